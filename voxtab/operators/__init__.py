"""Operators over catalogue, pixel and tag tables."""

from voxtab.sources import views  # noqa: F401  tables that operators build from the given ones
