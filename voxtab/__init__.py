"""Imaging data jobs on Spark: catalogue, tags, pixels, geometry, statistics and request logs as DataFrame jobs."""
