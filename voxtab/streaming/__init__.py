"""Jobs over the log of viewing requests."""
