"""driftline.sources."""
