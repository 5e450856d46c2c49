"""driftline.streaming."""
