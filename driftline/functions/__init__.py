"""driftline.functions."""
