"""driftline.operators."""
