"""driftline.plans."""
