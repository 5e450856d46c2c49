"""driftline: versioned web-content analytics expressed as Spark plans."""
