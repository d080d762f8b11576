"""Files and logs as streams."""
