"""Fleet-scan assessment as DataFrame operations."""
