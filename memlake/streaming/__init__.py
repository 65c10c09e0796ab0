"""memlake streaming."""
