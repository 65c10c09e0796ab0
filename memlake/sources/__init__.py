"""memlake sources."""
