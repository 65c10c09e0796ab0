"""memlake functions."""
