"""memlake plans."""
