"""textquarry plans."""
