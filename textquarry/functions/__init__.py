"""textquarry functions."""
