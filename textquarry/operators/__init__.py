"""textquarry operators."""
