"""textquarry sources."""
