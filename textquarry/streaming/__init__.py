"""textquarry streaming."""
