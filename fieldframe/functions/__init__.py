"""fieldframe functions."""
