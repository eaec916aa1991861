"""fieldframe operators."""
