"""Clone detection over arriving functions."""
