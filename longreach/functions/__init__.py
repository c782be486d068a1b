"""Package of longreach."""
