"""Running score tables over a stream."""
