"""Question streams against a batch index."""
