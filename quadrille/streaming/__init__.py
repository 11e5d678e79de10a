"""Moving objects over time, in batch and as streams."""
