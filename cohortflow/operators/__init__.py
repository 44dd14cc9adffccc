"""DataFrame jobs of the engine."""
