"""streaming of hearthdex."""
