"""store of hearthdex."""
