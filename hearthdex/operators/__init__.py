"""operators of hearthdex."""
