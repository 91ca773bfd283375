"""functions of hearthdex."""
