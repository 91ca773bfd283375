"""embedding of hearthdex."""
