"""sources of hearthdex."""
