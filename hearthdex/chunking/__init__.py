"""chunking of hearthdex."""
