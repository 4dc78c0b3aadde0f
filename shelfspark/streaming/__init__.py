"""Request streams."""
