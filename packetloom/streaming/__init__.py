"""streaming of the packet engine."""
