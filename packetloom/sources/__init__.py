"""sources of the packet engine."""
