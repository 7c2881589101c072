"""operators of the packet engine."""
