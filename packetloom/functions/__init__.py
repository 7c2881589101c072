"""functions of the packet engine."""
