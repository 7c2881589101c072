"""plans of the packet engine."""
