"""How operators are laid out over partitions, and the registered queries."""
