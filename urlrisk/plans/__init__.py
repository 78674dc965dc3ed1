"""Plans that compose operators, and the registered queries."""
