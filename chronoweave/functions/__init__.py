"""Column-level helpers: everything here builds Catalyst expressions."""
