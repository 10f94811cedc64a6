"""Column builders: each returns a Column and leaves the plan to Catalyst."""
