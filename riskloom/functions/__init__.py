"""Column expressions: no DataFrame, no action, all evaluated by Spark itself."""
