"""Stand-in bindings of the operators to the driver's tables, and their oracle SQL."""
