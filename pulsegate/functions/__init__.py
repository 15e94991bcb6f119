"""Column builders: predicates, arithmetic, durations, JSON casts."""
