"""Column builders, deterministic random numbers and scalar functions."""
