"""DataFrame operators: neighbour search, posteriors, dependence statistics, fronts, encoding."""
