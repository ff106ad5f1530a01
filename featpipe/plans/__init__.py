"""Plan-level building blocks: ordered computations, SQL step graphs, size checks."""
