"""graphfield: random-effects analytics on two-sided graphs, Spark first."""
