"""Plain SQL twins of the registered queries, for the correctness check."""
