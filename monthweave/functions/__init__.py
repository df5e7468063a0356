"""Column helpers and small DataFrame utilities shared by the operators."""
