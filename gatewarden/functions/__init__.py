"""Column-expression helpers and fixed values used inside the operators."""
