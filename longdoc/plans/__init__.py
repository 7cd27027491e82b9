"""Compositions of the operators: the reference's three flows (prepare data,
test/generate, score a result file) and the registered queries."""
