"""Compositions of operators: the layer chain and its backfill."""
