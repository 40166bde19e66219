"""Whole jobs, composed of operators: prepare, train, predict, evaluate, compare."""
