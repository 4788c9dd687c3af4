"""Candidate-retrieval analytics on Spark: codes, search structures, retrieval metrics and the kernels under them."""
