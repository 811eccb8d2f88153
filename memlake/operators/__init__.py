"""Operators over DataFrames: chunking, retrieval, vectors, graphs, memory, listing, evaluation."""
