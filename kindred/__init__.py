"""Similarity search and analytics over labelled collections of sparse count vectors, on Spark."""
