"""Computation graphs, their compilation, and training plans."""
