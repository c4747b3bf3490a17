"""Tensors as long tables, their algebra, and factorizations as iterative DataFrame jobs."""
