"""Readers and writers of the workload's files."""
