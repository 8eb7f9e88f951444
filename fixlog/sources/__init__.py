"""Graphs from files and to files."""
