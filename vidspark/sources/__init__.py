"""Readers and writers: frame folders and tables, model files, trajectories, features."""
