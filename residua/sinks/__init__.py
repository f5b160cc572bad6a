"""Sinks: text tables and documents that are the same on every run."""
