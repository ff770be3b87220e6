"""Readers of raw feeds, tables and dictionaries, and the sinks of each stage."""
