"""Readers and writers for tables, streams, lists and rules."""
