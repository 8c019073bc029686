"""Readers and writers for the tables and text formats."""
