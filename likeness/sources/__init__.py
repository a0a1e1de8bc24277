"""Readers and writers for tables, task files and result sets."""
