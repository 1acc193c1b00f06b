"""Readers and writers for record logs, tables and exports."""
