"""Readers and writers with fail-closed contracts."""
