"""Readers of server logs and of range feeds."""
