"""Clients and cadence over a stream of entries."""
