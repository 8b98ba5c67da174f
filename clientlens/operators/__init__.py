"""Grouping, enrichment, classification and rollups as DataFrame jobs."""
