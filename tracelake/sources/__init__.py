"""Readers that turn collected evidence into artifact records."""
