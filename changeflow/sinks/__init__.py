"""Sinks by plugin name: what a batch of changes becomes for each kind of target, and who writes it."""
