"""Readers, sinks and the domain frames derived from the driver's tables."""
