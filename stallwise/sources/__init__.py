"""Readers, sinks and session helpers."""
