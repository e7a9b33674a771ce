"""Readers, input views and sinks."""
