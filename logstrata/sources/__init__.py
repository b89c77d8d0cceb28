"""Readers, archive unpacking, file catalogue and sinks."""
