"""Structured Streaming forms of the file trigger, duplicate suppression and poll completion."""
