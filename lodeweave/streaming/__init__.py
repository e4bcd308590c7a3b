"""Structured Streaming forms of the stateful operators; each equals its batch form on the same rows."""
