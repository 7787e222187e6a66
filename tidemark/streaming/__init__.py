"""Streams of changes into a repository."""
