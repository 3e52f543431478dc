"""Structured Streaming forms of annotation sync, job progress and reading position."""
