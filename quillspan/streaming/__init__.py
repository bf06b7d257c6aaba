"""Streams of transcripts, usage and events."""
