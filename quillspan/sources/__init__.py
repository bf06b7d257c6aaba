"""Readers of transcripts and spans, and writers of sessions."""
