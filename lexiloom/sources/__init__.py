"""Readers and writers of text-annotation formats."""
