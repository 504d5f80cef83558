"""Readers and writers of captures and plans."""
