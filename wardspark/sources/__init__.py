"""Readers, writers, stage cuts and fixture views."""
