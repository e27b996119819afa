"""Operators over documents, ranges, passages, sections and conversations."""
