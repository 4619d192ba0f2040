"""Readers: files, page images, completions, gold sets."""
