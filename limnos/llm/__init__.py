"""Operators for preparing training corpora (text, vectors, token files)."""
