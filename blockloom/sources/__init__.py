"""Readers: files in, DataFrames with a document order out."""
