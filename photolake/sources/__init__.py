"""Readers and writers: files in, tables and files out."""
