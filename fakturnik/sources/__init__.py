"""Readers and writers: files, PDF, images, JSON, CSV and batch summaries."""
