"""Readers: files or message streams to DataFrames."""
