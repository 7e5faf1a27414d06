"""Readers and writers of sequence, alignment, hit and structure formats as DataFrames with explicit schemas."""
