"""Readers of folders of binary and text files as DataFrames, and inference of their layouts."""
