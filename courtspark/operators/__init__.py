"""Operators over tracking tables: DataFrames in, DataFrames out."""
