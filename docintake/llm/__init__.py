"""Operators for training-data pipelines."""

from docintake.llm.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
