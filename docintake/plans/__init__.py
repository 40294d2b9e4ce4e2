from docintake.plans import chat, checks, intake, records, streams  # noqa: F401
from docintake.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
