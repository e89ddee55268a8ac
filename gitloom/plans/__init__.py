from gitloom.plans import answers, bundles, evidence, history, ingest, memory, text  # noqa: F401
from gitloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
