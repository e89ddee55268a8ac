"""Documents as bytes that can be compared: canonical JSON, hashes, and who asked for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUNS = 20


def canonical(fields: dict[str, Column]) -> Column:
    """JSON with sorted keys, no spaces, NULLs written out and non-ASCII kept."""
    ordered = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return F.to_json(ordered, {"ignoreNullFields": "false"})


def newest_runs(runs: DataFrame, limit: int = RUNS) -> DataFrame:
    return runs.orderBy(F.desc("run_no")).limit(limit)
