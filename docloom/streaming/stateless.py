"""The stateless stages over a stream: $match, $project and $unwind compile to the same columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from docloom.errors import NotSupported
from docloom.operators.pipeline import Flow, parse_pipeline, run_pipeline

STATELESS = {"$match", "$project", "$unwind"}


def stream(df: DataFrame, pipeline: list[dict[str, Any]], null_means: str = "null") -> DataFrame:
    """Apply a pipeline of stateless stages to a streaming (or static) DataFrame."""
    stages = parse_pipeline(pipeline)
    for op, _ in stages:
        if op not in STATELESS:
            raise NotSupported(f"{op} on a stream")
    return run_pipeline(Flow(df, (), null_means), stages)
