"""Scoring new measurements as they land (O2 on a streaming source)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from limnos.plans.score import MIN_REL_SIGMA, score_batch
from limnos.session import ensure_checkpoint_dir


def score_stream(model, stream: DataFrame, roles: Mapping[str, str] | None = None, prefix: str = "DO",
                 min_rel_sigma: float = MIN_REL_SIGMA) -> DataFrame:
    """O2 on a streaming DataFrame: same columns as ``score_batch``."""
    if not stream.isStreaming:
        raise ValueError("score_stream expects a streaming DataFrame; use score_batch for batch input")
    return score_batch(model, stream, roles, prefix, min_rel_sigma)


def start_scoring(scored: DataFrame, path: str, name: str, fmt: str = "parquet",
                  trigger_once: bool = False) -> StreamingQuery:
    """Append scored rows to ``path``; the stream checkpoint lives under the
    session's shared ``spark.checkpoint.dir`` so a restarted driver resumes."""
    base = ensure_checkpoint_dir(scored.sparkSession)
    w = (scored.writeStream.format(fmt).outputMode("append").option("path", path)
         .option("checkpointLocation", f"{base.rstrip('/')}/streams/{name}"))
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
