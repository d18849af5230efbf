"""Checks over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rulequarry.plans.engine import run_checks
from rulequarry.sources.config import Rule


def check_stream(files: DataFrame, rules: list[Rule], sink: str, checkpoint: str) -> StreamingQuery:
    """Issues of each micro-batch of ``files(path, source)`` as Parquet below ``sink``, one folder a batch, so that a batch that is run again replaces itself.

    Rules that need the whole module graph see one batch only.
    """

    def one(batch: DataFrame, number: int) -> None:
        run_checks(batch, rules).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
