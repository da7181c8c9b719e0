"""Delivery of alerts: a table of what is to be sent, and a table of what has been sent."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Sends rows, which carry their ``delivery_key``; raises if they could not be sent.
Send = Callable[[DataFrame], None]


class Outbox:
    """Rows wait on shared storage until ``send`` has taken them.

    ``put`` is a batch function for streams: a batch that runs again replaces its rows, and a row whose key was delivered
    is not sent again. If ``send`` raises, its rows stay and go out with the next batch or ``deliver``, also after a
    restart. Only if a driver is lost between ``send`` and the note that it returned are rows sent twice, with
    the same ``delivery_key``.
    """

    def __init__(self, folder: str, send: Send, keys: Sequence[str] = ("source", "window_start"), stop_on_failure: bool = False) -> None:
        self.folder, self.send, self.keys, self.stop_on_failure = folder.rstrip("/"), send, list(keys), stop_on_failure
        self.failures: list[str] = []

    def put(self, batch: DataFrame, number: int) -> None:
        key = F.sha2(F.to_json(F.struct(*self.keys)), 256)
        batch.withColumn("delivery_key", key).write.mode("overwrite").parquet(f"{self.folder}/waiting/batch={number}")
        self.deliver(batch.sparkSession)

    def _read(self, spark: SparkSession, name: str) -> DataFrame | None:
        try:
            return spark.read.option("mergeSchema", "true").parquet(f"{self.folder}/{name}")
        except AnalysisException:
            return None

    def pending(self, spark: SparkSession) -> DataFrame | None:
        """Rows not delivered yet, one for each key."""
        waiting, delivered = self._read(spark, "waiting"), self._read(spark, "delivered")
        if waiting is None:
            return None
        rows = waiting.drop("batch").dropDuplicates(["delivery_key"])
        return rows if delivered is None else rows.join(delivered.select("delivery_key").distinct(), "delivery_key", "left_anti")

    def deliver(self, spark: SparkSession) -> int:
        """Sends what waits; returns how many rows went out."""
        rows = self.pending(spark)
        if rows is None or not rows.head(1):
            return 0
        attempt = f"{self.folder}/attempts/{uuid.uuid4().hex}"
        rows.write.parquet(attempt)
        stored = spark.read.schema(rows.schema).parquet(attempt)
        try:
            self.send(stored)
        except Exception as exc:  # noqa: BLE001 - whatever a sender raises, the rows stay
            self.failures.append(f"{type(exc).__name__}: {exc}")
            if self.stop_on_failure:
                raise
            return 0
        stored.select("delivery_key").write.mode("append").parquet(f"{self.folder}/delivered")
        return stored.count()
