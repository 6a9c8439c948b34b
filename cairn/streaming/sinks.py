"""Sinks of a stream: an event log, its outbox and a projection, written together and once each.

A batch is written to folders of its own number: ``events``, and ``outbox``, what others
are to be told of them.  A row in ``commits`` comes last and makes both visible.  A batch
that is delivered again writes the same folders again, so it counts once, wherever the
first attempt stopped.  The projection is the newest version of each key over all
committed events; ``compact`` folds committed batches into one, so that readers look at
the base and what came after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

COMMITS = "batch long, n_events long, n_outbox long, first_at timestamp, last_at timestamp"


class Store:
    """A log of events under ``path``, with the ``key`` and the ``version`` of what they are about.

    Events have a column ``at`` and any others; a null key is of no row of the projection.
    """

    def __init__(self, spark: SparkSession, path: str, schema, key: str, version: str) -> None:
        self.spark, self.path, self.schema, self.key, self.version = spark, path.rstrip("/"), schema, key, version

    def _read(self, name: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as error:  # nothing is written yet
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def commits(self) -> DataFrame:
        """What was written: a row a batch, for traces."""
        return self._read("commits", COMMITS)

    def base(self) -> int:
        """The last batch that is folded into the base; -1 if there is none."""
        return self._read("bases", "upto long").agg(F.coalesce(F.max("upto"), F.lit(-1))).first()[0]

    def _schema(self, *more: str):
        return self.spark.createDataFrame([], self.schema).select("*", *[F.lit(0).cast("long").alias(c) for c in more]).schema

    def _committed(self, name: str, schema, after: int = -1) -> DataFrame:
        done = self.commits().where(F.col("batch") > after).select("batch")
        # one number a batch: small beside the batches themselves, and joined by key all the same
        return self._read(name, schema).where(F.col("batch") > after).join(done, "batch", "left_semi")

    def events(self) -> DataFrame:
        """All committed events with their ``batch``."""
        return self._committed("events", self._schema("batch"))

    def outbox(self, schema) -> DataFrame:
        """What is to be told of the committed events; ``schema`` is that of the messages."""
        own = self.spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long")).schema
        return self._committed("outbox", own)

    def current(self) -> DataFrame:
        """The newest version of each key; of equal versions the first committed stays, so a late writer does not win."""
        upto = self.base()
        rows = self._committed("events", self._schema("batch"), upto)
        if upto >= 0:
            rows = rows.unionByName(self.spark.read.schema(self._schema("batch")).parquet(f"{self.path}/base/upto={upto}"))
        return self._newest(rows.where(F.col(self.key).isNotNull())).drop("batch")

    def _newest(self, rows: DataFrame) -> DataFrame:
        columns = [F.col(f"`{f.name}`") for f in self._schema("batch")]
        # the largest struct wins: a partial aggregate, so a key with very many events is reduced before the shuffle
        order = F.struct(F.col(self.version).alias("v"), (-F.col("batch")).alias("b"), F.unix_micros("at").alias("t"), F.xxhash64(F.to_json(F.struct(*columns))).alias("h"))
        best = rows.groupBy(self.key).agg(F.max_by(F.struct(*columns), order).alias("_r"))
        return best.select("_r.*")

    def write(self, batch: DataFrame, number: int, messages: Callable[[DataFrame], DataFrame]) -> None:
        """One batch: its events, what ``messages`` makes of them, and then its commit."""
        if not self.commits().where(F.col("batch") == number).isEmpty():
            return
        seen = Observation()
        counted = batch.select(*self._schema().names).observe(seen, F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
        events = f"{self.path}/events/batch={number}"
        counted.write.mode("overwrite").parquet(events)
        told = messages(self.spark.read.schema(self._schema()).parquet(events))
        also = Observation()
        told.observe(also, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{self.path}/outbox/batch={number}")
        row = self.spark.range(1).select(F.lit(number).cast("long").alias("batch"), F.lit(seen.get["n"]).alias("n_events"), F.lit(also.get["n"]).alias("n_outbox"), F.lit(seen.get["first"]).cast("timestamp").alias("first_at"), F.lit(seen.get["last"]).cast("timestamp").alias("last_at"))
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def compact(self) -> int:
        """Folds all committed batches into the base; returns the last of them."""
        upto = self.commits().agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]
        if upto > self.base():
            rows = self._committed("events", self._schema("batch"), self.base())
            if self.base() >= 0:
                rows = rows.unionByName(self.spark.read.schema(self._schema("batch")).parquet(f"{self.path}/base/upto={self.base()}"))
            self._newest(rows.where(F.col(self.key).isNotNull())).write.mode("overwrite").parquet(f"{self.path}/base/upto={upto}")
            self.spark.range(1).select(F.lit(upto).cast("long").alias("upto")).coalesce(1).write.mode("append").parquet(f"{self.path}/bases")
        return upto

    def attach(self, stream: DataFrame, messages: Callable[[DataFrame], DataFrame], **trigger) -> StreamingQuery:
        """Starts the stream into this store; ``availableNow=True`` unless another trigger is given.

        The stream's checkpoint lies within the store, so that the numbers of its batches are the store's own.
        """
        writer = stream.writeStream.foreachBatch(lambda batch, number: self.write(batch, number, messages))
        return writer.option("checkpointLocation", f"{self.path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def numbered(rows: DataFrame, key: str, at: str) -> DataFrame:
    """``version`` of each row among those of its key in a batch table, for logs that have none."""
    return rows.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(at)))
