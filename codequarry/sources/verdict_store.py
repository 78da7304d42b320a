"""A store of verdicts by key, kept as Parquet between runs, with a time to live.

Every ``put`` writes one segment beside the others and moves it into place by a
rename, so readers see all of it or nothing; of a key's rows the latest counts,
of equal times the greatest value. ``compact`` writes the live rows as one
segment first and removes the ones it has read after that, so a run that dies
between leaves rows twice at worst, never none. Entries older than the time to
live are not read, and go at the next compaction.

An empty or missing folder is an empty store. Null keys are never stored; a null
value is a value. Keys are compared after ``key_of``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, value string, at timestamp"
# How long reviews and registry answers hold, in seconds.
REVIEW_TTL, REGISTRY_TTL = 24 * 3600, 7 * 24 * 3600


def normalized_key(text: Column) -> Column:
    """Runs of white space are one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def key_of(*parts: Column) -> Column:
    """The first sixteen hex digits of the parts' digest; null parts count as empty."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[normalized_key(F.coalesce(p.cast("string"), F.lit(""))) for p in parts]), 256), 1, 16)


class VerdictStore:
    def __init__(self, spark: SparkSession, folder: str, ttl: int = REVIEW_TTL):
        self.spark, self.folder, self.ttl = spark, folder.rstrip("/"), ttl
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._fs = jvm.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def segments(self) -> list[str]:
        """Names of the segments in place; those being written begin with a dot."""
        here = self._path(self.folder)
        if not self._fs.exists(here):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(here)) if n.startswith("segment-"))

    def _write(self, rows: DataFrame) -> str:
        name = f"segment-{uuid.uuid4().hex}"
        rows.select("key", "value", "at").write.parquet(f"{self.folder}/.{name}")
        if not self._fs.rename(self._path(f"{self.folder}/.{name}"), self._path(f"{self.folder}/{name}")):
            raise OSError(f"{name} could not be moved into {self.folder}")
        return name

    def _rows(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.folder}/{n}" for n in names])

    def _live(self, rows: DataFrame, now: Column) -> DataFrame:
        rows = rows.filter(F.col("at") > now - F.make_dt_interval(secs=F.lit(self.ttl)))
        last = F.max(F.struct("at", F.coalesce("value", F.lit("")).alias("order"), "value"))
        return rows.groupBy("key").agg(last.alias("x")).select("key", "x.value", "x.at")

    def put(self, rows: DataFrame, now: Column | None = None) -> None:
        """Adds rows (key, value)."""
        self._write(rows.filter("key is not null").select("key", F.col("value").cast("string").alias("value"), (F.current_timestamp() if now is None else now).cast("timestamp").alias("at")))

    def read(self, now: Column | None = None) -> DataFrame:
        """key, value, at of each live key."""
        return self._live(self._rows(self.segments()), F.current_timestamp() if now is None else now.cast("timestamp"))

    def compact(self, now: Column | None = None) -> None:
        """One segment of the live rows instead of all segments there are now."""
        names = self.segments()
        if names:
            self._write(self._live(self._rows(names), F.current_timestamp() if now is None else now.cast("timestamp")))
            for name in names:
                self._fs.delete(self._path(f"{self.folder}/{name}"), True)

    def clear(self) -> None:
        for name in self.segments():
            self._fs.delete(self._path(f"{self.folder}/{name}"), True)

    def looked_up(self, rows: DataFrame, now: Column | None = None) -> DataFrame:
        """``rows`` (key, any others) with ``cached``, the stored value, and ``hit``, whether there is one."""
        known = self.read(now).select("key", F.col("value").alias("cached"), F.lit(True).alias("hit"))
        return rows.join(known, "key", "left").select(*[F.col(f"`{c}`") for c in rows.columns], "cached", F.coalesce("hit", F.lit(False)).alias("hit"))
