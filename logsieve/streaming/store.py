"""Counts by key that a stream updates, kept in a log-structured store.

Layout below one folder::

    updates/<batch>              changed counts of one batch
    merged/<batch>               the newest count of every open key up to that batch
    sealed/<level>-<from>-<to>   final counts of closed windows, never changed again

Every few batches the updates are merged. Keys of windows that no later row can reach
leave the merged part for good and become a sealed segment; as many segments of one level as
``FANOUT`` become one of the next. So a reader opens one merged part, the few updates
since then and a number of segments that grows with the logarithm of the batches.

A part counts once it is written to its end (its ``_SUCCESS`` file is there). ``merged`` is
written after the sealed segment of the same batch and publishes it: a segment
beyond the newest merged part is left over from a job that died, and is removed before the
next merge. A repeated batch replaces its own update, or nothing if it is merged already.
What a merge supersedes stays until the next merge, for readers that are still at it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import Folder

MERGE_EVERY = 10
FANOUT = 8
ROWS_PER_FILE = 2_000_000


@dataclass(frozen=True)
class Closing:
    """When a window is closed: its start column (epoch seconds), its width and the watermark's delay."""

    start: str
    width: int
    delay: int


@dataclass(frozen=True)
class Segment:
    level: int
    first: int
    last: int

    @classmethod
    def named(cls, name: str) -> Segment:
        return cls(*map(int, name.split("-")))

    @property
    def name(self) -> str:
        return f"{self.level}-{self.first}-{self.last}"


class CountStore:
    """The newest ``cnt`` of every key; ``keys`` are the label columns of the counts."""

    def __init__(
        self, spark: SparkSession, path: str, keys: Sequence[str], closing: Closing | None = None, merge_every: int = MERGE_EVERY
    ) -> None:
        self.spark, self.path, self.keys, self.closing, self.merge_every = spark, path.rstrip("/"), list(keys), closing, merge_every

    def _folder(self, part: str) -> Folder:
        return Folder(self.spark, f"{self.path}/{part}")

    def _finished(self, part: str) -> list[int]:
        return sorted(int(name) for name in self._folder(part).finished())

    def merged_upto(self) -> int:
        """The batch up to which the updates are merged, -1 for none."""
        return max(self._finished("merged"), default=-1)

    def segments(self) -> list[Segment]:
        """The published segments, without those that a segment of a higher level holds."""
        upto = self.merged_upto()
        found = [segment for segment in map(Segment.named, self._folder("sealed").finished()) if segment.last <= upto]
        return [
            one for one in found
            if not any(other.level > one.level and other.first <= one.first and one.last <= other.last for other in found)
        ]

    def _newest(self) -> DataFrame | None:
        """Newest count of each key that is not sealed."""
        upto = self.merged_upto()
        parts = [(upto, f"{self.path}/merged/{upto}")] if upto >= 0 else []
        parts += [(batch, f"{self.path}/updates/{batch}") for batch in self._finished("updates") if batch > upto]
        if not parts:
            return None
        rows = [self.spark.read.parquet(path).withColumn("_batch", F.lit(batch)) for batch, path in parts]
        return reduce(DataFrame.unionByName, rows).groupBy(*self.keys).agg(F.max_by("cnt", "_batch").alias("cnt"))

    def counts(self) -> DataFrame:
        """One row per key with its newest count."""
        newest = self._newest()
        if newest is None:
            raise FileNotFoundError(f"no counts below {self.path}")
        sealed = [self.spark.read.parquet(f"{self.path}/sealed/{segment.name}") for segment in self.segments()]
        return reduce(DataFrame.unionByName, sealed, newest)

    def update(self, counts: DataFrame, batch_id: int) -> None:
        """Store the changed counts of a batch; merge if enough batches have come."""
        upto = self.merged_upto()
        if batch_id <= upto:
            return
        counts.select(*self.keys, "cnt").write.mode("overwrite").parquet(f"{self.path}/updates/{batch_id}")
        if batch_id - upto >= self.merge_every:
            self.merge(batch_id)

    def _write(self, rows: DataFrame, path: str) -> None:
        rows = rows.persist()
        try:
            rows.coalesce(1 + rows.count() // ROWS_PER_FILE).write.mode("overwrite").parquet(path)
        finally:
            rows.unpersist()

    def merge(self, upto: int) -> None:
        """Merge everything up to a batch, seal closed windows and drop what the last merge superseded."""
        before = self.merged_upto()
        sealed = self._folder("sealed")
        for name in sealed.names():
            if Segment.named(name).last > before:
                sealed.remove(name)
        newest = self._newest()
        if self.closing is not None:
            start, after = F.col(self.closing.start), self.closing.width + self.closing.delay
            last = newest.agg(F.max(start)).first()[0]
            if last is not None:
                closed = start <= F.lit(last - after)
                self._write(newest.filter(closed), f"{self.path}/sealed/0-{before + 1}-{upto}")
                newest = newest.filter(~F.coalesce(closed, F.lit(False)))
        self._write(newest, f"{self.path}/merged/{upto}")
        merged, updates = self._folder("merged"), self._folder("updates")
        for folder in (merged, updates):
            for name in folder.names():
                # Updates up to the part before this one were superseded by it.
                if int(name) < before or (folder is updates and int(name) <= before):
                    folder.remove(name)
        self._raise_segments()

    def _raise_segments(self) -> None:
        """Make FANOUT segments of a level one of the next, level by level."""
        folder = self._folder("sealed")
        shown = self.segments()
        for name in folder.names():
            if Segment.named(name) not in shown:
                folder.remove(name)  # raised at an earlier merge
        level = 0
        while any(segment.level >= level for segment in shown):
            mine = sorted((segment for segment in shown if segment.level == level), key=lambda one: one.first)
            if len(mine) >= FANOUT:
                higher = Segment(level + 1, mine[0].first, mine[-1].last)
                rows = self.spark.read.parquet(*[f"{self.path}/sealed/{segment.name}" for segment in mine])
                self._write(rows, f"{self.path}/sealed/{higher.name}")
                shown = self.segments()
            level += 1
