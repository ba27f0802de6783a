"""Balanced label propagation: linked documents move to one shard, shards keep equal row counts.

Documents with equal texts are linked. A group of copies is kept as one hub that
counts its members in each shard, so no link list ever grows with the square of
the group. In each round every group names the shard that holds most of it, and its other
members ask to move there. A shard takes as many as it has room for or unlinked rows to give
away, which then go to shards below their quota; who may go is read from counts of hashed
groups, never from a ranking in one task. At the end all documents are put into one order by
label and group, and the order is cut into shards whose counts differ by one
at most, so only a group at a cut can be parted by it.

Law: ``rows``. Defined cases: a null or empty text has size 1, and those texts are copies of
each other; rows with equal or null doc_id are rows of their own; an empty table
gives no rows; fewer rows than shards leave the last shards empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .common import text_rows

SHARDS = 16
ROUNDS = 3
GROUP_BINS = 256  # of the counts by which movers are admitted
FREE_BINS = 1024  # of the counts by which unlinked rows make room
BIN_ROWS = 50_000  # rows of one numbering task


def hubs(rows: DataFrame, total: int, shards: int) -> DataFrame:
    """Adds ``hub`` and ``single``. A group that would fill more than half a shard is several hubs."""
    most = max(1, total // (2 * shards))
    sizes = rows.groupBy("text_key").agg(F.count("*").alias("n")).filter("n > 1")
    part = F.pmod(F.xxhash64(F.lit(1), "row"), F.ceil(F.col("n") / most))
    hub = F.when(F.col("n").isNull(), F.xxhash64("text_key")).otherwise(F.xxhash64("text_key", part))
    return rows.join(sizes, "text_key", "left").select("row", "text_key", hub.alias("hub"), F.col("n").isNull().alias("single"))


def labelled(rows: DataFrame, shards: int) -> DataFrame:
    """Rows with a first label that depends on the row's number alone."""
    return rows.withColumn("label", F.pmod(F.xxhash64(F.lit(3), "row"), F.lit(shards)).cast("int"))


def cut_links(labels: DataFrame) -> DataFrame:
    """links and cut: links of every copy to one of its group, and those between two shards."""
    held = labels.groupBy("text_key", "label").agg(F.count("*").alias("n"))
    stars = held.groupBy("text_key").agg((F.sum("n") - 1).alias("links"), (F.sum("n") - F.max("n")).alias("cut"))
    return stars.agg(F.sum("links").alias("links"), F.sum("cut").alias("cut"))


def _bin(seed: int, column: str, bins: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(bins)).cast("int")


def join_neighbours(labels: DataFrame, total: int, shards: int, turn: int) -> DataFrame:
    """Members move to the shard that holds most of their hub, as far as its quota goes."""
    linked = labels.filter("not single")
    held = linked.groupBy("hub", "label").agg(F.count("*").alias("n"))
    # The shard with most members; the smaller number among equals.
    wanted = held.groupBy("hub").agg(F.max(F.struct("n", (-F.col("label")).alias("low")))["low"].alias("low"), F.count("*").alias("parts"))
    wanted = wanted.filter("parts > 1").select("hub", (-F.col("low")).alias("target"), _bin(100 + turn, "hub", GROUP_BINS).alias("bin"))
    # At most shards * shards * GROUP_BINS rows, and so are the tables made from it.
    asks = written(
        held.join(wanted, "hub").filter("label <> target").groupBy("label", "target", "bin").agg(F.sum("n").alias("n")), "shard-asks"
    )
    quota = labels.groupBy("label").agg(F.count("*").alias("n"), F.count_if("single").alias("free")).select(
        F.col("label").alias("target"),
        (F.greatest(F.lit(-(-total // shards)) - F.col("n"), F.lit(0)) + F.col("free")).alias("quota"),
    )
    asked = asks.groupBy("target").agg(F.sum("n").alias("asked"))
    flows = asks.groupBy("label", "target").agg(F.sum("n").alias("want")).join(asked, "target").join(quota, "target")
    flows = flows.select("label", "target", F.floor(F.col("quota") * F.col("want") / F.col("asked")).alias("quota"))
    upto = Window.partitionBy("label", "target").orderBy("bin")
    admitted = asks.withColumn("upto", F.sum("n").over(upto)).join(flows, ["label", "target"]).filter("upto <= quota")
    moves = wanted.join(F.broadcast(admitted.select("label", "target", "bin")), ["target", "bin"]).select("hub", "label", "target")
    return labels.join(moves, ["hub", "label"], "left").select("row", "text_key", "hub", "single", F.coalesce("target", "label").alias("label"))


def make_room(labels: DataFrame, total: int, shards: int, turn: int) -> DataFrame:
    """Unlinked rows leave shards beyond their quota for those below it. No link is cut by that."""
    binned = labels.withColumn("bin", _bin(200 + turn, "row", FREE_BINS))
    sizes = written(labels.groupBy("label").agg(F.count("*").alias("n")), "shard-sizes")  # one row per shard
    quota = F.lit(total / shards)
    before = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    over = sizes.select("label", F.greatest(F.floor(F.col("n") - quota), F.lit(0)).alias("excess"))
    over = over.withColumn("start", F.coalesce(F.sum("excess").over(before), F.lit(0)))
    every = sizes.sparkSession.range(shards).select(F.col("id").cast("int").alias("label")).join(sizes, "label", "left")
    under = every.select("label", F.greatest(F.ceil(quota - F.coalesce("n", F.lit(0))), F.lit(0)).alias("lack"))
    under = under.withColumn("low", F.coalesce(F.sum("lack").over(before), F.lit(0)))
    under = under.select(F.col("label").alias("target"), "low", (F.col("low") + F.col("lack")).alias("high"))
    free = binned.filter("single").groupBy("label", "bin").agg(F.count("*").alias("n"))
    free = free.withColumn("upto", F.sum("n").over(Window.partitionBy("label").orderBy("bin")))
    leaving = free.join(F.broadcast(over), "label").filter("upto <= excess").withColumn("at", F.col("start") + F.col("upto") - F.col("n"))
    # At most shards * FREE_BINS rows against one row per shard.
    moves = leaving.join(F.broadcast(under), (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high"))).select("label", "bin", "target")
    moved = binned.join(F.broadcast(moves), ["label", "bin"], "left")
    label = F.when(F.col("single"), F.coalesce("target", "label")).otherwise(F.col("label"))
    return moved.select("row", "text_key", "hub", "single", label.alias("label"))


def numbered(labels: DataFrame, total: int) -> DataFrame:
    """Adds ``rank``, gapless from 0, in the order of label and group."""
    parts = max(1, -(-total // (GROUP_BINS * BIN_ROWS)))
    keys = {
        "group_bin": _bin(7, "text_key", GROUP_BINS), "row_bin": _bin(9, "row", 8 * parts),
    }
    binned = labels.withColumns(keys)
    by = ["label", "group_bin", "row_bin"]
    counts = binned.groupBy(*by).agg(F.count("*").alias("n"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("label").orderBy("group_bin", "row_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = counts.groupBy("label").agg(F.sum("n").alias("size"))
    # One row per label: a window over all of them is as small as the number of shards.
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offsets = counts.withColumn("within", within).join(F.broadcast(before.select("label", "before")), "label")
    offsets = offsets.select(*by, (F.col("before") + F.col("within")).alias("offset"))
    order = Window.partitionBy(*by).orderBy("text_key", "row")
    return binned.withColumn("place", F.row_number().over(order) - 1).join(offsets, by).withColumn("rank", F.col("offset") + F.col("place"))


def cut_evenly(rank: Column, total: int, shards: int) -> tuple[Column, Column]:
    """Shard and slot of a rank; the first shards get one row more where the total does not divide."""
    small, more = divmod(total, shards)
    edge = more * (small + 1)
    shard = F.when(rank < edge, F.floor(rank / (small + 1))).otherwise(more + F.floor((rank - edge) / max(small, 1)))
    slot = F.when(rank < edge, rank % (small + 1)).otherwise((rank - edge) % max(small, 1))
    return shard.cast("int"), slot.cast("long")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    base = text_rows(docs).select(
        "doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32("text").alias("text_crc32"),
        F.unhex(F.md5("text")).alias("text_key"),
    )
    # A number of its own for every row: it is stored, so it stays the same whatever is lost.
    rows = written(base.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    total = rows.count()
    labels = written(labelled(hubs(rows.select("text_key", "row"), total, shards), shards), "shard-labels")
    for turn in range(rounds):
        labels = written(join_neighbours(labels, total, shards, turn), "shard-labels")
        labels = written(make_room(labels, total, shards, turn), "shard-labels")
    shard, slot = cut_evenly(F.col("rank"), total, shards)
    placed = numbered(labels, total).select("row", shard.alias("shard"), slot.alias("slot"))
    return rows.join(placed, "row").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
