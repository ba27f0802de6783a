"""Benchmark decontamination by spaced seeds, with built-in functions only.

Words are lower-cased and freed of punctuation. A fixed mask looks at some positions and ignores
the others, so two passages that differ in an ignored word still share the hash. Masks are laid at
every position of every benchmark item and every document; equal hashes give (document, item,
shift) hits, and around each hit the two texts are compared word by word on that shift. A hit
counts where ``OVERLAP`` consecutive positions agree in at least ``AGREE`` of them, or in the same
share of a shorter item.

The masks are chosen so that wherever the words that differ lie in such a stretch, one mask fits
between them; items shorter than the stretch have masks for their own length, and items of three or
four words count where a document holds exactly their words in a row. One or two words stand in
clean documents by chance: items of fewer than ``LEAST`` words are not searched.

Defined cases: null and empty texts have no hits; rows with equal or null doc_id and the
same text share their hits; repeated items are items of their own; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .common import words_of

# 1: the position is looked at. By the length of the stretch, that of the item or OVERLAP at most.
MASKS = {
    3: ("111",),
    4: ("1111",),
    5: ("1111", "11101", "11011", "10111"),
    6: ("1111", "11011"),
    7: ("11111", "111011", "110111"),
    8: ("111011", "11111"),
    9: ("111011", "1001111", "11010011", "111101"),
    10: ("111011", "11010011", "11111"),
    11: ("1101011", "1110011"),
    12: ("11101011", "1101000111", "111111"),
    13: ("11101011", "1100100111", "111111", "11001010011", "1100011011", "1111011"),
}
ALL_MASKS = sorted({mask for masks in MASKS.values() for mask in masks})
OVERLAP = 13
AGREE = 10
LEAST = 3
PUNCTUATION = ".,;:!?\"'()[]{}<>*#$%&|_~`/\\^+=@-"
# Seeds of the benchmark are sent to all tasks up to so many; beyond it both sides are shuffled.
BROADCAST_SEEDS = 2_000_000


def plain_words(text: Column) -> Column:
    return words_of(F.translate(F.lower(text), PUNCTUATION, ""))


def _seed(words: str, at: str, mask: str, number: int) -> Column:
    """Hash of the words under a mask; null where the mask leaves the text."""
    looked = [F.expr(f"get({words}, {at} + {i})") for i, one in enumerate(mask) if one == "1"]
    return F.when(F.expr(f"{at} + {len(mask)} <= size({words})"), F.xxhash64(F.lit(number), *looked))


def seeds(rows: DataFrame, masks: list[str]) -> DataFrame:
    """The rows, once for each position and mask: ``at`` and ``seed``. Needs an array ``hashes``."""
    placed = rows.select("*", F.explode(F.expr("case when size(hashes) > 0 then sequence(0, size(hashes) - 1) else array() end")).alias("at"))
    found = F.array(*[_seed("hashes", "at", mask, ALL_MASKS.index(mask)) for mask in masks])
    return placed.select("*", F.explode(found).alias("seed")).filter("seed is not null")


def hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hashes", F.transform("words", lambda word: F.xxhash64(word)))


def item_rows(benchmark: DataFrame) -> DataFrame:
    """item (a number for every row), item_id and words."""
    rows = benchmark.select("item_id", plain_words(F.coalesce("text", F.lit(""))).alias("words"))
    return written(rows.filter(F.size("words") >= LEAST).withColumn("item", F.monotonically_increasing_id()), "benchmark")


def stretch() -> Column:
    """How many words of an item have to be compared at once."""
    return F.least(F.lit(OVERLAP), F.size("words"))


def item_seeds(items: DataFrame, widths: list[int]) -> DataFrame:
    """seed, item, item_at: the masks of an item's stretch at every position."""
    found = None
    for width in widths:
        some = seeds(hashed(items.filter(stretch() == width)), list(MASKS[width])).select("seed", "item", F.col("at").alias("item_at"))
        found = some if found is None else found.unionByName(some)
    return written(found.distinct(), "benchmark-seeds")


def document_seeds(docs: DataFrame, masks: list[str]) -> DataFrame:
    """d, key, seed and at, of every document."""
    base = docs.select(F.col("doc_id").cast("long").alias("d"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.select("d", F.xxhash64("text").alias("key"), plain_words(F.col("text")).alias("words"))
    return seeds(hashed(base), masks).select("d", "key", "seed", "at")


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """d, key, item, shift: where a mask of an item and of a document agree."""
    widths = [row[0] for row in items.select(stretch().alias("n")).distinct().orderBy("n").collect()] or [OVERLAP]
    wanted = item_seeds(items, widths)
    if wanted.count() <= BROADCAST_SEEDS:
        wanted = F.broadcast(wanted)
    found = document_seeds(docs, sorted({mask for width in widths for mask in MASKS[width]})).join(wanted, "seed")
    return found.select("d", "key", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """d, key, item, start, stop (words of the document) and matched, of verified hits."""
    by_doc = written(hits(docs, items), "benchmark-hits").groupBy("d", "key").agg(F.collect_set(F.struct("item", "shift")).alias("found"))
    base = docs.select(F.col("doc_id").cast("long").alias("d"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("key", F.xxhash64("text")).dropDuplicates(["d", "key"])
    same = base["d"].eqNullSafe(by_doc["d"]) & (base["key"] == by_doc["key"])
    texts = base.join(by_doc, same).select(base["d"], base["key"], plain_words(base["text"]).alias("doc_words"), "found")
    one = texts.select("d", "key", "doc_words", F.explode("found").alias("hit")).select(
        "d", "key", "hit.item", "hit.shift",
        # The stretch of the document that lies under the item, and where it begins.
        F.col("doc_words"),
    )
    sized = items.select("item", "item_id", F.col("words").alias("item_words"))
    pairs = one.join(sized, "item")
    low, high = F.greatest(F.lit(0), -F.col("shift")), F.least(F.size("item_words"), F.size("doc_words") - F.col("shift"))
    pairs = pairs.select(
        "d", "key", "item_id", "item", F.size("item_words").alias("size"), (low + F.col("shift")).alias("begin"),
        F.slice("item_words", low + 1, high - low).alias("a"), F.slice("doc_words", low + F.col("shift") + 1, high - low).alias("b"),
    )
    pairs = pairs.withColumn("same", F.zip_with("a", "b", lambda x, y: F.when(x == y, 1).otherwise(0))).drop("a", "b")
    width = F.least(F.lit(OVERLAP), F.col("size"))
    pairs = pairs.withColumn("width", width)

    def agreeing(start: Column, size: Column) -> Column:
        return F.aggregate(F.slice("same", start + 1, size), F.lit(0), lambda total, x: total + x)

    good = F.filter(
        F.expr("case when size(same) >= width then sequence(0, size(same) - width) else array() end"),
        lambda i: agreeing(i, F.col("width")) >= F.ceil(F.col("width") * AGREE / OVERLAP),
    )
    pairs = pairs.withColumn("good", good).filter(F.size("good") > 0)
    pairs = pairs.withColumns({"first": F.array_min("good"), "length": F.array_max("good") - F.array_min("good") + F.col("width")})
    return pairs.select(
        "d", "key", "item_id", (F.col("begin") + F.col("first")).alias("start"), (F.col("begin") + F.col("first") + F.col("length")).alias("stop"),
        agreeing(F.col("first"), F.col("length")).alias("matched"), "size",
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that overlap: the stretch of words and how many of them agree."""
    found = overlaps(docs, item_rows(benchmark))
    best = F.max(F.struct("matched", (F.col("stop") - F.col("start")).alias("length"), (-F.col("start")).alias("low"), "size"))
    return found.groupBy(F.col("d").alias("doc_id"), "item_id").agg(best.alias("best"), F.count("*").alias("n_overlaps")).select(
        "doc_id", "item_id", (-F.col("best.low")).cast("long").alias("start_word"), F.col("best.length").cast("long").alias("n_words"),
        F.col("best.matched").cast("long").alias("n_matched"), F.col("best.size").cast("long").alias("item_words"), "n_overlaps",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap no item."""
    found = written(overlaps(docs, item_rows(benchmark)).select("d", "key").distinct(), "contaminated")
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["d"]) & (key == found["key"]), "left_anti")
