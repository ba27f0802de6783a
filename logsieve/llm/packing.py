"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token runs ("pieces") of at most ``capacity`` tokens, and the
pieces are packed into sequences of that size. A candidate packing is a set of
bins. Crossover takes well-filled bins of one parent whole, removes the bins
of the other parent that hold the same pieces, and best-fits the pieces that
lost their bin. Each shard of pieces is worked on by several islands with
their own random numbers; after each epoch every island receives the elite of
its neighbour. Sequences that stay badly filled are packed once more across
shards.

Defined cases: a null or empty text is the end token alone; rows with equal or
null ``doc_id`` are documents of their own; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .common import batches, text_rows

CAPACITY = 4096
END = 1
SHARD_PIECES = 4000
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
OFFSPRING = 6
WELL_FILLED = 0.985

_tokens: dict[str, tuple[object, dict[bytes, bytes]]] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Marks that can be cut off the end of a word: between an ASCII letter and these the vocabulary always splits.
END_MARKS = b".,;:!?#$%&*|)\""
A, Z = b"az"


class WordTokenizer:
    """Token ids of whole texts, one word at a time, with a bounded memory of words.

    The vocabulary never joins tokens over white space and ignores case, so a
    text's ids are the ids of its lower-cased words in order. Texts with a
    special token's opening mark keep their case, as those tokens do not ignore it.
    Words are remembered in two generations: when the young one is full it
    becomes the old one, from which words in use are taken over.
    """

    def __init__(self, path: str, limit: int = 400_000) -> None:
        from tokenizers import Tokenizer

        self._model, self._young, self._old, self._limit = Tokenizer.from_file(path), {}, {}, limit
        vocabulary = self._model.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[at for token, at in vocabulary.items() if token.endswith("</w>")]] = True

    def _encode(self, words: list[bytes]) -> None:
        texts = [word.decode() for word in words]
        letters = [i for i, text in enumerate(texts) if text.isalpha()]
        self._encode_together([words[i] for i in letters], [texts[i] for i in letters])
        rest = [i for i, word in enumerate(words) if word not in self._young]
        found = self._model.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)
        self._young.update((words[i], np.array(one.ids, "<u4").tobytes()) for i, one in zip(rest, found))

    def _encode_together(self, words: list[bytes], texts: list[str], size: int = 500) -> None:
        """Words of letters only end with one closing token each, so many fit in one call."""
        parts = range(0, len(words), size)
        found = self._model.encode_batch_fast([" ".join(texts[at : at + size]) for at in parts], add_special_tokens=False)
        for at, one in zip(parts, found):
            ids = np.array(one.ids, "<u4")
            stops = np.flatnonzero(self._ends[ids]) + 1
            part = words[at : at + size]
            if len(stops) == len(part):  # else they are encoded one by one
                raw, edges = ids.tobytes(), [0, *(4 * stops).tolist()]
                self._young.update((word, raw[a:b]) for word, a, b in zip(part, edges, edges[1:]))

    def _recall(self, words: set[bytes]) -> set[bytes]:
        """Takes words over from the old generation; gives those that are unknown."""
        words = words.difference(self._young)  # looks up the words; difference_update would walk all that is remembered
        kept = self._old.keys() & words
        if not kept:
            return words
        self._young.update(zip(kept, map(self._old.__getitem__, kept)))
        return words - kept

    def _learn(self, words: set[bytes]) -> None:
        split, needed = [], set()
        for word in self._recall(words):
            core = word.rstrip(END_MARKS)
            if core != word and core and A <= core[-1] <= Z and b"<|" not in word:
                tail = word[len(core) :]
                split.append((word, core, tail))
                needed.add(core)
                needed.add(tail)
            else:
                needed.add(word)
        if needed:
            self._encode(list(self._recall(needed)))
        young = self._young
        for word, core, tail in split:
            young[word] = young[core] + young[tail]

    def batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split, words = [], set()
        for text in texts:
            raw = text.encode()
            split.append((raw if b"<|" in raw else raw.lower()).split())
            words.update(split[-1])
        if len(self._young) + len(words) > self._limit:
            self._old, self._young = self._young, {}
        self._learn(words)
        ids = self._young.__getitem__
        return [b"".join(map(ids, run)) for run in split]


def _tokenizer(path: str) -> WordTokenizer:
    """One per worker process: its memory of words serves later tasks too."""
    if path not in _tokens:
        _tokens[path] = WordTokenizer(path)
    return _tokens[path]


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: uid, doc_id, piece, start, length, ids_crc32 and, if wanted, ids."""
    where = path or tokenizer_path()
    fields = [
        ("uid", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
        ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ]
    if keep_ids:
        fields.append(("ids", pa.list_(pa.int64())))
    schema = pa.schema(fields)
    size = 4 * capacity

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer, uid, end = _tokenizer(where), TaskContext.get().partitionId() << 36, np.array([END], "<u4").tobytes()
        for ids, texts in batches(source):
            rows = []
            for doc_id, found in zip(ids, tokenizer.batch(texts)):
                found += end
                for piece, at in enumerate(range(0, len(found), size)):
                    run = found[at : at + size]
                    row = [uid, doc_id, piece, at // 4, len(run) // 4, zlib.crc32(run)]
                    rows.append([*row, np.frombuffer(run, "<u4").astype(np.int64)] if keep_ids else row)
                    uid += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    kinds = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids
    return text_rows(docs).mapInArrow(cut, kinds)


def best_fit(lengths: list[int], items: list[int], assign: np.ndarray, fill: list[int], capacity: int, usable: list[int]) -> None:
    """Place items, longest first, each in the fullest usable bin that has room; else in a new bin."""
    room = sorted((capacity - fill[b]) << 32 | b for b in usable)
    for item in items:
        length = lengths[item]
        at = bisect_left(room, length << 32)
        if at < len(room):
            b = room.pop(at) & 0xFFFFFFFF
        else:
            b = len(fill)
            fill.append(0)
        fill[b] += length
        assign[item] = b
        if fill[b] < capacity:
            insort(room, (capacity - fill[b]) << 32 | b)


def fitness(assign: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    fill = np.bincount(assign, weights=lengths)
    fill = fill[fill > 0]
    return len(fill), -float(np.sum((fill / capacity) ** 2))


def first_packing(lengths: np.ndarray, capacity: int, rng: np.random.Generator, shake: float) -> np.ndarray:
    """Best fit by falling length, with lengths disturbed by up to ``shake`` for variety."""
    order = np.argsort(-lengths * (1 + shake * rng.random(len(lengths))), kind="stable")
    assign = np.full(len(lengths), -1, np.int64)
    best_fit(lengths.tolist(), order.tolist(), assign, [], capacity, [])
    return assign


def crossover(mother: np.ndarray, father: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """The mother's packing with well-filled bins of the father put in whole."""
    filled = np.bincount(father, weights=lengths)
    order = np.argsort(-filled, kind="stable")
    good = order[: max(1, len(order) // 2)]
    chosen = np.zeros(len(filled), bool)
    chosen[good[rng.random(len(good)) < rng.uniform(0.3, 0.8)]] = True
    injected = chosen[father]
    broken = np.zeros(mother.max() + 1, bool)
    broken[mother[injected]] = True
    child = mother.copy()
    displaced = np.flatnonzero(broken[mother] & ~injected)
    base = len(broken)
    child[injected] = base + father[injected]
    child[displaced] = -1
    kept = child >= 0
    fill = np.zeros(base + len(filled), np.int64)
    np.add.at(fill, child[kept], lengths[kept])
    bins = fill.tolist()
    items = displaced[np.argsort(-lengths[displaced], kind="stable")].tolist()
    best_fit(lengths.tolist(), items, child, bins, capacity, np.flatnonzero((fill > 0) & (fill < capacity)).tolist())
    return np.unique(child, return_inverse=True)[1]


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, rng: np.random.Generator) -> list[np.ndarray]:
    """A few generations on one island; stops when no bin can be saved any more."""
    least = -(-int(lengths.sum()) // capacity)
    shakes = [0.0, 0.05, 0.15, 0.3]
    while len(population) < POPULATION:
        population.append(first_packing(lengths, capacity, rng, shakes[len(population) % len(shakes)]))
        if fitness(population[-1], lengths, capacity)[0] == least:
            break
    rated = sorted(((fitness(p, lengths, capacity), i, p) for i, p in enumerate(population)), key=lambda x: x[:2])
    for step in range(OFFSPRING):
        if rated[0][0][0] == least or len(rated) < 2:
            break
        a, b = rng.choice(len(rated), 2, replace=False)
        child = crossover(rated[min(a, b)][2], rated[max(a, b)][2], lengths, capacity, rng)
        rated.append((fitness(child, lengths, capacity), len(population) + step, child))
        rated.sort(key=lambda x: x[:2])
        rated = rated[:POPULATION]
    return [p for _, _, p in rated]


STATE = "shard long, island int, place int, bins array<int>"


def _pack_shards(pieces: DataFrame, capacity: int, name: str) -> DataFrame:
    """uid, sequence, offset and the fill of the sequence, from (shard, uid, length)."""
    spark = pieces.sparkSession
    spread = pieces.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))

    def epoch(number: int):
        def run(key: tuple, items: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
            shard, island = int(key[0]), int(key[1])
            if not len(items):
                return pd.DataFrame({"shard": [], "island": [], "place": [], "bins": []})
            items = items.sort_values(["length", "uid"], ascending=[False, True])
            lengths = items["length"].to_numpy(np.int64)
            rng = np.random.default_rng([shard & 0xFFFFFFFF, island, number])
            before = [np.array(b, np.int64) for b in state.sort_values("place")["bins"]]
            after = evolve(lengths, before, capacity, rng)
            return pd.DataFrame({
                "shard": shard, "island": island, "place": range(len(after)), "bins": [p.astype(np.int32) for p in after],
            })

        return run

    state = spark.createDataFrame([], STATE)
    for number in range(EPOCHS):
        grouped = spread.groupBy("shard", "island").cogroup(state.groupBy("shard", "island"))
        state = written(grouped.applyInPandas(epoch(number), STATE), f"pack-{name}-{number}")
        # The elite of each island goes to the next island, which keeps its own best as well.
        moved = state.filter("place = 0").withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int"))
        state = state.filter(f"place < {POPULATION - 1}").unionByName(moved.withColumn("place", F.lit(POPULATION)))

    def place(key: tuple, items: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["length", "uid"], ascending=[False, True])
        lengths = items["length"].to_numpy(np.int64)
        best = min((np.array(b, np.int64) for b in state["bins"]), key=lambda b: fitness(b, lengths, capacity))
        order = np.argsort(best, kind="stable")
        bins, sizes = best[order], lengths[order]
        ends = np.cumsum(sizes)
        first = np.concatenate([[True], bins[1:] != bins[:-1]])
        opened = (ends - sizes)[first][np.cumsum(first) - 1]
        return pd.DataFrame({
            "uid": items["uid"].to_numpy()[order], "sequence": (int(key[0]) << 24) + np.cumsum(first) - 1,
            "offset": ends - sizes - opened, "fill": np.bincount(bins, weights=sizes).astype(np.int64)[bins],
        })

    found = pieces.groupBy("shard").cogroup(state.groupBy("shard"))
    return found.applyInPandas(place, "uid long, sequence long, offset long, fill long")


def _sharded(pieces: DataFrame, count: int) -> DataFrame:
    shards = max(1, -(-count // SHARD_PIECES))
    return pieces.select(F.pmod(F.xxhash64("uid"), F.lit(shards)).alias("shard"), "uid", "length")


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset. ``pieces`` must be a stored table (it is read several times)."""
    full = pieces.filter(F.col("length") == capacity)
    rest = pieces.filter(F.col("length") < capacity)
    once = written(_pack_shards(_sharded(rest, rest.count()), capacity, "first"), "packed")
    good = once.filter(F.col("fill") >= WELL_FILLED * capacity)
    poor = once.filter(F.col("fill") < WELL_FILLED * capacity)
    left = rest.join(poor.select("uid"), "uid", "left_semi")
    again = _pack_shards(_sharded(left, poor.count()), capacity, "again")
    # Sequence numbers are 3 * n + 0, 1 or 2 by the way in which a sequence was filled.
    places = (
        good.select("uid", (F.col("sequence") * 3).alias("sequence_id"), "offset")
        .unionByName(again.select("uid", (F.col("sequence") * 3 + 1).alias("sequence_id"), "offset"))
    )
    alone = full.withColumn("sequence_id", F.col("uid") * 3 + 2).withColumn("offset", F.lit(0).cast("long"))
    return rest.join(places, "uid").unionByName(alone).drop("uid")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place in a sequence; ids too, if wanted."""
    return place_pieces(written(token_pieces(docs, path, capacity, keep_ids), "pieces"), capacity)


def packed_sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids and doc_ids of the filled sequences, from pieces that carry ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = placed.groupBy("sequence_id").agg(parts.alias("parts"))
    return rows.select(
        "sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.col("parts.doc_id").alias("doc_ids")
    )
