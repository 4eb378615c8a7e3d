"""Benchmark decontamination by a prefix-filtered set join of item windows with documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared, words

#: Counters of the frequency sketch that orders shingles (2 to this power); its size is fixed, whatever the corpus.
SKETCH_BITS = 20
#: Counters in one row of the sketch on its way to the sum.
CHUNK = 1 << 14

WINDOW = 10
SHINGLE = 5
#: Bits of the bitmap that tells the prefixes' shingles from most others (2 to this power); its size is fixed, whatever the benchmark.
FILTER_BITS = 25
_PLACE = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("before", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType()))])


def _counts(k: int, n_bits: int, chunk: int):
    """A task's counts of all shingles of k words, by the low bits of their hash, in rows of so many counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << n_bits, np.int64)
        for batch in batches:
            data, at = words.buffers(batch.column(0))
            for i, j in words.pieces(at):
                s = words.shingles(words.words(data, at[i : j + 1], words.WORDLIKE)[0], k)
                counts += np.bincount((s & np.uint64(len(counts) - 1)).astype(np.int64), minlength=len(counts))
        for c in range(len(counts) // chunk):
            part = counts[c * chunk : (c + 1) * chunk]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["chunk", "counts"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the rows of each chunk as they come; a task holds the sums of its chunks only."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[c] = sums.get(c, 0) + np.frombuffer(counts, np.int64)
    for c, s in sums.items():
        level = np.ceil(4 * np.log2(s + 1)).clip(0, 127).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["chunk", "level"])


def shingle_levels(texts: DataFrame, k: int) -> np.ndarray:
    """How common shingles of k words are in all documents, by a sketch of fixed size. It orders shingles and so decides on speed, never on hits."""
    rows = texts.mapInArrow(words.frugal(_counts(k, SKETCH_BITS, CHUNK)), "chunk int, counts binary").repartition("chunk")
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    for row in rows.mapInArrow(_add, "chunk int, level binary").collect():  # 1 MB at most
        levels[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["level"], np.uint8)
    return levels


def _spelled(folded: bytes, start: np.ndarray, end: np.ndarray, low: int, high: int) -> list[str]:
    return [folded[a:b].decode() for a, b in zip(start[low:high].tolist(), end[low:high].tolist(), strict=True)]


def _windows(window: int, shingle: int, levels):
    """Windows of items: their words, and of their shingles of k words the rarest one's place and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in batches:
            data, at = words.buffers(batch.column(1))
            names = batch.column(0).to_pylist()
            for i, j in words.pieces(at):
                h, start, end, of = words.words(data, at[i : j + 1], words.WORDLIKE)
                folded = words.FOLD[data].tobytes()
                for item in range(j - i):
                    low, high = int(of[item]), int(of[item + 1])
                    size = min(window, high - low)
                    if not size:
                        continue
                    k = min(shingle, size)
                    s = words.shingles(h[low:high], k)
                    rank = level[(s & np.uint64(len(level) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | s >> np.uint64(8)
                    offset = np.lib.stride_tricks.sliding_window_view(rank, size - k + 1).argmin(1)
                    every = _spelled(folded, start, end, low, high)
                    n = len(offset)
                    columns = [pa.array([names[i + item]] * n, pa.string()), pa.array([" ".join(every[w : w + size]) for w in range(n)], pa.string()), pa.array(np.full(n, size, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(offset.astype(np.int32)), pa.array(s[np.arange(n) + offset].view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["item_id", "w", "size", "k", "offset", "h"])

    return run


def _bitmap(prefixes: DataFrame) -> np.ndarray:
    """Two bits for the hash of each prefix, of 2^FILTER_BITS."""
    mask = F.lit((1 << FILTER_BITS) - 1).cast("long")
    each = prefixes.select(F.explode(F.array(F.col("h").bitwiseAND(mask) + 1, F.shiftrightunsigned("h", 32).bitwiseAND(mask) + 1)).alias("bit"))
    parts = each.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(max(1 << FILTER_BITS, 1 << 15) // 8, np.uint8)
    for row in parts.collect():  # 4 kB for each 2^15 bits
        at = (row["bucket"] - 1) * 4096
        part = np.frombuffer(row["bits"], np.uint8)
        out[at : at + len(part)] = part[: len(out) - at]
    return out


def _places(s: np.ndarray, bits: np.ndarray, n_bits: int) -> np.ndarray:
    """Places of s whose hash has both bits set."""
    mask = np.uint64((1 << n_bits) - 1)
    held = lambda x: bits[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8) & 1
    at = np.flatnonzero(held(s & mask))
    return at[held(s[at] >> np.uint64(32) & mask) > 0]


def _marked(window: int, shingle: int, sizes: list[int], bitmap, n_bits: int):
    """A text's number of words, and the places that may hold a prefix, with as many words around as a window could have there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            data, at = words.buffers(batch.column(1))
            n_words, places = [], []
            for i, j in words.pieces(at):
                h, start, end, of = words.words(data, at[i : j + 1], words.WORDLIKE)
                n_words.append(np.diff(of))
                found: list[list[dict]] = [[] for _ in range(j - i)]
                for k in sizes:
                    s = words.shingles(h, k)
                    for p in _places(s, bits, n_bits).tolist():
                        row = int(np.searchsorted(of, p, "right")) - 1
                        first, last = int(of[row]), int(of[row + 1])
                        if p + k > last:
                            continue
                        low, high = (max(first, p - window + k), min(last, p + window)) if k == shingle else (p, p + k)
                        around = [words.FOLD[data[start[x] : end[x]]].tobytes().decode() for x in range(low, high)]
                        found[row].append({"k": k, "h": int(s[p : p + 1].view(np.int64)[0]), "pos": p - first, "before": p - low, "words": around})
                places += found
            counts = np.concatenate([np.zeros(0, np.int64), *n_words])
            kind = pa.list_(pa.struct([("k", pa.int32()), ("h", pa.int64()), ("pos", pa.int64()), ("before", pa.int32()), ("words", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(places, kind)], ["doc_id", "n_words", "places"])

    return run


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """docs' id as doc_id with n_words, n_hit, n_items, items (sorted item ids) and contaminated, a row for each row of docs.

    Words are runs of a-z (A-Z folded), digits and characters beyond ASCII. Every window consecutive words
    of an item are a window of it; an item of fewer words is one window, an item without words has none.
    A document's word inside any occurrence of any window is hit; an item counts if one of its windows
    occurs. A null or empty text has no words. Of items with the same id, either's windows count for the
    id; items with a null id hit words but have no name to list. An empty benchmark hits nothing, an empty table gives no rows;
    rows that repeat or share an id are judged each by itself. Other columns aren't read.

    A window is contained as a set of its shingles before it is compared word by word. As all of them have to be there, a prefix of one is
    necessary: the rarest by a sketch of all documents. Documents' shingles that a bitmap of the prefixes doesn't rule out are joined with these by
    their hash; the shingle's place must leave room for the whole window, and then all words are compared. Documents are read twice,
    once for the sketch, whatever the benchmark; it may be larger than they are. The driver gets the sketch and the bitmap, of fixed sizes, and no text. Only places,
    with the words around them, are shuffled; a place that many documents share meets the few windows that have it as their rarest.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text")).distinct()
    levels = context.broadcast(shingle_levels(rows.select("_text"), shingle))
    windows = shared.materialise(items.mapInArrow(words.frugal(_windows(window, shingle, levels)), "item_id string, w string, size int, k int, offset int, h long"))
    prefixes = windows.select("w", "size", F.col("k").alias("_k"), "offset", F.col("h").alias("_h")).distinct()
    sizes = sorted(r["k"] for r in windows.select("k").distinct().collect())  # at most as many as a shingle has words
    bitmap = context.broadcast(_bitmap(windows.select("h")))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(_PLACE))])
    marked = shared.materialise(rows.mapInArrow(words.frugal(_marked(window, shingle, sizes, bitmap, FILTER_BITS)), schema).withColumn("_row", F.monotonically_increasing_id()))

    places = marked.where(F.size("places") > 0).select("_row", F.inline("places"))
    first = F.col("before") - F.col("offset")
    room = (first >= 0) & (first + F.col("size") <= F.size("words"))
    # The words are compared where hashes are equal, and are no key of the join.
    same = F.coalesce(F.array_join(F.slice("words", first + 1, F.col("size")), " ") == F.col("w"), F.lit(False))
    met = places.join(prefixes, (F.col("h") == F.col("_h")) & (F.col("k") == F.col("_k"))).where(room).where(same)
    hits = shared.materialise(met.select("_row", (F.col("pos") - F.col("offset")).alias("begin"), "size", "w"))
    spans = hits.groupBy("_row").agg(F.array_sort(F.collect_set(F.struct("begin", (F.col("begin") + F.col("size")).alias("end")))).alias("s"))
    covered = F.expr("aggregate(s, struct(0L as n, 0L as upto), (a, x) -> struct(a.n + greatest(0L, x.end - greatest(x.begin, a.upto)) as n, greatest(x.end, a.upto) as upto), a -> a.n)")
    named = hits.select("_row", "w").distinct().join(windows.where("item_id is not null").select("w", "item_id").distinct(), "w")
    named = named.groupBy("_row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    told = spans.select("_row", covered.alias("n_hit")).join(named, "_row", "left").withColumnRenamed("_row", "_of")
    out = marked.select("_row", "doc_id", "n_words").join(told, F.col("_row") == F.col("_of"), "left")
    listed, n_hit = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"), (n_hit > 0).alias("contaminated"))
