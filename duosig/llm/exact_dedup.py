"""Exact duplicates by Grace hashing: partition by hash until a bucket fits, then compare complete contents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared, words

LEVEL_BITS = 6


def normalised(text: Column) -> Column:
    """The text with every run of space and tab to carriage return as one space; null is empty."""
    # Single spaces stay as they are, so only other runs need a replacement.
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


class OpenTable:
    """An open-addressing table (linear probing) from complete content to a small number."""

    def __init__(self, slots: int = 1 << 10):
        self.hashes, self.refs, self.content, self.bytes = [0] * slots, [-1] * slots, [], 0

    def find(self, h: int, content: bytes) -> tuple[int, bool]:
        """The content's number, and whether it is new. Equal hashes don't count: all bytes are compared."""
        last = len(self.refs) - 1
        i = h & last
        while (ref := self.refs[i]) >= 0:
            if self.hashes[i] == h and self.content[ref] == content:
                return ref, False
            i = (i + 1) & last
        self.hashes[i], self.refs[i] = h, len(self.content)
        self.content.append(content)
        self.bytes += len(content)
        if 2 * len(self.content) > last:
            self._grow()
        return len(self.content) - 1, True

    def _grow(self) -> None:
        old = [(h, r) for h, r in zip(self.hashes, self.refs, strict=True) if r >= 0]
        slots = 2 * len(self.refs)
        self.hashes, self.refs = [0] * slots, [-1] * slots
        for h, r in old:
            i = h & (slots - 1)
            while self.refs[i] >= 0:
                i = (i + 1) & (slots - 1)
            self.hashes[i], self.refs[i] = h, r


LOCAL = "doc_id long, sha string, h long, rep long, n long, n_bytes long, content binary"


def _combine(memory: int):
    """Collapses the copies that one task reads: one row of a group keeps the content and the count, the smallest doc_id's.

    rep is unique over all tasks: the group's number with the task's above it.
    """

    def flush(rows: list, table: OpenTable, base: int) -> Iterator[pa.RecordBatch]:
        n, best = [0] * len(table.content), [-1] * len(table.content)
        for k, (doc, _, _, ref) in enumerate(rows):
            n[ref] += 1
            top = rows[best[ref]][0] if best[ref] >= 0 else None
            if best[ref] < 0 or (doc is not None and (top is None or doc < top)):
                best[ref] = k
        for low in range(0, len(rows), 1000):
            part = range(low, min(low + 1000, len(rows)))
            refs = [rows[k][3] for k in part]
            lead = [best[r] == k for k, r in zip(part, refs, strict=True)]
            columns = [
                pa.array([rows[k][0] for k in part], pa.int64()),
                pa.array([rows[k][1] for k in part], pa.string()),
                pa.array([rows[k][2] for k in part], pa.int64()),
                pa.array([base + r for r in refs], pa.int64()),
                pa.array([n[r] if one else None for r, one in zip(refs, lead, strict=True)], pa.int64()),
                pa.array([len(table.content[r]) for r in refs], pa.int64()),
                pa.array([table.content[r] if one else None for r, one in zip(refs, lead, strict=True)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "sha", "h", "rep", "n", "n_bytes", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, table, base = [], OpenTable(), TaskContext.get().partitionId() << 40
        for batch in batches:
            docs, shas, hs, contents = (batch.column(k) for k in range(4))
            for doc, sha, h, content in zip(docs.to_pylist(), shas.to_pylist(), hs.to_pylist(), contents, strict=True):
                rows.append((doc, sha, h, table.find(h, content.as_py())[0]))
                if table.bytes > memory or len(rows) >= 200_000:
                    yield from flush(rows, table, base)
                    rows, table, base = [], OpenTable(), base + len(table.content)
        yield from flush(rows, table, base)

    return run


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket. Every row leaves with the number of its content within the bucket."""
    path, table = None, OpenTable()
    for batch in batches:
        group = []
        for p, h, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(5), strict=True):
            if p != path:
                path, table = p, OpenTable()
            group.append(f"{p}:{table.find(h, content.as_py())[0]}")
        yield pa.RecordBatch.from_arrays([pa.array(group, pa.string()), *(batch.column(k) for k in (2, 3, 4))], ["grp", "rep", "doc_id", "n"])


def _split(rows: DataFrame, large: DataFrame, level: int) -> DataFrame:
    """rows whose path is a large bucket's get further bits of their hash."""
    digit = F.pmod(F.xxhash64("h", F.lit(level)), F.lit(1 << LEVEL_BITS)).cast("string")
    joined = rows.join(large.select(F.col("path").alias("_path"), F.lit(True).alias("_large")), F.col("path") == F.col("_path"), "left")
    return joined.withColumn("path", F.when(F.col("_large"), F.concat_ws(".", "path", digit)).otherwise(F.col("path"))).drop("_path", "_large")


def buckets(pieces: DataFrame, bucket_bytes: int, levels: int) -> DataFrame:
    """Adds path, each row's bucket: hash bits are added until the distinct contents of a bucket fit bucket_bytes.

    Buckets are worked out on a stored table of hashes and sizes; contents take their final path at once.
    A bucket of one hash cannot be split; it holds one content (or colliding ones), and copies of it
    take no room in the table.
    """
    total = pieces.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first()["b"]
    first = F.pmod(F.col("h"), F.lit(max(1, -(-int(total) // bucket_bytes)))).cast("string")
    sizes = shared.materialise(pieces.groupBy("h").agg(F.max("n_bytes").alias("b")).withColumn("path", first))
    at = pieces.withColumn("path", first)
    for level in range(levels):
        large = sizes.groupBy("path").agg(F.sum("b").alias("b"), F.count("*").alias("hashes")).where((F.col("b") > 2 * bucket_bytes) & (F.col("hashes") > 1))
        large = shared.materialise(large.select("path"))
        if large.isEmpty():
            break
        at = _split(at, large, level)
        sizes = shared.materialise(_split(sizes, large, level))
    return at


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", task_bytes: int = 48 << 20, bucket_bytes: int = 16 << 20, levels: int = 8) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space (space, tab to carriage return) is one
    space; null and empty texts are equal. Of equal texts the row with the smallest doc_id stays; of rows
    that also repeat this doc_id, one stays. A null doc_id counts as the largest; an empty table gives no
    rows. Other columns are not read, so their names don't matter.

    Each task first collapses its own copies in an open-addressing table of at most task_bytes of content,
    so that a content held by a third of all rows reaches its bucket once per task and not once per row.
    What is left goes by hash to buckets (Spark's shuffle files are the spill files), which are partitioned
    again by further hash bits until their contents fit bucket_bytes; then a table per bucket compares
    complete contents.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).cast("binary").alias("content"))
    rows = rows.select("doc_id", F.sha2("content", 256).alias("sha"), "content")
    rows = rows.select("doc_id", "sha", F.conv(F.substring("sha", 1, 15), 16, 10).cast("long").alias("h"), "content")
    local = shared.materialise(rows.mapInArrow(words.frugal(_combine(task_bytes)), LOCAL))

    leads = local.where("content is not null")
    cut = buckets(leads, bucket_bytes, levels).select("path", "h", "rep", "doc_id", "n", "content")
    found = cut.repartition("path").sortWithinPartitions("path").mapInArrow(words.frugal(_bucket), "grp string, rep long, doc_id long, n long")
    group = Window.partitionBy("grp")
    # A small table: the shuffled contents can go before the rows are joined.
    groups = found.select(
        F.col("rep").alias("_rep"),
        F.min("doc_id").over(group).alias("keep_id"),
        F.sum("n").over(group).alias("group_size"),
        (F.row_number().over(group.orderBy(F.col("doc_id").asc_nulls_last(), "rep")) == 1).alias("_first"),
    )
    groups = shared.materialise(groups)
    rows = local.select("doc_id", "sha", "rep", F.col("n").isNotNull().alias("_lead"))
    return rows.join(groups, F.col("rep") == F.col("_rep")).select(
        "doc_id", "keep_id", "group_size", (F.col("_lead") & F.col("_first")).alias("kept"), F.col("sha").alias("text_sha256")
    )
