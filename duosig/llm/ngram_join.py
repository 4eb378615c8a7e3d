"""N-gram Jaccard join: a blocked sparse product of document by n-gram incidence under size-derived bounds."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared, words

#: Sizes of sets rise by this factor within a class; each class deals columns into so many blocks as suit its largest.
CLASS = 1.5
#: One more block for so many that rows could differ in: the contents that most rows have need pair none.
SPARE = 4
#: Bits of the filter of block contents that several rows have (2 to this power); its size is fixed, whatever the corpus.
FILTER_BITS = 24
#: Bytes in one row of the filter on its way to the whole.
CHUNK = 1 << 16
#: Rounds that link the rows that agree in a block through one row before the rest is joined pair by pair.
STAR_ROUNDS = 1
#: Where rows of different components could still make more than so many pairs for each entry, over all contents, the contents in which
#: they could pair their rows with so many of them at once, in further rounds up to this one, before the rest is joined pair by pair.
HOT_PAIRS, HOT_CENTRES, MOST_ROUNDS = 8, 16, 4
#: 64-bit words of a row's signature: a bit for each number of columns' low bits, set where an odd number of the row's columns has it.
SIGNATURE = 16
#: Columns of a row in one block of the product, about.
BLOCK_COLUMNS = 256
#: A set that more than one in so many rows have is handed its component by broadcast: there are fewer such sets than this.
HOT_SETS = 1000


def grams_of(data: np.ndarray, at: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its k-word shingles); fewer words make one shingle, no words none."""
    for i, j in words.pieces(at):
        h, _, _, of = words.words(data, at[i : j + 1], words.UNSPACED)
        s = words.shingles(h, k)
        for row in range(i, j):
            low, high = of[row - i], of[row - i + 1]
            if high - low >= k:
                yield row, np.unique(s[low : high - k + 1])
            else:
                yield row, words.shingles(h[low:high], int(high - low)) if high > low else np.zeros(0, np.uint64)


def _tops() -> list[int]:
    """The largest size of each class."""
    tops = [1]
    while tops[-1] < 1 << 31:
        tops.append(max(tops[-1] + 1, int(tops[-1] * CLASS)))
    return tops


TOPS = _tops()


def parts_of(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(class, blocks, most) for each class in which a row of n columns takes part, with the most columns by which it differs from a row it links to there.

    These are its own class, as the smaller row or among its like, and lower ones whose rows could link to it.
    """
    found, own = [], bisect.bisect_left(TOPS, n)
    for c in range(own, -1, -1):
        if c < own and 100 * TOPS[c] < percent * n:
            break
        most = (100 - percent) * n // percent if c == own else (100 - percent) * (n + TOPS[c]) // (100 + percent)
        if most:  # equal sets are one row already
            blocks = (100 - percent) * TOPS[c] // percent
            found.append((c, blocks + blocks // SPARE + 2, most))
    return found


def agreements(g: np.ndarray, percent: int) -> list[np.ndarray]:
    """Contents of all blocks for each of parts_of; g: a row's sorted columns.

    Sets that link differ by d = (100 - percent) * (na + nb) / (100 + percent) columns at most, and so in d blocks at most. In whatever common order
    of contents, no more than d of a row's contents come before the first that both have.
    """
    found = []
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(g), dtype=np.uint64)])
        for c, blocks, _ in parts_of(len(g), percent):
            ends = np.cumsum(np.bincount((((g >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64), minlength=blocks))
            content = sums[ends]
            content[1:] -= sums[ends[:-1]]
            found.append(words.mix(content ^ words.mix(np.arange(blocks, dtype=np.uint64) + np.uint64((c + 1) << 40))))
    return found


def _contents(k: int, percent: int, words_of: int):
    """A document's number of shingles, a 128-bit key of its set, the contents of blocks in which it has to agree with those it links to, and its signature of so many words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = words.buffers(batch.column(1))
            size, key, contents, signature = [], [], [], []
            for _, g in grams_of(data, at, k):
                size.append(len(g))
                odd = np.bincount((g >> np.uint64(20)).astype(np.int64) & (64 * words_of - 1), minlength=64 * words_of) & 1
                signature.append(np.packbits(odd.astype(bool), bitorder="little").view(np.int64))
                with np.errstate(over="ignore"):
                    key.append(words.mix(g).sum(dtype=np.uint64).tobytes() + words.mix(g ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).tobytes())
                contents.append(np.concatenate([np.zeros(0, np.uint64), *agreements(g, percent)]).view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(c) for c in contents])]).astype(np.int32)
            flat = np.concatenate(contents) if contents else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64())),
                    pa.ListArray.from_arrays(np.arange(len(size) + 1, dtype=np.int32) * words_of, pa.array(np.concatenate([np.zeros(0, np.int64), *signature]))),
                ],
                ["doc_id", "text_hash", "n_shingles", "set_key", "contents", "signature"],
            )

    return run


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's bits of the filter, by the low bits of a content."""
    on = np.zeros(1 << FILTER_BITS, bool)
    for batch in batches:
        on[batch.column(0).to_numpy(zero_copy_only=False) & (len(on) - 1)] = True
    packed = np.packbits(on, bitorder="little")
    for c in range(0, len(packed), CHUNK):
        part = packed[c : c + CHUNK]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([c // CHUNK], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["chunk", "bits"])


def _either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the rows of each chunk as they come; a task holds its chunks only."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held[c] = held.get(c, 0) | np.frombuffer(bits, np.uint8)
    for c, bits in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["chunk", "bits"])


def repeated(every: DataFrame) -> np.ndarray:
    """Bits of the contents that several rows of every have, copies included. They spare shuffling the others, and never decide on links."""
    often = every.select(F.explode("contents").alias("gram")).groupBy("gram").agg(F.count("*").alias("m")).where("m > 1").select("gram")
    rows = often.mapInArrow(words.frugal(_bits), "chunk int, bits binary").repartition("chunk")
    on = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in rows.mapInArrow(_either, "chunk int, bits binary").collect():  # 2 MB at most, as FILTER_BITS bounds it
        on[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["bits"], np.uint8)
    return on


def _let_through(bits, percent: int):
    """(set_hash, class, blocks, most, gram) for each of a row's contents that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.unpackbits(bits.value, bitorder="little").view(bool)
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            parts = [(h, *part) for h, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if n for part in parts_of(n, percent)]
            parts = np.array(parts, np.int64).reshape(-1, 4)
            keep = on[flat & (len(on) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, parts[:, 2])[keep]) for x in parts.T] + [pa.array(flat[keep], pa.int64())], ["set_hash", "class", "blocks", "most", "gram"])

    return run


def _pieces(k: int):
    """The columns of wanted rows cut into 2^level blocks by the upper bits of a column's hash, as (row, level, block, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # rows that this task has cut already, as texts may repeat
        for batch in batches:
            data, at = words.buffers(batch.column(1))
            rows, levels = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, g in grams_of(data, at, k):
                if rows[i] in done:
                    continue
                done.add(rows[i])
                for level in levels[i]:
                    bounds = [0, *np.searchsorted(g, np.arange(1, 1 << level, dtype=np.uint64) << np.uint64(64 - level)).tolist(), len(g)] if level else [0, len(g)]
                    some = [b for b in range(1 << level) if bounds[b] < bounds[b + 1]]
                    ends = pa.array([0, *(bounds[b + 1] for b in some)], pa.int32())
                    n = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([rows[i]] * n, pa.int64()), pa.array([level] * n, pa.int32()), pa.array(some, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(g.view(np.int64), pa.int64()))],
                        ["row", "level", "block", "grams"],
                    )

    return run


def _bound(percent: int) -> str:
    """Whether rows a and b can link by their sizes, and by the pa and pb contents before a common one, all of which they differ in if it is their first."""
    return f"100 * least(na, nb) >= {percent} * greatest(na, nb) and (100 + {percent}) * greatest(pa, pb) <= (100 - {percent}) * (na + nb)"


def _possible(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Pairs whose overlap can still reach the bound by their signatures.

    Where signatures differ, the rows differ by a column: they share no more than half of the columns that are left of both.
    """
    side = lambda x: signatures.select(F.col("row").alias(x), F.col("signature").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    size = F.col("na") + F.col("nb")
    return both.where((100 + percent) * (size - apart) >= 2 * percent * size).select("a", "na", "b", "nb")


def _overlaps(pairs: DataFrame, docs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """pairs (a, na, b, nb, level) with o, their overlap: the product of both rows in each block of columns, summed over blocks."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("row"), "level").groupBy("row").agg(F.collect_set("level").alias("levels"))
    texts = wanted.join(rows.select("row", "doc_id", "text_hash"), "row").select("row", "levels", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    # A merge join by hint: where the plan changes on its way, the documents' shuffle files would stay until the session collects them.
    texts = docs.join(texts.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    pieces = shared.materialise(texts.select("row", "text", "levels").mapInArrow(words.frugal(_pieces(k)), "row long, level int, block int, grams array<long>"))
    side = lambda x: pieces.select(F.col("row").alias(x), "level", "block", F.col("grams").alias(f"g{x}"))
    cells = pairs.select("a", "b", "level", F.explode(F.expr("sequence(0, shiftleft(1, level) - 1)")).alias("block"))
    cells = cells.join(side("a"), ["a", "level", "block"]).join(side("b"), ["b", "level", "block"]).select("a", "b", "block", F.size(F.array_intersect("ga", "gb")).alias("o"))
    # A row whose text occurs in several tasks has been cut in each of them.
    return cells.groupBy("a", "b", "block").agg(F.max("o").alias("o")).groupBy("a", "b").agg(F.sum("o").alias("o"))


def _met(at: DataFrame, turn: int, percent: int, centres: int) -> DataFrame:
    """Pairs (a, na, b, nb) of rows of different labels and like sizes that agree in a block.

    A block's content pairs all its rows with so many of them, drawn anew in each turn, or with 0 centres all with each other.
    """
    side = lambda x: [F.col("row").alias(x), *[F.col(c).alias(f"{c}{x}") for c in ("n", "p", "label")]]
    if centres:
        draw = lambda i: F.xxhash64("row", F.lit(turn * MOST_ROUNDS * HOT_CENTRES + i)) if turn else F.lit(0)
        one = lambda i: F.min(F.struct(draw(i).alias("draw"), "row", "n", "p", "label"))
        centre = at.groupBy("gram").agg(F.array(*[one(i) for i in range(centres)]).alias("c")).select("gram", F.explode("c").alias("c")).select("gram", "c.*").select("gram", *side("a"))
        met = at.select("gram", *side("b")).join(centre, "gram").where("a <> b")
    else:
        met = at.select("gram", *side("a")).join(at.select("gram", *side("b")), "gram").where("a < b")
    met = met.where("labela <> labelb").where(_bound(percent))
    first = F.col("a") < F.col("b")
    pick = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    return met.select(pick("a", "b", "a"), pick("na", "nb", "na"), pick("b", "a", "b"), pick("nb", "na", "nb")).distinct()


def ngram_join(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id that its links reach).

    A document is the set of its distinct k-word shingles over words of non-space characters with A-Z as
    a-z; with fewer words, the whole sequence is one shingle. Two rows link when
    100 * intersection >= percent * union. Null, empty and blank texts have no shingles and link with
    nothing: they are their own component. Rows that share a doc_id are apart; a null doc_id counts as the largest, so
    component_id is null only where a component has no other. Shingles are compared by 64-bit hash (a collision would
    have to fall within one pair), equal sets by a 128-bit one. Columns other than id and text aren't read; an empty table gives no rows.

    Rows of the incidence matrix with equal sets become one row. The product of the matrix with its transpose is taken in
    blocks of columns. First, columns are dealt into more blocks than the columns by which rows of such sizes differ where they link, so
    that these agree in a whole block: rows that agree in none are discarded, as are those that sizes or signatures rule out. Then blocks of
    about BLOCK_COLUMNS columns of a row are multiplied for the pairs that are left, and overlaps are summed over blocks. A block's content
    first pairs all its rows with one of them, for STAR_ROUNDS rounds; what these link needs no pair of its own. Contents in which
    rows of different components are still many pair their rows with several, until few are left or nothing links any more, and
    then pairs are made between rows of different components and like sizes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    every = docs.mapInArrow(words.frugal(_contents(k, percent, SIGNATURE)), "doc_id long, text_hash long, n_shingles long, set_key binary, contents array<long>, signature array<long>")
    every = shared.materialise(every)

    # One row for each set, that of its smallest doc_id, numbered in the order of these.
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", F.col("n_shingles").alias("n"), "signature")).alias("_lead")
    rows = every.where("n_shingles > 0").groupBy("set_key").agg(lead, F.count("*").alias("copies")).select("set_key", "copies", "_lead.*")
    rows = shared.materialise(rows.orderBy(F.col("doc_id").asc_nulls_last(), "set_key").withColumn("row", F.monotonically_increasing_id()))
    bits = spark.sparkContext.broadcast(repeated(every))
    # Contents belong to hashes of sets until few are left; should two sets have one hash, both have the contents of both.
    entries = every.select(F.xxhash64("set_key").alias("set_hash"), "n_shingles", "contents").mapInArrow(words.frugal(_let_through(bits, percent)), "set_hash long, class long, blocks long, most long, gram long").distinct()
    entries = shared.materialise(entries)
    often = entries.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1")
    # A content's place among all of its row's in that class, from rare to usual: those that no other row has come first.
    usual = Window.partitionBy("set_hash", "class").orderBy(F.col("m").desc(), F.col("gram").desc())
    entries = entries.join(often, "gram").withColumn("p", F.col("blocks") - F.row_number().over(usual)).where("p <= most")
    entries = entries.join(rows.select(F.xxhash64("set_key").alias("set_hash"), "row", "n"), "set_hash").select("gram", "row", "n", "p")
    entries = shared.materialise(entries)
    signatures = rows.select("row", "signature")

    labels = done = None
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest("na", "nb") / BLOCK_COLUMNS))).cast("int")
    turn, last, stalled, named_rows = 0, False, False, 0
    while not last:
        at, centres = entries.withColumn("label", F.col("row")), 1
        if labels is not None:
            at = entries.join(labels, "row", "left").withColumn("label", F.coalesce("label", "row"))
        if turn:
            # How many pairs of rows of different components each content still has.
            held = at.groupBy("gram", "label").agg(F.count("*").alias("k")).groupBy("gram").agg(F.sum("k").alias("m"), ((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("cross"))
            held, most = shared.observed(held.where("cross > 0"), F.coalesce(F.sum("cross"), F.lit(0.0)).alias("cross"), F.coalesce(F.sum("m"), F.lit(0)).alias("m"))
            if turn >= STAR_ROUNDS:
                last = stalled or turn >= MOST_ROUNDS or most["cross"] <= HOT_PAIRS * most["m"]
                held, centres = (held, 0) if last else (held.where(F.col("cross") > HOT_PAIRS * F.col("m")), HOT_CENTRES)
            at = at.join(held.select("gram"), "gram")
        pairs = _met(at, turn, percent, centres)
        turn += 1
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = shared.materialise(_possible(pairs, signatures, percent).withColumn("level", level))
        if pairs.isEmpty():
            stalled = turn > STAR_ROUNDS
            continue
        with shared.scope(spark) as cut:  # the rows' pieces go once overlaps are stored
            found = _overlaps(pairs, docs, rows, k).withColumnRenamed("a", "_a").withColumnRenamed("b", "_b")
        found = pairs.join(found, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left")
        found = found.select("a", "b", F.expr(f"coalesce((100 + {percent}) * o >= {percent} * (na + nb), false)").alias("linked"))
        found, seen = shared.observed(found, F.count_if("linked").alias("links"))
        cut.release()
        done = found.select("a", "b") if done is None else done.unionByName(found.select("a", "b"))
        links = found.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
        if not seen["links"]:
            stalled = turn > STAR_ROUNDS
            continue
        if labels is not None:
            links = links.unionByName(labels.select(F.col("row").alias("u"), F.col("label").alias("v")))
        labels, told = shared.observed(shared.components(links, size=seen["links"] + named_rows).select(F.col("node").alias("row"), F.col("root").alias("label")), F.count("*").alias("n"))
        named_rows = told["n"]

    named = rows.select("set_key", "copies", "row", F.col("doc_id").alias("component_id"))
    if labels is not None:
        roots = rows.select(F.col("row").alias("label"), F.col("doc_id").alias("_root"))
        of = labels.join(roots, "label").select(F.col("row").alias("_row"), "_root", F.lit(True).alias("_named"))
        named = named.join(of, F.col("row") == F.col("_row"), "left").withColumn("component_id", F.when(F.col("_named"), F.col("_root")).otherwise(F.col("component_id")))
    named = shared.materialise(named.select(F.col("set_key").alias("_key"), "copies", "component_id"))
    # Rows with a set that many have don't meet it in one task: such sets are few by their number of copies.
    many = every.count() // HOT_SETS
    hot = F.broadcast(named.where(F.col("copies") > many).select("_key", F.col("component_id").alias("_hot"), F.lit(True).alias("_is_hot")))
    out = every.select("doc_id", "n_shingles", "set_key").join(hot, F.col("set_key") == F.col("_key"), "left").drop("_key")
    own = F.when(F.col("n_shingles") > 0, F.col("_hot")).otherwise(F.col("doc_id")).alias("component_id")
    settled = out.where("_is_hot or n_shingles = 0").select("doc_id", "n_shingles", own)
    rest = out.where("_is_hot is null and n_shingles > 0").join(named.where(F.col("copies") <= many), F.col("set_key") == F.col("_key"))
    return settled.unionByName(rest.select("doc_id", "n_shingles", "component_id"))
