"""Mixing sources to target weights by Pfair scheduling of blocks, earliest deadline first."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from . import shared

BLOCK_ROWS = 64
#: Rows of a plan that are handed on at once.
PLAN_ROWS = 100_000
PLAN = "source string, first long, step long, slot long, period long, repeats long, release long, due long"


def edf(weights: list[int], left: list[int] | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """(slot, source, block, release, deadline) of each source's blocks by whole weights, for as many slots as these add up to.

    Block j of a source with weight w of W in all is released at floor(j * W / w) and due by ceil((j + 1) * W / w); of the
    released blocks the one due first goes, ties to the earlier source. After every slot each source is less than one block off
    its share, as such windows of total weight one can always be met; after W slots all are level. Where `left` blocks of some source are
    fewer than its weight, the slots end with the first source that is used up.
    """
    total = sum(weights)
    window = lambda i, j: (j * total // weights[i], -(-(j + 1) * total // weights[i]))
    waiting = [(*window(i, 0), i, 0) for i in range(len(weights))]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            release, due, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, i, j, release))
        due, i, j, release = heapq.heappop(ready)
        yield slot, i, j, release, due
        if left is not None and j + 1 == left[i]:
            return
        if j + 1 < weights[i]:
            heapq.heappush(waiting, (*window(i, j + 1), i, j + 1))


def whole_weights(weights: list[Fraction]) -> list[int]:
    """The same proportions in the smallest whole numbers."""
    scale = math.lcm(*[w.denominator for w in weights])
    whole = [int(w * scale) for w in weights]
    return [w // math.gcd(*whole) for w in whole]


def plan(weights: list[Fraction], blocks: list[int]) -> Iterator[tuple[int, int, int, int, int, int, int, int]]:
    """(source, first, step, slot, period, repeats, release, due) for all blocks of all sources, in order of slots.

    Block first + q * step of a source goes to slot + q * period, for q below repeats; so do its window's bounds. A source has its exact weight among those that
    are not used up. As long as all have their weights' worth of blocks, the slots of one period are repeated, at whose end all are level; then the
    slots go on until the first source is used up, and the others start level in proportions of their own. Sources of weight 0 come when all others are through.
    """
    left, done, start = list(blocks), [0] * len(blocks), 0
    while any(left):
        open_ = [i for i, n in enumerate(left) if n and weights[i] > 0] or [i for i, n in enumerate(left) if n]
        whole = whole_weights([weights[i] or Fraction(1) for i in open_])
        repeats = min(left[i] // w for i, w in zip(open_, whole, strict=True))
        period, served = sum(whole), [0] * len(open_)
        for slot, k, j, release, due in edf(whole, left=None if repeats else [left[i] for i in open_]):
            i = open_[k]
            yield i, done[i] + j, whole[k], start + slot, period, max(1, repeats), start + release, start + due
            served[k] += 1
        for k, i in enumerate(open_):
            done[i] += served[k] * max(1, repeats)
            left[i] -= served[k] * max(1, repeats)
        start += sum(served) * max(1, repeats)


def _planned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The plan of all sources, which are rows here; it is handed on as it comes."""
    sources = [x for rows in batches for x in rows[["source", "weight", "blocks"]].itertuples(index=False, name=None)]
    sources.sort(key=lambda x: (x[0] is None, x[0] or ""))
    names, rows = [x[0] for x in sources], []
    columns = PLAN.replace(",", "").split()[::2]
    for i, *place in plan([Fraction(repr(float(w))) for _, w, _ in sources], [int(n) for *_, n in sources]):
        rows.append((names[i], *place))
        if len(rows) == PLAN_ROWS:
            yield pd.DataFrame(rows, columns=columns)
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def weighed(sizes: DataFrame, weights: dict[str, float] | None, default_weight: float, power: float) -> DataFrame:
    """sizes (source, rows) with the sources' weights."""
    if weights is None:
        weight = F.round(F.pow(F.col("rows").cast("double"), F.lit(power)), 3)
    else:
        given = F.create_map(*[F.lit(x) for name, w in weights.items() for x in (name, float(w))]) if weights else F.lit(None).cast("map<string,double>")
        weight = F.coalesce(F.try_element_at(given, F.coalesce("source", F.lit(""))), F.lit(float(default_weight)))
    return sizes.withColumn("weight", weight)


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, power: float = 0.5, block_rows: int = BLOCK_ROWS,
    id_col: str = "doc_id", source_col: str = "source",
) -> DataFrame:
    """docs with mix_slot (place of the row's block among all blocks), mix_row (place in the block), mix_block, mix_release and mix_deadline.

    weights are the sources' target weights, of any sum; a source without one, and the null source, has default_weight. Without
    weights a source's weight is its size to the given power, in thousandths. Weights are exact, as the decimals that they are written in: a source of a small weight
    has its first block when that is due. Sources of weight 0 come when all others are used up, in equal parts; a negative weight is an error.
    Reading rows by (mix_slot, mix_row) interleaves the sources so that each is always less than one block off its share of all
    slots since a source was last used up; then the rest divide the slots in the same proportions. No row is dropped or repeated. Rows of
    a source are in an order drawn by hash of their columns; rows that share an id keep a place each. A null source is a source of its own and comes
    last in ties; null and empty texts are rows as any; an empty table gives no rows. New columns replace columns of the same names.

    A source with a third of all rows is ranked in pieces, whose counts are summed: pieces and the rows of one are both about the root
    of all rows. The plan is made by one task from a row for each source; it has a row for each block of a period of the
    weights, at most one for each block in all, and is spread over tasks before periods are repeated. Whole rows are shuffled once to be ranked and once to meet their slots.
    """
    if any(w < 0 for w in (*(weights or {}).values(), default_weight)):
        raise ValueError("weights are not negative")
    names = ["mix_slot", "mix_row", "mix_block", "mix_release", "mix_deadline"]
    docs = docs.drop(*names)
    n = docs.agg(F.count("*")).first()[0]
    # Whole rows are one column, so that no name of theirs meets the names below.
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(source_col).cast("string").alias("_source"), F.col(id_col).alias("_id"))
    # The draw is over all plain columns, as many rows may share an id or have none.
    plain = [F.col(f"_doc.`{f.name}`") for f in docs.schema if isinstance(f.dataType, AtomicType)]
    rows = rows.withColumn("_draw", F.xxhash64("_id", *plain))
    ranked = shared.with_rank(rows, ["_source"], F.pmod(F.xxhash64("_draw"), F.lit(max(1, math.isqrt(n)))), [F.col("_draw"), F.col("_id")], "_rank")
    ranked = ranked.withColumns({"mix_block": F.floor(F.col("_rank") / block_rows), "mix_row": F.pmod(F.col("_rank"), F.lit(block_rows)).cast("int")})

    sizes = rows.groupBy(F.col("_source").alias("source")).agg(F.count("*").alias("rows"))
    sized = weighed(sizes, weights, default_weight, power).select("source", "weight", F.ceil(F.col("rows") / block_rows).alias("blocks"))
    periods = sized.repartition(1).mapInPandas(_planned, PLAN).repartition("source", "first")
    each = periods.select("*", F.explode(F.expr("sequence(0L, repeats - 1)")).alias("_q"))
    at = lambda c: F.col(c) + F.col("_q") * F.col("period")
    slots = each.select(F.col("source").alias("_psource"), (F.col("first") + F.col("_q") * F.col("step")).alias("_pblock"), at("slot").alias("mix_slot"), at("release").alias("mix_release"), at("due").alias("mix_deadline"))
    out = ranked.join(slots, F.col("_source").eqNullSafe(F.col("_psource")) & (F.col("mix_block") == F.col("_pblock")))
    return out.select("_doc.*", *names)
