"""Runs of repeated words in texts, by internal pattern matching: blocks of dyadic lengths ask a suffix array where they occur nearby."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words

#: Bytes of texts that share a suffix array; a longer text has one by itself.
PIECE = 4 << 20
LEAST_WORDS, LEAST_TIMES = 24, 3
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


class Suffixes:
    """Suffixes of several texts of symbols, each text's apart, in order, with the ranks of all factors of 2^k symbols on the way.

    order: positions by text and suffix. ranks[k][i]: where in order the suffixes begin whose first 2^k symbols are those at i, so that two places are equal
    in 2^k symbols if their ranks are; factors beyond a text's end are unlike all others. groups[k]: such beginnings of two places and more, and their sizes.
    Prefixes are doubled, and only places that are not yet told apart are sorted again.
    """

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray):
        n = len(symbols)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        end = bounds[1:][text]
        key = text * (1 + int(symbols.max(initial=0))) + symbols
        at = np.argsort(key, kind="stable")
        self.order, self.ranks, self.groups = at.copy(), [], []
        rank = np.full(n + 1, -1, np.int32)
        key, group = key[at], np.zeros(n, np.int64)
        width = 1
        while True:
            # key: sorted; a group's first place in the order is its rank.
            new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            inside = np.arange(len(key)) - first[np.cumsum(new) - 1] if len(key) else np.zeros(0, np.int64)
            began = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else first
            old = np.arange(len(key)) - began[np.cumsum(np.append(True, group[1:] != group[:-1])) - 1] if len(key) else inside
            place = group + old
            rank = rank.copy()
            rank[at] = place - inside
            self.order[place] = at
            self.ranks.append(rank)
            sizes = np.diff(np.append(first, len(key)))
            several = np.repeat(sizes > 1, sizes)
            self.groups.append((rank[at[first[sizes > 1]]], sizes[sizes > 1]))
            at, group = at[several], (place - inside)[several]
            if not len(at):
                return
            after = at + width
            beyond = after >= end[at]
            key = group * (n + 1) + np.where(beyond, 0, rank[np.where(beyond, n, after)] + 1)
            by = np.argsort(key, kind="stable")
            key, at, group = key[by], at[by], group[by]
            width *= 2

    def after(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many symbols from x on equal those from y on; x < y."""
        x, y, begun = x.copy(), y.copy(), x
        for k in reversed(range(len(self.ranks))):
            same = (self.ranks[k][x] == self.ranks[k][y]).astype(np.int64) << k
            x += same
            y += same
        return x - begun

    def before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many symbols before x equal those before y; x < y."""
        x, y, begun = x.copy(), y.copy(), x
        for k in reversed(range(len(self.ranks))):
            low = x - (1 << k)
            same = ((low >= 0) & (self.ranks[k][np.maximum(low, 0)] == self.ranks[k][np.maximum(y - (1 << k), 0)])).astype(np.int64) << k
            x -= same
            y -= same
        return begun - x


class WaveletTree:
    """Values below 2^bits in a fixed order, level by level from the highest bit on: counts below a bound and order statistics of any range of places."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for bit in reversed(range(bits)):
            one = (values >> bit & 1).astype(bool)
            zeros = np.append(0, np.cumsum(~one))
            self.levels.append((bit, zeros))
            values = np.concatenate([values[~one], values[one]])

    def _down(self, zeros: np.ndarray, lo: np.ndarray, hi: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = zeros[lo], zeros[hi]
        return np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of places lo to hi are under the bound."""
        count = np.zeros(len(lo), np.int64)
        for bit, zeros in self.levels:
            one = (bound >> bit & 1).astype(bool)
            count += np.where(one, zeros[hi] - zeros[lo], 0)
            lo, hi = self._down(zeros, lo, hi, one)
        top = self.levels[0][0] + 1 if self.levels else 0
        return np.where(bound >> top > 0, -1, count)

    def at(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value, from 0, of places lo to hi."""
        value = np.zeros(len(lo), np.int64)
        for bit, zeros in self.levels:
            under = zeros[hi] - zeros[lo]
            one = k >= under
            k = np.where(one, k - under, k)
            value |= one.astype(np.int64) << bit
            lo, hi = self._down(zeros, lo, hi, one)
        return value


def _candidates(s: Suffixes, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): every run of at least `least` and three periods has a block at a place with its period among them.

    Block length m: the largest power of two up to the period, or of three such lengths less one in `least`. A run of period q then holds a whole block
    with its copy q later, less than 2m away. The block's range of the suffix array is asked for its copies in the next two windows of m starts.
    Copies in one window are an arithmetic progression: with one or two members each is a candidate, with more its ends are, and, where the run's
    copy lies inside, the distance between the stretches of the progression's own period around block and copies: they start or end q apart.
    """
    base = max(0, ((least + 1) // 3).bit_length() - 1)
    none = np.zeros(0, np.int64)
    if base >= len(s.groups) or not len(s.groups[base][0]):
        return none, none
    starts, sizes = s.groups[base]
    by = np.argsort(starts)
    starts, sizes = starts[by].astype(np.int64), sizes[by]
    shift = np.append(0, np.cumsum(sizes))[:-1]  # where a group begins among the places that are not alone
    several = np.repeat(starts - shift, sizes) + np.arange(int(sizes.sum()))
    tree = WaveletTree(s.order[several], max(1, int(len(s.order)).bit_length() + 1))
    places, periods = [none], [none]
    for k in range(base, len(s.groups)):
        m = 1 << k
        blocks = np.concatenate([none, *[np.arange(lo, hi - m + 1, m) for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) if hi - lo >= 2 * m]])
        heads, counts = s.groups[k]
        size = np.zeros(len(s.order) + 1, np.int64)
        size[heads] = counts
        head = s.ranks[k][blocks].astype(np.int64)
        blocks, head = blocks[size[head] > 1], head[size[head] > 1]
        if not len(blocks):
            continue
        of = np.searchsorted(starts, head, "right") - 1
        lo = head - starts[of] + shift[of]
        hi = lo + size[head]
        upto = [tree.below(lo, hi, blocks + 1 + d) for d in (0, m, 2 * m)]
        for low, high in ((upto[0], upto[1]), (upto[1], upto[2])):
            high = np.where(high < 0, hi - lo, high)
            some = high > low
            i, a, b, c, n = blocks[some], lo[some], hi[some], low[some], (high - low)[some]
            first, last = tree.at(a, b, c), tree.at(a, b, c + n - 1)
            second = np.where(n > 1, tree.at(a, b, np.minimum(c + 1, b - a - 1)), last)
            places += [i, i, i]
            periods += [first - i, second - i, last - i]
            i, first, second = i[n > 2], first[n > 2], second[n > 2]
            p = second - first
            places += [i, i]
            periods += [first - s.before(first, second) - i + s.before(i, i + p), second + s.after(first, second) - i - p - s.after(i, i + p)]
    place, period = np.concatenate(places), np.concatenate(periods)
    fits = (period > 0) & (place + period < len(s.order))
    both = np.unique(place[fits] * (len(s.order) + 1) + period[fits])
    return both // (len(s.order) + 1), both % (len(s.order) + 1)


def runs_of(symbols: np.ndarray, bounds: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal runs of at least `least` symbols and `times` smallest periods, by start, then period. bounds: where texts begin, and the end."""
    if times < 3 or least < 2:
        raise ValueError("a run needs two symbols and three periods at least")
    s = Suffixes(symbols, bounds)
    place, period = _candidates(s, bounds, least)
    back, on = s.before(place, place + period), s.after(place, place + period)
    start, length = place - back, back + period + on
    held = (length >= least) & (length >= times * period)
    start, length, period = start[held], length[held], period[held]
    # Multiples of a period have the same stretch; its smallest comes first.
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    one = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])) if len(start) else np.zeros(0, bool)
    start, length, period = start[one], length[one], period[one]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def _piece(texts: pa.Array, least: int, times: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Number of words, runs and text without repeats of each text."""
    split = pc.ascii_split_whitespace(texts.fill_null(""))
    of, flat = pc.list_parent_indices(split).to_numpy(), split.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    of, flat = of[real], flat.filter(pa.array(real))
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    symbols = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    start, length, period = runs_of(symbols, bounds, least, times)

    text = np.searchsorted(bounds, start, "right") - 1
    cuts = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
    columns = [pa.array(x) for x in (start - bounds[text], length, period)]
    runs = pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays(columns, ["start", "length", "period"]))
    turns = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(turns, start + period, 1)
    np.add.at(turns, start + length, -1)
    kept = np.cumsum(turns)[:-1] == 0
    left = np.append(0, np.cumsum(kept))[bounds]
    joined = pc.binary_join(pa.LargeListArray.from_arrays(left, flat.filter(pa.array(kept))), " ")
    return np.diff(bounds), runs, joined


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, runs (start, length, period; in words, by start, then period), collapsed.

    Words are what spaces and tab to carriage return divide. A run is a stretch of at least `least` words and `times` times its smallest period, as long
    as the words go on so. collapsed has the words, joined by one space, that no run holds after its first period. A null text counts as empty:
    no words, no runs, an empty text. Rows that share a doc_id or are equal are apart, ids may be null, an empty table gives no rows; other columns aren't read.

    Each text is judged by itself, so that nothing is shuffled and copies are no group. Texts share suffix arrays in pieces of PIECE bytes; a longer
    text takes about 4 bytes for each word and doubling of its length.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType())]).add("runs", T.ArrayType(RUN)).add("collapsed", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at = words.buffers(batch.column(1))
            for i, j in words.pieces(at, PIECE):
                n, runs, collapsed = _piece(batch.column(1).slice(i, j - i), least, times)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), runs, collapsed.cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(words.frugal(run), schema)
