"""Language identification by prediction by partial matching over frozen byte context trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words

#: Bytes of a very long text that are coded together.
PART = 1 << 20
#: A text is in none of the languages if its best tree needs more than this share, and so many bits more, of what pooled byte frequencies,
#: or bytes all alike, need: what follows what in it is then nothing that was learned. The bits keep short texts from being judged on a whim.
KNOWN_SHARE, SLACK_BITS = 1.1, 16.0
#: Bytes of the piece of text whose posterior is the score: for whole texts the posterior is 1 within rounding and says nothing.
SCORE_BYTES = 4
#: Different bytes once A-Z are folded: the alphabet.
ALPHABET = len(np.unique(words.FOLD))


def sample(docs: DataFrame, per_lang: int, max_chars: int, id_col: str, text_col: str, lang_col: str, train: Column) -> DataFrame:
    """(lang, text): of each language the per_lang rows with the smallest hash; of a longer text a stretch of max_chars characters at a drawn place."""
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) > 0))
    drawn = F.xxhash64(F.col(id_col), F.col(text_col))
    at = F.pmod(F.xxhash64(drawn), F.greatest(F.length(text_col) - max_chars, F.lit(0)) + 1).cast("int") + 1
    rows = rows.select(F.col(lang_col).alias("lang"), F.substring(F.col(text_col), at, F.lit(max_chars)).alias("text"), drawn.alias("_k"))
    first = Window.partitionBy("lang").orderBy("_k", "text")
    return rows.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= per_lang).select("lang", "text")


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of all runs of four bytes of texts, as (lang, code, n)."""
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            codes = []
            for text in texts:
                b = words.FOLD[np.frombuffer(b"   " + text.encode(), np.uint8)].astype(np.int64)
                codes.append((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:])
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            yield pd.DataFrame({"lang": lang, "code": code, "n": n})


class Branches:
    """The children of contexts, as sorted keys context * size + symbol: bits of the symbols that follow, and the rank of the first of each word of 64."""

    def __init__(self, keys: np.ndarray, contexts: int, size: int):
        self.wide = -(-size // 64)
        word = keys // size * self.wide + keys % size // 64
        self.seen = np.zeros(contexts * self.wide, np.uint64)
        np.bitwise_or.at(self.seen, word, np.uint64(1) << (keys % size % 64).astype(np.uint64))
        self.first = np.searchsorted(word, np.arange(len(self.seen))).astype(np.int32)

    def find(self, context: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each (context, symbol) in keys, and which of them are there."""
        word = context * self.wide + (symbol >> 6)
        bit = np.uint64(1) << (symbol & 63).astype(np.uint64)
        seen = self.seen[word]
        return self.first[word] + np.bitwise_count(seen & (bit - np.uint64(1))), seen & bit != 0


def _log(x: np.ndarray) -> np.ndarray:
    """Base-2 logarithms; 0 for what isn't positive."""
    return np.log2(np.where(x > 0, x, 1))


def _rates(total: np.ndarray, kinds: np.ndarray, held: np.ndarray | float = 0.0, kinds_held: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Bits of a context by method C, as (what a symbol of count 1 costs, what the escape costs).

    held and kinds_held are the counts and kinds of symbols that a longer context excludes. Where nothing is left to be seen,
    the escape is certain and costs nothing.
    """
    kinds_left = kinds - kinds_held
    left = _log(total - held + kinds_left)
    return left, np.where(kinds_left > 0, left - _log(kinds_left), 0)


class Trees:
    """Per language a context tree of order 3 with escapes (method C with exclusion), as tables of code lengths in bits.

    A symbol seen n times after a context with N symbols of d kinds has probability n / (N + d), an unseen one
    the escape d / (N + d) and then its probability after the context without its oldest symbol, where
    the symbols of the longer context are excluded from counts and kinds; below the empty context all bytes that are left are
    alike. Probabilities of all bytes after any context thus sum to 1, and code lengths are exact. A symbol seen after
    a context is seen after all its endings, so what is excluded depends on the context just left alone, and two numbers for each
    context hold it. Every byte value that was learned is a symbol of its own. Those that no language holds are coded alike,
    so one symbol stands for each of them. Contexts of three and four symbols are kept as far as the sample holds them.
    """

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        codes, times = counts["code"].to_numpy(), counts["n"].to_numpy()
        learned = np.unique(np.concatenate([words.FOLD[[32]], *((codes >> shift) & 255 for shift in (24, 16, 8, 0))]))
        self.size = size = len(learned) + 1
        symbol = np.full(256, size - 1, np.uint8)
        symbol[learned] = np.arange(len(learned))
        self.symbol = symbol[words.FOLD]
        s = [symbol[(codes >> shift) & 255].astype(np.int64) for shift in (24, 16, 8, 0)]
        lang = pd.Categorical(counts["lang"], self.langs).codes
        before, after = (s[0] * size + s[1]) * size + s[2], (s[1] * size + s[2]) * size + s[3]
        self.threes = np.unique(np.concatenate([before, after]))
        tail = np.searchsorted(self.threes, after)
        self.fours, first, row = np.unique(np.searchsorted(self.threes, before) * size + s[3], return_index=True, return_inverse=True)
        above, rest = self.fours // size, tail[first]  # of each run of four, its first and last three symbols
        shorter, pair = self.threes // size, self.threes % size**2  # of each run of three, its first and last two
        n, one = len(self.langs), np.arange(size**2)
        table = lambda rows: np.empty((rows, n), np.float32, order="F")
        self.four, self.count2 = table(len(self.fours)), table(len(self.threes))
        self.seen3, self.escape3 = table(len(self.threes)), table(len(self.threes))  # after escaping from a listed context of three
        self.seen2, self.escape2, self.seen1, self.escape1 = (table(size**2) for _ in range(4))  # in a context of two; after escaping from one
        self.count1, self.below0 = table(size**2), table(size**2)
        for k in range(n):
            mine = lang == k
            count = lambda at, rows: np.bincount(at[mine], times[mine], rows)  # noqa: B023, E731
            n0, n1, n2, n3 = count(s[3], size), count(s[2] * size + s[3], size**2), count(tail, len(self.threes)), count(row, len(self.fours))
            by = lambda at, weights, rows: np.bincount(at, weights, rows)
            total1, kinds1 = by(one // size, n1, size), by(one // size, n1 > 0, size)
            total2, kinds2 = by(shorter, n2, size**2), by(shorter, n2 > 0, size**2)
            total3, kinds3 = by(above, n3, len(self.threes)), by(above, n3 > 0, len(self.threes))
            # Counts, one order lower, of the symbols seen in each context.
            held0, held1 = by(one // size, np.where(n1 > 0, n0[one % size], 0), size), by(shorter, np.where(n2 > 0, n1[pair], 0), size**2)
            held2 = by(above, np.where(n3 > 0, n2[rest], 0), len(self.threes))
            left0, out0 = _rates(n0.sum(), (n0 > 0).sum(), held0, kinds1)
            rare = np.log2(ALPHABET - (n0 > 0).sum()) if ALPHABET > (n0 > 0).sum() else 0.0
            self.below0[:, k] = np.where(n0 > 0, left0[:, None] - _log(n0), out0[:, None] + rare).ravel()
            self.count1[:, k], self.count2[:, k] = np.where(n1 > 0, _log(n1), np.nan), np.where(n2 > 0, _log(n2), np.nan)
            last = one % size  # the context of one that a context of two ends in
            self.seen1[:, k], self.escape1[:, k] = _rates(total1[last], kinds1[last], held1, kinds2)
            self.seen2[:, k], self.escape2[:, k] = _rates(total2, kinds2)
            left3, out3 = _rates(total3, kinds3)
            out3 = np.where(total3 > 0, out3, 0)
            self.seen3[:, k], self.escape3[:, k] = (out3 + x for x in _rates(total2[pair], kinds2[pair], held2, kinds3))
            fallback = self._lower(k, self.seen3[above, k], self.escape3[above, k], self.count2[rest, k], pair[above], self.fours % size)
            self.four[:, k] = np.where(n3 > 0, left3[above] - _log(n3), fallback)
        pooled = np.bincount(s[3], times, size)
        kinds = np.count_nonzero(pooled)
        unseen = np.log2((pooled.sum() + kinds) / kinds * max(1, ALPHABET - kinds))
        self.pooled = np.where(pooled > 0, np.log2(pooled.sum() + kinds) - _log(pooled), unseen)

    def _lower(self, k: int, seen: np.ndarray, escape: np.ndarray, count2: np.ndarray, context2: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Cost of symbols below their context of three: seen or escape, then the count in the context of two, or lower orders."""
        two = context2 % self.size * self.size + symbol
        count1 = self.count1[:, k][two]
        lower = np.where(np.isnan(count1), self.escape1[:, k][context2] + self.below0[:, k][two], self.seen1[:, k][context2] - count1)
        return np.where(np.isnan(count2), escape + lower, seen - count2)

    def index(self) -> tuple[Branches, Branches]:
        """Where runs of three symbols are in threes, and (place in threes, symbol) in fours."""
        return Branches(self.threes, self.size**2, self.size), Branches(self.fours, len(self.threes), self.size)

    def _cost(self, s: np.ndarray, at: np.ndarray, index: tuple[Branches, Branches]) -> Iterator[np.ndarray]:
        """Code lengths of the symbols s[at], which have three symbols before them, for one language after the other."""
        pair = s[:-1] * self.size + s[1:]
        place, known = index[0].find(pair[:-1], s[2:])  # of the three symbols that end two further
        context, symbol = at - 3, s[at]
        row, held = index[1].find(np.where(known, place, 0)[context], symbol)
        held &= known[context]
        missing = np.flatnonzero(~held)
        row[missing] = 0
        # An unknown context of three has nothing to escape from and excludes nothing.
        tail, ahead = at[missing] - 2, context[missing]
        listed, above = known[tail], known[ahead]
        three, place3 = np.where(listed, place[tail], 0), np.where(above, place[ahead], 0)
        context2, last = pair[tail], symbol[missing]
        for k in range(len(self.langs)):
            cost = self.four[:, k][row].astype(np.float64)
            seen = np.where(above, self.seen3[:, k][place3], self.seen2[:, k][context2])
            escape = np.where(above, self.escape3[:, k][place3], self.escape2[:, k][context2])
            cost[missing] = self._lower(k, seen, escape, np.where(listed, self.count2[:, k][three], np.nan), context2, last)
            yield cost

    def bits(self, data: np.ndarray, at: np.ndarray, index: tuple[Branches, Branches]) -> np.ndarray:
        """Code length of each text data[at[i]:at[i + 1]] in each language; a text begins after spaces."""
        out = np.zeros((len(at) - 1, len(self.langs)))
        space = self.symbol[32]
        for i, j in words.pieces(at):
            if j == i + 1:  # a very long text in parts, each after the symbols before it
                for low in range(int(at[i]), int(at[j]), PART):
                    part = self.symbol[data[max(low - 3, int(at[i])) : min(low + PART, int(at[j]))]].astype(np.int32)
                    lead = np.full(3 if low == at[i] else 0, space, np.int32)
                    s = np.concatenate([lead, part])
                    for k, cost in enumerate(self._cost(s, np.arange(3, len(s)), index)):
                        out[i, k] += cost.sum()
                continue
            size = np.diff(at[i : j + 1])
            to = np.arange(at[j] - at[i]) + 3 * np.repeat(np.arange(1, j - i + 1), size)
            s = np.full(at[j] - at[i] + 3 * (j - i), space, np.int32)
            s[to] = self.symbol[data[at[i] : at[j]]]
            full = np.flatnonzero(size)
            if len(full):
                for k, cost in enumerate(self._cost(s, to, index)):
                    out[i + full, k] = np.add.reduceat(cost, (at[i:j] - at[i])[full])
        return out

    def plain(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits of each text by the byte frequencies of all languages together, or with all bytes alike where that is less."""
        out = np.zeros(len(at) - 1)
        for i, j in words.pieces(at):
            for low in range(int(at[i]), max(int(at[j]), int(at[i]) + 1), PART) if j == i + 1 else [None]:
                if low is not None:
                    out[i] += self.pooled[self.symbol[data[low : min(low + PART, int(at[j]))]]].sum()
                    continue
                cost = self.pooled[self.symbol[data[at[i] : at[j]]]]
                full = np.flatnonzero(np.diff(at[i : j + 1]))
                if len(full):
                    out[i + full] = np.add.reduceat(cost, (at[i:j] - at[i])[full])
        return np.minimum(out, np.diff(at) * np.log2(ALPHABET))


def train(rows: DataFrame) -> Trees | None:
    """Trees from (lang, text) rows; None without rows. The driver gets counts by language and byte run, whose number the sample bounds."""
    counts = rows.mapInPandas(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counts = counts.toPandas().sort_values(["lang", "code"], ignore_index=True)
    return Trees(counts) if len(counts) else None


def predict(docs: DataFrame, trees: Trees | None, text_col: str = "text", known_share: float = KNOWN_SHARE) -> DataFrame:
    """docs with lang_pred, lang_score, lang_bits (bits a byte of the best tree) and lang_known (a text in one of the languages).

    lang_score is the posterior of lang_pred for SCORE_BYTES bytes at the text's mean code lengths. Null texts, texts without a letter,
    and all texts if nothing was learned are `und` with score 0. Of equal code lengths the first language by name wins. Columns of
    docs with these names are replaced.
    """
    drop = docs.drop("lang_pred", "lang_score", "lang_bits", "lang_known")
    if trees is None:
        return drop.withColumns({"lang_pred": F.lit("und"), "lang_score": F.lit(0.0), "lang_bits": F.lit(None).cast("double"), "lang_known": F.lit(False)})
    sent = docs.sparkSession.sparkContext.broadcast(vars(trees))  # its size is bounded by the sample

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Trees.__new__(Trees)
        vars(model).update(sent.value)
        index = model.index()
        for texts in batches:
            data, at = words.buffers(texts)
            bits = model.bits(data, at, index)
            size = np.maximum(np.diff(at), 1)
            top, least = bits.argmin(1), bits.min(1)
            away = (bits - least[:, None]) * (np.minimum(size, SCORE_BYTES) / size)[:, None]
            score = 1 / np.exp2(-np.minimum(away, 1000)).sum(1)
            pred = pa.array(model.langs, pa.string()).take(pa.array(top))
            yield pa.StructArray.from_arrays([pred, pa.array(score), pa.array(least / size), pa.array(least - known_share * model.plain(data, at))], ["pred", "score", "bits", "over"])

    handed = words.frugal(score)

    @F.arrow_udf("pred string, score double, bits double, over double")
    def best(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return handed(batches)

    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    out = drop.withColumns({"_duosig_letters": letters, "_duosig_best": best(F.coalesce(F.col(text_col), F.lit("")))})
    return out.withColumns(
        {
            "lang_pred": F.when(F.col("_duosig_letters"), F.col("_duosig_best.pred")).otherwise("und"),
            "lang_score": F.when(F.col("_duosig_letters"), F.col("_duosig_best.score")).otherwise(0.0),
            "lang_bits": F.when(F.col("_duosig_letters"), F.col("_duosig_best.bits")),
            "lang_known": F.col("_duosig_letters") & (F.col("_duosig_best.over") <= SLACK_BITS),
        }
    ).drop("_duosig_letters", "_duosig_best")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the id as text is 2 modulo 4; a null id is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify_language(
    docs: DataFrame, per_lang: int = 200, max_chars: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", known_share: float = KNOWN_SHARE,
) -> DataFrame:
    """Learns from docs' rows that aren't held out, then predicts for all rows; see predict() for the new columns.

    The trees are fitted on a bounded sample of labelled rows: per_lang texts a language, of longer texts a stretch of max_chars
    characters. Every row's whole text is scored. lang, source and doc_id take no part in it. Rows that repeat or share an id
    are scored each by itself; an empty table gives no rows.
    """
    trees = train(sample(docs, per_lang, max_chars, id_col, text_col, lang_col, ~held_out(id_col)))
    return predict(docs, trees, text_col, known_share)
