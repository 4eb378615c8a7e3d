"""Alignment of two tokenizers over the same texts: which tokens overlap, where both end together, and how often id pairs are linked in the corpus."""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import shared, words

#: Bytes of texts that are aligned together; a longer text is a piece by itself.
PIECE = 3 << 20
#: Tokens of the first tokenizer that one state of the merge passes: a longer text is that many states, so that steps stay few.
LANE = 256
#: How the byte tokenizer cuts texts before it merges: a fixed value, the format's own.
CUTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Up to here all versions of Unicode agree which characters are letters and digits.
_LATER = re.compile("[^\x00-ɏ]")
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 bytes are themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteTokens:
    """The byte-level tokenizer of a JSON file. ids() takes texts with the space before them.

    Ranks give the same tokens as the file's merges, faster, where each entry is what its own letters merge to: then the two parts that make
    an entry are always those of its merge. Where that doesn't hold, and for letters that versions of Unicode class differently, the file's own library is used.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True  # their strings in texts are plain text
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        letters, special = byte_letters(), {x["content"] for x in said.get("added_tokens", ())}
        vocabulary = said["model"]["vocab"]
        self.bytes = [b""] * (1 + max(vocabulary.values()))
        for entry, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.ranks = None
        before = said.get("pre_tokenizer") or {}
        alone = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not said.get("normalizer")
        if alone and all([x.id for x in self.own.model.tokenize(entry)] == [i] for entry, i in vocabulary.items() if entry not in special):
            import tiktoken

            merges = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in said["model"]["merges"]]
            if merges == sorted(merges):
                ranks = {self.bytes[i]: i for entry, i in vocabulary.items() if entry not in special}
                self.ranks = tiktoken.Encoding("bytes", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[str]) -> list[list[int]]:
        if self.ranks is None:
            return [x.ids for x in self.own.encode_batch(texts, add_special_tokens=False)]
        return [self.ranks.encode_ordinary(t) if _LATER.search(t) is None else self.own.encode(t, add_special_tokens=False).ids for t in texts]


class PieceTokens:
    """The tokenizer of a piece model. ids() takes texts as they are; the model adds a space."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = lambda i: self.model.id_to_piece(i).replace("▁", " ").encode()
        self.bytes = [bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i) else plain(i) for i in range(self.model.vocab_size())]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@functools.lru_cache(2)
def _byte_tokens(path: str) -> ByteTokens:
    return ByteTokens(path)


@functools.lru_cache(2)
def _piece_tokens(path: str) -> PieceTokens:
    return PieceTokens(path)


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, cut_a, cut_b): every overlapping pair of tokens, and which tokens end where both sides do.

    ends_*: where tokens end, over all texts one after the other; first_a: the first token of each text, and the end. One state vector holds a
    pair of pointers for every text, and of every LANE tokens of a long one; each step links all pairs, cuts where both end, and advances whichever
    token ends first, or both. States that are through leave the vector.
    """
    starts = [np.arange(lo, hi, LANE) for lo, hi in itertools.pairwise(first_a.tolist()) if hi > lo]
    a = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    stop = np.append(a[1:], len(ends_a))
    begins = np.concatenate([[0], ends_a])[a]
    b = np.searchsorted(ends_b, begins, "right")
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    links_a, links_b = [], []
    while len(a):
        links_a.append(a)
        links_b.append(b)
        end_a, end_b = ends_a[a], ends_b[b]
        both = end_a == end_b
        cut_a[a[both]] = True
        cut_b[b[both]] = True
        a, b = a + (end_a <= end_b), b + (end_b <= end_a)
        going = a < stop
        if not going.all():
            a, b, stop = a[going], b[going], stop[going]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *links_a]), np.concatenate([none, *links_b]), cut_a, cut_b


def written_groups(ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, said: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids in the order of their groups, as text with what follows each, and where each token of the first side stands. said: see _said()."""
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    upto_a, upto_b = np.append(0, np.flatnonzero(cut_a) + 1), np.append(0, np.flatnonzero(cut_b) + 1)
    place_a, place_b = np.arange(len(ids_a)) + upto_b[group_a], np.arange(len(ids_b)) + upto_a[group_b + 1]
    out = np.empty(len(ids_a) + len(ids_b), np.int64)
    size = len(said) // 3
    out[place_a] = ids_a + size * cut_a
    out[place_b] = ids_b + 2 * size * cut_b
    return said[out], place_a


@functools.lru_cache(2)
def _said(size: int) -> np.ndarray:
    """Ids as text, followed by a comma, by the bar between the sides of a group, and by the end of a group."""
    return np.array([f"{i}{x}".encode() for x in ",|;" for i in range(size)], object)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as differences, byte by byte in planes, so that the many zero bytes cost nothing."""
    planes = np.diff(values, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unpacked(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel())


def align_piece(texts: list[str | None], a: ByteTokens, b: PieceTokens) -> dict:
    """Of one piece of texts: counts and groups of each, its id pairs with their numbers of links, and each text's share of these."""
    some = [i for i, t in enumerate(texts) if t]
    ids_a, ids_b = a.ids([" " + texts[i] for i in some]), b.ids([texts[i] for i in some])
    whole = []
    for k, i in enumerate(some):
        want = b" " + texts[i].encode()
        if b"".join(map(a.bytes.__getitem__, ids_a[k])) == want and b"".join(map(b.bytes.__getitem__, ids_b[k])) == want:
            whole.append(k)
    n = {c: np.zeros(len(texts), np.int64) for c in _COUNTS}
    row = np.array([some[k] for k in whole], np.int64)
    n_a, n_b = (np.fromiter((len(ids[k]) for k in whole), np.int64, len(whole)) for ids in (ids_a, ids_b))
    flat_a, flat_b = (np.fromiter(itertools.chain.from_iterable(ids[k] for k in whole), np.int64, int(m.sum())) for ids, m in ((ids_a, n_a), (ids_b, n_b)))
    del ids_a, ids_b
    length_a, length_b = (np.fromiter(map(len, x.bytes), np.int64, len(x.bytes)) for x in (a, b))
    first_a = np.append(0, np.cumsum(n_a))
    link_a, link_b, cut_a, cut_b = lockstep(np.cumsum(length_a[flat_a]), np.cumsum(length_b[flat_b]), first_a)
    text_of = np.repeat(np.arange(len(whole)), n_a)
    of = text_of[link_a]
    n["n_a"][row], n["n_b"][row] = n_a, n_b
    n["n_groups"][row], n["n_links"][row] = np.bincount(text_of[cut_a], minlength=len(whole)), np.bincount(of, minlength=len(whole))

    written, place = written_groups(flat_a, flat_b, cut_a, cut_b, _said(max(len(a.bytes), len(b.bytes))))
    bounds = np.append(place[first_a[:-1]], len(written)) if len(whole) else np.zeros(1, np.int64)
    digest = [""] * len(texts)
    for k, i in enumerate(row.tolist()):
        digest[i] = hashlib.sha256(b"".join(written[bounds[k] : bounds[k + 1]].tolist())[:-1]).hexdigest()
    del written

    pairs, where, links = np.unique(flat_a[link_a] * len(b.bytes) + flat_b[link_b], return_inverse=True, return_counts=True)
    keys, times = np.unique(row[of] * max(1, len(pairs)) + where, return_counts=True)
    return {**n, "groups_sha256": digest, "pair": pairs, "links": links, "n_keys": len(keys), "keys": packed(keys), "times": packed(times)}


def _aligner(byte_path: str, piece_path: str, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _byte_tokens(byte_path), _piece_tokens(piece_path)
        task, number = TaskContext.get().partitionId(), itertools.count()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            _, at = words.buffers(texts)
            for i, j in words.pieces(at, PIECE):
                got = align_piece(texts.slice(i, j - i).to_pylist(), a, b)
                column = {"piece": pa.array([(task << 33) + next(number)]), "doc_id": pa.array([ids.slice(i, j - i).to_pylist()], pa.list_(id_type))}
                for c in (*_COUNTS, "pair", "links"):
                    column[c] = pa.ListArray.from_arrays(np.array([0, len(got[c])], np.int32), pa.array(got[c]))
                column |= {"groups_sha256": pa.array([got["groups_sha256"]]), "n_keys": pa.array([got["n_keys"]]), "keys": pa.array([got["keys"]]), "times": pa.array([got["times"]])}
                yield pa.RecordBatch.from_pydict(column)

    return words.frugal(run)


def _sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """One row per text of a piece, from its keys and the corpus-wide counts of its pairs."""
    row = left.to_pylist()[0]
    order = np.argsort(right["pair"].to_numpy())
    count, best = right["count"].to_numpy()[order], right["best"].to_numpy()[order]
    keys, times = unpacked(row["keys"], row["n_keys"]), unpacked(row["times"], row["n_keys"])
    text, pair = np.divmod(keys, max(1, len(count)))
    bounds = np.searchsorted(text, np.arange(len(row["doc_id"]) + 1))
    summed = lambda x: np.diff(np.append(0, np.cumsum(x))[bounds])
    out = {"doc_id": left["doc_id"].combine_chunks().flatten(), **{c: left[c].combine_chunks().flatten() for c in _COUNTS}}
    out |= {"n_best": pa.array(summed(times * best[pair])), "count_sum": pa.array(summed(times * count[pair])), "groups_sha256": left["groups_sha256"].combine_chunks().flatten()}
    return pa.table(out)


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is the byte-level tokenizer of the JSON file byte_path, B the piece model piece_path; every executor has to have both. Both read a text after
    a space. Links are the pairs of A and B tokens that share bytes; groups lie between bytes where tokens of both end. count_sum sums, over a text's
    links, how many links of the whole corpus have the same two ids; n_best counts those whose two ids have the most of all pairs with that B id.
    groups_sha256 is over the ids of the groups. Null and empty texts, and those that the tokens of either don't spell out, have no tokens: zeros and ''.
    Rows that share a doc_id or are equal are apart, ids may be null, an empty table gives no rows; other columns aren't read.

    Texts are aligned in pieces of about PIECE bytes, a longer text by itself, and are read once. Of a piece the distinct pairs with their links
    are shuffled to be summed, and come back with the sums to what is stored of its texts: a pair that all texts hold is a row of each piece. B ids,
    no more than the vocabulary has, are broadcast with their highest count.
    """
    id_type = docs.schema[id_col].dataType
    listed = lambda kind: T.ArrayType(kind)
    schema = T.StructType([T.StructField("piece", T.LongType()), T.StructField("doc_id", listed(id_type)), *[T.StructField(c, listed(T.LongType())) for c in (*_COUNTS, "pair", "links")]])
    schema = schema.add("groups_sha256", listed(T.StringType())).add("n_keys", T.LongType()).add("keys", T.BinaryType()).add("times", T.BinaryType())
    columns = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = shared.materialise(columns.mapInArrow(_aligner(byte_path, piece_path, to_arrow_type(id_type)), schema))

    each = pieces.select("piece", F.explode(F.arrays_zip("pair", "links")).alias("p")).select("piece", "p.pair", "p.links")
    by_pair = F.sum("links").over(shared.Window.partitionBy("pair"))  # a pair has a row for each piece, so none has many
    counted = shared.materialise(each.select("piece", "pair", by_pair.alias("count")))
    id_b = F.col("pair") % F.lit(len(_piece_tokens(piece_path).bytes))
    most = counted.groupBy(id_b.alias("b")).agg(F.max("count").alias("most"))
    answers = counted.withColumn("b", id_b).join(F.broadcast(most), "b").select("piece", "pair", "count", (F.col("count") == F.col("most")).alias("best"))
    out = T.StructType([T.StructField("doc_id", id_type), *[T.StructField(c, T.LongType()) for c in (*_COUNTS, "n_best", "count_sum")], T.StructField("groups_sha256", T.StringType())])
    kept = pieces.select("piece", "doc_id", *_COUNTS, "groups_sha256", "n_keys", "keys", "times")
    return kept.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(_sums, out)
