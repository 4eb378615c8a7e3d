"""Licence scan, tokenizer alignment and periodic runs against brute force on awkward tables: nulls, empty and long texts, repeats, no rows, extra columns."""

import bisect
import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from duosig.llm import alignment, license_scan, periodic, pii, queries

COLUMNS = "doc_id long, text string, row string, words string, piece string, template string, pair string, runs string"
MIT = license_scan.WORDINGS[[x for x, _ in license_scan.WORDINGS].index("mit") + 1][1]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    names = ["gnu", "general", "public", "license", "apache", "mit", "cc", "by", "other", "software", "été", "12"]
    rows = [(i, " ".join(rng.choice(names) for _ in range(rng.randrange(60)))) for i in range(60)]
    edited = MIT.split()
    for i in range(6):
        w = list(edited)
        for _ in range(i):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = ["Changed"] * rng.randrange(3)
        rows.append((100 + i, "Before. " + " ".join(w) + " and after " + ", ".join(edited)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "MIT-License"), (203, "MIT-License"), (203, "cc"), (None, "The Apache License, Version 2.0"), (None, None), (204, "mit license " * 3000), (205, " lead and  double  "), (206, "▁ under"), (207, "日本語 naïve ½ \U0001f600"), (208, "<|endoftext|> <unk> <0x41>"), (212, "GNU General Public License: licensed under the GNU General Public License, version 3.")]
    rows += [(209, "MIT LıcenSe mit licenſe mit liKense gnu\x00general"), (210, "a b c " * 40 + "d " * 30), (211, " ".join(rng.choice("ab") for _ in range(5000)))]
    return rows + [(300 + i, "one two three four " * rng.randrange(4, 12) + "five " * rng.randrange(30)) for i in range(40)]


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame([(*r, *"xxxxxx") for r in texts], COLUMNS).repartition(5).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], COLUMNS).write.parquet(f"{path}/documents.parquet")
    return path


def same(df, want):
    assert sorted(map(str, [tuple(r) for r in df.collect()])) == sorted(map(str, want))


def test_license_scan(spark, texts, folder, empty):
    def licenses(t):
        w, every = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)), []
        for base, known in ((True, license_scan.PHRASES), (False, license_scan.WORDINGS)):
            for label, text in known:
                x, k = text.split(), 2 if base else 5
                whole = base or len(x) < license_scan.LOOSE_WORDS
                found = sorted((p - q, p, q) for p in range(len(w) - k + 1) for q in range(len(x) - k + 1) if w[p : p + k] == x[q : q + k])
                band = []
                for i, (off, p, q) in enumerate(found):
                    band.append((p, q))
                    if i + 1 == len(found) or found[i + 1][0] - off > (0 if whole else len(x) // 10):
                        a, b, n = min(band)[0], max(band)[0] + k, len({y + j for _, y in band for j in range(k)})
                        if 100 * n >= (100 if whole else 80) * max(len(x), b - a):
                            every.append((a, label, base, n / len(x)))
                        band = []
        return w, every

    want = []
    for d, t in texts:
        w, every = licenses(t)
        starts = [a for a, _, base, _ in every if base]
        named = lambda xs: ",".join(sorted({label for _, label, _, _ in xs}))
        want.append((d, len(w), len(starts), min(starts, default=None), max(starts, default=None), named([x for x in every if x[2]]), named(every), float(max((x[3] for x in every), default=0)), len(every)))
    assert any("gpl-3.0" in r[6] for r in want) and any(0.8 <= r[7] < 1 or "mit" in r[6] and "mit" not in r[5] for r in want)
    same(queries.op11_license_scan(spark, folder), want)
    assert queries.op11_license_scan(spark, empty).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = license_scan.scan_licenses(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    with pytest.raises(ValueError, match="words"):
        license_scan.templates(spark, [("x", "one")])


def test_alignment(spark, texts, folder, empty, monkeypatch):
    a, b = alignment.ByteTokens(queries.BYTE_TOKENIZER), alignment.PieceTokens(queries.PIECE_TOKENIZER)
    each, corpus = [], collections.Counter()
    for _, t in texts:
        ids = [a.own.encode(" " + (t or ""), add_special_tokens=False).ids, b.model.encode(t or "")]
        spelled = [[own.bytes[i] for i in x] for own, x in zip((a, b), ids, strict=True)]
        if not t or any(b"".join(x) != b" " + t.encode() for x in spelled):
            each.append(None)
            continue
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelled]
        cuts, groups, links, low = sorted(set(ends[0]) & set(ends[1])), [], [], [0, 0]
        for c in cuts:
            high = [bisect.bisect_right(e, c) for e in ends]
            groups.append("|".join(",".join(map(str, x[i:j])) for x, i, j in zip(ids, low, high, strict=True)))
            for i in range(low[0], high[0]):
                for j in range(low[1], high[1]):
                    if max(ends[0][i] - len(spelled[0][i]), ends[1][j] - len(spelled[1][j])) < min(ends[0][i], ends[1][j]):
                        links.append((ids[0][i], ids[1][j]))
            low = high
        each.append((len(ids[0]), len(ids[1]), groups, links))
        corpus.update(links)
    most = collections.Counter()
    for (_, y), n in corpus.items():
        most[y] = max(most[y], n)
    want = []
    for (d, _), x in zip(texts, each, strict=True):
        if x is None:
            want.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = x
            want.append((d, n_a, n_b, len(groups), len(links), sum(corpus[p] == most[p[1]] for p in links), sum(corpus[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    assert {200, 201, 206} <= {r[0] for r in want if r[1] == 0} and all(r[1] for r in want if r[0] in (207, 208, 211))
    monkeypatch.setattr(alignment, "PIECE", 500)
    monkeypatch.setattr(alignment, "LANE", 7)
    same(queries.op12_alignment(spark, folder), want)
    assert queries.op12_alignment(spark, empty).count() == 0


def test_byte_tokens_by_rank_are_those_of_the_merges():
    a = alignment.ByteTokens(queries.BYTE_TOKENIZER)
    assert a.ranks is not None
    rng = random.Random(2)
    odd = [" " + "".join(chr(c) + x + chr(c) * 2 for x in (" ", "a", "1", "'s")) for c in range(1, 0x250)]
    odd += [" " + "".join(rng.choice("aeinst  \n.'01é") for _ in range(rng.randrange(200))) for _ in range(400)] + [" " + "a" * 500, " " + "\n" * 77, ""]
    assert a.ids(odd) == [x.ids for x in a.own.encode_batch(odd, add_special_tokens=False)]


def test_lockstep_of_uneven_sides():
    whole = np.array([1000, 1001])
    ends = np.append(np.arange(1, 1001), 1001)
    for first, second in ((whole, ends), (ends, whole)):
        la, lb, ca, cb = alignment.lockstep(first, second, np.array([0, len(first) - 1, len(first) - 1, len(first)]))
        assert len(la) == len(lb) == 1001 and ca.sum() == cb.sum() == 2
    assert [len(x) for x in alignment.lockstep(whole[:0], whole[:0], np.array([0]))] == [0, 0, 0, 0]
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 40, 1000))
    assert (alignment.unpacked(alignment.packed(values), 1000) == values).all() and not len(alignment.unpacked(b"", 0))


def runs_of(w, least=24):
    """Every run by its definition: for each period all stretches, each with its smallest period."""
    out = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def test_runs_of_many_shapes():
    rng = random.Random(1)

    def text():
        n, k = rng.choice([0, 1, 23, 24, 25, 60, 150, 300]), rng.choice([1, 2, 2, 3, 50])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(4) if n > 30 else 0):
            at, p = rng.randrange(n), rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 31, 32, 33])
            for i in range(at, min(n, at + rng.randrange(3 * p, 6 * p + 1))):
                w[i] = w[at + (i - at) % p]
        shape = rng.random()
        if shape < 0.1:  # Fibonacci
            a, w = [0], [0, 1]
            for _ in range(10):
                a, w = w, w + a
        elif shape < 0.4:  # roots that hold runs of their own
            u = [0, 1][: rng.randrange(1, 3)] * rng.randrange(1, 20) + [rng.randrange(3)]
            r = u * rng.randrange(1, 4) + [1, 0] * rng.randrange(20)
            w = w[: rng.randrange(20)] + r * rng.randrange(3, 7) + r[: rng.randrange(len(r))]
        return w

    for trial in range(60):
        several, least = [text() for _ in range(rng.randrange(1, 10))], rng.choice([24, 24, 10, 40])
        bounds = np.append(0, np.cumsum([len(t) for t in several]))
        got = periodic.runs_of(np.array([x for t in several for x in t], np.int64), bounds, least)
        want = [(int(bounds[i]) + s, n, q) for i, t in enumerate(several) for s, n, q in runs_of(t, least)]
        assert list(zip(*(x.tolist() for x in got), strict=True)) == want, trial


def test_wavelet_tree():
    rng = np.random.default_rng(5)
    values = rng.permutation(500)
    tree = periodic.WaveletTree(values, 10)
    lo = rng.integers(0, 499, 300)
    hi = rng.integers(lo + 1, 501)
    bound, k = rng.integers(0, 600, 300), rng.integers(0, hi - lo)
    assert tree.below(lo, hi, bound).tolist() == [int((values[a:b] < x).sum()) for a, b, x in zip(lo, hi, bound, strict=True)]
    assert tree.at(lo, hi, k).tolist() == [int(np.sort(values[a:b])[x]) for a, b, x in zip(lo, hi, k, strict=True)]


def test_periodic_runs(spark, texts, folder, empty, monkeypatch):
    want = []
    for d, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = runs_of(w)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        said = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((d, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    assert sum(r[1] > 0 for r in want) > 20
    monkeypatch.setattr(periodic, "PIECE", 700)
    same(queries.op13_periodic_runs(spark, folder), want)
    assert queries.op13_periodic_runs(spark, empty).count() == 0
    plain = {r["doc_id"]: r for r in periodic.find_runs(spark.read.parquet(f"{folder}/documents.parquet").where(F.col("doc_id") == 210)).collect()}
    assert [tuple(r) for r in plain[210]["runs"]] == runs_of(("a b c " * 40 + "d " * 30).split()) and plain[210]["collapsed"] == "a b c d"
    with pytest.raises(ValueError, match="periods"):
        periodic.runs_of(np.zeros(3, np.int64), np.array([0, 3]), times=2)


def test_overlaps_of_wide_spans(spark):
    """Wide spans by their patterns, less those that overlap a base span; of wide spans that overlap each other some stay, apart from one another."""
    rng = random.Random(9)
    parts = ["a.b@c.de", "joe (at) mail (dot) com", "4111 1111 1111 1111", "+49 30 1234567", "(212) 555-1234", "123-45-6789", "123456789", "4000-0000-0000-0", "9876 5432 1098 76", "10.0.0.1", "1:2:3:4:5:6:7:8", "x", "account", "ssn", "-", "/", "call"]
    texts = [rng.choice(["", " "]).join(rng.choice(parts) + rng.choice(["", " ", ", "]) for _ in range(rng.randrange(30))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.candidates(df, "doc_id", "text").collect()}
    kept = {r["doc_id"]: r for r in pii.find_pii(df, threshold=0.0).collect()}
    overlap = lambda a, b: a[0] < b[1] and b[0] < a[1]
    n_wide = n_dropped = 0
    for d, text in enumerate(texts):
        base = [(s["start"], s["stop"]) for s in found[d]["base"]]
        every = [(m.start(), m.end(), kind) for kind, pattern, _ in pii.WIDE for m in re.finditer(pattern, text)]
        want = [w for w in every if not any(overlap(w, b) for b in base)]
        assert sorted((s["start"], s["stop"], s["kind"]) for s in found[d]["wide"]) == sorted(want)
        added = [(s["start"], s["stop"], s["kind"]) for s in kept[d]["added"]]
        assert set(added) <= set(want) and not any(overlap(a, b) for a in added for b in added if a != b)
        assert all(any(overlap(w, x) for x in want if x != w) for w in set(want) - set(added))
        n_wide, n_dropped = n_wide + len(every), n_dropped + len(every) - len(added)
    assert n_wide > 100 and n_dropped > 10


def test_many_spans_in_one_text(spark):
    """A list of 30,000 addresses and as many account numbers is one text, and takes seconds."""
    text = "\n".join(f"user{i}@mail.com account 9876 5432 1098 {i:05d}" for i in range(30_000))
    began = time.time()
    r = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("n_email", F.size("base").alias("b"), F.size("added").alias("a")).first()
    assert r["n_email"] == 30_000 and r["b"] + r["a"] > 55_000 and time.time() - began < 90
