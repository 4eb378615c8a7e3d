"""The pipeline's stages and the whole of it, also where ids repeat or are null."""

import random
import re

import corpus_pipeline
from duosig.llm import exact_dedup

COLUMNS = "doc_id long, text string, lang string, source string"


def test_stages_judge_rows_not_ids(spark, tmp_path):
    rng = random.Random(13)
    text = lambda n: " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))
    item, base = text(12), text(100)
    near = lambda k: f"{base} end{k}"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    clean = {(1, text(30)), (2, text(30)), (None, text(30)), (None, text(30)), (3, None), (3, "")}
    dirty = {(1, f"{text(5)} {item}"), (None, f"{item} {text(5)}"), (4, item)}
    docs = spark.createDataFrame([(d, t, "en", "s") for d, t in clean | dirty], COLUMNS)
    got = corpus_pipeline.remove_benchmarks(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and got.schema == docs.schema
    assert sorted(map(str, got.select("doc_id", "text").collect())) == sorted(map(str, docs.select("doc_id", "text").where(~docs["text"].contains(item) | docs["text"].isNull()).collect()))

    lone = {(7, text(40)), (7, text(40)), (None, text(40)), (None, text(3)), (8, None), (9, None), (None, None), (12, text(40))}
    copies = {(11, near(0)), (12, near(1)), (12, near(2)), (None, near(3)), (None, near(4))}
    other = text(80)
    nulls = {(None, f"{other} a"), (None, f"{other} b")}  # of copies without an id, one stays
    docs = spark.createDataFrame([(d, t, "en", "s") for d, t in lone | copies | nulls], COLUMNS)
    got = corpus_pipeline.join_near_copies(spark, docs.repartition(3), str(tmp_path)).select("doc_id", "text").collect()
    rest = [r for r in map(tuple, got) if r not in nulls]
    assert sorted(map(str, rest)) == sorted(map(str, lone | {(11, near(0))}))
    assert len(got) == len(rest) + 1


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def by_hand(docs, items):
    """Rows that stages 2 to 4 keep, by loops over pairs."""
    order = lambda r: (r[0] is None, r[0] or 0)
    kept = {}
    for r in sorted(docs, key=order):
        kept.setdefault(re.sub("[ \t-\r]+", " ", r[1] or ""), r)
    rows = list(kept.values())
    sets = []
    for r in rows:
        w = re.findall(r"[^ \t-\r]+", lower(r[1]))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                o = len(a & b)
                if o and 100 * o >= 80 * len(a | b) and label[i] > label[j]:
                    label[i], changed = label[j], True
    rows = [min((rows[i] for i in range(len(rows)) if label[i] == x), key=order) for x in sorted(set(label))]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for t in items:
        w = word.findall(lower(t))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    found = lambda w, k: any(tuple(w[i : i + len(k)]) == k for i in range(len(w) - len(k) + 1))
    return [r for r in rows if not any(found(word.findall(lower(r[1])), k) for k in windows)]


def test_the_whole_pipeline(spark, tmp_path):
    rng = random.Random(17)
    known = {"en": [f"{rng.choice(['the', 'ing', 'wh'])}{rng.choice(['er', 'on', 'at'])}{i}" for i in range(400)], "fr": [f"{rng.choice(['eau', 'où', 'ille'])}{rng.choice(['ç', 'eux', 'le'])}{i}" for i in range(400)]}
    text = lambda x, n: " ".join(rng.choice(known[x]) for _ in range(n))
    docs = [(i, text(x, rng.randrange(20, 80)), x, f"src{i % 5}") for i in range(120) for x in [rng.choice(["en", "fr"])]]
    items = [text("en", 14), text("fr", 11)]
    docs += [(200 + i, docs[i][1].replace(" ", "\n ", 2), "en", "src0") for i in range(15)]  # exact copies
    docs += [(300 + i, docs[20 + i % 3][1] + f" more{i}", "en", None) for i in range(12)]  # near copies
    docs += [(400 + i, f"{text('en', 5 + i)} {items[i % 2].upper()} {text('en', 5)}", "en", "src1") for i in range(6)]  # benchmark passages
    strange = [(500, "".join(rng.choice("ஃஅஆஇஈஉஊஎஏஐ") for _ in range(80)), None, "src2"), (501, "中文字符測試" * 20, None, "src2"), (502, None, "en", "src1"), (503, "", "en", "src1"), (504, "12 34 !!", "en", None)]
    docs += [(None, text("en", 30), "en", "src1"), (None, text("fr", 30), "fr", "src1"), (7, text("en", 40), "en", "src1"), (7, docs[7][1], "en", "src1"), (None, f"{items[0]} x", "en", "src1")]
    columns = "doc_id long, text string, lang string, source string"
    spark.createDataFrame(docs + strange, columns).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    live = exact_dedup.exact_duplicates(spark.createDataFrame(docs, columns))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in got) == sorted(str(r[:2]) for r in by_hand(docs, items))
    assert live.count() == len(docs)  # tables of others are left alone
    assert corpus_pipeline.identify(spark, spark.createDataFrame([], columns), str(tmp_path)).count() == 0
    empty = spark.createDataFrame([], columns)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
