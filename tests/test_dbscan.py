"""Density clusters against loops over all pairs, and links of their cells."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duosig.operators import dbscan, graph


def brute(points, eps, least):
    """{id: (core, label)} of one group."""
    ids, x = list(points), np.array(list(points.values()))
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= least
    label = {i: i for i, c in zip(ids, core, strict=True) if c}
    changed = True
    while changed:
        changed = False
        for a in np.flatnonzero(core):
            for b in np.flatnonzero(near[a] & core):
                if label[ids[b]] < label[ids[a]]:
                    label[ids[a]], changed = label[ids[b]], True
    out = {}
    for a, i in enumerate(ids):
        reach = [label[ids[b]] for b in np.flatnonzero(near[a] & core)]
        out[i] = (bool(core[a]), label[i] if core[a] else min(reach, default=None))
    return out


@pytest.mark.parametrize("d", [1, 2, 3, 5])
def test_clusters_are_those_of_all_pairs(spark, d):
    rng = np.random.default_rng(d)
    rows, want = [], {}
    for group in ("a", "b"):
        centres = rng.uniform(-20, 20, (4, d))
        x = np.concatenate([rng.normal(c, s, (n, d)) for c, s, n in zip(centres, (0.5, 1.5, 3.0, 1.0), (60, 50, 40, 4), strict=True)] + [rng.uniform(-25, 25, (20, d))])
        chain = np.zeros((40, d))
        chain[:, 0] = 40 + np.arange(40) * 0.9  # a long cluster over many cells
        x = np.concatenate([x, chain, x[:3]])  # and rows that repeat
        points = {int(i): v.tolist() for i, v in zip(rng.permutation(len(x)), x, strict=True)}
        rows += [(group, i, *v) for i, v in points.items()]
        want |= {(group, i): r for i, r in brute(points, 1.6, 5).items()}
    names = [f"x{i}" for i in range(d)]
    df = spark.createDataFrame(rows, "g string, id long, " + ", ".join(f"{n} double" for n in names))
    got = {(r["g"], r["id"]): (r["core"], r["label"]) for r in dbscan.dbscan(df, ["g"], names, 1.6, least=5).collect()}
    assert got == want
    assert len({x for _, x in want.values()}) > 2 and any(x is None for _, x in want.values()) and (d == 5 or any(x is not None and not c for c, x in want.values()))
    assert dbscan.dbscan(df.limit(0), ["g"], names, 1.6, least=5).count() == 0


def test_dense_cells_do_not_compare_their_rows(spark):
    """A hundred times the rows in one range: all cells are core, and no two rows are compared."""
    rng = random.Random(1)
    rows = [(i, rng.uniform(0, 6), rng.uniform(0, 6)) for i in range(30_000)]
    df = spark.createDataFrame(rows, "id long, x double, y double").withColumn("g", F.lit(1))
    got = dbscan.dbscan(df, ["g"], ["x", "y"], 1.0, least=50)
    assert got.where("label = 0 and core").count() == 30_000


def test_components_of_any_nodes(spark):
    edges = [((1, i), (1, i + 1)) for i in range(30) if i % 10] + [((2, 5), (2, 5)), ((2, 1), (2, 9)), ((2, 9), (2, 3))]
    df = spark.createDataFrame([(*a, *b) for a, b in edges], "a int, b int, c int, d int").select(F.struct("a", "b").alias("u"), F.struct(F.col("c").alias("a"), F.col("d").alias("b")).alias("v"))
    got = {tuple(r["node"]): tuple(r["root"]) for r in graph.components(df).collect()}
    assert got == {(1, i): (1, i - (i - 1) % 10) for i in range(1, 31)} | {(2, i): (2, 1) for i in (1, 3, 9)}
    assert graph.components(df.limit(0)).count() == 0


def test_open_cells_compare_few_points(spark, monkeypatch):
    """No cell holds enough rows by itself and all surroundings do; rows of one place are one point. Before, each row met all rows around it: 30 million pairs here."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.exponential(4.0, (8_000, 2)), np.repeat(rng.uniform(0, 6, (4, 2)), 1_000, axis=0)]).round(3)
    seen = []
    plain = dbscan._Cells.compared
    monkeypatch.setattr(dbscan, "COMPARED", 4)
    monkeypatch.setattr(dbscan._Cells, "compared", lambda self, open_, *a: (seen.append((open_.select(F.sum(F.col("_p") * F.aggregate("_around", F.lit(0).cast("long"), lambda t, o: t + o["_q"]))).first()[0] or 0, self.points.count())), plain(self, open_, *a))[1])
    df = spark.createDataFrame([("a", i, *v) for i, v in enumerate(x.tolist())], "g string, id long, x double, y double")
    near = np.concatenate([((b[:, None] - x[None]) ** 2).sum(2) <= 4.0 for b in np.array_split(x, 40)])
    core = near.sum(1) >= 0.08 * len(x)
    met = near[:, core].any(1)
    assert core.any() and (met & ~core).any() and not met.all()
    want = {i: (bool(c), not m) for i, (c, m) in enumerate(zip(core, met, strict=True))}
    got = {r["id"]: (r["core"], r["label"] is None) for r in dbscan.dbscan(df, ["g"], ["x", "y"], 2.0, share=0.08).collect()}
    assert got == want
    assert {r["id"]: r["noise"] for r in dbscan.noise(df, ["g"], ["x", "y"], 2.0, share=0.08).collect()} == {i: n for i, (_, n) in want.items()}
    assert seen and all(pairs <= 4 * points and points < 8_010 for pairs, points in seen)
