"""Runs of adjacent lines found where the lines are: inside file splits, in file order, with nothing shuffled but each split's ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stored

#: A file's lines are numbered from its own multiple of this, by where their split begins and their place in it.
FILE_SPAN = 1 << 44
SUMS = ("k", "km", "kss", "kmm", "duration")


def in_file_order(spark: SparkSession, paths: list[str], read) -> DataFrame:
    """The rows of read(path) of every file with _file, its place among paths, and _block, where the row's split of it begins."""
    parts = [read(path).withColumns({"_file": F.lit(i), "_block": F.input_file_block_start()}) for i, path in enumerate(paths)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


class _Runs:
    """Runs of one task's rows, as they come. A run is open until another key or split begins; ends of splits are told apart."""

    def __init__(self, keys: list[str]):
        self.keys, self.open, self.rows, self.split_rows, self.split = keys, None, 0, 0, None

    def _differs(self, columns: list[pa.Array]) -> np.ndarray:
        new = np.zeros(max(0, len(columns[0]) - 1), bool)
        for c in columns:
            code = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new |= code[1:] != code[:-1]
        return np.append(True, new)

    def add(self, batch: pa.RecordBatch) -> pa.Table:
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        n = batch.num_rows
        splits = self._differs([column("_file"), column("_block")])
        new = splits | self._differs([column(c) for c in self.keys])
        # Where each row's split began, counted over all rows of the task.
        number = self.rows + np.arange(n)
        same_split = self.split == (column("_file")[0].as_py(), column("_block")[0].as_py())
        if same_split:
            splits[0] = False
        began = np.maximum.accumulate(np.where(splits, number, self.split_rows if same_split else number[0]))
        at = np.flatnonzero(new)
        number_of = lambda c: np.nan_to_num(column(c).to_numpy(zero_copy_only=False).astype(float))
        k, m, s = number_of("points"), number_of("mean"), number_of("std")
        sums = {"k": k, "km": k * m, "kss": k * s * s, "kmm": k * m * m, "duration": number_of("duration")}
        runs = pa.table(
            {c: column(c).take(pa.array(at)) for c in (*self.keys, "_file", "_block")}
            | {"n": np.diff(np.append(at, n))} | {c: np.add.reduceat(v, at) for c, v in sums.items()}
            | {"mean": column("mean").take(pa.array(at)), "std": column("std").take(pa.array(at)), "at": (number - began)[at], "first": splits[at]}
        )
        self.rows, self.split_rows, self.split = self.rows + n, int(began[-1]), (column("_file")[n - 1].as_py(), column("_block")[n - 1].as_py())
        if self.open is not None:
            one, two = self.open.to_pylist()[0], runs.slice(0, 1).to_pylist()[0]
            if all(one[c] == two[c] for c in (*self.keys, "_file", "_block")):
                joined = one | {c: one[c] + two[c] for c in ("n", *SUMS)}
                runs = pa.concat_tables([pa.Table.from_pylist([joined], runs.schema), runs.slice(1)])
            else:
                runs = pa.concat_tables([self.open, runs])
        self.open = runs.slice(runs.num_rows - 1)
        # The next run's being the first of a split makes this one the last of its own.
        first = runs["first"].combine_chunks()
        return self._told(runs.slice(0, runs.num_rows - 1), pc.or_(first.slice(0, runs.num_rows - 1), first.slice(1)))

    def _told(self, runs: pa.Table, ends: pa.Array) -> pa.Table:
        return runs.drop_columns(["first"]).append_column("end", ends)

    def rest(self) -> pa.Table | None:
        return None if self.open is None else self._told(self.open, pa.array([True]))


def split_runs(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of each split: keys, _file, _block, n, sums, mean and std of the first line, at (the first line's place in the split), end (of its split)."""
    number = {c: F.col(c).cast("double") for c in ("mean", "std", "duration")} | {"points": F.col("points").cast("long")}
    rows = lines.select(*keys, *[c.alias(x) for x, c in number.items()], F.col("_file").cast("int").alias("_file"), F.col("_block").cast("long").alias("_block"))
    kept = [*keys, "_file", "_block"]
    schema = T.StructType([rows.schema[c] for c in kept]).add("n", "long")
    for c in (*SUMS, "mean", "std"):
        schema = schema.add(c, "double")
    schema = schema.add("at", "long").add("end", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(keys)
        for batch in batches:
            if batch.num_rows:
                yield from runs.add(batch).to_batches()
        if (rest := runs.rest()) is not None:
            yield from rest.to_batches()

    return rows.mapInArrow(run, schema)


def _line(block: str, at: str) -> Column:
    return F.col("_file").cast("long") * FILE_SPAN + F.col(block) + F.col(at)


def collapse_splits(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of adjacent lines with equal keys, in file order: keys, mean, std, duration, n and row_no, that of the run's first line.

    lines: keys, mean, std, duration, points, and _file and _block of in_file_order(), as the scan gives them, without a shuffle or a
    sort since. Mean and deviation are pooled over lines of `points` points each; a single line's own values stay; a missing value counts
    as zero where lines are pooled. Null keys are equal. A line has at least one byte, so that where its split begins and its place in it number it.

    Splits are collapsed by the tasks that read them and stored. Only the first and the last run of each split are shuffled, by file, to
    be joined to their neighbours, over as many splits as a run has; a file has no more of these than two for each split.
    """
    runs = stored(split_runs(lines, keys).withColumn("row_no", _line("_block", "at")))
    ends = runs.where("end")
    by = Window.partitionBy("_file").orderBy("row_no")
    # Two runs of one split are never the same run.
    new = F.lag("_block").over(by).isNull() | (F.lag("_block").over(by) == F.col("_block"))
    for k in keys:
        new = new | ~F.col(k).eqNullSafe(F.lag(k).over(by))
    numbered = ends.withColumn("_new", new.cast("long")).withColumn("_run", F.sum("_new").over(by))
    first = [F.min_by(c, "row_no").alias(c) for c in ("mean", "std")]
    met = numbered.groupBy("_file", "_run", *keys).agg(*[F.sum(c).alias(c) for c in ("n", *SUMS)], *first, F.min("row_no").alias("row_no"))
    names = [*keys, "n", *SUMS, "mean", "std", "row_no"]
    every = runs.where("not end").select(*names).unionByName(met.select(*names))
    average = F.try_divide("km", "k")
    variance = F.try_divide("kss", "k") + F.try_divide("kmm", "k") - average * average
    one = F.col("n") == 1
    pooled = [F.when(one, F.col("mean")).otherwise(average).alias("mean"), F.when(one, F.col("std")).otherwise(F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("std")]
    return every.select(*keys, *pooled, "duration", "n", "row_no")
