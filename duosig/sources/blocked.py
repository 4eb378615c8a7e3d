"""Lines of gzip files whose members state their size, read by many tasks in the order of the file. Other gzip files can't be entered but at their start."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from . import bam

#: Lines that are handed on at once.
LINES = 20_000
ARROW = pa.schema([("value", pa.string()), ("_file", pa.int32()), ("_block", pa.int64())])


class LineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.split = json.loads(options["paths"]), int(options.get("split", bam.SPLIT))

    def partitions(self) -> list[bam.Split]:
        return bam.BamReader({"paths": json.dumps(self.paths), "split": str(self.split)}).partitions()

    def read(self, part: bam.Split) -> Iterator[pa.RecordBatch]:
        """Lines that begin in members that begin in the split; a line that begins where a member does belongs to the member before, which can't see its end otherwise."""
        system, name = bam._opened(part.path)
        with system.open_input_file(name) as file:
            blocks = bam._Blocks(file, part.start, file.size())
            if not blocks.find() or blocks.at >= part.stop:
                return
            rest, skip, lines = b"", part.start > 0, []
            while (got := blocks.next()) is not None:
                at, data = got
                if skip:  # up to the first line's end the text is the split's before
                    cut = data.find(b"\n")
                    if cut < 0:
                        if at >= part.stop:
                            return
                        continue
                    if at >= part.stop:
                        return
                    data, skip = data[cut + 1 :], False
                if at >= part.stop:
                    cut = data.find(b"\n")
                    if cut < 0:
                        rest += data
                        continue
                    lines.append(rest + data[:cut])
                    rest = b""
                    break
                *whole, rest = (rest + data).split(b"\n")
                lines += whole
                if len(lines) >= LINES:
                    yield self._batch(lines, part)
                    lines = []
            if rest:
                lines.append(rest)
            if lines:
                yield self._batch(lines, part)

    def _batch(self, lines: list[bytes], part: bam.Split) -> pa.RecordBatch:
        n = len(lines)
        text = pa.array([x[:-1] if x.endswith(b"\r") else x for x in lines], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([text, pa.array([self.paths.index(part.path)] * n, pa.int32()), pa.array([part.start] * n, pa.int64())], schema=ARROW)


class BlockedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blocked_lines"

    def schema(self) -> str:
        return "value string, _file int, _block long"

    def reader(self, schema) -> LineReader:
        return LineReader(self.options)


def first_line(path: str) -> str:
    reader = LineReader({"paths": json.dumps([path]), "split": "1"})
    for batch in reader.read(bam.Split(path, 0, 1)):
        return batch.column(0)[0].as_py()
    return ""


def blocked_lines(spark: SparkSession, paths: str | list[str], split: int = bam.SPLIT) -> DataFrame:
    """value, _file and _block of the lines of gzip files in members that state their size, as block compressors write them.

    A task reads the lines that begin in its share of a compressed file, of `split` bytes, in order; _file is the file's place among paths and _block where the share begins, as
    splits.collapse_splits() takes them. Files have to be where executors can open them: in a shared folder, or a store that pyarrow knows by its URL.
    """
    spark.dataSource.register(BlockedLines)
    return spark.read.format("blocked_lines").option("paths", json.dumps([paths] if isinstance(paths, str) else list(paths))).option("split", str(split)).load()


def blocked_tsv(spark: SparkSession, paths: list[str], split: int = bam.SPLIT) -> DataFrame:
    """Tables with a header, as strings by its names, with _file and _block; all files have the first one's header. Their headers are no rows."""
    header = first_line(paths[0])
    cut = F.split("value", "\t", -1)
    rows = blocked_lines(spark, paths, split).where(F.col("value") != header)
    return rows.select(*[F.get(cut, F.lit(i)).alias(c) for i, c in enumerate(header.split("\t"))], "_file", "_block")
