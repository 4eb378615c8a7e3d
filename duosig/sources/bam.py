"""Alignments in BAM files as a Spark data source: splits of the compressed file, read side by side, and writing back what a filter keeps.

Decoding follows the published format: blocks are gzip members that state their own size; records follow each other through blocks.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Compressed bytes that one task reads.
SPLIT = 64 << 20
#: Fixed values of the format: a block's first bytes, the empty block at the end, a header's first bytes, bytes before a record's name.
BLOCK_HEAD = b"\x1f\x8b\x08\x04"
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MAGIC = b"BAM\x01"
FIXED = 36
#: Bytes of one value of each tag type.
TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
#: Operations of a CIGAR that take up letters of the aligned part of a read, and of the whole read.
ALIGNED, WHOLE = (0, 1, 7, 8), (0, 1, 4, 7, 8)
#: Records that must follow each other from a place for it to be a record's start.
CHAIN = 12
BLOCK_BYTES = 0xFF00
SCHEMA = (
    "reference_name string, reference_start long, read_name string, flag int, mapping_quality int, cigar array<struct<op:int,len:int>>, "
    "query_length int, query_alignment_length int, inferred_length int, de double, reference_id int, record binary"
)
ARROW = pa.schema(
    [("reference_name", pa.string()), ("reference_start", pa.int64()), ("read_name", pa.string()), ("flag", pa.int32()), ("mapping_quality", pa.int32()), ("cigar", pa.list_(pa.struct([("op", pa.int32()), ("len", pa.int32())])))]
    + [(c, pa.int32()) for c in ("query_length", "query_alignment_length", "inferred_length")] + [("de", pa.float64()), ("reference_id", pa.int32()), ("record", pa.binary())]
)


def _opened(path: str):
    """(filesystem, path in it) of a local path or a URL that pyarrow knows."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _block_size(head: bytes) -> int | None:
    """The size of the block that begins with head; None if none begins there."""
    if len(head) < 18 or head[:4] != BLOCK_HEAD:
        return None
    extra, at = struct.unpack_from("<H", head, 10)[0], 12
    while at + 4 <= min(len(head), 12 + extra):
        name, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if name == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


class _Blocks:
    """Blocks of a file from a place on, decompressed one by one."""

    def __init__(self, file, at: int, size: int):
        self.file, self.at, self.size, self.buffer, self.base = file, at, size, b"", at

    def _bytes(self, at: int, n: int) -> bytes:
        if not (self.base <= at and at + n <= self.base + len(self.buffer)):
            self.file.seek(at)
            self.buffer, self.base = self.file.read(max(n, 1 << 20)), at
        return self.buffer[at - self.base : at - self.base + n]

    def find(self) -> bool:
        """Goes to the next block that begins at this place or after: one whose successors, so far as they are looked at, are blocks too."""
        while self.at < self.size:
            part = self._bytes(self.at, min(1 << 17, self.size - self.at))
            hit = part.find(BLOCK_HEAD)
            if hit < 0:
                self.at += max(1, len(part) - 3)
                continue
            at = self.at + hit
            follow = at
            for _ in range(3):
                n = _block_size(self._bytes(follow, min(64, self.size - follow)))
                if n is None:
                    break
                follow += n
                if follow == self.size:
                    break
            if n is not None and follow <= self.size:
                self.at = at
                return True
            self.at = at + 1
        return False

    def next(self) -> tuple[int, bytes] | None:
        """(where the block begins, its content)."""
        if self.at >= self.size:
            return None
        n = _block_size(self._bytes(self.at, min(1 << 10, self.size - self.at)))
        if n is None:
            raise ValueError(f"no block at {self.at}")
        block, at = self._bytes(self.at, n), self.at
        extra = struct.unpack_from("<H", block, 10)[0]
        self.at += n
        return at, zlib.decompress(block[12 + extra : -8], -15)


@dataclass(frozen=True)
class Header:
    text: bytes
    references: list[tuple[str, int]]

    def bytes(self) -> bytes:
        refs = b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in self.references)
        return MAGIC + struct.pack("<i", len(self.text)) + self.text + struct.pack("<i", len(self.references)) + refs


def read_header(path: str) -> tuple[Header, int, int]:
    """(header, block in which the first record begins, place in its content)."""
    system, name = _opened(path)
    with system.open_input_file(name) as file:
        blocks = _Blocks(file, 0, file.size())
        data, starts = b"", []

        def need(n: int) -> None:
            nonlocal data
            while len(data) < n:
                got = blocks.next()
                if got is None:
                    raise ValueError(f"{path} ends within its header")
                starts.append((len(data), got[0]))
                data += got[1]

        need(12)
        if data[:4] != MAGIC:
            raise ValueError(f"{path} is no BAM file")
        size = struct.unpack_from("<i", data, 4)[0]
        need(12 + size)
        at, refs = 12 + size, []
        for _ in range(struct.unpack_from("<i", data, 8 + size)[0]):
            need(at + 4)
            n = struct.unpack_from("<i", data, at)[0]
            need(at + 8 + n)
            refs.append((data[at + 4 : at + 3 + n].decode(), struct.unpack_from("<i", data, at + 4 + n)[0]))
            at += 8 + n
        within = [x for x in starts if x[0] <= at]
        return Header(data[8 : 8 + size], refs), within[-1][1], at - within[-1][0]


def _plausible(data: bytes, at: int, references: int) -> int | None:
    """Where the record at this place would end; None if there can't be one."""
    size, ref, pos, name, _, _, cigars, _, letters, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
    least = 32 + name + 4 * cigars + (letters + 1) // 2 + letters
    if letters < 0 or not name or size < least or not -1 <= ref < references or pos < -1 or not -1 <= mate < references or mate_pos < -1:
        return None
    said = data[at + FIXED : at + FIXED + name]
    if len(said) == name and (said[-1] != 0 or any(not 33 <= c <= 126 for c in said[:-1])):
        return None
    return at + 4 + size


def _possible(data: bytes, begin: int, references: int) -> list[int]:
    """Places from begin on whose bytes, but for the name, could begin a record."""
    raw = np.frombuffer(data, np.uint8)[begin:]
    n = len(raw) - FIXED + 1
    if n <= 0:
        return []
    byte = raw.astype(np.uint32)
    number = (byte[:-3] | byte[1:-2] << 8 | byte[2:-1] << 16 | byte[3:] << 24).view(np.int32)
    field = lambda at: number[at : at + n]
    fits = (field(0) >= 33) & (field(20) >= 0) & (raw[12 : 12 + n] > 0) & (field(8) >= -1) & (field(28) >= -1)
    for at in (4, 24):
        fits &= (field(at) >= -1) & (field(at) < references)
    return (begin + np.flatnonzero(fits)).tolist()


def first_record(data: bytes, references: int, whole: bool, begin: int = 0) -> tuple[int | None, int]:
    """(place, tried): the first place from begin on at which CHAIN records follow each other, or as many as data holds where it is whole.

    None if data is too short to tell; then no place before tried is one.
    """
    for start in _possible(data, begin, references):
        at, found = start, 0
        while found < CHAIN and not (at == len(data) and whole):
            if at + FIXED > len(data):
                if not whole:
                    return None, start
                found = -1
                break
            end = _plausible(data, at, references)
            if end is None or (whole and end > len(data)):
                found = -1
                break
            found, at = found + 1, end
        if found >= 0:
            return start, start
    return (len(data), len(data)) if whole else (None, max(begin, len(data) - FIXED + 1))


def _de(tags: bytes) -> float | None:
    """The value of the tag de."""
    at = 0
    while at + 3 <= len(tags):
        name, kind = tags[at : at + 2], chr(tags[at + 2])
        at += 3
        if name == b"de" and kind in "fcCsSiI":
            return float(struct.unpack_from("<" + {"c": "b", "C": "B", "s": "h", "S": "H"}.get(kind, kind), tags, at)[0])
        if kind in "ZH":
            at = tags.index(b"\0", at) + 1
        elif kind == "B":
            at += 5 + TAG_SIZES[chr(tags[at])] * struct.unpack_from("<i", tags, at + 1)[0]
        else:
            at += TAG_SIZES[kind]
    return None


def decode(data: bytes, offsets: list[int], header: Header) -> pa.RecordBatch:
    """Records at offsets as rows."""
    at = np.array(offsets, np.int64)
    raw = np.frombuffer(data, np.uint8)
    head = np.ascontiguousarray(raw[at[:, None] + np.arange(FIXED)]).view(np.dtype("<i4,<i4,<i4,u1,u1,<u2,<u2,<u2,<i4,<i4,<i4,<i4")).ravel()
    size, ref, pos, name, quality, _, cigars, flag, letters = (head[f"f{i}"].astype(np.int64) for i in range(9))
    first = np.append(0, np.cumsum(cigars))
    places = np.repeat(at + FIXED + name - 4 * first[:-1], cigars) + 4 * np.arange(first[-1])
    values = np.ascontiguousarray(raw[places[:, None] + np.arange(4)]).view("<u4").ravel() if len(places) else np.zeros(0, np.uint32)
    op, length = (values & 15).astype(np.int32), (values >> 4).astype(np.int32)
    lengths = [np.diff(np.append(0, np.cumsum(np.where(np.isin(op, kinds), length, 0)))[first]) for kinds in (ALIGNED, WHOLE)]
    tags = FIXED + name + 4 * cigars + (letters + 1) // 2 + letters
    cut = lambda a, b: [data[x + y : x + z] for x, y, z in zip(at.tolist(), a.tolist(), b.tolist(), strict=True)]
    names = [None if r < 0 else header.references[r][0] for r in ref.tolist()]
    cigar = pa.ListArray.from_arrays(first.astype(np.int32), pa.StructArray.from_arrays([pa.array(op), pa.array(length)], ["op", "len"]))
    columns = [
        names, pos, [x.decode() for x in cut(np.full(len(at), FIXED), FIXED + name - 1)], flag.astype(np.int32), quality.astype(np.int32), cigar, letters.astype(np.int32),
        lengths[0].astype(np.int32), lengths[1].astype(np.int32), [_de(x) for x in cut(tags, 4 + size)], ref.astype(np.int32), cut(np.zeros(len(at), np.int64), 4 + size),
    ]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


@dataclass
class Split(InputPartition):
    path: str
    start: int
    stop: int


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.split = json.loads(options["paths"]), int(options.get("split", SPLIT))

    def partitions(self) -> list[Split]:
        out = []
        for path in self.paths:
            system, name = _opened(path)
            size = system.get_file_info(name).size
            out += [Split(path, at, min(at + self.split, size)) for at in range(0, size, self.split)]
        return out

    def read(self, part: Split) -> Iterator[pa.RecordBatch]:
        """Records that begin in blocks that begin in the split; the last one may end in a later block."""
        header, first_block, first_at = read_header(part.path)
        system, name = _opened(part.path)
        with system.open_input_file(name) as file:
            blocks = _Blocks(file, part.start, file.size())
            if part.stop <= first_block:
                return
            known = part.start <= first_block
            if known:
                blocks.at = first_block
            elif not blocks.find():
                return
            data, bounds = b"", []  # bounds: where contents of blocks of the split end
            at, tried = (first_at, 0) if known else (None, 0)
            more = True
            while True:
                if blocks.at >= part.stop and not bounds:
                    return
                got = blocks.next() if more else None
                more = got is not None
                if more:
                    data += got[1]
                    if got[0] < part.stop:
                        bounds.append(len(data))
                if at is None:
                    at, tried = first_record(data, len(header.references), not more, tried)
                    if at is None:
                        continue
                limit, offsets = bounds[-1], []
                while at < limit and at + 4 <= len(data):
                    end = at + 4 + struct.unpack_from("<i", data, at)[0]
                    if end > len(data):
                        break
                    offsets.append(at)
                    at = end
                if offsets:
                    yield decode(data, offsets, header)
                through = blocks.at >= part.stop
                if at >= limit and through:
                    return
                if not more:
                    if at < limit:
                        raise ValueError(f"{part.path} ends within a record")
                    return
                # What is before the next record is done with.
                cut = min(at, len(data))
                data, at, bounds = data[cut:], at - cut, [bounds[-1] - cut]


@dataclass
class Written(WriterCommitMessage):
    part: str
    index: list


class BamWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder, self.header = options["path"].rstrip("/"), bytes.fromhex(options["header"])

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """One BAM file of this task's rows in their order, with their places by reference; its name is made final by commit()."""
        system, folder = _opened(self.folder)
        system.create_dir(folder, recursive=True)
        part, index, written = f"{folder}/.{uuid.uuid4().hex}", {}, 0
        with system.open_output_stream(part) as out:
            buffer = self.header

            def flush(least: int) -> None:
                nonlocal buffer, written
                while len(buffer) > least:
                    block = _packed(buffer[:BLOCK_BYTES])
                    out.write(block)
                    written, buffer = written + len(block), buffer[BLOCK_BYTES:]

            flush(0)  # records begin in a block of their own
            for batch in batches:
                columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("reference_id", "reference_start", "record")]
                for ref, start, record in zip(*columns, strict=True):
                    # A virtual offset: where the block begins, and the place in its content.
                    place = (written << 16) | len(buffer)
                    first = index.setdefault(ref, [start, start, place, 0])
                    index[ref] = [min(first[0], start), max(first[1], start), first[2], first[3] + 1]
                    buffer += record
                    flush(BLOCK_BYTES)
            flush(0)
            out.write(END_BLOCK)
        return Written(part, [[ref, *x] for ref, x in index.items()])

    def commit(self, messages: list[Written | None]) -> None:
        """Names the files by their order and writes which references each holds: first and last start, virtual offset of the first, records."""
        system, folder = _opened(self.folder)
        done = sorted((m for m in messages if m is not None), key=lambda m: min(((x[0] < 0, x[0], x[1]) for x in m.index), default=(True, 0, 0)))
        lines = []
        for i, m in enumerate(done):
            name = f"part-{i:05d}.bam"
            system.move(m.part, f"{folder}/{name}")
            lines += [json.dumps({"file": name, "reference_id": r, "first": a, "last": b, "offset": o, "records": n}) for r, a, b, o, n in m.index]
        with system.open_output_stream(f"{folder}/references.json") as out:
            out.write("".join(x + "\n" for x in lines).encode())

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None:
                _opened(self.folder)[0].delete_file(m.part)


def _packed(content: bytes) -> bytes:
    """A block of content."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(content) + squeeze.flush()
    head = BLOCK_HEAD + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(content), len(content))


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)

    def writer(self, schema, overwrite: bool) -> BamWriter:
        return BamWriter(self.options)


def read_bam(spark: SparkSession, paths: str | list[str], split: int = SPLIT) -> DataFrame:
    """Alignments of BAM files: what the alignment filter reads, and each record as it is.

    A task reads the records that begin in the blocks of its share of a compressed file, whatever the size of the shares: it looks for the first block, and in that for the
    first place from which records follow each other. Names and sizes are the format's: starts from 0, -1 without a place; de is null where a record has no such tag.
    Files have to be where executors can open them: in a shared folder, or a store that pyarrow knows by its URL.
    """
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("paths", json.dumps([paths] if isinstance(paths, str) else list(paths))).option("split", str(split)).load()


def write_bam(kept: DataFrame, folder: str, header: Header) -> None:
    """Writes alignments of read_bam() by reference and start: BAM files in that order, each with the header, and references.json, where which reference begins.

    Alignments without a place come last. Files get their names once all are written, so that what a lost task leaves is not a part.
    """
    kept.sparkSession.dataSource.register(BamSource)
    last = F.col("reference_id") < 0
    order = [last, F.col("reference_id"), F.col("reference_start")]
    rows = kept.repartitionByRange(*order, F.xxhash64("read_name")).sortWithinPartitions(*order)
    rows.write.format("bam").option("path", folder).option("header", header.bytes().hex()).mode("append").save()
