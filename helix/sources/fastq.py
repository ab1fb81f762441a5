"""FASTQ files, plain or gzip (told by their first bytes), as a data source: spark.read.format("fastq").

A plain file is read in byte ranges, and so is a blocked gzip file, by the blocks that start in a range. Quality lines may look like any other line, so records
aren't told by their shape: a first pass counts the lines of each range, in tasks, and a range then knows the number of its first line, whose
fourth parts are records. A bad record is thus the same one whatever the ranges are. Other gzip files are one task each. Ordinals are given by file
when asked for: see with_ordinals. Where only Spark's readers can open a path, they read it: see storage_lines.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from helix.sources import bgzf
from helix.sources.storage import files, opened, reachable

SCHEMA = "file string, start long, header string, seq string, separator string, qual string, _error string"


def is_gzip(path: str) -> bool:
    with opened(path) as f:
        return f.read(2) == b"\x1f\x8b"


def is_blocked_gzip(path: str) -> bool:
    with opened(path) as f:
        return bgzf.is_blocked(f)


class Range(InputPartition):
    """Bytes of a file of a size. line: the number of the first line that starts there. blocked: of a blocked gzip file."""

    def __init__(self, path: str, start: int, end: int, line: int = 0, size: int = 0, blocked: bool = False):
        self.path, self.start, self.end, self.line, self.size, self.blocked = path, start, end, line, size, blocked


def gzip_lines(path: str) -> Iterator[tuple[int, bytes]]:
    """Lines of a gzip file of any number of members, with their number; EOFError where it is cut off."""
    number, rest, unzip = 0, b"", zlib.decompressobj(31)
    with opened(path) as f:
        ended = True
        while block := f.read(1 << 20):
            while block:
                ended = False
                rest += unzip.decompress(block)
                block = unzip.unused_data
                if unzip.eof:
                    ended, unzip = True, zlib.decompressobj(31)
            *lines, rest = rest.split(b"\n")
            for line in lines:
                yield number, line
                number += 1
        if not ended:
            raise EOFError(f"{path} is cut off")
    if rest:
        yield number, rest


def plain_lines(path: str, start: int) -> Iterator[tuple[int, bytes]]:
    """Lines from a byte on, with the byte at which each starts. A line cut by the start is left out."""
    with opened(path) as f:
        if start:
            f.seek(start - 1)
            f.readline()
        at = f.tell()
        while line := f.readline():
            yield at, line.rstrip(b"\n")
            at += len(line)


def blocked_lines(path: str, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Lines of a blocked gzip file that begin after a line end in a block that starts at or after start (and the file's first line), with a number that is larger for
    later lines: 2^16 times the block's place, and where in its content the line end is."""
    with opened(path) as f:
        rest, place, begun = b"", 0, start == 0
        for at, content in bgzf.blocks(f, start, size):
            first = 0
            while (end := content.find(b"\n", first)) >= 0:
                if begun:
                    yield place, rest + content[first:end]
                rest, place, begun = b"", (at << 16) + end + 1, True
                first = end + 1
            if begun:
                rest += content[first:]
    if begun and rest:
        yield place, rest


def _clean(line: bytes, first: bool) -> str:
    line = line.removesuffix(b"\r")
    return line.removeprefix(b"\xef\xbb\xbf" if first else b"").decode("utf-8", "replace")


def records(part: Range) -> Iterator[tuple]:
    """The records that start in a range; part.line: the number of the first line that starts there."""
    zipped = is_gzip(part.path)
    if zipped and part.blocked:
        lines, end = blocked_lines(part.path, part.start, part.size), part.end << 16
    else:
        lines, end = (gzip_lines(part.path), None) if zipped else (plain_lines(part.path, part.start), part.end)
    held: list[tuple[int, bytes]] = []
    skip = -part.line % 4
    for line in lines:
        if skip:  # of a record that starts before
            skip -= 1
            continue
        if not held and end is not None and line[0] >= end:
            return
        held.append(line)
        if len(held) == 4:
            h, s, p, q = (_clean(x[1], i == 0 and held[0][0] == 0) for i, x in enumerate(held))
            yield (part.path, held[0][0], h, s, p, q, None)
            held = []
    if any(x[1].strip() for x in held):
        yield (part.path, held[0][0], _clean(held[0][1], False), None, None, None, "truncated")


def line_count(part: Range) -> int:
    """How many lines start after the first byte of a range, up to the first byte of the next."""
    if part.blocked:
        with opened(part.path) as f:
            return sum(content.count(b"\n") for _, content in takewhile(lambda x: x[0] < part.end, bgzf.blocks(f, part.start, part.size)))
    n, at, end = 0, max(0, part.start - 1), part.end - 1
    with opened(part.path) as f:
        f.seek(at)
        while at < end and (block := f.read(min(1 << 20, end - at))):
            n += block.count(b"\n")
            at += len(block)
    return n


class FastqReader(DataSourceReader):
    """counts: whether to give the lines of each range in place of records. first: for each file the numbers of the ranges' first lines, modulo 4, as JSON."""

    def __init__(self, options: dict):
        self.path, self.size, self.counts = options["path"], int(options.get("range_bytes", 64 << 20)), options.get("counts") == "true"
        self.first = json.loads(options.get("first", "{}"))

    def partitions(self) -> list[Range]:
        out = []
        for p, n in files(self.path):
            zipped = is_gzip(p)
            blocked = zipped and is_blocked_gzip(p)
            if zipped and not blocked:
                out += [] if self.counts else [Range(p, 0, n)]
            elif not self.counts and (n > self.size and p not in self.first):  # without a first pass a file is one range
                out.append(Range(p, 0, n, 0, n, blocked))
            else:
                lines = self.first.get(p, "")
                out += [Range(p, a, min(n, a + self.size), int(lines[i]) if i < len(lines) else 0, n, blocked) for i, a in enumerate(range(0, n, self.size))]
        return out or [Range(os.devnull, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not self.counts:
            yield from records(partition)
        elif partition.end:
            yield (partition.path, partition.start, str(line_count(partition)), None, None, None, None)


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)


def first_lines(counts: DataFrame) -> dict[str, str]:
    """For each file of several ranges, the number of each range's first line modulo 4, a digit each; counts: file, start, lines, a row for each range."""
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    digit = F.when(F.col("start") == 0, 0).otherwise((before + 1) % 4).cast("string")
    rows = counts.select("file", "start", digit.alias("digit")).groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "digit"))), lambda x: x["digit"]), "").alias("first"))
    return {r["file"]: r["first"] for r in rows.filter(F.length("first") > 1).collect()}  # a digit for each range, of 64 MB as a rule


def storage_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, place, line (bytes): the lines that Spark's text reader gives, by the part of the file that it read them in; places ascend within a part."""
    t = spark.read.option("lineSep", "\n").text(path)
    meta = t.metadataColumn("_metadata")
    return t.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("line"))


def storage_records(spark: SparkSession, path: str) -> DataFrame:
    """The columns of the data source, by Spark's text reader: for paths that Python can't open. start is the number of the record's first line.

    Parts of files are read by one task each and in order, so records are put together where they are read; lines at the ends of a part, three at most, that make a
    record with those of the next part meet in a second step."""
    lines = storage_lines(spark, path)
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = {(r["file"], r["block"]): r["first"] for r in counts.select("file", "block", before.alias("first")).collect()}  # a row for each part of a file that is one task's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = None, 0, []

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"file": f, "number": n, "lines": x} for f, n, x in found], pa.schema([("file", pa.string()), ("number", pa.int64()), ("lines", pa.list_(pa.binary()))]))

        for b in batches:
            out = []
            for file, block, line in zip(b["file"].to_pylist(), b["block"].to_pylist(), b["line"].to_pylist(), strict=True):
                if (file, block) != part:
                    if held:
                        out.append((part[0], number - len(held), held))
                    part, number, held = (file, block), first[file, block], []
                held.append(line)
                number += 1
                if number % 4 == 0:
                    out.append((file, number - len(held), held))
                    held = []
            yield rows(out)
        if held:
            yield rows([(part[0], number - len(held), held)])

    found = lines.select("file", "block", "line").mapInArrow(run, "file string, number long, lines array<binary>")
    whole = found.filter("size(lines) = 4")
    parts = found.filter("size(lines) < 4").groupBy("file", F.expr("number div 4").alias("q"))
    joined = parts.agg(F.sort_array(F.collect_list(F.struct("number", "lines"))).alias("x")).select("file", (F.col("q") * 4).alias("number"), F.flatten(F.transform("x", lambda y: y["lines"])).alias("lines"))
    every = whole.unionByName(joined.filter(F.exists("lines", lambda x: F.trim(x.cast("string")) != "")))
    text = lambda i: F.regexp_replace(F.get("lines", F.lit(i)).cast("string"), "\r$", "")
    header = F.when(F.col("number") == 0, F.regexp_replace(text(0), "^\ufeff", "")).otherwise(text(0))
    full = F.size("lines") == 4
    return every.select("file", F.col("number").alias("start"), header.alias("header"), *(F.when(full, text(i)).alias(c) for i, c in ((1, "seq"), (2, "separator"), (3, "qual"))), F.when(~full, "truncated").alias("_error"))


def read_fastq(spark: SparkSession, path: str, on_error: str = "fail", range_bytes: int = 64 << 20) -> DataFrame:
    """file, start, header, seq, separator, qual (and _error): the record's place, and what it holds."""
    from helix.functions.fastq import fastq_error
    from helix.sources.fasta import checked

    if reachable(path):
        spark.dataSource.register(FastqSource)
        source = spark.read.format("fastq").option("range_bytes", str(range_bytes))
        first = first_lines(source.option("counts", "true").load(path).select("file", "start", F.col("header").cast("long").alias("lines")))
        rows = spark.read.format("fastq").option("range_bytes", str(range_bytes)).option("first", json.dumps(first)).load(path)
    else:
        rows = storage_records(spark, path)
    return checked(rows.withColumn("_error", F.coalesce("_error", fastq_error("header", "seq", "separator", "qual"))), on_error)


def with_ordinals(df: DataFrame) -> DataFrame:
    """Records numbered from 0 in each file, by counts of ranges: only a range's rows are sorted, not a file's."""
    width = 1 << 26
    d = df.withColumn("_r", F.floor(F.col("start") / width))
    before = d.groupBy("file", "_r").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy("file", "_r").orderBy("start")) - 1
    return d.withColumn("_l", local).join(before, ["file", "_r"]).withColumn("ordinal", F.col("_base") + F.col("_l")).drop("_r", "_l", "_base")
