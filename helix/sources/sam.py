"""SAM text and BAM files."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from helix.functions.alignment import cigar_valid, has, nm_tag
from helix.functions.common import first_error
from helix.sources.fasta import checked
from helix.sources import bgzf
from helix.sources.fastq import Range
from helix.sources.storage import files, opened, reachable

COLUMNS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
SCHEMA = "qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string, nm long"


def record_error() -> object:
    """Why a record is invalid, or null."""
    mapped = ~has("flag", "unmapped")
    return first_error(
        (F.col("flag").isNull() | (F.col("flag") < 0) | (F.col("flag") > 65535), "bad_flag"), (F.col("mapq").isNull() | (F.col("mapq") < 0) | (F.col("mapq") > 255), "bad_mapq"), (F.col("pos").isNull() | F.col("pnext").isNull() | F.col("tlen").isNull(), "bad_number"),
        (has("flag", "read1") & has("flag", "read2"), "both_reads"), (mapped & ((F.col("rname") == "*") | (F.col("pos") < 1)), "no_place"), (mapped & ~cigar_valid("cigar"), "bad_cigar"),
    )


def read_sam(spark: SparkSession, path: str, on_error: str = "fail", skip_blank: bool = False) -> DataFrame:
    """The eleven fields and nm (and _error) of SAM records; header lines are left out, but one after a record is an error. Blank lines are an error unless skipped."""
    every = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    is_header = F.startswith("value", F.lit("@"))
    lines = every.filter(~is_header)
    if skip_blank:
        lines = lines.filter(F.trim("value") != "")
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    kinds = {"flag": "int", "pos": "long", "mapq": "int", "pnext": "long", "tlen": "long"}
    r = lines.select(f.alias("f")).select("f", *[F.get("f", F.lit(i)).try_cast(kinds.get(c, "string")).alias(c) for i, c in enumerate(COLUMNS)])
    r = r.withColumn("nm", F.when(F.size("f") > 11, nm_tag(F.slice("f", 12, 1_000_000))))
    r = r.withColumn("_error", F.when(F.size("f") < 11, "few_fields").otherwise(record_error())).drop("f")
    # a file's last header line and its first record: an aggregate with a row for each file
    ends = every.filter(is_header | (F.trim("value") != "")).groupBy("file").agg(F.max(F.when(is_header, F.col("at"))).alias("header"), F.min(F.when(~is_header, F.col("at"))).alias("record"))
    late = ends.filter("header > record").select(*[F.lit(None).cast(t).alias(c) for c, t in r.drop("_error").dtypes], F.lit("late_header").alias("_error"))
    return checked(r.unionByName(late), on_error)


def read_sam_dictionary(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    """idx (ascending, not dense), contig, length of the @SQ lines; a name that stands twice is an error."""
    sq = spark.read.text(path).withColumn("idx", F.monotonically_increasing_id()).filter(F.startswith("value", F.lit("@SQ\t")))
    tag = lambda t: F.regexp_extract_all("value", F.lit(f"\t{t}:([^\t\r]+)"), F.lit(1))
    d = sq.select("idx", tag("SN").alias("sn"), tag("LN").alias("ln")).select("idx", F.get("sn", F.lit(0)).alias("contig"), F.get("ln", F.lit(0)).try_cast("long").alias("length"), F.size("sn").alias("a"), F.size("ln").alias("b"))
    bad = (F.col("a") != 1) | (F.col("b") != 1) | F.col("length").isNull() | (F.col("length") < 1) | (F.col("length") > 5_000_000_000)
    again = F.count("*").over(Window.partitionBy("contig")) > 1
    return checked(d.withColumn("_error", F.when(bad, "bad_dictionary").when(again, "repeated_contig")).drop("a", "b"), on_error)


class Bytes:
    """A compressed file's content, read on demand. taken: the bytes that have been taken."""

    def __init__(self, file: BinaryIO):
        self.file, self.unzip, self.held, self.at, self.taken, self.ended = file, zlib.decompressobj(31), bytearray(), 0, 0, True

    def more(self) -> bool:
        block = self.file.read(1 << 20)
        if not block:
            if not self.ended:
                raise EOFError("a BAM file is cut off")
            return False
        del self.held[: self.at]
        self.at = 0
        while block:
            self.ended = False
            self.held += self.unzip.decompress(block)
            block = self.unzip.unused_data
            if self.unzip.eof:
                self.ended, self.unzip = True, zlib.decompressobj(31)
        return True

    def take(self, n: int, may_end: bool = False) -> bytes | None:
        while len(self.held) - self.at < n:
            if not self.more():
                if may_end and self.at == len(self.held):
                    return None
                raise EOFError("a BAM record is cut off")
        out = bytes(self.held[self.at : self.at + n])
        self.at, self.taken = self.at + n, self.taken + n
        return out


#: Fixed values of the format: letters of 4-bit bases and of CIGAR operations, sizes of tag values.
BASES, OPS, SIZES = "=ACMGRSVTWYHKDBN", "MIDNSHP=X", {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
#: Bytes of a record at most.
LARGEST = 64 << 20
#: The fixed part of a record; hexadecimal digits to bases; qualities to letters.
FIXED, LETTERS, PHRED = struct.Struct("<iiBBHHHiiii"), str.maketrans("0123456789abcdef", BASES), bytes((q + 33) % 256 for q in range(256))
#: The columns of a record in Arrow.
BAM_ARROW = pa.schema([(c, {"flag": pa.int32(), "mapq": pa.int32(), "pos": pa.int64(), "pnext": pa.int64(), "tlen": pa.int64(), "nm": pa.int64()}.get(c, pa.string())) for c in (*COLUMNS, "nm")])


def bam_header(data: Bytes) -> list[tuple[str, int]]:
    if data.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    data.take(struct.unpack("<i", data.take(4))[0])
    refs = []
    for _ in range(struct.unpack("<i", data.take(4))[0]):
        name = data.take(struct.unpack("<i", data.take(4))[0])[:-1].decode()
        refs.append((name, struct.unpack("<i", data.take(4))[0]))
    return refs


def _nm(raw: bytes) -> int | None:
    at, found = 0, None
    while at < len(raw):
        tag, kind = raw[at : at + 2], chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            at = raw.index(0, at) + 1
        elif kind == "B":
            at += 5 + SIZES[chr(raw[at])] * struct.unpack_from("<i", raw, at + 1)[0]
        else:
            if tag == b"NM" and kind in "cCsSiI":
                found = int.from_bytes(raw[at : at + SIZES[kind]], "little", signed=kind.islower())
            at += SIZES[kind]
    return found


def _record(raw: bytes, refs: list[str]) -> tuple:
    """A record without its size; refs end with "*"."""
    ref, pos, name_n, mapq, _, n_ops, flag, n_seq, nref, npos, tlen = FIXED.unpack_from(raw)
    at = 32
    name = raw[at : at + name_n - 1].decode()
    at += name_n
    cigar = "".join(f"{v >> 4}{OPS[v & 15]}" for v in struct.unpack_from(f"<{n_ops}I", raw, at)) or "*"
    at += 4 * n_ops
    packed = raw[at : at + (n_seq + 1) // 2]
    seq = packed.hex().translate(LETTERS)[:n_seq] or "*"
    at += (n_seq + 1) // 2
    quals = raw[at : at + n_seq]
    qual = "*" if not quals or quals[0] == 255 else quals.translate(PHRED).decode("latin-1")
    rnext = "*" if nref < 0 else "=" if nref == ref else refs[nref]
    if not flag & 4 and n_ops == 0:
        raise ValueError("a mapped BAM record has no CIGAR")
    return name, flag, refs[ref], pos + 1, mapq, cigar, rnext, npos + 1, tlen, seq, qual, _nm(raw[at + n_seq :])


def bam_records(file: BinaryIO) -> Iterator[tuple]:
    """All records of a file."""
    data = Bytes(file)
    refs = [n for n, _ in bam_header(data)] + ["*"]
    while (size := data.take(4, may_end=True)) is not None:
        n = struct.unpack("<i", size)[0]
        if not 32 <= n <= LARGEST:
            raise ValueError("a BAM record has a wrong size")
        yield _record(data.take(n), refs)


def _tags_end(raw: bytes, at: int) -> bool:
    """Do the tags from at on end where the record does?"""
    while at < len(raw):
        if at + 4 > len(raw):
            return False
        kind = chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.find(0, at)
            if end < 0:
                return False
            at = end + 1
        elif kind == "B":
            if at + 5 > len(raw) or chr(raw[at]) not in SIZES:
                return False
            at += 5 + SIZES[chr(raw[at])] * int.from_bytes(raw[at + 1 : at + 5], "little")
        elif kind in SIZES:
            at += SIZES[kind]
        else:
            return False
    return at == len(raw)


def _plausible(raw: bytes, n_refs: int) -> bool:
    """Can these bytes be a whole record?"""
    ref, pos, name_n, _, _, n_ops, _, n_seq, nref, npos, _ = FIXED.unpack_from(raw)
    at = 32 + name_n + 4 * n_ops
    if not (-1 <= ref < n_refs and -1 <= nref < n_refs and pos >= -1 and npos >= -1 and name_n > 0 and n_seq >= 0) or at + (n_seq + 1) // 2 + n_seq > len(raw):
        return False
    name = raw[32 : 32 + name_n]
    return name[-1] == 0 and all(32 < c < 127 for c in name[:-1]) and _tags_end(raw, at + (n_seq + 1) // 2 + n_seq)


class Blocks:
    """The content of blocks from a range on, with the block that each byte is of."""

    def __init__(self, f: BinaryIO, part: Range):
        self.blocks, self.held, self.cuts, self.base = bgzf.blocks(f, part.start, part.size), bytearray(), [], 0

    def more(self) -> bool:
        found = next(self.blocks, None)
        if found is None:
            return False
        self.cuts.append((self.base + len(self.held), found[0]))
        self.held += found[1]
        return True

    def at(self, place: int, n: int) -> bytes | None:
        """n bytes from a place of the content on; None where it ends before."""
        while self.base + len(self.held) < place + n:
            if not self.more():
                return None
        return bytes(self.held[place - self.base : place - self.base + n])

    def block_of(self, place: int) -> int | None:
        """Where the block of the byte at a place begins; what comes before place is let go. None at the end of the file."""
        while self.base + len(self.held) <= place:
            if not self.more():
                return None
        while len(self.cuts) > 1 and self.cuts[1][0] <= place:
            self.cuts.pop(0)
        if place - self.base > 1 << 20:
            del self.held[: place - self.base]
            self.base = place
        return self.cuts[0][1]


#: Records in a row that must be plausible for the first of a range.
CHAIN = 6


def _first_record(data: Blocks, part: Range, n_refs: int) -> int | None:
    """Where the first record that begins in a range's blocks does: from there on, records follow each other."""

    def chained(place: int) -> bool:
        for i in range(CHAIN):
            size = data.at(place, 4)
            if size is None:
                return i > 0 and data.at(place, 1) is None
            n = int.from_bytes(size, "little")
            if not 32 <= n <= LARGEST:
                return False
            fixed = data.at(place + 4, 32)
            if fixed is None or not -1 <= int.from_bytes(fixed[:4], "little", signed=True) < n_refs or (raw := data.at(place + 4, n)) is None or not _plausible(raw, n_refs):
                return False
            place += 4 + n
        return True

    place = 0
    while True:
        while data.base + len(data.held) <= place:
            if not data.more():
                return None
        block = next(b for p, b in reversed(data.cuts) if p <= place)
        if block >= part.end:
            return None
        if chained(place):
            return place
        place += 1


def bam_range(part: Range) -> Iterator[tuple]:
    """The records of a blocked file that begin in the blocks of a range."""
    with opened(part.path) as f:
        header = Bytes(f)
        refs = [n for n, _ in bam_header(header)] + ["*"]
        data = Blocks(f, part)
        if part.start == 0:
            place = header.taken
        elif (place := _first_record(data, part, len(refs) - 1)) is None:
            return
        while (block := data.block_of(place)) is not None and block < part.end:
            size = data.at(place, 4)
            n = int.from_bytes(size or b"", "little", signed=True)
            if size is not None and not 32 <= n <= LARGEST:
                raise ValueError("a BAM record has a wrong size")
            if size is None or (raw := data.at(place + 4, n)) is None:
                raise EOFError("a BAM record is cut off")
            yield _record(raw, refs)
            place += 4 + n


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("range_bytes", 64 << 20))

    def partitions(self) -> list[Range]:
        out = []
        for p, n in files(self.path):
            with opened(p) as f:
                blocked = bgzf.is_blocked(f)
            out += [Range(p, a, min(n, a + self.size), 0, n, True) for a in range(0, n, self.size)] if blocked else [Range(p, 0, n, 0, n)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.blocked:
            yield from bam_range(partition)
        else:
            with opened(partition.path) as f:
                yield from bam_records(f)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """content: whole BAM files -> their records."""
    names = [*COLUMNS, "nm"]
    for b in batches:
        for content in b["content"]:
            records = bam_records(io.BytesIO(content.as_buffer()))
            while some := list(islice(records, 4096)):
                yield pa.RecordBatch.from_arrays([pa.array(c) if n != "nm" else pa.array(c, pa.int64()) for n, c in zip(names, zip(*some, strict=True), strict=True)], names).cast(BAM_ARROW)


def read_bam(spark: SparkSession, path: str, on_error: str = "fail", range_bytes: int = 64 << 20) -> DataFrame:
    """The columns of read_sam. A blocked file is read in ranges, any other by one task; where Python can't open the path, each file (of 2 GB at most) is one task's."""
    if reachable(path):
        spark.dataSource.register(BamSource)
        d = spark.read.format("bam").option("range_bytes", str(range_bytes)).load(path)
    else:
        d = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_contents, SCHEMA)
    return checked(d.withColumn("_error", record_error()), on_error)


def read_bam_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """idx (from 0), contig, length of the header of a path's first BAM file, a list of contigs."""
    if reachable(path):
        with opened(files(path)[0][0]) as f:
            refs = bam_header(Bytes(f))
    else:
        first = spark.read.format("binaryFile").load(path).orderBy("path").select("content").first()
        refs = bam_header(Bytes(io.BytesIO(first["content"])))
    return spark.createDataFrame([(i, *x) for i, x in enumerate(refs)], "idx long, contig string, length long")
