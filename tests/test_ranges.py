"""Blocked gzip, BAM and FASTQ files give the same rows wherever they are cut, and by Spark's own readers."""

import gzip
import io
import random
import struct
import zlib

import pytest

from helix import workflows
from helix.sources import bgzf, fastq, sam, storage
from helix.sources.fastq import Range, line_count, read_fastq, records
from helix.sources.sam import bam_range, bam_records, read_bam, read_bam_dictionary


def block(data):
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def blocked(data, sizes):
    """data in blocks of the sizes in turn, and the empty block at the end."""
    out, at, i = [], 0, 0
    while at < len(data):
        out.append(block(data[at : at + sizes[i % len(sizes)]]))
        at, i = at + sizes[i % len(sizes)], i + 1
    return b"".join(out) + block(b"")


def bam(n, refs=(("c1", 5000), ("c2", 900)), seed=2):
    rng = random.Random(seed)
    out = [b"BAM\1", struct.pack("<i", 5), b"@HD\n\0", struct.pack("<i", len(refs))]
    out += [struct.pack("<i", len(k) + 1) + k.encode() + b"\0" + struct.pack("<i", size) for k, size in refs]
    for i in range(n):
        m = rng.choice([0, 1, 7, 50, 3000 if i % 40 == 0 else 20])
        name = f"read{i}".encode() + b"\0"
        mapped = m > 0 and i % 5
        cigar = struct.pack("<I", m << 4) if mapped else b""
        tags = rng.choice([b"", b"NMC\x03", b"XZZabc\0NMi" + struct.pack("<i", 7), b"XBBS" + struct.pack("<iHH", 2, 5, 6)])
        seq, qual = bytes(rng.randrange(256) for _ in range((m + 1) // 2)), bytes(rng.randrange(60) for _ in range(m))
        body = struct.pack("<iiBBHHHiiii", i % 2 if mapped else -1, i if mapped else -1, len(name), i % 61, 4680, len(cigar) // 4, 0 if mapped else 4, m, -1, -1, 0) + name + cigar + seq + qual + tags
        out.append(struct.pack("<i", len(body)) + body)
    return b"".join(out)


@pytest.mark.parametrize("sizes", [(300,), (97, 4001, 1), (60_000,)])
def test_every_cut_of_a_bam_file_gives_the_same_records(tmp_path, sizes):
    data = blocked(bam(120), sizes)
    path, n = tmp_path / "x.bam", len(data)
    path.write_bytes(data)
    want = list(bam_records(io.BytesIO(data)))
    assert len(want) == 120 and {r[11] for r in want} == {None, 3, 7}
    part = lambda a, b: list(bam_range(Range(str(path), a, b, 0, n, True)))
    for cut in range(1, n, 61):
        assert part(0, cut) + part(cut, n) == want, cut
    thirds = [0, n // 3, 2 * n // 3, n]
    assert [r for a, b in zip(thirds, thirds[1:], strict=False) for r in part(a, b)] == want


def test_bam_ranges_by_spark(spark, tmp_path):
    data = bam(700)
    (tmp_path / "a.bam").write_bytes(blocked(data, (700, 65_000)))
    (tmp_path / "b.bam").write_bytes(gzip.compress(data))
    rows = lambda d: sorted(map(tuple, d.collect()), key=repr)
    want = sorted(bam_records(io.BytesIO((tmp_path / "a.bam").read_bytes())), key=repr)
    assert rows(read_bam(spark, str(tmp_path / "a.bam"), range_bytes=5000)) == want
    assert rows(read_bam(spark, str(tmp_path / "b.bam"))) == want and rows(read_bam(spark, str(tmp_path), range_bytes=20_000)) == sorted(want * 2, key=repr)
    assert [tuple(r) for r in read_bam_dictionary(spark, str(tmp_path)).collect()] == [(0, "c1", 5000), (1, "c2", 900)]


def test_a_cut_off_blocked_file_is_an_error(tmp_path):
    data = blocked(bam(50), (500,))
    with pytest.raises(EOFError):
        list(bgzf.blocks(io.BytesIO(data[:-40]), 0, len(data) - 40))


FASTQ = "".join(f"@r{i}\n{'ACGTN' * (i % 7 + 1)}\n+\n{'@+I:5' * (i % 7 + 1)}\n" for i in range(90)) + "@bad\nACGT\nno separator\nIII\n@last\nA\n+\nI"


def test_every_cut_of_a_blocked_fastq_file_gives_the_same_records(tmp_path):
    plain = tmp_path / "x.fq"
    plain.write_text(FASTQ)
    want = [r[2:] for r in records(Range(str(plain), 0, len(FASTQ)))]
    for sizes in ((64,), (5, 1000, 21)):
        data = blocked(FASTQ.encode(), sizes)
        path, n = tmp_path / "x.fq.gz", len(data)
        path.write_bytes(data)
        got = list(records(Range(str(path), 0, n, 0, n, True)))
        assert [r[2:] for r in got] == want and [r[1] for r in got] == sorted({r[1] for r in got})
        for cut in range(1, n, 37):
            first = (1 + line_count(Range(str(path), 0, cut, 0, n, True))) % 4
            assert [r[2:] for r in [*records(Range(str(path), 0, cut, 0, n, True)), *records(Range(str(path), cut, n, first, n, True))]] == want, cut


def test_blocked_fastq_by_spark(spark, tmp_path):
    (tmp_path / "a.fq.gz").write_bytes(blocked(FASTQ.encode(), (256,)))
    (tmp_path / "b.fq").write_text(FASTQ)
    read = lambda name, size: sorted(tuple(r)[2:] for r in read_fastq(spark, str(tmp_path / name), "quarantine", size).collect())
    assert read("a.fq.gz", 700) == read("b.fq", 1 << 20) == read("b.fq", 300) and len(read("b.fq", 300)) == 92


def test_paths_that_only_spark_can_open(spark, tmp_path, monkeypatch):
    (tmp_path / "b.fq").write_text(FASTQ + "\n@cut\nACGT\n")
    (tmp_path / "c.fq.gz").write_bytes(gzip.compress(FASTQ.encode()))
    data = blocked(bam(300), (700,))
    (tmp_path / "a.bam").write_bytes(data)
    assert not storage.reachable("viewfs://cluster/x") and storage.reachable(f"{tmp_path},file://{tmp_path}")
    read = lambda name: sorted((tuple(r)[2:] for r in read_fastq(spark, str(tmp_path / name), "quarantine").collect()), key=repr)
    want = read("b.fq"), read("c.fq.gz")
    monkeypatch.setattr(fastq, "reachable", lambda p: False)
    monkeypatch.setattr(sam, "reachable", lambda p: False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert (read("b.fq"), read("c.fq.gz")) == want and ("@cut", None, None, None, "truncated") in want[0]
        assert spark.read.text(str(tmp_path / "b.fq")).rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(map(tuple, read_bam(spark, str(tmp_path / "a.bam")).collect()), key=repr) == sorted(bam_records(io.BytesIO(data)), key=repr)
    assert read_bam_dictionary(spark, str(tmp_path / "a.bam")).count() == 2


def test_callers_compare_dictionaries(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">c1\n" + "ACGT" * 10 + "\n>c2\n" + "GATT" * 5 + "\n")
    record = "r\t0\tc1\t1\t60\t4M\t*\t0\t0\tACGT\tIIII\n"

    def call(name, content):
        (tmp_path / name).write_bytes(content) if isinstance(content, bytes) else (tmp_path / name).write_text(content)
        return workflows.call_snvs(spark, str(tmp_path / name), str(tmp_path / "r.fa"))[1].first()["records"]

    one, two = "@SQ\tSN:c1\tLN:40\n", "@SQ\tSN:c2\tLN:20\n"
    assert call("a.sam", one + two + record) == call("b.sam", two + one + record) == call("c.sam", record) == 1
    for name, head in (("d.sam", one), ("e.sam", one + two.replace("20", "21")), ("f.sam", one + two + "@SQ\tSN:c3\tLN:5\n")):
        with pytest.raises(ValueError, match="dictionary"):
            call(name, head + record)
    assert call("a.bam", blocked(bam(0, (("c1", 40), ("c2", 20))), (100,))) == 0
    for name, refs in (("b.bam", (("c2", 20), ("c1", 40))), ("c.bam", (("c1", 40),))):
        with pytest.raises(ValueError, match="dictionary"):
            call(name, blocked(bam(0, refs), (100,)))
