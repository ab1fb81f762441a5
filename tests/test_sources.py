"""What readers reject, wherever a file is cut, and forms of one operator that must agree."""

import pytest
from pyspark.sql import functions as F

from helix.operators import alignments as A
from helix.operators import sinks
from helix.options import SnvOptions
from helix.sources.fasta import read_reference
from helix.sources.fastq import Range, first_lines, line_count, read_fastq, records
from helix.sources.sam import read_sam, read_sam_dictionary
from helix.sources.vcf import read_vcf


def put(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def read(d, **options):
    return [(r["header"], r["_error"]) for r in d.collect()]


def test_every_cut_of_a_fastq_file_gives_the_same_records(tmp_path):
    text = "@a\nACGT\n+\nIIII\n@bad\nACGT\nno separator\nIII\n@c\nAC\n+\n@@\n+d\nA\n+\nI\n@e\nACG\n+\n+++\n"
    path, n = put(tmp_path, "x.fq", text), len(text)
    want = list(records(Range(path, 0, n)))
    assert [r[2] for r in want] == ["@a", "@bad", "@c", "+d", "@e"]
    for cut in range(1, n):
        first = (1 + line_count(Range(path, 0, cut))) % 4
        assert list(records(Range(path, 0, cut))) + list(records(Range(path, cut, n, first))) == want, cut


def test_fastq_records_and_reasons_do_not_depend_on_ranges(spark, tmp_path):
    good = "".join(f"@r{i}\n{'ACGTN' * (i % 7 + 1)}\n+\n{'@+I:5' * (i % 7 + 1)}\n" for i in range(60))
    bad = "@b1\nACXU1\n+\nIIIII\n@b2\nACGT\n+\nII\x07I\n@b3\nACGT\nx\nIIII\n@\nA\n+\nI\n@b5\n\n+\n\n@b6\nAC\n+\nI\n"
    path = put(tmp_path, "m.fq", good + bad + good)
    want = {("@b1", "bad_base"), ("@b2", "bad_quality"), ("@b3", "bad_separator"), ("@", "bad_header"), ("@b5", "empty_sequence"), ("@b6", "length_mismatch")}
    for size in (150, 4096):
        rows = read(read_fastq(spark, path, "quarantine", size))
        assert len(rows) == 126 and {r for r in rows if r[1]} == want
    counts = spark.createDataFrame([("f", 0, 3), ("f", 10, 2), ("f", 20, 9), ("g", 0, 1)], "file string, start long, lines long")
    assert first_lines(counts) == {"f": "002"}


def test_sam_headers(spark, tmp_path):
    record = "r\t0\tc\t1\t60\t2M\t*\t0\t0\tAC\tII\n"
    assert read_sam(spark, put(tmp_path, "a.sam", "@SQ\tSN:c\tLN:9\n" + record)).count() == 1
    late = put(tmp_path, "b.sam", record + "@SQ\tSN:c\tLN:9\n" + record)
    with pytest.raises(Exception, match="late_header"):
        read_sam(spark, late).collect()
    assert [r["_error"] for r in read_sam(spark, late, "quarantine").collect()] == [None, None, "late_header"]
    with pytest.raises(Exception, match="repeated_contig"):
        read_sam_dictionary(spark, put(tmp_path, "c.sam", "@SQ\tSN:c\tLN:9\n@SQ\tSN:c\tLN:8\n")).collect()


def test_reference_names_differ(spark, tmp_path):
    with pytest.raises(Exception, match="repeated_contig"):
        read_reference(spark, put(tmp_path, "r.fa", ">a x\nACGT\n>b\nAC\n>a y\nAC\n")).collect()


VERSION, NAMES, ROW = "##fileformat=VCFv4.3\n", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n", "c\t1\t.\tA\tG\t.\tPASS\tDP=3\n"


@pytest.mark.parametrize(("text", "why"), [(VERSION + VERSION + NAMES + ROW, "one version"), (VERSION + NAMES + ROW + "#late\n", "one version"), (VERSION + ROW + NAMES, "before_header"), (VERSION + NAMES + ROW.replace("c\t", "c d\t", 1), "bad_contig"), (VERSION + NAMES + NAMES + ROW, "column names")])
def test_vcf_structure(spark, tmp_path, text, why):
    with pytest.raises(Exception, match=why):
        read_vcf(spark, put(tmp_path, "x.vcf", text))[1].collect()


def test_caller_errors(spark):
    ref = spark.createDataFrame([("c", "ACGTACGT")], "contig string, seq string")
    rows = [("ok", 0, "c", 1, 60, "4M", "ACGT", "IIII"), ("far", 0, "c", 7, 60, "4M", "ACGT", "IIII"), ("low", 0, "c", 7, 3, "4M", "ACGT", "IIII"), ("none", 0, "d", 1, 60, "4M", "ACGT", "IIII"), ("star", 0, "c", 1, 60, "4M", "*", "*"), ("len", 0, "c", 1, 60, "4M", "ACGT", "III"), ("base", 0, "c", 1, 60, "4M", "AC-T", "IIII"), ("span", 0, "c", 1, 60, "3M", "ACGT", "IIII"), ("un", 4, "*", 0, 0, "*", "*", "*")]
    d = spark.createDataFrame(rows, "qname string, flag int, rname string, pos long, mapq int, cigar string, seq string, qual string")
    got = {r["qname"]: r["error"] for r in A.caller_errors(d, ref).collect()}
    assert got == {"far": "beyond_contig", "none": "unknown_contig", "star": "no_bases", "len": "length_mismatch", "base": "bad_base", "span": "read_length"}


def test_counted_observations_are_those_that_are_counted(spark):
    ref = spark.createDataFrame([("c", "ACGTNacgt" * 1000), ("d", "ACGT")], "contig string, seq string")
    rows = [(0, "c", i * 37 % 8990 + 1, 60, "3S4M1D3M" if i % 3 else "10M", "acN=TGRACG"[i % 4 :] + "ACGT"[: i % 4], "I!5?H0:I+D") for i in range(300)] + [(0, "d", 3, 60, "10M", "ACGTACGTAC", "IIIII")]
    d = spark.createDataFrame(rows, "flag int, rname string, pos long, mapq int, cigar string, seq string, qual string")
    keys = ["contig", "pos", "ref", "base", "class"]
    want = A.observations(d, ref, SnvOptions()).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("quality").alias("qsum"))
    got = A.counted_observations(d, ref, SnvOptions()).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("qsum").alias("qsum"))
    assert want.count() > 500 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_reference_pieces(spark):
    seq = "ACGTNRYacgt" * 2000
    for more in (0, 10, 1024):
        got = A.reference_pieces(spark.createDataFrame([("c", seq), ("d", "AC"), ("e", "")], "contig string, seq string"), more).collect()
        assert {(r["contig"], r["piece"]): r["text"] for r in got} == {("d", 0): "AC"} | {("c", i): seq.upper()[i * A.PIECE : (i + 1) * A.PIECE + more] for i in range(-(-len(seq) // A.PIECE))}


def test_depth_over_several_parts(spark, monkeypatch):
    rows = [("c", i * 7 % 900 + 1, "40M", 0) for i in range(60)] + [("d", 5, "100M", 0)]
    d = spark.createDataFrame(rows, "rname string, pos long, cigar string, flag int")
    want = sorted(map(tuple, A.depth_segments(d).select("contig", "pos", "next", "depth").collect()))
    monkeypatch.setattr(A, "SWEEP", 64)
    assert sorted(map(tuple, A.depth_segments(d).select("contig", "pos", "next", "depth").collect())) == want


def test_header_lines(spark):
    meta = spark.createDataFrame([(0, "##fileformat=VCFv4.3"), (1, "##x"), (2, "#CHROM\tPOS")], "ordinal long, line string")
    lines = [r["line"] for r in sinks.with_annotation_lines(meta).orderBy("ordinal").collect()]
    assert len(lines) == 8 and lines[0].startswith("##fileformat") and lines[-1].startswith("#CHROM") and lines[2].startswith("##INFO=<ID=ANN_GENE,")
    calls = spark.createDataFrame([], "contig string, pos long, ref string, depth long, alts array<struct<base: string, n: long, fraction: double, abq: double>>")
    ref = spark.createDataFrame([("b", 0, "ACGT"), ("a", 1, "AC")], "contig string, contig_idx long, seq string")
    lines = [r["line"] for r in sinks.calls_to_vcf(calls, ref, SnvOptions())[0].orderBy("ordinal").collect()]
    assert lines[0] == "##fileformat=VCFv4.3" and "##MinAltFraction=0.200000" in lines and lines[6:8] == ["##contig=<ID=b,length=4>", "##contig=<ID=a,length=2>"] and lines[-1].startswith("#CHROM")
