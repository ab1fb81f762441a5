"""Cases with known results, from files where the operator reads files."""

import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from helix import workflows as WF
from helix.operators import alignments as A
from helix.operators import reads as R
from helix.operators import sinks
from helix.operators.align import align
from helix.operators.runs import bounded_log
from helix.options import AlignOptions, SnvOptions, TrimOptions, VcfQcOptions, options_from
from helix.sources.fasta import read_fasta, read_reference
from helix.sources.fastq import read_fastq, with_ordinals
from helix.sources.sam import read_bam, read_sam, read_sam_dictionary
from helix.sources.vcf import read_vcf
from tests.brute import brute_force


def put(tmp_path, name, text, zipped=False):
    p = tmp_path / name
    raw = text if isinstance(text, bytes) else text.encode()
    p.write_bytes(gzip.compress(raw) if zipped else raw)
    return str(p)


def test_fasta_qc(spark, tmp_path):
    p = put(tmp_path, "a.fa", "﻿>alpha\r\nAC\r\nGGT\r\n\r\n>beta text\nNNGC\n>gamma\nTTTTTTTTCC\nCG")
    r = WF.fasta_qc(spark, p).first()
    assert (r["sequences"], r["bases"], r["n50"], r["gc_percent"]) == (3, 21, 12, 47.368421)


@pytest.mark.parametrize("text", [">a\n>b\nAC", ">\nAC", "AC\n", ">a\nA C", ">a\nAU"])
def test_bad_fasta(spark, tmp_path, text):
    p = put(tmp_path, "a.fa", text)
    with pytest.raises(Exception, match="invalid record"):
        read_fasta(spark, p).collect()
    assert read_fasta(spark, p, "quarantine").filter("_error IS NOT NULL").count() >= 1


def test_fasta_is_whole_however_it_is_split(spark, tmp_path):
    p = put(tmp_path, "b.fa", "".join(f">s{i}\n{'ACGT' * (i % 37 + 1)}\n{'GG' * (i % 5)}\n" for i in range(700)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1777")
    try:
        d = read_fasta(spark, p)
        assert d.rdd.getNumPartitions() > 5
        assert (d.count(), d.agg(F.sum("length")).first()[0]) == (700, sum(4 * (i % 37 + 1) + 2 * (i % 5) for i in range(700)))
        names = [r["contig"] for r in read_reference(spark, p).orderBy("contig_idx").collect()]
        assert names == [f"s{i}" for i in range(700)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


FASTQ = "@x1\nGATTA\n+\nIIIII\n@x2 words\nNNCG\n+x2\n????\n@x3\nMKA\n+\n!!!\n"


@pytest.mark.parametrize("zipped", [False, True])
def test_fastq_qc(spark, tmp_path, zipped):
    r = WF.fastq_qc(spark, put(tmp_path, "reads", FASTQ, zipped)).first()
    assert (r["reads"], r["bases"], r["mean_phred"], r["q20_bases"], r["q30_percent"]) == (3, 12, 26.666667, 9, 75.0)


def test_bad_fastq(spark, tmp_path):
    with pytest.raises(Exception, match="length_mismatch"):
        read_fastq(spark, put(tmp_path, "x.fq", "@a\nACGT\n+\nIII\n")).collect()
    cut = gzip.compress(FASTQ.encode() * 50)[:-12]
    (tmp_path / "y.fq.gz").write_bytes(cut)
    with pytest.raises(Exception, match="cut off"):
        read_fastq(spark, str(tmp_path / "y.fq.gz")).collect()


@pytest.mark.parametrize("size", [7, 50, 333, 5000])
def test_fastq_ranges_lose_nothing(spark, tmp_path, size):
    text = "".join(f"@r{i}\n{'ACGTN'[i % 5] * (i % 23 + 1)}\n+\n{'@+I'[i % 3] * (i % 23 + 1)}\n" for i in range(200))
    d = with_ordinals(read_fastq(spark, put(tmp_path, "r.fq", text), range_bytes=size))
    rows = d.orderBy("ordinal").collect()
    assert [r["header"] for r in rows] == [f"@r{i}" for i in range(200)] and [r["ordinal"] for r in rows] == list(range(200))
    assert all(len(r["seq"]) == i % 23 + 1 for i, r in enumerate(rows))


def test_paired_qc(spark, tmp_path):
    a = put(tmp_path, "1.fq", "@left/1\nTTGCA\n+\nFFFFF\n@right 1:Y:0:7\nCAT\n+\n:::\n")
    b = put(tmp_path, "2.fq.gz", "@left/2\nGGA\n+\nFFF\n@right 2:Y:0:7\nCATC\n+\n::::\n", True)
    rows = {r["block"]: r for r in WF.paired_fastq_qc(spark, a, b).collect()}
    assert (rows["read1"]["reads"], rows["read2"]["reads"], rows["combined"]["reads"], rows["combined"]["bases"], rows["combined"]["pairs"]) == (2, 2, 4, 15, 2)
    with pytest.raises(ValueError, match="differ"):
        WF.paired_fastq_qc(spark, a, a)
    with pytest.raises(ValueError, match="missing_mate"):
        WF.paired_fastq_qc(spark, a, put(tmp_path, "3.fq", "@left/2\nGGA\n+\nFFF\n"))


def test_paired_trim(spark, tmp_path):
    one, two = TrimOptions().adapter, TrimOptions().adapter2
    a = put(tmp_path, "1.fq", f"@one/1\nCCATG{one}\n+\n{'I' * (5 + len(one))}\n@two/1\nCATCAT\n+\nIII!!!\n")
    b = put(tmp_path, "2.fq", f"@one/2\nTTGAC{two}\n+\n{'I' * (5 + len(two))}\n@two/2\nGGAAGG\n+\nIIIIII\n")
    t, s = WF.trim_paired(spark, a, b, TrimOptions(min_length=4))
    assert (s.first()["kept_pairs"], s.first()["discarded_pairs"]) == (1, 1)
    k = t.filter("kept").first()
    assert (k["trimmed_seq1"], k["trimmed_qual1"], k["trimmed_seq2"], k["trimmed_qual2"]) == ("CCATG", "IIIII", "TTGAC", "IIIII")
    out = str(tmp_path / "out")
    sinks.write_fastq(t.filter("kept").select(F.lit("x").alias("file"), "ordinal", F.col("header1").alias("header"), F.col("trimmed_seq1").alias("seq"), F.col("trimmed_qual1").alias("qual")), out)
    assert [r[0] for r in spark.read.text(out).collect()] == ["@one/1", "CCATG", "+", "IIIII"]


def test_options():
    with pytest.raises(ValueError, match="quality"):
        TrimOptions(quality=61)
    with pytest.raises(ValueError, match="unknown"):
        options_from(SnvOptions, {"depth": 3})
    assert options_from(SnvOptions, {"min_depth": 5}).min_depth == 5
    with pytest.raises(ValueError, match="max_mismatches"):
        AlignOptions(13)


def test_paired_alignment(spark, tmp_path):
    ref = put(tmp_path, "r.fa", ">ctgA\nTTACGGATCCAGTTGCATAGCCTTAGACAA\n")
    a, b = put(tmp_path, "1.fq", "@duo/1\nCGGATCC\n+\nIIIIIII\n"), put(tmp_path, "2.fq", "@duo/2\nGTCTAAG\n+\nIIIIIII\n")
    sam, classes = WF.align_paired(spark, a, b, ref, AlignOptions(0))
    rows = [tuple(r) for r in sam.orderBy("mate").select("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen").collect()]
    assert rows == [("duo", 97, "ctgA", 4, 60, "7M", "=", 22, 25), ("duo", 145, "ctgA", 22, 60, "7M", "=", 4, -25)]
    assert classes.first()["both_mapped"] == 1
    out = str(tmp_path / "sam")
    sinks.write_sam(sam.withColumn("ordinal", F.col("mate")), read_reference(spark, ref), out)
    assert spark.read.text(out).filter("value LIKE '@%'").count() == 3
    back = read_sam(spark, out)
    assert sorted(r["nm"] for r in back.collect()) == [0, 0]


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_align_against_brute_force(spark, k):
    import random

    rng = random.Random(k)
    ref = spark.createDataFrame([(f"c{i}", i, "".join(rng.choice("ACGTN" if i == 2 else "ACGT") for _ in range(n))) for i, n in enumerate((3, 40, 90, 12))] + [("t", 9, "ACAC" * 12)], "contig string, contig_idx int, seq string")
    reads = spark.createDataFrame([(i, "".join(rng.choice("ACGTN" if i % 9 == 0 else "ACGT") for _ in range(rng.randint(1, 14)))) for i in range(60)], "read_id int, seq string")
    key = ["read_id", "contig", "pos", "strand", "nm", "nh"]
    got, want = align(reads, ref, AlignOptions(k)).select(*key), brute_force(reads, ref, k).select(*key)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


SAM = "@HD\tVN:1.6\n@SQ\tSN:ctg\tLN:200\n" + "".join(
    "\t".join(map(str, r)) + "\n"
    for r in [
        ("duo", 99, "ctg", 11, 50, "8M", "=", 31, 28, "TTGACCAT", "FFFFFFFF", "NM:i:2"), ("duo", 147, "ctg", 31, 40, "8M", "=", 11, -28, "GGATCATC", "FFFFFFFF", "NM:i:0"), ("lost", 77, "*", 0, 0, "*", "*", 0, 0, "CATCATCA", "FFFFFFFF"),
        ("again", 256, "ctg", 14, 11, "8M", "*", 0, 0, "TTGACCAT", "FFFFFFFF", "NM:i:5"), ("part", 2048, "ctg", 60, 22, "8M", "*", 0, 0, "TTGACCAT", "FFFFFFFF", "NM:i:1"),
    ]
)


def test_alignment_qc(spark, tmp_path):
    p = put(tmp_path, "a.sam", SAM)
    qc, cov, totals = WF.alignment_qc(spark, p, read_sam_dictionary(spark, p))
    r, t = qc.first(), totals.first()
    assert (r["total"], r["primary"], r["mapped"], r["unmapped"], r["secondary"], r["supplementary"], r["mapping_rate"], r["mean_mapq"], r["nm_total"]) == (5, 3, 2, 1, 1, 1, 66.666667, 45.0, 2)
    assert (t["covered_bases"], t["breadth_percent"], t["mean_depth"], t["max_depth"], r["tlen_observed"], r["tlen_mean"]) == (16, 8.0, 0.08, 1, 1, 28.0)
    assert A.contig_counts(read_sam(spark, p)).first()["mapped"] == 2


def test_bad_sam(spark, tmp_path):
    with pytest.raises(Exception, match="bad_cigar"):
        read_sam(spark, put(tmp_path, "b.sam", SAM.replace("\t8M\t", "\t4Z\t", 1))).collect()


def bam_bytes(mapped_without_cigar=False):
    refs = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 100)
    out = refs
    for name, pos, nm in (("q1", 0, 2), ("q2", 9, 0)):
        cig = b"" if mapped_without_cigar else struct.pack("<I", 4 << 4)
        body = struct.pack("<iiBBHHHiiii", 0, pos, len(name) + 1, 60, 0, len(cig) // 4, 0, 4, -1, -1, 0) + name.encode() + b"\0" + cig + bytes([0x12, 0x48]) + bytes([30, 31, 32, 33]) + b"XXZab\0" + b"XBBc" + struct.pack("<i", 2) + b"\1\2" + b"NMC" + bytes([nm])
        out += struct.pack("<i", len(body)) + body
    half = len(out) // 2

    def member(x):
        c = zlib.compressobj(wbits=31)
        return c.compress(x) + c.flush()

    return member(out[:half]) + member(out[half:])


def test_bam(spark, tmp_path):
    p = put(tmp_path, "a.bam", bam_bytes())
    rows = read_bam(spark, p).orderBy("pos").collect()
    assert [(r["qname"], r["pos"], r["cigar"], r["seq"], r["qual"], r["nm"]) for r in rows] == [("q1", 1, "4M", "ACGT", "?@AB", 2), ("q2", 10, "4M", "ACGT", "?@AB", 0)]
    with pytest.raises(Exception, match="CIGAR"):
        read_bam(spark, put(tmp_path, "b.bam", bam_bytes(True))).collect()


def test_snv_calls(spark, tmp_path):
    ref = put(tmp_path, "r.fa", ">ctg\nTTGACCATGA\n")
    reads = [("v1", 0, 55, "TGATCAT"), ("v2", 16, 55, "TGATCAT"), ("v3", 0, 55, "TGATCAT"), ("plain", 0, 55, "TGACCAT"), ("copy", 1024, 55, "TGATCAT"), ("weak", 0, 5, "TGATCAT"), ("second", 256, 55, "TGATCAT")]
    sam = put(tmp_path, "a.sam", "@SQ\tSN:ctg\tLN:10\n" + "".join(f"{n}\t{f}\tctg\t2\t{q}\t7M\t*\t0\t0\t{s}\t???????\n" for n, f, q, s in reads))
    calls, summary = WF.call_snvs(spark, sam, ref)
    (c,) = calls.collect()
    assert (c["contig"], c["pos"], c["ref"], c["depth"]) == ("ctg", 5, "C", 4) and [tuple(a) for a in c["alts"]] == [("T", 3, 0.75, 30.0)]
    s = summary.first()
    assert (s["records"], s["records_eligible"], s["records_duplicate"], s["records_low_mapq"], s["records_secondary"]) == (7, 4, 1, 1, 1)
    meta, lines = sinks.calls_to_vcf(calls)
    assert lines.first()["line"] == "ctg\t5\t.\tC\tT\t.\tPASS\tDP=4;AC=3;AF=0.750000;ABQ=30.000000"
    sinks.write_vcf(meta, lines, str(tmp_path / "vcf"))
    parts = sorted((tmp_path / "vcf").glob("part-*"))
    assert "".join(p.read_text() for p in parts).startswith("##fileformat=VCFv4.3\n")


VCF = "##fileformat=VCFv4.3\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n" + "".join(
    "\t".join(r) + "\n"
    for r in [
        ("ctg", "12", ".", "T", "C", ".", "PASS", "DP=9;AC=4;AF=0.444444;ABQ=33.000000"), ("ctg", "31", ".", "A", "G", ".", "PASS", "DP=6;AC=1;AF=0.3;ABQ=35.5"), ("ctg", "47", ".", "G", "C", ".", ".", "DP=8;AC=4;AF=0.5;ABQ=31"),
    ]
)


def test_vcf_qc(spark, tmp_path):
    meta, qc, summary = WF.vcf_qc_filter(spark, put(tmp_path, "a.vcf", VCF), VcfQcOptions(min_ac=None))
    s = summary.first()
    assert (s["records"], s["passed_records"], s["filtered_records"], s["snv_alleles"], s["transitions"], s["ti_tv"]) == (3, 2, 1, 3, 2, 2.0)
    assert {r["pos"]: r["out_filter"] for r in qc.collect()} == {12: "PASS", 31: "PASS", 47: "Unfiltered"}
    lines = sinks.with_filter_lines(meta, {"LowDP": "low depth"}).orderBy("ordinal").collect()
    assert lines[1]["line"].startswith("##FILTER=<ID=LowDP")


def test_bad_vcf(spark, tmp_path):
    with pytest.raises(Exception, match="bad_position"):
        read_vcf(spark, put(tmp_path, "b.vcf", VCF.replace("\t12\t", "\t0\t")))[1].collect()
    with pytest.raises(ValueError, match="version"):
        read_vcf(spark, put(tmp_path, "c.vcf", VCF.replace("4.3", "3.0")))


def test_annotation(spark, tmp_path):
    notes = put(tmp_path, "n.tsv", "key\tgene\tconsequence\tclinical_significance\tsource\tsource_id\nctg:12:T:C\tABC9\tstop_gained\trisk; maybe\tcurated\tX-17\n")
    _, records, alleles, summary = WF.annotate_variants(spark, put(tmp_path, "a.vcf", VCF.rsplit("ctg\t47", 1)[0]), notes)
    s = summary.first()
    assert (s["hits"], s["misses"], s["hit_rate_percent"]) == (1, 1, 50.0)
    info = {r["pos"]: r["info"] for r in records.collect()}
    assert "ANN_CLNSIG=risk%3B%20maybe" in info[12] and info[31].endswith("ANN_GENE=.;ANN_CSQ=.;ANN_CLNSIG=.;ANN_SOURCE=.;ANN_SOURCE_ID=.")


def test_coverage_against_every_base(spark):
    import random

    rng = random.Random(5)
    rows = [(0, f"c{rng.randint(1, 2)}", rng.randint(1, 50), rng.choice(["5M", "3S4M", "2M2D3M", "1M3N2M1I2M", "4="])) for _ in range(80)]
    depth = {}
    import re

    for _, c, p, cig in rows:
        at = p
        for n, op in re.findall(r"(\d+)(.)", cig):
            if op in "M=X":
                for q in range(at, at + int(n)):
                    depth[c, q] = depth.get((c, q), 0) + 1
            at += int(n) * (op in "MDN=X")
    d = spark.createDataFrame(rows, "flag int, rname string, pos long, cigar string")
    cov = {r["contig"]: r for r in A.coverage(d, spark.createDataFrame([("c1", 100), ("c2", 100), ("c3", 9)], "contig string, length long")).collect()}
    for c in ("c1", "c2"):
        mine = [v for (k, _), v in depth.items() if k == c]
        assert (cov[c]["covered_bases"], cov[c]["depth_sum"], cov[c]["max_depth"], cov[c]["bases_10x"]) == (len(mine), sum(mine), max(mine), sum(v >= 10 for v in mine))
    assert cov["c3"]["covered_bases"] == 0


def test_empty_reads(spark):
    e = spark.createDataFrame([], "seq string, qual string")
    r = R.fastq_qc(e).first()
    assert (r["reads"], r["bases"], r["mean_phred"], r["min_phred"]) == (0, 0, 0.0, None)
    assert R.fasta_qc(e).first()["n50"] is None
    assert R.trim_summary(R.trim_reads(e)).first()["input_reads"] == 0


def test_sql_functions(spark):
    from helix.functions.register import register_functions

    register_functions(spark)
    assert spark.sql("SELECT helix_revcomp('TTGACN') AS a, helix_ref_span('5S3M2D1I4M') AS b, helix_read_span('5S3M2D1I4M') AS c").first() == ("NGTCAA", 9, 13)
    assert [tuple(r) for r in spark.sql("SELECT * FROM helix_cigar_blocks(10, '2S3M2D4M')").collect()] == [(10, 13), (15, 19)]
    assert spark.sql("SELECT * FROM helix_cigar_walk('2S3M2D4M')").count() == 4
    assert spark.sql("SELECT helix_n50(map_from_entries(collect_list(struct(l, n)))) FROM (SELECT l, count(*) n FROM VALUES (4L), (6L), (10L) t(l) GROUP BY l)").first()[0] == 10


def test_bounded_log(spark):
    e = spark.createDataFrame([("a", "log", i) for i in range(12)], "job_id string, event_type string, sequence int")
    r = bounded_log(e, 10).collect()
    assert len(r) == 10 and {x["dropped"] for x in r} == {2} and min(x["sequence"] for x in r) == 2


def test_verify_artifacts(spark, tmp_path):
    import hashlib

    from helix.operators.files import list_files, verify_artifacts

    d = tmp_path / "store"
    d.mkdir()
    (d / "a").write_bytes(b"hello")
    (d / "b").write_bytes(b"hello")
    good = hashlib.sha256(b"hello").hexdigest()
    rows = [("a", 5, good), ("b", 5, "00"), ("c", 5, good), ("a", 6, good), ("b", 5, None)]
    got = verify_artifacts(spark.createDataFrame(rows, "path string, size long, sha256 string"), f"file://{d}").collect()
    assert sorted(r["outcome"] for r in got) == ["checksum_mismatch", "checksum_unavailable", "missing", "size_mismatch", "verified"]
    assert list_files(spark, f"file://{d}").count() == 2


def test_summary_sink(spark, tmp_path):
    m = spark.createDataFrame([(1, 2.5)], "a int, b double")
    s = sinks.to_summary(m, contigs=spark.createDataFrame([("c2", 1), ("c1", 2)], "contig string, n int"))
    sinks.write_summary(s, str(tmp_path / "s"))
    r = spark.read.json(str(tmp_path / "s")).first()
    assert r["metrics"]["a"] == 1 and [c["contig"] for c in r["contigs"]] == ["c1", "c2"]
    sinks.write_metrics(m, str(tmp_path / "m"))
    sinks.write_table(m, str(tmp_path / "t"))
