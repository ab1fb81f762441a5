"""Every letter of the documents reaches the read operators."""

import random
import re

from helix import registry
from helix.operators.align import align, candidates
from helix.options import AlignOptions
from helix.plans.whole_read_queries import ALIGN
from tests.brute import brute_force
from tests.test_oracles import SF


def test_queries_see_whole_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()
    lengths = [n for n in (len(re.sub("[^A-Za-z]", "", r["text"] or "")) for r in rows) if n]
    for name in ("F2_fastq_qc_whole", "A1_fasta_qc_whole"):
        got = registry.QUERIES[name](spark, SF).first()
        assert (got["bases"], got["max_length"]) == (sum(lengths), max(lengths)), name
    assert sum(r["canonical"] + r["n"] + r["ambiguous"] for r in registry.QUERIES["P1_base_composition_whole"](spark, SF).collect()) == sum(lengths)


def test_long_reads_against_brute_force(spark):
    """Reads over several chunks and pieces, with ties, changed bases, other letters and both orientations."""
    rng = random.Random(5)
    a = "".join(rng.choice("ACGT") for _ in range(4400))
    ref = [("a", 0, a), ("b", 1, a[:3000] + "N" + a[3001:4200]), ("c", 2, a[100:2500])]

    def changed(s, n):
        s = list(s)
        for i in rng.sample(range(len(s)), n):
            s[i] = {"A": "C", "C": "G", "G": "T", "T": "A"}[s[i]]
        return "".join(s)

    cuts = [(0, 4400, 1), (200, 2400, 2), (1000, 4195, 0), (2950, 4200, 2), (3900, 4390, 1), (300, 2000, 3), (90, 150, 2), (4040, 4160, 0)]
    reads = [(i, changed(a[x:y], n)) for i, (x, y, n) in enumerate(cuts)]
    reads += [(100 + i, s[::-1].translate(str.maketrans("ACGT", "TGCA"))) for i, s in reads]
    r, f = spark.createDataFrame(reads, "read_id int, seq string"), spark.createDataFrame(ref, "contig string, contig_idx int, seq string")
    key = ["read_id", "contig", "pos", "strand", "nm", "nh"]
    got, want = align(r, f, AlignOptions(2)).select(*key).collect(), brute_force(r, f, 2).select(*key).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 14


def test_whole_table_is_aligned_with_itself(spark):
    rows = registry.QUERIES["A1_fasta_qc_whole"](spark, SF).first()
    got = ALIGN["F6_P29_A7_align_single_whole"](spark, SF).first()
    assert got["reads"] == rows["sequences"] and 0.6 * got["reads"] < got["mapped"]
    assert max(r["tlen"] for r in ALIGN["F7_P27_P28_align_pairs_whole"](spark, SF).collect()) >= 0


def test_repeats_against_brute_force(spark):
    """A stretch of one letter, reads that cross its ends, equal reads, palindromes and reads of a few bases."""
    rng = random.Random(8)
    left, right = ("".join(rng.choice("ACGT") for _ in range(300)) for _ in range(2))
    ref = [("a", 0, left + "A" * 700 + right), ("b", 1, "AT" * 40 + "ACGT" * 20)]
    texts = [left[200:] + "A" * 80, "A" * 60 + right[:90], "A" * 150, "A" * 150, "T" * 150, left[210:] + "C" + "A" * 60, "ACGT" * 9, "AC", "A", "AT" * 12, right[10:90], "A" * 100 + "CC" + "A" * 20, "N" * 30 + right[:70]]
    r, f = spark.createDataFrame(list(enumerate(texts)), "read_id int, seq string"), spark.createDataFrame(ref, "contig string, contig_idx int, seq string")
    key = ["read_id", "contig", "pos", "strand", "nm", "nh"]
    for k in (0, 1, 3):
        assert sorted(map(tuple, align(r, f, AlignOptions(k)).select(*key).collect())) == sorted(map(tuple, brute_force(r, f, k).select(*key).collect())), k


def test_a_long_stretch_of_one_letter_does_not_square(spark):
    """Reads that touch it are candidates at few places."""
    rng = random.Random(4)
    flank = "".join(rng.choice("ACGT") for _ in range(2000))
    reference = spark.createDataFrame([("a", 0, flank + "A" * 100_000 + flank[::-1])], "contig string, contig_idx int, seq string")
    reads = spark.createDataFrame([(i, flank[2000 - 100 + i :] + "A" * (50 + i)) for i in range(50)], "oid int, oseq string")
    assert candidates(reads, reference, 2).count() < 50 * 200
