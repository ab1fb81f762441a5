"""Pileup over many contigs and odd records, and the shape of its plan."""

from helix.operators import alignments as A

RECORDS = "qname string, flag int, rname string, pos long, mapq int, cigar string, seq string, qual string"


def test_contigs_beyond_any_packed_width(spark):
    n = 5000
    records = spark.range(n).selectExpr("concat('r', id) qname", "0 flag", "concat('c', id) rname", "1L pos", "60 mapq", "'4M' cigar", "'ACGT' seq", "'IIII' qual").coalesce(1)
    reference = spark.range(n).selectExpr("concat('c', id) contig", "'ACGT' seq")
    piled = A.pileup(A.counted_observations(records, reference))
    assert piled.select("contig").distinct().count() == n
    assert piled.filter("n <> 1 OR qsum <> 40").isEmpty() and piled.count() == 4 * n


def test_counts_are_the_observations_added_up(spark):
    rows = [("a", 0, "c", 1, 60, "2M1D2M", "AC=T", "I!I"), ("b", 0, "c", 4094, 60, "6M", "acgtnN", "IIIIII"), ("c", 0, "c", 4096, 60, "3M", "AéG", "III"), ("d", 0, "none", 1, 60, "2M", "AC", "II"), ("e", 4, "c", 1, 60, "2M", "AC", "II"), ("f", 0, "c", 1, 60, "2S2M", "TTAC", "IIII")]
    reference = spark.createDataFrame([("c", "ACGTN" * 820), ("empty", ""), ("null", None)], "contig string, seq string")
    records = spark.createDataFrame(rows, RECORDS)
    key = ["contig", "pos", "ref", "base", "class"]
    counted = A.counted_observations(records, reference).groupBy(key).sum("n")
    each = A.observations(records, reference).groupBy(key).count()
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, each.collect()))
    assert counted.filter("pos = 4097").count() == 2


def test_a_computed_reference_stays_on_its_side(spark):
    records = spark.createDataFrame([("a", 0, "c1", 1, 60, "4M", "ACGT", "IIII")], RECORDS)
    reference = spark.range(3).selectExpr("concat('c', id) contig").selectExpr("contig", "array_join(transform(sequence(1, 4), x -> substr(concat(contig, 'GGGG'), cast(x AS int), 1)), '') seq")
    plan = A.counted_observations(records, reference)._jdf.queryExecution().optimizedPlan().toString()
    upto_records = plan[: plan.index("LogicalRDD")]
    assert "array_join(" not in upto_records and "array_join(" in plan


def test_observations_of_a_place_are_added_up_in_one_task(spark):
    """Records in any order: what is left to be shuffled grows with places, not with records (F24, F28)."""
    records = spark.range(80_000).selectExpr("'r' qname", "0 flag", "'c' rname", "id * 7919 % 40000 + 1 pos", "60 mapq", "'10M' cigar", "'AAAAAAAAAA' seq", "'IIIIIIIIII' qual").coalesce(2)
    reference = spark.range(1).selectExpr("'c' contig", "repeat('A', 40009) seq")  # small, so it would be broadcast
    counted = A.counted_observations(records, reference)
    assert counted.agg({"n": "sum"}).first()[0] == 800_000
    assert counted.count() <= 2.2 * 40_009  # a piece may be in two batches


def test_odd_records_as_a_walk_by_hand(spark):
    rows = [
        ("c", 4090, "3H2S4M2N3=1P2X1I4M", "ttACGTGGGACnAAAAC", "IIIIIII!!IIIIIIII"), ("c", 1, "5M", "AC", "I"), ("c", 2, "3M", "*", "*"), ("c", 5, "4M", None, "IIII"), ("c", 5, "4M", "ACGT", None), ("c", None, "4M", "ACGT", "IIII"),
        (None, 1, "4M", "ACGT", "IIII"), ("c", -1, "4M", "ACGT", "IIII"), ("c", 8190, "9M", "ACGTACGTA", "IIIIIIIII"), ("c", 1, "99999999999M", "AC", "II"), ("c", 1, "4S", "ACGT", "IIII"),
    ]
    genome = "ACGTN" * 1639
    want = {}
    for rname, pos, cigar, seq, qual in rows:
        if rname is None or pos is None or seq is None:
            continue
        ref = read = 0
        for n, op in [(int(n), op) for n, op in A.CIGAR_OP.findall(cigar)]:
            for i in range(min(n, len(seq) - read) if op in "M=X" else 0):
                at = pos + ref + i - 1
                if 0 <= at < len(genome):
                    base, q = seq[read + i].upper(), ord(qual[read + i]) - 33 if qual and read + i < len(qual) else -33
                    kind = 0 if genome[at] not in "ACGT" else 1 if base not in "ACGT" else 2 if q < 20 else 3
                    key = (at + 1, genome[at], base, A.OBSERVATIONS[kind])
                    want[key] = want.get(key, 0) + 1
            ref, read = ref + n * (op in "MDN=X"), read + n * (op in "MIS=X")
    records = spark.createDataFrame([("q", 0, r[0], r[1], 60, *r[2:]) for r in rows], RECORDS)
    got = A.counted_observations(records, spark.createDataFrame([("c", genome)], "contig string, seq string"))
    got = {tuple(r)[:4]: r[4] for r in got.filter("ref <> ''").groupBy("pos", "ref", "base", "class").sum("n").collect()}
    assert got == want


def test_depth_is_of_all_bases_at_a_place(spark):
    rows = [(n, 0, "c", p, 60, "3M", s, "IIII") for n, p, s in (("a", 1, "ACG"), ("b", 1, "ACT"), ("d", 2, "GNN"))]
    counted = A.counted_observations(spark.createDataFrame(rows, RECORDS), spark.createDataFrame([("c", "ACGT")], "contig string, seq string"))
    got = sorted((r.pos, r.base, r.n, r.qsum, r.depth) for r in A.pileup_with_depth(counted).collect())
    assert got == [(1, "A", 2, 80, 2), (2, "C", 2, 80, 3), (2, "G", 1, 40, 3), (3, "G", 1, 40, 2), (3, "T", 1, 40, 2)]
