"""Queries of FASTA and FASTQ operators over reads derived from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helix.functions.fastq import adapter_position, fastq_error, mate_identity, phred, quality_profile, quality_trim_length, read_name
from helix.functions.sequence import base_composition, canonical_hamming, contig_name, fasta_error, revcomp
from helix.operators import reads as R
from helix.operators.align import align, align_pairs, alignment_summary, pair_classes, to_sam
from helix.options import AlignOptions, TrimOptions
from helix.plans.adapters import duck, table
from helix.registry import query

D = duck("reads")
ADAPTER = "ACGTTG"
OPTIONS = TrimOptions(adapter=ADAPTER, adapter2="CGTACA", min_overlap=4, max_mismatches=1, quality=12, min_length=30)


def n_of(letters: str, s: str = "seq") -> str:
    return f"(length({s}) - length(translate({s}, '{letters}', '')))"


COMP = f"{n_of('ACGT')} AS canonical, {n_of('GC')} AS gc, {n_of('N')} AS n, {n_of('RYSWKMBDHV')} AS ambiguous"


def reads(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """The reads of a folder's documents; or reads, as they are."""
    return source if isinstance(source, DataFrame) else table(spark, source, "reads")


@query("P1_base_composition", f"{D} SELECT read_id, {COMP}, regexp_matches(seq, '^[ACGTNRYSWKMBDHV]+$') AS valid FROM reads")
def _(spark, d):
    return reads(spark, d).select("read_id", base_composition("seq").alias("c")).select("read_id", "c.*")


@query("P2_phred_decode", f"{D} SELECT read_id, array_to_string(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33), ',') AS phred FROM reads")
def _(spark, d):
    return reads(spark, d).select("read_id", F.array_join(phred("qual").cast("array<string>"), ",").alias("phred"))


@query("P3_quality_profile", f"{D}, q AS (SELECT read_id, list_transform(string_split(qual, ''), lambda c: ascii(c) - 33) AS p FROM reads) SELECT read_id, list_sum(p)::BIGINT AS total, len(list_filter(p, lambda x: x >= 20)) AS q20, len(list_filter(p, lambda x: x >= 30)) AS q30, list_min(p) AS low, list_max(p) AS high FROM q")
def _(spark, d):
    return reads(spark, d).select("read_id", quality_profile("qual").alias("q")).select("read_id", "q.*")


BROKEN = "SELECT read_id, CASE WHEN read_id % 11 = 0 THEN 'r' ELSE concat('@r', read_id) END AS header, CASE WHEN read_id % 13 = 0 THEN '' WHEN read_id % 17 = 0 THEN concat('U', seq) ELSE seq END AS seq, CASE WHEN read_id % 7 = 0 THEN 'x' ELSE '+' END AS sep, CASE WHEN read_id % 17 = 0 THEN concat('I', qual) WHEN read_id % 5 = 0 THEN substr(qual, 2) WHEN read_id % 19 = 0 THEN concat(' ', substr(qual, 2)) ELSE qual END AS qual FROM reads"


@query("P4_fastq_check", f"{D}, b AS ({BROKEN}) SELECT read_id, CASE WHEN NOT regexp_matches(header, '^@\\s*\\S') THEN 'bad_header' WHEN seq = '' THEN 'empty_sequence' WHEN sep NOT LIKE '+%' THEN 'bad_separator' WHEN length(seq) <> length(qual) THEN 'length_mismatch' WHEN NOT regexp_matches(seq, '^[ACGTNRYSWKMBDHV]+$') THEN 'bad_base' WHEN NOT regexp_matches(qual, '^[!-~]+$') THEN 'bad_quality' END AS error FROM b")
def _(spark, d):
    return spark.sql(BROKEN.replace("FROM reads", "FROM {reads}"), reads=reads(spark, d)).select("read_id", fastq_error("header", "seq", "sep", "qual").alias("error"))


FASTA = "SELECT read_id, CASE WHEN read_id % 11 = 0 THEN '  ' ELSE concat('s', read_id, ' text') END AS header, CASE WHEN read_id % 13 = 0 THEN '' WHEN read_id % 17 = 0 THEN concat(seq, 'U') WHEN read_id % 7 = 0 THEN concat('A C', seq) ELSE seq END AS seq FROM reads"


@query("P5_fasta_check", f"{D}, b AS ({FASTA}) SELECT read_id, regexp_extract(header, '^\\s*(\\S+)', 1) AS contig, CASE WHEN trim(header) = '' THEN 'bad_header' WHEN seq = '' THEN 'empty_sequence' WHEN regexp_matches(seq, '\\s') THEN 'whitespace' WHEN NOT regexp_matches(seq, '^[ACGTNRYSWKMBDHV]+$') THEN 'bad_base' END AS error FROM b")
def _(spark, d):
    return spark.sql(FASTA.replace("FROM reads", "FROM {reads}"), reads=reads(spark, d)).select("read_id", contig_name("header").alias("contig"), fasta_error("header", "seq").alias("error"))


HEADERS = "SELECT read_id, CASE read_id % 6 WHEN 0 THEN concat('@p', read_id, '/1') WHEN 1 THEN concat('@p', read_id, '/2 text') WHEN 2 THEN concat('@p', read_id, ' 1:N:0:1') WHEN 3 THEN concat('@p', read_id, '/1  2:Y') WHEN 4 THEN concat('@ p', read_id) ELSE '@/1' END AS header FROM reads"


@query("P6_mate_identity", rf"{D}, h AS ({HEADERS}), t AS (SELECT read_id, regexp_extract(header, '^@([^ \t]*)', 1) AS tok, regexp_extract(header, '^@[^ \t]*[ \t]+([12]):', 1) AS sec FROM h), m AS (SELECT *, length(tok) > 2 AND regexp_matches(tok, '/[12]$') AS marked FROM t), f AS (SELECT *, CASE WHEN marked THEN substr(tok, length(tok), 1)::INT END AS first, CASE WHEN sec <> '' THEN sec::INT END AS second, CASE WHEN marked THEN substr(tok, 1, length(tok) - 2) ELSE tok END AS core_id FROM m) SELECT read_id, core_id, coalesce(second, first) AS mate, CASE WHEN core_id = '' THEN 'empty_id' WHEN first <> second THEN 'conflicting_mates' END AS error FROM f")
def _(spark, d):
    return spark.sql(HEADERS.replace("FROM reads", "FROM {reads}"), reads=reads(spark, d)).select("read_id", mate_identity("header").alias("m")).select("read_id", "m.*")


@query("P7_read_name", rf"{D}, h AS ({HEADERS}) SELECT read_id, regexp_extract(header, '^@[ \t]*([^ \t]+)', 1) AS name FROM h")
def _(spark, d):
    return spark.sql(HEADERS.replace("FROM reads", "FROM {reads}"), reads=reads(spark, d)).select("read_id", read_name("header").alias("name"))


@query("P8_P9_reverse", f"{D} SELECT read_id, reverse(translate(seq, 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN')) AS seq, reverse(qual) AS qual FROM reads")
def _(spark, d):
    return reads(spark, d).select("read_id", revcomp("seq").alias("seq"), F.reverse("qual").alias("qual"))


@query("P10_canonical_hamming", f"{D} SELECT read_id, len(list_filter(range(1, length(seq) + 1), lambda i: NOT (substr(seq, i, 1) = substr(reverse(seq), i, 1) AND contains('ACGT', substr(seq, i, 1))))) AS distance FROM reads")
def _(spark, d):
    return reads(spark, d).select("read_id", canonical_hamming("seq", F.reverse("seq")).cast("long").alias("distance"))


def place(s: str, adapter: str) -> str:
    n = len(adapter)
    return f"coalesce(list_min(list_filter(range(greatest(0, length({s}) - {n}), length({s}) - 3), lambda st: len(list_filter(range(st + 1, length({s}) + 1), lambda i: substr({s}, i, 1) <> substr('{adapter}', i - st, 1))) <= 1)), length({s}))"


LOW = "".join(chr(33 + i) for i in range(12)).replace("'", "''")


def trimmed(s: str, q: str, at: str) -> str:
    return f"length(rtrim(substr({q}, 1, {at}), '{LOW}'))"


@query("P11_adapter_position", f"{D} SELECT read_id, {place('seq', ADAPTER)}::INT AS at FROM reads")
def _(spark, d):
    return reads(spark, d).select("read_id", adapter_position("seq", ADAPTER, 4, 1).alias("at"))


@query("P12_quality_trim", f"{D} SELECT read_id, {trimmed('seq', 'qual', 'length(qual)')}::INT AS left_over FROM reads")
def _(spark, d):
    return reads(spark, d).select("read_id", quality_trim_length("qual", F.length("qual"), 12).alias("left_over"))


T1 = f"t AS (SELECT *, {place('seq', ADAPTER)}::INT AS spot FROM reads), u AS (SELECT *, {trimmed('seq', 'qual', 'spot')}::INT AS len FROM t)"


@query("P13_P14_trim_reads", f"{D}, {T1} SELECT read_id, length(seq) - spot AS adapter_bases, spot - len AS quality_bases, len AS final_length, substr(seq, 1, len) AS trimmed_seq, substr(qual, 1, len) AS trimmed_qual FROM u WHERE len >= 30")
def _(spark, d):
    return R.trim_reads(reads(spark, d), OPTIONS).filter("kept").select("read_id", "adapter_bases", "quality_bases", "final_length", "trimmed_seq", "trimmed_qual")


@query("A5_trim_summary", f"{D}, {T1} SELECT count(*) AS input_reads, count_if(len >= 30) AS kept_reads, count_if(len < 30) AS discarded_reads, count_if(length(seq) > spot) AS adapter_reads, sum(length(seq) - spot)::BIGINT AS adapter_bases, count_if(spot > len) AS quality_reads, sum(spot - len)::BIGINT AS quality_bases, sum(length(seq))::BIGINT AS input_bases, coalesce(sum(CASE WHEN len >= 30 THEN len END), 0)::BIGINT AS output_bases FROM u")
def _(spark, d):
    return R.trim_summary(R.trim_reads(reads(spark, d), OPTIONS))


FQ = """count(*) AS reads, coalesce(sum(length(seq)), 0)::BIGINT AS bases, min(length(seq)) AS min_length, max(length(seq)) AS max_length, sum(canonical)::BIGINT AS canonical_bases, sum(gc)::BIGINT AS gc_bases, sum(n)::BIGINT AS n_bases, sum(ambiguous)::BIGINT AS ambiguous_bases,
 sum(list_sum(p))::BIGINT AS phred_total, sum(len(list_filter(p, lambda x: x >= 20)))::BIGINT AS q20_bases, sum(len(list_filter(p, lambda x: x >= 30)))::BIGINT AS q30_bases, min(list_min(p)) AS min_phred, max(list_max(p)) AS max_phred"""
FQ_RATIOS = "round(bases / reads, 6) AS average_length, round(phred_total / bases, 6) AS mean_phred, round(100.0 * gc_bases / canonical_bases, 6) AS gc_percent, round(100.0 * n_bases / bases, 6) AS n_percent, round(100.0 * q20_bases / bases, 6) AS q20_percent, round(100.0 * q30_bases / bases, 6) AS q30_percent"
PROFILED = f"*, {COMP}, list_transform(string_split(qual, ''), lambda c: ascii(c) - 33) AS p"


@query("A3_fastq_qc", f"{D}, c AS (SELECT {PROFILED} FROM reads), s AS (SELECT lang, {FQ} FROM c GROUP BY lang) SELECT *, {FQ_RATIOS} FROM s")
def _(spark, d):
    return R.fastq_qc(reads(spark, d), ["lang"])


@query("F2_fastq_qc", f"{D}, c AS (SELECT {PROFILED} FROM reads), s AS (SELECT {FQ} FROM c) SELECT *, {FQ_RATIOS} FROM s")
def _(spark, d):
    return R.fastq_qc(reads(spark, d))


N50 = "(SELECT max(l) FROM (SELECT length(seq) AS l, sum(length(seq)) OVER (ORDER BY length(seq) DESC) AS c, sum(length(seq)) OVER () AS t FROM reads) x WHERE c >= ceil(t / 2))"


@query("A1_fasta_qc", f"{D}, c AS (SELECT seq, {COMP} FROM reads), s AS (SELECT count(*) AS sequences, sum(length(seq))::BIGINT AS bases, min(length(seq)) AS min_length, max(length(seq)) AS max_length, sum(canonical)::BIGINT AS canonical_bases, sum(gc)::BIGINT AS gc_bases, sum(n)::BIGINT AS n_bases, sum(ambiguous)::BIGINT AS ambiguous_bases FROM c) SELECT *, {N50} AS n50, round(bases / sequences, 6) AS average_length, round(100.0 * gc_bases / canonical_bases, 6) AS gc_percent, round(100.0 * n_bases / bases, 6) AS n_percent, round(100.0 * ambiguous_bases / bases, 6) AS ambiguous_percent FROM s")
def _(spark, d):
    return R.fasta_qc(reads(spark, d))


@query("A2_W1_n50", f"{D}, w AS (SELECT lang, length(seq) AS l, sum(length(seq)) OVER (PARTITION BY lang ORDER BY length(seq) DESC) AS c, sum(length(seq)) OVER (PARTITION BY lang) AS t FROM reads) SELECT lang, max(l) AS n50 FROM w WHERE c >= ceil(t / 2) GROUP BY lang")
def _(spark, d):
    return R.n50(reads(spark, d).withColumn("length", F.length("seq")), by=["lang"])


MATES = """m1 AS (SELECT read_id AS ordinal, concat('@p', read_id, CASE WHEN read_id % 29 = 0 THEN '/2' ELSE '/1' END) AS header1, seq AS seq1, qual AS qual1 FROM reads WHERE read_id % 31 <> 0),
m2 AS (SELECT read_id AS ordinal, concat('@p', CASE WHEN read_id % 37 = 0 THEN read_id + 1 ELSE read_id END, ' 2:N') AS header2, substr(seq, 31) AS seq2, substr(qual, 31) AS qual2 FROM reads WHERE read_id % 41 <> 0 AND length(seq) > 30)"""
ERRORS = "CASE WHEN seq1 IS NULL OR seq2 IS NULL THEN 'missing_mate' WHEN ordinal % 37 = 0 THEN 'id_mismatch' WHEN ordinal % 29 = 0 THEN 'wrong_mate' END"
PAIRS = f"{MATES}, p AS (SELECT *, {ERRORS} AS pair_error FROM m1 FULL OUTER JOIN m2 USING (ordinal))"


def pairs(spark: SparkSession, d: str | DataFrame) -> DataFrame:
    """Mates: the first is a read from its start, the second from its 31st base on, both up to its end."""
    r = reads(spark, d)
    cut = lambda c, at: F.substr(c, F.lit(at))
    num = lambda n, a, b: F.concat(F.lit("@p"), F.when(F.col("read_id") % n == 0, a).otherwise(b))
    one = r.filter("read_id % 31 <> 0").select(F.col("read_id").alias("ordinal"), F.concat(F.lit("@p"), "read_id", F.when(F.col("read_id") % 29 == 0, "/2").otherwise("/1")).alias("header"), cut("seq", 1).alias("seq"), cut("qual", 1).alias("qual"))
    two = r.filter("read_id % 41 <> 0 AND length(seq) > 30").select(F.col("read_id").alias("ordinal"), F.concat(num(37, (F.col("read_id") + 1).cast("string"), F.col("read_id").cast("string")), F.lit(" 2:N")).alias("header"), cut("seq", 31).alias("seq"), cut("qual", 31).alias("qual"))
    return R.pair_reads(one, two)


@query("J1_J2_pair_reads", f"{D}, {PAIRS} SELECT ordinal, seq1, seq2, pair_error FROM p")
def _(spark, d):
    return pairs(spark, d).select("ordinal", "seq1", "seq2", "pair_error")


BLOCKS = f"{PAIRS}, r AS (SELECT 'read1' AS block, seq1 AS seq, qual1 AS qual FROM p WHERE pair_error IS NULL UNION ALL SELECT 'read2', seq2, qual2 FROM p WHERE pair_error IS NULL), a AS (SELECT * FROM r UNION ALL SELECT 'combined', seq, qual FROM r)"


@query("A4_U1_paired_fastq_qc", f"{D}, {BLOCKS}, c AS (SELECT {PROFILED} FROM a), s AS (SELECT block, {FQ} FROM c GROUP BY block) SELECT *, {FQ_RATIOS}, CASE WHEN block = 'combined' THEN reads // 2 ELSE reads END AS pairs FROM s")
def _(spark, d):
    return R.paired_fastq_qc(pairs(spark, d).filter("pair_error IS NULL"))


T2 = f"t AS (SELECT *, {place('seq1', ADAPTER)}::INT AS at1, {place('seq2', 'CGTACA')}::INT AS at2 FROM p WHERE pair_error IS NULL), u AS (SELECT *, {trimmed('seq1', 'qual1', 'at1')}::INT AS len1, {trimmed('seq2', 'qual2', 'at2')}::INT AS len2 FROM t), v AS (SELECT *, least(len1, len2) >= 30 AS kept FROM u)"


def t2(n: int) -> str:
    return f"count_if(length(seq{n}) > at{n}) AS adapter_reads{n}, sum(length(seq{n}) - at{n})::BIGINT AS adapter_bases{n}, count_if(at{n} > len{n}) AS quality_reads{n}, sum(at{n} - len{n})::BIGINT AS quality_bases{n}, sum(length(seq{n}))::BIGINT AS input_bases{n}, coalesce(sum(CASE WHEN kept THEN len{n} END), 0)::BIGINT AS output_bases{n}"


@query("A6_F5_paired_trim", f"{D}, {PAIRS}, {T2} SELECT count(*) AS input_pairs, count_if(kept) AS kept_pairs, count_if(NOT kept) AS discarded_pairs, {t2(1)}, {t2(2)} FROM v")
def _(spark, d):
    return R.paired_trim_summary(R.trim_pairs(pairs(spark, d).filter("pair_error IS NULL"), OPTIONS))


FIRST = duck("first_reads") + ", reads AS (SELECT * FROM first_reads)"
#: A reference made of every fiftieth first read, and probes cut from all reads that may have a base changed.
REFERENCE = "SELECT concat('c', read_id) AS contig, read_id AS contig_idx, seq FROM reads WHERE read_id % 50 = 1"
PROBES = "SELECT read_id, CASE WHEN read_id % 3 = 0 THEN concat('A', substr(seq, 7, 23)) WHEN read_id % 3 = 1 THEN reverse(translate(substr(seq, 6, 24), 'ACGT', 'TGCA')) ELSE substr(seq, 6, 24) END AS seq, repeat('I', 24) AS qual FROM reads WHERE length(seq) >= 40"
#: By brute force: all places of all probes in all contigs.
BRUTE = f"""ref AS ({REFERENCE}), pr AS ({PROBES}), o AS (SELECT read_id, 0 AS strand, seq AS s FROM pr UNION ALL SELECT read_id, 1, reverse(translate(seq, 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN')) FROM pr),
w AS (SELECT contig, contig_idx, unnest(range(0, length(seq) - 23)) AS pos, seq FROM ref), places AS (SELECT contig, contig_idx, pos, substr(seq, pos + 1, 24) AS r FROM w),
c AS (SELECT read_id, strand, contig, contig_idx, pos, len(list_filter(range(1, 25), lambda i: NOT (substr(s, i, 1) = substr(r, i, 1) AND contains('ACGT', substr(s, i, 1))))) AS nm FROM o, places WHERE hamming(s, r) <= 2),
f AS (SELECT * FROM c WHERE nm <= 2), b AS (SELECT read_id, min(nm) AS best FROM f GROUP BY read_id), ties AS (SELECT f.* FROM f JOIN b ON f.read_id = b.read_id AND f.nm = b.best),
hits AS (SELECT *, count(*) OVER (PARTITION BY read_id) AS nh, row_number() OVER (PARTITION BY read_id ORDER BY contig_idx, pos, strand) AS n FROM ties)"""


def probes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = table(spark, d, "first_reads")
    return spark.sql(PROBES.replace("FROM reads", "FROM {reads}"), reads=r), spark.sql(REFERENCE.replace("FROM reads", "FROM {reads}"), reads=r)


@query("J3_W3_W4_align", f"{FIRST}, {BRUTE} SELECT read_id, contig, pos, strand, nm, nh FROM hits WHERE n = 1")
def _(spark, d):
    p, ref = probes(spark, d)
    return align(p, ref, AlignOptions(2)).select("read_id", "contig", "pos", "strand", F.col("nm").cast("long").alias("nm"), "nh")


@query("F6_P29_A7_align_single", f"{FIRST}, {BRUTE}, s AS (SELECT pr.read_id, contig, strand, nm, nh FROM pr LEFT JOIN (SELECT * FROM hits WHERE n = 1) h USING (read_id)) SELECT count(*) AS reads, count(contig) AS mapped, count_if(contig IS NULL) AS unmapped, count_if(nh = 1) AS unique_reads, count_if(nh > 1) AS multi_reads, count_if(strand = 1) AS reverse_reads, coalesce(sum(CASE WHEN contig IS NOT NULL THEN 24 END), 0)::BIGINT AS aligned_bases, coalesce(sum(nm), 0)::BIGINT AS mismatches, round(100.0 * count(contig) / count(*), 6) AS mapped_percent FROM s")
def _(spark, d):
    p, ref = probes(spark, d)
    return alignment_summary(to_sam(p, align(p, ref, AlignOptions(2))))


@query("A8_J4_pair_classes", f"{FIRST}, {BRUTE}, m AS (SELECT read_id // 2 AS pair, count(*) AS k, count(contig) AS n FROM pr LEFT JOIN (SELECT * FROM hits WHERE n = 1) h USING (read_id) GROUP BY 1) SELECT count(*) AS pairs, count_if(n = 2) AS both_mapped, count_if(n = 1) AS one_mapped, count_if(n = 0) AS none_mapped FROM m WHERE k = 2")
def _(spark, d):
    p, ref = probes(spark, d)
    r = p.withColumn("pair_id", F.floor(F.col("read_id") / 2)).withColumn("mate", (F.col("read_id") % 2 + 1).cast("int"))
    return pair_classes(align_pairs(r, align(p, ref, AlignOptions(2))))


P27 = """h1 AS (SELECT * FROM hits WHERE n = 1), r AS (SELECT pr.read_id, read_id // 2 AS pair_id, read_id % 2 + 1 AS mate, contig, pos, strand FROM pr LEFT JOIN h1 USING (read_id)), j AS (SELECT a.*, b.contig AS mc, b.pos AS mp, b.strand AS ms FROM r a JOIN r b ON a.pair_id = b.pair_id AND a.mate <> b.mate)"""


@query("F7_P27_P28_align_pairs", f"""{FIRST}, {BRUTE}, {P27} SELECT pair_id, mate::INT AS mate, 1 + CASE WHEN contig IS NULL THEN 4 WHEN strand = 1 THEN 16 ELSE 0 END + CASE WHEN mc IS NULL THEN 8 WHEN ms = 1 THEN 32 ELSE 0 END + CASE mate WHEN 1 THEN 64 ELSE 128 END AS flag, coalesce(contig, '*') AS rname, coalesce(pos + 1, 0) AS pos,
 CASE WHEN contig = mc THEN '=' WHEN mc IS NOT NULL THEN mc ELSE '*' END AS rnext, coalesce(mp + 1, 0) AS pnext, CASE WHEN contig = mc THEN (greatest(pos, mp) + 24 - least(pos, mp)) * CASE WHEN pos < mp OR (pos = mp AND mate = 1) THEN 1 ELSE -1 END ELSE 0 END AS tlen FROM j""")
def _(spark, d):
    p, ref = probes(spark, d)
    r = p.withColumn("pair_id", F.floor(F.col("read_id") / 2)).withColumn("mate", (F.col("read_id") % 2 + 1).cast("int"))
    return align_pairs(r, align(p, ref, AlignOptions(2))).select("pair_id", "mate", "flag", "rname", "pos", "rnext", "pnext", "tlen")


