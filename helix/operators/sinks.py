"""Results as files: FASTQ, SAM, VCF, tables of metrics and rows, nested summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helix.operators.variants import INFO_IDS
from helix.options import SnvOptions


def to_metrics(df: DataFrame, prefix: str = "") -> DataFrame:
    """A one-row frame as rows of metric and value, both text; a null is "."."""
    return df.select([F.coalesce(F.col(c).cast("string"), F.lit(".")).alias(f"{prefix}{c}") for c in df.columns]).unpivot([], [f"{prefix}{c}" for c in df.columns], "metric", "value")


def write_metrics(df: DataFrame, path: str) -> None:
    to_metrics(df).write.csv(path, sep="\t", header=True)


def write_table(df: DataFrame, path: str) -> None:
    """A row table with a header, "." for what is missing."""
    df.select([F.coalesce(F.col(c).cast("string"), F.lit(".")).alias(c) for c in df.columns]).write.csv(path, sep="\t", header=True, quote="", escape="", emptyValue="")


def write_summary(df: DataFrame, path: str) -> None:
    df.write.json(path)


def to_summary(metrics: DataFrame, **parts: DataFrame) -> DataFrame:
    """One nested record: metrics, and each part as an array of its rows. For parts whose size the analysis bounds, as contigs are."""
    out = metrics.select(F.struct(*metrics.columns).alias("metrics"))
    for name, df in parts.items():
        out = out.crossJoin(df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name)))  # one row each
    return out


def write_fastq(df: DataFrame, path: str, partitions: int | None = None, compression: str = "none") -> None:
    """Reads (file, ordinal, header, seq, qual) as FASTQ parts in their order; as many parts as the session shuffles to, unless told."""
    text = F.concat_ws("\n", "header", "seq", F.lit("+"), "qual")
    ordered(df, ["file", "ordinal"], partitions).select(text).write.text(path, compression=compression)


def ordered(df: DataFrame, by: list[str], partitions: int | None) -> DataFrame:
    """Sorted parts that follow each other; Spark chooses their number by size unless told."""
    dealt = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    return dealt.sortWithinPartitions(*by)


SAM_COLUMNS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")


def write_sam(df: DataFrame, reference: DataFrame, path: str, partitions: int | None = None) -> None:
    """SAM columns with nm and nh, in order of ordinal, as the parts of one file: put together in order of their names they are a SAM file, whose first part begins with
    the header (contigs in the reference's order). read_sam and read_sam_dictionary take the folder as that file."""
    tags = F.when(F.col("rname") == "*", F.lit("NH:i:0")).otherwise(F.concat(F.lit("NM:i:"), "nm", F.lit("\tNH:i:"), "nh"))
    records = df.select("ordinal", F.concat_ws("\t", *SAM_COLUMNS, tags).alias("line"))
    sq = reference.select(F.col("contig_idx").cast("double").alias("ordinal"), F.concat(F.lit("@SQ\tSN:"), "contig", F.lit("\tLN:"), F.length("seq")).alias("line"))
    ends = reference.sparkSession.createDataFrame([(-1.0, "@HD\tVN:1.6\tSO:unknown"), (float("inf"), "@PG\tID:helix\tPN:helix")], "ordinal double, line string")
    with_header(sq.unionByName(ends), records, partitions).write.text(path)


def with_header(header: DataFrame, records: DataFrame, partitions: int | None) -> DataFrame:
    """header (ordinal: a number, line) and records (ordinal, line) -> line, sorted: the header first."""
    none = F.lit(None).cast(records.schema["ordinal"].dataType).alias("ordinal")
    first = header.select(F.col("ordinal").cast("double").alias("h"), none, "line")  # null stands first
    return ordered(first.unionByName(records.select(F.lit(None).cast("double").alias("h"), "ordinal", "line")), ["ordinal", "h"], partitions).select("line")


def write_vcf(meta: DataFrame, records: DataFrame, path: str, partitions: int | None = None) -> None:
    """meta (ordinal, line) and records (ordinal, line) as the parts of one file: put together in order of their names they are a VCF file, whose first part begins
    with the header. read_vcf takes the folder as that file."""
    with_header(meta, records, partitions).write.text(path)


#: The options that a header of called variants names.
OPTION_LINES = (("MinDepth", "min_depth"), ("MinAltCount", "min_alt_count"), ("MinAltFraction", "min_alt_fraction"), ("MinMAPQ", "min_mapq"), ("MinBaseQuality", "min_base_quality"))
#: The header of called variants, without options and contigs.
CALL_INFO = (
    '##INFO=<ID=DP,Number=1,Type=Integer,Description="Callable depth">', '##INFO=<ID=AC,Number=A,Type=Integer,Description="Alternate observations">',
    '##INFO=<ID=AF,Number=A,Type=Float,Description="Alternate fraction">', '##INFO=<ID=ABQ,Number=A,Type=Float,Description="Mean alternate base quality">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO",
)


def calls_to_vcf(calls: DataFrame, reference: DataFrame | None = None, options: SnvOptions | None = None) -> tuple[DataFrame, DataFrame]:
    """Header and record lines (ordinal, line) of called variants; the ordinal of a record is its contig and position. The header names the options, and the contigs
    of reference (contig, contig_idx, seq) in their order, if given."""
    spark = calls.sparkSession
    given = [] if options is None else [f"##{n}={getattr(options, f):.6f}" if isinstance(getattr(options, f), float) else f"##{n}={getattr(options, f)}" for n, f in OPTION_LINES]
    start = ["##fileformat=VCFv4.3", *given]
    meta = spark.createDataFrame([(float(i), x) for i, x in enumerate(start)] + [(1e18 + i * 1e3, x) for i, x in enumerate(CALL_INFO)], "ordinal double, line string")
    if reference is not None:
        lines = reference.select((F.col("contig_idx") + len(start)).cast("double").alias("ordinal"), F.concat(F.lit("##contig=<ID="), "contig", F.lit(",length="), F.length("seq"), F.lit(">")).alias("line"))
        meta = meta.unionByName(lines)
    per = lambda fn: F.array_join(F.transform("alts", fn), ",")
    six = lambda x: F.format_string("%.6f", x)
    info = F.concat(F.lit("DP="), "depth", F.lit(";AC="), per(lambda a: a["n"].cast("string")), F.lit(";AF="), per(lambda a: six(a["fraction"])), F.lit(";ABQ="), per(lambda a: six(a["abq"])))
    line = F.concat_ws("\t", "contig", "pos", F.lit("."), "ref", per(lambda a: a["base"]), F.lit("."), F.lit("PASS"), info)
    return meta, calls.select(F.struct("contig", "pos").alias("ordinal"), line.alias("line"))


def with_filter_lines(meta: DataFrame, reasons: dict[str, str]) -> DataFrame:
    """A VCF's header lines with a ##FILTER line, right after the first, for each reason that has none."""
    have = [r["id"] for r in meta.select(F.regexp_extract("line", "^##FILTER=<ID=([^,]+),", 1).alias("id")).filter("id <> ''").collect()]  # header lines
    new = [(0.5 + i / 1000, f'##FILTER=<ID={k},Description="{v}">') for i, (k, v) in enumerate(reasons.items()) if k not in have]
    m = meta.select(F.col("ordinal").cast("double").alias("ordinal"), "line")
    return m.unionByName(meta.sparkSession.createDataFrame(new, "ordinal double, line string")) if new else m


def with_lines(meta: DataFrame, lines: list[str], before_names: bool = False) -> DataFrame:
    """A VCF's header lines with more, right after the first, or before the line of column names."""
    m = meta.select(F.col("ordinal").cast("double").alias("ordinal"), "line")
    new = meta.sparkSession.createDataFrame([(float(i), x) for i, x in enumerate(lines)], "i double, line string")
    at = m.agg((F.max("ordinal") - 0.9).alias("at")) if before_names else m.agg((F.min("ordinal") + 0.9).alias("at"))
    return m.unionByName(new.crossJoin(at).select((F.col("at") + F.col("i") / 100).alias("ordinal"), "line"))  # one row


def with_qc_lines(meta: DataFrame, options) -> DataFrame:
    """The header lines of a filtered VCF: what it was filtered by."""
    given = ",".join(f"{f}={'off' if (v := getattr(options, f)) is None else v}" for f in options.__dataclass_fields__)
    return with_lines(meta, [f"##VariantFilter=<Key=CHROM:POS:REF:ALT,Normalization=none,{given}>"])


def with_annotation_lines(meta: DataFrame) -> DataFrame:
    """The header lines of an annotated VCF: an INFO line for each annotation."""
    what = ("gene", "consequence", "clinical significance", "source", "source identifier")
    return with_lines(meta, [f'##INFO=<ID={k},Number=A,Type=String,Description="Local annotation: {d}">' for k, d in zip(INFO_IDS, what, strict=True)], before_names=True)
