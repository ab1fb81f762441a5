"""Nucleotide sequences. Symbols are compared without case; U is not among those of quality control."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helix.functions.common import col, count_of, first_error

#: The symbols of each class, and each symbol's complement.
CANONICAL, AMBIGUOUS = "ACGT", "RYSWKMBDHV"
SYMBOLS, COMPLEMENTS = "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"
MAX_HEADER = 4096


def base_composition(seq: Column | str) -> Column:
    """struct(canonical, gc, n, ambiguous, valid) of a sequence; valid is false for an empty one and for any other symbol."""
    s = F.upper(col(seq))
    return F.struct(
        count_of(s, CANONICAL).alias("canonical"), count_of(s, "GC").alias("gc"), count_of(s, "N").alias("n"), count_of(s, AMBIGUOUS).alias("ambiguous"),
        s.rlike(f"^[{CANONICAL}N{AMBIGUOUS}]+$").alias("valid"),
    )


def fasta_error(header: Column | str, seq: Column | str) -> Column:
    """Why a record is invalid, or null: bad_header, long_header, empty_sequence, whitespace, bad_base."""
    h, s = col(header), col(seq)
    return first_error(
        (h.isNull() | (F.trim(F.regexp_replace(h, r"\s", " ")) == ""), "bad_header"), (F.octet_length(h) > MAX_HEADER, "long_header"), (s.isNull() | (s == ""), "empty_sequence"),
        (s.rlike(r"\s"), "whitespace"), (~base_composition(s)["valid"], "bad_base"),
    )


def revcomp(seq: Column | str) -> Column:
    """Reverse complement, in upper case."""
    return F.reverse(F.translate(F.upper(col(seq)), SYMBOLS, COMPLEMENTS))


def contig_name(header: Column | str) -> Column:
    """The first token of a FASTA header."""
    return F.regexp_extract(col(header), r"^\s*(\S+)", 1)


def canonical_hamming(a: Column | str, b: Column | str) -> Column:
    """Places in which a and b, of the same length, aren't the same one of A, C, G and T; N against N counts."""
    x, y = F.upper(col(a)), F.upper(col(b))
    differ = F.filter(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: (p == q) & p.isin(*CANONICAL)), lambda same: ~same)
    return F.when(F.length(x) == 0, 0).otherwise(F.size(differ))
