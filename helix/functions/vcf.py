"""Variant records: INFO, FILTER, types and keys of alleles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helix.functions.common import col, first_error

_KEY = r"^[^\x00-\x20\x7F;=]+$"


def _fields(info: Column | str) -> Column:
    return F.when(col(info) == ".", F.array().cast("array<string>")).otherwise(F.split(col(info), ";"))


def info_error(info: Column | str) -> Column:
    """empty_field, bad_key or duplicate_key, else null."""
    keys = F.transform(_fields(info), lambda f: F.split(f, "=", 2)[0])
    return first_error((F.exists(_fields(info), lambda f: f == ""), "empty_field"), (F.exists(keys, lambda k: ~k.rlike(_KEY)), "bad_key"), (F.size(F.array_distinct(keys)) < F.size(keys), "duplicate_key"))


def parse_info(info: Column | str) -> Column:
    """map of keys to values: empty for ".", an empty value for a flag, all after the first = otherwise; null if invalid."""
    entries = F.transform(_fields(info), lambda f: F.struct(F.split(f, "=", 2)[0].alias("k"), F.when(F.contains(f, F.lit("=")), F.split(f, "=", 2)[1]).otherwise("").alias("v")))
    return F.when(info_error(info).isNull(), F.map_from_entries(entries))


def info_value(info: Column | str, key: str) -> Column:
    """The value of one key of a valid INFO, without parsing the rest; null if there is none."""
    return F.when(col(info).rlike(f"(?:^|;){key}(?:[=;]|$)"), F.regexp_extract(col(info), f"(?:^|;){key}=([^;]*)", 1))


def info_scalar(info: Column | str, key: str) -> Column:
    """A whole number; null if there is none or it is no such number."""
    v = info_value(info, key)
    return F.when(v.rlike("^[0-9]+$"), v).try_cast("long")


def info_per_allele(info: Column | str, key: str, n_alleles: Column, kind: str = "double", least: float | None = None, most: float | None = None) -> Column:
    """array with a number for each allele; null if the key is missing, has another count, or a value is no number or out of range."""
    v = F.transform(F.split(info_value(info, key), ","), lambda x: F.when(x.rlike(r"^[0-9]+$" if kind == "long" else r"^-?[0-9.]+(?:[eE][-+]?[0-9]+)?$"), x).try_cast(kind))
    bad = F.exists(v, lambda x: x.isNull() | (F.lit(False) if least is None else x < least) | (F.lit(False) if most is None else x > most))
    return F.when((F.size(v) == n_alleles) & ~bad, v)


def variant_type(ref: Column | str, alt: Column | str) -> Column:
    r, a = col(ref), col(alt)
    out = F.when(a.rlike(r"^<.*>$") | a.rlike(r"[\[\]]") | (a == "*"), "symbolic").when((F.length(r) == 1) & (F.length(a) == 1), "snv").when((F.length(r) == F.length(a)) & (F.length(r) > 1), "mnv")
    return out.when(F.length(a) > F.length(r), "insertion_like").when(F.length(a) < F.length(r), "deletion_like").otherwise("complex")


def ti_tv(ref: Column | str, alt: Column | str) -> Column:
    """transition or transversion for a canonical single base change (also of a base to itself: transversion), else null."""
    pair = F.upper(F.concat(col(ref), col(alt)))
    return F.when((variant_type(ref, alt) == "snv") & pair.rlike("^[ACGT]{2}$"), F.when(pair.isin("AG", "GA", "CT", "TC"), "transition").otherwise("transversion"))


def variant_key(chrom: Column | str, pos: Column | str, ref: Column | str, alt: Column | str) -> Column:
    return F.concat_ws(":", col(chrom), col(pos).cast("string"), col(ref), col(alt))


def filter_error(flt: Column | str) -> Column:
    parts = F.split(col(flt), ";")
    listed = ~col(flt).isin("PASS", ".")
    return first_error((listed & F.exists(parts, lambda p: ~p.rlike(r"^[^\x00-\x20\x7F;]+$") | p.isin("PASS", ".")), "bad_filter"), (listed & (F.size(F.array_distinct(parts)) < F.size(parts)), "duplicate_filter"))


def parse_filter(flt: Column | str) -> Column:
    """array of ids: none for PASS, Unfiltered for "."; null if invalid."""
    none = F.array().cast("array<string>")
    return F.when(filter_error(flt).isNull(), F.when(col(flt) == "PASS", none).when(col(flt) == ".", F.array(F.lit("Unfiltered"))).otherwise(F.split(col(flt), ";")))


def vcf_escape(v: Column | str) -> Column:
    """Percent-encoding of all bytes but A-Z a-z 0-9 _ . : / + -; "." for an empty value."""
    pairs = F.regexp_extract_all(F.hex(F.encode(col(v), "UTF-8")), F.lit("(..)"), F.lit(1))
    one = lambda h: F.when(F.chr(F.conv(h, 16, 10).cast("long")).rlike(r"^[A-Za-z0-9_.:/+\-]$"), F.chr(F.conv(h, 16, 10).cast("long"))).otherwise(F.concat(F.lit("%"), h))
    return F.when(F.coalesce(col(v), F.lit("")) == "", ".").otherwise(F.array_join(F.transform(pairs, one), ""))


def tsv_safe(v: Column | str) -> Column:
    return F.translate(col(v), "\t\r\n", "   ")
