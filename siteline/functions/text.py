"""Text functions on string columns, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_name(s: Column) -> Column:
    """Lower case, letters and digits only, ``rep`` before a digit as ``r``."""
    return F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]", ""), "rep([0-9])", "r$1")


def strip_trailing_paren(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, "\\s*\\([^()]*\\)\\s*$", ""))


def extract_all(s: Column, pattern: str) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(0))


def path_stem(s: Column) -> Column:
    """The file's name without one compression suffix and without its extension."""
    name = F.regexp_extract(s, "([^/]*)$", 1)
    return F.regexp_replace(F.regexp_replace(name, "\\.(gz|bz2|xz|zst)$", ""), "\\.[^.]*$", "")


def slug(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), "[^a-z0-9]", "")


def parse_region(s: Column) -> Column:
    """``contig[:a-b]`` with thousands commas, as (contig, first, last); whole contigs have no bounds."""
    part = lambda k: F.try_to_number(F.regexp_replace(F.nullif(F.regexp_extract(s, "^(.*):([0-9,]+)-([0-9,]+)$", k), F.lit("")), ",", ""), F.lit("999999999999999"))
    contig = F.coalesce(F.nullif(F.regexp_extract(s, "^(.*):([0-9,]+)-([0-9,]+)$", 1), F.lit("")), s)
    return F.struct(contig.alias("contig"), part(2).cast("long").alias("first"), part(3).cast("long").alias("last"))


def gff_attr(attrs: Column, key: str) -> Column:
    return F.nullif(F.regexp_extract(attrs, f"(?:^|;)\\s*{key}=([^;]*)", 1), F.lit(""))


def number_or_null(s: Column) -> Column:
    return F.trim(s).try_cast("double")


def pct(num: Column, den: Column) -> Column:
    """Percent to one place; null only where something wasn't measured, so a true 0 stays 0."""
    return F.when(den > 0, F.round(100 * num / den, 1))
