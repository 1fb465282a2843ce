"""Names, numbers in text and identifiers as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def slug(text: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 one hyphen, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def digit_runs(text: Column) -> Column:
    """Runs of one or two digits that stand alone."""
    return F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d{1,2})(?!\d)"), 1)


def shirt_number(text: Column) -> Column:
    """'08' becomes '8'; anything but 0..99 is null."""
    s = F.trim(text)
    return F.when(s.rlike(r"^\d{1,2}$"), s.try_cast("int").cast("string"))


def clock_label(minute: Column, extra: Column) -> Column:
    """45+2' style."""
    return F.when(minute.isNull(), None).when(F.coalesce(extra, F.lit(0)) > 0, F.concat(minute.cast("string"), F.lit("+"), extra.cast("string"), F.lit("'"))).otherwise(F.concat(minute.cast("string"), F.lit("'")))


def contains_case(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The first rule one of whose words is contained; the order of the rules matters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(default)
    for name, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def stable_id(*parts: Column, length: int = 24) -> Column:
    """Leading hex digits of sha256 over the parts joined by 0x1f; a null part is an empty field."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256), 1, length)


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys; nulls are written."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def digest(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields).cast("binary"), 256)


@F.pandas_udf(StringType())
def folded_name(names: pd.Series) -> pd.Series:
    """NFKD, letters and digits only, case-folded: Spark has no such normalisation."""
    return names.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if c.isalnum()).casefold())
