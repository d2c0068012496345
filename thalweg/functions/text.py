"""String, null and JSON expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Prefixes of administrative names, tried in this order, and aliases of slugs.
PREFIXES = ("ตำบล", "ต.", "แขวง", "อำเภอ", "อ.", "เขต")
SLUG_ALIASES = {"bueng_kan": "beung_kan"}


def strip(x: Column) -> Column:
    return F.regexp_replace(x, "^\\s+|\\s+$", "")


def admin_name(x: Column) -> Column:
    """Null to '', trimmed, the first matching prefix dropped once, trimmed again."""
    choice = "|".join(p.replace(".", "\\.") for p in PREFIXES)
    return strip(F.regexp_replace(strip(F.coalesce(x, F.lit(""))), f"^({choice})", ""))


@F.pandas_udf(StringType())
def _plain_ascii(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode())


def slug(x: Column, ascii_only: bool = False) -> Column:
    """Lower case with runs of white space as ``_``; other than ASCII dropped after decomposition, in Arrow batches, unless the
    input is known to be ASCII."""
    return F.regexp_replace(F.lower(strip(x if ascii_only else _plain_ascii(x))), "\\s+", "_")


def alias(s: Column, table: dict[str, str] = SLUG_ALIASES) -> Column:
    pairs = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.coalesce(F.element_at(pairs, s), s)


def first_non_empty(*xs: Column) -> Column:
    """The first value that is not null, NaN text or blank, as it is."""
    return F.coalesce(*[F.when(strip(x) != "", x) for x in xs])


def untruncated(x: Column, width: int, strict: bool = True) -> Column:
    """Null where a fixed-width field may have cut the text: its trimmed UTF-8 length reaches the width, or, if ``strict``,
    comes within two bytes of it, where a cut three-byte letter ends."""
    t = F.nullif(strip(x), F.lit(""))
    return F.when(F.octet_length(t) < width - (2 if strict else 0), t)


def quoted(x: Column) -> Column:
    return F.replace(x, F.lit("'"), F.lit("''"))


def size_class(tag: Column, main=("river", "major_river")) -> Column:
    return F.when(tag.isin(*main), "main").otherwise("branch")


def title(*parts: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]), F.lit("")), fallback)
