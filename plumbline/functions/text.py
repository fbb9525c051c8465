"""Text normalisers and canonical identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: white space around a text
BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """Text without surrounding white space; null becomes empty. Trimmed, not matched: nearly every row of every table passes here."""
    return F.btrim(F.coalesce(as_col(c).cast("string"), F.lit("")), F.lit(BLANKS))


def verbatim(c: Column | str) -> Column:
    """Text as it is; only null becomes empty."""
    return F.coalesce(as_col(c).cast("string"), F.lit(""))


def fold_case(c: Column | str) -> Column:
    """Case-insensitive key. Lower case, with the sharp s spelt out; other special foldings are not made."""
    return F.replace(F.lower(clean(c)), F.lit("ß"), F.lit("ss"))


def relation_leaf(c: Column | str) -> Column:
    """Last dotted part of a relation name, without quotes, as a case-insensitive key."""
    return fold_case(F.substring_index(F.regexp_replace(clean(c), '["`]', ""), ".", -1))


def relation_parts(c: Column | str) -> Column:
    """struct(schema, name): cut at the last dot; no dot leaves the schema empty."""
    name = clean(c)
    last = F.substring_index(name, ".", -1)
    schema = F.when(name.contains("."), F.substring(name, F.lit(1), F.char_length(name) - F.char_length(last) - 1)).otherwise("")
    return F.struct(schema.alias("schema"), last.alias("name"))


def file_stem(c: Column | str) -> Column:
    """File name without folders and last extension."""
    return F.regexp_replace(F.substring_index(F.replace(clean(c), F.lit("\\"), F.lit("/")), "/", -1), r"(?<=.)\.[^.]*$", "")


def is_template(c: Column | str) -> Column:
    """Holds an unexpanded placeholder, as sources read it."""
    return clean(c).contains("${") | clean(c).contains("{{")


def is_placeholder(c: Column | str) -> Column:
    """Holds an unexpanded placeholder, as gaps read it: percent forms count too."""
    return is_template(c) | clean(c).contains("%(")


def first_filled(*cols: Column | str) -> Column:
    """First non-empty text, or empty."""
    return F.coalesce(*[F.nullif(clean(c), F.lit("")) for c in cols], F.lit(""))


def tri_state(c: Column | str) -> Column:
    """True unless known to be false."""
    return F.coalesce(as_col(c), F.lit(True))


def canonical_json(*fields: Column) -> Column:
    """Compact JSON object of the given named columns in key order, nulls kept."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def json_list(*items: Column) -> Column:
    """Compact JSON array of texts."""
    return F.to_json(F.array(*[verbatim(i) for i in items]))


def digest(c: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(c, 256), 1, length)


def joined_id(prefix: str, *parts: Column | str, separator: str = "\x1f", length: int = 24) -> Column:
    """prefix and the first digits of the sha256 of the parts, joined by a control character."""
    return F.concat(F.lit(prefix), digest(F.concat_ws(separator, *[verbatim(p) for p in parts]), length))

