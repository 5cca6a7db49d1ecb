"""Privacy patterns, markup removal, fencing and host checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.functions import fixed
from plenum.functions.text import _col


def redact(c: Column | str) -> Column:
    text = _col(c)
    first, last = F.substring(text, 1, 1), F.substring(text, -1, 1)
    return (
        F.when(F.length(text) > 2, F.concat(first, F.lit("***"), last))
        .when(F.length(text) == 2, F.concat(first, F.lit("*")))
        .otherwise(text)
    )


def pii_matches(c: Column | str) -> Column:
    """All hits of a text as an array of (pattern_name, matched_text), redacted."""
    def hits(name: str, pattern: str) -> Column:
        found = F.regexp_extract_all(_col(c), F.lit(f"(?U){pattern}"), 0)
        return F.transform(found, lambda m: F.struct(F.lit(name).alias("pattern_name"), redact(m).alias("matched_text")))

    return F.concat(*[hits(name, pattern) for name, pattern in fixed.PII_PATTERNS.items()])


def string_leaves(df: DataFrame, *skip: str) -> Column:
    """Every string of a row as an array of (field_path, value), arrays and structs included.

    The walk happens once over the schema; the result is one expression.
    """
    parts = [
        part
        for field in df.schema.fields
        if field.name not in skip
        for part in _leaves(F.col(f"`{field.name}`"), field.dataType, F.lit(field.name))
    ]
    if not parts:
        return F.array().cast("array<struct<field_path:string,value:string>>")
    return F.filter(F.concat(*parts), lambda leaf: leaf["value"].isNotNull())


def _leaves(value: Column, kind: T.DataType, path: Column) -> list[Column]:
    empty = F.array().cast("array<struct<field_path:string,value:string>>")
    if isinstance(kind, T.StringType):
        return [F.array(F.struct(path.alias("field_path"), value.alias("value")))]
    if isinstance(kind, T.StructType):
        return [
            part
            for f in kind.fields
            for part in _leaves(value[f.name], f.dataType, F.concat(path, F.lit("." + f.name)))
        ]
    if isinstance(kind, T.ArrayType) and _holds_text(kind.elementType):
        def inside(item: Column, index: Column) -> Column:
            here = F.concat(path, F.lit("["), index.cast("string"), F.lit("]"))
            return F.concat(*_leaves(item, kind.elementType, here))
        return [F.coalesce(F.flatten(F.transform(value, inside)), empty)]
    if isinstance(kind, T.MapType) and _holds_text(kind.valueType):
        def entry(item: Column) -> Column:
            here = F.concat(path, F.lit("."), item["key"].cast("string"))
            return F.concat(*_leaves(item["value"], kind.valueType, here))
        return [F.coalesce(F.flatten(F.transform(F.map_entries(value), entry)), empty)]
    return []


def _holds_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_text(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _holds_text(kind.elementType)
    if isinstance(kind, T.MapType):
        return _holds_text(kind.valueType)
    return isinstance(kind, T.StringType)


def sanitize_html(c: Column | str) -> Column:
    text = _col(c)
    for pattern in fixed.MARKUP_PATTERNS:
        text = F.regexp_replace(text, pattern, "")
    return text


def escape_attribute(c: Column | str) -> Column:
    text = _col(c)
    for raw, safe in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def breaks_fence(c: Column | str, tag: str = fixed.FENCE_TAG) -> Column:
    return _col(c).rlike(rf"(?i)</?{tag}\b")


def has_dangerous_markup(c: Column | str) -> Column:
    return _col(c).rlike(f"(?i){fixed.DANGEROUS_MARKUP}")


def fence_content(
    content: Column | str,
    source: Column | str,
    fetched_at: Column | str | None = None,
    tag: str = fixed.FENCE_TAG,
    on_refusal: str = "error",
) -> Column:
    """Wrap text in an escaped source tag; text holding the tag is refused (error or null)."""
    stamp = F.lit("")
    if fetched_at is not None:
        given = F.concat(F.lit(' fetched_at="'), escape_attribute(fetched_at), F.lit('"'))
        stamp = F.when(F.coalesce(_col(fetched_at), F.lit("")) != "", given).otherwise("")
    fenced = F.concat(
        F.lit(f'<{tag} source="'), escape_attribute(source), F.lit('"'), stamp, F.lit(">"),
        _col(content), F.lit(f"</{tag}>"),
    )
    refused = (
        F.raise_error(F.lit("content contains the fence tag")).cast("string")
        if on_refusal == "error"
        else F.lit(None).cast("string")
    )
    return F.when(breaks_fence(content, tag), refused).otherwise(fenced)


def url_host(c: Column | str) -> Column:
    return F.lower(F.try_parse_url(_col(c), F.lit("HOST")))


def host_allowed(url: Column | str, allowed: list[str]) -> Column:
    """Exact hosts, or ``.suffix`` for a domain with its subdomains; no list means no limit."""
    if not allowed:
        return F.lit(True)
    host = url_host(url)
    exact = [a.lstrip(".") for a in allowed]
    suffixes = [a for a in allowed if a.startswith(".")]
    hit = host.isin(exact)
    for suffix in suffixes:
        hit = hit | host.endswith(suffix)
    return F.coalesce(hit, F.lit(False))
