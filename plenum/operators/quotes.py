"""Quotes: which message said it, and does a page contain it."""

from __future__ import annotations

import html
from difflib import SequenceMatcher
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.functions.text import _col, strip
from plenum.operators.page_index import PageIndex
from plenum.operators.ranking import keep_first

MIN_RATIO = 0.6


def ratio_above(left: str, right: str, least: float) -> float:
    """difflib's ratio, or 0 when it is not above ``least``.

    ``quick_ratio`` counts common characters without their order: an upper bound in linear
    time, so only pairs that may pass are aligned.
    """
    matcher = SequenceMatcher(None, left, right)
    return matcher.ratio() if matcher.quick_ratio() > least else 0.0


@F.pandas_udf(T.DoubleType())
def similarity_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """difflib's ratio; neither an edit distance nor symmetric, so no built-in replaces it."""
    return pd.Series([ratio_above(a, b, MIN_RATIO) for a, b in zip(left, right)], dtype="float64")


@F.pandas_udf(T.StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def attribute_quotes(
    quotes: DataFrame,
    messages: DataFrame,
    group: str = "cluster_id",
    quote_id: str = "quote_id",
    fallback: str = "none",
    one_per_phone: bool = True,
) -> DataFrame:
    """The message behind each quote: the first that contains it, else the most similar.

    ``messages`` has the group, ``message_id``, ``phone_number`` and ``message_text``. A few
    quotes per group meet the messages of that group. A pair reaches Python only when it can
    still win: difflib's ratio is at most ``2 * shorter / (both lengths)``, which a column
    computes. The best pair is a max aggregate, so nothing is collected per group.

    ``fallback='first'`` takes the group's first message when nothing is similar enough.
    """
    q = quotes.select(group, quote_id, F.lower(strip("quote")).alias("_quote"))
    m = messages.select(group, "message_id", "phone_number", "message_text", F.lower("message_text").alias("_text"))
    pairs = q.join(m, group).withColumn("_contains", F.col("_text").contains(F.col("_quote")))
    shorter = F.least(F.length("_text"), F.length("_quote"))
    bound = F.try_divide(2 * shorter, F.length("_text") + F.length("_quote"))
    open_pairs = pairs.where(~F.col("_contains") & (bound > MIN_RATIO))
    compared = open_pairs.withColumn("_ratio", similarity_ratio("_quote", "_text")).where(F.col("_ratio") > MIN_RATIO)
    contained = pairs.where("_contains").withColumn("_ratio", F.lit(2.0))
    keep = [group, quote_id, "message_id", "phone_number", "message_text", "_ratio"]
    scored = contained.select(*keep).unionByName(compared.select(*keep))
    best = scored.groupBy(group, quote_id).agg(
        F.min_by(
            F.struct("message_id", "phone_number", "message_text", "_ratio"),
            F.struct((-F.col("_ratio")).alias("r"), F.col("message_id").alias("i")),
        ).alias("_m")
    )
    out = quotes.join(best, [group, quote_id], "left").select(
        *[quotes[c] for c in quotes.columns],
        F.col("_m.message_id").alias("message_id"), F.col("_m.phone_number").alias("phone_number"),
        F.col("_m.message_text").alias("original_text"), F.col("_m._ratio").alias("_ratio"),
    )
    how = F.when(F.col("_ratio") == 2.0, "contains").when(F.col("_ratio").isNotNull(), "similar")
    if fallback == "first":
        first = messages.groupBy(group).agg(
            F.min_by(F.struct("phone_number", "message_text", "message_id"), "message_id").alias("_first")
        )
        out = out.join(first, group, "left")
        for target, source in [("phone_number", "phone_number"), ("original_text", "message_text"), ("message_id", "message_id")]:
            out = out.withColumn(target, F.coalesce(target, F.col(f"_first.{source}")))
        how = how.when(F.col("message_id").isNotNull(), "first")
    out = out.withColumn("matched_by", F.coalesce(how, F.lit("none"))).drop("_ratio", "_first")
    if one_per_phone:
        attributed = out.where("phone_number is not null")
        return keep_first(attributed, [group, "phone_number"], [F.col(quote_id)])
    return out.withColumn("phone_number", F.coalesce("phone_number", F.lit("Unknown")))


def normalise_page(c: Column | str, aggressive: bool = True) -> Column:
    """Text as compared by the quote check; ``aggressive`` also strips markup and unifies punctuation."""
    text = _col(c)
    if aggressive:
        text = F.regexp_replace(text, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
        text = F.regexp_replace(text, r"</?[a-zA-Z][^>]*>", " ")
        # only texts with an entity go to Python
        text = F.when(text.contains("&"), unescape_html(text)).otherwise(text)
    text = F.lower(text)
    if aggressive:
        text = F.translate(text, "—–−‘’“” ", "---''\"\" ")
        return strip(F.regexp_replace(text, r"[\s\x0B\x1C-\x1F\x{85}\p{Z}.-]+", " "))
    return strip(F.regexp_replace(text, r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+", " "))


def common_block(body: str, quote: str) -> tuple[int, int]:
    """Length of the longest common block and its first place in the body.

    A block of some length contains blocks of every smaller length, so the length is found by
    bisection; each step looks up the distinct pieces of the quote in the body.
    """
    def places(size: int) -> list[int]:
        return [at for piece in {quote[i : i + size] for i in range(len(quote) - size + 1)} if (at := body.find(piece)) >= 0]

    low, high = 0, min(len(quote), len(body))
    while low < high:
        middle = (low + high + 1) // 2
        pieces = {quote[i : i + middle] for i in range(len(quote) - middle + 1)}
        low, high = (middle, high) if any(p in body for p in pieces) else (low, middle - 1)
    return low, min(places(low)) if low else 0


#: Distinct quotes of a page that one task looks up; a page with more goes to several tasks.
QUOTES_AT_ONCE = 4096
#: From so many missed quotes on, a page is indexed.
INDEX_FROM = 4
ANSWERS = T.ArrayType(T.StructType([
    T.StructField("_quote", T.StringType()), T.StructField("match", T.BooleanType()),
    T.StructField("similarity", T.DoubleType()), T.StructField("closest_match", T.StringType()),
]))


def answer(body: str, quotes: list[str]) -> list[dict]:
    """For each quote: is it in the page, else the longest common block as a share of it and the text around."""
    missed = [q for q in quotes if q and q not in body]
    longest = PageIndex(body).longest if len(missed) >= INDEX_FROM else partial(common_block, body)
    found = {q: longest(q) for q in missed}
    answers = []
    for q in quotes:
        size, at = found.get(q, (len(q), 0))
        around = q if q not in found else body[max(0, at - 30) : at + size + 30]
        answers.append({"_quote": q, "match": bool(q) and q not in found, "similarity": size / len(q) if q else 0.0, "closest_match": around if size else None})
    return answers


@F.pandas_udf(ANSWERS)
def look_up(body: pd.Series, quotes: pd.Series) -> pd.Series:
    return pd.Series([answer(b or "", list(q)) for b, q in zip(body, quotes, strict=True)])


def verify_quotes(claims: DataFrame, pages: DataFrame, key: str = "url", aggressive: bool = True, explain_misses: bool = True) -> DataFrame:
    """Whether the page of each claim contains its quote.

    Claims meet pages by url. With ``explain_misses`` the distinct quotes of a page go to it as
    lists, so a page is sent and indexed once per list and not once per claim; a popular page has
    several lists by the hash of the quote. Otherwise containment is a column test. A claim whose
    page is missing or whose quote is empty or null is a miss.
    """
    bodies = pages.select(key, normalise_page("html", aggressive).alias("_body"))
    asked = claims.withColumn("_quote", F.coalesce(normalise_page("quote", aggressive), F.lit("")))
    if not explain_misses:
        match = (F.col("_quote") != "") & F.contains(F.coalesce("_body", F.lit("")), F.col("_quote"))
        return asked.join(bodies, key, "left").withColumn("match", match).drop("_quote", "_body")
    distinct = asked.select(key, "_quote").distinct()
    parts = distinct.groupBy(key).agg(F.ceil(F.count("*") / QUOTES_AT_ONCE).cast("int").alias("_parts"))
    lists = distinct.join(parts, key).withColumn("_part", F.pmod(F.xxhash64("_quote"), F.col("_parts")).cast("int"))
    lists = lists.groupBy(key, "_part").agg(F.collect_list("_quote").alias("_quotes"))
    copies = bodies.join(parts, key).select(key, "_body", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    answers = lists.join(copies, [key, "_part"]).select(key, F.inline(look_up("_body", "_quotes")))
    return (
        asked.join(answers, [key, "_quote"], "left").drop("_quote")
        .withColumns({"match": F.coalesce("match", F.lit(False)), "similarity": F.coalesce("similarity", F.lit(0.0))})
        .select(*claims.columns, "match", "similarity", "closest_match")
    )


def source_confidence(sources: DataFrame, key: str = "atom_id", disagreements: str = "n_disagreements") -> DataFrame:
    """high, medium, low or unknown per atom from its verified sources; one tier down on disagreement."""
    per_atom = sources.groupBy(key).agg(
        F.count_if("verified").alias("verified_sources"),
        F.bool_or(F.col("verified") & (F.col("type") == "government_record")).alias("_government"),
        F.max(disagreements).alias("_disagreements"),
    )
    level = (
        F.when((F.col("verified_sources") >= 2) & F.col("_government"), 3)
        .when(F.col("verified_sources") >= 2, 2)
        .when(F.col("verified_sources") == 1, 1)
        .otherwise(0)
    )
    settled = F.greatest(level - F.when(F.col("_disagreements") > 0, 1).otherwise(0), F.lit(0))
    names = F.array(*[F.lit(n) for n in ("unknown", "low", "medium", "high")])
    return per_atom.select(
        key, "verified_sources", F.element_at(names, settled + 1).alias("confidence"), (settled > 0).alias("keep_answer")
    )
