"""Cleaning, filtering and splitting of message text."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.functions import fixed
from plenum.functions.fixed import NWS, WS, WS_OR_WORD


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(patterns: list[str], anchored: bool = False) -> str:
    """One alternation from several patterns, so a text is scanned once."""
    body = "|".join(f"(?:{p})" for p in patterns)
    return f"^(?:{body})" if anchored else f"(?:{body})"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    Written plainly, every use would be its own copy of the expression.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def strip(c: Column | str) -> Column:
    """Trim Unicode white space, not only blanks."""
    return F.btrim(_col(c), F.lit(fixed.SPACES))


def replace_if(text: Column, marker: str, pattern: str, by: str) -> Column:
    """``regexp_replace`` for texts holding the marker that every match needs; others are not scanned by regex."""
    return let(text, lambda t: F.when(t.contains(marker), F.regexp_replace(t, pattern, by)).otherwise(t))


def collapse_spaces(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), rf"{WS}+", " ")


def nullif_blank(c: Column | str, *also: str) -> Column:
    """The stripped text, null when nothing (or one of the ``also`` spellings) is left."""
    stripped = strip(c)
    return F.when(~stripped.isin("", *also), stripped)


def clean_text(c: Column | str) -> Column:
    """Light cleaning: spaces, blank lines, zero-width characters, quotes, reaction artefacts."""
    text = strip(c)
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, rf"\n{WS}*\n", "\n")
    # curly quotes become straight ones, zero-width characters vanish
    text = F.translate(text, "“”‘’\u200b\u200c\u200d\ufeff", "\"\"''")
    text = F.regexp_replace(text, rf'(?id)^(?:"|{WS})*to{WS}*".*?"(?:"|{WS})*$', "")
    text = F.regexp_replace(text, rf'(?id)^{WS}*👍{WS}*to{WS}*".*?".*$', "")
    return strip(text)


def clean_text_heavy(c: Column | str) -> Column:
    """Also drop links, addresses, phone numbers, repeated punctuation and all symbols."""
    text = collapse_spaces(strip(F.coalesce(_col(c), F.lit(""))))
    text = replace_if(text, "http", fixed.LINK_PATTERN, "")
    text = replace_if(text, "@", fixed.ADDRESS_PATTERN, "")
    text = replace_if(text, "-", fixed.PHONE_PATTERN, "")
    text = F.regexp_replace(text, r"([!?])\1+", "$1")
    text = replace_if(text, "...", r"\.{3,}", "...")
    text = F.regexp_replace(text, r"[^\s\x0B\x1C-\x1F\x{85}\p{Z}\p{L}\p{N}_.,!?;:'\"-]", " ")
    return collapse_spaces(strip(text))


def is_stop_message(c: Column | str) -> Column:
    """Opt-out: an anchored pattern, or three or more words framed by a stop word."""
    text = strip(F.lower(_col(c)))
    words = "|".join(fixed.STOP_WORDS)
    framed = (
        rf"^(?:{words}){WS}+{NWS}+{WS}+{NWS}|{NWS}{WS}+{NWS}+{WS}+(?:{words})$"
    )
    return text.rlike(any_of([*fixed.STOP_PATTERNS], anchored=True) + "|" + framed)


def is_opt_out(c: Column | str, on_raw: bool = False) -> Column:
    """Opt-out, emoji and one or two character messages.

    The patterns see heavily cleaned text, in which a lone emoji is already gone; ``on_raw``
    tests the text as it came instead.
    """
    text = strip(F.lower(_col(c) if on_raw else clean_text_heavy(c)))
    return F.coalesce(text.rlike("(?d)" + any_of(fixed.OPT_OUT_PATTERNS, anchored=True)), F.lit(False))


def feedback_from_stop(c: Column | str) -> Column:
    """What an opt-out says besides the stop word, if that is more than five characters."""
    words = "|".join(fixed.STOP_WORDS)

    def said(pattern: str) -> Callable[[Column], Column]:
        return lambda t: let(strip(F.regexp_extract(t, pattern, 1)), lambda found: F.when(F.length(found) > 5, found))

    after, before = said(rf"(?id)^(?:{words}){WS}+(.+)$"), said(rf"(?id)^(.+?){WS}+(?:{words})$")
    return let(strip(c), lambda t: F.coalesce(after(t), before(t)))


def _non_substantive_pattern(strict_boundary: bool) -> str:
    edge = r"\b" if strict_boundary else ""
    greetings = [rf"{p}{edge}{WS_OR_WORD}*$" for p in fixed.GREETING_PATTERNS]
    if strict_boundary:
        greetings = [rf"{p}{WS}*$" for p in fixed.GREETING_PATTERNS]
    exclamations = [rf"{p}(?:{WS}|!)*$" for p in fixed.EXCLAMATION_PATTERNS]
    emoji_only = [rf"(?:[{fixed.EMOJI}]|{WS})*$"]
    return any_of(greetings + exclamations + emoji_only + fixed.WRONG_PERSON_PATTERNS, anchored=True)


def is_non_substantive(
    c: Column | str, min_length: int = 10, strict_boundary: bool = False
) -> Column:
    """Greeting, acknowledgement, emoji, wrong person, or short without a civic word.

    The default greeting patterns also swallow sentences that merely start with one of the
    words; ``strict_boundary`` only accepts the greeting alone.
    """
    pattern = _non_substantive_pattern(strict_boundary)
    civic = r"(?U)\b(?:" + "|".join(fixed.SHORT_CIVIC_PATTERNS) + r")\b"
    return let(
        _col(c),
        lambda t: strip(F.lower(t)).rlike(pattern) | ((F.length(t) < min_length) & ~F.lower(t).rlike(civic)),
    )


def starts_with_emoji(c: Column | str) -> Column:
    return F.coalesce(strip(c).rlike(rf"^[{fixed.EMOJI}]"), F.lit(False))


def has_civic_relevance(c: Column | str) -> Column:
    return F.lower(_col(c)).rlike("|".join(fixed.CIVIC_KEYWORDS))


def length_check(c: Column | str, min_length: int = 15, max_length: int = 5000) -> Column:
    """Lengths before and after heavy cleaning, and whether they are within the limits."""
    return let(
        F.length(clean_text_heavy(c)),
        lambda cleaned: F.struct(
            F.length(_col(c)).alias("original_length"),
            cleaned.alias("cleaned_length"),
            (cleaned >= min_length).alias("meets_min"),
            (cleaned <= max_length).alias("meets_max"),
        ),
    )


def filter_reasons(
    c: Column | str, max_length: int = 5000, on_raw: bool = False, cleaned: Column | None = None
) -> Column:
    """Why a message fails the filter; an empty array means it passed.

    ``cleaned`` is the heavily cleaned text where that is at hand.
    """
    def reasons(cleaned: Column) -> Column:
        length = F.length(cleaned)
        too_long = F.concat(F.lit("Too long: "), length.cast("string"), F.lit(f" > {max_length} chars"))
        seen = F.lower(_col(c)) if on_raw else F.lower(cleaned)
        opted_out = strip(seen).rlike("(?d)" + any_of(fixed.OPT_OUT_PATTERNS, anchored=True))
        return F.array_compact(
            F.array(F.when(length > max_length, too_long), F.when(opted_out, F.lit("STOP/opt-out message")))
        )

    return let(clean_text_heavy(c) if cleaned is None else cleaned, reasons)


def anonymise(c: Column | str, terms: Mapping[str, str]) -> Column:
    """Replace whole words, ignoring case; terms are applied in the given order."""
    text = _col(c)
    for term, replacement in terms.items():
        safe = replacement.replace("\\", "\\\\").replace("$", "\\$")
        text = F.regexp_replace(text, rf"(?iU)\b\Q{term}\E\b", safe)
    return text


def split_sentences(c: Column | str) -> Column:
    """Default splitter: sentences and lines, trimmed, empty pieces dropped."""
    pieces = F.regexp_extract_all(_col(c), F.lit(r"[^.!?;\n]+[.!?;]*"), 0)
    return F.filter(F.transform(pieces, strip), lambda piece: piece != "")


def issue_strings(issues: Column | str) -> Column:
    """``primary/secondary:stance(concern)`` joined with a bar."""
    def one(i: Column) -> Column:
        concern = F.coalesce(i["specific_concern"], F.lit(""))
        return F.concat(
            i["primary_category"], F.lit("/"), i["secondary_category"], F.lit(":"), i["stance"],
            F.when(concern != "", F.concat(F.lit("("), concern, F.lit(")"))).otherwise(""),
        )
    return F.array_join(F.transform(_col(issues), one), "|")


def root_cause_strings(issues: Column | str) -> Column:
    roots = F.filter(_col(issues), lambda i: i["is_root_cause"])
    keys = F.transform(roots, issue_key)
    return F.array_join(keys, "|")


def issue_key(issue: Column) -> Column:
    return F.concat(issue["primary_category"], F.lit("/"), issue["secondary_category"])


def unwrap_json(c: Column | str) -> Column:
    """Take model output out of code fences and doubled braces."""
    fenced = strip(F.regexp_replace(strip(c), r"(?s)^```(?:json)?(.*?)(?:```)?$", "$1"))

    def unbraced(t: Column) -> Column:
        doubled = t.startswith("{{") & t.endswith("}}")
        return F.when(doubled, strip(t.substr(F.lit(2), F.length(t) - 2))).otherwise(t)

    return let(fenced, unbraced)


def parse_json(c: Column | str, schema: T.StructType) -> Column:
    """Tolerant decode: as it is if that is valid JSON, else without trailing commas."""
    guarded = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}

    def decoded(t: Column) -> Column:
        return let(F.from_json(t, guarded, options), lambda v: F.when(v["_corrupt"].isNull(), v))

    return let(
        unwrap_json(c),
        lambda t: F.coalesce(decoded(t), decoded(F.regexp_replace(t, r",(\s*[}\]])", "$1"))),
    ).dropFields("_corrupt")


def valid_choice(index: Column | str, n_candidates: Column | str) -> Column:
    """A one-based choice that points outside the candidate list counts as no choice."""
    number = _col(index)
    return F.when(number.between(1, _col(n_candidates)), number)


def words(c: Column | str) -> Column:
    """Distinct white-space separated words, lower-cased."""
    return F.array_remove(F.array_distinct(F.split(strip(F.lower(_col(c))), rf"{WS}+")), "")


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two word arrays; 0 when either is empty."""
    share = let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), share).otherwise(F.lit(0.0))
