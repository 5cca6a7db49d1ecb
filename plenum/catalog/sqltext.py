"""SQL twins of the text and name expressions, for the checks only."""

from __future__ import annotations

from plenum.catalog.views import quoted
from plenum.functions import fixed
from plenum.functions import text as tx
from plenum.functions.fixed import NWS, WS, WS_OR_WORD


def replace(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(by)}, 'g')"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {quoted(pattern)})"


def strip(x: str) -> str:
    return replace(x, rf"^{WS}+|{WS}+$")


def collapse(x: str) -> str:
    return replace(x, rf"{WS}+", " ")


def nullif_blank(x: str, *also: str) -> str:
    s = strip(x)
    for value in ("", *also):
        s = f"nullif({s}, {quoted(value)})"
    return s


def clean_text(x: str) -> str:
    x = replace(strip(x), r"[ \t]+", " ")
    x = replace(x, rf"\n{WS}*\n", "\n")
    x = replace(x, r"[\x{200B}-\x{200D}\x{FEFF}]")
    x = replace(x, "[\"“”]", '"')
    x = replace(x, "['‘’]", "'")
    x = replace(x, rf'(?i)^(?:"|{WS})*to{WS}*".*?"(?:"|{WS})*$')
    x = replace(x, rf'(?i)^{WS}*👍{WS}*to{WS}*".*?".*$')
    return strip(x)


def clean_text_heavy(x: str) -> str:
    x = collapse(strip(f"coalesce({x}, '')"))
    x = replace(x, r"https?://[a-z!$-_]+")
    x = replace(x, rf"{NWS}+@{NWS}+")
    x = replace(x, r"\b\d{3}-\d{3}-\d{4}\b|\b\(\d{3}\)\s*\d{3}-\d{4}\b")
    x = replace(x, r"!{2,}", "!")
    x = replace(x, r"\?{2,}", "?")
    x = replace(x, r"\.{3,}", "...")
    x = replace(x, r"[^\s\x0B\x1C-\x1F\x{85}\p{Z}\p{L}\p{N}_.,!?;:'\"-]", " ")
    return collapse(strip(x))


def is_stop(x: str) -> str:
    s = strip(f"lower({x})")
    words = "|".join(fixed.STOP_WORDS)
    framed = rf"^(?:{words}){WS}+{NWS}+{WS}+{NWS}|{NWS}{WS}+{NWS}+{WS}+(?:{words})$"
    return f"({matches(s, tx.any_of(fixed.STOP_PATTERNS, True))} OR {matches(s, framed)})"


def is_opt_out(x: str) -> str:
    return matches(strip(f"lower({clean_text_heavy(x)})"), tx.any_of(fixed.OPT_OUT_PATTERNS, True))


def feedback(x: str) -> str:
    words = "|".join(fixed.STOP_WORDS)
    after = strip(f"regexp_extract({strip(x)}, {quoted(rf'(?i)^(?:{words}){WS}+(.+)$')}, 1)")
    before = strip(f"regexp_extract({strip(x)}, {quoted(rf'(?i)^(.+?){WS}+(?:{words})$')}, 1)")
    return f"CASE WHEN length({after}) > 5 THEN {after} WHEN length({before}) > 5 THEN {before} END"


def non_substantive(x: str, min_length: int = 10) -> str:
    s = strip(f"lower({x})")
    greetings = [rf"{p}{WS_OR_WORD}*$" for p in fixed.GREETING_PATTERNS]
    exclamations = [rf"{p}(?:{WS}|!)*$" for p in fixed.EXCLAMATION_PATTERNS]
    emoji = [rf"(?:[{fixed.EMOJI}]|{WS})*$"]
    pattern = tx.any_of(greetings + exclamations + emoji + fixed.WRONG_PERSON_PATTERNS, True)
    civic = r"\b(?:" + "|".join(fixed.SHORT_CIVIC_PATTERNS) + r")\b"
    return f"({matches(s, pattern)} OR (length({x}) < {min_length} AND NOT {matches(s, civic)}))"


def title_case(x: str) -> str:
    runs = f"regexp_extract_all({x}, {quoted(r'\p{L}+|[^\p{L}]+')})"
    return f"array_to_string(list_transform({runs}, lambda r: upper(r[1]) || lower(r[2:])), '')"


def clean_name(x: str) -> str:
    edge = r"[^\s\p{L}\p{N}_'-]+"
    n = replace(collapse(nullif_blank(x, "nan")), rf"^{edge}|{edge}$")
    low, up = f"({n} = lower({n}) AND {n} <> upper({n}))", f"({n} = upper({n}) AND {n} <> lower({n}))"
    cased = f"CASE WHEN {low} AND length({n}) <= 3 THEN {n} WHEN {low} OR {up} THEN {title_case(n)} ELSE {n} END"
    suffixes = ", ".join(quoted(s) for s in fixed.NAME_SUFFIXES)
    return (
        f"(SELECT CASE WHEN NOT regexp_matches(v, '\\p{{Nd}}') AND length(v) <= 50 AND (length(v) >= 2 OR v IN ({suffixes})) THEN v END "
        f"FROM (SELECT {cased} AS v))"
    )


def clean_state(x: str) -> str:
    codes = ", ".join(quoted(s) for s in fixed.STATE_CODES)
    s = f"upper({strip(x)})"
    return f"CASE WHEN {s} IN ({codes}) THEN {s} END"


def clean_office(x: str) -> str:
    o = collapse(nullif_blank(x, "nan", "None"))
    o = f"CASE WHEN length({o}) <= 150 THEN {o} END"
    for word in fixed.OFFICE_WORDS:
        o = replace(o, rf"(?i)\b{word}\b", word)
    return o


def office_level(x: str) -> str:
    s = f"upper({strip(x)})"

    def among(values: list[str]) -> str:
        return f"{s} IN (" + ", ".join(quoted(v) for v in values) + ")"

    return (
        f"CASE WHEN {among(fixed.FEDERAL_LEVELS)} OR contains({s}, 'FEDERAL') THEN 'FEDERAL' WHEN {among(fixed.STATE_LEVELS)} THEN 'STATE' "
        f"WHEN contains({s}, 'STATE') AND NOT contains({s}, 'INTERSTATE') THEN 'STATE' "
        f"WHEN {among(fixed.LOCAL_LEVELS)} OR {matches(s, '|'.join(fixed.LOCAL_KEYWORDS))} THEN 'LOCAL' END"
    )


def clean_party(x: str) -> str:
    p = nullif_blank(x, "nan", "None")
    cases = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in fixed.PARTY_SPELLINGS.items())
    return f"CASE {p} {cases} ELSE {p} END"


def election_type(x: str, default: str | None = None) -> str:
    cases = " ".join(f"WHEN contains(lower({x}), '{t}') THEN '{t}'" for t in fixed.ELECTION_TYPES)
    return f"CASE {cases} ELSE {x if default is None else quoted(default)} END"


def state_code(x: str) -> str:
    s = f"upper({nullif_blank(x)})"
    cases = " ".join(f"WHEN {quoted(n)} THEN {quoted(c)}" for n, c in fixed.STATES.items())
    return f"CASE WHEN length({s}) = 2 THEN {s} ELSE CASE {s} {cases} ELSE left({s}, 2) END END"


def phone(x: str) -> str:
    d = replace(f"coalesce({x}, '')", r"[^\p{Nd}]")
    return f"CASE WHEN length({d}) = 11 AND {d} LIKE '1%' THEN substr({d}, 2) ELSE {d} END"


def slug(x: str) -> str:
    return replace(replace(replace(f"lower({nullif_blank(x)})", r"[^a-z0-9\s-]"), r"\s+", "-"), "^-+|-+$")
