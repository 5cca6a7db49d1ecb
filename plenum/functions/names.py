"""Cleaning of candidate, office, party, state and phone fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plenum.functions import fixed
from plenum.functions.fixed import WS
from plenum.functions.text import _col, collapse_spaces, let, nullif_blank, strip


def title_case(c: Column | str) -> Column:
    """Upper-case the first letter after every non-letter, lower-case the rest.

    ``initcap`` only starts words after white space; names need ``O'Connor``.
    """
    runs = F.regexp_extract_all(_col(c), F.lit(r"\p{L}+|[^\p{L}]+"), 0)
    cased = F.transform(
        runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(r.substr(F.lit(2), F.length(r))))
    )
    return F.array_join(cased, "")


def clean_name(c: Column | str) -> Column:
    edge = r"[^\s\p{L}\p{N}_'-]+"
    trimmed = F.regexp_replace(collapse_spaces(nullif_blank(c, "nan")), rf"^{edge}|{edge}$", "")

    def cased(name: Column) -> Column:
        is_lower = (name == F.lower(name)) & (name != F.upper(name))
        is_upper = (name == F.upper(name)) & (name != F.lower(name))
        return (
            F.when(is_lower & (F.length(name) <= 3), name)
            .when(is_lower | is_upper, title_case(name))
            .otherwise(name)
        )

    def usable(name: Column) -> Column:
        long_enough = (F.length(name) >= 2) | name.isin(fixed.NAME_SUFFIXES)
        return F.when(~name.rlike(r"\p{Nd}") & (F.length(name) <= 50) & long_enough, name)

    return let(let(trimmed, cased), usable)


def clean_state(c: Column | str) -> Column:
    state = F.upper(strip(c))
    return F.when(state.isin(fixed.STATE_CODES), state)


def clean_office(c: Column | str) -> Column:
    office = collapse_spaces(nullif_blank(c, "nan", "None"))
    office = F.when(F.length(office) <= 150, office)
    for word in fixed.OFFICE_WORDS:
        office = F.regexp_replace(office, rf"(?iU)\b{word}\b", word)
    return office


def office_level(c: Column | str) -> Column:
    """FEDERAL, STATE, LOCAL or null; the order of the rules decides."""
    level = F.upper(strip(c))
    has_local_word = level.rlike("|".join(fixed.LOCAL_KEYWORDS))
    return (
        F.when(level.isin(fixed.FEDERAL_LEVELS) | level.contains("FEDERAL"), "FEDERAL")
        .when(level.isin(fixed.STATE_LEVELS), "STATE")
        .when(level.contains("STATE") & ~level.contains("INTERSTATE"), "STATE")
        .when(level.isin(fixed.LOCAL_LEVELS) | has_local_word, "LOCAL")
    )


def clean_party(c: Column | str) -> Column:
    party = nullif_blank(c, "nan", "None")
    spelling = F.create_map(*[F.lit(x) for pair in fixed.PARTY_SPELLINGS.items() for x in pair])
    return F.coalesce(F.try_element_at(spelling, party), party)


def state_of_race(race_name: Column | str) -> Column:
    """The leading two letters of a race name if they are a state code."""
    return clean_state(F.upper(F.substring(_col(race_name), 1, 2)))


def election_type(c: Column | str, default: str | None = None) -> Column:
    """primary before runoff before general; anything else stays or becomes ``default``."""
    text = F.lower(_col(c))
    known = F.coalesce(*[F.when(text.contains(t), F.lit(t)) for t in fixed.ELECTION_TYPES])
    return F.coalesce(known, _col(c) if default is None else F.lit(default))


def state_code(c: Column | str) -> Column:
    """Two-letter code from a code or a full name; otherwise the first two letters."""
    state = F.upper(nullif_blank(c))
    codes = F.create_map(
        *[F.lit(x) for pair in fixed.STATES.items() for x in pair]
    )
    return F.when(F.length(state) == 2, state).otherwise(
        F.coalesce(F.try_element_at(codes, state), F.substring(state, 1, 2))
    )


def slug(c: Column | str) -> Column:
    kept = F.regexp_replace(F.lower(nullif_blank(c)), r"[^a-z0-9\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"\s+", "-"), "^-+|-+$", "")


def normalise_phone(c: Column | str, enabled: bool = True) -> Column:
    """Digits only, without the leading 1 of eleven; empty instead of null."""
    phone = F.coalesce(_col(c), F.lit(""))
    if not enabled:
        return phone
    digits = F.regexp_replace(phone, r"[^\p{Nd}]", "")
    long_form = (F.length(digits) == 11) & digits.startswith("1")
    return F.when(long_form, F.substring(digits, 2, 10)).otherwise(digits)


def candidate_race_text(first: str, last: str, official: str, office: str, state: str) -> Column:
    """``name: F L | race: R`` for a candidate record."""
    name = F.coalesce(F.concat(F.col(first), F.lit(" "), F.col(last)), F.lit(""))
    race = F.coalesce(
        F.col(official),
        strip(F.concat(F.coalesce(F.col(state), F.lit("")), F.lit(" "), F.col(office))),
        F.lit(""),
    )
    return F.concat(F.lit("name: "), name, F.lit(" | race: "), race)


def result_race_text(candidate: str, race_name: str) -> Column:
    """``name: F L | race: R`` for an election result."""
    return F.concat(
        F.lit("name: "), F.coalesce(F.col(candidate), F.lit("")),
        F.lit(" | race: "), F.coalesce(F.col(race_name), F.lit("")),
    )


def city_race_text(city: str, office: str, official: str) -> Column:
    race = F.coalesce(nullif_blank(office), nullif_blank(official), F.lit(""))
    town = nullif_blank(city)
    return F.when(
        town.isNotNull(), F.concat(F.lit("city:"), town, F.lit(" | race:"), race)
    ).otherwise(race)


def district_text(state: str, district_type: str, district_name: str) -> Column:
    return F.concat(
        F.lit("state: "), F.col(state), F.lit(", district type: "), F.col(district_type),
        F.lit(", district name: "), F.col(district_name),
    )


def coalesce_location(value: str, derived: str | None = None) -> Column:
    """The value, else the derived one; ``none`` and blanks count as missing."""
    picked = nullif_blank(value)
    if derived:
        picked = F.coalesce(picked, nullif_blank(derived))
    return F.when(F.lower(picked) != "none", picked)


def is_municipal(office: Column | str) -> Column:
    return F.coalesce(F.lower(_col(office)).rlike("|".join(fixed.MUNICIPAL_WORDS)), F.lit(False))


def is_federal(office: Column | str) -> Column:
    return F.coalesce(F.lower(_col(office)).rlike("|".join(fixed.FEDERAL_WORDS)), F.lit(False))


def has_city(city: Column | str) -> Column:
    town = F.lower(_col(city))
    return F.coalesce(~town.isin("none", "", "n/a"), F.lit(False))


def district_query_text(
    office: Column, state: Column, city: Column, county: Column, district: Column
) -> Column:
    """What is searched for a position; the inputs are coalesced locations (null if missing)."""
    place = F.when(
        is_municipal(office) & city.isNotNull(),
        F.concat(F.lit("district type: "), office, F.lit(", district name: "), city),
    ).otherwise(F.concat(F.lit("district type: "), office))
    parts = F.array_compact(
        F.array(
            place,
            F.concat(F.lit("district name: "), city),
            F.concat(F.lit("county: "), county),
            F.concat(F.lit("district: "), district),
        )
    )
    fallback = F.concat(F.lit("position in "), F.coalesce(state, F.lit("")))
    return F.when(F.size(parts) > 0, F.array_join(parts, " | ")).otherwise(fallback)


def sheet_state(race: Column | str) -> Column:
    state = F.regexp_extract(_col(race), rf"^([A-Z]{{2}}){WS}+", 1)
    return F.when(state != "", state)


def sheet_race_name(race: Column | str) -> Column:
    name = F.regexp_replace(_col(race), rf"^[A-Z]{{2}}{WS}+", "")
    return F.regexp_replace(name, rf"{WS}+(?:General|Primary|Runoff|Special)$", "")
