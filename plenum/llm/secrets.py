"""Secret scan with linking of multipart credentials, in DataFrame functions only.

Strong parts (assignments, access identifiers, hex runs) are reported as they are. Weak parts
(short assignments and identifiers, 40-character blobs, user names, endpoints) are reported
only where a complementary part starts within ``reach`` code points: an interval join over
scopes of that length.

Code points of matches come from the text between them: ``split`` gives the gaps,
``regexp_extract_all`` the matches, and running sums over both are the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.common import staged


def _either(word: str) -> str:
    """A word in either case, for ASCII letters only."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _assigned(*names: str) -> str:
    return f"""(?:{"|".join(_either(n) for n in names)})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""


#: kind -> (pattern, is there a value in group 1, role). A hex run of 16 characters and more and
#: a blob are whole runs, so the length can stand in the pattern.
PATTERNS = {
    "assign": (_assigned("password", "passwd", "secret", "token", "api_?key"), True, "secret"),
    "access": ("AKIA[A-Z0-9]+", False, "id"),
    "hex": ("[0-9a-f]{16,}", False, "secret"),
    "user": (_assigned("username", "user", "login", "client_id", "account"), True, "id"),
    "blob": ("[A-Za-z0-9/+]{40,}", False, "secret"),
    "endpoint": ("""https?://[^\\x00-\\x20"'<>]+""", False, "endpoint"),
}
KINDS = list(PATTERNS)
#: Text that every match of a kind holds: a cheap test before any pattern runs.
MARKER = {"access": "AKIA", "endpoint": "://"}


def _found(text: Column, kind: str) -> Column:
    """array<struct(gap, size, value)>: code points before, of, and of the value in each match."""
    pattern, has_value, _ = PATTERNS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if has_value else matches
    zipped = F.zip_with(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("match")), values, lambda a, v: F.struct(
        F.length(a["gap"]).alias("gap"), F.length(a["match"]).alias("size"), F.length(v).alias("value")))
    hit = text.contains(MARKER[kind]) if kind in MARKER else text.rlike(pattern)
    return F.when(hit, F.filter(zipped, lambda m: m["size"].isNotNull()))


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", reach: int = 400) -> DataFrame:
    """(doc_id, spans) of every row of ``docs``.

    ``spans`` is array<struct(start, rank, kind, end, strong)> by start, then kind; offsets
    count code points, the end is exclusive. A null or empty text has no spans. Repeated rows
    are scanned as rows of their own, also with a null id. Other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), *[_found(body, k).alias(k) for k in KINDS])
    rows = staged(found, "secret-matches")
    matches = None
    for rank, kind in enumerate(KINDS):
        one = rows.where(F.col(kind).isNotNull()).select("row", F.lit(rank).alias("rank"), F.posexplode(kind).alias("nth", "m"))
        matches = one if matches is None else matches.union(one)
    order = Window.partitionBy("row", "rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(order)
    spans = matches.select("row", "rank", (end - F.col("m.size")).cast("long").alias("start"), end.cast("long").alias("end"), "m.size", "m.value")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("rank") + 1)
    role = F.element_at(F.array(*[F.lit(PATTERNS[k][2]) for k in KINDS]), F.col("rank") + 1)
    strong = F.when(kind == "assign", F.col("value") >= 12).when(kind == "access", F.col("size") >= 18).otherwise(kind == "hex")
    weak = (F.when(kind == "assign", F.col("value") >= 4).when(kind == "access", F.col("size") >= 12).when(kind == "blob", F.col("size") == 40)
            .when(kind == "user", F.col("value") >= 3).otherwise(kind == "endpoint"))
    parts = spans.select("row", "start", "rank", kind.alias("kind"), "end", role.alias("role"), strong.alias("strong"), weak.alias("weak")).where("strong or weak")
    parts = staged(parts.withColumn("scope", F.floor(F.col("start") / reach)), "secret-parts")
    linked = _complemented(parts, reach).select("row", "start", "rank", "kind", "end", "strong")
    kept = parts.where("strong").select(*linked.columns).union(linked)
    per_row = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end", "strong"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,strong:boolean>>")
    return rows.select("row", "doc_id").join(per_row, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def _complemented(parts: DataFrame, reach: int) -> DataFrame:
    """The weak parts with complementary parts within ``reach``.

    A secret needs an identifier, an identifier a secret, an endpoint both. Per row and scope
    only the first and last start of each role are kept and handed to the scopes beside, so a
    row with very many parts never forms pairs.
    """
    def edges(role: str) -> list[Column]:
        at = F.when(F.col("role") == role, F.col("start"))
        return [F.min(at).alias(f"{role}_first"), F.max(at).alias(f"{role}_last")]

    scopes = parts.groupBy("row", "scope").agg(*edges("id"), *edges("secret"))
    shifted = scopes.select("row", "*", F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)])).alias("step"))

    def near(role: str) -> list[Column]:
        return [
            F.max(F.when(F.col("step") == 1, F.col(f"{role}_last"))).alias(f"{role}_before"),
            F.max((F.col("step") == 0) & F.col(f"{role}_first").isNotNull()).alias(f"{role}_here"),
            F.min(F.when(F.col("step") == -1, F.col(f"{role}_first"))).alias(f"{role}_after"),
        ]

    around = shifted.groupBy("row", (F.col("scope") + F.col("step")).alias("scope")).agg(*near("id"), *near("secret"))

    def close(role: str) -> Column:
        return (F.coalesce(F.col(f"{role}_here"), F.lit(False)) | F.coalesce(F.col("start") - F.col(f"{role}_before") <= reach, F.lit(False))
                | F.coalesce(F.col(f"{role}_after") - F.col("start") <= reach, F.lit(False)))

    needed = F.when(F.col("role") == "secret", close("id")).when(F.col("role") == "id", close("secret")).otherwise(close("id") & close("secret"))
    return parts.where("not strong").join(around, ["row", "scope"]).where(needed)


def span_text(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
