"""The numbered queries over the shared tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm import collisions, decontaminate, html_text, jaccard, language, mixing, multi_index, phrases, secrets, sharding, syncmers, toxicity, warc
from plenum.llm.common import use_short_batches
from plenum.session import ensure_checkpoint_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["strong"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.span_text(base).cast("binary"), 256).alias("base_sha256"),
                        secrets.span_text(F.col("spans")).alias("spans"))


def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.mix(table(spark, folder, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(warc.plan_records(table(spark, folder, "pages")), archive)
    records = warc.read_archives(spark, archive, keep_payload=False)
    return records.select(
        warc.page_number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_number(F.col("refers_to")).alias("refers_to"), "intact", "url",
    )


def op4_shard(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard(table(spark, folder, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "start", "end", "matched", "item_words")


def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    rows = syncmers.edited_pairs(table(spark, folder, "documents"))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), syncmers.as_text(F.col("anchors")).alias("fingerprint"),
        syncmers.as_text(F.col("edited_anchors")).alias("edited_fingerprint"), syncmers.likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        syncmers.likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )


def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.classes(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_jaccard_links(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of ``op7_jaccard_join`` with the number of links of every document."""
    return jaccard.classes(table(spark, folder, "documents"), links=True).select("doc_id", "n_shingles", "component_id", "n_links")


def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    use_short_batches(spark)
    found = html_text.extract_pages(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    use_short_batches(spark)
    docs = table(spark, folder, "documents")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    coder = language.fit_languages(docs.where(~held_out))
    rows = docs.select("doc_id", held_out.alias("held_out"), language.identify(coder, F.col("text")).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.ambiguous")


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    use_short_batches(spark)
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    lexicon = toxicity.fit_toxicity(docs, labels.where(fold_of(F.col("doc_id"), 3) != 1))
    rows = docs.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), toxicity.toxicity(lexicon, F.col("text")).alias("score"))
    return rows.select("*", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return collisions.nearest(table(spark, folder, "embeddings"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.hard_negatives(table(spark, folder, "embeddings"))


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


OP2_SQL = r"""
WITH light AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS turn
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM light GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sizes),
weighted AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM ranked),
levels AS (
  SELECT *, cap / weight AS ratio,
    (sum(source_size) OVER ()::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
targets AS (
  SELECT source, source_size, rank, least(weight * max(CASE WHEN level <= ratio THEN level END) OVER (), cap) AS target FROM levels),
queue AS (
  SELECT l.*, t.source_size, t.rank, t.target,
    sum(l.size) OVER (PARTITION BY l.source ORDER BY turn, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)::BIGINT AS reach,
    row_number() OVER () AS row
  FROM light l JOIN targets t ON l.source IS NOT DISTINCT FROM t.source),
laps AS (
  SELECT *, (reach + source_size * (lap - 1))::DOUBLE / target AS finish FROM queue, (VALUES (1), (2), (3)) AS v(lap) WHERE size > 0),
sorted AS (
  SELECT row, sum(size) OVER (ORDER BY finish, rank, turn, doc_id NULLS FIRST, size, lap ROWS UNBOUNDED PRECEDING) AS run FROM laps),
mix AS (SELECT row, count(*) AS n FROM sorted WHERE run <= (SELECT sum(size) FROM light) GROUP BY row)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(m.n, 0) AS BIGINT) AS taken
FROM queue q LEFT JOIN mix m ON q.row = m.row"""

OP3_SQL = """
WITH rows AS (
  SELECT page_id, url, coalesce(html, '') AS payload, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex
  FROM pages),
digests AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + CAST((CAST('0x' || substr(hex, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS BIGINT), 1)), '') AS payload_digest,
    row_number() OVER (PARTITION BY hex ORDER BY page_id NULLS LAST, url) AS nth,
    first_value(page_id) OVER (PARTITION BY hex ORDER BY page_id NULLS LAST, url) AS first_id
  FROM rows)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN nth > 1 THEN first_id END AS refers_to, TRUE AS intact, url
FROM digests"""

OP1_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
kinds(rank, kind, pattern, grp, role) AS (VALUES
%s),
raw AS (
  SELECT d.row, k.rank, k.kind, k.role, k.grp,
    string_split_regex(d.text, k.pattern) AS gaps, regexp_extract_all(d.text, k.pattern) AS found, regexp_extract_all(d.text, k.pattern, k.grp) AS val
  FROM docs d, kinds k WHERE regexp_matches(d.text, k.pattern)),
matches AS (
  SELECT row, rank, kind, role, unnest(range(1, len(found) + 1)) AS nth, gaps, found, val FROM raw),
spans AS (
  SELECT row, rank, kind, role, length(found[nth]) AS size, length(val[nth]) AS value,
    sum(length(gaps[nth]) + length(found[nth])) OVER (PARTITION BY row, rank ORDER BY nth ROWS UNBOUNDED PRECEDING)::BIGINT AS fin
  FROM matches),
parts AS (
  SELECT *, fin - size AS beg,
    CASE kind WHEN 'assign' THEN value >= 12 WHEN 'access' THEN size >= 18 WHEN 'hex' THEN TRUE ELSE FALSE END AS strong,
    CASE kind WHEN 'assign' THEN value >= 4 WHEN 'access' THEN size >= 12 WHEN 'blob' THEN size = 40 WHEN 'user' THEN value >= 3 WHEN 'endpoint' THEN TRUE ELSE FALSE END AS weak
  FROM spans),
used AS (SELECT * FROM parts WHERE strong OR weak),
kept AS (
  SELECT * FROM used p WHERE strong OR CASE role
    WHEN 'secret' THEN EXISTS (SELECT 1 FROM used q WHERE q.row = p.row AND q.role = 'id' AND abs(q.beg - p.beg) <= 400)
    WHEN 'id' THEN EXISTS (SELECT 1 FROM used q WHERE q.row = p.row AND q.role = 'secret' AND abs(q.beg - p.beg) <= 400)
    ELSE EXISTS (SELECT 1 FROM used q WHERE q.row = p.row AND q.role = 'id' AND abs(q.beg - p.beg) <= 400)
     AND EXISTS (SELECT 1 FROM used q WHERE q.row = p.row AND q.role = 'secret' AND abs(q.beg - p.beg) <= 400) END),
texts AS (
  SELECT row, count(*) FILTER (strong AND kind = 'assign') AS n_assign, count(*) FILTER (strong AND kind = 'access') AS n_access,
    count(*) FILTER (strong AND kind = 'hex') AS n_hex,
    string_agg(kind || ':' || beg || ':' || fin, ',' ORDER BY beg, rank) FILTER (strong) AS base,
    string_agg(kind || ':' || beg || ':' || fin, ',' ORDER BY beg, rank) AS spans
  FROM kept GROUP BY row)
SELECT d.doc_id, coalesce(t.n_assign, 0) AS n_assign, coalesce(t.n_access, 0) AS n_access, coalesce(t.n_hex, 0) AS n_hex,
  sha256(coalesce(t.base, '')) AS base_sha256, coalesce(t.spans, '') AS spans
FROM docs d LEFT JOIN texts t ON d.row = t.row""" % ",\n".join(
    "  ({}, '{}', '{}', {}, '{}')".format(rank, kind, pattern.replace("'", "''"), int(value), role)
    for rank, (kind, (pattern, value, role)) in enumerate(secrets.PATTERNS.items()))

OP5_SQL = r"""
WITH doc AS (
  SELECT doc_id, md5(coalesce(text, '')) AS hash, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
item AS (
  SELECT item_id, w, len(w) AS n FROM (
    SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark) WHERE len(w) >= 5),
doc_word AS (SELECT DISTINCT doc_id, hash, unnest(range(0, len(w))) AS place, unnest(w) AS word FROM doc),
item_word AS (SELECT item_id, n, unnest(range(0, n)) AS place, unnest(w) AS word FROM item),
equal AS (
  SELECT d.doc_id, d.hash, i.item_id, i.n, d.place - i.place AS shift, i.place AS at FROM doc_word d JOIN item_word i USING (word)),
likely AS (
  SELECT doc_id, hash, item_id, shift, count(*) AS matched FROM equal GROUP BY ALL HAVING count(*) >= ceil(0.75 * least(12, any_value(n)))),
windows AS (
  SELECT e.*, l.matched, count(*) OVER (PARTITION BY e.doc_id, e.hash, e.item_id, e.shift ORDER BY e.at RANGE BETWEEN CURRENT ROW AND 11 FOLLOWING) AS inside
  FROM equal e JOIN likely l ON e.doc_id IS NOT DISTINCT FROM l.doc_id AND e.hash = l.hash AND e.item_id = l.item_id AND e.shift = l.shift),
good AS (
  SELECT DISTINCT doc_id, hash, item_id, shift, matched, n FROM windows WHERE inside >= ceil(0.75 * least(12, n))),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, hash, item_id ORDER BY matched DESC, shift) AS nth FROM good)
SELECT doc_id, item_id, CAST(greatest(shift, 0) AS INTEGER) AS start, CAST(shift + n AS INTEGER) AS "end", CAST(matched AS INTEGER) AS matched, CAST(n AS INTEGER) AS item_words
FROM best WHERE nth = 1"""

OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT row, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words),
members AS (SELECT row, unnest(s) AS g FROM sets),
common AS (SELECT g FROM members GROUP BY g HAVING count(*) > 1),
shared AS (
  SELECT a.row AS x, b.row AS y, count(*) AS n FROM members a JOIN members b ON a.g = b.g AND a.row < b.row
  WHERE a.g IN (SELECT g FROM common) GROUP BY ALL),
links AS (
  SELECT x, y FROM shared o JOIN sets a ON a.row = x JOIN sets b ON b.row = y
  WHERE 100 * n >= 85 * (len(a.s) + len(b.s) - n)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT row, row FROM sets UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles,
  CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE (SELECT min(t.doc_id) FROM reach r JOIN sets t ON t.row = r.y WHERE r.x = s.row) END AS component_id
FROM sets s"""

OP7_LINKS_SQL = OP7_SQL.replace("AS component_id\nFROM sets s", """AS component_id, coalesce(l.n, 0) AS n_links
FROM sets s LEFT JOIN (SELECT x, count(*) AS n FROM edges GROUP BY x) l ON l.x = s.row""")

OP11_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON c.vec_id IS DISTINCT FROM q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 10"""

OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id IS DISTINCT FROM b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other NULLS LAST) <= 5)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other NULLS LAST) AS INTEGER) AS rank,
  n.other AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY rank <= 3"""

OP13_SQL = r"""
WITH pieces AS (
  SELECT lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, coalesce(text, '') AS text FROM documents)),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (VALUES (1), (2), (3), (4)) AS v(m)) GROUP BY ALL),
found AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, f AS a FROM grams WHERE m > 1 AND f >= 30),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS one, array_to_string(w[k + 1:m], ' ') AS two
  FROM (SELECT *, unnest(range(1, m)) AS k FROM found)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, 2000000::HUGEINT * c.a // (x.f + y.f) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = c.one JOIN grams y ON y.lang = c.lang AND y.phrase = c.two),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS f
  FROM (SELECT lang, w, a, s, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM found)) GROUP BY ALL),
kept AS (
  SELECT w.* FROM worst w LEFT JOIN longer o ON o.lang = w.lang AND o.phrase = w.phrase
  WHERE o.f IS NULL OR 100::HUGEINT * o.f < 80::HUGEINT * w.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept k JOIN totals t ON t.lang = k.lang QUALIFY rank <= 2000"""

QUERIES = {
    "op1_secrets": (op1_secrets, OP1_SQL),
    "op5_decontaminate": (op5_decontaminate, OP5_SQL),
    "op6_fingerprints": (op6_fingerprints, None),
    "op2_mix_sources": (op2_mix_sources, OP2_SQL),
    "op3_warc": (op3_warc, OP3_SQL),
    "op4_shard": (op4_shard, None),
    "op7_jaccard_join": (op7_jaccard_join, OP7_SQL),
    "op8_main_text": (op8_main_text, None),
    "op9_language": (op9_language, None),
    "op10_toxicity": (op10_toxicity, None),
    "op11_nearest": (op11_nearest, OP11_SQL),
    "op12_hard_negatives": (op12_hard_negatives, OP12_SQL),
    "op13_phrases": (op13_phrases, OP13_SQL),
}
#: Further queries of an operator, after the one of each number.
MORE_QUERIES = {"op7_jaccard_links": (op7_jaccard_links, OP7_LINKS_SQL)}
