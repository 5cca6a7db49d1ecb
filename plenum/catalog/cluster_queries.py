"""Queries on clusters: metrics, choice of k, merging and density clusters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.catalog import views as v
from plenum.functions.vectors import best_vector, dot
from plenum.operators import clusters as cl
from plenum.operators import polls as pl
from plenum.operators.text_vectors import text_vectors
from plenum.plans import theme_discovery as td
from plenum.session import cut_lineage

# sums per label and dimension: what every closed form below starts from
SUMS = """unit AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings),
  cells AS (SELECT label, unnest(e) AS e, unnest(u) AS u, generate_subscripts(u, 1) AS i FROM unit),
  sums AS (SELECT label, i, sum(e) AS se, sum(u) AS su FROM cells GROUP BY ALL), sizes AS (SELECT label, count(*) AS n FROM unit GROUP BY 1),
  centre AS (SELECT label, list(se / z ORDER BY i) AS c, list(su ORDER BY i) AS su FROM sums JOIN (SELECT label, sqrt(sum(se * se)) AS z FROM sums GROUP BY 1) USING (label) GROUP BY label)"""


def labelled(spark, d):
    return v.table(spark, d, "embeddings").withColumnRenamed("label", "cluster_id")


def _within(spark, d):
    w = cl.within_cluster_distance(labelled(spark, d))
    return w.select("cluster_id", "n", F.round("wcscd", 5).alias("wcscd"))


# every pair, to check the closed form against its definition
WITHIN = f"""WITH {SUMS} SELECT a.label AS cluster_id, any_value(n) AS n, round(sum(CASE WHEN a.vec_id < b.vec_id THEN 1 - list_inner_product(a.u, b.u) ELSE 0 END), 5) AS wcscd
  FROM unit a JOIN unit b USING (label) JOIN sizes USING (label) GROUP BY a.label"""


def _ratio(spark, d):
    r = cl.between_within_ratio(labelled(spark, d))
    return r.select(*[F.round(c, 5).alias(c) for c in r.columns])


RATIO = f"""WITH {SUMS}, b AS (SELECT sum(1 - list_inner_product(x.c, y.c)) AS between_distance FROM centre x JOIN centre y ON x.label < y.label),
  w AS (SELECT sum(1 - list_inner_product(u, c)) AS within_distance FROM unit JOIN centre USING (label))
  SELECT round(between_distance, 5) AS between_distance, round(within_distance, 5) AS within_distance, round(between_distance / within_distance, 5) AS between_within_ratio FROM b, w"""


def _silhouette(spark, d):
    return cl.silhouette_rows(labelled(spark, d)).select(F.round("silhouette", 6).alias("silhouette"))


SILHOUETTE = f"""WITH {SUMS}, m AS (SELECT a.vec_id, a.label, b.label AS other, sum(1 - list_inner_product(a.u, b.u)) AS s, count(*) AS n FROM unit a, unit b GROUP BY ALL),
  p AS (SELECT vec_id, max(CASE WHEN label = other THEN s / (n - 1) END) AS a, min(CASE WHEN label <> other THEN s / n END) AS b FROM m GROUP BY vec_id)
  SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM p"""


def _sizes(spark, d):
    s = cl.cluster_sizes(labelled(spark, d))
    return s.withColumns({c: F.round(c, 6) for c in ("mean_size", "std_size", "cv")})


SIZES = """SELECT count(*) AS n_clusters, min(n) AS min_size, max(n) AS max_size, round(avg(n), 6) AS mean_size, round(stddev_pop(n), 6) AS std_size, round(stddev_pop(n) / avg(n), 6) AS cv
  FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)"""


def _centroids(spark, d):
    c = cl.centroids(labelled(spark, d))
    return c.select("cluster_id", "n", F.round(dot("centroid", "centroid"), 6).alias("squared_norm"), F.round(F.get("centroid", F.lit(0)), 6).alias("first"), F.round(F.get("centroid", F.lit(63)), 6).alias("last"))


CENTROIDS = f"WITH {SUMS} SELECT label AS cluster_id, n, 1.0::DOUBLE AS squared_norm, round(c[1], 6) AS first, round(c[64], 6) AS last FROM centre JOIN sizes USING (label)"
PAIRS_AT = 0.2


def _pairs(spark, d):
    p = cl.similar_pairs(cl.centroids(labelled(spark, d)), PAIRS_AT)
    return p.select("a", "b", F.round("similarity", 6).alias("similarity"))


PAIRS_SQL = f"""{SUMS}, pairs AS (SELECT x.label AS a, y.label AS b, round(list_inner_product(x.c, y.c), 9) AS s FROM centre x JOIN centre y ON x.label < y.label WHERE round(list_inner_product(x.c, y.c), 9) >= {PAIRS_AT})"""


def mapping(spark, d):
    centres = cl.centroids(labelled(spark, d))
    return cl.merge_map(cl.similar_forest(centres, PAIRS_AT), centres)


MERGES = f"""RECURSIVE {PAIRS_SQL}, edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
  reach AS (SELECT a AS node, a AS other FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other),
  component AS (SELECT node, min(other) AS component FROM reach GROUP BY 1),
  target AS (SELECT component, arg_max(node, n * 1000 - node) AS target FROM component JOIN sizes ON label = node GROUP BY 1),
  mapping AS (SELECT node AS label, target FROM component JOIN target USING (component))"""


def _merged(spark, d):
    return cl.apply_merges(labelled(spark, d), mapping(spark, d))


def _apply(spark, d):
    m = _merged(spark, d)
    return m.select("vec_id", "cluster_id", "original_cluster_id", "merged_cluster_id", F.array_join(F.transform("merge_source_clusters", lambda x: x.cast("string")), ",").alias("sources"))


APPLY = f"""WITH {MERGES}, src AS (SELECT target, string_agg(label::VARCHAR, ',' ORDER BY label) AS sources FROM mapping GROUP BY 1)
  SELECT vec_id, coalesce(target, label) AS cluster_id, label AS original_cluster_id, CASE WHEN target <> label THEN target END AS merged_cluster_id, CASE WHEN target <> label THEN sources END AS sources
  FROM embeddings LEFT JOIN mapping USING (label) LEFT JOIN src USING (target)"""


def _report(spark, d):
    r = cl.merge_report(_merged(spark, d))
    return r.withColumns({c: F.round(c, 6) for c in ("average_merge", "average_cluster_size", "reduction_pct")})


REPORT = f"""WITH {MERGES}, t AS (SELECT coalesce(target, label) AS c, count(DISTINCT label) AS s, count(*) AS n FROM embeddings LEFT JOIN mapping USING (label) GROUP BY 1)
  SELECT sum(s)::BIGINT AS original_clusters, count(*) AS final_clusters, count(*) FILTER (s > 1) AS merge_groups, max(s) FILTER (s > 1) AS largest_merge, round(avg(s) FILTER (s > 1), 6) AS average_merge,
  round(avg(n), 6) AS average_cluster_size, round((sum(s) - count(*)) * 100.0::DOUBLE / sum(s), 6) AS reduction_pct FROM t"""


def _merge_themes(spark, d):
    base = labelled(spark, d).groupBy("cluster_id").agg(F.count("*").alias("total_mentions"), F.countDistinct("vec_id").alias("unique_respondents"))
    c = F.col("cluster_id").cast("string")
    themes = base.select("cluster_id", "total_mentions", "unique_respondents", F.concat(F.lit("theme "), c).alias("theme"),
                         F.array(F.lit("shared quote"), F.concat(F.lit("quote "), c)).alias("quotes"), F.array(F.lit("topic"), F.concat(F.lit("topic "), c)).alias("key_topics"))
    m = pl.merge_themes(themes, mapping(spark, d))
    return m.withColumns({"quotes": F.array_join("quotes", "|"), "key_topics": F.array_join("key_topics", "|"), "avg_mentions_per_respondent": F.round("avg_mentions_per_respondent", 6)})


MERGE_THEMES = f"""WITH {MERGES}, t AS (SELECT label, n, coalesce(target, label) AS target FROM sizes LEFT JOIN mapping USING (label)),
  o AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY label <> target, label) AS pos FROM t)
  SELECT target AS cluster_id, 'theme ' || target AS theme, sum(n)::BIGINT AS total_mentions, sum(n)::BIGINT AS unique_respondents, 1.0::DOUBLE AS avg_mentions_per_respondent,
  'shared quote|' || string_agg('quote ' || label, '|' ORDER BY pos) FILTER (pos <= 4) AS quotes, 'topic|' || string_agg('topic ' || label, '|' ORDER BY pos) FILTER (pos <= 9) AS key_topics FROM o GROUP BY target"""


def _score_k(spark, d):
    """Scoring of several groupings of the same vectors: by label and by coarser labels."""
    e = v.table(spark, d, "embeddings")
    out, n = None, e.count()
    for k in (2, 3, 5, 10):
        g = e.select("embedding", F.pmod("label", F.lit(k)).alias("cluster_id"))
        row = cl.grouping_metrics(g).withColumn("k", F.lit(k))
        out = row if out is None else out.unionByName(row)
    return cl.score_k(out, n).select("k", "separation", "cohesion", "balance", "score")


def _score_sql() -> str:
    parts = []
    for k in (2, 3, 5, 10):
        parts.append(f"""SELECT {k} AS k, * FROM (
          WITH unit AS (SELECT vec_id, label % {k} AS label, embedding::DOUBLE[] AS e, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings),
          cells AS (SELECT label, unnest(e) AS e, generate_subscripts(e, 1) AS i FROM unit), sums AS (SELECT label, i, sum(e) AS se FROM cells GROUP BY ALL), sizes AS (SELECT label, count(*) AS n FROM unit GROUP BY 1),
          centre AS (SELECT label, list(se / z ORDER BY i) AS c FROM sums JOIN (SELECT label, sqrt(sum(se * se)) AS z FROM sums GROUP BY 1) USING (label) GROUP BY label),
          b AS (SELECT sum(1 - list_inner_product(x.c, y.c)) AS bd FROM centre x JOIN centre y ON x.label < y.label), w AS (SELECT sum(1 - list_inner_product(u, c)) AS wd FROM unit JOIN centre USING (label)),
          m AS (SELECT a.vec_id, a.label, b.label AS other, sum(1 - list_inner_product(a.u, b.u)) AS s, count(*) AS n FROM unit a, unit b GROUP BY ALL),
          p AS (SELECT vec_id, max(CASE WHEN label = other THEN s / (n - 1) END) AS a, min(CASE WHEN label <> other THEN s / n END) AS b FROM m GROUP BY vec_id),
          sil AS (SELECT avg((b - a) / greatest(a, b)) AS silhouette FROM p), sz AS (SELECT stddev_pop(n) / avg(n) AS cv, max(n) / sum(n) * 100 AS share FROM sizes)
          SELECT bd / wd AS bw, silhouette, cv, share FROM b, w, sil, sz)""")
    return f"""WITH metrics AS ({' UNION ALL '.join(parts)}), scored AS (SELECT k,
      CASE WHEN bw >= 50 THEN 50 WHEN bw >= 20 THEN 45 WHEN bw >= 10 THEN 40 WHEN bw >= 5 THEN 35 WHEN bw >= 3 THEN 30 WHEN bw >= 2 THEN 25 WHEN bw >= 1.5 THEN 15 WHEN bw >= 1 THEN 5 ELSE 0 END AS separation,
      CASE WHEN silhouette >= 0.8 THEN 30 WHEN silhouette >= 0.7 THEN 25 WHEN silhouette >= 0.6 THEN 20 WHEN silhouette >= 0.5 THEN 15 WHEN silhouette >= 0.4 THEN 10 ELSE 5 END AS cohesion,
      CASE WHEN cv < 0.3 THEN 10 WHEN cv < 0.5 THEN 7 WHEN cv < 0.7 THEN 5 WHEN cv < 1 THEN 3 ELSE 0 END + CASE WHEN share < 20 THEN 10 WHEN share < 30 THEN 7 WHEN share < 40 THEN 5 WHEN share < 50 THEN 3 ELSE 0 END AS balance FROM metrics)
      SELECT k, separation, cohesion, balance, separation + cohesion + balance AS score FROM scored"""


def _density(spark, d):
    return cl.density_clusters(labelled(spark, d).drop("cluster_id").withColumn("category", F.col("vec_id") % 3), ["category"], "vec_id", "embedding", 0.75).select("vec_id", F.col("cluster_id").alias("density_cluster"))


DENSITY = """WITH RECURSIVE e AS (SELECT vec_id, vec_id % 3 AS category, embedding::DOUBLE[] AS v FROM embeddings),
  near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b USING (category) WHERE a.vec_id <> b.vec_id AND round(list_cosine_similarity(a.v, b.v), 9) >= 0.75),
  core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 2), links AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
  reach AS (SELECT id AS node, id AS other FROM core UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
  comp AS (SELECT node AS id, min(other) AS c FROM reach GROUP BY 1),
  border AS (SELECT a AS id, min(b) AS core FROM near WHERE a NOT IN (SELECT id FROM core) AND b IN (SELECT id FROM core) GROUP BY a),
  labels AS (SELECT * FROM comp UNION ALL SELECT border.id, c FROM border JOIN comp ON comp.id = core), sized AS (SELECT c FROM labels GROUP BY c HAVING count(*) >= 3)
  SELECT vec_id, coalesce(l.c, -1) AS density_cluster FROM e LEFT JOIN (SELECT * FROM labels WHERE c IN (SELECT c FROM sized)) l ON l.id = vec_id"""


def _kmeans(spark, d):
    """Bisecting k-means on centred components; sizes and metrics of the result."""
    reduced, _ = cl.reduce_pca(v.table(spark, d, "embeddings"), dims=16)
    out = cl.cluster_k(reduced, 10, "reduced", method="bisecting")
    return cl.attach_row(cl.cluster_sizes(out), cl.between_within_ratio(out, vector="reduced"))


def _choose_k(spark, d):
    """The chosen k of the adaptive range and its alternatives, best first; a k of the fallback stands alone."""
    reduced = cut_lineage(cl.reduce_pca(v.table(spark, d, "embeddings"), dims=16)[0])
    k, alternatives = cl.choose_k(reduced)
    chosen = cl.score_k(cl.k_metrics(reduced, [k]), reduced.count())
    ranked = [(rank, *row) for rank, row in enumerate([*chosen.collect(), *alternatives], 1)]
    return spark.createDataFrame(ranked, T.StructType([T.StructField("rank", T.IntegerType()), *chosen.schema]))


def _best_vector(spark, d):
    e = v.table(spark, d, "embeddings")
    pick = best_vector(F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 15)), F.when(F.col("vec_id") % 3 == 1, F.slice("embedding", 1, 50)), "embedding")
    return e.select("vec_id", F.size(pick).alias("dims"))


def _attach(spark, d):
    """Vectors by distinct text: the documents' vectors come from the embedding table by a text key."""
    docs, e = v.table(spark, d, "documents").select("doc_id", "text"), v.table(spark, d, "embeddings")
    texts = cl.attach_row(docs.select("text").distinct(), e.agg(F.count("*").alias("n")))
    texts = texts.select("text", F.pmod(F.length("text") * 7, F.col("n")).cast("bigint").alias("vec_id"))
    vectors = texts.join(e, "vec_id").select("text", F.col("embedding").alias("vector"))
    return cl.attach_vectors(docs, "text", vectors=vectors).select("doc_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


def _text_vectors(spark, d):
    """The first components of the vectors of all conversation texts, and how long they are."""
    texts = v.table(spark, d, "conversations").withColumn("text", F.when(F.col("turn") % 7 != 0, F.col("text")).otherwise(F.lower("text")))
    rows = text_vectors(texts)
    at = lambda i: F.round(F.get("vector", F.lit(i)).cast("double"), 4).alias(f"v{i}")
    return rows.select(F.md5("text").alias("text_md5"), *[at(i) for i in (0, 5, 37, 63)], F.round(dot("vector", "vector"), 4).alias("length"))


TEXT_VECTORS = r"""WITH t AS (SELECT DISTINCT CASE WHEN turn % 7 <> 0 THEN text ELSE lower(text) END AS text FROM conversations WHERE text IS NOT NULL),
  w AS (SELECT text, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM t),
  f AS (SELECT text, unnest(list_transform(w, lambda x: 'w:' || x)) AS feature FROM w
    UNION ALL SELECT text, unnest(list_transform(range(1, len(w)), lambda i: 'p:' || w[i] || ' ' || w[i + 1])) FROM w
    UNION ALL SELECT text, unnest(flatten(list_transform(w, lambda x: list_transform(range(1, greatest(length(x) - 2, 1) + 1), lambda i: 'c:' || substr(x, i, 3))))) FROM w),
  c AS (SELECT text, feature, count(*) AS times, md5('42/0/' || feature) AS h FROM f GROUP BY ALL),
  n AS (SELECT count(*) AS n FROM w WHERE len(w) > 0), b AS (SELECT substr(h, 1, 5) AS bucket, count(DISTINCT text) AS held FROM c GROUP BY 1),
  weighed AS (SELECT text, h, times * (ln((n + 1)::DOUBLE / (held + 1)) + 1) AS x FROM c JOIN b ON bucket = substr(h, 1, 5), n),
  s AS (SELECT text, i, sum(CASE WHEN (CAST('0x' || substr(h, CAST(6 + 8 * (i // 32) AS BIGINT), 8) AS BIGINT) >> (i % 32)) & 1 = 1 THEN x ELSE -x END) AS v FROM weighed, range(64) AS r(i) GROUP BY ALL),
  z AS (SELECT text, sqrt(sum(v * v)) AS z FROM s GROUP BY 1)
  SELECT md5(text) AS text_md5, round(any_value(v / z) FILTER (i = 0)::FLOAT::DOUBLE, 4) AS v0, round(any_value(v / z) FILTER (i = 5)::FLOAT::DOUBLE, 4) AS v5, round(any_value(v / z) FILTER (i = 37)::FLOAT::DOUBLE, 4) AS v37,
    round(any_value(v / z) FILTER (i = 63)::FLOAT::DOUBLE, 4) AS v63, 1.0::DOUBLE AS length FROM s JOIN z USING (text) GROUP BY text"""


def _text_themes(spark, d):
    """Messages clustered from their texts alone: equal texts share a cluster, every message has one."""
    m = v.messages(spark, d).where(F.trim("message_text") != "")
    atoms = m.select(F.col("message_id").alias("atomic_id"), "message_text", F.lit(False).alias("is_opt_out"))
    out = td.discover_texts(atoms, dims=16, k=12, merge_at=0.95)
    per_text = out.groupBy("message_text").agg(F.countDistinct("cluster_id").alias("clusters"), F.count("*").alias("messages"))
    return per_text.select("message_text", "clusters", "messages")


def discovered(spark, d):
    """Vector records as atomic messages, clustered and merged; every 13th is an opt-out."""
    e = v.table(spark, d, "embeddings")
    atoms = e.select(
        F.col("vec_id").alias("atomic_id"), F.concat(F.lit("poll-"), (F.col("label") % 3).cast("string")).alias("poll_id"),
        (F.col("vec_id") % 100).cast("string").alias("phone_number"), (F.col("vec_id") % 13 == 0).alias("is_opt_out"), "embedding",
    )
    return td.discover(atoms, dims=16, k=10, merge_at=0.9)


def _theme_discovery(spark, d):
    c = discovered(spark, d).select("atomic_id", "poll_id", "phone_number", "is_opt_out", "cluster_id")
    theme = F.concat(F.lit("theme "), F.col("cluster_id").cast("string"))
    quotes = F.array(F.struct(theme.alias("quote"), F.col("phone_number").alias("phone_number")))
    c = cut_lineage(c.withColumns({"cluster_theme": theme, "issues_summary": theme, "detailed_analysis": theme, "quotes": quotes}))
    out = td.poll_issues(c, c.select("poll_id").distinct(), "10", minimum=2, n=3)
    return out.select("poll_id", "total_responses", (F.size("issues") > 0).alias("has_issues"))


QUERIES = {
    "theme_discovery": (_theme_discovery, """SELECT 'poll-' || (label % 3) AS poll_id, count(DISTINCT vec_id % 100) FILTER (vec_id % 13 <> 0) AS total_responses, TRUE AS has_issues FROM embeddings GROUP BY 1"""),
    "within_cluster_distance": (_within, WITHIN),
    "between_within_ratio": (_ratio, RATIO),
    "silhouette": (_silhouette, SILHOUETTE),
    "cluster_sizes": (_sizes, SIZES),
    "centroids": (_centroids, CENTROIDS),
    "similar_cluster_pairs": (_pairs, f"WITH {PAIRS_SQL} SELECT a, b, round(s, 6) AS similarity FROM pairs"),
    "cluster_merge_map": (mapping, f"WITH {MERGES} SELECT label AS cluster_id, target FROM mapping"),
    "apply_merges": (_apply, APPLY),
    "merge_report": (_report, REPORT),
    "merge_size_histogram": (lambda s, d: cl.merge_size_histogram(_merged(s, d)), f"""WITH {MERGES}, t AS (SELECT target, count(DISTINCT label) AS clusters_merged FROM mapping GROUP BY 1)
      SELECT clusters_merged, count(*) AS occurrences FROM t WHERE clusters_merged > 1 GROUP BY 1"""),
    "merge_themes": (_merge_themes, MERGE_THEMES),
    "score_groupings": (_score_k, _score_sql()),
    "density_clusters": (_density, DENSITY),
    "text_vectors": (_text_vectors, TEXT_VECTORS),
    "text_themes": (_text_themes, f"WITH {v.messages_sql()} SELECT message_text, 1::BIGINT AS clusters, count(*) AS messages FROM messages WHERE trim(message_text) <> '' GROUP BY 1"),
    "best_vector": (_best_vector, "SELECT vec_id, (CASE vec_id % 3 WHEN 0 THEN 15 WHEN 1 THEN 50 ELSE 64 END)::INTEGER AS dims FROM embeddings"),
    "attach_vectors": (_attach, "SELECT doc_id, round(embedding[1]::DOUBLE, 6) AS first FROM documents LEFT JOIN embeddings ON vec_id = length(text) * 7 % (SELECT count(*) FROM embeddings)"),
    "bisecting_clusters": (_kmeans, None),
    "choose_k": (_choose_k, None),
}
