"""Messages to clusters, merged themes and ranked poll issues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.operators import clusters as cl
from plenum.operators import messages as ms
from plenum.operators import polls as pl
from plenum.session import cut_lineage


def atomic_messages(messages: DataFrame, splitter=None) -> DataFrame:
    """Filtered and split messages; filtered ones pass through unsplit."""
    return ms.split_messages(ms.filter_messages(messages), splitter=splitter)


def discover(atoms: DataFrame, vector: str = "embedding", dims: int = 50, k: int | None = None, merge_at: float = 0.92, seed: int = 42) -> DataFrame:
    """Cluster atomic messages and merge similar clusters; opt-outs keep cluster -1.

    Reduced vectors and labels are written once: every later step reads them.
    """
    usable = atoms.where(~F.col("is_opt_out") & F.col(vector).isNotNull())
    reduced, _ = cl.reduce_pca(usable, vector, dims)
    reduced = cut_lineage(reduced)
    labelled = cut_lineage(cl.choose_clusters(reduced, "reduced", k, seed)[0])
    centres = cl.centroids(labelled, vector=vector)
    mapping = cl.merge_map(cl.similar_forest(centres, merge_at), centres)
    merged = cl.apply_merges(labelled, mapping)
    rest = atoms.where(F.col("is_opt_out") | F.col(vector).isNull()).withColumn("cluster_id", F.lit(cl.NOISE))
    return merged.unionByName(rest, allowMissingColumns=True)


def discover_texts(atoms: DataFrame, text: str = "message_text", embedder=None, **options) -> DataFrame:
    """Themes from texts alone: every distinct text gets its vector, then the messages are clustered."""
    return discover(cut_lineage(cl.attach_vectors(atoms, text, embedder)), **options)


def poll_issues(clustered: DataFrame, polls: DataFrame, configuration: str, minimum: int = 1, n: int = 3) -> DataFrame:
    """Ranked issues per poll from clustered atomic messages with a theme."""
    described = clustered.withColumn("configuration", F.lit(configuration))
    columns = ["cluster_id", "cluster_theme", "issues_summary", "detailed_analysis", "quotes"]
    maps = pl.cluster_maps(described.where(~F.col("is_opt_out")), "atomic_id", "configuration", columns)
    records = clustered.select("atomic_id", "poll_id", "phone_number", "is_opt_out").join(maps, "atomic_id", "left")
    return pl.poll_completion(polls, records, minimum, n)
