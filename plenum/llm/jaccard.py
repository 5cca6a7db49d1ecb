"""Exact n-gram Jaccard join as a recursive metric-space join.

The Jaccard distance of word-shingle sets is a metric, and two documents link when it is at
most ``r``. Every level has pivots, regions around them, and windows from the triangle
inequality that put a document into each region in which a partner within ``r`` may lie:

1. Pivots are single shingles, the nearest of a set being the first in a fixed order. A
   document within ``r`` keeps all but ``floor(r * n)`` of the ``n`` shingles, so the first
   ``floor(r * n) + 1`` of them name all regions needed. (Pivots that are documents do not
   part a corpus: nearly all documents are at distance 1 from any of them.) Shingles of very
   many documents stand last in the order, so a passage common to them opens no region.
2. Large regions are cut by the distance to the empty set, that is by size: a window reaches
   the next class of sizes only, and a class is dealt out in blocks of bounded size.
3. In a block every document in turn is the pivot for those not reached yet. Distances are
   those of the vectors of shingle counts in cells, about one cell for eight shingles: they
   never exceed the true ones, so what they part is parted.
4. Documents that hang together so far are brought together with their whole sets, in blocks
   of bounded size again, and compared exactly in the same way.

Only forests leave a block, never all its pairs; connected components over them are the
classes. Documents with equal sets are one node throughout. Where the number of links is asked
for, every two documents of a block of step 4 are compared: each pair is in one block only, so
the sums of what each block counts lose no link and need no rows of pairs.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.common import if_small, short_batches, slices, staged
from plenum.operators.graph import connected_components

FEWEST_CELLS, MOST_CELLS, BUCKETS = 16, 1 << 15, 1 << 16
#: Documents and shingles of one block, and words whose hashes a task remembers.
BLOCK, BLOCK_SHINGLES, REMEMBERED = 1 << 14, 1 << 22, 500_000
#: One region of so many is compared first.
EARLY = 16
#: A bucket of shingles is common when its count exceeds the mean of all by this many deviations and documents.
COMMON_SIGMAS, COMMON_LEAST = 10, 500

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)


class _Words(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, n: int, known: dict) -> np.ndarray:
    """The sorted distinct 63-bit hashes of the word n-grams of a text, A-Z lower-cased.

    Fewer than ``n`` words are one shingle; no words are none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for j in range(width):
        out = _mixed(out * _A + h[j : len(h) - width + 1 + j])
    return np.unique((out >> np.uint64(1)).astype(np.int64))


def set_id(s: np.ndarray) -> int:
    """A 63-bit hash of a set; equal sets are one node."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) >> 1


def cells(s: np.ndarray) -> np.ndarray:
    """Shingles per cell, at most 255: neither folding nor the bound ever enlarges a difference.

    The number of cells is a power of two near an eighth of the set. Documents that may link
    differ by one power at most; the longer vector is then folded.
    """
    count = min(max(1 << (len(s) // 8).bit_length(), FEWEST_CELLS), MOST_CELLS)
    return np.minimum(np.bincount(s & (count - 1), minlength=count), 255).astype(np.uint8)


def folded(v: np.ndarray) -> np.ndarray:
    """A vector in half as many cells: what stands in cell c and c + half together."""
    half = v.shape[-1] // 2
    return np.minimum(v[..., :half].astype(np.int16) + v[..., half:], 255)


def buckets(s: np.ndarray) -> np.ndarray:
    return (s >> 20) & (BUCKETS - 1)


def spare(n: int, percent: int) -> int:
    """How many of ``n`` shingles a document may lack and still link with another."""
    return n - (percent * n + 99) // 100


class Region:
    """Documents compared with each other; grows into a forest of what hangs together."""

    def __init__(self, nodes: np.ndarray, sizes: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray], percent: int):
        self.nodes, self.sizes, self.near, self.percent = nodes, sizes.astype(np.int64), near, percent

    def forest(self, left: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Edges of a spanning forest; with ``left`` (a mask) only pairs across the mask count."""
        out, order = [], np.argsort(self.sizes, kind="stable")
        waiting = np.ones(len(order), dtype=bool)
        for start in order:
            if not waiting[start]:
                continue
            waiting[start] = False
            front = [start]
            while front:
                pivot = front.pop()
                low, high = self.percent * self.sizes[pivot], 100 * self.sizes[pivot]
                rest = np.flatnonzero(waiting & (100 * self.sizes >= low) & (self.percent * self.sizes <= high))
                if left is not None:
                    rest = rest[left[rest] != left[pivot]]
                if not len(rest):
                    continue
                hit = rest[self.near(pivot, rest)]
                waiting[hit] = False
                front.extend(hit.tolist())
                out += [(int(self.nodes[pivot]), int(self.nodes[i])) for i in hit]
        return out

    def counted(self, copies: np.ndarray, left: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Edges of a spanning forest, and for every document the copies of all its partners; every pair is compared once."""
        out, links = [], np.zeros(len(self.sizes), dtype=np.int64)
        order, label = np.argsort(self.sizes, kind="stable"), np.arange(len(self.sizes))
        ends = np.searchsorted(self.percent * self.sizes[order], 100 * self.sizes[order], side="right")
        for at, pivot in enumerate(order):
            rest = order[at + 1 : ends[at]]
            if left is not None:
                rest = rest[left[rest] != left[pivot]]
            if not len(rest):
                continue
            hit = rest[self.near(pivot, rest)]
            links[pivot] += copies[hit].sum()
            links[hit] += copies[pivot]
            others = hit[label[hit] != label[pivot]]
            if len(others):
                joined, first = np.unique(label[others], return_index=True)
                out += [(int(self.nodes[pivot]), int(self.nodes[i])) for i in others[first]]
                label[np.isin(label, joined)] = label[pivot]
        return out, links


def _by_cells(vectors: list[np.ndarray], sizes: np.ndarray, percent: int):
    """Can the distance be at most r? True where the counts by cell do not rule it out."""
    sizes, width = sizes.astype(np.int64), np.array([len(v) for v in vectors])
    tables, place = {}, {}
    for w in np.unique(width):
        own, wider = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        rows = [np.stack([vectors[i] for i in own]).astype(np.int16)]
        if len(wider):
            rows.append(folded(np.stack([vectors[i] for i in wider])))
        tables[w], place[w] = np.concatenate(rows), np.full(len(vectors), -1)
        place[w][np.concatenate((own, wider))] = np.arange(len(own) + len(wider))

    def near(pivot: int, rest: np.ndarray) -> np.ndarray:
        w, ok = width[pivot], np.zeros(len(rest), dtype=bool)
        for at in (w, w // 2):
            part = np.flatnonzero(width[rest] >= w) if at == w else np.flatnonzero(width[rest] == at)
            if len(part):
                table, where = tables[at], place[at]
                apart = np.abs(table[where[rest[part]]] - table[where[pivot]]).sum(axis=1, dtype=np.int64)
                ok[part] = apart * (100 + percent) <= (100 - percent) * (sizes[rest[part]] + sizes[pivot])
        return ok

    return near


def _by_sets(sets: list[np.ndarray], percent: int):
    """Exact: 100 * |a and b| >= percent * |a or b|."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    maybe = _by_cells([cells(s) for s in sets], sizes, percent)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    mark = np.zeros(int(ids.max()) + 1, dtype=np.int32)

    def near(pivot: int, rest: np.ndarray) -> np.ndarray:
        ok = maybe(pivot, rest)
        some = rest[ok]
        ok[ok] = overlaps(pivot, some) if len(some) else False
        return ok

    def overlaps(pivot: int, rest: np.ndarray) -> np.ndarray:
        own = ids[ends[pivot] : ends[pivot + 1]]
        mark[own] = 1
        if 8 * len(rest) > len(sizes):  # no set is empty, so every sum has a run of its own
            both = np.add.reduceat(mark[ids], ends[:-1])[rest].astype(np.int64)
        else:
            both = np.fromiter((mark[ids[ends[i] : ends[i + 1]]].sum() for i in rest), dtype=np.int64, count=len(rest))
        mark[own] = 0
        return 100 * both >= percent * (sizes[rest] + sizes[pivot] - both)

    return near


def _pair_by_cells(a: tuple, b: tuple, percent: int) -> bool:
    """The test of ``_by_cells`` for two documents (node, size, cells, ...) alone."""
    (_, m, u, *_), (_, n, v, *_) = a, b
    if 100 * min(m, n) < percent * max(m, n):
        return False
    u, v = np.frombuffer(u, dtype=np.uint8), np.frombuffer(v, dtype=np.uint8)
    if len(u) != len(v):
        u, v = (folded(u), v) if len(u) > len(v) else (u, folded(v))
    apart = int(np.abs(u.astype(np.int16) - v).sum(dtype=np.int64))
    return apart * (100 + percent) <= (100 - percent) * (m + n)


def _batches(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def describe(texts: DataFrame, n: int) -> DataFrame:
    """Of (doc_id, text, hash): rows (doc_id, hash, n_shingles, node, cells), and per task counts of shingles by bucket.

    Rows of the second kind have a bucket and a count in place of a document.
    """
    kinds = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}
    id_kind = dict(texts.dtypes)["doc_id"]
    schema = pa.schema([("doc_id", kinds[id_kind]), ("hash", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("cells", pa.binary()), ("bucket", pa.int32()), ("uses", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, uses, seen = _Words(), np.zeros(BUCKETS, dtype=np.int64), set()
        for batch in slices(batches):
            rows = []
            for doc_id, text, code in zip(*(batch[i].to_pylist() for i in range(3)), strict=True):
                s = shingles(text, n, known)
                node = set_id(s)
                if len(s) and node not in seen:
                    seen.add(node)
                    uses += np.bincount(buckets(s), minlength=BUCKETS)
                rows.append((doc_id, code, len(s), node, cells(s).tobytes(), None, None))
            yield _batches(rows, schema)
        used = np.flatnonzero(uses)
        yield _batches([(None, None, None, None, None, int(b), int(uses[b])) for b in used], schema)

    return texts.select("doc_id", "text", "hash").mapInArrow(run, f"doc_id {id_kind}, hash long, n_shingles long, node long, cells binary, bucket int, uses long")


def pivots(texts: DataFrame, n: int, percent: int, common: np.ndarray) -> DataFrame:
    """(pivot, node): every set in the regions of its first shingles; a task names a set once."""
    schema = pa.schema([("pivot", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, stands_last = _Words(), set(), np.zeros(BUCKETS, dtype=bool)
        stands_last[common] = True
        for batch in slices(batches):
            found, owners = [], []
            for text in batch[0].to_pylist():
                s = shingles(text, n, known)
                node = set_id(s)
                if not len(s) or node in seen:
                    continue
                seen.add(node)
                if len(common):
                    late = stands_last[buckets(s)]
                    s = np.concatenate((s[~late], s[late]))
                first = s[: spare(len(s), percent) + 1]
                found.append(first)
                owners.append(np.full(len(first), node, dtype=np.int64))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(owners))], schema=schema)

    return texts.select("text").mapInArrow(run, "pivot long, node long")


def blocks(members: DataFrame, percent: int) -> DataFrame:
    """Put (region, node, size, all, load, ...) into blocks: adds tile, half.

    ``all`` and ``load`` are the documents and shingles of the region. One that fits a block is
    a single tile. Documents of a larger one stand in classes of size, each just over
    ``100 / percent`` times the one before, so partners are in one class or in neighbouring
    ones. A class is dealt out by the hash of the node into slots of about half a block, and
    every two slots that may hold partners are a tile; ``half`` tells its two slots apart and
    is null when they are one.
    """
    keys = [c for c in members.columns if c not in ("all", "load")]
    fits = (F.col("all") <= BLOCK) & (F.col("load") <= BLOCK_SHINGLES)
    one = members.where(fits).select(*keys, F.lit("").alias("tile"), F.lit(None).cast("boolean").alias("half"))
    level = F.floor(F.log(F.col("size").cast("double")) / F.lit(1.0001 * math.log(100 / percent))).cast("int")
    large = members.where(~fits).withColumn("level", level)
    wanted = F.greatest(F.count("*") / F.lit(BLOCK / 2), F.sum("size") / F.lit(BLOCK_SHINGLES / 2))
    slots = large.groupBy("region", "level").agg(F.ceil(wanted).cast("int").alias("slots"))
    pairs = None
    for step in (0, 1):
        upper = slots.select("region", (F.col("level") - step).alias("level"), F.col("level").alias("up"), F.col("slots").alias("up_slots"))
        found = slots.join(upper, ["region", "level"]).select("region", F.col("level").alias("low"), "up", F.col("slots").alias("low_slots"), "up_slots")
        pairs = found if pairs is None else pairs.union(found)
    mine = pairs.select("region", F.col("low").alias("level"), "low", "up", F.col("low_slots").alias("slots"), F.col("up_slots").alias("others"), F.lit(False).alias("half"))
    mine = mine.union(pairs.select("region", F.col("up").alias("level"), "low", "up", F.col("up_slots").alias("slots"), F.col("low_slots").alias("others"), F.lit(True).alias("half")))
    dealt = large.join(mine, ["region", "level"]).withColumn("slot", F.pmod(F.xxhash64("node"), F.col("slots")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    first, second = F.when(F.col("half"), F.col("other")).otherwise(F.col("slot")), F.when(F.col("half"), F.col("slot")).otherwise(F.col("other"))
    dealt = dealt.withColumns({"first": first, "second": second})
    same = F.col("low") == F.col("up")
    alone = same & (F.col("first") == F.col("second"))
    dealt = dealt.where((~same | (F.col("first") <= F.col("second"))) & ~(alone & F.col("half")))
    tile = F.concat_ws(":", "low", "up", "first", "second").alias("tile")
    return one.union(dealt.select(*keys, tile, F.when(~alone, F.col("half")).alias("half")))


def _compared(members: DataFrame, columns: list[str], keep: Callable[[tuple], tuple | None], compare: Callable[[list], Iterable[tuple[int, int]]], summed: bool = False) -> DataFrame:
    """Edges (a, b) of ``compare`` over every (region, tile); many small ones share a task.

    ``keep`` turns a row into what is held in memory until its tile is complete. With ``summed``
    ``compare`` gives numbers by (a, b), where b may be null, and rows are (a, b, n) with sums by task.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), *([("n", pa.int64())] if summed else [])])

    def rows_of(done: set | Counter) -> list[tuple]:
        return [(*pair, n) for pair, n in done.items()] if summed else sorted(done)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = Counter if summed else set
        at, held, done = None, [], kind()
        for batch in slices(batches):
            data = [batch[i].to_pylist() for i in range(batch.num_columns)]
            for row in zip(*data, strict=True):
                if (row[0], row[1]) != at:
                    if len(held) > 1:
                        done.update(compare(held))
                    at, held = (row[0], row[1]), []
                if (kept := keep(row[2:])) is not None:
                    held.append(kept)
            if len(done) >= 100_000:
                yield _batches(rows_of(done), schema)
                done = kind()
        if len(held) > 1:
            done.update(compare(held))
        yield _batches(rows_of(done), schema)

    dealt = members.select("region", "tile", *columns).repartition("region", "tile").sortWithinPartitions("region", "tile")
    return dealt.mapInArrow(run, "a long, b long, n long" if summed else "a long, b long")


def _halves(flags: list) -> np.ndarray | None:
    return None if flags[0] is None else np.array(flags, dtype=bool)


def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85, links: bool = False) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, class, component_id) of every row of ``docs``.

    Documents link when ``100 * intersection >= percent * union`` of their sets of word
    n-grams; ``component_id`` is the smallest id that links reach, the own one included. Empty
    and null texts have no shingles and link with nothing. Equal sets share ``node``, linked ones ``class``. Repeated
    rows are rows of their own; null ids are never the smallest unless all are. Other columns
    are ignored. Sets and shingles are told apart by 63-bit hashes. ``percent`` is 50 or more.

    With ``links`` there is also ``n_links``: how many other rows a row links with, those with an equal set included.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent is 50 to 100")
    with short_batches(docs.sparkSession):
        return _classes(docs, doc_id, text, n, percent, links)


def _classes(docs: DataFrame, doc_id: str, text: str, n: int, percent: int, counting: bool) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("hash"))
    described = staged(describe(texts, n), "jaccard-sets")
    light = described.where("node is not null").select("doc_id", "hash", "n_shingles", "node")
    uses = described.where("bucket is not null").groupBy("bucket").agg(F.sum("uses").alias("uses"))
    mean = (uses.agg(F.sum("uses")).first()[0] or 0) / BUCKETS
    limit = mean + max(COMMON_SIGMAS * math.sqrt(mean), COMMON_LEAST)
    common = np.array([r["bucket"] for r in uses.where(F.col("uses") > limit).select("bucket").collect()], dtype=np.int64)
    named = F.min(F.struct("doc_id", "hash"))
    nodes = staged(described.where("n_shingles > 0").groupBy("node").agg(
        named.alias("named"), F.min("n_shingles").alias("size"), F.min("cells").alias("cells"), F.count("*").alias("copies")), "jaccard-nodes")

    regions = pivots(texts, n, percent, common).repartition("pivot").dropDuplicates(["pivot", "node"])
    here = Window.partitionBy("region")
    shared = regions.select(F.col("pivot").alias("region"), "node").withColumn("all", F.count("*").over(here)).where(F.col("all") > 1)
    shared = staged(shared, "jaccard-regions")

    def loosely(held: list) -> list[tuple[int, int]]:
        if len(held) == 2 and held[0][3] is None:
            return [tuple(sorted((held[0][0], held[1][0])))] if _pair_by_cells(*held, percent) else []
        ids, sizes, packed, flags = zip(*held, strict=True)
        sizes = np.array(sizes)
        vectors = [np.frombuffer(p, dtype=np.uint8) for p in packed]
        return [tuple(sorted(p)) for p in Region(np.array(ids), sizes, _by_cells(vectors, sizes, percent), percent).forest(_halves(flags))]

    def compared(some: DataFrame) -> DataFrame:
        members = some.withColumn("load", F.lit(0)).join(nodes.select("node", "size", "cells"), "node")
        return _compared(blocks(members, percent), ["node", "size", "cells", "half"], lambda row: row, loosely).distinct()

    # A share of the regions shows what hangs together; of the others only those are compared
    # whose documents do not hang together yet.
    early = F.pmod(F.col("region"), F.lit(EARLY)) == 0
    first = staged(compared(shared.where(early)), "jaccard-early")
    known_groups = staged(connected_components(first).select("node", "component"), "jaccard-early-groups")
    rest = shared.where(~early).join(known_groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
    rest = rest.withColumns({"low": F.min("group").over(here), "high": F.max("group").over(here)}).where("low <> high")
    second = compared(rest.select("region", "node", "all"))
    loose = staged(first.union(second).distinct(), "jaccard-loose")
    groups = connected_components(loose).select(F.col("component").alias("region"), "node").join(nodes.select("node", "named", "size", "copies"), "node")
    groups = staged(groups, "jaccard-groups")
    counts = groups.groupBy("region").agg(F.count("*").alias("all"), F.sum("size").alias("load"))
    cut = staged(blocks(groups.join(counts, "region"), percent), "jaccard-blocks")
    c = if_small(cut).alias("c")
    joined = texts.alias("d").join(c, F.col("d.doc_id").eqNullSafe(F.col("c.named.doc_id")) & (F.col("d.hash") == F.col("c.named.hash")))
    whole = joined.select("c.region", "c.tile", "c.node", "d.text", "c.half", "c.copies")
    known = _Words()

    def as_set(row: tuple) -> tuple | None:
        s = shingles(row[1], n, known)
        return (row[0], s, row[2], row[3]) if set_id(s) == row[0] else None

    def exactly(held: list) -> Iterable[tuple[int, int]]:
        ids, sets, flags, copies = zip(*{row[0]: row for row in held}.values(), strict=True)  # rows may be repeated
        if len(ids) < 2:
            return []
        region = Region(np.array(ids), np.array([len(s) for s in sets]), _by_sets(list(sets), percent), percent)
        if not counting:
            return [tuple(sorted(p)) for p in region.forest(_halves(flags))]
        edges, counts = region.counted(np.array(copies), _halves(flags))
        return {tuple(sorted(p)): 1 for p in edges} | {(i, None): int(c) for i, c in zip(ids, counts, strict=True) if c}

    found = _compared(whole, ["node", "text", "half", "copies"], as_set, exactly, counting)
    found = staged(found if counting else found.distinct(), "jaccard-links")
    links = found.where("b is not null").select("a", "b")
    classed = light.join(connected_components(links), "node", "left").withColumn("class", F.coalesce("component", "node"))
    smallest = classed.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("smallest"))
    own = F.when(F.col("n_shingles") > 0, F.col("smallest")).otherwise(F.col("doc_id"))
    out = classed.join(smallest, "class", "left").select("doc_id", F.col("hash").alias("text_hash"), "n_shingles", "node", "class", own.alias("component_id"))
    if not counting:
        return out
    partners = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("partners"))
    linked = nodes.select("node", "copies").join(partners, "node", "left")
    linked = linked.select("node", (F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).alias("n_links")).where("n_links > 0")
    return out.join(linked, "node", "left").select(*out.columns, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def without_copies(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, of every class of linked documents only the one with the smallest id.

    Of equal ids the smallest text hash stays, of repeated rows one; a null id stays only where
    the class has no other. Documents without words all stay.
    """
    doc_id, text = how.get("doc_id", "doc_id"), how.get("text", "text")
    found = staged(classes(docs, **how).where("n_shingles > 0").groupBy("class", "doc_id", "text_hash").agg(F.count("*").alias("copies")), "copy-classes")
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    first = found.groupBy("class").agg(F.min(key).alias("first"))
    judged = found.join(first, "class").select("copies", key.alias("key"), "first")
    gone = staged(judged.where(~F.col("key").eqNullSafe(F.col("first"))).select("key.doc_id", "key.text_hash"), "near-copies")
    body, g = F.coalesce(F.col(text), F.lit("")), if_small(gone).alias("g")
    rows = docs.select(F.struct("*").alias("doc"), F.col(doc_id).alias("id"), F.xxhash64(body).alias("code"), body.rlike(r"[^\x20\x09-\x0D]").alias("words"))
    rows = rows.join(g, F.col("id").eqNullSafe(F.col("g.doc_id")) & (F.col("code") == F.col("g.text_hash")), "left_anti")
    if (judged.where(F.col("key").eqNullSafe(F.col("first"))).agg(F.max("copies")).first()[0] or 1) > 1:
        rows = rows.where(~F.col("words")).union(rows.where("words").dropDuplicates(["id", "code"]))
    return rows.select("doc.*")
