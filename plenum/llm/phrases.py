"""Phrase collocations by prefix-free parsing.

A document is cut into chunks where its own words say so: a chunk begins at every window of
``longest - 1`` words whose hash falls on a trigger, and runs to the end of the next such
window, so neighbours overlap by exactly that window. Equal passages give equal chunks wherever
they stand. The distinct chunks with their parse frequencies are the dictionary; phrases are
counted inside it, each occurrence times the frequency of its chunk. A phrase is counted where
it starts, and a chunk owns the starts before its closing window, so overlaps count once.

Counting takes three passes over the written dictionary, as a phrase is no more frequent than
its parts. First words and pairs are counted in hashed buckets, and buckets that reach
``least`` set bits of a table of fixed size; then, in the same way, longer phrases all of whose
pairs have their bit. Buckets only ever hold too much, so no phrase is lost. Words and phrases
with their bit are at last counted by their words themselves. What a task has counted is handed on
in packed rows, one per group of buckets or phrases, so the rows between tasks do not grow with the phrases.

Cases: null texts are empty, null languages ``und``; documents without words add nothing; an
empty table gives no rows; repeated rows count each; other columns are not read. Scores tie by
count, then by the bytes of the phrase.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import byte_chunks, short_batches, slices, staged
from plenum.operators.ranking import top_n

#: Bytes of texts that are numpy arrays at a time.
BUFFER = 1 << 20
#: Grams that a task adds up before it hands them on.
FLUSH = 1 << 20
#: Phrases that a task holds with their counts before it hands them on.
HELD = 500_000
#: Bits of the table of frequent buckets: 8 MB per length of phrase, whatever the input.
BITS = 26
#: Words of the dictionary per group of buckets.
GROUP_WORDS = 2_000_000
#: One window of words in so many is a trigger.
MODULUS = 16

_BLANK, _BREAK = 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = _BLANK
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over all 64 bits."""
    x = (x ^ (x >> _U(32))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_LETTERS = _mix(np.arange(1, 257, dtype=_U))


class Words:
    """The words of some texts as arrays: text number, piece, place in the bytes and two hashes of each word."""

    def __init__(self, texts: list[bytes]) -> None:
        raw = np.frombuffer(b"\n".join(texts).lower(), np.uint8)  # bytes.lower() changes A-Z alone
        kind = _CLASS[raw]
        inside = kind == 0
        edge = np.diff(inside.view(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        heads = np.zeros(len(raw) + 1, np.int32)
        heads[np.cumsum([len(t) + 1 for t in texts[:-1]], dtype=np.int64)] = 1
        self.text = np.cumsum(heads, dtype=np.int32)[starts]
        self.piece = np.cumsum(kind == _BREAK, dtype=np.int32)[starts]
        self.size = ends - starts
        # words with one separator each: a line break between pieces, a blank inside
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        plain = raw[keep]
        self.begin = np.cumsum(self.size + 1) - self.size - 1
        after = self.begin + self.size
        if len(starts):
            last = np.append(self.piece[1:] != self.piece[:-1], True)
            within = after < len(plain)
            plain[after[within]] = np.where(last, 10, 32)[within]
        self.bytes = plain.tobytes()
        self.hash, self.check = self._hashes(plain)

    def _hashes(self, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and exclusive or of one term per byte and place, in ranges of words of about ``BUFFER`` bytes."""
        total, check = np.zeros(len(self.size), _U), np.zeros(len(self.size), _U)
        if not len(total):
            return total, check
        cuts = np.unique(np.searchsorted(self.begin, np.arange(0, int(self.begin[-1]) + BUFFER, BUFFER)))
        for low, high in zip(cuts, [*cuts[1:], len(total)], strict=True):
            if low == high:
                continue
            size, begin = self.size[low:high], self.begin[low:high]
            first = np.cumsum(size) - size
            every = np.arange(int(size.sum()))
            powers = np.cumprod(np.full(int(size.max()), 0x2545F4914F6CDD1D, _U))
            terms = _LETTERS[plain[every + np.repeat(begin - first, size)]] * powers[every - np.repeat(first, size)]
            total[low:high] = _mix(np.add.reduceat(terms, first) + size.view(_U))
            check[low:high] = np.bitwise_xor.reduceat(terms, first)
        return total, check

def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[bytes], pa.RecordBatch]]:
    """The first column as bytes, with its batch, in parts of about ``BUFFER`` bytes."""
    for batch in slices(batches, 16_384):
        texts = batch.column(0).to_pylist()
        for low, high in byte_chunks(texts, BUFFER):
            yield texts[low:high], batch.slice(low, high - low)


def _parser(overlap: int, modulus: int) -> Callable:
    """From (text, lang) to (lang, chunk, owned): chunks and how many starts each owns."""

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, batch in _texts(batches):
            w = Words(texts)
            n = len(w.hash)
            if not n:
                continue
            room = max(n - overlap + 1, 0)
            window, whole = np.zeros(room, _U), np.zeros(n, bool)
            for j in range(overlap):
                window = _mix(window + w.hash[j: j + room])
            whole[:room] = (window % _U(modulus) == 0) & (w.text[:room] == w.text[overlap - 1: overlap - 1 + room])
            head = np.append(True, w.text[1:] != w.text[:-1])
            first = np.flatnonzero(head | whole)
            follow = np.append(first[1:], n)
            closes = np.append(head[first[1:]], True)  # the next chunk is of another text
            end = np.where(closes, follow, follow + overlap) - 1
            chunks = [w.bytes[b:e] for b, e in zip(w.begin[first].tolist(), (w.begin[end] + w.size[end]).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array(w.text[first])), pa.array(chunks, pa.binary()), pa.array((follow - first).astype(np.int32))],
                ["lang", "chunk", "owned"],
            )

    return parse


def dictionary(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 4, modulus: int = MODULUS) -> DataFrame:
    """(lang, chunk, owned, frequency): the distinct chunks of the parse, written once."""
    rows = docs.select(
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang")
    )
    chunks = rows.mapInArrow(_parser(longest - 1, modulus), "lang string, chunk binary, owned int")
    with short_batches(docs.sparkSession):
        return staged(chunks.groupBy("lang", "owned", "chunk").agg(F.count("*").alias("frequency")), "phrases-dictionary")


class Grams:
    """Phrases of some chunks: for every word the two hashes of the 1 to ``longest`` words from there."""

    def __init__(self, chunks: list[bytes], batch: pa.RecordBatch, longest: int) -> None:
        self.words = w = Words(chunks)
        langs = batch.column("lang").to_pylist()
        seeds = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in set(langs)}
        self.weight = batch.column("frequency").to_numpy()[w.text]
        sizes = np.bincount(w.text, minlength=len(chunks))
        self.owned = np.arange(len(w.text)) < (np.cumsum(sizes) - sizes + batch.column("owned").to_numpy())[w.text]
        self.hash = [_mix(w.hash + np.array([seeds[x] for x in langs], _U)[w.text])]
        self.check, self.whole = [w.check], [np.ones(len(w.text), bool)]
        for n in range(2, longest + 1):
            room = max(len(w.hash) - n + 1, 0)
            odd = _U(2 * n + 1)
            self.hash.append(self._padded(_mix(self.hash[-1][:room] + w.hash[n - 1:] * odd)))
            self.check.append(self._padded(self.check[-1][:room] * odd ^ w.check[n - 1:]))
            # the pieces of all chunks are numbered in one row, so this parts chunks too
            self.whole.append(self._padded(w.piece[:room] == w.piece[n - 1:]))

    def _padded(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.zeros(len(self.weight) - len(x), x.dtype)])

    def passing(self, n: int, pairs: np.ndarray) -> np.ndarray:
        """Phrases of ``n`` words inside a piece all of whose pairs have their bit in ``pairs``."""
        good = self.whole[n - 1].copy()
        pair = has_bit(pairs, self.hash[1]) & self.whole[1]
        for j in range(n - 1):
            good[: len(good) - j] &= pair[j:]
        return good


def has_bit(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & _U(64 * len(table) - 1)
    return (table[place >> _U(6)] >> (place & _U(63))) & _U(1) == 1


def count_type(least: int) -> type:
    """Counts matter up to ``least``: mostly one byte."""
    return np.uint8 if least < 256 else np.uint32


class _Adder:
    """Grams of a task added up per level and handed on as packed rows per group of buckets."""

    def __init__(self, groups: int, least: int) -> None:
        self.groups, self.least, self.parts, self.held = groups, least, {}, 0
        self.kind = count_type(least)

    def add(self, level: int, grams: np.ndarray, weights: np.ndarray) -> None:
        if not len(grams):
            return
        self.parts.setdefault(level, []).append((grams, np.minimum(weights, self.least).astype(self.kind)))
        self.held += len(grams)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for level, parts in self.parts.items():
            grams, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            total = np.bincount(place, np.concatenate([c for _, c in parts]), len(grams))
            count, group = np.minimum(total, self.least).astype(self.kind), ((grams >> _U(32)) % _U(self.groups)).astype(np.int32)
            order = np.argsort(group, kind="stable")
            bucket, count, group = grams[order].astype(np.uint32), count[order], group[order]
            heads = np.flatnonzero(np.diff(group, prepend=-1))
            spans = list(zip(heads.tolist(), [*heads[1:].tolist(), len(group)], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(heads), level, np.int32)), pa.array(group[heads]), pa.array([bucket[a:b].tobytes() for a, b in spans], pa.binary()),
                 pa.array([count[a:b].tobytes() for a, b in spans], pa.binary())],
                ["level", "group", "buckets", "counts"],
            )
        self.parts, self.held = {}, 0


def _frequent(chunks: DataFrame, use: Callable[[Grams, int], np.ndarray], levels: list[int], least: int, groups: int, size: int) -> dict[int, np.ndarray]:
    """Per length the table of bits of the buckets that reach ``least``, over the phrases that ``use`` marks.

    What comes to the driver is at most one row per 64 bits of the tables.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adder = _Adder(groups, least)
        for texts, batch in _texts(batches):
            g = Grams(texts, batch, max(levels))
            for n in levels:
                marked = g.owned & use(g, n)
                adder.add(n, g.hash[n - 1][marked], g.weight[marked])
            if adder.held >= FLUSH:
                yield from adder.rows()
        yield from adder.rows()

    def total(group: pa.Table) -> pa.Table:
        bucket = np.concatenate([np.frombuffer(x, np.uint32) for x in group["buckets"].to_pylist()])
        count = np.concatenate([np.frombuffer(x, count_type(least)) for x in group["counts"].to_pylist()])
        distinct, place = np.unique(bucket, return_inverse=True)
        bits = np.unique(distinct[np.bincount(place, count) >= least] & np.uint32((1 << size) - 1)).astype(np.int64)
        return pa.table({"level": pa.array(np.full(len(bits), group["level"][0].as_py(), np.int32)), "bit": pa.array(bits)})

    packed = chunks.mapInArrow(count, "level int, group int, buckets binary, counts binary")
    bits = packed.groupBy("level", "group").applyInArrow(total, "level int, bit long")
    cell = F.shiftrightunsigned("bit", 6).cast("int")
    cells = bits.groupBy("level", cell.alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS INT))")).alias("bits")).toArrow()
    level, cell, value = (cells[c].to_numpy() for c in ("level", "cell", "bits"))
    tables = {n: np.zeros(1 << (size - 6), _U) for n in levels}
    for n, table in tables.items():
        table[cell[level == n]] = value[level == n].astype(np.int64).view(_U)
    return tables


class _Speller:
    """Counts of phrases by their words, added up in a task and handed on as packed rows per group of phrases."""

    def __init__(self, groups: int) -> None:
        self.groups = groups
        self.counts: dict[tuple[str, int, int], dict[bytes, int]] = {}
        self.held = 0

    def add(self, g: Grams, langs: list[str], n: int, at: np.ndarray) -> None:
        """Add the phrases of ``n`` words that start at ``at``; both hashes agree only in equal phrases of one language."""
        if not len(at):
            return
        at = at[np.argsort(g.hash[n - 1][at], kind="stable")]
        one, two = g.hash[n - 1][at], g.check[n - 1][at]
        heads = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
        first, w = at[heads], g.words
        stop = w.begin[first + n - 1] + w.size[first + n - 1]
        total = np.add.reduceat(g.weight[at], heads)
        # the hash is of the language and the words: a phrase is in the same group in every task
        group = ((one[heads] >> _U(32)) % _U(self.groups)).tolist()
        for text, x, b, e, c in zip(w.text[first].tolist(), group, w.begin[first].tolist(), stop.tolist(), total.tolist(), strict=True):
            into = self.counts.setdefault((langs[text], n, x), {})
            phrase = w.bytes[b:e]
            before = into.get(phrase)
            self.held += before is None
            into[phrase] = c + (before or 0)

    def rows(self) -> Iterator[pa.RecordBatch]:
        keys = list(self.counts)
        for start in range(0, len(keys), 1_000):
            some = keys[start: start + 1_000]
            lang, words, group = zip(*some, strict=True)
            # no phrase has a line break
            phrases = [b"\n".join(self.counts[k]) for k in some]
            counts = [np.fromiter(self.counts[k].values(), np.int64, len(self.counts[k])).tobytes() for k in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(words, pa.int32()), pa.array(group, pa.int32()), pa.array(phrases, pa.binary()), pa.array(counts, pa.binary())],
                ["lang", "words", "group", "phrases", "counts"],
            )
        self.counts, self.held = {}, 0


def _spelled_sums(least: int) -> Callable[[pa.Table], pa.Table]:
    """From the packed rows of a group to (lang, phrase, words, f) of its phrases that reach ``least``."""

    def total(group: pa.Table) -> pa.Table:
        phrases = [p for packed in group["phrases"].to_pylist() for p in packed.split(b"\n")]
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in group["counts"].to_pylist()])
        sums = pa.table({"phrase": pa.array(phrases, pa.binary()), "f": pa.array(counts)}).group_by("phrase").aggregate([("f", "sum")])
        sums = sums.filter(pc.greater_equal(sums["f_sum"], least))
        n = sums.num_rows
        return pa.table({"lang": pa.array([group["lang"][0].as_py()] * n, pa.string()), "phrase": sums["phrase"],
                         "words": pa.array(np.full(n, group["words"][0].as_py(), np.int32)), "f": sums["f_sum"]})

    return total


def phrase_counts(chunks: DataFrame, longest: int = 4, least: int = 30, size: int = BITS) -> DataFrame:
    """(lang, phrase, words, f) of all phrases with ``f >= least`` and of the words in them, written once."""
    spark = chunks.sparkSession
    words = chunks.agg(F.coalesce(F.sum(F.col("owned").cast("long")), F.lit(0)).alias("n")).first()["n"]
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(words / GROUP_WORDS))
    rows = chunks.select("chunk", "lang", "owned", "frequency")
    share = spark.sparkContext.broadcast
    parts = share(_frequent(rows, lambda g, n: g.whole[n - 1], [1, 2], least, groups, size))
    levels = list(range(3, longest + 1))
    longer = _frequent(rows, lambda g, n: g.passing(n, parts.value[2]), levels, least, groups, size) if levels else {}
    bits = share(parts.value | longer)

    def spelled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = _Speller(groups)
        for texts, batch in _texts(batches):
            g, langs = Grams(texts, batch, longest), batch.column("lang").to_pylist()
            for n in range(1, longest + 1):
                marked = g.owned & has_bit(bits.value[n], g.hash[n - 1])
                speller.add(g, langs, n, np.flatnonzero(marked & g.passing(n, bits.value[2]) if n > 1 else marked))
            if speller.held >= HELD:
                yield from speller.rows()
        yield from speller.rows()

    found = rows.mapInArrow(spelled, "lang string, words int, group int, phrases binary, counts binary")
    sums = found.groupBy("lang", "words", "group").applyInArrow(_spelled_sums(least), "lang string, phrase binary, words int, f long")
    return staged(sums.select("lang", F.col("phrase").cast("string").alias("phrase"), "words", "f"), "phrases-counts")


def _wide(c: Column | str) -> Column:
    """A count as a decimal: products of counts may pass 64 bits."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def _join(words: str, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(F.split(words, " "), start, size), " ")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 4, least: int = 30, covered: int = 80, scale: int = 2_000_000, top: int = 2_000
) -> DataFrame:
    """The ``top`` phrases of every language by their worst cut.

    (lang, rank, phrase, a, l, r, n, score): a phrase of 2 to ``longest`` words with count ``a``,
    the counts ``l`` and ``r`` of the two sides of the cut with the lowest score, the words
    ``n`` of the language, and ``score = floor(scale * a / (l + r))``. Phrases inside a longer
    one with at least ``covered`` percent of their count are left out.
    """
    chunks = dictionary(docs, text, lang, longest)
    counts = phrase_counts(chunks, longest, least)
    found = counts.where("words > 1").withColumnRenamed("f", "a")
    k, size = F.col("k"), F.col("words")
    parts = found.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).select(
        "lang", "phrase", "a", "k",
        F.explode(F.array(F.struct(F.lit("l").alias("side"), _join("phrase", F.lit(1), k).alias("part")),
                          F.struct(F.lit("r").alias("side"), _join("phrase", k + 1, size - k).alias("part")))).alias("p"),
    ).select("lang", "phrase", "a", "k", "p.side", "p.part")
    sized = parts.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("f"))).alias(s)
    cuts = sized.groupBy("lang", "phrase", "a", "k").agg(side("l"), side("r")).withColumns(
        {"_a": _wide("a") * F.lit(scale).cast("decimal(10,0)"), "_both": _wide(F.col("l").cast("decimal(20,0)") + F.col("r"))}
    ).select("lang", "phrase", "a", F.struct(F.expr("_a div _both").alias("score"), "k", "l", "r").alias("cut"))
    worst = cuts.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    # what every longer phrase covers, by the most frequent one
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: _join("phrase", i, m))))
    cover = found.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    hidden = _wide(F.coalesce("longer", F.lit(0))) * 100 >= _wide("a") * covered
    kept = worst.join(cover, ["lang", "phrase"], "left").where(~hidden)
    sizes = chunks.groupBy("lang").agg(F.sum(F.col("frequency") * F.col("owned")).alias("n"))
    ranked = top_n(kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
