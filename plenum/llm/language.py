"""Language identification by error-correcting output codes.

Every language has a codeword. One binary classifier per bit looks at hashed byte trigrams of
the letters of a text; loss-weighted decoding adds up, per language, the exponential loss of
its codeword under the margins of all classifiers and takes the smallest sum. A second
language of nearly the same loss makes the decision ambiguous.

The model is fitted on a bounded sample of labelled rows (``sample_rows``); a prediction looks
at the whole text and at nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import byte_chunks, hash_share, text_lists

UNDETERMINED = "und"
PREDICTION = [("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())]
DIM = 1 << 15
#: Characters that are turned into numbers at once.
CHUNK = 1 << 18
_MULTIPLIERS = np.array([961748927, 32452843, 49979687], dtype=np.uint32)
#: ASCII bytes other than letters count as blanks; bytes of longer characters stay.
has_letterS = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], dtype=np.uint32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A matrix of -1 and 1: one row per language, one column per classifier.

    Up to five languages get the exhaustive code; more get the random code, of a length that
    grows with the logarithm of their number, whose two closest rows are farthest apart.
    """
    if n <= 5:
        columns = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns, dtype=np.float32).T.reshape(n, -1)
    rng, bits, best, apart = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], dtype=np.float32), size=(n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        distance = (code.shape[1] - code @ code.T) / 2
        closest = distance[~np.eye(n, dtype=bool)].min()
        if closest > apart:
            best, apart = code, closest
    return best


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts in a row, and where each text starts."""
    parts = [b"  " + t.lower().encode("utf-8", "replace") for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1])).astype(np.int64)
    data = has_letterS[np.frombuffer(b"".join(parts) + b"  ", dtype=np.uint8)]
    hashed = data[:-2] * _MULTIPLIERS[0] + data[1:-1] * _MULTIPLIERS[1] + data[2:] * _MULTIPLIERS[2]
    hashed ^= hashed >> np.uint32(15)
    blank = (data[:-2] == 32) & (data[1:-1] == 32)
    return np.where(blank, 0, 1 + hashed % np.uint32(DIM - 1)).astype(np.int64), starts


@dataclass
class Coder:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # DIM x bits; row 0 is the blank and weighs nothing
    scale: np.ndarray  # bits

    def losses(self, texts: list[str]) -> np.ndarray:
        """texts x languages; the smallest loss decides."""
        out = np.zeros((len(texts), len(self.languages)))
        for a, b in byte_chunks(texts, CHUNK):
            grams, starts = _grams(texts[a:b])
            used = np.add.reduceat((grams > 0).astype(np.float64), starts)
            sums = np.add.reduceat(self.weights[grams], starts, axis=0)
            margins = sums / np.maximum(used, 1)[:, None] * self.scale
            out[a:b] = np.exp(-margins[:, None, :] * self.code[None]).sum(axis=2)
        return out

    def decide(self, texts: list[str]) -> pd.DataFrame:
        """language, score in [0, 1] and whether a second language is nearly as close."""
        losses = self.losses(texts)
        weight = np.exp(losses.min(axis=1, keepdims=True) - losses)
        weight /= weight.sum(axis=1, keepdims=True)
        order = np.sort(weight, axis=1)
        second = order[:, -2] if order.shape[1] > 1 else np.zeros(len(order))
        return pd.DataFrame({
            "lang_pred": [self.languages[i] for i in losses.argmin(axis=1)], "score": order[:, -1], "ambiguous": order[:, -1] - second < 0.1,
        })


def fit_coder(texts: list[str], languages: list[str]) -> Coder:
    """Naive-Bayes weights for every bit: log odds of a trigram between its two sides.

    Languages count alike on their side, whatever the number of their rows.
    """
    names = sorted(set(languages))
    counts = np.zeros((len(names), DIM))
    for name in names:
        own = [t for t, n in zip(texts, languages, strict=True) if n == name]
        for a, b in byte_chunks(own, CHUNK):
            counts[names.index(name)] += np.bincount(_grams(own[a:b])[0], minlength=DIM)
    counts[:, 0] = 0
    share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * DIM)
    code = codewords(len(names))
    one = [share[code[:, b] > 0].mean(axis=0) for b in range(code.shape[1])]
    other = [share[code[:, b] < 0].mean(axis=0) for b in range(code.shape[1])]
    weights = np.log(np.array(one).reshape(-1, DIM) / np.array(other).reshape(-1, DIM)).T.astype(np.float32)
    weights[0] = 0
    coder = Coder(names, code, np.ascontiguousarray(weights), np.ones(code.shape[1]))
    margin = np.array([np.abs(counts[i] @ weights) / max(counts[i].sum(), 1) for i in range(len(names))]).reshape(len(names), -1)
    coder.scale = 3 / np.maximum(margin.mean(axis=0), 1e-9)
    return coder


def fit_languages(rows: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = 2000) -> Coder | None:
    """Fit on at most about ``sample_rows`` rows with a language, alike many of each.

    Rows are chosen by the hash of their key, so the sample does not depend on partitioning.
    None when no row has both a text and a language.
    """
    usable = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r["l"]: r["n"] for r in usable.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    each = max(sample_rows // len(counts), 1)
    share = F.create_map(*[F.lit(x) for name, n in sorted(counts.items()) for x in (name, min(1.0, each / n))])
    share = F.element_at(share, F.col(lang))
    keyed = F.coalesce(F.col(key).cast("string"), F.lit(""))
    picked = usable.where((share >= 1) | (hash_share(keyed, 11) < share)).select(keyed.alias("k"), F.col(lang).alias("l"), F.col(text).alias("t"))
    found = sorted(picked.limit(2 * sample_rows + 100 * len(counts)).collect()) or usable.select(F.lit("").alias("k"), F.col(lang).alias("l"), F.col(text).alias("t")).limit(100).collect()
    return fit_coder([r["t"] for r in found], [r["l"] for r in found])


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def identify(coder: Coder | None, text: Column) -> Column:
    """struct(lang_pred, score, ambiguous) of a text.

    A null text, and one without any letter, is ``und`` with score 0; so is every text when
    there is no model. A model of one language always answers that language.
    """
    undetermined = F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"))
    if coder is None:
        return undetermined

    @F.arrow_udf("lang_pred string, score double, ambiguous boolean")
    def decide(texts: pa.Array) -> pa.Array:
        found = pd.concat([coder.decide(part) for part in text_lists(texts)] or [coder.decide([])])
        return pa.StructArray.from_arrays([pa.array(found[c].to_numpy(), type=t) for c, t in PREDICTION], names=[c for c, _ in PREDICTION])

    return F.when(has_letter(text), decide(text)).otherwise(undetermined)


def with_language(docs: DataFrame, coder: Coder | None, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language can be told, with that language in ``lang``.

    These are the texts with a letter, once there is a model; so rows go before the model runs,
    and it runs once per row that stays.
    """
    if coder is None:
        return docs.limit(0)
    told = docs.where(has_letter(F.col(text)))
    return told.select(*[identify(coder, F.col(text))["lang_pred"].alias(c) if c == lang else F.col(f"`{c}`") for c in docs.columns])
