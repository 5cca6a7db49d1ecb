"""Toxicity: a weighted lexicon found by Aho-Corasick in folded text.

Folding undoes homoglyphs, full-width letters, digits used as letters and invisible
characters. Lexicon entries are stems at the start of a word (or whole words); exception
phrases are matched by the same automaton and cover the hits inside them. The weights of the
hits, alone and per length of the text, go through a logistic curve.

Lexicon, weights and curve are learned from a bounded sample of labelled rows
(``sample_rows``); a score looks at the whole text and at nothing else.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import hash_share, text_lists

# Characters that look like Latin letters, and digits and signs written for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j",
    "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ℓ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
INVISIBLE = ["­", "​", "‌", "‍", "⁠", "﻿"]
EXCEPTIONS = ["trash can", "trash bin", "trash bag", "clown fish", "pond scum"]

_FOLD = str.maketrans(HOMOGLYPHS | DIGITS | {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | dict.fromkeys(INVISIBLE, ""))
_NO_LETTER = re.compile(r"[\W_]+")


def _latin_byte(c: str) -> str:
    low = c.lower().translate(_FOLD)
    return low if len(low) == 1 and ord(low) < 256 and low.isalnum() else " "


#: The same folding for texts within Latin-1, one table look-up per byte.
_LATIN = "".join(_latin_byte(chr(i)) for i in range(256)).encode("latin-1")


def fold(text: str | None) -> str:
    """Folded lower-case words between single blanks, with a blank at either end."""
    try:
        plain = (text or "").encode("latin-1").translate(_LATIN, b"\xad").decode("latin-1")
    except UnicodeEncodeError:
        plain = _NO_LETTER.sub(" ", text.lower().translate(_FOLD))
    return f" {' '.join(plain.split())} "


@dataclass
class Lexicon:
    weights: dict[str, float]  # " stem" or " word "
    exceptions: list[str] = field(default_factory=lambda: EXCEPTIONS)
    curve: tuple[float, float, float] = (-4.0, 1.0, 1.0)
    _found: ahocorasick.Automaton | None = None

    def __getstate__(self):
        return self.__dict__ | {"_found": None}

    def automaton(self) -> ahocorasick.Automaton:
        if self._found is None:
            self._found = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                self._found.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                self._found.add_word(f" {fold(phrase).strip()} ", (len(fold(phrase).strip()) + 2, 0.0))
            self._found.make_automaton()
        return self._found

    def features(self, text: str | None) -> tuple[float, float]:
        """log of the summed weights, and of the weights per hundred words.

        Of the entries that start at one place the longest counts; those inside an exception
        phrase do not.
        """
        folded = fold(text)
        hits, covered = {}, []
        for end, (length, weight) in self.automaton().iter(folded):
            start = end - length + 1
            if weight:
                if length > hits.get(start, (0, 0.0))[0]:
                    hits[start] = (length, weight)
            else:
                covered.append((start, end))
        total = sum(w for s, (_, w) in hits.items() if not any(a <= s < b for a, b in covered))
        return math.log1p(total), math.log1p(100 * total / max(folded.count(" ") - 1, 1))

    def scores(self, texts) -> np.ndarray:
        x = np.array([self.features(t) for t in texts], dtype=float).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ np.array(self.curve[1:]), -40, 40)))


def _curve(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 0.05) -> tuple[float, float, float]:
    """Logistic regression by Newton steps; slopes stay at or above zero."""
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (balance * (y - p)) - ridge * w
        step = np.linalg.solve((a * (balance * p * (1 - p))[:, None]).T @ a + ridge * np.eye(3), gradient)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(max(w[1], 0)), float(max(w[2], 0))


def learn_lexicon(texts: list[str], toxic: list[int], *, shortest: int = 4, longest: int = 12, support: int = 3, odds: float = 2.0,
                  exceptions: list[str] = EXCEPTIONS) -> Lexicon:
    """Stems that cover the toxic texts and are rare in the others.

    Repeated texts count once. Candidates are words and word starts found in ``support`` toxic
    texts whose log odds are at least ``odds``; again and again the one that covers most
    uncovered toxic texts is taken (of equals the longest), until none covers ``support`` more.
    """
    unique = {fold(t): int(y) for t, y in zip(texts, toxic, strict=True)}
    bad, n_good = [t for t, y in unique.items() if y], max(sum(1 for y in unique.values() if not y), 1)
    n_bad = max(len(bad), 1)

    def terms(text: str) -> set[str]:
        words = set(text.split())
        return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in range(shortest, min(len(w), longest) + 1)}

    found = Counter(t for text in bad for t in terms(text))
    found = Counter({t: n for t, n in found.items() if n >= support})
    elsewhere: Counter = Counter()
    for text, y in unique.items():
        if not y:
            elsewhere.update(t for t in terms(text) if t in found)
    weight = {t: math.log((n + 0.5) / (n_bad + 1)) - math.log((elsewhere[t] + 0.5) / (n_good + 1)) for t, n in found.items()}
    weight = {t: w for t, w in weight.items() if w >= odds}
    seen: dict[str, set[int]] = defaultdict(set)
    for i, text in enumerate(bad):
        for t in terms(text):
            if t in weight:
                seen[t].add(i)
    left, chosen = set(range(len(bad))), {}
    queue = [(-len(seen[t]), -len(t), t) for t in weight]
    heapq.heapify(queue)
    while queue:
        gain, _, term = heapq.heappop(queue)
        now = len(seen[term] & left)
        if now < support:
            continue
        if now < -gain:  # gains only shrink, so a gain that still leads is the largest
            heapq.heappush(queue, (-now, -len(term), term))
            continue
        chosen[term] = weight[term]
        left -= seen[term]
    # Terms whose cover was already taken still count when they mark as many texts as a chosen one.
    floor = min((len(seen[t]) for t in chosen), default=0)
    for term in sorted(weight, key=lambda t: (len(t), t)):
        if len(seen[term]) >= max(floor, 10 * support) and not any(term.startswith(c) for c in chosen):
            chosen[term] = weight[term]
    lexicon = Lexicon(chosen, exceptions)
    y = np.array([int(v) for v in unique.values()], dtype=float)
    if len(y) and 0 < y.mean() < 1:
        lexicon.curve = _curve(np.array([lexicon.features(t) for t in unique]), y)
    return lexicon


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", toxic: str = "toxic", sample_rows: int = 6000) -> Lexicon:
    """Learn from at most about ``sample_rows`` labelled rows, a third of them toxic if there are as many.

    Labels may be repeated; rows without a label, a text or an id are not used. Without any
    toxic row the lexicon is empty and every score is that of an empty text.
    """
    marked = labels.select(F.col(key).alias("_id"), F.col(toxic).cast("int").alias("_y")).where("_id is not null and _y is not null")
    marked = marked.groupBy("_id").agg(F.max("_y").alias("_y"))
    counts = dict(marked.groupBy("_y").count().collect())
    share = {y: min(1.0, sample_rows * (1 / 3 if y else 2 / 3) / n) for y, n in counts.items()}
    wanted = F.lit(False)
    for y, s in share.items():
        wanted = wanted | ((F.col("_y") == y) & ((F.lit(s) >= 1) | (hash_share(F.col("_id"), 13) < s)))
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_text is not null")
    # the sample rule leaves about ``sample_rows`` ids, so this side is small at any size
    picked = texts.join(F.broadcast(marked.where(wanted)), F.col("_key") == F.col("_id"))
    rows = sorted(picked.select("_id", "_text", "_y").limit(2 * sample_rows).collect())
    return learn_lexicon([r[1] for r in rows], [r[2] for r in rows])


def toxicity(lexicon: Lexicon, text: Column) -> Column:
    """The score of a text in [0, 1]; null and empty texts score as texts without a hit."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0)] + [lexicon.scores(part) for part in text_lists(texts)]))

    return score(F.coalesce(text, F.lit("")))
