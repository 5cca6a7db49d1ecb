"""Levels of agreement of all pairs of a tile, as numbers in a matrix and not as rows.

A tile holds some left and some right rows of one block. Every text is compared once per pair of
distinct texts of the tile. Texts are only measured where their signatures leave them a chance: one edit takes
at most one letter and two pairs of letters out of a text, so texts that lost more per allowed edit are
too far. The edit distances of what is left are computed for many pairs at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Levels are handed on one up, as digits to the base 4: 0 missing, 1 different, 2 close, 3 equal.
BASE = 4
#: Pairs that are looked at together; they and their temporaries stay near the processor.
CHUNK = 1 << 17
#: Longs of a signature for pairs of letters, one more is for letters; and characters that are put beside each other.
WORDS, LETTERS = 4, 1 << 20


def allowed_edits(longest: int, close: float) -> np.ndarray:
    """For every length up to ``longest``: the most edits with which a longer text of that length is still close."""
    size = np.arange(longest + 1)
    out = np.full(longest + 1, -1)
    for edits in (-1, 0, 1):
        guess = np.clip(np.floor(size * (1 - close)).astype(np.int64) + edits, 0, None)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where((1 - guess / size >= close) & (guess <= size), np.maximum(out, guess), out)
    return out


def _signatures(texts: list[str]) -> np.ndarray:
    """The letters and the pairs of letters of every text as bits of some longs."""
    u = np.uint64
    out = np.zeros((len(texts), WORDS + 1), u)
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    low = 0
    while low < len(order):
        part = order[low: low + max(1, LETTERS // (8 * max(1, int(sizes[order[low]]))))]
        letters = _letters([texts[x] for x in part]).astype(u)
        inside = np.arange(letters.shape[1]) < sizes[part][:, None]
        bit = (letters * u(0x9E3779B97F4A7C15)) >> u(58)
        out[part, WORDS] = np.bitwise_or.reduce(np.where(inside, u(1) << bit, u(0)), axis=1)
        bit = ((letters[:, :-1] * u(1_000_003) + letters[:, 1:]) * u(0x9E3779B97F4A7C15)) >> u(56)
        stands = np.where(inside[:, 1:], u(1) << (bit & u(63)), u(0))
        for w in range(WORDS):
            out[part, w] = np.bitwise_or.reduce(np.where(bit >> u(6) == w, stands, u(0)), axis=1, initial=u(0))
        low += len(part)
    return out


def _letters(texts: list[str]) -> np.ndarray:
    """The code points of texts, a row per text, filled up with zeros."""
    return np.array([*texts, ""], dtype=f"U{max(map(len, texts), default=0) or 1}").view(np.uint32).reshape(len(texts) + 1, -1)[:-1]


def _myers(one: np.ndarray, i: np.ndarray, n: np.ndarray, two: np.ndarray, j: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Edit distances of the pairs ``one[i]``, ``two[j]`` of ``n`` and ``m`` characters; ``n`` is 1 to 64. A column of a pair's table is two longs."""
    u = np.uint64
    order = np.argsort(-m, kind="stable")
    i, n, j, m = i[order], n[order], j[order], m[order]
    alphabet = np.unique(one)
    # at which places of a text a letter stands; the last column is for letters that no text has
    stands = np.zeros((len(one), len(alphabet) + 1), u)
    size = np.zeros(len(one), np.int64)
    size[i] = n
    for place in range(one.shape[1]):
        at = np.flatnonzero(size > place)
        stands[at, np.searchsorted(alphabet, one[at, place])] |= u(1) << u(place)
    letter = np.minimum(np.searchsorted(alphabet, two), len(alphabet) - 1)
    letter = np.where(alphabet[letter] == two, letter, len(alphabet))
    up, down = np.full(len(n), ~u(0)), np.zeros(len(n), u)
    last, found = u(1) << (n - 1).astype(u), n.copy()
    for t in range(int(m.max(initial=0))):
        k = int(np.searchsorted(-m, -t, side="left"))
        equal = stands[i[:k], letter[j[:k], t]]
        p, d = up[:k], down[:k]
        vertical = equal | d
        level = (((equal & p) + p) ^ p) | equal
        rise, fall = d | ~(level | p), p & level
        found[:k] += ((rise & last[:k]) != 0).astype(np.int64) - ((fall & last[:k]) != 0)
        rise, fall = (rise << u(1)) | u(1), fall << u(1)
        up[:k], down[:k] = fall | ~(vertical | rise), rise & vertical
    out = np.empty_like(found)
    out[order] = found
    return out


def _table(one: np.ndarray, i: np.ndarray, n: np.ndarray, two: np.ndarray, j: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The same for texts of any length: a row of all tables at a time."""
    a, b, width = one[i], two[j], np.arange(two.shape[1] + 1)
    row = np.broadcast_to(width, (len(n), len(width))).copy()
    out = np.where(n == 0, m, 0)
    for place in range(int(n.max(initial=0))):
        step = np.empty_like(row)
        step[:, 0] = place + 1
        step[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (a[:, place, None] != b))
        row = np.minimum.accumulate(step - width, axis=1) + width
        done = np.flatnonzero(n == place + 1)
        out[done] = row[done, m[done]]
    return out


def edit_distances(one: list[str], two: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The edit distances of the pairs ``one[i]``, ``two[j]``."""
    n, m = (np.array([len(t) for t in texts], np.int64) for texts in (one, two))
    out = np.empty(len(i), np.int64)
    short = (n[i] > 0) & (n[i] <= 64)
    for part, work in ((np.flatnonzero(short), _myers), (np.flatnonzero(~short), _table)):
        # the longest come first, so they say how many pairs have room beside each other
        longest = np.maximum(n[i[part]], m[j[part]])
        order = np.argsort(-longest, kind="stable")
        part, longest = part[order], longest[order]
        low = 0
        while low < len(part):
            at = part[low: low + max(1, LETTERS // max(1, int(longest[low])))]
            left, at_left = np.unique(i[at], return_inverse=True)
            right, at_right = np.unique(j[at], return_inverse=True)
            out[at] = work(_letters([one[x] for x in left]), at_left, n[i[at]], _letters([two[x] for x in right]), at_right, m[j[at]])
            low += len(at)
    return out


def close_pairs(one: list[str], two: list[str], close: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``one``, in ``two``) of the pairs of distinct texts whose edit similarity is at least ``close``."""
    n, m = (np.array([len(t) for t in texts], np.int64) for texts in (one, two))
    edits = allowed_edits(int(max(n.max(initial=0), m.max(initial=0))), close)
    rows, columns = np.argsort(n, kind="stable"), np.argsort(m, kind="stable")
    n, m = n[rows], m[columns]
    bits = _signatures([*one, *two])
    mine, theirs = np.ascontiguousarray(bits[: len(one)][rows].T), np.ascontiguousarray(bits[len(one):][columns].T)
    missing = ~theirs
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    step = max(1, CHUNK // max(len(m), 1))
    for low in range(0, len(n), step):
        part = slice(low, low + step)
        # a text that is longer by more characters than edits are allowed is not close
        longest = int(n[part][-1])
        first = int(np.searchsorted(m, (n[part] - edits[n[part]]).min()))
        near = np.flatnonzero(m[first:] - edits[m[first:]] <= longest)
        span = slice(first, first + int(near[-1]) + 1 if len(near) else first)
        most = int(edits[: max(longest, int(m[span].max(initial=0))) + 1].max())
        if span.stop == span.start or most < 0:
            continue
        lost = np.bitwise_count(mine[0, part, None] & missing[0, span])
        for w in range(1, WORDS):
            lost += np.bitwise_count(mine[w, part, None] & missing[w, span])
        i, j = np.divmod(np.flatnonzero(lost <= min(2 * most, 255)), lost.shape[1])
        a, b = n[part][i], m[span][j]
        limit, lost = edits[np.maximum(a, b)], lost[i, j]
        i, j = i + low, j + span.start
        keep = (np.abs(a - b) <= limit) & (lost <= 2 * limit)
        keep &= (np.bitwise_count(mine[-1, i] & missing[-1, j]) <= limit) & (np.bitwise_count(~mine[-1, i] & theirs[-1, j]) <= limit)
        i, j, limit = i[keep], j[keep], limit[keep]
        gained = sum(np.bitwise_count(~mine[w, i] & theirs[w, j]).astype(np.int64) for w in range(WORDS))
        keep = gained <= 2 * limit
        i, j, limit = rows[i[keep]], columns[j[keep]], limit[keep]
        keep = edit_distances(one, two, i, j) <= limit
        found.append((i[keep], j[keep]))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _codes(one: pa.ChunkedArray, two: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Numbers of the texts of both sides in one list of distinct texts; -1 where there is none."""
    both = pa.chunked_array([*one.chunks, *two.chunks], one.type).combine_chunks().dictionary_encode()
    both = both.combine_chunks() if isinstance(both, pa.ChunkedArray) else both
    numbers = both.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return numbers[: len(one)], numbers[len(one):], both.dictionary


class TileLevels:
    """The levels of all pairs of a tile in some fields; ``fields`` are (left column, right column, close or None)."""

    def __init__(self, left: pa.Table, right: pa.Table, fields: list[tuple[str, str, float | None]]) -> None:
        self.sides = []
        self.tables = []
        for one, two, close in fields:
            a, b, texts = _codes(left[one], right[two])
            table = None
            if close is not None:
                mine, a_at = np.unique(a, return_inverse=True)
                theirs, b_at = np.unique(b, return_inverse=True)
                table = (1 + 2 * (mine[:, None] == theirs)).astype(np.uint8)
                known, others = np.flatnonzero(mine >= 0), np.flatnonzero(theirs >= 0)
                i, j = close_pairs(texts.take(pa.array(mine[known])).to_pylist(), texts.take(pa.array(theirs[others])).to_pylist(), close)
                i, j = known[i], others[j]
                table[i, j] = np.maximum(table[i, j], 2)
                table[mine < 0], table[:, theirs < 0] = 0, 0
                a, b = a_at, b_at
            self.sides.append((a, b))
            self.tables.append(table)

    def codes(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The pattern of every pair of the rows ``i`` and ``j``: digit f is the level of field f, one up."""
        kind = np.uint8 if len(self.tables) <= 4 else np.int64
        out = np.zeros((len(i), len(j)), kind)
        for f, ((a, b), table) in enumerate(zip(self.sides, self.tables, strict=True)):
            if table is None:
                digit = (a[i][:, None] == b[j]).astype(kind)
                digit *= kind(2 * BASE**f)
                digit += kind(BASE**f)
                digit[a[i] < 0] = 0
                if (b[j] < 0).any():
                    digit[:, b[j] < 0] = 0
            else:
                digit = np.take(table[a[i]].astype(kind) * kind(BASE**f), b[j], axis=1)
            out += digit
        return out

    def distinct(self) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """(a row of each kind, how many there are) for both sides; rows of one kind have the same texts."""
        out = []
        for side in (0, 1):
            rows = np.stack([s[side] for s in self.sides], axis=1)
            _, first, count = np.unique(rows, axis=0, return_index=True, return_counts=True)
            out.append((first, count))
        return out[0], out[1]


def chunks(n: int, width: int, most: int = CHUNK) -> Iterator[np.ndarray]:
    """Row numbers in parts of about ``most`` cells."""
    step = max(1, most // max(width, 1))
    for low in range(0, n, step):
        yield np.arange(low, min(low + step, n))


def count_patterns(levels: TileLevels) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, pairs) of a tile. Rows with the same texts are looked at once."""
    (i, n), (j, m) = levels.distinct()
    total: dict[int, int] = {}
    weighed = (n > 1).any() or (m > 1).any()
    for part in chunks(len(i), len(j)):
        found = levels.codes(i[part], j).ravel()
        names = None
        if len(levels.tables) > 6:
            names, found = np.unique(found, return_inverse=True)
        # sums of whole numbers: exact in doubles
        sums = np.bincount(found, np.outer(n[part], m).ravel().astype(float) if weighed else None)
        for at in np.flatnonzero(sums):
            code = int(at if names is None else names[at])
            total[code] = total.get(code, 0) + int(sums[at])
    return np.array(list(total), np.int64), np.array(list(total.values()), np.int64)


def best_columns(codes: np.ndarray, worth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` pairs of every row that are worth most; ties go to the left column.

    ``worth`` has what each pattern is worth in each row.
    """
    order = np.argsort(-worth, axis=1, kind="stable")
    ranked = np.take_along_axis(worth, order, axis=1)
    place = np.empty(worth.shape, np.int64)
    np.put_along_axis(place, order, np.concatenate([np.zeros((len(worth), 1), np.int64), np.cumsum(ranked[:, 1:] != ranked[:, :-1], axis=1)], axis=1), axis=1)
    width = codes.shape[1]
    rank = place.ravel()[codes + (np.arange(len(codes)) * worth.shape[1])[:, None]] * width + np.arange(width)
    k = min(k, width)
    if k < width:
        rank = np.partition(rank, k - 1, axis=1)[:, :k]
    return np.repeat(np.arange(len(codes)), k), (rank % width).ravel()
