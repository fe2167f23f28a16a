"""Similar names among those that one task holds in memory: every pair of the same kind is tried, none is made a row before it is found.

A pair of names costs a few instructions: two words of 64 bits tell most pairs apart, and the rest are compared letter by
letter, many pairs side by side. Both are exact for names of up to LONGEST letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Letters of the longest names that are tried here.
LONGEST = 64
#: Pairs whose bits are compared at once, and candidates that are compared letter by letter at once.
TILE, BATCH = 16_384, 65_536
#: Letters are counted in so many classes.
CLASSES = 48
#: More than any distance here; a few edits more still fit 8 bits.
FAR = 120


def most_edits(length: int, share: float) -> int:
    """Edits that two names may differ by, the longer one of that length."""
    return int(np.floor(length * share + 1e-9))


def code_points(names: list[str]) -> np.ndarray:
    return np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32)


def bits(own: np.ndarray, chosen: list[tuple[int, int]]) -> np.ndarray:
    """A word for each name: for each (class, least) chosen a bit, whether the name has so many letters of the class. An edit changes one bit at most for a letter that comes, one for a letter that goes."""
    word = np.zeros(len(own), np.uint64)
    for place, (c, least) in enumerate(chosen):
        word |= (own[:, c] >= least).astype(np.uint64) << np.uint64(place)
    return word


def held(letters: np.ndarray) -> np.ndarray:
    """How many letters of each class a name (a column) has."""
    n = letters.shape[1]
    return np.bincount((letters % CLASSES + np.arange(n) * CLASSES).ravel(), minlength=n * CLASSES).reshape(n, CLASSES)


def telling(own: np.ndarray, most: int) -> list[tuple[int, int]]:
    """The (class, least) that tell most names apart: those which about half of the names have."""
    shares = [((own >= least).mean(axis=0), least) for least in range(1, own.max(initial=0) + 1)]
    rated = sorted(((share[c] * (share[c] - 1), c, least) for share, least in shares for c in np.flatnonzero(share)))
    return [(c, least) for _, c, least in rated[:most]]


class Alphabet:
    """Letters of names as numbers, frequent ones first, and what their bits stand for; any choice is exact, this one tells most pairs apart."""

    def __init__(self, names: list[str]):
        self.codes, place, often = np.unique(code_points(names), return_inverse=True, return_counts=True)
        rank = np.empty(len(often), np.uint32)
        rank[np.argsort(-often, kind="stable")] = np.arange(len(often), dtype=np.uint32)
        self.rank = rank.astype(np.uint8 if len(rank) <= 256 else np.uint16 if len(rank) <= 65_536 else np.uint32)
        some = [np.searchsorted(self.codes, code_points([x])) for x in names[:: 1 + len(names) // 2048]]
        parts = [[rank[x][: len(x) // 2, None] for x in some], [rank[x][len(x) // 2 :, None] for x in some], [rank[x][:, None] for x in some]]
        self.first, self.last, self.whole = (telling(np.concatenate([held(x) for x in part]), most) for part, most in zip(parts, (32, 32, 64)))


class SameLength:
    """Names of one kind and one length: rows (their places among all names), letters by place, words of bits."""

    def __init__(self, names: list[str], rows: np.ndarray, alphabet: Alphabet):
        self.rows, self.alphabet, self.length, self._halves = rows, alphabet, len(names[rows[0]]), {}
        points = code_points([names[r] for r in rows]).reshape(len(rows), self.length)
        self.letters = np.ascontiguousarray(alphabet.rank[np.searchsorted(alphabet.codes, points)].T)
        self.whole = bits(held(self.letters), alphabet.whole)
        # the bits that neighbouring letters hash to, the last letter's with the end: an edit takes away two at most and adds two at most
        after = np.concatenate([points[:, 1:], np.zeros((len(rows), 1), points.dtype)], axis=1).astype(np.uint64)
        mixed = (points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + after) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(58)
        self.twos = np.bitwise_or.reduce(np.uint64(1) << mixed, axis=1)

    def halves(self, length: int) -> np.ndarray:
        """Words of the first and the last letters, as many of both as half of a name of that length has."""
        if length not in self._halves:
            first, last = self.letters[: length // 2], self.letters[self.length - (length - length // 2) :]
            self._halves[length] = bits(held(first), self.alphabet.first) | bits(held(last), self.alphabet.last) << np.uint64(32)
        return self._halves[length]


def by_length(names: list[str], rows: np.ndarray, alphabet: Alphabet) -> list[SameLength]:
    """names[rows] by length, TILE together at most."""
    lengths = np.array([len(names[r]) for r in rows], np.int64)
    own = [rows[lengths == length] for length in np.unique(lengths)]
    return [SameLength(names, r[at : at + TILE], alphabet) for r in own for at in range(0, len(r), TILE)]


def similar(x: list[SameLength], y: list[SameLength], share: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(rows of x, rows of y, edits, length of the longer): all pairs of names of x and y within the edits of the longer; same: x is y, each pair once."""
    for k, p in enumerate(x):
        for q in y[k:] if same else y:
            edits = most_edits(max(p.length, q.length), share)
            if abs(p.length - q.length) <= edits:
                a, b = (p, q) if p.length <= q.length else (q, p)
                for i, j in candidates(a, b, edits, p is q):
                    i, j, d = within(a, b, i, j, edits)
                    if len(i):
                        yield (a.rows[i], b.rows[j], d, b.length) if a is p else (b.rows[j], a.rows[i], d, b.length)


def candidates(a: SameLength, b: SameLength, edits: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in a and b of the pairs that their bits don't tell apart, b being the longer; same: those with the first before the second.

    Of s letters changed, p taken away and q added, the bits of the whole change by 2 s + p + q at most, where p + q are as
    many as the lengths differ by at least. A letter that comes into a half or leaves it moves another one over its end, so
    each edit changes 2 bits of the halves at most; it lies in one of them, since added letters can come before others go.
    """
    n, m, found, waiting = len(a.rows), len(b.rows), [], 0
    words = [(a.whole, b.whole, 2 * edits - (b.length - a.length)), (a.halves(a.length), b.halves(a.length), 2 * edits)]
    # the one that tells more of some pairs apart is tried on all
    words.sort(key=lambda w: (np.bitwise_count(w[0][:: 1 + n // 64, None] ^ w[1][:: 1 + m // 64]) <= w[2]).mean())
    (up, across, most), (up_then, across_then, most_then) = words
    high = max(1, TILE // m)
    differ, count, near = np.empty((high, m), np.uint64), np.empty((high, m), np.uint8), np.empty((high, m), bool)
    for top in range(0, n, high):
        rows = min(high, n - top)
        # of the same names, those before the first row are paired already
        left = top if same else 0
        np.bitwise_xor(up[top : top + rows, None], across[left:], out=differ[:rows, left:])
        np.bitwise_count(differ[:rows, left:], out=count[:rows, left:])
        np.less_equal(count[:rows, left:], most, out=near[:rows, left:])
        near[:rows, :left] = False
        found.append(np.flatnonzero(near[:rows]) + top * m)
        waiting += len(found[-1])
        if waiting >= BATCH or top + rows == n:
            i, j = np.divmod(np.concatenate(found), m)
            found, waiting = [], 0
            keep = np.bitwise_count(up_then[i] ^ across_then[j]) <= most_then
            if same:
                keep &= i < j
            i, j = i[keep], j[keep]
            one, other = a.twos[i], b.twos[j]
            keep = (np.bitwise_count(one & ~other) <= 2 * edits) & (np.bitwise_count(other & ~one) <= 2 * edits)
            if keep.any():
                yield i[keep], j[keep]


def within(a: SameLength, b: SameLength, i: np.ndarray, j: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance): the pairs within so many edits; b is the longer.

    Row by row of the table of distances, on the diagonals that a way of so many edits can reach: one that leaves those
    between the two corners by e must come back, at 2 e edits more. Pairs too far off are dropped on the way.
    """
    more = b.length - a.length
    aside = (edits - more) // 2
    wide = more + 2 * aside + 1
    # cell c of row r is column r + c - aside
    back = np.abs(np.arange(wide) - aside - more).astype(np.uint8)[:, None]
    cells = np.full((wide, len(i)), FAR, np.uint8)
    cells[aside:] = np.arange(wide - aside, dtype=np.uint8)[:, None]
    checks = {a.length // 2, a.length * 2 // 3, a.length * 5 // 6}
    # letters of the longer name at the columns that a row's cells end in
    window = np.zeros((wide, len(i)), b.letters.dtype)
    for c in range(aside, wide - 1):
        if c - aside < b.length:
            window[c + 1] = b.letters[c - aside][j]
    for r in range(1, a.length + 1):
        window[:-1] = window[1:]
        if 0 <= (column := r + wide - 1 - aside) - 1 < b.length:
            window[-1] = b.letters[column - 1][j]
        changed = cells + (window != a.letters[r - 1][i])
        np.minimum(changed[:-1], cells[1:] + np.uint8(1), out=changed[:-1])
        if r <= aside:
            changed[: aside - r] = FAR
            changed[aside - r] = r
        for c in range(1, wide):
            np.minimum(changed[c], changed[c - 1] + np.uint8(1), out=changed[c])
        cells = changed
        if r in checks:
            keep = (cells + back).min(axis=0) <= edits
            i, j, cells, window = i[keep], j[keep], cells[:, keep], window[:, keep]
    d = cells[aside + more]
    keep = d <= edits
    return i[keep], j[keep], d[keep]
