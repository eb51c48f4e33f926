"""Fuzzy passages that documents share, by chaining common word k-mers and aligning the chains.

K-mers of words are sampled as the smallest hash of every window, shared ones are joined into matches between two
documents, matches that run in the same order in both are chained, and the words along each chain are aligned.

Occurrences of a frequent seed first meet a few others. A second round brings together those that no passage found so
far connects: directly where these are few pairs, or else by keys of several seeds in reach of each other.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from panelweave.llm.common import LATIN, lean, lean_group, lean_pair, partitions, pick, settled, texts, unpacked

#: Words in a k-mer, and k-mers in a window of which one is sampled: 9 equal words in a row always share a seed.
WORDS, WINDOW = 4, 6
#: Words from a seed's start that tell its surroundings apart, and how many seeds a chain needs.
RUN, LEAST = 12, 3
#: Up to so many different surroundings of a seed meet in all pairs; of more, each first meets the next and the first ones by document.
SMALL, NEXT, FIRST = 16, 6, 2
#: Occurrences of a seed in the same surroundings that still meet like different ones; of more, all but the first first meet the first.
EQUAL = 6
#: Occurrences that nothing connects yet meet at once where they make up to so many pairs for each, or else by keys of several seeds.
DIRECT = 16
#: Words between two matches at which a chain is cut, words in a block of text, and what a word without a match costs.
REACH, BLOCK, GAP = 40, 64, 0.04
#: Words beyond both ends of an alignment that may still belong to its passage.
EDGE = 30
BUCKET_BYTES, HELD = 1_500_000, 400_000
#: Words that a task remembers, a power of two.
KNOWN = 1 << 20
SEED = np.dtype([("seed", "<u8"), ("run", "<u4"), ("doc", "<i8"), ("at", "<i4"), ("more", "u1")])
PLACE = np.dtype([("doc", "<i8"), ("at", "<i4")])
MATCH = np.dtype([("doc", "<i8"), ("other", "<i8"), ("at", "<i4"), ("there", "<i4"), ("late", "u1")])
SPOT = np.dtype([("seed", "<u8"), ("doc", "<i8"), ("at", "<i4")])
#: A passage of two documents, in words; and a spot inside one, with where the seed may stand in the other document.
LINK = np.dtype([("doc", "<i8"), ("other", "<i8"), ("lo", "<i4"), ("hi", "<i4"), ("low", "<i4"), ("high", "<i4")])
SIDE = np.dtype([("seed", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("other", "<i8"), ("low", "<i4"), ("high", "<i4")])
NEAR = np.dtype([("seed", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("label", "<u4"), ("hot", "u1")])
KEY = np.dtype([("key", "<u8"), ("doc", "<i8"), ("a", "<i4"), ("b", "<i4"), ("c", "<i4"), ("x", "<u4"), ("y", "<u4"), ("z", "<u4"), ("seeds", "u1"), ("part", "<u2"), ("parts", "<u2")])
#: What rows of packed data hold: matches by document, spots by seed, seeds that may stand near hot ones, hot ones, heads and members of classes, passages and edges, members of long lists.
MATCHES, SPOTS, OTHERS, HOT, HEADS, MEMBERS, EDGES, WIDE = range(8)
#: Pairs, matches or keys that a task holds at once, while it forms them or makes them distinct.
PAIRS, MOST = 500_000, 1_500_000
#: Members of a long list that are compared with each other, or with as many others, in one group.
TILE = 8192
#: Places in the table that tells which documents the second round asks for.
ASKED = 8_388_593
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: The first so many bytes of eight.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG = 24


class Words:
    """64-bit hashes of words, by a table of fixed size: a short word is found by its bytes, others and new ones are hashed one by one."""

    def __init__(self, slots: int = KNOWN):
        self.mask = np.uint64(slots - 1)
        self.known, self.values = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)

    def hashes(self, text: bytes) -> np.ndarray:
        """Of the words that ``latin_words`` finds in the text."""
        plain = text.translate(LATIN)
        return self.of(plain, *_edges(plain))

    def of(self, plain: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of words that begin and end at these bytes of a text with blanks for all other bytes."""
        size = end - begin
        key = _word_keys(plain, begin, size)
        slot = (key >> np.uint64(20)) & self.mask
        out = self.values[slot]
        short = size <= LONG
        new = np.flatnonzero((self.known[slot] != key) | ~short)
        if len(new):
            out[new] = [xxhash.xxh3_64_intdigest(plain[b:e]) for b, e in zip(begin[new].tolist(), end[new].tolist())]
            new = new[short[new]]
            self.known[slot[new]] = key[new]
            self.values[slot[new]] = out[new]
        return out


def _edges(plain: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end, in a text with blanks for all other bytes."""
    inside = np.frombuffer(plain, np.uint8) != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate([[0], edges])
    if len(inside) and inside[-1]:
        edges = np.concatenate([edges, [len(inside)]])
    return edges[::2], edges[1::2]


def _word_keys(plain: bytes, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Mixed 64 bits of the first ``LONG`` bytes of words."""
    eights = np.ndarray((len(plain) + 1,), "<u8", plain + bytes(8), 0, (1,))  # eight bytes from every place on
    with np.errstate(over="ignore"):
        key = (eights[begin] & _BYTES[np.minimum(size, 8)]) * _M1
        key ^= key >> np.uint64(32)
        for k in range(8, LONG, 8):
            own = np.flatnonzero(size > k)
            if len(own):
                more = (key[own] ^ eights[begin[own] + k] & _BYTES[np.minimum(size[own] - k, 8)]) * _M2
                key[own] = more ^ (more >> np.uint64(31))
        key *= _M1
    return key


def _batches_of(rows: Iterator[tuple[int, bytes]], size: int = 1 << 19) -> Iterator[tuple[list[int], list[bytes]]]:
    """Documents, some at a time, so that arrays of their words are neither small nor large."""
    docs, own, held = [], [], 0
    for doc, text in rows:
        docs.append(doc)
        own.append(text)
        held += len(text)
        if held >= size:
            yield docs, own
            docs, own, held = [], [], 0
    if docs:
        yield docs, own


def _joined_texts(own: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after the other with blanks for what is in no word, begin and end of all words, each text's first byte, and the
    number of words before each text and in all."""
    plain = b" ".join(own).translate(LATIN)
    begin, end = _edges(plain)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in own])])
    return plain, begin, end, first, np.searchsorted(begin, first)


def _seeds_of(docs: list[int], own: list[bytes], known: Words, words: int, window: int) -> np.ndarray:
    """Seeds of documents, as ``grams_of``, ``picked`` and ``runs`` give them for each."""
    plain, begin, end, _, upto = _joined_texts(own)
    grams = grams_of(known.of(plain, begin, end), words)
    count = np.maximum(0, np.diff(upto) - words + 1)
    of = np.repeat(np.arange(len(docs)), count)
    to = np.cumsum(count)
    at = np.arange(len(of)) - (to - count)[of]
    grams = grams[upto[of] + at]  # those inside one text
    best = np.zeros(0, np.int64)
    if len(grams) >= window:
        low, best = grams[:len(grams) - window + 1].copy(), np.arange(len(grams) - window + 1)
        for k in range(1, window):
            less = grams[k:len(grams) - window + 1 + k] < low
            low = np.minimum(low, grams[k:len(grams) - window + 1 + k])
            best[less] = np.flatnonzero(less) + k
        best = best[of[:len(best)] == of[window - 1:]]
        best = best[np.concatenate([[True], best[1:] != best[:-1]])] if len(best) else best
    few = np.flatnonzero((count > 0) & (count < window))
    best = np.concatenate([best, *[to[d] - count[d] + picked(grams[to[d] - count[d]:to[d]], window) for d in few.tolist()]])
    part = np.zeros(len(best), SEED)
    part["seed"], part["doc"], part["at"] = grams[best], np.array(docs, np.int64)[of[best]], at[best]
    out, last = grams[best], to[of[best]]
    with np.errstate(over="ignore"):
        for k in range(words, RUN, words):
            out = (out * _M1) ^ np.where(best + k < last, grams[np.minimum(best + k, len(grams) - 1)], np.uint64(0)) if len(best) else out
            out ^= out >> np.uint64(29)
        out = out * _M2
    part["run"] = (out >> np.uint64(32)).astype(np.uint32)
    return part


def grams_of(hashes: np.ndarray, words: int) -> np.ndarray:
    """64-bit hashes of the k-mers at every word."""
    n = max(0, len(hashes) - words + 1)
    with np.errstate(over="ignore"):
        grams = np.zeros(n, np.uint64)
        for k in range(words):
            grams = (grams ^ hashes[k:k + n]) * _M1
            grams ^= grams >> np.uint64(31)
        grams *= _M2
    return grams


def picked(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest k-mer of every window."""
    n = len(grams)
    if not n:
        return np.zeros(0, np.int64)
    window = min(window, n)
    best = np.arange(n - window + 1)
    low = grams[:n - window + 1].copy()
    for k in range(1, window):
        own = grams[k:n - window + 1 + k]
        less = own < low
        low = np.minimum(low, own)
        best[less] = np.flatnonzero(less) + k
    return best[np.concatenate([[True], best[1:] != best[:-1]])]  # they only move on


def seeds(hashes: np.ndarray, words: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled k-mers of a text: their hashes and the words they start at."""
    grams = grams_of(hashes, words)
    at = picked(grams, window)
    return grams[at], at


def runs(grams: np.ndarray, at: np.ndarray, words: int, length: int) -> np.ndarray:
    """32-bit hashes of the k-mers that follow each other from each place on, over up to ``length`` words."""
    out = grams[at]
    with np.errstate(over="ignore"):
        for k in range(words, length, words):
            out = (out * _M1) ^ np.where(at + k < len(grams), grams[np.minimum(at + k, len(grams) - 1)], np.uint64(0)) if len(at) else out
            out ^= out >> np.uint64(29)
        out = out * _M2
    return (out >> np.uint64(32)).astype(np.uint32)


def _sorted(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by whole numbers, the first column first, and whether each row in it differs from the one before: columns are
    sorted as one number of 64 bits as far as they fit in it."""
    key, size = np.zeros(len(columns[0]), np.uint64), 1

    def changes(own: np.ndarray) -> np.ndarray:
        return np.concatenate([[True], own[1:] != own[:-1]])[:len(own)]

    def ranked(key: np.ndarray) -> tuple[np.ndarray, int]:
        order = np.argsort(key)
        rank = np.empty(len(key), np.uint64)
        rank[order] = np.cumsum(changes(key[order])) - 1
        return rank, int(rank[order[-1]]) + 1

    for column in columns if len(key) else ():
        own = np.ascontiguousarray(column)
        own = (own if own.dtype == np.uint64 else own.astype(np.int64).view(np.uint64)) - np.uint64(int(own.min()) & (1 << 64) - 1)
        span = int(own.max()) + 1
        if size * span >= 1 << 63:
            if size > 1:
                key, size = ranked(key)
            if size * span >= 1 << 63:
                own, span = ranked(own)
        key, size = key * np.uint64(span) + own, size * span
    order = np.argsort(key)
    return order, changes(key[order])


def _ordered(rows: np.ndarray) -> np.ndarray:
    return rows[_sorted(rows["seed"], rows["run"], rows["doc"], rows["at"])[0]]


def _classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ordered rows: where each class (a seed with its surroundings) begins, each row's class, and the class's first row of a second document, -1 for none."""
    new = np.concatenate([[True], (rows["seed"][1:] != rows["seed"][:-1]) | (rows["run"][1:] != rows["run"][:-1])]) if len(rows) else np.zeros(0, bool)
    begin, of = np.flatnonzero(new), np.cumsum(new) - 1
    if not len(rows):
        return begin, of, begin
    other = np.where(rows["doc"] != rows["doc"][begin][of], np.arange(len(rows)), len(rows))
    second = np.minimum.reduceat(other, begin)
    return begin, of, np.where(second < len(rows), second, -1)


def _paired(doc: np.ndarray, at: np.ndarray, other: np.ndarray, there: np.ndarray, late: int = 0) -> np.ndarray:
    """Matches between different documents, the one of the larger id first."""
    keep = doc != other
    doc, at, other, there = doc[keep], at[keep], other[keep], there[keep]
    out, turned = np.empty(len(doc), MATCH), doc < other
    out["late"] = late
    out["doc"], out["other"] = np.where(turned, other, doc), np.where(turned, doc, other)
    out["at"], out["there"] = np.where(turned, there, at), np.where(turned, at, there)
    return out


def _incomplete(rows: np.ndarray, small: int = SMALL) -> np.ndarray:
    """Of ordered rows: those of seeds whose occurrences ``_matches`` does not bring together in all pairs."""
    if not len(rows):
        return np.zeros(0, bool)
    begin, of, _ = _classes(rows)
    few = (np.diff(np.append(begin, len(rows)))[of] <= EQUAL) & (rows["more"] == 0)
    heads = few.copy()
    heads[begin] = True
    seed = np.cumsum(np.concatenate([[False], rows["seed"][1:] != rows["seed"][:-1]]))
    return ((np.bincount(seed[heads]) > small) | (np.bincount(seed[~few], minlength=seed[-1] + 1) > 0))[seed]


def _matches(rows: np.ndarray, small: int = SMALL, ahead: int = NEXT, first: int = FIRST) -> np.ndarray:
    """First matches between the occurrences of equal seeds, given all of them in order.

    An occurrence meets the first one in the same surroundings, or, where that is in its own document, the first of another.
    Those in different surroundings, and up to ``EQUAL`` in the same, meet each other: up to ``small`` all, of more each the
    next ``ahead`` by document and the ``first`` of all; ``_rest`` and ``_keyed`` see to the others. None of this depends on how
    rows are dealt to tasks: a task holds back members only of classes that are larger than ``EQUAL`` anyway.
    """
    begin, of, second = _classes(rows)
    if not len(rows):
        return np.zeros(0, MATCH)
    to = np.where(rows["doc"] != rows["doc"][begin][of], begin[of], second[of])
    own = np.flatnonzero(to >= 0)
    found = [_paired(rows["doc"][own], rows["at"][own], rows["doc"][to[own]], rows["at"][to[own]])]
    size = np.diff(np.append(begin, len(rows)))
    few = (size[of] <= EQUAL) & (rows["more"] == 0)
    few[begin] = True
    heads = rows[few]
    heads = heads[np.lexsort((heads["at"], heads["doc"], heads["seed"]))]
    new = np.flatnonzero(np.concatenate([[True], heads["seed"][1:] != heads["seed"][:-1]]))
    size = np.diff(np.append(new, len(heads)))
    start, length = np.repeat(new, size), np.repeat(size, size)
    place = np.arange(len(heads)) - start
    for step in range(1, max(small, ahead + 1)):
        own = np.flatnonzero((place >= step) & ((length <= small) | (step <= ahead)))
        found.append(_paired(heads["doc"][own], heads["at"][own], heads["doc"][own - step], heads["at"][own - step]))
    for k in range(first):
        own = np.flatnonzero((length > small) & (place > k + ahead))
        found.append(_paired(heads["doc"][own], heads["at"][own], heads["doc"][start[own] + k], heads["at"][start[own] + k]))
    return np.concatenate(found)


def _distinct(found: np.ndarray) -> np.ndarray:
    """Matches in order, each once: of equal ones that of the first round."""
    if not len(found):
        return found
    order, new = _sorted(found["doc"], found["other"], found["at"], found["there"])
    late = np.minimum.reduceat(found["late"][order], np.flatnonzero(new))
    out = found[order[new]]
    out["late"] = late
    return out


class Fenwick:
    """Largest value with its owner over the places before a given one."""

    def __init__(self, size: int):
        self.best = [(-1e300, -1)] * (size + 1)

    def put(self, place: int, value: float, owner: int) -> None:
        best, n, entry = self.best, len(self.best), (value, owner)
        place += 1
        while place < n:
            if entry > best[place]:
                best[place] = entry
            place += place & -place

    def before(self, place: int) -> tuple[float, int]:
        best, out = self.best, (-1e300, -1)
        while place > 0:
            if best[place] > out:
                out = best[place]
            place -= place & -place
        return out


def chains(at: np.ndarray, there: np.ndarray, words: int, reach: int, gap: float) -> list[list[int]]:
    """Chains of matches, as indices in order, that run forward in both texts; each match is in one chain at most.

    A match scores its words, and a chain pays ``gap`` for every word it passes in either text. Of the chains that may
    come before a match, a Fenwick tree over the places in the other text gives the best. Where that one ends out of
    reach, the best of those within reach is looked up by its place in the other text.
    """
    order = np.lexsort((there, at))
    ranks = np.searchsorted(np.unique(there), there)
    tree, near, most = Fenwick(int(ranks.max()) + 1), {}, reach + words
    score, before = [0.0] * len(at), [-1] * len(at)

    def within(p: int, q: int) -> tuple[float, int]:
        out = (-1e300, -1)
        for k in range(q - most, q) if most < len(near) else [k for k in near if q - most <= k < q]:
            if ends := near.get(k):
                while ends and ends[0][2] < p - most:  # places only grow, so no later match reaches it either
                    ends.popleft()
                if ends and ends[0][:2] > out:
                    out = ends[0][:2]
        return out

    p, q, waiting, last = at.tolist(), there.tolist(), [], None
    for i in order.tolist():
        if p[i] != last:  # matches at one place of the text do not follow each other
            for j in waiting:
                value = score[j] + gap * (p[j] + q[j])
                tree.put(int(ranks[j]), value, j)
                ends = near.setdefault(q[j], deque())
                while ends and ends[-1][:2] < (value, j):  # worse, and out of reach sooner
                    ends.pop()
                ends.append((value, j, p[j]))
            waiting, last = [], p[i]
        value, j = tree.before(int(ranks[i]))
        if j >= 0 and value > gap * (p[i] + q[i]) and (p[i] - p[j] > most or q[i] - q[j] > most):
            value, j = within(p[i], q[i])
        value -= gap * (p[i] + q[i])
        score[i] = words
        if j >= 0 and value > 0:
            score[i] += value
            before[i] = j
        waiting.append(i)
    used, out = [False] * len(at), []
    for i in sorted(range(len(at)), key=lambda i: -score[i]):
        own = []
        while i >= 0 and not used[i]:
            used[i] = True
            own.append(i)
            i = before[i]
        if own:
            out.append(own[::-1])
    return out


def edits(a: np.ndarray | list[int], b: np.ndarray | list[int]) -> tuple[int, int]:
    """Of the best alignment of two word lists: equal words, and columns."""
    a, b = (x.tolist() if isinstance(x, np.ndarray) else x for x in (a, b))
    n, m, first = len(a), len(b), 0
    # Equal words at both ends are in some best alignment.
    while n and m and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    while first < n and first < m and a[first] == b[first]:
        first += 1
    known = len(a) - n + first
    a, b = a[first:n], b[first:m]
    if not a or not b or set(a).isdisjoint(b):
        return known, known + max(len(a), len(b))
    row = [(-j, 0) for j in range(len(b) + 1)]  # columns that are not equal, negative, and equal words
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], (-i, 0)
        for j, y in enumerate(b, 1):
            cost, same = diagonal
            best = (cost, same + 1) if x == y else (cost - 1, same)
            up, left = row[j], row[j - 1]
            best = max(best, (up[0] - 1, up[1]), (left[0] - 1, left[1]))
            diagonal, row[j] = row[j], best
    cost, same = row[-1]
    return known + same, known + same - cost


def columns_of(a: np.ndarray | list[int], b: np.ndarray | list[int]) -> list[tuple[int, int, bool]]:
    """The columns of the alignment that ``edits`` counts: words of either list in it, and whether they are equal."""
    a, b = (x.tolist() if isinstance(x, np.ndarray) else x for x in (a, b))
    n, m, first = len(a), len(b), 0
    while n and m and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    out = [(1, 1, True)] * (len(a) - n)
    while first < n and first < m and a[first] == b[first]:
        first += 1
    if n == m and set(a[first:n]).isdisjoint(b[:m]) and set(b[first:m]).isdisjoint(a[:n]):  # no other alignment is as good
        return [(1, 1, True)] * first + [(1, 1, False)] * (n - first) + out
    grid = [[(-j, 0) for j in range(m + 1)]]
    for i in range(1, n + 1):
        above, row = grid[-1], [(-i, 0)]
        for j in range(1, m + 1):
            cost, same = above[j - 1]
            best = (cost, same + 1) if a[i - 1] == b[j - 1] else (cost - 1, same)
            row.append(max(best, (above[j][0] - 1, above[j][1]), (row[-1][0] - 1, row[-1][1])))
        grid.append(row)
    i, j = n, m
    while i or j:
        cost, same = grid[i][j]
        if i and j and a[i - 1] == b[j - 1] and grid[i - 1][j - 1] == (cost, same - 1):
            out.append((1, 1, True))
        elif i and j and a[i - 1] != b[j - 1] and grid[i - 1][j - 1] == (cost + 1, same):
            out.append((1, 1, False))
        elif i and grid[i - 1][j] == (cost + 1, same):
            out.append((1, 0, False))
        else:
            out.append((0, 1, False))
        i, j = i - out[-1][0], j - out[-1][1]
    return out[::-1]


def _steps(at: list[int], there: list[int], words: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Along a chain: where the words not yet aligned begin in both texts, where they end, and how many equal words follow."""
    i, j = at[0], there[0]
    for p, q in zip(at, there):
        step = words
        if p < i or q < j:  # overlaps the match before
            step = min(p + words - i, q + words - j)
            if step <= 0 or p - i != q - j:
                continue
            p, q = i, j
        yield i, j, p, q, step
        i, j = p + step, q + step


def align(a: np.ndarray, b: np.ndarray, at: list[int], there: list[int], words: int, drop: int = 6) -> tuple[int, int, int, int, int, int]:
    """Align two texts along a chain of matches: begin and end in both, equal words, and columns.

    Matches are equal words; what lies between two of them is aligned word by word. The ends grow along their
    diagonals while equal words outweigh others.
    """
    same = columns = 0
    one, two = a.tolist(), b.tolist()
    i, j, end = at[0], there[0], at[-1] + words - at[0]
    exact = at[-1] - at[0] == there[-1] - there[0] and bool((a[i:i + end] == b[j:j + end]).all())
    if exact:
        same, columns, i, j = end, end, i + end, j + end
    for i, j, p, q, step in () if exact else _steps(at, there, words):
        more = edits(one[i:p], two[j:q])
        same, columns = same + more[0] + step, columns + more[1] + step
        i, j = p + step, q + step

    def grown(pairs: Iterator[tuple[int, int]]) -> tuple[int, int]:
        score = best = length = 0
        for k, (x, y) in enumerate(pairs, 1):
            score += 1 if x == y else -1
            if score > best:
                best, length = score, k
            if score < best - drop:
                break
        return length, (length + best) // 2  # equal words less others are the best score

    ahead, equal = grown(zip(one[i:], two[j:]))
    i, j, same, columns = i + ahead, j + ahead, same + equal, columns + ahead
    back, equal = grown(zip(reversed(one[:at[0]]), reversed(two[:there[0]])))
    return at[0] - back, i, there[0] - back, j, same + equal, columns + back


def stretches(a: np.ndarray, b: np.ndarray, at: list[int], there: list[int], words: int, min_words: int, similarity: float) -> list[tuple[int, int, int, int, int, int]]:
    """Passages along a chain of matches, each as ``align`` gives it: the whole chain where it is similar enough, or else
    its longest part that is and covers ``min_words`` words in both texts, and the same of what lies before and after.

    Parts begin and end with equal words.
    """
    whole = align(a, b, at, there, words)
    lo, hi, low, high, same, columns = whole
    if same >= similarity * columns and min(hi - lo, high - low) >= min_words:
        return [whole]
    # The ends may go on where fewer words are equal, as long as the whole is similar enough.
    back, ahead = min(lo, low, EDGE), min(len(a) - hi, len(b) - high, EDGE)
    lo, low, hi, high = lo - back, low - back, hi + ahead, high + ahead
    if min(hi - lo, high - low) < min_words:
        return []
    # All equal words of what follows; a passage has at least so many of its least columns.
    same += int((a[lo:lo + back] == b[low:low + back]).sum()) + int((a[hi - ahead:hi] == b[high - ahead:high]).sum())
    if same + 1e-6 < similarity * min_words:
        return []
    one, two = a.tolist(), b.tolist()
    parts = [(1, 1, x == y) for x, y in zip(one[lo:at[0]], two[low:there[0]])]
    i, j = at[0], there[0]
    for i, j, p, q, step in _steps(at, there, words):
        parts += columns_of(one[i:p], two[j:q])
        parts += [(1, 1, True)] * step
        i, j = p + step, q + step
    parts += [(1, 1, x == y) for x, y in zip(one[i:hi], two[j:high])]
    steps = np.array(parts, np.int64)
    x, y, equal = (np.concatenate([[0], np.cumsum(steps[:, k])]) for k in range(3))
    kept = steps[:, 2] > 0
    out, open_ = [], [(0, len(steps))]
    while open_:
        begin, end = open_.pop()
        if end - begin < min_words:
            continue
        own = kept[begin:end]
        level = equal[begin:end + 1] - similarity * np.arange(end - begin + 1) + 1e-9  # of a part: last less first, not below 0
        lowest = np.minimum.accumulate(np.where(own, level[:-1], np.inf))
        last = np.flatnonzero(own) + 1
        first = np.searchsorted(-lowest, -level[last] - 1e-7, side="left")  # the earliest place to begin
        last, first = begin + last[first < last], begin + first[first < last]
        sure = (x[last] - x[first] >= min_words) & (y[last] - y[first] >= min_words)
        if not sure.any():
            continue
        last, first = last[sure], first[sure]
        k = int(np.argmax(last - first))
        f, t = int(first[k]), int(last[k])
        out.append((lo + int(x[f]), lo + int(x[t]), low + int(y[f]), low + int(y[t]), int(equal[t] - equal[f]), t - f))
        open_ += [(begin, f), (t, end)]
    return sorted(out)


def shared_passages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, similarity: float = 0.8,
                    words: int = WORDS, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES, held: int = HELD) -> DataFrame:
    """Passages of at least ``min_words`` words that two documents share with at least ``similarity`` equal words.

    Returns one row per passage of a document and another document: the id, ``start`` and ``end`` (code points of the
    text), ``other_id``, ``other_start`` and ``other_end`` of a passage in a document with a smaller id, ``n_words`` and
    ``similarity`` (equal words over columns of the alignment). Words are letters and digits without case of ASCII.

    Pairs of a larger group of equal passages are not formed: each names the group's first document. Passages that differ meet each
    other seed by seed, those of very frequent seeds in two rounds: first a few of them (``_matches``), then all whose occurrences of
    the seed are not connected by passages found so far (``_rest``, ``_keyed``). So a passage that very many documents hold with changes
    of their own is named with some of them, which connect the group. Rows do not depend on how documents are dealt to tasks.
    Ids are whole numbers; rows with a null id, null and short texts have no passages, and rows of one id do not match
    each other: of their texts the smallest counts. No rows give no rows.
    """
    rows = pick(documents, doc=documents[id_col].cast("bigint"), text=text_col).where("doc is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * partitions(documents.sparkSession), -(-total // bucket_bytes))
    shelves = max(1, buckets // 16)  # for matches by document: each seed bucket sends a row to each of them

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts, size = Words(), [], 0
        for docs, own in _batches_of((doc, text) for batch in batches for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)))):
            parts.append(_seeds_of(docs, own, known, words, window))
            size += len(parts[-1])
            if size >= held:
                yield _dealt(np.concatenate(parts), buckets)
                parts, size = [], 0
        if size:
            yield _dealt(np.concatenate(parts), buckets)

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() >= buckets:  # further members of classes pass as they are
            nulls = pa.nulls(len(table), pa.int32())
            return pa.table([pa.array(np.full(len(table), MEMBERS, np.int32)), nulls, table["data"], table["seed"], table["run"], pa.nulls(len(table), pa.binary())], names=names)
        return _met(_ordered(np.concatenate([_unpacked(x, SEED) for x in table.column("data").to_pylist()])), shelves, key[0].as_py(), names)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data, head in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own, heads = np.frombuffer(zstandard.decompress(data), PLACE), np.frombuffer(head, PLACE)
                to = (own["doc"] == heads["doc"][0]).astype(int)
                own, to = own[to < len(heads)], to[to < len(heads)]
                found.append(_paired(own["doc"], own["at"], heads["doc"][to], heads["at"][to]))
            if found:
                yield _by_document(np.concatenate(found), shelves)

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for seed, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(zstandard.decompress(data), PLACE)
                found.append(np.empty(len(own), SPOT))
                found[-1]["seed"], found[-1]["doc"], found[-1]["at"] = seed & (1 << 64) - 1, own["doc"], own["at"]
            if found:
                own = np.concatenate(found)
                yield _kinds([(SPOTS, own, (own["seed"] % np.uint64(buckets)).astype(np.int64))])

    def by_shelf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_rows, size = [], 0
        for batch in batches:
            for data in batch.column(0).to_pylist():
                held_rows.append(_unpacked(data, SPOT))
                size += len(held_rows[-1])
                if size >= held:
                    own, held_rows, size = np.concatenate(held_rows), [], 0
                    yield _kinds([(SPOTS, own, _shelf(own["doc"], shelves))])
        if size:
            own = np.concatenate(held_rows)
            yield _kinds([(SPOTS, own, _shelf(own["doc"], shelves))])

    def passages_by_shelf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column(0).to_pylist()), LINK)
            yield _kinds([(EDGES, own, _shelf(own["doc"], shelves))])

    def edges(key: tuple, table: pa.Table) -> pa.Table:
        own = _inside(_held(table, SPOTS, SPOT), _held(table, EDGES, LINK))
        return pa.Table.from_batches([_kinds([(EDGES, own, (own["seed"] % np.uint64(buckets)).astype(np.int64))])])

    def rest(key: tuple, table: pa.Table) -> pa.Table:
        return _rest(_held(table, SPOTS, SPOT), _held(table, EDGES, SIDE), shelves, min_words)

    def keys(key: tuple, table: pa.Table) -> pa.Table:
        return _keys(_held(table, OTHERS, NEAR, HOT), 4 * shelves)

    def keyed(key: tuple, table: pa.Table) -> pa.Table:
        return _keyed(_read(table, KEY), shelves)

    def by_text(key: tuple, table: pa.Table) -> pa.Table:
        own = _read(table, KEY)
        docs, of = np.unique(own["doc"], return_inverse=True)
        parts = [(int(docs[k]), _packed(x)) for k, x in _split(own, of)]
        return pa.table({"of": pa.array([d for d, _ in parts], pa.int64()), "spots": pa.array([x for _, x in parts], pa.binary())})

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, waiting, size = Words(), [], 0
        for batch in batches:
            for text, data in zip(unpacked(batch.column(0)), batch.column(1).to_pylist()):
                hashes, own = known.hashes(text), _unpacked(data, KEY)
                for lo in range(0, len(own), 4096):
                    waiting.append(_around(hashes, own[lo:lo + 4096], wide))
                    size += len(waiting[-1])
                    if size >= 20_000:
                        yield _dealt_wide(np.concatenate(waiting), buckets)
                        waiting, size = [], 0
        if size:
            yield _dealt_wide(np.concatenate(waiting), buckets)

    def alike(key: tuple, table: pa.Table) -> pa.Table:
        return _alike(_read(table, wide), int(np.ceil(similarity * min_words - 1e-9)), shelves)

    def chain(fresh: bool):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            found, more, size = [], [], 0
            for x in table.column("data"):
                more.append(_unpacked(x.as_py(), MATCH))
                size += len(more[-1])
                if size >= 4 * held:  # several keys give the same match
                    found, more, size = [_distinct(np.concatenate([*found, *more]))], [], 0
            return _chained(np.concatenate([*found, *more]), words, min_words, fresh)

        return run

    def cut(key: tuple, own: pa.Table, chained: pa.Table) -> pa.Table:
        return _cut(own, chained, words)

    def aligned(key: tuple, own: pa.Table, chained: pa.Table) -> pa.Table:
        return _aligned(own, chained, words, min_words, similarity)

    def verified(matches: DataFrame, fresh: bool) -> DataFrame:
        """Chains go to the smaller document for its words around them, and with these to the other, where they are aligned:
        a text is sent once, and for each chain the words of one side."""
        chained = settled(matches.groupBy("bucket").applyInArrow(lean_group(chain(fresh)), sides))

        def dealt(df: DataFrame, by: str) -> GroupedData:
            return df.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(buckets))).groupBy("bucket")

        named = _texts_of(rows, chained.select(F.explode(F.array("doc", "other")).alias("of")))
        there = dealt(named, "doc").cogroup(dealt(chained, "other")).applyInArrow(lean_pair(cut), sides + ", first int, words binary, point int, spans binary")
        return dealt(named, "doc").cogroup(dealt(there, "doc")).applyInArrow(lean_pair(aligned), kind + ", link binary")

    sides = "doc bigint, other bigint, at array<int>, there array<int>"
    kind = "doc bigint, start int, `end` int, other_id bigint, other_start int, other_end int, n_words int, similarity double"
    packed = "kind int, bucket int, data binary"
    # Beyond a chain's ends a passage follows the diagonal, while equal words outweigh others or for EDGE words.
    width = 2 * min_words + 6 + EDGE
    wide = np.dtype([*[(f, KEY[f]) for f in KEY.names], ("low", "<u8"), ("high", "<u8"), ("before", "<u2", (width,)), ("after", "<u2", (width,))])
    names = ["kind", "bucket", "data", "seed", "run", "head"]
    sampled = rows.mapInArrow(lean(scan), "bucket int, data binary, seed bigint, run bigint")
    met = settled(sampled.groupBy("bucket").applyInArrow(lean_group(meet), packed + ", seed bigint, run bigint, head binary"))

    def of_kind(df: DataFrame, *kinds: int) -> DataFrame:
        return df.where(F.col("kind").isin(*kinds)).select("kind", "bucket", "data")

    heads = met.where(F.col("kind") == HEADS).select("seed", "run", "head")
    apart = met.where(F.col("kind") == MEMBERS)
    more = apart.select("seed", "run", "data").join(heads, ["seed", "run"]).select("data", "head")
    matches = of_kind(met, MATCHES).unionByName(more.mapInArrow(lean(members), packed))
    first = settled(verified(matches, False))

    spotted = of_kind(met, SPOTS).unionByName(apart.select("seed", "data").mapInArrow(lean(spots), packed))
    known = spotted.select("data").mapInArrow(lean(by_shelf), packed).unionByName(first.select("link").mapInArrow(lean(passages_by_shelf), packed))
    known = known.groupBy("bucket").applyInArrow(lean_group(edges), packed)
    rests = settled(spotted.unionByName(known).groupBy("bucket").applyInArrow(lean_group(rest), packed))
    out = first.drop("link")
    if not of_kind(rests, MATCHES, HOT).isEmpty():
        several = of_kind(met, OTHERS).unionByName(of_kind(rests, OTHERS, HOT)).groupBy("bucket").applyInArrow(lean_group(keys), packed)
        several = settled(several.groupBy("bucket").applyInArrow(lean_group(keyed), packed))
        late = of_kind(rests, MATCHES).unionByName(of_kind(several, MATCHES))
        long = of_kind(several, WIDE)
        if not long.isEmpty():
            long = settled(long.groupBy("bucket").applyInArrow(lean_group(by_text), "of bigint, spots binary"))
            full = _texts_of(rows, long)
            long = full.join(long, full["doc"] == long["of"]).select("data", "spots").mapInArrow(lean(around), packed)
            late = late.unionByName(long.groupBy("bucket").applyInArrow(lean_group(alike), packed))
        second = settled(verified(matches.unionByName(late), True)).drop("link").distinct()
        # A passage of the first round that lies inside one of the second is the same one, found with fewer matches.
        x, y = out.alias("x"), second.alias("y")
        inside = " and ".join(["x.doc = y.doc", "x.other_id = y.other_id", "y.start <= x.start", "x.`end` <= y.`end`", "y.other_start <= x.other_start", "x.other_end <= y.other_end"])
        out = x.join(y, F.expr(inside), "left_anti").unionByName(second)
    return out.withColumnRenamed("doc", id_col)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        y = x.astype(np.uint64) * _M1
        return (y ^ (y >> np.uint64(32))) * _M2 >> np.uint64(8)


def _packed(rows: np.ndarray) -> bytes:
    """Rows column by column, compressed: documents and places take few bytes then."""
    return zstandard.compress(b"".join([np.ascontiguousarray(rows[f]).tobytes() for f in rows.dtype.names]), 1)


def _unpacked(data: bytes, kind: np.dtype) -> np.ndarray:
    data = zstandard.decompress(data)
    out, at = np.empty(len(data) // kind.itemsize, kind), 0
    for f in kind.names:
        plain, shape = kind[f].subdtype or (kind[f], ())
        own = np.frombuffer(data, plain, len(out) * int(np.prod(shape)), at)
        out[f] = own.reshape(len(out), *shape)
        at += own.nbytes
    return out


def _read(table: pa.Table, rows: np.dtype, kinds: tuple[int, ...] = ()) -> np.ndarray:
    """All rows, or those of some kinds; only the packed ones and the result are held."""
    own = [x for x, k in zip(table["data"], table["kind"].to_pylist()) if k in kinds or not kinds]
    sizes = [zstandard.frame_content_size(x.as_py()) // rows.itemsize for x in own]
    out, at = np.empty(sum(sizes), rows), 0
    for x, n in zip(own, sizes):
        out[at:at + n] = _unpacked(x.as_py(), rows)
        at += n
    return out


def _held(table: pa.Table, kind: int, rows: np.dtype, *others: int) -> np.ndarray:
    return _read(table, rows, (kind, *others))


def _kinds(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Packed rows of several kinds, each with the bucket that it goes to."""
    rows = [(kind, to, _packed(own)) for kind, values, where in parts for to, own in _split(values, where)]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["kind", "bucket", "data"])


def _shelf(doc: np.ndarray, shelves: int) -> np.ndarray:
    return (_mixed(doc) % np.uint64(shelves)).astype(np.int64)


def _split(values: np.ndarray, where: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The values of each number in ``where``."""
    order = np.argsort(where.astype(np.uint16) if len(where) and where.max() < 1 << 16 else where, kind="stable")
    values, where = values[order], where[order]
    edges = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(where) else np.zeros(0, int)
    for lo, hi in zip(edges, np.append(edges[1:], len(where)).astype(int)):
        yield int(where[lo]), values[lo:hi]


def _dealt(rows: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row per bucket of seeds; of classes with many rows here all but the first and the first of another document go as members."""
    rows = _ordered(rows)
    begin, of, second = _classes(rows)
    size = np.diff(np.append(begin, len(rows)))
    many = (size > EQUAL)[of]
    head = np.zeros(len(rows), bool)
    head[begin] = True
    head[second[second >= 0]] = True
    rows["more"] = many
    bucket, data, seed, run = [], [], [], []
    for where, own in _split(rows[~many | head], (rows["seed"][~many | head] % np.uint64(buckets)).astype(np.int64)):
        bucket.append(where)
        data.append(_packed(own))
        seed.append(None)
        run.append(None)
    rest = np.flatnonzero(many & ~head)
    for k, own in _split(rows[rest], of[rest]):
        place = np.empty(len(own), PLACE)
        place["doc"], place["at"] = own["doc"], own["at"]
        key = int(own["seed"][0])
        bucket.append(buckets + (key ^ int(own["doc"][0])) % buckets)
        data.append(zstandard.compress(place.tobytes(), 1))
        seed.append(key - (1 << 64) if key >> 63 else key)
        run.append(int(own["run"][0]))
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(data, pa.binary()), pa.array(seed, pa.int64()), pa.array(run, pa.int64())],
                                      names=["bucket", "data", "seed", "run"])


def _by_document(found: np.ndarray, shelves: int) -> pa.RecordBatch:
    return _kinds([(MATCHES, found, _shelf(found["doc"], shelves))])


def _met(rows: np.ndarray, shelves: int, bucket: int, names: list[str]) -> pa.Table:
    """Matches by document; all occurrences of seeds that have not met in all pairs; by document, those of other seeds that
    several documents hold; and the heads of classes that have members elsewhere."""
    cut = _incomplete(rows)
    spots = np.empty(int(cut.sum()), SPOT)
    for f in SPOT.names:
        spots[f] = rows[f][cut]
    new = np.flatnonzero(np.concatenate([[True], rows["seed"][1:] != rows["seed"][:-1]])) if len(rows) else np.zeros(0, int)
    several = np.minimum.reduceat(rows["doc"], new) != np.maximum.reduceat(rows["doc"], new) if len(rows) else np.zeros(0, bool)
    own = rows[~cut & np.repeat(several, np.diff(np.append(new, len(rows))))]
    others = np.zeros(len(own), NEAR)
    others["seed"], others["doc"], others["at"] = own["seed"] & np.uint64(0xFFFFFFFF), own["doc"], own["at"]
    found = _matches(rows)
    out = _kinds([(MATCHES, found, _shelf(found["doc"], shelves)), (SPOTS, spots, np.full(len(spots), bucket)), (OTHERS, others, _shelf(others["doc"], shelves))])
    begin, _, second = _classes(rows)
    more = np.maximum.reduceat(rows["more"], begin) > 0 if len(rows) else np.zeros(0, bool)
    seed, run, head = [], [], []
    for b, s in zip(begin[more].tolist(), second[more].tolist()):
        own = rows[[b, s] if s >= 0 else [b]]
        place = np.empty(len(own), PLACE)
        place["doc"], place["at"] = own["doc"], own["at"]
        seed.append(int(own["seed"][0].astype(np.int64)))
        run.append(int(own["run"][0]))
        head.append(place.tobytes())
    n, m = len(out), len(head)
    return pa.table([pa.array([*out.column(0).to_pylist(), *[HEADS] * m], pa.int32()), pa.concat_arrays([out.column(1), pa.nulls(m, pa.int32())]), pa.concat_arrays([out.column(2), pa.nulls(m, pa.binary())]),
                     pa.array([None] * n + seed, pa.int64()), pa.array([None] * n + run, pa.int64()), pa.array([None] * n + head, pa.binary())], names=names)


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of ``n`` numbers that pairs reach, for each."""
    low = np.arange(n)
    while True:
        x, y = low[a], low[b]
        apart = x != y
        if not apart.any():
            return low
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]


def _across(group: np.ndarray, label: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows in one group under different labels, for rows in order of both; only those of ``wanted`` rows, and not many at a time."""
    n = len(group)
    edge = np.concatenate([group[1:] != group[:-1], [True]]) if n else np.zeros(0, bool)
    block = edge | np.concatenate([label[1:] != label[:-1], [True]]) if n else edge
    last = lambda ends: np.flatnonzero(ends)[np.cumsum(ends) - ends] + 1  # noqa: E731  where each row's group or block ends
    to, end = last(edge), last(block)
    count = np.where(wanted, to - end, 0)
    rows = np.flatnonzero(count)
    total, at = np.cumsum(count[rows]), 0
    while at < len(rows):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
        own, n = rows[at:upto], count[rows[at:upto]]
        i = np.repeat(own, n)
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(end[own], n)
        at = upto


def _pairs_apart(group: np.ndarray, label: np.ndarray) -> np.ndarray:
    """For rows in order of group and label: how many pairs of the row's group have different labels."""
    if not len(group):
        return np.zeros(0)
    new = np.concatenate([[True], group[1:] != group[:-1]])
    of = np.cumsum(new) - 1
    block = np.flatnonzero(new | np.concatenate([[True], label[1:] != label[:-1]]))
    equal = np.bincount(of[block], weights=np.diff(np.append(block, len(group))).astype(float) ** 2)
    return ((np.bincount(of).astype(float) ** 2 - equal) / 2)[of]


def _to_meet(group: np.ndarray, label: np.ndarray, doc: np.ndarray, always: np.ndarray | bool = False) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Pairs in a group that differ in label and document: which rows are of groups with few of them, or ``always``, which of
    groups with many, and all pairs of the former, block by block."""
    count = np.unique(group, return_inverse=True, return_counts=True)
    count = count[2][count[1]] if len(group) else np.zeros(0, int)
    orders = [np.lexsort((by, group)) for by in (label, doc)]
    pairs = np.zeros((2, len(group)))
    for p, order, by in zip(pairs, orders, (label, doc)):
        p[order] = _pairs_apart(group[order], by[order])
    least = pairs.min(axis=0)
    few = (least > 0) & ((least <= DIRECT * count) | always)

    def met() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for order, by, wanted in zip(orders, (label, doc), (few & (pairs[0] <= pairs[1]), few & (pairs[0] > pairs[1]))):
            for i, j in _across(group[order], by[order], wanted[order]):
                i, j = order[i], order[j]
                apart = (label[i] != label[j]) & (doc[i] != doc[j])
                yield i[apart], j[apart]

    return few, (least > 0) & ~few, met()


class _Parts:
    """Rows on their way out, packed by the bucket they go to: matches once each, as far as they are held at the same time, or keys in order."""

    def __init__(self, kind: int, where, distinct: bool = True):
        self.kind, self.where, self.distinct, self.held, self.size, self.out = kind, where, distinct, [], 0, []

    def add(self, rows: np.ndarray) -> None:
        self.held.append(rows)
        self.size += len(rows)
        if self.size < MOST:
            return
        if self.distinct:
            self.held = [_distinct(np.concatenate(self.held))]
            self.size = len(self.held[0])
        if self.size > MOST // 2:
            self.flush()

    def flush(self) -> None:
        if self.size:
            rows = np.concatenate(self.held)
            self.held, self.size = [], 0
            rows = _distinct(rows) if self.distinct else rows[np.argsort(rows["key"], kind="stable")]
            self.out.append(_kinds([(self.kind, rows, self.where(rows))]))

    def batches(self) -> list[pa.RecordBatch]:
        self.flush()
        return self.out


def _rest(spots: np.ndarray, edges: np.ndarray, shelves: int, min_words: int) -> pa.Table:
    """What is still to meet of seeds whose occurrences have not met in all pairs, given all of them and where they lie in passages.

    Occurrences in both documents of a passage are connected and need not meet. Of the others, all pairs meet where they are few; else the seed
    is hot, and its occurrences go to their documents, to meet those that agree in more than this seed. Overlapping
    occurrences in a document, of a word said again and again, are one, with its two ends; those that fill a passage meet the first.
    """
    spots = spots[np.lexsort((spots["at"], spots["doc"], spots["seed"]))]
    seed, at = spots["seed"], spots["at"].astype(np.int64)
    gap = np.append(0, np.diff(at)) if len(spots) else at
    other = np.concatenate([[True], (seed[1:] != seed[:-1]) | (spots["doc"][1:] != spots["doc"][:-1])]) if len(spots) else np.zeros(0, bool)
    new = other | (gap > WORDS)
    begin, unit = np.flatnonzero(new), np.cumsum(new) - 1
    label = np.arange(len(begin))
    if len(spots) and len(edges):
        seeds_, docs = np.unique(seed), np.unique(spots["doc"])
        held = np.searchsorted(seeds_, seed[other]) * len(docs) + np.searchsorted(docs, spots["doc"][other])  # each seed's documents, in order
        place = (np.cumsum(other) - 1 << 32) + at

        def group(doc: np.ndarray) -> np.ndarray:
            s, d = np.minimum(np.searchsorted(seeds_, edges["seed"]), len(seeds_) - 1), np.minimum(np.searchsorted(docs, doc), len(docs) - 1)
            k = np.minimum(np.searchsorted(held, s * len(docs) + d), len(held) - 1)
            return np.where((seeds_[s] == edges["seed"]) & (docs[d] == doc) & (held[k] == s * len(docs) + d), k, -1)

        a, b = group(edges["doc"]), group(edges["other"])
        x, y = (np.minimum(np.searchsorted(place, (k << 32) + p), len(place) - 1) for k, p in ((a, edges["at"]), (b, edges["low"])))
        fine = (a >= 0) & (b >= 0) & (place[x] == (a << 32) + edges["at"]) & (place[y] >= (b << 32) + edges["low"]) & (place[y] <= (b << 32) + edges["high"] - WORDS)
        label = _joined(len(begin), unit[x[fine]], unit[y[fine]])
    size = np.diff(np.append(begin, len(spots)))
    last = begin + size - 1
    step = np.where(new, 0, gap)
    high = np.maximum.reduceat(step, begin) if len(begin) else begin
    low = np.minimum.reduceat(np.where(new, WORDS + 1, step), begin) if len(begin) else begin
    even = (low == high) & (high > 0)

    few, hot, met = _to_meet(seed[begin], label, spots["doc"][begin])
    found = _Parts(MATCHES, lambda x: _shelf(x["doc"], shelves))

    def paired(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return _paired(spots["doc"][i], spots["at"][i], spots["doc"][j], spots["at"][j], 1)

    for i, j in met:
        run = (size[i] > 1) | (size[j] > 1)
        found.add(paired(begin[i], begin[j]))
        found.add(paired(last[i[run]], last[j[run]]))

    long = np.flatnonzero(even & (at[last] - at[begin] + WORDS >= min_words)) if len(begin) else begin
    if len(long):
        long = long[np.lexsort((long, high[long], seed[begin[long]]))]
        s, h = seed[begin[long]], high[long]
        head = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (h[1:] != h[:-1])]))
        to = long[np.repeat(head, np.diff(np.append(head, len(long))))]
        long, to = long[label[long] != label[to]], to[label[long] != label[to]]
        n = np.minimum(size[long], size[to])
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        found.add(paired(np.repeat(begin[long], n) + k, np.repeat(begin[to], n) + k))

    def near(own: np.ndarray, is_hot: int) -> np.ndarray:
        places = np.concatenate([begin[own], last[own[size[own] > 1]]])
        root = begin[label[unit[places]]]
        out = np.empty(len(places), NEAR)
        out["seed"], out["doc"], out["at"], out["hot"] = seed[places], spots["doc"][places], spots["at"][places], is_hot
        out["label"] = _label(spots["doc"][root], spots["at"][root])
        return out

    others, near_hot = near(np.flatnonzero(few), 0), near(np.flatnonzero(hot), 1)
    return pa.Table.from_batches([*found.batches(), _kinds([(OTHERS, others, _shelf(others["doc"], shelves)), (HOT, near_hot, _shelf(near_hot["doc"], shelves))])])


def _inside(spots: np.ndarray, links: np.ndarray) -> np.ndarray:
    """The spots inside passages, with the passage in the other document."""
    spots = spots[np.lexsort((spots["at"], spots["doc"]))]
    docs, begin = np.unique(spots["doc"], return_index=True)
    of = np.repeat(np.arange(len(docs)), np.diff(np.append(begin, len(spots))))
    place = (of << 32) + spots["at"]
    if not len(docs):
        return np.zeros(0, SIDE)
    k = np.minimum(np.searchsorted(docs, links["doc"]), len(docs) - 1)
    links, k = links[docs[k] == links["doc"]], k[docs[k] == links["doc"]]
    low, high = np.searchsorted(place, (k << 32) + links["lo"]), np.searchsorted(place, (k << 32) + links["hi"] - WORDS, side="right")
    n = np.maximum(high - low, 0)
    link = np.repeat(np.arange(len(links)), n)
    own = np.arange(len(link)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    out = np.empty(len(own), SIDE)
    for f in SPOT.names:
        out[f] = spots[f][own]
    for f in ("other", "low", "high"):
        out[f] = links[f][link]
    return out


def _label(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((_mixed(doc) ^ (at.astype(np.uint64) + np.uint64(1)) * _M1) * _M2 >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _key(*seeds: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = seeds[0] * _M1
        for s in seeds[1:]:
            out = (out ^ (out >> np.uint64(31)) ^ s) * _M2
    return out


def _keys(near: np.ndarray, buckets: int) -> pa.Table:
    """Keys of several seeds in reach of each other, of all documents whose seeds these are.

    In a chain of three or more matches, a match of a hot seed has one of a seed that is not hot at most two steps away, or is one of
    three matches of hot seeds that follow each other. So a hot seed goes with every other one within two steps, and with
    every two hot ones, a step apart each, the nearest of their kind.
    """
    near = near[np.lexsort((near["at"], near["doc"]))]
    reach, at = REACH + WORDS, near["at"].astype(np.int64)
    of = np.cumsum(np.concatenate([[False], near["doc"][1:] != near["doc"][:-1]])) if len(near) else at
    place = (of << 33) + at  # no two documents are within reach
    hot, cool = np.flatnonzero(near["hot"]), np.flatnonzero(near["hot"] == 0)
    out = _Parts(MATCHES, lambda x: (x["key"] % np.uint64(buckets)).astype(np.int64), False)

    def within(own: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = high - low
        return np.repeat(own, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)

    for begin in range(0, len(hot), 20_000):
        own = hot[begin:begin + 20_000]
        f, n = within(own, np.searchsorted(place[cool], place[own] - 2 * reach), np.searchsorted(place[cool], place[own] + 2 * reach, side="right"))
        n = cool[n]
        part = np.zeros(len(f), KEY)
        part["key"], part["doc"], part["a"], part["seeds"] = _key(near["seed"][f], near["seed"][n], (n > f).astype(np.uint64)), near["doc"][f], at[f], 1
        part["x"], part["y"] = np.where(near["label"][n] > 0, near["label"][n], _label(near["doc"][n], at[n])), near["label"][f]
        out.add(part)
    seed, spot = near["seed"][hot], place[hot]
    order = np.lexsort((np.arange(len(hot)), seed, of[hot]))
    before = np.full(len(hot), -1)
    again = np.flatnonzero((seed[order][1:] == seed[order][:-1]) & (of[hot][order][1:] == of[hot][order][:-1])) + 1
    before[order[again]] = order[again - 1]
    high = np.searchsorted(spot, spot + reach, side="right")
    for begin in range(0, len(hot), 1_000):
        i = np.arange(begin, min(begin + 1_000, len(hot)))
        i, j = within(i, i + 1, high[i])
        fine = (spot[j] > spot[i]) & (before[j] < i) & (seed[i] != seed[j])
        i, j = i[fine], j[fine]
        k, c = within(np.arange(len(j)), j + 1, high[j])
        a, b = i[k], j[k]
        fine = (spot[c] > spot[b]) & (before[c] < b) & (seed[c] != seed[b]) & (seed[c] != seed[a])
        a, b, c = hot[a[fine]], hot[b[fine]], hot[c[fine]]
        part = np.zeros(len(a), KEY)
        part["key"], part["doc"], part["seeds"] = _key(near["seed"][a], near["seed"][b], near["seed"][c]), near["doc"][a], 3
        for f, x, own in (("a", "x", a), ("b", "y", b), ("c", "z", c)):
            part[f], part[x] = at[own], near["label"][own]
        out.add(part)
    return pa.Table.from_batches([*out.batches(), _kinds([])])


def _keyed(rows: np.ndarray, shelves: int) -> pa.Table:
    """Matches of hot seeds between documents that hold the same key, where none of the key's seeds connects them yet; and the
    members of lists of three hot seeds, as of a line that very many documents hold, that would have too many of them."""
    rows = rows[np.lexsort((rows["c"], rows["b"], rows["a"], rows["doc"], rows["x"], rows["key"]))]
    _, many, met = _to_meet(rows["key"], rows["x"], rows["doc"], rows["seeds"] == 1)
    found = _Parts(MATCHES, lambda x: _shelf(x["doc"], shelves))
    for i, j in met:
        apart = _apart(rows, i, j)
        found.add(_distinct(_agreed(rows, i[apart], j[apart])))
    long = rows[many]
    _, of, count = np.unique(long["key"], return_inverse=True, return_counts=True)
    long["parts"] = -(-count[of] // TILE)
    long["part"] = _mixed(long["doc"]) % long["parts"]
    return pa.Table.from_batches([*found.batches(), _kinds([(WIDE, long, _shelf(long["doc"], shelves))])])


def _apart(rows: np.ndarray | dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows are of different documents and none of their seeds connects them."""
    return (rows["doc"][i] != rows["doc"][j]) & (rows["x"][i] != rows["x"][j]) & (rows["y"][i] != rows["y"][j]) & ((rows["seeds"][i] == 1) | (rows["z"][i] != rows["z"][j]))


def _agreed(rows: np.ndarray | dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Matches of the hot seeds of keys."""
    doc, other, three = rows["doc"][i], rows["doc"][j], rows["seeds"][i] == 3
    found = [_paired(doc, rows["a"][i], other, rows["a"][j], 1)]
    found += [_paired(doc[three], rows[f][i][three], other[three], rows[f][j][three], 1) for f in ("b", "c")]
    return np.concatenate(found)


def _around(hashes: np.ndarray, keys: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Members with the words before and after their seeds as small numbers, 0 outside the text; once for each tile they are in."""
    width = kind["before"].shape[0]
    edge = np.zeros(width, np.uint16)
    words = np.concatenate([edge, np.maximum(hashes & np.uint64(0xFFFF), np.uint64(2)).astype(np.uint16), edge])
    n = keys["parts"].astype(np.int64)
    own = np.repeat(np.arange(len(keys)), n)
    out = np.empty(len(own), kind)
    for f in KEY.names:
        out[f] = keys[f][own]
    other = (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
    out["low"], out["high"] = np.minimum(out["part"], other), np.maximum(out["part"], other)
    begin, end = (np.clip(x, 0, len(hashes))[:, None] + np.arange(width) for x in (out["a"], out["c"] + WORDS))
    out["before"], out["after"] = words[begin], words[end + width]
    return out


def _dealt_wide(rows: np.ndarray, buckets: int) -> pa.RecordBatch:
    return _kinds([(WIDE, rows, _shelf((rows["key"] ^ rows["low"] * _M1 ^ rows["high"] * _M2).view(np.int64), buckets))])


def _alike(rows: np.ndarray, need: int, shelves: int) -> pa.Table:
    """Matches between members of long lists that may share a passage: between their seeds, and in the same places
    before and after them, they must have ``need`` equal words. Compares all pairs, block by block."""
    rows = rows[np.lexsort((rows["doc"], rows["high"], rows["low"], rows["key"]))]
    new = np.concatenate([[True], np.logical_or.reduce([rows[f][1:] != rows[f][:-1] for f in ("key", "low", "high")])]) if len(rows) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    core = rows["c"] + WORDS - rows["a"]
    words = np.concatenate([rows["before"], rows["after"]], axis=1).T.copy()
    others = np.where(words == 0, np.uint16(1), words)  # outside of both texts nothing is equal
    keys = {f: np.ascontiguousarray(rows[f]) for f in KEY.names}  # apart from the wide rows
    found = _Parts(MATCHES, lambda x: _shelf(x["doc"], shelves))
    for lo, hi in zip(begin.tolist(), np.append(begin[1:], len(rows)).tolist()):
        one = bool(rows["low"][lo] == rows["high"][lo])
        left = lo + np.flatnonzero(rows["part"][lo:hi] == rows["low"][lo])
        right = left if one else lo + np.flatnonzero(rows["part"][lo:hi] == rows["high"][lo])
        for x in range(0, len(left), 256):
            own = left[x:x + 256]
            mine = np.ascontiguousarray(words[:, own])[:, :, None]
            for y in range(x if one else 0, len(right), 512):
                to = right[y:y + 512]
                theirs = np.ascontiguousarray(others[:, to])
                equal = np.minimum(core[own][:, None], core[to]).astype(np.uint16)
                same = np.empty(equal.shape, bool)
                for first in range(0, len(words), 255):
                    some = np.zeros(equal.shape, np.uint8)
                    for k in range(first, min(first + 255, len(words))):
                        np.equal(mine[k], theirs[k], out=same)
                        np.add(some, same.view(np.uint8), out=some)
                    equal += some
                i, j = np.nonzero(equal >= need)
                i, j = own[i], to[j]
                apart = _apart(keys, i, j) & ((i < j) | (not one))
                found.add(_agreed(keys, i[apart], j[apart]))
    return pa.Table.from_batches([*found.batches(), _kinds([])])


def _chained(found: np.ndarray, words: int, min_words: int, fresh: bool = False) -> pa.Table:
    """Chains of matches between two documents that may cover a passage; if ``fresh``, those that hold a match of the second round.

    No chain goes over a gap out of reach, so matches on either side of one are chained apart. Matches that run forward in both
    documents, the next always in reach, are one chain: a match scores more than the words between two of them cost.
    """
    found = _distinct(found)
    doc, other, at, there, late = (np.ascontiguousarray(found[f]) for f in ("doc", "other", "at", "there", "late"))
    most, least = REACH + words, min_words // 5
    forward = GAP * 2 * most < words
    apart = np.concatenate([[True], (doc[1:] != doc[:-1]) | (other[1:] != other[:-1]) | (at[1:] > at[:-1] + most)])[:len(found)]
    begin = np.flatnonzero(apart)
    end = np.append(begin[1:], len(found)).astype(int)
    order, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def fine(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = (end - begin >= LEAST) & (at[end - 1] - at[begin] + words >= least)  # places are in order
        if fresh and len(begin):
            upto = np.concatenate([[0], np.cumsum(late > 0)])
            out &= upto[end] > upto[begin]
        return out

    if len(found):
        back = ~apart & (np.concatenate([[False], (at[1:] <= at[:-1]) | (there[1:] <= there[:-1])]))
        straight = np.add.reduceat(back, begin) == 0 if forward else np.zeros(len(begin), bool)
        far = apart | np.concatenate([[True], there[1:] > there[:-1] + most])
        first = np.flatnonzero(far & np.repeat(straight, end - begin))
        last = np.append(np.flatnonzero(far), len(found))
        last = last[np.searchsorted(last, first, side="right")]
        kept = fine(first, last)
        size = (last - first)[kept]
        order.append(np.repeat(first[kept] - np.cumsum(size) + size, size) + np.arange(size.sum()))
        ends.append(size)
        wanted = ~straight & fine(begin, end)
        for a, b in zip(begin[wanted].tolist(), end[wanted].tolist()):
            for own in chains(at[a:b].astype(np.int64), there[a:b].astype(np.int64), words, REACH, GAP):
                # Seeds may lie a window and a few changed words inside a passage's ends.
                if len(own) >= LEAST and at[a + own[-1]] - at[a + own[0]] + words >= least and (not fresh or late[a:b][own].any()):
                    order.append(np.array(own) + a)
                    ends.append(np.array([len(own)]))
    order, size = np.concatenate(order), np.concatenate(ends)
    first = order[np.cumsum(size) - size]
    ends = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(x[order], pa.int32())) for x in (at, there)]
    return pa.table({"doc": pa.array(doc[first], pa.int64()), "other": pa.array(other[first], pa.int64()), "at": lists[0], "there": lists[1]})


def _texts_of(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Compressed texts of the documents in ``of``, and of some more: a table of fixed size tells which may be among them."""
    spot = F.pmod("of", F.lit(ASKED)).cast("int")
    table = ends.select(spot.alias("k")).groupBy(F.floor(F.col("k") / 32).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, k % 32)")).alias("bits")).toArrow()
    asked = np.zeros(ASKED // 32 + 1, np.uint32)
    asked[table["word"].to_numpy()] = table["bits"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            k = batch.column(0).to_numpy() % ASKED
            own = batch.filter(pa.array((asked[k // 32] >> (k % 32).astype(np.uint32) & 1).astype(bool)))
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array([compressor.compress(t) for t in texts(own.column(1))], pa.binary())], names=["doc", "data"])

    return rows.mapInArrow(lean(run), "doc bigint, data binary")


def word_spans(text: bytes) -> np.ndarray:
    """Begin and end of every word in code points."""
    inside = np.frombuffer(text.translate(LATIN), np.uint8) != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return points[edges].astype(np.int32).reshape(-1, 2)


def _merged_blocks(own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words and spans of an id with several texts: of each block the smallest."""
    known, blocks = Words(1 << 12), {}
    for text in own:
        hashes, spans, keys = known.hashes(text).astype(np.uint32), word_spans(text), _words_in([text])[0][0]
        for n in range(0, len(hashes), BLOCK):
            begin, end = spans[n:n + BLOCK, 0], spans[n:n + BLOCK, 1]
            gaps = np.concatenate([begin - np.concatenate([[0], end[:-1]]), end - begin]).astype(np.int32)
            entry = (hashes[n:n + BLOCK].tobytes(), zstandard.compress(gaps.tobytes(), 1)), keys[n:n + BLOCK], spans[n:n + BLOCK]
            if n not in blocks or entry[0] < blocks[n][0]:
                blocks[n] = entry
    own = [blocks[n] for n in sorted(blocks)]
    return np.concatenate([np.zeros(0, np.uint32), *[x[1] for x in own]]), np.concatenate([np.zeros((0, 2), np.int32), *[x[2] for x in own]])


def _words_in(own: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text 32-bit hashes of its words, and where they begin and end in code points."""
    plain, begin, end, first, upto = _joined_texts(own)
    keys = _word_keys(plain, begin, end - begin)
    for k in np.flatnonzero(end - begin > LONG).tolist():
        keys[k] = xxhash.xxh3_64_intdigest(plain[begin[k]:end[k]])
    hashes = (keys >> np.uint64(32)).astype(np.uint32)
    points = np.concatenate([[0], np.cumsum((np.frombuffer(b" ".join(own), np.uint8) & 0xC0) != 0x80)])
    spans = np.stack([points[begin], points[end]], axis=1)
    return [(hashes[lo:hi], (spans[lo:hi] - points[at]).astype(np.int32)) for lo, hi, at in zip(upto[:-1].tolist(), upto[1:].tolist(), first.tolist())]


def _with_words(own: pa.Table, chained: pa.Table, by: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The chains of each document of a group, as a row number, with the document's words and spans."""
    ids = chained[by].to_numpy()
    order = np.argsort(ids, kind="stable")
    docs, begin = np.unique(ids[order], return_index=True)
    rows = dict(zip(docs.tolist(), np.split(order, begin[1:])))
    place = own["doc"].to_numpy()
    kept = np.flatnonzero(np.isin(place, docs))
    place, counts = place[kept].tolist(), {}
    for doc in place:
        counts[doc] = counts.get(doc, 0) + 1
    data, several, decompress = own["data"].combine_chunks().take(pa.array(kept)), {}, zstandard.ZstdDecompressor().decompress

    def single() -> Iterator[tuple[int, bytes]]:
        for k, doc in enumerate(place):
            if counts[doc] == 1:
                yield doc, decompress(data[k].as_py())
            else:
                several.setdefault(doc, []).append(decompress(data[k].as_py()))

    for some, own_texts in _batches_of(single()):
        for doc, (hashes, spans) in zip(some, _words_in(own_texts)):
            for k in rows[doc].tolist():
                yield k, hashes, spans
    for doc, own_texts in several.items():
        hashes, spans = _merged_blocks(own_texts)
        for k in rows[doc].tolist():
            yield k, hashes, spans


def _around_chain(places: list[int], words: int, length: int) -> tuple[int, int]:
    """The words around a chain in one text, in whole blocks."""
    return max(0, places[0] - BLOCK) // BLOCK * BLOCK, min(length, ((places[-1] + words + BLOCK) // BLOCK + 1) * BLOCK)


def _cut(own: pa.Table, chained: pa.Table, words: int) -> pa.Table:
    """Chains with the smaller document's words around them, and in code points where they begin, and the gap before and the length of each."""
    kept, first, hashed, point, places = [], [], [], [], []
    there = chained["there"].combine_chunks()
    for k, hashes, spans in _with_words(own, chained, "other"):
        lo, hi = _around_chain(there[k].as_py(), words, len(hashes))
        begin, end = spans[lo:hi, 0], spans[lo:hi, 1]
        at = int(begin[0]) if hi > lo else 0
        gaps = np.concatenate([begin - np.concatenate([[at], end[:-1]]), end - begin])
        kept.append(k)
        first.append(lo)
        hashed.append(hashes[lo:hi].tobytes())
        point.append(at)
        places.append((gaps.astype(np.uint8) if not len(gaps) or gaps.max() < 256 else gaps.astype(np.int32)).tobytes())
    out = chained.select(["doc", "other", "at", "there"]).take(pa.array(kept, pa.int64()))
    for name, values, form in (("first", first, pa.int32()), ("words", hashed, pa.binary()), ("point", point, pa.int32()), ("spans", places, pa.binary())):
        out = out.append_column(name, pa.array(values, form))
    return out


def _aligned(own: pa.Table, chained: pa.Table, words: int, min_words: int, similarity: float) -> pa.Table:
    """Passages along chains, in the words of the larger document and those that came with the chain."""
    out, column = [], {f: chained[f].combine_chunks() for f in chained.column_names}
    doc, other, first, point = (column[f].to_numpy() for f in ("doc", "other", "first", "point"))
    for k, hashes, spans in _with_words(own, chained, "doc"):
        at, there = column["at"][k].as_py(), column["there"][k].as_py()
        a0, hi = _around_chain(at, words, len(hashes))
        b, b0 = np.frombuffer(column["words"][k].as_py(), np.uint32), int(first[k])
        if hi <= a0 or not len(b):
            continue
        places = None
        for lo, hi, low, high, same, columns in stretches(hashes[a0:hi], b, [p - a0 for p in at], [q - b0 for q in there], words, min_words, similarity):
            if places is None:
                raw = column["spans"][k].as_py()
                gap, length = np.frombuffer(raw, np.uint8 if len(raw) == 2 * len(b) else np.int32).astype(np.int64).reshape(2, -1)
                places = int(point[k]) + np.cumsum(gap + length)
            d, o = int(doc[k]), int(other[k])
            link = np.array([(d, o, a0 + lo, a0 + hi, b0 + low, b0 + high)], LINK)
            out.append((d, int(spans[a0 + lo, 0]), int(spans[a0 + hi - 1, 1]), o, int(places[low] - length[low]), int(places[high - 1]), hi - lo, same / columns, link.tobytes()))
    names = ["doc", "start", "end", "other_id", "other_start", "other_end", "n_words", "similarity", "link"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary()]
    return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * 9, kinds)], names=names)
