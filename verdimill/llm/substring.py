"""Near-duplicate passages by compact windows over token min-hashes.

Tokens are 5-word shingles, hashed by one function.  The Cartesian tree of a
text's token hashes assigns every subsequence to the node of its smallest hash:
node c with range [l, r) stands for all subsequences of [l, r) that hold c, and
they all have the min-hash of c.  A break in a passage costs at least nine
shingles, so a passage of MIN_WORDS words and SIMILARITY holds a run of RUN equal
words.  The run's token is the least of the shingles that have SIDE words of the
run on both sides; only nodes that are such a token are made (one for about seven
words), with ranges clipped to what a run can use.  Of equal hashes the leftmost is
taken, so both texts choose the same one, even where shingles repeat.

Windows are joined on their token and SIDE words on both sides of it.  A group
is not expanded into pairs: each member is linked to the group's first text
(smallest doc_id), and links whose ranges can't hold a run of RUN words go.
Where a member's link did not prove right, the words around the tokens of its group are
fetched and compared: members are taken by doc_id, and each is linked to the
earlier ones with which it shares a passage that is not yet represented.  Groups
of more than LIMIT members are split by the runs of RUN words around the key, and
what is still larger is compared block by block, so that no task holds more.

Texts of equal words are found by a hash of all their words (with the number of
words 86 bits and more); only the first of them takes part in all this.

Links of two texts are merged by diagonal into intervals, the words of the
intervals are fetched, and aligned shingles have the last word: MIN_WORDS words or more on
both sides and a similarity of SIMILARITY.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, settle, small_batches, text_bytes, tidied, unused

SHINGLE, MIN_WORDS, SIMILARITY = 5, 50, 0.8
#: Equal words in a row that every passage holds; words of a key on both sides of its token; shingles among which a token is the least.
RUN, SIDE = 25, 4
WIDTH = RUN - SHINGLE + 1 - 2 * SIDE
#: Window rows that a task sends at once, texts whose copies a task remembers.
BUFFER, TEXTS = 500_000, 100_000
#: Bytes whose words are hashed at once.
CHUNK = 1 << 21
#: Links are merged if their offsets differ by less than this; intervals begin and end at its multiples.
DIAGONAL = 64
#: Words between matching shingles that still belong to one passage.
GAP = 12
#: Where words repeat with a short period, a text has equal keys one after the other.  Of a stretch of MIN_WORDS words or more both ends are kept and one in so many words.
STEP = 32
#: Words fetched on both sides of a token where a group is compared; members that one task compares.
AROUND, LIMIT = 64, 1 << 14
#: Shingles that more members of a group hold are frequent there; shingles that a break in a chain costs the other text.
RARE, BREAK = 32, 3
#: In groups of so many, all pairs are compared.
SMALL = 8
#: A group's table of members by frequent shingles has at most two to this power cells: in large groups, more members make a shingle frequent.
CELLS = 27
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A position packs the token's place, TAG bits of the whole text's hash and the clipped range.
_TAG = (1 << 22) - 1
_WHOLE, _COPY = 0, 1023


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_LOWER = np.array([x + 32 if 65 <= x <= 90 else x for x in range(256)], np.uint64)
_IN_WORD = np.array([not (x == 32 or 9 <= x <= 13) for x in range(256)])


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, out=out)


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, A-Z in lower case, and the number of words of each text.

    A word's hash is a polynomial of its bytes, mixed with its length.  Pieces of CHUNK bytes bound the memory; a longer word gets a piece of its own.
    """
    data = b"\n".join([*texts, b""])
    raw = np.frombuffer(data, np.uint8)
    hashes, starts = [], []
    at, n = 0, len(data)
    power = back = np.zeros(0, np.uint64)
    while at < n:
        to = min(at + CHUNK, n)
        while to < n and _IN_WORD[raw[to - 1]]:
            stop = np.flatnonzero(~_IN_WORD[raw[to : to + CHUNK]])
            to = to + int(stop[0]) + 1 if len(stop) else min(to + CHUNK, n)
        piece = raw[at:to]
        inside = _IN_WORD[piece]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        lo, hi = edge[::2], edge[1::2]
        if len(power) < len(piece):
            power, back = _powers(len(piece), _ODD), _powers(len(piece), _INVERSE)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_LOWER[piece] * power[: len(piece)], out=total[1:])
        hashes.append(_mix((total[hi] - total[lo]) * back[lo] ^ _mix((hi - lo).astype(np.uint64))) if len(lo) else np.zeros(0, np.uint64))
        starts.append(lo + at)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    begin = np.concatenate(starts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.concatenate(hashes), np.diff(np.searchsorted(begin, ends), prepend=0)


def _sums(h: np.ndarray):
    """Prefix sums of h[i] * ODD**i, and the inverse powers: hashes of any window, by _span."""
    n = len(h)
    power = np.full(n + 1, _ODD, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    back = np.full(n + 1, _INVERSE, np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * power[:n], out=total[1:])
    return total, back


def _span(sums: tuple, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    total, back = sums
    return _mix((total[hi] - total[lo]) * back[lo])


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of all shingles from the hashes of the words."""
    n = len(h) - SHINGLE + 1
    s = np.zeros(max(n, 0), np.uint64)
    for j in range(SHINGLE if n > 0 else 0):
        s = s * _ODD + h[j : j + n]
    return _mix(s)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x, have = np.minimum(x[:-have], x[have:]), 2 * have
    return np.minimum(x[: have - width], x[width - have :]) if have < width else x


def compact_windows(v: np.ndarray, width: int, valid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the nodes of the Cartesian tree of v whose range is at least ``width`` wide, clipped to ``width`` on both sides of c.

    Of equal minima the leftmost is taken.  ``valid`` names the starts of the
    subsequences of this width that count.  A node is the minimum of some such
    subsequence, so the nodes are the sliding minima.
    """
    n = len(v) - width + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    mask = _U((1 << len(v).bit_length()) - 1)
    at = (_least(v & ~mask | np.arange(len(v), dtype=np.uint64), width) & mask).astype(np.int64)
    start = np.arange(n) if valid is None else np.flatnonzero(valid[:n])
    if not len(start):
        return (np.zeros(0, np.int64),) * 3
    at = at[start]
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return start[new], at[new], start[np.r_[new[1:] - 1, len(at) - 1]] + width


def _pack(c: np.ndarray, tag: np.ndarray, l: np.ndarray, r: np.ndarray) -> np.ndarray:
    return c << 32 | tag << 10 | (c - l) << 5 | (r - c)


def _unpack(pos: np.ndarray):
    c = pos >> 32
    return c - (pos >> 5 & 31), c, c + (pos & 31)


def _windows(h: np.ndarray, size: np.ndarray, sums: tuple):
    """(text, key, position) of the windows of texts of MIN_WORDS words or more, one after the other.

    A stretch of equal keys, words with a short period, meets others of that kind
    under a key of its own if it is a passage by its length.  If not, it has no
    windows: with 13 words more on a side, other windows hold a run.
    """
    end = np.cumsum(size)
    begin = end - size
    owner = np.repeat(np.arange(len(size)), size)
    n = max(len(h) - RUN + 1, 0)
    s = shingles(h)
    l, c, r = compact_windows(s[SIDE:], WIDTH, owner[:n] == owner[len(h) - n :])
    l, c, r = l + SIDE, c + SIDE, r + SIDE
    own = owner[c]
    if not len(c):
        return own, c, c, l, r
    key = _mix(s[c] ^ _span(sums, c - SIDE, c + SHINGLE + SIDE))
    order = np.lexsort((c, key, own))
    k, at = key[order], c[order]
    near = (k[1:] == k[:-1]) & (own[order][1:] == own[order][:-1]) & (at[1:] - at[:-1] <= WIDTH)
    before, after = np.r_[False, near], np.r_[near, False]
    stretch = np.cumsum(~before) - 1
    first, last = np.flatnonzero(~before), np.flatnonzero(~after)
    # The whole stretch, up to the first words that differ from those a period before.
    length = np.zeros(len(first), np.int64)
    many = np.flatnonzero(last > first)
    period = at[first[many] + 1] - at[first[many]]
    text = own[order][first[many]]
    for p in np.unique(period).tolist():
        some = period == p
        breaks = np.flatnonzero(h[p:] != h[:-p])
        left, right = at[first[many[some]]] - SIDE, at[last[many[some]]] + SHINGLE + SIDE
        stop = np.append(breaks + p, len(h))[np.searchsorted(breaks, right - p)]
        start = np.insert(breaks + 1, 0, 0)[np.searchsorted(breaks, left)]
        length[many[some]] = np.minimum(stop, end[text[some]]) - np.maximum(start, begin[text[some]])
    long = (length >= MIN_WORDS)[stretch]
    alone, ends = ~(before | after), ~(before & after)
    use = alone | long & (ends | (at // STEP != np.r_[-1, at[:-1] // STEP]))
    key &= ~_U(1)
    key[order[~alone]] = _mix(key[order[~alone]]) | _U(1)
    rows = np.sort(order[use])
    own, base = own[rows], begin[own[rows]]
    return own, key[rows].view(np.int64), c[rows] - base, l[rows] - base, r[rows] - base


_COLUMNS = ("key", "doc", "pos")
_SCHEMA = ", ".join(f"{c} long" for c in _COLUMNS)


def window_rows(documents: DataFrame) -> DataFrame:
    """Windows of all texts, and a row for each text (_WHOLE) by which copies meet.

    A text whose words a task has met under a smaller doc_id gives one row (_COPY, its key the other's doc_id) and no windows.
    """

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*held, strict=True)], names=list(_COLUMNS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        first: dict[tuple[int, int], int] = {}
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            h, size = hash_words([x.as_py() for x in batch.column(1)])
            use = size >= MIN_WORDS
            if not use.any():
                continue
            h, docs, size = h[np.repeat(use, size)], docs[use], size[use]
            sums, end = _sums(h), np.cumsum(size)
            whole = (_span(sums, end - size, end) ^ _mix(size.view(np.uint64))).view(np.int64)
            tag = (_mix(np.add.reduceat(_mix(h ^ _ODD), end - size)) >> _U(42)).astype(np.int64)
            place = size << 32 | tag << 10
            key, chosen, gone = whole.copy(), np.ones(len(docs), bool), np.zeros(len(docs), bool)
            for i, of in enumerate(zip(whole.tolist(), place.tolist(), strict=True)):
                least = first.get(of)
                if least is None or docs[i] < least:
                    if len(first) >= TEXTS:
                        first.clear()
                    first[of] = int(docs[i])
                else:
                    chosen[i], gone[i], key[i] = False, docs[i] == least, least
            held.append((key[~gone], docs[~gone], np.where(chosen, place, place | _COPY)[~gone]))
            if not chosen.all():
                h, docs, size, tag = h[np.repeat(chosen, size)], docs[chosen], size[chosen], tag[chosen]
                sums = _sums(h)
            own, keys, c, l, r = _windows(h, size, sums)
            held.append((keys, docs[own], _pack(c, tag[own], l, r)))
            rows += len(own)
            if rows >= BUFFER:
                yield batch_of(held)
                held, rows = [], 0
        if held:
            yield batch_of(held)

    return small_batches(documents).where("doc_id IS NOT NULL").select("doc_id", text_bytes().alias("text")).mapInArrow(tidied(run), _SCHEMA)


def _links(doc, pos, doc2, pos2) -> pa.RecordBatch:
    """a > b: two texts, and the words of each around an equal token that windows of both allow."""
    l, c, r = _unpack(pos)
    l2, c2, r2 = _unpack(pos2)
    left, right = np.minimum(c - l, c2 - l2), np.minimum(r - c, r2 - c2)
    use = left + right >= WIDTH
    # An edit ends the windows, not the passage: a passage's length more is fetched on both sides.
    more, after = SIDE + MIN_WORDS, SHINGLE - 1 + SIDE + MIN_WORDS
    down, up = (lambda x: np.maximum(x, 0) // DIAGONAL * DIAGONAL), (lambda x: -(-x // DIAGONAL) * DIAGONAL)
    cols = [doc, doc2, down(c - left - more), up(c + right + after), down(c2 - left - more), up(c2 + right + after), (c - c2) // DIAGONAL]
    return pa.RecordBatch.from_arrays([pa.array(x[use], pa.int64()) for x in cols], names=["a", "b", "a_from", "a_to", "b_from", "b_to", "diagonal"])


_LINKED = ("key", "a", "pos", "b", "pos2", "kind")
_PAIR, _MANY, _EQUAL = 0, 1, 2


def candidate_links(rows: DataFrame) -> DataFrame:
    """Each window of a group (a, pos) and the group's first one (b, pos2); rows come sorted by key.

    Groups of three windows or more, stretches apart, (kind _MANY) have a row for each window, the
    first included.  Rows of kind _EQUAL name a text and one with the same words.
    """

    def batch_of(key, doc, pos, doc2, pos2, kind) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (key, doc, pos, doc2, pos2, kind)], names=list(_LINKED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None

        def links(x: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = x[0, 1:] != x[0, :-1]
            x = x[:, ~(np.r_[True, new] & np.r_[new, True])]
            if not x.shape[1]:
                return
            whole = np.where((x[2] & _COPY) == _WHOLE, x[2], 0)  # equal words need an equal tag and number too
            x = x[:, np.lexsort((x[2], x[1], whole, x[0]))]
            key, doc, pos = x
            whole = np.where((pos & _COPY) == _WHOLE, pos, 0)
            start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])])
            size = np.diff(np.r_[start, len(key)])
            lead = np.repeat(start, size)
            # All stretches of a group (odd keys) are passages, so each is linked to the first alone.
            kind = np.where(whole != 0, _EQUAL, np.repeat(np.where((size > 2) & (key[start] & 1 == 0), _MANY, _PAIR), size))
            texts = np.repeat(doc[start] != doc[start + size - 1], size)
            use = texts & ((kind == _MANY) | (doc != doc[lead]))
            if use.any():
                lead = lead[use]
                yield batch_of(key[use], doc[use], pos[use], doc[lead], pos[lead], kind[use])

        for batch in batches:
            x = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            copy = (x[2] & _COPY) == _COPY
            if copy.any():
                key, doc, pos = x[:, copy]
                yield batch_of(key, doc, pos & ~_COPY, key, pos & ~_COPY, np.full(len(key), _EQUAL))
                x = x[:, ~copy]
            if held is not None:
                x = np.concatenate([held, x], axis=1)
            if not x.shape[1]:
                continue
            ends = np.flatnonzero(x[0] != x[0, -1])
            at = int(ends[-1]) + 1 if len(ends) else 0
            if at:
                yield from links(x[:, :at])
            held = x[:, at:]
        if held is not None and held.shape[1]:
            yield from links(held)

    return rows.mapInArrow(tidied(run), ", ".join(f"{c} long" for c in _LINKED))


def _similarity(x: np.ndarray, y: np.ndarray) -> float:
    x, y = np.unique(x), np.unique(y)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _chains(sa: np.ndarray, sb: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], bool]:
    """Chains of equal shingles: rising places in both sequences, with GAP at most between two; whether no shingle occurs twice in a sequence."""
    order, in_a = np.argsort(sb, kind="stable"), np.sort(sa)
    sorted_b = sb[order]
    if not (in_a[1:] == in_a[:-1]).any() and not (sorted_b[1:] == sorted_b[:-1]).any():
        at = np.minimum(np.searchsorted(sorted_b, sa), len(sb) - 1)
        i = np.flatnonzero(sorted_b[at] == sa)
        if not len(i):
            return [], True
        j = order[at[i]]
        di, dj = i[1:] - i[:-1], j[1:] - j[:-1]
        cut = [0, *(np.flatnonzero((di > GAP) | (dj <= 0) | (np.abs(dj - di) > GAP)) + 1).tolist(), len(i)]
        return [(i[x:y], j[x:y]) for x, y in zip(cut, cut[1:], strict=False) if min(i[y - 1] - i[x], j[y - 1] - j[x]) + SHINGLE >= MIN_WORDS], True
    # Shingles repeat: the nearest equal one along the chain is taken.
    lo, hi = np.searchsorted(sorted_b, sa, "left"), np.searchsorted(sorted_b, sa, "right")
    chains: list[list[tuple[int, int]]] = []
    for i in np.flatnonzero(hi > lo).tolist():
        spots = order[lo[i] : hi[i]]
        if chains:
            last = chains[-1][-1]
            expect = last[1] + i - last[0]
            k = int(np.searchsorted(spots, expect)) if len(spots) > 1 else 0
            near = min((int(spots[x]) for x in (k - 1, k) if 0 <= x < len(spots)), key=lambda j: abs(j - expect))
            if i - last[0] <= GAP and abs(near - expect) <= GAP and near > last[1]:
                chains[-1].append((i, near))
                continue
        # A new chain begins where it can go on longest, and takes the equal shingles to its left.
        ahead = min(len(sa) - i, MIN_WORDS)
        runs = [int(np.argmin(np.append(sa[i : i + ahead][: len(sb) - j] == sb[j : j + ahead], False))) for j in spots[:: max(1, len(spots) // 64)].tolist()]
        j = int(spots[:: max(1, len(spots) // 64)][int(np.argmax(runs))])
        back = 0
        while i - back > 0 and j - back > 0 and sa[i - back - 1] == sb[j - back - 1]:
            back += 1
        chains.append([(i - k, j - k) for k in range(back, -1, -1)])
    return [tuple(np.array(c, np.int64).T) for c in chains], False


def align(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """Passages (a_from, a_to, b_from, b_to, similarity) that two sequences of word hashes share.

    Shingles of a are matched to equal shingles of b along chains; a chain below
    the similarity is cut at its widest gap.
    """
    return _aligned(shingles(a.astype(np.uint64)), shingles(b.astype(np.uint64)))


def _aligned(sa: np.ndarray, sb: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    if len(sa) == 0 or len(sb) == 0:
        return []
    out = []
    todo, once = _chains(sa, sb)
    while todo:
        i, j = todo.pop()
        i0, i1, j0, j1 = int(i[0]), int(i[-1]), int(j[0]), int(j[-1])
        n_a, n_b = i1 - i0 + SHINGLE, j1 - j0 + SHINGLE
        if min(n_a, n_b) < MIN_WORDS:
            continue
        similarity = len(i) / (n_a + n_b - 2 * (SHINGLE - 1) - len(i)) if once else _similarity(sa[i0 : i1 + 1], sb[j0 : j1 + 1])
        if similarity >= SIMILARITY:
            out.append((i0, i0 + n_a, j0, j0 + n_b, similarity))
            continue
        steps = np.maximum(np.diff(i), np.diff(j))
        cut = int(np.argmax(steps)) + 1
        if steps[cut - 1] > 1:
            todo += [(i[:cut], j[:cut]), (i[cut:], j[cut:])]
    return sorted(set(out))


def _cut_out(asked: DataFrame, documents: DataFrame, *names: str) -> DataFrame:
    """doc, lo, hi and ``names`` of ``asked``, and the words from lo to hi as 32-bit hashes (a shingle is five of them).

    What is asked of a text is gathered first, so each text is cut once; the list is as long as the text's windows at most.
    """
    wanted = asked.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi", *names)).alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, size = hash_words([x.as_py() for x in batch.column(2)])
            h, end = h.astype(np.uint32), np.cumsum(size)
            lists = batch.column(1)
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            fields = lists.flatten().flatten()
            lo, hi = (np.minimum(f.to_numpy(zero_copy_only=False), size[owner]) + (end - size)[owner] for f in fields[:2])
            docs = batch.column(0).take(pa.array(owner))
            for at in range(0, len(owner), BUFFER // 10):
                part = slice(at, at + BUFFER // 10)
                out = [h[i:j].tobytes() for i, j in zip(lo[part].tolist(), hi[part].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([docs[part], *(f[part] for f in fields), pa.array(out, pa.binary())], names=["doc", "lo", "hi", *names, "words"])

    schema = ", ".join([*(f"{c} long" for c in ("doc", "lo", "hi", *names)), "words binary"])
    texts = documents.where("doc_id IS NOT NULL").select("doc_id", text_bytes().alias("text"))
    return wanted.join(texts, F.col("doc") == F.col("doc_id")).select("doc", "asked", "text").mapInArrow(tidied(cut), schema)


def _verified(links: DataFrame, documents: DataFrame) -> DataFrame:
    """The passages of linked windows (a, pos, b, pos2), computed once."""

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _links(*(c.to_numpy(zero_copy_only=False) for c in batch.columns))

    links = links.select("a", "pos", "b", "pos2").mapInArrow(tidied(regions), "a long, b long, a_from long, a_to long, b_from long, b_to long, diagonal long")
    region = links.groupBy("a", "b", "diagonal").agg(F.min("a_from").alias("a_from"), F.max("a_to").alias("a_to"), F.min("b_from").alias("b_from"), F.max("b_to").alias("b_to"))
    region = settle(region)
    ask = region.select(F.col("a").alias("doc"), F.col("a_from").alias("lo"), F.col("a_to").alias("hi")).unionByName(region.select(F.col("b").alias("doc"), F.col("b_from").alias("lo"), F.col("b_to").alias("hi"))).distinct()
    words = _cut_out(ask, documents)
    for side in "ab":
        w = words.select(F.col("doc").alias("w_doc"), F.col("lo").alias("w_lo"), F.col("hi").alias("w_hi"), F.col("words").alias(f"{side}_words"))
        region = region.join(w, (F.col(side) == F.col("w_doc")) & (F.col(f"{side}_from") == F.col("w_lo")) & (F.col(f"{side}_to") == F.col("w_hi"))).drop("w_doc", "w_lo", "w_hi")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for a, b, a_from, b_from, x, y in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                for i0, i1, j0, j1, similarity in align(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)):
                    for c, v in zip(cols, (a, a_from + i0, a_from + i1, b, b_from + j0, b_from + j1, similarity), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.float64())], names=["doc_id", "start_word", "end_word", "rep_doc_id", "rep_start_word", "rep_end_word", "similarity"])

    schema = "doc_id long, start_word long, end_word long, rep_doc_id long, rep_start_word long, rep_end_word long, similarity double"
    return settle(region.select("a", "b", "a_from", "b_from", "a_words", "b_words").mapInArrow(tidied(verify), schema).distinct())


def _runs(w: bytes, at: int) -> Iterator[tuple[int, bytes]]:
    """Start and words of each run of RUN words (as 32-bit hashes) that holds the SIDE words on both sides of the token at word ``at``."""
    for x in range(max(at + SHINGLE + SIDE - RUN, 0), at - SIDE + 1):
        part = w[4 * x : 4 * (x + RUN)]
        if len(part) == 4 * RUN:
            yield x, part


def _reaches(hits: np.ndarray, break_cost: np.ndarray | float = 0.0) -> np.ndarray:
    """Whether in some stretch of a row, as long as a passage, the share of hits (1; 0; beyond the text far below 0) reaches the similarity, if each break costs so much more."""
    least = MIN_WORDS - SHINGLE + 1
    over = np.zeros((hits.shape[0], hits.shape[1] + 1))
    np.cumsum(hits - SIMILARITY - break_cost, axis=1, out=over[:, 1:])
    return (over[:, least:] >= np.minimum.accumulate(over, axis=1)[:, :-least] - 1e-9).any(axis=1)


def _dense(a: np.ndarray, other: np.ndarray) -> bool:
    """Whether in some stretch of shingles, as long as a passage, the share of ``other``'s (sorted) reaches the similarity: in every passage it does."""
    if len(a) < MIN_WORDS - SHINGLE + 1 or len(other) == 0:
        return False
    return bool(_reaches((other[np.minimum(np.searchsorted(other, a), len(other) - 1)] == a)[None])[0])


def _sharers(s: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each shingle its number, and how many of the n owners (rising) hold it; for each owner, whether it holds one twice."""
    order = np.argsort(s, kind="stable")
    v, o = s[order], owner[order]
    new = np.r_[True, v[1:] != v[:-1]][: len(v)]
    other = np.r_[True, new[1:] | (o[1:] != o[:-1])][: len(v)]
    number = np.empty(len(v), np.int32)
    rank = np.cumsum(new, dtype=np.int32)
    number[order] = rank
    return number, np.bincount(rank[other], minlength=1)[number], np.bincount(o[~other], minlength=n) > 0


def _open(frequent: np.ndarray, h: np.ndarray, count: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which members can share a passage by their frequent shingles: at all; with one that has no shingle twice, nor has the member.  And in which two words come again within GAP.

    Then a chain has all equal shingles from its first to its last.  Where it breaks, the
    other text has shingles of its own, BREAK at least unless two words of this one come again within GAP.
    Fewer equal shingles can make two breaks one, if those between them go: a break after less than four costs nothing.
    """
    at, any_way, once = np.cumsum(size) - size, np.zeros(len(size), bool), np.zeros(len(size), bool)
    width = np.arange(max(int(count.max()), MIN_WORDS))
    start = np.cumsum(count) - count
    again = np.zeros(len(h), bool)
    for k in range(1, min(GAP + 1, len(h) - 1)):
        same = h[k:] == h[:-k]
        again[: len(same) - 1] |= same[1:] & same[:-1]
    seen = np.r_[0, np.cumsum(again)]
    twice = seen[at + size] > seen[at]
    for k in range(0, len(size), 2048):
        part = slice(k, k + 2048)
        inside = width < count[part, None]
        hits = np.zeros(inside.shape)
        hits[inside] = frequent[start[k] : start[k] + count[part].sum()]
        hit = hits > 0
        breaks = np.zeros(inside.shape, bool)
        breaks[:, 4:] = hit[:, :-4] & hit[:, 1:-3] & hit[:, 2:-2] & hit[:, 3:-1] & ~hit[:, 4:]
        hits[~inside] = -len(width)
        any_way[part] = _reaches(hits)
        once[part] = _reaches(hits, breaks * np.where(twice[part], 0.0, SIMILARITY * BREAK)[:, None])
    return any_way, once, twice


def _partners(docs: list[int], at: list[int], unproved: list[int], words: list[bytes]) -> Iterator[tuple[int, int]]:
    """(member, earlier member of another text) of one group, in order of doc: pairs that share a passage around the group's token (at word ``at``).

    They share a run around it, and are found by that.  Of a pair, one at
    least is ``unproved``, and runs in passages that earlier members hold are done:
    what two texts share beyond such a passage, if it is a run, has tokens of its
    own.  Members with the same words around them are compared once.

    A run can be a line that all members hold, and members can be one text with many edits, so not all
    pairs that share a run are compared.  Members that have a shingle in common which
    RARE at most hold are compared by that.  All others have only more frequent ones in common, so a
    member whose frequent shingles are too thin for a passage (``_open``) shares none with them.
    """
    same: dict[tuple[int, bytes], int] = {}
    first = [same.setdefault((at[i], w), i) if len(w) >= 4 * MIN_WORDS else i for i, w in enumerate(words)]
    alone = [i for i, j in enumerate(first) if i == j]
    row = dict(zip(alone, range(len(alone)), strict=True))
    size = np.array([len(words[i]) // 4 for i in alone])
    count = np.maximum(size - SHINGLE + 1, 0)
    h = np.frombuffer(b"".join([words[i] for i in alone]), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(alone)), count)
    start = np.cumsum(count) - count
    s = shingles(h)[np.arange(len(owner)) - start[owner] + (np.cumsum(size) - size)[owner]]
    rare, cut, any_way, once, repeats = np.zeros(0, np.int32), [0] * (len(alone) + 1), *([False] * len(alone) for _ in range(3))
    small = len(alone) <= SMALL
    if not small:
        number, many, repeats = _sharers(s, owner, len(alone))
        few = max(RARE, len(alone) * len(s) >> CELLS) if len(alone) > RARE else 1
        any_way, once, twice = _open(many > few, h, count, size)
        rare = np.flatnonzero((many > 1) & (many <= few))
        cut = np.searchsorted(rare, np.r_[start, len(s)]).tolist()
        rare = number[rare]
        # Which frequent shingles each member holds; none is in column 0.
        of_number = np.zeros(int(number.max(initial=0)) + 1, np.int32)
        of_number[number[many > few]] = 1
        of_number = np.cumsum(of_number, dtype=np.int32) * of_number
        column = of_number[number]
        holds = np.zeros((len(alone), int(of_number.max()) + 1), bool)
        holds[owner, column] = True
        holds[:, 0] = False
        del h, owner, number, many, of_number
        any_way, once, repeated, repeats = any_way.tolist(), once.tolist(), repeats, repeats.tolist()

    def close_by(k: int, rows: list[int]) -> list[bool]:
        """Which of the rows without a rare shingle in common can share a passage with row k."""
        hits = holds[np.array(rows)[:, None], column[start[k] : start[k] + count[k]]]
        broken = np.zeros(hits.shape, bool)
        broken[:, 1:] = hits[:, :-1] & ~hits[:, 1:]
        either = repeated[rows] | bool(repeats[k] or twice[k])
        return _reaches(hits, broken * np.where(either, 0.0, SIMILARITY * BREAK)[:, None]).tolist()

    @functools.lru_cache(1 << 12)
    def of(k: int) -> tuple[np.ndarray, np.ndarray]:
        x = s[start[k] : start[k] + count[k]]
        return x, np.sort(x)

    # Earlier members with runs that are not done, the proved and the others: those that ``once`` admits, those that hold a shingle twice, the rest.
    waiting: tuple = (([], [], []), ([], [], []))
    by_rare: dict[int, list[int]] = {}
    open_runs: dict[int, set[int]] = {}
    run_ids: dict[tuple[int, bytes], int] = {}
    for i, w in enumerate(words):
        if (j := first[i]) != i:
            if docs[j] != docs[i] and (unproved[i] or unproved[j]):
                yield i, j
            continue
        k = row[i]
        left = {run_ids.setdefault((at[i] - x, part), len(run_ids)): x for x, part in _runs(w, at[i])}
        numbers = set(rare[cut[k] : cut[k + 1]].tolist())
        near = {j for j in (open_runs if small else itertools.chain.from_iterable(by_rare.get(n, ()) for n in numbers)) if unproved[i] or unproved[j]}
        kind = 1 if repeats[k] else 0 if once[k] else 2
        far: list[list[int]] = []
        if any_way[k]:
            far = [x for by_kind in waiting[not unproved[i] :] for x in by_kind[(0, 0, 1)[kind] : (2, 3, 2)[kind]]]
        asked = (j for j, _ in itertools.groupby(heapq.merge(sorted(near), *far)))
        block = 16
        while left and (some := list(itertools.islice(asked, block))):
            block = min(2 * block, 1024)
            some = [j for j in some if docs[j] != docs[i] and not open_runs[j].isdisjoint(left)]
            rest = [j for j in some if j not in near]
            can = dict(zip(rest, close_by(k, [row[j] for j in rest]), strict=True)) if rest else {}
            for j in some:
                if open_runs[j].isdisjoint(left) or not (can[j] if j in can else _dense(of(k)[0], of(row[j])[1])):
                    continue
                if spans := _aligned(of(k)[0], of(row[j])[0]):
                    yield i, j
                    left = {run: x for run, x in left.items() if not any(i0 <= x and x + RUN <= i1 for i0, i1, *_ in spans)}
        if left:
            open_runs[i] = set(left)
            waiting[bool(unproved[i])][kind].append(i)
            for n in numbers:
                by_rare.setdefault(n, []).append(i)


def _bounded(words: DataFrame, limit: int) -> DataFrame:
    """``words`` (key, doc, pos, unproved, lo, words) with groups of ``limit`` rows at most; any two rows of a group that hold a common run of RUN words meet in one."""
    hot = settle(words.groupBy("key").count().where(F.col("count") > limit).select("key"))
    if hot.isEmpty():
        return words
    cold, rest = words.join(hot, "key", "left_anti"), words.join(hot, "key", "left_semi")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each run of RUN words that holds the key's words, keyed by it."""
        for batch in batches:
            at, keys = [], []
            for k, (key, pos, lo, w) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "pos", "lo", "words")), strict=True)):
                c = (pos >> 32) - lo
                for x, part in _runs(w, c):
                    at.append(k)
                    keys.append(xxhash.xxh3_64_intdigest(part, (key + c - x) % (1 << 64)))
            yield batch.take(pa.array(at, pa.int64())).set_column(batch.schema.get_field_index("key"), "key", pa.array(np.array(keys, np.uint64).view(np.int64), pa.int64()))

    finer = settle(rest.select(*words.columns).mapInArrow(tidied(runs), words.schema))
    half = max(limit // 2, 1)
    sizes = finer.groupBy(F.col("key").alias("n_key")).count().select("n_key", F.when(F.col("count") <= limit, 1).otherwise(F.ceil(F.col("count") / half)).alias("blocks"))
    dealt = finer.join(sizes, F.col("key") == F.col("n_key")).withColumn("block", F.pmod(F.xxhash64("doc", "pos"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
    return cold.unionByName(dealt.withColumn("key", key).select(*words.columns))


def regrouped(links: DataFrame, found: DataFrame, documents: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links (a, pos, b, pos2) within the groups in which not every other text proved to share a passage with the first."""
    many = links.where(f"kind = {_MANY}").select("key", F.col("a").alias("doc"), "pos", "b")
    proved = found.select("doc_id", "rep_doc_id", "start_word", "end_word")
    c = F.shiftright("pos", 32)
    rejected = many.where("doc <> b").join(proved, (F.col("doc") == F.col("doc_id")) & (F.col("b") == F.col("rep_doc_id")) & (F.col("start_word") <= c) & (c + SHINGLE <= F.col("end_word")), "left_anti")
    rejected = settle(rejected.select("key", "doc", "pos"))
    members = many.join(rejected.select("key").distinct(), "key", "left_semi").select("key", "doc", "pos").distinct()
    members = members.join(rejected.withColumn("r", F.lit(1)), ["key", "doc", "pos"], "left").select("doc", F.greatest(c - AROUND, F.lit(0)).alias("lo"), (c + SHINGLE + AROUND).alias("hi"), "key", "pos", F.coalesce("r", F.lit(0)).cast("long").alias("unproved"))
    words = settle(_cut_out(members, documents, "key", "pos", "unproved").select("key", "doc", "pos", "unproved", "lo", "words"))
    words = _bounded(words, limit).repartition("key").sortWithinPartitions("key", "doc", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(group: list[tuple]) -> Iterator[pa.RecordBatch]:
            if group and group[0][0] != group[-1][0]:
                docs, pos, unproved, lo, words = zip(*group, strict=True)
                at = [(p >> 32) - x for p, x in zip(pos, lo, strict=True)]
                got = [(docs[i], pos[i], docs[j], pos[j]) for i, j in _partners(docs, at, unproved, words)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], names=["a", "pos", "b", "pos2"])

        last, group = None, []
        for batch in batches:
            for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last:
                    yield from pairs(group)
                    last, group = key, []
                group.append(tuple(row))
        yield from pairs(group)

    return words.mapInArrow(tidied(run), "a long, pos long, b long, pos2 long").distinct()


def _copies(links: DataFrame) -> DataFrame:
    """a, tag, words, b: each text with the words of an earlier one, and the first of these (smallest doc_id)."""
    equal = links.where(f"kind = {_EQUAL}").select("a", F.shiftright("pos", 10).alias("tag"), "b")
    first = equal.select(F.col("a").alias("f_a"), F.col("tag").alias("f_tag"), F.col("b").alias("f_b"))
    chain = equal.join(first, (F.col("b") == F.col("f_a")) & (F.col("tag") == F.col("f_tag")), "left").select("a", "tag", F.coalesce("f_b", "b").alias("b"))
    return chain.where("a <> b").groupBy("a", "tag").agg(F.min("b").alias("b")).select("a", F.col("tag").bitwiseAND(_TAG).alias("tag"), F.shiftright("tag", 22).alias("n"), "b")


def near_passages(documents: DataFrame) -> DataFrame:
    """Passages of MIN_WORDS words or more that near-equal passages of other rows repeat.

    One row for each passage and its representative: doc_id, start_word,
    end_word, rep_doc_id, rep_start_word, rep_end_word, similarity, is_copy.
    Copies (is_copy) point to an earlier text that holds the passage, by
    doc_id; that text has a row for itself.  A text with the words of an earlier one
    has one row, for its whole.  Word positions count ``bytes.split()``
    of the text, from 0, ends excluded; case of A-Z does not matter.  Texts shorter
    than a passage, null texts and rows without doc_id have none; rows with one
    doc_id are not compared with each other.  Other columns play no part.
    """
    rows = window_rows(documents).repartition("key").sortWithinPartitions("key")
    links = settle(candidate_links(rows))
    equal = settle(_copies(links))
    copy = equal.select(F.col("a").alias("c_a"), F.col("tag").alias("c_tag"))
    links = links.where(f"kind <> {_EQUAL}").join(copy, (F.col("a") == F.col("c_a")) & (F.shiftright("pos", 10).bitwiseAND(_TAG) == F.col("c_tag")), "left_anti")
    first = _verified(links.where("a <> b"), documents)
    found = first.unionByName(_verified(regrouped(links, first, documents), documents)).distinct()
    whole = [F.col("a").alias("doc_id"), F.lit(0).cast("long").alias("start_word"), F.col("n").alias("end_word"), F.col("b").alias("rep_doc_id"), F.lit(0).cast("long").alias("rep_start_word"), F.col("n").alias("rep_end_word"), F.lit(1.0).alias("similarity")]
    found = found.unionByName(equal.select(*whole))
    copies = found.withColumn("is_copy", F.lit(True))
    firsts = found.select("rep_doc_id", "rep_start_word", "rep_end_word").distinct()
    firsts = firsts.select(F.col("rep_doc_id").alias("doc_id"), F.col("rep_start_word").alias("start_word"), F.col("rep_end_word").alias("end_word"), "rep_doc_id", "rep_start_word", "rep_end_word", F.lit(1.0).alias("similarity"), F.lit(False).alias("is_copy"))
    return copies.unionByName(firsts)


_PIECE = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")


def cut_words(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the given spans and the white space before them."""
    gone: set[int] = set()
    for s, e in spans:
        gone.update(range(s, e))
    out, at = [], 0
    for k, m in enumerate(_PIECE.finditer(data)):
        if k not in gone:
            out.append(m[0])
        at = m.end()
    return b"".join([*out, data[at:]])


def remove_repeats(documents: DataFrame) -> DataFrame:
    """``documents`` without the passages that an earlier row (smaller doc_id) holds; all other columns unchanged.

    The first text of a passage keeps it.  Texts are cut in place, n_chars (if
    there) follows, and a text of which no word is left goes.  Null, empty and short
    texts, rows without doc_id and extra columns of any name stay as they are; rows that
    repeat a doc_id are cut alike.
    """
    key, spans = unused(documents, "s_id", "spans")
    found = near_passages(documents).where("is_copy").groupBy(F.col("doc_id").alias(key)).agg(F.sort_array(F.collect_set(F.struct(F.col("start_word").alias("s"), F.col("end_word").alias("e")))).alias(spans))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = (batch.column(batch.schema.get_field_index(c)) for c in ("text", spans))
            new = [t.as_py() and cut_words(t.as_py().encode(), [(x["s"], x["e"]) for x in found]).decode("utf-8", "replace") for t, found in zip(texts, lists.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if n == "text" else c for n, c in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names)

    both = documents.join(found, F.col("doc_id") == F.col(key), "left").drop(key)
    same = both.where(F.col(spans).isNull()).drop(spans)
    new = both.where(F.col(spans).isNotNull())
    new = new.mapInArrow(tidied(cut), new.schema).where(F.regexp_like("text", F.lit(WORD))).drop(spans)
    if "n_chars" in documents.columns:
        new = new.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return same.unionByName(new)
