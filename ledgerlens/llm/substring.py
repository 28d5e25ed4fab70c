"""Fuzzy repeated passages by collinear chaining of shared k-mer seeds.

1. Seeds. Words (ASCII case folded, split at ASCII white space) make five-word k-mers; of every WINDOW consecutive k-mers the one with the smallest hash is
   a seed, so equal runs of WINDOW + 4 words share one.
2. Matches. Of equal texts the first is searched; the others have its passages, and the whole text against it. A seed with up to RARE places is matched at all pairs of
   them, a seed with more with its first place, the smallest (doc_id, word). Two seeds within REACH words, one of them frequent, are a key too, matched in the same way: two
   documents have such a pair wherever a chain goes from one seed to the next, however frequent each is alone. Every run of MIN_WORDS words with fewer than two different
   rare seeds is a key as well, matched with its first place. So matches grow with the text and not with the square of a group, and of any MIN_WORDS words that an earlier document
   has either two seeds are matched with that document or the whole run is matched with the first document that has it: no exact repeat is lost (but for under K words at an edge,
   see 5). Of passages that are only alike those are searched for against their pairs' first documents alone whose pairs all have more than RARE places.
3. Chains. Matches that follow each other along one diagonal are a segment. The segments of a document with one anchor document are chained in order along both: a
   Fenwick tree over the segments' ends in the anchor document holds the best chain that ends before a place, and a gap costs GAP a word on either side. Chains break
   where a gap is longer than LONGEST_GAP. A pair of documents has at most twice as many matches as the document has words.
4. Alignment. The words around a pair's chains are fetched from both documents, segments are compared word by word along their diagonals, gaps are aligned, both ends
   are extended, and what has MIN_WORDS words or more, SIMILAR of them matched, is a passage. A chain that is less alike is cut into the parts that are, and aligned
   along each of its diagonals alone, since seeds of repeated words may have led it aside. A chain
   that lies well within a passage of the same pair is passed over: it would report words that are reported already.
5. First sources. A passage is reported against the first document that has it: further sources count if they add K words in a row, so that a
   chance word at its edge makes no second passage.

Defined results: null, blank and short texts have no seeds; a text is read as a whole, however long, one text at a time; repeats within one document aren't passages; rows
that repeat a doc_id count as one document; of equal documents the one with the smallest id is the source of the others; of equal chains and passages the first along the
document goes first, and of sources the smallest id; null doc_ids are left alone; an empty table gives an empty result; further columns are ignored, or kept by `cut`, whatever
their names.
"""

from __future__ import annotations

import bisect
import operator
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import BROADCAST_BYTES, column, free_name, join_hot_aware, join_salted, slices, small_batches, tidied, words_of, written

K = 5
WINDOW = 12
GAP = 0.1
LONGEST_GAP = 32
#: Words from one seed's first word to the next one's in a chain, at most.
REACH = LONGEST_GAP + K
MARGIN = 64
#: Places of a seed that are all matched with each other; the first and the last place of a seed are enough for three.
RARE = 3
#: Bits of the filters of repeated and of frequent seeds, which go to all executors. What a filter lets through wrongly costs rows and no result.
FILTER_BITS = 1 << 26
#: Ranges of words that are fetched begin and end at multiples of this, so that near copies ask for the same ranges of their source.
GRID = 64
#: Pairs of documents whose matches a worker chains at once.
CHAINED = 256
MIN_WORDS = 50
SIMILAR = 0.8
#: Kinds of keys.
SEED, PAIR, RUN = 0, 1, 2
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's words, and of its k-mers."""
    n = max(0, len(words) - K + 1)
    one = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))
    h = one[:n].copy()
    for k in range(1, K):
        h = h * np.uint64(0x9E3779B97F4A7C15) + one[k : k + n]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return one, h


def _least(h: np.ndarray) -> np.ndarray:
    """Place of the smallest hash of each WINDOW consecutive k-mers; of all, if there are fewer."""
    if len(h) <= WINDOW:
        return np.array([int(h.argmin())])
    return np.lib.stride_tricks.sliding_window_view(h, WINDOW).argmin(axis=1) + np.arange(len(h) - WINDOW + 1)


def _alone(h: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Of each window of k-mers, whether its smallest hash stands in it once."""
    new = np.append(True, least[1:] != least[:-1])
    at = least[new]
    following = np.full(len(at), WINDOW)
    for k in range(WINDOW - 1, 0, -1):
        there = at[: np.searchsorted(at, len(h) - k)]
        following[: len(there)][h[there] == h[there + k]] = k
    return least + following[np.cumsum(new) - 1] >= np.arange(len(least)) + WINDOW


def _thinned(h: np.ndarray, least: np.ndarray, alone: np.ndarray) -> np.ndarray:
    at = least[np.append(True, least[1:] != least[:-1])]
    value = h[at]
    if len(at) > 1 and (value[1:] == value[:-1]).any():  # runs of one word: one seed in a window will do, and those that are a window's only one
        kept, last, before, needed = [], -WINDOW, None, {*least[alone].tolist()}
        for i, v in zip(at.tolist(), value.tolist(), strict=True):
            if v != before or i - last >= WINDOW or i in needed:
                kept.append(i)
                last, before = i, v
        at = np.array(kept)
    return at


def seeds(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a text's seeds."""
    if len(words) < K:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _hashes(words)[1]
    least = _least(h)
    at = _thinned(h, least, _alone(h, least))
    return at, h[at]


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes a filter lets through."""
    slot = (h & np.uint64(FILTER_BITS - 1)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def linked(at: np.ndarray, h: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the first and of the second seed, and hashes, of all pairs of seeds that may follow each other in a chain, one of them at least frequent."""
    first, second = [], []
    for k in range(1, REACH + 1):
        near = at[k:] - at[:-k] <= REACH
        if not near.any():
            break
        i = np.flatnonzero(near & (often[k:] | often[:-k]))
        first.append(i)
        second.append(i + k)
    i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (first, second))
    mixed = h[i] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + h[j]
    return at[i], at[j], mixed ^ mixed >> np.uint64(33)


def frequent_runs(one: np.ndarray, h: np.ndarray, least: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the runs of MIN_WORDS words with fewer than two different seeds that aren't frequent, of the seeds that the run itself has wherever it stands.

    frequent says of each k-mer in least whether it is, or whether its place in a run of one word isn't that of a seed wherever the run stands.
    """
    inside = MIN_WORDS - K - WINDOW + 2  # windows of k-mers in a run
    n = len(least) - inside + 1
    if n < 1 or len(one) < MIN_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rare = np.where(frequent, np.uint64(0), h[least] | np.uint64(1))
    where = np.flatnonzero(rare)
    if len(where) == 0:
        start = np.arange(n)
    else:  # rare windows of a run are of one value if none of them differs from the rare one before it, but for the first
        value = rare[where]
        change = np.zeros(len(least) + 1, np.int64)
        change[where[1:] + 1] = value[1:] != value[:-1]
        change = np.cumsum(change)
        following = np.append(where, len(least))[np.searchsorted(where, np.arange(n))]
        end = np.arange(n) + inside
        start = np.flatnonzero((following >= end) | (change[end] == change[np.minimum(following + 1, len(least))]))
    if len(start) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    mixed = one * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    runs, done = mixed, 1  # hashes of done words from each place on, doubled and put together to MIN_WORDS
    total, have = None, 0
    while have < MIN_WORDS:
        if MIN_WORDS >> (done.bit_length() - 1) & 1:
            if total is None:
                total = runs
            else:
                m = len(one) - have - done + 1
                total = (total[:m] ^ total[:m] >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + runs[have : have + m]
            have += done
        m = len(runs) - done
        if have < MIN_WORDS:
            runs = (runs[:m] ^ runs[:m] >> np.uint64(32)) * np.uint64(0xFF51AFD7ED558CCD) + runs[done : done + m]
            done *= 2
    total = total ^ total >> np.uint64(33)
    return start, total[start]


def _placed(batches, rows_of, names):
    for whole in batches:
        for batch in slices(whole, 1):
            columns = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (text or b"").translate(FOLD).split()
                if len(words) < K:
                    continue
                for kind, at, then, h in rows_of(words):
                    for c, v in zip(columns, (h.view(np.int64), np.full(len(at), doc, np.int64), at.astype(np.int32), then.astype(np.int32), np.full(len(at), kind, np.int8)), strict=False):
                        c.append(v)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=names)


def _seed_rows(batches):
    def rows_of(words):
        at, h = seeds(words)
        return [(SEED, at, at, h)]

    return _placed(batches, rows_of, ["seed", "doc", "at"])


def _key_rows(filters):
    """Repeated seeds, the pairs that frequent ones are in, and the runs of frequent ones."""

    def rows_of(words):
        repeated, often = filters.value
        one, h = _hashes(words)
        least = _least(h)
        alone = _alone(h, least)
        at = _thinned(h, least, alone)
        at = at[_in(repeated, h[at])]
        first, second, both = linked(at, h[at], _in(often, h[at]))
        start, run = frequent_runs(one, h, least, _in(often, h[least]) | ~alone)
        return [(SEED, at, at, h[at]), (PAIR, first, second, both), (RUN, start, start, run)]

    return lambda batches: _placed(batches, rows_of, ["seed", "doc", "at", "then", "kind"])


def segments(own: np.ndarray, other: np.ndarray, words: np.ndarray | int = K) -> np.ndarray:
    """Rows (first in own, first in other, words, matches) of the runs of matches along one diagonal with no gap of more than LONGEST_GAP words; a match holds words words."""
    words = np.broadcast_to(words, own.shape)
    order = np.lexsort((own, own - other))
    own, other, words = own[order], other[order], words[order]
    turn = own - other
    reach = np.maximum.accumulate(own + words + (np.cumsum(np.append(0, turn[1:] != turn[:-1])) << 40)) & ((1 << 40) - 1)
    new = np.append(True, (turn[1:] != turn[:-1]) | (own[1:] - reach[:-1] > LONGEST_GAP))
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(own)) - 1
    return np.stack([own[begin], other[begin], reach[end] - own[begin], end - begin + 1], axis=1)


def chain(found: np.ndarray) -> list[list[int]]:
    """Chains of segments, best first, as lists of rows along the document; each segment is in one at most.

    A segment may follow another if it begins behind the other's last match in both texts. A chain's score is the words of its segments less GAP
    for each word, in either text, between a segment's end and the next one's begin.
    """
    n = len(found)
    x, y, words = (found[:, k].tolist() for k in range(3))
    if n == 1:
        return [[0]]
    # the last match's place, K words before the end: segments may overlap by less than a match where a word was put in or left out
    x_end, y_end = [a + w - K for a, w in zip(x, words, strict=True)], [b + w - K for b, w in zip(y, words, strict=True)]
    places = sorted({*y_end})
    size = len(places)
    tree_score, tree_at = [float("-inf")] * (size + 1), [-1] * (size + 1)
    score, before = [0.0] * n, [-1] * n
    ends = iter(sorted(range(n), key=x_end.__getitem__))
    waiting = next(ends)
    for i in sorted(range(n), key=x.__getitem__):
        while waiting is not None and x_end[waiting] < x[i]:  # its begin lies no further, so its score is known
            lifted, k = score[waiting] + GAP * (x_end[waiting] + y_end[waiting]), bisect.bisect_left(places, y_end[waiting]) + 1
            while k <= size:
                if lifted > tree_score[k]:
                    tree_score[k], tree_at[k] = lifted, waiting
                k += k & -k
            waiting = next(ends, None)
        best, at, k = 0.0, -1, bisect.bisect_left(places, y[i])
        cost = GAP * (x[i] + y[i])
        while k > 0:
            if tree_score[k] - cost > best:
                best, at = tree_score[k] - cost, tree_at[k]
            k -= k & -k
        score[i], before[i] = words[i] + best, at
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        line = []
        while i >= 0 and not used[i]:
            used[i] = True
            line.append(i)
            i = before[i]
        part: list[int] = []
        for j in reversed(line):
            if part and (x[j] - x_end[part[-1]] > LONGEST_GAP + K or y[j] - y_end[part[-1]] > LONGEST_GAP + K):
                out.append(part)
                part = []
            part.append(j)
        if part:
            out.append(part)
    return out


def _grouped(lines: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Chains of one pair of documents, dealt into groups that stand near each other in both, so that a group's words are little more than its chains' words."""
    lines.sort(key=lambda c: int(c[0, 0]))
    groups: list[list[np.ndarray]] = []
    hull, held = [0, 0, 0, 0], 0
    for c in lines:
        (x, y, *_), (a, b, n, _) = c[0].tolist(), c[-1].tolist()
        a, b = a + n, b + n
        wider = [min(hull[0], x), max(hull[1], a), min(hull[2], y), max(hull[3], b)]
        if groups and wider[1] - wider[0] + wider[3] - wider[2] <= 2 * (held + a - x) + 16 * GRID:
            groups[-1].append(c)
            hull, held = wider, held + a - x
        else:
            groups.append([c])
            hull, held = [x, a, y, b], a - x
    return groups


def _chain_rows(batches):
    names = ["doc", "source", "low", "high", "source_low", "source_high", "at", "there", "words", "counts"]
    kinds = (*[pa.int64()] * 6, *[pa.list_(pa.int64())] * 4)
    for batch in (whole.slice(k, CHAINED) for whole in batches for k in range(0, whole.num_rows, CHAINED)):
        rows = []
        pairs = batch.column(2)
        ends = pairs.offsets.to_numpy()
        flat = pairs.values
        at, there = (flat.field(k).to_numpy().astype(np.int64) for k in (0, 1))
        words = np.where(flat.field(2).to_numpy(zero_copy_only=False), MIN_WORDS, K)
        for k, (doc, source) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            here = slice(ends[k], ends[k + 1])
            found = segments(at[here], there[here], words[here])
            lines = [part for part in (found[c] for c in chain(found)) if len(part) > 1 or part[0, 2] > K]  # not those of one seed
            for group in _grouped(lines):
                every = np.concatenate(group)
                bounds = []
                for side in (0, 1):
                    bounds += [max(0, int(every[:, side].min()) - MARGIN) // GRID * GRID, -(-(int((every[:, side] + every[:, 2]).max()) + MARGIN) // GRID) * GRID]
                low, _, low_there, _ = bounds
                rows.append((doc, source, *bounds, (every[:, 0] - low).tolist(), (every[:, 1] - low_there).tolist(), every[:, 2].tolist(), [len(c) for c in group]))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 10
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _pieces(batches):
    """The folded words of each range that is asked of a text, joined by spaces."""
    for whole in batches:
        for batch in slices(whole, 1):
            places, found = [], []
            for doc, text, ranges in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = (text or b"").translate(FOLD).split()
                for r in ranges:
                    places.append((doc, r["low"], r["high"]))
                    found.append(b" ".join(words[r["low"] : r["high"]]))
            columns = list(zip(*places, strict=True)) if places else [()] * 3
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(found, pa.binary())], names=["doc", "low", "high", "spoken"])


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    if a == b:
        return len(a)
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _extend(a: list[str], b: list[str]) -> tuple[int, int]:
    """Words of a and b that go on alike, and how many of them match: the best prefix, given up 8 below the best."""
    best = reach = score = matched = best_matched = 0
    for i, (x, y) in enumerate(zip(a, b, strict=False), 1):
        same = x == y
        score += 1 if same else -2
        matched += same
        if score > best:
            best, reach, best_matched = score, i, matched
        elif score < best - 8:
            break
    return reach, best_matched


def _between(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """Pieces (words of a, words of b, matched) of two gaps: the equal words at their ends apart, and word by word if no shift matches more."""
    least, head, tail = min(len(a), len(b)), 0, 0
    while head < least and a[head] == b[head]:
        head += 1
    while tail < least - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    matched = _common(a, b)
    if len(a) == len(b) and matched == sum(x == y for x, y in zip(a, b, strict=True)):
        inner = [(1, 1, int(x == y)) for x, y in zip(a, b, strict=True)]
    else:
        inner = [(len(a), len(b), matched)]
    return [(head, head, head), *inner, (tail, tail, tail)]


def _along(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """Pieces of two runs of words of one length along one diagonal: equal words together, and what differs as a gap."""
    same = np.fromiter(map(operator.eq, a, b), bool, len(a))
    turns = np.flatnonzero(same[1:] != same[:-1]) + 1
    out = []
    for s, e in zip([0, *turns.tolist()], [*turns.tolist(), len(a)], strict=True):
        out += [(e - s,) * 3] if same[s] else [(1, 1, 0)] if e == s + 1 else _between(a[s:e], b[s:e])
    return out


def align(a: list, b: list, at: list[int], there: list[int], words: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Start and end in a, start and end in b, and matched words, of the passages along the chain's segments.

    A chain that is SIMILAR as a whole is one passage. Of any other the passages are the longest parts of MIN_WORDS words or more that are
    SIMILAR, as many as it takes to hold every word that is in such a part.
    """
    i, j = at[0], there[0]
    pieces = []
    for x, y, n in zip(at, there, words, strict=True):
        over = max(i - x, j - y, 0)  # words that the segment before holds already
        if over >= n:
            continue
        x, y, n = x + over, y + over, n - over
        if x > i or y > j:
            pieces += _between(a[i:x], b[j:y])
        pieces += _along(a[x : x + n], b[y : y + n])
        i, j = x + n, y + n
    right, more = _extend(a[i:], b[j:])
    left, fore = _extend(a[: at[0]][::-1], b[: there[0]][::-1])
    parts: list[list[int]] = []
    for n, m, matched in [(left, left, fore), *pieces, (right, right, more)]:
        exact = n == m == matched
        if parts and exact and parts[-1][0] == parts[-1][1] == parts[-1][2]:  # one piece for a run of equal words
            parts[-1] = [parts[-1][0] + n, parts[-1][1] + m, parts[-1][2] + matched]
        elif n or m:
            parts.append([n, m, matched])
    if sum(p[2] for p in parts) < SIMILAR * MIN_WORDS:
        return []
    own, other, same = np.cumsum([[0, 0, 0], *parts], axis=0).T
    found, reach = [], -1
    for s in range(len(parts)):
        n, m, matched = own[s + 1 :] - own[s], other[s + 1 :] - other[s], same[s + 1 :] - same[s]
        fits = np.flatnonzero((n >= MIN_WORDS) & (matched >= SIMILAR * np.maximum(n, m)))
        if len(fits) and s + 1 + fits[-1] > reach:
            reach = s + 1 + int(fits[-1])
            found.append((s, reach))
            if reach == len(parts):
                break
    held = []
    for k, (s, e) in enumerate(found):
        end = held[-1][1] if held else 0
        if k + 1 < len(found) and held and found[k + 1][0] <= end:  # the next one goes on from what is held, and further
            continue
        held.append((s, e))
    start, start_there = at[0] - left, there[0] - left
    return [tuple(int(v) for v in (start + own[s], start + own[e], start_there + other[s], start_there + other[e], same[e] - same[s])) for s, e in held]


#: Groups of chains whose words a worker has as Python objects at once.
ALIGNED = 64
#: Words that a chain's passage may go on beyond its segments without a seed.
SLACK = WINDOW + K


def align_group(own: list, other: list, lines: list[tuple[list[int], list[int], list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """The passages of all chains of a group, the longest chains first, but for chains that lie well within a passage that is found already.

    A chain over several diagonals that isn't one passage is aligned along each of them alone as well: seeds of repeated words may lead it aside.
    """
    found: list[tuple[int, int, int, int, int]] = []
    held: list[tuple[int, int]] = []
    for at, there, words in sorted(lines, key=lambda c: -sum(c[2])):
        k = bisect.bisect_right(held, max(0, at[0] - SLACK), key=lambda x: x[0]) - 1
        if k >= 0 and held[k][1] >= min(at[-1] + words[-1] + SLACK, len(own)):
            continue
        passages = align(own, other, at, there, words)
        turns = {x - y for x, y in zip(at, there, strict=True)}
        if len(turns) > 1 and not any(p[0] <= at[0] and p[1] >= at[-1] + words[-1] for p in passages):
            for turn in sorted(turns):
                one = [(x, y, n) for x, y, n in zip(at, there, words, strict=True) if x - y == turn]
                passages += [p for p in align(own, other, *map(list, zip(*one, strict=True))) if not any(q[0] <= p[0] and q[1] >= p[1] for q in passages)]
        for p in passages:
            found.append(p)
            low, high = bisect.bisect_left(held, p[0], key=lambda x: x[1]), bisect.bisect_right(held, p[1], key=lambda x: x[0])
            held[low:high] = [(min([p[0], *(x[0] for x in held[low:high])]), max([p[1], *(x[1] for x in held[low:high])]))]
    return found


def _passage_rows(batches):
    for batch in (whole.slice(k, ALIGNED) for whole in batches for k in range(0, whole.num_rows, ALIGNED)):
        rows = []
        columns = [batch.column(k).to_pylist() for k in range(10)]
        for doc, source, low, source_low, at, there, words, counts, own, other in zip(*columns, strict=True):
            lines, k = [], 0
            for n in counts:
                lines.append((at[k : k + n], there[k : k + n], words[k : k + n]))
                k += n
            for start, end, start_there, end_there, matched in align_group(own.split(), other.split(), lines):
                rows.append((doc, low + start, low + end, source, source_low + start_there, source_low + end_there, matched))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        names = ["doc_id", "start_word", "end_word", "source_doc_id", "source_start", "source_end", "matched_words"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _first_rows(batches):
    """Of a document's passages those that hold K words or more in a row that none against an earlier source holds."""
    names = ["start_word", "end_word", "source_doc_id", "source_start", "source_end", "matched_words"]
    for batch in batches:
        rows = []
        for doc, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held: list[tuple[int, int]] = []  # apart, in order
            for r in sorted(found, key=lambda r: (r["source_doc_id"], r["start_word"], -r["end_word"])):
                a, b = r["start_word"], r["end_word"]
                low = bisect.bisect_left(held, a, key=lambda x: x[1])
                high = bisect.bisect_right(held, b, key=lambda x: x[0])
                edges = [a, *(v for x in held[low:high] for v in x), b]
                if max(y - x for x, y in zip(edges[::2], edges[1::2], strict=True)) >= K:
                    rows.append((doc, *(r[n] for n in names)))
                    held[low:high] = [(min([a, *(x[0] for x in held[low:high])]), max([b, *(x[1] for x in held[low:high])]))]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", *names])


def _filter(anchors: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, of which those of the seeds are set; at most so many bits come to the driver, however many seeds there are."""
    slot = F.col("seed").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1
    found = anchors.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(FILTER_BITS >> 3, np.uint8)
    for r in found.collect():
        at = (r["k"] - 1) << 12
        out[at : at + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _repeated(rows: DataFrame, places: list[str]) -> DataFrame:
    """(seed, first, last, n) of the keys that two documents have."""
    place = F.struct("doc", *places)
    found = rows.groupBy("seed").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
    return found.where(F.col("first.doc") < F.col("last.doc"))


def _matched(rows: DataFrame, sides: DataFrame, places: list[str]) -> DataFrame:
    """(doc, source, own, other): the places of each key with its first place, and the second of three with the third as well."""
    total = sides.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    place = F.struct("doc", *places)
    sides = sides.select("seed", "first", F.when(F.col("n") == RARE, F.col("last")).alias("last"), "n")
    joined = join_hot_aware(rows, sides, "seed", "n", total).select(place.alias("own"), "first", "last")
    middle = F.col("last").isNotNull() & (F.col("own") > F.col("first")) & (F.col("own") < F.col("last"))
    match = F.struct("own", F.col("first").alias("other"))
    later = F.struct(F.col("last").alias("own"), F.col("own").alias("other"))
    found = joined.select(F.explode(F.when(middle, F.array(match, later)).otherwise(F.array(match))).alias("m")).select("m.own", "m.other")
    return found.where(F.col("own.doc") != F.col("other.doc")).select(F.col("own.doc").alias("doc"), F.col("other.doc").alias("source"), "own", "other")


def copies(slim: DataFrame) -> DataFrame:
    """(doc, digest, rep, n): rows whose whole text an earlier document has, the first such document, and how many rows have the text."""
    long = slim.where(F.octet_length("text") >= 2 * MIN_WORDS - 1).select("doc", "digest", F.sha2("text", 256).alias("same"))
    firsts = long.groupBy("same").agg(F.min("doc").alias("rep"), F.max("doc").alias("most"), F.count("*").alias("n")).where(F.col("rep") < F.col("most"))
    firsts = written(firsts.select("same", "rep", "n"), "texts")
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sides = firsts.withColumn("copies", F.col("n"))
    found = join_hot_aware(long, sides, "same", "n", total).where(F.col("doc") > F.col("rep"))
    return written(found.select("doc", "digest", "rep", F.col("copies").alias("n")).distinct(), "copies")


def chains(slim: DataFrame) -> DataFrame:
    """Chained seeds of each document (doc, text) with each of the earlier documents that it is matched with."""
    slim = slim.where(F.col("doc").isNotNull())
    place = F.struct("doc", "at")
    placed = slim.mapInArrow(tidied(_seed_rows), "seed long, doc long, at int")
    anchors = written(_repeated(placed, ["at"]), "anchors")
    filters = slim.sparkSession.sparkContext.broadcast((_filter(anchors), _filter(anchors.where(F.col("n") > RARE))))
    keys = written(slim.mapInArrow(tidied(_key_rows(filters)), "seed long, doc long, at int, then int, kind byte"), "keys")
    seeded = _matched(keys.where(F.col("kind") == SEED).select("seed", "doc", "at"), anchors, ["at"])
    matches = seeded.select("doc", "source", F.col("own.at").alias("at"), F.col("other.at").alias("there"), F.lit(False).alias("run"))
    two = keys.where(F.col("kind") == PAIR).select("seed", "doc", "at", "then")
    both = _matched(two, written(_repeated(two, ["at", "then"]), "pairs"), ["at", "then"])
    ends = F.explode(F.array(*(F.struct(F.col(f"own.{k}").alias("at"), F.col(f"other.{k}").alias("there")) for k in ("at", "then"))))
    linked_too = both.select("doc", "source", ends.alias("m")).select("doc", "source", "m.at", "m.there", F.lit(False).alias("run"))
    runs = keys.where(F.col("kind") == RUN).select("seed", "doc", "at")
    firsts = runs.groupBy("seed").agg(F.min(place).alias("first"), F.max("doc").alias("most"), F.count("*").alias("n")).where(F.col("first.doc") < F.col("most"))
    firsts = written(firsts.select("seed", F.col("first.doc").alias("source"), F.col("first.at").alias("there"), "n"), "runs")
    many = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    wide = join_hot_aware(runs, firsts, "seed", "n", many).select("doc", "source", "at", "there", F.lit(True).alias("run"))
    pairs = (
        matches.union(linked_too)
        .union(wide)
        .where(F.col("doc") != F.col("source"))
        .groupBy("doc", "source")
        .agg(F.collect_list(F.struct("at", "there", "run")).alias("pairs"))
        .where((F.size("pairs") > 1) | F.col("pairs")[0]["run"])
    )
    lines = pairs.mapInArrow(
        tidied(_chain_rows), "doc long, source long, low long, high long, source_low long, source_high long, at array<bigint>, there array<bigint>, words array<bigint>, counts array<bigint>"
    )
    return written(lines, "chains")


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, source_doc_id, source_start, source_end, matched_words): every passage that an earlier document has as well."""
    small_batches(docs.sparkSession)
    text = column(text_col).cast("string")
    every = docs.select(column(id_col).cast("long").alias("doc"), text.cast("binary").alias("text"), F.xxhash64(text).alias("digest")).where(F.col("doc").isNotNull())
    again = copies(every)
    held = again.count() * 64
    side = again.select("doc", "digest")
    slim = every.join(F.broadcast(side) if held <= BROADCAST_BYTES else side, ["doc", "digest"], "left_anti").select("doc", "text")
    found = chains(slim)
    asked = written(
        found.select("doc", "low", "high").union(found.select("source", "source_low", "source_high")).groupBy("doc", "low", "high").agg(F.count("*").alias("n")),
        "asked",
    )
    ranges = written(asked.groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("ranges")), "ranges")
    held = ranges.agg(F.coalesce(F.sum(F.size("ranges") * 40 + 96), F.lit(0))).first()[0]
    cut = slim.join(F.broadcast(ranges) if held <= BROADCAST_BYTES else ranges, "doc").select("doc", "text", "ranges")
    place = F.xxhash64("doc", "low", "high")
    pieces = cut.mapInArrow(tidied(_pieces), "doc long, low long, high long, spoken binary").select(place.alias("place"), "spoken")
    pieces = written(pieces, "pieces")
    sizes = asked.select(place.alias("place"), "n")
    total = 2 * found.count()
    one = found.withColumn("place", place)
    with_own = join_salted(one, pieces, "place", sizes, total).withColumnRenamed("spoken", "own").drop("place")
    two = with_own.withColumn("place", F.xxhash64("source", "source_low", "source_high"))
    with_both = join_salted(two, pieces, "place", sizes, total).withColumnRenamed("spoken", "other")
    kinds = "doc_id long, start_word long, end_word long, source_doc_id long, source_start long, source_end long, matched_words long"
    parts = with_both.select("doc", "source", "low", "source_low", "at", "there", "words", "counts", "own", "other").mapInArrow(tidied(_passage_rows), kinds)
    parts = written(parts, "parts")
    fields = parts.columns
    # copies have their text's passages, and the whole text against the first document that has it
    texts = again.groupBy("rep", "digest").agg(F.max("n").alias("n"))
    first = every.withColumnRenamed("doc", "rep").join(F.broadcast(texts) if held <= BROADCAST_BYTES else texts, ["rep", "digest"])
    first = first.select("rep", "digest", "n", F.size(words_of(F.col("text").cast("string"))).cast("long").alias("words")).distinct().where(F.col("words") >= MIN_WORDS)
    its = parts.groupBy(F.col("doc_id").alias("rep")).agg(F.collect_list(F.struct(*fields[1:])).alias("found"))
    zero = F.lit(0).cast("long")
    whole = F.array(F.struct(*(v.alias(k) for k, v in zip(fields[1:], (zero, F.col("words"), F.col("rep"), zero, F.col("words"), F.col("words")), strict=True))))
    sides = first.join(its, "rep", "left").select(F.xxhash64("rep", "digest").alias("of"), "n", F.when(F.col("found").isNull(), whole).otherwise(F.concat("found", whole)).alias("found"))
    sides = written(sides, "wholes")
    total = again.count()
    copied = join_hot_aware(again.select(F.col("doc").alias("doc_id"), F.xxhash64("rep", "digest").alias("of")), sides, "of", "n", total)
    all_parts = parts.union(copied.select("doc_id", F.explode("found").alias("p")).select("doc_id", "p.*"))
    by_doc = all_parts.groupBy("doc_id").agg(F.collect_list(F.struct(*fields[1:])).alias("found"))
    return by_doc.mapInArrow(tidied(_first_rows), kinds)


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words in spans. What stands between two words that stay, after a cut, is one line break if the cut had one and else one space."""
    found = list(WORD.finditer(text))
    gone = set()
    for a, b in spans:
        gone.update(range(a, min(b, len(found))))
    out, last = [], None
    for k, m in enumerate(found):
        if k in gone:
            continue
        if last is None:
            out.append(text[: m.start()] if k == 0 else "")
        elif last == k - 1:
            out.append(text[found[last].end() : m.start()])
        else:
            out.append("\n" if "\n" in text[found[last].end() : m.start()] else " ")
        out.append(m[0])
        last = k
    if found and last == len(found) - 1:
        out.append(text[found[-1].end() :])
    return "".join(out)


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the passages that earlier documents have; a column n_chars, if there, is counted anew for texts that were cut."""
    key, spans_col, new = (free_name(docs, n) for n in ("_cut_id", "_spans", "_cut_text"))
    spans = passages(docs, id_col, text_col).groupBy("doc_id").agg(
        F.sort_array(F.collect_set(F.struct(F.col("start_word").alias("a"), F.col("end_word").alias("b")))).alias(spans_col)
    )
    spans = written(spans.withColumnRenamed("doc_id", key), "spans")
    held = spans.agg(F.coalesce(F.sum(F.size(spans_col) * 32 + 64), F.lit(0))).first()[0]
    side = F.broadcast(spans) if held <= BROADCAST_BYTES else spans
    joined = docs.join(side, column(id_col).cast("long") == F.col(key), "left")
    shorten = F.udf(lambda t, s: t if t is None or s is None else _without(t, [(x["a"], x["b"]) for x in s]), "string", useArrow=True)
    whole = F.col(spans_col).isNull()
    out = joined.withColumn(new, F.when(whole, column(text_col)).otherwise(shorten(column(text_col), F.col(spans_col))))
    counted = F.char_length(new)
    columns = {text_col: F.col(new)}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(counted.cast(docs.schema["n_chars"].dataType))
    return out.select(*[columns.get(c, column(c)).alias(c) for c in docs.columns])


cloudpickle.register_pickle_by_value(sys.modules[__name__])
