"""BPE encoding and decoding with a public vocabulary: speculate with longest matches, verify neighbours, merge only what fails.

A word's proposal is the longest token at every place, from the left. A sequence of tokens is what the merges give if every token comes
out of its own merges and no two neighbours would have merged across their border, and both can be looked up: whether a
pair is compatible follows from taking the two tokens apart along the border, last merges first, and asking at each step if the two parts on
the border have a merge that would have come earlier. That test runs over all pairs of a batch of new words at once.
Words of which a pair fails go through the merges themselves. Each different word is encoded once a batch of texts.

The texts' words follow the vocabulary file's own rules (NFC, lower case, split at white space, one digit a word). Texts of Latin letters
and common punctuation take a compiled pattern; all others take the library's normaliser and splitter, and then the same encoder.

Defined results: null and empty texts have no tokens and decode to the empty text; repeated rows are encoded alike; the strings of special tokens
in a text become those tokens, as in the library; a text is read as a whole, however long; merges of equal rank don't occur, and of equal places the left one goes first; null ids stay null;
an empty table gives an empty result; further columns are ignored, whatever their names. A vocabulary file with a decoder of its own is refused, since decoding here is joining tokens by spaces.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm.common import column, give_back, slices, tidied

#: Words that a worker remembers; beyond, it forgets those that it met in one batch only, or all if that isn't enough. This bounds memory and changes no result.
REMEMBERED = 100_000
#: Bytes of texts, about, whose words a worker has as Python objects at once.
MOST_BYTES = 1 << 20
#: Letters of a word that is merged over a list.
SHORT = 24
END = "</w>"
#: Stands behind every merge.
NEVER = (sys.maxsize, -1)


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, n = [""] * 256, 0
    for b in range(256):
        letters[b] = chr(b) if b in shown else chr(256 + n)
        n += b not in shown
    return letters


def _class(test) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x180) if test(chr(c)))


class Encoder:
    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        file = json.loads(spec)
        self.joined = not file.get("decoder")  # decoding is joining tokens by spaces
        model = file["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.strings = [""] * size
        for token, i in (*self.vocab.items(), *self.special.items()):
            self.strings[i] = token
        self.rank = {(self.vocab[a], self.vocab[b]): (k, self.vocab[a + b]) for k, (a, b) in enumerate(merges)}
        # Times: a token is made by its first merge; single bytes are there from the start.
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        self.made = np.full(size, -1)
        for (a, b), (k, made) in self.rank.items():
            if self.left[made] < 0:
                self.left[made], self.right[made], self.made[made] = a, b, k
        pairs = np.array([a * size + b for a, b in self.rank], dtype=np.int64)
        order = np.argsort(pairs)
        self.size, self.pairs = size, pairs[order]
        self.times = np.array([k for k, _ in self.rank.values()], dtype=np.int64)[order]
        whole = np.flatnonzero(self.left >= 0)
        self.own = self.left < 0
        self.own[whole] = self.compatible(self.left[whole], self.right[whole], self.made[whole])
        for i in whole[np.argsort(self.made[whole])]:
            self.own[i] &= self.own[self.left[i]] & self.own[self.right[i]]
        self.reach: dict[str, int] = {}  # letters of the longest token, by its first three
        for token in self.vocab:
            n = len(token.removesuffix(END))
            if n > 2 and n > self.reach.get(token[:3], 2):
                self.reach[token[:3]] = n
        letters = _byte_letters()
        self.letters = letters
        self.bytes = {x: b for b, x in enumerate(letters)}
        self.ascii = {b: letters[b] for b in range(128)}
        special = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        letter, digit = (_class(lambda c, k=k: unicodedata.category(c)[0] == k) for k in "LN")
        space = r"\t-\r \x85\xa0"
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^{space}{letter}{digit}]+").findall
        self.rare = re.compile("[^\x00-ſ‐-‧‰-⁞€]").search
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.again = np.zeros(0, bool)

    def forget_rare(self) -> None:
        """Forget the words that were met in one batch only."""
        kept = np.flatnonzero(self.again)
        counts = self.counts[kept]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.starts[kept] - (ends - counts), counts) + np.arange(total)]
        place = np.cumsum(self.again) - 1
        index = {w: int(place[k]) for w, k in self.index.items() if self.again[k]}
        self.forget()
        self.index, self.ids, self.starts, self.counts, self.again = index, ids, ends - counts, counts, np.zeros(len(kept), bool)

    def compatible(self, first: np.ndarray, second: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """For all pairs at once: no merge across the border comes earlier than what the two sides are made of (nor, if given, before)."""
        a, b = first.copy(), second.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max) if before is None else before.copy()
        good = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        while len(live):
            x, y, most = a[live], b[live], limit[live]
            key = x.astype(np.int64) * self.size + y
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            bad = (self.pairs[at] == key) & (self.times[at] < most)
            good[live[bad]] = False
            mx, my = self.made[x], self.made[y]
            # Undo the later of the two sides. An equal merge stands on both sides at once; the left one is done first, so the right is undone first.
            undo_x = mx > my
            stop = bad | ((mx < 0) & (my < 0))
            keep = ~stop
            live, x, y, mx, my, undo_x = live[keep], x[keep], y[keep], mx[keep], my[keep], undo_x[keep]
            a[live] = np.where(undo_x, self.right[x], x)
            b[live] = np.where(undo_x, y, self.left[y])
            # On the left side a merge at the same time across the border would have come after; on the right one it would have come before.
            limit[live] = np.where(undo_x, mx, my + 1)
        return good

    def propose(self, letters: str) -> list[int]:
        """Longest token at every place; END marks the word's end."""
        out, at, n, vocab, reach = [], 0, len(letters), self.vocab, self.reach
        while at < n:
            to = at + reach.get(letters[at : at + 3], 2)
            if to >= n:
                to = n - 1
                found = vocab.get(letters[at:] + END)
                if found is not None:
                    out.append(found)
                    break
            while to > at:
                found = vocab.get(letters[at:to])
                if found is not None:
                    out.append(found)
                    at = to
                    break
                to -= 1
            else:
                raise ValueError(f"no token for {letters[at]!r}")
        return out

    def merge(self, letters: str) -> list[int]:
        """The merges themselves, earliest first and from the left: over a linked list with a heap, or if the word is short over a list."""
        ids = [self.vocab[c] for c in letters[:-1]] + [self.vocab[letters[-1] + END]]
        if len(ids) <= SHORT:
            return self.merge_short(ids)
        after, ahead = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        rank = self.rank
        heap = [(rank[p][0], i, *p) for i in range(len(ids) - 1) if (p := (ids[i], ids[i + 1])) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != x or ids[j] != y:
                continue
            ids[i], ids[j] = rank[x, y][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                ahead[after[i]] = i
            for k, m in ((ahead[i], i), (i, after[i])):
                if k >= 0 and m >= 0 and (p := (ids[k], ids[m])) in rank:
                    heapq.heappush(heap, (rank[p][0], k, *p))
        return [i for i in ids if i >= 0]

    def merge_short(self, ids: list[int]) -> list[int]:
        rank = self.rank
        found = [rank.get(p, NEVER) for p in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best is NEVER:
                break
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = rank.get((ids[i - 1], ids[i]), NEVER)
            if i < len(found):
                found[i] = rank.get((ids[i], ids[i + 1]), NEVER)
        return ids

    def learn(self, words: list[str]) -> None:
        """Encode new words and remember them."""
        shown = [w.translate(self.ascii) if w.isascii() else "".join(map(self.letters.__getitem__, w.encode())) for w in words]
        found = [self.propose(s) for s in shown]
        counts = np.array([len(x) for x in found], dtype=np.int64)
        flat = np.array([i for x in found for i in x], dtype=np.int64)
        owner = np.repeat(np.arange(len(words)), counts)
        good = np.ones(len(words), dtype=bool)
        good[owner[~self.own[flat]]] = False
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        unlike, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        fits = self.compatible(unlike // self.size, unlike % self.size)[back]
        good[owner[inner[~fits]]] = False
        if not good.all():
            for k in np.flatnonzero(~good):
                found[k] = self.merge(shown[k])
            counts = np.array([len(x) for x in found], dtype=np.int64)
            flat = np.array([i for x in found for i in x], dtype=np.int64)
        base = len(self.index)
        self.index.update(zip(words, range(base, base + len(words)), strict=True))
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(counts) - counts)
        self.counts = np.append(self.counts, counts)
        self.again = np.append(self.again, np.zeros(len(words), bool))
        self.ids = np.append(self.ids, flat.astype(np.int32))

    def split(self, text: str) -> list[str]:
        if not text.isascii():
            if self.rare(text):
                pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
                return [bytes(map(self.bytes.__getitem__, p)).decode() for p, _ in pieces]
            text = unicodedata.normalize("NFC", text)
        return self.words(text.lower())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all texts."""
        cut = []
        for text in texts:
            if "<|" in text and self.cut:
                words: list = []
                for k, part in enumerate(self.cut.split(text)):
                    words += [self.special[part]] if k % 2 else self.split(part)
                cut.append(words)
            else:
                cut.append(self.split(text))
        unlike = set().union(*cut)
        if len(self.index) + len(unlike) > REMEMBERED:
            self.forget_rare()
            if len(self.index) + len(unlike) > REMEMBERED:
                self.forget()
        known = len(self.index)
        new = [w for w in unlike if w not in self.index and isinstance(w, str)]
        if new:
            self.learn(new)
        for i in (w for w in unlike if isinstance(w, int) and w not in self.index):
            self.index[i] = len(self.index)
            self.starts, self.counts, self.again = np.append(self.starts, len(self.ids)), np.append(self.counts, 1), np.append(self.again, False)
            self.ids = np.append(self.ids, np.int32(i))
        look = self.index.__getitem__
        sizes = [len(w) for w in cut]
        at = np.fromiter(map(look, chain.from_iterable(cut)), dtype=np.int64, count=sum(sizes))
        self.again[at[at < known]] = True
        n = self.counts[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.starts[at] - (ends - n), n) + np.arange(total)]
        return np.append(0, np.append(0, ends)[np.cumsum(sizes)]) if sizes else np.zeros(1, np.int64), ids


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file's text as a broadcast: a fixed file of a few MB, whatever the corpus."""
    return spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))


def _lists(encoder: Encoder, batch: pa.RecordBatch) -> pa.ListArray:
    offsets, ids = encoder.encode([x or "" for x in batch.column(1).to_pylist()])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


def _tokens(spec: str) -> pa.Array:
    """The tokens' strings by number."""
    file = json.loads(spec)
    if file.get("decoder"):
        raise ValueError("the vocabulary has a decoder of its own")
    named = {**file["model"]["vocab"], **{x["content"]: x["id"] for x in file["added_tokens"]}}
    strings = [""] * (max(named.values()) + 1)
    for token, i in named.items():
        strings[i] = token
    return pa.array(strings, pa.string())


def _spoken(tokens: pa.Array, lists: pa.ListArray) -> pa.Array:
    """The texts that lists of ids stand for."""
    held = pa.ListArray.from_arrays(pc.subtract(lists.offsets, lists.offsets[0]), tokens.take(lists.flatten()))
    return pc.binary_join(held, " ")


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""
    spec = vocabulary(docs.sparkSession, path)

    def run(batches):
        encoder = Encoder(spec.value)
        for whole in batches:
            for batch in slices(whole, 1, MOST_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(encoder, batch)], names=["doc_id", "ids"])

    return _slim(docs, id_col, text_col).mapInArrow(tidied(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the file has no decoder, so a text decodes to its tokens with spaces between."""
    spec = vocabulary(encoded.sparkSession, path)

    def run(batches):
        tokens = _tokens(spec.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*batch.columns, _spoken(tokens, batch.column(1))], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(tidied(run), "doc_id long, ids array<int>, decoded string")


def there_and_back(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): encode and decode in one worker a task instead of two, for the ids are the only thing that decoding reads."""
    spec = vocabulary(docs.sparkSession, path)

    def run(batches):
        encoder = Encoder(spec.value)
        if not encoder.joined:
            raise ValueError("the vocabulary has a decoder of its own")
        tokens = pa.array(encoder.strings, pa.string())
        give_back()  # what building them took
        for whole in batches:
            for batch in slices(whole, 1, MOST_BYTES):
                lists = _lists(encoder, batch)
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, _spoken(tokens, lists)], names=["doc_id", "ids", "decoded"])

    return _slim(docs, id_col, text_col).mapInArrow(tidied(run), "doc_id long, ids array<int>, decoded string")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
