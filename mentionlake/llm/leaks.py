"""Evaluation passages inside training text (problem 9), by winnowing.

Texts become words in one coarse form (case, accents, look-alikes, unseen signs and
punctuation set aside).  Of every ``window`` neighbouring hashes of ``k`` words the least
is kept, so two texts that share window + k - 1 words in a row share a kept hash; with the
default of 3 and 2 that is any four words.  The kept hashes of the items meet those of the
documents where the documents are read: the items are the query set, so their hashes go to
the workers as sorted arrays, and documents are neither moved nor read twice.  A pair with
one hash in common is a candidate; it is extended to the longest chain of words common to
both in order, stepping over a changed or inserted word or two, and counts if the chain
spans ``least`` words of the item.

Items of more than ``BLOCK_BYTES`` are taken in blocks of that size, each held against all
documents; the pairs of all blocks then meet by document, as chains of a document compete.

Items share turns of phrase.  Within a document the chains are taken from the longest
down, and a chain counts only for words that no longer chain holds already; so a turn that
belongs to a passage of one item is no case for another.

Defined cases: null and empty texts and items hold nothing; equal items are all reported;
repeated documents are reported each; a text of any length is taken whole.  Columns other
than the key and the text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionlake.llm.batches import frames
from mentionlake.llm.folding import _skeleton_maps
from mentionlake.session import cut, parallel

K, WINDOW, LEAST, STEP = 3, 2, 12, 3
#: Bytes of the texts of items that go to the workers at once.
BLOCK_BYTES = 16_000_000
_MAPS = _skeleton_maps()
_FOLD = dict(zip(_MAPS[0], _MAPS[1])) | {c: "" for c in _MAPS[0][len(_MAPS[1]) :]} | {chr(c): "" for c in range(0x300, 0x370)}
_FOLDED = re.compile("[" + "".join(map(re.escape, _FOLD)) + "]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text: runs of letters and digits of its coarse form."""
    if not text:
        return []
    return _WORD.findall((text if text.isascii() else _FOLDED.sub(lambda m: _FOLD[m.group()], text)).lower())


class Codes:
    """64-bit hashes of words, kept for the words that were seen lately."""

    def __init__(self, most: int = 500_000):
        self.seen: dict[str, int] = {}
        self.most = most

    def __call__(self, said: list[str]) -> list[int]:
        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        out = []
        for w in said:
            c = seen.get(w)
            if c is None:
                c = seen[w] = xxhash.xxh64_intdigest(w)
            out.append(c)
        return out


def gram_hashes(codes: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all runs of k words, by their order."""
    n = max(len(codes) - k + 1, 0)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = (h ^ codes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def kept_hashes(h: np.ndarray, first: np.ndarray, last: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each gram the least of the window that begins with it, and whether it counts.

    first, last: of each gram, the first and the last one of its text; a text of fewer grams
    than the window has one window of all."""
    low, at = h.copy(), np.arange(len(h))
    for j in range(1, window):
        inside = at + j <= last
        low[inside] = np.minimum(low[inside], h[at[inside] + j])
    return low, (at + window - 1 <= last) | (at == first)


class Item:
    """One text of the items: its ids (the least first), k-grams, and where each word stands."""

    def __init__(self, ids: list[int], said: list[str], k: int = K):
        self.ids, self.at = sorted(ids), {}
        for i, w in enumerate(said):
            self.at.setdefault(w, []).append(i)
        self.hashes = gram_hashes(np.array(Codes()(said), np.uint64), k)
        self.grams = self.hashes.tolist()


class Items:
    """A block of items, and which of them keep a hash."""

    def __init__(self, rows: list[tuple[int, str | None]], k: int = K, window: int = WINDOW):
        by_text: dict[tuple, list[int]] = {}
        for i, text in rows:
            said = tuple(words(text))
            if len(said) >= k:
                by_text.setdefault(said, []).append(i)
        self.all = [Item(ids, list(said), k) for said, ids in sorted(by_text.items())]
        pairs: set[tuple[int, int]] = set()
        for n, item in enumerate(self.all):
            size = len(item.hashes)
            low, counts = kept_hashes(item.hashes, np.zeros(size, int), np.full(size, size - 1), window)
            pairs |= {(h, n) for h in low[counts].tolist()}
        rows_ = sorted(pairs)
        self.kept = np.array([h for h, _ in rows_], np.uint64)
        self.of = np.array([n for _, n in rows_], np.int64)
        self.every = np.unique(np.concatenate([i.hashes for i in self.all])) if self.all else np.zeros(0, np.uint64)

    def having(self, h: np.ndarray) -> np.ndarray:
        """The items that keep any of the hashes."""
        lo, hi = np.searchsorted(self.kept, h, "left"), np.searchsorted(self.kept, h, "right")
        return np.unique(np.concatenate([self.of[a:b] for a, b in zip(lo, hi)]))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is one of a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Text:
    """The words of a document with the places of its k-grams; words may be taken out."""

    def __init__(self, said: list[str], grams: dict[int, list[int]]):
        self.words: list[str | None] = list(said)
        self.grams = grams

    def take(self, begin: int, end: int) -> None:
        self.words[begin:end] = [None] * (end - begin)


def chain(item: Item, doc: Text, k: int = K, step: int = STEP, around: int = 16, fewest: int = 1) -> list[tuple[int, int]]:
    """The longest chain of (item position, document position) of equal words in order.

    A link steps over at most step - 1 words on either side.  Only stretches of the
    document near k-grams of the item are searched, and none if they hold under ``fewest``
    words of the item.
    """
    words, near, at = doc.words, set(), item.at
    for g in item.grams:
        for d in doc.grams.get(g, ()):
            if words[d] is not None:
                near.update(range(max(0, d - around), min(len(words), d + k + around)))
    near = sorted(d for d in near if words[d] in at)
    if len(near) < fewest:
        return []
    ends: dict[int, dict[int, tuple[int, tuple | None]]] = {}  # document position -> item position -> (length, link before)
    top, most = None, 0
    for d in near:
        places = at[words[d]]
        rows = [(b, r) for b in range(1, step + 1) if (r := ends.get(d - b))]
        here = ends[d] = {}
        for i in places:
            score, back = 1, None
            for b, r in rows:
                for a in range(i - 1, i - step - 1, -1):
                    got = r.get(a)
                    if got and got[0] >= score:
                        score, back = got[0] + 1, (a, d - b)
            here[i] = (score, back)
            if score > most:
                top, most = (i, d), score
    out = []
    while top is not None:
        out.append(top)
        top = ends[top[1]][top[0]][1]
    return out[::-1]


def _counts(c: list[tuple[int, int]], least: int) -> bool:
    """Whether a chain is a passage: long enough, and mostly of equal words."""
    return bool(c) and (span := c[-1][0] - c[0][0] + 1) >= least and 3 * len(c) >= 2 * span


def leaked(free: Text, items: list[Item], least: int = LEAST) -> list[tuple[int, int]]:
    """(item id, words spanned) of the items that leaked into one document."""
    out = []
    waiting = [(len(c), -item.ids[0], item, c) for item in items if _counts(c := chain(item, free, fewest=2 * least // 3), least)]
    while waiting:
        waiting.sort(key=lambda x: x[:2])
        _, _, item, c = waiting.pop()
        if any(free.words[d] is None for _, d in c):  # part of it belongs to a longer chain: look at the rest
            if _counts(c := chain(item, free, fewest=2 * least // 3), least):
                waiting.append((len(c), -item.ids[0], item, c))
            continue
        out += [(i, c[-1][0] - c[0][0] + 1) for i in item.ids]
        free.take(c[0][1], c[-1][1] + 1)
    return out


def candidates(texts: list[str | None], items: Items, codes: Codes, k: int = K, window: int = WINDOW) -> Iterator[tuple[int, Text, list[Item]]]:
    """(place in the list, text, items) of the texts that share a kept hash with an item."""
    said = [words(t) for t in texts]
    flat = np.array(codes([w for s in said for w in s]), np.uint64)
    size = np.array([len(s) for s in said], np.int64)
    begin = np.concatenate(([0], np.cumsum(size)))[:-1]
    h = gram_hashes(flat, k)
    if not len(h) or not len(items.kept):
        return
    of = np.repeat(np.arange(len(said)), size)[: len(h)]
    last = (begin + size - k)[of]  # the last gram that lies in the text whole
    at = np.arange(len(h))
    valid = at <= last
    low, counts = kept_hashes(h, begin[of], last, window)
    hit = np.flatnonzero(valid & counts & _among(low, items.kept))
    if not len(hit):
        return
    whole = valid & _among(h, items.every)
    for d, some in zip(*(lambda u, i: (u, np.split(hit, i[1:])))(*np.unique(of[hit], return_index=True))):
        b, e = begin[d], begin[d] + size[d]
        grams: dict[int, list[int]] = {}
        for p in np.flatnonzero(whole[b:e]).tolist():
            grams.setdefault(int(h[b + p]), []).append(p)
        yield int(d), Text(said[d], grams), [items.all[n] for n in items.having(np.unique(low[some])).tolist()]


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of about BLOCK_BYTES, each brought to the driver by itself."""
    rows = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    n = 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i)
        yield [(r.item_id, r.text) for r in part.collect()]


def _scanned(documents: DataFrame, rows: list[tuple[int, str | None]], k: int, window: int, least: int, last: bool) -> DataFrame:
    """(doc_id, item_id, span) of one block; unless it is the ``last``, chains do not compete yet."""
    shared = documents.sparkSession.sparkContext.broadcast(Items(rows, k, window))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, codes = shared.value, Codes()
        for b in frames(batches, "text"):
            out, keys = [], b["doc_id"].to_numpy()
            for d, text, some in candidates(b["text"].tolist(), items, codes, k, window):
                if last:
                    out += [(keys[d], i, n) for i, n in leaked(text, some, least)]
                else:
                    out += [(keys[d], i, len(c)) for item in some if _counts(c := chain(item, text, fewest=2 * least // 3), least) for i in item.ids]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "span"]).astype({"doc_id": "int64", "item_id": "int64", "span": "int32"})

    return documents.select("doc_id", "text").where(F.col("text").isNotNull()).mapInPandas(run, "doc_id bigint, item_id bigint, span int")


def leaks(documents: DataFrame, items: DataFrame, k: int = K, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, span): the items of which a document holds a passage."""
    blocks = _blocks(items)
    first, rest = next(blocks), next(blocks, None)
    if rest is None:
        return _scanned(documents, first, k, window, least, True)
    pairs = None
    for rows in (first, rest, *blocks):
        found = cut(_scanned(documents, rows, k, window, least, False), "pairs")
        pairs = found if pairs is None else pairs.union(found)
    # Chains of a document compete over all blocks: its text meets the items that it holds a chain of.
    held = pairs.join(items.select("item_id", F.col("text").alias("item_text")), "item_id").groupBy("doc_id").agg(F.collect_set(F.struct("item_id", "item_text")).alias("items"))
    both = documents.select("doc_id", "text").join(held, "doc_id").repartition(parallel(documents.sparkSession), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = Codes()
        for b in frames(batches, "text"):
            out = []
            for key, text, some in zip(b["doc_id"], b["text"], b["items"]):
                own = Items([(int(x["item_id"]), x["item_text"]) for x in some], k, window)
                out += [(key, i, n) for _, t, cand in candidates([text], own, codes, k, window) for i, n in leaked(t, cand, least)]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "span"]).astype({"doc_id": "int64", "item_id": "int64", "span": "int32"})

    return both.mapInPandas(run, "doc_id bigint, item_id bigint, span int")


def p9_found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): one row for each document and item that leaked into it."""
    return leaks(documents, items).select("doc_id", "item_id").distinct()
