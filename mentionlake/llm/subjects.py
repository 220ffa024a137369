"""Subject areas of documents (problem 10): sentence terms under a chain of classifiers.

Terms.  Sentences get their subject by log-odds of their words and word pairs.  Labels are
known for documents only, so the sentences of the labelled sample are attributed to the
labels of their document by expectation maximisation, with a background class for what any
document may say; passages of evaluation items train the background, and a sentence that recurs in
documents of unlike subjects (a greeting) is a stock phrase and has none.  Sentences of a
bounded sample of unlabelled documents join the later rounds.

Chain.  A document's features are the share of each subject among its sentences that have
one (the term part), its source, and its structure (form, sentences, length).  One
logistic regression for each subject sees them together with the decisions for the
subjects before it, so subjects that occur together support each other; each is calibrated
on held-out folds.  Beam search takes the most likely combination of at most ``MOST``
subjects.

The model is trained here, on at most ``SAMPLE_DOCS`` labelled and ``EXTRA_DOCS``
unlabelled documents, whole, picked by a hash of their key; every document is decided.

Defined cases: null, blank and wordless texts, and texts whose sentences have no subject,
give no row; repeated documents are decided alike and each; double labels count once and a
label that is no subject counts as none; without any labels there are no subjects.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionlake.llm.batches import frames
from mentionlake.llm.folding import _skeleton_maps
from mentionlake.session import sampled

SAMPLE_DOCS, EXTRA_DOCS, ROUNDS, MOST, BEAM = 3000, 3000, 6, 2, 6
#: Bound on the distinct terms of the evaluation items, which come to the driver.
MOST_TERMS = 2_000_000
#: A sentence has a subject from these log-odds against the background on.
LEAST_ODDS = 3.0
#: Standard errors that are taken off each log-odds.
CHANCE = 1.3
#: A sentence that so many documents hold is a stock phrase if no subject has this share of them.
STOCK_SEEN, STOCK_SHARE = 6, 0.6

_STOP = re.compile(r"[.!?…]+(?=\s|$)|[\n\r|]+")
_SPEAKER = re.compile(r"^\s*(?:[>*+\-•#★☆\d:.\[\]()]+\s*)*(?:@[\w.]+:?\s*)?")
_WORD = re.compile(r"[^\W\d_]+")
_MAPS = _skeleton_maps()
_TAGS = re.compile(r"[#@]\S+")
_FOLD = dict(zip(_MAPS[0], _MAPS[1])) | {a: "" for a in _MAPS[0][len(_MAPS[1]) :]}
_FOLDED = re.compile("[" + "".join(map(re.escape, _FOLD)) + "]")


def _coarse(text: str) -> str:
    return (text if text.isascii() else _FOLDED.sub(lambda m: _FOLD[m.group()], text)).lower()


def sentences(text: str | None) -> list[list[str]]:
    """The sentences of a text, as words in a coarse form."""
    out = []
    for s in _STOP.split(_coarse(text or "")):
        s = s[_SPEAKER.match(s).end() :]
        if "#" in s or "@" in s:
            s = _TAGS.sub(" ", s)
        w = _WORD.findall(s)
        if len(w) >= 3:
            out.append(w)
    return out


def terms(words: list[str]) -> set:
    """The distinct words and pairs of neighbouring words."""
    return {*words, *zip(words, words[1:])}


def _order(term) -> str:
    return term if type(term) is str else " ".join(term)


class Terms:
    """Log-odds of terms for each subject, learned from documents with sets of labels."""

    def __init__(self, subjects: list[str]):
        self.subjects, self.index, self.odds = subjects, {}, np.zeros((0, len(subjects)), np.float32)
        self.stock: set[str] = set()

    def rows(self, sents: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(term ids of all sentences, offsets)."""
        ids, ends = [], [0]
        get = self.index.get
        for w in sents:
            ids += [i for t in terms(w) if (i := get(t)) is not None]
            ends.append(len(ids))
        return np.array(ids, np.int64), np.array(ends, np.int64)

    def score(self, sents: list[list[str]]) -> np.ndarray:
        ids, ends = self.rows(sents)
        total = np.concatenate([np.zeros((1, len(self.subjects)), np.float64), np.cumsum(self.odds[ids], axis=0, dtype=np.float64)])
        score = total[ends[1:]] - total[ends[:-1]]
        if self.stock:
            score[[i for i, w in enumerate(sents) if " ".join(w) in self.stock]] = 0
        return score

    def find_stock(self, sents: list[list[str]], of: np.ndarray, doc: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Which sentences are stock phrases: the same words in documents of unlike subjects.

        doc, own: the subject scores of each document and of each sentence.
        """
        others = doc[of] - own
        sure = others.max(1) >= LEAST_ODDS
        about = others.argmax(1)
        seen: dict[str, np.ndarray] = {}
        keys = [" ".join(w) for w in sents]
        for i in np.flatnonzero(sure):
            seen.setdefault(keys[i], np.zeros(len(self.subjects)))[about[i]] += 1
        self.stock = {s for s, c in seen.items() if c.sum() >= STOCK_SEEN and c.max() < STOCK_SHARE * c.sum()}
        return np.array([s in self.stock for s in keys], bool)

    def fit(self, docs: list[list[list[str]]], labels: list[set[int] | None], background: dict) -> None:
        """labels: of each document, or None where it has none known; background: term -> in how
        many sentences that have no subject it stands."""
        k = len(self.subjects)
        count: dict = {}
        for d in docs:
            for w in d:
                for t in terms(w):
                    count[t] = count.get(t, 0) + 1
        for t, n in background.items():
            count[t] = count.get(t, 0) + n
        self.index = {t: i for i, t in enumerate(sorted((t for t, n in count.items() if n >= 3), key=_order))}
        sents = [w for d in docs for w in d]
        of = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        ids, ends = self.rows(sents)
        size = np.diff(ends)
        at = np.repeat(np.arange(len(sents)), size)
        allowed = np.zeros((len(docs), k), bool)
        known = np.array([x is not None for x in labels], bool)
        for i, x in enumerate(labels):
            allowed[i, list(x) if x is not None else slice(None)] = True
        if not len(sents) or not known.any():
            self.odds = np.zeros((len(self.index), k), np.float32)
            return
        n = len(self.index)
        back0 = np.zeros(n)
        for t, c in background.items():
            if t in self.index:
                back0[self.index[t]] = c
        # Start: the sentences of labelled documents belong to their labels in equal shares.
        post = np.where(allowed[of] & known[of][:, None], 1.0, 0.0)
        post /= np.maximum(post.sum(1, keepdims=True), 1)
        for step in range(ROUNDS + 1):
            mass = np.stack([np.bincount(ids, post[at, j], n) for j in range(k)], 1)
            rest = np.bincount(ids, np.maximum(1 - post[at].sum(1), 0) * (known[of][at] | (step > 2)), n) + back0
            every = mass.sum(1) + rest
            rate = (mass + 0.5 * (every / every.sum())[:, None]) / (mass.sum(0) + 0.5)
            base = (every[:, None] - mass + 0.5 * (every / every.sum())[:, None]) / (every.sum() - mass.sum(0) + 0.5)
            # What chance alone would give a term is taken off: else the many terms of a
            # greeting, each a little uneven among the labels, add up to a subject.
            odds = np.log(np.maximum(rate, 1e-12) / np.maximum(base, 1e-12))
            chance = CHANCE * np.sqrt(1 / (mass + 0.5) + 1 / (every[:, None] - mass + 2.0))
            self.odds = np.clip(np.sign(odds) * np.maximum(np.abs(odds) - chance, 0), -3.5, 3.5).astype(np.float32)
            if step == ROUNDS:
                break
            total = np.concatenate([np.zeros((1, k)), np.cumsum(self.odds[ids], axis=0, dtype=np.float64)])
            score = total[ends[1:]] - total[ends[:-1]]
            score = np.where(allowed[of], score, -1e9)
            # A document speaks of few subjects: what the rest of it is about weighs in.
            own = np.clip(score, 0, 8)
            doc = np.stack([np.bincount(of, own[:, j], len(docs)) for j in range(k)], 1)
            stock = self.find_stock(sents, of, doc, own)
            share = (doc + 0.1) / (doc.sum(1, keepdims=True) + 0.1 * k)
            full = np.concatenate([score + np.log(share)[of], np.full((len(sents), 1), LEAST_ODDS - 3.0)], 1)
            full -= full.max(1, keepdims=True)
            p = np.exp(full)
            post = (p / p.sum(1, keepdims=True))[:, :k]
            post[stock] = 0
            if step < 2:
                post *= known[of][:, None]


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights by Newton's method; the last column of x is the constant."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + l2 * w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + l2 * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Chain:
    """A chain of calibrated logistic regressions, decoded by beam search."""

    def __init__(self, subjects: list[str], sources: list[str], forms: list[str]):
        self.subjects, self.sources, self.forms = subjects, sources, forms
        self.weights: list[np.ndarray] = []
        self.scale: list[tuple[float, float]] = []

    def features(self, score: np.ndarray, of: np.ndarray, n: int, source: list, form: list) -> tuple[np.ndarray, np.ndarray]:
        """(features, share of each subject) of n documents from the scores of their sentences."""
        k = len(self.subjects)
        best = score.argmax(1) if len(score) else np.zeros(0, int)
        has = (score.max(1) >= LEAST_ODDS) if len(score) else np.zeros(0, bool)
        counts = np.stack([np.bincount(of[has & (best == j)], minlength=n) for j in range(k)], 1) if k else np.zeros((n, 0))
        total = counts.sum(1, keepdims=True)
        share = counts / np.maximum(total, 1)
        one = lambda values, known: np.array([[v == x for x in known] for v in values], float).reshape(n, len(known))
        shape = np.stack([np.log1p(np.bincount(of, minlength=n)), np.log1p(total[:, 0]), (total[:, 0] == 0).astype(float), (share > 0).sum(1)], 1)
        return np.concatenate([share, one(source, self.sources), one(form, self.forms), shape], 1), share

    def _row(self, x: np.ndarray, share: np.ndarray, j: int, before: np.ndarray) -> np.ndarray:
        mine = share[:, j]
        own = np.stack([mine, np.clip(mine * 3, 0, 1), (mine >= 1 / 3).astype(float) * 2, (mine > 0.2).astype(float), np.abs(mine - 1 / 3)], 1)
        return np.concatenate([own, x, before, np.ones((len(x), 1))], 1)

    def fit(self, x: np.ndarray, share: np.ndarray, y: np.ndarray, folds: int = 5) -> None:
        n, k = y.shape
        fold = np.arange(n) % folds
        for j in range(k):
            rows = self._row(x, share, j, y[:, :j])
            raw = np.zeros(n)
            for f in range(folds):
                if (fold != f).any() and (fold == f).any():
                    raw[fold == f] = rows[fold == f] @ logistic(rows[fold != f], y[fold != f, j])
            a, b = logistic(np.stack([raw, np.ones(n)], 1), y[:, j], 0.01)
            self.weights.append(logistic(rows, y[:, j]))
            self.scale.append((max(float(a), 0.05), float(b)))

    def decode(self, x: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(labels, probability of the combination) by a beam of partial combinations."""
        n, k = share.shape
        beams, logp = np.zeros((n, 1, 0)), np.zeros((n, 1))
        for j in range(k):
            width = beams.shape[1]
            rows = self._row(np.repeat(x, width, 0), np.repeat(share, width, 0), j, beams.reshape(n * width, j))
            a, b = self.scale[j]
            p = 1 / (1 + np.exp(-np.clip(a * (rows @ self.weights[j]) + b, -30, 30))).reshape(n, width)
            full = beams.sum(2) >= MOST
            grown = np.concatenate([np.concatenate([beams, np.zeros((n, width, 1))], 2), np.concatenate([beams, np.ones((n, width, 1))], 2)], 1)
            logp = np.concatenate([logp + np.log1p(-p * (1 - 1e-9)), np.where(full, -np.inf, logp + np.log(p + 1e-12))], 1)
            top = np.argsort(-logp, axis=1, kind="stable")[:, :BEAM]
            beams, logp = np.take_along_axis(grown, top[:, :, None], 1), np.take_along_axis(logp, top, 1)
        return beams[:, 0].astype(bool), np.exp(logp[:, 0])


def _scored(model: Terms, texts: list) -> tuple[np.ndarray, np.ndarray]:
    docs = [sentences(t) for t in texts]
    of = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    return model.score([w for d in docs for w in d]), of


def counted(texts: Iterable[str | None]) -> dict:
    """term -> the number of sentences of the texts that hold it."""
    out: dict = {}
    for text in texts:
        for w in sentences(text):
            for t in terms(w):
                out[t] = out.get(t, 0) + 1
    return out


def item_terms(items: DataFrame) -> dict:
    """``counted`` over the texts of all items, in partial counts; more than MOST_TERMS is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames(batches, "text"):
            found = counted(b["text"])
            yield pd.DataFrame({"term": np.array([_order(t) for t in found], object), "n": np.array(list(found.values()), "int64")})

    sums = items.select("text").where(F.col("text").isNotNull()).mapInPandas(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    rows = sums.limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"evaluation items of more than {MOST_TERMS} terms")
    return {tuple(r.term.split(" ")) if " " in r.term else r.term: r.n for r in rows}


def train(rows: list[tuple], subjects: list[str], background: dict | Iterable[str]) -> tuple[Terms, Chain]:
    """From (text, source, form, labels or None) of sampled documents; background: texts without a
    subject, or their ``counted`` terms."""
    background = background if isinstance(background, dict) else counted(background)
    at = {s: i for i, s in enumerate(subjects)}
    docs = [sentences(r[0]) for r in rows]
    labels = [None if r[3] is None else {at[x] for x in r[3] if x in at} for r in rows]
    model = Terms(subjects)
    model.fit(docs, labels, background)
    kept = [i for i, x in enumerate(labels) if x is not None]
    chain = Chain(subjects, sorted({r[1] for r in rows if r[1]}), sorted({r[2] for r in rows if r[2]}))
    of = np.repeat(np.arange(len(kept)), [len(docs[i]) for i in kept])
    score = model.score([w for i in kept for w in docs[i]])
    x, share = chain.features(score, of, len(kept), [rows[i][1] for i in kept], [rows[i][2] for i in kept])
    y = np.array([[j in labels[i] for j in range(len(subjects))] for i in kept], float).reshape(len(kept), len(subjects))
    if len(kept):
        chain.fit(x, share, y)
    return model, chain


def sample(documents: DataFrame, labels: DataFrame, labelled: int = SAMPLE_DOCS, extra: int = EXTRA_DOCS) -> list[tuple]:
    """(text, source, form, labels or None) of the sampled documents."""
    pick = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = pick(labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("labels")), labelled)
    docs = documents.select("doc_id", "text", "source", "doc_form")
    got = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "source", "doc_form", "labels").collect()
    rest = sampled(docs.join(F.broadcast(chosen), "doc_id", "left_anti"), "doc_id", extra).collect()
    return [(r.text, r.source, r.doc_form, r.labels) for r in sorted(got, key=lambda r: r.doc_id)] + [(r.text, r.source, r.doc_form, None) for r in sorted(rest, key=lambda r: r.doc_id)]


def fit(documents: DataFrame, labels: DataFrame, subjects: DataFrame, items: DataFrame | None = None) -> tuple[Terms, Chain]:
    names = [r.subject for r in subjects.orderBy("ord", "subject").collect()]
    return train(sample(documents, labels), names, item_terms(items) if items is not None else {})


def subjects_of(documents: DataFrame, model: tuple[Terms, Chain]) -> DataFrame:
    """(doc_id, subject, probability of the combination, share of the sentences)."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, chain = shared.value
        for b in frames(batches, "text"):
            out = pd.DataFrame({"doc_id": np.zeros(0, "int64"), "subject": np.zeros(0, object), "probability": np.zeros(0), "share": np.zeros(0)})
            if len(b) and chain.weights:
                score, of = _scored(words, b["text"].tolist())
                x, share = chain.features(score, of, len(b), b["source"].tolist(), b["doc_form"].tolist())
                found, p = chain.decode(x, share)
                found &= share > 0
                r, c = np.nonzero(found)
                out = pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[r], "subject": np.array([chain.subjects[j] for j in c], object), "probability": p[r], "share": share[r, c]})
            yield out

    rows = documents.select("doc_id", "text", "source", "doc_form").where(F.col("text").isNotNull())
    return rows.mapInPandas(run, "doc_id bigint, subject string, probability double, share double")


def p10_found(documents: DataFrame, labels: DataFrame, subjects: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(doc_id, subject): one row for each subject of each document."""
    return subjects_of(documents, fit(documents, labels, subjects, items)).select("doc_id", "subject").distinct()
