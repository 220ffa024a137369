"""Languages of texts and of their parts (problem 1), by hyperdimensional profiles.

Each letter has a random vector of +1 and -1; the place of a letter in an n-gram permutes
its vector, and the n-gram's vector is their product.  A language's prototype bundles the
n-grams of its sample, a text's profile those of the text, and they are compared by
cosine.  A product with a prototype is linear in the bundle, so it is taken once for each
n-gram (``Profiles.table``); the words of a text then add up its score, for the whole or
any part of it, without building the vector again.  Which part is in which language is the
best path over the words, where a change of language costs more inside a sentence than
between two.

The prototypes are trained here on at most ``SAMPLE_ROWS`` labelled posts, whole, with a
few sentences of our own as a start; wrong labels are outvoted, then passages that read
as another language move to it (``ROUNDS`` times).

Defined cases: null, blank and wordless texts have no language; a part needs four words in
a row and a cosine of ``LEAST_COSINE``; tags, handles, addresses and numbers are no words; a text of any length is taken
whole; repeated rows are judged alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionlake.llm.batches import frames
from mentionlake.llm.folding import _skeleton_maps
from mentionlake.session import sampled


LANGUAGES = ("english", "swahili", "sheng", "french", "german")
#: Codes and names of the languages (first part of a label, lower case).
CODES = {
    "english": "english eng en", "swahili": "swahili kiswahili swa sw", "sheng": "sheng",
    "french": "french français francais fra fre fr", "german": "german deutsch deu ger de",
}
SAMPLE_ROWS, ROUNDS, DIMS, GRAMS, LEAST_WORDS = 3000, 3, 16384, (3, 4), 4
SWITCH, SWITCH_AT_STOP = 34.0, 10.0
#: A part counts as a sentence or clause from this cosine on; names and numbers fall short of it.
LEAST_COSINE = 0.1

#: A few sentences of our own for each language: a start where labels are few or absent.
SEEDS = {
    "english": "the people of this town have been waiting for the new road and they would like to know when it will be ready. I think we should go there with our friends before the rain starts because that is what everybody does",
    "swahili": "watu wa mji huu wamekuwa wakisubiri barabara mpya na wangependa kujua itakuwa tayari lini. nadhani tunapaswa kwenda huko pamoja na marafiki zetu kabla ya mvua kuanza kwa sababu hivyo ndivyo kila mtu anafanya",
    "sheng": "wasee wa mtaa wanangoja hiyo barabara mpya na manze wanadai kujua itakuwa ready lini buda. naona tuishie huko na mabeshte wetu kabla mvua ianze juu hivyo ndio kila msee anado bana, form ni gani leo, sina doo ya mat",
    "french": "les habitants de cette ville attendent la nouvelle route et ils voudraient savoir quand elle sera prête. je pense que nous devrions y aller avec nos amis avant que la pluie commence parce que c'est ce que tout le monde fait",
    "german": "die Leute in dieser Stadt warten auf die neue Straße und sie möchten wissen, wann sie fertig sein wird. ich denke, wir sollten mit unseren Freunden dorthin gehen, bevor der Regen anfängt, weil das alle so machen",
}

_NOT_WORDS = re.compile(r"(?:[#@]|https?://|www\.|mailto:)\S+|\S+@\S+")
_TOKEN = re.compile(r"(?<!\w)[^\W\d_]+(?:['’][^\W\d_]+)*(?!\w)|[.!?…\n/;|]|(?<=\s)-(?=\s)|[^\w\s,:'’\"()*#@+%-]")
_FOLD = str.maketrans(dict(zip(_skeleton_maps()[0][len(_skeleton_maps()[1]) :], [None] * 99)))
_LOOK = {ord(a): b for a, b in zip(*_skeleton_maps()) if not (0xC0 <= ord(a) < 0x1F00 and ord(a) < 0x250)}
_SIGHT = {**_LOOK, **_FOLD}


def label_language(label: Column) -> Column:
    """The language that a label names, null for none."""
    first = F.regexp_extract(F.lower(F.trim(label)), r"^([\p{L}]+)", 1)
    codes = F.create_map(*[F.lit(x) for k, v in CODES.items() for c in v.split() for x in (c, k)])
    return F.element_at(codes, first)


def tokens(text: str) -> tuple[list[str], list[bool]]:
    """(words in lower case, per word: a sentence ended before it)."""
    words, stops, stop = [], [], True
    if not text.isascii():
        text = text.translate(_SIGHT)
    if "#" in text or "@" in text or "://" in text or "www." in text or "mailto:" in text:
        text = _NOT_WORDS.sub(" . ", text)
    for t in _TOKEN.findall(text.lower()):
        if t[0].isalpha():
            words.append(t)
            stops.append(stop)
            stop = False
        else:
            stop = True
    return words, stops


def _ngrams(word: str) -> list[str]:
    w = f"_{word}_"
    return [w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1)]


class Profiles:
    """Letter vectors, prototypes and the product of each n-gram with each prototype."""

    def __init__(self, counts: dict[str, np.ndarray], least: int = 3):
        """counts: n-gram -> how often each language has it."""
        grams = sorted(g for g, c in counts.items() if c.sum() >= least) or sorted(counts)
        c = np.array([counts[g] for g in grams], float).reshape(len(grams), len(LANGUAGES))
        rate = np.log1p(c / np.maximum(c.sum(0), 1) * 20_000)
        weight = (rate - rate.mean(1, keepdims=True)).astype(np.float32)
        letters = {x: i for i, x in enumerate(sorted({x for g in grams for x in g}))}
        rng = np.random.default_rng(11)
        base = (rng.integers(0, 2, (len(letters) + 1, DIMS), dtype=np.int8) * 2 - 1).astype(np.int8)
        turned = [np.roll(base, p, axis=1) for p in range(max(GRAMS))]

        def vectors(chunk: list[str]) -> np.ndarray:
            out = np.ones((len(chunk), DIMS), np.int8)
            for p in range(max(GRAMS)):
                rows = [i for i, g in enumerate(chunk) if p < len(g)]
                out[rows] *= turned[p][[letters[chunk[i][p]] for i in rows]]
            return out

        step = 512
        prototypes = np.zeros((DIMS, len(LANGUAGES)), np.float32)
        for i in range(0, len(grams), step):
            prototypes += vectors(grams[i : i + step]).T.astype(np.float32) @ weight[i : i + step]
        self.norms = np.linalg.norm(prototypes, axis=0) / np.sqrt(DIMS)
        products = [vectors(grams[i : i + step]).astype(np.float32) @ prototypes / DIMS for i in range(0, len(grams), step)]
        table = np.concatenate(products) if products else np.zeros((0, len(LANGUAGES)), np.float32)
        scale = self.norms.mean() / np.maximum(self.norms, 1e-9)  # prototypes of unequal length count alike, as by cosine
        self.table = {g: (table[i] * scale).astype(np.float32) for i, g in enumerate(grams)}
        self.seen: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    def word_ids(self, words: list[str]) -> list[int]:
        seen = self.seen
        out = []
        for w in words:
            i = seen.get(w)
            if i is None:
                i = seen[w] = len(self.rows)
                known = [self.table[g] for g in _ngrams(w) if g in self.table]
                score = np.sum(known, axis=0) if known else np.zeros(len(LANGUAGES), np.float32)
                self.rows.append(np.append(score, np.float32(len(known))))
            out.append(i)
        return out

    def forget(self, most: int = 400_000) -> None:
        """Keeps the memory of words bounded; a forgotten word is scored again."""
        if len(self.rows) > most:
            self.seen, self.rows = {}, []


def best_paths(scores: np.ndarray, stops: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Language of each word: (texts, words, languages), (texts, words) -> (texts, words)."""
    n, most, k = scores.shape
    back = np.zeros((most, n, k), np.int8)
    now = scores[:, 0].copy()
    rows = np.arange(n)
    ends = np.zeros((n, k), np.float32)
    ends[lengths == 1] = now[lengths == 1]
    for t in range(1, most):
        cost = np.where(stops[:, t], np.float32(SWITCH_AT_STOP), np.float32(SWITCH))
        top = now.argmax(1)
        jump = now[rows, top] - cost
        stay = now >= jump[:, None]
        back[t] = np.where(stay, np.arange(k), top[:, None])
        now = np.where(stay, now, jump[:, None]) + scores[:, t]
        done = lengths == t + 1
        ends[done] = now[done]
    path = np.zeros((n, most), np.int8)
    at = ends.argmax(1)
    for t in range(most - 1, -1, -1):
        live = lengths > t
        path[live, t] = at[live]
        at = np.where(live, back[t][rows, at], at)
    return path


def parts(texts: list[str], model: Profiles) -> list[list[tuple[int, int, int, float]]]:
    """Per text: (language, first word, words, confidence) of each part."""
    cut = [tokens(t) if t else ([], []) for t in texts]
    model.forget()
    ids = [model.word_ids(w) for w, _ in cut]
    table = np.array(model.rows, np.float32).reshape(-1, len(LANGUAGES) + 1)
    out: list[list] = [[] for _ in texts]
    order = sorted((i for i, x in enumerate(ids) if x), key=lambda i: len(ids[i]))
    at = 0
    while at < len(order):
        most = max(len(ids[order[at]]) * 5 // 4, 8)
        group = [i for i in order[at : at + max(1, min(4096, 2_000_000 // most))] if len(ids[i]) <= most]
        at += len(group)
        lengths = np.array([len(ids[i]) for i in group])
        width = int(lengths.max())
        index = np.zeros((len(group), width), np.int64)
        stops = np.zeros((len(group), width), bool)
        for r, i in enumerate(group):
            index[r, : lengths[r]] = ids[i]
            stops[r, : lengths[r]] = cut[i][1]
        gathered = table[index]
        path = best_paths(gathered[:, :, :-1], stops, lengths)
        live = np.arange(width) < lengths[:, None]
        begins = live & np.concatenate([np.ones((len(group), 1), bool), path[:, 1:] != path[:, :-1]], 1)
        r, c = np.nonzero(begins)
        flat = np.where(live[:, :, None], gathered, 0).reshape(-1, len(LANGUAGES) + 1)
        sums = np.add.reduceat(flat, r * width + c, axis=0) if len(r) else flat[:0]
        sizes = np.diff(np.append(np.nonzero(begins[live])[0], live.sum()))
        lang = path[r, c]
        # The cosine, by the length that a bundle of so many unlike n-grams has.
        cosine = sums[np.arange(len(r)), lang] / np.maximum(np.sqrt(sums[:, -1]) * model.norms.mean(), 1e-9)
        for row, col, one, size, conf in zip(r.tolist(), c.tolist(), lang.tolist(), sizes.tolist(), cosine.tolist()):
            out[group[row]].append((one, col, size, float(min(max(conf, 0.0), 1.0))))
    return out


def train(samples: list[tuple[str | None, str]], rounds: int = ROUNDS) -> Profiles:
    """Profiles from (language or none, text); see the module's text."""
    counts: dict[str, np.ndarray] = {}

    def add(words: list[str], lang: int, n: float = 1.0) -> None:
        for w in words:
            for g in _ngrams(w):
                if g not in counts:
                    counts[g] = np.zeros(len(LANGUAGES))
                counts[g][lang] += n

    def seeds() -> None:
        for lang, said in SEEDS.items():
            add(tokens(said)[0], LANGUAGES.index(lang), 5.0)

    seeds()
    for lang, text in samples:
        if lang in LANGUAGES:
            add(tokens(text)[0], LANGUAGES.index(lang))
    model = Profiles(counts)
    for _ in range(rounds):
        counts = {}
        seeds()
        texts = [t for _, t in samples]
        for text, found in zip(texts, parts(texts, model)):
            words = tokens(text)[0]
            for lang, first, size, _ in found:
                if size >= LEAST_WORDS:
                    add(words[first : first + size], lang)
        model = Profiles(counts)
    return model


def texts_of(posts: DataFrame) -> DataFrame:
    """(post_key, pos, label, text): captions at 0, comments at their position."""
    caption = F.array(F.struct(F.lit(0).alias("pos"), F.col("caption").alias("text")))
    comments = F.transform(F.coalesce("comment_texts", F.expr("array()")), lambda c: F.struct(c["position"].alias("pos"), c["text"].alias("text")))
    rows = posts.select("post_key", F.col("language_detected").alias("label"), F.explode(F.concat(caption, comments)).alias("t"))
    return rows.select("post_key", "label", F.col("t.pos").alias("pos"), F.col("t.text").alias("text")).where(F.col("pos").isNotNull() & F.col("text").isNotNull())


def fit(posts: DataFrame, rows: int = SAMPLE_ROWS) -> Profiles:
    """Profiles trained on at most ``rows`` labelled posts, picked by a hash of their key."""
    labelled = posts.where(label_language(F.col("language_detected")).isNotNull()).select("post_key", "caption", "comment_texts", "language_detected")
    sample = sampled(labelled, "post_key", rows)
    got = texts_of(sample).select(label_language(F.col("label")).alias("lang"), "text").collect()
    return train(sorted((r.lang, r.text) for r in got if r.text))


def segments(posts: DataFrame, model: Profiles | None = None) -> DataFrame:
    """(post_key, pos, label, lang, words, confidence) for each part of each text."""
    model = model or fit(posts)
    model.seen, model.rows = {}, []
    shared = posts.sparkSession.sparkContext.broadcast((model.table, model.norms))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Profiles.__new__(Profiles)
        own.table, own.norms = shared.value
        own.seen, own.rows = {}, []
        for b in frames(batches, "text"):
            found = parts(b["text"].tolist(), own)
            n = [len(x) for x in found]
            flat = [y for x in found for y in x]
            yield pd.DataFrame({
                "post_key": np.repeat(b["post_key"].to_numpy(), n), "pos": np.repeat(b["pos"].to_numpy(), n).astype("int32"),
                "label": np.repeat(b["label"].to_numpy(), n), "lang": np.array([LANGUAGES[y[0]] for y in flat], object),
                "words": np.array([y[2] for y in flat], "int32"), "confidence": np.array([y[3] for y in flat], float),
            })

    return texts_of(posts).mapInPandas(run, "post_key bigint, pos int, label string, lang string, words int, confidence double")


def p1_found(posts: DataFrame, model: Profiles | None = None) -> DataFrame:
    """(post_key, pos, lang): languages of whole sentences or clauses that the label does not name."""
    named = label_language(F.col("label"))
    rows = segments(posts, model).where((F.col("words") >= LEAST_WORDS) & (F.col("confidence") >= LEAST_COSINE) & (named.isNull() | (F.col("lang") != named)))
    return rows.select("post_key", "pos", "lang").distinct()
