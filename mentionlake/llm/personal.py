"""Personal data in free text (problem 4), by a skip-chain conditional random field.

A text becomes tokens: words, initials, e-mail addresses (also spelled out), numbers with
their separators as one token, and marks.  A linear chain over the labels none, e-mail,
phone, id number, address and name scores words, kinds and number shapes up to three
tokens away; words that recur in a text, in any letter case, with other accents or as a
possessive, are joined by skip edges, whose potential favours equal labels.  Marginals come from loopy message passing: each round runs the chain
forwards and backwards with the messages of the skip edges, then sends new ones.

No text comes labelled, so the model is trained here on a bounded sample
(``SAMPLE_ROWS`` posts, picked by a hash of their key), labelled by cues and shapes that
are sure where they apply (``cues``); the field carries that over to other contexts, since
it knows each token by several of its features.  An exact check follows: an address needs
a house, plot or box number, a name a family name.

Texts in which no token comes near a label (by its own score) are settled without message
passing.  Defined cases: null and blank texts hold nothing; a text of any length is taken
whole; repeated rows are judged alike; other columns are not read.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionlake.llm.batches import frames
from mentionlake.llm.folding import INVISIBLE, LOOKALIKES, SPACES
from mentionlake.llm.languages import texts_of
from mentionlake.session import sampled

LABELS = ("none", "email", "phone", "id_number", "address", "name")
NONE, EMAIL, PHONE, ID, ADDRESS, NAME = range(6)
SAMPLE_ROWS, EPOCHS, ROUNDS, REACH = 3000, 25, 3, 3
#: A text goes to message passing, as a whole, if some label is within this score of "none" at a token.
NEAR = 5.0
#: Beliefs in other labels than "none" that are not passed on along a skip edge.
QUIET = 1e-4

# Words that introduce or follow what they name, in the coarse form of a word.
NAME_BEFORE = ("my name is", "jina langu ni", "naitwa", "ich heisse", "ich heiße", "je m'appelle", "regards ,", "ask for", "uliza", "muulizie", "demandez", "fragt nach", "thanks to", "asante sana", "merci a", "merci à", "danke an", "huyo", "nilihudumiwa na")
NAME_AFTER = ("helped my", "alinisort poa", "at the front", "by the way", "kwa msaada wako", "pour son aide", "fur die hilfe", "für die hilfe", "hapo base")
TITLES = set("mr mrs ms dr mme mlle herr frau bwana bi bro mama mzee mwalimu prof professor sir madam monsieur madame".split())
ID_WORDS = set("id pin passport passeport pasipoti reisepass kitambulisho kipande ausweisnummer identité identite d'identité d'identite ausweis".split())
OTHER_NUMBERS = set("order ref agizo bestellung commande views watazamaji part serial seriennummer série serie price preis prix bei code".split())
BOX_WORDS = set("p.o. box s.l.p s.l.p. b.p. postfach plot house nyumba".split())
STREETS = set("road lane avenue close street drive rue barabara mtaa".split())

_FOLD = {ord(a): b for a, b in LOOKALIKES.items()} | {ord(c): None for c in INVISIBLE if c != "‍"} | {ord(c): " " for c in SPACES} | {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {c: None for c in range(0x300, 0x370)}
_WORD = r"[^\W\d_]{2,}(?:['’-][^\W\d_]+)*(?!\w)"
_REST = (
    r"[#@][\w.]+|https?://\S+|\*\d+#"
    r"|(?<!\w)(?:[A-Za-z]{1,3}-?(?=\d))?[+(]*\d+(?:(?:[ ./-]|,(?=\d{3}(?!\d))|\)[ -]?| \()\d+)*(?:-?[A-Za-z](?!\w))?(?!\w)"
    r"|(?:[A-Za-z]\.){2,}[A-Za-z]?\.?|(?<!\w)[A-ZÀ-Þ]\.|[^\W\d_]+(?:['’-][^\W\d_]+)*|[.,:;!?/\n-]"
)
_MAIL = (
    r"(?:<?mailto:)?[\w.+-]+(?:\s?[\[(]dot[\])]\s?[\w.+-]+)*\s?(?:@|\[at\]|\(at\))\s?[\w-]+(?:(?:\.|\s?(?:\[dot\]|\(dot\))\s?)[\w-]+)+>?"
    r"|[\w.+-]+(?: (?:dot|punkt|point|nukta) [\w.+-]+)* at [\w-]+(?: dot [\w-]+)+"
)
#: Without and with addresses of e-mail; a text that has no sign of one needs no look for them.
_PLAIN = re.compile(f"{_WORD}|{_REST}")
_MAILED = re.compile(f"{_MAIL}|{_WORD}|{_REST}", re.IGNORECASE)
_SIGN = re.compile(r"@\w|\s@\s|[\[(]at[\])]| at \w+ dot ", re.IGNORECASE)
_IS_MAIL = re.compile(f"(?:{_MAIL})", re.IGNORECASE)


_NEEDS_FOLD = re.compile("[" + "".join(map(re.escape, map(chr, sorted(_FOLD)))) + "]")


def fold(text: str) -> str:
    """Full-width forms, look-alikes, spaces and unseen signs set right, for reading only."""
    return text.translate(_FOLD) if not text.isascii() and _NEEDS_FOLD.search(text) else text


def places(text: str) -> range | list[int]:
    """For each character of the folded text, and its end, where it stands in the text itself."""
    if fold(text) == text:
        return range(len(text) + 1)
    return [*(i for i, c in enumerate(text) if _FOLD.get(ord(c), c) is not None), len(text)]


def _pattern(text: str) -> re.Pattern:
    return _MAILED if _SIGN.search(text) else _PLAIN


@functools.lru_cache(maxsize=200_000)
def classify(said: str) -> tuple[str, str]:
    """(word key, kind) of a token."""
    c = said[0]
    if c in ".,:;!?/\n-" and len(said) == 1:
        return said, "mark"
    if len(said) > 5 and _IS_MAIL.fullmatch(said):
        return "email", "email"
    if c in "#@*" or said.startswith("http"):
        return "tag", "tag"
    if any(x.isdigit() for x in said):
        key = shape(said)
        return key, number_kind(key)
    if "." in said:
        return said.lower(), "initial"
    return said.lower(), "upper" if len(said) > 1 and said.isupper() else "capital" if c.isupper() else "lower"


def shape(number: str) -> str:
    """A number's shape: how it begins, the lengths of its groups and what parts them."""
    begin = re.match(r"[+(]*(?:00|0|254|202|9\d\d-|1 \(|)", number).group()
    return begin + "~" + re.sub(r"[A-Za-z]+", "A", re.sub(r"\d+", lambda m: str(min(len(m.group()), 12)), number))


def _is_phone(s: str) -> bool:
    begin, _, groups = s.partition("~")
    digits = sum(map(int, re.findall(r"\d+", groups)))
    return 9 <= digits <= 14 and "A" not in groups and "," not in groups and (begin.startswith(("+", "(", "0", "254")) or groups == "3.3.4" or (groups == "3-3-4"))


def _is_id(s: str) -> bool:
    return s.partition("~")[2] in ("A7", "A9A", "2-6-A", "3-2-4", "2 3 3", "8")


def number_kind(s: str) -> str:
    """What a number of this shape could be, before any context."""
    if _is_phone(s):
        return "like_phone"
    if _is_id(s):
        return "eight" if s.endswith("~8") else "like_id"
    return "house" if re.match(r"^[^~]*~(?:\d|[1-6]-?A|\d-\d)$", s) and int(s.partition("~")[2][0]) <= 6 else "number"


class Tokens:
    """Tokens of one text: word keys, kinds, and where each stands."""

    __slots__ = ("keys", "kinds", "spans")

    def __init__(self, text: str):
        folded = fold(text)
        self.keys, self.kinds, self.spans = [], [], []
        for m in _pattern(folded).finditer(folded):
            key, kind = classify(m.group())
            self.keys.append(key)
            self.kinds.append(kind)
            self.spans.append(m.span())


KINDS = ("edge", "email", "tag", "number", "like_phone", "like_id", "eight", "house", "initial", "lower", "capital", "upper", "mark", "known", "known_lower")
#: Kinds of tokens that skip edges join.
LINKED = ("lower", "capital", "upper", "email")
NUMBERS = ("number", "like_phone", "like_id", "eight", "house")
_KIND = {k: i for i, k in enumerate(KINDS)}


def _by_first(cues: tuple[str, ...]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for c in cues:
        out.setdefault(c.split()[0], []).append(c)
    return out


_BEFORE, _AFTER = _by_first(NAME_BEFORE), _by_first(NAME_AFTER)


def cues(t: Tokens) -> np.ndarray:
    """Labels of the tokens of a text, by cues and shapes that are sure where they apply."""
    n, keys, kinds = len(t.keys), t.keys, t.kinds
    y = np.zeros(n, np.int64)
    joined = [" ".join(keys[i : i + 3]) for i in range(n)]
    for i in range(n):
        if kinds[i] == "email":
            y[i] = EMAIL
        elif kinds[i] in NUMBERS:
            before = set(keys[max(0, i - 5) : i])
            near = set(keys[max(0, i - 3) : i]) | set(keys[i + 1 : i + 2])
            if _is_phone(keys[i]):
                y[i] = PHONE
            elif _is_id(keys[i]) and not near & OTHER_NUMBERS and (before & ID_WORDS or not keys[i].endswith("~8") or n <= 2):
                y[i] = ID
    words = ("capital", "upper")
    for i in range(n):  # addresses
        if kinds[i] != "house" or y[i] != NONE:
            continue
        a = b = i
        before = keys[max(0, i - 3) : i]
        if set(before) & BOX_WORDS:
            while a > 0 and a > i - 4 and (keys[a - 1] in BOX_WORDS | {"no", "no.", "namba", "."}):
                a -= 1
        elif i > 0 and re.search(r"(?:straße|strasse|weg|platz)$", keys[i - 1]):
            a = i - 1
        elif i > 0 and keys[i - 1] in STREETS:
            a = i - 1
            while a > 0 and kinds[a - 1] in words and a > i - 4:
                a -= 1
        elif not set(keys[i + 1 : i + 6]) & STREETS:
            continue
        j = i + 1
        while j < n and j <= i + 9 and (kinds[j] in words or keys[j] in STREETS | {"bis", "ya", "wa", "no", "avenue", "b"} or (keys[j] == "," and j + 1 < n and (kinds[j + 1] in words or keys[j + 1] in STREETS))):
            j += 1
        b = j - 1 if keys[j - 1] == "," else j
        if a == i and b <= i + 1:
            continue
        y[a:b] = np.where(y[a:b] == NONE, ADDRESS, y[a:b])
    for i in range(n):  # names
        start = None
        for cue in _BEFORE.get(keys[i], ()):
            m = cue.count(" ") + 1
            if joined[i].startswith(cue) and (i + m >= n or joined[i] == cue or keys[i : i + m] == cue.split()):
                start = i + m
        after = i + 1 if i + 1 < n and keys[i + 1] != "." else i + 2
        if start is None and keys[i] in TITLES and after < n and kinds[after] in words:
            start = i
        if start is None:
            continue
        j = start
        while j < n and j < start + 4 and (kinds[j] in (*words, "initial") or keys[j] in TITLES or (keys[j] == "." and j > start and keys[j - 1] in TITLES)):
            j += 1
        if j - start >= 2:
            y[start:j] = np.where(y[start:j] == NONE, NAME, y[start:j])
    for i in range(n - 1):
        if i >= 2 and any(joined[i].startswith(c) for c in _AFTER.get(keys[i], ())):
            a = i
            while a > 0 and a > i - 4 and kinds[a - 1] in (*words, "initial"):
                a -= 1
            if i - a >= 2 and kinds[i - 1] in words:
                y[a:i] = np.where(y[a:i] == NONE, NAME, y[a:i])
    return y


_NAMELIKE = [_KIND[x] for x in ("capital", "upper", "known", "known_lower")]


class Field:
    """The field: emission tables by offset, transitions and the potential of skip edges."""

    def __init__(self, words: dict[str, int], known: set[str] = frozenset()):
        """known: words that sure cues have named as parts of names, often enough."""
        k = len(LABELS)
        self.words, self.known = words, known
        self.w = np.zeros((2 * REACH + 1, len(words) + 2, k), np.float32)  # row 0 is an edge, 1 a rare word
        self.k = np.zeros((2 * REACH + 1, len(KINDS), k), np.float32)
        self.move = np.zeros((k, k), np.float32)
        self.skip = np.zeros(k, np.float32)

    def ids(self, t: Tokens) -> tuple[list[int], list[int]]:
        both = [self.ids_of(x, kind) for x, kind in zip(t.keys, t.kinds)]
        return [a for a, _ in both], [b for _, b in both]

    def ids_of(self, key: str, kind: str) -> tuple[int, int]:
        known = self.known
        if kind in ("lower", "capital", "upper") and (key in known or ("-" in key and all(part in known for part in key.split("-")))):
            kind = "known_lower" if kind == "lower" else "known"
        return self.words.get(key, 1), _KIND[kind]

    def emissions(self, ids: list[list[int]], kinds: list[list[int]], rng: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Scores of all tokens of many texts laid end to end, with edges between them."""
        pad = [0] * REACH
        flat_w, flat_k, at = list(pad), list(pad), []
        for a, b in zip(ids, kinds):
            at.append(len(flat_w))
            flat_w += a
            flat_w += pad
            flat_k += b
            flat_k += pad
        fw, fk = np.array(flat_w, np.int64), np.array(flat_k, np.int64)
        if rng is not None:  # in training, capitalised words are at times as good as unseen
            fw = np.where(np.isin(fk, _NAMELIKE) & (rng.random(len(fw)) < 0.5), 1, fw)
        n = len(fw)
        out = np.zeros((n, len(LABELS)), np.float32)
        inner = np.arange(REACH, n - REACH)
        for o in range(-REACH, REACH + 1):
            out[inner] += self.w[o + REACH][fw[inner + o]] + self.k[o + REACH][fk[inner + o]]
        return out, np.array(at, np.int64), (fw, fk)

    def chain(self, e: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(forward, backward, log partition, emissions) of padded texts: e is (texts, tokens, labels).

        Forward and backward messages are probabilities, brought to sum 1 at each token, so a
        step is one product with the transitions; emissions are relative to the best label.
        """
        n, most, k = e.shape
        top = e.max(2)
        em = np.ascontiguousarray(np.exp(e - top[:, :, None]).transpose(1, 0, 2))
        move = np.exp(self.move)
        fwd, bwd, sums = np.empty_like(em), np.empty_like(em), np.ones((most, n), np.float32)
        short = int(lengths.min()) if n else 0
        now = em[0]
        for t in range(most):
            if t:
                now = (fwd[t - 1] @ move) * em[t]
            total = now.sum(1)
            now = now / total[:, None]
            if t >= short:
                live = t < lengths
                now, total = np.where(live[:, None], now, fwd[t - 1]), np.where(live, total, 1)
            fwd[t], sums[t] = now, total
        back = move.T.copy()
        bwd[most - 1] = 1 / k
        for t in range(most - 2, -1, -1):
            now = (bwd[t + 1] * em[t + 1]) @ back
            now /= now.sum(1)[:, None]
            bwd[t] = now if t + 1 < short else np.where((t + 1 < lengths)[:, None], now, 1 / k)
        z = np.log(sums).sum(0) + np.where(np.arange(most) < lengths[:, None], top, 0).sum(1)
        return fwd.transpose(1, 0, 2), bwd.transpose(1, 0, 2), z, em.transpose(1, 0, 2)

    def _beliefs(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        fwd, bwd, _, _ = self.chain(e, lengths)
        p = fwd * bwd
        return p / p.sum(2, keepdims=True)

    def marginals(self, e: np.ndarray, lengths: np.ndarray, links: np.ndarray) -> np.ndarray:
        """Loopy marginals; links: (text, token, token) of the skip edges.

        An edge whose ends both are ``none`` but for ``QUIET`` sends nothing that counts (its
        message is under QUIET x exp(skip)), so later rounds take only the texts with another.
        """
        p = self._beliefs(e, lengths)
        if len(links):
            ends = np.maximum(1 - p[links[:, 0], links[:, 1], NONE], 1 - p[links[:, 0], links[:, 2], NONE])
            links = links[ends > QUIET]
        if not len(links):
            return p
        texts, at = np.unique(links[:, 0], return_inverse=True)
        width = int(lengths[texts].max())
        e0, sizes = e[texts, :width], lengths[texts]
        into = np.zeros((len(links), 2, e.shape[2]), np.float32)
        gain, q = np.expm1(self.skip), p[texts, :width]
        for _ in range(ROUNDS - 1):
            new = into.copy()
            for side in (0, 1):  # the message to one end: the other's belief without what came from here
                b = q[at, links[:, 2 - side]] * np.exp(-into[:, 1 - side])
                new[:, side] = np.log1p(b / b.sum(1, keepdims=True) * gain)
            into = 0.5 * into + 0.5 * new
            now = e0.copy()
            for side in (0, 1):
                np.add.at(now, (at, links[:, 1 + side]), into[:, side])
            q = self._beliefs(now, sizes)
        p[texts, :width] = q
        return p


@functools.lru_cache(maxsize=200_000)
def alike(key: str) -> str:
    """What similar words have in common: no accents, no possessive ending."""
    if not key.isascii():
        key = "".join(c for c in unicodedata.normalize("NFD", key) if not unicodedata.combining(c))
    return re.sub(r"['’]s?$", "", key)


def skip_links(texts: list[Tokens]) -> np.ndarray:
    """(text, token, token): each word to the next one alike."""
    out = []
    for i, t in enumerate(texts):
        last: dict[str, int] = {}
        for j, (key, kind) in enumerate(zip(t.keys, t.kinds)):
            if kind in LINKED and len(key := alike(key)) > 3:
                if key in last:
                    out.append((i, last[key], j))
                last[key] = j
    return np.array(out, np.int64).reshape(-1, 3)


def _batches(lengths: list[int], most: int = 60_000) -> Iterator[list[int]]:
    order = sorted((i for i, n in enumerate(lengths) if n), key=lambda i: lengths[i])
    at = 0
    while at < len(order):
        n, group = 1, []
        while at < len(order) and (not group or (len(group) + 1) * lengths[order[at]] <= most):
            group.append(order[at])
            at += 1
        yield group


def train(texts: list[str], epochs: int = EPOCHS, rate: float = 0.3, l2: float = 2e-3) -> Field:
    toks = [t for x in texts if (t := Tokens(x)).keys]
    gold = [cues(t) for t in toks]
    count: dict[str, int] = {}
    for t in toks:
        for x in t.keys:
            count[x] = count.get(x, 0) + 1
    named: dict[str, int] = {}
    for t, y in zip(toks, gold):
        for x, kind, label in zip(t.keys, t.kinds, y.tolist()):
            if label == NAME and kind in ("capital", "upper") and x not in TITLES and len(x) > 2:
                named[x] = named.get(x, 0) + 1
    known = {x for x, n in named.items() if n >= 2 and 3 * n >= count[x]}
    for t, y in zip(toks, gold):  # two known words side by side are a name in any letter case
        n = len(t.keys)
        for i in range(n - 1):
            j = i + 2 if t.kinds[i + 1] == "initial" and i + 2 < n else i + 1
            if t.keys[i] in known and (t.keys[j] in known or ("-" in t.keys[j] and all(x in known for x in t.keys[j].split("-")))):
                y[i : j + 1] = np.where(y[i : j + 1] == NONE, NAME, y[i : j + 1])
    field = Field({x: i + 2 for i, x in enumerate(sorted(x for x, n in count.items() if n >= 2))}, known)
    k = len(LABELS)
    sums = [np.full_like(a, 1e-6) for a in (field.w, field.k, field.move)]
    rng = np.random.default_rng(3)
    groups = list(_batches([len(t.keys) for t in toks], 6000))
    coded = [field.ids(t) for t in toks]
    plain = [[_KIND[x] for x in t.kinds] for t in toks]
    for _ in range(epochs):
        for g in rng.permutation(len(groups)):
            group = groups[g]
            # Half of the time a text goes without the knowledge of names, so that contexts are learned too.
            hide = rng.random(len(group)) < 0.6
            score, at, (fw, fk) = field.emissions([coded[i][0] for i in group], [plain[i] if x else coded[i][1] for i, x in zip(group, hide)], rng)
            lengths = np.array([len(toks[i].keys) for i in group])
            width = int(lengths.max())
            index = at[:, None] + np.minimum(np.arange(width), lengths[:, None] - 1)
            live = np.arange(width) < lengths[:, None]
            e = np.where(live[:, :, None], score[index], 0)
            y = np.zeros((len(group), width), np.int64)
            for r, i in enumerate(group):
                y[r, : lengths[r]] = gold[i]
            fwd, bwd, _, em = field.chain(e, lengths)
            p = fwd * bwd
            p = p / p.sum(2, keepdims=True)
            diff = np.zeros_like(score)
            d = (np.eye(k, dtype=np.float32)[y] - p) * live[:, :, None]
            diff[index[live]] = d[live]
            if width > 1:
                both, move = live[:, 1:], np.exp(field.move)
                left, right = fwd[:, :-1][both], (em[:, 1:] * bwd[:, 1:])[both]
                left = left / ((left @ move) * right).sum(1, keepdims=True)
                expect = move * (left.T @ right)
                seen = np.zeros((k, k))
                np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
                grads_move = seen - expect
            else:
                grads_move = np.zeros((k, k))
            inner = np.arange(REACH, len(fw) - REACH)
            gw, gk = np.zeros_like(field.w), np.zeros_like(field.k)
            hot = inner[np.abs(diff[inner]).max(1) > 1e-4]
            put = diff[hot].astype(np.float64)
            for o in range(-REACH, REACH + 1):
                gw[o + REACH] = np.bincount((fw[hot + o][:, None] * k + np.arange(k)).ravel(), put.ravel(), gw.shape[1] * k).reshape(-1, k)
                gk[o + REACH] = np.bincount((fk[hot + o][:, None] * k + np.arange(k)).ravel(), put.ravel(), gk.shape[1] * k).reshape(-1, k)
            for a, grad, s in ((field.w, gw, sums[0]), (field.k, gk, sums[1]), (field.move, grads_move.astype(np.float32), sums[2])):
                grad = grad - l2 * a
                s += grad * grad
                a += rate * grad / np.sqrt(s)
    # The potential of a skip edge: how much more often its ends agree on a label than chance has it.
    links = skip_links(toks)
    total = np.bincount(np.concatenate(gold) if gold else np.zeros(0, np.int64), minlength=k) + 1.0
    ends = [(gold[i][a], gold[i][b]) for i, a, b in links]
    for label in range(1, k):
        one = sum(a == label or b == label for a, b in ends)
        both = sum(a == label and b == label for a, b in ends)
        rate_of = (both + 0.5) / (one + 1.0)
        field.skip[label] = float(np.clip(np.log(max(rate_of, 1e-3) / (total[label] / total.sum())), 0.0, 2.0))
    return field


class Reader:
    """Scores texts by a field: each distinct token is classified once, then only looked up."""

    def __init__(self, field: Field, most: int = 300_000, near: float | None = NEAR):
        """near: the gate of message passing; None takes every text to it."""
        self.field, self.most, self.near = field, most, near
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.word, self.kind, self.same = [0], [0], [-1]  # row 0 is an edge
        self.likes: dict[str, int] = {}

    def rows(self, tokens: list[str]) -> list[int]:
        seen, out = self.seen, []
        for x in tokens:
            i = seen.get(x)
            if i is None:
                i = seen[x] = len(self.word)
                key, kind = classify(x)
                word, k = self.field.ids_of(key, kind)
                self.word.append(word)
                self.kind.append(k)
                like = alike(key) if kind in LINKED else ""
                self.same.append(self.likes.setdefault(like, len(self.likes)) if len(like) > 3 else -1)
            out.append(i)
        return out

    @staticmethod
    def links(same: np.ndarray) -> np.ndarray:
        """Skip edges (text, token, token) from what each token is alike to (-1: nothing)."""
        text, at = np.nonzero(same >= 0)
        like = same[text, at]
        order = np.lexsort((at, like, text))
        text, at, like = text[order], at[order], like[order]
        next_ = (text[1:] == text[:-1]) & (like[1:] == like[:-1])
        return np.stack([text[:-1][next_], at[:-1][next_], at[1:][next_]], 1)

    def tag(self, texts: list[str | None]) -> list[tuple[Tokens, np.ndarray] | None]:
        """Per text: its tokens and their labels, or None where nothing comes near a label."""
        field, out = self.field, [None] * len(texts)
        if len(self.word) > self.most:
            self.forget()
        live, at, flat = [], [], [0] * REACH
        for i, text in enumerate(texts):
            if text:
                folded = fold(text)
                tokens = _pattern(folded).findall(folded)
                if tokens:
                    live.append(i)
                    at.append((len(flat), len(flat) + len(tokens)))
                    flat += self.rows(tokens)
                    flat += [0] * REACH
        if not live:
            return out
        row, words, kinds = np.array(flat, np.int64), np.array(self.word, np.int64), np.array(self.kind, np.int64)
        same = np.array(self.same, np.int64)[row]
        used, row = np.unique(row, return_inverse=True)
        n = len(row)
        score = np.zeros((n - 2 * REACH, len(LABELS)), np.float32)
        for o in range(2 * REACH + 1):
            score += (field.w[o][words[used]] + field.k[o][kinds[used]])[row[o : n - 2 * REACH + o]]
        near = score[:, 1:].max(1) - score[:, 0] > -(np.inf if self.near is None else self.near)
        before = np.concatenate(([0], np.cumsum(near)))
        jobs = []
        for i, (a, b) in zip(live, at):
            a, b = a - REACH, b - REACH
            if before[b] > before[a]:
                jobs.append((i, a, b - a))
        for group in _batches([n for *_, n in jobs]):
            lengths = np.array([jobs[g][2] for g in group])
            width = int(lengths.max())
            begin = np.array([jobs[g][1] for g in group])
            index = begin[:, None] + np.minimum(np.arange(width), lengths[:, None] - 1)
            live = np.arange(width) < lengths[:, None]
            e = np.where(live[:, :, None], score[index], 0)
            p = field.marginals(e, lengths, self.links(np.where(live, same[index + REACH], -1)))
            best = np.where(live, p.argmax(2), NONE)
            for r in np.flatnonzero(best.any(1)):
                i = jobs[group[r]][0]
                out[i] = (Tokens(texts[i]), best[r, : lengths[r]])
        return out


def tag(texts: list[str | None], field: Field, near: float | None = NEAR) -> list[tuple[Tokens, np.ndarray] | None]:
    return Reader(field, near=near).tag(texts)


def entities(tokens: Tokens, labels: np.ndarray) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of the entities, after the exact check of each."""
    out = []
    n, i = len(labels), 0
    while i < n:
        label = int(labels[i])
        if label == NONE:
            i += 1
            continue
        j = i
        while j + 1 < n and (labels[j + 1] == label or (label in (NAME, ADDRESS) and j + 2 < n and labels[j + 2] == label and tokens.kinds[j + 1] in ("mark", "initial") and tokens.keys[j + 1] in (".", ",", "-"))):
            j += 1
        kinds, keys = tokens.kinds[i : j + 1], tokens.keys[i : j + 1]
        if label == ADDRESS:
            good = any(x in NUMBERS for x in kinds) and len(keys) > 1
        elif label == NAME:
            named = [k for x, k in zip(kinds, keys) if x in ("capital", "upper", "lower") and k not in TITLES and len(k) > 1]
            good = len(named) >= 2 or (bool(named) and any(k in TITLES for k in keys))
        elif label == EMAIL:
            good = "email" in kinds
        else:
            good = any(x in NUMBERS for x in kinds)
        if good:
            out.append((tokens.spans[i][0], tokens.spans[j][1], LABELS[label]))
        i = j + 1
    return out


def fit(posts: DataFrame, rows: int = SAMPLE_ROWS) -> Field:
    """A field trained on the texts of at most ``rows`` posts, picked by a hash of their key."""
    sample = sampled(posts.select("post_key", "caption", "comment_texts", "language_detected"), "post_key", rows)
    got = sorted(r.text for r in texts_of(sample).select("text").collect() if r.text)
    marked = [t for t in got if re.search(r"\d{3}|@| at |[Nn]a[mi]|Mr|Dr|[Rr]egards|[Aa]sk|[Uu]liz|emand|ragt|[Tt]hank|sante|erci|Danke|[Hh]uyo", t)]
    rest = [t for t in got if t not in set(marked)]
    return train(marked + rest[: len(marked) // 2])


def personal(posts: DataFrame, field: Field | None = None, near: float | None = NEAR) -> DataFrame:
    """(post_key, pos, text with typed placeholders, kinds found) of each text that holds any.

    Entities are found in the folded text and replaced in the text itself, so all else stays
    as it was written, letters of other scripts and separate accents included."""
    field = field or fit(posts)
    shared = posts.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(shared.value, near=near)
        for b in frames(batches, "text"):
            keys, positions, clean, kinds = [], [], [], []
            for key, pos, text, got in zip(b["post_key"], b["pos"], b["text"], reader.tag(b["text"].tolist())):
                found = entities(*got) if got else []
                if not found:
                    continue
                at, parts, last = places(text), [], 0
                for x, y, kind in found:
                    parts += [text[last : at[x]], f"[{kind.upper()}]"]
                    last = at[y]
                keys.append(key)
                positions.append(pos)
                clean.append("".join([*parts, text[last:]]))
                kinds.append(sorted({k for _, _, k in found}))
            yield pd.DataFrame({"post_key": np.array(keys, "int64"), "pos": np.array(positions, "int32"), "text": np.array(clean, object), "kinds": pd.Series(kinds, dtype=object)})

    return texts_of(posts).select("post_key", "pos", "text").mapInPandas(run, "post_key bigint, pos int, text string, kinds array<string>")


def p4_found(posts: DataFrame, field: Field | None = None) -> DataFrame:
    """(post_key, pos, kind): one row for each text and kind of personal data in it."""
    return personal(posts, field).select("post_key", "pos", F.explode("kinds").alias("kind")).distinct()
