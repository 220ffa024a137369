"""One form for text that looks the same (problem 7), and tables that other operators share.

``fold_batch`` copies an Arrow string column to a numpy array of code points and works on
all rows at once: lookup-table gathers give classes and replacements, expansion offsets
place replacements of several code points, and marks are composed with their bases by a
search in a sorted table of pairs.  No string of a single row is touched.

Defined cases: null stays null and an empty text empty; a text of any length is one run of
the same arrays.  Line breaks and tabs are no spaces to fold.  Joiners and selectors
inside emoji stay, as do joiners between letters of other scripts; words wholly in another
script keep their letters.  ``fold_columns`` replaces the named columns and leaves others.
"""

from __future__ import annotations

import functools
import sys
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionlake.llm.batches import arrow

# Letters of other scripts that look like Latin ones (left), and those (right).
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i",
    "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v", "к": "k", "т": "t", "м": "m", "н": "h", "в": "b",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "τ": "t", "ϲ": "c", "ϳ": "j",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "ѡ": "w", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "γ": "y", "ω": "w", "ε": "e",
}
# Code points that are not seen, and spaces other than U+0020.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff\uffa0"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

LATIN, OTHER, MARK, UNSEEN, SPACE, WIDE, EMOJI, INNER, DIGIT = 1, 2, 4, 8, 16, 32, 64, 128, 256
_TOP = sys.maxunicode + 1


@functools.lru_cache(maxsize=1)
def tables() -> dict[str, np.ndarray]:
    """Lookup tables over all code points, made by rule from the Unicode database."""
    kind = np.zeros(_TOP, np.uint16)
    to = np.arange(_TOP, dtype=np.uint32)
    like = np.zeros(_TOP, np.uint32)
    pairs, longer = [], {}
    for c in range(_TOP):
        if 0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xD7A4 or 0xD800 <= c < 0xF900 or c >= 0x1FB00:
            if c < 0xD800 or 0xE000 <= c:
                kind[c] = OTHER if c < 0xD7A4 or 0x20000 <= c < 0x33000 else 0
            continue
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat == "Cn":
            continue
        if cat[0] == "L":
            name = unicodedata.name(ch, "")
            kind[c] |= LATIN if name.startswith(("LATIN", "FULLWIDTH LATIN", "FEMININE ORD", "MASCULINE ORD")) else OTHER
        elif cat[0] == "M":
            kind[c] |= INNER
            if 0x300 <= c <= 0x36F and c != 0x34F or 0x1AB0 <= c <= 0x1AFF or 0x1DC0 <= c <= 0x1DFF or 0x20D0 <= c <= 0x20DC or 0xFE20 <= c <= 0xFE2F:
                kind[c] |= MARK
        elif cat == "Nd":
            kind[c] |= DIGIT
        elif ch in "_":
            kind[c] |= INNER
        elif cat in ("So", "Sk") and (c >= 0x1F000 or 0x2190 <= c <= 0x2BFF or c in (0xA9, 0xAE, 0x3030, 0x303D)):
            kind[c] |= EMOJI
        parts = unicodedata.decomposition(ch).split()
        if parts and parts[0] in ("<wide>", "<narrow>"):
            plain = unicodedata.normalize("NFKC", ch)
            if len(plain) == 1 and ord(plain) != 0x20:
                kind[c] |= WIDE
                to[c] = ord(plain)
        elif parts and parts[0] == "<compat>" and 0xFB00 <= c <= 0xFB06:
            longer[c] = unicodedata.normalize("NFKC", ch)
        elif len(parts) == 2 and not parts[0].startswith("<") and unicodedata.normalize("NFC", ch) == ch:
            pairs.append((int(parts[0], 16) << 21 | int(parts[1], 16), c))
    for ch in INVISIBLE:
        kind[ord(ch)] = UNSEEN | INNER
    for ch in SPACES:
        kind[ord(ch)] = SPACE
        to[ord(ch)] = 0x20
    kind[0xFE0F] = kind[0xFE0E] = EMOJI
    kind[0x20E3] = EMOJI
    kind[0xE0020:0xE0080] = EMOJI
    for a, b in LOOKALIKES.items():
        like[ord(a)] = ord(b)
    pairs.sort()
    long_at = np.array(sorted(longer), np.uint32)
    return {
        "kind": kind, "to": to, "like": like,
        "pair": np.array([p for p, _ in pairs], np.uint64), "made": np.array([m for _, m in pairs], np.uint32),
        "long_at": long_at, "long": [np.array([ord(x) for x in longer[int(c)]], np.uint32) for c in long_at],
    }


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all rows, offsets of the rows) of a string array; null counts as empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int32)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and n else np.zeros(0, np.uint8)
    cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    before = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return cp, before[off - off[0]]


def to_strings(cp: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    data = cp.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
    ends = np.concatenate(([0], np.cumsum(width)))[offsets]
    mask = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [mask, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data)])


def _shift(a: np.ndarray, by: int, fill=0) -> np.ndarray:
    out = np.full_like(a, fill)
    if by > 0:
        out[by:] = a[:-by]
    elif by < 0:
        out[:by] = a[-by:]
    return out


def fold_batch(cp: np.ndarray, off: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded code points, their offsets, per row: held a character to fold).

    whole: a row is one word (a user name), so that its letters are judged together.
    """
    t = tables()
    rows = len(off) - 1
    if not len(cp):
        return cp, off, np.zeros(rows, bool)
    kind = t["kind"][cp]
    row = np.repeat(np.arange(rows), np.diff(off))
    first = np.zeros(len(cp), bool)
    first[off[:-1][np.diff(off) > 0]] = True
    inside = (kind & (LATIN | OTHER | INNER | DIGIT | WIDE)) > 0
    begins = first | (inside != _shift(inside, 1, False))
    word = row if whole else np.cumsum(begins) - 1
    words = int(word[-1]) + 1
    latin = np.bincount(word, (kind & LATIN) > 0, words)[word] > 0
    other = np.bincount(word, ((kind & OTHER) > 0) & (t["like"][cp] == 0), words)[word] > 0
    alike = (t["like"][cp] > 0) & latin & inside & ~(other & ~latin)
    seen = (kind & UNSEEN) == 0
    # A joiner inside emoji, or between letters of a script other than Latin, is text.
    before = np.where(first, 0, _shift(kind, 1))
    after = np.where(_shift(first, -1, True), 0, _shift(kind, -1))
    joins = (cp == 0x200D) | (cp == 0x200C)
    text_joiner = joins & ((((before & EMOJI) > 0) & ((after & EMOJI) > 0) & (cp == 0x200D)) | (((before & (OTHER | INNER)) > 0) & ((after & (OTHER | INNER)) > 0) & (((before | after) & UNSEEN) == 0) & ~latin & inside & (np.bincount(word, (kind & OTHER) > 0, words)[word] > 0)))
    unseen = ~seen & ~text_joiner
    spaces = (kind & SPACE) > 0
    wide = (kind & WIDE) > 0
    # Marks that follow a letter, a letter's mark or something unseen after a letter.
    letter = (kind & (LATIN | OTHER | DIGIT)) > 0
    mark = ((kind & MARK) > 0) & inside
    last_letter = np.maximum.accumulate(np.where(letter, np.arange(len(cp)), -1))
    loose = np.maximum.accumulate(np.where(~(letter | ((kind & (MARK | UNSEEN)) > 0)) | first, np.arange(len(cp)), -1))
    accent = mark & (last_letter >= 0) & (last_letter >= loose) & (row[np.maximum(last_letter, 0)] == row)
    hit = alike | unseen | spaces | wide | accent
    held = np.bincount(row, hit, rows) > 0
    new = np.where(alike, t["like"][cp], t["to"][cp])
    keep = ~unseen
    new, row, accent = new[keep], row[keep], accent[keep]
    if len(t["long_at"]) and len(new):
        at = np.searchsorted(t["long_at"], new)
        is_long = t["long_at"][np.minimum(at, len(t["long_at"]) - 1)] == new
        if is_long.any():
            sizes = np.ones(len(new), np.int64)
            sizes[is_long] = [len(t["long"][i]) for i in at[is_long]]
            start = np.cumsum(sizes) - sizes
            out = np.repeat(new, sizes)
            for i in np.flatnonzero(is_long):
                out[start[i] : start[i] + sizes[i]] = t["long"][at[i]]
            new, row, accent = out, np.repeat(row, sizes), np.repeat(accent, sizes)
    while accent.any():  # a pass composes each first mark of a run with its base
        here = np.flatnonzero(accent & ~_shift(accent, 1, False))
        here = here[here > 0]
        key = new[here - 1].astype(np.uint64) << np.uint64(21) | new[here].astype(np.uint64)
        at = np.minimum(np.searchsorted(t["pair"], key), len(t["pair"]) - 1)
        fits = t["pair"][at] == key
        accent[here] = False
        if fits.any():
            new[here[fits] - 1] = t["made"][at[fits]]
            gone = np.ones(len(new), bool)
            gone[here[fits]] = False
            new, row, accent = new[gone], row[gone], accent[gone]
    return new, np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows)))), held


def fold_array(column: pa.Array, whole: bool = False) -> tuple[pa.Array, np.ndarray]:
    """(folded strings, per row: held a character to fold) of an Arrow string array."""
    cp, off = code_points(column)
    new, ends, held = fold_batch(cp, off, whole)
    valid = np.ones(len(column), bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    return to_strings(new, ends, valid), held


def _percent_decoded(c: Column) -> Column:
    return F.transform(c, lambda h: F.when(h.contains("%"), F.coalesce(F.try_url_decode(F.replace(h, F.lit("+"), F.lit("%2B"))), h)).otherwise(h))


def fold_posts(posts: DataFrame) -> DataFrame:
    """post_key, caption, hashtags and username in one form, and ``<field>_held`` for each.

    A hashtag that is percent-encoded is decoded first; the encoding itself is no case.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow(batches, ("caption", "username")):
            caption, c_held = fold_array(b.column("caption"))
            username, u_held = fold_array(b.column("username"), whole=True)
            tags = b.column("hashtags")
            flat, t_held = fold_array(tags.flatten())
            sizes = tags.value_lengths().fill_null(0).to_numpy()
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            of = np.repeat(np.arange(len(sizes)), sizes)
            h_held = np.bincount(of, t_held, len(sizes)) > 0
            mask = pa.array(tags.is_null().to_numpy(zero_copy_only=False)) if tags.null_count else None
            lists = pa.ListArray.from_arrays(pa.array(ends), flat.cast(pa.string()), mask=mask)
            yield pa.RecordBatch.from_arrays(
                [b.column("post_key"), caption.cast(pa.string()), lists, username.cast(pa.string()), pa.array(c_held), pa.array(h_held), pa.array(u_held)],
                names=["post_key", "caption", "hashtags", "username", "caption_held", "hashtags_held", "username_held"],
            )

    rows = posts.select("post_key", "caption", "username", _percent_decoded(F.col("hashtags")).alias("hashtags"))
    return rows.mapInArrow(run, "post_key bigint, caption string, hashtags array<string>, username string, caption_held boolean, hashtags_held boolean, username_held boolean")


def p7_found(posts: DataFrame) -> DataFrame:
    """(post_key, field): one row for each field that held a character to fold."""
    fields = F.filter(F.array(*[F.when(F.col(f"{f}_held"), F.lit(f)) for f in ("caption", "hashtags", "username")]), lambda x: x.isNotNull())
    return fold_posts(posts).select("post_key", F.explode(fields).alias("field"))


@functools.lru_cache(maxsize=1)
def _skeleton_maps() -> tuple[str, str]:
    a, b = [], []
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = unicodedata.normalize("NFD", chr(c))[0]
        if plain != chr(c) and plain.isascii():
            a.append(chr(c))
            b.append(plain.lower())
    for c in range(0xFF01, 0xFF5F):
        a.append(chr(c))
        b.append(chr(c - 0xFEE0).lower())
    for x, y in LOOKALIKES.items():
        a.append(x)
        b.append(y.lower())
    for x in SPACES:
        a.append(x)
        b.append(" ")
    return "".join(a) + INVISIBLE, "".join(b)


def skeleton(c: Column) -> Column:
    """A coarse form for matching, inside the JVM: lower case, no accents, no unseen signs.

    Unlike the fold above it maps look-alike letters in every word.
    """
    a, b = _skeleton_maps()
    return F.lower(F.translate(F.regexp_replace(c, "[\\u0300-\\u036F]", ""), a, b))


_COARSE = dict(zip(*(m for m in _skeleton_maps()))) | {c: "" for c in _skeleton_maps()[0][len(_skeleton_maps()[1]) :]} | {chr(c): "" for c in range(0x300, 0x370)}
_COARSE_SIGNS = re.compile("[" + "".join(map(re.escape, _COARSE)) + "]")


def coarse(text: str) -> str:
    """``skeleton`` of one text, for use inside Arrow batches."""
    return (text if text.isascii() else _COARSE_SIGNS.sub(lambda m: _COARSE[m.group()], text)).lower()
