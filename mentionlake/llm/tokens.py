"""Token ids of a byte-level BPE vocabulary inside the JVM (problem 8).

A text is cut into words by the vocabulary's pattern; each distinct word is encoded once
and its ids are put back in place.  A word starts as its bytes (as hex pairs, so that any
byte string is plain text); a fold then merges, step by step, the neighbouring pair whose
joint bytes have the least rank, at all places where it stands, until no pair has a rank.
(A pair made by a merge never ranks before it, so this is the same as one place at a time,
and a very long word takes a step for each kind of merge, not for each letter.)  The
ranks are one literal: an array of small maps, where the CRC of the joint bytes names the
map, so that a look-up reads a dozen entries instead of 50,000.

The ``HOT_WORDS`` words that most documents hold are a literal as well, so they are put in
place without any join, and no key of the join that serves the rest is frequent.

Defined cases: null and empty texts give an empty list; the special token's text is
ordinary text; characters outside the pattern's classes fall into its last branches, so
every byte of a text is covered and ``decode`` gives the text back.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.functions.binding import let
from mentionlake.session import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BUCKETS, HOT_WORDS = 4096, 16384
# Fixed value: the public pattern of this vocabulary, in Java's notation.
PATTERN = r"('(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+)"


@functools.lru_cache(maxsize=4)
def _ranks(path: str) -> dict[str, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a).hex().upper(): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def _rank_json(path: str) -> str:
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in _ranks(path).items():
        buckets[zlib.crc32(token.encode()) % BUCKETS][token] = rank
    return json.dumps(buckets, separators=(",", ":"))


def rank_of(token: Column, path: str = VOCABULARY) -> Column:
    """Rank of a token in hex, null if the vocabulary lacks it."""
    maps = F.from_json(F.lit(_rank_json(path)), "array<map<string,int>>")  # folded to one literal
    return F.try_element_at(F.element_at(maps, (F.crc32(F.encode(token, "UTF-8")) % BUCKETS).cast("int") + 1), token)


def words(text: Column) -> Column:
    """The words of a text by the vocabulary's pattern; they cover it wholly."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + PATTERN), F.lit(1))


def encode_word(word: Column, path: str = VOCABULARY) -> Column:
    """array<int> of a word: the fold of merges over its bytes."""
    hexed = F.hex(F.encode(word, "UTF-8"))
    no_rank = F.lit(2**31 - 1)
    at = F.element_at

    def merge(said: Column) -> Column:
        def of(p: Column) -> Column:
            ranks = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.coalesce(rank_of(F.concat(at(p, i), at(p, i + 1)), path), no_rank))

            def apply(r: Column) -> Column:
                first = F.array_position(r, F.array_min(r)).cast("int")
                joined = let(first, lambda i: F.replace(said, F.concat(F.lit("<"), at(p, i), F.lit("><"), at(p, i + 1), F.lit(">")), F.concat(F.lit("<"), at(p, i), at(p, i + 1), F.lit(">"))))
                return F.when(F.array_min(r) < no_rank, F.struct(joined.alias("p"), F.lit(False).alias("done"))).otherwise(F.struct(said.alias("p"), F.lit(True).alias("done")))

            return F.when(F.size(p) < 2, F.struct(said.alias("p"), F.lit(True).alias("done"))).otherwise(let(ranks, apply))

        return let(pieces(said), of)

    def pieces(said: Column) -> Column:
        return F.split(F.substring(said, F.lit(2), F.length(said) - 2), "><")

    def step(state: Column, _: Column) -> Column:
        return F.when(state["done"], state).otherwise(merge(state["p"]))

    def fold(h: Column) -> Column:
        start = F.struct(F.regexp_replace(h, "(..)", "<$1>").alias("p"), F.lit(False).alias("done"))
        steps = F.sequence(F.lit(1), F.greatest((F.length(h) / 2).cast("int") - 1, F.lit(1)))
        return F.aggregate(steps, start, step, lambda s: F.transform(pieces(s["p"]), lambda p: rank_of(p, path)))

    return let(hexed, fold)


def _hot_codes(hot: dict[str, list[int]]):
    """Look-up of frequent words: one literal of small maps, as for the ranks."""
    buckets: list[dict[str, list[int]]] = [{} for _ in range(BUCKETS)]
    for w, code in hot.items():
        buckets[zlib.crc32(w.encode()) % BUCKETS][w] = code
    maps = F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,array<int>>>")
    return lambda w: F.try_element_at(F.element_at(maps, (F.crc32(F.encode(w, "UTF-8")) % BUCKETS).cast("int") + 1), w)


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, ids) for every row; keys that occur twice keep a row each."""
    spark = documents.sparkSession
    # One row for each distinct word; the counts are combined before they move.
    counted = cut(documents.select(F.explode(F.array_distinct(words(F.col(text)))).alias("word")).groupBy("word").count(), "words")
    coded = cut(counted.repartition(spark.sparkContext.defaultParallelism * 2, "word").select("word", "count", encode_word(F.col("word"), path).alias("code")), "codes")
    hot = _hot_codes({r.word: list(r.code) for r in coded.orderBy(F.desc("count"), "word").limit(HOT_WORDS).collect()})

    def mark(w: Column) -> Column:
        # A frequent word gives its ids in place, another the negative of its place.
        ids = F.flatten(F.transform(w, lambda x, i: F.coalesce(hot(x), F.array(-(i + 1)))))
        cold = lambda i: F.transform(F.filter(i, lambda n: n < 0), lambda n: F.struct(n.alias("n"), F.element_at(w, -n).alias("word")))
        return let(ids, lambda i: F.struct(i.alias("ids"), cold(i).alias("cold")))

    rows = documents.select(F.col(key), let(words(F.col(text)), mark).alias("_m")).select(key, F.monotonically_increasing_id().alias("_row"), "_m.ids", "_m.cold")
    rows = cut(rows, "marked")
    open_ = rows.where(F.size("cold") > 0)
    each = open_.select("_row", F.explode("cold").alias("c")).select("_row", "c.n", "c.word").join(coded.select("word", "code"), "word")
    found = each.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("n", "code"))).alias("_codes"))
    filled = F.flatten(F.transform("ids", lambda x: F.when(x < 0, F.element_at("_codes", x)).otherwise(F.array(x))))
    return rows.where(F.size("cold") == 0).select(key, "ids").union(open_.join(found, "_row").select(key, filled.alias("ids")))


def decode(ids: Column, spark: SparkSession | None = None, path: str = VOCABULARY) -> Column:
    """The bytes of token ids as text: pieces are joined as binary, then read as UTF-8."""
    by_rank = sorted(_ranks(path).items(), key=lambda x: x[1])
    table = F.from_json(F.lit(json.dumps([t for t, _ in by_rank])), "array<string>")
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(table, i + 1)), "")), "UTF-8")


def p8_ids(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): the token ids of every document."""
    return encode(documents, path=path)
