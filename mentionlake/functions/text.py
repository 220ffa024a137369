"""Scalar functions over text, counts, dates, URLs and places, as Column expressions.

All of them pass null on unless their text says otherwise, and stay inside the JVM.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from mentionlake.lexicon import TIERS

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
EMOJI_RANGES = r"[\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}]"


def empty_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def first_filled(*cs: Column) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in cs])


def hashtags(text: Column, keep_sign: bool = False) -> Column:
    """Hashtags of a text in lower case, in order; an empty array for null."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)#(\w+)"), F.lit(0 if keep_sign else 1))
    return F.transform(found, F.lower)


def mentions(text: Column, dots: bool = False) -> Column:
    """Handles that a text names, in lower case and without the sign."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)@([\w.]+)" if dots else r"(?U)@(\w+)"), F.lit(1)), F.lower)


def without_hashtags(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)#\w+", "")


def distinct_tokens(text: Column) -> Column:
    """Distinct lower-case tokens, cut at white space, without punctuation at their ends."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+")
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.btrim(w, F.lit(PUNCTUATION))), lambda w: w != ""))


def joined_text(*parts: Column, sep: str = "\n") -> Column:
    return F.concat_ws(sep, *parts)


def parse_count(c: Column) -> Column:
    """bigint of a human count: 1,234 or 1.4K or 2.3M; null if it is none."""
    s = F.upper(F.regexp_replace(F.trim(c), "[, ]", ""))
    number = F.regexp_extract(s, r"^([0-9]+(?:[.][0-9]+)?)[KMB]?$", 1).try_cast("decimal(20,6)")
    unit = F.when(s.endswith("K"), 1_000).when(s.endswith("M"), 1_000_000).when(s.endswith("B"), 1_000_000_000).otherwise(1)
    return F.floor(number * unit).cast("bigint")


def harvest_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "").try_cast("bigint")


def from_unix(c: Column) -> Column:
    """timestamp of Unix seconds in any column type; null for 0 and for what is no number."""
    n = c.try_cast("bigint")
    return F.when(n != 0, F.timestamp_seconds(n))


def from_ctime(c: Column) -> Column:
    """timestamp of ``Sat Jun 03 11:02:01 +0000 2023``."""
    return F.try_to_timestamp(F.substring(F.trim(c), 5, 60), F.lit("MMM dd HH:mm:ss Z yyyy"))


def from_iso(c: Column) -> Column:
    return F.try_to_timestamp(F.trim(c))


def from_age(c: Column, at: Column) -> Column:
    """timestamp of an age such as 3d or 2 weeks ago, counted back from ``at``."""
    n = F.regexp_extract(F.lower(c), r"^\s*([0-9]{1,5})\s*(w|d|h|m|s)", 1).try_cast("bigint")
    unit = F.regexp_extract(F.lower(c), r"^\s*([0-9]{1,5})\s*(w|d|h|m|s)", 2)
    seconds = F.when(unit == "w", 604_800).when(unit == "d", 86_400).when(unit == "h", 3_600).when(unit == "m", 60).otherwise(1)
    return F.timestamp_seconds(F.unix_seconds(at) - n * seconds)


def engagement_rate(reactions: Column, followers: Column, digits: int = 2) -> Column:
    """Reactions for each hundred followers; 0 without followers."""
    rate = F.coalesce(reactions, F.lit(0)).cast("decimal(20,0)") * 100 / followers.cast("decimal(20,0)")
    return F.when(followers > 0, F.round(rate, digits).cast("double")).otherwise(F.lit(0.0))


def shortcode(url: Column) -> Column:
    return empty_to_null(F.regexp_extract(url, r"/(?:p|reel)/([A-Za-z0-9_-]+)", 1))


def canonical_url(url: Column) -> Column:
    """The URL of a photo or reel in one form, null for others."""
    kind = F.regexp_extract(url, r"/(p|reel)/[A-Za-z0-9_-]+", 1)
    return F.when(kind != "", F.concat(F.lit("https://www.instagram.example/"), kind, F.lit("/"), shortcode(url), F.lit("/")))


def host(url: Column) -> Column:
    h = F.lower(F.regexp_extract(F.trim(url), r"^(?i)(?:https?://)?([^/?#]+)", 1))
    return empty_to_null(F.regexp_replace(h, r"^(?:www|m|mobile)\.", ""))


def platform_of(url: Column) -> Column:
    """Platform by the host's name, so that no other host that ends alike is taken for it."""
    h, out = host(url), None
    for name in ("instagram", "tiktok", "facebook", "linkedin", "x"):
        hit = h.rlike(rf"^(?:[a-z0-9-]+\.)*{name}\.[a-z]+$")
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit("unknown"))


def query_param(url: Column, name: str) -> Column:
    return F.try_url_decode(empty_to_null(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)))


def percent_decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def short_md5(c: Column, chars: int, length: int) -> Column:
    """The first ``length`` hex digits of the md5 of the first ``chars`` characters."""
    return F.substring(F.md5(F.substring(c, 1, chars).cast("binary")), 1, length)


def follower_tier(followers: Column, tiers: Sequence = TIERS) -> Column:
    out = None
    for least, name, _ in tiers:
        out = F.when(followers >= least, F.lit(name)) if out is None else out.when(followers >= least, F.lit(name))
    return out.otherwise(F.lit("individual"))


def city_part(location: Column) -> Column:
    """The part before the first comma."""
    return empty_to_null(F.trim(F.split_part(location, F.lit(","), F.lit(1))))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def local_hour(ts: Column, offset: Column) -> Column:
    return F.pmod(F.hour(ts) + offset, F.lit(24)).cast("int")


# Letters of scripts other than Latin.
SCRIPTS = {
    "hangul": r"\x{AC00}-\x{D7AF}", "kana": r"\x{3040}-\x{30FF}", "han": r"\x{4E00}-\x{9FFF}", "arabic": r"\x{0600}-\x{06FF}",
    "thai": r"\x{0E00}-\x{0E7F}", "devanagari": r"\x{0900}-\x{097F}", "cyrillic": r"\x{0400}-\x{04FF}",
}


def script_of(text: Column) -> Column:
    """The first script other than Latin that a text holds, null if none."""
    found = None
    for name, span in SCRIPTS.items():
        hit = text.rlike(f"[{span}]")
        found = F.when(hit, F.lit(name)) if found is None else found.when(hit, F.lit(name))
    return found


def has_phone(text: Column) -> Column:
    """Whether a text holds something like a telephone number (the number is not kept)."""
    return text.rlike(r"(?<![0-9])(?:\+?254|0)[ -]?[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{3}(?![0-9])")


def softmax_score(logits: Column) -> Column:
    """P(last) - P(first) of an array of logits."""
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return (F.element_at(e, -1) - F.element_at(e, 1)) / total


def emoji(text: Column, runs: bool = False) -> Column:
    """Emoji of a text; ``runs``: neighbours count as one."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({EMOJI_RANGES}{'+' if runs else ''})"), F.lit(1))


def contained(text_lc: Column, words: Sequence[str]) -> Column:
    """Those of the words that a lower-case text contains, in lexicon order."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text_lc, w))


def mapped(c: Column, table: Mapping) -> Column:
    """Look-up in a small fixed table, null if absent."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def post_url(platform: Column, username: Column, post_id: Column) -> Column:
    """The URL of a post by its author and id, null where one is missing or the platform unknown."""
    out = None
    for name, shape in (("x", "https://x.example/%s/status/%s"), ("tiktok", "https://www.tiktok.example/@%s/video/%s"), ("facebook", "https://www.facebook.example/%s/posts/%s")):
        said = F.when(empty_to_null(username).isNotNull() & empty_to_null(post_id).isNotNull(), F.format_string(shape, username, post_id))
        out = F.when(platform == name, said) if out is None else out.when(platform == name, said)
    return out


def story_url(url: Column, post_id: Column, site: str = "https://m.facebook.example") -> Column:
    """The plain page of a post by its number; the page's own id is taken along from a permalink."""
    page = F.when(F.contains(url, F.lit("permalink.php")), query_param(url, "id"))
    return F.when(empty_to_null(post_id).isNotNull(), F.concat(F.lit(f"{site}/story.php?story_fbid="), post_id, F.coalesce(F.concat(F.lit("&id="), page), F.lit(""))))


def comment_id(post_id: Column, text: Column, chars: int | None = None) -> Column:
    """A derived id of a comment: 16 hex digits of the md5 of the post's id and the text (or its begin)."""
    said = F.coalesce(text, F.lit(""))
    return F.substring(F.md5(F.concat(F.coalesce(post_id, F.lit("")), F.substring(said, 1, chars) if chars else said).cast("binary")), 1, 16)


def joined(values: Column, sep: str = ", ", sign: str = "") -> Column:
    """A list as one string, '' for null; ``sign`` is put before each value."""
    return F.array_join(F.transform(F.coalesce(values, F.expr("cast(array() as array<string>)")), lambda x: F.concat(F.lit(sign), x)), sep)
