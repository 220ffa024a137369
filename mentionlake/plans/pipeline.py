"""From landed posts to annotated posts and summaries, in tables or from file to file."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake import lexicon as L
from mentionlake.functions import filters
from mentionlake.operators import adapters, annotate, dedupe, nlp, summary
from mentionlake.session import cut
from mentionlake.sinks import files
from mentionlake.sources import payloads


@dataclass(frozen=True)
class Config:
    """What to run.  ``max_comments`` of a post are scored, ``max_posts`` of each ``query`` are
    taken (the latest); posts outside [date_from, date_to] (ISO, UTC) are left out, and with
    either bound those without a date too.  ``output``: a folder for posts, summaries, failed
    records and counts; ``layout``: a flat CSV of the canonical posts there; ``upsert``: a sink
    for rows of the ``upsert_keys``."""

    rules: bool = True
    places: bool = True
    text: bool = True
    comments: bool = True
    max_comments: int = 20
    max_posts: int | None = None
    date_from: str | None = None
    date_to: str | None = None
    by: tuple[str, ...] = ()
    scorers: Mapping = field(default_factory=dict)
    output: str | None = None
    layout: str | None = None
    upsert: Callable | None = None
    upsert_keys: tuple[str, ...] = ("post_url",)


def annotated(posts: DataFrame, gazetteer: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """Flat posts with the annotations of the stages that are on; a stage that is off adds no
    columns and leaves no trace in the plan, and a column that a later stage adds again is the
    later one's."""
    if config.rules:
        posts = annotate.annotate_rules(posts)
    if config.places and gazetteer is not None:
        posts = annotate.annotate_places(posts, gazetteer, "geo_enrichment" if "geo_enrichment" in posts.columns else None)
    if config.text:
        posts = nlp.annotate_nlp(posts, config.max_comments, "lang_hint" if "lang_hint" in posts.columns else None, config.scorers, config.comments)
    return posts


def run(records: DataFrame, platform: str, gazetteer: DataFrame | None = None, config: Config = Config()) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(annotated posts, summaries) of records (VARIANT column ``post``) of one platform.

    With ``config.output`` the posts are written there once, and the summaries read that table."""
    canonical, counts = adapters.normalized(records, platform)
    canonical = canonical.where(filters.in_range(F.col("ts"), config.date_from, config.date_to))
    if config.max_posts is not None:
        canonical = dedupe.top_n(canonical, ["query"], [F.desc_nulls_last("ts"), F.asc("post_id"), F.asc("post_url")], config.max_posts).drop("rank")
    if config.output:
        canonical = cut(canonical, "canonical")
    posts = annotated(adapters.flat_post(canonical), gazetteer, config)
    if config.output:
        files.write_json(posts, f"{config.output}/posts")
        posts = posts.sparkSession.read.schema(posts.schema).json(f"{config.output}/posts")
        files.write_json(records.sparkSession.createDataFrame([(platform, *counts().values())], "platform string, read bigint, post_count bigint, skipped bigint"), f"{config.output}/metadata")
        if config.layout:
            files.write_laid_out(canonical, f"{config.output}/csv", config.layout)
    if config.upsert:
        files.upsert(posts, config.upsert_keys, config.upsert)
    summaries = summary.summarize(posts, config.by, L.ENGAGEMENT.get(platform)) if config.text and config.rules else {}
    if config.output and summaries:
        files.write_summaries(summaries, f"{config.output}/summary")
    return posts, summaries


def run_files(spark: SparkSession, source: str, platform: str, output: str, gazetteer: DataFrame | None = None, config: Config = Config()) -> tuple[DataFrame, dict[str, DataFrame]]:
    """``run`` from a folder of landed JSON (lists or envelopes) to the folder ``output``."""
    return run(payloads.load_posts(spark, source), platform, gazetteer, Config(**{**config.__dict__, "output": output}))


def annotate_files(spark: SparkSession, source: str, output: str, stage: str, gazetteer: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """One stage (``rules``, ``places`` or ``text``) over flat posts that lie as JSON lines, to JSON lines."""
    if stage not in ("rules", "places", "text"):
        raise ValueError(f"no stage {stage!r}")
    posts = spark.read.json(source)
    for name, kind in (("caption", "string"), ("username", "string"), ("post_url", "string"), ("platform", "string"), ("location", "string"), ("location_confidence", "double"), ("follower_count", "bigint"), ("hashtags", "array<string>"), ("mentions", "array<string>"), ("comment_texts", "array<struct<text:string>>")):
        if name not in posts.columns:
            posts = posts.withColumn(name, F.lit(None).cast(kind))
    only = {s: s == stage for s in ("rules", "places", "text")}
    out = annotated(posts, gazetteer, Config(**{**config.__dict__, **only}))
    files.write_json(out, output)
    return spark.read.schema(out.schema).json(output)
