"""Language markers, keywords, lexicon sentiment, tone, and the routing of texts to scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from mentionlake import lexicon as L
from mentionlake.functions import text as X
from mentionlake.functions.binding import let
from mentionlake.session import cut

#: Least lengths of trimmed texts for language, sentiment and comments.
LEAST_LANGUAGE, LEAST_SENTIMENT, LEAST_COMMENT = 10, 5, 5


def marker_hits(tokens: Column, words) -> Column:
    return F.size(F.array_intersect(tokens, F.array(*[F.lit(w) for w in dict.fromkeys(words)])))


def language(text: Column, hint: Column | None = None, markers: Mapping = L.MARKERS) -> Column:
    """struct<language, confidence, sheng, swahili>: two or more sheng markers mean sheng
    (0.5 + 0.1 each, 0.95 at most), English words with two Swahili ones mean mixed (0.7), else
    the language with most markers (0.85); unknown for short texts and without any marker.
    A hint that is not empty wins."""
    counts = let(X.distinct_tokens(text), lambda t: F.array(*[marker_hits(t, v) for v in markers.values()]))

    def decide(c: Column) -> Column:
        n = {k: F.element_at(c, i + 1) for i, k in enumerate(markers)}
        most = F.greatest(n["english"], n["swahili"], n["french"], n["german"])
        best = F.when(most == 0, F.lit("unknown"))
        for k in ("english", "swahili", "french", "german"):
            best = best.when(n[k] == most, F.lit(k))
        sheng = (F.least(50 + 10 * n["sheng"], F.lit(95)).cast("decimal(5,2)") / 100).cast("double")
        pair = lambda lang, conf: F.struct(lang.alias("language"), conf.alias("confidence"), n["sheng"].alias("sheng"), n["swahili"].alias("swahili"))
        found = (
            F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) < LEAST_LANGUAGE, pair(F.lit("unknown"), F.lit(0.0)))
            .when(n["sheng"] >= 2, pair(F.lit("sheng"), sheng))
            .when((best == "english") & (n["swahili"] >= 2), pair(F.lit("mixed"), F.lit(0.7)))
            .otherwise(pair(best, F.when(best == "unknown", F.lit(0.0)).otherwise(F.lit(0.85))))
        )
        if hint is not None:
            found = F.when(F.trim(hint) != "", pair(F.lower(F.trim(hint)), F.lit(1.0))).otherwise(found)
        return found

    return let(counts, decide)


def keywords(text: Column, lang: Column, table: Mapping) -> Column:
    """Keywords of a polarity in a text: English always, Swahili for swahili, sheng and mixed,
    sheng for sheng and mixed; single words by token, longer ones by containment."""
    empty = F.expr("cast(array() as array<string>)")
    gates = {"english": F.lit(True), "swahili": lang.isin("swahili", "sheng", "mixed"), "sheng": lang.isin("sheng", "mixed")}

    def find(tokens: Column) -> Column:
        lower, out = F.lower(F.coalesce(text, F.lit(""))), []
        for k, words in table.items():
            single, longer = [w for w in words if " " not in w], [w for w in words if " " in w]
            found = F.array_intersect(F.array(*[F.lit(w) for w in single]), tokens) if single else empty
            if longer:
                found = F.concat(found, X.contained(lower, longer))
            out.append(F.when(gates.get(k, F.lit(True)), found).otherwise(empty))
        return F.array_distinct(F.concat(*out))

    return let(X.distinct_tokens(text), find)


def lexicon_score(positive: Column, negative: Column) -> Column:
    """(p - n) / (p + n) from the keywords, 0 without any."""

    def score(c: Column) -> Column:
        p, n = F.element_at(c, 1), F.element_at(c, 2)
        return F.when(p + n > 0, F.round((p - n).cast("decimal(10,0)") / (p + n).cast("decimal(10,0)"), 4).cast("double")).otherwise(F.lit(0.0))

    return let(F.array(F.size(positive), F.size(negative)), score)


def label_of(score: Column) -> Column:
    return F.when(score > 0.25, F.lit("positive")).when(score < -0.25, F.lit("negative")).otherwise(F.lit("neutral"))


def tone(score: Column, positive: Column, negative: Column) -> Column:
    return (
        F.when(score > 0.3, F.lit("positive")).when(score < -0.3, F.lit("negative"))
        .when(positive > negative + 2, F.lit("positive")).when(negative > positive + 2, F.lit("negative"))
        .when((positive >= 2) & (negative >= 2), F.lit("mixed")).otherwise(F.lit("neutral"))
    )


#: What a model says of a text; scores_all holds the class probabilities, sentences the parts' scores.
SCORED = "struct<score:double,magnitude:double,confidence:double,provider:string,scores_all:array<double>,sentences:array<struct<text:string,score:double>>>"


class Scorer(Protocol):
    """A sentiment model: loaded once for each worker, asked for the texts of a batch at a time.

    The loaded function gives scores as a Series, or a DataFrame with ``score`` and any of
    ``magnitude``, ``confidence``, ``scores_all`` and ``sentences``."""

    name: str

    def load(self) -> Callable[[pd.Series], pd.Series | pd.DataFrame]: ...


class ThreeClass:
    """A scorer over the logits (negative, neutral, positive) of a three-class model:
    score = P(positive) - P(negative), confidence and magnitude = the greatest probability,
    probabilities to four places."""

    def __init__(self, name: str, load_logits: Callable[[], Callable[[pd.Series], np.ndarray]]):
        self.name, self.load_logits = name, load_logits

    def load(self) -> Callable[[pd.Series], pd.DataFrame]:
        logits = self.load_logits()

        def run(texts: pd.Series) -> pd.DataFrame:
            x = np.asarray(logits(texts), float).reshape(len(texts), 3)
            e = np.exp(x - x.max(1, keepdims=True))
            p = np.round(e / e.sum(1, keepdims=True), 4)
            return pd.DataFrame({"score": np.round(p[:, 2] - p[:, 0], 4), "magnitude": p.max(1), "confidence": p.max(1), "scores_all": list(p)})

        return run


def routes(remote: Scorer | None = None, local: Scorer | None = None) -> dict[str, list[Scorer]]:
    """Which scorers a language tries in turn: English the remote one first, the mixed local
    languages and unknown texts the local one, others the remote one; ``*`` is any other."""
    chain = lambda *ss: [s for s in ss if s is not None]
    table = {"english": chain(remote, local), **{k: chain(local) for k in ("swahili", "sheng", "mixed", "unknown")}, "*": chain(remote, local)}
    return {k: v for k, v in table.items() if v}


def _chains(scorers: Mapping) -> dict[str, list]:
    return {k: list(v) if isinstance(v, (list, tuple)) else [v] for k, v in scorers.items()}


def _route(texts: pd.Series, langs: pd.Series, chains: dict[str, list], models: dict) -> pd.DataFrame:
    """Scores of the texts that have one and whose language has a chain; others stay null."""
    n = len(texts)
    out = {c: np.full(n, None, object) for c in ("score", "magnitude", "confidence", "provider", "scores_all", "sentences")}
    texts, langs = texts.reset_index(drop=True), langs.reset_index(drop=True)
    open_ = texts.notna().to_numpy()
    named = langs.isin([k for k in chains if k != "*"]).to_numpy()
    for lang, chain in chains.items():
        at = np.flatnonzero(open_ & (~named if lang == "*" else (langs == lang).to_numpy()))
        if not len(at):
            continue
        for scorer in chain:
            try:
                if scorer.name not in models:
                    models[scorer.name] = scorer.load()
                got = models[scorer.name](texts.iloc[at].reset_index(drop=True))
            except Exception:  # the next of the chain takes over; the provider tells
                continue
            if not isinstance(got, pd.DataFrame):
                got = pd.DataFrame({"score": np.asarray(got, float)})
            size = got["score"].astype(float).abs()
            rows = {"score": got["score"], "magnitude": got.get("magnitude", size), "confidence": got.get("confidence", got.get("magnitude", size).clip(upper=1.0)), "scores_all": got.get("scores_all"), "sentences": got.get("sentences")}
            for c, values in rows.items():
                for i, v in zip(at, values if values is not None else ()):
                    out[c][i] = v
            out["provider"][at] = scorer.name
            break
        else:
            for c in ("score", "magnitude", "confidence"):
                out[c][at] = 0.0
            out["provider"][at] = f"{chain[-1].name}_error"
    return pd.DataFrame(out)


def _rows(found: pd.DataFrame) -> pd.DataFrame:
    for c in ("score", "magnitude", "confidence"):
        found[c] = pd.to_numeric(found[c])
    return found


def scored_by(text: Column, lang: Column, scorers: Mapping) -> Column:
    """SCORED of a text by the scorers of its language, null where there is none; a scorer sees
    only texts of its languages and is loaded once a worker."""
    chains = _chains(scorers)

    @pandas_udf(SCORED)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        models: dict = {}
        for texts, langs in batches:
            yield _rows(_route(texts, langs, chains, models))

    return run.asNondeterministic()(text, lang)  # never copied by the optimizer: a model runs once


def scored_each(texts: Column, langs: Column, scorers: Mapping) -> Column:
    """array<SCORED> of an array of texts with an array of their languages."""
    chains = _chains(scorers)

    @pandas_udf(f"array<{SCORED}>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        models: dict = {}
        for t, g in batches:
            t, g = [x if x is not None else [] for x in t], [x if x is not None else [] for x in g]
            flat = _route(pd.Series([y for x in t for y in x], dtype=object), pd.Series([y for x in g for y in x], dtype=object), chains, models).to_dict("records")
            at, out = 0, []
            for x in t:
                out.append([r if r["provider"] is not None else None for r in flat[at : at + len(x)]])
                at += len(x)
            yield pd.Series(out)

    return run.asNondeterministic()(texts, langs)


def sentiment(df: DataFrame, text: str, lang: str, scorers: Mapping | None = None, keyword_text: str | None = None) -> DataFrame:
    """Adds positive, negative (keywords), score, label, provider, magnitude, confidence,
    scores_all and sentences (both null without a model).

    Languages with scorers go to them in turn (see ``routes``), all others to the lexicon,
    whose magnitude is four times the share of keywords among the tokens, 1 at most.  Texts of
    under five characters are neutral with provider none.  ``keyword_text``: another column
    whose keywords are reported; the lexicon scores those of ``text``.
    """
    found = lambda c, t: keywords(F.col(c), F.col(lang), t)
    df = df.withColumns({"positive": found(text, L.POSITIVE), "negative": found(text, L.NEGATIVE)})
    long_enough = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) >= LEAST_SENTIMENT
    n, tokens = F.size("positive") + F.size("negative"), F.greatest(F.size(X.distinct_tokens(F.col(text))), F.lit(1))
    strength = F.round(F.least(F.lit(1.0), 4 * n / tokens), 4)
    df = df.withColumns({"score": F.when(long_enough, lexicon_score(F.col("positive"), F.col("negative"))).otherwise(F.lit(0.0)), "magnitude": F.when(long_enough, strength).otherwise(F.lit(0.0)), "provider": F.when(long_enough, F.lit("lexicon")).otherwise(F.lit("none"))})
    df = df.withColumns({"confidence": F.col("magnitude"), "scores_all": F.lit(None).cast("array<double>"), "sentences": F.lit(None).cast("array<struct<text:string,score:double>>")})
    if scorers:
        df = df.withColumn("_model", scored_by(F.when(long_enough, F.col(text)), F.col(lang), scorers))
        df = df.withColumns({c: F.when(F.col("_model.provider").isNotNull(), F.col(f"_model.{c}")).otherwise(F.col(c)) for c in ("score", "magnitude", "provider", "confidence", "scores_all", "sentences")}).drop("_model")
    if keyword_text:
        df = df.withColumns({"positive": found(keyword_text, L.POSITIVE), "negative": found(keyword_text, L.NEGATIVE)})
    return df.withColumn("label", label_of(F.col("score")))


def _long_comments(comments: str, most: int) -> Column:
    first = F.slice(F.coalesce(F.col(comments), F.expr("array()")), 1, most)
    return F.filter(first, lambda c: F.length(F.trim(F.coalesce(c["text"], F.lit("")))) >= LEAST_COMMENT)


def comment_details(df: DataFrame, comments: str, most: int, chars: int = 100) -> Column:
    """array<struct<text, score, label, provider>> of the first ``most`` comments, those of under
    five characters left out, each in its own language; texts are cut to ``chars`` for display,
    after they are scored."""

    def told(c: Column, score: Column, provider: Column) -> Column:
        return F.struct(F.substring(c["text"], 1, chars).alias("text"), score.alias("score"), label_of(score).alias("label"), provider.alias("provider"))

    def by_lexicon(c: Column) -> Column:
        score = let(language(c["text"])["language"], lambda lang: lexicon_score(keywords(c["text"], lang, L.POSITIVE), keywords(c["text"], lang, L.NEGATIVE)))
        return let(score, lambda s: told(c, s, F.lit("lexicon")))

    kept = _long_comments(comments, most)
    plain = F.transform(kept, by_lexicon)
    return plain


def with_comment_details(df: DataFrame, name: str, comments: str, most: int, scorers: Mapping | None = None, chars: int = 100) -> DataFrame:
    """Adds ``comment_details``; comments of a language that has scorers are scored by those.

    With scorers the texts are written before and their scores after the models ran, so a model
    runs once whatever reads the result."""
    plain = comment_details(df, comments, most, chars)
    if not scorers:
        return df.withColumn(name, plain)
    kept = _long_comments(comments, most)
    rows = df.withColumns({"_plain_details": plain, "_texts": F.transform(kept, lambda c: c["text"]), "_langs": F.transform(kept, lambda c: language(c["text"])["language"])})
    rows = cut(cut(rows, "comments").withColumn("_models", scored_each(F.col("_texts"), F.col("_langs"), scorers)), "scored")
    by_model = F.transform(F.arrays_zip("_plain_details", "_models"), lambda z: F.when(z["_models"]["provider"].isNull(), z["_plain_details"]).otherwise(
        F.struct(z["_plain_details"]["text"].alias("text"), z["_models"]["score"].alias("score"), label_of(z["_models"]["score"]).alias("label"), z["_models"]["provider"].alias("provider"))
    ))
    return rows.withColumn(name, by_model).drop("_plain_details", "_texts", "_langs", "_models")


def mean_score(details: Column) -> Column:
    """Mean of the scores, null if there is none."""
    total = F.aggregate(details, F.lit(0.0), lambda a, x: a + x["score"])
    return F.when(F.size(details) > 0, F.round(total / F.size(details), 4))


def comment_scores(df: DataFrame, comments: str, most: int) -> Column:
    """Mean score of the first ``most`` comments that are long enough, null if none is."""
    return mean_score(comment_details(df, comments, most))


def annotate_nlp(df: DataFrame, max_comments: int = 20, hint: str | None = None, scorers: Mapping | None = None, comments: bool = True) -> DataFrame:
    """Language, sentiment and tone of captions, keywords of captions and comments without tags,
    and per comment its sentiment (``comment_details``, null if there is none) and their mean."""
    df = df.withColumn("language", language(F.col("caption"), F.col(hint) if hint else None)).withColumn("_lang", F.col("language.language"))
    said = F.array_join(F.transform(F.coalesce("comment_texts", F.expr("array()")), lambda c: F.coalesce(c["text"], F.lit(""))), " ")
    plain = df.withColumns({"_plain": X.without_hashtags(F.col("caption")), "_all": X.without_hashtags(F.concat_ws(" ", "caption", said))})
    out = sentiment(plain, "_plain", "_lang", scorers, "_all")
    out = out.withColumn("tone", tone(F.col("score"), F.size("positive"), F.size("negative")))
    if comments and max_comments > 0:
        out = with_comment_details(out, "_details", "comment_texts", max_comments, scorers)
        out = out.withColumns({"comment_score": mean_score(F.col("_details")), "comment_details": F.when(F.size("_details") > 0, F.col("_details"))}).drop("_details")
    return out.drop("_plain", "_all", "_lang")
