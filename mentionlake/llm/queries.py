"""Queries over the operators of this package, for the entry point."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm import folding, languages, leaks, personal, places, repeats, subjects, tokens
from mentionlake.llm.folding import _skeleton_maps
from mentionlake.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.p1_found(table(spark, d, "posts"))


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    return languages.segments(table(spark, d, "posts")).select("post_key", "pos", "lang", "words", F.round("confidence", 4).alias("confidence"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.p4_found(table(spark, d, "posts"))


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    return personal.personal(table(spark, d, "posts")).select("post_key", "pos", "text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return places.p5_found(table(spark, d, "posts"), table(spark, d, "gazetteer"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return repeats.p6_found(table(spark, d, "posts"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return folding.p7_found(table(spark, d, "posts"))


def p7_forms(spark: SparkSession, d: str) -> DataFrame:
    return folding.fold_posts(table(spark, d, "posts")).select("post_key", "caption", "hashtags", "username")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.p8_ids(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.p9_found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.p10_found(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects"), table(spark, d, "eval_items"))


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """How many documents of each source treat each subject."""
    found = p10_found(spark, d)
    return found.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source", "subject").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_segments, p4_found, p4_clean, p5_found, p6_found, p7_found, p7_forms, p8_ids, p9_found, p10_found, p10_composition)
}


def _places_sql() -> str:
    """Problem 5 by comparing every typed value with every name: what the pigeonhole join must find."""
    a, b = (x.replace("'", "''") for x in _skeleton_maps())
    coarse = lambda c: f"lower(translate(regexp_replace({c}, '[\\x{{0300}}-\\x{{036F}}]', '', 'g'), '{a}', '{b}'))"
    key = lambda c: f"regexp_replace({c}, '[^a-z0-9]', '', 'g')"
    county, town, loose = (w.replace("\\\\", "\\") for w in (places.COUNTY_WORDS, places.TOWN_WORDS, places.LOOSE_WORDS))
    without = lambda words: key(f"regexp_replace(part, '{words}', ' ', 'g')")
    borne = f"CASE WHEN least(length(key), length(name)) >= {places.LONG} THEN 2 WHEN least(length(key), length(name)) >= {places.SHORT} THEN 1 ELSE 0 END"
    return f"""WITH typed AS (SELECT post_key, 'location' AS field, location AS value FROM posts UNION ALL SELECT post_key, 'city', city FROM posts UNION ALL SELECT post_key, 'county', county FROM posts),
v AS (SELECT field, value, {coarse('value')} AS v FROM typed WHERE value IS NOT NULL AND regexp_matches(value, '[^\\s\\x{{A0}}\\x{{3000}}\\x{{200B}}\\x{{FEFF}}]') GROUP BY ALL),
s AS (SELECT field, value, CASE WHEN field = 'location' THEN regexp_split_to_array(v, '[,/()|]| - ') ELSE [regexp_replace(v, '[-().]', ' ', 'g')] END AS p FROM v),
m AS (SELECT field, value, pos, part, regexp_matches(part, '{county}') AS marked FROM (SELECT field, value, unnest(p) AS part, generate_subscripts(p, 1) AS pos FROM s)),
c AS (SELECT *, unnest(CASE field WHEN 'city' THEN ['town'] WHEN 'county' THEN ['county'] ELSE CASE WHEN marked THEN ['county'] ELSE ['town', 'county'] END END) AS kind FROM m),
k AS (SELECT * FROM (SELECT field, value, pos, kind, marked, unnest(list_distinct([{key('part')}, {without(loose)}, CASE WHEN kind = 'county' THEN {without(county + '|' + loose)} ELSE {without(town + '|' + loose)} END])) AS key FROM c) WHERE key <> '' AND key NOT IN ({", ".join(f"'{w}'" for w in places.WIDER_PLACES)})),
n AS (SELECT DISTINCT place_id, ord, kind, county_key, name FROM (SELECT place_id, ord, CASE WHEN area_type = 'county' THEN 'county' ELSE 'town' END AS kind, {key(coarse('county'))} AS county_key, unnest(list_transform([display] || coalesce(aliases, []), lambda x: {key(coarse('x'))})) AS name FROM gazetteer) WHERE name <> ''),
h AS (SELECT *, levenshtein(key, name) AS d FROM k JOIN n USING (kind) WHERE abs(length(key) - length(name)) <= 2 AND (levenshtein(key, name) <= {borne} OR (levenshtein(key, name) = 2 AND length(key) = length(name) AND length(key) >= {places.SHORT} AND list_sort(string_split(key, '')) = list_sort(string_split(name, ''))))),
r AS (SELECT field, value, place_id, row_number() OVER (PARTITION BY field, value ORDER BY field = 'location' AND kind = 'county', d, CASE WHEN field = 'location' AND EXISTS (SELECT 1 FROM h g WHERE g.field = h.field AND g.value = h.value AND g.kind = 'county' AND g.pos <> h.pos AND g.county_key = h.county_key) THEN 0 ELSE 1 END, pos, ord) AS i FROM h WHERE NOT (field = 'location' AND kind = 'county' AND NOT marked))
SELECT t.post_key, t.field, coalesce(r.place_id, -1)::INTEGER AS place_id FROM typed t JOIN v USING (field, value) LEFT JOIN r ON r.field = t.field AND r.value = t.value AND r.i = 1"""


#: The others are held against brute force, exact round trips and held-out rows by the tests: models, and
#: rules over whole texts, are beyond the SQL of the checking engine.
ORACLES: dict[str, str] = {"p5_found": _places_sql()}
