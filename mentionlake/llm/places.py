"""Typed places mapped to the gazetteer by a pigeonhole join (problem 5), in SQL alone.

Distinct values are matched once and joined back.  A value is cut into parts; of each part
the words that say what kind of place it is are set aside and letters are brought to a
coarse form.  A name within ``k`` edits of a reference name keeps at least one of k + 1
segments of it unchanged, at most k places away: so the segments of the names meet the
substrings of the keys in an equality join, and ``levenshtein`` verifies what remains.
An anti-join reports the values that met nothing, as place -1.

A match is an equal key, or one within as many edits as the shorter of both bears: two from
``LONG`` letters on, one from ``SHORT`` on, none below; two neighbouring letters changed over
count as one.  Ties go to the fewer edits, then to the town
whose county stands beside it, then to the earlier part, then to the gazetteer's order.
Null and blank values give no row; repeated rows are kept apart by their key only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from mentionlake.llm.folding import _skeleton_maps
from mentionlake.session import cut, small

K = 2
#: Letters from which a name bears one edit, and two (changing over two letters counts as one).
SHORT, LONG = 4, 6
# Words around a place that are no part of its name (coarse form).
COUNTY_WORDS = r"\\b(county of|kaunti ya|comte de|county|cnty|kaunti|comte|co)\\b"
TOWN_WORDS = r"\\b(city of|mji wa|city|town|municipality|cbd)\\b"
LOOSE_WORDS = r"\\b(somewhere in|greater|area|from|with love|bei|mtaani|pres de|near)\\b"
WIDER_PLACES = ("ke", "kenya", "eastafrica", "africa")


def _coarse(c: str) -> str:
    # Braces would be read as parameters of the statement; they are no part of a name.
    a, b = (x.replace("\\", "\\\\").replace("'", "\\'").replace("{", "(").replace("}", ")") for x in _skeleton_maps())
    return f"lower(translate(regexp_replace({c}, '[\\\\u0300-\\\\u036F]', ''), '{a}', '{b}'))"


def _key(c: str) -> str:
    return f"regexp_replace({c}, '[^a-z0-9]', '')"


VALUES = """
SELECT field, value, {coarse} AS v FROM (
  SELECT stack(3, 'location', location, 'city', city, 'county', county) AS (field, value) FROM {{posts}}
) WHERE value IS NOT NULL AND value RLIKE '[^\\\\s\\\\u00A0\\\\u3000\\\\u200B\\\\uFEFF]' GROUP BY field, value
""".format(coarse=_coarse("value"))

PARTS = f"""
SELECT field, value, pos, kind, marked, key FROM (
  SELECT field, value, pos, marked,
    explode(CASE field WHEN 'city' THEN array('town') WHEN 'county' THEN array('county')
            ELSE CASE WHEN marked THEN array('county') ELSE array('town', 'county') END END) AS kind, part
  FROM (
    SELECT field, value, pos, part, part RLIKE '{COUNTY_WORDS}' AS marked FROM (
      SELECT field, value, posexplode(CASE WHEN field = 'location' THEN split(v, '[,/()|]| - ') ELSE array(regexp_replace(v, '[-().]', ' ')) END) AS (pos, part) FROM {{values}}
    )
  )
) LATERAL VIEW explode(array_distinct(array(
    {_key("part")},
    {_key(f"regexp_replace(part, '{LOOSE_WORDS}', ' ')")},
    {_key(f"regexp_replace(part, CASE WHEN kind = 'county' THEN '{COUNTY_WORDS}|{LOOSE_WORDS}' ELSE '{TOWN_WORDS}|{LOOSE_WORDS}' END, ' ')")}
  ))) AS key
WHERE key <> '' AND key NOT IN ({", ".join(f"'{w}'" for w in WIDER_PLACES)})
"""

NAMES = f"""
SELECT place_id, ord, kind, county_key, name, length(name) AS len FROM (
  SELECT place_id, ord, CASE WHEN area_type = 'county' THEN 'county' ELSE 'town' END AS kind, {_key(_coarse("county"))} AS county_key,
    explode(array_distinct(transform(concat(array(display), coalesce(aliases, array())), a -> {_key(_coarse("a"))}))) AS name
  FROM {{gazetteer}}
) WHERE name <> '' GROUP BY place_id, ord, kind, county_key, name
"""

#: Segment i of a name of length L begins after floor(i L / (k + 1)) letters.
SEGMENTS = f"""
SELECT kind, name, len, i, substring(name, a + 1, b - a) AS seg FROM (
  SELECT kind, name, len, i, CAST(floor(i * len / {K + 1}) AS INT) AS a, CAST(floor((i + 1) * len / {K + 1}) AS INT) AS b
  FROM (SELECT DISTINCT kind, name, len FROM {{names}} WHERE len >= {SHORT - 1}) LATERAL VIEW explode(sequence(0, {K})) AS i
)
"""

PROBES = f"""
SELECT DISTINCT kind, key, len, i, substring(key, p, b - a) AS seg FROM (
  SELECT kind, key, len, i, a, b, explode(sequence(greatest(a + 1 - {K}, 1), greatest(least(a + 1 + {K}, length(key) - (b - a) + 1), 1))) AS p FROM (
    SELECT kind, key, len, i, CAST(floor(i * len / {K + 1}) AS INT) AS a, CAST(floor((i + 1) * len / {K + 1}) AS INT) AS b
    FROM (SELECT DISTINCT kind, key FROM {{parts}} WHERE length(key) >= {SHORT - 1})
    LATERAL VIEW explode(sequence(greatest(length(key) - {K}, {SHORT - 1}), length(key) + {K})) AS len LATERAL VIEW explode(sequence(0, {K})) AS i
  )
)
"""

MATCHES = f"""
SELECT kind, key, name, d FROM (
  SELECT kind, key, name, levenshtein(key, name, {K}) AS d FROM (
    SELECT DISTINCT p.kind, p.key, s.name FROM {{probes}} p JOIN {{segments}} s ON p.kind = s.kind AND p.len = s.len AND p.i = s.i AND p.seg = s.seg
  )
) WHERE d BETWEEN 0 AND CASE WHEN least(length(key), length(name)) >= {LONG} THEN 2 WHEN least(length(key), length(name)) >= {SHORT} THEN 1 ELSE 0 END
  OR (d = 2 AND length(key) = length(name) AND length(key) >= {SHORT} AND array_sort(split(key, '')) = array_sort(split(name, '')))
UNION
SELECT DISTINCT p.kind, p.key, n.name, 0 AS d FROM {{parts}} p JOIN {{names}} n ON p.kind = n.kind AND p.key = n.name
"""

RESOLVED = """
WITH hits AS (
  SELECT p.field, p.value, p.pos, p.kind, p.marked, m.name, m.d, n.place_id, n.ord, n.county_key
  FROM {parts} p JOIN {matches} m ON p.kind = m.kind AND p.key = m.key JOIN {names} n ON m.kind = n.kind AND m.name = n.name
), beside AS (
  SELECT field, value, collect_set(struct(pos, county_key)) AS counties FROM hits WHERE field = 'location' AND kind = 'county' GROUP BY field, value
), ranked AS (
  SELECT h.field, h.value, struct(
      CASE WHEN h.field = 'location' AND h.kind = 'county' THEN 1 ELSE 0 END AS second, h.d,
      CASE WHEN exists(b.counties, c -> c.pos <> h.pos AND c.county_key = h.county_key) THEN 0 ELSE 1 END AS apart, h.pos, h.ord) AS rank, h.place_id
  FROM hits h LEFT JOIN beside b ON h.field = b.field AND h.value = b.value
  WHERE NOT (h.field = 'location' AND h.kind = 'county' AND NOT h.marked)
)
SELECT field, value, min_by(place_id, rank) AS place_id FROM ranked GROUP BY field, value
"""

UNMATCHED = """
SELECT v.field, v.value, -1 AS place_id FROM {values} v LEFT ANTI JOIN {resolved} r ON v.field = r.field AND v.value = r.value
"""

FOUND = """
SELECT p.post_key, p.field, m.place_id FROM (
  SELECT post_key, stack(3, 'location', location, 'city', city, 'county', county) AS (field, value) FROM {posts}
) p JOIN {mapped} m ON p.field = m.field AND p.value = m.value
"""


def map_places(posts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(field, value, place_id) of every distinct value; -1 where nothing matches."""
    sql = posts.sparkSession.sql
    # Written once: each is read by several of the statements below.
    values = cut(sql(VALUES, posts=posts), "values")
    parts = cut(sql(PARTS, values=values), "parts")
    names = cut(sql(NAMES, gazetteer=gazetteer), "names")
    segments = small(sql(SEGMENTS, names=names))
    matches = cut(sql(MATCHES, probes=sql(PROBES, parts=parts), segments=segments, parts=parts, names=names), "matches")
    resolved = cut(sql(RESOLVED, parts=parts, matches=matches, names=names), "resolved")
    return resolved.union(sql(UNMATCHED, values=values, resolved=resolved))


def p5_found(posts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(post_key, field, place_id): one row for each value that is not null or blank."""
    mapped = small(map_places(posts, gazetteer))
    return posts.sparkSession.sql(FOUND, posts=posts, mapped=mapped)
