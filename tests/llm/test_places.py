from mentionlake.llm import places

G = [(1, 1, "ulmstadt", "Ulmstadt", "Alpha", "urban", ["ULMS", "Old Bridge City"]), (2, 2, "alpha", "Alpha", "Alpha", "county", None), (3, 3, "twinford", "Twinford", "Alpha", "rural", []), (4, 4, "twinford", "Twinford", "Betaland", "rural", []), (5, 5, "betaland", "Betaland", "Betaland", "county", []), (6, 6, "alpha", "Alpha", "Alpha", "urban", [])]
GS = "place_id int, ord int, place_key string, display string, county string, area_type string, aliases array<string>"


def found(spark, rows, g=G):
    posts = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "post_key bigint, location string, city string, county string")
    return {(r.post_key, r.field): r.place_id for r in places.p5_found(posts, spark.createDataFrame(g, GS)).collect()}


def test_values(spark):
    rows = [("Ulmstadt, Alpha County", " ULMSTADT-CBD", "County of Alpha"), ("mtaani Ulmsatdt", "Ulmstdt town", "alphaa"), ("Twinford - Betaland", "ulms", "Beltaand co."), ("Alpha", None, " "), ("somewhere in Alpha County", "cloud nine", "N/A"), ("Betaland County, Twinford", "Old Bridge City", "Bëtaland"), ("\U0001f4cd Ülmstadt, KE", "", None)]
    got = found(spark, rows)
    assert got == {
        (0, "location"): 1, (0, "city"): 1, (0, "county"): 2, (1, "location"): 1, (1, "city"): 1, (1, "county"): 2, (2, "location"): 4, (2, "city"): 1, (2, "county"): 5, (3, "location"): 6,
        (4, "location"): 2, (4, "city"): -1, (4, "county"): -1, (5, "location"): 4, (5, "city"): 1, (5, "county"): 5, (6, "location"): 1,
    }


def test_empty(spark):
    assert found(spark, [(None, "", "  ")]) == {}
    assert found(spark, [("Ulmstadt", None, None)], [(9, 9, "q", "Q", "Q", "county", None)]) == {(0, "location"): -1}


def test_pigeonhole_misses_nothing(spark):
    import random

    r = random.Random(4)
    names = ["".join(r.choice("abcdo") for _ in range(r.randint(3, 11))) for _ in range(25)]
    g = [(i, i, n, n, "Zzz", "urban", []) for i, n in enumerate(names)]

    def edit(w):
        p = r.randrange(len(w))
        return r.choice([w[:p] + w[p + 1 :], w[:p] + r.choice("abcdo") + w[p:], w[:p] + r.choice("abcdo") + w[p + 1 :]])

    typed = [edit(r.choice(names)) for _ in range(80)] + [edit(edit(r.choice(names)) or "x") for _ in range(60)]
    typed = [t for t in typed if t]
    got = found(spark, [(None, t, None) for t in typed], g)

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a):
            new = [i + 1]
            for j, e in enumerate(b):
                new.append(min(row[j] + (c != e), row[j + 1] + 1, new[-1] + 1))
            row = new
        return row[-1]

    for i, t in enumerate(typed):
        borne = lambda n: 2 if min(len(t), len(n)) >= 6 else 1 if min(len(t), len(n)) >= 4 else 0  # noqa: E731, B023
        near = {n: lev(t, n) for n in names if lev(t, n) <= borne(n) or (lev(t, n) == 2 and len(t) == len(n) >= 4 and sorted(t) == sorted(n))}
        assert (got[(i, "city")] >= 0) == bool(near) and (not near or near[names[got[(i, "city")]]] == min(near.values()))


def test_short_names_and_two_edits(spark):
    g = [(1, 1, "thika", "Thika", "Alpha", "urban", []), (2, 2, "abc", "Abc", "Alpha", "urban", []), (3, 3, "ulmstadt", "Ulmstadt", "Alpha", "urban", [])]
    got = found(spark, [(None, t, None) for t in ("Thikka", "Thka", "Thiak", "Thk", "Abd", "Abc", "Umlstad", "Ulstat", "Ulmxxxdt")], g)
    assert [got[(i, "city")] for i in range(9)] == [1, 1, 1, -1, -1, 2, -1, 3, -1]
