import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mentionlake.llm import folding


def fold(*texts, whole=False):
    out, held = folding.fold_array(pa.array(texts, pa.string()), whole)
    return out.to_pylist(), held.tolist()


def test_cases_and_others():
    texts = ["plain", None, "", "ｆｕｌｌ", "été", "a​b", "a b", "pаy", "дорога", "été", "👨‍👩‍👧 ❤️", "a­b", "tab\tnew\nline", "ن‌م", "#пa"]
    out, held = fold(*texts)
    assert out == ["plain", None, "", "full", "été", "ab", "a b", "pay", "дорога", "été", "👨‍👩‍👧 ❤️", "ab", "tab\tnew\nline", "ن‌م", "#пa"]
    assert held == [False, False, False, True, True, True, True, True, False, False, False, True, False, False, False]


def test_a_user_name_is_one_word():
    assert fold("soko.о.line", whole=True)[1] == [True]


def test_several_marks_and_long_text():
    out, held = fold("ấx", "q́", "y" * 200_000 + "​")
    assert out[0] == unicodedata.normalize("NFC", "ấx") and out[1] == "q́" and held == [True] * 3 and len(out[2]) == 200_000


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aé ｂ​́̈ ад_1👩‍　ﬁ\n", max_size=12), max_size=8))
def test_rows_do_not_meet_and_folding_is_final(texts):
    alone = [fold(t)[0][0] for t in texts]
    assert fold(*texts)[0] == alone
    assert [fold(t)[0][0] for t in alone] == alone


def test_found(spark):
    posts = spark.createDataFrame([(1, "a​", ["#ok"], "me"), (2, None, None, None), (3, "x", ["#%C3%A9t%C3%A9", None, "#ａ"], "uа"), (4, "", [], "")], "post_key bigint, caption string, hashtags array<string>, username string")
    assert sorted(map(tuple, folding.p7_found(posts).collect())) == [(1, "caption"), (3, "hashtags"), (3, "username")]
    forms = {r.post_key: r for r in folding.fold_posts(posts).collect()}
    assert forms[3].hashtags == ["#été", None, "#a"] and forms[2].hashtags is None and forms[4].hashtags == []
    assert folding.p7_found(posts.where("false")).count() == 0


def test_skeleton(spark):
    assert spark.range(1).select(folding.skeleton(F.lit("É́ｆа ​X")).alias("s")).first().s == "efa x"
