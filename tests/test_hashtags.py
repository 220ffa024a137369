import re
from collections import Counter

from mentionlake.plans import catalogue


def test_top_tags_of_all_letters(spark, tmp_path):
    captions = ["#été #Straße #дорога", "#ÉTÉ #été #طريق!", "#qualité, #road_1 #дорога", "#straße #طريق #été", None, "# no tag", "#été#дорога"]
    spark.createDataFrame(list(enumerate(captions)), "post_key bigint, caption string").write.parquet(str(tmp_path / "posts.parquet"))
    counts = Counter(t for c in captions for t in {t.lower() for t in re.findall(r"#(\w+)", c or "")})
    got = [tuple(r) for r in catalogue.QUERIES["hashtag_top10"](spark, str(tmp_path)).select("tag", "posts").collect()]
    assert got == sorted(counts.items(), key=lambda x: (-x[1], x[0])) and got[0] == ("été", 4)
