import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mentionlake.llm import tokens as K

pytestmark = pytest.mark.skipif(not os.path.exists(K.VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {bytes.fromhex(k): v for k, v in K._ranks(K.VOCABULARY).items()}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


ODD = ["", None, " ", "a  b\n\n c\t", "it's IT'S we'll 12½", "été 👨‍👩‍👧", "<|endoftext|>", "日本語　です", "\x1c\x85 x", "a" * 300, "🏾" * 40, "नमस्ते", "﻿x​", "same", "same"]


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: (list(r.ids), r.back) for r in K.p8_ids(df).select("doc_id", "ids", K.decode(F.col("ids")).alias("back")).collect()}


def test_odd_texts(spark, reference):
    got = run(spark, ODD)
    assert len(got) == len(ODD)
    for i, t in enumerate(ODD):
        assert got[i][0] == reference.encode_ordinary(t or "") and got[i][1] == (t or "")


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30), min_size=1, max_size=30))
def test_any_text(spark, reference, texts):
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    got = run(spark, texts) if texts else {}
    for i, t in enumerate(texts):
        assert got[i][1] == t


def test_whole_table(spark, reference, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: list(r.ids) for r in K.p8_ids(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert all(got[r.doc_id] == reference.encode_ordinary(r.text or "") for r in rows) and len(got) == len(rows)
    assert K.p8_ids(docs.where("false")).count() == 0
