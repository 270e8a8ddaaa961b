"""Behaviour of retrieval on hand-made vectors and texts."""

import math

import pytest
from pyspark.sql import functions as F

from quillon.operators import search as S


def hits(spark, chunks, query, config, threshold=None):
    rows = spark.createDataFrame(chunks, "chunk_id string, doc_id string, ord long, text string, v array<double>")
    asked = spark.createDataFrame([(1, *query)], "query_id long, question string, v array<double>")
    known = {"chunk_id": rows, "query_id": asked}
    found = S.search(rows, asked, config, threshold, embed=lambda df, i, t: known[i].join(df.select(i), i, "left_semi").select(i, "v"))
    return [(r.chunk_id, round(r.score, 3), r.vector_rank, r.bm25_rank, round(r.cosine, 3)) for r in found.orderBy("rank").collect()]


THREE = [("a", "d1", 1, "x", [1.0, 0.0]), ("b", "d2", 2, "x", [0.5, 0.866]), ("c", "d3", 3, "x", [0.0, 1.0])]


def test_vector_order_and_no_default_threshold(spark):
    found = hits(spark, THREE, ("q", [1.0, 0.0]), S.SearchConfig(strategy="vector", top_k=3))
    assert [(h[0], round(h[1], 2)) for h in found] == [("a", 1.0), ("b", 0.5), ("c", 0.0)]


def test_threshold_applies_to_hybrid(spark):
    found = hits(spark, THREE, ("q", [1.0, 0.0]), S.SearchConfig(), 0.55)
    assert [h[0] for h in found] == ["a"]


def test_quota(spark):
    chunks = [("a1", "a", 1, "x", [1.0, 0.0]), ("a2", "a", 2, "x", [0.99, 0.141]), ("a3", "a", 3, "x", [0.98, 0.199]), ("b4", "b", 4, "x", [0.9, 0.436])]
    assert [h[0] for h in hits(spark, chunks, ("q", [1.0, 0.0]), S.SearchConfig(strategy="vector", top_k=4))] == ["a1", "a2", "b4"]


def test_hybrid_lifts_the_rare_term(spark):
    chunks = [("A", "A", 1, "甲", [0.5, 0.866]), ("B", "B", 2, "乙", [0.4, 0.9165]), ("lex", "C", 3, "含罕见词 XYZ 的资料", [0.3, 0.954])]
    chunks += [(f"f{i}", f"f{i}", 3 + i, "填充内容", [0.0, 1.0]) for i in range(1, 28)]
    query = ("罕见词 XYZ", [1.0, 0.0])
    assert [h[0] for h in hits(spark, chunks, query, S.SearchConfig(strategy="vector", top_k=3))] == ["A", "B", "lex"]
    first = hits(spark, chunks, query, S.SearchConfig(top_k=3, candidate_pool=3), 0.0)[0]
    assert first[0] == "lex" and first[2:4] == (3, 1) and first[4] == 0.3


def test_blank_question_has_no_hits_and_bad_settings_are_refused(spark):
    assert hits(spark, THREE, (" \t", [1.0, 0.0]), S.SearchConfig()) == []
    for wrong in ({"strategy": "x"}, {"top_k": 0}, {"threshold": 2.0}, {"candidate_pool": 1}):
        with pytest.raises(ValueError):
            S.SearchConfig(**wrong)


def test_bm25_finds_the_only_match(spark):
    docs = [(0, "【川崎病】定义：儿童急性血管炎。")] + [(i, f"【疾病{i}】定义：某种疾病，症状与治疗如下。") for i in range(1, 20)]
    chunks = spark.createDataFrame([(i, i, i, t) for i, t in docs], "chunk_id long, doc_id long, ord long, text string")
    asked = spark.createDataFrame([(1, "川崎病")], "query_id long, question string")
    assert [r.chunk_id for r in S.bm25_top(S.bm25_scores(chunks, asked), 10).collect()] == [0]


def test_zero_vector_stays_zero(spark):
    row = spark.range(1).select(S.l2_normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("z"), S.l2_normalize(F.array(F.lit(3.0), F.lit(4.0))).alias("u")).first()
    assert row.z == [0.0, 0.0] and math.isclose(row.u[0], 0.6)
