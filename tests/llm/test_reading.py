import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import reading
from ledgerloom.llm.reading import reading_levels, text_nodes, word_nodes

DATA = "/root/testdata/sf0.1"


def test_edges_of_texts():
    assert text_nodes("") == ({}, {}) and text_nodes("123 !!")[0] == {}
    words, features = text_nodes("One two two. Three")
    assert set(words) == {"one", "two", "three"} and words["two"] > words["one"] and set(features) == {"sentence", "word", "long", "comma"}


def test_cases(spark):
    docs = spark.createDataFrame([(1, "easy cat dog. cat sat.", "x"), (2, "notwithstanding jurisdictional considerations, the aforementioned stipulations", "x"), (3, "cat dog sat easy.", "x"), (4, None, "x"), (5, "", "x"), (5, "", "x"), (6, "notwithstanding aforementioned jurisdictional stipulations, the considerations", "x")], "doc_id long, text string, grade string")
    labels = spark.createDataFrame([(1, "a", 1), (2, "a", 5), (2, "b", 4), (9, "a", 3), (None, "a", 2), (3, "a", None)], "doc_id long, rater string, grade int")
    out = [r.asDict() for r in reading_levels(docs, labels).collect()]
    level = {r["doc_id"]: r["level"] for r in out}
    assert len(out) == 7 and level[1] == 1.0 and level[2] == 4.5 and level[4] is None and level[5] is None and level[3] < 2.5 < level[6]
    assert {r["doc_id"] for r in out if r["graded"]} == {1, 2}
    assert all(r["level"] is None for r in reading_levels(docs, labels.limit(0)).collect())
    assert reading_levels(docs.limit(0), labels).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_held_out_grades(spark):
    """A third of the graded documents of the test tables, never shown, is graded within a third of a grade on average."""
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "grade_labels"))
    out = reading_levels(docs, labels.where("pmod(doc_id, 3) <> 0"))
    truth = labels.where("pmod(doc_id, 3) = 0").groupBy("doc_id").agg(F.avg("grade").alias("grade"))
    j = out.join(truth, "doc_id").toPandas()
    assert len(j) > 100 and not j["graded"].any()
    assert np.corrcoef(j["level"], j["grade"])[0, 1] > 0.92 and (j["level"] - j["grade"]).abs().mean() < 0.36


def test_nodes_are_bounded_by_their_share(spark, monkeypatch):
    df = spark.createDataFrame([(1, "alpha beta beta"), (2, "Alpha beta gamma"), (3, None)], "doc_id long, text string")
    assert len(word_nodes(df, "text")) == 2  # gamma stands once
    monkeypatch.setattr(reading, "SHARE", 2)
    assert len(word_nodes(df, "text")) == 1 and len(word_nodes(df.limit(0), "text")) == 0


def test_words_beyond_the_share_count_alike(spark, monkeypatch):
    """Whether a word's level lies in arrays or in tables must not show: every word that occurs twice takes part."""
    texts = ["easy cat dog. cat sat, mat.", "notwithstanding jurisdictional considerations, the aforementioned stipulations", "cat dog sat easy. once", "", None, "aforementioned stipulations, the easy cat", "mat mat dog sat.", "jurisdictional considerations lonely lonely"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(2, "the dog sat, the mat")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 5), (1, 4), (6, 2)], "doc_id long, grade int")
    found = lambda: sorted((r["doc_id"], r["level_band"] or 0, r["level"] or 0.0, r["support"], r["graded"]) for r in reading_levels(docs, labels).collect())
    whole = found()
    for share in (15, 2, 0.1):  # some words in tables, most, all
        monkeypatch.setattr(reading, "SHARE", share)
        part = found()
        assert [(r[0], r[1], r[4]) for r in part] == [(r[0], r[1], r[4]) for r in whole]
        assert np.allclose([r[2:4] for r in part], [r[2:4] for r in whole], atol=1e-6)
