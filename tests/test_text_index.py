"""The persisted index ranks as the search that reads the text, and repeats or failures of appends add nothing."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import search, text_index
from palimpsest.operators.text_index import TextIndex

FIELDS = {"title": "A", "heading": "B", "text": "C"}
QUERIES = ["alpha", "alpha beta", "alpha or gamma", '"beta gamma"', 'alpha -"beta gamma"', "delta -alpha", '"alpha beta alpha"', "missing alpha", "-alpha", "", None,
           "beta beta", '"head word1" or "word2 beta"']


def sections(spark, n, start=0):
    words = ["alpha", "beta", "gamma", "delta", "word1", "word2", "Épsilon"]
    rows = []
    for i in range(start, start + n):
        text = " ".join(words[(i * k * k + k + i // 5) % 7] for k in range(1 + i % 9)) if i % 11 else ("" if i % 2 else None)
        rows.append((f"{i}:1", f"d{i % 13}", ["alpha beta", "Delta", None][i % 3], "head word1" if i % 4 == 0 else "", text))
    return spark.createDataFrame(rows, "section_id string, identity_id string, title string, heading string, text string")


def asked(spark):
    return spark.createDataFrame(list(enumerate(QUERIES)), "query_id bigint, query string")


@pytest.mark.parametrize("limit", [3, 300])
def test_index_ranks_like_the_text_search(spark, tmp_path, rows, monkeypatch, limit):
    monkeypatch.setattr(text_index, "FIRST_BLOCKS", 2)
    monkeypatch.setattr(text_index, "WORTHWHILE", 1)
    corpus = sections(spark, 200)
    index = TextIndex(spark, str(tmp_path / "ix"), FIELDS, ("identity_id",), buckets=5).add(corpus, "b0", block_rows=16)
    cols = ("query_id", "section_id", "text_score", "text_rank")
    want = rows(search.full_text(corpus, asked(spark), FIELDS, limit), *cols)
    assert rows(index.search(asked(spark), limit), *cols) == want and len(want) > 3
    few = corpus.filter(F.col("identity_id").isin("d1", "d4"))
    want = rows(search.full_text(few, asked(spark), FIELDS, limit), *cols)
    assert rows(index.search(asked(spark), limit, few), *cols) == want


def test_appends_read_only_new_sections_and_repeat_safely(spark, tmp_path, rows):
    index = TextIndex(spark, str(tmp_path / "ix"), FIELDS, ("identity_id",), buckets=3).add(sections(spark, 60), "b0")
    index.add(sections(spark, 40, 60), "b1").add(sections(spark, 40, 60), "b1")
    whole = sections(spark, 60).unionByName(sections(spark, 40, 60))
    cols = ("query_id", "section_id", "text_score", "text_rank")
    assert index.batches() == ["b0", "b1"] and index.members.count() == 100
    assert rows(index.search(asked(spark), 20), *cols) == rows(search.full_text(whole, asked(spark), FIELDS, 20), *cols)


def test_a_batch_that_was_not_finished_is_not_read_and_can_be_added_again(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "ix"), FIELDS, buckets=3).add(sections(spark, 30), "b0")
    index.add(sections(spark, 30, 30), "b1")
    (tmp_path / "ix" / "b1" / "tops" / "_SUCCESS").unlink()
    assert index.batches() == ["b0"] and index.members.count() == 30
    assert index.add(sections(spark, 30, 30), "b1").members.count() == 60


def test_a_search_reads_no_section_text(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "ix"), FIELDS, buckets=3).add(sections(spark, 30), "b0")
    files = index.search(asked(spark)).inputFiles()
    assert any("/postings/" in f for f in files)
    assert all("/postings/" in f or "/index-clauses-" in f or "/index-blocks-" in f or "/index-bar-" in f for f in files)


def test_empty_corpus_and_empty_query_table(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "ix"), FIELDS, buckets=3).add(sections(spark, 30), "b0")
    assert index.search(asked(spark).limit(0)).count() == 0
    bare = TextIndex(spark, str(tmp_path / "none"), FIELDS, buckets=3).add(sections(spark, 30).limit(0), "b0")
    assert bare.search(asked(spark)).count() == 0
