"""Every operator gives its defined result for odd rows and for empty tables."""

import pytest
from pyspark.sql import functions as F

from quire.llm import decontaminate, html_extract, language_id, line_dedup, ngram_join, packing, quality_rules, sharding, toxicity, warc


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 1), (5, 1, 0), (6, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, None), (2, ""), (None, "x y"), (3, "a b c d e f g h i j k l m n o p")], "item_id long, text string")


@pytest.fixture(scope="module")
def odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "http://[bad", "<p>a"), (None, "http://x.org/a?b=1&a=2#f", "<p>b</p>"), (5, "http://x.org/a", "plain & simple"), (5, "http://x.org/a", "plain & simple"), (6, "http://x.org/b\r\nX: y", "<p>" + "long " * 50_000), (7, "http://y.org", "<script>x"), (8, "http://y.org", "< 5 <b")]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, run int")


@pytest.fixture(scope="module")
def no_pages(spark):
    return spark.createDataFrame([], "page_id long, url string, html string")


@pytest.mark.parametrize("op", [quality_rules.quality_rules, ngram_join.near_duplicates, sharding.shard_digest, language_id.language_id, line_dedup.line_dedup])
def test_a_row_for_every_row(op, odd_docs, no_docs):
    assert op(odd_docs).count() == odd_docs.count()
    assert op(no_docs).count() == 0


def test_quality_of_odd_rows(odd_docs):
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(odd_docs).collect()}
    assert rows[0]["n_words"] == 0 and rows[0]["base_failed"] and not rows[0]["kept"] and rows[1]["n_dup_lines"] == 0
    assert rows[15]["n_repeat_words"] == 60 and rows[15]["base_failed"]


def test_near_duplicates_of_odd_rows(odd_docs):
    rows = {r["doc_id"]: r for r in ngram_join.near_duplicates(odd_docs).collect() if r["doc_id"] is not None}
    assert rows[0]["n_shingles"] == 0 and rows[0]["component_id"] == 0 and rows[2]["component_id"] == 2
    assert {rows[i]["component_id"] for i in (6, 7, 8, 9)} == {6}
    assert rows[4]["n_shingles"] == 1 and rows[5]["component_id"] == 5
    assert ngram_join.one_of_each(odd_docs).where("doc_id in (6, 7, 8, 9)").count() == 1


def test_lines_of_odd_rows(odd_docs):
    rows = {r["doc_id"]: r for r in line_dedup.line_dedup(odd_docs).collect() if r["doc_id"] is not None}
    assert rows[0]["text"] is None and rows[0]["n_lines"] == 0 and rows[1]["n_lines"] == 1 and rows[1]["text"] == ""
    assert rows[12]["n_dropped"] == 8 and rows[11]["n_dropped"] == 0 and rows[7]["text"] == ""
    kept = line_dedup.without_repeated_lines(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id = 7").count() == 0 and kept.where("doc_id = 1").count() == 1


def test_shards_of_odd_rows(odd_docs):
    rows = sharding.shard_digest(odd_docs, shards=3).collect()
    assert sorted(r["size"] for r in rows)[0] == 16
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_languages_of_odd_rows(odd_docs, spark):
    rows = {r["doc_id"]: r for r in language_id.language_id(odd_docs).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (0, 1, 2, 3, 13, 14))
    assert rows[6]["lang_pred"] != "und" and 0 <= rows[6]["score"] <= 1
    bare = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.language_id(bare).collect()} == {"und"}


def test_toxicity_of_odd_rows(odd_docs, no_docs, labels, spark):
    rows = toxicity.toxicity(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.toxicity(no_docs, labels).count() == 0
    none = spark.createDataFrame([], labels.schema)
    assert toxicity.toxicity(odd_docs, none).where("score is null").count() == 0


def test_decontamination_of_odd_rows(odd_docs, no_docs, benchmark, spark):
    assert decontaminate.contaminated(odd_docs, benchmark).count() == 0
    assert decontaminate.contaminated(no_docs, benchmark).count() == 0
    kept = decontaminate.clean(odd_docs, spark.createDataFrame([], benchmark.schema))
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_packing_of_odd_rows(odd_docs, no_docs):
    rows = packing.pack(odd_docs, capacity=64).collect()
    assert {r["doc_id"] for r in rows if r["bin"] is None} >= {0, 1, 2, 3}
    assert sum(r["n_words"] for r in rows if r["doc_id"] == 10) == 24_000
    assert packing.pack(no_docs).count() == 0


def test_pages(odd_pages, no_pages):
    out = html_extract.extract(odd_pages).collect()
    assert len(out) == odd_pages.count() and all(r["n_chars"] == len(r["text"]) for r in out)
    texts = {r["page_id"]: r["text"] for r in out}
    assert texts[1] == "" and texts[5] == "plain & simple" and texts[7] == "" and texts[3] == "a" and len(texts[6]) == 249_999
    assert html_extract.extract(no_pages).count() == 0
    rows = warc.warc_digest(odd_pages).collect()
    assert len(rows) == odd_pages.count()
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in rows if r["page_id"] in (1, 2, 5)} == {(1, "response", None), (2, "revisit", 1), (5, "response", None)}
    assert warc.warc_digest(no_pages).count() == 0
