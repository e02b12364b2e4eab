"""The pipeline on small, odd and empty tables, and its stages against plain versions of what they decide."""

import random
import re

import corpus_pipeline
import pytest

from quire.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th long, row string, own int, g int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Writes documents and a benchmark, and gives the folder."""

    def make(rows, items):
        path = str(tmp_path_factory.mktemp("corpus"))
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        return path

    return make


def words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def corpus():
    """Clean texts, and of each kind some that a stage must drop: short ones, repetitive ones, copies, near copies, leaks, repeated lines."""
    rng = random.Random(11)
    item = " ".join(words(rng, 40))
    notice = " ".join(words(rng, 12))
    kinds, rows = {}, []

    def add(kind, text, n=9):
        kinds[len(rows)] = kind
        rows.append((len(rows), text, "en", f"s{len(rows) % 3}", len(text or ""), 1, "r", 2, 3))

    body = lambda n: "\n".join(" ".join(words(rng, 20)) for _ in range(n // 20))
    for i in range(60):
        add("clean", body(200))
    for i in range(8):
        text = rows[i][1]
        add("copy", text)
        lines = text.split("\n")
        lines[i] = lines[i].replace(" ", " changed ", 1)
        add("near", "\n".join(lines))
        add("leak", body(100) + "\n" + item + "\n" + body(100))
        add("notice", body(180) + "\n" + notice)
        add("short", " ".join(words(rng, 20)))
        add("looped", "one two three four " * 40)
    add("null", None)
    add("empty", "")
    rows.append(rows[0])
    return rows, kinds, item, notice


def test_stages_drop_what_they_are_for(spark, folder):
    rows, kinds, item, notice = corpus()
    path = folder(rows, [(1, item), (2, None)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.schema == docs.schema
        left[name] = out.collect()
        docs = spark.createDataFrame(left[name], docs.schema)
    ids = {k: [r["doc_id"] for r in v] for k, v in left.items()}
    of = lambda kind: {i for i, k in kinds.items() if k == kind}
    assert not set(ids["quality_rules"]) & (of("short") | of("looped") | of("null") | of("empty"))
    assert set(ids["quality_rules"]) >= of("clean") | of("copy") | of("near") | of("leak") | of("notice") and ids["quality_rules"].count(0) == 2
    # A copy loses all its lines, and so does one that differs by a word.
    after = {r["doc_id"]: r for r in left["line_dedup"]}
    assert not set(after) & (of("copy") | of("near"))
    assert sum(notice in r["text"] for r in after.values()) == 1 and sum(item in r["text"] for r in after.values()) == 1
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    assert sorted(ids["ngram_jaccard_join"]) == sorted(set(ids["line_dedup"]))
    assert set(ids["ngram_jaccard_join"]) - set(ids["benchmark_decontamination"]) == {min(of("leak"))}
    packed = corpus_pipeline.run(spark, path).collect()
    want = {r["doc_id"]: len(WORD.findall(r["text"])) for r in left["benchmark_decontamination"]}
    got = {}
    for r in packed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_words"]
    assert got == want


def test_an_empty_corpus(spark, folder):
    path = folder([], [])
    assert corpus_pipeline.run(spark, path).count() == 0
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).count() == 0


def test_odd_rows_pass_each_stage(spark, folder, odd_docs):
    path = folder([], [(1, "x y z"), (None, "a"), (3, None)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd_docs, path)
        assert out.columns == odd_docs.columns and out.count() <= odd_docs.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, odd_docs, path).count() >= odd_docs.count()
    assert quality_rules.kept(odd_docs).columns == odd_docs.columns
