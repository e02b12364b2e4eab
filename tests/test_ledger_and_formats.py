import random

import pytest
from pyspark.sql import functions as F

from quire.operators import evaluate, settings
from quire.operators.ledger import Account, balances, settled
from quire.sources import formats as f


def test_account_rules():
    a = Account(10)
    assert a.apply("spend", "r1", 11) == (0, "refused")
    assert a.apply("spend", "r1", 0) == (0, "no amount") and a.apply("spend", "r1", -1) == (0, "no amount") and a.apply("spend", "r1", 1.5) == (0, "no amount")
    assert a.apply("spend", "r1", 6) == (-6, "applied") and a.apply("spend", "r1", 6) == (0, "repeated")
    assert a.apply("refund", "r1", 9) == (0, "more than it took") and a.apply("refund", "r1", 4) == (4, "applied") and a.apply("refund", "r1", 3) == (0, "more than it took")
    assert a.apply("refund", "r1", 2) == (2, "applied") and a.apply("refund", "r9", 1) == (0, "no such run")
    assert a.apply("credit", "e1", 5) == (5, "applied") and a.apply("credit", "e1", 5) == (0, "repeated")
    assert a.apply("clawback", "e2", 99) == (-99, "applied") and a.balance == -84
    assert a.apply("spend", "r2", 1) == (0, "refused")


def plain_ledger(rows):
    """The rules on one account's rows in turn, each looked up in what was applied before it."""
    done = []
    for kind, run, coins in rows:
        balance = sum(x[3] for x in done)
        same = [x for x in done if x[1] == run and x[3]]
        took, back = -sum(x[3] for x in same if x[0] == "spend"), sum(x[3] for x in same if x[0] == "refund")
        if coins <= 0:
            change, why = 0, "no amount"
        elif kind == "spend":
            change, why = (0, "repeated") if took else (0, "refused") if coins > balance else (-coins, "applied")
        elif kind == "refund":
            change, why = (0, "no such run") if not took else (0, "more than it took") if back + coins > took else (coins, "applied")
        else:
            once = any(x[0] in ("credit", "clawback") and x[4] == "applied" for x in done if x[1] == run)
            change, why = (0, "repeated") if once else (coins if kind == "credit" else -coins, "applied")
        done.append((kind, run, coins, change, why))
        yield change, balance + change, why


def test_settled_is_the_fold(spark):
    rng = random.Random(2)
    rows = [(u, s, rng.choice(["spend", "credit", "refund", "clawback"]), f"r{rng.randrange(9)}", rng.randrange(20)) for u in range(5) for s in range(60)]
    got = {(r["uid"], r["seq"]): (r["applied"], r["balance"], r["outcome"]) for r in settled(spark.createDataFrame(rows, "uid long, seq long, kind string, run string, coins long")).collect()}
    for u in range(5):
        own = sorted(r for r in rows if r[0] == u)
        for (_, s, *_), want in zip(own, plain_ledger([r[2:] for r in own])):
            assert got[u, s] == want


def test_balances_ignore_other_kinds(spark):
    df = spark.createDataFrame([(1, "credit", 9), (1, "spend", 4), (1, "meter", 100)], "uid long, kind string, coins long")
    assert [tuple(r) for r in balances(df).collect()] == [(1, 5)]


def test_template_round_trip():
    text = f.template([("p1", 1, "src", ""), ("p1", 2, "src", "two\nlines"), ("p2", 1, "src", "x")])
    assert f.filled_in("# a note\n" + text) == [("p1", 2, "two\nlines"), ("p2", 1, "x")]
    assert f.filled_in('{"pages": [{"page": "p", "boxes": [{"n": 1, "english": "a"}, {"n": 2, "english": " "}, {"n": "x", "english": "b"}, {"n": 7, "dst": "c"}]}]}') == [("p", 1, "a"), ("p", 7, "c")]
    assert f.filled_in('{"p1.png #2": "HELLO", "[p2 #3]": " ", "other": "x"}') == [("p1.png", 2, "HELLO")]
    assert f.filled_in("[p1 #1]  src\nwords\n\n  # a note\nmore\n[p1 #2]\n\n") == [("p1", 1, "words\n\nmore")]


def test_env_files(spark):
    text = "\ufeffexport A='x y'\r\nB=1 # one\nC=\n# D=2\nE=\"q\"\nb=2\nnothing\n"
    files = spark.createDataFrame([(1, 1, text), (1, 2, "C=c\nA=other")], "owner long, rank int, text string")
    environment = spark.createDataFrame([(1, "Q_Z", "z"), (1, "OTHER", "o"), (1, "Q_A", " ")], "owner long, name string, value string")
    got = {r["name"]: r["value"] for r in settings.answers(settings.env_entries(files), environment, "Q_").collect()}
    assert got == {"A": "x y", "B": "2", "C": "c", "E": "q", "Q_Z": "z"}
    one = files.where("rank = 2").select(settings.edited_env(F.col("text"), "A", "").alias("out"), settings.edited_env(F.col("text"), "A", "5").alias("set")).first()
    assert tuple(one) == ("C=c\n", "C=c\nA=5\n")


def test_settings(spark):
    rows = spark.createDataFrame([({"api_key": "set", "token": "real", "mode": "set", "old": "click"},)], "m map<string,string>")
    out = rows.select(settings.without_secrets(F.col("m")).alias("a"), settings.without_reports(F.col("m")).alias("b"), settings.migrated(F.col("m"), [("old", "new", {"click": "fast"})]).alias("c")).first()
    assert out["a"] == {"api_key": "", "token": "", "mode": "set", "old": "click"} and out["b"] == {"token": "real", "mode": "set", "old": "click"} and out["c"]["new"] == "fast" and "old" not in out["c"]
    assert f.safe_path("../a/./b:c/d//e") == "a/d/e"
    assert f.with_fonts({"font": "a", "x": [{"big_font": "b", "y": "c"}]}, str.upper) == {"font": "A", "x": [{"big_font": "B", "y": "c"}]}


def test_bundle_and_documents(spark, tmp_path):
    lines = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "b", None), (2, 0, "a", "é\"")], "page_id long, ord long, speaker string, text string")
    f.write_bundle({"lines": lines, "docs": f.documents(lines)}, str(tmp_path / "b"))
    back = f.read_bundle(spark, str(tmp_path / "b"))
    assert sorted(back) == ["docs", "lines"]
    assert sorted(map(tuple, f.regions(back["docs"]).collect()), key=repr) == sorted(map(tuple, lines.collect()), key=repr)


def test_image_listing_and_natural_order(spark, tmp_path):
    for name in ("p10.png", "p2.png", "P1.png", "note.txt"):
        (tmp_path / name).write_bytes(b"x")
    found = f.images(spark, str(tmp_path)).withColumn("k", f.natural_key("path"))
    assert [r["path"].rsplit("/", 1)[1] for r in found.orderBy("k", "path").collect()] == ["P1.png", "p2.png", "p10.png"]


def test_chrf_and_persons(spark):
    same = spark.createDataFrame([("the cat sat on the mat", "the cat sat on the mat")], "hypothesis string, reference string")
    assert evaluate.chrf(same).first()["chrf"] == 100.0
    other = spark.createDataFrame([("zzzz", "the cat")], "hypothesis string, reference string")
    assert evaluate.chrf(other).first()["chrf"] == 0.0
    short = spark.createDataFrame([("ab", "abcdefgh")], "hypothesis string, reference string")
    assert evaluate.chrf(short).first()["precision_"] == 1.0  # of the orders that the short side has
    lines = spark.createDataFrame([("行こう", "We go to her", "I go to her"), ("私は", "I", "you"), (None, "You and me", "my, you"), ("", "no one", "he")], "source string, reference string, candidate string")
    assert tuple(evaluate.who_differs(lines).first()) == (3, 2, 1)


def test_streams_agree_with_tables(spark):
    from quire.plans.grouped_queries import QUERIES

    sf = "/root/testdata/sf0.001"
    stream = QUERIES["t4_stream_accounts"](spark, sf)
    table = QUERIES["m7_settled_ledger"](spark, sf)
    assert stream.count() == table.count()
    assert stream.select(F.sum("applied")).first()[0] == table.select(F.sum("applied")).first()[0]


@pytest.mark.parametrize("name", ["g1_suppression", "w14_reading_order", "a10_chrf", "g6_merged_boxes"])
def test_grouped_queries_run(spark, name):
    from quire.plans import registry

    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
