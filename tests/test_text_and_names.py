import itertools
import random

from quire.functions import text as t
from quire.operators import names as n


def test_comparison_form():
    assert t.comparison_form("ｆｕｌｌ １ ２") == "full12" and t.comparison_form(None) is None


def test_json_repair():
    assert t.repaired_json('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert t.repaired_json("{a: 'x', \"b\": [1,2,],}") == '{"a": "x", "b": [1, 2]}'
    assert t.repaired_json('{"a": "line\nbreak"}') == '{"a": "line\\nbreak"}'
    assert t.repaired_json('{"a": 1') is None and t.repaired_json("none") is None and t.repaired_json(None) is None


def test_hyphenation_by_patterns(spark):
    """The example of the method's inventor, and the lines of a dictionary that are no patterns."""
    lines = ["UTF-8", "LEFTHYPHENMIN 2", "% note", "a1b=c", "hy3ph", "he2n", "hena4", "hen5at", "1na", "n2at", "1tio", "2io", "o2n"]
    patterns = t.hyphenation_patterns(spark.createDataFrame([(x,) for x in lines], "line string"))
    words = spark.createDataFrame([("hyphenation",), ("Hyphenation",), ("ab",), ("x1y2z",)], "word string")
    got = {r["word"]: r["points"] for r in t.hyphenation(words, patterns).collect()}
    assert got == {"hyphenation": [2, 6], "Hyphenation": [2, 6], "ab": [], "x1y2z": []}
    assert t.hyphenation(words, patterns.limit(0)).where("size(points) > 0").count() == 0


def test_own_breaks():
    assert t.own_breaks("well-known") == ["well-", "known"] and t.own_breaks("plain") == ["plain"]


def test_broken_lines_are_the_best():
    rng = random.Random(5)
    for _ in range(60):
        words = ["x" * rng.randrange(1, 8) for _ in range(rng.randrange(1, 7))]
        widths = [float(rng.randrange(4, 20)) for _ in range(rng.randrange(1, 4))]
        best = None
        for cuts in itertools.combinations(range(1, len(words)), len(widths) - 1):
            lines = [" ".join(words[a:b]) for a, b in zip((0, *cuts), (*cuts, len(words)))]
            if all(len(x) <= w for x, w in zip(lines, widths)):
                cost = sum((w - len(x)) ** 2 for x, w in zip(lines, widths))
                best = cost if best is None else min(best, cost)
        got = t.broken_lines(words, widths)
        assert (got is None) == (best is None)
        if got:
            assert " ".join(got) == " ".join(words) and sum((w - len(x)) ** 2 for x, w in zip(got, widths)) == best


def test_ngram_matches_are_clipped():
    assert t.ngram_matches("aaa", "aa", 2) == [(2, 3, 2), (1, 2, 1)]


def test_one_name_has_one_key(spark):
    same = [("Glow", "Glou", "Grow", "Grou"), ("Keiko", "Keeko"), ("Ada", "Adasama", "Ada-san"), ("Tarou", "Taro", "Tarow", "Taroh"), ("Yuuki", "Yuhki", "Yuki"), ("Kitto", "Kito"), ("Victor", "Bictor")]
    for group in same:
        assert len({n.key_of(x) for x in group}) == 1, group
    assert len({n.key_of(g[0]) for g in same}) == len(same) and n.key_of("San") == "san" and n.key_of(None) == ""
    every = [x for g in same for x in g] + ["", "Momo", "O'Neill", "Mr. Lee-chan"]
    rows = spark.createDataFrame([(x,) for x in every], "name string")
    assert {r["name"]: r["k"] for r in rows.select("name", n.key(rows["name"]).alias("k")).collect()} == {x: n.key_of(x) for x in every}


def test_known_names(spark):
    known = spark.createDataFrame([("Leonora", 1), ("Glow", 2), ("Mimi", 3)], "known string, place int")
    names = spark.createDataFrame([(x,) for x in ("Leonore", "Glou", "Momi", "Leonard", "Leonora-san")], "name string")
    assert {r["name"]: r["known"] for r in n.known_as(names, known).collect()} == {"Leonore": "Leonora", "Glou": "Glow", "Leonora-san": "Leonora"}
    assert n.one_edit("abcd", "abd") and not n.one_edit("abcd", "badc") and not n.one_edit("a", "a")


def test_spellings_are_enforced_and_near_ones_noted(spark):
    table = spark.createDataFrame([("gro", "Glow"), ("reonora", "Leonora"), ("adae", "Adae")], "key string, word string")
    lines = spark.createDataFrame([(1, 0, "GLOU! Watch it grow, Ada."), (1, 1, "Grou met Leonorra; watch."), (1, 2, "And then")], "page_id long, ord long, text string")
    got = {r["ord"]: (r["text"], r["notes"]) for r in n.enforced(lines, table).collect()}
    assert got == {0: ("GLOW! Watch it grow, Ada.", "Ada / Adae"), 1: ("Glow met Leonora; watch.", ""), 2: ("And then", "")}


def test_people_merge_in_order():
    out = n.merged_people([("Hana", "")], [("A guard", "g"), ("Sakura", "1"), ("Sakurra", "2"), ("Hana", "3"), ("Lord Nobody", "4"), ("42", "5")], {n.key_of("Sakura")})
    assert [(x, why) for x, _, why in out] == [("A guard", "role"), ("Sakura", "set"), ("Sakurra", "spelling"), ("Hana", "kept"), ("Lord Nobody", "written nowhere"), ("42", "role")]


def test_layout_takes_the_largest_size_that_fits():
    size, lines = t.fitted(["aa", "bb"], 200, 60, sizes=(24, 12))
    assert size == 24 and " ".join(lines) == "aa bb"
    assert t.fitted(["x" * 99], 50, 50) is None
