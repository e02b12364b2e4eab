"""Names: one key for all spellings of a person, tables of canon spellings, and merges where the first entry wins.

Romanised names differ in ways that say nothing: l and r are one sound, and so are v and b; a long vowel is written in many
ways; letters are doubled or not; an honorific may follow. `key` folds these away. The fold is a table of rewriting rules,
applied in turn by built-in functions, so that it runs inside the scan; `key_of` applies the same table to one string.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is not part of a name, and spellings that count as one (fixed values): pattern and what it becomes, in turn.
HONORIFICS = ("sama", "san", "chan", "kun", "dono", "senpai", "sensei", "tan", "shi")
SOUNDS = (
    ("[^a-z]", ""),
    (f"^(.{{2,}}?)({'|'.join(HONORIFICS)})$", "$1"),
    ("l", "r"),
    ("v", "b"),
    ("o[uhow]", "o"),
    ("u[uh]", "u"),
    ("e[ie]", "e"),
    (r"(.)\1+", "$1"),
)
#: Words that stand before a name and are not it (fixed values).
TITLES = (
    "lady lord sir madam master mistress miss mr mrs ms prince princess king queen duke duchess count countess baron baroness captain general doctor dr saint st "
    "the of young elder old big little"
).split()
#: Capitalised words that are no names, as far as a table is given: callers pass their own.
COMMON = "and but for not you all any are can did had has her him his how its may our out she the they this that then there what when where which who why with yes".split()
#: Words for people without a name (fixed values).
ROLES = (
    "guard guards bystander bystanders crowd onlooker onlookers passerby narrator narration petitioner soldier villager mob spectator commoner citizen patient kid child children boy girl "
    "townsperson attendant servant maid shopkeeper merchant priest nun audience student voice someone somebody people figure stranger"
).split()


def key(name: Column) -> Column:
    """The folded form of a name; empty where it has no letter."""
    out = F.lower(F.coalesce(name, F.lit("")))
    for pattern, to in SOUNDS:
        out = F.regexp_replace(out, pattern, to)
    return out


def key_of(name: str | None) -> str:
    out = (name or "").lower()
    for pattern, to in SOUNDS:
        out = re.sub(pattern, to.replace("$", "\\"), out)
    return out


def near(a: Column, b: Column, least: int) -> Column:
    """Whether two keys are one edit apart or less, both of `least` letters or more."""
    return (a == b) | ((F.length(a) >= least) & (F.length(b) >= least) & (F.levenshtein(a, b, 1) >= 0))


def forms(df: DataFrame, keys: str, least: int) -> DataFrame:
    """Adds form: each key, and for one of `least` letters or more what is left of it without each one of its letters. Keys one edit apart have a
    form in common, on which they meet."""
    shorter = F.transform(F.sequence(F.lit(1), F.length(keys)), lambda i: F.concat(F.col(keys).substr(F.lit(1), i - 1), F.col(keys).substr(i + 1, F.length(keys))))
    every = F.when(F.length(keys) >= least, F.concat(F.array(keys), shorter)).otherwise(F.array(keys))
    return df.where(F.col(keys) != "").withColumn("form", F.explode(F.array_distinct(every)))


def known_as(names: DataFrame, known: DataFrame, least: int = 5) -> DataFrame:
    """names: name. known: known, place. For each name the first known one of the same person: equal keys, or keys of `least`
    letters or more that are one edit apart."""
    left = forms(names.select("name").distinct().withColumn("_a", key(F.col("name"))), "_a", least)
    right = forms(known.select("known", "place").withColumn("_b", key(F.col("known"))), "_b", least)
    met = left.join(right, "form").where(near(F.col("_a"), F.col("_b"), least))
    return met.groupBy("name").agg(F.min_by("known", F.struct("place", "known")).alias("known"))


def capitalised(lines: DataFrame) -> DataFrame:
    """lines: page_id, ord, text. Every word of letters with a capital at its front: page_id, ord, at (its place), word."""
    words = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))
    return lines.select("page_id", "ord", F.posexplode(words).alias("at", "word")).where(F.col("word").rlike("^[A-Z]") & (F.length("word") >= 3))


def lower_seen(lines: DataFrame) -> DataFrame:
    """word: every word of three letters or more that some line has in lower case."""
    words = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))
    return lines.select(F.explode(words).alias("word")).where(F.col("word").rlike("^[a-z]{3,}$")).distinct()


def name_words(lines: DataFrame, common: list[str] | None = None) -> DataFrame:
    """The capitalised words that are neither titles nor common nor ever in lower case: ordinary words are."""
    never = [*TITLES, *(COMMON if common is None else common)]
    words = capitalised(lines).withColumn("low", F.lower("word")).where(~F.col("low").isin(never))
    return words.join(lower_seen(lines).withColumnRenamed("word", "low"), "low", "left_anti")


def variants(lines: DataFrame, references: int = 4) -> DataFrame:
    """A4. Keys under which more than one spelling stands: key, spelling (as first met), uses, and its first references."""
    words = name_words(lines).withColumn("key", key(F.col("word"))).where("key <> ''")
    where = F.struct("page_id", "ord", "at")
    each = words.groupBy("key", "low").agg(F.count("*").alias("uses"), F.min_by("word", where).alias("spelling"), F.sort_array(F.collect_set(F.struct("page_id", "ord"))).alias("_w"))
    many = each.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key")
    refs = F.array_join(F.transform(F.slice("_w", 1, references), lambda r: F.concat(F.lit("p"), r["page_id"].cast("string"), F.lit(" l"), r["ord"].cast("string"))), ", ")
    return each.join(many, "key", "left_semi").select("key", "spelling", "uses", refs.alias("refs"))


def names_in(lines: DataFrame) -> DataFrame:
    """A8. Words with a capital that do not begin a sentence, without a possessive, that are nowhere in lower case: name, page_id, ord, at (where it is first)."""
    word = "[A-Za-z][A-Za-z'’-]*"
    parts = F.regexp_extract_all("text", F.lit(f"([^A-Za-z]*)({word})"), F.lit(0))
    pieces = lines.select("page_id", "ord", F.posexplode(parts).alias("at", "piece"))
    before = F.regexp_replace(F.regexp_extract("piece", "^([^A-Za-z]*)", 1), r"\s+$", "")
    found = F.regexp_extract("piece", f"({word})$", 1)
    pieces = pieces.select("page_id", "ord", "at", before.alias("before"), F.regexp_replace(found, "['’]s$", "").alias("name"))
    # The first word of a line begins a sentence, and so does one after a full stop or a mark like it, or a line break.
    begins = (F.col("at") == 0) & (F.col("before") == "") | F.col("before").rlike("[.!?…\"'“”]$")
    names = pieces.where(F.col("name").rlike("^[A-Z]") & ~begins & (F.length("name") > 2))
    lower = pieces.where(F.col("name").rlike("^[a-z]")).select(F.lower("name").alias("_low")).distinct()
    first = F.min(F.struct("page_id", "ord", "at")).alias("w")
    return names.join(lower, F.lower("name") == F.col("_low"), "left_anti").groupBy("name").agg(first).select("name", "w.page_id", "w.ord", "w.at")


def canon_table(people: DataFrame, terms: DataFrame) -> DataFrame:
    """M4. key -> word: the canon spelling. people: name, place (these count over terms, the last of them most). terms: term, place (the first counts)."""
    split = lambda df, c, rank: df.select(F.posexplode(F.split(c, "[^A-Za-z]+")).alias("at", "word"), F.col("place"), F.lit(rank).alias("rank"))
    words = split(people, "name", 1).union(split(terms, "term", 0))
    words = words.where((F.length("word") >= 3) & F.col("word").rlike("^[A-Z]") & ~F.lower("word").isin([*TITLES, *COMMON])).withColumn("key", key(F.col("word"))).where(F.length("key") >= 2)
    order = F.when(F.col("rank") == 1, F.col("place") * 1000 + F.col("at")).otherwise(-F.col("place") * 1000 - F.col("at"))
    return words.groupBy("key").agg(F.max_by("word", F.struct("rank", order)).alias("word"))


def enforced(lines: DataFrame, table: DataFrame) -> DataFrame:
    """M5. page_id, ord, text with every name in its canon spelling (a shouted one stays shouted), and notes on names one letter
    away from a canon one, which are left as they are."""
    pieces = F.regexp_extract_all("text", F.lit("([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    parts = lines.select("page_id", "ord", F.posexplode(pieces).alias("at", "piece"))
    names = name_words(lines.select("page_id", "ord", "text")).select(F.col("word").alias("piece")).distinct().withColumn("key", key(F.col("piece"))).where("key <> ''")
    exact = names.join(table, "key").select("piece", F.when((F.upper("piece") == F.col("piece")) & (F.length("piece") > 1), F.upper("word")).otherwise(F.col("word")).alias("canon"))
    rest = forms(names.join(exact.select("piece"), "piece", "left_anti").where(F.length("key") >= 3), "key", 3)
    close = (F.length("tkey") >= 3) & (F.greatest(F.length("key"), F.length("tkey")) >= 4) & (F.levenshtein("key", "tkey", 1) >= 0)
    notes = rest.join(forms(table.toDF("tkey", "canon"), "tkey", 3), "form").where(close).groupBy("piece").agg(F.min("canon").alias("near"))
    out = parts.join(exact, "piece", "left").join(notes, "piece", "left")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("canon", "piece").alias("t")))), lambda x: x["t"]), "")
    note = F.array_join(F.array_distinct(F.transform(F.filter(F.sort_array(F.collect_list(F.struct("at", "piece", "near"))), lambda x: x["near"].isNotNull()), lambda x: F.concat(x["piece"], F.lit(" / "), x["near"]))), ", ")
    return out.groupBy("page_id", "ord").agg(text.alias("text"), note.alias("notes"))


def generic(name: Column) -> Column:
    """P18. A speaker without a name: a word for a role in it, or no word at all."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z ]", " "), " +"), lambda x: x != "")
    return (F.size(words) == 0) | F.arrays_overlap(words, F.array(*map(F.lit, ROLES)))


def merged_people(sheet: list[tuple[str, str]], adds: list[tuple[str, str]], evidence: set[str]) -> list[tuple[str, str, str]]:
    """M2. (name, note, outcome) of one sheet's additions in turn; each one that stands is known to those after it. evidence: keys of
    the words that the story writes. Outcomes: set, kept, spelling (another one is on the sheet), role, written nowhere."""
    keys = [key_of(n) for n, _ in sheet]
    names = [n for n, _ in sheet]
    out = []
    for name, note in adds:
        mine = key_of(name)
        same = next((n for n, k in zip(names, keys) if mine and k and (mine == k or (min(len(mine), len(k)) >= 5 and one_edit(mine, k)))), None)
        words = re.findall("[a-z]+", name.lower())
        if same is not None:
            out.append((name, note, "kept" if same == name else "spelling"))
        elif not words or set(words) & set(ROLES):
            out.append((name, note, "role"))
        elif not evidenced(name, evidence):
            out.append((name, note, "written nowhere"))
        else:
            names.append(name), keys.append(mine)
            out.append((name, note, "set"))
    return out


def evidenced(name: str, evidence: set[str]) -> bool:
    """Any part of the name, titles aside, is written somewhere; a name without such parts is nobody's concern."""
    words = re.findall("[A-Za-z]+", name)
    parts = {key_of(w) for w in ([w for w in words if w.lower() not in TITLES] or words)}
    parts = {p for p in parts if len(p) >= 2}
    return not parts or bool(parts & evidence)


def one_edit(a: str, b: str) -> bool:
    """Levenshtein distance 1."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


__all__ = ["canon_table", "capitalised", "enforced", "evidenced", "forms", "generic", "key", "key_of", "known_as", "lower_seen", "merged_people", "name_words", "names_in", "near", "one_edit", "variants"]
