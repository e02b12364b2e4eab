"""Pages as wholes: fingerprints and what changed, carried context, aliases, routes, seams, reports, and small formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprints(boxes: DataFrame, inputs: list[str]) -> DataFrame:
    """F15. page_id and the SHA-1 of what its look depends on: its boxes by id, of each the named inputs; a locked box is one word, whatever is in it."""
    own = F.concat_ws("|", F.col("id").cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in inputs])
    token = F.when(F.col("locked"), F.concat(F.col("id").cast("string"), F.lit("|locked"))).otherwise(own)
    every = F.sort_array(F.collect_list(F.struct("id", token.alias("t"))))
    return boxes.groupBy("page_id").agg(F.sha1(F.array_join(F.transform(every, lambda x: x["t"]), "\n")).alias("fingerprint"))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """T8. The pages whose fingerprint is not the one that their cached result was made for."""
    return now.join(before, ["page_id", "fingerprint"], "left_anti")


def carried(terms: DataFrame) -> DataFrame:
    """T1. terms: series, page_id, ord, term, rendering. Adds canon: how the earliest of the earlier pages renders the term; null on the first. A page
    does not see itself."""
    own = terms.groupBy("series", "term", "page_id").agg(F.min_by("rendering", F.struct("ord", "rendering")).alias("_own"))
    w = Window.partitionBy("series", "term").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    return terms.join(own.select("series", "term", "page_id", F.first("_own").over(w).alias("canon")), ["series", "term", "page_id"])


def glossary(sheet: DataFrame, adds: DataFrame, people: DataFrame) -> DataFrame:
    """M1. sheet and adds: term, value ("name (note)"). people: name. The sheet with what stands of the additions, and what became of each:
    an entry must say what it is; a person is none; a bare entry gets its note and keeps its name; a described one stays."""
    name = lambda v: F.trim(F.element_at(F.split(v, r"\s*[（(]|\s+[—–-]\s+", 2), 1))
    bracket, dash = (lambda v: F.regexp_extract(v, r"[（(]([^)）]*)[)）]", 1)), (lambda v: F.regexp_extract(v, r"\s+[—–-]\s+(.+)$", 1))
    note = lambda v: F.trim(F.when(v.rlike(r"[（(][^)）]*[)）]"), bracket(v)).otherwise(dash(v)))
    new = adds.select(F.trim("term").alias("term"), F.trim("value").alias("_v")).where((F.col("term") != "") & (name(F.col("_v")) != ""))
    first = people.select(F.lower(F.element_at(F.split("name", r"\s+"), 1)).alias("_first"), F.lower("name").alias("_who")).groupBy("_first").agg(F.collect_set("_who").alias("_who"))
    # A person is two words with capitals, of which the first begins somebody else's entry on the sheet of people.
    shaped = name(F.col("_v")).rlike(r"^\p{Lu}\p{L}{2,} \p{Lu}\p{L}{2,}$")
    new = new.join(first, F.lower(F.substring_index("_v", " ", 1)) == F.col("_first"), "left")
    person = shaped & F.col("_who").isNotNull() & (F.size(F.array_remove("_who", F.lower(name(F.col("_v"))))) > 0)
    both = sheet.select("term", F.col("value").alias("_have")).join(new, "term", "full")
    have, v = F.col("_have"), F.col("_v")
    outcome = (
        F.when(v.isNull(), "kept").when(note(v) == "", "no note").when(person, "a person")
        .when(have.isNotNull() & (note(have) != ""), "kept").when(have.isNotNull(), "described").otherwise("set")
    )
    known = F.when(have.isNotNull() & (name(have) != ""), name(have)).otherwise(name(v))
    value = F.when(outcome.isin("described", "set"), F.concat(known, F.lit(" ("), note(v), F.lit(")"))).otherwise(have)
    return both.select("term", value.alias("value"), outcome.alias("outcome"))


def aliases(pages: DataFrame) -> DataFrame:
    """J23. pages: page_id, path. alias and the first page that answers to it: its path, file name, file name without ending, and these in lower case."""
    base = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    names = F.array(F.col("path"), base, stem)
    every = pages.select("page_id", F.explode(F.array_distinct(F.concat(names, F.transform(names, lambda x: F.lower(x))))).alias("alias"))
    return every.groupBy("alias").agg(F.min("page_id").alias("page_id"))


def first_route(**routes: Column) -> Column:
    """X3. The name of the first route, in the order given, that is available; null if none is."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in routes.items()])


def families(boxes: DataFrame, kinds: DataFrame, own: DataFrame, default: str = "speech") -> DataFrame:
    """X5 and P3. Adds family: by the user's own kinds, then by the known ones, else the default. kinds and own: kind, family; small tables."""
    mine = own.select("kind", F.col("family").alias("_own"))
    known = kinds.select("kind", F.col("family").alias("_known"))
    out = boxes.join(F.broadcast(mine), "kind", "left").join(F.broadcast(known), "kind", "left")
    return out.withColumn("family", F.coalesce("_own", "_known", F.lit(default))).drop("_own", "_known")


def seams(tiles: DataFrame, busy: float = 20.0, alike: float = 16.0) -> DataFrame:
    """J29. tiles: strip_id, tile, width, top, bottom (arrays of grey values, the edge rows). The tiles whose lower edge goes on in the next one's upper
    edge: of one width, both edges busy (by their standard deviation), and alike on average."""
    w = Window.partitionBy("strip_id").orderBy("tile")
    rows = tiles.withColumns({"_top": F.lead("top").over(w), "_width": F.lead("width").over(w)}).where("_width = width")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    spread = lambda a: F.sqrt(mean(F.transform(a, lambda x: (x - mean(a)) * (x - mean(a)))))
    apart = mean(F.zip_with("bottom", "_top", lambda a, b: F.abs(a - b)))
    return rows.where((spread(F.col("bottom")) >= busy) & (spread(F.col("_top")) >= busy) & (apart < alike)).select("strip_id", "tile")


def rgba(colour: Column) -> Column:
    """F13. [r, g, b, a] of #rgb, #rrggbb, #rrggbbaa or rgb(...), rgba(...); a from 0 to 255; null for anything else."""
    c = F.lower(F.trim(colour))
    digits = F.when(c.rlike("^#[0-9a-f]{3}$"), F.regexp_replace(F.substring(c, 2, 3), "(.)", "$1$1")).when(c.rlike("^#([0-9a-f]{6}|[0-9a-f]{8})$"), c.substr(F.lit(2), F.lit(8)))
    full = F.rpad(digits, 8, "f")
    hexed = F.transform(F.array(*map(F.lit, (1, 3, 5, 7))), lambda k: F.conv(full.substr(k, F.lit(2)), 16, 10).cast("int"))
    parts = F.split(F.regexp_extract(c, r"^rgba?\(([0-9., ]+)\)$", 1), r"\s*,\s*")
    alpha = F.when(F.size(parts) == 4, F.round(F.try_element_at(parts, F.lit(4)).try_cast("double") * 255)).otherwise(F.lit(255.0)).cast("int")
    css = F.concat(F.transform(F.slice(parts, 1, 3), lambda x: x.try_cast("int")), F.array(alpha))
    return F.when(digits.isNotNull(), hexed).when(F.size(parts).isin(3, 4), css)


def colour_distance(a: Column, b: Column) -> Column:
    """F13. The greatest difference of a channel."""
    return F.greatest(*[F.abs(F.element_at(a, k) - F.element_at(b, k)) for k in (1, 2, 3)])


def counted(n: Column, one: str, many: str) -> Column:
    """F16. "1 box", "2 boxes"."""
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def percent(part: Column, whole: Column) -> Column:
    """F16. A share as a whole percentage, rounded half to even; empty where there is no whole."""
    return F.when(whole > 0, F.concat(F.bround(F.lit(100.0) * part / whole).cast("long").cast("string"), F.lit("%"))).otherwise("")


def references(where: Column, most: int = 4) -> Column:
    """F16. "p1 l2, p3 l4 and 2 more" of an array of (page, line)."""
    shown = F.array_join(F.transform(F.slice(where, 1, most), lambda r: F.concat(F.lit("p"), r["page"].cast("string"), F.lit(" l"), r["line"].cast("string"))), ", ")
    return F.when(F.size(where) > most, F.concat(shown, F.lit(" and "), (F.size(where) - most).cast("string"), F.lit(" more"))).otherwise(shown)


def refusal(status: Column, body: Column) -> Column:
    """F19. What an error of a provider means, by its code and words: key, money, limit, model, too long, refused, server, or the code itself."""
    t = F.lower(F.coalesce(body, F.lit("")))
    return (
        F.when(status.isin(401, 403) | t.rlike("api.?key|unauthorized"), "key").when((status == 402) | t.rlike("billing|credit|quota"), "money").when((status == 429) | t.rlike("rate limit"), "limit")
        .when((status == 404) | t.rlike("no such model|model not found"), "model").when((status == 413) | t.rlike("context length|too long"), "too long").when(t.rlike("safety|refus"), "refused")
        .when(status >= 500, "server").when(status >= 400, F.concat(F.lit("error "), status.cast("string")))
    )


def source_language(media: DataFrame, projects: DataFrame) -> DataFrame:
    """F21. projects: project, medium, source (may be null). Adds language and rtl: what the project says, else what its medium is in. media: medium, language, rtl."""
    out = projects.join(F.broadcast(media.select("medium", F.col("language").alias("_l"), F.col("rtl").alias("_r"))), "medium", "left")
    return out.select(*projects.columns, F.coalesce(F.when(F.trim("source") != "", F.col("source")), "_l", F.lit("und")).alias("language"), F.coalesce("_r", F.lit(False)).alias("rtl"))


def slow_pages(loads: DataFrame, least: int = 500) -> DataFrame:
    """A28. loads: page_id, route, boxes, load_ms, detect_ms. One line for each slow page: how often, by which route it took longest, and its sums."""
    total = F.col("load_ms") + F.col("detect_ms")
    slow = loads.withColumn("ms", total).where(F.col("ms") > least)
    return slow.groupBy("page_id").agg(
        F.count("*").alias("loads"), F.max_by("route", F.struct("ms", "route")).alias("route"), F.max("boxes").alias("boxes"), F.sum("load_ms").alias("load_ms"), F.sum("detect_ms").alias("detect_ms")
    )


def run_report(boxes: DataFrame) -> DataFrame:
    """A2. Of all boxes: how many, how many of them set small, run over or are flagged. boxes: layout, compact, overflow, flagged."""
    return boxes.agg(F.count("*").alias("regions"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(c) for c in ("compact", "overflow")], F.count_if(F.trim(F.coalesce("flagged", F.lit(""))) != "").alias("flagged"))


def three_points(predicted: DataFrame) -> DataFrame:
    """A25. predicted: step, model, boxes, context, usd, with rows for (1, 0), (2, 0) and (1, 1). What a page costs: by itself, for each box and for each
    box of context, by differences."""
    at = lambda b, c: F.max(F.when((F.col("boxes") == b) & (F.col("context") == c), F.col("usd")))
    p = predicted.groupBy("step", "model").agg(at(1, 0).alias("one"), at(2, 0).alias("two"), at(1, 1).alias("more"))
    return p.select("step", "model", (F.col("one") * 2 - F.col("two")).alias("per_page"), (F.col("two") - F.col("one")).alias("per_box"), (F.col("more") - F.col("one")).alias("per_context_box"))


def offered(seeded: DataFrame, ever: DataFrame) -> tuple[DataFrame, DataFrame]:
    """U7. seeded and ever: project, key. What to seed now, which is what was never offered, and all that ever was after that."""
    fresh = seeded.distinct().join(ever, ["project", "key"], "left_anti")
    return fresh, ever.union(fresh).distinct()
