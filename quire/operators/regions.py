"""Rules on the boxes of pages and on the lines in them, as columns and as transformations of a table of boxes.

A box has page_id, id, ord (its place, below 0 if it has none), kind, src (what was read) and dst (its translation), own_text and locked
(boxes that a person wrote or set), hidden, and what the single rules name. Text columns may be null. All rules are built-in functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters, other than modifier letters, and numbers.
WRITING = r"[\p{L}\p{N}&&[^\p{Lm}]]"
# Japanese text (fixed values): kanji; particles and sentence endings; marks that say nothing of a sound.
KANJI = "[一-鿿㐀-䶿]"
GLUE = "[をにはがでとものねよかなわぞぜだすまし]"
SILENT = "[ \t\r\n。、．，!?！？…‥・「」『』（）()〜~-]"
SOUND_MOST = 12
# Marks (fixed values): long dashes, masks, what an ellipsis is, what may stand before a line's first mark or word.
DASHES, SWUNG = "—–", "—–―─━〜～"
MASKS = "[*＊〇○●×✕✖#＃$＄@＠%％]"
ELLIPSIS = "(?:[…‥]|[.．・]{2})[.．・…‥]*"
OPENERS = r"""["'“”‘’«»「」『』（）()\[\]【】\s]*"""
LEAD_MARKS = r"[,.;:!?…‥・·、。，；：！？—–ー~〜～\-]"
TAIL_DOTS = r"(?:\.{2,}|[…‥]+|・{2,}|。{2,})\s*$"
TRAILS, ENDED = r"(?:[…‥—―－]|\.\.\.|．．．)$", r"""[.!?…‥—–\-"'”’」』）)】』～~]$"""
#: Characters that a square pixel of balloon holds: share of it that is written on, area of a character, and what is too many.
PACK, CHARACTER, OVER = 0.55, 1.05, 1.25


def _text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def only_symbols(text: Column) -> Column:
    """P6. Marks and nothing that is writing. An empty text is not that."""
    return (_bare(_text(text)) != "") & ~_text(text).rlike(WRITING)


def protected() -> Column:
    """Boxes that no cleanup takes: a person's own, locked ones, translated ones."""
    return F.coalesce("own_text", F.lit(False)) | F.coalesce("locked", F.lit(False)) | (_bare(_text("dst")) != "")


def without_symbols(boxes: DataFrame) -> DataFrame:
    return boxes.where(~only_symbols(F.col("src")) | protected())


def garbage(text: Column, ink: Column) -> Column:
    """P8. Why a reading is not to be trusted; null if it may be. ink: inked pixels of the box, 0 where unknown."""
    seen = F.regexp_replace(_text(text), r"\s+", "")
    return (
        F.when(seen == "", "empty").when(only_symbols(seen), "punctuation only").when(seen.rlike(r"(.)\1{6,}"), "repeated character run")
        .when((ink > 0) & (F.length(seen) > 30) & (F.length(seen) > ink / 12), "implausible length")
    )


def sounds(text: Column, most: int = SOUND_MOST) -> Column:
    """P9. Reads as a drawn sound: no kanji, no particle or ending, and short; or nothing at all."""
    bare = F.regexp_replace(_text(text), SILENT, "")
    return (bare == "") | (~bare.rlike(KANJI) & ~bare.rlike(GLUE) & (F.length(bare) <= most))


def relabelled(boxes: DataFrame) -> DataFrame:
    """The kind of every box once it is read; in_balloon wins, and a person's own box keeps its kind."""
    kind = F.when(F.coalesce("own_text", F.lit(False)), F.col("kind")).when(F.col("in_balloon"), "bubble").when(sounds(F.col("src")), "sfx").otherwise("freefloat")
    return boxes.withColumn("kind", kind)


def tally(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """A1 and P10. For each page the five counts over boxes that are not hidden, and its status. pages: page_id, detected."""
    has = lambda c: _text(c) != ""
    active = boxes.where(~F.coalesce("hidden", F.lit(False)))
    counts = active.groupBy("page_id").agg(
        F.count("*").alias("_n"), F.count_if(~F.coalesce("own_text", F.lit(False))).alias("regions"), F.count_if(has("src")).alias("ocr"), F.count_if(has("dst")).alias("translated"),
        F.count_if("typeset").alias("typeset"), F.count_if("proofread").alias("proofread"),
    )
    status = (
        F.when(F.col("_n").isNull(), F.when(F.col("detected"), "done").otherwise("pending"))
        .when(F.col("translated") == F.col("_n"), "translated").when(F.col("ocr") > 0, "ocr").otherwise("detected")
    )
    names = ["regions", "ocr", "translated", "typeset", "proofread"]
    return pages.join(counts, "page_id", "left").select("page_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in names], status.alias("status"))


def with_angles(boxes: DataFrame, read: DataFrame, least: float = 0.05) -> DataFrame:
    """P13. Sound effects take the angle that was read, unless they were measured, were set by hand, or have it already. read: page_id, id, read_angle."""
    free = (F.col("kind") == "sfx") & ~((F.coalesce("sfx_len", F.lit(0)) > 0) & (F.coalesce("sfx_wid", F.lit(0)) > 0)) & ~F.coalesce("by_hand", F.lit(False))
    new = F.when(free & F.col("read_angle").isNotNull() & (F.abs(F.col("read_angle") - F.col("angle")) > least), F.col("read_angle")).otherwise(F.col("angle"))
    return boxes.join(read, ["page_id", "id"], "left").withColumn("angle", new).drop("read_angle")


def loudness(text: Column) -> Column:
    """The length of the longest run of ! and ?; 0 if none has two."""
    runs = F.regexp_extract_all(_text(text), F.lit("([!?！？]{2,})"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0))


def room(w: Column, h: Column, size: int = 12) -> Column:
    """How many characters a box holds at that size; 0 where that says nothing."""
    n = F.floor(w * h * F.lit(PACK) / (F.lit(CHARACTER) * max(6, size) ** 2))
    return F.when(n >= 4, n).otherwise(F.lit(0))


def line_note(src: Column, dst: Column, holds: Column) -> Column:
    """P16. The first thing to say about a translated line, or null: masked, quieter, stops short, too long."""
    masked = _text(dst).rlike(r"[A-Za-z]\*|\*[A-Za-z]|[A-Za-z][#@$%&][#@$%&!*]+") & ~_text(src).rlike(MASKS)
    quieter = (loudness(src) >= 2) & (loudness(dst) < loudness(src))
    s, d = _bare(_text(src)), _bare(_text(dst))
    short = (s != "") & (d != "") & s.rlike(TRAILS) & ~d.rlike(ENDED)
    return F.when(masked, "masked").when(quieter, "quieter").when(short, "stops short").when((holds > 0) & (F.length(d) > holds * OVER), "too long")


def reads_on(first: Column, second: Column) -> Column:
    """P19. A dash or an ellipsis at the break, on either side, unless a sentence ends there."""
    a = F.regexp_replace(_bare(_text(first)), "[」』）)】〕》”\"']+$", "")
    b = F.regexp_replace(_bare(_text(second)), "^[「『（(【〔《“\"']+", "")
    return (a != "") & (b != "") & ~a.rlike("[。．！？!?]$") & (a.rlike(f"[{SWUNG}…‥]$") | b.rlike(f"^[{SWUNG}…‥]"))


def linked(boxes: DataFrame) -> DataFrame:
    """G11. The sections of a balloon (box_group above 0) are linked if each reads on into the next, and unlinked if not. New links
    are numbered from the page's greatest on, in the order in which the groups come. Other boxes keep link and link_kind."""
    group = Window.partitionBy("page_id", "box_group")
    order = group.orderBy(F.greatest("ord", F.lit(0)), "id")
    grouped = boxes.where("box_group > 0")
    on = grouped.select("page_id", "box_group", "id", F.lead("src").over(order).alias("_next"), "src")
    on = on.withColumn("_on", F.col("_next").isNull() | reads_on(F.col("src"), F.col("_next")))
    # A missing next text is told from a missing next box by the number of boxes.
    n = on.groupBy("page_id", "box_group").agg(F.count("*").alias("_n"), F.min("id").alias("_first"), F.count_if("_on").alias("_yes"), F.count_if(F.col("_next").isNull()).alias("_ends"))
    joined = n.where("_n >= 2").withColumn("_joined", (F.col("_yes") == F.col("_n")) & (F.col("_ends") == 1))
    base = boxes.groupBy("page_id").agg(F.max(F.coalesce("link", F.lit(0))).alias("_used"))
    numbered = joined.where("_joined").withColumn("_k", F.row_number().over(Window.partitionBy("page_id").orderBy("_first"))).select("page_id", "box_group", "_k")
    verdict = joined.select("page_id", "box_group", "_joined").join(numbered, ["page_id", "box_group"], "left").join(base, "page_id")
    out = boxes.join(verdict, ["page_id", "box_group"], "left")
    link = F.when(F.col("_joined").isNull(), F.col("link")).when(F.col("_joined"), F.col("_used") + F.col("_k")).otherwise(F.lit(0)).cast("long")
    kind = F.when(F.col("_joined").isNull(), F.col("link_kind")).when(F.col("_joined"), "sentence").otherwise(F.lit(""))
    return out.withColumns({"link": link, "link_kind": kind}).select(*boxes.columns)


def with_linked_tails(boxes: DataFrame) -> DataFrame:
    """G12. Among boxes that one link joins (other than as lobes of a balloon), a translation ends in dots exactly where its source does."""
    link = F.when((F.coalesce("link", F.lit(0)) > 0) & (_text("link_kind") != "balloon"), F.col("link"))
    size = F.when(link.isNotNull(), F.count("*").over(Window.partitionBy("page_id", link)))
    d = _bare(_text("dst"))
    bare = F.regexp_replace(F.regexp_replace(d, TAIL_DOTS, ""), r"\s+$", "")
    want = F.regexp_replace(_text("src"), r"\s+$", "").rlike(TAIL_DOTS)
    new = F.when(want, F.concat(bare, F.lit("..."))).otherwise(bare)
    change = (F.coalesce(size, F.lit(0)) >= 2) & (d != "") & (want != d.rlike(TAIL_DOTS)) & (new != "")
    return boxes.withColumn("dst", F.when(change, new).otherwise(F.col("dst")))


def _or(new: Column, old: Column) -> Column:
    """Never nothing: what was, where nothing is left."""
    return F.when(_bare(new) == "", old).otherwise(_bare(new))


def without_added_marks(dst: Column, src: Column) -> Column:
    """F1. A translated line without the marks that its source does not have: first dashes (at its front always; at its end and inside,
    where a comma takes their place, if the source has none), then an ellipsis at its front, then any other mark there."""
    s, t = _text(src), _bare(_text(dst))
    dashed = s.rlike(f"[{SWUNG}]") | s.rlike("ー{2,}") | s.rlike(r"(?:^|\s)-+(?:\s|$)")
    lead = F.regexp_replace(t, f"^({OPENERS}(?:{ELLIPSIS})?{OPENERS})[-{DASHES}]+\\s*", "$1")
    tail = F.regexp_replace(lead, rf"(?:\s*[{DASHES}]+|\s+-+)({OPENERS}(?:{ELLIPSIS})?{OPENERS})$", "$1")
    inner = reduce(lambda c, r: F.regexp_replace(c, *r), ((rf"\s*[{DASHES}]+\s*", ", "), (r",\s*,+", ","), (r"\s+,", ",")), tail)
    one = F.when(t == "", dst).otherwise(_or(F.when(dashed, lead).otherwise(inner), dst))
    opens = f"^({OPENERS}){ELLIPSIS}\\s*"
    two = F.when((_bare(_text(one)) == "") | s.rlike(opens), one).otherwise(_or(F.regexp_replace(one, opens, "$1"), one))
    marks = rf"^({OPENERS})({LEAD_MARKS}+\s*)"
    return F.when((_bare(_text(two)) == "") | s.rlike(marks), two).otherwise(_or(F.regexp_replace(two, marks, "$1"), two))


#: Characters that a typesetter writes otherwise, and invisible ones (fixed values).
PLAIN = {"“": '"', "”": '"', "‘": "'", "’": "'", "‼": "!!", "⁉": "!?", "⁈": "?!", "⁇": "??", "×": "x", "−": "-", "•": "*", "□": ""}
INVISIBLE = "​‌‍⁠﻿­"


def plain_text(text: Column) -> Column:
    """F2. Plain marks, no invisible characters, runs of hyphens as one dash, and no pairs of asterisks round words (four deep)."""
    single = {k: v for k, v in PLAIN.items() if len(v) == 1}
    out = F.translate(F.translate(text, INVISIBLE, ""), "".join(single), "".join(single.values()))
    for k, v in PLAIN.items():
        if len(v) != 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    out = F.regexp_replace(out, "-{2,}", "—")
    for _ in range(4):
        out = F.regexp_replace(out, r"\*([^*]+)\*", "$1")
    return out


def without_notes(note: Column, retired: list[str], once: list[str]) -> Column:
    """P22. A box's remarks without the retired ones, and with one of each that is said once; null if nothing is left."""
    out = note
    for r in retired:
        out = F.replace(out, F.lit(r), F.lit(""))
    for k in once:
        at = F.instr(out, k) + len(k) - 1
        out = F.when(F.instr(out, k) > 0, F.concat(out.substr(F.lit(1), at), F.replace(out.substr(at + 1, F.length(out)), F.lit(k), F.lit("")))).otherwise(out)
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.when(out != "", out)


def cleaning_report(boxes: DataFrame, routes: DataFrame) -> DataFrame:
    """A3. How many boxes each route cleaned, and what besides befell them; the total leaves out routes that clean nothing.
    boxes: route, core_only, second_pass, redrawn. routes: route, cleans (those not listed do)."""
    count = boxes.groupBy("route").agg(F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in ("core_only", "second_pass", "redrawn")])
    out = count.join(F.broadcast(routes), "route", "left").withColumn("cleans", F.coalesce("cleans", F.lit(True)))
    return out.withColumn("total", F.sum(F.when(F.col("cleans"), F.col("n")).otherwise(0)).over(Window.partitionBy(F.lit(1))))


def honorifics_lost(lines: DataFrame) -> DataFrame:
    """A5, where honorifics are kept. Lines whose source has a katakana name with one, and whose translation has none."""
    from quire.operators.names import HONORIFICS

    return lines.where(_text("src").rlike("[ァ-ヶ][ァ-ヶー]+(さん|様|ちゃん|くん|殿)") & ~_text("dst").rlike(rf"(?i)\b([A-Z][A-Za-z]+)[-‐‑‒–]({'|'.join(HONORIFICS)})\b"))


def honorifics_leaked(lines: DataFrame) -> DataFrame:
    """A5, where they are dropped. Names that kept one, unless they are no exception: more than three and a twentieth of the lines."""
    from quire.operators.names import HONORIFICS

    hit = F.explode(F.regexp_extract_all(_text("dst"), F.lit(rf"(?i)(\b[A-Z][A-Za-z]+[-‐‑‒–](?:{'|'.join(HONORIFICS)})\b)"), F.lit(1)))
    leaks = lines.select("page_id", "ord", hit.alias("hit"))
    sizes = lines.agg(F.count("*").alias("_lines")).crossJoin(leaks.agg(F.count("*").alias("_leaks")))  # one row each
    return leaks.join(F.broadcast(sizes), F.col("_leaks") <= F.greatest(F.lit(3), F.expr("_lines div 20"))).select("page_id", "ord", "hit")


def persons(text: Column) -> Column:
    """A11. The grammatical persons that a line names: 1s, 1p, 2 and 3, in order."""
    words = F.regexp_extract_all(F.lower(_text(text)), F.lit(r"\b([a-z]+)\b"), F.lit(1))
    forms = {"1p": "we us our ours", "1s": "i me my mine", "2": "you your yours", "3": "he him his she her hers they them their"}
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(words, F.array(*map(F.lit, w.split()))), F.lit(p)) for p, w in forms.items()]))


def remembered(labels: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """U2. labels: series, label, seq. Of each series the distinct labels (whatever their case; the first spelling counts) in order of their
    first sight: the first `first`, or the last `last`."""
    seen = labels.groupBy("series", F.lower("label").alias("_low")).agg(F.min_by("label", F.struct("seq", "label")).alias("label"), F.min("seq").alias("seq"))
    w = Window.partitionBy("series")
    seen = seen.withColumns({"place": F.row_number().over(w.orderBy("seq", "_low")), "_back": F.row_number().over(w.orderBy(F.desc("seq"), F.desc("_low")))})
    keep = F.col("place") <= first if first is not None else F.col("_back") <= (last or 0)
    return seen.where(keep).select("series", "label", "place")
