"""Queries stated once as SQL templates, for Spark and for DuckDB.

`@name` is a supplied table. Names of VIEWS are put in front as common table expressions when they are used.
Braces hold what the dialects spell differently; everything else is standard.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SPARK = {
    "div": "div", "bs": "\\\\", "each": "explode", "all0": ", 0)", "g": "", "1": "$1", "2": "$2", "like": "regexp_like", "str": "string", "list": "array",
    "agg": lambda x, sep, order: f"listagg({x}, '{sep}') within group (order by {order})",
    "size": "size", "substr": "substring", "range": "sequence", "dbl": "double", "strpos": "instr", "lpad0": "lpad",
    "map": lambda xs, v, body: f"transform({xs}, {v} -> {body})", "keep": lambda xs, v, body: f"filter({xs}, {v} -> {body})",
    "join": "array_join", "sortlist": "array_sort", "collect": lambda x: f"collect_list({x})", "ntz": "timestamp_ntz",
    "epoch": lambda x: f"unix_seconds(cast({x} as timestamp))", "has": "array_contains", "distinct": "array_distinct", "at": lambda xs, i: f"get({xs}, {i} - 1)",
}
DUCK = SPARK | {
    "div": "//", "bs": "\\", "each": "unnest", "g": ", 'g'", "1": "\\1", "2": "\\2", "like": "regexp_matches", "str": "varchar", "list": "list_value",
    "agg": lambda x, sep, order: f"string_agg({x}, '{sep}' order by {order})",
    "size": "len", "substr": "substr", "range": "generate_series",
    "map": lambda xs, v, body: f"list_transform({xs}, lambda {v}: {body})", "keep": lambda xs, v, body: f"list_filter({xs}, lambda {v}: {body})",
    "join": "array_to_string", "sortlist": "list_sort", "collect": lambda x: f"list({x})", "ntz": "timestamp",
    "epoch": lambda x: f"cast(floor(epoch({x})) as bigint)", "has": "list_contains", "distinct": "list_distinct", "at": lambda xs, i: f"{xs}[{i}]",
}

#: The surrogate inputs of FIXTURES.md, and what several queries build on.
VIEWS: dict[str, str] = {
    "boxes": "select o_custkey page_id, o_orderkey box_id, (o_orderkey*7919)%300 x, (o_orderkey*104729)%300 y, 20+(o_orderkey*31)%180 w, 20+(o_orderkey*17)%160 h, "
    "case o_orderstatus when 'F' then 'bubble' when 'O' then 'freefloat' else 'sfx' end kind, (o_orderkey*13)%1000 score from @orders",
    "lines": "select conv_id page_id, turn ord, role speaker, text from @conversations",
    "meter": "select seq, ts, step, model, boxes, predicted, (predicted {div} 100)*(60+(seq*37)%100)*(case model when 'm3' then 3 else 1 end) {div} (case model when 'm0' then 8 else 1 end) metered "
    "from (select event_id seq, ts, event_type step, concat('m', cast(user_id%4 as {str})) model, event_id%40 boxes, (cast(regexp_extract(props,'([0-9]+)',1) as bigint)+1)*100 predicted from @events) e",
    "ledger": "select user_id uid, event_id seq, ts, case event_type when 'purchase' then 'credit' when 'signup' then 'credit' when 'click' then 'spend' when 'view' then 'spend' else 'meter' end kind, "
    "cast(ceil(value) as bigint) coins from @events",
    "flags": "select o_custkey strip_id, o_orderkey row_no, (o_orderkey*o_orderkey)%7 < 4 flat from @orders",
    "tokens": "select doc_id, tok from (select doc_id, {each}(regexp_extract_all(text,'[{bs}p{L}]+',0)) tok from @documents) t where length(tok)>=3",
    # pairs of boxes on one page, with the shared area
    "pairs": "select * from (select a.page_id, a.box_id a_id, b.box_id b_id, a.x ax, a.y ay, a.w aw, a.h ah, b.x bx, b.y by_, b.w bw, b.h bh, a.kind a_kind, b.kind b_kind, "
    "greatest(0, least(a.x+a.w, b.x+b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y+a.h, b.y+b.h) - greatest(a.y, b.y)) inter, a.w*a.h a_area, b.w*b.h b_area "
    "from boxes a join boxes b on a.page_id = b.page_id and a.box_id <> b.box_id) q where inter > 0",
    # panels: the page cut into a grid of 2 by 2
    "panels": "select page_id, panel, (panel%2)*240 px, (panel {div} 2)*230 py, 240 pw, 230 ph from (select distinct page_id from boxes) p cross join (select cast(i as bigint) panel from (select {each}({range}(0, 3)) i) r) g",
    "families": "select 'bubble' kind, 'speech' family, 0 rank union all select 'sfx', 'sound', 1 union all select 'freefloat', 'loose', 2",
    "rates": "select 'm' prefix, 3 tin, 15 tout union all select 'm1', 1, 5 union all select 'm3', 10, 30",
    # boxes of pages with what was read in them, what became of it, and what a person set
    "regions": "select page_id, id, ord, m, nullif({at([SRC]; m % 20 + 1)}, '?') src, nullif({at([DST]; (m {div} 3) % 18 + 1)}, '?') dst, case m % 5 when 0 then 'sfx' when 1 then 'freefloat' else 'bubble' end kind, "
    "40 + m % 200 w, 30 + m % 150 h, m % 29 = 0 own_text, m % 31 = 0 locked, m % 13 = 0 or page_id % 11 = 0 hidden, m % 3 = 0 in_balloon, (m * 7) % 400 ink, m % 6 = 0 typeset, m % 8 = 0 proofread, "
    "case when page_id % 2 = 0 then id {div} 2 + 1 else 0 end box_group, case when m % 5 = 0 then cast(page_id % 3 + 1 as bigint) else cast(0 as bigint) end link, case when m % 10 = 0 then 'balloon' else '' end link_kind, "
    "cast(m % 30 as {dbl}) angle, m % 4 * 10 sfx_len, m % 6 * 5 sfx_wid, m % 9 = 0 by_hand "
    "from (select conv_id page_id, cast(turn as bigint) id, cast(turn as bigint) ord, cast(conv_id * 31 + turn * 17 as bigint) m from @conversations) c",
    "page_states": "select page_id, page_id % 2 = 0 detected from (select distinct conv_id page_id from @conversations) c",
    # lines in which people are named, in several spellings
    "scenes": "select page_id, ord, concat({at([DST]; (m {div} 3) % 18 + 1)}, ' ', {at([NAMED]; m % 12 + 1)}, ' and the ', {at([NAMED]; (m {div} 5) % 12 + 1)}, '.') text from regions where m % 3 > 0",
    # what runs were predicted to take and took, in two regimes, with and without their thinking told
    "runs": "select seq, step, model, seq % 7 = 0 think_off, boxes, metered tin, seq % 5 * 100 cached, metered {div} 3 + seq % 90 tout, case when seq % 4 = 0 then null when model = 'm2' then 0 else seq % 60 end think, "
    "predicted ptin, seq % 3 * 100 pcached, predicted {div} 3 + 40 ptout, 30 pthink from meter",
    # the rows of strips: bands of 24 rows, every third of them empty
    "strip_rows": "select strip_id, row_no, (row_no {div} 24) % 3 = strip_id % 3 flat from (select o_custkey % 5 strip_id, cast(row_number() over (partition by o_custkey % 5 order by o_orderkey) - 1 as bigint) row_no from @orders) r",
    # words of lower-case text with their places
    "said": "select page_id, ord, speaker, trim(text) text from lines where trim(coalesce(text, '')) <> ''",
}

#: Lines as they are read, translated, and names as they are spelled, of which the surrogate views take one for each box. "?" stands for null.
SRC = ["先生、早く来て！", "ドドドド", "……", "バン!!", "おはよう", "", "ーー", "えっ？", "きみは誰だ", "あああああああああ", "モモさんが来た", "3", "それは、たぶん—", "♡", "ザブン", "—そして", "行こう…", "「待って…」", "エーダ様!!!", "?"]
DST = ["Teacher, come quick!", "Dododo", "...well then", "Bang!!", "Good morning", "", "What the f*** is this", "Huh?", "Who are you", "Aaaaaah", "Momo-san came", "--It was him-- I think", "Perhaps —", "And then...", "*turn* “so”", "They left. We stayed", "I know — you do, - no", "?"]
NAMED = ["Glow", "Glou", "Leonora", "Leonore", "Grow-san", "watch", "Keiko", "Keeko", "Ada", "LEONORE", "Tarou", "Lancaster's"]


def _literal(words: list[str]) -> str:
    return "{list}(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


for _name, _view in VIEWS.items():
    for _word, _values in (("[SRC]", SRC), ("[DST]", DST), ("[NAMED]", NAMED)):
        _view = _view.replace(_word, _literal(_values))
    VIEWS[_name] = _view

_USED = re.compile(r"\b(" + "|".join(VIEWS) + r")\b")
_CALL = re.compile(r"\{(agg|map|keep|collect|epoch|at)\(")


def _expand(sql: str, words: dict) -> str:
    """Replaces {word} and {word(a; b)}: arguments stand between semicolons and may nest."""
    while m := _CALL.search(sql):
        # The innermost call first: the last one that opens before its end.
        start = max(x.start() for x in _CALL.finditer(sql))
        depth, at = 0, sql.index("(", start)
        for end in range(at, len(sql)):
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if not depth:
                break
        name, args = sql[start + 1 : at], [x.strip() for x in sql[at + 1 : end].split(";")]
        sql = sql[:start] + words[name](*args) + sql[end + 2 :]
    return re.sub(r"\{(\w+)\}", lambda m: words[m[1]] if isinstance(words.get(m[1]), str) else m[0], sql)


def _needed(sql: str) -> list[str]:
    need, todo = set(), [sql]
    while todo:
        for name in set(_USED.findall(todo.pop())) - need:
            need.add(name)
            todo.append(VIEWS[name])
    return [x for x in VIEWS if x in need]


def rendered(sql: str, words: dict, table: Callable[[str], str]) -> str:
    views = ", ".join(f"{x} as ({VIEWS[x]})" for x in _needed(sql))
    recursive = sql.lstrip().lower().startswith("with recursive")
    body = sql.lstrip()
    if recursive:
        body = body[len("with recursive") :]
        text = f"with recursive {views}, {body}" if views else f"with recursive {body}"
    elif body.lower().startswith("with "):
        text = f"with {views}, {body[5:]}" if views else body
    else:
        text = f"with {views} {body}" if views else body
    return re.sub(r"@(\w+)", lambda m: table(m[1]), _expand(text, words))


def spark_query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(rendered(sql, SPARK, lambda name: f"parquet.`{sf_dir}/{name}.parquet`"))

    return run


def duck_sql(sql: str) -> str:
    return rendered(sql, DUCK, lambda name: name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark_query(f"select * from {name}")(spark, sf_dir)
