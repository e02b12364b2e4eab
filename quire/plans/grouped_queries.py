"""Queries of operators that need a grouped map, a text kernel or a stream. Oracles where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as kernels
from quire.operators import cost, greedy, ledger, sequence, spatial
from quire.plans.dialect import view
from quire.sources import formats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _page_kernel(name: str, schema: str, kernel: Callable[[pd.DataFrame], pd.DataFrame], where: str = "true", oracle: str | None = None) -> None:
    @query(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return greedy.per_page(view(spark, sf_dir, "boxes").where(where), kernel, schema)


def _rows(page: pd.DataFrame, kept: list[int]) -> pd.DataFrame:
    return page.loc[kept, ["page_id", "box_id"]]


def _labelled(page: pd.DataFrame, **columns: list) -> pd.DataFrame:
    return page[["page_id", "box_id"]].assign(**columns)


def _by_score(page: pd.DataFrame) -> list[int]:
    return sorted(range(len(page)), key=lambda k: (-page.score[k], k))


def _by_area(page: pd.DataFrame) -> list[int]:
    return sorted(range(len(page)), key=lambda k: (-page.w[k] * page.h[k], k))


BOX = "page_id long, box_id long"
_page_kernel("g1_suppression", BOX, lambda p: _rows(p, greedy.kept_after_suppression(greedy.as_boxes(p), _by_score(p), lambda a, b: greedy.iou(a, b) >= 0.35)))
_page_kernel("g1_containment_suppression", BOX, lambda p: _rows(p, greedy.kept_after_suppression(greedy.as_boxes(p), _by_area(p), lambda a, b: greedy.covered(a, b) >= 0.85)))
_page_kernel("j5_additive_union", BOX, lambda p: _rows(p, greedy.kept_after_suppression(greedy.as_boxes(p), list(range(len(p))), lambda a, b: greedy.iou(a, b) >= 0.35)))
_page_kernel("j11_vouched", BOX, lambda p: _rows(p, greedy.vouched(greedy.as_boxes(p), (p.score >= 600).tolist())))
_page_kernel("g8_parent_or_children", BOX, lambda p: _rows(p, greedy.parents_or_children(greedy.as_boxes(p), p.score.tolist())))
_page_kernel("g7_widest_link", BOX + ", side long", lambda p: _labelled(p, side=greedy.widest_link(greedy.as_boxes(p))))
_page_kernel("g10_passages", BOX + ", passage long", lambda p: _labelled(p, passage=greedy.stacked(greedy.as_boxes(p))))
_page_kernel("w13_spoken_first", BOX + ", place long", lambda p: _placed(p, greedy.spoken_first(greedy.as_boxes(p))))
_page_kernel("w14_reading_order", BOX + ", place long", lambda p: _placed(p, greedy.reading_order(greedy.as_boxes(p))))
_page_kernel("a27_snapped_colours", BOX + ", r long, g long, b long", lambda p: _colours(p))
_page_kernel(
    "g5_components", BOX + ", component long", lambda p: _labelled(p, component=[int(p.box_id[k]) for k in greedy.groups_in_reach(greedy.as_boxes(p), 0.1)]),
    oracle="""
      with recursive near as (select a.page_id, a.box_id a_id, b.box_id b_id from boxes a join boxes b on a.page_id = b.page_id where
          power(greatest(0, greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w)), 2) + power(greatest(0, greatest(a.y, b.y) - least(a.y + a.h, b.y + b.h)), 2) <= power(0.1 * least(a.w, a.h, b.w, b.h), 2)),
        reach as (select page_id, a_id, b_id from near union select r.page_id, r.a_id, n.b_id from reach r join near n on n.page_id = r.page_id and n.a_id = r.b_id)
      select page_id, a_id box_id, min(b_id) component from reach group by page_id, a_id""",
)


def _placed(page: pd.DataFrame, order: list[int]) -> pd.DataFrame:
    place = [0] * len(order)
    for n, i in enumerate(order):
        place[i] = n
    return _labelled(page, place=place)


def _colours(page: pd.DataFrame) -> pd.DataFrame:
    seen = greedy.snapped([(int(x) % 32, int(y) % 32, int(s) % 32) for x, y, s in zip(page.x, page.y, page.score)])
    return _labelled(page, r=[c[0] for c in seen], g=[c[1] for c in seen], b=[c[2] for c in seen])


@query("g2_one_owner")
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 and G2: loose boxes and the smallest free balloon that holds them."""

    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        loose, balloons = p[p.kind != "bubble"].reset_index(drop=True), p[p.kind == "bubble"].reset_index(drop=True)
        owner = greedy.one_owner_each(greedy.as_boxes(loose), greedy.as_boxes(balloons), 0.3)
        return _labelled(loose, owner=[int(balloons.box_id[k]) if k >= 0 else -1 for k in owner])

    return greedy.per_page(view(spark, sf_dir, "boxes"), kernel, BOX + ", owner long")


@query("g3_swapped_neighbours")
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13 and G3: neighbours whose readings fit each other's boxes better, best gain first."""

    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        import math

        b, found = greedy.as_boxes(p), []
        chars = [1 + int(s) % 60 for s in p.score]
        for i in range(len(b)):
            for j in range(i + 1, len(b)):
                if max(greedy.gap(b[i], b[j])) > 60:
                    continue
                size = [b[k][2] * b[k][3] for k in (i, j)]
                now = abs(math.log(chars[i] / size[0]) - math.log(chars[j] / size[1]))
                then = abs(math.log(chars[j] / size[0]) - math.log(chars[i] / size[1]))
                if now >= math.log(6) and then <= math.log(2):
                    found.append((now - then, i, j))
        pairs = greedy.disjoint_pairs(found)
        return pd.DataFrame([(int(p.page_id[0]), int(p.box_id[i]), int(p.box_id[j])) for i, j in pairs], columns=["page_id", "a_id", "b_id"])

    return greedy.per_page(view(spark, sf_dir, "boxes"), kernel, "page_id long, a_id long, b_id long")


@query("g6_merged_boxes")
def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        out = greedy.merged_to_rest(greedy.as_boxes(p), 0.5)
        return pd.DataFrame([(int(p.page_id[0]), k, *map(int, b)) for k, b in enumerate(out)], columns=["page_id", "place", "x", "y", "w", "h"])

    return greedy.per_page(view(spark, sf_dir, "boxes"), kernel, "page_id long, place long, x long, y long, w long, h long")


@query("g9_grown_to_marks")
def g9(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        owners, marks = p[p.kind == "bubble"].reset_index(drop=True), p[p.kind != "bubble"].reset_index(drop=True)
        got = greedy.grown(greedy.as_boxes(owners), greedy.as_boxes(marks), 0.3)
        return _labelled(marks, owner=[int(owners.box_id[k]) if k >= 0 else -1 for k in got])

    return greedy.per_page(view(spark, sf_dir, "boxes"), kernel, BOX + ", owner long")


@query("j7_clear_of_balloons")
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        b = greedy.as_boxes(p)
        balloons = [x for x, k in zip(b, p.kind) if k == "bubble"]
        rows = [(int(p.page_id[i]), int(p.box_id[i]), *map(int, r)) for i in range(len(b)) if p.kind[i] != "bubble" and (r := greedy.remaining_box(b[i], balloons))]
        return pd.DataFrame(rows, columns=["page_id", "box_id", "x", "y", "w", "h"])

    return greedy.per_page(view(spark, sf_dir, "boxes"), kernel, "page_id long, box_id long, x long, y long, w long, h long")


@query("j12_read_twice")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        return _rows(p, greedy.without_subreadings(greedy.as_boxes(p), [str(s)[: 1 + int(s) % 3] for s in p.score], 0.3))

    return greedy.per_page(view(spark, sf_dir, "boxes"), kernel, BOX)


@query("j21_name_drift")
def j21(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = view(spark, sf_dir, "tokens").where("length(tok) >= 9").select("doc_id", F.lower("tok").alias("w")).distinct()
    pairs = words.join(words.select((F.col("doc_id") + 1).alias("doc_id"), F.col("w").alias("used")), "doc_id").where("w <> used and substring(w, 1, 1) = substring(used, 1, 1)")
    close = pairs.withColumn("r", kernels.ratio("w", "used")).where("r >= 0.72")
    return close.groupBy("doc_id", "w").agg(F.min("used").alias("used"))


@query("f5_json_repair")
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    loose = F.concat(F.lit("```json\n{page: "), F.col("page_id"), F.lit(", 'speaker': \""), F.col("speaker"), F.lit("\", }\n```"))
    return view(spark, sf_dir, "lines").select("page_id", "ord", kernels.json_repair(loose).alias("json"))


@query("f8_own_breaks", oracle="select page_id, ord, list_value(concat(speaker, '-'), speaker) parts from lines")
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "lines").select("page_id", "ord", kernels.author_breaks(F.concat_ws("-", "speaker", "speaker")).alias("parts"))


@query("f9_broken_lines")
def f9(spark: SparkSession, sf_dir: str) -> DataFrame:
    least, broken = kernels.wrapped, kernels.broken_lines

    def run(batches):
        for x in batches:
            fit = [broken(t.split(), [80.0] * ((least(t.split(), 80.0) or 0) + 1)) for t in x.text]
            yield pd.DataFrame({"page_id": x.page_id, "ord": x.ord, "lines": fit})

    rows = view(spark, sf_dir, "said").select("page_id", F.col("ord").cast("long").alias("ord"), "text")
    return rows.mapInPandas(run, "page_id long, ord long, lines array<string>")


@query("s4_documents_round_trip", oracle="select page_id, ord, speaker, text from lines")
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 to S6: pages as JSON documents, and back."""
    lines = view(spark, sf_dir, "lines").select("page_id", F.col("ord").cast("long").alias("ord"), "speaker", "text")
    out = formats.regions(formats.documents(lines))
    return out.select("page_id", F.col("ord").cast(dict(view(spark, sf_dir, "lines").dtypes)["ord"]).alias("ord"), "speaker", "text")


def account_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "ledger")
    kind = F.when(F.col("kind") == "meter", "refund").otherwise(F.col("kind"))
    return rows.select("uid", "seq", kind.alias("kind"), F.concat(F.lit("run"), (F.col("seq") % 40).cast("string")).alias("run"), "coins")


@query("m7_settled_ledger")
def m7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.settled(account_events(spark, sf_dir))


@query("t2_balances", oracle="select uid, cast(sum(case kind when 'credit' then coins when 'spend' then -coins else 0 end) as bigint) balance from ledger group by uid")
def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.balances(view(spark, sf_dir, "ledger"))


@query("t5_live_entries", oracle="select uid, seq from (select uid, seq, max(seq) over (partition by uid) last from ledger) l where last - seq < 500")
def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "ledger").select("uid", "seq", F.max("seq").over(Window.partitionBy("uid")).alias("last"))
    return rows.where("last - seq < 500").select("uid", "seq")


def _streamed(spark: SparkSession, df: DataFrame, name: str, mode: str) -> DataFrame:
    from quire.streaming.ledger_stream import collected

    return collected(df, spark, _scratch(spark, name), mode)


@query("t11_stream_windows", oracle="select event_type, {epoch(ts)} {div} 86400 day_, count(*) n from @events group by 1, 2")
def t11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling day windows over the stream of events, in complete mode."""
    from quire.streaming.ledger_stream import events, tumbling

    out = _streamed(spark, tumbling(events(spark, sf_dir)), "windows", "complete")
    return out.select("event_type", F.expr("unix_seconds(start) div 86400").alias("day_"), "n")


@query("t3_stream_apply_once", oracle="select user_id, event_type from @events group by user_id, event_type")
def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each user and kind of event, however often it comes, within a watermark longer than the table."""
    from quire.streaming.ledger_stream import applied_once, events

    return _streamed(spark, applied_once(events(spark, sf_dir), ["user_id", "event_type"], "3650 days"), "once", "append").select("user_id", "event_type")


@query("t4_stream_accounts")
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The account state machine over the stream of events; equal to m7_settled_ledger when the table comes in one batch."""
    from quire.streaming.ledger_stream import events

    kinds = F.when(F.col("event_type").isin("purchase", "signup"), "credit").when(F.col("event_type").isin("click", "view"), "spend").otherwise("refund")
    rows = events(spark, sf_dir).select(
        F.col("user_id").alias("uid"), F.col("event_id").alias("seq"), kinds.alias("kind"), F.concat(F.lit("run"), (F.col("event_id") % 40).cast("string")).alias("run"), F.ceil("value").cast("long").alias("coins")
    )
    return _streamed(spark, ledger.settled_stream(rows), "accounts", "append")


@query("f10_layout_fit")
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size and lines of each line's words in a box of its own, with a fixed-width metric."""
    best = kernels.fitted

    def run(batches):
        for x in batches:
            found = [best(t.split(), 300 + 7 * (p % 20), 60 + 0.5 * len(t) + 9 * (o % 9)) for p, o, t in zip(x.page_id, x.ord, x.text)]
            yield pd.DataFrame({"page_id": x.page_id, "ord": x.ord, "size": pd.array([f[0] if f else None for f in found], dtype="Int64"), "lines": [f[1] if f else None for f in found]})

    lines = view(spark, sf_dir, "said").select("page_id", F.col("ord").cast("long").alias("ord"), "text")
    return lines.mapInPandas(run, "page_id long, ord long, size long, lines array<string>")


@query("o10_far_apart_colours")
def o10(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        colours = list(dict.fromkeys((int(x) % 256, int(y) % 256, int(s) % 256) for x, y, s in zip(p.x, p.y, p.score)))
        chosen = greedy.far_apart([(255, 255, 255)], colours, 3)
        return pd.DataFrame([(int(p.page_id[0]), k, *c) for k, c in enumerate(chosen)], columns=["page_id", "place", "r", "g", "b"])

    return greedy.per_page(view(spark, sf_dir, "boxes"), kernel, "page_id long, place long, r long, g long, b long")


@query("s1_file_listing")
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and sizes of the files of the supplied tables, in natural order, without their contents."""
    found = formats.images(spark, sf_dir, "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    return found.withColumn("key", F.array_join(F.transform(formats.natural_key("name"), lambda x: x), " "))


@query("s10_font_paths", oracle="select box_id, json_object('font', kind, 'style', json_object('size', score, 'title_font', 'b')) document from boxes")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Font paths at any depth of a document, made relative."""

    def run(batches):
        for x in batches:
            yield pd.DataFrame({"box_id": x.box_id, "document": [formats.with_fonts_in(t, lambda v: v.removeprefix("/fonts/")) for t in x.document]})

    doc = F.to_json(F.struct(F.concat(F.lit("/fonts/"), "kind").alias("font"), F.struct(F.lit("/fonts/b").alias("title_font"), F.col("score").alias("size")).alias("style")))
    return view(spark, sf_dir, "boxes").select("box_id", doc.alias("document")).mapInPandas(run, "box_id long, document string")


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the folder that driver and executors share; in a local session a local one where none is named, as in tests."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: this needs a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quire-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("s5_atomic_write", oracle="select page_id, ord, speaker, text from lines")
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "write")
    lines = view(spark, sf_dir, "lines")
    lines.write.mode("overwrite").parquet(path)
    return spark.read.schema(lines.schema).parquet(path)


@query("s6_page_json", oracle="select page_id, cast(to_json({'page_id': page_id, 'regions': list({'ord': cast(ord as bigint), 'speaker': speaker, 'text': text} order by ord)}) as varchar) document from lines group by page_id")
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = view(spark, sf_dir, "lines")
    return formats.documents(lines.withColumn("ord", F.col("ord").cast("long")))


@query("s7_bundle_round_trip", oracle="select l.page_id, l.ord, l.speaker, b.n from lines l join (select page_id, count(*) n from lines group by page_id) b on b.page_id = l.page_id")
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "bundle")
    lines = view(spark, sf_dir, "lines")
    formats.write_bundle({"lines": lines, "pages": lines.groupBy("page_id").agg(F.count("*").alias("n"))}, path)
    back = formats.read_bundle(spark, path)
    return back["lines"].join(back["pages"], "page_id").select("page_id", "ord", "speaker", "n")


@query("t7_saved_by_batch", oracle="select event_id, event_type from @events")
def t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch of a stream is written under its number, so that a batch that runs again replaces itself."""
    from quire.streaming.ledger_stream import events

    path = _scratch(spark, "saved")
    rows = events(spark, sf_dir).select("event_id", "event_type")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    rows.writeStream.foreachBatch(save).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select("event_id", "event_type")


QUERIES |= {"j2_smallest_free_container": QUERIES["g2_one_owner"], "j13_readings_next_door": QUERIES["g3_swapped_neighbours"], "g4_nearest_centroids": QUERIES["a27_snapped_colours"]}


# Operators that are also stated in SQL: the DataFrame form runs, and the SQL is its oracle.


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "boxes")


def _panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "panels").toDF("page_id", "panel", "x", "y", "w", "h")


QUERIES |= {
    "j1_best_panel": lambda s, d: spatial.best_panel(_boxes(s, d), _panels(s, d)),
    "j3_label_transfer": lambda s, d: spatial.transferred_labels(_boxes(s, d)),
    "j4_uncovered": lambda s, d: spatial.uncovered(_boxes(s, d), F.col("b_kind") == "bubble").select("box_id"),
    "j6_any_direction_cover": lambda s, d: spatial.covering_pairs(_boxes(s, d)),
    "j8_drop_parents": lambda s, d: spatial.without_parents(_boxes(s, d)).select("box_id"),
    "j9_absorbed_by_similar": lambda s, d: spatial.without_absorbed(_boxes(s, d)).select("box_id"),
    "j10_crumbs": lambda s, d: spatial.without_crumbs(_boxes(s, d), F.col("b_kind") != "sfx").select("box_id"),
    "j24_boxes_under": lambda s, d: spatial.boxes_under(_boxes(s, d), 60, 90, 180, 200).select("page_id", "box_id"),
    "j27_grid_buckets": lambda s, d: spatial.grid(_boxes(s, d)),
    "j28_neighbours_in_crop": lambda s, d: spatial.neighbours(_boxes(s, d)),
    "g13_run_angle": lambda s, d: spatial.run_angles(_boxes(s, d).where("kind = 'sfx'")),
    "w1_reading_rank": lambda s, d: sequence.reading_rank(view(s, d, "lines")),
    "w3_gutters": lambda s, d: sequence.islands(view(s, d, "flags")),
    "w4_interval_gaps": lambda s, d: sequence.interval_gaps(_boxes(s, d)),
    "w9_last_lines": lambda s, d: sequence.last_of_each(view(s, d, "said")).select("page_id", "ord", "speaker"),
    "w10_first_rendering": lambda s, d: sequence.first_of_each(view(s, d, "tokens").withColumn("term", F.lower("tok")), "term", ["doc_id", "tok"]),
    "w12_running_balance": lambda s, d: sequence.running_balance(view(s, d, "ledger")),
    "s21_user_receipt": lambda s, d: sequence.newest(view(s, d, "ledger"), ["uid"], ["seq"], 5).select("uid", "seq", "kind", "coins"),
    "j18_longest_prefix": lambda s, d: cost.longest_prefix(view(s, d, "meter").select("model").union(s.createDataFrame([("x9",)], "model string")), view(s, d, "rates")),
    "a15_drift_report": lambda s, d: cost.ratios(view(s, d, "meter")),
    "a17_accuracy": lambda s, d: cost.accuracy(view(s, d, "meter")),
    "m10_hold_and_settle": lambda s, d: cost.settled(view(s, d, "meter")),
    "a23_balance": lambda s, d: ledger.balances(view(s, d, "ledger")),
}
