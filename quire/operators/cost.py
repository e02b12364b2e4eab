"""Run costs: rates by prefix, drift of measured against predicted, holds and settlements. Coins are whole and rounded up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def longest_prefix(models: DataFrame, rates: DataFrame) -> DataFrame:
    """J18. Each model with the rate whose prefix is the longest; rates are a small table. Null where none matches."""
    m = models.select("model").distinct()
    found = m.join(rates, F.col("model").startswith(F.col("prefix")), "left")
    best = F.row_number().over(Window.partitionBy("model").orderBy(F.length("prefix").desc_nulls_last()))
    return found.withColumn("_r", best).where("_r = 1").select("model", "prefix", "tin", "tout")


#: Runs that count, boxes that a run needs, and how far a correction may go (fixed values): of input and thinking, and of what is visible.
RUNS, LEAST_BOXES, WIDE, TIGHT = 8, 20, (0.2, 2.5), (0.75, 1.25)


def _newest(meter: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("seq"))
    return meter.where(F.col("boxes") >= LEAST_BOXES).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= RUNS)


def drift(meter: DataFrame) -> DataFrame:
    """A15. For each step, model and regime (think_off: thinking was not asked for) three corrections: of input, of the visible reply and of
    thinking, each a ratio of sums over the newest runs, measured by predicted. Cached input is input. Runs that tell their
    thinking apart (think is not null) vote on the last two; others on one ratio for both, which counts where there are none of
    the first kind. A correction without evidence is 1. meter: step, model, think_off, seq, boxes, tin, cached, tout, think,
    and the predictions ptin, pcached, ptout, pthink."""
    rows = _newest(meter.where((F.col("ptin") + F.col("pcached") > 0) & (F.col("ptout") > 0)).withColumn("think_off", F.coalesce("think_off", F.lit(False))), ["step", "model", "think_off"])
    told = F.col("think").isNotNull()
    total = lambda c, when=None: F.coalesce(F.sum(c if when is None else F.when(when, c)), F.lit(0))
    sums = rows.groupBy("step", "model", "think_off").agg(
        F.count("*").alias("runs"), F.count_if(told).alias("told"), total(F.col("tin") + F.col("cached")).alias("rin"), total(F.col("ptin") + F.col("pcached")).alias("pin"),
        total(F.greatest(F.lit(0), F.col("tout") - F.col("think")), told).alias("rvis"), total(F.greatest(F.lit(0), F.col("ptout") - F.col("pthink")), told).alias("pvis"),
        total(F.col("think"), told).alias("rthk"), total(F.col("pthink"), told).alias("pthk"), total(F.col("tout"), ~told).alias("rout"), total(F.col("ptout"), ~told).alias("pout"),
    )

    def ratio(real: str, predicted: str, within: tuple[float, float], zero_counts: bool = False):
        enough = (F.col(predicted) > 0) & (F.lit(True) if zero_counts else F.col(real) > 0)
        return F.when(enough, F.least(F.lit(within[1]), F.greatest(F.lit(within[0]), F.col(real) / F.col(predicted)))).otherwise(1.0)

    whole, split = ratio("rout", "pout", WIDE), (F.col("pvis") > 0) | (F.col("pthk") > 0)
    return sums.select(
        "step", "model", "think_off", "runs", ratio("rin", "pin", WIDE).alias("input"),
        F.when(split, ratio("rvis", "pvis", TIGHT)).otherwise(whole).alias("visible"), F.when(split, ratio("rthk", "pthk", WIDE, True)).otherwise(whole).alias("thinking"),
    )


def ratios(meter: DataFrame, low: int = 20, high: int = 250) -> DataFrame:
    """For each step and model the one ratio of the newest runs' metered and predicted sums, in percent, clamped."""
    sums = _newest(meter, ["step", "model"]).groupBy("step", "model").agg(F.count("*").alias("runs"), F.sum("metered").cast("long").alias("metered"), F.sum("predicted").cast("long").alias("predicted"))
    return sums.withColumn("percent", F.least(F.lit(high).cast("long"), F.greatest(F.lit(low).cast("long"), F.expr("(100 * metered) div predicted"))))


def thinks(meter: DataFrame) -> DataFrame:
    """A16. Whether a model thinks on a step: true if any of the newest runs that tell it says so, false if all say 0; steps and models that no run
    tells of are left out. meter: step, model, seq, boxes, think (null: not told)."""
    return _newest(meter.where("think is not null"), ["step", "model"]).groupBy("step", "model").agg((F.max("think") > 0).alias("thinks"))


#: Tokens of a word, of an East Asian character and of a mark, and the ranges of these characters (fixed values).
TOKENS = (1.25, 0.95, 0.63)
EAST_ASIAN = "[⺀-鿿가-힯豈-﫿＀-￯　-〿]"


def tokens(text) -> "F.Column":
    """A20. About how many tokens a text has. White space has none. Ties round to the even number."""
    t = F.coalesce(text, F.lit(""))
    rest = F.regexp_replace(t, EAST_ASIAN, "")
    words = F.regexp_count(rest, F.lit("[A-Za-z0-9]+"))
    marks = F.length(F.regexp_replace(rest, r"[A-Za-z0-9\s]", ""))
    word, east, mark = (F.lit(x).cast("decimal(4,2)") for x in TOKENS)
    return F.bround(word * words + east * (F.length(t) - F.length(rest)) + mark * marks, 0).cast("long")


#: The least and the most that a reply is allowed (fixed values).
REPLY = (1500, 8000)


def reply_cap(boxes, characters, fixed, per_box, per_character, thinking):
    """A22. Twice the predicted reply, within REPLY; the most where there are no boxes. Columns."""
    predicted = fixed + per_box * boxes + per_character * characters + thinking
    return F.when(boxes <= 0, F.lit(REPLY[1])).otherwise(F.least(F.lit(REPLY[1]), F.greatest(F.lit(REPLY[0]), F.floor(2 * predicted)))).cast("long")


def usage(reply) -> "F.Column":
    """A19. tin, tout, cached, written, think and cost of a provider's JSON reply, under either naming. Where the total of input includes what
    was cached, that is taken out. think is null where nothing is said of it; cost is then 0. What cannot be read counts as nothing."""
    at = lambda p: F.get_json_object(reply, f"$.usage.{p}").try_cast("long")
    first = lambda *ps: F.coalesce(*[F.when(at(p) != 0, at(p)) for p in ps], F.lit(0).cast("long"))
    own, within = first("cache_read_input_tokens"), first("prompt_tokens_details.cached_tokens")
    tin = first("input_tokens", "prompt_tokens")
    think = F.coalesce(at("completion_tokens_details.reasoning_tokens"), at("thoughts_token_count"))
    cost = F.coalesce(F.get_json_object(reply, "$.usage.cost").try_cast("double"), F.lit(0.0))
    return F.struct(
        F.when(own == 0, F.greatest(F.lit(0), tin - within)).otherwise(tin).alias("tin"), first("output_tokens", "completion_tokens").alias("tout"), F.when(own == 0, within).otherwise(own).alias("cached"),
        first("cache_creation_input_tokens").alias("written"), F.when(think.isNotNull(), F.greatest(F.lit(0), think)).alias("think"), F.greatest(F.lit(0.0), cost).alias("cost"),
    )


def bill(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """A18. For each run its tokens, its cost (a call's own where the provider says one above 0, else by the table, a million tokens at a rate), and how many calls
    told their thinking. calls: run, model, tin, tout, think, direct. rates: model, rin, rout."""
    table = (F.col("tin") * F.col("rin") + F.col("tout") * F.col("rout")) / 1e6
    rows = calls.join(F.broadcast(rates), "model", "left").withColumn("_cost", F.coalesce(F.when(F.col("direct") > 0, F.col("direct")), table, F.lit(0.0)))
    return rows.groupBy("run").agg(F.sum("tin").alias("tin"), F.sum("tout").alias("tout"), F.count("think").alias("told"), F.sum("think").alias("think"), F.sum("_cost").alias("cost"), F.count("*").alias("calls"))


def accuracy(meter: DataFrame) -> DataFrame:
    """A17. Charged and measured by step and model."""
    total = lambda c, name: F.sum(c).cast("long").alias(name)
    return meter.groupBy("step", "model").agg(F.count("*").alias("runs"), total("boxes", "boxes"), total("predicted", "charged"), total("metered", "really"))


def settled(meter: DataFrame) -> DataFrame:
    """M10. A hold of five quarters of the quote, rounded up; what is measured is kept, up to the hold; the rest returns."""
    hold = F.ceil(F.col("predicted") * F.lit(1.25).cast("decimal(3,2)")).cast("long")
    kept = F.least(F.col("metered"), hold)
    return meter.select("step", "model", "seq", kept.alias("kept"), (hold - kept).alias("returned"))
