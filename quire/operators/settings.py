"""Settings: secrets, env files and who answers first, options that were never set, migrations, fonts and styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that hold a secret, by how they end, and words by which a report says that one is set (fixed values).
SECRET = "(?i)(key|token|secret|password)$"
REPORTED = ("set", "env")


def without_secrets(settings: Column) -> Column:
    """S8. A map of settings as it is exported: secrets are blank, and still there."""
    return F.transform_values(settings, lambda k, v: F.when(k.rlike(SECRET), F.lit("")).otherwise(v))


def without_reports(settings: Column) -> Column:
    """S8. A map of settings as it is taken in: a secret whose value is a report's word is no value."""
    return F.map_filter(settings, lambda k, v: ~(k.rlike(SECRET) & v.isin(*REPORTED)))


def masked(secret: Column) -> Column:
    """F20. Whether a secret is there, never what it is."""
    return F.when(F.trim(F.coalesce(secret, F.lit(""))) != "", "set").otherwise(F.lit(""))


def env_entries(files: DataFrame) -> DataFrame:
    """S18. files: owner, rank, text. The NAME=value lines of each: owner, rank, name, value; of a name that a file has twice, the later.
    `export`, quotes and a byte-order mark are taken off; comments and lines without = say nothing."""
    lines = files.select("owner", "rank", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n", -1)).alias("at", "line"))
    line = F.regexp_replace("line", "^﻿?\\s+|^﻿|\\s+$", "")
    lines = lines.select("owner", "rank", "at", line.alias("line")).where(~F.col("line").startswith("#") & F.col("line").contains("="))
    name = F.upper(F.trim(F.regexp_replace(F.trim(F.substring_index("line", "=", 1)), r"^export\s+", "")))
    value = F.trim(F.regexp_replace("line", "^[^=]*=", ""))
    quoted = (F.length(value) >= 2) & value.rlike("(?s)^(['\"]).*\\1$")
    rows = lines.select("owner", "rank", "at", name.alias("name"), F.when(quoted, value.substr(F.lit(2), F.length(value) - 2)).otherwise(value).alias("value")).where("name <> ''")
    return rows.groupBy("owner", "rank", "name").agg(F.max_by("value", "at").alias("value"))


def answers(entries: DataFrame, environment: DataFrame, prefix: str) -> DataFrame:
    """S18. owner, name, value: the first file by rank whose value is not blank; last the environment (owner, name, value), of which
    only names of our own count."""
    own = environment.where(F.col("name").startswith(prefix)).select("owner", F.lit(1 << 30).alias("rank"), "name", "value")
    every = entries.select("owner", F.col("rank").cast("int").alias("rank"), "name", "value").unionByName(own).where(F.trim("value") != "")
    return every.groupBy("owner", "name").agg(F.min_by("value", "rank").alias("value"))


def edited_env(text: Column, name: str, value: str) -> Column:
    """S18. An env file with one name set; a blank value takes its line out. Other lines stay."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike(rf"^\s*(export\s+)?{name}\s*="))
    kept = F.regexp_replace(F.array_join(lines, "\n"), r"\n+$", "")
    return F.concat(F.when(kept != "", F.concat(kept, F.lit("\n"))).otherwise(F.lit("")), F.lit(f"{name}={value}\n" if value else ""))


def seeded(old: DataFrame, new: DataFrame) -> DataFrame:
    """S22. key, value: what is given anew, and for what is left out the old value."""
    return old.withColumnRenamed("value", "_old").join(new.withColumnRenamed("value", "_new"), "key", "full").select("key", F.coalesce("_new", "_old").alias("value"))


def on(flag: Column) -> Column:
    """P14. An option is on unless it is false; one that was never set is on."""
    return F.coalesce(flag, F.lit(True))


def migrated(settings: Column, moves: list[tuple[str, str, dict[str, str]]]) -> Column:
    """M6. A map of settings with old keys lifted: (old key, new key, old value -> new value; others as they are). A new key that is
    there already stays as it is, and doing it twice changes nothing."""
    out = settings
    for old, new, values in moves:
        value = F.element_at(out, F.lit(old))
        lifted = value
        for a, b in values.items():
            lifted = F.when(value == a, F.lit(b)).otherwise(lifted)
        rest = F.map_filter(out, lambda k, v: k != old)
        out = F.when(F.map_contains_key(out, old) & ~F.map_contains_key(out, new), F.map_concat(rest, F.map_from_arrays(F.array(F.lit(new)), F.array(lifted)))).otherwise(rest)
    return out


def font(*choices: Column, usable: list[str]) -> Column:
    """F11. The first choice that can be used: a box's own, its sub-type's, its family's, the project's; else the first usable one."""
    return F.coalesce(*[F.when(c.isin(usable), c) for c in choices], F.lit(usable[0]))


def styled(hand: Column, measured: Column, automatic: Column) -> Column:
    """F14. One map of style attributes from three: what was set by hand, then what was measured, then what is automatic, each attribute by itself."""
    keys = F.array_distinct(F.concat(F.map_keys(automatic), F.map_keys(measured), F.map_keys(hand)))
    pick = F.transform(keys, lambda k: F.struct(k.alias("key"), F.coalesce(F.element_at(hand, k), F.element_at(measured, k), F.element_at(automatic, k)).alias("value")))
    return F.map_from_entries(F.filter(pick, lambda e: e["value"].isNotNull()))


def username_key(name: Column) -> Column:
    """The key under which look-alike names are one: no dots, dashes and underscores; digits as the letters that they look like; i, l and 1 alike."""
    out = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), "[._-]", "")
    return F.translate(out, "034571i", "oeastll")
