"""Readers and writers of page records: documents, bundles, templates, settings files and listings."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_SCHEMA = "page_id long, regions array<struct<ord:long,speaker:string,text:string>>"


def images(spark: SparkSession, path: str, glob: str = "*.{png,jpg,jpeg,webp}") -> DataFrame:
    """path, length and modificationTime of image files; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def natural_key(col: str):
    """A key by which digit runs compare as numbers and text without case."""
    tokens = F.regexp_extract_all(F.lower(col), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.transform(tokens, lambda t: F.when(t.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(t, 20, "0"))).otherwise(F.concat(F.lit("1"), t)))


def documents(lines: DataFrame) -> DataFrame:
    """One JSON document per page, its regions in order."""
    regions = F.sort_array(F.collect_list(F.struct("ord", "speaker", "text")))
    return lines.groupBy("page_id").agg(regions.alias("regions")).select("page_id", F.to_json(F.struct("page_id", "regions")).alias("document"))


def regions(docs: DataFrame) -> DataFrame:
    """The regions of JSON documents; unknown fields are left out, damaged documents give none."""
    page = F.from_json("document", PAGE_SCHEMA)
    return docs.select(page.alias("p")).select("p.page_id", F.explode("p.regions").alias("r")).select("page_id", "r.*")


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """A folder with a Parquet table per name and a manifest of their names."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(n,) for n in sorted(tables)], "name string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest.json")


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that the manifest names. A folder without one is no bundle."""
    names = [r["name"] for r in spark.read.schema("name string").json(f"{path}/manifest.json").collect()]
    return {n: spark.read.parquet(f"{path}/{safe_path(n)}") for n in names}


def safe_path(path: str) -> str:
    """Path segments that are empty, dots or hold a colon are left out."""
    return "/".join(s for s in path.split("/") if s not in ("", ".", "..") and ":" not in s)


def with_fonts(document, change):
    """The document with change() applied to every value named font or *_font, at any depth."""
    if isinstance(document, dict):
        return {k: change(v) if (k == "font" or k.endswith("_font")) and isinstance(v, str) else with_fonts(v, change) for k, v in document.items()}
    if isinstance(document, list):
        return [with_fonts(x, change) for x in document]
    return document


def with_fonts_in(document: str, change) -> str:
    """with_fonts() on a document as JSON text; its keys come in order."""
    return json.dumps(with_fonts(json.loads(document), change), sort_keys=True, separators=(",", ":"))


def template(lines: list[tuple[str, int, str, str]]) -> str:
    """Blocks to fill in: page, rank, source and what is known of the target."""
    return "\n".join(f"[{page} #{n}]  {source}\n{target}\n" for page, n, source, target in lines)


LABEL = re.compile(r"^[ \t]*\[(?P<page>.+?)\s*#\s*(?P<n>\d+)\]", re.M)


def filled_in(text: str) -> list[tuple[str, int, str]]:
    """(page, rank, translation) of a filled-in template, as text or as JSON; what was left blank says nothing."""
    if text.lstrip()[:1] in ("{", "["):
        try:
            return [(p, n, t) for p, n, t in _entries(json.loads(text)) if t]
        except ValueError:
            pass  # a text whose first line is a label
    labels = [(m.start(), m.end(), m["page"].strip(), int(m["n"])) for m in LABEL.finditer(text)]
    ends = [at for at, *_ in labels[1:]] + [len(text)]
    blocks = ((page, n, text[end:stop].partition("\n")[2]) for (_, end, page, n), stop in zip(labels, ends))
    plain = ((page, n, "\n".join(x.rstrip() for x in block.splitlines() if not x.lstrip().startswith("#")).strip()) for page, n, block in blocks)
    return [x for x in plain if x[2]]


def _entries(doc):
    """The entries of the JSON forms: pages with boxes, or a mapping from labels."""
    if isinstance(doc, dict) and isinstance(doc.get("pages"), list):
        for page in (p for p in doc["pages"] if isinstance(p, dict)):
            for box in (b for b in page.get("boxes") or [] if isinstance(b, dict)):
                if str(box.get("n")).lstrip("-").isdigit():
                    yield str(page.get("page") or page.get("name") or ""), int(box["n"]), str(box.get("english") or box.get("dst") or "").strip()
    elif isinstance(doc, dict):
        for label, words in doc.items():
            if m := LABEL.match(label if label.startswith("[") else f"[{label}]"):
                yield m["page"].strip(), int(m["n"]), str(words).strip()
