"""Corpora from files: text, Markdown, HTML, JSON Lines and XML; every reader returns url, title, body.

``on_bad`` is "fail" or "skip".  Files that can't be parsed fail the read with their name and line, or
end at the bad place: what was read before it is kept.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections import Counter
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.storage import Files, small_batches
from .html import decode, extract

FORMATS = {"xml": "xml", "html": "html", "htm": "html", "txt": "text", "md": "text", "markdown": "text", "jsonl": "json", "ndjson": "json"}
#: Where a row is from: its file, the first byte of the file's part that held it, its line or place there.
_PLACE = "file string, block long, part long"
_ROWS = f"url string, title string, body string, bad string, {_PLACE}"
DEEPEST = 64


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncate_body(body: Column, most: int) -> Column:
    """At most ``most`` UTF-16 units, without half a character at the end; 0 is no limit."""
    if most <= 0:
        return body
    units = F.encode(body, "UTF-16BE")
    high = F.hex(F.substring(units, 2 * most - 1, 1)).between("D8", "DB")
    cut = F.decode(F.substr(units, F.lit(1), F.lit(2 * most) - F.when(high, 2).otherwise(0)), "UTF-16BE")
    return F.when(body.rlike(r"[\x{10000}-\x{10FFFF}]"), cut).otherwise(F.substring(body, 1, most))


def has_text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")).rlike(r"(?U)\S")


def non_empty(docs: DataFrame) -> DataFrame:
    return docs.filter(has_text("title") | has_text("body"))


def _relative(path: Column, root: str) -> Column:
    """A file's path below the root, decoded; the file's own name if the root is that file."""
    plain = F.url_decode(F.regexp_replace(path, r"\+", "%2B"))
    short = F.regexp_replace(plain, r"^file:/+", "/")
    base = root.removeprefix("file://").rstrip("/")
    return F.when(short.startswith(base + "/"), F.substr(short, F.lit(len(base) + 2))).otherwise(F.substring_index(short, "/", -1))


def text_fields(text: Column) -> tuple[Column, Column]:
    """Title and body: the first line with text, without leading marks, and the rest with white space collapsed."""
    plain = F.regexp_replace(text, "^﻿", "")
    head = F.regexp_extract(plain, r"^\s*([^\r\n]*)", 1)
    rest = F.regexp_replace(plain, r"^\s*[^\r\n]*", "")
    return F.trim(F.regexp_replace(F.trim(head), r"^[#\s]+", "")), collapse_whitespace(rest)


def first_string(row: dict, *names: str) -> str:
    """The first of the names whose value is a string or a number."""
    for name in names:
        value = row.get(name)
        if isinstance(value, str):
            return value.strip()
        if isinstance(value, (int, Decimal)) and not isinstance(value, bool):
            return format(value, "f") if isinstance(value, Decimal) else str(value)
    return ""


def parse_line(line: str) -> tuple[str, str, str]:
    """url, title, body of a JSON object.  Raises ValueError for anything but one object, nested at most 64 deep."""

    def constant(name: str):
        raise ValueError(f"{name} isn't JSON")

    row = json.loads(line, parse_float=Decimal, parse_constant=constant)
    if not isinstance(row, dict):
        raise ValueError("an object is expected")

    def depth(x: object, n: int = 1) -> None:
        if n > DEEPEST:
            raise ValueError("nested too deeply")
        for v in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            depth(v, n + 1)

    depth(row)
    body = re.sub(r"[ \t\n\x0b\f\r]+", " ", first_string(row, "body", "text", "content"))
    return first_string(row, "url", "id"), first_string(row, "title"), body.strip()


def parse_xml(data: bytes) -> Iterator[tuple[str, str]]:
    """url and html of each DOC element; names in any case."""
    parser = ET.XMLPullParser(("start", "end"))
    parser.feed(data)
    for event, element in parser.read_events():
        if event == "end" and element.tag.lower() == "doc":
            parts = {child.tag.lower(): "".join(child.itertext()) for child in element}
            yield parts.get("url", "").strip(), parts.get("html", "")
            element.clear()
    parser.close()


def _json_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter[tuple[str, int]] = Counter()
    for f in frames:
        out = []
        for name, block, line in zip(f["file"], f["block"], f["value"], strict=True):
            seen[name, block] += 1
            n = seen[name, block]
            line = line.removeprefix("\ufeff")
            if line.strip():
                try:
                    out.append((*parse_line(line), None, name, block, n))
                except (ValueError, RecursionError) as e:
                    place = f"line {n}" if block == 0 else f"line {n} after byte {block}"
                    out.append(("", "", "", f"{name}: {place}: {str(e)[:200]} in {line[:80]!r}", name, block, n))
        yield pd.DataFrame(out, columns=["url", "title", "body", "bad", "file", "block", "part"])


def json_documents(lines: DataFrame) -> DataFrame:
    """url, title, body, bad, file, block, part of lines (file, value and, if files are read in parts, block: the part's first byte)."""
    small_batches(lines.sparkSession)
    block = F.col("block") if "block" in lines.columns else F.lit(0).cast("long").alias("block")
    return lines.select("file", block, "value").mapInPandas(_json_rows, _ROWS)


def html_documents(pages: DataFrame, html: str = "html", whole_references: bool = False) -> DataFrame:
    """pages with the title and body of their HTML; ``whole_references`` as in ``extract``."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [extract(x, whole_references) for x in f[html]]
            yield f.assign(title=[t for t, _ in found], body=[b for _, b in found])

    small_batches(pages.sparkSession)
    return pages.mapInPandas(task, StructType([*pages.schema.fields, StructField("title", StringType()), StructField("body", StringType())]))


def _file_rows(kind: str):
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, data in zip(f["file"], f["content"], strict=True):
                out: list[tuple] = []
                try:
                    if kind == "html":
                        out.append((name, *extract(decode(data)), None, name, 0, 0))
                    else:
                        for i, (url, page) in enumerate(parse_xml(data)):
                            out.append((url, *extract(page), None, name, 0, i))
                except (ValueError, ET.ParseError) as e:
                    out.append(("", "", "", f"{name}: {e}", name, 0, len(out)))
                yield pd.DataFrame(out, columns=["url", "title", "body", "bad", "file", "block", "part"])

    return task


def _read(spark: SparkSession, path: str, root: str, kind: str, extension: str) -> DataFrame:
    glob = "*." + "".join(f"[{c}{c.upper()}]" for c in extension)
    single = path != root or path.lower().endswith("." + extension)
    files = spark.read if single else spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    name = _relative(F.col("_metadata.file_path"), root).alias("file")
    if kind == "text":
        title, body = text_fields(F.col("value"))
        rows = files.text(path, wholetext=True).select(name, title.alias("title"), body.alias("body"))
        return rows.selectExpr("file as url", "title", "body", "cast(null as string) as bad", "file", "0L as block", "0L as part")
    if kind == "json":
        return json_documents(files.text(path).select(name, F.col("_metadata.file_block_start").alias("block"), "value"))
    return files.format("binaryFile").load(path).select(name, "content").mapInPandas(_file_rows(kind), _ROWS)


def _until_bad(rows: DataFrame) -> DataFrame:
    """rows without those after the first bad place of their file."""
    place = F.struct("block", "part")
    first = rows.filter("bad is not null").groupBy(F.col("input").alias("i"), F.col("file").alias("f")).agg(F.min(place).alias("end"))
    rows = rows.join(first, (F.col("input") == F.col("i")) & (F.col("file") == F.col("f")), "left")
    return rows.filter(F.col("end").isNull() | (place <= F.col("end"))).drop("i", "f", "end")


def read_corpus(spark: SparkSession, paths: list[str], *, on_bad: str = "fail", max_body: int = 0, ordered: bool = True, counters: Observation | None = None) -> DataFrame:
    """url, title, body of all documents below the paths (folders or files), empty ones left out.

    They come in the order of the paths, then of the files' names, then as in the file, whatever the files' parts.  ``ordered=False``
    leaves the order, and its shuffle of all texts, out.  counters gets ``empty``, documents without text, and ``bad``, files that end early.
    """
    if on_bad not in ("fail", "skip"):
        raise ValueError("on_bad is 'fail' or 'skip'")
    out: DataFrame | None = None
    for n, path in enumerate(paths):
        path = path.rstrip("/")
        files = Files(spark)
        if not files.fs(path).exists(files.path(path)):
            raise ValueError(f"{path} doesn't exist")
        own = path.rsplit(".", 1)[-1].lower()
        if files.fs(path).getFileStatus(files.path(path)).isFile():
            if own not in FORMATS:
                raise ValueError(f"{path}: files of this kind aren't read")
            some = {own: FORMATS[own]}
        else:
            some = FORMATS
        for extension, kind in some.items():
            rows = _read(spark, path, path, kind, extension).withColumn("input", F.lit(n))
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no input")
    if on_bad == "fail":
        out = out.withColumn("bad", F.when(F.col("bad").isNotNull(), F.raise_error(F.concat(F.lit("bad input: "), F.col("bad"))).cast("string")))
    else:
        out = _until_bad(out)
    if ordered:
        out = out.orderBy("input", "file", "block", "part")
    if counters is not None:
        empty = ~(has_text("title") | has_text("body"))
        out = out.observe(counters, F.count_if(empty & F.col("bad").isNull()).alias("empty"), F.count_if(F.col("bad").isNotNull()).alias("bad"))
    out = non_empty(out.filter("bad is null"))
    return out.select("url", "title", truncate_body(F.col("body"), max_body).alias("body"))
