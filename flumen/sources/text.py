"""Readers of text recordings, tables and phase signals."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.vortex import infer_columns


def probe_text(spark: SparkSession, paths: list[str] | str, value_column: int = 4, sign: int = 1, grid: float = 100.0, tolerance: float = 1e-6) -> DataFrame:
    """Rows of white-space separated recordings: file, row, height, value, on_grid. The height is the sum of the first
    two columns, snapped to a grid within a tolerance; rows off the grid have height null, and what is no number is
    null too."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.split(F.trim("value"), r"\s+").alias("p"))
    number = lambda i: F.get("p", F.lit(i)).try_cast("double")
    raw = number(0) + number(1)
    snapped = F.rint(raw / grid) * grid
    on = F.coalesce(F.abs(raw - snapped) <= tolerance, F.lit(False))
    v = number(value_column - 1)
    return lines.select("file", "row", F.when(on, snapped).alias("height"), F.when(~F.isnan(v), v * sign).alias("value"), on.alias("on_grid"))


def audit(rows: DataFrame) -> DataFrame:
    """Rows kept, off the grid and without a finite value in each file."""
    ok = F.col("value").isNotNull()
    return rows.groupBy("file").agg(F.count_if(F.col("on_grid") & ok).alias("kept"), F.count_if(~F.col("on_grid")).alias("off_grid"), F.count_if(F.col("on_grid") & ~ok).alias("not_finite"))


#: Numbers as tables write them, and lines of nothing else.
NUMBER = r"[-+]?(?:(?:\d+\.?\d*|\.\d+)(?:[eEdD][-+]?\d+)?|[nN][aA][nN]|[iI][nN][fF](?:inity)?)"
NUMBERS = rf"^\s*{NUMBER}(?:[,;\s]+{NUMBER})*[,;\s]*$"
#: Lines that are looked at for a header.
HEAD = 50


def header_of(line: str) -> tuple[list[str], str]:
    """Names and separator in the header line of a table: a quoted VARIABLES list, or names between commas, semicolons,
    tabs or blanks. A line of numbers is no header."""
    if re.match(r"\s*variables\s*=", line, re.I):
        body = line.split("=", 1)[1]
        return re.findall(r'"([^"]*)"', body) or [x for x in re.split(r"[,\s]+", body.strip()) if x], " "
    if re.fullmatch(NUMBERS, line):
        raise ValueError("a table needs a header line")
    sep = next((s for s in (",", ";", "\t") if s in line), " ")
    return [x.strip().strip('"') for x in (line.split() if sep == " " else line.split(sep))], sep


def table_header(lines: list[str]) -> list[str]:
    """Column names in the first lines of a table: those of a VARIABLES record, which quoted names may continue on lines of
    their own, or of the first line that is no comment, title or zone."""
    for i, line in enumerate(lines):
        if re.match(r"\s*variables\s*=", line, re.I):
            more = itertools.takewhile(lambda x: re.match(r'\s*"', x), lines[i + 1 :])
            return header_of(" ".join([line, *more]))[0]
    for line in lines:
        if line.strip() and not re.match(r"\s*(#|%|title|zone)", line, re.I):
            return [n for n in header_of(line)[0] if n]
    raise ValueError("a table needs a header line")


def in_order(lines: DataFrame, **what: Column) -> DataFrame:
    """Lines of files (file, block, value; block is where a split of the file starts) with how many lines before each, in
    its file, are of each kind. Lines are counted within each split as it is read, and splits are put together by their
    sums: no file is sorted or read by one task."""
    names = list(what)
    flagged = lines.withColumns({n: F.coalesce(c, F.lit(False)).cast("long") for n, c in what.items()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, so_far = None, dict.fromkeys(names, 0)
        for b in batches:
            if not b.num_rows:
                continue
            keys = list(zip(b.column("file").to_pylist(), b.column("block").to_pylist()))
            columns = {n: b.column(n).to_numpy() for n in names}
            out = {n: np.empty(b.num_rows, np.int64) for n in names}
            starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for p, q in itertools.pairwise(starts):
                if keys[p] != last:
                    last, so_far = keys[p], dict.fromkeys(names, 0)
                for n in names:
                    c = np.cumsum(columns[n][p:q])
                    out[n][p:q] = so_far[n] + c - columns[n][p:q]
                    so_far[n] += int(c[-1])
            kept = [f.name for f in b.schema if f.name not in names]
            yield pa.record_batch([*(b.column(c) for c in kept), *(pa.array(out[n]) for n in names)], [*kept, *names])

    kept = [f for f in flagged.schema.fields if f.name not in names]
    counted = flagged.mapInArrow(count, StructType([*kept, *(StructField(n, LongType()) for n in names)]))
    sums = flagged.groupBy("file", "block").agg(*(F.sum(n).alias(n) for n in names))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("file", "block", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in names))
    return counted.join(offsets, ["file", "block"]).withColumns({n: F.col(n) + F.col(f"_{n}") for n in names}).drop(*(f"_{n}" for n in names))


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def zoned_table(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A table in one or more blocks: rows (file, zone, row and the columns by common names) and zones (file, zone, title,
    i, j, k, n). A zone line starts a block; other lines that aren't numbers belong to the header of their zone, and rows
    before any zone are of zone 0. Files may be of any size, and all have the header of the first. A line of numbers with
    more or fewer columns than the header is an error."""
    names = table_header([r[0] for r in spark.read.text(path).limit(HEAD).collect()])
    at = {k: names.index(n) for k, n in infer_columns(names).items()}
    is_zone, is_row = F.col("value").rlike(r"(?i)^\s*zone\b"), F.col("value").rlike(NUMBERS)
    numbered = in_order(_lines(spark, path), zone=is_zone, row=is_row)
    rows = numbered.filter(is_row).withColumn("_p", F.split(F.regexp_replace(F.trim("value"), r"[,;\s]+$", ""), r"[,;\s]+"))
    right = F.when(F.size("_p") == len(names), F.col("_p")).otherwise(F.raise_error(F.concat(F.lit(f"the header has {len(names)} columns, a row has "), F.size("_p").cast("string"))).cast("array<string>"))
    rows = rows.withColumn("_p", right)
    number = lambda i: F.regexp_replace(F.get("_p", F.lit(i)), "[dD]", "e").try_cast("double")
    first = numbered.filter(is_row).groupBy("file", "zone").agg(F.min("row").alias("_first"), F.count("*").alias("n"))
    marks = numbered.filter(~is_row).withColumn("zone", F.col("zone") + is_zone.cast("long")).filter("zone > 0")
    part = lambda p: F.max(F.when(F.regexp_extract("value", p, 1) != "", F.regexp_extract("value", p, 1)))
    size = lambda a: part(rf"(?i)(?:^|[\s,]){a}(?:max)?\s*=\s*(\d+)").cast("long").alias(a)
    heads = marks.groupBy("file", "zone").agg(part(r'(?i)(?:^|[\s,])t\s*=\s*"([^"]*)"').alias("title"), *map(size, "ijk"))
    zones = heads.join(first.select("file", "zone", "n"), ["file", "zone"], "full").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = rows.join(first.select("file", "zone", "_first"), ["file", "zone"])
    rows = rows.select("file", "zone", (F.col("row") - F.col("_first")).alias("row"), *(number(i).alias(k) for k, i in at.items()))
    return rows, zones.select("file", "zone", "title", "i", "j", "k", "n")


def field_table(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z, swirl and what velocities there are, from a table with a header of any common spelling."""
    lines = spark.read.text(path)
    names = table_header([r[0] for r in lines.limit(HEAD).collect()])
    at = {k: names.index(n) for k, n in infer_columns(names).items()}
    table = lines.filter(F.col("value").rlike(NUMBERS)).select(F.split(F.trim("value"), r"[,;\s]+").alias("p"))
    return table.select(*(F.regexp_replace(F.get("p", F.lit(i)), "[dD]", "e").try_cast("double").alias(k) for k, i in at.items()))


def phase_signal(spark: SparkSession, path: str) -> DataFrame:
    """ti and phase from delimited text: the last of several columns."""
    full = F.trim("value") != ""
    rows = in_order(_lines(spark, path), row=full).filter(full)
    return rows.select(F.col("row").cast("int").alias("ti"), F.element_at(F.split(F.trim("value"), r"[,;\s]+"), -1).try_cast("double").alias("phase"))


def case_label(path) -> tuple:
    """case and distance (in diameters) from a path part like name_2.5D; without one the case is what stands before a
    double underscore, and the distance unknown."""
    part = F.regexp_extract(path, r"([^/]*?_[0-9]+(?:\.[0-9]+)?D)(?:[/_.]|$)", 1)
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    case = F.when(part != "", F.regexp_extract(part, r"^(.*)_[0-9.]+D$", 1)).otherwise(F.substring_index(last, "__", 1))
    distance = F.regexp_extract(part, r"_([0-9.]+)D$", 1).try_cast("double")
    return case.alias("case"), distance.alias("distance")
