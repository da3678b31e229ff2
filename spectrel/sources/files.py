"""Reading tables, spectra and text from files, and writing results."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING = ("", "na", "n/a", "nan", "null", "none", "-", "--")
#: Most rows, positions and targets that a spectral load takes.
MOST_ROWS, MOST_POSITIONS, MOST_TARGETS = 100_000, 50_000, 256


def table_name(name: str) -> str:
    """A view name: anything but word characters becomes _, a leading digit gets a prefix."""
    out = re.sub(r"\W+", "_", name).strip("_") or "t"
    return f"t_{out}" if out[0].isdigit() else out


def load_files(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """Views for CSV, TSV, JSON, Parquet and ORC files, named by their stems; later names that clash get _1, _2, ...; other files are left out."""
    out: dict[str, DataFrame] = {}
    for path in paths:
        stem, extension = os.path.splitext(os.path.basename(path.rstrip("/")))
        reader = spark.read.option("header", True).option("inferSchema", True)
        if extension.lower() in (".csv", ".tsv"):
            df = reader.option("sep", "\t" if extension.lower() == ".tsv" else ",").csv(path)
        elif extension.lower() in (".json", ".jsonl", ".parquet", ".orc"):
            df = spark.read.format({".jsonl": "json"}.get(extension.lower(), extension[1:].lower())).load(path)
        else:
            continue
        name, n = table_name(stem), 0
        while (key := name if not n else f"{name}_{n}") in out:
            n += 1
        df.createOrReplaceTempView(key)
        out[key] = df
    return out


def number(text: Column, decimal: str = ".") -> Column:
    """A double from text: decimal comma, Unicode minus, missing marks and non-finite values are null."""
    plain = F.regexp_replace(F.trim(text), "[−–]", "-")
    if decimal == ",":
        plain = F.replace(F.replace(plain, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    value = plain.try_cast("double")
    return F.when(F.lower(plain).isin(*MISSING) | F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def columns_of(spec: str, n: int, dropped: int | None = None) -> list[int]:
    """Column numbers of a selector: 8: (from 8 on), :8 (up to and without 8), 2:8, lists 8,9, and single numbers, negative from the end."""
    out: list[int] = []
    for part in spec.split(","):
        part = part.strip()
        if ":" in part:
            a, b = (x.strip() for x in part.split(":", 1))
            out += range(n)[slice(int(a) if a else None, int(b) if b else None)]
        else:
            k = int(part)
            if not -n <= k < n:
                raise ValueError(f"column {k} of {n}")
            out.append(k % n)
    out = [k for k in dict.fromkeys(out) if k != dropped]
    if not out:
        raise ValueError(f"no columns in {spec!r}")
    return out


def delimiter(spark: SparkSession, path: str, lines: int = 30) -> str:
    """The separator that cuts the first lines widest and most evenly."""
    head = [r["value"] for r in spark.read.text(path).limit(lines).collect() if r["value"].strip()]  # `lines` rows
    best = (0.0, ",")
    for sep in (",", ";", "\t", "|"):
        widths = [len(x.split(sep)) for x in head]
        if widths and max(widths) > 1:
            common = max(set(widths), key=widths.count)
            best = max(best, (common * widths.count(common) / len(widths), sep), key=lambda b: b[0])
    return best[1]


def profile(df: DataFrame, decimal: str = ".") -> DataFrame:
    """Per text column: numeric_share (of values that aren't missing), missing, distinct values, kind (numeric from 0.9 on); one pass."""
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("position"), F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for k, c in enumerate(df.columns)))).alias("c")
    gone = F.col("v").isNull() | F.lower(F.trim("v")).isin(*MISSING)
    seen = df.select(cells).select("c.*").groupBy("position", "column_name").agg(
        F.coalesce(F.avg(F.when(~gone, number(F.col("v"), decimal).isNotNull().cast("double"))), F.lit(0.0)).alias("numeric_share"), F.count_if(gone).alias("missing"), F.count_distinct(F.when(~gone, F.col("v"))).alias("distinct_values")
    )
    return seen.withColumn("kind", F.when(F.col("numeric_share") >= 0.9, "numeric").otherwise("text"))


def spectra(df: DataFrame, positions: list[str], targets: list[str] = (), sample: str | None = None, decimal: str = ".") -> DataFrame:
    """Rows of text or number columns as sample_id, x (array of doubles), y (map of targets)."""
    if len(positions) > MOST_POSITIONS or len(targets) > MOST_TARGETS:
        raise ValueError("too many columns")
    y = F.create_map(*(v for t in targets for v in (F.lit(t), number(F.col(f"`{t}`").cast("string"), decimal)))) if targets else F.create_map().cast("map<string,double>")
    name = F.col(f"`{sample}`").cast("string") if sample else F.lit(None).cast("string")
    return df.select(name.alias("sample_id"), F.array(*(number(F.col(f"`{p}`").cast("string"), decimal) for p in positions)).alias("x"), y.alias("y"))


def joined_blocks(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two blocks of positions of the same samples side by side; samples on one side alone are an error when read."""
    both = first.select("sample_id", F.col("x").alias("x1"), F.col("y").alias("y1")).join(second.select("sample_id", F.col("x").alias("x2")), "sample_id", "full_outer")
    x = F.when(F.col("x1").isNull() | F.col("x2").isNull(), F.raise_error(F.concat(F.lit("not in both blocks: "), "sample_id")).cast("array<double>")).otherwise(F.concat("x1", "x2"))
    return both.select("sample_id", x.alias("x"), F.col("y1").alias("y"))


def check_size(df: DataFrame, column: str = "x") -> None:
    """Raises if there are more rows or positions than a spectral load takes; one pass."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(column)).alias("p")).first()
    if r["n"] > MOST_ROWS or (r["p"] or 0) > MOST_POSITIONS:
        raise ValueError(f"{r['n']} rows of {r['p']} positions")


def markdown_row(columns: list[Column]) -> Column:
    """One line of a Markdown table; bars and line ends in cells are escaped."""
    cell = lambda c: F.coalesce(F.replace(F.replace(c.cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit(""))
    return F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))


def export(df: DataFrame, path: str) -> None:
    """Writes csv, json or md, by the path's ending; binary columns as hexadecimal digits."""
    kind = os.path.splitext(path)[1].lower()
    flat = df.select(*(F.hex(f.name).alias(f.name) if f.dataType.simpleString() == "binary" else F.col(f"`{f.name}`") for f in df.schema))
    if kind == ".csv":
        flat.write.option("header", True).csv(path)
    elif kind == ".json":
        flat.write.json(path)
    elif kind == ".md":
        head = df.sparkSession.createDataFrame([("| " + " | ".join(df.columns) + " |",), ("|" + " --- |" * len(df.columns),)], "value string")
        head.coalesce(1).unionByName(flat.select(markdown_row([F.col(f"`{c}`") for c in df.columns]).alias("value"))).write.text(path)
    else:
        raise ValueError(f"cannot write {kind!r}")


def ten_digits(value: Column) -> Column:
    """A number with at most ten significant digits."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.10g", value), r"(\.\d*?)0+(?=e|$)", "$1"), r"\.(?=e|$)", "")


def save_spectra(df: DataFrame, path: str, axis: list[float], target: str | None = None) -> None:
    """CSV with the target first and a column for each coordinate."""
    y = [ten_digits(F.col("y")[target]).alias(target)] if target else []
    df.select(*y, *(ten_digits(F.col("x")[k]).alias(f"{w:.10g}") for k, w in enumerate(axis))).write.option("header", True).csv(path)


def text_files(spark: SparkSession, folder: str, pattern: str = "*", most_bytes: int = 1_000_000) -> DataFrame:
    """path, text of the files of a tree that match a name pattern and aren't larger or binary."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.where((F.col("length") <= most_bytes) & ~F.hex("content").rlike("^(..)*?00")).select("path", F.col("content").cast("string").alias("text"))


def feed_entries(spark: SparkSession, path: str) -> DataFrame:
    """Literature records of an Atom feed: id (without version), title, authors, published."""
    schema = "id string, title string, published string, author array<struct<name string>>"
    rows = spark.read.format("xml").schema(schema.replace("<name string>", "<name:string>")).option("rowTag", "entry").load(path)
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return rows.select(F.regexp_extract("id", r"([^/]+?)(?:v\d+)?$", 1).alias("id"), squeeze(F.col("title")).alias("title"), F.transform("author", lambda a: squeeze(a["name"])).alias("authors"), "published")
