"""Record keeping: threads and runs, catalogs and their readiness, column candidates, dataset checks, resource samples, message guards."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrel.operators.tabular import cut, typed_match

# --- threads, runs, events --------------------------------------------------------------------------------------------------------


def search(rows: DataFrame, order: list, limit: int, offset: int = 0, metadata: str | None = None, wanted: dict | None = None, **equal) -> DataFrame:
    """Rows whose columns equal what is given and whose JSON metadata holds all wanted values, by type; one page in order. All filters
    come before the limit."""
    for column, value in equal.items():
        rows = rows.where(F.col(column).isin(value) if isinstance(value, (list, tuple)) else F.col(column).eqNullSafe(F.lit(value)))
    for key, value in (wanted or {}).items():
        rows = rows.where(typed_match(F.col(metadata), key, value))
    return rows.orderBy(*order).offset(offset).limit(limit)


def waiting(runs: DataFrame, status: list[str], at: str, until, order: list, limit: int) -> DataFrame:
    """Runs in one of these states up to a cutoff time, the oldest first."""
    return runs.where(F.col("status").isin(status) & (F.col(at) <= F.lit(until))).orderBy(*order).limit(limit)


def without(rows: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(the rows that stay, one row with how many are deleted)."""
    gone = F.coalesce(condition, F.lit(False))
    return rows.where(~gone), rows.agg(F.count_if(gone).alias("deleted"))


def kept_messages(messages: DataFrame, thread: str, order: str, role: str, text: str, block: str, tool_calls: str | None = None, hidden: str | None = None) -> DataFrame:
    """Human messages and final answers: upload blocks are cut out, a human message of uploads alone goes and so does the answer next to
    it. Hidden messages and answers that call tools are left out and change nothing."""
    human = F.col(role) == "human"
    shown = ~F.coalesce(F.col(hidden), F.lit(False)) if hidden else F.lit(True)
    rows = messages.where((human & shown) | (F.col(role) == "ai"))
    if tool_calls:
        rows = rows.where(human | (F.coalesce(F.size(tool_calls), F.lit(0)) <= 0))
    cut = F.regexp_replace(F.regexp_replace(text, block, ""), r"^\s+|\s+$", "")
    has_block = F.col(text).rlike(block)
    rows = rows.withColumns({"__only": human & has_block & (cut == ""), text: F.when(human & has_block, cut).otherwise(F.col(text))})
    before = F.lag("__only").over(Window.partitionBy(thread).orderBy(order))
    return rows.withColumn("__skip", ~human & F.coalesce(before, F.lit(False))).where("NOT __only AND NOT __skip").drop("__only", "__skip")


def follows(actions: DataFrame, thread: str, order: str, action: str, first: str, then: str) -> DataFrame:
    """Per thread: where the first `first` and the first `then` stand (their order value), and whether the latter comes after the former."""
    seen = actions.groupBy(thread).agg(F.min(F.when(F.col(action) == first, F.col(order))).alias("first_at"), F.min(F.when(F.col(action) == then, F.col(order))).alias("then_at"))
    return seen.withColumn("in_order", F.coalesce(F.col("then_at") > F.col("first_at"), F.lit(False)))


# --- catalogs ---------------------------------------------------------------------------------------------------------------------


def registered(catalog: DataFrame, records: DataFrame, order: str) -> DataFrame:
    """What registering the records one after another does. catalog: doc_id, content_sha256, version; records: doc_id, content_sha256
    and a column of unique order. Adds action and version:

    unchanged or duplicate, with the holder's version, if the content is held when the record comes (by its own id, or by another);
    else the id takes the content, as updated with the next version if the id is known, as created with version 1 if not. The content
    that an updated id held before is free from then on. Where ids of the catalog share a content, the smallest counts as its holder.

    Which records take their content depends on those before them. Each round takes the answers of the last, derives from them when
    each content was held, and asks every record again; a round settles all whose predecessors are settled. Records meet the few spans
    of time in which their content was held by a join, so a content of many records is split like any skewed join. The keys of both
    tables are written once, so that no round reads or hashes the contents again.
    """
    now = F.col(order)
    given = catalog.select("doc_id", "content_sha256", F.col("version").cast("long").alias("version"), F.lit(None).cast(records.schema[order].dataType).alias("__at"))
    given, asked = cut(given), cut(records.select("doc_id", "content_sha256", now.alias("__at")))
    holder = given.groupBy("content_sha256").agg(F.min("doc_id").alias("__holder"))
    known = given.select("content_sha256").distinct()
    first = asked.groupBy("content_sha256").agg(F.min_by(F.struct("doc_id", "__at"), "__at").alias("f")).select("content_sha256", "f.*")
    taken = cut(first.join(known, "content_sha256", "left_anti").select("doc_id", "content_sha256", "__at"))
    by_id = Window.partitionBy("doc_id").orderBy(F.asc_nulls_first("__at"))
    while True:
        stores = given.unionByName(taken.withColumn("version", F.lit(None).cast("long")))
        base = F.max("version").over(Window.partitionBy("doc_id"))
        stores = stores.withColumns({"version": F.coalesce("version", F.coalesce(base, F.lit(0)) + F.row_number().over(by_id) - F.when(base.isNull(), 0).otherwise(1)), "__until": F.lead("__at").over(by_id)})
        spans = stores.join(holder, "content_sha256", "left").where(F.col("__at").isNotNull() | (F.col("doc_id") == F.col("__holder")))
        spans = spans.select("content_sha256", F.col("doc_id").alias("__by"), F.col("version").alias("__version"), F.col("__at").alias("__from"), "__until")
        own = stores.where("__at IS NULL").select("content_sha256", "doc_id", F.col("version").alias("__own"), F.col("__until").alias("__own_until"))
        held = (F.col("__from").isNull() | (F.col("__from") < F.col("__at"))) & (F.col("__until").isNull() | (F.col("__until") >= F.col("__at")))
        met = asked.join(spans, "content_sha256").where(held).select("__at", "__by", "__version")
        own = asked.join(own, ["content_sha256", "doc_id"]).where(F.col("__own_until").isNull() | (F.col("__own_until") >= F.col("__at"))).select("__at", "__own")
        state = asked.join(met, "__at", "left").join(own, "__at", "left")
        free = cut(state.where("__by IS NULL AND __own IS NULL").select("doc_id", "content_sha256", "__at"))
        if free.join(taken, "__at", "left_anti").isEmpty() and taken.join(free, "__at", "left_anti").isEmpty():
            break
        taken = free
    version = stores.where("__at IS NOT NULL").select("__at", F.col("version").alias("__new"))
    state = state.join(version, "__at", "left").select(
        F.col("__at").alias(order),
        F.when(F.col("__own").isNotNull() | (F.col("__by") == F.col("doc_id")), "unchanged").when(F.col("__by").isNotNull(), "duplicate").when(F.col("__new") > 1, "updated").otherwise("created").alias("action"),
        F.coalesce("__own", "__version", "__new").alias("version"),
    )
    return records.join(state, order)


def blank(text: Column) -> Column:
    """Null, or nothing but white space of any script."""
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)[^\s\x1c-\x1f]")


def readiness(records: DataFrame, doi_types: list[str]) -> DataFrame:
    """Adds missing_fields (of title, authors, year, source), warnings, ready, doi_status and message to records with these columns, doi
    and source_type. A document of `doi_types` without a doi is ready, with the warning doi_missing."""
    none = {"title": blank(F.col("title")), "authors": F.coalesce(F.size("authors"), F.lit(0)) <= 0, "year": F.col("year").isNull(), "source": blank(F.col("source"))}
    missing = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in none.items())))
    expected, has_doi = F.coalesce(F.lower("source_type").isin(doi_types), F.lit(False)), F.coalesce(F.col("doi") != "", F.lit(False))
    doi = F.when(has_doi, "valid").when(expected, "missing").otherwise("not_applicable")
    warnings = F.when(expected & ~has_doi, F.array(F.lit("doi_missing"))).otherwise(F.array().cast("array<string>"))
    message = F.when(F.size("missing_fields") > 0, F.concat(F.lit("publication requires: "), F.array_join("missing_fields", ", "))).when(F.size("warnings") > 0, "ready for publication with warning: DOI is missing").otherwise("ready for publication")
    return records.withColumns({"missing_fields": missing, "warnings": warnings, "ready": F.size(missing) == 0, "doi_status": doi}).withColumn("message", message)


def newest_versions(models: DataFrame, id_: str, version: str) -> DataFrame:
    """The row of the highest version of each model."""
    return models.withColumn("__n", F.row_number().over(Window.partitionBy(id_).orderBy(F.desc(version)))).where("__n = 1").drop("__n")


def reranked(candidates: DataFrame, scores: DataFrame, query: str, item: str, document: str, order: list, pool: int, per_document: int) -> DataFrame:
    """The pool of each query (at most per_document items of a document, then `pool` items in order), by its clamped rerank score."""
    within = Window.partitionBy(query, document).orderBy(*order)
    some = candidates.withColumn("__d", F.row_number().over(within)).where(F.col("__d") <= per_document)
    some = some.withColumn("__p", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("__p") <= pool)
    scored = some.join(scores, [query, item]).withColumn("rerank_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("rerank_score"))))
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("rerank_score"), "__p"))
    return scored.withColumn("place", place).drop("__d", "__p")


def two_budgets(facts: DataFrame, key: str, order: list, cost: str, guaranteed: Column, budget: int, spare: int) -> DataFrame:
    """Each key's longest affordable prefix in order: guaranteed facts from a budget of their own, all others from `budget`."""
    kind = facts.withColumn("guaranteed", guaranteed)
    used = F.sum(cost).over(Window.partitionBy(key, "guaranteed").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return kind.withColumn("used", used).where(F.col("used") <= F.when(F.col("guaranteed"), spare).otherwise(budget))


# --- columns and datasets ---------------------------------------------------------------------------------------------------------


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value as text) of all cells, in one pass."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.explode(cells).alias("c")).select("c.column", "c.value")


def column_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: rows, present, distinct."""
    counts = long_form(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("present"), F.count("value").alias("distinct"))


def categorical_profiles(df: DataFrame, columns: list[str], most: int = 20, top: int = 12) -> DataFrame:
    """The `top` values of each column of 2 to `most` distinct values, fewer than it has values."""
    counts = long_form(df, columns).where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    fit = counts.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"), F.sum("n").alias("present")).where((F.col("n_unique") >= 2) & (F.col("n_unique") <= most) & (F.col("n_unique") < F.col("present")))
    # at most `most` values of a column are left to rank
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    kept = counts.join(F.broadcast(fit.select("column", "n_unique")), "column").withColumn("place", place).where(F.col("place") <= top)
    return kept.select("column", "value", "n", "n_unique", (F.col("n_unique") > top).alias("truncated"))


#: Names of columns that number the rows, whole and in part.
ROW_IDS, ROW_ID_PARTS = ("id", "index", "序号"), ("sampleid", "recordid", "样本编号", "样本id")


def group_candidates(df: DataFrame, scores: dict[str, int], target: str | None = None) -> DataFrame:
    """Columns that may name groups: those whose name holds a key of `scores` (the highest score counts) and is no row id. Eligible with at
    most a fifth missing and 5 to max(5, min(100, a quarter of the rows)) groups; the best first by `place`."""
    plain = {c: "".join(x.lower() for x in c if x.isalnum()) for c in df.columns if c != target}
    named = {c: max((s for key, s in scores.items() if key in p), default=None) for c, p in plain.items() if p not in ROW_IDS and not any(part in p for part in ROW_ID_PARTS)}
    named = {c: s for c, s in named.items() if s is not None}
    score = F.element_at(F.create_map(*(F.lit(x) for pair in named.items() for x in pair)), F.col("column"))
    found = column_counts(df, list(named)).withColumn("score", score)
    most = F.greatest(F.lit(5), F.least(F.lit(100), F.bround(F.col("rows") * 0.25).cast("long")))
    missing = 1 - F.col("present") / F.col("rows")
    eligible = (missing <= 0.2) & F.col("distinct").between(5, most)
    order = Window.orderBy(F.desc("eligible"), F.desc("score"), "distinct", "column")  # a row for each column
    return found.withColumn("eligible", eligible).withColumn("place", F.row_number().over(order)).select("column", "score", F.col("distinct").alias("n_groups"), missing.alias("missing_fraction"), "eligible", "place")


def dataset_checks(df: DataFrame, x: str, y: str, least: int = 6, axis: list[float] | None = None) -> DataFrame:
    """Findings over a calibration set: code, severity, n (rows, values, positions or groups that the code is about).

    Numbers are looked at in one pass; constant positions (range up to 1e-12) and groups of equal spectra in one more each, if all are
    finite. Groups whose targets differ are an error, others a warning. Rows of several widths are the finding ragged_rows, and then
    neither positions nor groups are looked at."""
    v, bad = F.col(x).cast("array<double>"), lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf"))
    t = F.col(y).cast("double")
    rows = df.select(v.alias("v"), t.alias("t"))
    one = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.coalesce(F.size(F.filter("v", bad)), F.lit(1)).cast("long")), F.lit(0)).alias("bad_x"), F.count_if(bad(F.col("t"))).alias("bad_y"),
        (F.max("t") - F.min("t")).alias("range"), F.max(F.size("v")).alias("width"), F.min(F.size("v")).alias("least_width"),
    ).first()
    n, width = one["rows"], one["width"] or 0
    ragged = n > 0 and one["width"] != one["least_width"]
    found = [("insufficient_samples", "error", n, n < least), ("insufficient_wavelengths", "error", width, width < 2), ("ragged_rows", "error", 1, ragged)]
    found += [("nonfinite_spectra", "error", one["bad_x"], one["bad_x"] > 0), ("nonfinite_targets", "error", one["bad_y"], one["bad_y"] > 0)]
    found.append(("constant_targets", "error", 1, not one["bad_y"] and (one["range"] or 0.0) <= 1e-12))
    if n and not one["bad_x"] and not ragged:
        dead = dead_positions(df, x, 1e-12).count()
        found.append(("constant_wavelength_columns", "warning", dead, dead > 0))
        if not one["bad_y"]:
            same = rows.groupBy(F.sha2(F.to_json("v"), 256).alias("d")).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("low"), F.max("t").alias("high")).where("n > 1")
            differs = F.col("high") - F.col("low") > 1e-10 + 1e-7 * F.abs("low")
            groups = same.agg(F.count_if(differs).alias("conflicting"), F.count_if(~differs).alias("consistent")).first()
            found += [("conflicting_duplicate_spectra", "error", groups["conflicting"], groups["conflicting"] > 0), ("duplicate_spectra", "warning", groups["consistent"], groups["consistent"] > 0)]
    if axis is not None:
        found += _axis_findings(axis, width)
    kept = [(code, severity, int(k)) for code, severity, k, holds in found if holds]
    return df.sparkSession.createDataFrame(kept, "code string, severity string, n long")


def _axis_findings(axis: list[float], width: int) -> list[tuple]:
    steps = [b - a for a, b in zip(axis, axis[1:], strict=False)]
    wrong = sum(not math.isfinite(a) for a in axis)
    if len(axis) != width:
        return [("wavelength_length_mismatch", "error", len(axis), True)]
    if wrong:
        return [("nonfinite_wavelengths", "error", wrong, True)]
    if 0 in steps:
        return [("duplicate_wavelengths", "error", steps.count(0), True)]
    return [("nonmonotonic_wavelengths", "error", 1, any(s < 0 for s in steps) and any(s > 0 for s in steps))]


def dead_positions(df: DataFrame, x: str, within: float = 0.0) -> DataFrame:
    """Positions whose values differ by at most `within` over all rows."""
    cells = df.select(F.posexplode(F.col(x).cast("array<double>")).alias("pos", "v"))
    return cells.groupBy("pos").agg(F.min("v").alias("low"), F.max("v").alias("high")).where(F.col("high") - F.col("low") <= within).select("pos", F.col("low").alias("value"))


def by_column(df: DataFrame, column: str, roles: dict[str, str]) -> DataFrame:
    """Adds role, from explicit values of a column; rows of other values are in none and left out."""
    role = F.element_at(F.create_map(*(F.lit(x) for pair in roles.items() for x in pair)), F.col(column).cast("string"))
    return df.withColumn("role", role).where("role IS NOT NULL")


def partition_manifest(df: DataFrame, id_: str, role: str, version: int, parent: int | None = None) -> DataFrame:
    """One row for each role of a frozen partition: n, a digest that no order of rows changes, version and parent."""
    part = F.conv(F.substring(F.md5(F.col(id_).cast("string")), 1, 12), 16, 10).cast("decimal(38,0)")
    digest = F.sha2(F.concat_ws("|", F.sum(part).cast("string"), F.count(F.lit(1)).cast("string")), 256)
    return df.groupBy(role).agg(F.count(F.lit(1)).alias("n"), digest.alias("digest")).withColumns({"version": F.lit(version), "parent": F.lit(parent).cast("int")})


def paired(source: DataFrame, target: DataFrame, id_: str) -> DataFrame:
    """Per trimmed sample id: how often it stands in each instrument, and whether it can be paired: once in both."""
    key = F.trim(F.col(id_).cast("string")).alias("sample_id")
    both = source.select(key, F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(target.select(key, F.lit(0).alias("s"), F.lit(1).alias("t")))
    n = both.groupBy("sample_id").agg(F.sum("s").alias("in_source"), F.sum("t").alias("in_target"))
    return n.withColumn("paired", (F.col("in_source") == 1) & (F.col("in_target") == 1) & (F.col("sample_id") != ""))


def comparable_best(runs: DataFrame, context: list[str], experiment: str, error: str) -> DataFrame:
    """Per comparable context (rows of equal context columns): n, the experiment of least error and that error."""
    return runs.groupBy(*context).agg(F.count(F.lit(1)).alias("n"), F.min_by(experiment, F.struct(error, experiment)).alias("best"), F.min(error).alias("error"))


# --- resource samples -------------------------------------------------------------------------------------------------------------

#: Bytes of a memory unit, and cores of a processor unit.
MEMORY_UNITS = {"": 1, "Ki": 1024, "Mi": 1024**2, "Gi": 1024**3, "Ti": 1024**4, "K": 1000, "M": 1000**2, "G": 1000**3, "T": 1000**4}
CPU_UNITS = {"": 1.0, "m": 1e-3, "u": 1e-6, "n": 1e-9}


def quantity(text: Column, units: dict) -> Column:
    """The amount that a number with a unit says; null if it can't be read."""
    value = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)\s*$", 1)
    unit = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)\s*$", 2)
    factor = F.element_at(F.create_map(*(F.lit(x) for pair in units.items() for x in (pair[0], float(pair[1])))), unit)
    return F.when(value != "", value.cast("double") * factor)


def resource_summary(samples: DataFrame, group: str, memory: str, cpu: str) -> DataFrame:
    """Per group: n, total, mean and largest memory in bytes, total processor cores, and how many samples could not be read."""
    m, c = quantity(F.col(memory), MEMORY_UNITS), quantity(F.col(cpu), CPU_UNITS)
    read = samples.select(group, m.alias("__m"), c.alias("__c"))
    return read.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.sum("__m").alias("total_bytes"), F.avg("__m").alias("mean_bytes"), F.max("__m").alias("max_bytes"), F.sum("__c").alias("cores"), F.count_if(F.col("__m").isNull() | F.col("__c").isNull()).alias("unread"),
    )


# --- messages ---------------------------------------------------------------------------------------------------------------------

#: The marks around user text, and what stands for them inside it.
BEGIN, END = "--- BEGIN USER INPUT ---", "--- END USER INPUT ---"
NEUTRAL_BEGIN, NEUTRAL_END = "[BEGIN USER INPUT]", "[END USER INPUT]"


def guarded(text: Column, tags: list[str]) -> Column:
    """User text between marks: blocked tags are escaped, marks inside it are made harmless. Blank text stays; text that is wrapped
    already is wrapped no more."""
    tag = r"(?i)<\s*/?\s*(?:" + "|".join(map(re.escape, sorted(tags))) + r")\b[^>]*>?"
    found = F.transform(F.regexp_extract_all(text, F.lit(tag), F.lit(0)), lambda m: F.replace(F.replace(m, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")))
    escaped = F.array_join(F.zip_with(F.split(text, tag, -1), found, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    harmless = lambda t: F.replace(F.replace(t, F.lit(BEGIN), F.lit(NEUTRAL_BEGIN)), F.lit(END), F.lit(NEUTRAL_END))
    inner = F.substring(escaped, len(BEGIN) + 1, 1 << 30)
    inner = F.when(F.length(inner) >= len(END), F.left(inner, F.length(inner) - len(END))).otherwise("")
    wrapped = escaped.startswith(BEGIN) & escaped.endswith(END) & (F.length(escaped) >= len(BEGIN) + len(END))
    whole = F.when(wrapped, F.concat(F.lit(BEGIN), harmless(inner), F.lit(END))).otherwise(F.concat(F.lit(BEGIN + "\n"), harmless(escaped), F.lit("\n" + END)))
    return F.when(blank(text), text).otherwise(whole)
