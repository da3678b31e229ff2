"""Rule tables over metrics, spectra, evidence and text: gates, validation codes, support levels, entities, catalog search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrel.operators.metrics import DOMAINS


def tier(value: Column, good: float, above: float, below: float) -> Column:
    """excellent from good + above, good from good, fair from good - below, else poor; missing without a value."""
    return F.when(value.isNull(), "missing").when(value >= good + above, "excellent").when(value >= good, "good").when(value >= good - below, "fair").otherwise("poor")


def quality(metrics: DataFrame, domain: str = "default", r2: str = "r2", rpd: str = "rpd", rmsep: str | None = None, rmsecv: str | None = None) -> DataFrame:
    """Adds r2_status, rpd_status, grade (the worse of both; poor if either is missing), passed, and overfitting (RMSEP beyond twice RMSECV)."""
    least_r2, least_rpd = DOMAINS.get(domain, DOMAINS["default"])
    out = metrics.withColumns({"r2_status": tier(F.col(r2), least_r2, 0.10, 0.20), "rpd_status": tier(F.col(rpd), least_rpd, 1.0, 1.5)})
    order = F.array(*map(F.lit, ("missing", "poor", "fair", "good", "excellent")))
    worse = F.least(F.array_position(order, F.col("r2_status")), F.array_position(order, F.col("rpd_status")))
    grade = F.element_at(F.array(*map(F.lit, ("poor", "poor", "fair", "good", "excellent"))), worse.cast("int"))
    out = out.withColumn("grade", grade).withColumn("passed", F.col("grade").isin("excellent", "good"))
    return out.withColumn("overfitting", F.coalesce(F.col(rmsep) > 2 * F.col(rmsecv), F.lit(False))) if rmsep and rmsecv else out


def class_gate(metrics: DataFrame, balanced: float = 0.8, macro: float = 0.8, recall: float = 0.6) -> DataFrame:
    """metrics: balanced_accuracy, macro_f1, least_recall. Adds passed and grade A, B, C or F."""
    passed = (F.col("balanced_accuracy") >= balanced) & (F.col("macro_f1") >= macro) & (F.col("least_recall") >= recall)
    score = F.least("balanced_accuracy", "macro_f1", "least_recall")
    return metrics.withColumns({"passed": passed, "grade": F.when(passed & (score >= 0.9), "A").when(passed, "B").when(score >= 0.5, "C").otherwise("F")})


def drift_index(distances: DataFrame, distance: str = "distance", rpd: float | None = None) -> DataFrame:
    """min(1, mean distance / (3 RPD, or 9))."""
    return distances.agg(F.least(F.lit(1.0), F.avg(distance) / (3.0 * rpd if rpd and rpd > 0 else 9.0)).alias("drift_index"))


def row_checks(df: DataFrame, id_: str, x: str) -> DataFrame:
    """A row for each finding in a spectrum: id, code (empty, non_finite, all_zero, constant, negative), n values."""
    v = F.col(x).cast("array<double>")
    bad = lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf"))
    n = lambda test: F.size(F.filter(v, test))
    findings = F.array_compact(F.array(
        F.when(v.isNull() | (F.size(v) == 0), F.struct(F.lit("empty").alias("code"), F.lit(0).alias("n"))),
        F.when(F.exists(v, bad), F.struct(F.lit("non_finite").alias("code"), n(bad).alias("n"))),
        F.when((F.size(v) > 0) & F.forall(v, lambda a: a == 0), F.struct(F.lit("all_zero").alias("code"), F.size(v).alias("n"))),
        F.when((F.size(v) > 1) & ~F.exists(v, bad) & (F.array_max(v) == F.array_min(v)) & (F.array_max(v) != 0), F.struct(F.lit("constant").alias("code"), F.size(v).alias("n"))),
        F.when(F.exists(v, lambda a: a < 0), F.struct(F.lit("negative").alias("code"), n(lambda a: a < 0).alias("n"))),
    ))
    return df.select(id_, F.explode(findings).alias("f")).select(id_, "f.code", "f.n")


def outlying_targets(df: DataFrame, id_: str, y: str, z: float = 5.0) -> DataFrame:
    """Rows whose target lies beyond z sample standard deviations from the mean."""
    stats = df.agg(F.avg(y).alias("__m"), F.stddev_samp(y).alias("__s"))
    return df.join(F.broadcast(stats)).where((F.col("__s") > 0) & (F.abs(F.col(y) - F.col("__m")) > z * F.col("__s"))).select(id_, y, ((F.col(y) - F.col("__m")) / F.col("__s")).alias("z"))


def evidence(results: DataFrame, query: str, document: str, quality_tier: str, doi: str, purpose: str = "answer") -> DataFrame:
    """Per query: documents, acceptable (of tier A to C), with_doi, doi_completeness, support_level, ready."""
    by = results.groupBy(query, document).agg(F.bool_or(F.col(quality_tier).isin("A", "B", "C")).alias("ok"), F.bool_or(F.coalesce(F.col(doi), F.lit("")) != "").alias("has_doi"))
    n = by.groupBy(query).agg(F.count(F.lit(1)).alias("documents"), F.count_if("ok").alias("acceptable"), F.count_if("has_doi").alias("with_doi"))
    decision = (F.col("documents") >= 2) & (F.col("acceptable") >= 2)
    return n.withColumns({
        "doi_completeness": F.when(F.col("with_doi") == F.col("documents"), "complete").when(F.col("with_doi") > 0, "partial").otherwise("missing"),
        "support_level": F.when(decision & (F.col("documents") >= 3), "strong").when(decision, "moderate").otherwise("limited"),
        "ready": decision if purpose == "decision" else F.lit(True),
    })


def entities(documents: DataFrame, id_: str, text: str, dictionary: dict[str, dict[str, list[str]]]) -> DataFrame:
    """Dictionary terms in texts: id, category, names (sorted). Latin aliases stand as whole words, others anywhere; case doesn't count."""

    def hit(aliases: list[str]) -> Column:
        parts = [rf"(?<![\p{{L}}\p{{N}}]){re.escape(a)}(?![\p{{L}}\p{{N}}])" if a.isascii() else re.escape(a) for a in aliases]
        return F.col(text).rlike("(?iu)" + "|".join(parts))

    found = F.array_compact(F.array(*(F.when(hit([name, *aliases]), F.struct(F.lit(category).alias("category"), F.lit(name).alias("name"))) for category, names in dictionary.items() for name, aliases in names.items())))
    return documents.select(id_, F.explode(found).alias("e")).groupBy(id_, "e.category").agg(F.array_sort(F.collect_set("e.name")).alias("names"))


def merged_entities(found: DataFrame, *keys: str) -> DataFrame:
    """The union of the names of each category over chunks."""
    return found.groupBy(*keys, "category").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))


def catalog_search(catalog: DataFrame, name: str, description: str, query: str, k: int = 5) -> DataFrame:
    """select:a,b names them; +word rest requires the word in the name and ranks by matches of the rest; else a pattern, the name counting double."""
    both = F.concat_ws(" ", name, F.coalesce(description, F.lit("")))
    query = query.strip()
    if query.startswith("select:"):
        found = catalog.where(F.col(name).isin([n.strip() for n in query[7:].split(",")])).withColumn("score", F.lit(1))
    elif query.startswith("+"):
        required, _, rest = query[1:].partition(" ")
        score = F.regexp_count(both, F.lit(f"(?i){rest.strip()}")) if rest.strip() else F.lit(1)
        found = catalog.where(F.lower(name).contains(required.lower()) & F.lit(bool(required))).withColumn("score", score)
    else:
        pattern = f"(?i){query}"
        found = catalog.where(both.rlike(pattern) & F.lit(bool(query))).withColumn("score", F.when(F.col(name).rlike(pattern), 2).otherwise(1))
    return found.orderBy(F.desc("score"), name, *catalog.columns).limit(k)


def preview(text: Column, head: int = 2000, tail: int = 1000) -> Column:
    """A long text's head and tail with a note of what is left out; the head ends at a line end of its second half, if there is one."""
    start = F.substring(text, 1, head)
    line = F.length(start) - F.instr(F.reverse(start), "\n") + 1
    kept = F.when((F.instr(F.reverse(start), "\n") > 0) & (line > head / 2), F.substring(text, F.lit(1), line.cast("int"))).otherwise(start)
    note = F.concat(F.lit("\n... "), (F.length(text) - F.length(kept) - tail).cast("string"), F.lit(" characters left out ...\n"))
    return F.when(F.length(text) > head + tail, F.concat(kept, note, F.right(text, F.lit(tail)))).otherwise(text)


def word_edges(pattern: str) -> str:
    """The pattern with \\b as the edge of a run of [A-Za-z0-9_], as SQL has it; what Java's own \\b takes as a letter depends on its version."""
    before, after = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
    pattern = re.sub(r"(?<!\\)\\b(?=[A-Za-z0-9_])", before, pattern)  # the cheap form where a letter stands behind it
    edge = f"(?:(?<=[A-Za-z0-9_]){after}|{before}(?=[A-Za-z0-9_]))"
    return re.sub(r"\\(.)", lambda m: edge if m[1] == "b" else m[0], pattern, flags=re.DOTALL)


def scrubbed(text: Column, pattern: str) -> Column:
    """The text without the sentences that match, double blanks squeezed."""
    pattern = word_edges(pattern)
    kept = F.regexp_replace(text, rf"(?i)[^.!?\n]*(?:{pattern})[^.!?\n]*[.!?]?", "")
    return F.trim(F.regexp_replace(F.when(text.rlike(f"(?i)(?:{pattern})"), kept).otherwise(text), " {2,}", " "))


def facts(df: DataFrame, owner: str, content: str, confidence: str, order: list, least: float = 0.7, most: int = 100) -> DataFrame:
    """Per owner: confident facts, one for each content (case and outer blanks don't count), the best `most`."""
    key = F.lower(F.trim(content))
    kept = df.where(F.col(confidence) >= least).withColumn("__k", F.row_number().over(Window.partitionBy(owner, key).orderBy(*order))).where("__k = 1").drop("__k")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc(confidence), *order))).where(F.col("rank") <= most)


def best_version(versions: DataFrame, model: str, version: str, metric: str) -> DataFrame:
    """Per model: latest, and best (largest metric, the earliest of equals; a missing metric counts least)."""
    return versions.groupBy(model).agg(F.max(version).alias("latest"), F.max_by(version, F.struct(F.coalesce(F.col(metric), F.lit(float("-inf"))), -F.col(version))).alias("best"))


def improvement(before: Column, after: Column) -> Column:
    """By how many percent an error fell."""
    return F.when(before > 0, 100 * (before - after) / before)


def adopted(before: Column, after: Column, least: float = 0.5) -> Column:
    """Whether an alternative's error is at least `least` percent better."""
    return F.coalesce(improvement(before, after) >= least, F.lit(False))


def trace_scores(checks: DataFrame, trace: str) -> DataFrame:
    """checks: trace, name, value (0 to 1), weight. Per trace: score (0 to 100) and passed (every value is 1)."""
    return checks.groupBy(trace).agg(F.coalesce(F.round(100 * F.try_divide(F.sum(F.col("value") * F.col("weight")), F.sum("weight")), 2), F.lit(0.0)).alias("score"), F.bool_and(F.col("value") == 1).alias("passed"))


def coverage(required: Column, seen: Column) -> Column:
    """The share of required entries that were seen; 1 if none is required."""
    return F.when(F.size(required) == 0, 1.0).otherwise(F.size(F.array_intersect(required, seen)) / F.size(F.array_distinct(required)))


def suite(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.avg("score").alias("mean_score"))
