"""What SQL users call by name: array kernels and token estimates as SQL functions, chunking as a table function.

The scalar functions are SQL expressions, so they are inlined into a query's plan and stay in the JVM. The table function runs in
Python workers, a text at a time. All are temporary: register() makes them known to one session, however often it is called.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from spectrel.operators import chunking

_A = "ARRAY<DOUBLE>"
_NONE = "CAST(array() AS ARRAY<DOUBLE>)"


def _bound(value: str, name: str, body: str) -> str:
    """An expression in which a value has a name, so that it is computed once and not for each element."""
    return f"transform(array({value}), {name} -> {body})[0]"


_SUM = "aggregate(x, 0D, (s, v) -> s + {})"
#: name: (parameters, result, expression).
SCALARS = {
    "array_mean": (f"x {_A}", "DOUBLE", f"CASE WHEN size(x) > 0 THEN {_SUM.format('v')} / size(x) END"),
    "snv": (
        f"x {_A}",
        _A,
        "CASE WHEN size(x) > 0 THEN "
        + _bound(f"{_SUM.format('v')} / size(x)", "m", _bound(f"sqrt({_SUM.format('(v - m) * (v - m)')} / size(x))", "d", "transform(x, v -> CASE WHEN d = 0 THEN 0D ELSE (v - m) / d END)"))
        + f" WHEN x IS NOT NULL THEN {_NONE} END",
    ),
    "l2_normalized": (f"x {_A}", _A, "CASE WHEN x IS NOT NULL THEN " + _bound(f"sqrt({_SUM.format('v * v')})", "d", "transform(x, v -> CASE WHEN d = 0 THEN 0D ELSE v / d END)") + " END"),
    "array_difference": (f"x {_A}", _A, "CASE WHEN size(x) > 1 THEN transform(sequence(1, size(x) - 1), i -> x[i] - x[i - 1]) WHEN x IS NOT NULL THEN CAST(array() AS ARRAY<DOUBLE>) END"),
    "array_dot": (f"x {_A}, y {_A}", "DOUBLE", "aggregate(zip_with(x, y, (a, b) -> a * b), 0D, (s, v) -> s + v)"),
    "estimated_tokens": ("text STRING", "INT", "regexp_count(text, r'{token}')".format(token=chunking.TOKEN)),
}


@udtf(returnType="chunk_index int, section_path array<string>, content string, tokens int, page_start bigint, page_end bigint")
class Chunks:
    """The chunks of a text: text, tokens of a chunk, strategy (paragraphs, sections or questions)."""

    def eval(self, text, most, strategy):
        if strategy not in chunking.STRATEGIES or most is None or most < 1:
            raise ValueError(f"strategy is one of {chunking.STRATEGIES}, a chunk holds one token at least")
        for i, c in enumerate(chunking.chunked(text or "", most, 0, strategy)):
            yield i, c["section_path"], c["content"], c["tokens"], c["page_start"], c["page_end"]


def register(spark: SparkSession) -> None:
    for name, (parameters, result, expression) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {expression}")
    spark.udtf.register("text_chunks", Chunks)
