"""The queries of this subpackage by name, and their DuckDB oracles where SQL can express them."""

from __future__ import annotations

from spectrel.llm import (
    queries_collocations,
    queries_decontaminate,
    queries_fingerprints,
    queries_licenses,
    queries_lm,
    queries_neardup,
    queries_packing,
    queries_pii,
    queries_quality,
    queries_runs,
    queries_urlfilter,
    queries_warc,
    queries_wrappers,
)

QUERIES = {
    f.__name__: f
    for f in (
        queries_pii.op1_pii,
        queries_decontaminate.op2_decontaminate,
        queries_quality.op3_quality,
        queries_packing.op4_pack,
        queries_lm.op5_kneser_ney,
        queries_warc.op6_warc,
        queries_licenses.op7_licenses,
        queries_fingerprints.op8_fingerprints,
        queries_neardup.op9_near_duplicates,
        queries_urlfilter.op10_url_filter,
        queries_runs.op11_periodic_runs,
        queries_wrappers.op12_html_extraction,
        queries_collocations.op13_collocations,
    )
}
ORACLES = {"op2_decontaminate": queries_decontaminate.SQL, "op6_warc": queries_warc.SQL, "op12_html_extraction": queries_wrappers.SQL, "op13_collocations": queries_collocations.SQL}
