"""Every query of the subpackage over the smallest tables: against its SQL, or for its rows and columns alone."""

import os

import duckdb
import pytest

from spectrel.llm import registry
from tests.test_queries import SF, TABLES, plain

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")

COLUMNS = {
    "op1_": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op2_": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op3_": {"doc_id", "held_out", "score", "predicted"},
    "op4_": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op5_": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op6_": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op7_": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    "op8_": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op9_": {"doc_id", "n_shingles", "component_id", "kept"},
    "op10_": {"page_id", "host", "path", "rule", "verdict"},
    "op11_": {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
    "op12_": {"page_id", "url", "text", "n_chars"},
    "op13_": {"lang", "rank", "phrase", "a", "l", "r", "n", "score"},
}


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert COLUMNS[name[: name.index("_") + 1]] <= set(df.columns)
    rows = df.collect()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    if name in registry.ORACLES:
        found = con.execute(registry.ORACLES[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in rows) == sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
    elif not name.startswith("op4_"):  # which has a row for each piece
        key = "page_id" if "page_id" in df.columns else "doc_id"
        table = "pages" if key == "page_id" else "documents"
        assert sorted(r[key] for r in rows) == sorted(r[0] for r in con.execute(f"SELECT {key} FROM {table}").fetchall())
