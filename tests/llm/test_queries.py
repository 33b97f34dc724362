"""Registered queries of the operators: names, columns and SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id n_bytes n_removed n_spans kept_sha256", "op2": "doc_id size source_size target taken", "op3": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op4": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op5": "page_id url text n_chars", "op6": "doc_id contaminated", "op7": "doc_id held_out score predicted", "op8": "doc_id keep_id group_size kept text_sha256", "op9": "doc_id n_shingles component_id kept", "op10": "doc_id held_out lang_pred score",
    "op11": "word form root n n_near form_n", "op12": "page_id host path rule verdict",
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("op", COLUMNS)
def test_contract(spark, op):
    name = next(n for n in entry.queries() if n.startswith(op + "_"))
    df = entry.queries()[name](spark, SF)
    assert set(COLUMNS[op].split()) <= set(df.columns)
    sql = entry.oracle_sql().get(name)
    if not sql:
        assert df.count() > 0
        return
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(sql).df()
    got = df.toPandas()[list(want.columns)]
    key = want.columns[0]
    want, got = want.sort_values(key).reset_index(drop=True), got.sort_values(key).reset_index(drop=True)
    for c in want.columns:
        same = (want[c] == got[c]) | (want[c].isna() & got[c].isna())
        assert same.all() or (want[c] - got[c]).abs().max() < 1e-6, c
