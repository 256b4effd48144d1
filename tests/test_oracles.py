"""Registered queries against their DuckDB oracles on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = (
    "counterparties b1_first_write b2_new_addresses b6_comparable_window c1_utxo_recipients c3_supernode_cap c4_trace d1_attribution d8_usd_value g3_peel_chain g5_fan_in h10_exit_ladder "
    "f5_reconcile a1_utxo_movements a6_receipt_logs a8_balance_deltas e1_labelpacks e3_quoted_reserves e4_sanctions e4_shapes e6_tag_claims e6_contested_tags c13_ledger_levels c6_pursuit_stops h12_stamped_findings j2_answers j15_address_summary"
).split()


def plain(rows):
    """Rows as comparable text, floats to nine places."""
    told = lambda v: f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted("|".join(map(told, r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    mine = entry.queries()[name](spark, DATA)
    theirs = con.sql(entry.oracle_sql()[name])
    columns = sorted(theirs.columns)
    assert sorted(mine.columns) == columns
    a = plain(tuple(r[c] for c in columns) for r in mine.collect())
    b = plain(theirs.select(*[f'"{c}"' for c in columns]).fetchall())
    assert a == b


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
