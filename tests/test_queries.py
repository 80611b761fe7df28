"""Every core query on the smallest tables, against DuckDB where SQL is given."""

import glob
import os

import duckdb
import pytest

from lectern.plans.queries import ORACLES, QUERIES
from lectern.plans.views import TABLE_PAYLOADS, view

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(names, values):
    at = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(tuple(plain(r[i]) for i in at) for r in values) if all(v is not None for r in values for v in r) else sorted((tuple(plain(r[i]) for i in at) for r in values), key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert got or name == "fold_ledger_budget"
        return
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, want.fetchall())


def test_payloads_are_whole_tables(spark, con):
    """Every row of the tables is routed and reduced, and the literals reach each compressor."""
    want = dict(con.execute("SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'event_items', count(DISTINCT user_id) FROM events").fetchall()) | {"literal": 19}
    routes = QUERIES["route_payloads"](spark, SF).collect()
    reduced = QUERIES["payload_reduction"](spark, SF).collect()
    for found in (routes, reduced):
        assert {s: sum(r.source == s for r in found) for s in want} == want and len(found) == sum(want.values())
    assert {(r.source, r.payload_id, r.compressor) for r in routes} == {(r.source, r.payload_id, r.compressor) for r in reduced}
    of = {r.payload_id: r for r in routes if r.source == "literal"}
    assert all(of[k].content_type == "source_code" for k in (4, 10, 11, 12, 13, 14)) and all(of[k].compressor == "log_stripper" for k in range(15, 20))
    arrays = dict(con.execute("""SELECT user_id, string_agg('{"id":' || event_id || ',"note":"' || repeat('n', CAST(event_id % 23 AS INT)) || '","type":"' || event_type || '"}', ',' ORDER BY event_id) FROM events GROUP BY user_id""").fetchall())
    given = {r.payload_id: r.content for r in view(spark, SF, TABLE_PAYLOADS).where("source = 'event_items'").collect()}
    assert given == {k: f"[{v}]" for k, v in arrays.items()}
    assert {r.compressor for r in routes if r.source == "event_items"} == {"smart_crusher"}


def test_code_and_traces_cover_whole_tables(spark, con):
    """Comments go from the code literals, the five traces are found, and no payload is left out."""
    whole = {(r.source, r.payload_id): r.content for r in view(spark, SF, TABLE_PAYLOADS).collect()}
    code = {(r.source, r.payload_id): r.content for r in QUERIES["code_strip"](spark, SF).collect()}
    traces = {(r.source, r.payload_id): r for r in QUERIES["stack_traces"](spark, SF).collect()}
    assert set(code) == set(traces) == set(whole)
    assert all("# comment" not in code["literal", k] and "// note" not in code["literal", k] for k in (4, 10, 11, 13, 14))
    assert code["literal", 4] == "import os\ndef f(x):\n\n    return x\nclass A:\n    pass"
    assert {k for (s, k), r in traces.items() if s == "literal" and r.n_lines} == {15, 16, 17, 18, 19}
