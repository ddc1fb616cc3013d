"""Driver contract: entry() runs; every query has an oracle unless documented."""

import __spark_entry__ as entry
from revlens import registry

ROWS_ONLY = set()  # queries without SQL twin (none at the moment)


def test_every_query_has_oracle():
    q, o = registry.queries(), registry.oracle_sql()
    assert set(q) - set(o) == ROWS_ONLY
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(q) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["query_id", "n_matches", "prompt"]
    assert len(rows) > 0 and all(r.prompt for r in rows)
