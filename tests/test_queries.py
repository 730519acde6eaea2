import duckdb
import pytest

import __spark_entry__ as entry
from harrow import queries as engine

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = [n for n in engine.ORACLE_SQL if not n.startswith(("roundtrip", "ddinc", "scan"))]


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in found], key=repr)


@pytest.mark.parametrize("name", [*FAST, "ddinc_final", "roundtrip_columns_snz", "roundtrip_pcap_gz", "roundtrip_csv", "scan_chunk_limit", "scan_shard", "scan_columns"])
def test_same_rows_as_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    ours = engine.QUERIES[name](spark, data)
    found = con.execute(engine.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(ours.columns)
    assert rows(ours.columns, ours.collect()) == rows(columns, found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 685
    assert set(entry.oracle_sql()) <= set(entry.queries())
