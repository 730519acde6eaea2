import json

from pyspark.sql import functions as F

from harrow import cli
from harrow.metrics import Counters, Sampler
from harrow.operators import mapreduce as mr
from harrow.queries import full_visits
from harrow.sources import catalog
from harrow.sources.tables import stream_table, write_table
from harrow.streaming.incremental import keep_changes, keep_count, keep_sums, stream_chunks


def test_epochs_and_retractions(spark, tmp_path):
    schema = "key string, value double, weight long"
    spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 1)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    kind = spark.read.parquet(str(tmp_path / "in")).schema
    seen = []
    upkeep = keep_sums(stream_chunks(spark, str(tmp_path / "in"), kind), str(tmp_path / "state"), seen.append, str(tmp_path / "sums"))
    upkeep.settle()
    spark.createDataFrame([("c", 4.0, 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    upkeep.settle()
    spark.createDataFrame([("b", 2.0, -1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    upkeep.settle()
    upkeep.stop()
    assert [(e.n_groups, e.total_revenue) for e in upkeep.epochs] == [(2, 3.0), (3, 7.0), (2, 5.0)] and seen == upkeep.epochs
    assert {r["key"] for r in spark.read.parquet(str(tmp_path / "sums")).collect()} == {"a", "c"}
    changes = keep_changes(stream_chunks(spark, str(tmp_path / "in"), kind), str(tmp_path / "changes_state"), str(tmp_path / "changes"))
    changes.settle()
    changes.stop()
    parts = [{(r["key"], r["total"], r["weight"]) for r in spark.read.parquet(str(tmp_path / f"changes/epoch={i}")).collect()} for i in range(3)]
    assert parts == [{("a", 1.0, 1), ("b", 2.0, 1)}, {("c", 4.0, 1)}, {("b", 0.0, 0)}]
    count = keep_count(stream_chunks(spark, str(tmp_path / "in"), kind, chunks_per_epoch=None), str(tmp_path / "count"), "keys_so_far")
    count.processAllAvailable()
    count.stop()
    assert spark.table("keys_so_far").first()[0] == 3


def test_map_reduce(spark):
    rows = spark.range(1000).withColumn("k", F.col("id") % 7)
    found = mr.map_par_reduce(rows, lambda r: [(r["k"], r["id"])] * 2 if r["id"] % 2 else [], lambda a, b: a + b, "key long, value long", 3)
    assert {r["key"]: r["value"] for r in found.collect()} == {k: 2 * sum(i for i in range(1000) if i % 2 and i % 7 == k) for k in range(7)}
    assert found.select("partition").distinct().count() <= 3 and mr.map_reduce(rows.limit(0), list, max, "key long, value long").count() == 0
    nulls = spark.createDataFrame([(None, 1), (None, 2)], "k string, v long")
    assert [tuple(r) for r in mr.map_reduce(nulls, lambda r: mr.one(r["k"], r["v"]), max, "key string, value long").collect()] == [(None, 2)]
    assert mr.fold_values([3, 1], min) == 1 and mr.filter_count(rows, F.col("id") > 10).first()["n"] == 989


def test_command_line(spark, data, tmp_path, capsys):
    write_table(full_visits(spark, data).repartition(3), catalog.directory(str(tmp_path), "columns-snz", "tiny", "uservisits"), "uservisits", "columns-snz")
    args = ["query2", "-s", "tiny", "--root", str(tmp_path)]
    groups = []
    for more in ([], ["-r", "tries"], ["-r", "timely"], ["-r", "dd", "-m", str(tmp_path / "samples")], ["-p", "-b", "4", "--sip", "--hosts", "x", "--me", "0"], ["-r", "ddinc"]):
        assert cli.main(args + more) == 0
        groups.append(json.loads(capsys.readouterr().out.splitlines()[-1])["n_groups"])
    assert len(set(groups)) == 1 and groups[0] > 100
    last = json.loads((tmp_path / "samples").read_text().splitlines()[-1])
    assert last["resident_bytes"] > 0 and last["target"] == last["progress"] == 3 and last["read"] == 1000 and last["aggreg"] == groups[0]
    catalog_path = catalog.directory(str(tmp_path), "columns-snz", "tiny", "uservisits")
    seen = []
    upkeep = keep_sums(stream_table(spark, catalog_path, "uservisits", "columns-snz", ["source_ip", "ad_revenue"], 2).selectExpr("source_ip as key", "ad_revenue as value", "1L as weight"), str(tmp_path / "state"), seen.append)
    upkeep.settle()
    upkeep.stop()
    assert len(seen) == 2 and seen[0].n_groups <= seen[1].n_groups
    write_table(spark.createDataFrame([("u", 11, 1), ("v", 10, 1)], "url string, pagerank long, duration long"), catalog.directory(str(tmp_path), "rmp-gz", "tiny", "rankings"), "rankings", "rmp-gz")
    assert cli.main(["query1", "-s", "tiny", "--root", str(tmp_path)]) == 0 and capsys.readouterr().out.strip() == "1"
    assert cli.main(["pack", "uservisits", "pbuf-gz", "--source", "columns-snz", "-s", "tiny", "--root", str(tmp_path)]) == 0


def test_counters(spark, tmp_path):
    counters = Counters()
    counters.count(spark.range(10), "read").groupBy().sum().collect()
    assert counters.values() == {"read": 10}
    with Sampler(str(tmp_path / "s"), 0.01, lambda: {"rows": 1}) as sampler:
        sampler.progress = lambda: {"rows": 2}
    assert json.loads((tmp_path / "s").read_text().splitlines()[-1])["rows"] == 2
    seen = []
    mr.foreach(spark.range(0), seen.append)
    assert seen == []
    total = spark.sparkContext.accumulator(0)
    mr.foreach(spark.range(10), lambda r: total.add(r["id"]))
    assert total.value == 45
