"""The engine's queries: name to function of (session, folder), and the SQL that gives the same rows."""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions.keys import WIDTHS, double_sum, empty_key, prefix_key, prefix_text, trie_bucket
from harrow.operators import mapreduce as mr
from harrow.operators.multiset import consolidate, weighted_groups, weighted_sums
from harrow.plans.strategies import STRATEGIES, aggregate, bucket_sizes, by_partition, group_count
from harrow.sources import catalog
from harrow.sources.tables import read_table, write_table
from harrow.streaming.incremental import initial_share, keep_sums, stream_chunks
from harrow.views import RK, RK_WIDE, UV_SQL, rankings, uservisits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


def pairs(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    return uservisits(spark, sf_dir).select(prefix_key(F.col("source_ip"), k).alias("key"), F.col("ad_revenue").alias("value"))


#: Decimals that the queries show of sums: double sums of two engines differ in their last digits.
DIGITS = 6


def shown(sums: DataFrame) -> DataFrame:
    return sums.select(F.col("key").cast("string").alias("ip_prefix"), F.round("total", DIGITS).alias("total_revenue"))


def rounded(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.round(c, DIGITS) for c in columns})


def revenue_sql(k: int) -> str:
    return f"select rpad(source_ip, {k}, ' ') as ip_prefix, round(sum(ad_revenue), {DIGITS}) as total_revenue from {UV_SQL} group by 1"


for k in WIDTHS:
    query(f"q2_revenue_k{k}", revenue_sql(k))(lambda spark, d, k=k: shown(aggregate(pairs(spark, d, k))))
    query(f"q2_groups_k{k}", f"select count(*) as n_groups, round(sum(total_revenue), {DIGITS}) as total_revenue from ({revenue_sql(k)})")(
        lambda spark, d, k=k: rounded(group_count(aggregate(pairs(spark, d, k))), "total_revenue")
    )
for strategy in STRATEGIES:
    query(f"q2_{strategy}", revenue_sql(8))(lambda spark, d, s=strategy: shown(aggregate(pairs(spark, d), s, partial=False, buckets=32)))


@query("q1_filter_count", f"select count(*) as n from ({RK}) where pagerank > 10")
def q1_filter_count(spark, d):
    return mr.filter_count(rankings(spark, d), F.col("pagerank") > 10)


def regex_count(spark: SparkSession, d: str, digits: int) -> DataFrame:
    return mr.filter_count(rankings(spark, d, wide=True), F.col("pagerank").cast("string").rlike(f"[0-9]{{{digits}}}"))


for digits in (2, 4):
    query(f"q1_regex{digits}", f"select count(*) as n from ({RK_WIDE}) where regexp_matches(cast(pagerank as varchar), '[0-9]{{{digits}}}')")(lambda spark, d, n=digits: regex_count(spark, d, n))


@query("project_pairs", f"select rpad(source_ip, 8, ' ') as ip_prefix, cast(ad_revenue as float)::double as value, cast(8 as bigint) as n_bytes from {UV_SQL}")
def project_pairs(spark, d):
    rows = pairs(spark, d)
    return rows.select(F.col("key").cast("string").alias("ip_prefix"), F.col("value").cast("float").cast("double").alias("value"), F.octet_length("key").cast("long").alias("n_bytes"))


@query("empty_keys", "select cast(n as integer) as k, rpad('', cast(n as integer), ' ') as key from range(8, 13) t(n)")
def empty_keys(spark, d):
    row = spark.range(1)
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), empty_key(k).cast("string").alias("key")) for k in WIDTHS])).alias("x")).select("x.k", "x.key")


@query("mr_emit_none", f"select source_ip as key, ad_revenue as value from {UV_SQL} where ad_revenue > 50")
def mr_emit_none(spark, d):
    rows = mr.emit_where(uservisits(spark, d), F.col("ad_revenue") > 50)
    return mr.emit_one(rows, F.col("source_ip"), F.col("ad_revenue"))


@query("mr_emit_one", f"select rpad(source_ip, 8, ' ') as key, round(sum(ad_revenue), {DIGITS}) as value from {UV_SQL} group by 1")
def mr_emit_one(spark, d):
    rows = mr.emit_one(uservisits(spark, d), prefix_text(F.col("source_ip"), 8), F.col("ad_revenue"))
    return rounded(mr.reduce_pairs(rows, double_sum), "value")


@query("mr_emit_vec", f"select key, count(*) as value from (select unnest(['ip:' || source_ip, 'u:' || user_id]) as key from {UV_SQL}) group by 1")
def mr_emit_vec(spark, d):
    user = F.concat(F.lit("u:"), F.col("user_id"))
    rows = mr.emit_many(uservisits(spark, d), [(F.concat(F.lit("ip:"), F.col("source_ip")), F.lit(1)), (user, F.lit(1))])
    return mr.reduce_pairs(rows, F.count)


@query("mr_map_reduce", f"select source_ip as key, count(*) + sum(event_id % 3) as value from {UV_SQL} where event_id % 2 = 0 group by 1")
def mr_map_reduce(spark, d):
    """A mapper that gives none, one or two pairs, in Python."""
    rows = uservisits(spark, d).select("source_ip", "event_id")
    give = lambda r: mr.none() if r["event_id"] % 2 else mr.many([(r["source_ip"], 1), (r["source_ip"], r["event_id"] % 3)])
    return mr.map_reduce(rows, give, lambda a, b: a + b, "key string, value long")


@query("mr_map_par_reduce", f"select source_ip as key, max(event_id) as value from {UV_SQL} group by 1")
def mr_map_par_reduce(spark, d):
    rows = uservisits(spark, d).select("source_ip", "event_id")
    return mr.map_par_reduce(rows, lambda r: mr.one(r["source_ip"], r["event_id"]), max, "key string, value long", 8).select("key", "value")


for name in ("min", "max"):
    query(f"mr_{name}", f"select rpad(source_ip, 8, ' ') as key, {name}(ad_revenue) as value from {UV_SQL} group by 1")(
        lambda spark, d, f=getattr(F, name): mr.reduce_pairs(mr.emit_one(uservisits(spark, d), prefix_text(F.col("source_ip"), 8), F.col("ad_revenue")), f)
    )


def weighted_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every visit once, and every tenth taken back."""
    rows = uservisits(spark, d).select(prefix_key(F.col("source_ip"), 12).alias("key"), F.col("ad_revenue").alias("value"), "event_id")
    back = rows.where("event_id % 10 = 0").withColumn("weight", F.lit(-1).cast("long"))
    return rows.withColumn("weight", F.lit(1).cast("long")).unionByName(back).drop("event_id")


WEIGHTED_SQL = f"(select rpad(source_ip, 12, ' ') as key, ad_revenue as value, 1 as weight from {UV_SQL} union all select rpad(source_ip, 12, ' '), ad_revenue, -1 from {UV_SQL} where event_id % 10 = 0)"
WEIGHTED_SUMS = f"select key, round(sum(value * weight), {DIGITS}) as total, cast(sum(weight) as bigint) as weight from {WEIGHTED_SQL} group by 1 having sum(weight) <> 0"


@query("dd_weighted_sum", WEIGHTED_SUMS)
def dd_weighted_sum(spark, d):
    return rounded(weighted_sums(weighted_rows(spark, d)), "total").withColumn("key", F.col("key").cast("string"))


@query("dd_weighted_groups", f"select count(*) as n_groups, round(sum(total), {DIGITS}) as total_revenue from ({WEIGHTED_SUMS})")
def dd_weighted_groups(spark, d):
    return rounded(weighted_groups(weighted_rows(spark, d)), "total_revenue")


@query("dd_consolidate", f"select key, value, cast(sum(weight) as bigint) as weight from {WEIGHTED_SQL} group by 1, 2 having sum(weight) <> 0")
def dd_consolidate(spark, d):
    return consolidate(weighted_rows(spark, d)).withColumn("key", F.col("key").cast("string"))


@query("dd_map_constant", f"select count(*) as n from (select distinct rpad(source_ip, 8, ' ') from {UV_SQL})")
def dd_map_constant(spark, d):
    """Each group mapped to a constant, and these counted; the sums stay in the plan as a filter that all pass."""
    groups = aggregate(pairs(spark, d)).where(F.col("total").isNotNull())
    return groups.select(F.lit(1).alias("one")).agg(F.sum("one").alias("n"))


@query("ddinc_final", revenue_sql(8))
def ddinc_final(spark, d):
    """Upkeep over 20 chunks: 95 of 100 first, then one at a time. The sums after the last."""
    root = catalog.shared_folder(spark)
    rows = pairs(spark, d).select("key", F.col("value").cast("double").alias("value"), F.lit(1).cast("long").alias("weight"))
    rows.repartition(20).write.parquet(f"{root}/staged")
    system, inside = catalog.filesystem(root)
    staged = sorted(i.path for i in system.get_file_info(fs.FileSelector(f"{inside}/staged")) if i.path.endswith(".parquet"))
    system.create_dir(f"{inside}/arrived", recursive=True)
    upkeep = keep_sums(stream_chunks(spark, f"{root}/arrived", rows.schema, chunks_per_epoch=None), f"{root}/state", sink=f"{root}/sums")
    first = initial_share(len(staged))
    for part in (staged[:first], *[[s] for s in staged[first:]]):
        for path in part:
            system.move(path, posixpath.join(inside, "arrived", posixpath.basename(path)))
        upkeep.settle()
    upkeep.stop()
    return shown(spark.read.parquet(f"{root}/sums"))


def full_visits(spark: SparkSession, d: str) -> DataFrame:
    """All nine columns."""
    return spark.sql(FULL.format(str="string").replace("from events", "from {t}"), t=spark.read.parquet(f"{d}/events.parquet"))


FULL = """select concat(cast(100 + user_id % 100 as {str}), '.', cast(event_id % 7 as {str})) as source_ip, concat('http://x/', cast(user_id as {str}), '?a=,"b"') as dest_url,
  substr(cast(ts as {str}), 1, 10) as visit_date, cast(value as float) as ad_revenue, event_type as user_agent, substr(event_type, 1, 2) as country_code, 'en' as language_code,
  'é' as search_word, event_id as duration from events"""
FULL_SQL = f"select * replace (cast(ad_revenue as double) as ad_revenue) from ({FULL.format(str='varchar')})"


def round_trip(spark: SparkSession, d: str, fmt: str) -> DataFrame:
    path = catalog.directory(catalog.shared_folder(spark), fmt, "tiny", "uservisits")
    write_table(full_visits(spark, d).repartition(4), path, "uservisits", fmt)
    return read_table(spark, path, "uservisits", fmt).withColumn("ad_revenue", F.col("ad_revenue").cast("double"))


#: Every encoding once, and every codec.
ROUND_TRIPS = ("text-deflate", "csv", "csv-gz", "json", "json-deflate", "bincode-snz", "cbor-lz4", "rmp-gz", "cap", "pcap-gz", "mcap", "mcap-lz4", "pbuf", "columns-snz", "parquet", "orc")
for name in ROUND_TRIPS:
    query(f"roundtrip_{name.replace('-', '_')}", FULL_SQL)(lambda spark, d, f=name: round_trip(spark, d, f))


def chunked(spark: SparkSession, d: str, fmt: str = "rmp") -> str:
    """Eight chunks, chunk i with the visits whose number modulo 8 is i."""
    path = catalog.directory(catalog.shared_folder(spark), fmt, "tiny", "uservisits")
    write_table(full_visits(spark, d).repartitionById(8, (F.col("duration") % 8).cast("int")), path, "uservisits", fmt)
    return path


@query("scan_chunk_limit", f"select count(*) as n, sum(duration) as total from ({FULL_SQL}) where duration % 8 < 3")
def scan_chunk_limit(spark, d):
    return read_table(spark, chunked(spark, d), "uservisits", "rmp", chunks=3).agg(F.count("*").alias("n"), F.sum("duration").alias("total"))


@query("scan_shard", f"select count(*) as n, sum(duration) as total from ({FULL_SQL}) where duration % 8 in (1, 4, 7)")
def scan_shard(spark, d):
    return read_table(spark, chunked(spark, d), "uservisits", "rmp", shard=(1, 3)).agg(F.count("*").alias("n"), F.sum("duration").alias("total"))


@query("scan_columns", "select concat(cast(100 + user_id % 100 as varchar), '.', cast(event_id % 7 as varchar)) as source_ip, cast(cast(value as float) as double) as ad_revenue from events")
def scan_columns(spark, d):
    """Two columns of the columnar encoding; the files of the others are not opened."""
    rows = read_table(spark, chunked(spark, d, "columns-snz"), "uservisits", "columns-snz", columns=["source_ip", "ad_revenue"])
    return rows.withColumn("ad_revenue", F.col("ad_revenue").cast("double"))


@query("scan_single_column", "select page_id * 37 % 3000 as pagerank from pages")
def scan_single_column(spark, d):
    path = catalog.directory(catalog.shared_folder(spark), "rmp-gz", "tiny", "rankings")
    write_table(rankings(spark, d, wide=True).withColumn("duration", F.lit(1).cast("long")), path, "rankings", "rmp-gz")
    return read_table(spark, path, "rankings", "rmp-gz", columns=["pagerank"])


BUCKET_SQL = "(ascii(substr(ip_prefix, 1, 1)) * 256 + ascii(substr(ip_prefix, 2, 1))) % 16"


@query("bucket_sizes", f"select count(*) as buckets, min(n) as least, max(n) as most, avg(n) as mean from (select {BUCKET_SQL} as bucket, count(*) as n from ({revenue_sql(8)}) group by 1)")
def q_bucket_sizes(spark, d):
    return bucket_sizes(aggregate(pairs(spark, d)), 16, trie_bucket)


@query("result_partitions", f"select cast({BUCKET_SQL} as integer) as partition, count(*) as n_groups, round(sum(total_revenue), {DIGITS}) as total_revenue from ({revenue_sql(8)}) group by 1")
def result_partitions(spark, d):
    sums = by_partition(aggregate(pairs(spark, d)), 16, trie_bucket)
    return rounded(sums.groupBy("partition").agg(F.count("*").alias("n_groups"), F.sum("total").alias("total_revenue")), "total_revenue")
