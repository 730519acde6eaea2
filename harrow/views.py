"""Stand-ins for the two record types on the driver's tables, by plain arithmetic. Amounts have up to five decimals; an eighth is exact in binary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

UV = """
select concat(cast(100 + user_id % 100 as {str}), '.', cast(event_id % 7 as {str}), '.', cast(event_id % 11 as {str}), '.',
  cast(10 + (event_id % 13) * 17 as {str})) as source_ip, value / 8 as ad_revenue, event_id, user_id
from events"""
RK = "select url, page_id % 50 as pagerank, page_id from pages"
RK_WIDE = "select url, page_id * 37 % 3000 as pagerank, page_id from pages"
UV_SQL = f"({UV.format(str='varchar')})"


def view(spark: SparkSession, sf_dir: str, source: str, query: str) -> DataFrame:
    return spark.sql(query.format(str="string").replace(f"from {source}", "from {t}"), t=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def uservisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "events", UV)


def rankings(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    return view(spark, sf_dir, "pages", RK_WIDE if wide else RK)
