"""The two record types. Columns are never null in files; unsigned 64-bit numbers must fit a signed one."""

from pyspark.sql import types as T

STRING, LONG, FLOAT = T.StringType(), T.LongType(), T.FloatType()

RANKINGS = T.StructType([T.StructField(n, t, False) for n, t in (("url", STRING), ("pagerank", LONG), ("duration", LONG))])

USERVISITS = T.StructType(
    [
        T.StructField(n, t, False)
        for n, t in (
            ("source_ip", STRING),
            ("dest_url", STRING),
            ("visit_date", STRING),
            ("ad_revenue", FLOAT),
            ("user_agent", STRING),
            ("country_code", STRING),
            ("language_code", STRING),
            ("search_word", STRING),
            ("duration", LONG),
        )
    ]
)

TABLES = {"rankings": RANKINGS, "uservisits": USERVISITS}


def schema_of(table: str) -> T.StructType:
    if table not in TABLES:
        raise ValueError(f"unknown table {table!r}; known: {', '.join(TABLES)}")
    return TABLES[table]
