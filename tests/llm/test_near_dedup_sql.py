"""Near-duplicates of whole tables against DuckDB SQL."""

import duckdb

from tessera.llm import near_dedup


def test_same_as_sql(spark):
    folder = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    rel, df = c.sql(near_dedup.ORACLE), near_dedup.op4_near_dedup(spark, folder)
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = sorted(tuple(r[x] for x in rel.columns) for r in df.collect()), sorted(rel.fetchall())
    assert got == want and sum(not r[-1] for r in want) > 50
