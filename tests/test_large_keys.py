"""Queries whose stand-ins are made from keys, on keys beyond those of the small tables, against their SQL."""

import duckdb

from brindle.plans import catalog


def test_address_networks_of_keys_beyond_16_bits(spark, tmp_path):
    keys = [*range(1, 41), *range(65_500, 65_580), *range(900_000, 900_040), 2**31 + 3, 2**32 + 7, 2**48 + 9, 2**53 + 11]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k,) for k in range(25)], "n_nationkey long").coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    con = duckdb.connect()
    for name in ("customer", "nation"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = [tuple(r) for r in catalog.queries()["address_networks"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.execute(catalog.oracle_sql()["address_networks"]).fetchall())
