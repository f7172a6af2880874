"""Results that are the same as those of the SQL in DuckDB where a table is a folder of several files."""

import datetime

import duckdb
import pytest

from loomgraph.plans.carriers import CARRIERS, carrier

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


@pytest.mark.parametrize("turned", [False, True])
def test_tied_lines_in_the_order_of_their_files(spark, tmp_path, turned):
    """Component 7 has one line in each of two files, 8 both in the second, which is the larger one."""
    line = lambda part, supplier: (1, part, supplier, 2, 10.0, 1.0, 0.0, 0.0, "A", "F", datetime.datetime(2000, 1, 1))
    one, two = ((3, 4), (4, 3))[turned]
    (tmp_path / "lineitem.parquet").mkdir()
    for number, lines in enumerate([[line(7, one)], [line(7, two), line(8, one), line(8, two), *(line(p, 0) for p in range(100, 400))]]):
        spark.createDataFrame(lines, LINE).coalesce(1).write.parquet(f"{tmp_path}/{number}")
        next((tmp_path / str(number)).glob("*.parquet")).rename(tmp_path / "lineitem.parquet" / f"part-{number:04}.parquet")
    got = sorted(map(tuple, carrier(spark, str(tmp_path), "cat_props").filter("component_id < 100").select("component_id", "cdf_type").collect()))
    assert got == [(7, (None, "enum")[one == 3]), (8, (None, "enum")[one == 3])]
    duck = duckdb.connect()
    duck.sql(f"SET threads = 1; CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert duck.sql(f"SELECT component_id, cdf_type FROM ({CARRIERS['cat_props']}) WHERE component_id < 100 ORDER BY 1").fetchall() == got
