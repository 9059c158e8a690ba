import duckdb

from catalogspark.plans import registry


def test_ties_and_nulls_as_in_sql(spark, tmp_path):
    """Rows that rank alike go by their place in the table, whichever file is read first; arg_min passes over nulls."""
    rows = [(i % 40, 1000 + i, 1 + i % 2 * 99, "ARN"[i % 3]) for i in range(30)]
    more = [(i % 40, 5000 + i, 1 + i % 2 * 99, "ARN"[i % 3]) for i in range(900)]
    odd = [(50, None, 1, "A"), (50, 7, 2, "N"), (51, 8, None, "A"), (51, 9, 3, "R"), (52, None, None, None), (None, 10, 1, "A"), (53, 11, 120, "A"), (53, 12, 1, "R")]
    schema = "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string"
    for n, part in enumerate((rows + odd, more)):  # the larger file is read first
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/{n}")
    (tmp_path / "lineitem.parquet").mkdir()
    for n in range(2):
        (file,) = (tmp_path / f"{n}").glob("*.parquet")
        (tmp_path / "lineitem.parquet" / f"part-{n}.parquet").write_bytes(file.read_bytes())
    got = {tuple(r) for r in registry.QUERIES["representative_rows"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.sql("SET threads = 1")
    db.sql(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet(['{tmp_path}/lineitem.parquet/part-0.parquet', '{tmp_path}/lineitem.parquet/part-1.parquet'])")
    assert got == set(db.sql(registry.ORACLES["representative_rows"]).fetchall())
