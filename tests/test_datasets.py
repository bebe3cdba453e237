"""Datasets on disk, JDBC, pages, distances from many sources."""

import random

import pytest
from pyspark.sql import functions as F

from relmill.functions import features
from relmill.operators import analytics, paths
from relmill.operators.ordered import page_rows
from relmill.schema import ForeignKey
from relmill.sources import datasets, tables


def test_life_of_a_made_dataset(spark, tmp_path):
    folder = str(tmp_path / "shop")
    assert datasets.catalogue(spark).count() == 22 and len(datasets.DATASETS) == 9
    assert datasets.status(spark, "shop-small", folder) == "absent" and not datasets.delete(spark, "shop-small", folder)
    assert datasets.ensure(spark, "shop-small", folder) == "made"
    assert datasets.status(spark, "shop-small", folder) == "ready" == datasets.ensure(spark, "shop-small", folder)
    db = datasets.load(spark, "shop-small", folder)
    assert db.tables["users"].count() == 400 and len(db.foreign_keys) == 2 and set(db.times) == {"users", "items", "transactions"}
    assert datasets.delete(spark, "shop-small", folder) and datasets.status(spark, "shop-small", folder) == "absent"
    with pytest.raises(KeyError, match="unknown dataset"):
        datasets.find("rel-none")


def test_parquet_files_get_keys(spark, tmp_path):
    folder = str(tmp_path)
    rows = {
        "items": ("item_id long, title string", [(i, f"t{i}") for i in range(9)]),
        "stores": ("store_id long, town string", [(i, "x") for i in range(20, 24)]),
    }
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    assert datasets.status(spark, "rel-hm", folder) == "partial"
    with pytest.raises(ValueError, match="missing tables"):
        datasets.load(spark, "rel-hm", folder)
    sales = [(100 + i, i % 7, 20 + i % 4, f"2023-01-{i % 28 + 1:02}") for i in range(50)]
    spark.createDataFrame(sales, "sale_id long, fk_item_id long, fk_store_id long, at string").withColumn("at", F.col("at").cast("date")).withColumnsRenamed({"fk_item_id": "s_item_id", "fk_store_id": "s_store_id"}).write.parquet(f"{folder}/sales.parquet")
    assert datasets.status(spark, "rel-hm", folder) == "ready" == datasets.ensure(spark, "rel-hm", folder)
    db = datasets.load(spark, "rel-hm", folder)
    assert db.keys == {"items": "item_id", "stores": "store_id", "sales": "sale_id"} and db.times == {"sales": "_time"}
    with pytest.raises(FileNotFoundError, match="rel-amazon"):
        datasets.ensure(spark, "rel-amazon", folder + "/none")


def test_discovered_names_may_differ_in_prefix_only(spark, tmp_path):
    from relmill.operators.discovery import discover

    a = spark.createDataFrame([(i,) for i in range(5)], "a_key long")
    b = spark.createDataFrame([(i, i % 5, i % 5) for i in range(7)], "b_id long, b_key long, b_other long")
    assert discover("x", {"a": a, "b": b}).foreign_keys == [ForeignKey("b", "b_key", "a")]


def test_jdbc(spark, tmp_path):
    """A round trip through the database that comes with Spark, whole, by query and in parallel parts."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = [(i, f"n{i}", i / 4) for i in range(200)]
    spark.createDataFrame(rows, "id int, name string, v double").write.format("jdbc").option("url", url).option("dbtable", "things").options(**driver).save()
    read = lambda **o: sorted(tuple(r) for r in tables.load_jdbc(spark, url, **o, **driver).collect())
    assert read(table="things") == rows
    assert read(query='select "id", "name" from things where "v" < 2') == [r[:2] for r in rows[:8]]
    parts = tables.load_jdbc(spark, url, table="things", partition=("id", 0, 200, 4), **driver)
    assert parts.rdd.getNumPartitions() == 4 and sorted(tuple(r) for r in parts.collect()) == rows


@pytest.mark.parametrize(("offset", "n"), [(0, 5), (17, 20), (490, 50), (600, 5)])
def test_pages(spark, offset, n):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("x")).repartition(5)
    want = list(range(500))[offset : offset + n]
    for out in (features.page(df, ["x"], offset, n), page_rows(df, ["x"], offset, n)):
        assert sorted(r.x for r in out.collect()) == want


@pytest.mark.parametrize("weight", [None, "w"])
def test_nearest_source(spark, weight):
    r = random.Random(2)
    pairs = [(r.randrange(80), r.randrange(80), float(r.randrange(1, 9))) for _ in range(110)] + [(i, i + 1, 1.0) for i in range(100, 130)]
    e = spark.createDataFrame(pairs, "src long, dst long, w double")
    sources = spark.createDataFrame([(3,), (9,), (100,), (100,), (999,)], "id long")
    got = {x.id: x.distance for x in paths.nearest_source(e, sources, weight, compact=3).collect()}
    each = analytics.shortest_paths(e.withColumn("weight", F.col("w") if weight else F.lit(1.0)), sources)
    assert got == {x.id: x.d for x in each.groupBy("id").agg(F.min("distance").alias("d")).collect()}
    assert got[130] == 30.0 and got[999] == 0.0
