"""Joins on a key that a third of all rows share: adaptive execution must be able to split it."""

import pytest
from pyspark.sql import functions as F

from tallyspark import Lookup, SemanticModel, volume
from tallyspark.operators import aggregates, filters, joins

MODEL = SemanticModel((volume("rows", "count", "1"),))
SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture(scope="module")
def small(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def hot(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 5000)
    return spark.range(0, 90_000, 1, 8).select("id", key.alias("k"), F.xxhash64("id").alias("noise"))


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_lookup_join(spark, small, hot):
    side = spark.range(-1, 5000).select(F.col("id").alias("key"), F.concat(F.lit("v"), "id").alias("v"))
    lookup = Lookup(side.union(side), "key", "k", {"attribute": "v"})
    joined = joins.join_dimensions_dedup(hot, [lookup])
    assert joined.filter("attribute = concat('v', k)").count() == 90_000
    joined.collect()
    assert "skew=true" in final_plan(joined)
    unique = joins.join_dimensions(hot, [Lookup(side, "key", "k", {"attribute": "v"})])
    assert len(unique.collect()) == 90_000
    assert "skew=true" in final_plan(unique)


def test_semi_join(spark, small, hot):
    kept = filters.semi_join(hot, hot.filter("k < 1000").select("k"), ["k"])
    assert len(kept.collect()) == hot.filter("k < 1000").count()
    assert "skew=true" in final_plan(kept)


def test_reaggregated_metric(spark, small, hot):
    rows = hot.select(F.col("k").alias("a"), F.col("id").alias("b"), "noise")
    got = aggregates.reaggregate_metric(rows, "noise", ["a", "b"], ["b"], "max")
    best = {r.a: r.m for r in rows.groupBy("a").agg(F.max("noise").alias("m")).collect()}
    assert all(r.noise_max == best[r.a] for r in got.collect())
    assert "skew=true" in final_plan(got)


def test_distinct_count_of_a_hot_group(spark, small, hot):
    model = SemanticModel((volume("ids", "count_distinct", "{id}"),))
    got = {r.k: r.ids for r in aggregates.grouped(hot, model, ["k"]).collect()}
    assert got[-1] == 30_000
    assert sum(got.values()) == 90_000


def test_hot_keys_are_found_and_spread_alone(spark):
    from tallyspark.model import Lookup
    from tallyspark.operators.joins import hot_keys, join_dimensions_dedup

    rows = spark.range(0, 60_000, 1, 6).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000 + 100).alias("key"))
    side = spark.range(0, 6000).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))
    assert hot_keys(rows, "key") == [7]
    assert hot_keys(rows.withColumn("key", F.col("key").cast("string")), "key") == ["7"]
    assert hot_keys(rows.filter("key > 100"), "key") == [] and hot_keys(rows.filter("key < 0"), "key") == []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.adaptive.skewJoin.enabled")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        lookup = Lookup(side, "k", "key", {"value": "v"}, unique=True)
        joined = join_dimensions_dedup(rows, [lookup], find_hot=True)
        parts = [r[0] for r in joined.groupBy(F.spark_partition_id()).count().select("count").collect()]
        plain = [r[0] for r in join_dimensions_dedup(rows, [lookup]).groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert sum(parts) == sum(plain) == 60_000
        assert max(plain) > 20_000 and max(parts) < 12_000
        got = joined.filter("value = concat('v', key)").count()
        assert got == rows.filter("key < 6000").count() and joined.columns == ["id", "key", "value"]
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", before)
        for c in ("autoBroadcastJoinThreshold", "adaptive.autoBroadcastJoinThreshold", "adaptive.coalescePartitions.enabled"):
            spark.conf.unset(f"spark.sql.{c}")


@pytest.fixture
def repeated(spark, tmp_path):
    """Events of 200 nations in no order, and 200 suppliers in each nation: 800 000 pairs, and 100 of an event without a nation."""
    mixed = F.xxhash64("id", F.lit(7))
    # Two events have a customer without a nation and two have no customer; one nation has no supplier.
    users = F.when(F.col("id") < 2, 5000).when(F.col("id") < 4, 6000).otherwise(F.pmod(mixed, F.lit(1000)))
    events = spark.range(0, 4004, 1, 1).select(F.col("id").alias("event_id"), F.current_timestamp().alias("ts"), users.alias("user_id"))
    customers = spark.range(0, 1000, 1, 1).selectExpr("id AS c_custkey", "CAST(id % 201 AS int) AS c_nationkey")
    customers = customers.union(spark.sql("SELECT 5000L, CAST(NULL AS int)"))
    suppliers = spark.range(0, 40_000, 1, 1).selectExpr("id AS s_suppkey", "CAST(id % 200 AS int) AS s_nationkey")
    suppliers = suppliers.union(spark.sql("SELECT 77777L, CAST(NULL AS int)"))
    for name, rows in (("events", events), ("customer", customers), ("supplier", suppliers)):
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_multiplied_rows_are_stored_small(spark, repeated, tmp_path):
    """Rows of one key lie together: a file holds the lookup rows that repeat in a fraction of a byte a row."""
    from tallyspark.catalog import REGISTRY

    REGISTRY["join_dimensions_duplicates"].build(spark, repeated).write.parquet(f"{tmp_path}/out")
    made = spark.read.parquet(f"{tmp_path}/out")
    for name in ("events", "customer", "supplier"):
        spark.read.parquet(f"{repeated}/{name}.parquet").createOrReplaceTempView(f"repeated_{name}")
    want = spark.sql(
        "SELECT event_id, s_suppkey AS supplier FROM repeated_events LEFT JOIN repeated_customer ON user_id = c_custkey "
        "LEFT JOIN repeated_supplier ON c_nationkey = s_nationkey"
    )
    assert made.exceptAll(want).isEmpty() and want.exceptAll(made).isEmpty()
    stored = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert made.count() > 700_000 and stored < 0.5 * made.count()


@pytest.mark.parametrize("find_hot", [False, True])
def test_clustered_join_agrees_with_the_plain_one(spark, find_hot):
    fact = spark.range(0, 300, 1, 3).selectExpr("id", "CASE WHEN id % 50 = 0 THEN NULL ELSE id % 11 END AS k")
    side = spark.range(0, 90).selectExpr("CAST(id % 9 AS int) AS key", "CAST(id AS string) AS v").union(spark.sql("SELECT CAST(NULL AS int), 'x'"))
    for lookup in (Lookup(side, "key", "k", {"attribute": "v"}), Lookup(side.filter("key < 0"), "key", "k", {"attribute": "v"})):
        want = joins.join_dimensions(fact, [lookup], allow_duplicates=True)
        got = joins.join_dimensions(fact, [lookup], allow_duplicates=True, find_hot=find_hot, cluster=True)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_tasks_of_a_clustered_join_follow_the_rows_made(spark, monkeypatch):
    """A key that few fact rows have, and half of the lookup, is spread; so are rows that are few bytes before the join."""
    monkeypatch.setattr(joins, "CLUSTERED_ROWS", 4000)
    fact = spark.range(0, 2000, 1, 2).selectExpr("id", "IF(id < 16, -1L, id % 1000) AS k")
    side = spark.range(0, 6000).selectExpr("IF(id % 2 = 0, -1, id % 1000) AS key", "id AS v")
    lookup = Lookup(side, "key", "k", {"v": "v"})
    made = joins.join_dimensions(fact, [lookup], allow_duplicates=True, find_hot=True, cluster=True)
    parts = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == joins.join_dimensions(fact, [lookup], allow_duplicates=True).count() > 16 * 3000
    assert len(parts) >= 5 and max(parts) < 30_000


def test_long_lists_are_stored_small(spark, tmp_path):
    """A list that no page of a file holds: the rows still come in an order that repeats within a page."""
    fact = spark.range(0, 1200, 1, 3).selectExpr("id * 7919 AS id", "CASE WHEN id % 300 = 0 THEN NULL ELSE id % 3 END AS k")
    # The third key has no lookup row.
    side = spark.range(0, 24_000, 1, 3).selectExpr("id % 2 AS key", "id * 104729 % 1000003 AS v")
    lookup = Lookup(side, "key", "k", {"v": "v"})
    joins.join_dimensions(fact, [lookup], allow_duplicates=True, find_hot=True, cluster=True).write.parquet(f"{tmp_path}/out")
    made, want = spark.read.parquet(f"{tmp_path}/out"), joins.join_dimensions(fact, [lookup], allow_duplicates=True)
    assert made.columns == want.columns
    said = [df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38)"))).first() for df in (made, want)]
    assert said[0] == said[1] and made.count() == 404 + (400 + 396) * 12_000
    stored = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert stored < 0.25 * made.count()


def test_clustered_join_of_strings_with_numbers(spark, monkeypatch):
    """Two hot keys of the fact that are one key of the lookup."""
    monkeypatch.setattr(joins, "CLUSTERED_ROWS", 500)
    fact = spark.range(0, 120, 1, 3).selectExpr("id", "CASE id % 4 WHEN 0 THEN '1' WHEN 1 THEN '01' WHEN 2 THEN '7' END AS k")
    lookup = Lookup(spark.range(0, 90).selectExpr("CAST(id % 3 AS int) AS key", "id AS v"), "key", "k", {"v": "v"})
    want = joins.join_dimensions(fact, [lookup], allow_duplicates=True)
    got = joins.join_dimensions(fact, [lookup], allow_duplicates=True, find_hot=True, cluster=True)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert want.count() == 60 * 30 + 60


@pytest.mark.parametrize("salts, find_hot", [(1, False), (3, False), (1, True)])
def test_clustered_join_of_many_parts_agrees_with_the_plain_one(spark, monkeypatch, salts, find_hot):
    """Keys in several parts with lookup rows from several tasks, rows that come twice, any kind of column and key, odd names."""
    monkeypatch.setattr(joins, "CLUSTERED_ROWS", 1000)
    monkeypatch.setattr(joins, "CLUSTERED_BLOCK", 8)
    monkeypatch.setattr(joins, "CLUSTERED_SIDE", 3)
    fact = spark.range(0, 140, 1, 3).selectExpr(
        "id div 2 AS id", "IF(id % 7 = 0, NULL, id % 5) AS `k k`", "map('a', id div 2) AS m", "array(id % 3, NULL) AS a", "IF(id % 9 = 0, NULL, 'x') AS `s.s`"
    )
    side = spark.range(0, 1300).selectExpr("CAST(IF(id < 1200, 1, id % 4) AS smallint) AS key", "id div 2 AS v", "map(id, id % 2) AS m2")
    plain = [F.col("id"), F.col("`k k`"), F.map_entries("m"), F.col("a"), F.col("`s.s`"), F.col("`v v`"), F.map_entries("m2")]
    for rows, df in ((fact, side), (fact, side.filter("false")), (fact.filter("false"), side)):
        lookup = Lookup(df, "key", "k k", {"v v": "v", "m2": "m2"})
        want = joins.join_dimensions(rows, [lookup], allow_duplicates=True)
        got = joins.join_dimensions(rows, [lookup], allow_duplicates=True, salts=salts, find_hot=find_hot, cluster=True)
        assert got.dtypes == want.dtypes
        assert sorted(map(str, got.select(plain).collect())) == sorted(map(str, want.select(plain).collect()))


def test_clustered_join_makes_no_rows_ahead(spark):
    """The join itself puts out tiles, sorted before they are unpacked: no operator holds all rows of a block of the fact."""
    fact = spark.range(0, 600).selectExpr("id", "id % 2 AS k")
    side = spark.range(0, 1000).selectExpr("id % 2 AS key", "id AS v")
    made = joins.join_dimensions(fact, [Lookup(side, "key", "k", {"v": "v"})], allow_duplicates=True, cluster=True)
    assert made.count() == 300_000
    plan = final_plan(made)
    assert plan.index("Generate inline(_rows") < plan.index("Generate inline(_side") < plan.index("Sort [_target") < plan.index("SortMergeJoin")
