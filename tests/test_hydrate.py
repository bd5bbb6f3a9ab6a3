"""Hits that fetch their columns when their ids are too many to broadcast."""

import pytest
from pyspark.sql import functions as F

from vectide.operators import idfilter
from vectide.operators.hits import broadcast_limit, hydrate_hits
from vectide.operators.idfilter import BITMAP_BITS, id_bitmaps, may_contain, table_bits


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("kind", ["bigint", "int", "string"])
def test_no_member_is_lost_and_few_others_pass(spark, kind):
    ids = spark.range(0, 300_000, 30).select(F.col("id").cast(kind))
    rows = spark.range(300_000).select(F.col("id").cast(kind), F.lit("t").alias("text"))
    passed = may_contain(rows, ids, 10_000)
    assert passed.columns == ["id", "text"]
    assert passed.join(ids, "id", "left_semi").count() == 10_000
    # 290,000 others, of which a sixteenth is expected.
    assert passed.count() - 10_000 < 290_000 * 0.08


def test_bits_grow_with_the_ids(spark):
    assert table_bits(0) == table_bits(1) == BITMAP_BITS
    assert table_bits(2048) == BITMAP_BITS and table_bits(2049) == 2 * BITMAP_BITS
    bitmaps = id_bitmaps(spark.range(100_000), table_bits(100_000))
    assert bitmaps.count() == table_bits(100_000) // BITMAP_BITS
    set_bits = bitmaps.agg(F.sum(F.bitmap_count("_bits"))).first()[0]
    assert 0.95 * 100_000 < set_bits <= 100_000


def test_what_is_not_filtered(spark, monkeypatch):
    ids, rows = spark.range(5), spark.range(100)
    assert may_contain(rows.select(F.col("id").cast("int")), ids, 5).count() == 100
    assert may_contain(rows.select(F.col("id").cast("double")), ids.select(F.col("id").cast("double")), 5).count() == 100
    monkeypatch.setattr(idfilter, "MOST_BYTES", 100)
    assert may_contain(rows, ids, 5).count() == 100


def test_nulls_and_empty_tables(spark):
    some = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "id long, text string")
    assert [r["id"] for r in may_contain(some, spark.createDataFrame([(1,), (None,)], "id long"), 2).collect()] == [1]
    assert may_contain(some, spark.createDataFrame([], "id long"), 0).count() == 0
    assert may_contain(some.limit(0), some.select("id"), 3).count() == 0


def test_equals_the_plain_way(no_broadcast):
    spark = no_broadcast
    assert broadcast_limit(spark) == 0
    # Hits without a stored row, copies of a stored id, one id that most queries hit, a clashing name.
    hits = spark.range(5000).select(
        F.col("id").alias("query_id"), F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("id"), F.lit(0.5).alias("score"))
    stored = spark.range(100, 4000).select(F.col("id").alias("key"), F.concat(F.lit("t"), "id").alias("text"), F.lit(1).alias("_bucket"))
    stored = stored.unionByName(stored.where("key % 2 = 0")).unionByName(stored.limit(1).withColumn("key", F.lit(7).cast("long")))
    columns = ["query_id", "id", "score", "text"]
    found = {limit: sorted(hydrate_hits(hits, stored, ["text"], "key", limit).select(*columns).collect(), key=str) for limit in (None, 0, 1 << 30)}
    assert found[None] == found[0] == found[1 << 30] and len(found[0]) == 5000
    assert sum(r["text"] is None for r in found[0]) == sum(1 for i in range(0, 5000, 3) if not 100 <= i < 4000)


def test_the_filter_stands_before_the_exchange(no_broadcast):
    spark = no_broadcast
    ids = spark.range(0, 100_000, 7)
    rows = spark.range(100_000).select("id", F.lit("t").alias("text"))
    filtered = may_contain(rows, ids, 14_286).join(ids, "id", "left_semi")
    plan = filtered._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [_bucket" in plan and "BatchEvalPython" not in plan and "ArrowEval" not in plan
    assert plan.index("SortMergeJoin") < plan.index("Exchange hashpartitioning(") < plan.index("BroadcastHashJoin [_bucket")
