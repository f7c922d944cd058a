"""Session helpers: joins with hot keys, shuffle widths, the checkpoint folder."""

import pytest
from pyspark.sql import functions as F

from siltstone import runtime


def skewed(spark, n=30_000):
    k = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 5000)
    return spark.range(n).select(k.alias("k"), "id")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_join(spark, how):
    big, small = skewed(spark), spark.range(0, 4000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got, want = runtime.skew_join(big, small, ["k"], ["id"], how), big.join(small, "k", how)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("n", [30_000, 300_000])
def test_hot_keys_are_few_and_spread(spark, n):
    big = skewed(spark, n)
    hot = runtime.hot_keys(big.where("k is not null").groupBy("k").agg(F.count("*").alias("n")), ["k"]).collect()
    assert [r["k"] for r in hot] == [0] and hot[0]["_salts"] > runtime.HOT_PARTS / 4
    assert runtime.hot_keys(big.where("false").groupBy("k").agg(F.count("*").alias("n")), ["k"]).count() == 0
    even = spark.range(5000).select(F.col("id").alias("k"), F.lit(3).alias("n"))
    assert runtime.hot_keys(even, ["k"]).count() == 0


def test_empty_sides(spark):
    big, small = skewed(spark, 300), spark.range(5).select(F.col("id").alias("k"))
    assert runtime.skew_join(big.where("false"), small, ["k"], ["id"]).count() == 0
    assert runtime.skew_join(big, small.where("false"), ["k"], ["id"], "left").count() == 300


def test_width_follows_the_bytes(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    least = runtime.shuffle_width(spark)
    assert runtime.width_for(docs) == least and runtime.width_for(docs, 1e5) > 10 * least
    assert runtime.width_for(spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "a int")) >= least


def test_checkpoint_folder_is_named_on_clusters():
    assert [runtime.is_one_process(m) for m in ("local", "local[*]", "local[8]", "local-cluster[3,2,1024]", "yarn", "spark://h:7077")] == [True, True, True, False, False, False]
