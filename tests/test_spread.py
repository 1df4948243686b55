"""Joins with hot keys."""

from pyspark.sql import functions as F

from cloakframe.operators.spread import heavy_join, heavy_keys


def _many(spark, n=30000):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, "warm").otherwise(F.concat(F.lit("k"), F.col("id") % 9000))
    return spark.range(n).select(key.alias("key"), F.col("id").alias("row"))


def test_a_key_with_a_third_of_the_rows_is_split_by_its_share(spark):
    many = _many(spark)
    ways = heavy_keys(many, ["key"], 64)
    hot, warm = (spark.range(1).select(F.xxhash64(F.lit(k))).first()[0] for k in ("hot", "warm"))
    assert set(ways) == {hot, warm} and 40 <= ways[hot] <= 64 and 2 <= ways[warm] <= 4
    one = many.groupBy("key").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        joined = heavy_join(many, one.filter("key != 'k7'"), ["key"], how)
        wanted = many.join(one.filter("key != 'k7'"), ["key"], how)
        assert joined.columns == wanted.columns
        assert sorted(map(tuple, joined.collect()), key=repr) == sorted(map(tuple, wanted.collect()), key=repr)


def test_split_rows_lie_in_many_tasks_and_light_keys_in_one_way(spark):
    many = _many(spark)
    one = many.groupBy("key").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        joined = heavy_join(many, one, ["key"], "inner", 64).withColumn("task", F.spark_partition_id())
        tasks = {r.key: r.tasks for r in joined.groupBy("key").agg(F.countDistinct("task").alias("tasks")).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert tasks["hot"] > 16 and max(n for k, n in tasks.items() if k.startswith("k")) == 1


def test_without_heavy_keys(spark):
    many = spark.range(5000).select((F.col("id") % 2500).alias("key"), "id")
    one = spark.range(2500).select(F.col("id").alias("key"), F.lit("x").alias("name"))
    assert heavy_keys(many, ["key"], 64) == {} and heavy_keys(many.limit(0), ["key"], 64) == {}
    assert heavy_join(many, one, ["key"], "inner").count() == 5000
    nulls = spark.createDataFrame([(None, i) for i in range(300)] + [("a", 1)], "key string, row int")
    assert heavy_join(nulls, spark.createDataFrame([("a", 2)], "key string, v int"), ["key"], "left").count() == 301
