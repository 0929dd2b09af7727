import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusflow.functions.keys import keyed_hash
from corpusflow.operators.positions import exact_positions, running_sum


def test_exact_positions_equal_row_number(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("abc")) for i in range(2000)]
    df = spark.createDataFrame(rows, "id bigint, g string").withColumn("k", keyed_hash(1, "t", F.col("id")))
    got = exact_positions(df, "k", "id", ["g"], total_out="tot", buckets=16)
    ref = df.withColumn("ref", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")) - 1) \
            .withColumn("rtot", F.count(F.lit(1)).over(Window.partitionBy("g")))
    j = got.join(ref, ["id", "g"])
    assert j.where((F.col("pos") != F.col("ref")) | (F.col("tot") != F.col("rtot"))).count() == 0
    assert j.count() == 2000
    glob = exact_positions(df, "k", "id", buckets=8).select(F.max("pos"), F.countDistinct("pos")).first()
    assert tuple(glob) == (1999, 2000)


def test_running_sum(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(300)], "o bigint, v bigint")
    got = {r.o: r.c for r in running_sum(df, "o", "v", "c", chunk=16).collect()}
    acc = 0
    for i in range(300):
        acc += i % 7
        assert got[i] == acc


def test_sorted_positions_equal_row_number(spark):
    from corpusflow.operators.positions import sorted_positions
    rng = random.Random(5)
    vals = rng.sample(range(10**9), 3000)
    df = spark.createDataFrame([(v, f"x{v}") for v in vals], "k bigint, s string")
    got = {r.k: (r.pos, r.tot) for r in sorted_positions(df, "k", total_out="tot", buckets=16).collect()}
    assert got == {v: (i, 3000) for i, v in enumerate(sorted(vals))}


def test_mix_without_shuffle_takes_leading_rows(spark):
    from corpusflow.operators import mix as MX
    a = spark.createDataFrame([(i, f"a{i}") for i in range(50)], "k bigint, text string").repartition(4)
    out = MX.mix(lambda n, s: a, {"A": 0.2}, splits=("train",), columns_to_keep=["k"], shuffle=False,
                 order_col="k", keep_ids=True)["train"]
    assert sorted((r.id, r.k) for r in out.collect()) == sorted((f"A_{i}", i) for i in range(10))


def test_outlier_ids_and_two_levels(spark):
    from corpusflow.operators.positions import sorted_positions
    df = spark.range(2000).union(spark.range(10**15, 10**15 + 1))
    got = sorted_positions(df, "id", buckets=8)
    assert got.where((F.col("id") < 2000) & (F.col("pos") != F.col("id"))).count() == 0
    assert got.where(F.col("id") > 2000).first().pos == 2000
    sums = {r.o: r.c for r in running_sum(spark.range(1000).selectExpr("id as o", "id as v"), "o", "v", "c", chunk=7).collect()}
    assert all(sums[i] == i * (i + 1) // 2 for i in range(1000))


def test_first_by_key_is_exact(spark):
    from corpusflow.operators.positions import first_by_key
    df = spark.range(3000).withColumn("k", keyed_hash("x", F.col("id")))
    want = [r.id for r in df.orderBy("k", "id").limit(700).collect()]
    got = first_by_key(df, "k", "id", F.floor(F.col("_tot") * 0.2334), out="p").orderBy("p").collect()
    assert [r.id for r in got] == want and [r.p for r in got] == list(range(700))
    assert first_by_key(df, "k", "id", F.lit(0)).count() == 0 and first_by_key(df.limit(0), "k", "id", F.lit(5)).count() == 0
