from pyspark.sql import functions as F

from tallyforge.llm import common


def test_no_partner_is_lost_and_most_others_stay_out(spark, monkeypatch):
    keys = spark.range(2000).select(F.xxhash64("id").alias("id")).union(spark.createDataFrame([(None,)], "id long"))
    rows = spark.range(20_000).select(F.when(F.col("id") % 1000 != 7, F.xxhash64("id")).alias("k"), F.col("id").alias("_word"), F.lit("x").alias("a b"))
    for words, most in ((common.WORDS, 10), (1 << 10, 800)):
        monkeypatch.setattr(common, "WORDS", words)
        near, far = common.near_rows(rows, F.col("k"), keys)
        assert near.columns == far.columns == rows.columns
        n, f = near.collect(), far.collect()
        assert len(n) + len(f) == 20_000 and len({r["_word"] for r in n}) == len(n)
        assert {r["_word"] for r in n} >= {i for i in range(2000) if i % 1000 != 7} and len(n) <= 1998 + most
        assert sum(r.k is None for r in f) == 20
    monkeypatch.setattr(common, "WORDS", 4)
    near, far = common.near_rows(rows, F.col("k"), keys)
    assert near.count() == 20_000 and far.count() == 0
