"""Search for many texts at once against brute force."""

from pyspark.sql import functions as F

from tallyforge.operators import search as S
from tallyforge.plans import lookups
from tallyforge.sources.model import Model


def test_search_equals_brute_force_without_an_index(spark):
    texts = {1: "green tea 33 gx", 2: "绿茶 33", 3: "\\u7eff\\u8336 5", 4: "tea", 5: "", 6: "a b"}
    asked = {10: " TEA ", 11: "绿茶", 12: "33", 13: "", 14: None, 15: "nothing", 16: " TEA ", 17: "A   B", 18: "."}
    forms = {10: ["tea"], 11: ["绿茶", "\\u7eff\\u8336"], 12: ["33"], 15: ["nothing"], 16: ["tea"], 17: ["a   b", "a b"], 18: ["."]}
    q = spark.createDataFrame(list(asked.items()), "query_id long, q string")
    r = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = sorted(tuple(x) for x in S.found(q, "q", r, "id", "text").select("query_id", "id").collect())
    assert got == sorted((k, i) for k, fs in forms.items() for i, t in texts.items() if any(f in t for f in fs))


def test_records_of_a_small_file_are_dealt_out(spark):
    d = lookups.product_records(Model(spark, "/root/testdata/sf0.001"))
    assert d.select(F.spark_partition_id().alias("p")).distinct().count() > 1
