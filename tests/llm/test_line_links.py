"""Near copies of lines are linked whatever their letters and whatever else stands in their bucket."""

import random

from pyspark.sql import functions as F

from tallyforge.llm import line_dedup


def kept(spark, lines):
    """How many of the lines, each a document of its own, stay."""
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    return sum(r.n_kept for r in line_dedup.deduped(df).collect())


def test_long_lines_without_certain_letters(spark):
    rnd = random.Random(6)
    lines = []
    for letters in ("fghijklmnopqrstuvwxyz", "56789", "FGHIJ"):
        words = " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(3, 9))) for _ in range(150))
        solid = "".join(rnd.choice(letters) for _ in range(900))
        lines += [words, words + letters[0], solid, solid + letters[0]]
    # of each line and its near copy one stays
    assert kept(spark, lines) == 6


def grams(line):
    return {line[i : i + 5] for i in range(max(1, len(line) - 4))}


def test_lines_of_a_few_words_with_one_edit(spark):
    rnd = random.Random(8)
    lines = []
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "漢字日本語文章例題 𝒳é"):
        for _ in range(12):
            base = " ".join("".join(rnd.choice(alphabet) for _ in range(rnd.randrange(3, 9))) for _ in range(14)).strip()
            at = rnd.randrange(20, len(base) - 20)
            near = base[:at] + "#" + base[at + 1 :]
            assert len(grams(base) & grams(near)) >= 0.8 * len(grams(base) | grams(near))
            lines += [base, near]
    # banding misses 3 pairs in 1,000 at the threshold
    assert kept(spark, lines) <= 25
    assert kept(spark, ["abc", "abd", "ab", "abcde", "abcdf"]) == 5


def test_families_that_share_a_bucket(spark, monkeypatch):
    # one bucket of 150 lines in this order: three families by turns, unlike each other
    monkeypatch.setattr(line_dedup, "_bands", lambda lines: lines.select(F.lit(1).alias("band"), F.xxhash64("line").alias("id"), F.size(line_dedup._shingles(F.col("line"))).alias("n")))
    rnd = random.Random(9)
    body = ["".join(rnd.choice("abcdefghij ") for _ in range(120)) + "." for _ in range(3)]
    assert kept(spark, [f"{i:03d} {body[i % 3]}" for i in range(150)]) == 3


def test_short_lines_at_the_threshold(spark):
    rnd = random.Random(10)
    pairs = []
    while len(pairs) < 400:
        a = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(29))
        at = rnd.randrange(2, 27)
        b = a[:at] + "#" + a[at + rnd.randrange(2) :] if rnd.random() < 0.5 else a + "#" * rnd.randrange(4, 6)
        if 0.8 <= len(grams(a) & grams(b)) / len(grams(a) | grams(b)) < 0.86:
            pairs.append((a, b))
    df = spark.createDataFrame([(i, x) for i, p in enumerate(pairs) for x in p], "pair long, line string").select("pair", "line", F.xxhash64("line").alias("id"))
    groups = line_dedup.line_components(df.select("id", "line"))
    # with bands of points by chance some 13 of them were missed
    assert groups.count() >= 2 * 396 and groups.select("component").distinct().count() <= 400


def test_lines_joined_in_no_round_are_compared(spark, monkeypatch):
    rnd = random.Random(11)
    base = "".join(rnd.choice("abcdefghij ") for _ in range(90))
    lines = [base + "xyz"[: i % 4] + "." * (i // 4) for i in range(16)]
    few = kept(spark, lines)
    monkeypatch.setattr(line_dedup, "SHORTENED", 0)
    assert kept(spark, lines) == few


def test_lines_are_dealt_out_once_for_both_sides_of_their_pairs(spark, tmp_path):
    rows = [(i, "one and the same line of text %s" % ("abc"[: i % 4])) for i in range(8)]
    spark.createDataFrame(rows, "id long, line string").write.parquet(f"{tmp_path}/texts")
    pairs = spark.createDataFrame([(a, b) for a in range(8) for b in range(a)], "a long, b long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = line_dedup._verified(pairs, spark.read.parquet(f"{tmp_path}/texts"))
        assert met.count() and {(r.a, r.b) for r in met.collect()} >= {(4, 0), (5, 1)}
        plan = met._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Scan parquet") == 1 and "ReusedExchange" in plan
