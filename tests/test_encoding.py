"""Repair of damaged names: clean ones stay, damaged ones come back."""

from pyspark.sql import functions as F

from tallyforge.functions import encoding as E

#: Names of foods, firms and places, made of common and less common characters.
CLEAN = """苹果 食品 香蕉 葡萄 鸡蛋 牛奶 大米 面粉 酱油 豆腐 绿茶 咖啡 啤酒 白糖 花生 芝麻 虾仁 螃蟹 鲈鱼 榴莲 荔枝 枸杞 茄子 韭菜 蘑菇 冬瓜 南瓜 芹菜 菠菜 土豆 洋葱 生姜 大蒜 辣椒 胡椒 茴香 八角 桂皮
北京华联商贸有限公司 上海大昌食品公司 广州恒大贸易 深圳鑫源实业 珠海椰风饮料 厦门鹭岛海产 青岛啤酒集团 香港美心食品 台湾统一企业 東京食品 龍門貿易 鹽水雞 café crème jalapeño Müller GmbH señor""".split()


def test_clean_names_stay_and_damaged_ones_come_back(spark):
    rows = [(w + tail, w + tail) for w in CLEAN for tail in ("", " 500G", " Inc.", "二十箱")]
    model = E.learned_likelihood(spark.createDataFrame([(w,) for w in CLEAN[:20]], "name string"), "name")
    damaged = []
    for w, _ in rows:
        for codec in ("gb18030", "latin-1"):
            try:
                bad = w.encode().decode(codec)
            except UnicodeDecodeError:
                continue
            if bad != w:
                damaged.append((w, bad))
    df = spark.createDataFrame(rows + damaged, "name string, shown string")
    for m in (None, model):
        got = df.select("name", "shown", E.repaired_ideographs(F.col("shown"), m).alias("r")).collect()
        whole = [r for r in got if r.name == r.shown]
        broken = [r for r in got if r.name != r.shown]
        assert len(broken) > 250 and all(r.r == r.name for r in whole)
        share = sum(r.r == r.name for r in broken) / len(broken)
        assert share >= 0.99, (share, [r for r in broken if r.r != r.name])


def test_common_names_never_reach_python(spark):
    got = spark.createDataFrame([("食品 苹果",), ("plain",), (None,), ("",)], "x string").select(E.suspicious(F.col("x"))).collect()
    assert [r[0] for r in got] == [False] * 4


def test_known_phrases_with_lost_bytes(spark):
    phrases = ("处理中...", "登录已失效，请重新登录。", "继续识别")
    forms = [(p, "1: " + f + " end") for p in phrases for f in E.damaged_forms(p)]
    assert {"澶勭悊涓...", "澶勭悊涓?.."} <= {f[3:-4] for _, f in forms}
    got = spark.createDataFrame(forms, "p string, x string").select("p", E.repaired_text(F.col("x"), None, phrases).alias("r")).collect()
    assert all(r.r == f"1: {r.p} end" for r in got)


def test_escapes_and_flags(spark):
    df = spark.createDataFrame([("\\u005cu516c",), ("公",), ("鑻规灉",), (None,)], "x string")
    got = df.select(E.repaired_text(F.col("x")).alias("r"), E.has_damage(F.col("x")).alias("d")).collect()
    assert [tuple(r) for r in got] == [("公", True), ("公", False), ("苹果", True), (None, False)]
