import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import chat
from tallyforge.llm.queries import OP12_SQL

SCHEMA = "conv_id long, turn long, role string, text string, valid string, segments int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def check(spark, rows, tmp_path):
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = chat.digests(table)
    columns = sorted(got.columns)
    path = str(tmp_path / "conversations")
    table.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM '{path}/*.parquet'")
    result = con.execute(OP12_SQL)
    names = [d[0] for d in result.description]
    expected = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    got = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    return {(r[columns.index("conv_id")], r[columns.index("n_turns")]): dict(zip(columns, r)) for r in got}


def test_edge_cases_equal_sql(spark, tmp_path):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", None), (1, 2, "assistant", "é\U0001f600\\"), (1, 3, "user", ""),
        (2, 5, "assistant", "first"), (2, None, "user", "last"), (2, 6, "assistant", "<"), (2, 7, "user", "[\\\\INST] <\\s> <</SYS>>"),
        (3, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, None, "no role"), (3, 2, "tool[/ROLE]", "[TEXT]"), (3, 3, "", "empty"),
        (-1, 0, "user", "a given conversation with the probe's id"),
        (None, 0, "user", "x" * 300_000 + "[INST]" * 1000), (None, 1, "assistant", "<s></s>" * 5000),
    ]
    got = check(spark, rows, tmp_path)
    assert got[1, 4]["valid"] and not got[1, 4]["complete"] and got[1, 4]["first_error"] is None
    assert got[2, 4]["first_error"] == 0 and got[3, 5]["first_error"] == 1
    probe = got[-1, 2]
    assert probe["loss_sha256"] == sha(chat.PROBE_TEXT) and probe["turns_sha256"] == sha(f"user\n{chat.PROBE_TEXT}\nassistant\n{chat.PROBE_TEXT}\n")
    assert probe["valid"] and probe["complete"] and (-1, 1) in got


def test_random_control_strings_come_back(spark, tmp_path):
    r = random.Random(5)
    pieces = ["<", "[", "\\", "/", "<s>", "</s>", "[INST]", "[/INST]", "INST]", "s>", "<<SYS>>", "<</SYS>>", "SYS>>", "[ROLE]", "TEXT]", "a", "\n", "é"]
    rows = [(i // 4, i % 4, r.choice(["user", "assistant", "system", "tool", "[INST]"]), "".join(r.choices(pieces, k=r.randrange(12)))) for i in range(2000)]
    assert len(check(spark, rows, tmp_path)) == 501


def test_empty_table_gives_the_probe_only(spark):
    assert [r.conv_id for r in chat.digests(spark.createDataFrame([], SCHEMA)).collect()] == [-1]


def test_segments_have_loss_on_assistant_texts_only(spark):
    rows = chat.formatted(chat.with_probe(spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "</s>")], "conv_id long, turn long, role string, text string"))).where("not added")
    assert [tuple(s) for s in rows.first().segments] == [("[INST]", False), ("q", False), ("[/INST]", False), ("<s>", False), ("<\\/s>", True), ("</s>", False)]
    assert rows.select(F.col("segments")).count() == 1


def test_templates_that_cannot_be_read_back_are_refused():
    with pytest.raises(ValueError):
        chat.Template(marks={"user": ("[A]", "[A]"), "assistant": ("<s>", "</s>")})
    with pytest.raises(ValueError):
        chat.Template(marks={"user": ("<a<", "<b>"), "assistant": ("<s>", "</s>")})
    chat.Template(marks={"user": ("<|user|>", "<|end|>"), "assistant": ("<|bot|>", "<|eos|>")}, other=("<|role|>", "<|text|>", "<|stop|>"))
