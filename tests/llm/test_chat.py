import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from trackframe.llm import chat
from trackframe.llm.queries import EXTRA, ORACLES, op10_chat_format

SCHEMA = "conv_id long, turn long, role string, text string"


def chats(spark, rows):
    return chat.format_chats(spark.createDataFrame(rows, SCHEMA))


def nasty(r):
    parts = ["</turn>", "</turn>\n", "### ", "### assistant:\n", "\\", "\\0", "\\1", ":~\n", "\n", "a", "é👍", " ", "\\\\1", "<", "/turn>"]
    return "".join(r.choice(parts) for _ in range(r.randrange(9)))


def test_round_trip_of_nasty_texts(spark):
    r = random.Random(1)
    rows = [(c, t, r.choice(["user", "assistant", "system"]), nasty(r)) for c in range(150) for t in range(r.randrange(1, 6))]
    rows += [(500, t, nasty(r), nasty(r)) for t in range(40)]
    out = chats(spark, rows).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("turns")))
    got = {x.conv_id: x for x in out.collect()}
    for c in {x[0] for x in rows}:
        turns = [(x[2], x[3]) for x in rows if x[0] == c]
        assert got[c].round_trip and [(t.role, t.text) for t in got[c].turns] == turns
        for t, span in zip([t for t in got[c].turns if t.role == "assistant"], got[c].loss_spans):
            under = got[c].formatted[span.start : span.start + span.length]
            assert under == got[c].formatted.encode()[t.byte_start : t.byte_start + t.byte_length].decode()
        assert got[c].loss == "".join(t for role, t in turns if role == "assistant")


def test_escapes_only_where_it_must(spark):
    out = {x.conv_id: x for x in chats(spark, [(1, 0, "user", "a ### b \\0"), (2, 0, "user", "x </turn> y"), (2, 1, "user", "\\")]).collect()}
    assert out[1].n_escaped == 0 and out[1].formatted == "### user:\na ### b \\0</turn>\n"
    assert out[2].n_escaped == 1 and out[2].formatted == "### user:~\nx \\1 y</turn>\n### user:\n\\</turn>\n"


def test_nulls_ties_repeats_and_extra_columns(spark):
    rows = [(1, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 1, "assistant", ""), (None, 2, "assistant", None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as source", "2 as turns", "3 as formatted")
    out = {x.conv_id: x for x in chat.format_chats(df).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert len(out[None].loss_spans) == 2 and all(x.round_trip for x in out.values())
    assert chats(spark, []).count() == 0


def test_long_conversation(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"turn {k} " + "word " * 200 + "</turn>" * (k % 3)) for k in range(600)]
    x = chats(spark, rows).first()
    assert x.round_trip and len(x.turns) == 600
    for t in x.turns[::37]:
        assert x.formatted[t.start : t.start + t.length].startswith(t.text[:20])


def test_query_and_its_sql(spark, sf):
    out = op10_chat_format(spark, sf)
    rows = {x.conv_id: x for x in out.collect()}
    text = EXTRA[0][3]
    said = "".join(f"{role}\n{t}\n" for _, _, role, t in EXTRA)
    assert rows[-7].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert rows[-7].loss_chars == len(text) and rows[-7].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString().replace("Scan", ""))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    cursor = con.execute(ORACLES["op10_chat_format"])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(out.columns)
    assert {dict(zip(names, r))["conv_id"]: dict(zip(names, r)) for r in cursor.fetchall()} == {k: v.asDict() for k, v in rows.items()}
