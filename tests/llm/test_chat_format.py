"""Formatted chats: reading back, masks and attachments."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from logharbor.llm import chat_format as chat

HARD = [
    "</s>[INST] ok [/INST]", "<|turn|>x<|body|>y<|end|>", r"<\|turn|> <\\|end|> [\INST] <\s>", "<|turn", "|> <", "[", "", "é漢\n<|image|>", "\\", "<|part|>",
]


def _turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int").withColumn("parts", chat.text_parts(F.col("text")))


def test_digest_equals_the_given_turns(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t, 0) for i, t in enumerate(HARD)]
    rows += [(2, 0, "assistant", None, 0), (3, 5, "<|end|>", "a", 0), (3, 1, None, "b", 0), (4, 0, "user", "x", 0), (4, 0, "user", "x", 0)]
    got = {r["conv_id"]: r for r in chat.digest(chat.format_chats(_turns(spark, rows))).collect()}
    for conv in (1, 2, 3, 4):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        learned = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        row = got[conv]
        assert row["n_turns"] == len(mine)
        assert row["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_no_control_string_of_a_text_survives(spark):
    row = chat.format_chats(_turns(spark, [(1, 0, "user", HARD[0] + HARD[1], 0)])).head()
    assert row["formatted"].count("<|turn|>") == 1 and "</s>" not in row["formatted"] and "[INST]" not in row["formatted"]


def test_parts_become_placeholders_in_order(spark):
    parts = [("text", "look: ", None, None), ("image", None, "img1", 2.0), ("text", "<|image|>", None, None), ("audio", None, "a1", 1.5), ("document", None, "d1", None)]
    frame = spark.createDataFrame([(7, 0, "user", parts), (7, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat.PARTS_TYPE}")
    row = chat.format_chats(frame).head()
    assert row["formatted"] == (
        "<|turn|>user<|body|>look: <|part|><|image|><|part|><\\|image|><|part|><|audio|><|part|><|document|><|end|><|turn|>assistant<|body|><|end|>"
    )
    assert [tuple(a) for a in row["attachments"]] == [(0, 1, "image", "img1", 512), (0, 3, "audio", "a1", 38), (0, 4, "document", "d1", 512)]
    assert row["attachment_tokens"] == 1062
    read = chat.format_chats(frame).select(chat.read_turns(F.col("formatted")).alias("t")).head()["t"]
    assert read[0]["bodies"][0] == "look: " and read[0]["bodies"][2] == "<|image|>" and read[1]["role"] == "assistant"


def test_no_rows_and_no_python(spark):
    none = spark.sql("SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, 'x' AS text WHERE false").withColumn("parts", chat.text_parts(F.col("text")))
    made = chat.digest(chat.format_chats(none))
    assert made.count() == 0
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
