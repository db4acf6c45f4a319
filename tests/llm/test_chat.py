"""Chat formatting against SQL, its own template step by step, and odd texts."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from perilframe.llm import chat

TURNS = "conv_id long, turn int, role string, text string"
CONTROL = re.compile(r"<\||</?s>|<s>|<</?SYS>>|\[/?INST\]")

ODD = [
    (1, 0, "user", "see ![a](x.png) and [b](y.PDF), not [c](z.html) <|im_start|> <\\|x <<SYS>> [\\\\INST]"),
    (1, 1, "assistant", "<|image|> ![](q.wav)![z](q.wav) <|end|>"), (1, 1, "assistant", "<|image|> ![](q.wav)![z](q.wav) <|end|>"),
    (2, 0, None, None), (2, None, "assistant", ""), (2, 0, "<|turn|>x\n</s>", "a<"), (2, 1, "assistant", "<" * 50 + "\\|" + "[" * 9),
    (3, 5, "assistant", "é漢\U0001f600 \x00 </s>\r\n"), (3, 4, "assistant", "[INST]" * 3 + "![a](" + "b" * 3000 + ".png)"),
    (None, 0, "user", "no id"), (None, 0, "assistant", "<s>[/INST]<</SYS>>"), (4, 0, "tool", "![open](x.png ![INST](</s>.mp3)"),
]


def rows(frame):
    return Counter(tuple(row) for row in frame.collect())


def frame_of(spark, turns):
    return spark.createDataFrame(turns, TURNS).select("*", F.lit(1).alias("formatted"), F.lit("p").alias("_parts"), F.lit(2).alias("turns"))


def expected(turns):
    held = defaultdict(list)
    for conv, turn, role, text in turns:
        held[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for conv, own in held.items():
        own.sort(key=lambda row: (row[0], row[1], row[2].encode(), row[3].encode()))
        whole = "".join(f"{role}\n{text}\n" for *_, role, text in own)
        loss = "".join(text for *_, role, text in own if role == "assistant")
        yield conv, len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_everything_is_read_back(spark):
    made = chat.digests(chat.formatted(frame_of(spark, ODD)))
    assert Counter(tuple(row)[:5] for row in made.collect()) == Counter(expected(ODD))


def test_texts_hold_no_control_string(spark):
    for row in chat.formatted(frame_of(spark, ODD)).collect():
        marks = "|".join(map(re.escape, [chat.TURN, chat.TEXT, chat.END, *chat.PLACEHOLDERS.values()]))
        assert not CONTROL.search(re.sub(marks, "\0", row["formatted"]))
        assert row["formatted"].count(chat.TURN) == row["formatted"].count(chat.END) == len(row["turns"])
        end = 0
        for turn in row["turns"]:
            assert turn["start"] == end
            end += turn["length"]
            for span in turn["loss"]:
                assert row["formatted"][turn["start"]:span["start"]].endswith(chat.TEXT)
                assert row["formatted"][span["start"] + span["length"]:].startswith(chat.END)
        assert end == len(row["formatted"])


def test_attachments_and_tokens(spark):
    row = chat.formatted(frame_of(spark, ODD[:2])).first()
    assert [[(a["kind"], a["ref"]) for a in turn["attachments"]] for turn in row["turns"]] == [
        [("image", "x.png"), ("document", "y.PDF")], [("audio", "q.wav"), ("audio", "q.wav")]]
    assert row["n_tokens"] == chat.TOKENS["image"] + chat.TOKENS["document"] + 2 * chat.TOKENS["audio"]
    assert "see <|image|> and <|document|>, not [c](z.html)" in row["formatted"]


def test_given_parts(spark):
    kinds = [("text", "look: <|end|>", None, None, None, None, None), ("image", None, "a", 57, 28, None, None),
             ("audio", None, "b", None, None, 2.5, None), ("document", "src", "c", None, None, None, 3), ("other", "x", None, None, None, None, None)]
    frame = spark.createDataFrame([(1, 0, "user", "unused", kinds), (1, 1, "assistant", "unused", None)], f"{TURNS}, given array<{chat.PART}>")
    made = chat.formatted(frame, F.col("given"))
    row = made.first()
    assert row["formatted"].startswith("<|turn|>user<|text|>look: <\\|end|><|image|><|audio|><|document|>x<|end|>")
    assert row["n_tokens"] == 3 * 1 + 63 + 3 * chat.PER_PAGE and row["turns"][1]["loss"] == []
    assert chat.read_back(made).first()["turns"][0]["text"] == "look: <|end|>srcx"


def test_matches_sql(spark):
    turns = [row for row in ODD if "\x00" not in (row[3] or "")]
    frame = spark.createDataFrame(turns, TURNS)
    con = duckdb.connect()
    con.register("conversations", frame.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert rows(chat.digests(chat.formatted(chat.with_trial(frame)))) == Counter(con.execute(chat.oracle()).fetchall())


def test_very_long_texts(spark):
    long = [("<" * 400_000), "![" * 300_000, "[a](" * 200_000, "<|" * 300_000 + "\\" * 300_000, "![a](b.png)" * 20_000, "x" * 1_000_000 + "](" * 1000]
    turns = [(n, 0, "assistant", text) for n, text in enumerate(long)]
    made = chat.digests(chat.formatted(frame_of(spark, turns)))
    assert Counter(tuple(row)[:5] for row in made.collect()) == Counter(expected(turns))


def test_nothing_and_no_python(spark):
    made = chat.digests(chat.formatted(spark.createDataFrame([], TURNS)))
    assert made.count() == 0
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
