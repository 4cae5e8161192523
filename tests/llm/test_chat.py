"""Chat formatting: exact round trips, masks and typed parts."""

import random

from pyspark.sql import functions as F

from vigil.llm import chat


def back(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts(F.col("text")))
    return {r["conv_id"]: r for r in chat.read_formatted(chat.format_conversations(df)).collect()}


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>", "<|", "|>", "\\", "\\\\", "\\|", "\n", "assistant", "\\n", "é😀", " ", "<", "|", "x"]
    rows = []
    for c in range(150):
        for t in range(rng.randint(1, 4)):
            say = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
            rows.append((c, t, rng.choice(["user", "assistant", "a\nb\\n<|im_end|>", ""]), say))
    got = back(spark, rows)
    for c in range(150):
        want = [(r[2], r[3]) for r in rows if r[0] == c]
        assert [tuple(t) for t in got[c]["turns"]] == want
        assert got[c]["loss_text"] == "".join(x for r, x in want if r == "assistant")
        assert got[c]["formatted"].count("<|im_end|>") == len(want) == got[c]["formatted"].count("<|im_start|>")


def test_nulls_ties_and_empty(spark):
    got = back(spark, [(None, 1, "user", None), (None, 0, None, "x"), (2, None, "assistant", "late"), (2, 0, "user", "b"), (2, 0, "user", "a"),
                       (2, 0, "user", "a")])
    assert [tuple(t) for t in got[None]["turns"]] == [("", "x"), ("user", "")]
    assert [tuple(t) for t in got[2]["turns"]] == [("assistant", "late"), ("user", "a"), ("user", "a"), ("user", "b")]
    empty = spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    assert chat.format_conversations(empty).count() == 0


def test_typed_parts_become_ordered_placeholders(spark):
    parts = [("text", "look <|image:1|> ", None, None), ("image", None, "s3://a.png", 4), ("text", "and", None, None),
             ("audio", None, "b.wav", None), ("document", "ignored", "c.pdf", 2), (None, "tail", None, None)]
    rows = [(1, 0, "assistant", parts, "z"), (1, 1, "user", None, "z"), (1, 2, "user", [], "z")]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>, formatted string")
    r = chat.read_formatted(chat.format_conversations(df)).first()
    assert "look <\\|image:1|> <|image:1|>and<|audio:3|><|document:4|>tail" in r["formatted"]
    assert [tuple(a) for a in r["attachments"]] == [(0, "image", "s3://a.png", 1024), (0, "audio", "b.wav", 25), (0, "document", "c.pdf", 1200)]
    assert r["loss_text"] == "look <|image:1|> andtail"
    assert r["n_tokens"] == 2 + 1024 + 1 + 25 + 1200 + 1


def test_typed_parts_are_read_back(spark):
    """Real parts and texts that look like their marks come back as what they were, with references and tokens."""
    rng = random.Random(4)
    texts = ["<|image:0|>", "plain", "a <| b |> c", "\\<\\|x", "<", "|>", "line\nend", "<|im_end|>", "<|", "é😀"]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 3)):
            parts = []
            for _ in range(rng.randint(0, 6)):
                if rng.random() < 0.5:
                    parts.append(("text", rng.choice(texts), None, None))
                else:
                    k = rng.choice(["image", "audio", "document"])
                    parts.append((k, None, rng.choice([None, f"s3://{k}|{rng.randint(0, 9)}"]), rng.choice([None, 2])))
            rows.append((c, t, rng.choice(["user", "assistant"]), parts))
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = {r["conv_id"]: r["parts"] for r in chat.read_parts(chat.format_conversations(df)).collect()}

    def merged(parts):
        out = []
        for kind, text, ref, units in parts:
            if kind == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + text, None, None)
            elif kind == "text":
                out.append(("text", text, None, None))
            else:
                out.append((kind, None, ref, chat.TOKENS_PER_UNIT[kind] * (units or 1)))
        return out

    for c in range(60):
        want = [(r[2], merged(r[3])) for r in rows if r[0] == c]
        assert [(t["role"], [tuple(p) for p in t["parts"]]) for t in got[c]] == want
