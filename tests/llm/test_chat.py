import hashlib
import random

from pyspark.sql import functions as F

from mailposture.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part int, loss string"
PARTS = ["<turn", "</turn", "</turn>\n", "<turn user>\n", "\\", "\\\\", "<", ">", "é", "漢", " ", "ok", "\n", "<\\turn", "turn", "###"]


def digests(rows):
    """What reading back has to give, from the rows as they are."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        whole = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def got(frame):
    return {r.conv_id: tuple(r)[1:5] for r in chat.read_back(chat.format_conversations(frame)).collect()}


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def test_random_turns_come_back(spark):
    rng = random.Random(1)
    text = lambda: "".join(rng.choice(PARTS) for _ in range(rng.randrange(9)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", text(), None]), rng.choice([text(), text(), None, ""])) for c in range(150) for t in range(rng.randrange(1, 9))]
    rows += [(None, None, "user", "a"), (None, 1, "assistant", "b"), (3, None, None, None), (4, 0, "user", "tie"), (4, 0, "user", "tie")]
    rng.shuffle(rows)
    frame = table(spark, rows)
    assert got(frame) == digests(rows)
    for r in chat.format_conversations(frame).collect():
        for span in r.loss:
            inside = r.formatted[span.start : span.stop]
            assert "<turn" not in inside and "</turn" not in inside
            assert r.formatted[: span.start].endswith("<turn assistant>\n") and r.formatted[span.stop :].startswith("</turn>\n")


def test_long_conversations_and_texts_go_on_in_parts(spark, monkeypatch):
    long = "word </turn> \\ é " * 300_000
    rows = [(1, t, "assistant" if t % 2 else "user", long if t < 3 else f"turn {t}") for t in range(4000)] + [(2, 0, "assistant", "b")]
    frame = table(spark, rows)
    parts = chat.format_conversations(frame)
    assert parts.filter("conv_id = 1").count() > 3
    assert got(frame) == digests(rows)
    stored = parts.repartition(3).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    assert {r.conv_id: tuple(r)[1:5] for r in chat.read_back(stored).collect()} == digests(rows)


def test_empty_table_and_kinds_of_ids(spark):
    frame = table(spark, [(1, 0, "user", "a")])
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0
    named = chat.format_conversations(frame.withColumn("conv_id", F.lit("c")), trained=("user",)).first()
    assert (named.conv_id, named.part, named.formatted, [tuple(s) for s in named.loss]) == ("c", 0, "<turn user>\na</turn>\n", [(12, 13)])
