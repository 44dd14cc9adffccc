import random
from hashlib import sha256

from cohortflow.llm import chat_format as C


def digest(s):
    return sha256(s.encode()).hexdigest()


def check(df):
    rows = df.select("conv_id", "turn", "role", "text").collect()
    by = {}
    for r in rows:
        by.setdefault(r.conv_id, []).append(((r.turn is None, r.turn or 0, r.role is not None, r.role or "",
                                              r.text is not None, r.text or ""), r.role or "", r.text or ""))
    want = []
    for c, turns in by.items():
        turns = [(r, t) for _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        want.append((c, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss)))
    made = C.format_conversations(df)
    got = C.read_back(made).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    for r in made.collect():
        assert all(r.formatted[b:b + 7] == "</turn>" for b in r.loss_ends)


def test_conversations(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))


def test_edges(spark):
    hard = ["\\", "\\\\", "</turn>", "<", "###", "### ", "#### User: x", "\\### Assistant: </turn> ok", "", None,
            "é</turn>\n### ", "中文\\</turn", "\n", "a" * 200_000, "<\\/turn>", "#\\## "]
    rng = random.Random(1)
    rows = [(i % 5 if i % 7 else None, rng.choice([0, 1, None, 2]), rng.choice(["user", "assistant", None, "a:\nb\\", "### "]),
             t, "x") for i, t in enumerate(hard * 6)]
    schema = "conv_id long, turn long, role string, text string, formatted string"
    check(spark.createDataFrame(rows, schema))
    assert C.read_back(C.format_conversations(spark.createDataFrame([], schema))).count() == 0


def test_no_control_string_in_an_escaped_text():
    for t in ("</turn>### </turn>", "#### ### #", "</turn</turn>"):
        data, at = C.escape([t])
        s = data.tobytes().decode()
        assert "### " not in s and "</turn>" not in s and C.unescape(s) == t


def test_a_long_conversation_in_bounded_segments(spark):
    """One conversation of most rows, and rows without an id, many of them
    equal; the order of turns holds across segments and ranges."""
    rng = random.Random(5)
    rows = [(1, i % 900, rng.choice(["user", "assistant", "r" * 40 + str(i % 3)]), f"{rng.random()} " * (i % 60), i)
            for i in range(4000)]
    rows += [(None, rng.choice([0, 1, None]), "assistant", rng.choice([None, "", "same " * 30, "long " * 60 + str(i % 9)]), i)
             for i in range(3000)]
    rows += [(k, 0, "user", "hello", 0) for k in range(2, 50)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, own long").repartition(7)
    check(df)
    made = C.format_conversations(df).collect()
    for c in (1, None):
        own = [r for r in made if r.conv_id == c]
        assert len(own) > 3 and len({r.segment for r in own}) == len(own)
    assert max(len(r.formatted) for r in made) < 2 * C.SEGMENT_CHARS
