import hashlib
import random
from collections import defaultdict

from webloom.llm import chat as C

CONTROL = ["<|user|>\n", "<|end|>\n", "</s>", "[INST]", "[/INST]", "&amp;", "&lt;", "&", "<", "[", "&#91;", "<|", "|>", "\n", "x", "é\U0001f600"]


def by_hand(rows, target="assistant"):
    convs = defaultdict(list)
    for c, n, r, t in rows:
        convs[c].append((n is not None, n or 0, r or "", t or ""))
    out = []
    for c, ts in convs.items():
        ts = [x[2:] for x in sorted(ts)]
        loss = "".join(t for r, t in ts if r == target)
        turns = "".join(f"{r}\n{t}\n" for r, t in ts)
        out.append((c, len(ts), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(df, rows):
    got = C.read_back(C.format_chats(df)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == by_hand(rows)


def test_all_conversations(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    check(df, [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


def test_control_strings_and_odd_rows(spark):
    rnd = random.Random(1)
    rows = []
    for c in range(60):
        for n in range(rnd.randrange(1, 7)):
            rows.append((c, n, rnd.choice(["user", "assistant", "system", None, "<|x"]), rnd.choice([None, "", "".join(rnd.choices(CONTROL, k=rnd.randrange(12)))])))
    rows += [(None, 1, "assistant", "x"), (100, None, "user", "first"), (100, 1, "assistant", "a"), (100, 1, "assistant", "a"), (101, 0, "user", "y" * 200_000), (102, 0, "assistant", None)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, context string")
    check(df, rows)
    assert C.read_back(C.format_chats(df.limit(0))).count() == 0


def test_examples(spark):
    rows = [(1, 0, "user", "hi <b>"), (1, 1, "assistant", "yo"), (1, 2, "user", "and?"), (1, 3, "assistant", "no [x]"), (1, 4, "user", "bye")]
    out = sorted(C.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: r.example)
    assert [r.target for r in out] == ["yo", "no [x]", None]
    assert out[0].formatted == "<|user|>\nhi &lt;b><|end|>\n<|assistant|>\nyo<|end|>\n"
    assert out[1].context == out[0].formatted + "<|user|>\nand?<|end|>\n"
    masked = [r.formatted[r.loss_start : r.loss_start + r.loss_chars] for r in out]
    assert masked == ["yo", "no &#91;x]", ""]


def test_no_python_in_the_plan(spark, sf):
    plan = C.op10_chat(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
