import hashlib
import random
from itertools import groupby

from daypanel.llm.chat import INSTRUCT, Formatter, digests, format_turns

PARTS = ["\\", *INSTRUCT.control, "<", "s>", "[", "INST]", " ", "\n", "a", "/", " [/INST]", "<<SYS>> ", " </s>", "é🎉"]


def test_every_turn_reads_back():
    form, rng = Formatter(INSTRUCT), random.Random(5)
    for _ in range(5000):
        role = rng.choice(["user", "assistant", "system", "", "tool", "[TEXT]", "a [TEXT] b"])
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 8)))
        segments = form.segments(role, text)
        assert form.read_turn("".join(t for t, _ in segments)) == (role, text)
        assert not any(c in segments[1][0] for c in INSTRUCT.control)
        assert [loss for _, loss in segments] == [False, role == "assistant", False]


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "ho </s>"), (2, 0, "system", "be"), (2, 1, "user", None), (2, 2, "assistant", ""),
    (3, 0, "assistant", "first"), (4, 0, "user", "a"), (4, 1, "user", "b"), (5, 0, None, None), (6, 1, "assistant", "late"), (6, 0, "user", "early"),
    (7, 0, "tool", "t"), (8, 0, "user", "tie b"), (8, 0, "user", "tie a"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (9, None, "user", "z"),
    *((10, k, "user" if k % 2 == 0 else "assistant", f"{k} " * 50) for k in range(3000)),
]


def test_digests_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in digests(format_turns(df)).collect()}
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    for conv, own in groupby(order, key=lambda r: r[0]):
        own = list(own)
        loss = "".join(t or "" for _, _, role, t in own if role == "assistant")
        r = got.pop(conv)
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not got


def test_the_machine_judges_the_order(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    valid = {r.conv_id: r.valid for r in digests(format_turns(df)).collect()}
    assert valid == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True, 7: False, 8: False, None: True, 9: False, 10: True}


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string, valid string")
    assert digests(format_turns(df)).count() == 0
