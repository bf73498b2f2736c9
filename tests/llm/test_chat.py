"""Chat formatting against comparing all conversations."""

import random

from granary.llm import chat
from tests.llm.helpers import prose

SCHEMA = "conv_id long, turn long, role string, text string"


def slow(rows):
    talks = {}
    for conv, turn, role, text in {(c, t, "unknown" if r is None else r, x or "") for c, t, r, x in rows}:
        if conv is not None:
            talks.setdefault(conv, []).append((turn, role, text))
    key = lambda t: tuple((x is not None, x if x is not None else "") for x in t)
    talks = {c: tuple((r, x) for _, r, x in sorted(t, key=key)) for c, t in talks.items()}
    out = []
    for c, t in talks.items():
        longer = any(len(o) > len(t) and o[: len(t)] == t for o in talks.values())
        first = min(d for d, o in talks.items() if o == t) == c
        if first and not longer:
            inside = sum(t[: len(o)] == o for o in talks.values()) - 1
            body = "".join(f"<|im_start|>{'unknown' if r is None else r}\n{escape(x)}<|im_end|>\n" for r, x in t)
            out.append((c, len(t), inside, body))
    return sorted(out)


def escape(x):
    return (x or "").replace("<|im_start|>", "< |im_start|>").replace("<|im_end|>", "< |im_end|>")


def test_against_all_conversations(spark):
    r = random.Random(2)
    rows, n = [], 0
    for g in range(30):
        talk = [("system" if r.random() < 0.2 else "user", prose(g, 5))] + [(("assistant", "user")[k % 2], prose(g * 10 + k, r.randrange(8))) for k in range(r.randrange(6))]
        for _ in range(r.randrange(1, 6)):
            part = talk[: r.randrange(1, len(talk) + 1)]
            rows += [(n, k, *t) for k, t in enumerate(part)]
            n += 1
    for k in range(40):  # a very common first turn
        rows += [(n + k, 0, "user", "hello"), (n + k, 1, "assistant", prose(k, 3))]
    rows += [(9000, 0, "user", "hello")]
    rows += [(None, 0, "user", "lost"), (9001, None, None, None), (9002, 0, "user", "x <|im_end|> y"), (9002, 0, "user", "x <|im_end|> y"), (9003, 0, "user", None), (9004, 0, "user", ""), (9006, 0, None, "who"), (9007, 0, "unknown", "who"), (9005, 1, "user", "tie b"), (9005, 1, "user", "tie a")]
    got = sorted(map(tuple, chat.chat(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()))
    assert got == slow(rows)


def test_empty(spark):
    assert chat.chat(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_very_long_conversation(spark):
    """One of 3,000 turns, and snapshots of it at some of them."""
    rows = [(c, k, "user", f"turn {k}") for c, n in enumerate((3000, 1, 1500, 2999, 3000)) for k in range(n)]
    got = chat.chat(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.conv_id, r.n_turns, r.n_collapsed) for r in got] == [(0, 3000, 4)]
