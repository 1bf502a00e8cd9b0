import hashlib
import random
import re

import pytest

from fathomry.llm import chat_format as cf

CTRL = re.compile(rf"([<\[])(\\*)({cf.CONTROLS})")
TOKEN = re.compile(r"[^\W_]{1,6}|[^ \t\n\x0B\f\r]")


def esc(t):
    return CTRL.sub(lambda m: m[1] + "\\" + m[2] + m[3], t)


def n_tokens(t):
    return len(re.findall(r"[a-zA-Z0-9éü]{1,6}|[^ \t\n\x0B\f\ra-zA-Z0-9éü]", t)) + 4


def layout(rows, o):
    """Windows of one conversation, turn by turn: lists of (pos, new)."""
    sysn = n_tokens(rows[0][1]) if rows[0][0] == "system" else None
    left = o.budget - (sysn or 0)
    most = min(o.history, max(left // 4, 0))
    room = max(left - most, 2)
    stride, s, turns = room // 2, 0, []
    for p, (_, text) in enumerate(rows):
        n = n_tokens(text)
        if not (p == 0 and sysn is not None):
            k = s // stride
            turns.append((p, s, n, (k, int(s + n - k * stride > room))))
            s += n
    keys = sorted({t[3] for t in turns})
    out = []
    for key in keys:
        mine = [t for t in turns if t[3] == key]
        start = mine[0][1]
        back = min(most, left - sum(t[2] for t in mine))
        items = [(t[0], False) for t in turns if t[1] < start and start - t[1] <= back] + [(t[0], True) for t in mine]
        out.append(([(0, key == keys[0])] if sysn is not None else []) + items)
    return out or [[(0, True)]]


def data():
    r = random.Random(2)
    bits = ["</s>", "<\\|end|>", "<|end|>", "[INST]", "[\\\\/INST]", "<", "<|sep|>", "é", "ü", "word", "longerword", "\n", "<|start|>x<|sep|>", "\\", "12", "!", " ", " ", " "]
    convs = {}
    for c in range(30):
        rows = [("system", "be good [INST]")] if c % 3 == 0 else []
        for i in range(r.choice([0, 1, 2, 5, 30]) if rows else r.choice([1, 2, 5, 30])):
            rows.append((["user", "assistant"][i % 2] if c % 5 else r.choice(["user", "assistant", "<|end|>", ""]), "".join(r.choice(bits) for _ in range(r.choice([0, 3, 20, 60])))))
        convs[c] = rows
    convs[50] = [("system", "s " * 100), ("user", "u " * 80), ("assistant", "a " * 1000), ("user", "u " * 20)]
    convs[51] = [("system", "s " * 900), ("user", "u " * 100), ("assistant", "a " * 150), ("user", "u"), ("assistant", "b"), ("user", "c " * 20)]
    convs[52] = [("system", "s " * 2000), ("user", "hi"), ("assistant", "yo")]
    convs[53] = [("system", "s " * 46), *[(["user", "assistant"][i % 2], "x " * (i % 4)) for i in range(20)]]
    convs[99] = [(["user", "assistant"][i % 2], f"turn {i} of a long one") for i in range(700)]
    return convs


@pytest.mark.parametrize("o", [cf.Options(budget=60, history=12, block=4), cf.Options()])
def test_windows_and_round_trip(spark, o):
    convs = data()
    rows = [(c, i, role, text, "x") for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string")
    w = cf.windows(df, o)
    plan = w._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = {}
    for x in w.collect():
        got.setdefault(x["conv_id"], []).append(x)
    for c, turns in convs.items():
        mine = sorted(got[c], key=lambda x: x["first_pos"])
        want = layout(turns, o)
        assert len(mine) == len(want)
        for x, items in zip(mine, want, strict=True):
            assert x["formatted"] == "".join(f"<|start|>{esc(turns[p][0])}<|sep|>{esc(turns[p][1])}<|end|>" for p, _ in items)
            assert list(x["new_turns"]) == [new for _, new in items]
            assert [x["formatted"][s["start"] : s["end"]] for s in x["loss_spans"]] == [esc(turns[p][1]) for p, new in items if new and turns[p][0] == "assistant"]
            assert x["over_budget"] == (x["n_tokens"] > o.budget)
            if x["over_budget"]:
                assert [new for p, new in items if turns[p][0] != "system" or p] == [True]
    for x in cf.read_back(w).collect():
        turns = convs[x["conv_id"]]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert x["n_turns"] == len(turns) and x["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert x["loss_chars"] == len(loss) and x["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert x["formatted_chars"] == sum(len(y["formatted"]) for y in got[x["conv_id"]])


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, 0, None, None), (1, 0, None, None), (None, None, "user", "hi"), (None, 1, "assistant", "yo"), (5, 0, "system", "only")], "conv_id long, turn long, role string, text string")
    got = {x["conv_id"]: x for x in cf.read_back(cf.windows(cf.with_probe(df))).collect()}
    assert {k: v["n_turns"] for k, v in got.items()} == {1: 2, None: 2, 5: 1, -7: 2}
    assert got[-7]["loss_chars"] == 21 and got[None]["loss_chars"] == 2
    assert cf.windows(df.limit(0)).count() == 0
