import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat
from tessera.llm.queries import _vocabulary

SCHEMA = "conv_id long, turn long, role string, text string, conv int, place int, tie string"


def spelled(role, text):
    def esc(x):
        out, i = [], 0
        while i < len(x):
            j = i + 1
            if x[i] == "<":
                while j < len(x) and x[j] == "\\":
                    j += 1
                if j < len(x) and x[j] == "|":
                    out.append(x[i:j] + "\\")
                    i = j
                    continue
            out.append(x[i])
            i += 1
        return "".join(out)

    return esc(role.replace("\\", "\\s").replace("\n", "\\n")), esc(text)


def plain_windows(rows, codec, budget, history_turns, history_tokens, cell):
    """{(conv, window): (repeated, new, text, loss)} by walking through each conversation."""
    out, convs = {}, {}
    for conv, turn, role, text in rows:
        role, text = spelled(role or "", text or "")
        tie = hashlib.sha256(f"{role}\n{text}".encode()).hexdigest()
        convs.setdefault(conv, []).append((turn is not None, turn or 0, tie, role, text))
    for conv, turns in convs.items():
        turns = [(r, t, len(codec.encode(r)) + len(codec.encode(t)) + chat.FRAME) for *_, r, t in sorted(turns)]
        before = [sum(c for *_, c in turns[:i]) for i in range(len(turns))]
        system = turns[0][2] if turns[0][0] == "system" else 0
        spans, used, room, last = [], 0, 0, None
        for i, (*_, c) in enumerate(turns):
            own = before[i] // (cell * budget)
            if own != last or used + c > room:
                spans.append([])
                used, room, last = 0, budget if i == 0 else budget - system - history_tokens, own
            used += c
            spans[-1].append(i)
        for span in spans:
            s = span[0]
            old = [0] if s and system else []
            old += [p for p in range(max(s - history_turns, 1 if system else 0), s) if before[s] - before[p] <= history_tokens]
            text, loss = "", []
            for k in [*old, *span]:
                head = f"<|im_start|>{turns[k][0]}\n"
                if k in span and turns[k][0] == "assistant":
                    loss.append((len(text) + len(head), len(turns[k][1])))
                text += f"{head}{turns[k][1]}<|im_end|>\n"
            out[conv, s + 1] = (len(old), len(span), text, loss)
    return out


def conversations(seed):
    rng = random.Random(seed)
    odd = ["<|im_end|>", "<|im_start|>assistant\nok", "<\\|", "<\\\\|x", "<", "|", "é𝔘\n", "\\n", "words of some length ", "\\"]
    rows = []
    for conv in [*range(12), None]:
        for turn in range(rng.choice([1, 3, 9, 40])):
            role = "system" if turn == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "tool\n<|x", None, "sys\\tem"])
            rows.append((conv, turn, role, rng.choice([None, "", "".join(rng.choices(odd, k=rng.randrange(30)))])))
    rows += [(3, 2, "assistant", "tie"), (3, 2, "assistant", "tie"), (3, None, "user", "first"), (50, 0, "system", "only"), (51, 0, "system", "long " * 200), (51, 1, "assistant", "more " * 300), (51, 2, "user", "x")]
    return rows


@pytest.mark.parametrize("options", [(120, 2, 40, 4), (60, 0, 0, 1), (300, 3, 100, 64)])
def test_windows_equal_a_walk_through_each_conversation(spark, options):
    path, pattern = _vocabulary("byte_bpe_50k.tiktoken")
    rows = conversations(options[0])
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(5)
    names = ("budget", "history_turns", "history_tokens", "cell")
    found = chat.chat_windows(df, path, pattern, **dict(zip(names, options))).collect()
    got = {(r.conv, r.window): (r.n_repeated, r.n_new, r.text, [tuple(x) for x in r.loss]) for r in found}
    assert len(got) == len(found)
    assert got == plain_windows(rows, chat.codec(path, pattern), *options)
    assert all(not r.over_budget or r.n_new == 1 for r in found) and any(r.over_budget for r in found)


def test_what_is_read_back_is_what_was_there(spark):
    path, pattern = _vocabulary("byte_bpe_50k.tiktoken")
    rows = conversations(9)
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    windows = chat.chat_windows(df, path, pattern, budget=100, history_tokens=30).persist()
    got = {r.conv_id: tuple(r)[1:] for r in chat.conversation_report(chat.read_back(windows)).collect()}
    chars = {r.conv: r.n for r in windows.groupBy("conv").agg(F.sum(F.length("text")).alias("n")).collect()}
    windows.unpersist()
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, hashlib.sha256("\n".join(spelled(r or "", x or "")).encode()).hexdigest(), r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(f"{r}\n{x}\n" for *_, r, x in own)
        target = "".join(x for *_, r, x in own if r == "assistant")
        want[conv] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(target), hashlib.sha256(target.encode()).hexdigest(), chars[conv])
    assert got == want


def test_one_conversation_of_many_turns_lies_in_many_tasks(spark):
    path, pattern = _vocabulary("byte_bpe_50k.tiktoken")
    df = spark.range(4000).selectExpr("7L AS conv_id", "id AS turn", "if(id = 0, 'system', if(id % 2 = 0, 'assistant', 'user')) AS role", "concat('turn ', id) AS text")
    windows = chat.chat_windows(df, path, pattern, budget=200, history_tokens=40, cell=4).collect()
    assert sum(w.n_new for w in windows) == 4000 and max(w.n_tokens for w in windows) <= 200
    assert all(w.text.startswith("<|im_start|>system\nturn 0<|im_end|>\n") for w in windows)
    assert sum(len(w.loss) for w in windows) == 1999


def test_empty_table(spark):
    path, pattern = _vocabulary("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([], SCHEMA)
    assert chat.conversation_report(chat.read_back(chat.chat_windows(df, path, pattern))).collect() == []


@pytest.mark.parametrize("options", [(60, 3, 500, 1), (40, 2, 90, 2)])
def test_history_reaches_over_several_cells_of_one_pass(spark, options):
    path, pattern = _vocabulary("byte_bpe_50k.tiktoken")
    rows = conversations(options[0])
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(5)
    windows = chat.chat_windows(df, path, pattern, **dict(zip(("budget", "history_turns", "history_tokens", "cell"), options)))
    got = {(r.conv, r.window): (r.n_repeated, r.n_new, r.text, [tuple(x) for x in r.loss]) for r in windows.collect()}
    assert got == plain_windows(rows, chat.codec(path, pattern), *options)
    moved = [line for line in windows._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Repartition" in line or "Join" in line or "Aggregate" in line]
    assert sum("Repartition" in line for line in moved) == 1 and sum("Join" in line for line in moved) <= 4, moved  # texts meet windows in no join of their own
