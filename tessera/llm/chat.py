"""Chat formatting: conversations as windows of whole turns under a token budget, with a loss mask.

Each turn's tokens are counted once. Running sums over a conversation, from range partitions and offsets so
that one long conversation lies in many tasks, choose the spans: a window takes as many new turns as fit,
beside the system turn, which every window repeats, and room for a limited history, the turns just before
the span. Repeated turns carry no loss; each assistant turn is a target in the one window where it is new.
The sums also cut a conversation into cells of `cell` budgets each, in which spans are chosen one after
another; windows end where a cell does, so that no task walks through a whole conversation. Texts travel with
their turns, twice: to the range partitions where they are counted, and to their cells, where windows are made.

The template is `<|im_start|>` role, line feed, text, `<|im_end|>`, line feed. Inside roles and texts one
backslash more is put between `<` and `|` wherever only backslashes stand between them, so no control string
can appear; taking one away gives the text back. Line feeds and backslashes of a role are escaped first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import codec
from tessera.llm.common import materialized, slices

# fixed values: the template's control strings
START, END = "<|im_start|>", "<|im_end|>"
#: Ids of a turn besides its role and text: two control strings and two line feeds.
FRAME = 4


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _role_out(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def _role_back(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def _counted(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows dealt by range, written with their tokens: (part, conv, nth, so_far, cost, head, role, text).

    nth and so_far are a turn's place and the tokens up to and with it among its conversation's rows of the range
    partition; head is the tokens of the first of them, if that is a system turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        conv, nth, so_far, head = None, 0, 0, 0
        for batch in slices(batches, 512):
            convs, roles, texts = (batch.column(i).to_pylist() for i in (1, 2, 3))
            costs = [len(a) + len(b) + FRAME for a, b in zip(own.encode_many(roles), own.encode_many(texts))]
            out = []
            for c, role, cost in zip(convs, roles, costs):
                if not nth or c != conv:
                    conv, nth, so_far, head = c, 0, 0, cost if role == "system" else 0
                nth, so_far = nth + 1, so_far + cost
                out.append((nth, so_far, cost, head))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in zip(*out))], names=["part", "conv", "role", "text", "nth", "so_far", "cost", "head"])

    dealt = turns.repartitionByRange("conv", "turn", "tie").sortWithinPartitions("conv", "turn", "tie").select(F.spark_partition_id().alias("part"), "conv", "role", "text")
    return materialized(dealt.mapInArrow(run, f"part int, conv {dict(turns.dtypes)['conv']}, role string, text string, nth long, so_far long, cost long, head long"))


def _placed(cut: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their place in the conversation, the tokens before them, the system turn's tokens and their cell of
    `width` tokens; and (of, total) of the conversations that are longer than a cell.

    Only a range partition's first conversation has rows in an earlier one, so what is added is one row a partition.
    """
    own = cut.groupBy("part", "conv").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"), F.max("head").alias("head"))
    across = Window.partitionBy("conv").orderBy("part")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    offsets = own.select(
        F.col("part").alias("of_part"), F.col("conv").alias("of"), F.sum("n").over(before).alias("n_before"), F.sum("cost").over(before).alias("cost_before"),
        F.first("head").over(across).alias("first_head"), F.sum("cost").over(across).alias("total"),
    )
    offsets = materialized(offsets.where(F.col("n_before").isNotNull() | (F.col("total") > width)))
    carried = offsets.where("n_before is not null").drop("total")
    both = cut.join(F.broadcast(carried), (F.col("part") == F.col("of_part")) & F.col("conv").eqNullSafe(F.col("of")), "left")
    placed = both.select(
        "conv", "cost", "role", "text", (F.coalesce("n_before", F.lit(0)) + F.col("nth")).alias("place"),
        (F.coalesce("cost_before", F.lit(0)) + F.col("so_far") - F.col("cost")).alias("before"), F.coalesce("first_head", "head").alias("system_cost"),
    )
    return placed.withColumn("cell", F.expr(f"before div {width}")), offsets.groupBy("of").agg(F.max("total").alias("total")).where(F.col("total") > width)


_WINDOW = "window long, n_repeated int, n_new int, n_tokens long, over_budget boolean, text string, loss array<struct<start:int,length:int>>"


def _windows(placed: DataFrame, budget: int, history_turns: int, history_tokens: int) -> DataFrame:
    """The windows of rows dealt by conversation and cell; rows that are not `own` are there to be repeated."""
    told = ["conv", "cell", "place", "before", "cost", "system_cost", "role", "text", "own"]
    kind = dict(placed.dtypes)["conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = system = window = None
        old: list[tuple] = []  # the last turns before this one: place, before, cost, role, text
        used = room = 0
        conv_type = window_type = None

        def made(conv, again: list[tuple], new: list[tuple]) -> tuple:
            parts, loss, at = [], [], 0
            for i, (_, _, _, role, text) in enumerate([*again, *new]):
                if i >= len(again) and role == "assistant":
                    loss.append({"start": at + len(START) + len(role) + 1, "length": len(text)})
                parts.append(f"{START}{role}\n{text}{END}\n")
                at += len(parts[-1])
            tokens = sum(t[2] for t in again) + sum(t[2] for t in new)
            return conv, new[0][0], len(again), len(new), tokens, tokens > budget, "".join(parts), loss

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            types = [conv_type, pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), window_type]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["conv", "window", "n_repeated", "n_new", "n_tokens", "over_budget", "text", "loss"])

        window_type = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
        for batch in slices(batches):
            conv_type, done = batch.schema.field(0).type, []
            for conv, cell, place, before, cost, system_cost, role, text, own in zip(*(c.to_pylist() for c in batch.columns)):
                if group != (conv, cell):
                    if window:
                        done.append(made(group[0], *window))
                    group, system, window, old = (conv, cell), None, None, []
                turn = (place, before, cost, role, text)
                if own:
                    if window is None or used + cost > room:
                        if window:
                            done.append(made(conv, *window))
                        again = [t for t in old if t[0] >= place - history_turns and before - t[1] <= history_tokens and t[0] > (system_cost > 0)]
                        window, used = ([system] * (place > 1 and system_cost > 0) + again, []), 0
                        room = budget if place == 1 else budget - system_cost - history_tokens
                    used += cost
                    window[1].append(turn)
                if place == 1:
                    system = turn
                old = [*old, turn][-history_turns:] if history_turns else []
            if done:
                yield packed(done)
        if window:
            yield packed([made(group[0], *window)])

    dealt = placed.select(told).repartition("conv", "cell").sortWithinPartitions("conv", "cell", "place")
    return dealt.mapInArrow(run, f"conv {kind}, {_WINDOW}")


def chat_windows(
    rows: DataFrame, path: str, pattern: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    budget: int = 1024, history_turns: int = 2, history_tokens: int = 256, cell: int = 64,
) -> DataFrame:
    """(conv, window, n_repeated, n_new, n_tokens, over_budget, text, loss): one row for each window.

    window is the place, from 1, of its first new turn; its text holds n_repeated turns, the system turn and
    then history, and n_new turns. loss lists (start, length) in code points: the new assistant turns' texts.
    The system turn is a conversation's first turn if its role is `system`. History takes at most history_turns
    turns of together at most history_tokens tokens. A turn that does not fit stays whole in a window of its
    own, which is over_budget then; nothing is cut or left out.

    Turns come by turn, a null one first; ties in a fixed order of role and text, each row a turn of its own,
    repeated rows too. Null roles and texts count as empty; rows with a null conversation form one. Other
    columns, whatever their names, are not looked at. An empty table gives no windows.
    """
    base = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    turns = base.withColumns({"role": _role_out(F.col("role")), "text": escaped(F.col("text"))})
    turns = turns.withColumn("tie", F.unhex(F.sha2(F.concat("role", F.lit("\n"), "text").cast("binary"), 256)))
    width = cell * budget
    placed, longer = _placed(_counted(turns, path, pattern), width)
    own = placed.withColumn("own", F.lit(True))
    # a cell's first window may repeat turns of the cells before, all within history_tokens, and the system turn
    after = F.expr(f"(before + {history_tokens}) div {width}")
    back = own.where((F.lit(history_turns) > 0) & (after > F.col("cell")) & ((F.col("place") > 1) | (F.col("system_cost") == 0)))
    back = back.withColumn("cell", F.explode(F.sequence(F.col("cell") + 1, after)))
    heads = own.where("place = 1 and system_cost > 0").join(longer, F.col("conv").eqNullSafe(F.col("of")))
    heads = heads.withColumn("cell", F.explode(F.sequence(F.lit(1).cast("long"), F.expr(f"total div {width}")))).drop("of", "total")
    return _windows(own.unionByName(back.unionByName(heads).withColumn("own", F.lit(False))), budget, history_turns, history_tokens)


def read_back(windows: DataFrame) -> DataFrame:
    """(conv, window, turns, targets, n_chars), from the formatted texts and masks alone.

    turns are the new turns' (role, text), unescaped; targets the texts under the mask, unescaped.
    """
    pieces = F.filter(F.split("text", r"<\|im_end\|>\n"), lambda x: x != "")
    body = lambda x: F.substr(x, F.lit(len(START) + 1))
    cut = lambda x: F.locate("\n", x)
    turn = lambda x: F.struct(_role_back(F.substr(x, F.lit(1), cut(x) - 1)).alias("role"), unescaped(F.substr(x, cut(x) + 1)).alias("text"))
    new = F.slice(pieces, F.col("n_repeated") + 1, F.greatest(F.size(pieces), F.lit(1)))
    return windows.select(
        "conv", "window", F.transform(F.transform(new, body), turn).alias("turns"),
        F.transform("loss", lambda s: unescaped(F.substr(F.col("text"), s["start"] + 1, s["length"]))).alias("targets"), F.length("text").cast("long").alias("n_chars"),
    )


def conversation_report(back: DataFrame) -> DataFrame:
    """One row for each conversation of read_back: its turns, targets and length.

    A digest is of the whole conversation in order, so its windows pass one after another through one task,
    which holds a batch of them and three sums. Conversations without rows have none here.
    """
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    flat = back.select("conv", "window", F.size("turns").cast("long").alias("n"), said.cast("binary").alias("said"), F.array_join("targets", "").alias("target"), "n_chars")
    flat = flat.select("conv", "window", "n", "said", F.col("target").cast("binary").alias("target"), F.length("target").cast("long").alias("target_chars"), "n_chars")
    kind = dict(flat.dtypes)["conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        open_conv: list | None = None

        def row(c: list) -> tuple:
            return c[0], c[1], c[2].hexdigest(), c[3], c[4].hexdigest(), c[5]

        for batch in slices(batches, 256):
            done = []
            for conv, _, n, said, target, chars, length in zip(*(c.to_pylist() for c in batch.columns)):
                if open_conv is None or open_conv[0] != conv:
                    if open_conv is not None:
                        done.append(row(open_conv))
                    open_conv = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                open_conv[1] += n
                open_conv[2].update(said)
                open_conv[3] += chars
                open_conv[4].update(target)
                open_conv[5] += length
            if done:
                yield _batch(done, names, batch.schema.field(0).type)
        if open_conv is not None:
            yield _batch([row(open_conv)], names, batch.schema.field(0).type)

    dealt = flat.repartition("conv").sortWithinPartitions("conv", "window")
    return dealt.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _batch(rows: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
