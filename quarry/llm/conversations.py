"""Conversation structure repair by composing weighted finite-state machines.

The rows of a conversation, in order, are an input acceptor; an edit transducer keeps (0), reroles (2) or
deletes (3) each of them and inserts turns (2) anywhere; the role grammar ``(s?(ua)+)?`` accepts what comes
out. Their composition is built lazily, position by position, which is its topological order, and the
shortest path is taken over weights (cost, label string), so ties go to the string that is least in ASCII.

A state and a label have one successor, so two different paths of equal cost differ at some letter, and the
order of weights survives concatenation. Conversations of any length are therefore cut into blocks of at
most 4,096 rows: each block gives the least weight between every two grammar states, the blocks of a
conversation are chained backwards for the costs that remain and forwards for the choices, and the chosen
labels go back to the blocks' rows. Only labels, never texts, are held for a whole conversation; repaired
turns stream in order.

Rows that tie in turn are ordered by role and text, bytes ascending, and equal rows are interchangeable.
A null conv_id is a conversation of its own; null turns come first; null roles and texts are one space.
Roles with other initials than s, u and a are never kept. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

BLOCK_BITS = 12
HEAD_CHARS = 64  # of a text, to deal rows of one turn to several tasks
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
NAMES = {"u": "user", "a": "assistant"}
#: The role grammar: state to {initial: state}; a conversation may end in the states of FINAL.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
KEEP, REROLE, DELETE, INSERT = "KRDI"
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
EMPTY_HASH = hashlib.sha256(b"").hexdigest()
Weight = tuple[int, str]


def made(state: int) -> str:
    """The initial of the turn that may be made in a state: inserted, or reroled to."""
    return next(r for r in GRAMMAR[state] if r in NAMES)


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) after seeded damage, with k_n copies of each.

    CRC-32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes its sentence ends,
    3 repeats it, 4 makes its role user.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    role = F.when(kind == 4, "user").otherwise(text_of("role"))
    return rows.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("k_n"))


def _conversation(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def ordered(rows: DataFrame) -> DataFrame:
    """All rows, k_n copies of each, in order: k_conv, conv_id, turn, role, text, k_row (ascending), k_fault; written.

    Equal rows are counted before they are dealt, and the first turn of each role and text is found by
    partial minima, so many copies in one conversation meet in no task.
    """
    same = ["k_conv", "turn", "role", "text"]
    counted = rows.withColumn("k_conv", _conversation(F.col("conv_id"))).groupBy("conv_id", *same).agg(F.sum("k_n").cast("int").alias("k_n"))
    place = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))  # nulls first
    counted = written(counted.withColumns({"k_same": F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256), "k_place": place}), "turns")
    first = counted.groupBy("k_conv", "k_same").agg(F.min("k_place").alias("k_first"))
    rows = counted.join(first, ["k_conv", "k_same"]).withColumn("k_copy", F.explode(F.sequence(F.lit(1), F.col("k_n"))))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    again = (F.col("k_copy") > 1) | (F.col("k_place") > F.col("k_first"))
    cut = F.col("text").rlike(r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, BLANK).when(again, DUPLICATE).when(cut, TRUNCATED).otherwise(SOUND)
    rows = rows.select("k_conv", "conv_id", "turn", "role", "text", fault.alias("k_fault"), F.substring("text", 1, HEAD_CHARS).alias("k_head"))
    rows = rows.repartitionByRange("k_conv", "turn", "role", "k_head").sortWithinPartitions("k_conv", "turn", "role", "text")
    return written(rows.drop("k_head").withColumn("k_row", F.monotonically_increasing_id()), "ordered-turns")


def _inserted(front: dict[int, Weight]) -> dict[int, Weight]:
    """Weights of grammar states, with any turns inserted; two in a row suffice, as three come back to a state."""
    for _ in range(2):
        for state, (cost, label) in list(front.items()):
            to, weight = GRAMMAR[state][made(state)], (cost + COSTS[INSERT], label + INSERT)
            if to not in front or weight < front[to]:
                front[to] = weight
    return front


def _arcs(state: int, initial: str, fault: int) -> Iterator[tuple[str, int, int]]:
    """What the edit transducer and the grammar make of one row: label, cost, next state."""
    yield DELETE, COSTS[DELETE], state
    if fault not in (BLANK, DUPLICATE):
        extra = int(fault == TRUNCATED)
        yield REROLE, COSTS[REROLE] + extra, GRAMMAR[state][made(state)]
        if initial in GRAMMAR[state]:
            yield KEEP, COSTS[KEEP] + extra, GRAMMAR[state][initial]


@lru_cache(maxsize=20_000)
def _block_weights(initials: tuple[str, ...], faults: tuple[int, ...]) -> list[tuple[int, int, int, str]]:
    """(from state, to state, cost, label) of a block's rows, with insertions before each of them."""
    out = []
    for start in GRAMMAR:
        front = {start: (0, "")}
        for initial, fault in zip(initials, faults, strict=True):
            after: dict[int, Weight] = {}
            for state, (cost, label) in _inserted(front).items():
                for edit, more, to in _arcs(state, initial, fault):
                    weight = (cost + more, label + edit)
                    if to not in after or weight < after[to]:
                        after[to] = weight
            front = after
        out += [(start, to, cost, label) for to, (cost, label) in front.items()]
    return out


def _ends() -> dict[int, Weight]:
    """Of each state, the least weight of turns to insert until the grammar accepts."""
    out = {}
    for state in GRAMMAR:
        reached = _inserted({state: (0, "")})
        out[state] = min(reached[f] for f in FINAL if f in reached)
    return out


def chained(blocks: list[list[tuple[int, int, int, str]]]) -> tuple[int, list[tuple[int, str]]]:
    """The least cost over a conversation's blocks, and each block's entry state and labels (the last one's with final insertions)."""
    ends = _ends()
    remaining = [{s: c for s, (c, _) in ends.items()}]
    for arcs in reversed(blocks):
        least: dict[int, int] = {}
        for state, to, cost, _ in arcs:
            least[state] = min(least.get(state, cost + remaining[-1][to]), cost + remaining[-1][to])
        remaining.append(least)
    remaining.reverse()
    state, chosen = 0, []
    for arcs, here, after in zip(blocks, remaining, remaining[1:], strict=False):
        label, to = min((label, to) for start, to, cost, label in arcs if start == state and cost + after[to] == here[state])
        chosen.append((state, label))
        state = to
    if chosen:
        chosen[-1] = (chosen[-1][0], chosen[-1][1] + ends[state][1])
    return remaining[0][0], chosen


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Values of runs of rows that agree in ``keys``, as far as they lie in one batch."""
    for batch in batches:
        cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        key = list(zip(*(cols[k] for k in keys), strict=True))
        at = 0
        while at < len(key):
            end = at + 1
            while end < len(key) and key[end] == key[at]:
                end += 1
            yield key[at], {n: v[at:end] for n, v in cols.items()}
            at = end


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Whole runs of rows that agree in ``keys``; rows arrive sorted by them."""
    last, held = None, None
    for key, cols in _runs(batches, keys):
        if held is not None and key == last:
            for n, v in cols.items():
                held[n] += v
            continue
        if held is not None:
            yield last, held
        last, held = key, cols
    if held is not None:
        yield last, held


BLOCK = T.StructType(
    [
        T.StructField("k_conv", T.StringType()), T.StructField("k_block", T.LongType()),
        *(T.StructField(n, T.LongType()) for n in ("blank", "duplicate", "truncated", "illegal")),
        T.StructField("k_first", T.StringType()), T.StructField("k_last", T.StringType()),
        T.StructField("k_from", T.ArrayType(T.IntegerType())), T.StructField("k_to", T.ArrayType(T.IntegerType())),
        T.StructField("k_cost", T.ArrayType(T.LongType())), T.StructField("k_label", T.ArrayType(T.StringType())),
    ]
)
CHOICE = T.StructType(
    [
        T.StructField("k_conv", T.StringType()), T.StructField("k_block", T.LongType()),
        *(T.StructField(n, T.LongType()) for n in ("blank", "duplicate", "truncated", "illegal", "cost")),
        T.StructField("k_state", T.IntegerType()), T.StructField("k_labels", T.StringType()), T.StructField("audit", T.StringType()),
    ]
)
LEGAL = {"su", "ua", "au"}  # initials of adjacent turns


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), to_arrow_schema(schema), strict=True)], names=schema.names)


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for (conv, block), got in _grouped(batches, ("k_conv", "k_block")):
        initials, faults = tuple(got["k_initial"]), tuple(got["k_fault"])
        weights = _block_weights(initials, faults)
        counts = [faults.count(x) for x in (BLANK, DUPLICATE, TRUNCATED)]
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
        rows.append((conv, block, *counts, illegal, initials[0], initials[-1], *map(list, zip(*weights, strict=True))))
        if len(rows) >= 500:
            yield _batch(rows, BLOCK)
            rows = []
    if rows:
        yield _batch(rows, BLOCK)


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for (conv,), got in _grouped(batches, ("k_conv",)):
        blocks = [list(zip(*x, strict=True)) for x in zip(got["k_from"], got["k_to"], got["k_cost"], got["k_label"], strict=True)]
        cost, chosen = chained(blocks)
        illegal = sum(got["illegal"]) + sum(a + b not in LEGAL for a, b in zip(got["k_last"], got["k_first"][1:], strict=False))
        totals = (sum(got["blank"]), sum(got["duplicate"]), sum(got["truncated"]), illegal, cost)
        for i, (block, (state, labels)) in enumerate(zip(got["k_block"], chosen, strict=True)):
            last = i + 1 == len(chosen)
            rows.append((conv, block, *(totals if last else (None,) * 5), state, labels, "".join(x for _, x in chosen) if last else None))
        if len(rows) >= 500:
            yield _batch(rows, CHOICE)
            rows = []
    if rows:
        yield _batch(rows, CHOICE)


def choices(rows: DataFrame) -> DataFrame:
    """Of each block of ``ordered`` rows its entry state and edit labels; the last one of a conversation has its counts, cost and audit. Written."""
    small = rows.select("k_conv", F.shiftright("k_row", BLOCK_BITS).alias("k_block"), "k_row", F.substring("role", 1, 1).alias("k_initial"), "k_fault")
    blocks = small.repartition("k_conv", "k_block").sortWithinPartitions("k_conv", "k_block", "k_row").mapInArrow(_weigh, BLOCK)
    return written(blocks.repartition("k_conv").sortWithinPartitions("k_conv", "k_block").mapInArrow(_choose, CHOICE), "edits")


def _turns(got: Iterator[tuple[tuple, dict[str, list]]]) -> Iterator[tuple[str, str, str]]:
    """(conversation, role, text) of all repaired turns, as rows arrive: a block's labels, then its rows."""
    state, labels, at = 0, "", 0

    def inserted(conv: str) -> Iterator[tuple[str, str, str]]:
        nonlocal state, at
        while at < len(labels) and labels[at] == INSERT:
            initial = made(state)
            state, at = GRAMMAR[state][initial], at + 1
            yield conv, NAMES[initial], ""

    for (conv,), cols in got:
        for row, first, given, role, text in zip(cols["k_row"], cols["k_state"], cols["k_labels"], cols["role"], cols["text"], strict=True):
            if row < 0:
                state, labels, at = first, given, 0
            else:
                edit, at = labels[at], at + 1
                if edit != DELETE:
                    initial = role[:1] if edit == KEEP else made(state)
                    state = GRAMMAR[state][initial]
                    yield conv, role if edit == KEEP else NAMES[initial], text
            yield from inserted(conv)


def _stream(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of each conversation in order, in one task, every block's labels before it."""
    block = F.shiftright("k_row", BLOCK_BITS).alias("k_block")
    heads = chosen.select("k_conv", "k_block", F.lit(-1).cast("long").alias("k_row"), "k_state", "k_labels", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    both = rows.select("k_conv", block, "k_row", F.lit(None).cast("int").alias("k_state"), F.lit(None).cast("string").alias("k_labels"), "role", "text").unionByName(heads)
    return both.repartition("k_conv").sortWithinPartitions("k_conv", "k_block", "k_row")


def repaired_turns(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The repaired conversations: k_conv, position (from 0), role, text."""
    schema = T.StructType([T.StructField("k_conv", T.StringType()), T.StructField("position", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, out, size = None, 0, [], 0
        for conv, role, text in _turns(_runs(batches, ("k_conv",))):
            at = at + 1 if conv == last else 0
            last = conv
            out.append((conv, at, role, text))
            size += len(text)
            if len(out) >= 1000 or size > 4_000_000:
                yield _batch(out, schema)
                out, size = [], 0
        if out:
            yield _batch(out, schema)

    return _stream(rows, chosen).mapInArrow(run, schema)


def repaired_digests(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """k_conv, repaired_sha256 of the conversations with a repaired turn: ``role:text``, joined by line feeds, hashed as they stream."""
    schema = T.StructType([T.StructField("k_conv", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, out = None, None, []
        for conv, role, text in _turns(_runs(batches, ("k_conv",))):
            if conv != last:
                if state:
                    out.append((last, state.hexdigest()))
                last, state = conv, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
            if len(out) >= 1000:
                yield _batch(out, schema)
                out = []
        if state:
            out.append((last, state.hexdigest()))
        if out:
            yield _batch(out, schema)

    return _stream(rows, chosen).mapInArrow(run, schema)


def repair(conversations: DataFrame) -> DataFrame:
    """Audit of every conversation of ``conversations`` (conv_id, turn, role, text) after damage.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Where no row is left:
    zeros, an empty audit and the hash of nothing. Gaps beyond 64 bits are null.
    """
    rows = ordered(damaged(conversations.select("conv_id", "turn", "role", "text")))
    chosen = choices(rows)
    turns = rows.groupBy("k_conv", "turn").agg(F.lit(1).alias("one")).groupBy("k_conv").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count("turn").alias("n"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    gaps = turns.select("k_conv", F.when(F.col("n") == 0, F.lit(0).cast("long")).otherwise((wide("high") - wide("low") + 1 - wide("n")).try_cast("long")).alias("gaps"))
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    found = chosen.where("audit is not null").select("k_conv", *counts, "audit").join(gaps, "k_conv").join(repaired_digests(rows, chosen), "k_conv", "left")
    ids = conversations.select("conv_id").distinct().withColumn("k_conv", _conversation(F.col("conv_id"))).join(found.withColumn("k_found", F.lit(True)), "k_conv", "left")
    zero = lambda c: F.when(F.col("k_found"), F.col(c)).otherwise(F.lit(0).cast("long")).alias(c)
    return ids.select("conv_id", *(zero(c) for c in ("gaps", *counts)), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_HASH)).alias("repaired_sha256"))
