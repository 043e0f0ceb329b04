"""Minimum-cost role repair of chats, and their rendering.

A legal chat is an optional system turn, then user and assistant turns in alternation, ending with the
assistant. Repair walks the turns through this automaton and for each may keep it, relabel it or merge it
into the turn before, after inserting empty turns; dynamic programming finds the cheapest way.

Of ways of equal cost the first counts: that which takes the earlier move, in the order of moves(), at the first
turn where they differ. It is found by going forward from the start along moves that keep the cost of the rest
lowest, so it does not depend on where a chat is cut.

The cheapest cost from each state to each state over a run of turns is a small matrix, and runs compose by
the (min, +) product. So turns are sorted over the whole cluster and cut into blocks of bounded size. A block that
holds a whole chat, as nearly all do, is repaired by itself. Of the others each gives its matrix; from a chat's end
backwards these give the cost of the rest behind each block, with which each block tells where it leads from each
state, and so where the next one begins. No task holds a whole long chat.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechloom.llm.common import staged

ROLES = ("system", "user", "assistant")
#: States: before the first turn, or behind a turn of a role.
START, STATES = 3, 4
#: Roles that may follow each state.
LEGAL = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
#: Costs: keep is free; a turn without a known role has no label to change, so giving it one is cheaper.
RELABEL, LABEL, MERGE, INSERT = 20, 10, 5, 30
#: Turns and bytes of text of a block.
BLOCK_TURNS, BLOCK_TEXT = 512, 1 << 20
FAR = 1 << 50
TEMPLATE = ("<|im_start|>{}\n", "{}", "<|im_end|>\n")


def routes() -> dict[int, dict[int, tuple[int, tuple[int, ...]]]]:
    """Cheapest empty turns to insert so that a role may follow a state: state -> role -> (cost, inserted roles)."""
    out: dict[int, dict[int, tuple[int, tuple[int, ...]]]] = {}
    for state in range(STATES):
        best: dict[int, tuple[int, tuple[int, ...]]] = {}
        level = [(state, ())]
        for _ in range(STATES):
            step = []
            for at, path in level:
                for role in LEGAL[at]:
                    if role not in best:
                        best[role] = (INSERT * len(path), path)
                    step.append((role, (*path, role)))
            level = step
        out[state] = best
    return out


ROUTES = routes()


def moves(state: int, role: int | None) -> list[tuple[int, int, str, tuple[int, ...]]]:
    """(cost, next state, action, inserted roles) for a turn that is labelled role (None: unknown)."""
    out = []
    for new, (cost, path) in sorted(ROUTES[state].items()):
        label = 0 if new == role else LABEL if role is None else RELABEL
        out.append((cost + label, new, "keep" if new == role else "relabel", path))
    if state != START:
        label = 0 if state == role else LABEL if role is None else RELABEL
        out.append((MERGE + label, state, "merge", ()))
    return out


MOVES = {(s, r): moves(s, r) for s in range(STATES) for r in (None, 0, 1, 2)}
#: Cost and inserted roles that end a chat from each state; a chat without turns is left empty.
ENDING = {s: (0, ()) if s in (2, START) else (ROUTES[s][2][0] + INSERT, (*ROUTES[s][2][1], 2)) for s in range(STATES)}
ENDING_COSTS = [ENDING[s][0] for s in range(STATES)]


def cost_matrix(roles: list[int | None]) -> list[int]:
    """Cheapest cost from each state to each state over these turns, row by row."""
    rows = []
    for begin in range(STATES):
        cost = [FAR] * STATES
        cost[begin] = 0
        for role in roles:
            following = [FAR] * STATES
            for state in range(STATES):
                if cost[state] < FAR:
                    for c, new, _, _ in MOVES[state, role]:
                        following[new] = min(following[new], cost[state] + c)
            cost = following
        rows += cost
    return rows


def costs_to_go(roles: list[int | None], end_costs: list[int]) -> list[list[int]]:
    """Cheapest cost from each state before each turn to the chat's end; end_costs price the states behind the last."""
    after = [end_costs]
    for role in reversed(roles):
        after.append([min(c + after[-1][new] for c, new, _, _ in MOVES[state, role]) for state in range(STATES)])
    return after[::-1]


def repair(roles: list[int | None], begin: int, end_costs: list[int]) -> list[tuple[int, str, tuple[int, ...]]]:
    """(role, action, inserted roles) per turn on the first of the cheapest ways from begin."""
    after = costs_to_go(roles, end_costs)
    state, out = begin, []
    for k, role in enumerate(roles):
        _, state, action, path = min(MOVES[state, role], key=lambda m: m[0] + after[k + 1][m[1]])  # noqa: B023  (the first of equals)
        out.append((state, action, path))
    return out


def role_number(role: str | None) -> int | None:
    name = (role or "").strip().lower()
    return ROLES.index(name) if name in ROLES else None


def turn_blocks(turns: DataFrame) -> DataFrame:
    """Blocks of consecutive turns (conv_id, turn, role, text) in chat order: (conv_id, block, whole, turns array).

    whole: the block surely holds all turns of its chat, as other chats come before and after it in its partition.
    """
    ordered = turns.dropDuplicates().repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    item = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 40
        conv, held, size = None, [], 0
        begun_here = False  # whether the chat's first turn is the first of this block

        def out(ended: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([conv], type=pa.int64()), pa.array([block], type=pa.int64()), pa.array([begun_here and ended]), pa.array([held], type=pa.list_(item))], names=["conv_id", "block", "whole", "turns"])

        for batch in batches:
            for conv_id, turn, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (conv_id != conv or len(held) >= BLOCK_TURNS or size >= BLOCK_TEXT):
                    yield out(conv_id != conv)
                    block, held, size, begun_here = block + 1, [], 0, conv_id != conv
                conv = conv_id
                held.append({"turn": turn, "role": role, "text": text})
                size += len(text or "")
        if held:
            yield out(False)

    return ordered.mapInArrow(run, "conv_id long, block long, whole boolean, turns array<struct<turn: long, role: string, text: string>>")


def repair_chats(turns: DataFrame, template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """One row per turn: conv_id, position, turn, role, action, new_role, inserted, cost, rendered.

    action is keep, relabel or merge; inserted lists the empty turns put in before it, and after a chat's last
    turn those that end it. cost is the whole chat's. The chat's text is its rendered parts in the order of
    position: each opens its turn (and closes the one before) unless it is merged into that, after a newline.
    Of repairs of equal cost the first counts (see above). Turns are ordered by turn, role and text, nulls first; a repeated row is one turn. Unknown and null roles
    are turns without a label, null texts are empty. A null conv_id is a chat like any other; an empty table
    gives an empty result; other columns are not read.
    """
    columns = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"]
    blocks = staged(turn_blocks(turns.select(*columns)), "roles-blocks")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(2).to_pylist()
            costs = [cost_matrix([role_number(r) for r in roles]) for roles in listed]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(costs, type=pa.list_(pa.int64())), pa.array([len(x) for x in listed], type=pa.int64())], names=["conv_id", "block", "costs", "n"])

    parts = blocks.where("not whole")
    summary = parts.select("conv_id", "block", F.col("turns.role").alias("roles")).mapInArrow(summarise, "conv_id long, block long, costs array<long>, n long")

    def backwards(table: pa.Table) -> pa.Table:
        """Costs of leaving, first position and chat cost of each block of one chat."""
        rows = sorted(zip(*[table.column(c).to_pylist() for c in ("block", "costs", "n")], strict=True))
        after = [ENDING_COSTS]  # cheapest cost from each state to the chat's end
        for _, m, _ in reversed(rows):
            after.append([min(m[STATES * s + t] + after[-1][t] for t in range(STATES)) for s in range(STATES)])
        after.reverse()
        ahead = [sum(n for _, _, n in rows[:k]) for k in range(len(rows))]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.bool_()]
        out = [[b for b, _, _ in rows], after[1:], ahead, [after[0][START]] * len(rows), [False] * (len(rows) - 1) + [True]]
        return pa.table([pa.array(c, type=t) for c, t in zip(out, kinds, strict=True)], names=["block", "leaving", "position", "cost", "last"])

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state behind each block for each state in front of it."""
        for batch in batches:
            ends = [[repair([role_number(r) for r in roles], s, leaving)[-1][0] for s in range(STATES)] for roles, leaving in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ends, type=pa.list_(pa.int64()))], names=["conv_id", "block", "ends"])

    def forwards(table: pa.Table) -> pa.Table:
        """The state in which each block of one chat begins."""
        state, begins = START, []
        rows = sorted(zip(table.column("block").to_pylist(), table.column("ends").to_pylist(), strict=True))
        for _, ends in rows:
            begins.append(state)
            state = ends[state]
        return pa.table({"block": pa.array([b for b, _ in rows], type=pa.int64()), "begin": pa.array(begins, type=pa.int64())})

    # a chat has a row of 16 numbers per block of turns here, and only chats of several blocks or at the edge of a partition
    passed = staged(summary.groupBy("conv_id").applyInArrow(backwards, "block long, leaving array<long>, position long, cost long, last boolean"), "roles-leaving")
    ends = parts.join(passed, "block").select("conv_id", "block", F.col("turns.role").alias("roles"), "leaving").mapInArrow(leads, "conv_id long, block long, ends array<long>")
    begins = ends.groupBy("conv_id").applyInArrow(forwards, "block long, begin long")
    opening, content, closing = template

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, turns_, begin, leaving, position, cost, last in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                labels = [role_number(t["role"]) for t in turns_]
                if begin is None:  # a whole chat
                    begin, leaving, position, last = START, ENDING_COSTS, 0, True
                    cost = costs_to_go(labels, leaving)[0][START]
                state = begin
                way = repair(labels, begin, leaving)
                for k, (t, (new, action, path)) in enumerate(zip(turns_, way, strict=True)):
                    text = t["text"] or ""
                    if action == "merge":
                        part = "\n" + content.format(text)
                    else:
                        part = closing if state != START else ""
                        part += "".join(opening.format(ROLES[r]) + closing for r in path) + opening.format(ROLES[new]) + content.format(text)
                    inserted = list(path)
                    if last and k + 1 == len(turns_):
                        end = ENDING[new][1]
                        inserted += end
                        part += closing + "".join(opening.format(ROLES[r]) + closing for r in end)
                    rows.append((conv, position + k, t["turn"], t["role"], action, ROLES[new], ",".join(ROLES[r] for r in inserted), cost, part))
                    state = new
            kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)], names=["conv_id", "position", "turn", "role", "action", "new_role", "inserted", "cost", "rendered"])

    columns = ["conv_id", "turns", "begin", "leaving", "position", "cost", "last"]
    cut = parts.join(passed, "block").join(begins, "block").select(*columns)
    none = [F.lit(None).cast(cut.schema[c].dataType).alias(c) for c in columns[2:]]
    return blocks.where("whole").select("conv_id", "turns", *none).unionByName(cut).mapInArrow(render, "conv_id long, position long, turn long, role string, action string, new_role string, inserted string, cost long, rendered string")


def whole_chats(repaired: DataFrame) -> DataFrame:
    """(conv_id, rendered): whole texts, for chats that fit into a row."""
    listed = repaired.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", "rendered"))).alias("parts"))
    return listed.select("conv_id", F.array_join("parts.rendered", "").alias("rendered"))
