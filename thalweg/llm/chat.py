"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, user first, assistant
last.  Each turn of a conversation may keep its role, merge into the turn before it, take another role, and empty turns may be
put in; a dynamic programme over the states of the legal-turn automaton finds the cheapest repair, which is then rendered.

The programme is a product of min-plus matrices, one per turn, so a conversation of any length is cut into segments of turns:
each segment's matrix is computed on its own, the chain of matrices of a conversation fixes the states at the cuts, and each
segment then finds its own part of the repair.  Segments are runs of turns in sorted range partitions, whatever the numbers
of the turns, so a conversation with very many turns is dealt to many tasks; what one task holds of a conversation is a
segment of bounded size, or its matrices, one for ``SEGMENT`` turns.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.storage import materialize

#: A segment ends with its conversation, or after so many turns, or so many characters.
SEGMENT, SEGMENT_CHARS = 4096, 8 << 20
ROLES = ("system", "user", "assistant")
# Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
MERGE, INSERT, RELABEL, NAME = 1, 2, 3, 1  # NAME: giving a role to a turn of an unknown role
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
FAR = 1 << 40
_AFTER = {"system": AFTER_SYSTEM, "user": AFTER_USER, "assistant": AFTER_ASSISTANT}
#: Empty turns to put in before a turn of a role, by state; roles absent can't follow.
_GAP = {
    START: {"system": (), "user": (), "assistant": ("user",)},
    AFTER_SYSTEM: {"user": (), "assistant": ("user",)},
    AFTER_USER: {"assistant": (), "user": ("assistant",)},
    AFTER_ASSISTANT: {"user": (), "assistant": ("user",)},
}
_LAST = {START: "", AFTER_SYSTEM: "system", AFTER_USER: "user", AFTER_ASSISTANT: "assistant"}
#: What must follow the last turn.
_END = {START: (), AFTER_SYSTEM: ("user", "assistant"), AFTER_USER: ("assistant",), AFTER_ASSISTANT: ()}


def role_code(role: str | None) -> str:
    name = (role or "").strip(" \t\n\x0b\f\r").lower()
    name = ALIASES.get(name, name)
    return name[0] if name in ROLES else "?"


_NAMES = {"s": "system", "u": "user", "a": "assistant"}


@lru_cache(maxsize=64)
def moves(code: str) -> tuple[tuple[int, int, int, str, str, tuple[str, ...]], ...]:
    """All ways to pass a turn: (from, to, cost, action, role, empty turns before), in the order that settles ties."""
    own = _NAMES.get(code)
    out = []
    for state, gaps in _GAP.items():
        for role in ROLES:
            change = 0 if role == own else NAME if own is None else RELABEL
            if role in gaps:
                gap = gaps[role]
                action = "keep" if not change else "relabel"
                out.append((state, _AFTER[role], change + INSERT * len(gap), action, role, gap))
            if _LAST[state] == role:
                out.append((state, state, change + MERGE, "merge", role, ()))
    rank = {"keep": 0, "merge": 1, "relabel": 2}
    return tuple(sorted(out, key=lambda m: (m[2], len(m[5]), rank[m[3]], m[1], m[0])))


def advance(costs: list[int], code: str) -> tuple[list[int], list[int]]:
    """Costs after a turn, and for each state the move taken."""
    after, taken = [FAR] * 4, [-1] * 4
    for k, (a, b, cost, *_) in enumerate(moves(code)):
        if costs[a] + cost < after[b]:
            after[b], taken[b] = costs[a] + cost, k
    return after, taken


#: Segments up to so many turns are remembered.
_SHORT = 48


def matrix(codes: str) -> tuple[int, ...]:
    """Least costs of passing a segment from each state (row) to each state."""
    return _short_matrix(codes) if len(codes) <= _SHORT else _matrix(codes)


def _matrix(codes):
    out = []
    for start in range(4):
        costs = [0 if s == start else FAR for s in range(4)]
        for c in codes:
            costs, _ = advance(costs, c)
        out += costs
    return tuple(out)


def end_cost(state: int) -> int:
    return INSERT * len(_END[state])


def chain(matrices: list[tuple[int, ...]]) -> tuple[list[int], int]:
    """States at the cuts of a conversation's segments, first and last included, and the least cost."""
    costs, back = [0, FAR, FAR, FAR], []
    for m in matrices:
        new = [min((costs[a] + m[4 * a + b], a) for a in range(4)) for b in range(4)]
        back.append([a for _, a in new])
        costs = [c for c, _ in new]
    total, state = min((c + end_cost(s), s) for s, c in enumerate(costs))
    states = [state]
    for b in reversed(back):
        states.append(b[states[-1]])
    return states[::-1], total


def path(codes: str, first: int, last: int) -> tuple[int, ...]:
    """Moves of the cheapest way through a segment between two states."""
    return _short_path(codes, first, last) if len(codes) <= _SHORT else _path(codes, first, last)


def _path(codes, first, last):
    costs, trail = [0 if s == first else FAR for s in range(4)], []
    for c in codes:
        costs, taken = advance(costs, c)
        trail.append(taken)
    out, state = [], last
    for c, taken in zip(reversed(codes), reversed(trail)):
        out.append(taken[state])
        state = moves(c)[taken[state]][0]
    return tuple(reversed(out))


_short_matrix, _short_path = lru_cache(maxsize=50_000)(_matrix), lru_cache(maxsize=50_000)(_path)


def opened(role: str, text: str = "") -> str:
    return f"<|im_start|>{role}\n{text}"


CLOSED = "<|im_end|>\n"


def _rows(rows, *kinds, names):
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], list(names))


def _plain_rows(batches):
    return (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))


_CUT = {"seg": pa.int64(), "idx": pa.int32(), "conv_id": pa.int64(), "turn": pa.int64(), "role_in": pa.string(), "code": pa.string(), "text": pa.string(), "m": pa.list_(pa.int64())}


def _cutter(segment: int):
    """Sorted turns to turns with their segment and place in it, and a row with its matrix for each segment."""

    def cut(batches):
        base, k, before, codes, chars = TaskContext.get().partitionId() << 40, 0, None, [], 0
        for b in batches:
            seg, idx, done = [], [], []
            convs, marks, sizes = (b.column(c).to_pylist() for c in (0, 3, 5))
            for conv, code, size in zip(convs, marks, sizes):
                if codes and (conv != before or len(codes) >= segment or chars >= SEGMENT_CHARS):
                    done.append((base + k, -1, before, len(codes), None, None, None, list(matrix("".join(codes)))))
                    k, codes, chars = k + 1, [], 0
                before = conv
                seg.append(base + k)
                idx.append(len(codes))
                codes.append(code)
                chars += size
            none = pa.nulls(b.num_rows, _CUT["m"])
            yield pa.RecordBatch.from_arrays([pa.array(seg, _CUT["seg"]), pa.array(idx, _CUT["idx"]), *[b.column(c) for c in (0, 1, 2, 3, 4)], none], list(_CUT))
            if done:
                yield _rows(done, *_CUT.values(), names=_CUT)
        if codes:
            yield _rows([(base + k, -1, before, len(codes), None, None, None, list(matrix("".join(codes))))], *_CUT.values(), names=_CUT)

    return cut


def _chains(batches):
    held: list[tuple] = []
    names = ("seg", "enter", "leave", "final", "cost", "first")
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64())
    for _, parts in groupby(_plain_rows(batches), key=lambda r: r[0]):
        segs, matrices, sizes = [], [], []
        for _, seg, m, n in parts:
            segs.append(seg)
            matrices.append(tuple(m))
            sizes.append(n)
        states, cost = chain(matrices)
        first = 0
        for k, seg in enumerate(segs):
            held.append((seg, states[k], states[k + 1], k == len(segs) - 1, cost, first))
            first += sizes[k]
            if len(held) >= 4096:
                yield _rows(held, *kinds, names=names)
                held = []
    yield _rows(held, *kinds, names=names)


def _repaired(batches):
    names = ("conv_id", "turn", "role_in", "role", "action", "n_inserted", "piece", "cost", "position")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64())
    held, size = [], 0
    for _, rows in groupby(_plain_rows(batches), key=lambda r: r[0]):
        enter, leave, final, cost, first = next(rows)[7:12]  # the segment's own row comes first
        rows = list(rows)
        state = enter
        for k, (r, move) in enumerate(zip(rows, path("".join(r[5] for r in rows), enter, leave))):
            _, _, conv, turn, role_in, code, text = r[:7]
            _, to, _, action, role, gap = moves(code)[move]
            text = text or ""
            if action == "merge":
                piece = "\n" + text
            else:
                piece = (CLOSED if state != START else "") + "".join(opened(g) + CLOSED for g in gap) + opened(role, text)
            n = len(gap)
            if final and k == len(rows) - 1:
                tail = _END[to]
                piece += CLOSED + "".join(opened(g) + CLOSED for g in tail)
                n += len(tail)
            held.append((conv, turn, role_in, role, action, n, piece, cost, first + k))
            size += len(piece)
            state = to
        if size > 4 << 20:
            yield _rows(held, *kinds, names=names)
            held, size = [], 0
    yield _rows(held, *kinds, names=names)


def repair(df: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", segment: int = SEGMENT) -> DataFrame:
    """One row per turn: ``conv_id, turn, role_in, role, action, n_inserted, piece, cost, position``.

    ``role`` and ``action`` (keep, relabel, merge) tell how the turn is repaired, ``n_inserted`` how many empty turns stand before it
    (after it too, for the last), ``cost`` is that of the whole conversation.  The pieces of a conversation in the order of
    ``position``, from 0, are its rendering.  conv_id must be an integer; a turn that is no whole number counts as null.

    Turns are ordered by turn (null first, then negative ones), then role (null first), then the md5 of the text (null as empty);
    rows equal in all of these are turns like others and may swap.  Null texts are empty; roles count without white space around
    them and in any case; null and unknown roles get a role at the cost ``NAME``.  Rows with a null conv_id form one conversation.
    Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    code = F.lower(F.regexp_replace(F.coalesce(F.col(role_col).cast("string"), F.lit("")), "^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$", ""))
    names = F.create_map(*[F.lit(x) for k, v in {**{r: r for r in ROLES}, **ALIASES}.items() for x in (k, v[0])])
    turns = df.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).try_cast("long").alias("turn"), F.col(role_col).cast("string").alias("role_in"),
        F.coalesce(names[code], F.lit("?")).alias("code"), text.alias("text"), F.length(F.coalesce(text, F.lit(""))).alias("size"),
        F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("digest"), F.monotonically_increasing_id().alias("tie"),
    )
    order = ["conv_id", "turn", "role_in", "digest", "tie"]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role_in", "code", "text", "size")
    cut = materialize(ranged.mapInArrow(_cutter(segment), "seg long, idx int, conv_id long, turn long, role_in string, code string, text string, m array<long>"), "chat-segments")
    own = cut.where("m is not null").select("conv_id", "seg", "m", F.col("turn").alias("n")).repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    states = own.mapInArrow(_chains, "seg long, enter int, leave int, final boolean, cost long, first long")
    whole = cut.where("m is null").drop("m").unionByName(states.withColumn("idx", F.lit(-1)), allowMissingColumns=True)
    return whole.repartition("seg").sortWithinPartitions("seg", "idx").mapInArrow(_repaired, "conv_id long, turn long, role_in string, role string, action string, n_inserted int, piece string, cost long, position long")
