"""Chat formatting: roles recovered from raw transcripts by a hidden Markov model.

A state is a role and whether the line begins a turn. Emissions weigh speaker markers
(``User:``, ``### Assistant``, ``[system]``, ``Q:`` ...) and other features of the line;
the Viterbi path gives each line its role, from which turns are rendered in one form.

A conversation may be of any length: it is cut into blocks of ``span`` source rows.
Scores over a block are a max-plus matrix from the state before it to its last state;
matrices of blocks are multiplied up a tree of bounded groups, the best states at the
cuts come down again, and every block then finds its own path. The result is that of one
pass over the whole conversation, but no task holds more than one block of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialize, runs

ROLES = ("system", "user", "assistant")
#: (role, begins a turn), and last the state before the first line.
STATES = (*((r, b) for r in ROLES for b in (True, False)), (None, False))
BEFORE = len(STATES) - 1
SPAN, FAN = 64, 64
_S = len(STATES)
_NAMES = {
    "system": "system", "instructions": "system", "context": "system",
    "user": "user", "human": "user", "customer": "user", "question": "user", "q": "user", "prompter": "user", "me": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "answer": "assistant", "a": "assistant", "gpt": "assistant", "agent": "assistant", "model": "assistant",
}
_marker = re.compile(
    r"\s*(?:#{1,6}\s*|\*\*|>\s*)?(?:(<\|)([a-z]+)\|>|\[([a-z]+)\]\s*:?|([a-z]+)\s*(?:\*\*)?\s*:(?:\*\*)?|(?<=#\s)([a-z]+)\s*$)[ \t]*", re.I
)
_assistant_start = re.compile(r"\s*(?:sure|certainly|of course|here (?:is|are)|i'm sorry|as an ai)\b", re.I)
_system_start = re.compile(r"\s*(?:you are (?:a|an|the)\b|respond (?:in|only|with)|always answer)", re.I)
_list_line = re.compile(r"\s*(?:[-*]\s|\d+[.)]\s|```)")
#: Log probabilities of the next state: a turn goes on, or the next role begins one.
_GO_ON = np.log(0.8)
_NEXT = np.log(0.2) + np.log(np.array([[0.05, 0.90, 0.05], [0.02, 0.08, 0.90], [0.02, 0.90, 0.08]]))
_NEVER = -1e9


_FIRST = {"system": np.log(0.25), "user": np.log(0.65), "assistant": np.log(0.1)}


def _transitions() -> np.ndarray:
    t = np.full((_S, _S), _NEVER)
    for i, (a, _) in enumerate(STATES):
        for j, (b, begins) in enumerate(STATES[:BEFORE]):
            if begins:
                t[i, j] = _NEXT[ROLES.index(a), ROLES.index(b)] if a else _FIRST[b]
            elif a == b:
                t[i, j] = _GO_ON
    return t


TRANSITIONS = _transitions()


def split_marker(line: str) -> tuple[str | None, str]:
    """The role that a speaker marker at the start of the line names, and the rest of it."""
    m = _marker.match(line)
    if m and (role := _NAMES.get(next(g for g in m.groups()[1:] if g).lower())):
        return role, line[m.end() :]
    return None, line


@lru_cache(maxsize=None)  # at most a few hundred combinations of features
def _weights(role: str | None, first: bool, asks: bool, answers: bool, lists: bool, long: bool, instructs: bool) -> np.ndarray:
    out = np.zeros(_S)
    for k, (r, begins) in enumerate(STATES[:BEFORE]):
        if role:
            out[k] += np.log(0.9 if begins and r == role else 0.02 if not begins else 0.005)
        elif begins:
            out[k] += np.log(0.15)
        out[k] += np.log((0.9 if first else 0.1) if begins else (0.02 if first else 0.98))
        out[k] += {"user": 1.0 * asks, "assistant": 1.5 * answers + 0.5 * lists + 0.3 * long, "system": 2.0 * instructs}[r]
    out.flags.writeable = False
    return out


def emissions(line: str, first: bool) -> np.ndarray:
    """Log weight of the line in each state; ``first``: it is the first of its source row."""
    role, rest = split_marker(line)
    return _weights(
        role, first, rest.rstrip().endswith("?"), _assistant_start.match(rest) is not None, _list_line.match(rest) is not None, len(rest) > 400, _system_start.match(rest) is not None
    )


def block_matrix(e: list[np.ndarray]) -> np.ndarray:
    """Best score from each state before the lines to each state of the last one."""
    m = TRANSITIONS + e[0]
    for x in e[1:]:
        m = (m[:, :, None] + TRANSITIONS[None]).max(axis=1) + x
    return m


def best_path(e: list[np.ndarray], before: int, last: int) -> list[int]:
    """The best states of the lines, from state ``before`` to ``last``."""
    score = TRANSITIONS[before] + e[0]
    back = []
    for x in e[1:]:
        step = score[:, None] + TRANSITIONS
        back.append(step.argmax(axis=0))
        score = step.max(axis=0) + x
    path = [last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _pieces(rows: list[tuple], at: int) -> list[tuple[str, bool]]:
    """The lines of source rows, whose text is in column ``at``, and whether each is the
    first of its row."""
    return [(line, k == 0) for r in rows for k, line in enumerate((r[at] or "").split("\n"))]


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], names=list(kinds))


_NODE = {"conv_id": pa.int64(), "block": pa.int64(), "m": pa.list_(pa.float64())}
_END = {"conv_id": pa.int64(), "block": pa.int64(), "before": pa.int32(), "last": pa.int32()}
_CHAT = {"conv_id": pa.int64(), "block": pa.int64(), "n_turns": pa.int64(), "n_lines": pa.int64(), "roles": pa.string(), "chat": pa.string()}


def _dealt(df: DataFrame, group: str, order: str, *rest: str) -> DataFrame:
    """All rows of a conversation's ``group`` in one task, sorted."""
    return df.select("conv_id", group, order, *rest).repartition("conv_id", group).sortWithinPartitions("conv_id", group, order, *rest)


def _ends(nodes: DataFrame, fan: int) -> DataFrame:
    """``nodes(conv_id, block, m)`` to ``(conv_id, block, before, last)``: the state before
    each block and the last one in it on the best path of the whole conversation."""
    up = nodes.withColumn("up", F.floor(F.col("block") / fan).cast("long"))
    if nodes.agg(F.max("block")).first()[0]:

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (conv, group), rows in runs(batches, 2):
                m = np.array(rows[0][3]).reshape(_S, _S)
                for r in rows[1:]:
                    m = (m[:, :, None] + np.array(r[3]).reshape(_S, _S)[None]).max(axis=1)
                yield _batch([(conv, group, m.ravel().tolist())], _NODE)

        parents = materialize(_dealt(up, "up", "block", "m").mapInArrow(multiply, "conv_id long, block long, m array<double>"), "blocks")
        ends = _ends(parents, fan).withColumnRenamed("block", "up")
        both = up.alias("u").join(ends.alias("e"), F.expr("u.conv_id <=> e.conv_id AND u.up = e.up")).select("u.conv_id", "u.up", "block", "m", "before", "last")
    else:
        both = up.withColumn("before", F.lit(BEFORE)).withColumn("last", F.lit(-1))

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, _), rows in runs(batches, 2):
            before, last, out, back = rows[0][4], rows[0][5], [], []
            score = np.array(rows[0][3]).reshape(_S, _S)[before]
            for r in rows[1:]:
                step = score[:, None] + np.array(r[3]).reshape(_S, _S)
                back.append(step.argmax(axis=0))
                score = step.max(axis=0)
            state = int(score.argmax()) if last < 0 else last
            for k in range(len(rows) - 1, -1, -1):
                prev = int(back[k - 1][state]) if k else before
                out.append((conv, rows[k][2], prev, state))
                state = prev
            yield _batch(out, _END)

    return _dealt(both, "up", "block", "m", "before", "last").mapInArrow(descend, "conv_id long, block long, before int, last int")


def _cut_crowded(rows: DataFrame, span: int) -> DataFrame:
    """``rows(conv_id, turn, text, block)`` with blocks of more than ``2 * span`` rows cut
    into blocks of at most ``span``, and room in the numbers for these.

    Rows of crowded blocks are sorted over all tasks, so that one block of very many rows
    is cut where it stands; what is counted is one number for each block."""
    counts = materialize(rows.groupBy("conv_id", "block").count(), "block_sizes")
    crowded = counts.where(F.col("count") > 2 * span).select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"))
    if crowded.isEmpty():
        return rows
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))
    calm = rows.join(crowded, same, "left_anti").withColumn("piece", F.lit(0).cast("long"))
    full = rows.join(crowded, same, "left_semi").withColumn("n", F.monotonically_increasing_id())
    full = full.repartitionByRange("conv_id", "block", "turn", "text", "n").sortWithinPartitions("conv_id", "block", "turn", "text", "n")
    place = F.monotonically_increasing_id()  # the task, and the row within it
    full = full.select("conv_id", "turn", "text", "block", F.shiftright(place, 33).alias("task"), place.bitwiseAND((1 << 33) - 1).alias("nth"))
    full = materialize(full, "crowded")
    tasks = full.groupBy("conv_id", "block", "task").agg(F.min("nth").alias("low"), F.ceil(F.count("*") / span).alias("pieces"))
    tasks = tasks.withColumn("before", F.sum("pieces").over(Window.partitionBy("conv_id", "block").orderBy("task")) - F.col("pieces"))
    tasks = materialize(tasks, "pieces")
    most = tasks.agg(F.max(F.col("before") + F.col("pieces"))).first()[0]
    near = F.col("f.conv_id").eqNullSafe(F.col("t.conv_id")) & (F.col("f.block") == F.col("t.block")) & (F.col("f.task") == F.col("t.task"))
    piece = F.col("before") + F.floor((F.col("nth") - F.col("low")) / span)
    full = full.alias("f").join(tasks.alias("t"), near).select("f.conv_id", "turn", "text", "f.block", piece.cast("long").alias("piece"))
    out = calm.unionByName(full)
    return out.select("conv_id", "turn", "text", (F.col("block") * most + F.col("piece")).alias("block"))


def format_chats(
    transcripts: DataFrame, span: int = SPAN, fan: int = FAN, id_col: str = "conv_id", order_col: str = "turn", text_col: str = "text"
) -> DataFrame:
    """``conv_id, block long, n_turns long, n_lines long, roles string, chat string``.

    ``transcripts`` has raw text with or without speaker markers, in any number of rows per
    conversation, ordered by ``order_col`` and then by text; a row may hold many lines. A
    block holds the rows of ``span`` consecutive order values; ``n_turns`` and ``roles``
    (joined by commas) are those of the turns that begin in it. ``chat`` is the canonical
    form: ``<|role|>`` and a newline where a turn begins, then its lines without markers,
    each with a newline; the blocks of a conversation, joined in order, are its chat.
    Null and empty texts are one empty line; a null order comes first, in the first
    block; rows of a null id are one conversation; repeated rows are repeated lines. Where
    repeated or null order values give a block over ``2 * span`` rows, it is cut into
    blocks of at most ``span`` consecutive rows (by order and text), so no block grows
    with the data; numbers of blocks ascend but need not follow one another. No rows give
    no rows; other columns are ignored.
    """
    rows = transcripts.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(order_col).cast("long").alias("turn"), F.col(text_col).cast("string").alias("text")
    )
    lowest = rows.agg(F.min("turn")).first()[0] or 0
    rows = rows.withColumn("block", F.coalesce(F.floor((F.col("turn") - lowest) / span).cast("long"), F.lit(0).cast("long")))
    rows = _cut_crowded(rows, span)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, block), own in runs(batches, 2):
            yield _batch([(conv, block, block_matrix([emissions(*x) for x in _pieces(own, 3)]).ravel().tolist())], _NODE)

    nodes = materialize(_dealt(rows, "block", "turn", "text").mapInArrow(measure, "conv_id long, block long, m array<double>"), "blocks")
    ends = _ends(nodes, fan)
    both = rows.alias("r").join(ends.alias("e"), F.expr("r.conv_id <=> e.conv_id AND r.block = e.block"))
    both = both.select("r.conv_id", "r.block", "turn", "text", "before", "last")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, block), own in runs(batches, 2):
            lines = _pieces(own, 3)
            path = best_path([emissions(*x) for x in lines], own[0][4], own[0][5])
            roles, chat = [], []
            for (line, _), state in zip(lines, path, strict=True):
                role, begins = STATES[state]
                if begins:
                    roles.append(role)
                    chat.append(f"<|{role}|>\n")
                    marked, rest = split_marker(line)
                    line = rest if marked == role else line
                chat.append(line + "\n")
            yield _batch([(conv, block, len(roles), len(lines), ",".join(roles), "".join(chat))], _CHAT)

    return _dealt(both, "block", "turn", "text", "before", "last").mapInArrow(
        render, "conv_id long, block long, n_turns long, n_lines long, roles string, chat string"
    )
