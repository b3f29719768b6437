"""Chat formatting: roles of transcript lines by a hidden Markov model.

A message is a few lines; a conversation is the lines of its messages in order.
Every line is observed as whether it begins a message, the speaker marker it
starts with, its length and whether it asks.  A hidden state is a role, at the
first line of its turn or further in.  Start, transition and observation
probabilities are counted over all labelled messages.  Viterbi finds the most
likely states, a message takes the role of its first line, and turns are rendered
in one canonical form: ``<|role|>``, the text without marker, ``<|end|>``.

A conversation may be of any length: it is cut into stretches of ``STRETCH``
turn numbers.  Each stretch gives a small matrix with the best path score from
every state before it to every state at its end; the matrices of a conversation
are chained, and then each stretch is solved between its known ends.  The result
is that of one Viterbi over the whole conversation.

Edge cases: a null or empty text is one empty line; a null role is not learned
from; a null turn comes first; equal turns keep the order of the input; without
any labelled row every role is ``unknown``; a null conversation id is a
conversation; an empty table gives an empty table.  Other columns are not read
and cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from runweave.storage import cut_lineage

STRETCH = 256
UNKNOWN = "unknown"
SMOOTHING = 0.5
# Words that mark a speaker at the start of a line.
MARKERS = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q", "you", "me", "prompter"),
    "assistant": ("assistant", "bot", "ai", "agent", "answer", "a", "model", "gpt", "response"),
}
KINDS = [None, *MARKERS]
WORD_KIND = {w: k for k, ws in MARKERS.items() for w in ws}
MARKER = re.compile(
    r"^\s*(?:<\|(?P<tag>[A-Za-z]+)\|>|(?:#+\s*|\*\*|\[)?(?P<word>[A-Za-z]+)(?:\*\*)?\]?\s*:(?:\*\*)?|###\s*(?P<title>[A-Za-z]+)\s*$)\s*"
)
# A marker is worth so many labelled lines of its role.
MARKER_WEIGHT = 200.0
LENGTHS = [0, 20, 60, 150, 400, 1000]
# Values of each observed feature: first line, marker, length, question.
SHAPE = (2, len(KINDS), len(LENGTHS) + 1, 2)


def marker_of(line: str) -> tuple[int, str]:
    """The kind of marker a line starts with (0: none), and the rest of it."""
    found = MARKER.match(line)
    if found:
        kind = WORD_KIND.get((found["tag"] or found["word"] or found["title"]).lower())
        if kind:
            return KINDS.index(kind), line[found.end() :]
    return 0, line


def observe(text: str) -> list[int]:
    """One number per line of a message, from which its features follow."""
    seen = []
    for i, line in enumerate(text.split("\n")):
        kind, rest = marker_of(line)
        features = (int(i == 0), kind, int(np.searchsorted(LENGTHS, len(rest), side="right")), int("?" in rest))
        seen.append(int(np.ravel_multi_index(features, SHAPE)))
    return seen


@dataclass
class Model:
    roles: list[str]
    start: np.ndarray
    moves: np.ndarray
    emit: np.ndarray  # state x observation

    @property
    def states(self) -> int:
        return 2 * len(self.roles)


def fit_counts(roles: list[str], starts: np.ndarray, moves: np.ndarray, seen: np.ndarray) -> Model:
    """Log probabilities from counts; features are independent given the state."""
    n = 2 * len(roles)
    every = np.array(np.unravel_index(np.arange(np.prod(SHAPE)), SHAPE)).T
    emit = np.zeros((n, len(every)))
    for f, size in enumerate(SHAPE):
        table = np.full((n, size), SMOOTHING)
        for s in range(n):
            table[s] += np.bincount(every[:, f], seen[s], size)
            if f == 1 and s % 2 == 0 and roles[s // 2] in KINDS:
                table[s, KINDS.index(roles[s // 2])] += MARKER_WEIGHT
        emit += np.log(table / table.sum(1, keepdims=True))[:, every[:, f]]
    starts, moves = starts + SMOOTHING, moves + SMOOTHING
    return Model(roles, np.log(starts / starts.sum()), np.log(moves / moves.sum(1, keepdims=True)), emit)


def stretch_matrix(seen: list[int], model: Model, first: bool) -> np.ndarray:
    """Best score from every state before the stretch to every state at its end;
    a first stretch begins in no state, so all its rows are equal."""
    step = np.tile(model.start, (model.states, 1)) if first else model.moves
    score = step + model.emit[:, seen[0]]
    for o in seen[1:]:
        score = (score[:, :, None] + model.moves[None]).max(1) + model.emit[:, o]
    return score


def solve_stretch(seen: list[int], model: Model, before: int | None, after: int | None) -> list[int]:
    """The best states of a stretch between the states around it; ``after`` is
    the state at its end, if known."""
    score = (model.start if before is None else model.moves[before]) + model.emit[:, seen[0]]
    back = []
    for o in seen[1:]:
        ways = score[:, None] + model.moves
        back.append(ways.argmax(0))
        score = ways.max(0) + model.emit[:, o]
    state = int(score.argmax()) if after is None else after
    path = [state]
    for pointers in reversed(back):
        state = int(pointers[state])
        path.append(state)
    return path[::-1]


def chain(matrices: list[np.ndarray]) -> list[int]:
    """The best state at the end of every stretch of a conversation."""
    score, back = matrices[0][0], []
    for m in matrices[1:]:
        ways = score[:, None] + m
        back.append(ways.argmax(0).astype(np.int8))
        score = ways.max(0)
    state = int(score.argmax())
    ends = [state]
    for pointers in reversed(back):
        state = int(pointers[state])
        ends.append(state)
    return ends[::-1]


def render(role: str, text: str) -> str:
    """A turn in canonical form."""
    first, _, rest = text.partition("\n")
    _, first = marker_of(first)
    body = (first + "\n" + rest if rest else first).strip()
    return f"<|{role}|>\n{body}\n<|end|>\n"


def _observed(conversations: DataFrame) -> DataFrame:
    """Messages with their stretch and observations, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [observe(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seen, pa.list_(pa.int32()))], [*batch.schema.names, "seen"])

    rows = conversations.select(
        F.col("conv_id").cast("long"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("at"),
        F.col("turn").cast("long"),
        "role",
        "text",
        F.monotonically_increasing_id().alias("row_id"),
    )
    schema = "conv_id long, at long, turn long, role string, text string, row_id long, seen array<int>"
    return cut_lineage(rows.mapInArrow(run, schema), "messages").withColumn("stretch", F.floor(F.col("at") / STRETCH))


def _stretches(messages: DataFrame, columns: list[str]) -> DataFrame:
    """Stretches together and in order."""
    key = ["conv_id", "stretch"]
    return messages.repartition(*key).sortWithinPartitions(*key, "at", "row_id").select(*key, *columns)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, list[dict]]]:
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = (row["conv_id"], row["stretch"])
            if held and now != key:
                yield *key, held
                held = []
            key = now
            held.append(row)
    if held:
        yield *key, held


def _states(role: int, lines: int) -> list[int]:
    return [2 * role] + [2 * role + 1] * (lines - 1)


def fit(messages: DataFrame, learn: Column) -> Model | None:
    """Count over all messages where ``learn`` holds.  Only counts, as many as
    pairs of states and of state and observation, reach the driver.

    A transition from one stretch into the next counts like any other; none is
    counted over a stretch without messages.  Messages without a turn come first in
    their conversation, which still has one start."""
    known = messages.where(learn & F.col("role").isNotNull())
    roles = sorted(r[0] for r in known.select("role").distinct().collect())
    if not roles:
        return None
    number = {r: i for i, r in enumerate(roles)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds, a, b, n, convs, stretches = zip(*rows) if rows else ((),) * 6
            columns = [pa.array(kinds, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (n, convs, stretches)]
            return pa.RecordBatch.from_arrays(columns, ["kind", "a", "b", "n", "conv_id", "stretch"])

        counts: dict[tuple[str, int, int], int] = {}
        ends: list[tuple] = []
        for conv, stretch, group in _groups(batches):
            first = last = None
            for row in group:
                states = _states(number[row["role"]], len(row["seen"]))
                for state, seen in zip(states, row["seen"]):
                    if last is None:
                        first = state
                    else:
                        counts["move", last, state] = counts.get(("move", last, state), 0) + 1
                    counts["seen", state, seen] = counts.get(("seen", state, seen), 0) + 1
                    last = state
            if last is not None:
                ends.append(("ends", first, last, 1, conv, stretch))
            if len(ends) >= 10_000:
                yield out(ends)
                ends = []
        yield out(ends + [(*what, n, None, None) for what, n in counts.items()])

    schema = "kind string, a int, b int, n long, conv_id long, stretch long"
    found = cut_lineage(_stretches(known, ["role", "seen"]).mapInArrow(run, schema), "counts")
    ends = found.where("kind = 'ends'").select("conv_id", "stretch", "a", "b")
    before = ends.select(F.col("conv_id").alias("_conv"), (F.col("stretch") + 1).alias("_next"), F.col("b").alias("_last"))
    # One row per stretch on both sides.
    met = ends.join(before, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("stretch") == F.col("_next")), "left")
    over = F.col("_last").isNotNull()
    borders = met.where(over | (F.col("stretch") <= 0)).select(
        F.when(over, "move").otherwise("start").alias("kind"), F.coalesce("_last", F.lit(0)).alias("a"), F.col("a").alias("b"), F.lit(1).cast("long").alias("n")
    )
    counted = found.where("kind <> 'ends'").select("kind", "a", "b", "n").unionByName(borders)
    starts, moves = np.zeros(2 * len(roles)), np.zeros((2 * len(roles),) * 2)
    seen = np.zeros((2 * len(roles), int(np.prod(SHAPE))))
    for r in counted.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect():
        if r.kind == "start":
            starts[r.b] += r.n
        else:
            (moves if r.kind == "move" else seen)[r.a, r.b] += r.n
    return fit_counts(roles, starts, moves, seen)


def _ends(messages: DataFrame, model: Model) -> DataFrame:
    """``conv_id, stretch, before, after``: the states around every stretch."""

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, stretch, group in _groups(batches):
            # -1: whether a stretch is the first is only known below.
            seen = [o for row in group for o in row["seen"]]
            first, later = (stretch_matrix(seen, model, f) for f in (True, False))
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([stretch], pa.int64()), pa.array([first[0].tolist()]), pa.array([later.ravel().tolist()])],
                ["conv_id", "stretch", "first", "later"],
            )

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(conv: int | None, held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            ends = chain([m for _, m in held])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([conv] * len(held), pa.int64()),
                    pa.array([s for s, _ in held], pa.int64()),
                    pa.array([None, *ends[:-1]], pa.int32()),
                    pa.array(ends, pa.int32()),
                ],
                ["conv_id", "stretch", "before", "after"],
            )

        conv, held, began = None, [], False
        for batch in batches:
            for row in batch.to_pylist():
                if began and row["conv_id"] != conv:
                    yield out(conv, held)
                    held = []
                conv, began = row["conv_id"], True
                shape = (model.states, model.states)
                held.append((row["stretch"], np.tile(row["first"], (model.states, 1)) if not held else np.reshape(row["later"], shape)))
        if held:
            yield out(conv, held)

    steps = _stretches(messages, ["seen"]).mapInArrow(matrices, "conv_id long, stretch long, first array<double>, later array<double>")
    steps = cut_lineage(steps, "stretches")
    ordered = steps.repartition("conv_id").sortWithinPartitions("conv_id", "stretch")
    return ordered.mapInArrow(chains, "conv_id long, stretch long, before int, after int")


def format_chat(conversations: DataFrame, learn: Column) -> DataFrame:
    """Per message ``conv_id, turn, role, role_pred, rendered, n_lines``.

    ``learn`` is an expression over ``conv_id``; roles of other rows are not
    looked at.
    """
    messages = _observed(conversations)
    model = fit(messages, learn)
    if model is None:
        plain = F.concat(F.lit(f"<|{UNKNOWN}|>\n"), F.trim(F.coalesce("text", F.lit(""))), F.lit("\n<|end|>\n"))
        return messages.select(
            "conv_id", "turn", "role", F.lit(UNKNOWN).alias("role_pred"), plain.alias("rendered"), F.size("seen").alias("n_lines")
        )
    ends = _ends(messages, model)
    key = F.coalesce(F.col("conv_id"), F.lit(-(2**63)))
    ends = ends.select(key.alias("_conv"), F.col("stretch").alias("_stretch"), "before", "after")
    # The rows of a stretch are few, so no key of this join is hot.
    whole = messages.join(ends, (key == F.col("_conv")) & (F.col("stretch") == F.col("_stretch")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, _, group in _groups(batches):
            seen = [o for row in group for o in row["seen"]]
            states = solve_stretch(seen, model, group[0]["before"], group[0]["after"])
            roles, at = [], 0
            for row in group:
                roles.append(model.roles[states[at] // 2])
                at += len(row["seen"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([conv] * len(group), pa.int64()),
                    pa.array([r["turn"] for r in group], pa.int64()),
                    pa.array([r["role"] for r in group], pa.string()),
                    pa.array(roles, pa.string()),
                    pa.array([render(role, r["text"] or "") for role, r in zip(roles, group)], pa.string()),
                    pa.array([len(r["seen"]) for r in group], pa.int32()),
                ],
                ["conv_id", "turn", "role", "role_pred", "rendered", "n_lines"],
            )

    ordered = _stretches(whole, ["turn", "role", "text", "seen", "before", "after"])
    return ordered.mapInArrow(run, "conv_id long, turn long, role string, role_pred string, rendered string, n_lines int")
