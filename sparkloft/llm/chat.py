"""Chat formatting: a hidden Markov model over the lines of transcripts finds where turns begin and whose they are.

Every line is an observation: its speaker marker, its size, and the size of what follows up to the next place where a turn could begin.
The states are a role and whether the line begins a turn or goes on with it. Viterbi recovers them, then turns are rendered in one form.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from sparkloft.llm.common import checkpointed

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # a turn of each role begins, then one of each role goes on
FOLDS = 2  # conversations of a fold are decoded by the model that is fitted on the other ones
TRAIN_CONVERSATIONS = 2000  # conversations with known roles that a model is fitted on at most
TRAIN_TURNS = 64  # turns of each
TRAIN_BYTES = 1 << 16  # and bytes of a turn
ROWS_A_TASK = 50_000
BEGIN, END = "<|{role}|>\n", "\n<|end|>"
NEVER = -1e9

# Fixed words that mark a speaker at the start of a line, by role.
MARKERS = {
    "system": ("system", "sys", "instruction", "instructions"),
    "user": ("user", "human", "customer", "client", "question", "q", "me", "prompter"),
    "assistant": ("assistant", "ai", "bot", "chatbot", "agent", "answer", "a", "gpt", "model", "support"),
}
_ROLE_OF = {w: r for r, words in MARKERS.items() for w in words}
_ANY = "|".join(sorted(_ROLE_OF, key=lambda w: (-len(w), w)))
_MARKER = re.compile(
    rf"\s*(?:<\|im_start\|>\s*({_ANY})\s*$|(?:#{{1,4}}\s*|\*\*|\[|<\|?)?({_ANY})(?:\*\*)?\s*(?::\*\*|[:\]>]|\|>))\s*", re.I
)
_CLOSING = re.compile(r"(?:\s*(?:<\|im_end\|>|<\|end\|>))+\s*$")


def marker(line: str) -> tuple[str | None, int]:
    """The role that a speaker marker at the start names, and where the text after it begins."""
    m = _MARKER.match(line)
    return (_ROLE_OF[(m[1] or m[2]).lower()], m.end()) if m else (None, 0)


# What is seen of a line: marker; bits of the number of characters, and number of lines, up to where the next turn could begin; bits
# of the line's own length; a question mark; inside a row, at the start of a row, at the start of the conversation.
SIZES = (4, 17, 10, 12, 2, 3)
INSIDE, ROW, CONVERSATION = 0, 1, 2


def features(text: str, first: bool) -> list[tuple[int, ...]]:
    """Observations of the lines of a row; a turn can begin at its first line and at marked ones."""
    lines = text.split("\n")
    marks = [marker(x) for x in lines]
    opens = [i for i, (role, _) in enumerate(marks) if i == 0 or role]
    out = [(0, 0, 0, min(len(x).bit_length(), 11), int("?" in x), INSIDE) for x in lines]
    for a, b in zip(opens, [*opens[1:], len(lines)], strict=True):
        role, at = marks[a]
        size = sum(map(len, lines[a:b])) + b - a - 1 - at
        place = INSIDE if a else (CONVERSATION if first else ROW)
        out[a] = (
            0 if role is None else 1 + ROLES.index(role), min(1 + size.bit_length(), 16), min(b - a, 9), min((len(lines[a]) - at).bit_length(), 11),
            int("?" in lines[a]), place
        )
    return out


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray  # [from, to]
    emit: list[np.ndarray]  # for each feature [state, value]

    @classmethod
    def fit(cls, conversations: Sequence[Sequence[tuple[int, Sequence[Sequence[int]]]]]) -> Model:
        """Smoothed counts of conversations: rows of (role, observations of its lines).

        What a marker means is fixed, whatever the sample holds: where a turn begins it names its role, however rare that role is there, and
        inside a turn there is hardly one. So is that a row begins a turn. Who opens a conversation is told by ``start`` alone.
        """
        n = len(ROLES)
        start, step = np.ones(n), np.full((n, n), 0.5)
        emit = [np.full((STATES, k), 0.5) for k in SIZES]
        for rows in conversations:
            for i, (role, lines) in enumerate(rows):
                if i:
                    step[rows[i - 1][0], role] += 1
                else:
                    start[role] += 1
                for k, f in enumerate(lines):
                    for e, v in zip(emit, f, strict=True):
                        e[role + n * (k > 0), v] += 1
        p = [e / e.sum(1, keepdims=True) for e in emit]
        for k in (1, 2):  # how much follows says whose turn begins, not whether one does
            p[k][n:] = p[k][:n].mean(0)
        for r in range(n):
            p[0][r] = [60 / 110, *(50 / 110 if r == j else 0 for j in range(n))]
            p[0][r + n] = [1 - 3e-5, 1e-5, 1e-5, 1e-5]
            p[5][r] = [0.02, 0.98, 0.98]
        emit = [np.log(np.maximum(x, 1e-12)) for x in p]
        emit[0][:n, 1:][~np.eye(n, dtype=bool)] = NEVER
        emit[5][n:] = [0.0, NEVER, NEVER]
        turn = np.log(step / step.sum(1, keepdims=True))
        trans = np.full((STATES, STATES), NEVER)
        for r in range(n):
            for s in (r, r + n):
                trans[s, :n] = np.log(0.5) + turn[r]
                trans[s, r + n] = np.log(0.5)
        return cls(np.concatenate([np.log(start / start.sum()), np.full(n, NEVER)]), trans, emit)

    def scores(self, f: np.ndarray) -> np.ndarray:
        """[line, state] log likelihood of observations."""
        return sum(e[:, f[:, i]].T for i, e in enumerate(self.emit))


def product(model: Model, scores: np.ndarray, begins: bool) -> np.ndarray:
    """Best score of a run of lines from each entering state to each last state (max-plus product)."""
    m = np.full((STATES, STATES), NEVER)
    np.fill_diagonal(m, 0.0)
    for i, e in enumerate(scores):
        step = np.broadcast_to(model.start, m.shape) if begins and not i else model.step
        m = (m[:, :, None] + step[None]).max(1) + e[None]
    return m


def viterbi(model: Model, scores: np.ndarray, begins: bool, enter: int | None = None, leave: int | None = None) -> np.ndarray:
    """Best states of a run; ``enter`` is the state before it, ``leave`` the state it must end in."""
    n = len(scores)
    best = (model.start if begins or enter is None else model.step[enter]) + scores[0]
    back = np.zeros((n, STATES), np.int8)
    for i in range(1, n):
        s = best[:, None] + model.step
        back[i] = s.argmax(0)
        best = s.max(0) + scores[i]
    out = np.zeros(n, np.int8)
    out[-1] = best.argmax() if leave is None else leave
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def render(role: str, text: str) -> str:
    """One turn in canonical form: role line, text without its speaker marker, closing marks and outer white space, end line."""
    line = text.split("\n", 1)[0]
    return BEGIN.format(role=role) + _CLOSING.sub("", text[marker(line)[1] :]).strip() + END


def turns_of(text: str, states: Sequence[int]) -> list[tuple[str, str]]:
    """(role, text) of the turns that the states of a row's lines tell."""
    lines = text.split("\n")
    begins = [i for i, s in enumerate(states) if s < len(ROLES)] or [0]
    return [(ROLES[states[a] % len(ROLES)], "\n".join(lines[a:b])) for a, b in zip(begins, [*begins[1:], len(lines)], strict=True)]


def fold(conv_id) -> int:
    """Whose model decodes a conversation; that model has not seen it."""
    return 0 if conv_id is None else zlib.crc32(str(conv_id).encode()) % FOLDS


def train(turns: DataFrame) -> list[Model]:
    """A model for each fold, fitted on a bounded sample of the other folds' conversations, chosen by a hash of their ids.

    turns: (conv_id, turn, role, text). Rows without a known role, with a marker inside or of more than TRAIN_BYTES are no examples.
    Without any example the models know markers only.
    """
    known = turns.where(F.col("conv_id").isNotNull() & F.col("role").isin(*ROLES) & F.col("turn").between(0, TRAIN_TURNS - 1))
    known = known.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_BYTES)
    chosen = known.select("conv_id").distinct().orderBy(F.xxhash64("conv_id"), "conv_id").limit(FOLDS * TRAIN_CONVERSATIONS)

    def describe(batches):
        for b in batches:
            f = [features(t or "", i == 0) for t, i in zip(b.column("text").to_pylist(), b.column("turn").to_pylist(), strict=True)]
            flat = pa.array([[v for line in x for v in line] for x in f], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), b.column("role"), flat], names=["conv_id", "turn", "role", "f"])

    rows = known.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role", "text"
    ).join(F.broadcast(chosen), "conv_id")  # bounded by the limit
    rows = rows.dropDuplicates(["conv_id", "turn"]).mapInArrow(
        describe, "conv_id long, turn long, role string, f array<int>"
    ).orderBy("conv_id", "turn").collect()
    by: dict[int, list] = {}
    for r in rows:
        lines = [tuple(r["f"][k : k + len(SIZES)]) for k in range(0, len(r["f"]), len(SIZES))]
        if not any(f[0] for f in lines[1:]):
            by.setdefault(r["conv_id"], []).append((ROLES.index(r["role"]), lines))
    return [Model.fit([x for i, x in by.items() if fold(i) != k]) for k in range(FOLDS)]


def _segments(batches):
    """Runs of rows of one conversation within a task: (conv_id, table)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        ids = b.column("conv_id").to_pylist()
        a = 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or ids[i] != ids[a]:
                if held and held[0].column("conv_id")[0].as_py() != ids[a]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(b.slice(a, i - a))
                a = i
    if held:
        yield pa.Table.from_batches(held)


def format_turns(turns: DataFrame, models: Sequence[Model]) -> DataFrame:
    """(conv_id, turn, part, role, rendered): the turns that every row holds, with their recovered roles, each in canonical form.

    turns: (conv_id, turn, text, ...); a role column is not looked at. A row is a message or a whole transcript: it begins a turn, and
    each of its lines may begin another; part counts them from 0. The order in a conversation is by turn, then text; null turns come
    first. Rows are dealt out by ranges of that order, so a conversation of any length is spread over tasks: each task
    reduces its part to the best scores from state to state, the driver joins those of conversations that cross tasks (two
    at most for each task) and fixes the states at the borders, and each task decodes its part between them. Null texts count as
    empty; an empty text is one empty turn; rows with a null conv_id are one conversation; repeated rows are turns of their own; an
    empty table gives an empty result.
    """
    spark = turns.sparkSession
    n = turns.count()
    rows = turns.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    key = ["conv_id", "turn", F.xxhash64("text"), F.spark_partition_id()]
    rows = rows.repartitionByRange(max(1, -(-n // ROWS_A_TASK), min(n, spark.sparkContext.defaultParallelism)), *key)
    rows = rows.sortWithinPartitions("conv_id", "turn", "text")
    rows = checkpointed(rows)  # fixes which task holds which rows
    sent = spark.sparkContext.broadcast(list(models))

    def model_of(t: pa.Table) -> Model:
        return sent.value[fold(t.column("conv_id")[0].as_py()) % len(sent.value)]

    def observed(t: pa.Table, begins: bool) -> tuple[np.ndarray, list[int]]:
        f = [features(x, begins and not i) for i, x in enumerate(t.column("text").to_pylist())]
        return model_of(t).scores(np.array([line for x in f for line in x], np.int64)), [len(x) for x in f]

    def ends(batches):
        part, edge = TaskContext.get().partitionId(), []
        for k, t in enumerate(_segments(batches)):
            if k < 2:
                edge.append(t)
            else:
                edge[1] = t
        for k, t in enumerate(edge):
            # whether this run begins its conversation is known only on the driver: both cases are sent
            both = np.stack([product(model_of(t), observed(t, begins)[0], begins) for begins in (True, False)])
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "last": pa.array([k == 1 or len(edge) == 1]),
                    "first": pa.array([k == 0]),
                    "conv_id": t.column("conv_id").combine_chunks().slice(0, 1).cast(pa.int64()),
                    "m": pa.array([both.ravel().tolist()], pa.list_(pa.float64())),
                }
            )

    edges = rows.mapInArrow(ends, "part int, last boolean, first boolean, conv_id long, m array<double>").collect()
    edges = sorted(edges, key=lambda r: (r["part"], r["last"]))
    border: dict[tuple[int, bool], tuple[bool, int | None, int | None]] = {}  # by task, and whether its first run: begins, enter, leave
    chain: list = []

    def settle() -> None:
        if len(chain) > 1:
            ms = [np.array(r["m"]).reshape(2, STATES, STATES)[0 if i == 0 else 1] for i, r in enumerate(chain)]
            best, back = ms[0][0], []
            for m in ms[1:]:
                s = best[:, None] + m
                back.append(s.argmax(0))
                best = s.max(0)
            leave = [int(best.argmax())]
            for b in reversed(back):
                leave.append(int(b[leave[-1]]))
            leave.reverse()
            for i, r in enumerate(chain):
                border[r["part"], r["first"]] = (i == 0, leave[i - 1] if i else None, leave[i])
        chain.clear()

    for r in edges:
        if chain and not (r["first"] and chain[-1]["last"] and chain[-1]["conv_id"] == r["conv_id"]):
            settle()
        chain.append(r)
    settle()
    fixed = spark.sparkContext.broadcast(border)

    def decode(batches):
        part = TaskContext.get().partitionId()
        runs = _segments(batches)
        now = next(runs, None)
        first = True
        while now is not None:
            after = next(runs, None)
            begins, enter, leave = fixed.value.get((part, first), (True, None, None)) if first or after is None else (True, None, None)
            scores, sizes = observed(now, begins)
            states = viterbi(model_of(now), scores, begins, enter, leave).tolist()
            take, parts, roles, rendered, at = [], [], [], [], 0
            for i, (text, size) in enumerate(zip(now.column("text").to_pylist(), sizes, strict=True)):
                for k, (role, said) in enumerate(turns_of(text, states[at : at + size])):
                    take.append(i)
                    parts.append(k)
                    roles.append(role)
                    rendered.append(render(role, said))
                at += size
            held = now.select(["conv_id", "turn"]).take(pa.array(take, pa.int64()))
            yield from pa.table(
                {"conv_id": held.column(0), "turn": held.column(1), "part": pa.array(parts, pa.int32()), "role": roles, "rendered": rendered}
            ).to_batches()
            now, first = after, False

    kinds = {c: turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    return rows.mapInArrow(decode, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, part int, role string, rendered string")


def parse_transcripts(transcripts: DataFrame, models: Sequence[Model]) -> DataFrame:
    """(conv_id, turn, role, rendered) of raw transcripts (conv_id, text), each a text of many turns."""
    parts = format_turns(transcripts.select("conv_id", F.lit(0).alias("turn"), "text"), models)
    return parts.select("conv_id", F.col("part").alias("turn"), "role", "rendered")
