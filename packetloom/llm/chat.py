"""Chat formatting: a hidden Markov model recovers the roles of lines, Viterbi decodes, turns are rendered.

States are roles. A line is observed by its speaker marker ("User:", "### Response", ...) and by line
features: whether it begins a row, asks a question, its length, the row's number of lines. Transitions
and emissions are counted over all rows whose role is known; markers keep a fixed strength.

Decoding is distributed. The lines of a conversation are cut in segments; each gives a matrix of the
best scores from any state at its start to any at its end. These products are few and are joined in
order for the states at the borders, between which each segment is then decoded by itself. So one
conversation with a third of all rows is many tasks' work.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
SEGMENT = 512

# Words that open a line of each speaker, before a colon or as a heading.
SPEAKERS = {
    "system": "system instructions",
    "user": "user human customer prompt question instruction",
    "assistant": "assistant bot ai model response answer gpt",
}
_of_word = {w: r for r, words in SPEAKERS.items() for w in words.split()}
_MARKER = re.compile(r"^\s*(?:<\|)?(?:#{1,6}\s*)?(?:\*\*)?\s*\[?(" + "|".join(sorted(_of_word, key=len, reverse=True)) + r")\]?\s*(?:\*\*)?\s*(?::|\|>|$)\s*", re.IGNORECASE)
_LENGTHS = np.array([0, 20, 60, 120, 250, 500, 1000])
N_FEATURES = 2 * 2 * (len(_LENGTHS) + 1) * 3
#: Log-odds that a marked line is of its speaker.
MARKER_STRENGTH = 8.0


def observe(line: str, first: bool, lines: int) -> tuple[int, int]:
    """(index of the marked role or -1, feature) of a line; first: it begins its row, which has lines lines."""
    found = _MARKER.match(line)
    marked = ROLES.index(_of_word[found[1].lower()]) if found else -1
    length = int(np.searchsorted(_LENGTHS, len(line), "right"))
    feature = ((int(first) * 2 + int(line.rstrip().endswith("?"))) * (len(_LENGTHS) + 1) + length) * 3 + min(2, lines - 1)
    return marked, feature


def _row(text: str | None) -> list[tuple[int, int]]:
    lines = (text or "").split("\n")
    return [observe(line, i == 0, len(lines)) for i, line in enumerate(lines)]


_SAME = np.where(np.eye(len(ROLES)) > 0, 0.0, -np.inf)


class Model:
    def __init__(self, begin: np.ndarray, turn: np.ndarray, emit: np.ndarray):
        self.begin, self.turn, self.emit = begin, turn, emit
        self.stay = np.full((len(ROLES),) * 2, -12.0) + 12.0 * np.eye(len(ROLES))  # within a row only a marker changes the role

    def steps(self, rows: list[str | None], opens: bool) -> tuple[list[np.ndarray], list[np.ndarray], list[int]]:
        """For each line the transition into it and the score of each state; the lines of each row.

        opens: the rows begin a conversation, so the state before them is the first line's own.
        """
        moves, scores, counts = [], [], []
        for text in rows:
            seen = _row(text)
            counts.append(len(seen))
            for i, (marked, feature) in enumerate(seen):
                moves.append(self.stay if i else self.turn if moves or not opens else _SAME)
                s = self.emit[:, feature].copy()
                if marked >= 0:
                    s[marked] += 2 * MARKER_STRENGTH if i else MARKER_STRENGTH
                scores.append(s)
        return moves, scores, counts


def fit(df: DataFrame, conv: str, turn: str, role: str, text: str) -> Model:
    """Counts over all rows with a known role; one is added to each count."""
    known = df.select(F.col(conv).alias("c"), F.col(turn).alias("n"), F.lower(F.trim(F.col(role))).alias("r"), F.col(text).alias("t")).where(F.col("r").isin(*ROLES))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(ROLES), N_FEATURES), np.int64)
        for batch in batches:
            for r, t in zip(batch.column("r").to_pylist(), batch.column("t").to_pylist(), strict=True):
                for _, feature in _row(t):
                    total[ROLES.index(r), feature] += 1
        r, f = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(f.astype(np.int32)), pa.array(total[r, f])], ["r", "f", "n"])

    emit = np.ones((len(ROLES), N_FEATURES))
    for x in known.select("r", "t").mapInArrow(features, "r int, f int, n bigint").groupBy("r", "f").agg(F.sum("n").alias("n")).collect():
        emit[x.r, x.f] += x.n
    # the role of the row before, found by its number: no window over a conversation
    pairs = known.select("c", "n", "r").join(known.select("c", (F.col("n") + 1).alias("n"), F.col("r").alias("before")).distinct(), ["c", "n"], "left")
    begin, move = np.ones(len(ROLES)), np.ones((len(ROLES),) * 2)
    for x in pairs.groupBy("before", "r").count().collect():
        if x.before is None:
            begin[ROLES.index(x.r)] += x["count"]
        else:
            move[ROLES.index(x.before), ROLES.index(x.r)] += x["count"]
    log = lambda a: np.log(a / a.sum(axis=-1, keepdims=True))
    return Model(log(begin), log(move), log(emit))


def best_product(moves: list[np.ndarray], scores: list[np.ndarray]) -> np.ndarray:
    """Max-plus product of a segment's steps: the best score from each state before it to each at its end."""
    total = _SAME
    for m, s in zip(moves, scores, strict=True):
        total = (total[:, :, None] + m[None]).max(axis=1) + s
    return total


def viterbi(begin: np.ndarray, moves: list[np.ndarray], scores: list[np.ndarray], end: int | None = None) -> list[int]:
    """The best states of a segment, given scores of the state before it and, if known, the last state."""
    best, back = begin, []
    for m, s in zip(moves, scores, strict=True):
        step = best[:, None] + m
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + s
    states = [int(best.argmax()) if end is None else end]
    for b in back[:0:-1]:
        states.append(int(b[states[-1]]))
    return states[::-1]


def render(role: str, text: str | None) -> str:
    """A turn in canonical form: role header, the text without its markers and outer blank lines, end mark."""
    lines = [_MARKER.sub("", line, count=1) if _MARKER.match(line) else line for line in (text or "").replace("\r\n", "\n").split("\n")]
    return f"<|{role}|>\n" + "\n".join(line.rstrip() for line in lines).strip("\n") + "\n<|end|>\n"


def _turns(ordered: pa.Table, states: list[int], counts: list[int]) -> pa.Table:
    """The rendered turns of rows (conv, turn, text): states for each line, counts of the lines of each row."""
    out: tuple[list, ...] = ([], [], [], [])
    place = 0
    for i, (t, n) in enumerate(zip(ordered.column("text").to_pylist(), counts, strict=True)):
        lines, own = (t or "").split("\n"), states[place : place + n]
        place += n
        cuts = [0, *(k for k in range(1, n) if own[k] != own[k - 1]), n]
        for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
            for column, x in zip(out, (i, part, ROLES[own[a]], render(ROLES[own[a]], "\n".join(lines[a:b]))), strict=True):
                column.append(x)
    took = pa.array(out[0], pa.int64())
    return pa.table({"conv": ordered.column("conv").take(took), "turn": ordered.column("turn").take(took), "part": pa.array(out[1], pa.int32()), "role_pred": pa.array(out[2], pa.string()), "rendered": pa.array(out[3], pa.string())})


def format_chats(df: DataFrame, model: Model | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """conv, turn, part, role_pred, rendered: the turns of each conversation, its roles recovered from its text.

    A row becomes one turn, or more where a marker inside it changes the speaker; part counts them from
    0. The role column trains the model, if none is given, and never decides a row's own role. Rows are
    read by ascending turn, those of one turn by text; segments hold the turns from a multiple of
    segment to the next. Null, empty and very long texts are rows like any other (an empty turn is
    rendered too), repeated rows stay. A row with a null conv or a null turn has no place in a
    conversation: it is decoded by itself, as one that opens a conversation, and moves no other row.
    Rows of one conversation and one turn are one segment. Other columns are not read.
    """
    model = model or fit(df, conv, turn, role, text)
    shared = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    every = df.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.col(text).cast("string").alias("text"))
    placed = F.col("conv").isNotNull() & F.col("turn").isNotNull()
    rows = every.where(placed).withColumn("segment", F.floor(F.col("turn") / segment).cast("bigint"))

    def product(key: tuple, table: pa.Table) -> pa.Table:
        m: Model = pickle.loads(shared.value)
        ordered = table.sort_by([("turn", "ascending"), ("text", "ascending")])
        both = [best_product(*m.steps(ordered.column("text").to_pylist(), opens)[:2]).tobytes() for opens in (False, True)]
        return pa.table({"conv": ordered.column("conv").slice(0, 1), "segment": ordered.column("segment").slice(0, 1), "best": pa.array(both[:1], pa.binary()), "first": pa.array(both[1:], pa.binary())})

    kind = rows.schema["conv"].dataType.simpleString()
    split = rows.groupBy("conv").agg(F.min("segment").alias("a"), F.max("segment").alias("b")).where("a < b").select("conv")
    long_rows = rows.join(split, "conv", "left_semi")
    products = long_rows.groupBy("conv", "segment").applyInArrow(product, f"conv {kind}, segment bigint, best binary, first binary")

    def borders(key: tuple, table: pa.Table) -> pa.Table:
        """A conversation's segments in order: a matrix each, forward for the scores, back for the states."""
        m: Model = pickle.loads(shared.value)
        ordered = table.sort_by("segment")
        each = [np.frombuffer(x if isinstance(x, bytes) else x.as_py(), np.float64).reshape((len(ROLES),) * 2) for x in (ordered.column("first")[0], *ordered.column("best").to_pylist()[1:])]
        before = [m.begin]
        for p in each:
            before.append((before[-1][:, None] + p).max(axis=0))
        state = int(before[-1].argmax())
        ends = []
        for p, b in zip(each[::-1], before[-2::-1], strict=True):
            ends.append(state)
            state = int((b + p[:, state]).argmax())
        return pa.table({"conv": ordered.column("conv"), "segment": ordered.column("segment"), "before": pa.array([b.tobytes() for b in before[:-1]], pa.binary()), "end": pa.array(ends[::-1], pa.int32()), "opens": pa.array(np.arange(len(each)) == 0)})

    known = products.groupBy("conv").applyInArrow(borders, f"conv {kind}, segment bigint, before binary, end int, opens boolean")
    schema = f"conv {kind}, turn bigint, part int, role_pred string, rendered string"

    def decoded(key: tuple, table: pa.Table, at: pa.Table) -> pa.Table:
        m: Model = pickle.loads(shared.value)
        ordered = table.sort_by([("turn", "ascending"), ("text", "ascending")])
        texts = ordered.column("text").to_pylist()
        moves, scores, counts = m.steps(texts, at.column("opens")[0].as_py() if at.num_rows else True)
        before = np.frombuffer(at.column("before")[0].as_py(), np.float64) if at.num_rows else m.begin
        states = viterbi(before, moves, scores, at.column("end")[0].as_py() if at.num_rows else None) if scores else []
        return _turns(ordered, states, counts)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = pickle.loads(shared.value)
        for batch in batches:
            states, counts = [], []
            for t in batch.column("text").to_pylist():
                moves, scores, n = m.steps([t], True)
                states += viterbi(m.begin, moves, scores)
                counts += n
            yield from _turns(pa.Table.from_batches([batch]), states, counts).to_batches()

    out = rows.groupBy("conv", "segment").cogroup(known.groupBy("conv", "segment")).applyInArrow(decoded, schema).unionAll(every.where(~placed).mapInArrow(alone, schema))
    return out.select(F.col("conv").alias(conv), F.col("turn").alias(turn), "part", "role_pred", "rendered")

