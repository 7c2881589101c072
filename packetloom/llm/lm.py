"""LM scoring: masked pseudo-likelihood of a bidirectional window network, trained in numpy.

A token is the class of a word: one of the FREQUENT most frequent words of the corpus, or one of RARE
classes by hash for all others. The network predicts a token from the SIDE tokens on both sides of it:
their embeddings, each through the matrix of its place, summed and squashed, then a softmax. The word
is then predicted within its class, by how often the corpus has it elsewhere: its count without the
masked one, and SMOOTH. A text scores the sum of the log-probabilities of its words, each masked in turn.

Every distinct word of the corpus is counted, in a table that grows with it. Training goes through all
of it: texts, as classes, are dealt by a hash to shards of about SHARD tokens each. In each round each
shard starts from the same weights and takes stochastic gradient steps on its share of the positions, in an
order drawn by a fixed seed, so that each token of the corpus is a target once over the rounds; the weights
of all shards are averaged by tokens, in groups on the executors. Nothing depends on how the input lies in
files or tasks.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm import _bytes as B
from packetloom.llm._shared import small_batches, written

FREQUENT, RARE = 192, 64
PAD = FREQUENT + RARE
SIDE = 2
DIM = 16
ROUNDS = 2
SMOOTH = 0.1
#: Tokens of a shard, and places of one gradient step.
SHARD, STEP = 1 << 20, 256
#: Weights averaged by one task.
GROUP = 64
#: Places scored at a time.
PART = 1 << 10
#: Distinct words a task holds before it sends their counts.
HELD = 1 << 20
#: Bytes and rows of texts that are scored together.
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 4000
_PLACES = [d for d in range(-SIDE, SIDE + 1) if d]
#: Logits below this need no shift before the exponential.
_SAFE = 60.0


@dataclass
class Model:
    frequent: np.ndarray  #: the most frequent words, by count; a word's place is its class
    w: dict[str, np.ndarray]
    counts: DataFrame  #: word, n: every word of the corpus
    sizes: np.ndarray  #: of each rare class, the counts of its words, SMOOTH for each, and SMOOTH for words not there


def classes(frequent: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Class of each word: its place in frequent, or one of RARE by hash."""
    out = FREQUENT + (words >> np.uint64(48)).astype(np.int64) % RARE
    if len(frequent):
        order = np.argsort(frequent)
        at = order[np.minimum(np.searchsorted(frequent, words, sorter=order), len(frequent) - 1)]
        out = np.where(frequent[at] == words, at, out)
    return out


def _summed(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(words)
    words = words[order]
    first = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else np.zeros(0, np.int64)
    return words[first], np.add.reduceat(n[order], first) if len(first) else np.zeros(0, np.int64)


def count_words(df: DataFrame, text: str = "text") -> DataFrame:
    """word (hash), n: all words of all texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, fresh, size = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(known[0].view(np.int64)), pa.array(known[1])], ["word", "n"])

        for batch in batches:
            for words, _ in _texts(batch.column(0)):
                fresh.append(_summed(words, np.ones(len(words), np.int64)))
                size += len(fresh[-1][0])
                if size > HELD:
                    known, fresh, size = _summed(*(np.concatenate(c) for c in zip(known, *fresh, strict=True))), [], 0
                    if len(known[0]) > HELD:
                        yield sent()
                        known = (known[0][:0], known[1][:0])
        known = _summed(*(np.concatenate(c) for c in zip(known, *fresh, strict=True)))
        yield sent()
        known = fresh = None
        B.release()

    return df.select(F.col(text).cast("string").alias("t")).mapInArrow(counted, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _texts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes of runs of texts, with the row of each; a long text comes in pieces."""
    data, offsets = B.column_bytes(column, lower=True)
    for i, j in B.runs(offsets):
        part = data[offsets[i] : offsets[j]]
        for piece in B.pieces(part) if j - i == 1 else (part,):
            low = B.LOWER[piece]
            begin, end, bounds = B.word_spans(low, np.array([0, len(piece)]) if j - i == 1 else offsets[i : j + 1] - offsets[i])
            yield B.range_hash(B.prefix_hash(low), begin, end), np.repeat(np.arange(i, j), np.diff(bounds))


def vocabulary(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The FREQUENT words of the largest counts, and the sizes of the rare classes."""
    frequent = np.array([r.word for r in counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()], np.int64)
    sizes = np.full(RARE, SMOOTH)
    for r in counts.where(~F.col("word").isin(frequent.tolist())).groupBy((F.shiftrightunsigned("word", 48) % RARE).alias("c")).agg((F.sum("n") + F.lit(SMOOTH) * F.count("*")).alias("s")).collect():
        sizes[r.c] += r.s
    return frequent.view(np.uint64), sizes


def start(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {"E": rng.normal(0, 0.3, (PAD + 1, DIM)), "A": rng.normal(0, DIM**-0.5, (len(_PLACES), DIM, DIM)), "O": rng.normal(0, 0.1, (DIM, PAD)), "b": np.zeros(PAD)}
    return {k: v.astype(np.float32) for k, v in w.items()}


def padded(token: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts with SIDE paddings before, between and after them, and where each token stands."""
    at = np.arange(len(token))
    at += SIDE
    at[1:] += SIDE * np.cumsum(row[1:] != row[:-1])
    out = np.full((int(at[-1]) if len(at) else 0) + SIDE + 1, PAD, np.int16)
    out[at] = token
    return out, at


def step(w: dict[str, np.ndarray], around: np.ndarray, token: np.ndarray, rate: float) -> float:
    """One gradient step in place; the mean loss before it."""
    n, k = around.shape
    side, O, b = w["A"].reshape(k * DIM, DIM), w["O"], w["b"]
    x = w["E"][around].reshape(n, k * DIM)
    h = np.tanh(x @ side)
    p = h @ O
    p += b
    if np.abs(O).sum(axis=0).max() + np.abs(b).max() > _SAFE:
        p -= p.max(axis=1, keepdims=True)
    rows = np.arange(n)
    mine = p[rows, token]
    np.exp(p, out=p)
    total = p @ np.ones(PAD, np.float32)
    p *= (np.float32(rate / n) / total)[:, None]
    p[rows, token] -= np.float32(rate / n)
    dh = (p @ O.T) * (1 - h * h)
    O -= h.T @ p
    b -= np.ones(n, np.float32) @ p
    dx = (dh @ side.T).reshape(n * k, DIM)
    side -= x.T @ dh
    cells = (around.reshape(-1, 1).astype(np.int64) * DIM + np.arange(DIM)).ravel()
    w["E"] -= np.bincount(cells, weights=dx.ravel(), minlength=(PAD + 1) * DIM).reshape(PAD + 1, DIM).astype(np.float32)
    return float((np.log(total) - mine).mean())


def targets(row: np.ndarray, r: int, rounds: int) -> np.ndarray:
    """Places of a run of texts that round r learns from: of each text every rounds-th, from another one each round."""
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return np.flatnonzero(place % rounds == r)


def _flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def _shaped(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at, like = {}, 0, start()
    for k in sorted(like):
        n = like[k].size
        out[k] = flat[at : at + n].reshape(like[k].shape).astype(np.float32)
        at += n
    return out


def encoded(df: DataFrame, frequent: np.ndarray, text: str = "text", key: str | None = None) -> DataFrame:
    """h, n, tokens: of each text with a word, a hash of key and text, the number of words and their classes, a byte each."""

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            parts = [(classes(frequent, words).astype(np.uint8), row) for words, row in _texts(batch.column("t"))]
            n = sum((np.bincount(row, minlength=size) for _, row in parts), np.zeros(size, np.int64))
            data = b"".join(t.tobytes() for t, _ in parts)
            ends = pa.py_buffer(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(n), pa.Array.from_buffers(pa.binary(), size, [None, ends, pa.py_buffer(data)])], ["h", "n", "tokens"])
            del parts, data
        B.release()

    t = F.col(text).cast("string")
    return df.select(F.xxhash64(*([key] if key else []), t).alias("h"), t.alias("t")).where("t is not null").mapInArrow(classed, "h bigint, n bigint, tokens binary").where("n > 0")


def learned(texts: list[bytes], w: dict[str, np.ndarray], r: int, rounds: int, rate: float) -> dict[str, np.ndarray]:
    """The weights after round r over the texts of a shard, which come as classes."""
    w = {k: v.copy() for k, v in w.items()}
    token = np.frombuffer(b"".join(texts), np.uint8)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    seq, at = padded(token, row)
    at = at[targets(row, r, rounds)]
    del row, token
    np.random.default_rng(9 + r).shuffle(at)
    for a in range(0, len(at), STEP):
        here = at[a : a + STEP]
        step(w, np.stack([seq[here + d] for d in _PLACES], axis=1), seq[here], rate / (1 + r))
    return w


def _taught(shared: Broadcast, r: int, rounds: int, rate: float):
    def taught(group: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("tokens", "ascending")])
        own = learned(table.column("tokens").to_pylist(), pickle.loads(shared.value), r, rounds, rate)
        B.release()
        return pa.table({"shard": pa.array([group[0].as_py()]), "n": pa.array([sum(table.column("n").to_pylist())]), "w": pa.array([_flat(own).tobytes()], pa.binary())})

    return taught


def _averaged(group: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by("shard")
    n = table.column("n").to_pylist()
    mean = sum(k * np.frombuffer(raw.as_py(), np.float32).astype(np.float64) for k, raw in zip(n, table.column("w"), strict=True)) / sum(n)
    return pa.table({"shard": pa.array([group[0].as_py()]), "n": pa.array([sum(n)]), "w": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})


def train(df: DataFrame, text: str = "text", rounds: int = ROUNDS, rate: float = 1.0, key: str | None = None) -> Model:
    """The words and the weights, from all texts of df. Without a word, the starting weights.

    Texts go to shards by a hash of the text, and of key if one is named: with a key, copies of one text
    are spread.
    """
    spark, w = df.sparkSession, start()
    small_batches(spark)
    counts = written(count_words(df, text), "words")
    frequent, sizes = vocabulary(counts)
    tokens = written(encoded(df, frequent, text, key), "classes")
    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    shards = max(1, round(total / SHARD))
    dealt = tokens.withColumn("shard", F.pmod("h", F.lit(shards)))
    for r in range(rounds if total else 0):
        shared = spark.sparkContext.broadcast(pickle.dumps(w))

        told, left = dealt.groupBy("shard").applyInArrow(_taught(shared, r, rounds, rate), "shard bigint, n bigint, w binary"), shards
        while left > 1:
            told = told.withColumn("group", F.floor(F.col("shard") / GROUP)).groupBy("group").applyInArrow(_averaged, "shard bigint, n bigint, w binary")
            left = math.ceil(left / GROUP)
        w = _shaped(np.frombuffer(told.collect()[0].w, np.float32))
    return Model(frequent, w, counts, sizes)


def log_probabilities(w: dict[str, np.ndarray], token: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Of each token, given the others of its text."""
    seq, at = padded(token, row)
    by_place = [w["E"] @ w["A"][k] for k in range(len(_PLACES))]
    last = np.vstack([w["O"], w["b"]])
    safe = np.abs(last).sum(axis=0).max() <= _SAFE
    ones, out = np.ones(PAD, np.float32), np.zeros(len(token))
    for a in range(0, len(token), PART):
        here = at[a : a + PART]
        h = np.ones((len(here), DIM + 1), np.float32)
        inner = by_place[0][seq[here + _PLACES[0]]]
        for k in range(1, len(_PLACES)):
            inner += by_place[k][seq[here + _PLACES[k]]]
        np.tanh(inner, out=h[:, :DIM])
        z = h @ last
        if not safe:
            z -= z.max(axis=1, keepdims=True)
        mine = z[np.arange(len(here)), seq[here]]
        out[a : a + PART] = mine - np.log(np.exp(z, out=z) @ ones)
    return out


def score(df: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, log_likelihood (the sum), mean_log_likelihood for each row of df, over its whole text.

    Null, empty and wordless texts have 0 tokens, the sum 0 and a null mean. Equal texts score alike, to
    the last few bits; repeated rows stay; other columns are not read. A text is scored as a whole, however long.

    Texts are dealt to blocks. A block asks for the counts of its rare words, each once; words go by hash to
    the parts where their counts are, and the counts come back to the block, where its texts are then judged.
    """
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(pickle.dumps((model.frequent, model.w)))
    whole = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0)).alias("bytes")).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(least, math.ceil(whole.bytes / BLOCK_BYTES), math.ceil(whole.n / BLOCK_ROWS))
    parts = max(least, math.ceil(blocks / 4))
    docs = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = docs.schema["k"].dataType.simpleString()
    docs = docs.withColumn("block", F.pmod(F.xxhash64("k", "t"), F.lit(blocks))).repartition(blocks, "block")
    frequent, sizes = model.frequent, model.sizes

    def asked(group: tuple, table: pa.Table) -> pa.Table:
        words = np.zeros(0, np.uint64)
        for own, _ in _texts(table.column("t")):
            words = np.union1d(words, own[classes(frequent, own) >= FREQUENT])
        part = (words >> np.uint64(33)).astype(np.int64) % parts
        order = np.argsort(part, kind="stable")
        full, first = np.unique(part[order], return_index=True)
        sent = [x.tobytes() for x in np.split(words[order], first[1:])] if len(full) else []
        B.release()
        return pa.table({"part": pa.array(full.astype(np.int32)), "block": pa.array([group[0].as_py()] * len(full), pa.int64()), "words": pa.array(sent, pa.binary())})

    def answered(asks: pa.Table, counts: pa.Table) -> pa.Table:
        word, n = counts.column("word").to_numpy().view(np.uint64), counts.column("n").to_numpy()
        order = np.argsort(word)
        word, n = np.append(word[order], np.uint64(0)), np.append(n[order], 0)
        out = []
        for raw in asks.column("words"):
            words = np.frombuffer(raw.as_py(), np.uint64)
            at = np.searchsorted(word[:-1], words)
            elsewhere = np.maximum(np.where(word[at] == words, n[at], 0) - 1, 0)
            out.append(np.log((elsewhere + SMOOTH) / sizes[(words >> np.uint64(48)).astype(np.int64) % RARE]).tobytes())
        B.release()
        return pa.table({"block": asks.column("block"), "words": asks.column("words"), "gains": pa.array(out, pa.binary())})

    def judged(docs: pa.Table, answers: pa.Table) -> pa.Table:
        known, w = pickle.loads(shared.value)
        word, gain = (np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in answers.column(c).to_pylist())]) for c, kind in (("words", np.uint64), ("gains", np.float64)))
        order = np.argsort(word)
        word, gain = word[order], gain[order]
        size = docs.num_rows
        n, total, tokens, rows = np.zeros(size, np.int64), np.zeros(size), [np.zeros(0, np.int16)], [np.zeros(0, np.int32)]
        for words, row in _texts(docs.column("t")):
            token = classes(known, words)
            rare = token >= FREQUENT
            n += np.bincount(row, minlength=size)
            total += np.bincount(row[rare], weights=gain[np.searchsorted(word, words[rare])], minlength=size)
            tokens.append(token.astype(np.int16))
            rows.append(row.astype(np.int32))
        row = np.concatenate(rows)
        total += np.bincount(row, weights=log_probabilities(w, np.concatenate(tokens), row), minlength=size)
        del word, gain, tokens, rows, row
        B.release()
        mean = pa.array(total / np.maximum(n, 1), pa.float64(), mask=n == 0)
        return pa.table({"k": docs.column("k"), "n_tokens": pa.array(n), "log_likelihood": pa.array(total), "mean_log_likelihood": mean})

    asks = docs.groupBy("block").applyInArrow(asked, "part int, block bigint, words binary")
    counts = model.counts.withColumn("part", (F.shiftrightunsigned("word", 33) % parts).cast("int"))
    answers = asks.groupBy("part").cogroup(counts.groupBy("part")).applyInArrow(answered, "block bigint, words binary, gains binary").repartition(blocks, "block")
    scored = docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(judged, f"k {kind}, n_tokens bigint, log_likelihood double, mean_log_likelihood double")
    return scored.withColumnRenamed("k", key)
