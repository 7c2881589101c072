"""Toxicity: a convolutional classifier over hashed word embeddings, trained in numpy.

A word is the sum of two embeddings: of its own hash and of the hash of its first bytes, so that forms
of one stem share what is learnt. Filters of several widths slide over the words, the maximum of each
over the text goes through a linear layer. It learns from all labelled texts, on shards by hash whose
weights are averaged. Words and stems in few of the texts have no embedding, and embeddings decay, so
that no rare word decides. The logit is then calibrated for the language of the text,
told by its stop words, so that one score means the same in each.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm import _bytes as B
from packetloom.llm._shared import forgotten, small_batches, written
from packetloom.llm.lm import GROUP, _averaged

WIDTHS = (1, 2, 3)
STEM_BYTES = 5
DIM, FILTERS = 12, 6
#: Bytes of the texts of a shard, texts of one gradient step, the steps that a shard should take over all epochs, and the fewest and most epochs.
SHARD, BATCH, STEPS, EPOCHS = 12 << 20, 64, 300, (3, 10)
#: Words of a long text taken at a time.
PART = 1 << 16

# Frequent function words by language.
STOP_WORDS = {
    "de": "der die das und ist nicht ein eine den dem von zu mit auf sich des im für auch es",
    "en": "the of and to in is that it was for on with as be at by this from or an",
    "es": "el la de que y en un una los las del se por con no su para es al lo",
    "fr": "le la les de des et un une du en est que dans pour sur pas au avec qui il",
}


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word (A-Z lower-cased), hash of its first STEM_BYTES, len + 1 bounds by text."""
    low = B.LOWER[data]
    start, end, bounds = B.word_spans(low, offsets)
    sums = B.prefix_hash(low)
    stem_end = np.minimum(end, start + STEM_BYTES)
    return B.range_hash(sums, start, end), B.range_hash(sums, start, stem_end) ^ np.uint64(0xA5A5A5A5), bounds


def _stop_table() -> tuple[np.ndarray, np.ndarray, list[str]]:
    langs = sorted(STOP_WORDS)
    owner: dict[int, np.ndarray] = {}
    for k, lang in enumerate(langs):
        for word in STOP_WORDS[lang].split():
            raw = np.frombuffer(word.encode(), np.uint8)
            h = int(hashed_words(raw, np.array([0, len(raw)]))[0][0])
            owner.setdefault(h, np.zeros(len(langs), np.float32))[k] = 1
    keys = np.array(sorted(owner), np.uint64)
    return keys, np.array([owner[int(k)] for k in keys]), langs


def _lookup(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """1 + the index of each h in sorted keys, 0 where it is absent."""
    if not len(keys):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at + 1, 0)


@dataclass
class ToxicModel:
    words: np.ndarray  #: sorted hashes with an embedding; row 0 of tables is any other word
    stems: np.ndarray
    word_maps: list[np.ndarray] = field(default_factory=list)  #: per width and offset, row -> filters
    stem_maps: list[np.ndarray] = field(default_factory=list)
    bias: list[np.ndarray] = field(default_factory=list)  #: per width
    out: np.ndarray | None = None
    out_bias: float = 0.0
    scale: dict[str, tuple[float, float]] = field(default_factory=dict)  #: by language, "" for any other

    def pooled(self, w: np.ndarray, s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Maximum of each filter over each text; texts are padded, so that one word is enough."""
        n, parts, k = len(bounds) - 1, [], 0
        for width, bias in zip(WIDTHS, self.bias, strict=True):
            total = np.broadcast_to(bias, (len(w), len(bias))).copy()
            for j in range(width):
                add = self.word_maps[k][w] + self.stem_maps[k][s]
                total[: len(w) - j] += add[j:]
                k += 1
                if j:  # what stands beyond the end of a text is padding
                    for back in range(1, j + 1):
                        edge = bounds[1:] - back
                        edge = edge[(edge >= bounds[:-1]) & (edge + j < len(w))]
                        total[edge] -= add[edge + j]
            parts.append(B.segment_max(np.maximum(total, 0), bounds, 0.0))
        return np.concatenate(parts, axis=1) if n else np.zeros((0, sum(len(b) for b in self.bias)))

    def logit_of(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.out + self.out_bias

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """Of each text, before calibration, and its language by stop words."""
        stop_keys, stop_of, langs = _stop_table()
        stop_of = np.vstack([np.zeros(len(langs), np.float32), stop_of])
        rows = len(offsets) - 1
        logit, group = np.zeros(rows), []
        for i, j in B.runs(offsets):
            part = data[offsets[i] : offsets[j]]
            best, seen = None, np.zeros((j - i, len(langs)))
            for piece in B.pieces(part, max(WIDTHS) - 1) if j - i == 1 else (part,):
                local = np.array([0, len(piece)]) if j - i == 1 else offsets[i : j + 1] - offsets[i]
                w, s, bounds = hashed_words(piece, local)
                got = self.pooled(_lookup(self.words, w), _lookup(self.stems, s), bounds)
                best = got if best is None else np.maximum(best, got)
                seen += B.segment_sums(stop_of[_lookup(stop_keys, w)], bounds)
            logit[i:j] = self.logit_of(best)
            group += [langs[k] if v[k] > 0 else "" for v, k in zip(seen, seen.argmax(axis=1), strict=True)]
        return logit, group

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str]]:
        logit, group = self.logits(data, offsets)
        slope = np.array([self.scale.get(g, self.scale[""]) for g in group]).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(slope[:, 0] * logit + slope[:, 1], -40, 40))), group


def vocabulary(labelled: DataFrame, n: int, min_docs: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words and the stems that have an embedding: those in min_docs, and 1 in 400, of the n texts to train on, or more."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]]
            for w, s in _words(batch.column("_text")):
                found[0].append(np.unique(w))
                found[1].append(np.unique(s))
            for stem, own in enumerate(found):
                keys, docs = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), stem == 1)), pa.array(keys.view(np.int64)), pa.array(docs.astype(np.int64))], ["stem", "h", "n"])
        B.release()

    least = max(min(min_docs, max(1, n // 20)), n // 400)
    counts = labelled.where("not held").select("_text").mapInArrow(counted, "stem boolean, h bigint, n bigint").groupBy("stem", "h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    rows = counts.select("stem", "h").collect()
    words, stems = (np.sort(np.array([r.h for r in rows if r.stem is kind], np.int64).view(np.uint64)) for kind in (False, True))
    return words, stems


def _words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words and the stems of each text, however long."""
    data, offsets = B.column_bytes(column, lower=True)
    for i in range(len(column)):
        parts = [hashed_words(piece, np.array([0, len(piece)]))[:2] for piece in B.pieces(data[offsets[i] : offsets[i + 1]])]
        yield np.concatenate([w for w, _ in parts]), np.concatenate([s for _, s in parts])


def encoded(texts: DataFrame, words: np.ndarray, stems: np.ndarray) -> DataFrame:
    """h, y, n, tokens of each text: the number of its words, and these and their stems as rows of the tables."""
    kind = _kind(words, stems)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.stack([_lookup(words, w), _lookup(stems, s)]).astype(kind) for w, s in _words(batch.column("_text"))]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("y"), pa.array([x.shape[1] for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["h", "y", "n", "tokens"])
        B.release()

    return texts.select("h", "y", "_text").mapInArrow(coded, "h bigint, y int, n bigint, tokens binary")


def _kind(words: np.ndarray, stems: np.ndarray) -> type:
    return np.uint16 if max(len(words), len(stems)) < 1 << 16 else np.uint32


def _packed(group: tuple, table: pa.Table) -> pa.Table:
    """A shard as one row: labels, numbers of words and tokens of its texts end to end, in an order of their own."""
    table = table.sort_by([("h", "ascending"), ("tokens", "ascending"), ("y", "ascending")])
    y, n = table.column("y").to_numpy().astype(np.int8), table.column("n").to_numpy()
    out = pa.table({"shard": pa.array([group[0].as_py()], pa.int64()), "y": pa.array([y.tobytes()], pa.binary()), "n": pa.array([n.tobytes()], pa.binary()), "tokens": pa.array([b"".join(x.as_py() for x in table.column("tokens"))], pa.binary())})
    B.release()
    return out


def start(n_words: int, n_stems: int, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {"E": rng.normal(0, 0.05, (n_words + 1, DIM)), "S": rng.normal(0, 0.05, (n_stems + 1, DIM)), "o": rng.normal(0, 0.3, len(WIDTHS) * FILTERS), "c": np.zeros(1)}
    p |= {f"K{width}": rng.normal(0, 0.5, (width, DIM, FILTERS)) for width in WIDTHS} | {f"b{width}": np.zeros(FILTERS) for width in WIDTHS}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["E"][0] = p["S"][0] = 0
    return p


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _tops(p: dict[str, np.ndarray], w: np.ndarray, s: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each width, where each filter is greatest over the text, and all those maxima; PART words at a time."""
    top, best = [np.zeros(FILTERS, np.int64) for _ in WIDTHS], np.full((len(WIDTHS), FILTERS), -np.inf, np.float32)
    for a in range(0, len(w), PART):
        b = min(len(w), a + PART)
        x = p["E"][w[a : b + WIDTHS[-1] - 1]] + p["S"][s[a : b + WIDTHS[-1] - 1]]
        for k, width in enumerate(WIDTHS):
            total = np.broadcast_to(p[f"b{width}"], (b - a, FILTERS)).copy()
            for j in range(width):
                add = x[j : j + b - a] @ p[f"K{width}"][j]
                total[: len(add)] += add
            at = total.argmax(axis=0)
            most = total[at, np.arange(FILTERS)]
            top[k] = np.where(most > best[k], a + at, top[k])
            best[k] = np.maximum(best[k], most)
    return top, best.ravel()


def learned(rows: list[tuple[np.ndarray, np.ndarray, int]], p: dict[str, np.ndarray], epoch: int, epochs: int, weight: tuple[float, float], rate: float = 0.02) -> dict[str, np.ndarray]:
    """The weights after an epoch over all rows (words, stems, label): Adam on the log loss, the two classes weighted alike."""
    p = {k: v.copy() for k, v in p.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    mixed = np.random.default_rng(29 + epoch).permutation(len(rows))
    for a in range(0, len(mixed), BATCH):
        g = {k: np.zeros_like(v) for k, v in p.items()}
        batch = mixed[a : a + BATCH]
        for k in batch:
            w, s, y = rows[k]
            if not len(w):
                continue
            top, pre = _tops(p, w, s)
            h = np.maximum(pre, 0)
            gap = (1 / (1 + np.exp(-np.clip(h @ p["o"] + p["c"][0], -40, 40))) - y) * weight[y] / len(batch)
            g["o"] += gap * h
            g["c"] += gap
            back = (gap * p["o"] * (pre > 0)).reshape(len(WIDTHS), FILTERS)
            for n, width in enumerate(WIDTHS):
                g[f"b{width}"] += back[n]
                for j in range(width):
                    live = top[n] + j < len(w)
                    at = top[n][live] + j
                    x = p["E"][w[at]] + p["S"][s[at]]
                    g[f"K{width}"][j][:, live] += (x * back[n][live, None]).T
                    dx = back[n][live, None] * p[f"K{width}"][j][:, live].T
                    np.add.at(g["E"], w[at], dx)
                    np.add.at(g["S"], s[at], dx)
        # a text without a word, of class 0, with each batch
        g["c"] += 4 / len(batch) / (1 + np.exp(-p["c"][0]))
        g["E"][0] = g["S"][0] = 0
        step += 1
        lr = rate * (1 - 0.9 * epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for k, v in g.items():
            first[k] += 0.1 * (v - first[k])
            second[k] += 0.001 * (v * v - second[k])
            p[k] -= lr * first[k] / (np.sqrt(second[k]) + 1e-7)
            if k in "ES":
                p[k] *= 1 - 0.05 * rate
    return p


def _taught(shared: Broadcast, kind: type, *how):
    def taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, y, n, tokens in (row for batch in batches for row in zip(*(batch.column(c) for c in ("shard", "y", "n", "tokens")), strict=True)):
            size = np.frombuffer(n.as_py(), np.int64)
            parts = np.split(np.frombuffer(tokens.as_py(), kind), np.cumsum(2 * size)[:-1])
            rows = [(*x.reshape(2, -1), int(label)) for x, label in zip(parts, np.frombuffer(y.as_py(), np.int8), strict=True)]
            own = learned(rows, pickle.loads(shared.value), *how)
            yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()]), pa.array([len(rows)]), pa.array([_flat(own).tobytes()], pa.binary())], ["shard", "n", "w"])
            del rows, parts, own
            B.release()

    return taught


def built(words: np.ndarray, stems: np.ndarray, p: dict[str, np.ndarray]) -> ToxicModel:
    """The model of the weights, without calibration."""
    model = ToxicModel(words, stems, bias=[p[f"b{width}"] for width in WIDTHS], out=p["o"], out_bias=float(p["c"][0]), scale={"": (1.0, 0.0)})
    for width in WIDTHS:
        for j in range(width):
            model.word_maps.append(p["E"] @ p[f"K{width}"][j])
            model.stem_maps.append(p["S"] @ p[f"K{width}"][j])
    return model


def calibrate(model: ToxicModel, logit: np.ndarray, y: np.ndarray, group: np.ndarray, threshold: float = 0.7) -> None:
    """For each language with enough texts of both classes a slope and an intercept put the best cut between the classes at the score threshold; others share a common one."""
    # texts without a word, a tenth as many as there are clean ones, count as clean for every language
    blank = lambda labels: max(2, int((labels == 0).sum()) // 10)
    with_blank = lambda z, labels: (np.append(z, np.full(blank(labels), model.out_bias)), np.append(labels, np.zeros(blank(labels), int)))
    model.scale[""] = _cut(*with_blank(logit, y), threshold) or (1.0, float(np.log(threshold / (1 - threshold))))
    for lang in sorted(set(group) - {""}):
        if found := _cut(*with_blank(logit[group == lang], y[group == lang]), threshold):
            model.scale[lang] = found


def _cut(logit: np.ndarray, y: np.ndarray, threshold: float, least: int = 5) -> tuple[float, float] | None:
    """Slope and intercept that score threshold at the best cut; None with under least of a class."""
    if min((y == 0).sum(), (y == 1).sum()) < least:
        return None
    cuts = np.unique(logit)
    if len(cuts) > 1:
        cuts = (cuts[1:] + cuts[:-1]) / 2
    # a false alarm weighs as three misses; of equal cuts the middle one
    clean, toxic = np.sort(logit[y == 0]), np.sort(logit[y == 1])
    wrong = 3 * (1 - np.searchsorted(clean, cuts) / len(clean)) + np.searchsorted(toxic, cuts) / len(toxic)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    cut = float(cuts[best[len(best) // 2]])
    spread = max(1e-3, float(np.abs(logit - cut).mean()))
    slope = 4.0 / spread
    return slope, float(np.log(threshold / (1 - threshold))) - slope * cut


def _known(marks: DataFrame, others: DataFrame) -> tuple[np.ndarray, int, np.ndarray]:
    """What tells the key of marks from that of others by a hash, h, of each: bits, set for each mark, how many, and the sorted hashes of others whose bit is set too, about 1 in 16."""
    bits = 1 << max(20, (16 * marks.count()).bit_length())
    slot = F.col("h").bitwiseAND(F.lit(bits - 1))

    def packed(group: tuple, table: pa.Table) -> pa.Table:
        own = np.zeros(1 << 19, np.uint8)
        own[table.column("at").to_numpy()] = 1
        return pa.table({"block": pa.array([group[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(own).tobytes()], pa.binary())})

    known = np.zeros(bits >> 3, np.uint8)
    for r in marks.select(F.shiftright(slot, 19).alias("block"), slot.bitwiseAND(F.lit((1 << 19) - 1)).alias("at")).groupBy("block").applyInArrow(packed, "block bigint, bits binary").collect():
        known[r.block << 16 : (r.block + 1) << 16] = np.frombuffer(r.bits, np.uint8)
    shared = others.sparkSession.sparkContext.broadcast(known)

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_set(shared.value, bits, batch.column("h").to_numpy())))

    wrong = others.select("h").mapInArrow(picked, "h bigint").distinct().join(marks, "h", "left_anti").toArrow().column("h").to_numpy()
    shared.unpersist()
    return known, bits, np.sort(wrong)


def _set(known: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    slot = h & (bits - 1)
    return (known[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)


def _among(found: tuple[np.ndarray, int, np.ndarray], h: np.ndarray) -> np.ndarray:
    """Which h of marks or others, as _known() has seen them, are of marks."""
    known, bits, wrong = found
    return _set(known, bits, h) & (_lookup(wrong, h) == 0)


def labelled(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """h, y, held, _text of every row of docs with a text and a label; held: the fifth, by a hash of key and text, that calibrates and trains nothing.

    A key labelled more than once is toxic if one label says so. Only hashes of keys are joined and shuffled (of
    a whole number the hash is one to one); each text finds its label where it lies.
    """
    kind = docs.schema[key].dataType
    marks = labels.select(F.col(key).cast(kind).alias("_key"), F.col(label).alias("_y")).where("_key is not null and _y is not null")
    marks = written(marks.groupBy(F.xxhash64("_key").alias("h")).agg((F.max("_y") > 0).cast("int").alias("y")), "marks")
    known = _known(marks.select("h"), docs.where(F.col(key).isNotNull()).select(F.xxhash64(F.col(key)).alias("h")))
    toxic = _known(marks.where("y = 1").select("h"), marks.where("y = 0").select("h"))
    forgotten(marks)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps((known, toxic)))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, toxic = pickle.loads(shared.value)
        for batch in batches:
            own = batch.filter(pa.array(_among(known, batch.column("k").to_numpy())))
            y = _among(toxic, own.column("k").to_numpy()).astype(np.int32)
            yield pa.RecordBatch.from_arrays([own.column("h"), pa.array(y), own.column("_text")], ["h", "y", "_text"])

    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).where("_key is not null and _text is not null")
    some = rows.select(F.xxhash64("_key").alias("k"), F.xxhash64("_key", "_text").alias("h"), "_text").mapInArrow(picked, "h bigint, y int, _text string")
    return some.select("h", "y", (F.pmod(F.xxhash64("h"), F.lit(5)) == 0).alias("held"), "_text")


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> ToxicModel:
    """A model of all labelled rows: docs joined with labels on key, labels (0 or 1) from the latter, whole texts.

    Texts are dealt by a hash to shards of about SHARD bytes each. In each epoch each shard starts from the
    same weights and learns from all its texts; the weights of all shards are averaged by texts, in groups
    on the executors. There are as many epochs as give a shard about STEPS batches, within EPOCHS. Nothing
    depends on how the input lies in files or tasks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = written(labelled(docs, labels, text, key, label), "labelled")
    size = texts.where("not held").agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("toxic"), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("bytes")).first()
    words, stems = vocabulary(texts, size.n)
    shards = max(1, round(size.bytes / SHARD))
    tokens = encoded(texts.where("not held"), words, stems)
    dealt = written(tokens.groupBy(F.pmod("h", F.lit(shards)).alias("shard")).applyInArrow(_packed, "shard bigint, y binary, n binary, tokens binary"), "shards")
    epochs = min(EPOCHS[1], max(EPOCHS[0], math.ceil(STEPS * BATCH * shards / max(1, size.n))))
    weight = (size.n / max(1, 2 * (size.n - size.toxic)), size.n / max(1, 2 * size.toxic))
    p = start(len(words), len(stems))
    for epoch in range(epochs if size.n else 0):
        shared = spark.sparkContext.broadcast(pickle.dumps(p))
        told, left = dealt.mapInArrow(_taught(shared, _kind(words, stems), epoch, epochs, weight), "shard bigint, n bigint, w binary"), math.ceil(shards / GROUP)
        told = told.groupBy(F.floor(F.col("shard") / GROUP).alias("group")).applyInArrow(_averaged, "shard bigint, n bigint, w binary")
        while left > 1:
            told = told.groupBy(F.floor(F.col("shard") / GROUP).alias("group")).applyInArrow(_averaged, "shard bigint, n bigint, w binary")
            left = math.ceil(left / GROUP)
        p = _shaped(np.frombuffer(told.collect()[0].w, np.float32), p)
        shared.unpersist()
    forgotten(dealt)
    model = built(words, stems, p)
    shared = spark.sparkContext.broadcast(pickle.dumps(model))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(shared.value)
        for batch in batches:
            logit, group = m.logits(*B.column_bytes(batch.column("_text"), lower=True))
            yield pa.RecordBatch.from_arrays([pa.array(logit, pa.float64()), batch.column("y"), pa.array(group, pa.string())], ["logit", "y", "lang"])
        B.release()

    told = texts.where("held").select("y", "_text").mapInArrow(judged, "logit double, y int, lang string").toArrow().sort_by([("logit", "ascending"), ("y", "ascending"), ("lang", "ascending")])
    calibrate(model, *(told.column(c).to_numpy() for c in ("logit", "y", "lang")))
    forgotten(texts)
    return model


def score(df: DataFrame, model: ToxicModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.7) -> DataFrame:
    """keep and score, predicted, lang_group for each row of df, from its whole text alone.

    score: 0 to 1, higher where the label 1 is likelier; predicted: 1 if it is at least threshold.
    A null or empty text, or one without a word, gets the score of no filter firing. Repeated rows
    stay; other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    wanted = df.select(F.col(text).cast("string").alias("t"), *[F.col(c).alias(f"k_{c}") for c in keep if c != text])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields)
    shown = text in keep

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ToxicModel = pickle.loads(shared.value)
        for batch in batches:
            p, group = m.scores(*B.column_bytes(batch.column("t"), lower=True))
            t = batch.column("t") if shown else pa.nulls(batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([t, *batch.columns[1:], pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32)), pa.array(group, pa.string())], [*batch.schema.names, "score", "predicted", "lang_group"])

    out = wanted.mapInArrow(judged, f"{fields}, score double, predicted int, lang_group string")
    return out.select(*[F.col("t" if c == text else f"k_{c}").alias(c) for c in keep], "score", "predicted", "lang_group")
