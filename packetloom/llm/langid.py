"""Language ID: averaged hashed subword embeddings under a linear softmax, with calibrated rejection."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.llm import _bytes as B

UNKNOWN = "und"
_SIZES = (3, 4, 5)
_ASCII_LETTER = np.isin(np.arange(256), list(range(65, 91)) + list(range(97, 123)))


def subwords(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 3- to 5-byte subwords of each text, and len + 1 bounds into them.

    Letters are in lower case and all else counts as one space; a subword may begin or end with a
    space, which marks the edge of a word, and has none inside.
    """
    x = B.LETTERS[data].astype(np.uint64)
    space = x == 32
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    found, where = [], []
    for n in _SIZES:
        if len(x) < n:
            continue
        m = len(x) - n + 1
        good = text[:m] == text[n - 1 :]
        for j in range(1, n - 1):
            good &= ~space[j : j + m]
        value = np.full(m, n, np.uint64)
        for j in range(n):
            value = (value << np.uint64(8)) | x[j : j + m]
        at = np.flatnonzero(good)
        found.append((value[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits))
        where.append(text[at])
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    where_all = np.concatenate(where)
    order = np.argsort(where_all, kind="stable")
    return np.concatenate(found)[order].astype(np.int64), np.searchsorted(where_all[order], np.arange(len(offsets)))


def has_letter(text: np.ndarray) -> bool:
    """Whether UTF-8 bytes hold a letter of any script, as str.isalpha tells it."""
    return bool(_ASCII_LETTER[text].any()) or any(map(str.isalpha, text.tobytes().decode("utf-8", "replace")))


@dataclass
class LangModel:
    langs: list[str]
    table: np.ndarray  #: bucket -> logits: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float
    bits: int

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A text longer than a piece is averaged over the subwords of all its pieces."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        for i, j in B.runs(offsets):
            part = data[offsets[i] : offsets[j]]
            total, n = np.zeros((j - i, len(self.langs))), np.zeros(j - i)
            for piece in B.pieces(part) if j - i == 1 else (part,):
                local = np.array([0, len(piece)]) if j - i == 1 else offsets[i : j + 1] - offsets[i]
                bucket, bounds = subwords(piece, local, self.bits)
                total += B.segment_sums(self.table[bucket], bounds)
                n += np.diff(bounds)
            out[i:j] = total / np.maximum(n, 1)[:, None] + self.bias
        return out

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return _softmax(self.logits(data, offsets) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(samples: list[tuple[np.ndarray, np.ndarray, str]], bits: int, dim: int = 16, epochs: int = 6, rate: float = 1.0, target_precision: float = 0.99, seed: int = 7) -> LangModel:
    """samples: (bucket, count, lang) of a text each. A fifth of them calibrates and trains nothing.

    The temperature minimises the calibration part's log loss; the threshold is the least probability
    above which its predictions are right in target_precision of the cases.
    """
    rng = np.random.default_rng(seed)
    langs = sorted({lang for _, _, lang in samples})
    if not langs:
        return LangModel([UNKNOWN], np.zeros((1 << bits, 1), np.float32), np.zeros(1), 1.0, 0.0, bits)
    want = {lang: k for k, lang in enumerate(langs)}
    order = rng.permutation(len(samples))
    held = len(samples) // 5
    calibrating, training = order[:held], order[held:]
    E = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
    W, bias = rng.normal(0, 0.1, (dim, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    steps, step = max(1, epochs * len(training)), 0
    for _ in range(epochs):
        for k in rng.permutation(training):
            bucket, count, lang = samples[k]
            step += 1
            if not len(bucket):
                continue
            share = (count / count.sum()).astype(np.float32)
            average = share @ E[bucket]
            gap = _softmax(average @ W + bias)
            gap[want[lang]] -= 1
            lr = np.float32(rate * (1 - step / steps))
            back = W @ gap
            W -= lr * np.outer(average, gap)
            bias -= lr * np.float32(0.1) * gap
            # a bucket's share is small, so its step is scaled by the square root of their number
            E[bucket] -= lr * np.sqrt(np.float32(len(bucket))) * np.outer(share, back)
    model = LangModel(langs, (E @ W).astype(np.float32), bias.astype(np.float64), 1.0, 0.0, bits)
    scored = [(np.average(model.table[b], axis=0, weights=c) + model.bias, want[lang]) for b, c, lang in (samples[k] for k in calibrating) if len(b)]
    if scored and len(langs) > 1:
        z, y = np.array([s[0] for s in scored]), np.array([s[1] for s in scored])
        rows = np.arange(len(y))
        grid = np.geomspace(0.05, 20, 60)
        model.temperature = float(min(grid, key=lambda t: -np.log(_softmax(z / t)[rows, y] + 1e-12).mean()))
        p = _softmax(z / model.temperature)
        top, right = p.max(axis=1), p.argmax(axis=1) == y
        down = np.argsort(-top, kind="stable")
        precision = np.cumsum(right[down]) / (rows + 1)
        fine = np.flatnonzero(precision >= target_precision)
        model.threshold = float(top[down][fine[-1]]) if len(fine) else 1.0
    return model


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 600, most_rows: int = 40_000, bits: int = 15) -> LangModel:
    """A model of the rows of df whose lang is not null.

    The bound of the sample: at most per_lang rows of each language teach it, and most_rows of all: those
    whose key has the least xxhash64 among about four times as many, drawn by that hash. Only their
    subword counts come to the driver, at most 2 ** bits for a row however long its text.
    """
    known = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(lang).alias("_lang"))
    sizes = known.groupBy("_lang").agg(F.count("*").alias("_n"))
    n = sizes.count()
    per_lang = max(1, min(per_lang, most_rows // max(1, n)))
    sizes = F.broadcast(sizes) if n <= most_rows else sizes
    # a language may have a third of all rows: few of them are ranked, all others go before the shuffle
    drawn = known.join(sizes, "_lang").where((F.xxhash64("_key") * F.lit(2.0**-64) + 0.5) * F.col("_n") <= 4 * per_lang)
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.xxhash64("_key"), "_key"))
    chosen = drawn.withColumn("_rank", rank).where(F.col("_rank") <= per_lang).select("_key").distinct()
    rows = df.where(F.col(lang).isNotNull()).select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key", "left_semi")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.column_bytes(batch.column("_text"), lower=True)
            buckets, counts = [], []
            for i in range(batch.num_rows):
                n = np.zeros(1 << bits, np.int64)
                for piece in B.pieces(data[offsets[i] : offsets[i + 1]]):
                    n += np.bincount(subwords(piece, np.array([0, len(piece)]), bits)[0], minlength=1 << bits)
                full = np.flatnonzero(n)
                buckets.append(full.astype(np.uint32).tobytes())
                counts.append(n[full].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("_key").cast(pa.string()), batch.column("_lang"), pa.array(buckets, pa.binary()), pa.array(counts, pa.binary())], ["key", "lang", "bucket", "n"])

    got = rows.mapInArrow(counted, "key string, lang string, bucket binary, n binary").collect()
    got.sort(key=lambda r: (r.lang, r.key or "", bytes(r.bucket)))
    return fit([(np.frombuffer(r.bucket, np.uint32).astype(np.int64), np.frombuffer(r.n, np.float32), r.lang) for r in got], bits)


def identify(df: DataFrame, model: LangModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and lang_pred, score, accepted for each row of df.

    lang_pred is the likeliest language and score its calibrated probability; accepted is false where
    the score is under the model's threshold, for those who would rather have no answer. A text that
    is null or has no letter is "und" with score 0 and not accepted. Repeated rows stay; other columns
    are not read.
    """
    spark: SparkSession = df.sparkSession
    shared = spark.sparkContext.broadcast(pickle.dumps(model))
    wanted = df.select(*[F.col(c).alias(f"k_{c}") for c in keep], F.col(text).cast("string").alias("t"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields if f.name != "t")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LangModel = pickle.loads(shared.value)
        for batch in batches:
            data, offsets = B.column_bytes(batch.column("t"), lower=True)
            p = m.probabilities(data, offsets)
            lettered = np.array([has_letter(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], bool)
            best = p.argmax(axis=1) if len(p) else np.zeros(0, int)
            score = np.where(lettered, p[np.arange(len(p)), best], 0.0)
            names = [m.langs[k] if good else UNKNOWN for k, good in zip(best, lettered, strict=True)]
            kept = [batch.column(c) for c in batch.schema.names if c != "t"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(lettered & (score >= m.threshold), pa.bool_())], [*[c for c in batch.schema.names if c != "t"], "lang_pred", "score", "accepted"])

    out = wanted.mapInArrow(judged, f"{fields}, lang_pred string, score double, accepted boolean")
    return out.select(*[F.col(f"k_{c}").alias(c) for c in keep], "lang_pred", "score", "accepted")
