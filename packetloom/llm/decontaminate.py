"""Benchmark decontamination: BM25 over an inverted index of test items, by block-max WAND."""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from packetloom.llm import _bytes as B
from packetloom.llm.toxicity import hashed_words

K1, BODY = 1.2, 0.75
SHINGLE = 5
#: Share of an item's score that its essential terms have; where a threshold asks for more, MARGIN above 1 less it.
ESSENTIAL, MARGIN = 0.6, 0.1
#: Postings of a term in one block.
BLOCK = 64
#: Text of test items in one index, which is broadcast; more items make more indexes, used in turn.
INDEX_BYTES = 16 << 20
_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the last sentence or line with a word is the answer; of a single one, both are the whole."""
    parts = [p for p in _SENTENCE.split(text.strip()) if any(c.isalnum() for c in p)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def _words(text: str) -> np.ndarray:
    raw, offsets = B.column_bytes(pa.array([text]), lower=True)
    return hashed_words(raw, offsets)[0]


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        h = B.mixed(h * np.uint64(31) + words[j : len(words) - n + 1 + j])
    return h


@dataclass
class Index:
    ids: list[int]
    terms: np.ndarray  #: sorted word hashes
    postings: list[tuple[list[int], list[float], list[float]]]  #: per term: items, their share, the most in each block
    upper: np.ndarray  #: per term, the most share in any item; 0 first, for words in no item
    parts: list[tuple[tuple[int, frozenset], tuple[int, frozenset]]]  #: per item: question, answer as (n, hashes of n words)
    window: int  #: words of a passage: twice the longest item
    #: Essential terms of items: bounds by term (0 for words in no item), then item and share.
    essential: tuple[np.ndarray, np.ndarray, np.ndarray]
    essential_share: np.ndarray  #: per item

    def need(self, threshold: float) -> np.ndarray:
        """What a passage must have of an item's essential terms to reach threshold with all others."""
        return self.essential_share - (1 - threshold)


def build(items: list[tuple[int, str]], threshold: float = 0.7) -> Index:
    """Scores are shares of the item's score against itself, so one threshold serves all items. It serves thresholds from this one on."""
    enough = max(ESSENTIAL, 1 - threshold + MARGIN)
    items = [(i, t, w) for i, t in items if t is not None and len(w := _words(t))]
    n = len(items)
    average = sum(len(w) for _, _, w in items) / max(1, n)
    seen: dict[int, list[tuple[int, int, int]]] = {}
    lengths: dict[int, int] = {}
    for k, (_, t, w) in enumerate(items):
        raw, offsets = B.column_bytes(pa.array([t]), lower=True)
        start, end, _ = B.word_spans(raw, offsets)
        lengths |= zip(w.tolist(), (end - start).tolist(), strict=True)
        for term, tf in zip(*np.unique(w, return_counts=True), strict=True):
            seen.setdefault(int(term), []).append((k, int(tf), len(w)))
    weight = {t: [(k, math.log(1 + (n - len(p) + 0.5) / (len(p) + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - BODY + BODY * size / average))) for k, tf, size in p] for t, p in seen.items()}
    whole = [0.0] * n
    for p in weight.values():
        for k, x in p:
            whole[k] += x
    terms = sorted(weight)
    postings = []
    for t in terms:
        docs, shares = [k for k, _ in weight[t]], [x / whole[k] for k, x in weight[t]]
        postings.append((docs, shares, [max(shares[a : a + BLOCK]) for a in range(0, len(shares), BLOCK)]))

    # an item's rarest terms, by items and then by length, until they are enough of its score
    by_item: list[list[tuple[int, int, int, float]]] = [[] for _ in items]
    for k, t in enumerate(terms):
        for item, share in zip(postings[k][0], postings[k][1], strict=True):
            by_item[item].append((len(postings[k][0]), -lengths[t], k + 1, share))
    entries, essential_share = [], np.zeros(n)
    for item, own in enumerate(by_item):
        for _, _, k, share in sorted(own):
            entries.append((k, item, share))
            essential_share[item] += share
            if essential_share[item] >= enough:
                break
    entries.sort()
    pointer = np.searchsorted(np.array([e[0] for e in entries], np.int64), np.arange(len(terms) + 2))
    essential = (pointer, np.array([e[1] for e in entries], np.int64), np.array([e[2] for e in entries]))

    def part(text: str) -> tuple[int, frozenset]:
        w = _words(text)
        size = max(1, min(SHINGLE, len(w)))
        return size, frozenset(_grams(w, size).tolist())

    return Index([i for i, _, _ in items], np.array(terms, np.uint64), postings, np.array([0.0, *(max(p[1]) for p in postings)]), [tuple(part(x) for x in split_item(t)) for _, t, _ in items], 2 * max([SHINGLE, *(len(w) for _, _, w in items)]), essential, essential_share)


def block_max_wand(index: Index, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """All items whose score against the query terms (indexes, no repeats) is threshold or more."""
    cursors = [[index.postings[t][0][0], 0, t] for t in terms]  # item, place, term
    found, end = [], len(index.ids)
    while cursors:
        cursors.sort()
        total, pivot = 0.0, -1
        for k, (_, _, t) in enumerate(cursors):
            total += index.upper[t + 1]
            if total >= threshold - 1e-9:
                pivot = k
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        # the most that the blocks around this item allow
        bound, step = 0.0, end
        for c in cursors[: pivot + 1]:
            docs, _, most = index.postings[c[2]]
            at = bisect_left(docs, item, c[1])
            block = at // BLOCK
            if at < len(docs):
                bound += most[block]
                step = min(step, docs[min(len(docs), (block + 1) * BLOCK) - 1] + 1)
        if pivot + 1 < len(cursors):
            step = min(step, cursors[pivot + 1][0])
        if bound < threshold - 1e-9:
            target = max(step, item + 1)
        else:
            target, score = item + 1, 0.0
            for c in cursors[: pivot + 1]:
                docs, shares, _ = index.postings[c[2]]
                at = bisect_left(docs, item, c[1])
                if at < len(docs) and docs[at] == item:
                    score += shares[at]
            if score >= threshold - 1e-9:
                found.append((item, score))
        alive = []
        for k, c in enumerate(cursors):
            if k <= pivot:
                docs = index.postings[c[2]][0]
                c[1] = bisect_left(docs, target, c[1])
                if c[1] == len(docs):
                    continue
                c[0] = docs[c[1]]
            alive.append(c)
        cursors = alive
    return found


def _lookup(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at + 1, 0)


def passages_at_bound(index: Index, term: np.ndarray, bounds: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
    """(text, first word, last + 1) of the passages that could score threshold with some item.

    Passages are index.window words, each half of them in two. Every passage is judged by an upper
    bound for each item: what it has of the item's essential terms, and all the rest of the item.
    """
    half, n_terms = index.window // 2, len(index.terms) + 1
    sizes = np.diff(bounds)
    parts = np.maximum(1, -(-sizes // half))
    first_part = np.concatenate([[0], np.cumsum(parts)])
    at = np.flatnonzero(index.essential[0][term + 1] > index.essential[0][term])
    text = np.searchsorted(bounds, at, "right") - 1
    number = (at - bounds[text]) // half
    # a part is the first half of its passage, unless it ends a longer text, and the second of the one before
    own = (number + 1 < parts[text]) | (number == 0)
    passage = np.concatenate([(first_part[text] + number)[own], (first_part[text] + number - 1)[number > 0]])
    key = np.unique(passage * n_terms + np.concatenate([term[at][own], term[at][number > 0]]))
    passage, term = key // n_terms, key % n_terms
    pointer, item, share = index.essential
    count = pointer[term + 1] - pointer[term]
    where = np.repeat(pointer[term], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    pair = np.repeat(passage, count) * len(index.ids) + item[where]
    order = np.argsort(pair, kind="stable")
    pair, new = pair[order], np.concatenate([[True], pair[order][1:] != pair[order][:-1]]) if len(pair) else np.zeros(0, bool)
    edge = np.flatnonzero(new)
    if not len(edge):
        return []
    total = np.add.reduceat(share[where][order], edge)
    hit = np.unique(pair[edge][total >= index.need(threshold)[pair[edge] % len(index.ids)] - 1e-9] // len(index.ids))
    owner = np.searchsorted(first_part, hit, "right") - 1
    begin = bounds[owner] + (hit - first_part[owner]) * half
    return list(zip(owner.tolist(), begin.tolist(), np.minimum(begin + index.window, bounds[owner + 1]).tolist(), strict=True))


def find_leaks(df: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text", threshold: float = 0.7, overlap: float = 0.8, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """key, item_id, score, question_overlap, answer_overlap: a row for each text and item that leaks into it.

    Passages of twice the longest item's words, each half a passage on from the last, query the index;
    an item comes back if its BM25 score is at least threshold of its score against itself. It leaks if
    of its question's and of its answer's five-word shingles (of fewer words: the whole) at least
    overlap each stand in the passage. A-Z lower-cased; words are runs of letters, digits and bytes of
    other scripts. Of a text's passages the best scored is told.

    Null or wordless texts and items match nothing; equal items all come back; rows that repeat repeat
    their matches; an empty table on either side gives no rows; other columns are not read. The index
    of items with more than index_bytes of text is built in parts, and each part queried. threshold is
    above 0: the lower, the more of an item's terms bring a passage to the index.
    """
    out = None
    kind = items.schema[item_key].dataType
    for index in _indexes(items, item_key, item_text, index_bytes, threshold):
        one = _found(df, index, text, key, kind, threshold, overlap)
        out = one if out is None else out.unionByName(one)
    return out.withColumnRenamed("item_id", item_key)


def without_leaks(df: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = 0.7, overlap: float = 0.8, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of df into which no item leaks (see find_leaks), all their columns as they are."""
    for index in _indexes(items, item_key, item_text, index_bytes, threshold):
        df = _clean(df, index, text, threshold, overlap)
    return df


def _indexes(items: DataFrame, item_key: str, item_text: str, index_bytes: int, threshold: float) -> Iterator[Index]:
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a share above 0")
    size = items.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0)).alias("b")).first().b
    shards = max(1, math.ceil(size / index_bytes))
    for shard in range(shards):
        rows = items.select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).where(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == shard).collect()
        yield build(sorted(((r.i, r.t) for r in rows if r.i is not None), key=lambda r: (r[0], r[1] or "")), threshold)


def matches(ix: Index, column: pa.Array, threshold: float, overlap: float) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(row, item) to score and the overlaps of question and answer, for each leak in a column of texts."""
    data, offsets = B.column_bytes(column, lower=True)
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for i, j in B.runs(offsets) if ix.ids else ():
        part = data[offsets[i] : offsets[j]]
        for piece in B.pieces(part, ix.window) if j - i == 1 else (part,):
            local = np.array([0, len(piece)]) if j - i == 1 else offsets[i : j + 1] - offsets[i]
            words, _, bounds = hashed_words(piece, local)
            term = _lookup(ix.terms, words)
            for row, a, b in passages_at_bound(ix, term, bounds, threshold):
                query = np.unique(term[a:b])
                grams: dict[int, set] = {}
                for item, score in block_max_wand(ix, (query[query > 0] - 1).tolist(), threshold):
                    shares = []
                    for n, want in ix.parts[item]:
                        if n not in grams:
                            grams[n] = set(_grams(words[a:b], n).tolist())
                        shares.append(len(want & grams[n]) / len(want))
                    if min(shares) >= overlap - 1e-9:
                        best[i + row, item] = max(best.get((i + row, item), (0.0, 0.0, 0.0)), (score, *shares))
    return best


def _found(df: DataFrame, index: Index, text: str, key: str, item_kind: DataType, threshold: float, overlap: float) -> DataFrame:
    item_type = to_arrow_type(item_kind)
    shared = df.sparkSession.sparkContext.broadcast(pickle.dumps(index))
    wanted = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = pickle.loads(shared.value)
        for batch in batches:
            best = matches(ix, batch.column("t"), threshold, overlap)
            got = sorted(best)
            yield pa.RecordBatch.from_arrays(
                [batch.column("k").take(pa.array([r for r, _ in got], pa.int64())), pa.array([ix.ids[m] for _, m in got], item_type), *(pa.array([best[g][c] for g in got], pa.float64()) for c in range(3))],
                ["k", "item_id", "score", "question_overlap", "answer_overlap"],
            )

    kind = wanted.schema["k"].dataType.simpleString()
    return wanted.mapInArrow(matched, f"k {kind}, item_id {item_kind.simpleString()}, score double, question_overlap double, answer_overlap double").withColumnRenamed("k", key)


def _clean(df: DataFrame, index: Index, text: str, threshold: float, overlap: float) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(pickle.dumps(index))

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = pickle.loads(shared.value)
        for batch in batches:
            good = np.ones(batch.num_rows, bool)
            good[[row for row, _ in matches(ix, batch.column(text), threshold, overlap)]] = False
            yield batch.filter(pa.array(good))

    return df.mapInArrow(filtered, df.schema)
