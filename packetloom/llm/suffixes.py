"""Suffix-array removal of repeated byte strings, the array built blockwise over a difference cover.

What must be compared is thinned first. Each window of DEPTH bytes chooses one of the GRAM-byte strings
in it, the one of the least hash; equal windows choose alike. Successive windows with one choice form a
run, and the bytes under a run are its span. Runs of equal choice and equal span stand in one class, in
which all windows are equal: a rank known beforehand, so these long ties are never sorted. Only where
one choice has several spans are their suffixes sorted, a bucket of suffixes at a time, ties after
PERIOD bytes being told apart by the ranks of cover samples. Neighbours in that order that agree in DEPTH
bytes are the repeats. Choices and spans are known by 48 bits of hash each: two unequal spans pass for one
with probability 2 ** -96.

Texts are dealt to blocks. A block sends its classes, packed in one row for each task of choices; the
answers, the spans to sort and what was found about them travel packed in the same way. A string that
all texts share costs an entry a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm import _bytes as B
from packetloom.llm._shared import small_batches

DEPTH = 50
GRAM = 20
_CHOICE = DEPTH - GRAM + 1
_LOW = np.uint64((1 << 48) - 1)

PERIOD = 31
#: A perfect difference set of 31, so that any two residues meet in it at one shift.
COVER = (1, 5, 11, 24, 25, 27)
_in_cover = np.isin(np.arange(PERIOD), COVER)
_SHIFT = np.array([[next(d for d in range(PERIOD) if _in_cover[(a + d) % PERIOD] and _in_cover[(b + d) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])
#: Of each residue the number of cover samples before it.
_SLOT = np.cumsum(_in_cover) - _in_cover

#: Suffixes sorted at a time.
SUFFIX_BLOCK = 1 << 16
#: Spans of one choice that are sorted in one task; the windows of more are dealt out by their bytes.
HOT_SPANS = 20_000


def _order(*columns: np.ndarray) -> np.ndarray:
    """The order of rows by columns, the first the most significant; the others are read for its ties alone."""
    order = np.argsort(columns[0])
    first = columns[0][order]
    same = first[1:] == first[:-1]
    tied = np.zeros(len(order), bool)
    tied[1:] |= same
    tied[:-1] |= same
    at = np.flatnonzero(tied)
    rows = order[at]
    order[at] = rows[np.lexsort([c[rows] for c in columns[::-1]])]
    return order


def _new(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Where a row, in this order, differs from the one before."""
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for c in columns:
            c = c[order]
            new[1:] |= c[1:] != c[:-1]
    return new


def _dense(*columns: np.ndarray) -> np.ndarray:
    """Ranks from 1 of rows by columns."""
    order = _order(*columns)
    out = np.empty(len(order), np.int32)
    out[order] = np.cumsum(_new(order, *columns))
    return out


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin[i], begin[i] + 1, ... of each range, end to end."""
    total = np.cumsum(size)
    return np.repeat(begin - total + size, size) + np.arange(total[-1] if len(total) else 0)


def sorted_suffixes(data: np.ndarray, starts: np.ndarray, block: int = SUFFIX_BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """starts in the order of the suffixes there, and whether each agrees with the one before in DEPTH bytes.

    The order is that of the first 2 * PERIOD bytes at least; zeros stand beyond the end. Memory beside
    the input: the ranks of the sample, kept at its places alone, and one block.
    """
    n = len(data)
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(5 * PERIOD, np.uint8)]), 8)
    at = lambda i, j: eight[i + j].view(">u8").ravel().astype(np.uint64)
    # ranks of cover samples: by PERIOD bytes, then by as many again; the next sample of a residue is PERIOD on
    sample = (np.arange(n // PERIOD + 3)[:, None] * PERIOD + np.array(COVER)).ravel()
    inside = np.minimum(sample, n + PERIOD)
    near = _dense(at(inside, 0), at(inside, 8), at(inside, 16), at(inside, 23))
    rank = _dense(near, np.append(near[len(COVER) :], np.zeros(len(COVER), np.int32)))
    # buckets of suffixes by two bytes, as many as fit a block
    lead = (at(starts, 0) >> np.uint64(48)).astype(np.int64)
    by_lead = np.argsort(lead, kind="stable")
    ends = np.cumsum(np.bincount(lead, minlength=1 << 16))
    out, a = [], 0
    while a < len(starts):
        k = np.searchsorted(ends, a + block, "right") - 1
        b = int(ends[k]) if k >= 0 and ends[k] > a else int(ends[np.searchsorted(ends, a, "right")])
        out.append(_sorted_block(starts[by_lead[a:b]], at, rank))
        a = b
    order = np.concatenate(out) if out else starts[:0]
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        same[1:] = True
        for j in (0, 8, 16, 24, 32, 40, DEPTH - 8):
            w = at(order, j)
            same[1:] &= w[1:] == w[:-1]
    return order, same


def _sorted_block(s: np.ndarray, at, rank: np.ndarray) -> np.ndarray:
    keys = [at(s, j) for j in (0, 8, 16, 23)]
    order = _order(*keys)
    group = np.cumsum(_new(order, *keys)) - 1
    s = s[order]
    open_ = np.flatnonzero(np.bincount(group)[group] > 1)
    ranked = lambda i: rank[i // PERIOD * len(COVER) + _SLOT[i % PERIOD]]
    # split the ties three ways around their first member, all groups at once
    while len(open_):
        g, m = group[open_], s[open_]
        first = np.concatenate([[True], g[1:] != g[:-1]])
        pivot = m[first][np.cumsum(first) - 1]
        d = _SHIFT[m % PERIOD, pivot % PERIOD]
        side = np.sign(ranked(m + d) - ranked(pivot + d))
        turn = np.lexsort((side, g))
        s[open_], side, g = m[turn], side[turn], g[turn]
        part = np.cumsum(np.concatenate([[True], (g[1:] != g[:-1]) | (side[1:] != side[:-1])])) - 1
        group[open_] = part
        keep = (side != 0) & (np.bincount(part)[part] > 1)
        open_ = open_[keep]
    return s


def _runs(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """choice, span, row, place in data and number of windows of the runs of these rows, some texts at a time."""
    size = np.diff(offsets)[rows]
    rows, size = rows[size >= DEPTH], size[size >= DEPTH]
    local = np.concatenate([[0], np.cumsum(size)])
    for i, j in B.runs(local):
        if j - i > 1 or size[i] <= B.PIECE:
            part = np.concatenate([data[offsets[r] : offsets[r + 1]] for r in rows[i:j]])
            choice, span, text, first, count = _runs_of(part, local[i : j + 1] - local[i])
            yield choice, span, rows[i + text], offsets[rows[i + text]] + first, count
        else:
            for a in range(0, size[i] - DEPTH + 1, B.PIECE):
                begin = offsets[rows[i]] + a
                part = data[begin : min(begin + B.PIECE + DEPTH - 1, offsets[rows[i] + 1])]
                choice, span, text, first, count = _runs_of(part, np.array([0, len(part)]))
                yield choice, span, rows[i + text], begin + first, count


def _runs_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    m = len(data) - DEPTH + 1
    sums = B.prefix_hash(data)
    grams = np.arange(len(data) - GRAM + 1)
    gram = B.range_hash(sums, grams, grams + GRAM)
    least = (gram & ~np.uint64((1 << 21) - 1)) | grams.astype(np.uint64)
    for k in (1, 2, 4, 8):
        least = np.minimum(least[:-k], least[k:])
    least = np.minimum(least[:m], least[_CHOICE - 16 : m + _CHOICE - 16])
    at = (least & np.uint64((1 << 21) - 1)).astype(np.int32)
    del least, grams
    edge = np.ones(m, bool)
    edge[1:] = at[1:] != at[:-1]
    good = np.ones(m, bool)
    for end in offsets[1:-1]:
        good[end - DEPTH + 1 : end] = False
        if end < m:
            edge[end] = True
    edge[1:] |= good[1:] != good[:-1]
    a = np.flatnonzero(edge)
    b = np.append(a[1:], m)
    a, b = a[good[a]], b[good[a]]
    text = np.searchsorted(offsets, a, "right") - 1
    return gram[at[a]] & _LOW, B.range_hash(sums, a, b - 1 + DEPTH) & _LOW, text, a - offsets[text], b - a


class Block:
    """Texts of a block, and the classes of those that are no copies, in the order in which they are sent."""

    def __init__(self, table: pa.Table, tasks: int):
        self.keys = table.column("k").to_numpy(zero_copy_only=False).astype(np.int64) if table.num_rows else np.zeros(0, np.int64)
        self.data, self.offsets = B.column_bytes(table.column("t"))
        first: dict[bytes, int] = {}  # by the text itself
        bounds = self.offsets.tolist()
        self.of = np.array([first.setdefault(self.data[a:b].tobytes(), i) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))], np.int64)
        del first
        self.docs = self.keys.copy()  # of a text's first row the least key of all its rows
        np.minimum.at(self.docs, self.of, self.keys)
        found = list(_runs(self.data, self.offsets, np.flatnonzero(self.of == np.arange(len(self.of)))))
        kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64)
        choice, span, row, self.place, self.count = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, kind) for k, kind in enumerate(kinds))
        del found
        self.doc = self.docs[row]
        order = _order(choice, span, self.doc)
        new = _new(order, choice, span)
        self.item = np.empty(len(order), np.int64)  # of each run
        self.item[order] = np.cumsum(new) - 1
        self.sample = order[new]  # a run of each class
        self.choice, self.span, self.least = choice[self.sample], span[self.sample], self.doc[self.sample]
        # a task has a range of choices, so that classes stand in the order of tasks
        self.bounds = np.searchsorted(_task(self.choice, tasks), np.arange(tasks + 1))


def _task(choice: np.ndarray, tasks: int) -> np.ndarray:
    return (((choice >> np.uint64(16)) * np.uint64(tasks)) >> np.uint64(32)).astype(np.int64)


def _pack(a: np.ndarray, n: int) -> bytes:
    """The n low bytes of 64-bit integers, plane by plane."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()


def _unpack(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(n, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :n] = planes.T
    return out.view(np.uint64).ravel()


def _column(table: pa.Table, name: str, kind: int | type) -> list[np.ndarray]:
    """A packed column, row by row: kind is a number of bytes for _unpack, or a type."""
    raw = table.column(name).to_pylist()
    return [_unpack(x, kind) for x in raw] if isinstance(kind, int) else [np.frombuffer(x, kind) for x in raw]


def _joined(table: pa.Table, name: str, kind: int | type) -> np.ndarray:
    parts = _column(table, name, kind)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64 if isinstance(kind, int) else kind)


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
    return pa.table({name: pa.array([r[k] for r in rows], kinds[kind]) for k, (name, kind) in enumerate(fields)})


_SENT = "task int, block bigint, choices binary, spans binary, docs binary"
_ANSWER = "block bigint, task int, at binary, code binary, least binary, held binary, holders binary"
_SPANS = "deal int, hot int, choices binary, spans binary, least binary, sizes binary, content binary, held binary, holders binary"
_BACK = "block bigint, choices binary, spans binary, counts binary, minima binary"
_SINGLE, _SEVERAL, _SHOW, _SHOW_HOT = 1, 2, 3, 4


def _send(tasks: int):
    def send(key: tuple, table: pa.Table) -> pa.Table:
        b, out = Block(table, tasks), []
        for t in np.flatnonzero(np.diff(b.bounds)):
            s = slice(b.bounds[t], b.bounds[t + 1])
            out.append((int(t), key[0].as_py(), _pack(b.choice[s], 6), _pack(b.span[s], 6), _pack(b.least[s], 8)))
        del b
        B.release()
        return _rows(_SENT, out)

    return send


def _answer(hot_spans: int):
    def answer(key: tuple, table: pa.Table) -> pa.Table:
        """For each block: entries whose class has a lesser key elsewhere, or whose choice has several spans.

        The block with the least key of a class of the latter kind is asked to show its bytes, and told
        which blocks have it.
        """
        blocks = table.column("block").to_numpy()
        size = np.array([len(x) // 6 for x in table.column("choices").to_pylist()])
        choice, span, doc = _joined(table, "choices", 6), _joined(table, "spans", 6), _joined(table, "docs", 8).view(np.int64)
        row = np.repeat(np.arange(len(size)), size)
        order = _order(choice, span, doc)
        new_choice, new_class = _new(order, choice), _new(order, choice, span)
        group, class_of = np.cumsum(new_choice) - 1, np.cumsum(new_class) - 1
        d = doc[order]
        least = d[new_class][class_of]
        spans = np.bincount(group, weights=new_class)[group]
        code = np.where(spans > 1, _SEVERAL, np.where(least < d, _SINGLE, 0)).astype(np.uint8)
        code[new_class & (spans > 1)] = _SHOW
        code[new_class & (spans > hot_spans)] = _SHOW_HOT
        members = np.bincount(class_of)
        # told entries, block by block
        told = np.flatnonzero(code)
        told = told[np.argsort(row[order[told]], kind="stable")]
        entry = order[told]
        at = (entry - (np.cumsum(size) - size)[row[entry]]).astype(np.uint32)
        cut = np.searchsorted(row[entry], np.arange(len(size) + 1))
        code, least = code[told], least[told]
        out = []
        for k in np.flatnonzero(np.diff(cut)):
            s = slice(cut[k], cut[k + 1])
            asked = told[s][code[s] >= _SHOW]  # each is the first of its class in the order
            held = members[class_of[asked]]
            holders = blocks[row[order[_ranges(asked, held)]]]
            out.append((int(blocks[k]), key[0].as_py(), at[s].tobytes(), code[s].tobytes(), _pack(least[s], 8), held.astype(np.uint32).tobytes(), _pack(holders, 8)))
        del choice, span, doc, row, order, group, class_of
        B.release()
        return _rows(_ANSWER, out)

    return answer


def _show(tasks: int):
    def show(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        """The bytes of the classes that this block was asked for."""
        out = []
        if docs.num_rows and any(answers.column("held").to_pylist()):
            b = Block(docs, tasks)
            columns = [answers.column("task").to_pylist(), *(_column(answers, c, kind) for c, kind in (("at", np.uint32), ("code", np.uint8), ("least", 8), ("held", np.uint32), ("holders", 8)))]
            for task, at, code, least, held, holders in zip(*columns, strict=True):
                asked = code >= _SHOW
                code, least, item = code[asked], least[asked], b.bounds[task] + at[asked].astype(np.int64)
                ends = np.cumsum(held, dtype=np.int64)
                for hot in np.unique(code):
                    own = np.flatnonzero(code == hot)
                    run = b.sample[item[own]]
                    size = b.count[run] - 1 + DEPTH
                    content = b.data[_ranges(b.place[run], size)].tobytes()
                    with_them = holders[_ranges((ends - held)[own], held[own].astype(np.int64))]
                    out.append((task, int(hot == _SHOW_HOT), _pack(b.choice[item[own]], 6), _pack(b.span[item[own]], 6), _pack(least[own], 8), size.astype(np.uint8).tobytes(), content, held[own].tobytes(), _pack(with_them, 8)))
            del b
            B.release()
        return _rows(_SPANS, out)

    return show


def window_minima(data: np.ndarray, size: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each window of each content (size bytes each, end to end in data), the least value of the contents that have it, from a suffix array of all."""
    count = size - DEPTH + 1
    owner = np.repeat(np.arange(len(size)), count)
    starts = _ranges(np.cumsum(size) - size, count)
    order, same = sorted_suffixes(data, starts)
    if not len(order):
        return np.zeros(0, np.int64)
    which = np.empty(len(data), np.int32)
    which[starts] = np.arange(len(starts))
    order = which[order]
    del which, starts
    first = np.flatnonzero(~same)
    best = np.minimum.reduceat(least[owner[order]], first)
    found = np.empty(len(order), np.int64)
    found[order] = np.repeat(best, np.diff(np.append(first, len(order))))
    return found


def _sort(key: tuple, table: pa.Table) -> pa.Table:
    table = table.filter(pc.equal(table.column("hot"), 0))
    out = []
    if table.num_rows:
        choice, span, least, size = _joined(table, "choices", 6), _joined(table, "spans", 6), _joined(table, "least", 8).view(np.int64), _joined(table, "sizes", np.uint8).astype(np.int64)
        held, holders = _joined(table, "held", np.uint32).astype(np.int64), _joined(table, "holders", 8).view(np.int64)
        minima = window_minima(B.column_bytes(table.column("content"))[0], size, least)
        count = size - DEPTH + 1
        begin = np.cumsum(count) - count
        item = np.repeat(np.arange(len(size)), held)
        turn = np.argsort(holders, kind="stable")
        item, holders = item[turn], holders[turn]
        cut = np.append(np.flatnonzero(_new(np.arange(len(holders)), holders)), len(holders))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            own = item[a:b]
            out.append((int(holders[a]), _pack(choice[own], 6), _pack(span[own], 6), count[own].astype(np.uint8).tobytes(), minima[_ranges(begin[own], count[own])].tobytes()))
        del choice, span, least, held, holders, minima, item
    B.release()
    return _rows(_BACK, out)


def _hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table.filter(pc.equal(table.column("hot"), 1))
        if table.num_rows:
            yield table


def _hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of a hot span: its place and its bytes."""
    for table in _hot(batches):
        size = _joined(table, "sizes", np.uint8).astype(np.int64)
        data, n = B.column_bytes(table.column("content"))[0], size - DEPTH + 1
        begin = _ranges(np.cumsum(size) - size, n)
        raw = np.lib.stride_tricks.sliding_window_view(data, DEPTH)[begin].tobytes()
        window = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((np.arange(len(begin) + 1) * DEPTH).astype(np.int32)), pa.py_buffer(raw)])
        each = lambda x, n=n: pa.array(np.repeat(x.view(np.int64), n))
        columns = [each(_joined(table, "choices", 6)), each(_joined(table, "spans", 6)), pa.array(_ranges(np.zeros(len(n), np.int64), n).astype(np.int32)), window, each(_joined(table, "least", 8))]
        yield pa.RecordBatch.from_arrays(columns, ["choice", "span", "j", "window", "least"])


def _hot_holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _hot(batches):
        held = _joined(table, "held", np.uint32)
        each = [np.repeat(_joined(table, c, 6).view(np.int64), held) for c in ("choices", "spans")]
        yield pa.RecordBatch.from_arrays([pa.array(each[0]), pa.array(each[1]), pa.array(_joined(table, "holders", 8).view(np.int64))], ["choice", "span", "block"])


def _hot_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(r["block"], _pack(np.array([r["choice"]]), 6), _pack(np.array([r["span"]]), 6), bytes([len(r["m"])]), np.array(r["m"], np.int64).tobytes()) for r in batch.to_pylist()]
        yield from _rows(_BACK, rows).to_batches()


_KEPT = "k bigint, n_bytes bigint, starts array<bigint>, ends array<bigint>, kept binary"


def _cut(tasks: int, carried: list[str]):
    def cut(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        b = Block(docs, tasks)
        least, several = b.least.copy(), np.zeros(len(b.least), bool)
        told = answers.filter(answers.column("at").is_valid())
        for task, at, code, values in zip(told.column("task").to_pylist(), *(_column(told, c, kind) for c, kind in (("at", np.uint32), ("code", np.uint8), ("least", 8))), strict=True):
            i = b.bounds[task] + at.astype(np.int64)
            least[i] = values.view(np.int64)
            several[i] = code >= _SEVERAL
        # minima of the windows of classes whose choice has several spans: these come back once each
        back = answers.filter(answers.column("at").is_null())
        choice, span, count, flat = _joined(back, "choices", 6), _joined(back, "spans", 6), _joined(back, "counts", np.uint8).astype(np.int64), _joined(back, "minima", np.int64)
        items, order = np.flatnonzero(several), _order(choice, span)
        if len(items) != len(order):
            raise RuntimeError(f"{len(items)} classes wait for {len(order)} results")
        begin = np.zeros(len(several), np.int64)
        begin[items] = (np.cumsum(count) - count)[order]
        # covered bytes of all texts end to end, from the starts and ends of runs of repeated windows
        change = np.zeros(len(b.data) + 1, np.int32)
        many = several[b.item]
        sure = np.flatnonzero((least[b.item] < b.doc) & ~many)
        np.add.at(change, b.place[sure], 1)
        np.add.at(change, b.place[sure] + b.count[sure] - 1 + DEPTH, -1)
        many = np.flatnonzero(many)
        windows = b.count[many]
        hit = flat[_ranges(begin[b.item[many]], windows)] < np.repeat(b.doc[many], windows)
        at = _ranges(b.place[many], windows)[hit]
        np.add.at(change, at, 1)
        np.add.at(change, at + DEPTH, -1)
        gone = np.cumsum(change[:-1], dtype=np.int32) > 0
        del change, flat, hit, at, many
        # copies go whole, and those of the least key as their first row does
        size = np.diff(b.offsets)
        for i in np.flatnonzero((b.of != np.arange(len(b.of))) | (b.keys > b.docs)):
            k = b.of[i]
            gone[b.offsets[i] : b.offsets[i + 1]] = size[i] >= DEPTH if b.keys[i] > b.docs[k] else gone[b.offsets[k] : b.offsets[k + 1]]
        out = _without(b.data, b.offsets, gone)
        table = pa.table({"k": docs.column("k"), "n_bytes": pa.array(size, pa.int64())} | out | {c: docs.column(c) for c in carried})
        del b, gone
        B.release()
        return table

    return cut


def _without(data: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> dict[str, pa.Array]:
    """starts and ends of the runs of gone bytes in each text, and the other bytes."""
    n = len(offsets) - 1
    edge = gone[1:] != gone[:-1]
    begins, ends = np.zeros(len(gone), bool), np.zeros(len(gone), bool)
    if len(gone):
        begins[0], ends[-1] = gone[0], gone[-1]
        begins[1:], ends[:-1] = edge & gone[1:], edge & gone[:-1]
        first, last = offsets[:-1][offsets[:-1] < offsets[1:]], offsets[1:][offsets[:-1] < offsets[1:]] - 1
        begins[first], ends[last] = gone[first], gone[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    lists = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
    kept = np.concatenate([[0], np.cumsum(~gone)])[offsets].astype(np.int32)
    listed = lambda x: pa.ListArray.from_arrays(pa.array(lists), pa.array(x - offsets[text], pa.int64()))
    return {"starts": listed(starts), "ends": listed(stops), "kept": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(kept), pa.py_buffer(data[~gone].tobytes())])}


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", carry: tuple[str, ...] = (), block_rows: int = 2000, block_bytes: int = 4 << 20, hot_spans: int = HOT_SPANS) -> DataFrame:
    """key, n_bytes, starts, ends, kept, and the columns carry, for each row of df.

    Bytes of the UTF-8 text that a string of DEPTH bytes covers which also starts in a text with a
    smaller key are removed; strings are judged on the input. starts and ends delimit the maximal
    removed byte ranges, kept holds the other bytes (which need not be whole characters). A null text is
    empty. Rows of one key don't remove each other's bytes; a null key is neither smaller nor larger
    than any, so its text stays whole and removes nothing. Keys are whole numbers; others are a ValueError.
    Other columns are not read.

    A block has about block_rows rows and block_bytes bytes. Of a choice with more than hot_spans spans
    windows are aggregated by their bytes, over all tasks, instead of being sorted in one.
    """
    if df.schema[key].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{key} must be a whole number")
    spark = df.sparkSession
    small_batches(spark)
    raw = F.coalesce(F.encode(F.col(text).cast("string"), "UTF-8"), F.lit(b""))
    docs = df.select(F.col(key).cast("bigint").alias("k"), raw.alias("t"), *[F.col(c).alias(f"c_{c}") for c in carry])
    whole = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0)).alias("bytes")).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(least, math.ceil(whole.n / block_rows), math.ceil(whole.bytes / block_bytes))
    tasks = max(least, math.ceil(blocks / 4))
    alone = docs.where("k is null")
    docs = docs.where("k is not null").withColumn("block", F.pmod(F.xxhash64("k", "t"), F.lit(blocks))).repartition(blocks, "block")
    # answers and shown are read by several branches: each is dealt once, with all its columns, so that
    # the branches share that exchange
    answers = docs.groupBy("block").applyInArrow(_send(tasks), _SENT).groupBy("task").applyInArrow(_answer(hot_spans), _ANSWER).repartition(blocks, "block")
    shown = docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_show(tasks), _SPANS).repartition(tasks, "deal")
    usual = shown.groupBy("deal").applyInArrow(_sort, _BACK)
    windows = shown.mapInArrow(_hot_windows, "choice bigint, span bigint, j int, window binary, least bigint")
    minima = windows.groupBy("choice", "window").agg(F.min("least").alias("m"))
    by_span = windows.join(minima, ["choice", "window"]).groupBy("choice", "span").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda x: x["m"]).alias("m"))
    holders = shown.mapInArrow(_hot_holders, "choice bigint, span bigint, block bigint")
    hot = holders.join(by_span, ["choice", "span"]).select("block", "choice", "span", "m").mapInArrow(_hot_back, _BACK)
    null = lambda schema: [F.lit(None).cast(f.rsplit(" ", 1)[1]).alias(f.rsplit(" ", 1)[0]) for f in schema.split(", ")[1:]]
    told = answers.select("*", *null(_BACK)).unionByName(usual.unionByName(hot).select("*", *null(_ANSWER)))
    extra = [f for f in docs.schema.fields if f.name.startswith("c_")]
    schema = ", ".join([_KEPT, *(f"`{f.name}` {f.dataType.simpleString()}" for f in extra)])
    out = docs.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_cut(tasks, [f.name for f in extra]), schema)
    none = F.array().cast("array<bigint>")
    out = out.unionByName(alone.select("k", F.length("t").cast("bigint").alias("n_bytes"), none.alias("starts"), none.alias("ends"), F.col("t").alias("kept"), *[f.name for f in extra]))
    return out.select(F.col("k").alias(key), "n_bytes", "starts", "ends", "kept", *[F.col(f"c_{c}").alias(c) for c in carry])


def whole_characters(df: DataFrame, kept: str = "kept", text: str = "text") -> DataFrame:
    """df with the bytes of kept as a string text, without the rest of characters that were cut."""

    @F.pandas_udf("string")
    def decoded(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    return df.withColumn(text, decoded(kept))
