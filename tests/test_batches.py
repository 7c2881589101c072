"""Packed batches, their reader, and cursors that commit or discard them."""

import struct

import pytest

from packetloom.cursors import CursorError, Handles, Registry
from packetloom.operators import paging
from packetloom.sinks import batches

SCHEMA = "capture_id string, packet_id bigint, interface_id bigint, seconds bigint, fraction bigint, res_kind string, res_exp int, captured_length bigint, original_length bigint, evidence_offset bigint"


def packets(spark, counts):
    rows = []
    for c, n in counts.items():
        for k in range(n):
            time = (None, None, None, None) if k % 5 == 4 else (-k, k, "binary", 20) if k % 2 else (1 << 40, 999, "decimal", 9)
            rows.append((c, k, k % 3, *time, 60 + k, 4_294_967_295 - k, 1 << (33 + k % 8)))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_batches_come_back_whole(spark):
    p = packets(spark, {"a": 23, "b": 8, "c": 1})
    made = batches.packet_batches(p, 8)
    got = {(r.capture_id, r.start_row): r for r in made.collect()}
    assert {k: (r.next_row, r.total_rows) for k, r in got.items()} == {("a", 0): (8, 23), ("a", 8): (16, 23), ("a", 16): (23, 23), ("b", 0): (8, 8), ("c", 0): (1, 1)}
    assert [struct.unpack_from("<I", got[k].batch, 20)[0] for k in (("a", 0), ("a", 16), ("b", 0))] == [0, 1, 1]
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(batches.batch_rows(made)) == key(paging.packet_rows(p, "capture_id"))
    assert batches.packet_batches(p.limit(0)).count() == 0


def test_broken_batches_are_refused(spark):
    good = bytes(batches.packet_batches(packets(spark, {"a": 6})).first().batch)
    assert batches.decoded(good)[1:] == (0, 6, 6) and len(good) == 352 + 51 * 6
    spots = [0, 8, 10, 12, 16, 18, 20, 24, 28, 32, 36, 40, 48, 56]  # each part of the header
    spots += [64 + 24 * k + d for k in range(12) for d in (0, 2, 3, 4, 8, 12, 16, 20)]  # and of the descriptors
    spots += [352, 352 + 6 * 12, 352 + 6 * 20]  # an id and two lengths
    for at in spots:
        with pytest.raises(batches.BatchError):
            batches.decoded(good[:at] + bytes([good[at] ^ 64]) + good[at + 1 :])
    for bad in (b"", good[:-1], good + b"\0", good[:351]):
        with pytest.raises(batches.BatchError):
            batches.decoded(bad)
    with pytest.raises(Exception, match="out of its type's range"):
        batches.packet_batches(packets(spark, {"a": 2}).selectExpr("* except (original_length)", "5000000000L as original_length")).collect()


def test_cursors(spark):
    registry = Registry()
    data = registry.open(packets(spark, {"a": 10, "b": 3}), "a")
    cursor = registry.cursor(data, 2)

    def fails(category, call, *args):
        with pytest.raises(CursorError) as e:
            call(*args)
        assert e.value.category == category

    fails("out_of_range", registry.cursor, data, 11)
    fails("invalid_state", registry.commit, cursor, 2, 5)
    fails("invalid_argument", registry.read, cursor, 3, 352)
    fails("resource_limit", registry.read, cursor, 65_537)
    first = registry.read(cursor, 3)
    assert batches.decoded(first)[1:] == (2, 5, 10)
    fails("invalid_state", registry.read, cursor, 3)
    fails("invalid_argument", registry.commit, cursor, 2, 6)
    fails("unsupported_version", registry.commit, cursor, 2, 5, 2)
    registry.discard(cursor, 2, 5)
    assert registry.read(cursor, 3) == first
    registry.commit(cursor, 2, 5)
    rest = registry.read(cursor, 100, 352 + 51 * 4)
    assert batches.decoded(rest)[1:] == (5, 9, 10)
    registry.commit(cursor, 5, 9)
    assert batches.decoded(registry.read(cursor))[1:] == (9, 10, 10)
    registry.commit(cursor, 9, 10)
    assert batches.decoded(registry.read(cursor))[1:] == (10, 10, 10)
    registry.close(data)
    fails("invalid_handle", registry.read, cursor)
    again = registry.open(packets(spark, {"b": 3}))
    assert again[0] == data[0] and again != data
    fails("invalid_handle", registry.cursor, data)


def test_handles_are_bounded():
    held = Handles(2)
    one = held.insert("x")
    held.insert("y")
    with pytest.raises(CursorError):
        held.insert("z")
    assert held.remove(one) == "x" and held.insert("z") == (one[0], one[1] + 1)
