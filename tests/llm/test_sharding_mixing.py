import hashlib
import random
from collections import Counter, defaultdict

import pytest

from thalweg.llm import mixing as M
from thalweg.llm import sharding as S


def trie(rows, limit):
    """Plain extendible hashing: (leaf, bytes) of every row index."""
    bits = []
    for d, t in rows:
        inner = hashlib.md5((t or "").encode()).hexdigest()
        key = hashlib.md5(f"{'' if d is None else d}:{inner}".encode()).hexdigest()
        bits.append(f"{int(key[:15], 16):060b}")
    size = [len((t or "").encode()) for _, t in rows]
    leaf = {}
    waiting = [("", list(range(len(rows))))]
    while waiting:
        prefix, own = waiting.pop()
        total = sum(size[i] for i in own)
        if total <= limit or len(prefix) == 60 or len(own) == 1:
            for i in own:
                leaf[i] = (int("1" + prefix, 2), total)
            continue
        for b in "01":
            half = [i for i in own if bits[i][len(prefix)] == b]
            if half:
                waiting.append((prefix + b, half))
    return leaf


def test_what_grows_is_not_sent_through_the_driver(spark, monkeypatch):
    """Many shards are merged with the rows, few are broadcast, and both place alike."""
    df = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(300)], "doc_id long, text string")
    found = []
    for few in (1 << 20, 0):
        monkeypatch.setattr(S, "_FEW", few, raising=False)
        out = S.extendible_shards(df, limit=200)
        rows = sorted((r.doc_id, r.shard, r.shard_bytes) for r in out.collect())
        found.append((rows, "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()))
    assert found[0][0] == found[1][0] and [b for _, b in found] == [True, False]


def test_shards_against_plain_trie(spark):
    r = random.Random(1)
    rows = [(i, "x" * r.randrange(0, 300)) for i in range(400)] + [(1000, None), (None, "abc"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "x")
    for limit in (2000, 700, 200, 1 << 30):  # rows have up to 299 bytes
        got = Counter((r.doc_id, r.n_bytes, r.shard, r.shard_bytes) for r in S.extendible_shards(df, limit=limit).collect())
        want = Counter((d, len((t or "").encode()), *trie(rows, limit)[i]) for i, (d, t) in enumerate(rows))
        assert got == want


def test_directory_covers_the_hash_space(spark):
    rows = [(i, "x" * (i % 90)) for i in range(300)]
    placed = S.extendible_shards(spark.createDataFrame(rows, "doc_id long, text string"), limit=900)
    slots = sorted(S.directory(placed).collect(), key=lambda r: r.first_slot)
    (bits,) = {r.global_depth for r in slots}
    assert len(slots) > 8 and bits == max(r.depth for r in slots) and all(r.last_slot - r.first_slot + 1 == r.slots == 1 << (bits - r.depth) for r in slots)
    assert all(a.last_slot < b.first_slot for a, b in zip(slots, slots[1:])) and slots[-1].last_slot < 1 << bits
    for r in placed.collect():
        key = hashlib.md5(f"{r.doc_id}:{hashlib.md5(dict(rows)[r.doc_id].encode()).hexdigest()}".encode()).hexdigest()
        slot = int(key[:15], 16) >> (60 - bits)
        assert [x.shard for x in slots if x.first_slot <= slot <= x.last_slot] == [r.shard]


def test_oversized_rows_and_equal_rows(spark):
    rows = [(1, "a" * 5000), (2, "b" * 10), (3, "c" * 10)] + [(7, "same" * 5)] * 50
    df = spark.createDataFrame([r + (0, 0) for r in rows], "doc_id long, text string, h int, cell int")
    out = S.extendible_shards(df, limit=100).collect()
    assert len(out) == len(rows)
    held = defaultdict(int)
    for r in out:
        held[r.shard, r.part] += r.n_bytes
        assert r.shard_bytes <= 100 or r.shard_rows == 1
    assert all(n <= 100 or n == 5000 for n in held.values())
    assert len({r.part for r in out if r.doc_id == 7}) == 10
    assert S.extendible_shards(df.limit(0)).collect() == []


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, target, fixed = sum(sizes.values()), {}, {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        target = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return target | fixed
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mix_against_plain_targets(spark):
    r = random.Random(4)
    sources = ["a", "B", "é", "zz", None, "tiny"]
    rows = [(i, " ".join("w" * r.randrange(0, 40)), r.choice(sources[:5] + ["a"] * 4), i) for i in range(600)] + [(9000, "one two three", "tiny", 0), (9001, None, "empty", 0), (None, "x y", "a", 0), (5, "dup id", "B", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    out = M.mix_documents(df).collect()
    assert len(out) == len(rows)
    size = defaultdict(int)
    for _, t, s, _ in rows:
        size[s] += len((t or "").split())
    want = plain_targets(size)
    near = defaultdict(int)
    for o in out:
        (s,) = {x[2] for x in rows if x[0] == o.doc_id and len((x[1] or "").split()) == o.size and size[x[2]] == o.source_size}
        near[s] += o.taken
        assert o.target == pytest.approx(want[s]) and 0 <= o.taken <= 3 * o.size and o.copies == -(-o.taken // max(1, o.size))
    assert all(near[s] == int(want[s] + 0.5) for s in near)
    places = [o.position for o in out if o.position is not None]
    assert places == sorted(places) and all(0 <= p <= sum(size.values()) for p in places)
    assert sorted(map(str, out)) == sorted(map(str, M.mix_documents(df.repartition(7)).collect()))
    mixed = M.mixed_rows(df)
    assert mixed.columns == df.columns
    taken = Counter(x.doc_id for x in mixed.collect())
    assert all(taken[o.doc_id] == int(o.taken / o.size + 0.5) for o in out if o.size and o.doc_id not in (5, None))
    assert M.mix_documents(df.limit(0)).collect() == [] and M.mixed_rows(df.limit(0)).collect() == []


def test_schedules_invert(spark):
    from pyspark.sql import functions as F

    for points in M.SCHEDULES:
        df = spark.range(101).select((F.col("id") / 100).alias("u"))
        for row in df.select("u", M.demand_time(F.col("u"), points).alias("t")).collect():
            area = total = 0.0
            for (t0, w0), (t1, w1) in zip(points, points[1:]):
                total += (t1 - t0) * (w0 + w1) / 2
                x = min(max(row.t - t0, 0), t1 - t0)
                area += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
            assert area / total == pytest.approx(row.u, abs=1e-9)
