"""N-gram Jaccard join by PartEnum signatures.

Sets of five-word shingles with Jaccard similarity of at least ``percent`` / 100 differ in at most
(n + m) * (100 - percent) / (100 + percent) members.  Sizes are cut into bands so that similar sets lie in one band or in
two adjacent ones, and each set is signed for its own band and for the next.

* Within a band the feature domain (the hash range) is cut into partitions, so many that sets of the band which differ in
  at most k members differ in at most one member in one partition more than k // 2.  Each partition is cut into three parts;
  where two sets differ in one member, two parts are equal.  All subsets of two of the three parts are enumerated; a
  signature is the content of such a subset.  Partitions are taken in their order until k // 2 + 1 of them (k: what the set
  itself may differ in) have members in two parts at least, so that no subset of them is empty.
* Sets of 4 to 14 shingles use every shingle as a partition of its own: all subsets lacking up to (100 - percent) % of the
  members are enumerated.

Both are complete: every similar pair shares a signature.  Sets sharing one form a group.  Copies collapse to one set first.
Each member is compared exactly with the hub of its group, its member of the highest rank in an order of all sets, and linked
sets become one component.  Other members of one hub are compared only if they are in different components and their parity sketches,
which differ in at most as many bits as the sets in members, are near enough.  Signatures, hubs and components that very many
sets have are dealt to many tasks.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thalweg.llm import textkernel as tk
from thalweg.operators.components import connected_components
from thalweg.operators.skew import LARGE_KEYS, salted_join
from thalweg.storage import forget, materialize

PERCENT = 80
_SMALL, _LEAST = 14, 4
U64 = np.uint64
#: Documents whose signatures are counted to find those that a large part of all sets have, the count from which one is among
#: them, and the most that are sent to the tasks.  This deals rows to tasks; it drops nothing.
_PROBE_DOCS, _FREQUENT, _MOST_FREQUENT = 8000, 16, 100_000
_SIG_ROWS = 1_500_000
#: Parts of a partition, and pairs of set ids with one set from which they are dealt to more tasks.
_PARTS, _LARGE_HUB, _BLOCK = 3, 512, 2048


def bands(percent: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest size of each band, from ``_SMALL`` + 1 to beyond ``largest``."""
    low, high = [_SMALL + 1], []
    while True:
        high.append(low[-1] * 100 // percent)
        if low[-1] > largest:
            return np.array(low), np.array(high)
        low.append(high[-1] + 1)


def _small_signatures(members: np.ndarray, percent: int) -> np.ndarray:
    scrambled = tk.mix(members ^ U64(0x7F4A7C15F39CC060))
    total, most = scrambled.sum(dtype=U64), len(members) * (100 - percent) // 100
    out = [np.array([total], U64)]
    for k in range(1, most + 1):
        picks = np.array(list(combinations(range(len(members)), k)))
        out.append(total - scrambled[picks].sum(axis=1, dtype=U64))
    return tk.mix(np.concatenate(out) ^ U64(0x1F83D9ABFB41BD6B))


def _band_signatures(flat, bounds, docs, tags, low, high, percent):
    """Signatures of ``docs`` (indices of sets) for the bands ``tags``: owner index and signature, flat."""
    n = np.diff(bounds)[docs]
    most = 2 * high * (100 - percent) // (100 + percent) // 2 + 1
    parts = (most + 2 + most // 16)[tags]
    differ = (n + np.minimum(high[tags], n * 100 // percent)) * (100 - percent) // (100 + percent)
    at = np.repeat(bounds[docs], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    members, owner = flat[at], np.repeat(np.arange(len(docs)), n)
    first = np.cumsum(parts) - parts
    part = first[owner] + (((members >> U64(32)) * parts[owner].astype(U64)) >> U64(32)).astype(np.int64)
    mixed = tk.mix(members ^ U64(0x3C6EF372FE94F82B))
    cell = part * _PARTS + (mixed % U64(_PARTS)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(cell[order]) != 0])
    content = np.zeros(int(parts.sum()) * _PARTS, U64)
    content[cell[order][cut]] = np.add.reduceat(mixed[order], cut)
    filled = np.zeros(len(content), bool)
    filled[cell] = True
    content, filled = content.reshape(-1, _PARTS), filled.reshape(-1, _PARTS)
    who = np.repeat(np.arange(len(docs)), parts)
    telling = filled.sum(axis=1) >= 2
    # partitions up to the one that makes enough telling ones; all, with empty subsets too, where there are not enough
    met = np.cumsum(telling)
    met -= (met[first] - telling[first])[who]
    need = (differ // 2 + 1)[who]
    kept = met - telling < need
    short = (met[first + parts - 1] < differ // 2 + 1)[who]
    name = tags[who].astype(U64) * U64(0x9E3779B97F4A7C15) + (np.arange(len(who)) - first[who]).astype(U64) * U64(0xD1B54A32D192ED03)
    out_who, out_sig = [], []
    for lacking, (a, b) in enumerate(((1, 2), (0, 2), (0, 1))):
        use = kept & (filled[:, a] | filled[:, b] | short)
        out_who.append(docs[who[use]])
        out_sig.append(tk.mix(tk.mix(content[use, a] + U64(lacking + 1)) * U64(3) + content[use, b] + name[use]))
    return np.concatenate(out_who), np.concatenate(out_sig)


def signatures(flat: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of a batch of sets: index of the set and signature."""
    n = np.diff(bounds)
    who, sig = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for d in np.flatnonzero((n >= _LEAST) & (n <= _SMALL)):
        own = _small_signatures(flat[bounds[d] : bounds[d + 1]], percent)
        who.append(np.full(len(own), d))
        sig.append(own)
    low, high = bands(percent, int(n.max(initial=0)))
    band = np.searchsorted(low, n, side="right") - 1
    for step in (0, 1):
        tag = band + step
        docs = np.flatnonzero((tag >= 0) & (n > _LEAST) & (n * 100 // percent >= low[np.maximum(tag, 0)]))
        if len(docs):
            a, b = _band_signatures(flat, bounds, docs, tag[docs], low, high, percent)
            who.append(a)
            sig.append(b)
    return np.concatenate(who), np.concatenate(sig)


def _batches(batches, column="text"):
    for batch in batches:
        data, offsets = tk.utf8(batch.column(batch.schema.get_field_index(column)))
        for lo, hi in tk.chunks(offsets):
            yield batch, lo, hi, *tk.shingle_sets(data, offsets[lo : hi + 1])


class _Seen:
    """Ids met in this task, forgotten when there are many: repeats are skipped only to save work."""

    def __init__(self, most=200_000):
        self.ids, self.most = set(), most

    def fresh(self, ids: np.ndarray) -> np.ndarray:
        if len(self.ids) > self.most:
            self.ids.clear()
        out = np.zeros(len(ids), bool)
        for i, x in enumerate(ids.tolist()):
            if x and x not in self.ids:
                self.ids.add(x)
                out[i] = True
        return out


def _pick(flat, bounds, keep):
    n = np.diff(bounds)
    inner = np.repeat(keep, n)
    new = np.zeros(int(keep.sum()) + 1, np.int64)
    np.cumsum(n[keep], out=new[1:])
    return flat[inner], new


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == U64 else x.astype(np.int64))


def _sizes(batches):
    for batch, lo, hi, flat, bounds in _batches(batches):
        ids, n = tk.set_ids(flat, bounds), np.diff(bounds)
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(ids.view(np.int64), mask=n == 0), _long(n)], ["doc_id", "set_id", "n_shingles"])


def _place(sig: np.ndarray, places: int) -> np.ndarray:
    return ((sig >> U64(32)) * U64(places)) >> U64(32)


def _signer(percent: int):
    """Signatures of the documents, one row each."""

    def sign(batches):
        for _, _, _, flat, bounds in _batches(batches):
            yield pa.RecordBatch.from_arrays([_long(signatures(flat, bounds, percent)[1])], ["signature"])

    return sign


def _packer(percent: int, places: int, frequent):
    """Signatures and set ids, packed by the place where equal signatures meet: ``place, often, keys, ids``.  The key of a signature is its
    place and 32 bits of it.  What has a frequent signature goes to a place by its set id, with the whole key."""

    def pack(batches):
        seen, hot = _Seen(), frequent.value
        for _, _, _, flat, bounds in _batches(batches):
            ids = tk.set_ids(flat, bounds)
            fresh = seen.fresh(ids)
            flat, bounds = _pick(flat, bounds, fresh)
            who, sig = signatures(flat, bounds, percent)
            own, place = ids[fresh][who], _place(sig, places)
            key = sig & U64(0xFFFFFFFF)
            often = hot[np.minimum(np.searchsorted(hot, sig), len(hot) - 1)] == sig if len(hot) else np.zeros(len(sig), bool)
            for flag in (False, True):
                at = np.flatnonzero(often == flag)
                if not len(at):
                    continue
                to = tk.mix(own[at]) % U64(places) if flag else place[at]
                keys = (place[at] << U64(32)) | key[at] if flag else key[at].astype(np.uint32)
                order = np.argsort(to.astype(np.int32), kind="stable")
                to, keys, held = to[order], keys[order], own[at][order]
                cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                ends = np.r_[cut, len(to)].astype(np.int32)
                packed = lambda x: pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(ends * np.int32(x.itemsize)), pa.py_buffer(np.ascontiguousarray(x))])  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(to[cut].astype(np.int32)), pa.array(np.full(len(cut), flag)), packed(keys), packed(held)], ["place", "often", "keys", "ids"])

    return pack


def _rank(ids: np.ndarray) -> np.ndarray:
    """An order of all sets that has nothing to do with their contents: the hub of a group is its member of the highest rank."""
    return tk.mix(ids.view(U64) ^ U64(0x9B05688C2B3E6C1F)) >> U64(1)


def _hubs(batches):
    """Groups of a partition, as rows ``key, a, b``: each member b of a group with its hub a, once; where the signature is frequent the group
    is elsewhere too, so its key and b, with a null."""
    keys, ids, often = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for b in batches:
        for place, flag, k, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
            raw = k.as_buffer()
            keys.append(np.frombuffer(raw, np.int64) if flag else np.frombuffer(raw, np.uint32).astype(np.int64) | (place << 32))
            ids.append(np.frombuffer(i.as_buffer(), np.int64))
            often.append(np.full(len(ids[-1]), flag))
    key, ids, often = (np.concatenate(x) for x in (keys, ids, often))
    del keys
    out = lambda k, a, b: pa.RecordBatch.from_arrays([k, a, b], ["key", "a", "b"])
    if often.any():
        rows = np.unique(np.stack([key[often], ids[often]]), axis=1)
        yield out(pa.array(rows[0]), pa.nulls(rows.shape[1], pa.int64()), pa.array(rows[1]))
        key, ids = key[~often], ids[~often]
    if not len(key):
        return
    order = np.lexsort((_rank(ids), key))
    key, ids = key[order], ids[order]
    last = np.flatnonzero(np.r_[key[1:] != key[:-1], True])
    hub = np.repeat(ids[last], np.diff(np.r_[-1, last]))
    met = hub != ids
    hub, ids = hub[met], ids[met]
    order = np.lexsort((ids, hub))
    hub, ids = hub[order], ids[order]
    fresh = np.r_[True, (hub[1:] != hub[:-1]) | (ids[1:] != ids[:-1])] if len(hub) else np.zeros(0, bool)
    yield out(pa.nulls(int(fresh.sum()), pa.int64()), pa.array(hub[fresh]), pa.array(ids[fresh]))


def _hub_pairs(text: DataFrame, percent: int, n_docs: int, n_shingles: int) -> DataFrame:
    """``a, b``: each member b of a group, the sets with one signature, with the hub a of the group.  A first look at some documents tells which signatures a large part
    of all sets have; their rows are dealt to many partitions."""
    spark = text.sparkSession
    share = min(1.0, _PROBE_DOCS / max(1, n_docs))
    probe = text.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    counts = probe.mapInArrow(_signer(percent), "signature long").groupBy("signature").agg(F.count("*").alias("n")).where(F.col("n") >= _FREQUENT)
    keys = [r[0] for r in counts.orderBy(F.desc("n"), "signature").limit(_MOST_FREQUENT).select("signature").collect()]
    frequent = spark.sparkContext.broadcast(np.sort(np.array(keys, np.int64).view(U64)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_shingles // _SIG_ROWS))
    packed = text.mapInArrow(_packer(percent, 4 * parts, frequent), "place int, often boolean, keys binary, ids binary")
    found = materialize(packed.repartition(parts, "place").mapInArrow(_hubs, "key long, a long, b long"), "jaccard-groups")
    spread = found.where("key is not null").select("key", "b")
    hubs = spread.groupBy("key").agg(F.max(F.struct(F.xxhash64("b").alias("rank"), "b")).alias("top"))  # frequent signatures only
    far = spread.join(F.broadcast(hubs), "key").select(F.col("top.b").alias("a"), "b").where("a <> b")
    return found.where("key is null").select("a", "b").unionByName(far).distinct()


def _bit_places(ids: np.ndarray, bits: int) -> np.ndarray:
    x = tk.mix(ids.view(U64) ^ U64(0x510E527FADE682D1))
    return np.stack([(x & U64(bits - 1)).astype(np.int64), ((x >> U64(32)) & U64(bits - 1)).astype(np.int64)])


def _bloom(ids: DataFrame, n: int) -> np.ndarray:
    """Bit table of ids, at most 64 MB; it only spares sets the way to the exact semi-join."""
    bits = 1 << min(29, max(16, int(8 * n).bit_length()))

    def fill(batches):
        table = np.zeros(bits, bool)
        for b in batches:
            table[_bit_places(b.column(0).to_numpy(), bits).ravel()] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(table).tobytes()], pa.binary())], ["bits"])

    out = np.zeros(bits // 8, np.uint8)
    for row in ids.coalesce(4).mapInArrow(fill, "bits binary").toLocalIterator():
        out |= np.frombuffer(row[0], np.uint8)
    return out


SKETCH = 512


def sketches(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``SKETCH`` parity bits of each set, as rows of 64-bit words: bit b tells whether an odd number of members hash to b.  The sketches
    of two sets differ in at most as many bits as the sets in members."""
    out = np.zeros((len(bounds) - 1, SKETCH // 64), np.int64)
    for lo in range(0, len(out), 2048):
        hi = min(len(out), lo + 2048)
        part = flat[bounds[lo] : bounds[hi]]
        place = np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1])) * SKETCH + (tk.mix(part ^ U64(0x6A09E667F3BCC909)) & U64(SKETCH - 1)).astype(np.int64)
        odd = (np.bincount(place, minlength=(hi - lo) * SKETCH) & 1).astype(np.uint8).reshape(hi - lo, SKETCH)
        out[lo:hi] = np.packbits(odd, axis=1).view(np.int64)
    return out


def wide_sketches(flat: np.ndarray, bounds: np.ndarray) -> list[np.ndarray | None]:
    """Longer sketches of sets of more than ``SKETCH`` members, as 64-bit words: as many bits as members, up to the next power of two.  A
    sketch folds to a shorter one by adding up its parts modulo 2."""
    out: list[np.ndarray | None] = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo <= SKETCH:
            out.append(None)
            continue
        bits = 1 << (hi - lo - 1).bit_length()
        place = (tk.mix(flat[lo:hi] ^ U64(0x6A09E667F3BCC909)) & U64(bits - 1)).astype(np.int64)
        out.append(np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).view(np.int64))
    return out


def _apart(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two wide sketches differ, the longer one folded; at most as many as the sets differ in members."""
    n = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(x.reshape(-1, n), axis=0) for x in (a, b))
    return int(np.bitwise_count((a ^ b).view(U64)).sum())


def _filtered(batches, bloom):
    """Sets whose ids pass the bit table, once a task: ids, members flat and bounds."""
    table, seen = bloom.value, _Seen()
    for _, _, _, flat, bounds in _batches(batches):
        ids = tk.set_ids(flat, bounds)
        at = _bit_places(ids, len(table) * 8)
        hit = ((table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0) & (ids != 0)
        hit[hit] = seen.fresh(ids[hit])
        yield ids[hit], *_pick(flat, bounds, hit)


def _sets_of(text: DataFrame, ids: DataFrame, of, columns: str, label: str) -> DataFrame:
    """A table with a row for each set id of ``ids`` and what ``of(flat, bounds)`` gives for the sets in the texts."""
    bloom = text.sparkSession.sparkContext.broadcast(_bloom(ids, ids.count()))

    def read(batches):
        for own, flat, bounds in _filtered(batches, bloom):
            yield pa.RecordBatch.from_arrays([_long(own), *of(flat, bounds)], names)

    names = ["set_id", *[c.split()[0] for c in columns.split(", ")]]
    rows = text.mapInArrow(read, f"set_id long, {columns}")
    return materialize(rows.join(ids, "set_id", "left_semi").dropDuplicates(["set_id"]), label)


def _list_members(flat, bounds):
    return [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), _long(flat))]


def _list_sketches(flat, bounds):
    marks = sketches(flat, bounds)
    cuts = pa.array(np.arange(len(marks) + 1) * (SKETCH // 64), pa.int32())
    return [_long(np.diff(bounds)), pa.ListArray.from_arrays(cuts, pa.array(marks.ravel())), pa.array(wide_sketches(flat, bounds), pa.list_(pa.int64()))]


def _ids_of(pairs: DataFrame) -> DataFrame:
    return materialize(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), "jaccard-ids")


def _differences(percent: int):
    """Sorted rows ``a, slice, b, members``, the row of the hub a itself (b null) first, to pairs ``a, b`` of similar sets.  Only the hub's
    members are held."""

    def run(batches):
        at, hub = None, None
        for batch in batches:
            a, part, b, lists = batch.columns
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(U64)
            ends = lists.offsets.to_numpy().astype(np.int64)
            ends -= ends[0]
            a, part = a.to_numpy(zero_copy_only=False), part.to_numpy(zero_copy_only=False)
            own = np.array(b.is_null())
            b = b.fill_null(0).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (part[1:] != part[:-1])]) if len(a) else np.zeros(0, np.int64)
            out_a, out_b = [], []
            for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(a)]):
                if own[lo]:
                    at, hub = (a[lo], part[lo]), flat[ends[lo] : ends[lo + 1]].copy()
                    lo += 1
                if lo == hi:
                    continue
                assert at == (a[lo], part[lo])
                values = flat[ends[lo] : ends[hi]]
                shared = np.r_[0, np.cumsum(hub[np.minimum(np.searchsorted(hub, values), len(hub) - 1)] == values)]
                size = np.diff(ends[lo : hi + 1])
                both = len(hub) + size
                differ = both - 2 * (shared[ends[lo + 1 : hi + 1] - ends[lo]] - shared[ends[lo:hi] - ends[lo]])
                near = differ * (100 + percent) <= both * (100 - percent)
                out_a.append(a[lo:hi][near])
                out_b.append(b[lo:hi][near])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return run


def _similar(text: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Table of those of the pairs ``a, b`` of set ids that are similar.  ``pairs``: a table.  Only the sets of these pairs are read again
    from the texts.  The members of b go to the place of a; a set a in very many pairs is repeated in several places."""
    ids = _ids_of(pairs)
    members = _sets_of(text, ids, _list_members, "members array<long>", "jaccard-members")
    total, own = pairs.count(), members
    share = max(_LARGE_HUB, total // LARGE_KEYS)
    times = pairs.groupBy("a").agg(F.count("*").alias("n"))
    slices = F.ceil(F.col("n") / share).cast("int")
    large = times.where(F.col("n") > share).select("a", slices.alias("slices"))
    dealt = pairs.join(F.broadcast(large), "a", "left").withColumn("slice", F.coalesce(F.pmod(F.xxhash64("b"), "slices"), F.lit(0)).cast("int"))
    right = dealt.select("a", "slice", "b").join(own.withColumnRenamed("set_id", "b"), "b").select("a", "slice", "b", "members")
    left = times.join(own.withColumnRenamed("set_id", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), F.lit(None).cast("long").alias("b"), "members")
    rows = left.unionByName(right).repartition("a", "slice").sortWithinPartitions("a", "slice", F.asc_nulls_first("b"))
    out = materialize(rows.mapInArrow(_differences(percent), "a long, b long"), "jaccard-links")
    forget(ids, members)
    return out


_WORDS = [f"s{k}" for k in range(SKETCH // 64)]
_APART = " + ".join(f"bit_count({w} ^ {w}_)" for w in _WORDS)


def _marks(marks: DataFrame, name: str, tail: str = "") -> DataFrame:
    """Sizes and sketches of sets, under the given name of the set and with a tail to the other names."""
    return marks.select(F.col("set_id").alias(name), F.col("size").alias(f"size{tail}"), *[F.col("sketch")[k].alias(w + tail) for k, w in enumerate(_WORDS)])


def _may_be_similar(percent: int) -> str:
    return f"({_APART}) * {100 + percent} <= (size + size_) * {100 - percent}"


def _near(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` whose sketches are near enough for similar sets, so that the members of few sets are read.  Large sets are
    compared by their wide sketches too."""
    left = pairs.groupBy("a").agg(F.count("*").alias("n")).join(_marks(marks, "a"), "a")
    met = salted_join(pairs, left, "a", pairs.count(), "b", least=_LARGE_HUB).join(_marks(marks, "b", "_"), "b")
    met = materialize(met.where(_may_be_similar(percent)).select("a", "b", "size", "size_"), "jaccard-met")
    large = F.least("size", "size_") > SKETCH
    wide = marks.where("wide is not null").select("set_id", "wide")
    both = met.where(large).join(wide.select(F.col("set_id").alias("a"), F.col("wide").alias("p")), "a").join(wide.select(F.col("set_id").alias("b"), F.col("wide").alias("q")), "b")

    def compare(batches):
        for batch in batches:
            n, m = (batch.column(k).to_numpy() for k in (2, 3))
            apart = np.array([_apart(p.values.to_numpy(), q.values.to_numpy()) for p, q in zip(batch.column(4), batch.column(5))], np.int64)
            near = pa.array(apart * (100 + percent) <= (n + m) * (100 - percent))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], ["a", "b"])

    return met.where(~large).select("a", "b").unionByName(both.select("a", "b", "size", "size_", "p", "q").mapInArrow(compare, "a long, b long"))


def _open_pairs(tested: DataFrame, found: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of members of one hub that are in different components and whose sketches are near enough for similar sets.  Members
    of a group have a hub in common, so no similar pair is missed.  The test is part of the join; what fails it is not made.  The
    members of a large hub are dealt into blocks, and each two blocks meet in a place of their own."""
    rows = tested.select(F.col("a").alias("hub"), F.col("b").alias("x")).join(found.select(F.col("node").alias("x"), "component"), "x", "left")
    rows = rows.select("hub", "x", F.coalesce("component", "x").alias("c"))
    mixed = rows.groupBy("hub").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n"), F.ceil(F.count("*") / _BLOCK).cast("int").alias("blocks")).where("lo < hi").drop("lo", "hi")
    rows = salted_join(rows, mixed, "hub", tested.count(), "x", least=_LARGE_HUB).join(_marks(marks, "x"), "x")
    rows = materialize(rows.withColumn("block", F.pmod(F.xxhash64("x", F.lit(5)), "blocks").cast("int")), "jaccard-open")
    own = rows.select("hub", "x", "c", "size", *_WORDS, F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    other = rows.select("hub", *[F.col(c).alias(f"{c}_") for c in ("x", "c", "size", *_WORDS)], F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"))
    met = own.join(other, ["hub", "i", "j"]).where(f"(i < j or x < x_) and c <> c_ and {_may_be_similar(percent)}")
    return met.select(F.least("x", "x_").alias("a"), F.greatest("x", "x_").alias("b")).distinct()


def document_sets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, set_id, n_shingles`` of every row; set_id is null where there is no shingle."""
    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_sizes, f"doc_id {kind}, set_id long, n_shingles long")


def similar_sets(df: DataFrame, sets: DataFrame, text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Components over set ids (``node, component``); sets without a link do not appear.  ``sets``: of document_sets()."""
    spark = df.sparkSession
    text = df.select(F.col(text_col).cast("string").alias("text"))
    n_docs, n_shingles = sets.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    tested = materialize(_hub_pairs(text, percent, n_docs, n_shingles), "jaccard-tested")
    if tested.isEmpty():
        return spark.createDataFrame([], "node long, component long")
    ids = _ids_of(tested)
    marks = _sets_of(text, ids, _list_sketches, "size long, sketch array<long>, wide array<long>", "jaccard-marks")
    near = materialize(_near(tested, marks, percent), "jaccard-near")
    links = _similar(text, near, percent)
    found = materialize(connected_components(links), "jaccard-components")
    open_pairs = materialize(_open_pairs(tested, found, marks, percent), "jaccard-pairs")
    near_too = materialize(_near(open_pairs, marks, percent), "jaccard-near")
    forget(ids, marks, tested, near, open_pairs)
    if near_too.isEmpty():
        return found
    more = _similar(text, near_too, percent)
    return found if more.isEmpty() else connected_components(links.unionByName(more))


def _named(own: DataFrame, found: DataFrame) -> DataFrame:
    """``set_id, component, component_id`` of sets ``own(set_id, m)``, m being the smallest id of a set: the component's smallest id."""
    labelled = own.join(found.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    labelled = materialize(labelled, "jaccard-named")
    least = labelled.groupBy("component").agg(F.min("m").alias("component_id"), F.count("*").alias("n"))
    return salted_join(labelled, least, "component", labelled.count(), "set_id", least=256).select("set_id", "component", "component_id")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    Two rows link when the Jaccard similarity of their shingle sets is at least ``percent`` %; component_id is the
    smallest id reachable by links, the row's own id included.  Rows without words or with null text have no shingles
    and link with nothing, so component_id is their own id.  Rows with a null id take part in links; null is never the
    smallest id unless all ids of a component are null.  Repeated rows link as copies do.  Other columns are ignored; an
    empty table gives no rows.
    """
    sets = materialize(document_sets(df, id_col, text_col), "jaccard-sets")
    return _labelled(sets, _components(df, sets, text_col, percent)[1])


def _components(df, sets, text_col, percent):
    """Number of rows of the sets, and ``set_id, component, component_id, n``, n being the number of rows with that set."""
    own = sets.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("m"), F.count("*").alias("n"))
    own = materialize(own, "jaccard-own")
    return own.select("set_id", "n"), _named(own.drop("n"), similar_sets(df, sets, text_col, percent)).join(own.drop("m"), "set_id")


def _labelled(sets: DataFrame, named: DataFrame) -> DataFrame:
    alone = sets.where("set_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    rows = salted_join(sets.where("set_id is not null").withColumn("_any", F.monotonically_increasing_id()), named.select("set_id", "component_id", "n"), "set_id", sets.count(), "_any", least=_LARGE_HUB)
    return rows.select("doc_id", "n_shingles", "component_id").unionByName(alone)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row of each group of similar rows, the one with the smallest id; columns as in ``df``, whatever their names.

    Rows without shingles (null text, no words) all stay.  A null id comes after all others.  Of rows of a group with the same
    id the one whose text has the smallest md5 stays; rows that are equal in both are repeats, of which one stays.  An empty table
    gives no rows.
    """
    sets = materialize(document_sets(df, id_col, text_col), "jaccard-sets")
    _, named = _components(df, sets, text_col, percent)
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if sets.where("doc_id is null").isEmpty() and sets.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = named.select(F.col("component_id").alias("key")).distinct().unionByName(sets.where("set_id is null").select(F.col("doc_id").alias("key")))
        return packed.join(kept, "key", "left_semi").select("row.*")
    # ids do not tell rows apart: each row goes by its own set
    at = F.struct(F.col("key").isNull().alias("none"), "key", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))
    own = packed.withColumn("at", at).mapInArrow(_set_of_row, T.StructType([*packed.schema.fields, T.StructField("at", packed.select(at.alias("at")).schema[0].dataType), T.StructField("set_id", T.LongType())]))
    own = materialize(own, "jaccard-rows")
    mine = salted_join(own.where("set_id is not null").withColumn("any", F.monotonically_increasing_id()), named.select("set_id", "component", "n"), "set_id", sets.count(), "any", least=_LARGE_HUB)
    once = mine.groupBy("component").agg(F.min_by("row", "at").alias("row"))
    return once.select("row.*").unionByName(own.where("set_id is null").select("row.*"))


def _set_of_row(batches):
    for batch in batches:
        ids = []
        data, offsets = tk.utf8(batch.column(batch.schema.get_field_index("text")))
        for lo, hi in tk.chunks(offsets):
            ids.append(tk.set_ids(*tk.shingle_sets(data, offsets[lo : hi + 1])))
        ids = np.concatenate(ids) if ids else np.zeros(0, U64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids.view(np.int64), mask=ids == 0)], [*batch.schema.names, "set_id"])
