"""Periodic runs of words, by the Lempel-Ziv factors of each text.

Suffix array and common prefixes of a text give, for each word, the longest earlier occurrence of what follows (the
longest-previous-factor array); its greedy reading is a row of blocks.  Every run either touches the border of two blocks,
and is found there by extending a pair of words one period apart to both sides, or lies inside a block, and is the copy of a
run inside the block's earlier occurrence.  A batch of texts is worked on at once: equal words of two texts count as
different letters, so nothing reaches from one text into another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm import textkernel as tk

#: Texts of about so many bytes are worked on at once; a longer text alone.
_CHUNK = 1 << 20


def _order(key: np.ndarray) -> np.ndarray:
    """Stable order of non-negative keys; where key and place fit one number, by sorting those."""
    bits = len(key).bit_length()
    if int(key.max(initial=0)) < 1 << (63 - bits):
        packed = (key << bits) | np.arange(len(key))
        packed.sort()
        return packed & ((1 << bits) - 1)
    return np.argsort(key, kind="stable")


def _heads(sorted_keys: np.ndarray) -> np.ndarray:
    """For each place of a sorted array the first place with an equal key."""
    first = np.ones(len(sorted_keys), bool)
    first[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.maximum.accumulate(np.where(first, np.arange(len(sorted_keys)), 0))


def ranks(letters: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Row k ranks the windows of 2**k letters: equal windows have equal ranks, and the last row is the inverse of the suffix
    array.  ``ends``: where each letter's text ends; no letter may occur in two texts.  Windows that reach beyond their text
    equal no other.  A last column of -1 stands for the end.  Only what is not told apart yet is sorted again."""
    n = len(letters)
    order = _order(letters)
    heads = _heads(letters[order])
    level = np.full(n + 1, -1, np.int32)
    level[order] = heads
    out = [level]
    size = 1
    while True:
        many = np.bincount(out[-1][:n], minlength=n) if n else np.zeros(0, int)
        left = np.flatnonzero(many[out[-1][:n]] > 1)
        if not len(left):
            return np.stack(out)
        own = out[-1][left].astype(np.int64)
        after = left + size
        after = np.where(after < ends[left], out[-1][np.minimum(after, n)] + 1, 0)
        key = own * (n + 1) + after
        order = _order(key)
        own, key = own[order], key[order]
        level = out[-1].copy()
        level[left[order]] = own + _heads(key) - _heads(own)
        out.append(level)
        size *= 2


def common(rows: np.ndarray, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """Length of the longest common prefix of what starts at a and at b, or of the longest common suffix of what ends before them."""
    n = rows.shape[1] - 1
    out = np.zeros(len(a), np.int64)
    for k in range(len(rows) - 1, -1, -1):
        step = out + (1 << k) if back else -out
        x, y = a - step, b - step
        if back:
            same = (x >= 0) & (y >= 0) & (rows[k][np.maximum(x, 0)] == rows[k][np.maximum(y, 0)])
        else:
            same = (x < n) & (y < n) & (rows[k][np.minimum(x, n)] == rows[k][np.minimum(y, n)])
        out[same] += 1 << k
    return out


def previous_factors(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each letter the length of the longest factor from there that also starts earlier, and such an earlier start: the nearest
    suffixes in the suffix array that start earlier, on either side, with the least common prefix on the way."""
    n = rows.shape[1] - 1
    suffix = np.empty(n, np.int64)
    suffix[rows[-1][:n]] = np.arange(n)
    shared = np.zeros(n + 1, np.int64)
    beside = 1 + np.flatnonzero(rows[0][suffix[1:]] == rows[0][suffix[:-1]])
    shared[beside] = common(rows, suffix[beside - 1], suffix[beside])
    longest, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for side in (-1, 1):
        to = np.arange(n) + side
        low = shared[:n].copy() if side < 0 else shared[1:].copy()
        active = np.flatnonzero(low > 0)
        while len(active):
            active = active[suffix[to[active]] > suffix[active]]
            over = to[active]
            low[active], to[active] = np.minimum(low[active], low[over]), to[over]
            active = active[low[active] > 0]
        better = np.flatnonzero(low > longest[suffix])
        longest[suffix[better]], source[suffix[better]] = low[better], suffix[to[better]]
    return longest, source


def blocks(longest: np.ndarray) -> np.ndarray:
    """Starts of the blocks: each is the longest factor that also starts earlier, or one letter."""
    following = (np.arange(len(longest)) + np.maximum(longest, 1)).tolist()
    out, at = [], 0
    while at < len(following):
        out.append(at)
        at = following[at]
    return np.array(out, np.int64)


def _touching(rows, starts, lengths, first_of_text, ends, least: int, times: int):
    """Runs that contain or touch a border of blocks: ``start, end, period`` with the smallest period of each."""
    n = rows.shape[1] - 1
    before = np.r_[0, lengths[:-1]] * ~first_of_text
    last = np.r_[first_of_text[1:], True]
    border, far = np.r_[starts, ends[starts[last]]], np.r_[before + lengths, lengths[last]]
    text_end = np.r_[ends[starts], ends[starts[last]]]
    text_start = starts[np.maximum.accumulate(np.where(first_of_text, np.arange(len(starts)), 0))]
    text_start = np.r_[text_start, text_start[last]]
    # a run of ``times`` periods that ends in this block begins at most a period before the last one
    most = far // (times - 1)
    at = np.repeat(np.arange(len(border)), most)
    period = np.arange(len(at)) - np.repeat(np.cumsum(most) - most, most) + 1
    found = []
    for right in (True, False):
        x = border[at] - (0 if right else period)
        y = x + period
        fits = (x >= text_start[at]) & ((y < text_end[at]) | (not right))
        x, y, p = x[fits], y[fits], period[fits]
        # one of the two extensions has half of what is wanted: windows of that size are equal
        k = np.frexp(((times - 1) * p + 1) // 2)[1] - 1
        within = k < len(rows)
        x, y, k = x[within], y[within], k[within]
        flat, wide = rows.reshape(-1), rows.shape[1]
        bx, by = x - (1 << k), y - (1 << k)
        near = (flat[k * wide + x] == flat[k * wide + np.minimum(y, n)]) | ((bx >= 0) & (flat[k * wide + np.maximum(bx, 0)] == flat[k * wide + np.maximum(by, 0)]))
        x, y = x[near], y[near]
        s, e = x - common(rows, x, y, back=True), y + common(rows, x, y)
        good = e - s >= np.maximum(least, times * (y - x))
        found.append(np.stack([s, e, y - x])[:, good])
    s, e, p = np.concatenate(found, axis=1)
    order = np.lexsort((p, e, s))
    s, e, p = s[order], e[order], p[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    return s[fresh], e[fresh], p[fresh]


def runs(letters: np.ndarray, ends: np.ndarray, least: int, times: int) -> np.ndarray:
    """All runs of at least ``least`` letters and ``times`` periods: rows ``start, end, period``, by start and period."""
    if not len(letters):
        return np.zeros((0, 3), np.int64)
    rows = ranks(letters, ends)
    longest, source = previous_factors(rows)
    starts = blocks(longest)
    lengths = np.diff(np.r_[starts, len(letters)])
    first_of_text = np.r_[True, ends[starts[1:]] != ends[starts[:-1]]]
    s, e, p = _touching(rows, starts, lengths, first_of_text, ends, least, times)
    bucket: dict[int, list] = {}
    for a, b, q in zip(s.tolist(), e.tolist(), p.tolist()):
        bucket.setdefault(a, []).append((b, q))
    # runs inside a block are copied from its earlier occurrence, block by block, by their start
    holds = np.zeros(len(letters) + 1, bool)
    holds[s] = True
    texts = np.unique(ends[s])
    at = np.flatnonzero(np.isin(ends[starts], texts) & (lengths > least + 1))
    for b, n, src in zip(starts[at].tolist(), lengths[at].tolist(), source[starts[at]].tolist()):
        for lo in range(src + 1, src + n, max(1, b - src)):  # what is copied in may be copied on
            hi = min(src + n, lo + b - src)
            for a in (lo + np.flatnonzero(holds[lo:hi])).tolist():
                inside = [(c + b - src, q) for c, q in bucket[a] if c < src + n]
                if inside:
                    bucket.setdefault(a + b - src, []).extend(inside)
                    holds[a + b - src] = True
    out = sorted((a, q, b) for a, found in bucket.items() for b, q in found)
    return np.array([(a, b, q) for a, q, b in out], np.int64).reshape(-1, 3)


def _kept(words: list, found: list) -> bytes:
    """The words that no run has after its first period, joined by one space."""
    if not found:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int32)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    stay = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([words[i] for i in stay.tolist()])


def _worked(data: np.ndarray, offsets: np.ndarray, least: int, times: int):
    """Runs, number of words and collapsed text of each text of a batch."""
    ids: dict[bytes, int] = {}
    texts = [data[offsets[i] : offsets[i + 1]].tobytes().split() for i in range(len(offsets) - 1)]
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.fromiter((ids.setdefault(w, len(ids)) for t in texts for w in t), np.int64, int(sizes.sum()))
    begins = np.cumsum(sizes) - sizes
    found = runs(codes + np.repeat(np.arange(len(texts)), sizes) * len(ids), np.repeat(begins + sizes, sizes), least, times)
    of = np.searchsorted(begins, found[:, 0], side="right") - 1
    each: list[list] = [[] for _ in texts]
    for i, (start, end, period) in zip(of.tolist(), found.tolist()):
        each[i].append((start - int(begins[i]), end - start, period))
    return each, sizes, [_kept(w, r) for w, r in zip(texts, each)]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """``id_col, n_words, runs, collapsed`` of every row: runs of at least ``least`` words and ``times`` periods (two or more), as
    ``start, length, period`` by start and period, and the text without the words that a run has after its first period, its words
    joined by one space.

    Words are maximal runs of other bytes than white space (0x20, 0x09 to 0x0D), equal byte by byte; they are numbered from 0.  A null
    text counts as empty: no words, no runs, an empty collapsed text.  Repeated rows and null ids are rows like others, other
    columns are ignored, and an empty table gives no rows.  Whole texts are read, in about 150 bytes a word and one
    number more for each doubling of the longest repeat.
    """
    if times < 2:
        raise ValueError("a run has two periods at least")

    def work(batches):
        for b in batches:
            data, offsets = tk.utf8(b.column(1))
            found, sizes, texts = [], [], []
            for lo, hi in tk.chunks(offsets, _CHUNK):
                part = _worked(data, offsets[lo : hi + 1], least, times)
                for whole, piece in zip((found, sizes, texts), part):
                    whole.extend(piece)
            rows = [[dict(zip(("start", "length", "period"), r)) for r in f] for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(rows, pa.list_(_RUN)), pa.array(texts, pa.binary()).cast(pa.string())], [id_col, "n_words", "runs", "collapsed"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(work, f"`{id_col}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: of every tenth document by the crc32 of its id, the words from a place on repeat with a period; place and
    period come from the same number.  Null ids count as the empty text."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    whole = F.array_join(F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), again), F.lit(1), F.col("n")), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), whole).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """Runs of the planted documents, with digests: the run of the greatest exponent (the first by start, then by period, in a tie),
    all runs and the collapsed text."""
    out = find_runs(planted(docs))
    # a / p > b / q as a * q > b * p; runs come by start and period, and only a greater one takes the place of the best
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    b = F.col("best")
    return out.select("doc_id", "n_runs", b["start"].alias("start"), b["length"].alias("length"), b["period"].alias("period"), F.floor(F.lit(1000) * b["length"] / b["period"]).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
