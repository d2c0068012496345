"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

The symbols are words (ASCII letters in lower case, white space and ASCII punctuation are separators).  The CGK random walk
reads a window symbol by symbol: at step j it emits the symbol under its pointer, and a random function of step and symbol
tells whether the pointer moves on.  Two windows at a small edit distance fall back into step after an edit, so their
embeddings agree at many steps (small Hamming distance), and a few sampled steps agree with good probability.  A repetition
is one walk with one sample of its steps; its key folds the sampled symbols.

Windows are as large as the item: an item of n words is embedded in windows of the largest length of ``LENGTHS`` that n
reaches, from each of its words, and so is a document, once for each length that the items use.  A window of L words is
walked for 2 L steps, which reads it to its end on average.  An item longer than the last length has, by the pigeonhole
principle, a window with no more than its share of the edits.  Items that allow no edit (fewer than five words) need
one repetition, since equal windows have equal embeddings; the others get several walks (``WALKS``) with three samples each,
so that the recall of items of every length, with the most edits allowed, reaches ``TARGET`` (a test measures it).
Candidates are verified by the exact edit distance between the whole item and the best passage of the document around it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from thalweg.llm import textkernel as tk

#: A passage matches an item of n words within n * (100 - PERCENT) // 100 word edits.
PERCENT = 80
#: Walks by length of window in words; an item uses the largest length that it reaches.  Shorter windows need more walks.
WALKS = {1: 10, 2: 10, 3: 10, 4: 10, 5: 10, 6: 8, 8: 6, 10: 5, 12: 4}
LENGTHS = tuple(WALKS)
#: For each walk the parts of it that a sample of steps is taken from, and the steps sampled.
SPANS, SAMPLED = (0.3, 0.6, 1.0), 5
#: The recall that these repetitions reach at the default ``percent``.
TARGET = 0.99
#: An item's window is used in a repetition if its sample holds so many different places, or half of a shorter window, or as
#: many as the item has at best.
DIFFERENT = 3
#: Items handled in one pass over the documents, so that what is sent to the workers stays small.
BLOCK_ITEMS, BLOCK_WORDS = 4096, 1_000_000
#: Candidates gathered before they are verified, so that a frequent key takes no more memory.
BATCH_PAIRS = 1 << 20
#: Windows walked at a time.
BATCH_WINDOWS = 1 << 15
U64 = np.uint64
_CELL_BITS = 22


def walks(length: int, edits: bool = True, seed: int = 7):
    """The walks of windows of ``length`` words: which hash bit decides each step, and samples of steps, each beginning with
    step 0.  Where no item of the length allows edits there is one walk, sampled at every step."""
    rng = np.random.default_rng([seed, length])
    steps = 2 * length
    if not edits:
        return [(rng.integers(0, 64, steps), [np.arange(steps)])]
    out = []
    for _ in range(WALKS[length]):
        samples = []
        for span in SPANS:
            reach = max(min(SAMPLED, steps), int(span * steps))
            samples.append(np.r_[0, np.sort(1 + rng.choice(reach - 1, min(SAMPLED, reach) - 1, replace=False))])
        out.append((rng.integers(0, 64, steps), samples))
    return out


def window_keys(hashes: np.ndarray, starts: np.ndarray, last: np.ndarray, walk, count: bool = False):
    """For each sample of a walk the keys of the windows at ``starts``, whose last words are ``last``; there the walk stays.
    With ``count`` also the number of different places sampled."""
    bits, samples = walk
    keys = [np.zeros(len(starts), U64) for _ in samples]
    different = [np.zeros(len(starts), np.int64) for _ in samples]
    seen = [np.full(len(starts), -1) for _ in samples]
    wanted = [set(s.tolist()) for s in samples]
    at, final = starts.copy(), max(int(s[-1]) for s in samples)
    for step in range(final + 1):
        symbol = hashes[at]
        for k, steps in enumerate(wanted):
            if step in steps:
                key = (keys[k] ^ symbol) * U64(0x9E3779B97F4A7C15)
                keys[k] = key ^ (key >> U64(29))
                if count:
                    different[k] += at != seen[k]
                    seen[k] = at.copy()
        if step < final:
            at += ((symbol >> U64(bits[step])) & U64(1)).astype(np.int64)
            np.minimum(at, last, out=at)
    return (keys, different) if count else keys


def _texts_words(texts) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = tk.utf8(pa.array(texts, pa.string()))
    return tk.words(data, offsets, space=tk.PUNCTUATION)


def _cell(keys: np.ndarray) -> np.ndarray:
    return (keys >> U64(64 - _CELL_BITS)).astype(np.int64)


class Items:
    """A block of items: their words and, for each length of window and each repetition, the sorted keys of all windows with the
    place each begins at."""

    def __init__(self, texts, percent: int = PERCENT):
        self.hashes, self.before = _texts_words(texts)
        size = np.diff(self.before)
        self.item = np.repeat(np.arange(len(size)), size)
        length = np.array([0, *LENGTHS])[np.searchsorted(LENGTHS, size, side="right")]
        self.lengths = []
        for n in np.unique(length[length > 0]).tolist():
            edits = bool((size[length == n] * (100 - percent) // 100).any())
            starts = np.flatnonzero(length[self.item] == n) if edits else self.before[:-1][length == n]
            last = np.minimum(starts + n, self.before[self.item[starts] + 1]) - 1
            tables, family = [], walks(n, edits)
            for walk in family:
                for keys, different in zip(*window_keys(self.hashes, starts, last, walk, count=True)):
                    # a sample that stood still, or met the end, tells too little, but each item keeps its best
                    best = np.zeros(len(size), np.int64)
                    np.maximum.at(best, self.item[starts], different)
                    telling = np.flatnonzero(different >= np.minimum(min(DIFFERENT, n // 2), best[self.item[starts]]))
                    order = telling[np.argsort(keys[telling], kind="stable")]
                    tables.append((keys[order], starts[order].astype(np.int32)))
            self.lengths.append((n, family, tables, np.unique(self.hashes[starts])))

    def cells(self):
        """Bit tables by length: of words that begin a window, and of the keys of each repetition."""
        out = []
        for _, _, tables, first in self.lengths:
            marks = []
            for keys in [first, *(keys for keys, _ in tables)]:
                table = np.zeros(1 << _CELL_BITS, bool)
                table[_cell(keys)] = True
                marks.append(table)
            out.append(marks)
        return out


def edit_distances(items, regions, allowed=None) -> tuple[np.ndarray, np.ndarray]:
    """For each (item, region), arrays of word hashes: the least edit distance between the item and a passage of the
    region, and where that passage ends.  With ``allowed``, distances above it may be reported as the item's length: an item
    that has more words missing from the region than that is not aligned."""
    rows, width = max(map(len, items)), max(map(len, regions))
    n, m = np.array([len(x) for x in items]), np.array([len(x) for x in regions])
    a, b = np.zeros((len(items), rows), U64), np.zeros((len(items), width), U64)
    for k, (x, y) in enumerate(zip(items, regions)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    if allowed is not None:
        found = ((a[:, :, None] == b[:, None, :]) & (np.arange(width) < m[:, None])[:, None, :]).any(axis=2)
        missing = (~found & (np.arange(rows) < n[:, None])).sum(axis=1)
        near = np.flatnonzero(missing <= allowed)
        best, end = n.astype(np.int64), np.zeros(len(items), np.int64)
        if len(near):
            best[near], end[near] = edit_distances([items[k] for k in near], [regions[k] for k in near])
        return best, end
    slope = np.arange(width + 1)
    d = np.zeros((len(items), width + 1), np.int64)
    best, end = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    beyond = slope[None, :] > m[:, None]
    for i in range(rows + 1):
        if i:
            t = np.empty_like(d)
            t[:, 0] = i
            t[:, 1:] = np.minimum(d[:, 1:] + 1, d[:, :-1] + (b != a[:, i - 1 : i]))
            d = np.minimum.accumulate(t - slope, axis=1) + slope
        done = n == i
        if done.any():
            final = np.where(beyond[done], 1 << 40, d[done])
            best[done], end[done] = final.min(axis=1), final.argmin(axis=1)
    return best, end


def _hits(hashes, last, items: Items, cells):
    """For each repetition: its table, the words of the document at which a window has a key of the table, and those keys."""
    for (length, family, tables, _), (begins, *marks) in zip(items.lengths, cells):
        starts = np.flatnonzero(begins[_cell(hashes)])
        found = [([], []) for _ in tables]
        for lo in range(0, len(starts), BATCH_WINDOWS):
            some = starts[lo : lo + BATCH_WINDOWS]
            end = np.minimum(some + length - 1, last[some])
            own = (keys for walk in family for keys in window_keys(hashes, some, end, walk))
            for (where, what), keys, mark in zip(found, own, marks):
                hit = np.flatnonzero(mark[_cell(keys)])
                where.append(some[hit])
                what.append(keys[hit])
        for table, (where, what) in zip(tables, found):
            if where:
                yield table, np.concatenate(where), np.concatenate(what)


def _candidates(hashes, last, items: Items, cells):
    """Places where an item may lie, in batches: first word of the item's place, item, a word of the document."""
    batch, held = [], 0
    for (keys, place), hit, own in _hits(hashes, last, items, cells):
        lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        some = hi > lo
        hit, lo, n = hit[some], lo[some], (hi - lo)[some]
        total, first = np.cumsum(n), 0
        while first < len(hit):
            room = (total[first - 1] if first else 0) + BATCH_PAIRS - held
            until = max(first + 1, int(np.searchsorted(total, room, "right")))
            h, m = hit[first:until], n[first:until]
            at = place[np.repeat(lo[first:until], m) + (np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m))]
            item = items.item[at]
            batch.append(np.stack([np.repeat(h, m) - (at - items.before[item]), item, np.repeat(h, m)]))
            held, first = held + len(at), until
            if held >= BATCH_PAIRS or first < len(hit):
                yield np.concatenate(batch, axis=1)
                batch, held = [], 0
    if held:
        yield np.concatenate(batch, axis=1)


def matches(hashes, before, items: Items, cells, percent: int = PERCENT):
    """Matches in a batch of documents, given by word hashes: document, item, edits, first and last word (about)."""
    size = np.diff(before)
    last = np.repeat(before[1:] - 1, size)
    found = [_verified(hashes, before, items, percent, *c) for c in _candidates(hashes, last, items, cells)]
    rows = np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.int64)
    rows = rows[:, np.lexsort((rows[4], rows[2], rows[1], rows[0]))]
    fresh = np.r_[True, (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)] if rows.shape[1] else np.zeros(0, bool)
    return rows[:, fresh]


def _verified(hashes, before, items: Items, percent: int, start, item, where):
    doc = np.searchsorted(before, where, side="right") - 1
    length = np.diff(items.before)[item]
    allowed = length * (100 - percent) // 100
    slot = (start + length) // np.maximum(1, allowed // 2 + 1)
    _, one = np.unique(np.stack([doc, item, slot]), axis=1, return_index=True)
    out = []
    for lo in range(0, len(one), 2048):
        pick = one[lo : lo + 2048]
        pick = pick[np.argsort(length[pick], kind="stable")]
        for part in np.array_split(pick, max(1, len(pick) // 256)):
            left = np.maximum(before[doc[part]], start[part] - allowed[part] - allowed[part] // 2 - 1)
            right = np.minimum(before[doc[part] + 1], start[part] + length[part] + allowed[part] + allowed[part] // 2 + 2)
            edits, end = edit_distances(
                [items.hashes[items.before[i] : items.before[i + 1]] for i in item[part]], [hashes[x:y] for x, y in zip(left, right)], allowed[part]
            )
            ok = edits <= allowed[part]
            out.append(np.stack([doc[part], item[part], edits, np.maximum(start[part], before[doc[part]]) - before[doc[part]], left + end - before[doc[part]]])[:, ok])
    return np.concatenate(out, axis=1)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """Items in blocks of a bounded size, read one partition at a time."""
    ids, texts, n = [], [], 0
    for row in benchmark.select(F.col(id_col), F.col(text_col).cast("string")).orderBy(id_col).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1] or "")
        n += len(texts[-1]) // 4
        if len(ids) >= BLOCK_ITEMS or n >= BLOCK_WORDS:
            yield ids, texts
            ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def _matcher(held, percent, whole_rows, id_at, text_at, ids=None, id_type=None):
    def run(batches):
        items = held.value
        cells = items.cells()
        for batch in batches:
            data, offsets = tk.utf8(batch.column(text_at))
            keep = np.ones(batch.num_rows, bool)
            for lo, hi in tk.chunks(offsets):
                hashes, before = tk.words(data, offsets[lo : hi + 1], space=tk.PUNCTUATION)
                found = matches(hashes, before, items, cells, percent)
                if whole_rows:
                    keep[lo + found[0]] = False
                    continue
                size = np.diff(items.before)[found[1]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_at).take(pa.array(lo + found[0])), pa.array(ids, id_type).take(pa.array(found[1])), pa.array(found[2].astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(found[3]), pa.array(found[4])],
                    ["doc_id", "item_id", "edits", "item_words", "first_word", "end_word"],
                )
            if whole_rows:
                yield batch.filter(pa.array(keep))

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", percent: int = PERCENT, item_text_col="text") -> DataFrame:
    """One row per document and item it contains: ``doc_id, item_id, edits, item_words, first_word, end_word, similarity``.

    A document contains an item of n words if one of its passages is within n * (100 - percent) // 100 word edits of it;
    ``edits`` is the least such distance found.  Candidates come from random walks: items under five words are found wherever
    they lie, longer ones with the recall ``TARGET`` at least at the default ``percent`` (not measured at others).  Null and empty texts, and items without words, match nothing.  Repeated rows
    give repeated matches, equal items each a match.  Null ids are reported as null; ids of items and documents may be of
    any simple type.  An empty table on either side gives no rows; other columns are ignored.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    item_type = benchmark.select(F.col(item_col)).schema[0].dataType
    item_kind = item_type.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, edits int, item_words int, first_word long, end_word long"
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = spark.createDataFrame([], schema)
    arrow = to_arrow_type(item_type)
    for ids, texts in _blocks(benchmark, item_col, item_text_col):
        held = spark.sparkContext.broadcast(Items(texts, percent))
        out = out.unionByName(narrow.mapInArrow(_matcher(held, percent, False, 0, 1, ids, arrow), schema))
    return out.withColumn("similarity", F.lit(1.0) - F.col("edits") / F.col("item_words"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col="text", item_col="item_id", percent: int = PERCENT, item_text_col="text") -> DataFrame:
    """The rows of ``docs`` that contain no item; columns as in ``docs``.  Null and empty texts stay, as do all rows where there are no
    items; repeated rows stay or go alike."""
    spark = docs.sparkSession
    for _, texts in _blocks(benchmark, item_col, item_text_col):
        held = spark.sparkContext.broadcast(Items(texts, percent))
        docs = docs.mapInArrow(_matcher(held, percent, True, None, docs.columns.index(text_col)), docs.schema)
    return docs
