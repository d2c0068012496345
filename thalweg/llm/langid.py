"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of up to three bytes with frozen counts.  A byte costs -log2 of its share in the longest
context known to the tree; where it was never seen there, the escape share is paid and the next shorter context is asked,
down to a uniform byte.  The language with the shortest total code is predicted.

Trees are kept as sorted arrays of the contexts and followers that occur, so a tree takes some 12 bytes for each distinct run
of up to four bytes in its sample, whatever the number of languages and scripts; no context is left out for room.  With frozen
counts the cost of a byte depends on the four bytes that end with it alone, so a worker works out the costs of a run of four
once under all languages, remembers them, and adds up texts by look-ups.  Bytes never seen in training cost the same everywhere
and share one symbol.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thalweg.llm import textkernel as tk

#: Bounds of the training sample: bytes a language (expected), bytes of all languages together, which share that evenly if they
#: are more than some hundred, and bytes of one text in it, texts being taken whole.
TRAIN_BYTES, TRAIN_TOTAL, TRAIN_TEXT_BYTES = 600_000, 96 << 20, 60_000
#: A context is in the tree from this count on.
LEAST_COUNT = 4
ORDERS = 3
_BLOCK = 1 << 19
#: Costs that a worker remembers (runs of four bytes times languages), and slots in which they are looked up.
_REMEMBERED, _SLOTS = 8_000_000, 1 << 20


def _runs(block: np.ndarray, a: int) -> np.ndarray:
    """Code of the four symbols that end at each place of a block that starts with three zeros."""
    s = block.astype(np.int64)
    return ((s[:-3] * a + s[1:-2]) * a + s[2:-1]) * a + s[3:]


class Tree:
    """One language: costs of single symbols, and for each order the contexts with their escape costs and the followers with theirs."""

    def __init__(self, codes: np.ndarray, a: int):
        n = np.bincount(codes % a, minlength=a)
        total, kinds = n.sum(), (n > 0).sum()
        with np.errstate(divide="ignore"):
            lacking = np.log2(total + kinds) - np.log2(kinds) + 8.0 if total else 8.0
            self.single = np.where(n > 0, np.log2(max(1, total + kinds)) - np.log2(n), lacking)
        self.orders = []
        for k in range(1, ORDERS + 1):
            pairs, n = np.unique(codes % a ** (k + 1), return_counts=True)
            contexts, first = np.unique(pairs // a, return_index=True)
            total, kinds = np.add.reduceat(n, first) if len(n) else n, np.diff(np.r_[first, len(n)])
            known = total >= LEAST_COUNT
            member = np.repeat(known, kinds)
            hit = np.log2(np.repeat(total + kinds, kinds)) - np.log2(n)
            escape = np.log2(total + kinds) - np.log2(kinds)
            self.orders.append((contexts[known].astype(np.uint32), escape[known].astype(np.float32), pairs[member].astype(np.uint32), hit[member].astype(np.float32)))

    def costs(self, codes: np.ndarray, a: int) -> np.ndarray:
        out = self.single[codes % a]
        for k, (contexts, escape, pairs, hit) in enumerate(self.orders, 1):
            if len(contexts):
                pair = (codes % a ** (k + 1)).astype(np.uint32)
                context = pair // np.uint32(a)
                at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
                out = np.where(contexts[at] == context, out + escape[at], out)
                at = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
                out = np.where(pairs[at] == pair, hit[at], out)
        return out

    def nbytes(self) -> int:
        return self.single.nbytes + sum(x.nbytes for order in self.orders for x in order)


class Trees:
    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(texts)
        if not texts:
            return
        blocks = {k: np.frombuffer(b"\0\0\0" + b"\0\0\0".join(t.encode() for t in texts[k]), np.uint8) for k in self.langs}
        seen = np.zeros(256, bool)
        for b in blocks.values():
            seen[tk.LOWER[b]] = True
        seen[0] = False
        self.size = a = int(seen.sum()) + 1
        symbol = np.zeros(256, np.int32)
        symbol[seen] = np.arange(1, a)
        self.symbol = symbol[tk.LOWER]  # 0: unseen in training, and before the start of a text
        self.trees = []
        for k in self.langs:
            codes = _runs(self.symbol[blocks[k]], a)
            self.trees.append(Tree(codes[codes % a > 0], a))
        self.forget()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("codes", "known", "slots")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def forget(self) -> None:
        self.codes, self.known = np.zeros(0, np.int64), np.zeros((0, len(self.langs)), np.float32)
        self.slots = np.zeros(_SLOTS, np.int32)

    def nbytes(self) -> int:
        """Bytes sent to a worker."""
        return sum(t.nbytes() for t in self.trees) if self.langs else 0

    def _slot(self, codes):
        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 20)).astype(np.int64) & (_SLOTS - 1)

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """Costs of runs under each language, float32; those met before are remembered."""
        at = np.zeros(len(codes), np.int64)
        hit = np.zeros(len(codes), bool)
        if len(self.codes):
            at = self.slots[self._slot(codes)].astype(np.int64)
            hit = self.codes[at] == codes
            rest = np.flatnonzero(~hit)
            at[rest] = np.minimum(np.searchsorted(self.codes, codes[rest]), len(self.codes) - 1)
            hit[rest] = self.codes[at[rest]] == codes[rest]
        if not hit.all():
            fresh = np.unique(codes[~hit])
            if len(self.codes) and (len(self.codes) + len(fresh)) * len(self.langs) > _REMEMBERED:
                self.forget()
                fresh = np.unique(codes)
            rows = np.stack([t.costs(fresh, self.size) for t in self.trees], axis=1).astype(np.float32)
            every = np.r_[self.codes, fresh]
            order = np.argsort(every, kind="stable")
            self.codes, self.known = every[order], np.concatenate([self.known, rows])[order]
            self.slots[self._slot(self.codes)] = np.arange(len(self.codes), dtype=np.int32)
            at = np.searchsorted(self.codes, codes)
        return self.known[at]

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text under each language, in bits."""
        a = self.size
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        stop = int(offsets[-1])
        for lo in range(int(offsets[0]), stop, _BLOCK):
            hi = min(stop, lo + _BLOCK)
            back = min(3, lo)
            s = np.zeros(hi - lo + 3, np.int32)
            s[3 - back :] = self.symbol[data[lo - back : hi]]
            one, two, three = s[2:-1].copy(), s[1:-2].copy(), s[:-3].copy()
            starts = offsets[np.searchsorted(offsets, lo - 2) : np.searchsorted(offsets, hi)] - lo
            for shift, columns in ((0, (one, two, three)), (1, (two, three)), (2, (three,))):
                at = starts + shift
                at = at[(at >= 0) & (at < hi - lo)]
                for column in columns:
                    column[at] = 0
            bits = self.costs(((three.astype(np.int64) * a + two) * a + one) * a + s[3:])
            first, last = np.searchsorted(offsets, lo, "right") - 1, np.searchsorted(offsets, hi, "left")
            docs = np.arange(first, last)
            begin = np.maximum(offsets[docs], lo) - lo
            filled = np.minimum(offsets[docs + 1], hi) - lo > begin
            out[docs[filled]] += np.add.reduceat(bits, begin[filled], axis=0, dtype=np.float64)
        return out

    def predict(self, data, offsets):
        """Index of the language and the posterior share of its code among all, for each text."""
        bits = self.lengths(data, offsets)
        best = bits.argmin(axis=1)
        return best, 1.0 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)


def fit(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> Trees:
    """Trees from texts whose crc32 of the id as text is not 1 modulo 3 and whose lang is not null.  The sample is drawn by a
    hash of the text, copies once, to about ``TRAIN_BYTES`` a language, one text of each at least; texts over
    ``TRAIN_TEXT_BYTES`` are not in it."""
    rows = docs.where(~F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False)))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("lang is not null and text is not null").withColumn("n", F.octet_length("text")).where(F.col("n").between(1, TRAIN_TEXT_BYTES))
    rows = rows.withColumn("h", F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 40)))
    totals = rows.groupBy("lang", "h").agg(F.max("n").alias("n")).groupBy("lang").agg(F.sum("n"), F.min("h")).collect()
    if not totals:
        return Trees({})
    each = min(TRAIN_BYTES, TRAIN_TOTAL // len(totals))
    below = {lang: max(least + 1, int(min(1.0, each / n) * (1 << 40))) for lang, n, least in totals}
    limits = docs.sparkSession.createDataFrame(list(below.items()), "lang string, below long")
    drawn = rows.join(F.broadcast(limits), "lang").where("h < below")  # a row a language
    drawn = drawn.withColumn("k", F.row_number().over(Window.partitionBy("lang", "h").orderBy("text"))).where("k = 1")
    texts: dict[str, list[str]] = {lang: [] for lang in below}
    for lang, text in sorted(drawn.select("lang", "text").collect()):
        texts[lang].append(text)
    return Trees(texts)


def identify(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row.

    ``held_out``: crc32 of the id as text is 1 modulo 3 (null id: false).  ``lang_pred`` is ``und`` with score 0 where the text is
    null or has no letter, or where nothing could be learned; otherwise the language of the shortest code, the first by
    name in a tie, and ``score`` its posterior share under equal priors.  Whole texts are scored whatever their length.
    Repeated rows and other columns are no special case; an empty table gives no rows.
    """
    trees = fit(docs, id_col, text_col, lang_col)
    held = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        model = held.value
        names = np.array([*model.langs, "und"], object)
        for b in batches:
            data, offsets = tk.utf8(b.column(1))
            best, score = np.full(b.num_rows, len(names) - 1), np.zeros(b.num_rows)
            if len(model.langs):
                letters = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
                pick, share = model.predict(data, offsets)
                best, score = np.where(letters, pick, best), np.where(letters, share, 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    text = F.col(text_col).cast("string")
    narrow = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.coalesce(text.rlike("\\p{L}"), F.lit(False)).alias("letters"))
    out = narrow.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, lang_pred string, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
