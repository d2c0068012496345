"""Token counts of a byte-pair vocabulary, without materialising ids.

The vocabulary file's own normaliser and splitter cut a text into pre-tokens.  The pieces of a pre-token do not depend on its
surroundings, so each distinct pre-token is split once, and a document's count is the sum over its pre-tokens of frequency
times pieces.  Per-document frequencies are joined with the piece counts: for the most frequent pre-tokens from a broadcast
table of a fixed size, for all others by a shuffle join on the pre-token.

Where the splitter never joins what white space parts, which is tried out on pairs of all kinds of characters, the library is
asked once for each distinct run between blanks, else for each text.  Where it also parts printable ASCII into runs of letters,
single digits and runs of others, which is tried out on all pairs and many longer runs, such runs are parted here and the library
is asked for the others.
"""

from __future__ import annotations

import hashlib
import json
import random
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.storage import materialize

LIMIT = 2048
#: Pre-tokens in the broadcast table, the most frequent ones, and characters from which a pre-token's key is a digest.
HEAD, HEAD_CHARS = 131_072, 48
#: Runs between blanks that a task remembers, and the longest of them.
_MEMO, _MEMO_CHARS = 400_000, 200
_ASCII_PARTS = re.compile("[a-z]+|[0-9]|[^a-z0-9]+")
#: Characters of all kinds that a splitter may treat in different ways.
_KINDS = ("a", "Z", "é", "ß", "Σ", "İ", "ก", "中", "ー", "1", "²", "Ⅷ", "٣", "'", "'s", ".", ",", "_", "-", "́", "่", "​", "\x00", "\x1c", "\x85", "\xa0", "😀", "　")


class Pieces:
    """The pre-tokens of texts and the pieces of pre-tokens, by the vocabulary file at ``path``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.splitter, self.model = tokenizer.normalizer, tokenizer.pre_tokenizer, tokenizer.model
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that depend on their surroundings are not supported")
        self.special = {t["content"] for t in added}
        self._special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if added else None
        self.apart = not any(c.isspace() for s in self.special for c in s) and all(
            self._plain(f"{a}{gap}{b}") == self._plain(a) + self._plain(b) for a in _KINDS for b in _KINDS for gap in (" ", "\n", "\t", "  \n")
        )

        marks = "".join(re.escape(s[0]) for s in self.special)
        self._odd = re.compile(f"[^!-&(-~]|[{marks}]" if marks else "[^!-&(-~]").search  # not printable ASCII, an apostrophe, or may be special
        self.ascii = self.apart and all(self._plain(run) == _ASCII_PARTS.findall(run.lower()) for run in self._ascii_runs())

    @staticmethod
    def _ascii_runs():
        signs = [chr(c) for c in range(33, 127) if chr(c) != "'"]
        yield from signs
        yield from (a + b for a in signs for b in signs)
        r = random.Random(1)
        for _ in range(20_000):
            yield "".join(r.choices(signs, k=r.randrange(3, 12)))

    def _plain(self, text: str) -> list[str]:
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        return [text] if self.splitter is None else [w for w, _ in self.splitter.pre_tokenize_str(text)]

    def _split(self, text: str) -> list[str]:
        if self._special is None or not self._special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [*self._plain(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self._plain(text[at:])

    def runs(self, text: str) -> list[str]:
        """What may be split on its own: the runs between blanks, or the whole text."""
        return text.replace("\n", " ").replace("\t", " ").split(" ") if self.apart else [text]

    def split(self, run: str) -> list[str]:
        """Pre-tokens of a run, in order; special strings are pre-tokens of their own."""
        if self.ascii and not self._odd(run):
            return _ASCII_PARTS.findall(run.lower())
        return [w for w in self._split(run) if w] if run else []

    def pretokens(self, text: str) -> Counter:
        """Pre-tokens of a text and how often each occurs."""
        out: Counter = Counter()
        for run, n in Counter(self.runs(text)).items():
            for w in self.split(run):
                out[w] += n
        return out

    def count(self, words: list[str]) -> list[int]:
        return [1 if w in self.special else len(self.model.tokenize(w)) for w in words]


@lru_cache(maxsize=1)
def pieces_of(path: str) -> Pieces:
    """One for all tasks of a worker."""
    return Pieces(path)


def _key(word: str) -> str:
    """The pre-token, or a digest in the place of a long one; no pre-token starts with the sign before it."""
    return word if len(word) <= HEAD_CHARS else "\x01" + hashlib.md5(word.encode()).hexdigest()


def _distinct(path):
    """Pre-tokens with counts, gathered up to a bounded number before they leave; the text of those with a digest goes along."""

    def run(batches):
        pieces = pieces_of(path)
        held: Counter = Counter()
        size = 0
        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    size += len(text)
                    held.update(pieces.runs(text))
                if len(held) > 300_000 or size > 64 << 20:
                    yield _counted(held, pieces)
                    held, size = Counter(), 0
        yield _counted(held, pieces)

    return run


def _counted(runs, pieces):
    held: dict[str, int] = {}
    for run, n in runs.items():
        for w in pieces.split(run):
            held[w] = held.get(w, 0) + n
    words = list(held)
    keys = [w if len(w) <= HEAD_CHARS else _key(w) for w in words]
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(list(held.values()), pa.int64()), pa.array([None if k == w else w for k, w in zip(keys, words)], pa.string())], ["pretoken", "n", "long"])


def vocabulary_counts(text: DataFrame, path: str) -> DataFrame:
    """``pretoken, n, pieces`` of a table with one text column: each distinct pre-token once, long ones by a digest."""
    totals = text.mapInArrow(_distinct(path), "pretoken string, n long, long string").groupBy("pretoken").agg(F.sum("n").alias("n"), F.first("long").alias("long"))

    def split(batches):
        pieces = pieces_of(path)
        for b in batches:
            words = [w if long is None else long for w, long in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pieces.count(words), pa.int32())], ["pretoken", "n", "pieces"])

    return totals.mapInArrow(split, "pretoken string, n long, pieces int")


def _document_counter(head, kind, path):
    """Per document one row with what the head table counts, and a row for each pre-token beyond it.  The first row's
    pre-token is a string no text can yield, so it meets nothing and hashes anywhere."""

    def run(batches):
        known, pieces, memo = head.value, pieces_of(path), {}

        def told(run: str):
            """Pieces of a run that the head table counts, or those and the keys of its other pre-tokens."""
            counted, others = 0, []
            for w in pieces.split(run):
                k = w if len(w) <= HEAD_CHARS else _key(w)
                n = known.get(k)
                if n is None:
                    others.append(k)
                else:
                    counted += n
            out = (counted, others) if others else counted
            if len(run) <= _MEMO_CHARS:
                if len(memo) >= _MEMO:
                    memo.clear()
                memo[run] = out
            return out

        base, k = TaskContext.get().partitionId() << 40, 0
        for b in batches:
            rows: list[list] = [[] for _ in range(5)]
            ids, at = b.column(0), []
            for i, text in enumerate(b.column(1).to_pylist()):
                value = text or ""
                counted, rest = 0, Counter()
                for r in pieces.runs(value):
                    got = memo.get(r)
                    if got is None:
                        got = told(r)
                    if got.__class__ is int:
                        counted += got
                    else:
                        counted += got[0]
                        rest.update(got[1])
                for word, n, n_bytes, c in [(f"\x00{base + k}", 0, len(value.encode()), counted), *[(w, n, None, 0) for w, n in rest.items()]]:
                    for column, v in zip(rows, (base + k, word, n, n_bytes, c)):
                        column.append(v)
                    at.append(i)
                k += 1
                if len(at) >= 1 << 17:
                    yield _counts(rows, ids, at)
                    rows, at = [[] for _ in range(5)], []
            if at:
                yield _counts(rows, ids, at)

    return run, f"row long, doc_id {kind}, pretoken string, n long, n_bytes long, counted long"


def _counts(rows, ids, at):
    long = lambda k: pa.array(rows[k], pa.int64())
    return pa.RecordBatch.from_arrays([long(0), ids.take(pa.array(at)), pa.array(rows[1], pa.string()), long(2), long(3), long(4)], ["row", "doc_id", "pretoken", "n", "n_bytes", "counted"])


def count_tokens(df: DataFrame, path: str, id_col="doc_id", text_col="text", limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, for the vocabulary file at ``path``.

    Special strings inside texts are one token each, as by the library's default; no tokens are added, cut or padded.  Null
    texts count as empty (0 bytes, 0 tokens).  Rows are told apart by their place, so null ids and repeated rows are no
    special case.  Other columns are ignored; an empty table gives no rows.
    """
    text = F.col(text_col).cast("string").alias("text")
    words = materialize(vocabulary_counts(df.select(text), path), "token-pieces")
    top = words.orderBy(F.desc("n"), "pretoken").limit(HEAD).select("pretoken", "pieces")
    head = df.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in top.toLocalIterator()})
    run, schema = _document_counter(head, dict(df.dtypes)[id_col], path)
    rows = df.select(F.col(id_col).alias("doc_id"), text).mapInArrow(run, schema)
    joined = rows.join(words.select("pretoken", "pieces"), "pretoken", "left")
    out = joined.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), (F.sum("counted") + F.sum(F.col("n") * F.coalesce("pieces", F.lit(0)))).alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
