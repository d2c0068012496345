import random

import public_tokenizers
from tokenizers import Tokenizer

from thalweg.llm import tokencount as T

PATH = public_tokenizers.path("word_bpe_49k.json")


def odd_texts(n=1500, seed=1):
    r = random.Random(seed)
    pool = list("abzAZ09 '.,\n\t_-éÉßΣσςİıǰñ́̈  　\x1c\x1f\x85​²Ⅷ中文日😀👍🏽\x00") + ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "'s", "'LL", " the", "don't", "ΑΣ", "ﬁ", "K", "Å"]
    return ["".join(r.choice(pool) for _ in range(r.randrange(0, 40))) for _ in range(n)]


def test_counts_against_the_library():
    tokenizer, pieces = Tokenizer.from_file(PATH), T.Pieces(PATH)
    for text in odd_texts():
        words = pieces.pretokens(text)
        got = sum(n * k for (_, n), k in zip(words.items(), pieces.count(list(words))))
        assert got == len(tokenizer.encode(text, add_special_tokens=False).ids), repr(text)


def test_every_code_point_against_the_library():
    """Alone, between letters, after an apostrophe and beside digits, assigned or not."""
    tokenizer, pieces = Tokenizer.from_file(PATH), T.Pieces(PATH)
    assert pieces.apart and pieces.ascii
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for form in ("{0}", "ab{0}cd", "'{0} 1{0}2", "e\u0301{0}\u0301 {0}"):
        texts = [form.format(c) for c in points]
        for lo in range(0, len(texts), 4096):
            part = texts[lo : lo + 4096]
            for text, e in zip(part, tokenizer.encode_batch(part, add_special_tokens=False)):
                words = pieces.pretokens(text)
                assert sum(n * k for (_, n), k in zip(words.items(), pieces.count(list(words)))) == len(e.ids), repr(text)


def test_other_vocabularies_are_split_by_their_own_rules():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, pieces = Tokenizer.from_file(path), T.Pieces(path)
    assert not pieces.apart and not pieces.ascii
    for text in [*odd_texts(300, 9), "  two  blanks\n\nand lines\t."]:
        words = pieces.pretokens(text)
        assert sum(n * k for (_, n), k in zip(words.items(), pieces.count(list(words)))) == len(tokenizer.encode(text, add_special_tokens=False).ids), repr(text)


def test_query_against_the_library(spark, monkeypatch):
    monkeypatch.setattr(T, "HEAD", 5)
    tokenizer = Tokenizer.from_file(PATH)
    texts = [None, "", "Hello   world's 123!", "a " * 40000 + "zyxwv", "=" * 70, "x " + "=" * 70 + " y " + "é" * 5000, *odd_texts(60, 3), "same", "same"]
    rows = [(i if i % 7 else None, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pretoken string")
    got = sorted(tuple(-1 if v is None else v for v in r) for r in T.count_tokens(df, PATH).collect())
    want = []
    for i, t, _ in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want.append((-1 if i is None else i, len((t or "").encode()), n, n > T.LIMIT))
    assert got == sorted(want)
    assert T.count_tokens(df.limit(0), PATH).collect() == []
