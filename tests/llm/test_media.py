import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from thalweg.llm import media as M

rng = np.random.default_rng(1)
PICTURES = [rng.integers(0, 256, (h, w, s), dtype=np.uint8) for h, w, s in ((1, 1, 1), (7, 5, 3), (64, 64, 1), (130, 33, 4))] + [np.zeros((90, 70, 1), np.uint8), np.tile(np.arange(200, dtype=np.uint8), (120, 1))[:, :, None]]


@pytest.mark.parametrize("packing", [M.NONE, M.LZW, M.DEFLATE, M.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_round_trip(packing, predictor, tile):
    back = list(M.read_pages(M.write_pages(PICTURES, packing, predictor, 13, tile)))
    assert [p.index for p in back] == list(range(len(PICTURES)))
    assert all(np.array_equal(p.pixels, q) and p.compression == packing and p.predictor == predictor for p, q in zip(back, PICTURES))


def test_codecs_on_long_and_odd_bytes():
    r = random.Random(4)
    for data in (b"", b"a", b"a" * 5000, bytes(r.randrange(256) for _ in range(20000)), b"abcabcabd" * 3000, bytes(r.choice(b"ab") for _ in range(60000))):
        assert M.unpack_lzw(M.pack_lzw(data), len(data)) == data
        assert M.unpack_bits(M.pack_bits(data), len(data)) == data


def test_known_bytes():
    # the PackBits example of the format's description, and an LZW stream written out by hand: clear, 7, 258, 8, end
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert M.unpack_bits(packed, 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 257))
    stream = int(bits.ljust(48, "0"), 2).to_bytes(6, "big")
    assert M.unpack_lzw(stream, 4) == bytes([7, 7, 7, 8])


def test_big_endian_and_broken_files():
    entries = [(256, 4, 2), (257, 4, 1), (258, 3, 8 << 16), (259, 3, 1 << 16), (273, 4, 8), (279, 4, 2)]
    ifd = struct.pack(">H", 6) + b"".join(struct.pack(">HHLL", t, k, 1, v) for t, k, v in entries) + struct.pack(">L", 0)
    data = struct.pack(">2sHL", b"MM", 42, 10) + b"\x05\x09" + ifd
    (page,) = M.read_pages(data)
    assert page.pixels[:, :, 0].tolist() == [[5, 9]]
    for bad in (b"", b"II*\0", data[:30], data[:4] + struct.pack(">L", 9999), b"xx" + data[2:]):
        with pytest.raises(ValueError):
            list(M.read_pages(bad))
    loop = bytearray(M.write_pages([PICTURES[0]]))
    loop[-4:] = loop[4:8]
    with pytest.raises(ValueError):
        list(M.read_pages(bytes(loop)))


def test_pages_of_a_column(spark):
    rows = [(1, M.write_pages(PICTURES[:3])), (2, None), (3, b"junk"), (None, M.write_pages(PICTURES[1:2], M.LZW))]
    out = M.tiff_pages(spark.createDataFrame(rows, "k long, page binary"), "k", "page").collect()
    assert [(r.id, r.page, r.width, r.height, r.samples) for r in out if r.error is None] == [(1, 0, 1, 1, 1), (1, 1, 5, 7, 3), (1, 2, 64, 64, 1), (None, 0, 5, 7, 3)]
    assert bytes(out[1].pixels) == PICTURES[1].tobytes()
    assert [r.id for r in out if r.error] == [3]


def test_pages_after_an_unsupported_one(spark):
    data = bytearray(M.write_pages([np.full((2, 3, 1), k, np.uint8) for k in (7, 8, 9)]))
    at = struct.unpack_from("<L", data, 4)[0]
    at = struct.unpack_from("<L", data, at + 2 + 12 * struct.unpack_from("<H", data, at)[0])[0]
    for k in range(struct.unpack_from("<H", data, at)[0]):
        if struct.unpack_from("<H", data, at + 2 + 12 * k)[0] == M.COMPRESSION:
            struct.pack_into("<H", data, at + 10 + 12 * k, 7)
    out = M.tiff_pages(spark.createDataFrame([(1, bytes(data))], "id long, tiff binary"), "id", "tiff").orderBy("page").collect()
    assert [(r.page, r.pixels and r.pixels[0], r.error) for r in out] == [(0, 7, None), (1, None, "unsupported kind of page"), (2, 9, None)]
    with pytest.raises(ValueError):
        list(M.read_pages(bytes(data)))


def test_text_media(spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "y" * 65, "long text é " * 30000, "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as pages")
    out = sorted(M.text_media(df).collect())
    for r, t in zip(out, texts):
        raw = (t or "").encode()
        pad = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest())
        assert r.tail_crc32 == zlib.crc32(pad[-64:])
        media = M.store(pad)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.pages == -(-len(pad) // 65536)
    assert out[2][1:] == out[7][1:]
    assert M.text_media(df.limit(0)).collect() == []


def test_false_claims_give_one_error_row(spark):
    import struct

    def tiff(width, height, packing, body, rows=None):
        tags = [(256, width), (257, height), (258, 8), (259, packing), (273, 8), (277, 1), (278, rows or height), (279, len(body))]
        entries = b"".join(struct.pack("<HHLL", t, 4, 1, v) for t, v in tags)
        return struct.pack("<2sHL", b"II", 42, 8 + len(body)) + body + struct.pack("<H", len(tags)) + entries + bytes(4)

    bomb = zlib.compress(bytes(64 << 20), 9)
    rows = [("claim", tiff(10**6, 10**6, 8, b"x" * 20)), ("plain", tiff(30_000, 30_000, 1, b"x" * 20)), ("missing", tiff(4, 4, 1, b"x" * 16, 1)), ("zero", tiff(4, 0, 1, b"x" * 16)), ("bomb", tiff(8, 8, 8, bomb))]
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "id string, tiff binary")
    got = {r.id: (r.page, r.pixels and len(r.pixels), r.error) for r in M.tiff_pages(df, "id", "tiff").collect()}
    assert got["claim"] == (0, None, "page is too large") and got["plain"] == (0, None, "strip or tile is short") and got["missing"] == (0, None, "strip or tile is missing")
    assert got["bomb"] == (0, 64, None) and got["zero"][1] is None and len(got) == 5


def test_pages_of_odd_vectors(spark):
    nan = float("nan")
    rows = [("a", [0.5] * 64), ("a", [0.5] * 64), (None, [1.0, None, nan]), ("b", None), ("c", []), ("d", [float("inf"), -float("inf")]), ("e", [0.1] * 70)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>").selectExpr("*", "1 as page", "'x' as error")
    got = {}
    for r in M.embedding_pages(df).collect():
        assert r.error is None and r.width == 8
        got.setdefault(r.vec_id, []).append((r.page, r.height, r.pixels_md5))
    want = {"a": bytes([90] * 64), None: bytes([100, 0, 0, 0, 0, 0, 0, 0]), "d": bytes([126, 33, 0, 0, 0, 0, 0, 0]), "e": bytes([82] * 70 + [0, 0])}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert sorted(got[k]) == sorted([(p, len(v) // 8, hashlib.md5(v).hexdigest()) for p in range(8)] * (2 if k == "a" else 1))
    assert M.embedding_pages(df.limit(0)).collect() == []
