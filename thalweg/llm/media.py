"""TIFF columns: image directories, strips and tiles, PackBits, LZW and deflate, horizontal predictors.

``read_pages`` walks the chain of image file directories of a TIFF in memory and decodes each page to an array.  ``tiff_pages``
does so for a binary column, one row per page.  ``write_pages`` stores pages losslessly.  ``text_media`` stores texts as 8-bit
grey pages of 64 columns, reads the stored bytes back through the same walker and digests what it read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the TIFF 6.0 format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPE_CODES = {1: "B", 3: "H", 4: "L"}

#: Shape of the pages that text_media writes.
COLUMNS, PAGE_ROWS, ROWS_A_STRIP = 64, 1024, 256


@dataclass
class Page:
    index: int
    compression: int
    predictor: int
    pixels: np.ndarray  # height x width x samples, uint8


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size and i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 1 + (n > 128)
    return bytes(out[:size])


def pack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while run < 128 and i + run < len(data) and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        end = i + 1
        while end < len(data) and end - i < 128 and data[end : end + 3] != data[end : end + 1] * 3:
            end += 1
        out.append(end - i - 1)
        out += data[i:end]
        i = end
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widened one code early; 256 clears, 257 ends."""
    out, table, last = bytearray(), [bytes((k,)) for k in range(256)] + [b"", b""], None
    width, held, have = 9, 0, 0
    for byte in data:
        held, have = held << 8 | byte, have + 8
        if have < width:
            continue
        have -= width
        code = held >> have
        held &= (1 << have) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("LZW code out of range")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out += entry
        last = entry
        if len(out) >= size:
            break
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out[:size])


def pack_lzw(data: bytes) -> bytes:
    out, held, have = bytearray(), 0, 0

    def put(code, width):
        nonlocal held, have
        held, have = held << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(held >> have)
            held &= (1 << have) - 1

    fresh = {bytes((k,)): k for k in range(256)}
    table, width, known = dict(fresh), 9, b""
    put(256, 9)
    for k in range(len(data)):
        longer = known + data[k : k + 1]
        if longer in table:
            known = longer
            continue
        put(table[known], width)
        table[longer] = len(table) + 2
        known = data[k : k + 1]
        if len(table) + 2 > 4093:
            put(256, width)
            table, width = dict(fresh), 9
        else:
            width = max(9, (len(table) + 2).bit_length())
    if known:
        put(table[known], width)
        width = min(12, max(9, (len(table) + 3).bit_length()))
    put(257, width)
    if have:
        out.append(held << (8 - have) & 255)
    return bytes(out)


_UNPACK = {
    NONE: lambda d, n: bytes(d[:n]), LZW: unpack_lzw, PACKBITS: unpack_bits,
    DEFLATE: lambda d, n: zlib.decompressobj().decompress(d, n), OLD_DEFLATE: lambda d, n: zlib.decompressobj().decompress(d, n),
}
#: Most bytes that a packed byte can stand for, and most samples of a page: a value of a binary column must hold them.
_GROWTH = {NONE: 1, LZW: 4096, PACKBITS: 128, DEFLATE: 1040, OLD_DEFLATE: 1040}
MOST_SAMPLES = 1 << 30
_KNOWN = {WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS}
_PACK = {NONE: bytes, LZW: pack_lzw, PACKBITS: pack_bits, DEFLATE: lambda d: zlib.compress(d, 1)}


def _directories(data: bytes) -> Iterator[dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    at, met = struct.unpack(order + "L", data[4:8])[0], set()
    while at:
        if at in met or at + 2 > len(data):
            raise ValueError("directory chain is broken")
        met.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHL", data, at + 2 + 12 * k)
            if kind in TYPE_CODES and tag in _KNOWN and tag not in tags:
                form = f"{order}{count}{TYPE_CODES[kind]}"
                own = at + 10 + 12 * k
                tags[tag] = struct.unpack_from(form, data, own if struct.calcsize(form) <= 4 else struct.unpack_from(order + "L", data, own)[0])
        yield tags
        at = struct.unpack_from(order + "L", data, at + 2 + 12 * n)[0]


class UnsupportedPage(ValueError):
    """A page whose directory is whole but whose samples can't be decoded here."""


def read_pages(data: bytes) -> Iterator[Page]:
    """Pages of a TIFF with 8-bit interleaved samples, in order.  ValueError where the file is broken or of another kind."""
    for page in _pages_or_faults(data):
        if isinstance(page, UnsupportedPage):
            raise page
        yield page


def _pages_or_faults(data: bytes) -> Iterator[Page | UnsupportedPage]:
    """As ``read_pages``, with an UnsupportedPage in the place of each page of another kind."""
    try:
        for index, tags in enumerate(_directories(data)):
            one = lambda tag, default: tags.get(tag, (default,))[0]
            width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
            packing, predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
            if set(tags.get(BITS, (1,))) != {8} or packing not in _UNPACK or predictor not in (1, 2) or samples > 1 and one(PLANAR, 1) != 1:
                yield UnsupportedPage("unsupported kind of page")
                continue
            tiled = TILE_OFFSETS in tags
            w, h = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(height, one(STRIP_ROWS, height)))
            offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
            across = -(-width // w) if tiled else 1
            blocks = list(zip(offsets, counts))[: across * -(-height // h)]
            if len(blocks) < across * -(-height // h):
                raise ValueError("strip or tile is missing")
            area = height * width * samples
            if area > MOST_SAMPLES or tiled and h * w * samples > MOST_SAMPLES:
                yield UnsupportedPage("page is too large")
                continue
            if area > _GROWTH[packing] * sum(len(data[at : at + n]) for at, n in blocks):
                raise ValueError("strip or tile is short")
            pixels = np.zeros((height, width, samples), np.uint8)
            for k, (at, n) in enumerate(blocks):
                top, left = k // across * h, k % across * w
                rows = h if tiled else min(h, height - top)
                raw = _UNPACK[packing](data[at : at + n], rows * w * samples)
                if len(raw) < rows * w * samples:
                    raise ValueError("strip or tile is short")
                block = np.frombuffer(raw, np.uint8).reshape(rows, w, samples)
                if predictor == 2:
                    block = np.cumsum(block, axis=1, dtype=np.uint8)
                pixels[top : top + rows, left : left + w] = block[: height - top, : width - left]
            yield Page(index, packing, predictor, pixels)
    except (KeyError, IndexError, struct.error, zlib.error, ZeroDivisionError) as e:
        raise ValueError(f"broken TIFF: {e}") from e


def write_pages(pages: list[np.ndarray], packing=DEFLATE, predictor=2, strip_rows: int = ROWS_A_STRIP, tile=None) -> bytes:
    """Little-endian TIFF of pages (height x width x samples, uint8) in strips, or in tiles of (height, width).  Packing, predictor and
    tile may be lists, with a value for each page."""
    out = bytearray(struct.pack("<2sHL", b"II", 42, 0))
    link = 4
    each = lambda v: v if isinstance(v, list) else [v] * len(pages)
    for page, packing, predictor, tile in zip(pages, each(packing), each(predictor), each(tile)):
        height, width, samples = page.shape
        if tile:
            h, w = tile
            blocks = [np.pad(b, ((0, h - b.shape[0]), (0, w - b.shape[1]), (0, 0))) for y in range(0, height, h) for x in range(0, width, w) for b in [page[y : y + h, x : x + w]]]
        else:
            blocks = [page[y : y + strip_rows] for y in range(0, height, strip_rows)]
        offsets, counts = [], []
        for b in blocks:
            if predictor == 2:
                b = np.concatenate([b[:, :1], b[:, 1:] - b[:, :-1]], axis=1)
            packed = _PACK[packing](np.ascontiguousarray(b).tobytes())
            offsets.append(len(out))
            counts.append(len(packed))
            out += packed
        tags = [(WIDTH, "L", [width]), (HEIGHT, "L", [height]), (BITS, "H", [8] * samples), (COMPRESSION, "H", [packing]), (PHOTOMETRIC, "H", [1 if samples < 3 else 2])]
        if not tile:
            tags += [(STRIP_OFFSETS, "L", offsets), (SAMPLES, "H", [samples]), (STRIP_ROWS, "L", [strip_rows]), (STRIP_COUNTS, "L", counts), (PREDICTOR, "H", [predictor])]
        else:
            tags += [(SAMPLES, "H", [samples]), (PREDICTOR, "H", [predictor]), (TILE_WIDTH, "L", [tile[1]]), (TILE_HEIGHT, "L", [tile[0]]), (TILE_OFFSETS, "L", offsets), (TILE_COUNTS, "L", counts)]
        entries = b""
        for tag, code, values in tags:
            raw = struct.pack(f"<{len(values)}{code}", *values)
            if len(raw) > 4:
                where, raw = len(out), raw
                out += raw
                raw = struct.pack("<L", where)
            entries += struct.pack("<HHL", tag, 3 if code == "H" else 4, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into("<L", out, link, len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def tiff_pages(df: DataFrame, id_col: str, tiff_col: str) -> DataFrame:
    """One row per page of each TIFF: ``id, page, width, height, samples, compression, predictor, pixels, error``.  A page
    of an unsupported kind, or of more than ``MOST_SAMPLES`` samples, gives a row with null pixels and the error.  A file that is no
    TIFF, or broken, or that claims more samples than its bytes can hold, gives the pages before the fault and one such row;
    null gives no rows.  No more is unpacked than a page claims."""

    def run(batches):
        names = ["id", "page", "width", "height", "samples", "compression", "predictor", "pixels", "error"]
        for b in batches:
            rows = []
            for key, data in zip(b.column(0).to_pylist(), b.column(1)):
                n = 0
                try:
                    for p in _pages_or_faults(data.as_py()) if data.is_valid else ():
                        if isinstance(p, UnsupportedPage):
                            rows.append((key, n, None, None, None, None, None, None, str(p)))
                        else:
                            h, w, s = p.pixels.shape
                            rows.append((key, p.index, w, h, s, p.compression, p.predictor, p.pixels.tobytes(), None))
                        n += 1
                except ValueError as e:
                    rows.append((key, n, None, None, None, None, None, None, str(e)))
                if sum(len(r[7] or b"") for r in rows[-64:]) > 8 << 20:
                    yield _batch(rows, names, b.schema.field(0).type)
                    rows = []
            yield _batch(rows, names, b.schema.field(0).type)

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("id"), F.col(tiff_col).alias("tiff")).mapInArrow(
        run, f"id {kind}, page int, width int, height int, samples int, compression int, predictor int, pixels binary, error string"
    )


def _batch(rows, names, kind):
    kinds = [kind, *[pa.int32()] * 6, pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def store(payload: bytes) -> bytes:
    """Payload (a multiple of 64 bytes) as grey pages of 64 columns and at most ``PAGE_ROWS`` rows."""
    grid = np.frombuffer(payload, np.uint8).reshape(-1, COLUMNS, 1)
    return write_pages([grid[k : k + PAGE_ROWS] for k in range(0, len(grid), PAGE_ROWS)])


def feature_of(pages: list[Page]) -> str:
    """Pages, rows, mean and deviation of the samples, and a 64-bit difference hash of an 8 x 9 thumbnail."""
    grid = np.concatenate([p.pixels[:, :, 0] for p in pages])
    mean = grid.mean(dtype=np.float64)
    columns = np.add.reduceat(grid, np.linspace(0, COLUMNS, 10)[:-1].astype(int), axis=1, dtype=np.int64)
    edge = np.linspace(0, len(grid), 9).astype(int)
    bands = np.stack([columns[a : max(a + 1, b)].mean(axis=0) if a < len(grid) else columns[-1] for a, b in zip(edge, edge[1:])])
    bits = np.packbits(bands[:, 1:] > bands[:, :-1]).tobytes().hex()
    return f"{len(pages)}:{len(grid)}:{mean:.3f}:{grid.std(dtype=np.float64):.3f}:{bits}"


def text_media(df: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pages`` of every row.

    The payload is the text in UTF-8 (null: empty) with zero bytes up to a positive multiple of 64; all digests but that of the
    stored form are of samples read back from the stored TIFF.  Equal texts have equal values.  Null ids stay null, rows may
    repeat, other columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for text in b.column(1):
                n, payload = payload_of(text.as_py())
                media = store(payload)
                pages = list(read_pages(media))
                back = b"".join(p.pixels.tobytes() for p in pages)
                row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(pages), len(pages))
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pages"]
    schema = f"doc_id {dict(df.dtypes)[id_col]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int"
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def embedding_pages(df: DataFrame, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """``vec_id, page, width, height, compression, predictor, pixels_md5, error``: each vector as a picture of eight samples a row, the last row
    filled up with zeros, in a file of eight pages, one for each packing in strips of three rows and in tiles of 4 x 16, read back by
    ``tiff_pages``.  A sample is floor(20 x) + 80, from 33 to 126; a component that is null or NaN is a zero.  A null or empty vector
    has no file and no rows.  Ids of any type, null ids and repeated rows are rows like others: pages take turns with the predictor by the
    position of the page and the number of samples over 80.  Other columns are ignored; an empty table gives no rows."""

    def store_vectors(batches):
        for b in batches:
            ids, files = [], []
            for k, vector in enumerate(b.column(1)):
                if not vector.is_valid or not len(vector):
                    continue
                x = np.array([np.nan if v is None else v for v in vector.as_py()], np.float64)
                samples = np.where(np.isnan(x), 0, np.clip(np.floor(np.nan_to_num(x) * 20) + 80, 33, 126)).astype(np.uint8)
                grid = np.concatenate([samples, np.zeros(-len(samples) % 8, np.uint8)]).reshape(-1, 8, 1)
                turn = int((samples > 80).sum())
                ids.append(k)
                files.append(write_pages([grid] * 8, [NONE, LZW, DEFLATE, PACKBITS] * 2, [1 + (turn + p) % 2 for p in range(8)], 3, [None] * 4 + [(4, 16)] * 4))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(files, pa.binary())], ["id", "tiff"])

    kind = dict(df.dtypes)[id_col]
    files = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(store_vectors, f"id {kind}, tiff binary")
    return tiff_pages(files, "id", "tiff").select(F.col("id").alias("vec_id"), "page", "width", "height", "compression", "predictor", F.md5("pixels").alias("pixels_md5"), "error")
