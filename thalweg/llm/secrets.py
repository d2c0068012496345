"""Secret scan with structural confirmation.

Base patterns find assignments, access keys and long hex runs.  Further candidates, long base64 or hex runs and dotted
triples, are reported only if they decode to something built like a secret: a signed-token header, a DER key with
consistent nested lengths, an OpenSSH key with consistent fields, or a PEM block around either.  Offsets are code points,
ends exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: All kinds in the order in which spans with equal starts are listed.
KINDS = ("assign", "access", "hex", "pem", "jwt", "der", "ssh")

_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
_DOTTED = re.compile(r"[A-Za-z0-9_.-]+")
_FIRST_KEY = re.compile(r'\{"(?:[^"\\]|\\.)*"[ \t\n\r]*:')
_PEM_LINE = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}?)PRIVATE KEY-----")
_PEM_BODY = re.compile(r"(?:[A-Za-z0-9+/=\s:,-]|\\+[nrt])*")
_BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
_BASE64_URL = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
#: First lines of wrapped keys, also after an escaped line end, and what follows on the next line.
_WRAPPED = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\[nrt]))(?:M[A-Za-z]|b3Bl|AAAA)[A-Za-z0-9+/_-]{10,}")
_NEXT_LINE = re.compile(r"[ \t]*(?:\r?\n|(?:\\+r)?\\+n)[ \t]*([A-Za-z0-9+/_-]+={0,2}|={1,2})")
_ESCAPED_END = re.compile(r"\\+[nrt]")
_HEX_KEY = re.compile(r"(?:[0-9a-fA-F]{2}){24,}")
_HEX_RUN = bytes(0x68 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))
_B64_RUN = bytes(0x68 if chr(b).isalnum() and b < 128 or chr(b) in "+/-_" else 0x20 for b in range(256))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if b"h" * LEAST["hex"] in text.encode().translate(_HEX_RUN):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return out


def _decoded(run: str) -> bytes | None:
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """Items (tag, start, end) that fill data[at:end] exactly, or None."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            n = int.from_bytes(data[at : at + k], "big")
            at += k
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        at += n
    return out


def is_der_key(data: bytes) -> bool:
    """A sequence filling the data whose fields are those of a private key: version, then numbers, an algorithm with an
    object identifier and an octet string, or an octet string."""
    top = der_items(data, 0, len(data)) if len(data) >= 16 and data[0] == 0x30 else None
    if not top or len(top) != 1:
        return False
    fields = der_items(data, top[0][1], top[0][2])
    if not fields or fields[0][0] != 2 or fields[0][2] - fields[0][1] != 1 or data[fields[0][1]] > 1:
        return False
    tags = [t for t, _, _ in fields]
    if len(tags) >= 6 and all(t == 2 for t in tags[:6]):
        return True
    if tags[1:3] == [0x30, 4]:
        inner = der_items(data, fields[1][1], fields[1][2])
        return bool(inner) and inner[0][0] == 6
    return len(tags) > 1 and tags[1] == 4 and fields[1][2] - fields[1][1] >= 16


def is_ssh_key(data: bytes) -> bool:
    """The OpenSSH private key container, or a wire-format key: length-prefixed fields that fill the data, a key type first."""
    magic = b"openssh-key-v1\0"
    at, held = (len(magic), data) if data.startswith(magic) else (0, data)
    fields = []
    while at + 4 <= len(held):
        n = int.from_bytes(held[at : at + 4], "big")
        if at + 4 + n > len(held):
            return False
        fields.append(held[at + 4 : at + 4 + n])
        at += 4 + n
        if held is not data or not data.startswith(magic):
            continue
        if len(fields) == 3:
            at += 4  # number of keys
    if at != len(held):
        return False
    if data.startswith(magic):
        return len(fields) >= 5 and fields[0].isascii()
    return len(fields) >= 2 and fields[0].startswith((b"ssh-", b"ecdsa-sha2-", b"sk-"))


def is_token(text: str) -> bool:
    """header.payload.signature whose header is an object naming its algorithm and whose payload is an object."""
    head, body, signature = text.split(".")
    try:
        header, claims = (json.loads(_decoded(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict) and (bool(signature) or header["alg"].lower() == "none")


def _object_starts(part: str):
    """Offsets of eyJ from which the part, decoded, may be one object.  What starts at offsets of the same remainder by 4 is
    decoded together, and an object is read only where a key with its colon stands."""
    read, texts, at = json.JSONDecoder().raw_decode, {}, part.find("eyJ")
    while at >= 0:
        if at % 4 not in texts:
            texts[at % 4] = (_decoded(part[at % 4 :]) or b"").decode("latin-1").rstrip(" \t\n\r")
        text, k = texts[at % 4], at // 4 * 3
        if text.endswith("}") and _FIRST_KEY.match(text, k):
            try:
                if read(text, k)[1] == len(text):
                    yield at
            except (ValueError, RecursionError):
                pass
        at = part.find("eyJ", at + 1)


def tokens(text: str):
    """Spans of signed tokens, whatever stands before them: of each maximal dotted run every three parts in a row, the first
    from the first offset that makes them a token."""
    for m in _DOTTED.finditer(text):
        if "eyJ" not in m[0]:
            continue
        at, parts = m.start(), m[0].split(".")
        for head, body, signature in zip(parts, parts[1:], parts[2:]):
            if "eyJ" in head and body:
                start = next((k for k in _object_starts(head) if is_token(f"{head[k:]}.{body}.{signature}")), None)
                if start is not None:
                    yield at + start, at + len(head) + len(body) + len(signature) + 2
            at += len(head) + 1


def pem_blocks(text: str):
    """Spans, labels and bodies of armoured keys: a first line, and the last line of the same label that is the next such line."""
    opened = None
    for m in _PEM_LINE.finditer(text):
        if m[1] == "BEGIN":
            opened = m
        elif opened:
            if opened[2] == m[2] and _PEM_BODY.fullmatch(text, opened.end(), m.start()):
                yield opened.start(), m.end(), m[2], text[opened.end() : m.start()]
            opened = None


def _outside(found, spans):
    """Those of the sorted ``found`` that start in none of the spans."""
    spans, k, reach = sorted(spans), 0, -1
    for s, e, kind in found:
        while k < len(spans) and spans[k][0] <= s:
            reach, k = max(reach, spans[k][1]), k + 1
        if s >= reach:
            yield s, e, kind


def _kind(data: bytes | None) -> str | None:
    return "der" if data and is_der_key(data) else "ssh" if data and is_ssh_key(data) else None


def wrapped_keys(text: str):
    """Spans and kinds of keys without armour over several lines.  A DER key ends where its first length says; the lines of
    others are equally long but for the last."""
    for m in _WRAPPED.finditer(text):
        width, end, run = len(m[0]), m.end(), [m[0]]
        head, need, have = _decoded(m[0][:8]), None, width
        if m[0][0] == "M" and head[0] == 0x30:
            k = head[1] & 0x7F if head[1] & 0x80 else 0
            if not k <= 4:
                continue
            size = (int.from_bytes(head[2 : 2 + k], "big") if k else head[1]) + 2 + k
            need = -(-size * 4 // 3)
        elif m[0][0] == "M":
            continue
        while (need is None or have < need) and (line := _NEXT_LINE.match(text, end)):
            part = line[1].rstrip("=")
            if need is None and len(part) > width:
                break
            run.append(part)
            have, end = have + len(part), line.end()
            if "=" in line[1] or need is None and len(part) < width:
                break
        if len(run) > 1 and (need is None or have == need) and (kind := _kind(_decoded("".join(run)))):
            yield m.start(), end, kind


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Candidates that decode to keys or signed tokens."""
    out = []
    if "PRIVATE KEY-----" in text:
        for start, end, label, body in pem_blocks(text):
            body = "".join(x for x in _ESCAPED_END.sub("\n", body).splitlines() if ":" not in x)
            data = _decoded(re.sub(r"\s", "", body))
            if data and (is_der_key(data) or is_ssh_key(data) or label == "ENCRYPTED " and der_items(data, 0, len(data))):
                out.append((start, end, "pem"))
    if "eyJ" in text:
        out += [(start, end, "jwt") for start, end in tokens(text)]
    if b"h" * 40 in text.encode().translate(_B64_RUN) or _WRAPPED.search(text):
        inside = [(s, e) for s, e, _ in out]
        found = set()
        for pattern, decode in ((_BASE64, _decoded), (_BASE64_URL, _decoded), (_HEX_KEY, bytes.fromhex)):
            for m in pattern.finditer(text):
                if pattern is _BASE64_URL and not ("-" in m[0] or "_" in m[0]):
                    continue
                # the letter of an escape before a run is not part of it
                for skip in (0, 1) if text[m.start() - 1 : m.start()] == "\\" else (0,):
                    if kind := _kind(decode(m[0][skip:]) if decode is _decoded or not skip else None):
                        found.add((m.start() + skip, m.end(), kind))
        found.update(wrapped_keys(text))
        out += _outside(sorted(found), inside)
    return out


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


def scan(text: str | None):
    """n_assign, n_access, n_hex, base_sha256, spans, n_confirmed."""
    base = base_spans(text or "")
    more = confirmed_spans(text or "")
    counts = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
    return (*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more), len(more))


def find_secrets(df: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed`` of every row.

    Null texts count as empty: no spans, an empty ``spans`` string and the digest of it.  Whole texts are scanned whatever
    their length; spans of different kinds may overlap and all stay.  Null ids stay null, repeated rows repeat, other
    columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        for b in batches:
            rows = [scan(t.as_py()) for t in b.column(1)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"]
    schema = f"doc_id {dict(df.dtypes)[id_col]}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed int"
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
