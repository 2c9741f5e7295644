"""Secret scans with structural confirmation.

Base spans come from three patterns over the whole text. The method adds spans of
candidates that prove their structure once decoded: PEM bodies, base64 and hex runs
whose bytes are a private or public key encoding (DER with every nested length
adding up, or length-prefixed SSH fields), and signed tokens whose header and payload
decode to JSON with an algorithm. A map over rows: no shuffle; candidates are sought
in the bytes of a whole piece of rows at once.

Defined results: a null or empty text has no spans; repeated rows are scanned one by
one; other columns are kept by `redact` and ignored by `scan`.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keyfold.llm import common as C

#: In this order where starts are equal; the first three are the base.
KINDS = ("assign", "access", "hex", "jwt", "pem", "key64", "keyhex")

# Fixed patterns; the first is for lower-cased bytes.
_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
# A run is tried from its start only, and without going back: linear in any text.
# The first byte of a JSON object is { or a blank or line break: e, I, C or D in base64.
_TOKEN = re.compile(rb"(?<![A-Za-z0-9_-])(?=([eICD][A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+))")
# Base64 in lines, parted by line breaks or escaped ones; and where keys typically begin in it.
_BREAK = re.compile(rb"(?:\r|\n|\\++[rn])++[\x20\t]*+")
_LINES = re.compile(rb"(?:(?!-----)[A-Za-z0-9+/_-]){40,}+(?:(?:\r|\n|\\++[rn])++[\x20\t]*+(?:(?!-----)[A-Za-z0-9+/_-])++)*+")
_BEGIN = re.compile(rb"(?=M[A-P]|b3BlbnNzaC1rZXktdjEA|AAAA[A-Z][23n](?:NzaC1|VjZHNh|Nr))")
_OTHERS = re.compile(rb"[+/].*[_-]|[_-].*[+/]")
_PEM_HEAD = re.compile(rb"-----BEGIN ([A-Z0-9 ]{1,40})-----")
_PAD = re.compile(rb"={0,2}")
_HEX = C.byte_table(lambda b: b in b"0123456789abcdef")
_ANY_HEX = C.byte_table(lambda b: b in b"0123456789abcdefABCDEF")
_B64 = C.byte_table(lambda b: chr(b).isascii() and chr(b).isalnum() or b in b"+/_-")
_TAIL = C.byte_table(lambda b: 0x80 <= b <= 0xBF)

# ---------------------------------------------------------------- structures


def der(data: bytes, depth: int = 0) -> list | None:
    """[(tag, content or nested list)] if the lengths fill the bytes exactly at every level, else None."""
    out, i = [], 0
    while i < len(data):
        if i + 2 > len(data):
            return None
        tag, length = data[i], data[i + 1]
        i += 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or i + n > len(data):
                return None
            length = int.from_bytes(data[i : i + n], "big")
            i += n
        if i + length > len(data):
            return None
        body = data[i : i + length]
        i += length
        if tag & 0x20:
            if depth >= 16:
                return None
            nested = der(body, depth + 1)
            if nested is None:
                return None
            out.append((tag, nested))
        else:
            out.append((tag, body))
    return out


def is_der_key(data: bytes) -> bool:
    """A key in DER: PKCS#8, PKCS#1, SEC1, an encrypted PKCS#8 or a public SubjectPublicKeyInfo."""
    if len(data) < 24 or data[0] != 0x30:
        return False
    top = der(data)
    if not top or len(top) != 1:
        return False
    parts = top[0][1]
    tags = [t for t, _ in parts]
    algorithm = lambda x: x[0] == 0x30 and bool(x[1]) and x[1][0][0] == 0x06
    if tags[:3] == [0x02, 0x30, 0x04]:  # version, algorithm, key
        return algorithm(parts[1])
    if len(tags) >= 8 and all(t == 0x02 for t in tags[:8]):  # RSA numbers
        return True
    if tags[:2] == [0x02, 0x04]:  # EC private key
        return len(parts[1][1]) >= 16
    if tags == [0x30, 0x04] or tags == [0x30, 0x03]:  # encrypted private, or public
        return algorithm(parts[0])
    return False


def ssh_fields(data: bytes) -> list[bytes] | None:
    """Length-prefixed fields that fill the bytes exactly."""
    out, i = [], 0
    while i < len(data):
        if i + 4 > len(data):
            return None
        n = int.from_bytes(data[i : i + 4], "big")
        i += 4
        if i + n > len(data):
            return None
        out.append(data[i : i + n])
        i += n
    return out


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key container, or a public key blob."""
    magic = b"openssh-key-v1\x00"
    if data.startswith(magic):
        at, got = len(magic), []
        for _ in range(3):  # cipher, kdf, its options
            if at + 4 > len(data):
                return False
            n = int.from_bytes(data[at : at + 4], "big")
            got.append(data[at + 4 : at + 4 + n])
            at += 4 + n
        if at + 4 > len(data):
            return False
        keys = int.from_bytes(data[at : at + 4], "big")
        rest = ssh_fields(data[at + 4 :].rstrip(b"\x00") if keys else b"")
        return 1 <= keys <= 64 and rest is not None and len(rest) == keys + 1
    fields = ssh_fields(data) if data[:4] and int.from_bytes(data[:4], "big") <= 64 else None
    return bool(fields) and len(fields) >= 2 and re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+", fields[0]) is not None


def decode64(text: bytes) -> bytes | None:
    text = text.rstrip(b"=").replace(b"-", b"+").replace(b"_", b"/")
    try:
        return base64.b64decode(text + b"=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_key(data: bytes | None) -> bool:
    return bool(data) and (is_der_key(data) or is_ssh_key(data))


def is_signed_token(token: bytes) -> bool:
    """header.payload.signature with JSON objects, an algorithm, and a signature unless the algorithm is none."""
    head, payload, signature = token.split(b".")
    found = []
    for part in (head, payload):
        try:
            found.append(json.loads(decode64(part) or b""))
        except (ValueError, RecursionError):
            return False
    if not all(isinstance(x, dict) for x in found) or not isinstance(found[0].get("alg"), str):
        return False
    return found[0]["alg"].lower() == "none" or bool(decode64(signature))


def pem_end(data: bytes, head: re.Match) -> int:
    """End of the block if its body, which has no further dashes, decodes to a key; else -1. Rows are a zero byte apart."""
    tail = b"-----END " + head[1] + b"-----"
    at = data.find(b"-----", head.end())
    if at < 0 or not data.startswith(tail, at) or b"\x00" in data[head.end() : at]:
        return -1
    lines = _BREAK.sub(b"\n", data[head.end() : at]).splitlines()
    body = b"".join(x.strip() for x in lines if b":" not in x)
    raw = decode64(body)
    legacy = any(x.startswith(b"Proc-Type:") for x in lines)  # encrypted bytes have no structure
    return at + len(tail) if raw and (is_key(raw) or legacy and len(raw) % 8 == 0) else -1


def key_chars(text: bytes, at: int) -> int:
    """Length of the base64 at `at` that is a key by its own length fields; 0 if none is."""
    head = decode64(text[at : at + 8]) or b""
    if head[:1] == b"\x30" and len(head) == 6:
        n = head[1] & 0x7F if head[1] & 0x80 else 0
        if n > 2:  # 64 KB are more than any key
            return 0
        size = 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])
        chars = -(-size * 4 // 3)
    else:
        chars = len(text) - at
    if chars > 1 << 17 or at + chars > len(text):
        return 0
    body = text[at : at + chars]
    # one alphabet
    return chars if is_key(decode64(body)) and not _OTHERS.search(body) else 0


def keys_in_lines(lines: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of keys anywhere in base64 lines."""
    parts, place, at = [], [], 0
    for m in [*_BREAK.finditer(lines), None]:
        end = m.start() if m else len(lines)
        parts.append(lines[at:end])
        place.append(np.arange(at, end))
        at = m.end() if m else end
    text, where, after = b"".join(parts), np.concatenate(place), 0
    for m in _BEGIN.finditer(text):
        if m.start() >= after and (n := key_chars(text, m.start())):
            after = m.start() + n
            yield int(where[m.start()]), int(where[after - 1]) + 1


# ---------------------------------------------------------------- spans


def find_spans(column: pa.Array) -> list[list[tuple[int, int, int]]]:
    """Of each text: (start, kind as index of KINDS, end) in code points, sorted."""
    plain, off = C.text_buffer(column)
    rows = len(off) - 1
    # one zero byte after each row keeps matches within rows; it is in none of the classes
    data = np.zeros(len(plain) + rows, np.uint8)
    data[np.arange(len(plain)) + np.repeat(np.arange(rows), np.diff(off))] = plain
    base = off + np.arange(rows + 1)
    buffer = data.tobytes()
    spans: list[tuple[int, int, int]] = []

    spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(C.LOWER[data].tobytes()) if m.end(1) - m.start(1) >= 6]
    spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(buffer) if m.end() - m.start() >= 20]
    starts, ends = C.runs(_HEX[data], base)
    far = ends - starts >= 24
    spans += [(s, 2, e) for s, e in zip(starts[far].tolist(), ends[far].tolist(), strict=True)]

    after = 0
    for m in _TOKEN.finditer(buffer):
        if m.start() >= after and is_signed_token(m[1]):
            after = m.end(1)
            spans.append((m.start(), 3, after))
    at = 0
    while head := _PEM_HEAD.search(buffer, at):
        end = pem_end(buffer, head)
        if end > 0:
            spans.append((head.start(), 4, end))
        at = max(end, head.end())
    starts, ends = C.runs(_B64[data], base)
    far = ends - starts >= 40
    for s, e in zip(starts[far].tolist(), ends[far].tolist(), strict=True):
        if is_key(decode64(buffer[s:e])):
            spans.append((s, 5, e + len(_PAD.match(buffer, e)[0])))
    found = sorted((s, e) for s, k, e in spans if k in (4, 5))
    for m in _LINES.finditer(buffer):
        for s, e in keys_in_lines(m[0]):
            s, e = s + m.start(), e + m.start()
            if not any(x < e and s < y for x, y in found[max(0, bisect.bisect(found, (s,)) - 2) : bisect.bisect(found, (e,))]):
                spans.append((s, 5, e + len(_PAD.match(buffer, e)[0])))
    starts, ends = C.runs(_ANY_HEX[data], base)
    far = (ends - starts >= 48) & ((ends - starts) % 2 == 0)
    spans += [(s, 6, e) for s, e in zip(starts[far].tolist(), ends[far].tolist(), strict=True) if is_key(bytes.fromhex(buffer[s:e].decode()))]

    out: list[list[tuple[int, int, int]]] = [[] for _ in range(rows)]
    if spans:
        spans.sort()
        heads = np.zeros(len(data) + 1, np.int64)
        np.cumsum(~_TAIL[data], out=heads[1:])
        s, kind, e = np.array(spans).T
        row = np.searchsorted(base, s, side="right") - 1
        for r, x, k, y in zip(row.tolist(), (heads[s] - heads[base[row]]).tolist(), kind.tolist(), (heads[e] - heads[base[row]]).tolist(), strict=True):
            out[r].append((x, k, y))
    return out


def said(spans: list[tuple[int, int, int]], kinds: int = len(KINDS)) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans if k < kinds)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts by kind, base_sha256 over the base spans, and all spans."""
    counts = [f"n_{k}" for k in KINDS]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in C.pieces(batches, "__text"):
            found = find_spans(piece.column("__text"))
            by_kind = np.array([np.bincount([k for _, k, _ in x], minlength=len(KINDS)) if x else np.zeros(len(KINDS), int) for x in found], np.int64)
            columns = [piece.column("__id"), *(pa.array(by_kind[:, k]) for k in range(len(KINDS))), pa.array([sha256(said(x, 3).encode()).hexdigest() for x in found]), pa.array([said(x) for x in found])]
            yield pa.RecordBatch.from_arrays(columns, [id_col, *counts, "base_sha256", "spans"])

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, " + ", ".join(f"{c} long" for c in counts) + ", base_sha256 string, spans string"
    return docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text")).mapInArrow(work, schema)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """All documents and columns; every span is replaced by the mark, and the length column follows the text."""
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in C.pieces(batches, text_col):
            found = find_spans(piece.column(text_col))
            if any(found):
                texts = [redacted(t, x, mark) if x else t for t, x in zip(piece.column(text_col).to_pylist(), found, strict=True)]
                columns = [piece.column(i) for i in range(len(names))]
                columns[names.index(text_col)] = pa.array(texts, piece.schema.field(text_col).type)
                if length_col in names:
                    old = piece.column(length_col).to_pylist()
                    columns[names.index(length_col)] = pa.array([len(t) if x else n for t, x, n in zip(texts, found, old, strict=True)], piece.schema.field(length_col).type)
                piece = pa.RecordBatch.from_arrays(columns, schema=piece.schema)
            yield piece

    return docs.mapInArrow(work, docs.schema)
