"""Secret scans: patterns find candidates, and what a candidate decodes to confirms it.

Base kinds (``assign``, ``access``, ``hex``) are found by pattern alone and always reported. Structural kinds are
reported only if their content holds together:

* ``jwt``: three base64url parts, of which the first two are JSON objects and the first names an algorithm;
* ``pem``: an armoured private key, headers allowed, whose body is base64 of one DER sequence with exact nested lengths, or
  of an OpenSSH private key;
* ``der``: a base64, base64url or hex run that decodes to such a sequence and begins as a private key does;
* ``sshkey``: such a run that decodes to an OpenSSH private key or key blob whose length fields fill it.

A run of base64 may be wrapped over lines. A run inside an armoured key, and a key blob inside a key, is part of it and isn't reported.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "sshkey")
_NAMES = ("password", "passwd", "secret", "token", r"api_?key")
_ASSIGN = re.compile(
    "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in _NAMES) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_.-])(ey[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----((?:\s*[A-Za-z0-9-]+:[^\n]*\n)*)([A-Za-z0-9+/=\s]+)-----END \1PRIVATE KEY-----")
#: Base64 of a DER sequence begins with M, of an OpenSSH key with b3Blbn or AAAA. Lines of one length may follow, and a shorter last one.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M[A-Za-z0-9+/_-]|b3Blbn|AAAA)[A-Za-z0-9+/_-]{14,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]{1,128})*={0,2}")
#: Hex of a DER sequence begins with 30, of an OpenSSH key with "openssh" or a length of less than 256.
_HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?:30|6[fF]70656[eE]737368|000000)[0-9A-Fa-f]{26,}(?![0-9A-Fa-f])")
_SSH_MAGIC = b"openssh-key-v1\0"
_SSH_KEY = re.compile(rb"(?:ssh-|ecdsa-|sk-)[a-z0-9@.-]+")


def _base64(text: str, url: bool = False) -> bytes | None:
    """The bytes of base64 with or without padding; None if it isn't base64."""
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the elements that fill data[start:end] exactly; None if lengths don't add up."""
    items = []
    while start < end:
        if start + 2 > end:
            return None
        tag, size = data[start], data[start + 1]
        body = start + 2
        if size >= 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or body + width > end:
                return None
            size = int.from_bytes(data[body : body + width], "big")
            body += width
        if body + size > end:
            return None
        items.append((tag, body, body + size))
        start = body + size
    return items


def is_private_der(data: bytes) -> bool:
    """One SEQUENCE that fills ``data``: an integer version, then a private key's fields with exact lengths.

    Known are PKCS#1 (nine integers), PKCS#8 (algorithm, octets), SEC 1 (octets after version 1) and
    encrypted PKCS#8 (algorithm, octets).
    """
    top = der_items(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    fields = der_items(data, top[0][1], top[0][2])
    if not fields:
        return False
    tags = [f[0] for f in fields]
    if tags[0] == 0x02:
        if len(tags) >= 9 and set(tags[:9]) == {0x02}:
            return True
        if len(tags) >= 2 and tags[1] == 0x04:
            return fields[0][2] - fields[0][1] == 1 and data[fields[0][1]] == 1
        fields, tags = fields[1:], tags[1:]
    if len(tags) < 2 or tags[0] != 0x30 or tags[1] != 0x04:
        return False
    algorithm = der_items(data, fields[0][1], fields[0][2])
    return bool(algorithm) and algorithm[0][0] == 0x06


def _strings(data: bytes, at: int, count: int | None = None) -> tuple[list[bytes], int] | None:
    """``count`` strings with 32-bit lengths ahead, from ``at`` on, and where they end; without a count, those that fill the rest."""
    parts: list[bytes] = []
    while at < len(data) if count is None else len(parts) < count:
        body = at + 4
        end = body + int.from_bytes(data[at:body], "big")
        if body > len(data) or end > len(data):
            return None
        parts.append(data[body:end])
        at = end
    return parts, at


def _is_blob(data: bytes) -> bool:
    """A key blob: two strings or more that fill it, of which the first names an algorithm."""
    found = _strings(data, 0)
    return found is not None and len(found[0]) >= 2 and _SSH_KEY.fullmatch(found[0][0]) is not None


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key file's body, or a key blob.

    The body holds, after the magic, cipher, derivation and its options as strings, a number of keys, a public key blob
    for each, and one encrypted or plain section; they must fill it, and a plain section begins with one number twice.
    """
    if not data.startswith(_SSH_MAGIC):
        return _is_blob(data)
    head = _strings(data, len(_SSH_MAGIC), 3)
    if head is None:
        return False
    (cipher, derivation, _), at = head
    count = int.from_bytes(data[at : at + 4], "big")
    if not (re.fullmatch(rb"[a-z0-9@.-]+", cipher) and re.fullmatch(rb"[a-z0-9@.-]+", derivation)) or not 1 <= count <= 64:
        return False
    keys = _strings(data, at + 4, count + 1)
    if keys is None or keys[1] != len(data) or not all(map(_is_blob, keys[0][:-1])):
        return False
    section = keys[0][-1]
    return len(section) >= 8 and (cipher != b"none" or section[:4] == section[4:8])


def is_jwt(header: str, payload: str) -> bool:
    """Whether both parts are JSON objects and the header names an algorithm."""
    found = []
    for part in (header, payload):
        raw = _base64(part, url=True)
        try:
            found.append(json.loads(raw.decode()) if raw is not None else None)
        except (ValueError, RecursionError):
            return False
    return all(isinstance(x, dict) for x in found) and isinstance(found[0].get("alg"), str)


def _key_kind(raw: bytes | None) -> int | None:
    if raw is None:
        return None
    if raw[:1] == b"\x30":
        return 5 if is_private_der(raw) else None
    return 6 if is_ssh_key(raw) else None


def _run_key(run: str) -> tuple[int, int] | None:
    """(length, kind) of the key that a run of base64 begins with: as one line, or with lines that are as long and a shorter last one."""
    lines = re.split(r"(\r?\n[\x20\t]*)", run)
    ends, wide, end = [len(lines[0])], len(lines[0]), len(lines[0])
    for gap, line in zip(lines[1::2], lines[2::2], strict=True):
        end += len(gap) + len(line)
        if len(line) > wide:
            break
        ends.append(end)
        if len(line) < wide:
            break
    # The whole run, and its first line alone: a word on the next line may look like base64 too.
    for end in dict.fromkeys((ends[-1], ends[0], *ends[-2:-1])):
        text = re.sub(r"\s+", "", run[:end])
        kind = _key_kind(_base64(text, url="-" in text or "_" in text))
        if kind:
            return end, kind
    return None


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) of all spans, sorted by start and kind; ends are exclusive."""
    spans = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    if "ey" in text:
        spans += [(m.start(), m.end(), 3) for m in _JWT.finditer(text) if is_jwt(m[1], m[2])]
    armoured = []
    if "PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            raw = _base64(re.sub(r"\s+", "", m[3]))
            # An encrypted body under headers isn't DER: the headers name its cipher.
            if raw is not None and (is_private_der(raw) or is_ssh_key(raw) or ("DEK-Info:" in m[2] and len(raw) >= 64 and len(raw) % 8 == 0)):
                armoured.append((m.start(), m.end()))
        spans += [(a, b, 4) for a, b in armoured]
    outside = lambda m: not any(a <= m.start() and m.end() <= b for a, b in armoured)
    for m in filter(outside, _RUN.finditer(text)):
        found = _run_key(m[0])
        if found:
            spans.append((m.start(), m.start() + found[0], found[1]))
    for m in filter(outside, _HEX_KEY.finditer(text)):
        kind = _key_kind(bytes.fromhex(m[0])) if len(m[0]) % 2 == 0 else None
        if kind:
            spans.append((m.start(), m.end(), kind))
    spans.sort(key=lambda s: (s[0], s[2], s[1]))
    return spans


def _scan(batches: Iterator[pa.RecordBatch], text_at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    for batch in batches:
        found = []
        for text in batch.column(text_at):
            text = text.as_py()
            found.append([{"kind": KINDS[k], "start": a, "end": b} for a, b, k in scan(text)] if text else [])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(kind))], names=names)


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``spans`` added: array of (kind, start, end), in code points, by start and kind.

    Null and empty texts have no spans. Repeated rows are scanned alike; a column ``spans`` is replaced; an
    empty table gives an empty result. Structural spans may lie over base spans; both stay.

    Scale: narrow, one pass; a task holds one batch of texts.
    """
    from pyspark.sql.types import StructType

    given = [c for c in docs.columns if c != "spans"]
    source = docs.select(*given)
    full = StructType(source.schema.fields + StructType.fromDDL("spans array<struct<kind:string,start:int,end:int>>").fields)
    at, names = given.index(text_col), [f.name for f in full.fields]
    return source.mapInArrow(lambda batches: _scan(batches, at, names), full)


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return scanned.select(
        id_col,
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
