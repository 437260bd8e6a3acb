"""Secret scans: pattern matches, plus candidates that are reported only when their decoded structure confirms them."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayline.llm.common import small_batches, within

#: Fixed patterns: the base kinds, in the order in which ties at one start are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "pem_key", "der_key", "hex_key", "ssh_key", "jwt")
BASE = KINDS[:3]

# a brace, then a quote or white space
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[yw][A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:[^-]|-(?!----))+)-----END \1-----")
# line breaks of armour and wrapped base64, also as escapes in quoted strings
_BREAK = re.compile(r"(?:\\r)?\\n|\s+")
_LEAD = re.compile(r"\s*(?:\\[nr])*")
_HEADER = re.compile(r"([A-Za-z][A-Za-z0-9-]*): *([^\r\n\\]*)((?:\\r)?\\n|\r?\n)")
_CIPHER = re.compile(r"[A-Za-z0-9-]+,((?:[0-9A-Fa-f]{2}){8}|(?:[0-9A-Fa-f]{2}){16})\Z")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])[Mb][A-Za-z0-9+/]{39,}(?:(?:(?:\\r)?\\n|\r?\n)[ \t]*[A-Za-z0-9+/]+)+={0,2}")
_HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
_SSH_MAGIC = b"openssh-key-v1\0"
#: The encodings of the object identifiers of password-based encryption (PKCS#5 and PKCS#12) begin with these.
_PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def _decode64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _may_be_key(tags: list[int]) -> bool:
    """Whether the values of a key can begin with these: integers; version, algorithm, octets; version, octets, tagged; algorithm, octets."""
    kind = tags[1] if len(tags) > 1 else None
    if tags[0] == 0x30:
        return kind in (None, 0x04) and len(tags) < 3
    rest = {None: set(), 0x02: {0x02}, 0x30: {0x04}, 0x04: {0xA0, 0xA1}}.get(kind)
    return tags[0] == 0x02 and rest is not None and set(tags[2 : 3 if kind == 0x30 else 9]) <= rest


def _der_items(data: bytes, start: int, end: int, of_key: bool = False) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[start:end] exactly, or None; also as soon as they cannot be those ``of_key``."""
    items = []
    while start < end:
        if start + 2 > end:
            return None
        tag, length, at = data[start], data[start + 1], start + 2
        if length >= 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            length, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + length > end:
            return None
        items.append((tag, at, at + length))
        if of_key and len(items) <= 9 and not _may_be_key([x[0] for x in items]):
            return None
        start = at + length
    return items


def is_der_key(data: bytes) -> bool:
    """A private key: PKCS#1 (nine integers), PKCS#8 (version, algorithm, octets; or a password-based algorithm and octets) or SEC 1 (version 1, octets)."""
    if len(data) < 16 or data[0] != 0x30:
        return False
    top = _der_items(data, 0, len(data))
    if not top or len(top) != 1:
        return False
    inner = _der_items(data, *top[0][1:], of_key=True)
    if inner and [tag for tag, _, _ in inner] == [0x30, 0x04]:
        algorithm = _der_items(data, *inner[0][1:])
        return bool(algorithm) and algorithm[0][0] == 0x06 and data[algorithm[0][1] : algorithm[0][2]].startswith(_PASSWORD_BASED)
    if not inner or inner[0][0] != 0x02:
        return False
    tags = [tag for tag, _, _ in inner]
    version = int.from_bytes(data[inner[0][1] : inner[0][2]], "big") if inner[0][2] - inner[0][1] <= 4 else -1
    if len(tags) >= 9 and set(tags[:9]) == {0x02} and version in (0, 1):
        return True
    if tags[:3] == [0x02, 0x30, 0x04] and version in (0, 1):
        algorithm = _der_items(data, *inner[1][1:])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return tags[:2] == [0x02, 0x04] and version == 1 and set(tags[2:]) <= {0xA0, 0xA1}


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key: its magic, three length-prefixed names, a key count, then length-prefixed blocks."""
    if not data.startswith(_SSH_MAGIC):
        return False
    at = len(_SSH_MAGIC)

    def block(at: int) -> int | None:
        if at + 4 > len(data):
            return None
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        return end if end <= len(data) else None

    for _ in range(3):
        if (at := block(at)) is None:
            return False
    if at + 4 > len(data) or not 1 <= (keys := int.from_bytes(data[at : at + 4], "big")) <= 16:
        return False
    at += 4
    for _ in range(keys + 1):
        if (at := block(at)) is None:
            return False
    return True


def is_signed_token(head: str, body: str, signature: str) -> bool:
    """A compact signed token: a JSON header that names its algorithm, a JSON object, and a signature if one is due."""
    try:
        header, claims = json.loads(_decode64(head) or b"x"), json.loads(_decode64(body) or b"x")
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(claims, dict) or not isinstance(header.get("alg"), str):
        return False
    sealed = _decode64(signature)
    return bool(signature == "" and header["alg"].lower() == "none") or bool(sealed and len(sealed) >= 16)


def is_armoured_key(body: str) -> bool:
    """What stands between the armour lines: headers, then base64 of a key, or of whole cipher blocks where the headers say so."""
    at, headers = _LEAD.match(body).end(), {}
    while m := _HEADER.match(body, at):
        headers[m[1]] = m[2].strip()
        at = m.end()
    data = _decode64(_BREAK.sub("", body[at:]))
    if not data:
        return False
    if headers.get("Proc-Type", "").endswith("ENCRYPTED"):
        cipher = _CIPHER.match(headers.get("DEK-Info", ""))
        return bool(cipher) and len(data) >= 32 and len(data) % (len(cipher[1]) // 2) == 0
    return is_der_key(data) or is_ssh_key(data)


def _wrapped_key(text: str, m: re.Match) -> tuple[int, str] | None:
    """End and kind of the key whose base64 starts at the match and goes on over its lines; a DER key ends where its length says."""
    line = re.match(r"[A-Za-z0-9+/]*", m[0])[0]
    head = base64.b64decode(line[:12])
    if m[0][0] == "b":
        data = _decode64(_BREAK.sub("", m[0]))
        return (m.end(), "ssh_key") if data and is_ssh_key(data) else None
    length, size = head[1], 2
    if length >= 0x80:
        n = length & 0x7F
        if not 1 <= n <= 4:
            return None
        length, size = int.from_bytes(head[2 : 2 + n], "big"), 2 + n
    chars = -(-(size + length) * 4 // 3)
    if chars <= len(line):
        return None  # within one line: found without this
    if chars > m.end() - m.start():
        return None  # shorter than its length says
    # all of the match but its breaks (white space, escapes) and padding is base64
    held = np.frombuffer(m[0].encode("ascii"), np.uint8)
    escape = held == ord("\\")
    real = (held > 32) & ~escape & (held != ord("="))
    real[1:] &= ~escape[:-1]
    places = np.flatnonzero(real)[:chars]
    if len(places) < chars:
        return None
    data = _decode64(held[places].tobytes().decode("ascii"))
    if not data or not is_der_key(data[: size + length]) or len(data) < size + length:
        return None
    pad = re.compile("={0,2}").match(text, m.start() + int(places[-1]) + 1)
    return pad.end(), "der_key"


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; code points, end exclusive; leftmost non-overlapping in each kind."""
    low = text.lower()  # a plain search for the fixed words is far faster than the pattern
    found = []
    if any(word in low for word in ("passw", "secret", "token", "api")):
        found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "." in text:
        found += [(m.start(), m.end(), "jwt") for m in _TOKEN.finditer(text) if is_signed_token(*m.groups())]
    armoured = [(m.start(), m.end(), "pem_key") for m in _PEM.finditer(text) if is_armoured_key(m[2])] if "-----BEGIN " in text else []
    found += armoured
    keys = []
    for m in _BASE64.finditer(text):
        # one octet of 0x30 leads with M in base64, the OpenSSH magic with b3BlbnNzaC1r
        if m[0][0] in "Mb" and (data := _decode64(m[0])):
            if is_der_key(data):
                keys.append((m.start(), m.end(), "der_key"))
            elif is_ssh_key(data):
                keys.append((m.start(), m.end(), "ssh_key"))
    whole = {start for start, _, _ in keys}
    for m in _WRAPPED.finditer(text):
        if m.start() not in whole and (hit := _wrapped_key(text, m)):
            keys.append((m.start(), *hit))
    end = {"der_key": -1, "ssh_key": -1}
    for key in sorted(keys):
        if key[0] >= end[key[2]] and not any(a <= key[0] < b for a, b, _ in armoured):
            end[key[2]] = key[1]
            found.append(key)
    for m in _HEX_ANY.finditer(text):
        if (m[0].startswith("30") and is_der_key(bytes.fromhex(m[0]))) or (m[0][:8].lower() == "6f70656e" and is_ssh_key(bytes.fromhex(m[0]))):
            found.append((m.start(), m.end(), "hex_key"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """``text`` with each run of overlapping spans replaced by one ``[SECRET]``."""
    out, at = [], 0
    merged: list[list[int]] = []
    for start, end, _ in found:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], "[SECRET]"]
        at = end
    return "".join(out) + text[at:]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in within(batches):
        found = [spans(t or "") for t in batch.column("text").to_pylist()]
        rows = [[{"kind": k, "start": s, "end": e} for s, e, k in f] for f in found]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans`` (kind, start, end) of every secret in the whole ``text``; one row for each row of ``docs``.

    Base kinds are plain matches; the other kinds are reported only if the candidate decodes and its structure
    (DER lengths, OpenSSH blocks, token header and claims) holds to its end. Null and empty texts have no spans;
    rows are independent, so null, repeated ids and repeated rows come back as they are. An empty table gives none.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text, from ``find_secrets`` rows."""

    def some(*kinds: str) -> Column:
        return F.filter("spans", lambda x: x["kind"].isin(*kinds))

    def said(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    counts = [F.size(some(kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(said(some(*BASE)), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``[SECRET]`` and ``n_chars`` of the new text; all rows stay."""
    small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in within(batches):
            columns = dict(zip(names, batch.columns, strict=True))
            texts = columns["text"].to_pylist()
            new = [None if t is None else redact(t, spans(t)) for t in texts]
            columns["text"] = pa.array(new, pa.string())
            if "n_chars" in columns:
                kept = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([k if n is None or n == t else len(n) for k, n, t in zip(kept, new, texts, strict=True)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return docs.mapInArrow(run, docs.schema)
