"""Secret scan with structural confirmation.

A pattern only proposes candidates. A candidate is reported when it decodes (base64, base64url, hex,
base32 or base62) and what it decodes to has the structure of a secret: nested DER lengths of a
private key that fill the value exactly, the length-prefixed parts of an OpenSSH key, the header,
claims and signature length of a signed token, a token's checksum, an access key id's encoded
account, or, for an opaque value that is assigned to a credential's name, enough decoded bytes.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import only
from .textutil import text_steps

#: What the JVM looks for first; a text without it can hold no secret of the kinds below.
PREFILTER = r"[A-Za-z0-9+/_-]{16}|PRIVATE KEY-----|30:[0-9A-Fa-f]{2}:[0-9A-Fa-f]{2}:"

#: An armoured key; a body holds no "--", so that no begin line is searched past the next one.
_PEM = re.compile(r"-----BEGIN (?P<label>[A-Z0-9 ]{0,40}PRIVATE KEY)-----(?P<body>(?:[A-Za-z0-9+/=\s,:.\\]|-(?!-))*+)-----END (?P=label)-----")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Secrets with a fixed start, wherever no letter or digit stands beside them.
_FIXED = re.compile(r"(?<![A-Za-z0-9])(?:A[KS]IA[A-Z2-7]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])")
_LINE, _WRAP, _PAD = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"(?:\r?\n|(?:\\r)?\\n)[ \t]{0,16}"), re.compile("={0,2}")
_LINES = re.compile(rf"{_LINE.pattern}(?:{_WRAP.pattern}{_LINE.pattern})*+")
_MAGIC = re.compile(r"[A-Za-z0-9+/]+={0,2}")
_DOTTED = re.compile(r"[A-Za-z0-9_.-]{24,}")
_HEADER = re.compile(r"(?<![A-Za-z0-9])e[wy]")
_COLONS = re.compile(r"(?<![0-9A-Fa-f:])30:(?:[0-9A-Fa-f]{2}:\s{0,40})++[0-9A-Fa-f]{2}(?![0-9A-Fa-f])")
#: Starts of an encoded key within or at the start of a run: a DER sequence or OpenSSH's magic.
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:M[A-Z]|b3BlbnNzaC1rZXktdjEA|30)")
#: Characters of a token's header, and decoded bytes of an opaque value or an encoded key, at most.
_MOST_HEADER, _MOST_OPAQUE, _MOST_KEY = 4096, 4096, 12_288
_NAMED = re.compile(r"(?:secret|token|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth|credentials?|private[_-]?key|encryption[_-]?key)[\"']?\s{0,4}(?:=>|:=|[:=])\s{0,4}[\"']?$", re.IGNORECASE)
_HEX = re.compile(r"(?:[0-9a-f]{2}){8,}|(?:[0-9A-F]{2}){8,}")
_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_SIGNATURE = {"HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64), "ES256": (64, 64), "ES384": (96, 96), "ES512": (132, 132), "EdDSA": (64, 114)} | dict.fromkeys(("RS256", "RS384", "RS512", "PS256", "PS384", "PS512"), (128, 1024))


def from_base64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padded or not; None where it isn't canonical."""
    body = text.rstrip("=")
    if len(body) % 4 == 1 or ("-" in body or "_" in body) and ("+" in body or "/" in body):
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_parts(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of the DER values that fill `data` exactly; None where a length doesn't fit."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
                return None
            size = int.from_bytes(data[at : at + n], "big")
            at += n
            if size < 0x80:
                return None
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def private_der(data: bytes) -> str | None:
    """Kind of private key that the bytes are, by its nested structure."""
    top = der_parts(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return None
    parts = der_parts(top[0][1])
    if not parts:
        return None
    tags = [t for t, _ in parts]
    if tags == [2] * 9 and parts[0][1] == b"\0" and len(parts[1][1]) >= 32:
        return "rsa_private_key"
    if tags == [2] * 6 and parts[0][1] == b"\0":
        return "dsa_private_key"
    if tags[:2] == [2, 4] and parts[0][1] == b"\1" and len(parts[1][1]) in range(20, 67):
        return "ec_private_key"
    if tags[:3] == [2, 0x30, 4] and parts[0][1] in (b"\0", b"\1"):
        algorithm = der_parts(parts[1][1])
        if algorithm and algorithm[0][0] == 6 and der_parts(parts[2][1]):
            return "pkcs8_private_key"
    if tags == [0x30, 4]:
        algorithm = der_parts(parts[0][1])
        if algorithm and algorithm[0][0] == 6 and algorithm[0][1].startswith(b"\x2a\x86\x48\x86\xf7\x0d\x01"):
            return "encrypted_private_key"
    return None


def openssh_key(data: bytes) -> str | None:
    """An OpenSSH private key: the magic, then strings whose lengths nest to the end of the data."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return None
    at = len(magic)

    def string() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    if any(string() is None for _ in range(3)) or at + 4 > len(data):
        return None
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 64 or any(string() is None for _ in range(keys + 1)):
        return None
    return "openssh_private_key" if at == len(data) else None


def signed_token(text: str) -> tuple[str, int] | None:
    """(detail, bytes of the signature) of a signed token: JSON header with a known algorithm, JSON
    claims, and a signature of the length that the algorithm makes."""
    parts = text.split(".")
    if len(parts) != 3:
        return None
    raw = [from_base64(p) for p in parts]
    if any(r is None for r in raw):
        return None
    try:
        header, claims = json.loads(raw[0]), json.loads(raw[1])
    except (ValueError, RecursionError):
        return None
    if not isinstance(header, dict) or not isinstance(claims, dict):
        return None
    algorithm = header.get("alg")
    least, most = _SIGNATURE.get(algorithm if isinstance(algorithm, str) else "", (1, 0))
    return (f"alg={algorithm}", len(raw[2])) if least <= len(raw[2]) <= most else None


def access_key_id(text: str) -> str | None:
    """Account number within a cloud access key id, a base32 value after its four-letter prefix."""
    if len(text) != 20 or not text.startswith(("AKIA", "ASIA")):
        return None
    try:
        data = base64.b32decode(text[4:])
    except binascii.Error:
        return None
    return f"account={(int.from_bytes(data[:6], 'big') & 0x7FFFFFFFFF80) >> 7:012d}"


def checksum_token(text: str) -> bool:
    """A token gh?_ with 30 characters and their CRC-32 in base 62."""
    if len(text) != 40 or text[:2] != "gh" or text[2] not in "pousr" or text[3] != "_" or not text[4:].isalnum():
        return False
    value, digits = zlib.crc32(text[4:34].encode()), ""
    while value:
        value, digit = divmod(value, 62)
        digits = _B62[digit] + digits
    return digits.rjust(6, "0") == text[34:]


def opaque(text: str) -> tuple[str, int] | None:
    """(encoding, bytes) of a value that is assigned to a credential's name."""
    if _HEX.fullmatch(text):
        data = bytes.fromhex(text)
        return ("hex", len(data)) if len(set(data)) * 2 >= min(len(data), 16) else None
    if text.isdigit() or not any(c.isdigit() for c in text) or text.upper() == text or text.lower() == text:
        return None
    data = from_base64(text)
    return ("base64", len(data)) if data and len(data) >= 12 and len(set(data)) * 2 >= min(len(data), 16) else None


def confirm(text: str) -> tuple[str, str, int] | None:
    """(kind, detail, decoded bytes) of one whole candidate, or None."""
    if "." in text:
        found = signed_token(text)
        return ("signed_token", *found) if found else None
    account = access_key_id(text)
    if account:
        return "access_key_id", account, 10
    if checksum_token(text):
        return "checksum_token", "crc32", 30
    if _HEX.fullmatch(text):
        data, how = bytes.fromhex(text), "hex"
    else:
        data, how = from_base64(text) if len(text) >= 40 else None, "base64"
    kind = data and (private_der(data) or openssh_key(data))
    return (kind, how, len(data)) if kind else None


def confirm_pem(body: str) -> tuple[str, str, int] | None:
    """The same for what stands between the lines of an armoured key."""
    lines = [x for x in re.split(r"(?:\\[rn]|\s)+", body) if x and ":" not in x and "," not in x]
    data = from_base64("".join(lines))
    kind = data and (private_der(data) or openssh_key(data))
    if kind:
        return kind, "pem", len(data)
    if data and "ENCRYPTED" in body and len(data) >= 64 and len(data) % 8 == 0:
        return "encrypted_private_key", "pem", len(data)
    return None


def _der_size(head: bytes) -> int:
    """Bytes of the DER sequence that begins so, 0 where none does."""
    if len(head) < 6 or head[0] != 0x30:
        return 0
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    if n > 3:
        return 0
    return 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])


def _key_at(text: str, at: int) -> tuple[int, tuple[str, str, int]] | None:
    """(length, secret) of an encoded key that begins at a position. The encoded length is in its head, so
    that only that much is decoded; base64 may be wrapped."""
    head = text[at : at + 8]
    if head.startswith("30"):
        try:
            size = 2 * _der_size(bytes.fromhex(text[at : at + 16]))
        except ValueError:
            size = 0
        part = text[at : at + size]
        if 32 <= size <= 2 * _MOST_KEY and len(part) == size and not text[at + size : at + size + 1].isalnum():
            found = confirm(part)
            return (size, found) if found else None
    if head.startswith("b3Bl"):
        m = _MAGIC.match(text, at, at + 2 * _MOST_KEY)
        found = confirm(m.group())
        return (len(m.group()), found) if found else None
    if not head.startswith("M"):
        return None
    head = _WRAP.sub("", text[at : at + 40])[:16]
    data = from_base64(head) if len(head) == 16 else None
    size = _der_size(data) if data else 0
    inner = data[2 + (data[1] & 0x7F if data[1] & 0x80 else 0) :] if 12 <= size <= _MOST_KEY else b""
    if not inner.startswith((b"\2\1\0", b"\2\1\1", b"\x30")):  # a version or an algorithm comes first in every kind
        return None
    left, end = (size * 8 + 5) // 6, at
    body = _WRAP.sub("", _LINES.match(text, at, at + 2 * left + 64).group())
    found = confirm(body[:left]) if len(body) >= left else None
    while found and left:  # where in the text that many characters end
        m = _LINE.match(text, end, end + left)
        end, left = m.end(), left - len(m.group())
        end = _WRAP.match(text, end).end() if left else end
    if not found or text[end : end + 1].isalnum():
        return None
    return _PAD.match(text, end).end() - at, found


def _tokens(text: str, m: re.Match) -> list[tuple[int, int, tuple[str, str, int]]]:
    """(start, length, secret) of the signed tokens within a run of dotted parts."""
    out, start = [], m.start()
    parts = m.group().split(".")
    for i, head in enumerate(parts):
        if i + 2 < len(parts) and parts[i + 1] and parts[i + 2]:
            low = max(start, start + len(head) - _MOST_HEADER)
            for h in _HEADER.finditer(text, low, start + len(head)):
                found = _token(text[h.start() : start + len(head)], parts[i + 1], parts[i + 2])
                if found:
                    out.append((h.start(), found[0], found[1]))
                    break
        start += len(head) + 1
    return out


def _token(head: str, claims: str, signature: str) -> tuple[int, tuple[str, str, int]] | None:
    """(length, secret) of a token whose signature may be joined to what follows by '-' or '_'."""
    raw = from_base64(head)
    if not raw or raw[:1] != b"{":
        return None
    try:
        algorithm = json.loads(raw).get("alg")
    except (ValueError, RecursionError, AttributeError):
        return None
    least, most = _SIGNATURE.get(algorithm if isinstance(algorithm, str) else "", (1, 0))
    short, long = (least * 8 + 5) // 6, (most * 8 + 5) // 6
    ends = [len(signature), *(i for i in range(min(long, len(signature) - 1), short - 1, -1) if signature[i] in "-_")]
    for end in ends:
        if short <= end <= long:
            whole = f"{head}.{claims}.{signature[:end]}"
            found = confirm(whole)
            if found:
                return len(whole), found
    return None


def find_secrets(text: str | None) -> list[tuple[int, int, str, str, int]]:
    """(start, length, kind, detail, decoded bytes) of the secrets of a text, in order, not overlapping.

    Each kind of candidate is looked for on its own, in time proportional to the text; where two overlap
    the kind that comes first here stands."""
    if not text:
        return []
    out: list[tuple[int, int, str, str, int]] = []
    taken: list[tuple[int, int]] = []

    def free(start: int, end: int) -> bool:
        i = bisect.bisect_left(taken, (end,))
        return i == 0 or taken[i - 1][1] <= start

    def add(start: int, size: int, found: tuple[str, str, int] | None) -> None:
        if found and free(start, start + size):
            bisect.insort(taken, (start, start + size))
            out.append((start, size, *found))

    for m in _PEM.finditer(text):
        add(m.start(), m.end() - m.start(), confirm_pem(m.group("body")))
    for m in _DOTTED.finditer(text):
        if m.group().count(".") >= 2:
            for start, size, found in _tokens(text, m):
                add(start, size, found)
    for m in _FIXED.finditer(text):
        add(m.start(), m.end() - m.start(), confirm(m.group()))
    for m in _COLONS.finditer(text):
        digits = re.sub(r"[:\s]", "", m.group()).lower()
        found = confirm(digits) if len(digits) <= 2 * _MOST_KEY else None
        add(m.start(), m.end() - m.start(), found and (found[0], "colon hex", found[2]))
    for m in _RUN.finditer(text):
        run, seen = m.group(), False
        for key in _KEY.finditer(text, m.start(), m.end()):
            found = _key_at(text, key.start()) if free(key.start(), key.end()) else None
            if found:
                add(key.start(), *found)
                seen = True
        before = text[max(0, m.start() - 48) : m.start()]
        if seen or not free(m.start(), m.end()) or not _NAMED.search(before):
            continue
        # the value, or the last part of it that is one: an id may stand before it
        for start in (0, *(x.end() for x in re.finditer(r"[/_+-](?=[A-Za-z0-9])", run[-_MOST_OPAQUE:]))):
            start += max(0, len(run) - _MOST_OPAQUE) if start else 0
            found = opaque(run[start:]) if 16 <= len(run) - start <= _MOST_OPAQUE else None
            if found:
                add(m.start() + start, len(run) - start, ("named_secret", *found))
                break
    return sorted(out)


SCHEMA = "doc_id bigint, start bigint, length int, kind string, detail string, n_bytes int, fingerprint string"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row for each confirmed secret of each row of docs.

    `start` counts characters from 0; `fingerprint` is the start of the secret's SHA-256, so that the
    secret itself isn't copied on. NULL and empty texts have none; a repeated row gives its rows
    again; a NULL id is carried. An empty table gives none. Texts are read whole. Columns other than
    doc_id and text are ignored.
    """

    def run(batches):
        for batch in batches:
            for a, _, texts in text_steps(batch, "text"):
                ids = batch.column("doc_id")
                rows = [(ids[a + i].as_py(), *s, hashlib.sha256(t[s[0] : s[0] + s[1]].encode("utf-8", "surrogatepass")).hexdigest()[:16]) for i, t in enumerate(texts) for s in find_secrets(t)]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()]
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "kind", "detail", "n_bytes", "fingerprint"])

    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return rows.filter(F.col("text").rlike(PREFILTER)).mapInArrow(run, SCHEMA)


def redact(text: str) -> str:
    """The text with each confirmed secret replaced by [REDACTED:kind]."""
    out, at = [], 0
    for start, size, kind, _, _ in find_secrets(text):
        out += [text[at:start], f"[REDACTED:{kind}]"]
        at = start + size
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with every confirmed secret replaced; all rows stay, with all their columns.

    Where the text changes and there is a column n_chars, it becomes the new length. Rows whose text
    is NULL, empty or without a secret are unchanged.
    """
    at, counted = docs.columns.index("text"), "n_chars" in docs.columns

    def run(batches):
        for whole in batches:
            for a, b, texts in text_steps(whole, "text"):
                batch = whole.slice(a, b - a)
                new = [redact(t) if t else t for t in texts]
                batch = batch.set_column(at, "text", pa.array(new, batch.schema.field("text").type))
                if counted:
                    i = batch.schema.names.index("n_chars")
                    old = batch.column(i).to_pylist()
                    batch = batch.set_column(i, "n_chars", pa.array([len(y) if x != y else n for x, y, n in zip(texts, new, old, strict=True)], batch.schema.field(i).type))
                yield batch

    return docs.mapInArrow(run, docs.schema)
