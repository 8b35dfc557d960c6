"""Secret scans with structural confirmation.

Three base kinds come from their patterns alone. Beyond them, runs that look like base64 or hex are
decoded, and reported only if what they hold parses: a DER key (SEQUENCE with consistent nested
lengths and integers), an SSH key (length-prefixed fields), or a signed token whose header is JSON
with an algorithm. Armoured private keys are reported if their body decodes to such a key.

Defined results: a null or empty text has no spans; spans are in code points, end exclusive; equal
rows give equal rows. Spans of different kinds may overlap; those of one kind never do.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table_of, whole_text

#: Kinds in the order in which spans with the same start are listed (fixed values).
KINDS = ("assign", "access", "hex", "der", "ssh", "token", "armour")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
WORDS = ("pass", "secret", "token", "api")
ENCODED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_ANY = re.compile(r"(?:[0-9a-f]{2}){20,}|(?:[0-9A-F]{2}){20,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])ey[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
ARMOUR = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
#: Runs over line ends, real or written as backslash and letter, and what DER and SSH keys start with in them.
BREAK = re.compile(r"(?:\\r|\\n|\r|\n[ \t]*)+")
WRAPPED = re.compile(rf"[A-Za-z0-9+/_-]+(?:{BREAK.pattern}[A-Za-z0-9+/_-]+)*")
START = re.compile(r"M[A-I]|AAAA|b3BlbnNzaC1rZXktdjE")
#: Texts without such a run hold nothing to decode.
LONG_RUN = re.compile(r"[A-Za-z0-9+/_-]{40}")


def der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """(length, where the value starts) of the DER length at `at`; None if it isn't minimal or runs over."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 0x80:
        return first, at + 1
    n = first & 0x7F
    if not 1 <= n <= 4 or at + 1 + n > len(data):
        return None
    length = int.from_bytes(data[at + 1:at + 1 + n], "big")
    if length < 0x80 or data[at + 1] == 0:
        return None
    return length, at + 1 + n


def der_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill [start, end) exactly, or None."""
    out = []
    while start < end:
        tag, found = data[start], der_length(data, start + 1)
        if found is None or found[1] + found[0] > end:
            return None
        out.append((tag, found[1], found[1] + found[0]))
        start = found[1] + found[0]
    return out


def is_der_key(data: bytes) -> bool:
    """RSA, EC or PKCS#8 private keys and public key infos: nested lengths that close, integers or an OID where due."""
    outer = der_length(data, 1) if data[:1] == b"\x30" else None
    if outer is None or outer[0] < 16 or outer[1] + outer[0] > len(data) or len(data) - outer[1] - outer[0] > 2:
        return False
    items = der_items(data, outer[1], outer[1] + outer[0])
    if not items or len(items) < 2:
        return False
    tags = [t for t, _, _ in items]

    def algorithm(item) -> bool:
        inner = der_items(data, item[1], item[2])
        return bool(inner) and inner[0][0] == 0x06

    if all(t == 0x02 for t in tags):  # RSA or DSA key: integers only
        return len(tags) in (2, 6, 9) and max(e - s for _, s, e in items) >= 16
    if tags[0] == 0x02 and items[0][2] - items[0][1] == 1 and len(tags) >= 2:
        if tags[1] == 0x30 and len(tags) >= 3 and tags[2] == 0x04:
            return algorithm(items[1])
        return tags[1] == 0x04 and items[1][2] - items[1][1] >= 16
    if tags == [0x30, 0x04]:  # encrypted PKCS#8
        return items[1][2] - items[1][1] >= 16 and algorithm(items[0])
    return tags[:2] == [0x30, 0x03] and algorithm(items[0])


def is_ssh_key(data: bytes) -> bool:
    """A key blob of length-prefixed fields that fill it, or the private container with its magic."""
    if data.startswith(b"openssh-key-v1\0"):
        at, fields = 15, 0
        while fields < 3:
            if at + 4 > len(data):
                return False
            at += 4 + int.from_bytes(data[at:at + 4], "big")
            fields += 1
        return at + 4 <= len(data)
    at, fields = 0, []
    while at < len(data):
        if at + 4 > len(data):
            return False
        n = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + n > len(data):
            return False
        fields.append(data[at + 4:at + 4 + n])
        at += 4 + n
    return len(fields) >= 2 and re.fullmatch(rb"(ssh-(rsa|dss|ed25519)|ecdsa-sha2-nistp\d+|sk-[a-z0-9@.-]+)", fields[0]) is not None


def decoded(run: str) -> bytes | None:
    """The bytes of a base64 run, either alphabet, padding optional."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def key_length(data: bytes) -> tuple[str, int] | None:
    """(kind, bytes) of the key that data begins with, whatever follows it."""
    if data[:1] == b"\x30":
        outer = der_length(data, 1)
        end = outer[0] + outer[1] if outer else 0
        return ("der", end) if 0 < end <= len(data) and is_der_key(data[:end]) else None
    if data.startswith(b"openssh-key-v1\0"):
        return ("ssh", len(data)) if is_ssh_key(data) else None
    at, found = 0, None
    while at + 4 <= len(data) and at + 4 + (n := int.from_bytes(data[at:at + 4], "big")) <= len(data):
        at += 4 + n
        if is_ssh_key(data[:at]):
            found = at
        elif found or at == 4 + n and not re.match(rb"ssh-|ecdsa-|sk-", data[4:12]):
            break
    return ("ssh", found) if found else None


def keys_inside(text: str) -> Iterator[tuple[str, int, int]]:
    """Keys that begin anywhere in a run, or go on over line ends."""
    for m in WRAPPED.finditer(text):
        if m.end() - m.start() < 40:
            continue
        places, at = [], m.start()
        for b in [*BREAK.finditer(text, m.start(), m.end()), None]:
            places += range(at, b.start() if b else m.end())
            at = b.end() if b else at
        run, done = "".join([text[i] for i in places]), 0
        for s in START.finditer(run):
            if s.start() < done:
                continue
            head = decoded(run[s.start():s.start() + 12])
            if not head or head[0] == 0x30 and ((size := der_length(head, 1)) is None or size[0] + size[1] > (len(run) - s.start()) * 3 // 4):
                continue
            if head[0] == 0 and not re.match(rb"ssh-|ecds|sk-", head[4:8]):
                continue
            need = -(-(size[0] + size[1]) // 3) * 4 if head[0] == 0x30 else len(run)
            rest = run[s.start():s.start() + need]
            data = decoded(rest[:len(rest) - (len(rest) % 4 == 1)])
            if data and (found := key_length(data)):
                done = s.start() + -(-found[1] * 4 // 3)
                yield found[0], places[s.start()], places[min(done, len(run)) - 1] + 1


def token_header(run: str) -> bool:
    """Whether the first part of a dotted run is a JSON object that names an algorithm, and the second decodes."""
    head, body, sign = run.split(".")
    found = decoded(head)
    if found is None or decoded(body) is None or (sign and decoded(sign) is None):
        return False
    try:
        header = json.loads(found)
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """All spans of one text by start, then kind as listed, then end."""
    out: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if "ey" in text and text.count(".") > 1:
        out += [("token", m.start(), m.end()) for m in TOKEN.finditer(text) if token_header(m[0])]
    if "-----BEGIN" in text:
        for m in ARMOUR.finditer(text):
            data = decoded("".join(m[2].split()))
            if data and (is_der_key(data) or is_ssh_key(data)):
                out.append(("armour", m.start(), m.end()))
    if LONG_RUN.search(text):
        for m in ENCODED.finditer(text):
            data = decoded(m[0])
            if data and (kind := "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None):
                out.append((kind, m.start(), m.end()))
        for m in HEX_ANY.finditer(text):
            data = bytes.fromhex(m[0])
            if kind := "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None:
                out.append((kind, m.start(), m.end()))
        taken = [s for s in out if s[0] in ("der", "ssh", "armour")]
        out += [s for s in keys_inside(text) if not any(a < s[2] and s[1] < b for _, a, b in taken)]
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(out), key=lambda x: (x[1], rank[x[0]], x[2]))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document with its spans; a map over the scan, no shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            for start, texts in slices(batch):
                counts, sums, listed, confirmed = [[], [], []], [], [], []
                for text in texts:
                    spans = spans_of(text)
                    base = [s for s in spans if s[0] in KINDS[:3]]
                    for k in range(3):
                        counts[k].append(sum(s[0] == KINDS[k] for s in base))
                    sums.append(hashlib.sha256(",".join("%s:%d:%d" % s for s in base).encode()).hexdigest())
                    listed.append(",".join("%s:%d:%d" % s for s in spans))
                    confirmed.append(len(spans) - len(base))
                columns = [batch.column(0).slice(start, len(texts)), *(pa.array(c, pa.int64()) for c in counts), pa.array(sums), pa.array(listed), pa.array(confirmed, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(scan, SCHEMA)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    return scan_secrets(table_of(spark, sf_dir, "documents"))
