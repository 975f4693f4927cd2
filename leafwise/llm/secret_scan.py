"""Operator 4, secret scans by structural confirmation.

Three plain patterns report assignments, access keys and hex strings.  On top of these, every maximal base64
or hex run over a small length, alone and together with the runs of the lines around it, is decoded and reported only if their bytes parse as what they claim to be: a private key in DER
(nested lengths must fill the outer length exactly), an OpenSSH key container (every counted string must lie
inside the blob), or a signed token (JSON header with a known algorithm, decodable claims, signature of the
length that the algorithm makes).  An encrypted PEM key of the traditional form is ciphertext, so its Proc-Type
and DEK-Info headers confirm it.  PEM blocks and text encoded a second time are unwrapped first.

Defined results: null text counts as empty and yields no span; spans are code points, end exclusive, and may
overlap across kinds; repeated rows are scanned one by one; an empty table gives an empty result; columns of
the input other than doc_id and text are not read by the scan, and ``redact`` keeps them.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwise.llm.common import documents, map_columns

KINDS = ["assign", "access", "hex", "key", "token"]
BASE = KINDS[:3]
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")          # runs are maximal, so this is `[0-9a-f]+` of 32 or more
#: The body may be a JSON or source string: escaped line breaks and slashes, quotes and joins between lines.
PEM_BEGIN = re.compile(r"(?=(-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----))")
PEM_END = re.compile(r"(?=(-----END [A-Z0-9 ]*PRIVATE KEY-----))")
PEM_LAST_FOREIGN = re.compile(r"(?s:.*)[^A-Za-z0-9+/=\s:,\\\"'-]")          # up to the last character that no body holds
PEM_BREAK = re.compile(r"""(?:(?<!\\)\\+(?:u000[aAdD]|[rn])|[\r\n])+""")
PEM_JOIN = re.compile(r"""["'][\x20\t]*(?:\+[\x20\t]*)?$|^[\x20\t]*(?:\+[\x20\t]*)?["']|[\s"'\\]""")
ENCRYPTED = re.compile(r"^(?:[^\S\n]|[\"'+])*Proc-Type:\s*4,\s*ENCRYPTED\b", re.M)
DEK = re.compile(r"^(?:[^\S\n]|[\"'+])*DEK-Info:\s*[A-Z0-9-]+,\s*(?:[0-9A-Fa-f]{16}){1,2}\b", re.M)
#: Runs are maximal; the letter of an escaped line break and `0x` before them are no part of them.
BLOB = re.compile(r"(?<![A-Za-z0-9+/_-])(?:(?<=\\)[nrt])?([A-Za-z0-9+/_-]{22,}={0,2})")
BLOB_END = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
PLAIN64 = re.compile(r"[A-Za-z0-9+/]{22,}={0,2}")
HEXBLOB = re.compile(r"(?:(?<![0-9A-Za-z])|(?<=0[xX])|(?<=\\[nrt]))((?:[0-9a-fA-F]{2}){16,})(?![0-9A-Za-z])")
HEX_END = re.compile(r"(?:[0-9a-fA-F]{2})+(?![0-9A-Za-z])")
BREAK = re.compile(r"""["']?[\x20\t]*\+?[\x20\t]*(?:\\+[rn]|["'+\s]){1,40}""")     # between two lines, also of a source string
TOKEN = re.compile(r"(?:(?<![A-Za-z0-9_.-])|(?<=\\[nrt]))(ey[A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
#: Signature bytes by algorithm (JSON Web Algorithms); None: any length from 128 (RSA moduli).
SIGNATURE_BYTES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "ES256K": 64,
                   "EdDSA": 64, "RS256": None, "RS384": None, "RS512": None, "PS256": None, "PS384": None, "PS512": None}
SPAN = "array<struct<kind:string,start:int,end:int>>"


def unbase64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def read_element(data: bytes, at: int, end: int):
    """(tag, content start, content end) of the DER element at ``at``, or None if it does not fit."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size, at = int.from_bytes(data[at:at + n], "big"), at + n
    return (tag, at, at + size) if at + size <= end else None


def children(data: bytes, start: int, end: int):
    """Elements that fill start..end exactly, or None."""
    found = []
    while start < end:
        e = read_element(data, start, end)
        if e is None:
            return None
        found.append(e)
        start = e[2]
    return found


def is_private_der(data: bytes) -> bool:
    """PKCS 1, DSA, PKCS 8 (also encrypted) or SEC 1 private key whose nested lengths agree."""
    outer = read_element(data, 0, len(data))
    if outer is None or outer[0] != 0x30 or outer[2] != len(data):
        return False
    parts = children(data, outer[1], outer[2])
    if not parts or len(parts) < 2:
        return False
    tags = [t for t, _, _ in parts]
    first = data[parts[0][1]:parts[0][2]]
    if tags[0] == 0x02 and first in (b"\x00", b"\x01"):
        if len(tags) >= 9 and all(t == 0x02 for t in tags[:9]):
            return True                                                    # PKCS 1: version and eight integers
        if len(tags) == 6 and first == b"\x00" and all(t == 0x02 for t in tags):
            return True                                                    # DSA: version and five integers
        if tags[1] == 0x04 and first == b"\x01":
            return parts[1][2] - parts[1][1] in (28, 32, 48, 66)           # SEC 1: version and scalar
        if len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:
            inner = children(data, parts[1][1], parts[1][2])
            return bool(inner) and inner[0][0] == 0x06                     # PKCS 8: algorithm with identifier
        return False
    if tags == [0x30, 0x04]:
        inner = children(data, parts[0][1], parts[0][2])                   # encrypted PKCS 8 (PBES under PKCS 5 / 12)
        return bool(inner) and inner[0][0] == 0x06 and data[inner[0][1]:inner[0][2]].startswith(b"\x2a\x86\x48\x86\xf7\x0d\x01")
    return False


def is_openssh(data: bytes) -> bool:
    magic = b"openssh-key-v1\x00"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def counted():
        nonlocal at
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at:at + 4], "big")
        at += 4
        if at + n > len(data):
            return None
        at += n
        return data[at - n:at]

    head = [counted(), counted(), counted()]
    if None in head or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at:at + 4], "big")
    at += 4
    return 1 <= keys <= 16 and all(counted() is not None for _ in range(keys)) and bool(counted())


def is_token(header: str, claims: str, signature: str) -> bool:
    raw, body, sign = unbase64(header), unbase64(claims), unbase64(signature) if signature else b""
    if raw is None or body is None or sign is None:
        return False
    try:
        head = json.loads(raw)
        said = json.loads(body)
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(said, dict) or head.get("alg") not in SIGNATURE_BYTES:
        return False
    need = SIGNATURE_BYTES[head["alg"]]
    return len(sign) >= 128 if need is None else len(sign) == need


def kind_of_bytes(data: bytes | None, depth: int) -> str | None:
    """What decoded bytes are; printable bytes are scanned once more, to ``depth`` encodings."""
    if not data:
        return None
    if is_private_der(data) or is_openssh(data):
        return "key"
    if depth > 0 and data[:1].isascii():
        try:
            inner = data.decode("ascii")
        except UnicodeDecodeError:
            return None
        return next((k for k, _, _ in structures(inner, depth - 1)), None)
    return None


def unhex(text: str) -> bytes | None:
    return bytes.fromhex(text) if len(text) % 2 == 0 else None


def blocks(text: str, runs: list[tuple[int, int]], last: re.Pattern):
    """Runs of one width that only line breaks divide, as lists of spans; and the shorter run on the line after
    them, or None."""
    at = 0
    while at < len(runs):
        to = at + 1
        width = runs[at][1] - runs[at][0]
        while (to < len(runs) and runs[to][1] - runs[to][0] == width and runs[to][0] - runs[to - 1][1] <= 50
               and BREAK.fullmatch(text, runs[to - 1][1], runs[to][0])):
            to += 1
        tail = None
        if gap := BREAK.match(text, runs[to - 1][1]):
            m = last.match(text, gap.end())
            tail = m.span() if m and m.end() - m.start() <= width else None
        yield runs[at:to], tail
        at = to


def outside(runs: list[tuple[int, int]], covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs that lie in no covered span, by one search each: the furthest end of all spans that begin before."""
    spans = sorted(covered)
    starts = [a for a, _ in spans]
    ends = list(accumulate((b for _, b in spans), max))
    return [r for r in runs if not (i := bisect_right(starts, r[0])) or ends[i - 1] < r[1]]


def confirmed(text: str, pattern: re.Pattern, last: re.Pattern, decode, depth: int, covered: list):
    """(kind, start, end) of the runs that decode to something known: whole blocks of lines first, then run by run."""
    runs = outside([m.span(1) for m in pattern.finditer(text)], covered)
    for lines, tail in blocks(text, runs, last):
        whole = None
        for some in ([*lines, tail] if tail else [], lines if len(lines) > 1 else []):
            if some and (kind := kind_of_bytes(decode("".join(text[a:b] for a, b in some)), depth)):
                whole = (kind, some[0][0], some[-1][1])
                break
        if whole and not (len(lines) == 1 and kind_of_bytes(decode(text[slice(*lines[0])]), depth)):
            yield whole
            continue
        for a, b in lines:
            if kind := kind_of_bytes(decode(text[a:b]), depth):
                yield kind, a, b
            elif decode is unbase64 and ("-" in text[a:b] or "_" in text[a:b]):    # a name joined to a blob
                for m in PLAIN64.finditer(text, a, b):
                    if kind := kind_of_bytes(decode(m[0]), depth):
                        yield kind, m.start(), m.end()


def is_private_pem(body: str) -> bool:
    """What stands between the marks: a private key, or ciphertext under the headers of an encrypted one."""
    rows = PEM_BREAK.sub("\n", body)
    joined_rows = "".join(PEM_JOIN.sub("", x) for x in rows.split("\n") if ":" not in x)
    data = unbase64(joined_rows)
    return bool(data) and (kind_of_bytes(data, 0) is not None or bool(ENCRYPTED.search(rows) and DEK.search(rows)))


def armoured(text: str):
    """(start, end, body) of the armours: an end mark closes the first beginning since the armour before it that has
    nothing but body characters between.  Marks are found once and joined in order, so time is linear in the text."""
    begins = [m.span(1) for m in PEM_BEGIN.finditer(text)]
    at, free, seen, clean = 0, 0, 0, 0
    for m in PEM_END.finditer(text) if begins else ():
        a, b = m.span(1)
        if a < free:
            continue
        if foreign := PEM_LAST_FOREIGN.match(text, seen, a):
            clean = foreign.end()
        seen = a
        while at < len(begins) and (begins[at][0] < free or begins[at][1] < clean):
            at += 1
        if at < len(begins) and begins[at][1] <= a:
            yield begins[at][0], b, text[begins[at][1]:a]
            free = b


def structures(text: str, depth: int = 2) -> list[tuple[str, int, int]]:
    """Confirmed (kind, start, end), each candidate once, PEM blocks before what lies inside them."""
    found, covered = [], []
    if "PRIVATE KEY" in text:
        for a, b, body in armoured(text):
            if is_private_pem(body):
                found.append(("key", a, b))
                covered.append((a, b))
    if "ey" in text and "." in text:
        for m in TOKEN.finditer(text):
            if is_token(*m.groups()):
                found.append(("token", m.start(), m.end()))
                covered.append(m.span())
    for pattern, last, decode in ((BLOB, BLOB_END, unbase64), (HEXBLOB, HEX_END, unhex)):
        more = list(confirmed(text, pattern, last, decode, depth, covered))
        found += more
        covered += [(a, b) for _, a, b in more]
    return found


def scan_text(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind as listed."""
    if not text:
        return []
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    found += structures(text)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """Columns doc_id and spans (array of kind, start, end) for every row."""
    def start():
        def step(ids, texts):
            return {"doc_id": ids, "spans": [[{"kind": k, "start": a, "end": b} for k, a, b in scan_text(t)] for t in texts]}
        return step
    return map_columns(docs, ["doc_id", "text"], f"doc_id long, spans {SPAN}", start)


def redact_text(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with every span (joined where they overlap) replaced by ``<kind>``, kind of the first."""
    if not spans:
        return text
    out, at = [], 0
    joined: list[list] = []
    for k, a, b in spans:
        if joined and a < joined[-1][2]:
            joined[-1][2] = max(b, joined[-1][2])
        else:
            joined.append([k, a, b])
    for k, a, b in joined:
        out += [text[at:a], f"<{k}>"]
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """The table of documents (doc_id, text, lang, source, n_chars) with secrets replaced in every text."""
    def start():
        def step(ids, texts, langs, sources):
            new = [redact_text(t, scan_text(t)) for t in texts]
            return {"doc_id": ids, "text": new, "lang": langs, "source": sources,
                    "n_chars": [None if t is None else len(t) for t in new]}
        return step
    return map_columns(docs, ["doc_id", "text", "lang", "source"],
                       "doc_id long, text string, lang string, source string, n_chars long", start)


def joined(spans):
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir, "doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == F.lit(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


Q = {"op4_secret_scan": op4_secret_scan}
SQL: dict[str, str] = {}
