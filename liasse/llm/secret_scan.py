"""Secrets in texts: patterns for the plain kinds, structure for the encoded ones.

A pattern finds assignments, access keys and long hex runs as they stand.  Whatever
looks like base64 or hex of something larger is decoded and read before it counts:

* ``pem`` -- a block between BEGIN and END lines of a private key whose body is a key;
* ``key`` -- a key in base64 or hex without such lines: a DER sequence, read by the
  grammars of RSA, DSA, EC, PKCS#8 (plain and encrypted) and PKCS#12, or the
  length-prefixed OpenSSH form.  All nested lengths have to add up, and the length the
  outermost one states says where the span ends, across line breaks;
* ``wrapped`` -- base64 whose bytes are a ``pem`` block (as configuration files hold them);
* ``token`` -- a signed token: its header is a JSON object with a known algorithm, its
  payload a JSON object, its signature as long as that algorithm makes it.

Public keys, certificates, unsigned tokens and random base64 are not reported.

Spans are in code points, ends exclusive, of the whole match.  A null text counts as
empty and has no spans.  Texts are searched whole, one by one, however long; repeated
rows are searched alike; an empty table gives no rows.  Other columns pass through; an
input that has a column of the output's name already is refused.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import refuse_clash, slices

PLAIN = ("assign", "access", "hex")
CONFIRMED = ("pem", "key", "wrapped", "token")
KINDS = PLAIN + CONFIRMED
SLICE = 4 << 20
SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]))

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# A run fails as a whole when it is short, so the least length may stand in these two patterns.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

# A DER sequence starts with 0x30, in base64 with M and one of these; OpenSSH keys and PEM blocks start with fixed words.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M[A-P]|b3BlbnNzaC1rZXktdjE|LS0tLS1CRUdJTi)[A-Za-z0-9+/_-]{14}")
HEX_CANDIDATE = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{44,}|(?<![0-9A-Fa-f])6f70656e7373682d6b65792d7631[0-9A-Fa-f]{30,}")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----(.*?)-----END \1-----", re.S)
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[yw][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{16,})(?![A-Za-z0-9_-])")
BREAK = re.compile(r"(?:\r?\n|\\r\\n|\\n)[\x20\t]*")
CHARS = re.compile(r"[A-Za-z0-9+/_-]+")
LEGACY = re.compile(r"\s*Proc-Type: 4,ENCRYPTED\s+DEK-Info: ([A-Z0-9-]+),([0-9A-Fa-f]{16,})\s+(.*)", re.S)

# Bytes of a signature by algorithm; RSA's are those of the modulus, from 1024 bits on.
SIGNATURES = {"HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES256K": (64,), "ES384": (96,), "ES512": (132,), "EdDSA": (64, 114)}
RSA_SIGNED = ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512")

INTEGER, BITS, OCTETS, NULL, OID, SEQUENCE = 0x02, 0x03, 0x04, 0x05, 0x06, 0x30
RSA_OID, EC_OID = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201")
PKCS5, PKCS12, PKCS7_DATA = (bytes.fromhex(x) for x in ("2a864886f70d0105", "2a864886f70d010c", "2a864886f70d0107"))
EDWARDS = {bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57, bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56}


class Broken(ValueError):
    """Bytes that do not follow their encoding."""


def element(data: bytes, at: int, end: int) -> tuple[int, int, int]:
    """Tag, start and end of the content of the DER element that starts at ``at`` and ends by ``end``."""
    if at + 2 > end:
        raise Broken
    tag, size, start = data[at], data[at + 1], at + 2
    if size & 0x80:
        more = size & 0x7F
        if not 1 <= more <= 4 or start + more > end:
            raise Broken
        size, start = int.from_bytes(data[start:start + more], "big"), start + more
        if size < 0x80 or size >> 8 * (more - 1) == 0:
            raise Broken  # not the shortest form
    if start + size > end:
        raise Broken
    return tag, start, start + size


def elements(data: bytes, at: int, end: int) -> list[tuple[int, bytes]]:
    """The elements that fill ``at`` to ``end`` without a rest."""
    out = []
    while at < end:
        tag, start, at = element(data, at, end)
        out.append((tag, data[start:at]))
    return out


def sequence(data: bytes) -> list[tuple[int, bytes]]:
    tag, start, end = element(data, 0, len(data))
    if tag != SEQUENCE or end != len(data):
        raise Broken
    return elements(data, start, end)


def _whole_number(value: bytes) -> bool:
    """A positive integer in its shortest form."""
    return bool(value) and value[0] < 0x80 and (len(value) == 1 or value[0] > 0 or value[1] >= 0x80)


def is_key(data: bytes) -> bool:
    """Whether these bytes are, from the first to the last, the encoding of a private key."""
    try:
        return _openssh(data) if data.startswith(b"openssh-key-v1\0") else _der_key(data)
    except Broken:
        return False


def _der_key(data: bytes) -> bool:
    parts = sequence(data)
    tags = [t for t, _ in parts]
    first = parts[0][1] if parts else b""
    if tags[:1] == [INTEGER] and first == b"\3" and tags[1:2] == [SEQUENCE]:  # PKCS#12: a version and data that is authenticated
        inner = elements(parts[1][1], 0, len(parts[1][1]))
        return bool(inner) and inner[0][0] == OID and inner[0][1].startswith(PKCS7_DATA)
    if tags == [SEQUENCE, OCTETS]:  # encrypted PKCS#8
        how = elements(parts[0][1], 0, len(parts[0][1]))
        return len(how) == 2 and how[0][0] == OID and how[0][1].startswith((PKCS5, PKCS12)) and how[1][0] == SEQUENCE and len(parts[1][1]) >= 8
    if tags[:1] != [INTEGER] or first not in (b"\0", b"\1"):
        return False
    if tags[1:3] == [SEQUENCE, OCTETS] and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]):  # PKCS#8
        how = elements(parts[1][1], 0, len(parts[1][1]))
        return bool(how) and how[0][0] == OID and len(how) <= 2 and _inner_key(how[0][1], parts[2][1])
    if all(t == INTEGER for t in tags[:9]) and len(tags) in (6, 9, 10):  # RSA, with more primes or not, and DSA
        numbers = [v for t, v in parts[1:9] if t == INTEGER]
        many = len(tags) == 10
        return all(map(_whole_number, numbers)) and len(numbers[0]) >= 32 and many == (first == b"\1") and (not many or tags[9] == SEQUENCE)
    if first == b"\1" and tags[1:2] == [OCTETS] and all(t in (0xA0, 0xA1) for t in tags[2:]):  # EC
        return 16 <= len(parts[1][1]) <= 72 and all(_tagged(t, v) for t, v in parts[2:])
    return False


def _tagged(tag: int, value: bytes) -> bool:
    inner = elements(value, 0, len(value))
    return len(inner) == 1 and inner[0][0] in ((OID, SEQUENCE) if tag == 0xA0 else (BITS,))


def _inner_key(algorithm: bytes, data: bytes) -> bool:
    if algorithm in (RSA_OID, EC_OID):
        return _der_key(data)
    if algorithm in EDWARDS:
        tag, start, end = element(data, 0, len(data))
        return tag == OCTETS and end == len(data) and end - start == EDWARDS[algorithm]
    return len(data) >= 16


def _openssh(data: bytes) -> bool:
    at = 15

    def field() -> bytes:
        nonlocal at
        size = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + size > len(data):
            raise Broken
        at += 4 + size
        return data[at - size:at]

    cipher, kdf, options = field(), field(), field()
    keys = int.from_bytes(data[at:at + 4], "big")
    at += 4
    if not re.fullmatch(rb"[a-z0-9@.-]{3,40}", cipher) or kdf not in (b"none", b"bcrypt") or (kdf == b"none") != (not options) or not 1 <= keys <= 16:
        return False
    for _ in range(keys):
        public = field()
        size = int.from_bytes(public[:4], "big")
        if not re.fullmatch(rb"[a-z0-9@.-]+", public[4:4 + size]):
            return False
    private = field()
    return at == len(data) and len(private) % 8 == 0 and (kdf != b"none" or private[:4] == private[4:8])


def decoded(letters: str) -> bytes | None:
    """The bytes of base64 in either alphabet, without its padding; None where it is none."""
    if len(letters) % 4 == 1:
        return None
    try:
        return base64.b64decode(letters.translate({45: 43, 95: 47}) + "=" * (-len(letters) % 4), validate=True)
    except binascii.Error:
        return None


def _base64_run(text: str, at: int) -> Iterator[tuple[str, int, int]]:
    """The pieces of base64 from ``at`` on, across line breaks: letters, start and end."""
    while m := CHARS.match(text, at):
        yield m.group(), m.start(), m.end()
        gap = BREAK.match(text, m.end())
        if gap is None:
            return
        at = gap.end()


def _read(text: str, at: int, wanted: int | None) -> tuple[str, int]:
    """``wanted`` letters of base64 from ``at`` on (None: those of one line), and the end of them with their padding."""
    parts, got, end = [], 0, at
    for letters, start, stop in _base64_run(text, at):
        take = len(letters) if wanted is None else min(len(letters), wanted - got)
        parts.append(letters[:take])
        got, end = got + take, start + take
        if wanted is None or got == wanted:
            break
    padding = 0
    while padding < -got % 4 and text[end:end + 1] == "=":
        padding, end = padding + 1, end + 1
    return "".join(parts), end


def _outer_length(head: bytes) -> int | None:
    """Bytes of the DER element that starts so."""
    size = head[1]
    if not size & 0x80:
        return 2 + size
    more = size & 0x7F
    return 2 + more + int.from_bytes(head[2:2 + more], "big") if 1 <= more <= 4 else None


def _from_base64(text: str, at: int) -> tuple[str, int] | None:
    """Kind and end of the secret whose base64 starts at ``at``."""
    if text[at] == "M":
        size = _outer_length(decoded(text[at:at + 8]) or b"\0\0")
        if size is None or size < 24 or size > len(text) - at:
            return None
        letters, end = _read(text, at, -(-size * 4 // 3))
        data = decoded(letters)
        return ("key", end) if data is not None and len(data) == size and not CHARS.match(text, end) and is_key(data) else None
    letters, end = _read(text, at, len(text))
    found = _longest(letters, text, at)
    if found is None:
        letters, end = _read(text, at, None)
        found = _longest(letters, text, at)
    if found is None:
        return None
    return found, end


def _longest(letters: str, text: str, at: int) -> str | None:
    data = decoded(letters)
    if data is None:
        return None
    if data.startswith(b"openssh"):
        return "key" if is_key(data) else None
    inside = data.decode("latin-1")
    m = PEM.match(inside)
    return "wrapped" if m and is_pem(m.group(2)) and not inside[m.end():].strip() else None


def is_pem(body: str) -> bool:
    """Whether what stands between the BEGIN and END lines is a private key."""
    body = body.replace("\\r", "").replace("\\n", "\n")
    legacy = LEGACY.fullmatch(body)
    letters = re.sub(r"\s+", "", legacy.group(3) if legacy else body)
    data = decoded(letters.rstrip("=")) if len(letters) - len(letters.rstrip("=")) <= 2 else None
    if data is None:
        return False
    return len(data) >= 64 and len(data) % 8 == 0 if legacy else is_key(data)


def _json(letters: str) -> dict | None:
    data = decoded(letters)
    try:
        out = json.loads(data) if data is not None else None
    except (ValueError, RecursionError):
        return None
    return out if isinstance(out, dict) else None


def is_token(header: str, payload: str, signature: str) -> bool:
    head = _json(header)
    if head is None or not isinstance(head.get("alg"), str) or _json(payload) is None:
        return False
    signed = decoded(signature)
    if signed is None:
        return False
    if head["alg"] in RSA_SIGNED:
        return len(signed) >= 128
    return len(signed) in SIGNATURES.get(head["alg"], ())


def find(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of all secrets of a text, by start, then kind."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    blocks = [(m.start(), m.end()) for m in PEM.finditer(text) if is_pem(m.group(2))] if "-----BEGIN " in text else []
    out += [("pem", *b) for b in blocks]
    at = 0
    while m := CANDIDATE.search(text, at):
        at = m.start() + 1
        block = next((e for s, e in blocks if s <= m.start() < e), None)
        found = None if block else _from_base64(text, m.start())
        if block:
            at = block
        elif found:
            out.append((found[0], m.start(), found[1]))
            at = found[1]
    for m in HEX_CANDIDATE.finditer(text):
        if len(m.group()) % 2 == 0 and is_key(bytes.fromhex(m.group())):
            out.append(("key", m.start(), m.end()))
    out += [("token", m.start(), m.end()) for m in TOKEN.finditer(text) if is_token(*m.groups())]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def secret_spans(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``df`` with an array of ``(kind, start, end)``."""
    refuse_clash(df, spans)
    at = df.columns.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at, SLICE):
                found = [[dict(zip(("kind", "start", "end"), s)) for s in find(t.as_py() or "")] for t in batch.column(at)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, spans])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(spans, SPANS)]))


def masked(df: DataFrame, text: str = "text", spans: str = "spans", mask: str = "█") -> DataFrame:
    """``df`` from ``secret_spans`` with each span of ``text`` replaced by one mask character; overlapping spans become one."""
    ends = F.aggregate(F.col(spans), F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), lambda state, s: F.struct(
        F.when(s["end"] <= state["at"], state["out"]).when(s["start"] < state["at"], state["out"]).otherwise(
            F.concat(state["out"], F.substring(F.col(text), (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit(mask))).alias("out"),
        F.greatest(state["at"], s["end"]).alias("at")))
    rest = F.expr(f"substring(`{text}`, cast(__m.at + 1 as int))")
    return df.withColumn("__m", ends).withColumn(text, F.concat(F.col("__m")["out"], rest)).drop("__m")


def digest(spans: Column) -> Column:
    """``kind:start:end`` of these spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, how many spans of each plain kind, a digest of these, all spans as text, and how many are confirmed by structure."""
    found = secret_spans(df.select(key, text), text, "found").select(key, "found")
    plain = F.filter("found", lambda s: s["kind"].isin(*PLAIN))
    many = [F.expr(f"cast(size(filter(found, s -> s.kind = '{k}')) as long) AS n_{k}") for k in PLAIN]
    return found.select(key, *many, F.sha2(digest(plain), 256).alias("base_sha256"), digest(F.col("found")).alias("spans"),
                        F.size(F.filter("found", lambda s: ~s["kind"].isin(*PLAIN))).cast("long").alias("n_confirmed"))
