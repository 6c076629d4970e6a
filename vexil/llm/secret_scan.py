"""Secret scans with structural confirmation.

Candidates are long runs of base64 or hex characters and words that start like known tokens. A candidate is reported
only if, decoded, it has the structure it claims:

- private_key_der: base64 or hex of a DER SEQUENCE whose nested lengths add up to its end and which reads as a PKCS#1,
  SEC1 or DSA private key, or as a PKCS#8 one whose inner key is one of those, an octet string or, with parameters, an
  integer, or as an encrypted PKCS#8 one, whose algorithm is one of password-based encryption (bare, assigned to a name,
  or in PEM armour, which may wrap it over lines)
- private_key_openssh: the same of data that starts with the OpenSSH magic and whose length-prefixed fields fit
- signed_token: three base64url parts; the header and the claims are JSON objects, the header names an algorithm and, but
  for "none", the signature has the length that algorithm gives
- checksum_token: a prefixed token of 36 base62 characters of which the last 6 are the CRC-32 of the others
- access_key_id: a 20-character key id whose base32 part decodes to ten bytes with an account number that isn't zero
- assigned_key: hex or base64 that is assigned to a name that says key, token, secret or password, decodes to a usual key
  size and has as many different bytes as random ones would have

Only the place, the kind and the decoded size are reported, never the secret. Texts without any long run are passed over
on the JVM by one regular expression, before Python sees them. Defined results: a null text counts as empty; repeated
rows are each reported; of overlapping finds the first stands; other columns are ignored. Texts of any length are read
whole, in time in proportion to their length, whatever runs they hold; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What every secret has: armour, or a run of at least 19 of these (the shortest header of a signed token).
PREFILTER = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{19,}+|-----BEGIN "
ARMOUR = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s\\]+?)-----END \1-----")
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
CHECKED = re.compile(r"(?<![A-Za-z0-9_])(gh[pousr]_)([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
KEY_ID = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)([A-Z2-7]{16})(?![A-Za-z0-9])")
#: A name is read once, from its first character and without going back, so that long runs of any characters take time in proportion.
ASSIGNED = re.compile(r"(?i)(?<![a-z0-9_.-])(?=[a-z0-9_.-]*?(?:key|token|secret|passw(?:or)?d|credential))[a-z0-9_.-]++[\"']?\s*+(?:=>|[:=])\s*+[\"']?([A-Za-z0-9+/_=-]{20,}+)")
BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/]{80,}={0,2}(?![A-Za-z0-9+/_=-])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Object identifiers of PKCS#5 and PKCS#12 encryption, without their last number.
PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
KEY_SIZES = {16, 20, 24, 28, 30, 32, 40, 48, 64}
SIGNATURE = {"HS256": {32}, "HS384": {48}, "HS512": {64}, "ES256": {64}, "ES384": {96}, "ES512": {132}, "EdDSA": {64, 114}}


def decode_base64(text: str) -> bytes | None:
    """Either alphabet, padding optional; None if the characters don't decode to whole bytes."""
    body = text.rstrip("=")
    if len(body) % 4 == 1 or len(text) - len(body) > 2 or ("+" in body or "/" in body) and ("-" in body or "_" in body):
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def decode_hex(text: str) -> bytes | None:
    """Digits of either case, 0x in front optional; None if they aren't whole bytes."""
    m = re.fullmatch(r"(?:0[xX])?((?:[0-9A-Fa-f]{2})+)", text)
    return bytes.fromhex(m[1]) if m else None


def der_elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of DER elements that fill data exactly; None if a length doesn't fit or isn't minimal."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length = data[at], data[at + 1]
        at += 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            length = int.from_bytes(data[at : at + n], "big")
            if length < 0x80 or length >> 8 * (n - 1) == 0:
                return None
            at += n
        if at + length > len(data):
            return None
        out.append((tag, data[at : at + length]))
        at += length
    return out


def is_der_key(data: bytes, within: bool = False) -> bool:
    """within: as the inner key of a PKCS#8 one, which isn't PKCS#8 again."""
    outer = der_elements(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    parts = der_elements(outer[0][1])
    if not within and parts and [t for t, _ in parts] == [0x30, 0x04]:  # encrypted PKCS#8
        algorithm = der_elements(parts[0][1])
        return bool(algorithm) and [t for t, _ in algorithm] == [0x06, 0x30] and algorithm[0][1].startswith(PASSWORD_BASED) and len(parts[1][1]) >= 16
    if not parts or parts[0][0] != 0x02 or len(parts[0][1]) != 1:
        return False
    tags, version = [t for t, _ in parts], parts[0][1][0]
    if version in (0, 1) and len(parts) >= 9 and all(t == 0x02 for t in tags[:9]):
        return True  # PKCS#1
    if version == 1 and len(parts) >= 2 and tags[1] == 0x04 and len(parts[1][1]) in (20, 24, 28, 32, 48, 66) and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return True  # SEC1
    if version == 0 and len(parts) == 6 and all(t == 0x02 for t in tags) and len(parts[1][1]) >= 64 and 20 <= len(parts[2][1]) <= 33:
        return True  # DSA: p, q, g, y, x
    if not within and version in (0, 1) and len(parts) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:  # PKCS#8
        algorithm, inner = der_elements(parts[1][1]), der_elements(parts[2][1])
        if not algorithm or algorithm[0][0] != 0x06 or not inner:
            return False
        number = len(inner) == 1 and inner[0][0] == 0x02 and [t for t, _ in algorithm] == [0x06, 0x30]  # DSA, with p, q, g as parameters
        return number or inner[0][0] == 0x04 or is_der_key(parts[2][1], True)
    return False


def is_openssh_key(data: bytes) -> bool:
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, fields = len(magic), []
    for _ in range(3):  # cipher, key derivation, its options
        if at + 4 > len(data):
            return False
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4 + n
        fields.append(n)
    if at + 4 > len(data) or not 1 <= fields[0] <= 64:
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 64:
        return False
    for _ in range(keys + 1):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at == len(data)


def key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "private_key_openssh" if is_openssh_key(data) else "private_key_der" if data[0] == 0x30 and is_der_key(data) else None


def key_in(text: str) -> tuple[str, int] | None:
    """Kind and size of the private key that text is, as base64 or as hex."""
    for data in (decode_base64(text), decode_hex(text)):
        if kind := key_kind(data):
            return kind, len(data)
    return None


def is_signed_token(header: str, claims: str, signature: str) -> bool:
    parts = [decode_base64(header), decode_base64(claims)]
    try:
        head, body = (json.loads(p) for p in parts if p is not None)
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(body, dict) or not isinstance(head.get("alg"), str):
        return False
    if head["alg"].lower() == "none":
        return signature == ""
    signed = decode_base64(signature) if signature else None
    return signed is not None and len(signed) in SIGNATURE.get(head["alg"], {len(signed)} if len(signed) >= 64 else set())


def is_checksummed(body: str, check: str) -> bool:
    value = zlib.crc32(body.encode())
    out = ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out == check


def is_random_key(data: bytes) -> bool:
    """A usual key size and, of n bytes, as many different ones as n random bytes all but always have."""
    n = len(data)
    expected = 256 * (1 - (255 / 256) ** n)
    return n in KEY_SIZES and len(set(data)) >= expected - 4 * max(1.0, n * n / 512) ** 0.5


def assigned_size(text: str) -> int | None:
    """The size of the key that an assigned hex or base64 string decodes to."""
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
        data = bytes.fromhex(text) if len(text) % 2 == 0 else None
    elif re.search("[0-9+/_-]", text) and re.search("[a-z]", text) and re.search("[A-Z]", text):
        data = decode_base64(text)
    else:
        data = None
    return len(data) if data and is_random_key(data) else None


def find_secrets(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, decoded size) in order, none overlapping; offsets in characters."""
    found = []
    for m in ARMOUR.finditer(text):
        if key := key_in(re.sub(r"\s|\\[nr]", "", m[2])):
            found.append((m.start(), m.end(), *key))
    for m in BARE.finditer(text):
        if key := key_in(m[0]):
            found.append((m.start(), m.end(), *key))
    for m in TOKEN.finditer(text):
        if m[1].startswith("e") and is_signed_token(*m.groups()):
            found.append((m.start(), m.end(), "signed_token", len(decode_base64(m[3]) or b"")))
    for m in CHECKED.finditer(text):
        if is_checksummed(m[2], m[3]):
            found.append((m.start(), m.end(), "checksum_token", 30))
    for m in KEY_ID.finditer(text):
        account = (int.from_bytes(base64.b32decode(m[1])[:6], "big") & 0x7FFFFFFFFF80) >> 7
        if account > 0:
            found.append((m.start(), m.end(), "access_key_id", 10))
    for m in ASSIGNED.finditer(text):
        if key := key_in(m[1]):
            found.append((m.start(1), m.end(1), *key))
        elif size := assigned_size(m[1]):
            found.append((m.start(1), m.end(1), "assigned_key", size))
    out: list[tuple[int, int, str, int]] = []
    for f in sorted(set(found)):
        if not out or f[0] >= out[-1][1]:
            out.append(f)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, kind, n_bytes) of each confirmed secret."""
    maybe = docs.select("doc_id", "text").where(F.col("text").rlike(PREFILTER))
    schema = T.StructType([maybe.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("n_bytes", T.LongType())])

    def run(batches):
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = find_secrets(text)
                rows += [i] * len(own)
                found += own
            columns = list(zip(*found)) if found else [[], [], [], []]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]], schema.names)

    return maybe.mapInArrow(run, schema)
