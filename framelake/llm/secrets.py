"""Secret scanning with structural confirmation.

Base candidates are assignments to secret-like names, access key ids and long hexadecimal runs.  Structural
confirmation looks further: base64 (both alphabets) and hexadecimal candidates (either case), in one run or in lines that
may be indented or joined by an escaped line end, are decoded, and reported when the bytes parse throughout as a private
key - DER whose nested lengths all add up and whose fields are those of an RSA, DSA, EC, PKCS#8 or encrypted PKCS#8 key
and belong together (a modulus is its primes' product, a public value the power of the private one, an EC key as long as
its curve asks), or the fields of an OpenSSH key file - or when a signed token's header and claims are JSON with an
algorithm.  A key may begin anywhere in a run: its first bytes are looked for at every place, its fields' lengths are
followed without decoding what lies between, and only what fits is decoded.  Public keys, certificates and signatures have other
fields and are not reported.  Confirmed spans are added; base ones stay.

Spans are (kind, start, end) in code points, end exclusive, of the whole match.  A scan is one pass over each row in
its own task, in time linear in the text: nothing is shuffled.  Nulls and edge cases: a null or empty text has no spans; a
null id keeps its row; repeated rows repeat; an empty table gives no rows.  ``redact`` keeps all other columns as they
are, whatever their names; ``scan`` does not read them.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import beside, slices, text_column

# The base patterns and the shortest secret of each kind.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "token", "armour", "der", "ssh")

#: Runs of token characters; a signed token is three parts of one.
TOKEN = re.compile(r"[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+)*+")
ARMOUR = re.compile(r"-----BEGIN ([A-Z ]{0,32}PRIVATE KEY)-----([A-Za-z0-9+/=\s]{16,}?)-----END \1-----")
#: What stands between the lines of one block: a line end, real or escaped, and indentation.
LINE_END = re.compile(r"(?<=[A-Za-z0-9+/_-])[ \t]{0,64}(?:\r?\n|(?:\\r)?\\n)[ \t]{0,64}(?=[A-Za-z0-9+/_-])")
RUN64, RUN16 = re.compile(r"[A-Za-z0-9+/_-]*"), re.compile(r"[0-9A-Fa-f]*")
#: The first characters of a sequence (of a long, a middle or a short length) whose first field is a version of 0 or 1, or a
#: sequence that begins with an object identifier, in base64 and in hexadecimal.
_ANY, _LOW = "[A-Za-z0-9+/_-]", "[AEIMQUYcgkosw048]"
START64 = re.compile(
    f"M(?=I[I-L]{_ANY}{_ANY}[AQgw]IBA|I[E-H]{_ANY}AgE[AB]|[A-H]{_LOW}CAQ|I[I-L]{_ANY}{_ANY}[DTjz][AB]{_ANY}B[g-v]|I[E-H]{_ANY}M[A-H]{_LOW}G|[A-H]{_LOW}w{_ANY}[AQgw][YZab])|b3BlbnNzaC1rZXktdjE"
)
START16 = re.compile(r"30(?=(?:[0-7][0-9A-Fa-f]|81[0-9A-Fa-f]{2}|82[0-9A-Fa-f]{4})(?:02010[01]|30[0-7][0-9A-Fa-f]06))|6[fF]70656[eE]7373682[dD]6[bB]65792[dD]7631")
#: Keys have no more bytes than this.
LONGEST = 1 << 16
# How keys begin (DER's sequence tag, OpenSSH's name), and the object identifiers of encrypted PKCS#8.
SEQUENCE, INTEGER, OCTETS, OBJECT_ID = 0x30, 0x02, 0x04, 0x06
OPENSSH = b"openssh-key-v1\x00"
ENCRYPTED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c"))
RSA_IDS = (bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a864886f70d01010a"))
DSA_ID, EC_ID = bytes.fromhex("2a8648ce380401"), bytes.fromhex("2a8648ce3d0201")
#: Bytes of the private values of curves: 25519 and 448 for signing and agreement; then the prime curves.
EDWARDS = {bytes.fromhex(k): n for k, n in (("2b6570", 32), ("2b6571", 57), ("2b656e", 32), ("2b656f", 56))}
CURVES = {bytes.fromhex(k): n for k, n in (("2a8648ce3d030107", 32), ("2b81040022", 48), ("2b81040023", 66), ("2b81040021", 28), ("2a8648ce3d030101", 24), ("2b8104000a", 32))}
SSH_NAMES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-", b"sk-")
REDACTED = "[REDACTED]"


def decoded(text: str) -> bytes | None:
    """Base64 (either alphabet, padding optional) as bytes, or None."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """(content start, content end) of the DER element at ``at``, or None where the length does not parse."""
    if at + 2 > len(data):
        return None
    first, start = data[at + 1], at + 2
    if first < 128:
        return start, start + first
    size = first & 127
    if not 1 <= size <= 4 or start + size > len(data) or data[start] == 0:
        return None
    length = int.from_bytes(data[start : start + size], "big")
    return (start + size, start + size + length) if length >= 128 else None


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, content start, content end) of the DER elements that fill ``at`` to ``end`` exactly, or None."""
    found = []
    while at < end:
        content = der_length(data, at)
        if content is None or content[1] > end:
            return None
        found.append((data[at], *content))
        at = content[1]
    return found


def well_formed(data: bytes) -> list[tuple[int, int, int]] | None:
    """The fields of the one SEQUENCE that ``data`` is, when every nested length adds up; each element is seen once."""
    outer = elements(data, 0, len(data)) if data[:1] == bytes([SEQUENCE]) else None
    if outer is None or len(outer) != 1:
        return None
    fields = None
    waiting = outer
    while waiting:
        tag, start, end = waiting.pop()
        if tag & 0x20:
            inner = elements(data, start, end)
            if inner is None:
                return None
            if fields is None:
                fields = list(inner)
            waiting += inner
        elif tag == INTEGER and start == end:
            return None
    return fields


def numbers(data: bytes, fields: list[tuple[int, int, int]]) -> list[int]:
    """The values of integer fields."""
    return [int.from_bytes(data[a:b], "big", signed=True) for _, a, b in fields]


def is_rsa(data: bytes, fields: list[tuple[int, int, int]]) -> bool:
    """Version, modulus, exponents, primes and the primes' own exponents, which must belong together."""
    if [t for t, _, _ in fields] not in ([INTEGER] * 9, [INTEGER] * 9 + [SEQUENCE]):
        return False
    version, n, e, d, p, q, dp, dq, _ = numbers(data, fields[:9])
    if version != len(fields) - 9 or min(n, e, d, p, q) < 3:
        return False
    return (n == p * q if version == 0 else n % (p * q) == 0) and e * dp % (p - 1) == 1 and e * dq % (q - 1) == 1


def is_dsa(data: bytes, fields: list[tuple[int, int, int]]) -> bool:
    """Version 0, p, q, g, the public and the private value."""
    if [t for t, _, _ in fields] != [INTEGER] * 6:
        return False
    version, p, q, g, y, x = numbers(data, fields)
    return version == 0 and 1 < q < p and (p - 1) % q == 0 and 1 < g < p and 0 < x < q and pow(g, x, p) == y


def is_ec(data: bytes, fields: list[tuple[int, int, int]], curve: bytes | None = None) -> bool:
    """Version 1 and a private value as long as its curve asks; a key by itself names its curve or has its public point."""
    tags = [t for t, _, _ in fields]
    if tags[:2] != [INTEGER, OCTETS] or numbers(data, fields[:1]) != [1] or any(t not in (0xA0, 0xA1) for t in tags[2:]):
        return False
    size, point = fields[1][2] - fields[1][1], False
    for tag, a, b in fields[2:]:
        inner = elements(data, a, b)
        if not inner or len(inner) != 1:
            return False
        kind, c, d = inner[0]
        if tag == 0xA0 and kind == OBJECT_ID:
            curve = data[c:d]
        if tag == 0xA1:
            # Unused bits, then 4 and both coordinates, or 2 or 3 and one.
            point = kind == 3 and data[c : c + 2] in (b"\0\x04", b"\0\2", b"\0\3") and d - c in (2 * size + 2, size + 2)
            if not point:
                return False
    return (curve is not None or point) and CURVES.get(curve, size) == size and 16 <= size <= 80


def is_wrapped(data: bytes, fields: list[tuple[int, int, int]]) -> bool:
    """PKCS#8: version, algorithm, and a key of that algorithm."""
    tags = [t for t, _, _ in fields]
    if tags[:3] != [INTEGER, SEQUENCE, OCTETS] or numbers(data, fields[:1])[0] not in (0, 1) or any(t not in (0xA0, 0xA1, 0x81) for t in tags[3:]):
        return False
    named = elements(data, fields[1][1], fields[1][2])
    if not named or named[0][0] != OBJECT_ID:
        return False
    name, inner = data[named[0][1] : named[0][2]], data[fields[2][1] : fields[2][2]]
    own = well_formed(inner)
    if name in RSA_IDS:
        return own is not None and is_rsa(inner, own)
    if name == EC_ID:
        return own is not None and len(named) == 2 and is_ec(inner, own, data[named[1][1] : named[1][2]])
    if name in EDWARDS:
        return inner[:1] == bytes([OCTETS]) and der_length(inner, 0) == (2, len(inner)) and len(inner) == EDWARDS[name] + 2
    if name == DSA_ID:
        values = elements(inner, 0, len(inner))
        return bool(values) and [t for t, _, _ in values] == [INTEGER] and numbers(inner, values)[0] > 0
    return len(inner) >= 16  # an algorithm that is not known here


def is_der_key(data: bytes) -> bool:
    """A private key in DER: RSA, DSA, EC, PKCS#8 or encrypted PKCS#8."""
    fields = well_formed(data)
    if not fields:
        return False
    if fields[0][0] == SEQUENCE:
        named = elements(data, fields[0][1], fields[0][2])
        locked = [t for t, _, _ in fields] == [SEQUENCE, OCTETS] and fields[1][1] < fields[1][2]
        return locked and bool(named) and named[0][0] == OBJECT_ID and data[named[0][1] : named[0][2]].startswith(ENCRYPTED)
    return is_rsa(data, fields) or is_dsa(data, fields) or is_ec(data, fields) or is_wrapped(data, fields)


def ssh_fields(data: bytes, at: int, most: int | None = None) -> tuple[list[bytes], int] | None:
    """Length-prefixed fields from ``at`` on (all of them or ``most``), and where they end; None where one runs over."""
    fields: list[bytes] = []
    while at < len(data) and len(fields) != most:
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return fields, at


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key: cipher, derivation and its options, public keys with known names, and the private part."""
    head = ssh_fields(data, len(OPENSSH), 3) if data.startswith(OPENSSH) else None
    if head is None or len(head[0]) < 3 or not head[0][0].isascii():
        return False
    at = head[1]
    keys = int.from_bytes(data[at : at + 4], "big")
    rest = ssh_fields(data, at + 4)
    if rest is None or not 1 <= keys == len(rest[0]) - 1:
        return False
    for public in rest[0][:-1]:
        fields = ssh_fields(public, 0)
        if fields is None or len(fields[0]) < 2 or not fields[0][0].startswith(SSH_NAMES):
            return False
    private = rest[0][-1]
    # Unencrypted, it starts with one check number twice.
    return len(private) >= 8 and len(private) % 8 == 0 and (head[0][0] != b"none" or private[:4] == private[4:8])


def is_key(data: bytes | None) -> str | None:
    """The kind of key that the bytes are."""
    if not data:
        return None
    return "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None


def is_json_object(text: str) -> dict | None:
    """The object that base64 decodes to, or None."""
    data = decoded(text) if text.startswith("eyJ") else None
    try:
        found = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def signed_tokens(text: str) -> Iterator[tuple[str, int, int]]:
    """Three parts of a run: a JSON header that names its algorithm (from its part's first "eyJ"), JSON claims, a signature."""
    for m in TOKEN.finditer(text):
        if "eyJ" not in m[0] or m[0].count(".") < 2:
            continue
        parts, at = m[0].split("."), m.start()
        skip = 0
        for k, part in enumerate(parts[:-2]):
            head = part.find("eyJ")
            # The shortest header, {"alg":""}, takes 14 characters.
            if not skip and 0 <= head <= len(part) - 14 and parts[k + 1].startswith("eyJ"):
                header = is_json_object(part[head:])
                if header is not None and isinstance(header.get("alg"), str) and is_json_object(parts[k + 1]) is not None:
                    yield "token", at + head, at + sum(map(len, parts[k : k + 3])) + 2
                    skip = 3
            at += len(part) + 1
            skip = max(skip - 1, 0)


class Flat:
    """A text whose block lines are joined, and where its characters stand in the text."""

    def __init__(self, text: str) -> None:
        pieces, self.starts, self.shifts, at, size = [], [0], [0], 0, 0
        for m in LINE_END.finditer(text):
            pieces.append(text[at : m.start()])
            size += m.start() - at
            at = m.end()
            self.starts.append(size)
            self.shifts.append(at - size)
        self.text = "".join([*pieces, text[at:]]) if pieces else text
        #: In the common base64 alphabet.
        self.plain = self.text.replace("-", "+").replace("_", "/")

    def place(self, at: int) -> int:
        """Where a character of the joined text stands."""
        return at + self.shifts[bisect_right(self.starts, at) - 1]


class Window:
    """The bytes that characters from some place on stand for, decoded where they are asked for."""

    def __init__(self, plain: str, at: int, end: int, hexadecimal: bool) -> None:
        self.plain, self.at, self.end, self.hexadecimal = plain, at, end, hexadecimal
        self.size = (end - at) // 2 if hexadecimal else (end - at) * 3 // 4
        self.head = self._decoded(0, min(48, self.size))  # most of what is asked for

    def _decoded(self, start: int, stop: int) -> bytes:
        if self.hexadecimal:
            return bytes.fromhex(self.plain[self.at + 2 * start : self.at + 2 * stop])
        first = start // 3
        part = self.plain[self.at + 4 * first : min(self.at + 4 * -(-stop // 3), self.end)]
        if len(part) % 4 == 1:
            part = part[:-1]
        return binascii.a2b_base64(part + "=" * (-len(part) % 4))[start - 3 * first : stop - 3 * first]

    def read(self, start: int, stop: int) -> bytes:
        """Bytes ``start`` to ``stop``, or as many as there are."""
        stop = min(stop, self.size)
        if stop <= len(self.head):
            return self.head[start:stop]
        return self._decoded(start, stop) if start < stop else b""

    def characters(self, size: int) -> int:
        """Where the characters of so many bytes end."""
        return self.at + (2 * size if self.hexadecimal else -(-size * 4 // 3))

    def header(self, at: int) -> tuple[int, int, int] | None:
        """(tag, content start, content end) of the DER element at a byte."""
        head = self.read(at, at + 6)
        content = der_length(head, 0) if len(head) > 1 else None
        return (head[0], at + content[0], at + content[1]) if content else None

    def der_size(self) -> int | None:
        """How many bytes a sequence here has, where it ends within and its fields' lengths add up to its own."""
        outer = self.header(0)
        if outer is None or outer[0] != SEQUENCE or outer[2] > min(self.size, LONGEST):
            return None
        at, fields = outer[1], 0
        while at < outer[2]:
            field = self.header(at)
            if field is None or field[2] > outer[2] or fields == 12:
                return None
            at, fields = field[2], fields + 1
        return outer[2] if fields > 1 else None

    def ssh_size(self) -> int | None:
        """How many bytes an OpenSSH key here has: three fields, a number of keys, these and the private part."""
        at = len(OPENSSH)
        for _ in range(3):
            at += 4 + int.from_bytes(self.read(at, at + 4), "big")
            if at > min(self.size, LONGEST):
                return None
        keys = int.from_bytes(self.read(at, at + 4), "big")
        at += 4
        if not 1 <= keys <= 16:
            return None
        for _ in range(keys + 1):
            at += 4 + int.from_bytes(self.read(at, at + 4), "big")
            if at > min(self.size, LONGEST):
                return None
        return at


def keys_in(flat: Flat, hexadecimal: bool) -> Iterator[tuple[str, int, int]]:
    """Keys in base64 or hexadecimal, wherever in a run they begin; one within another is not looked for."""
    text, run = flat.text, RUN16 if hexadecimal else RUN64
    end = done = 0
    for m in (START16 if hexadecimal else START64).finditer(text):
        at = m.start()
        if at < done:
            continue
        if at >= end:
            end = run.match(text, at).end()
        window = Window(flat.plain, at, end, hexadecimal)
        der = m[0][0] in "M3"
        size = window.der_size() if der else window.ssh_size()
        if size is None:
            continue
        stop = window.characters(size)
        if not hexadecimal and set(text[at:stop]) & set("+/") and set(text[at:stop]) & set("-_"):
            continue
        if kind := is_key(window.read(0, size)):
            done = stop
            last = flat.place(stop - 1) + 1
            while not hexadecimal and (stop - at) % 4 and text[stop : stop + 1] == "=" and stop - done < 2:
                stop, last = stop + 1, last + 1
            yield kind, flat.place(at), last


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base matches, leftmost and non-overlapping within each kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans that structural confirmation adds."""
    found = list(signed_tokens(text)) if "eyJ" in text else []
    armour = []
    if "-----BEGIN " in text:
        for m in ARMOUR.finditer(text):
            if is_key(decoded("".join(m[2].split()))):
                armour.append(("armour", m.start(), m.end()))
    flat = Flat(text)
    found += keys_in(flat, True)
    at = 0
    for span in keys_in(flat, False):
        while at < len(armour) and armour[at][2] <= span[1]:
            at += 1
        if at == len(armour) or span[1] < armour[at][1]:
            found.append(span)
    return found + armour


def joined(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by start, then kind as listed."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every run of overlapping spans replaced by a mark."""
    out, at = [], 0
    runs: list[list[int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if runs and a < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    for a, b in runs:
        out += [text[at:a], REDACTED]
        at = b
    return "".join([*out, text[at:]])


FOUND = T.StructType([*(T.StructField(f"n_{kind}", T.LongType()) for kind in KINDS[:3]), T.StructField("base", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("clean", T.StringType())])


def scan_rows(rows: DataFrame, rewrite: bool) -> DataFrame:
    """Every ``row`` of (``row``, ``text``) with counts of the base kinds, joined base spans, joined spans and, on demand,
    the redacted text where there are spans."""
    schema = T.StructType([rows.schema["row"], *FOUND.fields])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            out: list[list] = [[] for _ in FOUND]
            for text in part.column("text").to_pylist():
                base = base_spans(text)
                every = base + confirmed_spans(text)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
                for column, value in zip(out, (*counts, joined(base), joined(every), redacted(text, every) if rewrite and every else None), strict=True):
                    column.append(value)
            types = [pa.int64()] * 3 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([part.column("row"), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], schema.names)

    return rows.mapInArrow(of, schema)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, joined ``base`` spans and joined ``spans``."""
    rows = docs.select(F.struct(F.col(id_col).alias("doc_id")).alias("row"), text_column(text_col).alias("text"))
    return scan_rows(rows, False).select("row.doc_id", *FOUND.names[:-1])


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``[REDACTED]``; a length column follows where it exists."""
    found = scan_rows(beside(docs, text_col), True)
    old = {c: F.col("row").getField(c) for c in docs.columns}
    new = {text_col: F.coalesce("clean", old[text_col])}
    if length_col in old:
        new[length_col] = F.when(F.col("clean").isNotNull(), F.length("clean").cast(docs.schema[length_col].dataType)).otherwise(old[length_col])
    return found.select(*[new.get(c, column).alias(c) for c, column in old.items()])


def query(spark, sf_dir: str) -> DataFrame:
    """Contract query of operator 5."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
