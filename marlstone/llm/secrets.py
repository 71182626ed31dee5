"""Secret scans: a keyword automaton finds the places to look at, anchored patterns look there, checksums confirm.

Kinds, in order: assign, access, hex (the base kinds), github and npm (tokens whose last six characters are a base-62
CRC-32 of the rest), jwt (whose header must decode to JSON), pem (private-key blocks whose body must be base64).
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.words import small_batches

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE = ("assign", "access", "hex")

# Keywords by kind, in lower case, and the patterns that are tried at their places.
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
OTHER_WORDS = {b"akia": "access", b"ghp_": "github", b"gho_": "github", b"ghu_": "github", b"ghs_": "github", b"ghr_": "github", b"npm_": "npm", b"eyj": "jwt", b"-----begin ": "pem"}
ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
GITHUB = re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
JWT = re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
PEM = re.compile(rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END (?:[A-Z]+ )*PRIVATE KEY-----")
JWT_RUN = re.compile(rb"[A-Za-z0-9_-]+")
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        found.add_word(word.decode("latin-1"), (len(word), "assign"))
    for word, kind in OTHER_WORDS.items():
        found.add_word(word.decode("latin-1"), (len(word), kind))
    found.make_automaton()
    return found


def _base62(number: int) -> bytes:
    out = b""
    for _ in range(6):
        number, r = divmod(number, 62)
        out = BASE62[r : r + 1] + out
    return out


def _json_part(part: bytes) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4))), dict)
    except (ValueError, binascii.Error, UnicodeDecodeError, RecursionError):
        return False


def _base64_block(body: bytes) -> bool:
    try:
        return len(base64.b64decode(b"".join(body.split()), validate=True)) >= 16
    except (ValueError, binascii.Error):
        return False


#: For each kind: the pattern, and what a match needs to count.
RULES = {
    "assign": (ASSIGN, lambda m: len(m[1]) >= 8),
    "access": (ACCESS, lambda m: len(m[0]) >= 16),
    "github": (GITHUB, lambda m: _base62(zlib.crc32(m[1])) == m[2]),
    "npm": (NPM, lambda m: _base62(zlib.crc32(m[1])) == m[2]),
    "jwt": (JWT, lambda m: _json_part(m[1]) and _json_part(m[2])),
    "pem": (PEM, lambda m: _base64_block(m[1])),
}


def _byte_spans(raw: bytes, keywords) -> list[tuple[int, int, str]]:
    """Spans in bytes. Matches of one kind are leftmost and don't overlap; one that fails its test still takes its room."""
    spans = [(m.start(), m.end(), "hex") for m in HEX.finditer(raw)]
    places: dict[str, list[int]] = {}
    for end, (size, kind) in keywords.iter(raw.lower().decode("latin-1")):
        places.setdefault(kind, []).append(end + 1 - size)
    for kind, starts in places.items():
        pattern, valid = RULES[kind]
        behind = 0
        for start in sorted(starts):
            if start < behind:
                continue
            if m := pattern.match(raw, start):
                behind = m.end()
                if valid(m):
                    spans.append((start, behind, kind))
            elif kind == "jwt":  # what follows a run of its letters is the same for every start in it
                behind = JWT_RUN.match(raw, start).end()
    return spans


def find_secrets(text: str | None, keywords=None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, end exclusive, by start and then by the order of KINDS. Null has none.

    Lone surrogates, which Parquet texts don't hold, are kept as bytes and count as one code point.
    """
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    spans = _byte_spans(raw, keywords or automaton())
    if not spans:
        return []
    if len(raw) != len(text):
        ends = sorted({p for a, b, _ in spans for p in (a, b)})
        at, points, before = {}, 0, 0
        for p in ends:
            points += len(raw[before:p].decode("utf-8", "surrogatepass"))
            before = p
            at[p] = points
        spans = [(at[a], at[b], k) for a, b, k in spans]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str | None, mask: str = "[SECRET]", keywords=None) -> str | None:
    """The text with each span, or union of overlapping spans, replaced by ``mask``."""
    spans = find_secrets(text, keywords)
    if not spans:
        return text
    merged: list[list[int]] = []
    for a, b, _ in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, behind = [], 0
    for a, b in merged:
        out += [text[behind:a], mask]
        behind = b
    return "".join([*out, text[behind:]])


FOUND = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_assign", T.LongType()),
        T.StructField("n_access", T.LongType()),
        T.StructField("n_hex", T.LongType()),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("n_spans", T.LongType()),
    ]
)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: counts of the base kinds, a hash of the base spans, and all spans as text.

    Null and empty texts have no spans. Repeated rows are scanned each on their own. Spans of equal start are listed in the
    order of their kinds. A text of any length is scanned whole, a few at a time. An empty table gives no rows; ids must be
    integers or null; other columns are not read.

    Hex runs have no keyword that a prefilter could look for, so their pattern runs over the whole text by itself.
    """

    def find(batches):
        keywords = automaton()
        for batch in small_batches(batches, 1):
            rows = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                spans = find_secrets(t.as_py(), keywords)
                base = [s for s in spans if s[2] in BASE]
                rows.append((doc, *(sum(s[2] == k for s in base) for k in BASE), hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans), len(spans)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=FOUND.fieldNames())

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(find, FOUND)


def redacted(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with its secrets masked in ``text``, and ``n_chars`` set to the new length where a text has changed.

    Null, empty and clean texts and all other columns, whatever their names, stay as they are; repeated rows are masked
    alike; an empty table gives no rows."""
    names = docs.columns
    at = names.index(text)
    count = names.index(n_chars) if n_chars in names else None

    def mask(batches):
        keywords = automaton()
        for batch in small_batches(batches, at):
            columns = list(batch.columns)
            old = columns[at].to_pylist()
            new = [redact(t, keywords=keywords) for t in old]
            changed = [k for k, (a, b) in enumerate(zip(old, new)) if a is not b]
            if changed:
                columns[at] = pa.array(new, columns[at].type)
                if count is not None:
                    sizes = columns[count].to_pylist()
                    for k in changed:
                        sizes[k] = len(new[k])
                    columns[count] = pa.array(sizes, columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(mask, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
