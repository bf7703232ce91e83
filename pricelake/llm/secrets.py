"""Secret scans: three fixed patterns and a token-efficiency test.

The fixed patterns find assigned passwords and keys, access key ids and long hexadecimal runs. The
token-efficiency test looks at every other unbroken run of letters, digits and ``+/=_-``: under a
byte-pair vocabulary, words and names need few tokens, while random strings need one for every two
or three characters. Runs of at least ``MIN_CHARS`` characters with at most ``MAX_RATIO``
characters a token are spans of the kind ``random``, except known digests (hexadecimal of the usual
lengths), UUIDs, plain numbers and words joined by ``_ - / + =``. Where a run as a whole passes, its
pieces between these signs are tested in the same way, so a path or a name before a secret hides
nothing. Parts of web and mail addresses are runs like all others.

Defined cases: a null or blank text has no spans; repeated rows each give a row; spans count code
points, ends exclusive, in the order of start and then kind; a very long text is scanned whole, in time
in proportion to its length; carried columns may have any name but those of the results; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, small_batches

VOCABULARY = "byte_bpe_50k.tiktoken"
MIN_CHARS, MAX_RATIO = 16, 2.4
KINDS = ("assign", "access", "hex", "random")
# The patterns of the base kinds, and the least lengths of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS, ACCESS_CHARS = 12, 18
_HINTS = ("passw", "secret", "token", "apikey", "api_key")
_RUN = re.compile(r"[A-Za-z0-9+/=_-]{%d,}" % MIN_CHARS)
_DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})\Z")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\Z")
_PART, _PIECE = re.compile(r"[^/=]+"), re.compile(r"[^_/=+-]+")
_WORD = re.compile(r"[A-Z]?[a-z]*|[A-Z]*|[0-9]*")
_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary in a file of base64 tokens and ranks, read once in each process."""
    if path not in _encodings:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def is_known(run: str) -> bool:
    """Digests, UUIDs and numbers."""
    return bool(_DIGEST.match(run) or _UUID.match(run)) or not any(c.isalpha() for c in run)


def inefficient(run: str, tokens: tiktoken.Encoding) -> bool:
    return len(run) <= MAX_RATIO * len(tokens.encode_ordinary(run))


def random_parts(run: str, tokens: tiktoken.Encoding) -> Iterator[tuple[int, int]]:
    """Start and end of what is random in a run: all of it, or long pieces of it."""
    if len(run) < MIN_CHARS or is_known(run):
        return
    parts = list(_PART.finditer(run))
    if len(parts) > 1 and any(len(p[0]) >= MIN_CHARS and is_known(p[0]) for p in parts):
        for p in parts:
            yield from ((p.start() + s, p.start() + e) for s, e in random_parts(p[0], tokens))
        return
    pieces = list(_PIECE.finditer(run))
    words = len(pieces) > 1 and all(_WORD.fullmatch(p[0]) for p in pieces)
    if not words and inefficient(run, tokens):
        yield 0, len(run)
        return
    for p in pieces:
        if MIN_CHARS <= len(p[0]) < len(run) and not is_known(p[0]) and inefficient(p[0], tokens):
            yield p.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the three fixed patterns."""
    found = []
    low = lower_ascii(text)
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, tokens: tiktoken.Encoding, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs that need many tokens and that no other span touches; taken is in order, so one pass merges both."""
    found, k, reach = [], 0, 0
    for m in _RUN.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            reach = max(reach, taken[k][2])
            k += 1
        if reach <= m.start():
            found += [(m.start() + s, 3, m.start() + e) for s, e in random_parts(m[0], tokens)]
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def spans_of(text: str | None, tokens: tiktoken.Encoding) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text, in order."""
    base = base_spans(text) if text else []
    return base, sorted(base + (random_spans(text, tokens, base) if text else []))


def scanned(documents: DataFrame, carry: list[str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """The carried columns with n_assign, n_access, n_hex, base_sha256 and spans of every text."""
    carry = ["doc_id"] if carry is None else carry
    small_batches(documents.sparkSession)
    schema = documents.select(*carry).schema
    for name, kind in (("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base_sha256", "string"), ("spans", "string")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]):
        tokens = encoding(public_tokenizers.path(vocabulary))
        for batch in batches:
            rows = [spans_of(t, tokens) for t in batch.column("__text").to_pylist()]
            counts = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in rows], pa.int64()) for kind in range(3)]
            digest = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *counts, digest, pa.array([joined(a) for _, a in rows], pa.string())], [*carry, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return documents.select(*carry, F.col("text").alias("__text")).mapInArrow(run, schema)


def redacted(text: str = "text", spans: str = "spans") -> Column:
    """The text with every span replaced by [SECRET]; built from code-point offsets, so overlapping spans are masked once."""
    cut = F.transform(F.filter(F.split(F.col(spans), ","), lambda s: s != ""), lambda s: F.struct(F.element_at(F.split(s, ":"), 2).cast("int").alias("s"), F.element_at(F.split(s, ":"), 3).cast("int").alias("e")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        begin = F.greatest(acc["at"], x["s"])
        piece = F.substring(F.col(text), acc["at"] + 1, begin - acc["at"])
        return F.when(x["e"] > acc["at"], F.struct(x["e"].alias("at"), F.concat(acc["out"], piece, F.lit("[SECRET]")).alias("out"))).otherwise(acc)

    done = F.aggregate(cut, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))))
    return F.when(F.col(text).isNull() | (F.col(spans) == ""), F.col(text)).otherwise(done)
