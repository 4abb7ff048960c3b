"""Secret scans with corpus-wide ownership frequency.

Patterns propose candidates in every text; the value of each is hashed, and hashes are counted over the
whole corpus by distinct repositories and distinct owners. A value that many owners hold is a widely
copied example; one that a few owners hold and that looks random is a live-looking credential. Three base
kinds are always reported; further kinds are reported unless their value is widely copied.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from planweave.llm.common import materialize, utf8

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "private_key", "prefixed", "web_token", "login_url", "random")
#: A value held by more owners than this is a widely copied example.
MOST_OWNERS = 3
#: Bits per character from which a value looks random, and the least number of distinct characters.
LEAST_BITS, LEAST_DISTINCT = 2.5, 6

_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PREFIXED = re.compile(r"\b(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_|npm_|AIza)[A-Za-z0-9_-]{16,}")
_WEB_TOKEN = re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
_LOGIN = re.compile(r"://([^\s/:@]{1,256}:[^\s/:@]{4,256})@")
_RANDOM = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
_KEY_OPEN = re.compile(r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----")
_KEY_CLOSE = re.compile(r"-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----")
#: Words inside a value that mark it as a stand-in.
_STAND_IN = re.compile(r"example|sample|dummy|changeme|placeholder|redacted|your_|test|xxxx|0000|1234", re.I)

# Two quick looks at the bytes say whether the slow patterns can match at all.
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_RUNS = bytes(
    (b"h" if chr(c) in "0123456789abcdef" else b"w" if chr(c).isascii() and (chr(c).isalnum() or chr(c) in "+/_-") else b" ")[0]
    for c in range(256)
)


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    hash: bytes
    random: bool


def looks_random(value: str) -> bool:
    """Whether a value has enough different characters, evenly enough, and no stand-in word."""
    counts = Counter(value)
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values()) if value else 0.0
    return bits >= LEAST_BITS and len(counts) >= LEAST_DISTINCT and not _STAND_IN.search(value)


def _private_keys(text: str) -> Iterator[tuple[int, int]]:
    """Key blocks from opening to the next closing line; every line is looked at once."""
    at = 0
    while opening := _KEY_OPEN.search(text, at):
        closing = _KEY_CLOSE.search(text, opening.end())
        if not closing:
            return
        yield opening.start(), closing.end()
        at = closing.end()


def _proposed(text: str, data: bytes) -> Iterator[tuple[str, int, int, str]]:
    """``kind, start, end, value``."""
    low = data.lower()
    if any(name in low for name in _NAMES):
        for m in _ASSIGN.finditer(text):
            if len(m[1]) >= 6:
                yield "assign", *m.span(), m[1]
    if b"AKIA" in data:
        for m in _ACCESS.finditer(text):
            yield "access", *m.span(), m[0]
    runs = data.translate(_RUNS)
    if b"h" * 24 in runs:
        for m in _HEX.finditer(text):
            yield "hex", *m.span(), m[0]
    if b"PRIVATE KEY-----" in data:
        for start, end in _private_keys(text):
            yield "private_key", start, end, text[start:end]
    if b"w" * 16 in (solid := runs.replace(b"h", b"w")):
        for m in _PREFIXED.finditer(text):
            yield "prefixed", *m.span(), m[0]
        if b"eyJ" in data:
            for m in _WEB_TOKEN.finditer(text):
                yield "web_token", *m.span(), m[0]
        if b"w" * 32 in solid:
            for m in _RANDOM.finditer(text):
                if not _HEX.fullmatch(m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0]):
                    yield "random", *m.span(), m[0]
    if b"://" in data and b"@" in data:
        for m in _LOGIN.finditer(text):
            yield "login_url", *m.span(1), m[1]


_ORDER = {k: n for n, k in enumerate(KINDS)}


def find(data: bytes) -> list[Span]:
    """All candidates of a UTF-8 text by start, then kind as listed; offsets are code points."""
    text = data.decode("utf-8", "replace")
    found = []
    for kind, start, end, value in _proposed(text, data):
        random = looks_random(value)
        if kind in BASE or random or kind == "private_key":
            found.append(Span(start, end, kind, blake2b(value.encode(), digest_size=16).digest(), random))
    return sorted(found, key=lambda s: (s.start, _ORDER[s.kind], s.end))


_SPAN = pa.struct([
    ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("hash", pa.binary()), ("random", pa.bool_()),
])


def _candidates(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([[s._asdict() for s in find(x.as_py())] for x in batch], pa.list_(_SPAN))


def candidate_column(text: str) -> Column:
    """Array of candidates of a text column; a null text has none."""
    kind = "array<struct<start: bigint, end: bigint, kind: string, hash: binary, random: boolean>>"
    return arrow_udf(_candidates, kind)(utf8(text))


def ownership(candidates: DataFrame) -> DataFrame:
    """``hash, owners, repositories``: how many hold each value; all missing owners are one unknown owner.

    Repeats inside a task are folded before any row is moved, so a value in a third of all documents
    costs a row per task, owner and repository.
    """
    return candidates.groupBy("hash").agg(
        F.count_distinct(F.struct("owner")).alias("owners"), F.count_distinct(F.struct("repository")).alias("repositories")
    )


def secrets(
    docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id",
    most_owners: int = MOST_OWNERS,
) -> DataFrame:
    """``doc_id`` and its ``found`` secrets (start, end, kind, owners, repositories, verdict), a row per input row.

    ``verdict`` is ``copied`` where more than ``most_owners`` owners hold the value, else ``live`` where it
    looks random, else ``weak``. Base kinds are always listed, others unless copied. Texts are read once and
    never shuffled; only hashes are. Only the named columns are read. A null or empty text has no secrets;
    repeated rows and null keys give a row each, and repeats add nothing to the counts of owners; an empty
    table gives an empty result.
    """
    rows = materialize(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), F.col(owner).alias("owner"),
        F.col(repository).alias("repository"), candidate_column(text).alias("spans"),
    ))
    each = rows.select("row", "owner", "repository", F.posexplode("spans").alias("place", "s")).select(
        "row", "owner", "repository", "place", "s.hash"
    )
    known = (
        each.select("row", "place", "hash").join(ownership(each), "hash")
        .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "owners", "repositories"))).alias("known"))
    )
    base = F.array(*map(F.lit, BASE))

    def judged(s: Column, k: Column) -> Column:
        verdict = F.when(k["owners"] > most_owners, "copied").when(s["random"], "live").otherwise("weak")
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"),
            k["owners"].alias("owners"), k["repositories"].alias("repositories"), verdict.alias("verdict"),
        )

    every = F.zip_with("spans", F.coalesce("known", F.array()), judged)
    kept = F.filter(every, lambda s: F.array_contains(base, s["kind"]) | (s["verdict"] != "copied"))
    return rows.join(known, "row", "left").select("doc_id", kept.alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, the checksum of the base spans, all spans, and the live-looking ones as text."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(field: str, value: str) -> Column:
        return F.size(F.filter("found", lambda s: s[field] == value)).cast("bigint")

    return found.select(
        "doc_id", *(number("kind", k).alias(f"n_{k}") for k in BASE),
        F.sha2(joined(F.filter("found", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        *(number("verdict", v).alias(f"n_{v}") for v in ("live", "copied", "weak")),
        joined(F.filter("found", lambda s: s["verdict"] == "live")).alias("live_spans"),
        F.coalesce(F.array_max(F.transform("found", lambda s: s["owners"])), F.lit(0)).alias("most_owners"),
    )
