"""Personal data in texts: patterns propose spans, checksums confirm them, context moves the score.

Four base kinds follow fixed patterns and checks and are always reported. Further kinds (bank account
numbers with mod-97, national numbers and local telephone numbers) start from a prior, gain from a
checksum and from telling words nearby, and are reported from ``LEAST_SCORE`` on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from planweave.llm.common import utf8

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national", "local_phone")
LEAST_SCORE = 0.5
#: Characters before and after a span in which context words count.
NEAR = 48

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# A match never starts inside a run of digits: the one before it would have taken the whole run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_GROUP_END = re.compile(r"(?<=[A-Z0-9])(?![A-Za-z0-9])")
_LEAST_ACCOUNT = 15
#: Characters of an account number by country, as registered.
_ACCOUNT = {
    c: int(n) for n, names in (x.split(":") for x in (
        "15:NO 16:BE 18:DK,FI,FO,GL,NL 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK 21:CH,HR,LI,LV "
        "22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG "
        "25:LY,PT,ST 26:IS,TR 27:FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,PL,SV 29:BR,EG,PS,QA,UA "
        "30:JO,KW,MU 31:MT,SC 32:LC"
    ).split()) for c in names.split(",")
}
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_DIGITS = re.compile(r"[^0-9]")
#: Prior without a checksum or context, and the words that speak for a kind.
_PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.4, "phone": 0.7, "iban": 0.2, "national": 0.4, "local_phone": 0.4}
_CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|contact|write|correo|courriel)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|client)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|credit|debit|tarjeta|carte|karte|payment)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|fax|mobile|cell|telefon|tel[eé]fono|t[eé]l[eé]phone)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|konto|compte|cuenta)\b", re.I),
    "national": re.compile(r"\b(?:ssn|social security|national|tax)\b", re.I),
}
_CONTEXT["local_phone"] = _CONTEXT["phone"]
_GAIN_CHECKSUM, _GAIN_CONTEXT = 0.4, 0.2


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if n % 2 == 0 else (d * 2 if d < 5 else d * 2 - 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, ``@`` and dotted domain, leftmost and without overlap, in linear time."""
    done, after = 0, 0
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            held = text[max(done, after) : at]
            size = len(held) - len(held.rstrip(_LOCAL))
            if size:
                yield at - size, domain.end()
                done = domain.end()
        after = at + 1
        at = text.find("@", max(after, done))


def _accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers that pass mod-97, without overlap, in linear time.

    A start may end where any of its groups ends: the registered length first, then the longest. What
    stands behind an account is looked at again, and so is everything behind a start that none fits.
    """
    at = 0
    while run := _IBAN.search(text, at):
        start, last = run.span()
        ends = []
        for m in _GROUP_END.finditer(text, start + _LEAST_ACCOUNT, min(last + 1, len(text))):
            account = text[start : m.end()].replace(" ", "")
            if m.end() <= last and len(account) >= _LEAST_ACCOUNT:
                ends.append((len(account) != _ACCOUNT.get(account[:2]), -m.end(), account))
        at = next((-end for _, end, account in sorted(ends) if mod97(account)), None)
        if at is None:
            at = start + 4
        else:
            yield start, at


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _proposed(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """``kind, start, end, checksum passed``; base spans only where their check holds."""
    for start, end in _emails(text):
        yield "email", start, end, False
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            yield "ip", *m.span(), False
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _DIGITS.sub("", m[0])) <= 19 and luhn(digits):
            yield "card", *m.span(), True
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
                yield "phone", *m.span(), False
    for start, end in _accounts(text):
        yield "iban", start, end, True
    for m in _NATIONAL.finditer(text):
        yield "national", *m.span(), False
    for m in _LOCAL_PHONE.finditer(text):
        yield "local_phone", *m.span(), False


def find(text: str | None) -> list[Span]:
    """All spans by start, then kind as listed; offsets are code points, ends exclusive."""
    found = []
    for kind, start, end, passed in _proposed(text or ""):
        score = _PRIOR[kind] + _GAIN_CHECKSUM * passed
        words = _CONTEXT[kind]
        if words.search(text[max(0, start - NEAR) : start]) or words.search(text[end : end + NEAR]):
            score += _GAIN_CONTEXT
        if kind in BASE or score >= LEAST_SCORE:
            found.append(Span(start, end, kind, min(1.0, round(score, 3))))
    order = {k: n for n, k in enumerate(KINDS)}
    return sorted(found, key=lambda s: (s.start, order[s.kind], s.end))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span, overlapping ones merged, replaced by ``[kind]`` of the first."""
    out, at, n = [], 0, 0
    while n < len(spans):
        start, end, kind = spans[n].start, spans[n].end, spans[n].kind
        n += 1
        while n < len(spans) and spans[n].start < end:
            end = max(end, spans[n].end)
            n += 1
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join(out) + text[at:]


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())])


def _spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        found = [[s._asdict() for s in find(x.as_py().decode("utf-8", "replace"))] for x in batch]
        yield pa.array(found, pa.list_(_SPAN))


def _redacted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        texts = [None if not x.is_valid else x.as_py().decode("utf-8", "replace") for x in batch]
        yield pa.array([x if x is None else redacted(x, find(x)) for x in texts], pa.string())


def span_column(text: str) -> Column:
    """Array of spans of a text column; a null text has none."""
    kind = "array<struct<start: bigint, end: bigint, kind: string, score: double>>"
    return arrow_udf(_spans, kind)(utf8(text))


def redacted_column(text: str) -> Column:
    """The text without its personal data; a null text stays null."""
    return arrow_udf(_redacted, "string")(F.col(text).cast("binary"))


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and its ``found`` spans (start, end, kind, score), one row per input row, no shuffle.

    Only ``key`` and ``text`` are read, so clashing names elsewhere do not matter. A null or empty text
    gives no spans; repeated rows and null keys give a row each; every pattern runs in time
    proportional to the text; an empty table gives an empty result.
    """
    return docs.select(F.col(key).alias("doc_id"), span_column(text).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, the checksum of the base spans, and all spans as text."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    counts = [number(k).alias(f"n_{k}") for k in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
        F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0)).alias("highest_score"),
    )
