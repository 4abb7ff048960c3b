"""Merkle fingerprints of documents over paragraphs and sections.

Leaves are paragraphs (up to and including a line feed). A paragraph over ``LONG`` characters is cut
after sentence ends, and a sentence that is still over it at places that its own characters choose,
so an edit moves no cut but those beside it. Sections are runs of leaves that end where a leaf's digest
says so, and the root hashes the sections' digests. Equal roots mean equal texts. In unequal trees,
equal sections are skipped as a whole and the differing branches lead to the leaves that were edited.

A fingerprint is ``root:leaves``: 32 hex digits, and 10 for each leaf. Section borders follow from the
leaves' digits, so the tree can be built again from it.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from planweave.llm.common import stored, utf8

LONG = 80
SECTION = 8  # leaves of a section on average
_DIGITS = 10
_ROOT = 33  # characters of a fingerprint before its leaves
_SENTENCE = re.compile(r"(?<=[.!?;:,] )")


def _own_cuts(text: str) -> list[str]:
    """Cut after characters that two neighbours choose, every 32 characters on average."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    mixed = (code[:-1] * np.uint64(31) + code[1:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(59)
    ends = (np.flatnonzero(mixed == 0) + 2).tolist()
    return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)]) if a < b]


def leaves(text: str) -> list[str]:
    """The text in pieces; joined again they are the text. An empty text has none."""
    out = []
    lines = text.split("\n")
    for n, line in enumerate(lines):
        line += "\n" if n < len(lines) - 1 else ""
        if len(line) <= LONG:
            out += [line] if line else []
            continue
        for sentence in _SENTENCE.split(line):
            out += _own_cuts(sentence) if len(sentence) > LONG else [sentence] if sentence else []
    return out


def _sections(digits: list[str]) -> list[tuple[str, ...]]:
    out, held = [], []
    for d in digits:
        held.append(d)
        if int(d, 16) % SECTION == 0:
            out.append(tuple(held))
            held = []
    return out + [tuple(held)] if held else out


def tree(text: str) -> tuple[str, list[int]]:
    """The fingerprint of a text, and where each of its leaves ends."""
    pieces = leaves(text)
    whole = [xxhash.xxh3_128_hexdigest(x.encode("utf-8", "replace")) for x in pieces]
    root, held = hashlib.sha256(), hashlib.sha256()
    for digest in whole:
        held.update(bytes.fromhex(digest))
        if int(digest[:_DIGITS], 16) % SECTION == 0:
            root.update(held.digest())
            held = hashlib.sha256()
    root.update(held.digest())
    return root.hexdigest()[:32] + ":" + "".join(d[:_DIGITS] for d in whole), list(accumulate(map(len, pieces)))


def fingerprint(text: str) -> str:
    return tree(text)[0]


def _digits(print_: str) -> list[str]:
    rest = print_.partition(":")[2]
    return [rest[k : k + _DIGITS] for k in range(0, len(rest), _DIGITS)]


def likeness(a: str, b: str) -> float:
    """Share of leaves, counted with repeats, that two trees have in common; 1 only for equal roots."""
    if a.partition(":")[0] == b.partition(":")[0]:
        return 1.0
    left, right = _digits(a), _digits(b)
    common = (Counter(left) & Counter(right)).total()
    return min(0.9999, 2 * common / (len(left) + len(right)))


def differing(a: str, b: str) -> tuple[range, range]:
    """The leaves of each tree between the first and the last difference; sections go first."""
    def ends_alike(x, y) -> tuple[int, int]:
        front = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        rest = min(len(x), len(y)) - front
        back = next((k for k in range(rest) if x[-1 - k] != y[-1 - k]), rest)
        return front, back

    left, right = _digits(a), _digits(b)
    one, two = _sections(left), _sections(right)
    front, back = ends_alike(one, two)
    start = sum(map(len, one[:front]))
    end = sum(map(len, one[len(one) - back :]))
    front, back = ends_alike(left[start : len(left) - end], right[start : len(right) - end])
    return range(start + front, len(left) - end - back), range(start + front, len(right) - end - back)


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the start of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def located(a: str, b: str, ends: list[int]) -> tuple[int | None, int | None]:
    """Code points of the first text in which the leaves differ, from the two trees; nulls for equal texts."""
    if a == b:
        return None, None
    own, _ = differing(a, b)
    return ends[own.start - 1] if own.start else 0, ends[own.stop - 1] if own.stop else 0


_FIELDS = (
    "doc_id {key}, n_chars bigint, edited_sha256 string, fingerprint string, edited_root string, same int, rest string,"
    " near_edited double, near_next double, edit_start bigint, edit_end bigint"
)
_INNER, _HEAD, _TAIL = 0, 1, 2


def _finished(key, text: str, own: str, ends: list[int], following: str, next_: str) -> tuple:
    """A row of results; the edited fingerprint as root, number of digits it begins with like ``own``, and rest."""
    changed = edited(text, following)
    other = fingerprint(changed)
    left, right = own[_ROOT:], other[_ROOT:]
    same = len(commonprefix((left, right)))
    return (
        key, len(text), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), own, other[: _ROOT - 1], same,
        right[same:], likeness(own, other), likeness(own, next_), *located(own, other, ends),
    )


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Texts in less space for the shuffle."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        yield pa.array([pack(x.as_py()) for x in batch], pa.binary())


def _neighbours(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Finished rows of documents whose next document is in this task, and the task's first and last."""
    part, held, none = TaskContext.get().partitionId(), None, (None,) * (len(schema) - 7)
    unpack = zstandard.ZstdDecompressor().decompress

    def edge(key, text: str, own: str, place: int) -> tuple:
        return (key, len(text), None, own, *none, part, place, text)

    for batch in batches:
        rows = []
        for key, data in zip(batch.column("doc_id").to_pylist(), batch.column("data")):
            text = unpack(data.as_py()).decode("utf-8", "replace")
            now = (key, text, *tree(text))
            if held is None:
                rows.append(edge(*now[:3], _HEAD))
            else:
                rows.append((*_finished(*held, text, now[2]), part, _INNER, None))
            held = now
        yield _table(rows, schema)
    if held is not None:
        yield _table([edge(*held[:3], _TAIL)], schema)


def document_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of every document, of its edited text, and their likenesses; one row per input row.

    Documents follow each other by descending ``key`` (null last), the last one by the first. Rows
    with equal keys follow by a hash of the text; equal rows are interchangeable. A null text is an
    empty one: its fingerprint has no leaves and equals that of the empty text. Only ``key`` and
    ``text`` are read. One document is its own follower; an empty table gives an empty result.

    ``edit_start`` and ``edit_end`` bound the code points of the document whose leaves differ from the edited
    text's, as the two trees tell (null for equal texts).

    Texts are shuffled once, compressed, by ranges of the key. A task finishes all documents but its last; the
    first and last document of each task are written with the results and joined afterwards.
    """
    rows = docs.select(F.col(key).alias("doc_id"), utf8(text).alias("data")).select(
        "doc_id", arrow_udf(_packed, "binary")("data").alias("data"), F.xxhash64("data").alias("_tie"),
        (F.monotonically_increasing_id() % 1024).alias("_spread"),
    )
    order = [F.col("doc_id").desc_nulls_last(), F.col("_tie"), F.col("_spread")]
    fields = _FIELDS.format(key=rows.schema["doc_id"].dataType.simpleString())
    ddl = f"{fields}, part int, place int, text string"
    schema, finished = (to_arrow_schema(StructType.fromDDL(d)) for d in (ddl, fields))
    made = stored(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "data")
        .mapInArrow(lambda batches: _neighbours(batches, schema), ddl)
    )
    inner = made.filter(F.col("place") == _INNER).select(*(f.name for f in finished))
    # One head and one tail per task; the numbers of the tasks alone stand in this window.
    heads = made.filter(F.col("place") == _HEAD)
    tasks = heads.select("part").withColumn(
        "next", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy()))
    )
    last = (
        made.filter(F.col("place") == _TAIL).join(tasks, "part")
        .join(heads.select(F.col("part").alias("next"), F.col("text").alias("after"), F.col("fingerprint").alias("after_print")), "next")
        .select("doc_id", "text", "after", "after_print")
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield _table([_finished(k, t, *tree(t), after, print_) for k, t, after, print_ in rows], finished)

    every = inner.unionByName(last.mapInArrow(finish, fields))
    other = F.concat("edited_root", F.lit(":"), F.substring("fingerprint", _ROOT + 1, F.col("same")), "rest")
    return every.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", other.alias("edited_fingerprint"), "near_edited", "near_next",
        "edit_start", "edit_end",
    )
