"""Token counts per section: whole documents are encoded once, and tokens are given to sections.

A section is a paragraph: a stretch of text up to and including a line feed. Token spans and section
spans, both in bytes of the one encoded text, are joined as intervals; a token that crosses a border
goes to one section by an explicit rule, so the sections of a document add up to its tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from planweave.llm.common import utf8
from planweave.llm.tokens import worker_ids

#: ``start``: the section of a token's first byte. ``most``: the section with most of its bytes, the
#: earliest on ties.
RULES = ("start", "most")
_ROWS_AT_ONCE = 20_000


def section_starts(data: bytes) -> np.ndarray:
    """Byte offsets where sections begin; an empty text is one empty section."""
    after = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return np.concatenate(([0], after[after < len(data)]))


def attribute(starts: np.ndarray, total: int, lengths: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens given to each section, and tokens of it that cross its end.

    ``starts`` are the section starts, ``total`` the end of the last, ``lengths`` the tokens' bytes.
    """
    ends = np.cumsum(lengths)
    first = np.searchsorted(starts, ends - lengths, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    crossing = np.flatnonzero(last > first)
    owner = first.copy()
    if rule == "most":
        limits = np.append(starts, total)
        for k in crossing:
            a, b = ends[k] - lengths[k], ends[k]
            held = [min(b, limits[s + 1]) - max(a, limits[s]) for s in range(first[k], last[k] + 1)]
            owner[k] = first[k] + int(np.argmax(held))
    n = len(starts)
    return np.bincount(owner, minlength=n), np.bincount(first[crossing], minlength=n)


def _counted(batches: Iterator[pa.RecordBatch], schema: pa.Schema, rule: str) -> Iterator[pa.RecordBatch]:
    encode = worker_ids()

    def table(held: list) -> pa.RecordBatch:
        keys, sizes, *columns = zip(*held)
        repeated = pa.array(np.repeat(np.arange(len(keys)), sizes))
        made = [pa.array(keys, schema[0].type).take(repeated)]
        return pa.record_batch(made + [pa.array(np.concatenate(c)) for c in columns], schema=schema)

    for batch in batches:
        held, rows = [], 0
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = data.as_py()
            text = data.decode("utf-8", "replace")
            data = text.encode()
            lengths = encode.lengths[encode.of(text)]
            starts = section_starts(data)
            tokens, crossing = attribute(starts, len(data), lengths, rule)
            heads = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) if data else np.zeros(1, int)
            ends = heads[np.append(starts[1:], len(data)) - 1] if data else heads
            begins = np.append(0, ends[:-1])
            n = len(starts)
            held.append((key, n, np.arange(n), begins, ends, tokens, crossing, np.full(n, len(lengths))))
            rows += n
            if rows > _ROWS_AT_ONCE:
                yield table(held)
                held, rows = [], 0
        if held:
            yield table(held)


def token_counts(docs: DataFrame, rule: str = "most", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, section, start, end, n_tokens, n_crossing, doc_tokens``: one row per section.

    ``start`` and ``end`` are code points; ``n_crossing`` counts tokens that begin in the section and
    end in a later one. Only ``key`` and ``text`` are read, in one pass without a shuffle. A null or
    empty text is one empty section with no tokens; repeated rows each get their own sections; an
    empty table gives an empty result.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    rows = docs.select(F.col(key).alias("doc_id"), utf8(text).alias("data"))
    ddl = (
        f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, section bigint, start bigint, end bigint,"
        " n_tokens bigint, n_crossing bigint, doc_tokens bigint"
    )
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return rows.mapInArrow(lambda batches: _counted(batches, schema, rule), ddl)
