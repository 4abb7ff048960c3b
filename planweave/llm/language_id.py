"""Language identification with interpolated Kneser-Ney character models.

Per language one model of order 4. A text is lower-cased; letters and marks become symbols of 11 bits
(the first 1,536 code points as they are, the rest hashed to 512 symbols), everything else a single
space. Four symbols are one 44-bit key, and a model's keys stand in sorted arrays, looked up by binary
search. The prediction is the language of the lowest cross-entropy per symbol; a text whose
cross-entropy is far outside of what calibration documents of that language show is rejected.

Counts cover all training documents. What is broadcast is the models with all their grams, 16 bytes
each; it grows with the distinct grams of the input, and so do the driver and every Python worker.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from planweave.llm.common import materialize, slices, utf8

ORDER = 4
BITS = 11
SYMBOLS = 1 << BITS
#: A text is rejected beyond so many times the deviation that all but ``BEYOND`` of the calibration's documents
#: keep within, if its cross-entropy is also beyond so many times the language's mean: repetitive or very short texts stay.
SLACK, FAR, BEYOND = 1.5, 2.0, 0.002
#: Symbols that count at most for the width of the deviation, and for the score.
_WIDE, _SCORE_SYMBOLS = 2_000, 20
_SLICE = 1 << 20  # bytes of texts scored at once
_PIECE = 1 << 21  # characters taken at once; a longer text is the sum of its pieces
_DOC_BITS = 64 - ORDER * BITS
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each code point (0: none), and whether it is a letter."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    letter = np.array([k == "L" for k in kinds])
    code = np.arange(0x110000, dtype=np.uint64)
    hashed = SYMBOLS - 512 + (code * np.uint64(2654435761) >> np.uint64(16)) % np.uint64(512)
    symbol = np.where(code < SYMBOLS - 512, code, hashed)
    symbol[~(letter | np.array([k == "M" for k in kinds]))] = 0
    return symbol.astype(np.uint16), letter


def grams(text: str) -> np.ndarray:
    """The packed 4-grams of a text; none if it has no letter."""
    symbol, letter = _tables()
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    if not letter[code].any():
        return np.empty(0, np.uint64)
    signs = symbol[code]
    signs = signs[(signs > 0) | np.append(True, signs[:-1] > 0)].astype(np.uint64)
    signs = np.concatenate((np.zeros(ORDER - 1, np.uint64), signs, np.zeros(1, np.uint64)))
    packed = np.zeros(len(signs) - ORDER + 1, np.uint64)
    for k in range(ORDER):
        packed = packed << np.uint64(BITS) | signs[k : k + len(packed)]
    return packed


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (gram, text) pairs of a list: gram, number of the text, count; symbols per text."""
    keys, total = [], np.zeros(len(texts), np.int64)
    for n, text in enumerate(texts):
        for at in range(0, max(1, len(text)), _PIECE):
            found = grams(text[at : at + _PIECE])
            total[n] += len(found)
            keys.append(found << np.uint64(_DOC_BITS) | np.uint64(n))
    keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    times = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return keys >> np.uint64(_DOC_BITS), (keys & np.uint64((1 << _DOC_BITS) - 1)).astype(np.int64), times, total


class Model:
    """Interpolated Kneser-Ney of one language from gram counts, continuation counts below the top."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = [np.empty(0, np.uint64)]
        self.logs: list[np.ndarray] = [np.empty(0)]
        self.contexts: list[np.ndarray] = [np.empty(0, np.uint64)]
        self.shares: list[np.ndarray] = [np.empty(0)]

    def add_order(self, keys, counts, contexts, totals, kinds, discount: float) -> None:
        """The next higher order: grams with counts, contexts with total count and distinct followers."""
        k, order = len(self.keys), np.argsort(contexts)
        contexts, totals, kinds = contexts[order], totals[order], kinds[order]
        self.contexts.append(contexts)
        self.shares.append(np.log(discount * kinds / totals))
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        at = np.searchsorted(contexts, keys >> np.uint64(BITS))
        below = np.exp(self.log(keys & np.uint64((1 << BITS * (k - 1)) - 1), k - 1))
        chance = (np.maximum(counts - discount, 0) + discount * kinds[at] * below) / totals[at]
        self.keys.append(keys)
        self.logs.append(np.log(chance))

    def log(self, wanted: np.ndarray, k: int) -> np.ndarray:
        """Log probability of the last symbol of k-grams after the others."""
        if k == 0:
            return np.full(len(wanted), -np.log(SYMBOLS))
        hit, at = _look(self.keys[k], wanted)
        out = np.empty(len(wanted))
        out[hit] = self.logs[k][at[hit]]
        missing = wanted[~hit]
        if len(missing):
            known, where = _look(self.contexts[k], missing >> np.uint64(BITS))
            share = np.zeros(len(missing))
            share[known] = self.shares[k][where[known]]
            out[~hit] = share + self.log(missing & np.uint64((1 << BITS * (k - 1)) - 1), k - 1)
        return out


def _look(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool), at


class Identifier:
    """Models of all languages with the calibrated rejection."""

    def __init__(self, models: dict[str, Model]):
        self.models = dict(sorted(models.items()))
        self.names = [*self.models]
        self.usual: dict[str, tuple[float, float]] = {}  # language: mean, wide deviation

    def entropies(self, texts: list[str], names: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol of each text and language (all, or ``names``), and the symbols of each text."""
        names = self.names if names is None else names
        gram, doc, times, total = counted(texts)
        first = np.append(True, gram[1:] != gram[:-1]) if len(gram) else np.empty(0, bool)
        which, distinct = np.cumsum(first) - 1, gram[first]
        out = np.zeros((len(texts), len(names)))
        for n, name in enumerate(names):
            logs = self.models[name].log(distinct, ORDER)
            out[:, n] = -np.bincount(doc, times * logs[which], len(texts)) / np.maximum(total, 1)
        return out, total

    def deviation(self, name: str, entropy: float, symbols: int) -> float:
        return (entropy - self.usual[name][0]) * np.sqrt(min(symbols, _WIDE))

    def predict(self, texts: list[str]) -> list[dict]:
        entropy, total = self.entropies(texts)
        out = []
        for row, symbols in zip(entropy, total):
            if not symbols or not self.names:
                out.append({"lang": UNKNOWN, "score": 0.0, "entropy": None, "rejected": True})
                continue
            best = int(np.argmin(row))
            share = np.exp(-(row - row[best]) * min(symbols, _SCORE_SYMBOLS))
            name = self.names[best]
            far = name in self.usual and row[best] > FAR * self.usual[name][0] and (
                self.deviation(name, row[best], symbols) > SLACK * self.usual[name][1]
            )
            out.append({
                "lang": name, "score": float(1 / share.sum()), "entropy": float(row[best]), "rejected": bool(far),
            })
        return out


def held_out(key: str) -> Column:
    """Documents that no model learns from; a document without a key is in neither part."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "data", 2 * _SLICE):
        parts = list(zip(batch.column("lang").to_pylist(), batch.column("apart").to_pylist()))
        texts = [x.as_py().decode("utf-8", "replace") for x in batch.column("data")]
        for part in sorted(set(parts)):
            gram, _, times, _ = counted([t for t, p in zip(texts, parts) if p == part])
            first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.empty(0, np.int64)
            total = np.add.reduceat(times, first) if len(gram) else times
            yield pa.record_batch(
                [pa.array([part[0]] * len(first), pa.string()), pa.array(gram[first].astype(np.int64)), pa.array(total),
                 pa.array(total * (not part[1]))],
                ["lang", "gram", "n", "inside"],
            )


def _left_out(key: str) -> Column:
    """Taught documents that the calibration leaves out of its counts, a fifth of them."""
    return F.floor(F.crc32(F.col(key).cast("string").cast("binary")) / 5) % 5 == 0


def _models(level: DataFrame) -> dict[str, Model]:
    """One model per language from its grams of the highest order, all orders collected."""
    found: dict[str, list] = {}
    for k in range(ORDER, 0, -1):
        contexts = level.groupBy("lang", F.shiftright("gram", BITS).alias("context")).agg(
            F.sum("n").alias("total"), F.count("*").alias("kinds")
        )
        once = {
            r.lang: r.a / max(1, r.a + 2 * r.b)
            for r in level.groupBy("lang").agg(
                F.count_if(F.col("n") == 1).alias("a"), F.count_if(F.col("n") == 2).alias("b")
            ).collect()
        }
        grams_, contexts_ = level.select("lang", "gram", "n").toArrow(), contexts.toArrow()
        for name in once:
            rows, at = (t.filter(pc.equal(t["lang"], name)) for t in (grams_, contexts_))
            found.setdefault(name, []).append((
                rows["gram"].to_numpy().astype(np.uint64), rows["n"].to_numpy().astype(float),
                at["context"].to_numpy().astype(np.uint64), at["total"].to_numpy().astype(float),
                at["kinds"].to_numpy().astype(float), min(0.95, max(0.05, once[name])),
            ))
        level = level.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1)).alias("gram")).agg(
            F.count("*").alias("n")
        )
    models = {}
    for name, orders in found.items():
        models[name] = Model()
        for order in reversed(orders):
            models[name].add_order(*order)
    return models


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Identifier:
    """Models and calibration from the labelled documents that are not held out.

    The models keep all grams of all these documents. The rejection is calibrated with models of four
    fifths of them on the other fifth, whose entropies are those of texts that were not learned.
    """
    taught = docs.filter(F.col(lang).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).select(
        F.col(lang).cast("string").alias("lang"), utf8(text).alias("data"), _left_out(key).alias("apart")
    )
    level = materialize(
        taught.mapInArrow(_gram_rows, "lang string, gram bigint, n bigint, inside bigint")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside"))
    )
    inside = level.filter(F.col("inside") > 0).select("lang", "gram", F.col("inside").alias("n"))
    usual = _usual(Identifier(_models(inside)), taught.filter("apart"))
    made = Identifier(_models(level.select("lang", "gram", "n")))
    made.usual = _for_all(usual, made.names)
    return made


def _for_all(usual: dict[str, tuple[float, float]], names: list[str]) -> dict[str, tuple[float, float]]:
    """A language without calibrated texts takes the highest mean and the widest deviation of the others."""
    if not usual:
        return {}
    widest = tuple(max(x[k] for x in usual.values()) for k in (0, 1))
    return {name: usual.get(name, widest) for name in names}


def _usual(made: Identifier, apart: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and wide deviation of each language's own documents among those that were left out.

    Wide is what all but ``BEYOND`` of the documents keep within, so that single documents with a wrong
    label do not set the limit. The documents are scored where they are; the driver gets one row per language.
    """
    if not made.names:
        return {}
    held = apart.sparkSession.sparkContext.broadcast(made)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "data", _SLICE):
            names = batch.column("lang").to_pylist()
            texts = [x.as_py().decode("utf-8", "replace") for x in batch.column("data")]
            for name in sorted(set(names)):
                if name in held.value.models:
                    entropy, symbols = held.value.entropies([t for t, n in zip(texts, names) if n == name], [name])
                    some = symbols > 0
                    columns = [pa.array([name] * int(some.sum()), pa.string()), pa.array(entropy[some, 0]), pa.array(symbols[some])]
                    yield pa.record_batch(columns, ["lang", "entropy", "symbols"])

    seen = materialize(apart.select("lang", "data").mapInArrow(own, "lang string, entropy double, symbols bigint"))
    means = seen.groupBy("lang").agg((F.sum(F.col("entropy") * F.col("symbols")) / F.sum("symbols")).alias("mean"))
    deviation = (F.col("entropy") - F.col("mean")) * F.sqrt(F.least("symbols", F.lit(_WIDE)))
    wide = seen.join(F.broadcast(means), "lang").groupBy("lang", "mean").agg(
        F.percentile_approx(deviation, 1 - BEYOND, 10_000).alias("wide")
    )
    return {r["lang"]: (r["mean"], max(r["wide"], 1.0)) for r in wide.collect()}


def prediction_column(spark, made: Identifier, text: str) -> Column:
    """Struct of lang, score, entropy and rejected for a text column."""
    held = spark.sparkContext.broadcast(made)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("rejected", pa.bool_())])

    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out: list[dict] = []
            for part in slices([pa.record_batch([batch], ["data"])], "data", _SLICE):
                out += held.value.predict([x.as_py().decode("utf-8", "replace") for x in part.column("data")])
            yield pa.array(out, kind)

    return arrow_udf(predicted, "struct<lang: string, score: double, entropy: double, rejected: boolean>")(utf8(text))


def identify(docs: DataFrame, made: Identifier | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, entropy, rejected`` of every row.

    Predictions come from the text alone. A null text, or one without a letter, is ``und`` with score
    0 and rejected, and so is every text if no document is labelled. Ties go to the first language by
    name. Repeated rows each get a row; they also count as often in training. An empty table gives an
    empty result. Other columns are not read.
    """
    made = made or train(docs, key, text, lang)
    found = docs.select(
        F.col(key).alias("doc_id"), held_out(key).alias("held_out"),
        prediction_column(docs.sparkSession, made, text).alias("p"),
    )
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.entropy", "p.rejected")
