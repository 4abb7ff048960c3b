"""Benchmark decontamination by edit distance.

A document is contaminated by an item when some stretch of it is within ``MOST_EDITS`` of the item's
length in edit distance, after case, punctuation and spacing are evened out. Candidates come from the
CGK embedding, a random walk that maps edit distance to Hamming distance: step j reads one character
and moves on by a random bit of (j, character), so two similar windows soon read the same characters
again after an edit. Windows start at every word of documents and items (at every character of scripts
written without spaces), and repeated bit-sampling LSH compares sampled steps of their walks. A walk goes
on for as long as the items' sizes ask (``LEVELS``): the longer an item, the more windows it has, and the
more of its window a walk has to share. A window leaves a walk as soon as no item's walk begins like it.
Candidates pass a lower bound of their distance, computed for many at once, and are then verified exactly,
on code points, by bit-parallel edit distance.

A walk over a whole item-sized window would be hit by nearly every edit: at a fifth of the characters no
sampled walk of 100 characters survives. The stretch that a walk covers and the number of repeats are
therefore chosen from the wanted recall of nine tenths at the limit of a fifth (measured in the tests for
every size). Items under ``SHORT`` characters have too few windows for that; they are found exactly, by
pieces: of k + 1 disjoint pieces of an item one is left whole by k edits. Their spaces on both sides
belong to them, so that short words are not found inside others.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from planweave.llm.common import slices, utf8

MOST_EDITS = 0.2
REPEATS = 6
#: Items from this size on are looked for by walks, shorter ones by pieces.
SHORT = 40
#: Least size of item, steps of its walks, and how many of the steps are sampled; each goes on from the one before.
LEVELS = ((SHORT, 18, 9), (72, 26, 13), (160, 36, 17))
#: Steps after which windows that no item's walk begins like are left out.
CHECKS = (8, 13, 18, 26, 36)
SEED = 7
#: Characters of benchmark items that one pass over the documents looks for; more items, more passes.
#: A pass broadcasts about 16 bytes for each repeat and word of its items: 70 MB at most.
ITEM_CHARACTERS = 2_000_000
#: A walk may begin so many characters beside the place that an alignment gives it.
_MARGIN = 4
_SPACE = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: a byte for the walks, the evened code point, and whether it starts a window itself.

    Anything but letters, marks and digits is a space; case is evened; bytes above 127 may be shared.
    """
    byte, code = np.full(0x110000, _SPACE, np.uint8), np.full(0x110000, _SPACE, np.uint32)
    dense = np.zeros(0x110000, bool)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] in "LMN":
            low = chr(c).lower()
            low = ord(low) if len(low) == 1 else c
            code[c] = low
            byte[c] = low if low < 256 else 128 + (low * 2654435761 >> 16) % 96
            dense[c] = kind in ("Lo", "Nl") and c >= 0x0E00 and not 0xAC00 <= c <= 0xD7A3
    return byte, code, dense


class Evened:
    """A text with single spaces: bytes for the walks, evened code points, and the places they came from."""

    def __init__(self, text: str):
        byte, code, dense = _tables()
        raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        symbols = byte[raw]
        kept = np.flatnonzero((symbols != _SPACE) | np.append(False, symbols[:-1] != _SPACE))
        if len(kept) and symbols[kept[-1]] == _SPACE:
            kept = kept[:-1]
        self.symbols, self.places = symbols[kept], kept
        self.codes, self._dense = code[raw[kept]], dense

    def starts(self) -> np.ndarray:
        """Where windows start: at words, and at every character of scripts without spaces."""
        first = (self.symbols != _SPACE) & np.append(True, self.symbols[:-1] == _SPACE)
        return np.flatnonzero(first | self._dense[self.codes])

    def bordered(self) -> tuple[int, int]:
        """Whether a space belongs to the text on either side: not beside scripts without spaces."""
        return (int(not self._dense[self.codes[0]]), int(not self._dense[self.codes[-1]])) if len(self.codes) else (0, 0)


def evened(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text with single spaces, and the code point that each came from."""
    made = Evened(text)
    return made.symbols, made.places


@lru_cache(maxsize=1)
def _walks() -> list[tuple[np.ndarray, np.ndarray]]:
    """For each repeat the bits of (step, symbol), and which steps are sampled."""
    random, out = np.random.default_rng(SEED), []
    for _ in range(REPEATS):
        bits = random.integers(0, 2, (LEVELS[-1][1], 256)).astype(np.int32)
        sampled, at, number = np.zeros(LEVELS[-1][1], bool), 0, 0
        for _, steps, most in LEVELS:
            sampled[at + random.choice(steps - at, most - number, replace=False)] = True
            at, number = steps, most
        out.append((bits, sampled))
    return out


def walk_keys(symbols: np.ndarray, starts: np.ndarray, repeat: int, known=None) -> Iterator[tuple]:
    """Keys of the walks from ``starts``: (steps so far, numbers of the starts, keys, last position read).

    Given after each of ``CHECKS``. ``known(steps, keys)`` may say which walks go on. ``symbols`` must go on
    for as many symbols as a walk has steps after the last start.
    """
    bits, sampled = _walks()[repeat]
    at, key, which = starts.astype(np.int32), np.zeros(len(starts), np.uint64), np.arange(len(starts))
    read = at
    for j in range(LEVELS[-1][1]):
        seen = symbols.take(at)
        if sampled[j]:
            key *= _STEP
            key ^= seen
            read = at.copy() if known is None else at
        at = at + bits[j].take(seen)
        if j + 1 in CHECKS:
            mixed = (key ^ key >> np.uint64(29)) * _MIX
            if known is not None:
                on = known(j + 1, mixed)
                which, at, key, mixed, read = which[on], at[on], key[on], mixed[on], read[on]
            yield j + 1, which, mixed, read


def edits(item: Sequence[int], text: Sequence[int], masks: dict[int, int] | None = None) -> tuple[int, int]:
    """Least edit distance of the item to any stretch of the text, and where the first such ends."""
    size = len(item)
    masks = symbol_masks(item) if masks is None else masks
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, now, best, end = full, 0, size, size, 0
    for n, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        x = eq | minus
        zero = (((x & plus) + plus) ^ plus) | x
        up = minus | (full & ~(zero | plus))
        down = zero & plus
        if up & top:
            now += 1
        elif down & top:
            now -= 1
        up, down = up << 1, down << 1
        plus = (down | ~(zero | up)) & full
        minus = zero & up & full
        if now < best:
            best, end = now, n
            if not best:
                break
    return best, end


def symbol_masks(item: Sequence[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for n, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << n
    return out


def _rolled(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` code points that follow each other."""
    out = np.zeros(max(0, len(codes) - size + 1), np.uint64)
    for k in range(size):
        out = out * _STEP + codes[k : k + len(out)]
    return (out ^ out >> np.uint64(29)) * _MIX


class Parts:
    """Items cut into parts of at most 64 characters, for a lower bound of many distances at once.

    The least edits of an item in a stretch are at least the sum of the least edits of its parts, each in its
    own neighbourhood, and a part fits one machine word of the recurrence of ``edits``. Characters are told
    apart by five bits only, which lowers the bound a little and loses nothing.
    """

    def __init__(self, items: list[np.ndarray], limits: list[int]):
        self.limit = np.array(limits, np.int64)
        count = [-(-len(x) // 64) for x in items]
        self.count = np.array(count, np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.at, self.size = np.zeros(sum(count), np.int64), np.zeros(sum(count), np.int64)
        self.table = np.zeros((sum(count), 32), np.uint64)
        for n, item in enumerate(items):
            cuts = np.linspace(0, len(item), count[n] + 1).astype(int).tolist()
            for row, (a, b) in enumerate(zip(cuts, cuts[1:]), int(self.first[n])):
                self.at[row], self.size[row] = a, b - a
                bits = np.uint64(1) << np.arange(b - a, dtype=np.uint64)
                np.bitwise_or.at(self.table[row], item[a:b] & 31, bits)

    def within(self, symbols: np.ndarray, starts: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Which stretches (start of the item, item) may hold the item within its limit."""
        times = self.count[items]
        of = np.repeat(np.arange(len(items)), times)
        row = self.first[items][of] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
        limit = self.limit[items][of]
        steps = self.size[row] + 2 * limit + 2 * _MARGIN
        begin = starts[of] + self.at[row] - limit - _MARGIN
        least = np.zeros(len(of), np.int64)
        order = np.argsort(steps, kind="stable")
        for part in np.array_split(order, max(1, min(8, len(order) // 512))):
            if len(part):
                least[part] = self._least(symbols, begin[part], row[part], int(steps[part[-1]]))
        return np.bincount(of, least, len(items)) <= self.limit[items]

    def _least(self, symbols: np.ndarray, begin: np.ndarray, row: np.ndarray, steps: int) -> np.ndarray:
        table, base, one = self.table.reshape(-1), row * 32, np.uint64(1)
        top = (self.size[row] - 1).astype(np.uint64)
        plus, minus = np.full(len(row), ~np.uint64(0)), np.zeros(len(row), np.uint64)
        now = self.size[row].astype(np.int64)
        best = now.copy()
        for j in range(steps):
            eq = table.take(base + (symbols.take(begin + j, mode="clip") & 31))
            x = eq | minus
            zero = (((x & plus) + plus) ^ plus) | x
            up, down = minus | ~(zero | plus), zero & plus
            now += (up >> top & one).view(np.int64)
            now -= (down >> top & one).view(np.int64)
            up, down = up << one, down << one
            plus, minus = down | ~(zero | up), zero & up
            np.minimum(best, now, out=best)
        return best


class Lookup:
    """Sorted keys with what they stand for, behind a table of bits of the keys."""

    def __init__(self, keys: list, values: list):
        key = np.array(keys, np.uint64)
        order = np.argsort(key, kind="stable")
        self.keys, self.values = key[order], np.array(values, np.int32).reshape(len(key), -1)[order]
        self._bits = np.uint64(64 - max(12, int(len(key) * 32).bit_length()))
        self._there = np.zeros(1 << int(np.uint64(64) - self._bits), bool)
        self._there[(key >> self._bits).astype(np.int64)] = True

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be there."""
        return self._there.take((keys >> self._bits).view(np.int64))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the keys that are there, once for each value, and the values."""
        first, last = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        times = last - first
        rows = np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(np.arange(len(keys)), times), self.values[rows]


class Items:
    """Benchmark items of one pass, with the sorted LSH keys of their windows and the pieces of short ones."""

    def __init__(self, items: list[tuple]):
        self.ids, self.symbols, self.codes, self.masks, self.border = [], [], [], [], []
        whole, limits = [], []
        keys = [{c: ([], []) for c in CHECKS} for _ in range(REPEATS)]
        ends = [{c: ([], []) for c in CHECKS} for _ in range(REPEATS)]
        pieces: dict[int, tuple[list, list]] = {}
        for name, text in items:
            made = Evened(text or "")
            size = len(made.symbols)
            if not size:
                continue
            n = len(self.ids)
            self.ids.append(name)
            self.symbols.append(made.symbols.tobytes())
            short = size < SHORT
            border = made.bordered() if short else (0, 0)
            codes = np.concatenate((np.full(border[0], _SPACE), made.codes, np.full(border[1], _SPACE))).astype(np.uint32)
            self.border.append(border)
            self.codes.append(codes)
            self.masks.append(symbol_masks(codes.tolist()))
            edge = [np.full(k, _SPACE, np.uint8) for k in border]
            whole.append(np.concatenate((edge[0], made.symbols, edge[1])))
            limits.append(int(MOST_EDITS * size))
            if short:
                cuts = np.linspace(0, len(codes), int(MOST_EDITS * size) + 2).astype(int)
                for a, b in zip(cuts, cuts[1:]):
                    held = pieces.setdefault(b - a, ([], []))
                    held[0].append(_rolled(codes[a:b], b - a)[0])
                    held[1].append((n, a))
                continue
            steps = max(t for least, t, _ in LEVELS if size >= least)
            padded, starts = np.concatenate((made.symbols, np.zeros(LEVELS[-1][1] + 1, np.uint8))), made.starts()
            for repeat in range(REPEATS):
                for check, which, key, read in walk_keys(padded, starts, repeat):
                    if check > steps:
                        break
                    fits = read < size
                    held = (keys if check == steps else ends)[repeat][check]
                    held[0].extend(key[fits].tolist())
                    held[1].extend((n, s) for s in starts[which[fits]].tolist())
        self.parts = Parts(whole, limits)
        self.final = [{c: Lookup(*held) for c, held in of.items() if held[0]} for of in keys]
        # Beginnings of the walks that go on after a check, those that end later included.
        self.begun = [{c: Lookup(held[0], [()] * len(held[0])) for c, held in of.items() if held[0]} for of in ends]
        self.pieces = {size: Lookup(*held) for size, held in pieces.items()}

    def _walked(self, symbols: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Windows that share a walk with an item's: (position, item, place in the item)."""
        for repeat in range(REPEATS):
            final, begun = self.final[repeat], self.begun[repeat]
            if not final:
                continue

            def known(check: int, keys: np.ndarray) -> np.ndarray:
                there = [of[check].maybe(keys) for of in (begun, final) if check in of]
                return np.flatnonzero(there[0] | there[-1]) if there else np.empty(0, np.int64)

            for check, which, keys, _ in walk_keys(symbols, starts, repeat, known):
                if check in final and len(which):
                    n, found = final[check].find(keys)
                    yield starts[which[n]], found[:, 0], found[:, 1]
                if not len(which):
                    break

    def _pieced(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places that share a piece with a short item, moved off the space before it."""
        for size, lookup in self.pieces.items():
            keys = _rolled(codes, size)
            at = np.flatnonzero(lookup.maybe(keys))
            n, found = lookup.find(keys[at])
            off = (found[:, 1] == 0) & (size > 1)
            yield at[n] + off, found[:, 0], found[:, 1] + off

    def matches(self, texts: list[str]) -> list[list[dict]]:
        """For each text the best match of every item in it: item, edits, start and end (code points)."""
        made = [Evened(t) for t in texts]
        # Each text between spaces, with a symbol of no item behind it.
        edge, wall = np.full(1, _SPACE, np.uint8), np.full(1, 0, np.uint8)
        tail = np.zeros(LEVELS[-1][1] + 1, np.uint8)
        sizes = np.array([len(x.symbols) + 3 for x in made], np.int64)
        begins = np.cumsum(sizes) - sizes + 1
        whole = np.concatenate([*(x for m in made for x in (edge, m.symbols, edge, wall)), tail])
        starts = np.concatenate([m.starts() + b for m, b in zip(made, begins)]) if made else np.empty(0, np.int64)
        found = [*self._walked(whole, starts)]
        if self.pieces:
            codes = np.concatenate([*(x for m in made for x in (edge, m.codes, edge, wall)), tail]).astype(np.uint32)
            found += self._pieced(codes)
        out: list[list[dict]] = [[] for _ in texts]
        if not found:
            return out
        at, item, place = (np.concatenate(x).astype(np.int64) for x in zip(*found))
        doc = np.searchsorted(begins, at, "right") - 1
        rows = np.unique(np.stack((doc, item, at - place), axis=1), axis=0)
        rows = rows[self.parts.within(whole, rows[:, 2], rows[:, 1])].tolist()
        best: dict[tuple[int, int], tuple] = {}
        k = 0
        while k < len(rows):
            d, n, start = rows[k]
            limit, last = int(self.parts.limit[n]), k
            # Starts that lie close together are one stretch.
            while last + 1 < len(rows) and rows[last + 1][:2] == [d, n] and rows[last + 1][2] <= start + limit + _MARGIN:
                last += 1
            start, until = (x - int(begins[d]) + self.border[n][0] for x in (start, rows[last][2]))
            low = max(0, start - limit - _MARGIN)
            high = min(len(made[d].symbols), until + len(self.symbols[n]) + 2 * limit + _MARGIN)
            match = self._verified(made[d], n, low, max(low, high), limit)
            if match and match[:2] < best.get((d, n), (len(self.symbols[n]) + 1, 0))[:2]:
                best[d, n] = match
            k = last + 1
        for (d, n), (fewest, _, start, end) in sorted(best.items()):
            places = made[d].places
            out[d].append({
                "item": n, "edits": fewest, "start": int(places[start]), "end": int(places[end - 1]) + 1,
                "similarity": 1 - fewest / len(self.symbols[n]),
            })
        return out

    def _verified(self, text: Evened, n: int, low: int, high: int, limit: int) -> tuple | None:
        """Fewest edits of item ``n`` in a stretch of a text, where the stretch and the match lie; None over the limit."""
        before, after = self.border[n]
        inner = text.codes[max(0, low - before) : high + after].tolist()
        codes = [_SPACE] * (before and low == 0) + inner + [_SPACE] * (after and high == len(text.codes))
        item = self.codes[n].tolist()
        fewest, end = edits(item, codes, self.masks[n])
        if fewest > limit:
            return None
        start = end - edits(item[::-1], codes[:end][::-1])[1]
        start, end = max(0, low + start), min(len(text.codes), low + end - before - after)
        return (fewest, low, start, end) if start < end else None


_MATCH = pa.struct([
    ("item", pa.int64()), ("edits", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("similarity", pa.float64()),
])


def _matcher(held):
    """A function from the name of a text column to its matches with the broadcast items."""

    def matched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out: list = []
            for part in slices([pa.record_batch([batch], ["data"])], "data", 1 << 20):
                out += held.value.matches([x.as_py().decode("utf-8", "replace") for x in part.column("data")])
            yield pa.array(out, pa.list_(_MATCH))

    def column(name: str) -> Column:
        kind = "array<struct<item: bigint, edits: bigint, start: bigint, end: bigint, similarity: double>>"
        return arrow_udf(matched, kind)(utf8(name))

    return column


def match_columns(items: DataFrame, key: str = "item_id", text: str = "text", most: int = ITEM_CHARACTERS):
    """For each pass, the items it looks for and a function from a text column's name to its matches.

    A pass holds about ``most`` characters of items, dealt by hash. Null and empty items match nothing.
    """
    spark = items.sparkSession
    rows = items.filter(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    passes = max(1, -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // most))
    for n in range(passes):
        block = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == n)
        made = Items([tuple(r) for r in block.collect()])
        held = spark.sparkContext.broadcast(made)

        yield made.ids, _matcher(held)


def contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``doc_id, item_id, edits, similarity, start, end``: the best match of each item in each document.

    Clean documents have no row. Offsets are code points of the document. Null and empty documents or
    items match nothing, repeated rows each get their rows, and empty tables give an empty result.
    Documents are read once a pass and never shuffled; other columns are not read.
    """
    out = None
    for ids, column in match_columns(items, item_key, item_text):
        names = docs.sparkSession.createDataFrame(
            [(n, x) for n, x in enumerate(ids)], f"item bigint, item_id {items.schema[item_key].dataType.simpleString()}"
        )
        found = docs.select(F.col(key).alias("doc_id"), F.explode(column(text)).alias("m")).select("doc_id", "m.*")
        found = found.join(names, "item").select("doc_id", "item_id", "edits", "similarity", "start", "end")
        out = found if out is None else out.unionByName(found)
    return out
