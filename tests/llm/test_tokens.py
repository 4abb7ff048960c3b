import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from planweave.llm.packing import Packer, pack
from planweave.llm.token_counts import attribute, section_starts, token_counts
from planweave.llm.tokens import Ids


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_the_tokenizers(plain):
    rng, ids = random.Random(1), Ids()
    odd = ["", " ", "a  b", "<|endoftext|> x", "日本 😀", "x" * 5000, "I'm  12 3.4\r\n"]
    odd += ["".join(rng.choice(" \n\tab1.'s  \x1cé$²\x85\xa0ɏ") for _ in range(rng.randrange(30))) for _ in range(1500)]
    for text in odd:
        found = ids.of(text)
        assert found.tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
        assert ids.lengths[found].sum() == len(text.encode())


def check_pieces(rows, ids_of):
    """Every id is in exactly one piece, and sequences have no gap."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for key, found in pieces.items():
        ids = ids_of(key)
        whole = sorted(found, key=lambda r: r.start)
        assert [r.start for r in whole] == np.cumsum([0] + [r.length for r in whole])[:-1].tolist()
        assert sum(r.length for r in whole) == len(ids) == whole[0].doc_tokens
        for r in whole:
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert zlib.crc32(part.tobytes()) == r.ids_crc32
    sizes = []
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes.append(at)
    return sizes


def test_packing_keeps_every_id_and_needs_no_padding(texts, plain):
    docs, rows = texts
    found = pack(docs.repartition(4), windows=3).collect()
    assert {r.doc_id for r in found} == set(rows)
    sizes = check_pieces(found, lambda k: plain.encode(rows[k].text, add_special_tokens=False).ids + [0])
    assert all(s & (s - 1) == 0 and s <= 1024 for s in sizes)
    assert sum(s < 1024 for s in sizes) <= 10


def test_open_windows_are_bounded():
    rng, packer = random.Random(2), Packer(64, 4)
    total = 0
    for key in range(500):
        size = rng.randrange(1, 150)
        total += size
        packer.add(key, np.arange(size, dtype=np.uint32))
        assert len(packer.windows) <= 4
    assert all(sum(len(p[2]) for p in w) == 64 for w in packer.closed)
    assert 64 * len(packer.closed) + sum(w[1] for w in packer.windows) == total


def test_packing_odd_rows(odd, plain):
    repeated = odd.filter("doc_id is not null and doc_id != 9")
    texts = {r.doc_id: r.text or "" for r in repeated.collect()}
    check_pieces(
        pack(repeated).collect(), lambda k: plain.encode(texts[k], add_special_tokens=False).ids + [0]
    )
    rows = pack(odd).collect()
    assert sum(r.length for r in rows if r.start == 0 and r.doc_id in (1, 2)) == 2
    assert len([r for r in rows if r.doc_id == 9 and r.start == 0]) == 2
    assert len([r for r in rows if r.doc_id is None and r.start == 0]) == 2
    assert pack(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pack(odd, size=1000)


def test_attribution_rules():
    # Sections [0, 3), [3, 4), [4, 10); tokens of 2, 3, 1 and 4 bytes.
    starts, lengths = np.array([0, 3, 4]), np.array([2, 3, 1, 4])
    assert [x.tolist() for x in attribute(starts, 10, lengths, "start")] == [[2, 0, 2], [1, 0, 0]]
    assert [x.tolist() for x in attribute(starts, 10, np.array([4, 6]), "most")] == [[1, 0, 1], [1, 0, 0]]
    assert [x.tolist() for x in attribute(np.array([0, 1]), 4, np.array([4]), "most")] == [[0, 1], [1, 0]]
    assert [x.tolist() for x in attribute(np.array([0, 2]), 4, np.array([4]), "most")] == [[1, 0], [1, 0]]
    assert section_starts(b"a\n\nb\n").tolist() == [0, 2, 3] and section_starts(b"").tolist() == [0]


@pytest.mark.parametrize("rule", ["start", "most"])
def test_counts_against_offsets(texts, plain, rule):
    docs, rows = texts
    found = {}
    for r in token_counts(docs, rule).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == set(rows)
    for key, sections in found.items():
        text = rows[key].text
        offsets = plain.encode(text, add_special_tokens=False).offsets
        starts = [0] + [n + 1 for n, c in enumerate(text) if c == "\n" and n + 1 < len(text)]
        sections.sort(key=lambda r: r.section)
        assert [r.start for r in sections] == starts
        assert [r.end for r in sections] == starts[1:] + [len(text)]
        assert sum(r.n_tokens for r in sections) == len(offsets) == sections[0].doc_tokens
        if rule == "start" and text.isascii():
            counts = [0] * len(starts)
            for a, _ in offsets:
                counts[max(n for n, s in enumerate(starts) if s <= a)] += 1
            assert counts == [r.n_tokens for r in sections]


def test_counts_of_odd_rows(odd):
    rows = token_counts(odd).collect()
    empty = [r for r in rows if r.doc_id in (1, 2)]
    assert [(r.section, r.start, r.end, r.n_tokens, r.doc_tokens) for r in empty] == [(0, 0, 0, 0, 0)] * 2
    assert len([r for r in rows if r.doc_id == 9]) == len([r for r in rows if r.doc_id is None]) == 2
    assert len([r for r in rows if r.doc_id == 11]) == 3
    assert token_counts(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        token_counts(odd, rule="other")


@pytest.mark.parametrize("blank", [" ", "\n", " \n"])
def test_very_long_runs_of_blanks(spark, blank):
    """Such runs are beyond the fast splitter; the ids are those of the other one."""
    text = "a" + blank * (1_000_000 // len(blank)) + "b"
    ids = Ids()
    found = ids.of(text)
    assert (found == np.array(ids._tokenizer.encode(text, add_special_tokens=False).ids)).all()
    docs = spark.createDataFrame([(1, text), (2, "c")], "doc_id bigint, text string")
    assert sum(r.length for r in pack(docs).collect()) == len(found) + 1 + len(ids.of("c")) + 1
