import hashlib
import random

import xxhash

from planweave.llm import merkle as M


def test_leaves_join_to_the_text(texts):
    _, rows = texts
    for text in [r.text for r in rows.values()] + ["", "\n", "a\n\nb", "日本" * 500, "x" * 5000, "a. b! " * 200]:
        assert "".join(M.leaves(text)) == text
        assert "" not in M.leaves(text)
    assert M.fingerprint("a b") != M.fingerprint("a  b")


def test_differing_branches_locate_the_edit():
    lines = [f"paragraph number {n} of the text\n" for n in range(200)]
    before = M.fingerprint("".join(lines))
    lines[120] = "changed\n"
    after = M.fingerprint("".join(lines))
    assert M.differing(before, after) == (range(120, 121), range(120, 121))
    lines.insert(50, "new\n")
    found = M.differing(before, M.fingerprint("".join(lines)))
    assert (found[0].start, found[0].stop, found[1].start, found[1].stop) == (50, 121, 50, 122)
    assert len(M.differing(before, before)[0]) == 0
    assert 0.98 < M.likeness(before, after) < 1 and M.likeness(before, before) == 1
    assert M.likeness(before, M.fingerprint("quite another text\n" * 9)) == 0


def expected(rows):
    out = []
    for n, (key, text) in enumerate(rows):
        changed = M.edited(text, rows[(n + 1) % len(rows)][1])
        own, other, following = map(M.fingerprint, (text, changed, rows[(n + 1) % len(rows)][1]))
        sha = hashlib.sha256(changed.encode()).hexdigest()
        out.append((key, len(text), sha, own, other, M.likeness(own, other), M.likeness(own, following)))
    return out


def plain(text):
    """The fingerprint once more, character by character, with other means."""
    pieces, line = [], ""
    for n, c in enumerate(text):
        line += c
        if c == "\n" or n == len(text) - 1:
            if len(line) <= 80:
                pieces.append(line)
            else:
                sentence = ""
                for k, d in enumerate(line):
                    sentence += d
                    if k == len(line) - 1 or (d == " " and k and line[k - 1] in ".!?;:,"):
                        piece = ""
                        for j, e in enumerate(sentence):
                            piece += e
                            mixed = (ord(sentence[j - 1]) * 31 + ord(e)) * 0x9E3779B97F4A7C15 % 2**64 >> 59 if j else 1
                            if j == len(sentence) - 1 or (len(sentence) > 80 and mixed == 0):
                                pieces.append(piece)
                                piece = ""
                        sentence = ""
            line = ""
    digests = [xxhash.xxh3_128(p.encode()).digest() for p in pieces]
    sections, held = [], b""
    for d in digests:
        held += d
        if int(d.hex()[:10], 16) % 8 == 0:
            sections.append(hashlib.sha256(held).digest())
            held = b""
    root = hashlib.sha256(b"".join(sections) + hashlib.sha256(held).digest()).hexdigest()[:32]
    return root + ":" + "".join(d.hex()[:10] for d in digests), pieces


def test_fingerprint_against_a_plain_one(texts):
    _, rows = texts
    for text in [r.text for r in rows.values()][:60] + ["", "\n", "a\n\nb", "日本" * 300, "x" * 500, "ab. cd! " * 60]:
        own, pieces = plain(text)
        assert M.fingerprint(text) == own and M.tree(text)[1] == [len("".join(pieces[: n + 1])) for n in range(len(pieces))]


def test_located_edits(texts):
    _, rows = texts
    ordered = [rows[k].text for k in sorted(rows, reverse=True)]
    for text, following in zip(ordered, ordered[1:]):
        changed = M.edited(text, following)
        print_, ends = M.tree(text)
        start, end = M.located(print_, M.fingerprint(changed), ends)
        if text == changed:
            assert (start, end) == (None, None)
            continue
        assert 0 <= start <= end <= len(text)
        # Outside the range the texts are the same.
        assert changed.startswith(text[:start]) and changed.endswith(text[end:]) and len(text) // 3 >= len(text) - end
        assert start <= next((k for k, (a, b) in enumerate(zip(text, changed)) if a != b), len(changed))


def test_unrelated_long_texts_are_not_alike():
    rng = random.Random(6)
    a, b = ("\n".join("%030x" % rng.getrandbits(120) for _ in range(60_000)) for _ in range(2))
    assert M.likeness(M.fingerprint(a), M.fingerprint(b)) < 1e-3


def test_query(texts):
    docs, rows = texts
    ordered = [(k, rows[k].text) for k in sorted(rows, reverse=True)]
    for parts in (1, 6):
        found = M.document_fingerprints(docs.repartition(parts)).collect()
        assert sorted(tuple(r)[:7] for r in found) == sorted(expected(ordered))
        for n, (key, text) in enumerate(ordered):
            own, ends = M.tree(text)
            place = M.located(own, M.fingerprint(M.edited(text, ordered[(n + 1) % len(ordered)][1])), ends)
            assert [(r.edit_start, r.edit_end) for r in found if r.doc_id == key] == [place]
    near = [r for r in expected(ordered) if r[1] > 500]
    assert sum(r[5] for r in near) / len(near) > 0.5 > sum(r[6] for r in near) / len(near)


def test_edited_text():
    assert M.edited("abcdef", "xyz") == "abcdxy" and M.edited("abcdef", "x") == "abcdx" and M.edited("", "x") == ""


def test_odd_rows(spark, odd):
    rows = M.document_fingerprints(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].fingerprint == by_id[2].fingerprint == M.fingerprint("")
    assert len({r.fingerprint for r in rows if r.doc_id == 9}) == 1
    assert M.document_fingerprints(odd.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "abcdef")], "doc_id bigint, text string")
    row = M.document_fingerprints(one).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and row.near_next == 1
