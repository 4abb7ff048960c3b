import hashlib
import random
import re

from planweave.llm import pii

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + n % 2), 10)) for n, c in enumerate(digits[::-1])) % 10 == 0
            good = {
                "email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15,
            }
            if good[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


def base(text):
    return [f"{s.kind}:{s.start}:{s.end}" for s in pii.find(text) if s.kind in pii.BASE]


def test_base_spans_match_the_plain_patterns():
    rng = random.Random(1)
    parts = ["a@b.c", "1.2.3.4", "255.", "+1 (", "555-", "0", "4539 1488 0343 6467", "@", ".", "x", " ", "-", "..", "+", "é"]
    for _ in range(4000):
        text = "".join(rng.choice("aB9.@-+ ()%0123é\n") for _ in range(rng.randrange(40)))
        assert base(text) == brute(text), text
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert base(text) == brute(text), text


def test_further_kinds_need_checksum_or_context():
    found = pii.find("IBAN GB82 WEST 1234 5698 7654 32, call 212-555-0123, ssn 123-45-6789")
    assert [s.kind for s in found] == ["iban", "local_phone", "national"]
    assert pii.find("GB82 WEST 1234 5698 7654 33 and 212-555-0123 and 123-45-6789") == []
    near, far = pii.find("card 4539148803436467")[0], pii.find("4539148803436467")[0]
    assert near.kind == far.kind == "card" and near.score > far.score


def test_accounts_end_before_what_follows_them():
    german, british, norwegian = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NO93 8601 1117 947"
    for text, expected in (
        (f"{german} BIC COBADEFF", [german]), (f"{german} 1500 EUR", [german]), (f"{german} {british}", [german, british]),
        (f"{german} {german} {norwegian} 7", [german, german, norwegian]), (f"AB12 {german} X", [german]),
        (f"AB12 CD34 {british} {norwegian}", [british, norwegian]), (f"{german}x {british}", [british]), (german + "0", []),
        (f"({german}), {norwegian}.", [german, norwegian]), ("DE89 3704 0044 0532 0130 01 BIC COBADEFF", []),
        (german, [german]), (f"{german}\n{british} PAYABLE TO ME NOW", [german, british]),
    ):
        found = [text[s.start : s.end] for s in pii.find(text) if s.kind == "iban"]
        assert found == expected, text
        assert not any(x in pii.redacted(text, pii.find(text)) for x in expected)
    pii.find("DE89 " * 100_000 + "DE893704" * 50_000)


def test_redaction_merges_overlaps():
    text = "x a@1.2.3.4 y +1 555 555 5555 z"
    assert pii.redacted(text, pii.find(text)) == "x [email] y [phone] z"
    clean = pii.redacted(text, pii.find(text))
    assert base(clean) == []


def test_patterns_are_linear():
    for text in ("1" * 300_000, "a@" * 200_000, "+1 " * 200_000, "A" * 300_000 + "@", "1 " * 200_000):
        pii.find(text)  # a quadratic pattern would take hours


def test_query(texts):
    docs, rows = texts
    found = pii.digest(pii.personal_data(docs)).collect()
    assert len(found) == len(rows)
    for r in found:
        expected = brute(rows[r.doc_id].text)
        assert r.base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest()
        assert r.n_card == sum(x.startswith("card") for x in expected)
        assert set(expected) <= set(filter(None, r.spans.split(",")))


def test_odd_rows(odd):
    rows = pii.digest(pii.personal_data(odd)).collect()
    assert len(rows) == odd.count()
    assert all(r.spans == "" and r.n_email == 0 and r.highest_score == 0 for r in rows)
    assert pii.personal_data(odd.limit(0)).count() == 0
    kept = {r.doc_id: r.t for r in odd.select("doc_id", pii.redacted_column("text").alias("t")).collect()}
    assert kept[1] is None and kept[2] == "" and kept[10] == "x" * 3000
