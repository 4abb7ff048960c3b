import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from planweave.llm import secret_scan as S

RANDOM = "q7Zt0WbX9pLk2RmV"
HEXES = "9f8e7d6c5b4a39281706f5e4d3c2b1a0"


def base(text):
    """The base kinds written out plainly."""
    out = []
    assign = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(S.BASE[k], a, b) for a, k, b in sorted(out)]


def spans(text):
    return [(s.kind, s.start, s.end) for s in S.find(text.encode())]


@pytest.mark.parametrize("text", [
    'password=abc123', "PassWord' :  \"abcdef", "password=abc", "token=abc token=abcdef", "secretsecret=abcdefg",
    "api_key=a.b-c/d+e_f=", "apikey : zzzzzz", "api__key=zzzzzz", "toKen=abcdefg", "paſsword=abcdef",
    "AKIA" + "A" * 16, "AKIA" + "A" * 15, "xAKIAAKIA" + "B" * 12, "é😀 AKIA" + "Z9" * 10 + " ü", HEXES, HEXES[:23], "g" + HEXES + "A",
    f"token = \"{HEXES}\"", "password=" * 5 + "x" * 9, "token" + " " * 50 + "=" + " " * 50 + "abcdef", "",
])
def test_base_spans(text):
    assert [s for s in spans(text) if s[0] in S.BASE] == base(text)


def test_base_spans_of_random_texts():
    rng = random.Random(8)
    parts = ["password", "Token", "=", ":", " ", "'", '"', "AKIA", "ABCDEF0123", "0123456789abcdef", "é", "xyz", "api_", "key", "\n", "-", "."]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        assert [s for s in spans(text) if s[0] in S.BASE] == base(text), text


def test_further_kinds():
    key = "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"
    text = f"a {key} b ghp_{RANDOM}AB12 c eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK d https://bob:{RANDOM}@host/x e {RANDOM}{RANDOM[::-1]}"
    kinds = [k for k, _, _ in spans(text)]
    assert kinds == ["private_key", "prefixed", "web_token", "login_url", "random"]
    assert text[slice(*spans(text)[0][1:])] == key
    assert not spans("x" * 5000) and not spans("-----BEGIN PRIVATE KEY----- and no end")
    assert not S.looks_random("your_password_here") and not S.looks_random("aaaaaaaaab") and S.looks_random(RANDOM)


def test_long_texts_take_linear_time():
    for text in ("-----BEGIN PRIVATE KEY-----" * 40_000, "token " * 200_000, "password" + " " * 1_000_000, "://a:" * 200_000 + "@",
                 "eyJ" * 300_000, "a" * 1_000_000, "AKIA" * 250_000, "password='" * 100_000):
        S.find(text.encode())


def test_ownership_tells_copies_from_live_values(spark):
    rows = [(n, f"see password={RANDOM} there", f"owner{n % 9}") for n in range(40)]  # widely copied
    rows += [(100, "ghp_" + RANDOM + "wide", "a"), (101, "token=Zk3jQ81nmP0x", "a"), (102, "token=Zk3jQ81nmP0x", "a")]
    rows += [(200 + n, f"ghp_{RANDOM}copy", f"owner{n}") for n in range(5)]  # an added kind, copied
    rows += [(300, "password=aaaaaaaa", "b")]
    out = {r.doc_id: r for r in S.secrets(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)).collect()}
    assert {(s.kind, s.owners, s.repositories, s.verdict) for n in range(40) for s in out[n].found} == {("assign", 9, 40, "copied")}
    assert [(s.kind, s.owners, s.verdict) for s in out[100].found] == [("prefixed", 1, "live")]
    assert [(s.owners, s.repositories, s.verdict) for s in out[101].found] == [(1, 2, "live")]
    assert all(not out[200 + n].found for n in range(5))
    assert [s.verdict for s in out[300].found] == ["weak"]


def test_query_against_brute_force(spark, texts, odd):
    docs, rows = texts
    added = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(f" token={HEXES} é"))).otherwise(F.col("text")))
    for df in (added, odd):
        held = [(r.doc_id, r.text or "") for r in df.collect()]
        result = sorted(S.digest(S.secrets(df)).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.base_sha256))
        assert len(result) == len(held)
        for r, (key, text) in zip(result, sorted(held, key=lambda x: (x[0] is None, x[0], sha(base(x[1]))))):
            own = base(text)
            assert r.doc_id == key and r.base_sha256 == sha(own)
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in own) for k in S.BASE)
            listed = [s for s in r.spans.split(",") if s]
            assert set(":".join(map(str, s)) for s in own) <= set(listed) and r.n_live + r.n_copied + r.n_weak == len(listed)
    assert S.digest(S.secrets(odd.limit(0))).count() == 0


def sha(found):
    return hashlib.sha256(",".join(":".join(map(str, s)) for s in found).encode()).hexdigest()
