import hashlib
import math
import re

import pytest

from planweave.llm import url_filter as U


def parts(url):
    head, sign, rest = (url or "").partition("://")
    if not sign:
        return "", ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule(host, path):
    best = None
    for verdict, text in U.RULES:
        name, _, rest = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            if best is None or len(text) > len(best[1]):
                best = verdict, text
    return best


def letters(host, path):
    text = re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), host + path))
    return "^^^" + re.sub("[^a-z0./_%~=&-]", "*", text) + "$"


def grams(text):
    return [[text[n - k : n] for k in range(1, 5)] for n in range(4, len(text) + 1)]


def brute_model(good, bad):
    counts = [{}, {}]
    for side, urls in enumerate((good, bad)):
        for url in urls:
            for g in (g for row in grams(url) for g in row):
                counts[side][g] = counts[side].get(g, 0) + 1
    followers = [{}, {}]
    for side in (0, 1):
        for g, n in counts[side].items():
            total, kinds = followers[side].get((len(g), g[:-1]), (0, 0))
            followers[side][len(g), g[:-1]] = total + n, kinds + 1

    def chance(side, g):
        below = 1 / U.ALPHABET if len(g) == 1 else chance(side, g[1:])
        total, kinds = followers[side].get((len(g), g[:-1]), (0, 0))
        return (counts[side].get(g, 0) + kinds * below) / (total + kinds) if total else below

    return {g: math.log(chance(0, g)) - math.log(chance(1, g)) for g in {*counts[0], *counts[1]}}


@pytest.fixture(scope="module")
def judged(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    return {r.page_id: r.url for r in pages.collect()}, U.judge_urls(pages).collect()


def test_parts_and_rules(judged):
    urls, rows = judged
    assert len(rows) == len(urls)
    for r in rows:
        assert (r.host, r.path) == parts(urls[r.page_id])
        found = rule(r.host, r.path)
        assert r.rule == (found and found[1])
        assert r.verdict == (found[0] if found else "allow" if r.score >= r.threshold else "block")


def test_scores_against_brute_force(judged):
    _, rows = judged
    distinct = sorted({(r.host, r.path) for r in rows})
    held = {d for d in distinct if int(hashlib.md5("".join(d).encode()).hexdigest()[0], 16) < U.HELD_OUT}
    ruled = {d: rule(*d) for d in distinct}
    sides = [[letters(*d) for d in distinct if ruled[d] and d not in held and ruled[d][0] == v] for v in ("allow", "block")]
    model = brute_model(*sides)
    scores = {}
    for d in distinct:
        each = [next((model[g] for g in reversed(row) if g in model), 0.0) for row in grams(letters(*d))]
        scores[d] = sum(each) / len(each)
    for r in rows:
        assert r.score == pytest.approx(scores[r.host, r.path], abs=2e-6)
    sample = [(math.floor(round(scores[d], 6) / U.BIN + 1e-9), ruled[d][0]) for d in distinct if ruled[d] and d in held]
    good, bad = ([b for b, v in sample if v == x] for x in ("allow", "block"))
    gains = {
        b: sum(x < b for x in bad) / len(bad) - sum(x < b for x in good) / len(good) for b in {b for b, _ in sample}
    }
    best = max(gains.values())
    assert rows[0].threshold == pytest.approx(min(b for b, g in gains.items() if g == best) * U.BIN)


def test_odd_urls(spark):
    pages = [
        (1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://A.Example.COM/en/x?q#f"), (6, "x://net/es/"),
        (7, "x://badnet/es/"), (8, "a://b://c"), (9, "http://www.example.com/en/"), (None, "http://a.org/Ü/1"),
        (10, "http://a.com?x=/"), (5, "HTTP://A.Example.COM/en/x?q#f"), (11, "http://h.org/" + "long/" * 20_000),
    ]
    table = spark.createDataFrame([(*p, "h", 1) for p in pages], "page_id bigint, url string, host string, score int")
    rows = U.judge_urls(table).collect()
    assert len(rows) == len(pages)
    by_id = {r.page_id: r for r in rows}
    for key in (1, 2, 3, 4):
        assert (by_id[key].host, by_id[key].path, by_id[key].rule, by_id[key].verdict) == ("", "", None, "allow")
    assert (by_id[5].rule, by_id[5].verdict) == ("example.com/en/", "block")
    assert by_id[6].rule == "net/es/" and by_id[7].rule is None and by_id[8].host == "b:"
    assert by_id[9].rule == "www.example.com/en/" and by_id[10].rule is None and by_id[10].path == ""
    assert U.judge_urls(table.limit(0)).count() == 0
