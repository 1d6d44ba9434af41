"""Perspectives and link verdicts against plain Python."""

import numpy as np
import pytest

from flowsift.llm import links, perspectives


def turns():
    rows = [(1, 0, "system", "Be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "ana", "hey"), (1, 3, "ana", "hey"), (1, 4, None, "who?"), (1, 5, "user", None)]
    rows += [(2, 0, "system", "alone")] + [(3, i, "user" if i % 2 else "bob", f"t{i} ü") for i in range(200)]
    return rows + [(None, 0, "user", "lost"), (None, 1, "assistant", "found"), (4, None, "user", "no turn"), (4, 1, "", ""), (5, 2, "a", "tie"), (5, 2, "b", "tie")]


def test_perspectives(spark):
    table = spark.createDataFrame([(*r, 1, "x") for r in turns()], "conv_id long, turn int, role string, text string, part int, lines string")
    got = {(r.conv_id, r.perspective, r.part): r for r in perspectives.rotate_perspectives(table).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    expected = {}
    unique = sorted(set(turns()), key=order)
    for conv in {r[0] for r in unique}:
        own = [r for r in unique if r[0] == conv]
        for who in {r[2] for r in own if r[2] and r[2] != "system"}:
            for _, turn, role, text in own:
                part = -1 if turn is None else turn // 64
                name = role or "unknown"
                head = {"system": "<|system|>\n"}.get(name, "<|assistant|>\n" if name == who else f"<|user:{name}|>\n")
                out = expected.setdefault((conv, who, part), ["", [], 0])
                said = f"{text or ''}<|end|>"
                if name == who:
                    out[1].append((len(out[0]) + len(head), len(said)))
                out[0] += head + said + "\n"
                out[2] += 1
    assert got.keys() == expected.keys()
    for key, (text, mask, n) in expected.items():
        assert got[key].text == text and got[key].n_turns == n
        assert [(m.start, m.length) for m in got[key].mask] == mask
        assert all(text[a : a + b].endswith("<|end|>") for a, b in mask)


def test_perspectives_empty(spark):
    assert perspectives.rotate_perspectives(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).collect() == []


PAGES = [
    (1, "https://Good.org/x", '<a href="https://spam.net/a">'), (2, "http://example.org/es/1", '<a href="//evil.net/">'), (3, "https://example.org/en/17?x", None),
    (4, "http://evil.net/p", '<a href="http://www.example.org/es/2">'), (5, "http://www.example.org/es/2#y", ""), (6, None, "<a href='http://good.org'>"), (7, "no scheme", ""),
    (8, "https://x.com/fr/1", '<A HREF=https://friend.io/1><img src="https://friend.io/2">'), (9, "https://x.com/de/1", ""), (10, "https://org", ""),
    (11, "ftp://friend.io", ""), (12, "https://friend.io/z", ""), (12, "https://friend.io/z", ""), (13, "a://b://org/", ""), (None, "https://spam.net/q", ""),
]


def test_rules_and_propagation(spark):
    table = spark.createDataFrame([(*p, "x", 1.0) for p in PAGES], "page_id long, url string, html string, host string, trust double")
    got = links.judge_pages(table)
    rows = {}
    for r in got.collect():
        rows.setdefault(r.page_id, []).append(r)
    assert sum(map(len, rows.values())) == len(PAGES) and len(rows[12]) == 2
    one = lambda i: (rows[i][0].host, rows[i][0].path, rows[i][0].rule, rows[i][0].verdict)
    assert one(1) == ("good.org", "/x", "org/", "allow")
    assert one(2) == ("example.org", "/es/1", "example.org/es/", "block")
    assert one(3) == ("example.org", "/en/17", "example.org/en/1", "block")
    assert one(5) == ("www.example.org", "/es/2", "example.org/es/", "block")
    assert one(6) == ("", "", None, "allow") and one(7)[:3] == ("", "", None)
    assert one(8)[2:] == ("com/fr/", "allow") and one(9)[2:] == ("com/de/", "block")
    assert one(10)[:3] == ("org", "", None) and one(13)[:3] == ("b:", "//org/", None)
    assert one(4)[2:] == (None, "block")  # it links to a blocked host
    assert one(11)[3] == one(12)[3] == "allow"
    assert rows[12][0].trust > 0 and rows[4][0].distrust > 0


def test_page_rank(spark):
    edges = [("a", "b", 0.5), ("a", "c", 0.5), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "a", 1.0)]
    seeds = [("a", 0.25), ("d", 0.75)]
    got = links.propagate(
        spark.createDataFrame(edges, "src string, dst string, share double"), spark.createDataFrame(seeds, "host string, seed double"), 9, 0.85
    )
    names = "abcd"
    m = np.zeros((4, 4))
    for a, b, s in edges:
        m[names.index(b), names.index(a)] = s
    seed = np.array([0.25, 0, 0, 0.75])
    rank = seed
    for _ in range(9):
        rank = 0.85 * m @ rank + 0.15 * seed
    ranks = {r["host"]: r["rank"] for r in got.collect()}
    assert all(abs(ranks.get(n, 0) - x) < 1e-12 for n, x in zip(names, rank, strict=True))


@pytest.mark.parametrize("others", [1, 1000])
def test_distrust_of_a_chain(spark, others):
    """All of 15 hosts in a row that lead to a blocked one are blocked, however many blocked pages there are elsewhere."""
    pages = [(0, "http://h0.com/de/", "")] + [(-i, "http://else.com/de/", "") for i in range(1, others + 1)]
    for i in range(1, 16):
        pages += [(100 * i + k, f"http://{'hab'[k]}{i}.net/", f'<a href="http://h{i - 1}.{"com" if i == 1 else "net"}/">') for k in range(3)]
    got = {r.page_id: r.verdict for r in links.judge_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert set(got.values()) == {"block"}


def test_no_pages(spark):
    assert links.judge_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
