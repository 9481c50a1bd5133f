"""Templates inside articles against brute force, copies, odd hosts and tables."""

import random
from collections import Counter, defaultdict

from kudoscope.llm import main_text

SCHEMA = "page_id long, url string, html string, host string, template string"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(3, 8))) for _ in range(n))


def page(rng, title, paragraphs, share="<p>Share this story with friends</p>"):
    body = "".join(f"<p>{words(rng, 12)} <b>Note</b> {words(rng, 5)}.</p>" for _ in range(paragraphs))
    return (
        f"<html><body><div class='top'><a href='/'>Home</a></div><article><h1>{title}</h1>{body}{share}"
        f"<div><p>You may like</p><ul><li>An old tale</li><li>A new tale</li></ul></div></article><p>Imprint</p></body></html>"
    )


def rows_of(rng):
    rows = [(i, f"http://news.example/{i}", page(rng, words(rng, 4), rng.randrange(2, 6))) for i in range(9)]
    # a host of copies: nothing in them may be taken for a template
    copy = page(rng, "One story", 4)
    rows += [(100 + i, f"http://copies.example/{i}", copy) for i in range(12)]
    # copies beside different pages count once
    rows += [(200 + i, f"http://mixed.example/{i}", page(rng, words(rng, 3), 3)) for i in range(4)]
    rows += [(210 + i, f"http://mixed.example/c{i}", rows[-1][2]) for i in range(20)]
    # too few pages for a template
    rows += [(300 + i, f"http://small.example/{i}", page(rng, words(rng, 3), 2)) for i in range(2)]
    return rows + [(400, None, None), (401, "", ""), (402, "http://news.example/x", "<p>" + "long " * 20000)]


def brute_templates(rows):
    """Classes of equal occurrence vectors over a host's different pages."""
    hosts = defaultdict(dict)
    for _, url, html in rows:
        host = url.split("/")[2] if url else ""
        own = list(main_text.nodes(html))
        hosts[host][main_text._print(own)] = own
    out = {}
    for host, pages in hosts.items():
        vectors, spans = defaultdict(dict), defaultdict(list)
        for mark, own in pages.items():
            places = defaultdict(list)
            for at, n in enumerate(own, 1):
                if n.token:
                    places[n.token].append(at / len(own))
            for token, ats in places.items():
                vectors[token][mark] = len(ats)
                spans[token].append((ats[0], ats[-1]))
        classes = defaultdict(list)
        for token, v in vectors.items():
            if len(pages) >= 3 and 2 * len(v) > len(pages) and len(v) >= 2:
                classes[tuple(sorted(v.items()))].append(token)
        mean = lambda token, k: sum(s[k] for s in spans[token]) / len(spans[token])  # noqa: B023, E731
        boxes = [
            (len(v), min(mean(t, 0) for t in ts), max(mean(t, 1) for t in ts), ts) for v, ts in classes.items() if len(ts) >= 3
        ]
        crosses = lambda c, d: d[0] > c[0] and (d[1] < c[1] < d[2] < c[2] or c[1] < d[1] < c[2] < d[2])
        out[host] = {t for c in boxes if not any(crosses(c, d) for d in boxes) for t in c[3]}
    return out


def test_templates_equal_brute_force(spark):
    rows = rows_of(random.Random(6))
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    got = {r["host"]: set(r["template"]) for r in main_text.templates(df).collect()}
    want = {h: t for h, t in brute_templates(rows).items() if t}
    assert got == want and {"news.example", "mixed.example"} <= set(got) and "copies.example" not in got


def test_repeated_blocks_inside_articles(spark, monkeypatch):
    rows = rows_of(random.Random(6))
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    got = {r["page_id"]: r["text"] for r in main_text.main_texts(df).collect()}
    assert len(got) == len(rows)
    for i, url, html in rows:
        text = got[i]
        if url and ("news" in url or "mixed" in url) and i != 402:
            assert "Share this" not in text and "tale" not in text and "Imprint" not in text
            assert text.count("Note") == html.count("<b>Note</b>")  # words in bold stay with their block
        if url and "copies" in url:
            assert text.startswith("One story") and "Share this" in text
    assert "Share this" in got[300] and got[400] == got[401] == "" and got[402].count("long") == 20000
    # templates too large to be broadcast are joined by a shuffle, tokens are held in parts
    monkeypatch.setattr(main_text, "BROADCAST_TOKENS", 0)
    monkeypatch.setattr(main_text, "HELD_TOKENS", 5)
    assert {r["page_id"]: r["text"] for r in main_text.main_texts(df).collect()} == got


def test_repeated_pages_and_empty_table(spark):
    rows = rows_of(random.Random(6))
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    once = Counter((r["page_id"], r["text"]) for r in main_text.main_texts(df).collect())
    twice = Counter((r["page_id"], r["text"]) for r in main_text.main_texts(df.union(df)).collect())
    assert twice == Counter({k: 2 * n for k, n in once.items()})
    assert main_text.main_texts(df.limit(0)).collect() == []
