"""Text operators against brute force and on odd tables."""

import datetime as dt
import hashlib
import html as entities
import random
import re
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

import corpus_pipeline
from kudoscope.llm import (
    byte_pairs,
    decontaminate,
    main_text,
    near_duplicates,
    personal_data,
    perspectives,
    quality_rules,
    repeated_text,
    token_counts,
    url_filters,
)
from kudoscope.llm.common import written
from kudoscope.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality int, keep string, found string"


def words(n, seed, alphabet="abcdefghijkl"):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(alphabet, k=rng.randrange(2, 9))) for _ in range(n))


BASE = words(80, 1) + "."
TEXTS = [
    None, "", " \n\t ", "one", BASE, BASE, BASE.replace(" ", "  ", 1), BASE + " tail.", words(40, 2) + ".\n" + BASE,
    "call +1 (017) 555-7713 or a.b@mail7.example.com, 4111 1111 1111 1111, 10.0.0.255 and 10.0.0.256.",
    "é" * 300, "a" * 1000, "ab" * 700, "9 " * 400, words(6000, 3), "| a | b |\nHome | About\n" + BASE,
    "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" and 𝒜 漢字 \x1c x", "<|endoftext|> it's 1234",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), 1, "k", "f") for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, BASE, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# 1 near duplicates


def components_of(rows):
    """Brute force: rows of (doc_id, fingerprint) to component ids."""
    fps = [int(f, 16) for _, f in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    lowest = {}
    for (doc, _), k in zip(rows, label):
        if doc is not None:
            lowest[k] = min(doc, lowest.get(k, doc))
    return [lowest.get(k) for k in label]


def plain_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"


@pytest.mark.parametrize("bucket", [256, 1])
def test_near_duplicates(docs, bucket, monkeypatch):
    monkeypatch.setattr(near_duplicates, "PAIR_BUCKET", bucket)
    rows = [(r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates.cluster_table(docs).collect()]
    assert sorted((r[:2] for r in rows), key=str) == sorted(
        ((r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()), key=str
    )
    assert [r[2] for r in rows] == components_of([r[:2] for r in rows])


def test_links_by_bits(spark, monkeypatch):
    rng = np.random.default_rng(5)
    seeds = rng.integers(-(2**63), 2**63, 6)
    prints = {int(s) for s in seeds}
    for s in list(prints):
        for _ in range(12):
            x = s
            for bit in rng.choice(63, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(bit)
            prints.add(x)
    prints = sorted(prints)
    table = spark.createDataFrame([(p,) for p in prints], "fp long")
    want = components_of([(k, f"{p & (2**64 - 1):016x}") for k, p in enumerate(prints)])
    for bucket in (256, 2):
        monkeypatch.setattr(near_duplicates, "PAIR_BUCKET", bucket)
        roots = {r.node: r.root for r in near_duplicates.components(near_duplicates.links(table)).collect()}
        groups = {}
        for k, p in enumerate(prints):
            groups.setdefault(roots.get(p, p), []).append(k)
        got = {k: min(g) for g in groups.values() for k in g}
        assert [got[k] for k in range(len(prints))] == want


def test_one_document_of_a_group_stays(docs, empty):
    kept = near_duplicates.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    rows = near_duplicates.cluster_table(docs).collect()
    assert ids == sorted({r.component_id for r in rows if r.component_id is not None})
    assert near_duplicates.deduplicated(empty).count() == 0


def test_different_texts_under_null_and_equal_ids_stay(spark):
    texts = [words(60, 700 + k) for k in range(40)]
    rows = [(None, t, "a") for t in texts[:20]] + [(5, t, "a") for t in texts[20:]]
    rows += [(None, texts[0], "a"), (None, texts[0], "b"), (9, texts[1] + " tail", None), (5, texts[30], None), (7, texts[30], "a")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    near = lambda a, b: (int(plain_fingerprint(a), 16) ^ int(plain_fingerprint(b), 16)).bit_count() <= 3
    assert not any(near(a, b) for k, a in enumerate(texts) for b in texts[:k])
    kept = sorted(((r.doc_id, r.text) for r in near_duplicates.deduplicated(table).collect()), key=str)
    want = [(9, texts[1] + " tail") if k == 1 and near(texts[1], texts[1] + " tail") else (None if k < 20 else 5, t) for k, t in enumerate(texts)]
    if not near(texts[1], texts[1] + " tail"):
        want.append((9, texts[1] + " tail"))
    assert kept == sorted(want, key=str)


def test_long_chains_contract(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1300)], "a long, b long")
    roots = near_duplicates.components(edges).collect()
    assert len({r.root for r in roots}) == 2 and len(roots) == 601


# 2 repeated text


def cut_of(rows):
    seen, out = {}, []
    for doc, text in rows:
        b = (text or "").encode()
        for s in range(len(b) - 99):
            place = (doc is None, doc or 0, s)
            seen[b[s : s + 100]] = min(place, seen.get(b[s : s + 100], place))
    for doc, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if seen[b[s : s + 100]] < (doc is None, doc or 0, s):
                gone[s : s + 100] = b"\1" * 100
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [50_000, 3])
def test_repeated_text(docs, hot, monkeypatch):
    monkeypatch.setattr(repeated_text, "HOT_ENTRIES", hot)
    got = pairs_of(repeated_text.repeat_table(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == cut_of([(r.doc_id, r.text) for r in docs.collect()])


def test_repeated_passages_in_odd_places(spark):
    rng = random.Random(9)
    passages = [words(40, k)[: 98 + k] for k in range(5)] + [words(80, 11)]
    rows = [
        (i, words(rng.randrange(0, 40), 100 + i) + rng.choice(passages) + words(rng.randrange(0, 9), i) + rng.choice(passages))
        for i in range(120)
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = pairs_of(repeated_text.repeat_table(table), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == cut_of(rows)


def test_many_texts_without_an_id(spark):
    shared = [words(45, 900 + k) for k in range(4)]
    rows = [(None if k % 3 else 7, f"{words(22, 2000 + k)} {shared[k % 4] if k % 5 == 0 else k} {words(k % 20, 5000 + k)}") for k in range(900)]
    rows += [(8, shared[0]), (None, None), (None, "short")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = pairs_of(repeated_text.repeat_table(table), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == cut_of(rows)


# 3 perspectives


def test_perspectives(spark):
    rows = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, None, "x"),
            (None, 0, "ann", ""), (2, 0, "system", "alone")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = {(r.conv_id, r.perspective): r for r in perspectives.dialogues(perspectives.segments(table)).collect()}
    assert set(done) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    ann = done[1, "ann"]
    assert ann.text == (
        "<|user|>unknown\nx<|end|>\n<|system|>\nbe nice<|end|>\n<|assistant|>\nhi<|end|>\n"
        "<|user|>bob\n<|end|>\n<|user|>bob\n<|end|>\n"
    )
    assert [ann.text[m.start : m.end] for m in ann.masks] == ["hi<|end|>\n"]
    assert len(done[1, "bob"].masks) == 2
    assert perspectives.segments(table.limit(0)).count() == 0


# 4 main text


def page(body, head="<title>t</title><script>var a='</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body><nav><ul><li><a href='/x'>Menu</a></ul></nav>{body}<footer>foot</footer></body></html>"


def test_main_text(spark):
    article = "<article><h1>T &amp; t</h1><p>One <b>bo</b>ld.<p>Two<br>three&nbsp;x<div class='comments'>no</div></article>"
    plain = "<div id=top>Site</div><div class='story'><p>Story {k} a.</p><p>More {k}.</p></div><div class='ad'>buy</div><form>f</form>"
    rows = [(k, "http://a.example/x", page(article)) for k in range(3)]
    rows += [(10 + k, "http://b.example/y", page(plain.replace("{k}", str(k)))) for k in range(6)]
    rows += [(20, None, None), (21, "", ""), (22, "x", "text < 3 & <b"), (None, None, "<p>a<!-- x"), rows[0]]
    got = {r.page_id: (r.text, r.n_chars) for r in main_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0][0] == got[2][0] == "T & t One bold. Two three x"
    assert got[12][0] == "Story 2 a. More 2."
    assert got[20] == got[21] == ("", 0)
    assert got[None][0] == "a"
    assert main_text.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_names_that_do_not_drop_the_article():
    article = "<article class='{a}'><header class='entry-header'><h1>Title</h1></header><p>Story of the day.</p><div class='{d}'>gone</div></article>"
    for body, wrap, a in [("has-sidebar", "x", "no-comments"), ("comments-open", "has-header-image", "post"), ("no-comments", "content-with-sidebar", "comments-open"),
                          ("x", "sidebar", "post"), ("header", "main-widget", "post")]:
        for d in ("comments", "share-links", "post-ad", "relatedPosts"):
            page = f"<html class='{body}'><body class='{body}'><div class='{wrap}'>{article.format(a=a, d=d)}</div><div class='sidebar'>side</div></body></html>"
            assert main_text.extract(page, frozenset()) == "Title Story of the day.", (body, wrap, a, d)
    teaser = "<div class='related'><article>Other story</article></div><ol class='comment-list'><li><article class='comment-body'>me too</article></ol>"
    assert main_text.extract(f"<body><article>One.</article>{teaser}</body>", frozenset()) == "One."
    assert main_text.extract(f"<body><p>A longer story here.</p>{teaser}</body>", frozenset()) == "A longer story here."


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
def test_main_text_of_pages(spark):
    for r in QUERIES["op4_main_text"](spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        assert r.text == " ".join(entities.unescape(re.sub("<[^>]+>", " ", inner)).split())


# 5 token counts


def test_token_counts(docs, empty):
    v = vocabulary()
    sizes = [r[0] for r in token_counts.encoded_lengths(docs, v.ranks, v.pattern).collect()]
    table = token_counts.context_table(token_counts.histogram(token_counts.encoded_lengths(docs, v.ranks, v.pattern)), block=16)
    for r in table.collect():
        k = r.context_limit
        assert r.tokens_truncated == sum(min(k, n) for n in sizes)
        assert (r.docs_that_fit, r.docs_truncated) == (sum(n <= k for n in sizes), sum(n > k for n in sizes))
    assert token_counts.quantile(table, 0.5).first()[0] == sorted(sizes)[(len(sizes) + 1) // 2 - 1]
    assert token_counts.truncated_total(table, 7).first()[0] == sum(min(7, n) for n in sizes)
    assert token_counts.context_table(token_counts.histogram(token_counts.encoded_lengths(empty, v.ranks, v.pattern))).count() == 0


# 6 quality rules


def test_quality_rules(docs, empty):
    got = {r.doc_id: r for r in quality_rules.quality_table(docs).collect()}
    for r in docs.collect():
        ws = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        fives = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
        twice = {f for f in fives if fives.count(f) > 1} if len(fives) < 1000 else set()
        covered = {i + k for i, f in enumerate(fives) if f in twice for k in range(5)}
        q = got[r.doc_id] if r.doc_id is not None else None
        if q is not None and len(fives) < 1000:
            assert (q.n_words, q.n_repeat_words) == (len(ws), len(covered))
            assert q.word_chars == sum(map(len, ws))
    assert got[4].kept and not got[0].kept and not got[13].kept
    assert got[15].n_failed_lines == 2
    cleaned = {r.doc_id: r for r in quality_rules.clean(docs).collect()}
    assert cleaned[15].text == BASE and cleaned[15].n_chars == len(BASE)
    assert quality_rules.clean(docs).columns == docs.columns
    assert quality_rules.clean(empty).count() == quality_rules.quality_table(empty).count() == 0


# 7 byte pairs


def test_round_trip_equals_the_library(docs, empty):
    v = vocabulary()
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in byte_pairs.round_trip(docs, v).collect():
        if r.doc_id is not None:
            assert r.ids == coder.encode_ordinary(texts[r.doc_id] or "")
            assert bytes(r.decoded).decode() == (texts[r.doc_id] or "")
    back = byte_pairs.decode(byte_pairs.round_trip(docs, v).select("doc_id", "ids"), v).collect()
    assert all(bytes(r.decoded).decode() == (texts[r.doc_id] or "") for r in back if r.doc_id is not None)
    assert byte_pairs.token_table(empty, v).count() == 0


def test_long_words_by_heap(monkeypatch):
    v = vocabulary()
    rng = random.Random(2)
    for k in range(60):
        word = bytes(rng.choices(b"abcdeing th\xc3\xa9", k=rng.randrange(2, 90)))
        assert byte_pairs.merged_by_heap(word, v.ranks) == _slow(word, v.ranks)


def _slow(word, ranks):
    parts = [bytes([b]) for b in word]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


# 8 decontamination


@pytest.mark.parametrize("block, at_once", [(decontaminate.BLOCK_WORDS, 4), (5, 4), (5, 1)])
def test_decontamination(spark, docs, empty, block, at_once):
    items = [(1, " ".join(BASE.split()[5:30])), (2, "One!"), (3, None), (4, ""), (None, words(12, 44)), (1, words(10, 45)), (7, "aa bb")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = lambda t: re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = []
    for r in docs.collect():
        ws, hit, ids = low(r.text), set(), set()
        for i, t in items:
            iw = low(t)
            n = min(10, len(iw))
            windows = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else ()
            for k in range(len(ws) - n + 1):
                if tuple(ws[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids.add("" if i is None else str(i))
        want.append((r.doc_id, len(ws), len(hit), sorted(ids)))
    found = decontaminate.matches(docs, bench, block, at_once)
    assert pairs_of(found, "doc_id", "n_words", "n_hit", "items") == sorted(want, key=str)
    assert found.where("doc_id = 4").first().longest_words == 25
    kept = decontaminate.decontaminated(docs, bench, block, at_once)
    assert kept.columns == docs.columns and kept.count() == sum(not w[2] for w in want)
    assert decontaminate.matches(empty, bench).count() == 0
    assert decontaminate.matches(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_long_items_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    item = words(40, 5)
    rows = [(k, " ".join(["zz"] + item.split()[k : k + 10] + ["zz"]), "l", "s", 0) for k in range(31)]
    some = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for at_once in (1, 4):
        assert {r.n_hit for r in decontaminate.matches(some, bench, 7, at_once).collect()} == {10}
        assert decontaminate.decontaminated(some, bench, 7, at_once).count() == 0


# 9 personal data


def base_of(t):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in re.sub("[^0-9]", "", m[0])][::-1]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


ODD = ["x@y.z+q@r.s.t u.v@-a.b", "1.2.3.4.5 0255.1.1.1 256.1.1.1 1.2.3", "4111-1111 1111 1111 1 +1 23 456 7890 12", "+1 555 123 4567-+44 (0)20 7946 0958",
       "𝒜 é a@b.cc 7.7.7.7", "1 2 3 " * 2000, "a." * 3000 + "@", "@" * 50, "5" * 3000]


def test_base_spans(spark, docs):
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(ODD, 500)), "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in table.collect()}
    for r in personal_data.personal_table(table, None).collect():
        if r.doc_id is not None:
            want = base_of(texts[r.doc_id])
            assert r.spans == want and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(k + ":") for k in personal_data.KINDS]


def test_model_adds_near_misses(spark, empty):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        n = "4" + "".join(rng.choices("0123456789", k=14))
        check = next(c for c in "0123456789" if base_of(n + c))
        rows.append((i, f"{words(9, i)} {n + check} {words(4, i)} seen {rng.randrange(1000, 9999999)} times."))
    rows.append((900, f"{words(5, 1)} 4000000000000001 {words(5, 2)}."))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    model = personal_data.fit(table)
    got = {r.doc_id: r for r in personal_data.personal_table(table, model).collect()}
    assert got[900].n_card == 0 and got[900].spans.startswith("card:")
    assert sum(len(r.spans.split(",")) > 1 for r in got.values()) < 30
    assert "[CARD]" in personal_data.redact(table, model).where("doc_id = 900").first().text
    assert personal_data.fit(empty) is None
    assert personal_data.redact(empty, None).columns == empty.columns


# 10 URL filters


def test_url_filters(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    entries = [("spam", "bad.example", "add", day(3)), ("spam", "bad.example", "remove", day(10)), ("spam", "bad.example", "add", day(20)),
               ("spam", "ok.example/a", "add", day(1)), ("adult", "bad.example", "add", day(5)), ("adult", "bad.example", "remove", day(5)),
               (None, "x.example", "add", day(1)), ("spam", None, "add", day(1)), ("spam", "bad.example", "add", day(3))]
    pages = [(1, "http://www.bad.example/z", day(2), False), (2, "http://sub.bad.example", day(3), True), (3, "https://bad.example:80/q?x", day(10), False),
             (4, "http://bad.example", day(25), True), (5, "http://ok.example/a/b", day(9), True), (6, "http://ok.example/ab", day(9), False),
             (7, None, day(9), False), (8, "http://bad.example", None, False), (2, "http://sub.bad.example", day(3), True), (9, "", day(9), False)]
    captures = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, fetched_at timestamp")
    table = spark.createDataFrame(entries, "list_name string, pattern string, action string, at timestamp")
    got = url_filters.filtered(captures, table).collect()
    assert sorted((r.page_id, not r.kept) for r in got) == sorted((p[0], p[3]) for p in pages)
    assert url_filters.filtered(captures.limit(0), table).count() == 0
    assert url_filters.filtered(captures, table.limit(0)).where("kept").count() == len(pages)


# pipeline


def test_pipeline_stages(spark, docs, empty):
    for table in (docs, empty):
        rows = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = written(stage(spark, rows, SF))
            assert out.columns == table.columns, name
            assert out.count() <= rows.count()
            rows = out
        last = corpus_pipeline.STAGES[-1][1](spark, rows, SF)
        assert last.count() == rows.count()
