"""Hard negatives, collocations and language identification: brute force and odd tables."""

import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kudoscope.llm import collocations, hard_negatives, language
from kudoscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


# hard negatives


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 90), st.integers(1, 150), st.integers(1, 110), st.integers(0, 9))
def test_strassen_product(m, k, n, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-(2**40), 2**40, (m, k)), rng.integers(-(2**20), 2**20, (n, k))
    assert (hard_negatives.product(a, b) == a @ b.T).all()  # both modulo 2^64


VECTORS = "vec_id long, embedding array<float>, label int, id string, key int, v int, anchor int, a int"


def mined(rows, anchor, positives=5, negatives=3):
    """Brute force over ``(id, vector, label)``."""
    usable = []
    for i, x, lab in rows:
        if lab is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        r = (i, lab, tuple(int(np.floor(256 * float(np.float32(c)))) for c in x))
        if r not in usable:
            usable.append(r)
    place = lambda r: (r[0] is None, r[0] or 0)
    out = []
    for one in usable:
        if one[0] is None or not anchor(one[0]):
            continue
        scored = sorted(((sum(p * q for p, q in zip(one[2], r[2])), r) for r in usable if r != one), key=lambda s: (-s[0], place(s[1])))
        for p, pos in [s for s in scored if s[1][1] == one[1]][:positives]:
            found = [s for s in scored if s[1][1] != one[1] and 50 * p <= 100 * s[0] <= 95 * p]
            out += [(one[0], pos[0], k, neg[0], p, n) for k, (n, neg) in enumerate(found[:negatives], 1)]
    return sorted(out, key=str)


def test_hard_negatives_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(160):
        x = [rng.choice([0.0, 0.25, 0.5, 0.75, 1.0, -0.3]) for _ in range(rng.choice([4, 4, 4, 2, 6]))]
        rows.append((i if i % 23 else None, x, rng.choice([0, 0, 0, 0, 1, 2])))
    rows += [rows[10], rows[10], (20, [0.5, 0.5, 0.5, 0.5], 0), (20, [1.0, 0.5], 1), (200, [], 0), (201, None, 0), (202, [0.5], None)]
    rows += [(203, [float("nan"), 1.0], 0), (204, [float("inf")], 0), (205, [0.5, None], 1)]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], VECTORS).repartition(3)
    got = hard_negatives.mine(df, F.col("id") % 10 == 0, anchor_tile=3, row_tile=7).collect()
    want = mined(rows, lambda i: i % 10 == 0)
    assert sorted((tuple(r) for r in got), key=str) == want and len(want) > 50


def test_hard_negatives_of_odd_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(none, F.col("id") % 10 == 0).collect() == []
    alone = spark.createDataFrame([(10, [1.0], 1, "", 0, 0, 0, 0)], VECTORS)
    assert hard_negatives.mine(alone, F.col("id") % 10 == 0).collect() == []
    # one vector holds most rows: ties go to the smaller id
    hot = [(i, [1.0, 0.0], 0) for i in range(400)] + [(1000 + i, [0.75, 0.5], 1) for i in range(300)]
    df = spark.createDataFrame([(*r, "", 0, 0, 0, 0) for r in hot], VECTORS)
    got = hard_negatives.mine(df, F.col("id") == 50, anchor_tile=4, row_tile=32).collect()
    assert sorted(tuple(r) for r in got) == sorted((50, p, k, 999 + k, 65536, 49152) for p in range(5) for k in (1, 2, 3))


# collocations


def mined_phrases(rows, least, top, covered, scale):
    counts, words = {}, Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    f = counts.setdefault(lang, Counter())
                    f[tuple(ws[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in found.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and inside(q) and 100 * b >= covered * a for q, b in found.items()):
                continue
            score, k = min((scale * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for r, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, r, p.decode(), -a, left, right, words[lang], -s))
    return sorted(out)


def phrase_rows():
    rng = random.Random(11)
    vocabulary = ["Alpha", "beta", "É", "é", "of", "the", "the", "the", "x\x1cy", "漢字", "Of\x0bthe", "z" * 40]
    rows = []
    for _ in range(60):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", " ", "\t ", ", ", ".", "\r\n", "\xa0"]) for _ in range(rng.randrange(0, 60)))
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), text))
    return rows + [rows[0]] * 5 + [("en", None), ("en", ""), (None, None), ("fr", " .,;"), ("en", "alpha beta of the " * 3000)]


@pytest.mark.parametrize("bits, shards, block", [(27, 8, 2_000_000), (9, 3, 50), (20, 1, 700)])
def test_collocations_equal_brute_force(spark, monkeypatch, bits, shards, block):
    monkeypatch.setattr(collocations, "SLICE", 100)
    rows = phrase_rows()
    schema = "lang string, text string, phrase int, words string, part int, raw string, f int"
    df = spark.createDataFrame([(*r, 1, "w", 2, "r", 3) for r in rows], schema).repartition(5)
    for least, top, scale in ((6, 2000, 2_000_000), (4, 3, 2_000_000), (6, 50, 10**15)):
        got = collocations.collocations(df, least, top, 80, scale, bits=bits, shards=shards, block_words=block)
        want = mined_phrases(rows, least, top, 80, scale)
        assert sorted(tuple(r) for r in got.collect()) == want and want


def test_collocations_of_empty_tables(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None)], "lang string, text string")).collect() == []


@given(st.lists(st.integers(0, 2**48 - 1), min_size=1, max_size=50, unique=True))
def test_packed_hashes(values):
    values = np.array(sorted(values), dtype=np.uint64)
    assert (collocations._unpacked(collocations._packed(values)) == values).all()


# language


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="abcé漢", min_size=1, max_size=9), min_size=1, max_size=6))
def test_subwords_stay_inside_their_word(words):
    together, sizes = language.subwords(words)
    parts = [language.subwords([w])[0].tolist() for w in words]
    assert [sorted(p) for p in np.split(together, np.cumsum(sizes)[:-1])] == [sorted(p) for p in parts]
    for w, n in zip(words, sizes):
        bordered = len(w) + 2
        grams = len(w) + sum(max(0, bordered - k + 1) for k in (2, 3, 4))
        assert n == grams + 1


DOCS = "doc_id long, text string, lang string, kept int, words string, score string, draw int"


def test_language_on_odd_rows(spark):
    rng = random.Random(2)
    sounds = {"aa": ["ka", "la", "ma"], "bb": ["schu", "sto", "ptu"]}
    rows = [(i, " ".join("".join(rng.choices(sounds[lang], k=3)) for _ in range(30)), lang) for i in range(400) for lang in [rng.choice("ab") * 2]]
    odd = [(5000, None, "aa"), (5001, "", "bb"), (5002, "123 !? ٣", "aa"), (None, "kala maka", "zz"), (5003, "kala " * 50_000, None), (5003, "KALA " * 2, None), (5004, "́", None)]
    df = spark.createDataFrame([(*r, 0, "w", "s", 1) for r in rows + odd], DOCS).repartition(4)
    got = language.language_table(df, sample_docs=200).collect()
    assert len(got) == len(rows) + len(odd)
    lang = {i: x for i, _, x in rows}
    assert all(r["lang_pred"] == lang[r["doc_id"]] for r in got if r["doc_id"] in lang)
    blank = [r for r in got if r["doc_id"] in (5000, 5001, 5002, 5004)]
    assert [(r["lang_pred"], r["score"], r["accepted"]) for r in blank] == [("und", 0.0, False)] * 4
    assert {r["lang_pred"] for r in got if r["doc_id"] in (None, 5003)} == {"aa"}
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "some words", None, 0, "w", "s", 1), (None, "a", "en", 0, "w", "s", 1)], DOCS)
    assert {tuple(r)[2:] for r in language.language_table(df).collect()} == {("und", 0.0, False)}
    assert language.language_table(df.limit(0)).collect() == []


@needs_tables
def test_language_of_held_out_documents(spark):
    got = QUERIES["op13_language"](spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    rows = got.join(truth, "doc_id").collect()
    assert len(rows) == 1000 and all(r["held_out"] == (r["h"] % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    right = [r["lang"] == r["lang_pred"] for r in held]
    accepted = [r["lang"] == r["lang_pred"] for r in held if r["accepted"]]
    assert np.mean(right) > 0.97 and np.mean(accepted) >= np.mean(right) and len(accepted) > 0.9 * len(held)
