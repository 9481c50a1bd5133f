"""What the trees add to the base spans, and how their sample and cuts are made."""

import random
import warnings

import pytest

from kudoscope.llm import personal_data as pd_


def corpus(n, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("aeioulnrst", k=rng.randrange(3, 9)))
    digits = lambda k: "".join(rng.choices("123456789", k=k))
    rows = []
    for i in range(n):
        say = [word() for _ in range(12)]
        say.insert(3, rng.choice([
            f"call +1 ({digits(3)}) {digits(3)}-{digits(4)} now", f"mail {word()}.{word()}@{word()}.example.com today",
            f"look at {word()}", f"seen {digits(7)} times", f"on 20{digits(2)}-0{digits(1)}-1{digits(1)} late", f"id {digits(12)} done",
            f'token = "{"".join(rng.choices("0123456789abcdef", k=40))}"', f"the {word()}{word()}{word()}-{word()}{word()}{word()} case",
            f"host 10.{digits(2)}.{digits(2)}.{digits(1)} is up",
        ]))
        rows.append((i, " ".join(say)))
    return rows


PLANTED = {
    100_000: ("write to anna.brock at mailbox dot example dot org please", "email", "anna.brock at mailbox dot example dot org"),
    100_001: ("write to anna.brock(at)mailbox.example.org please", "email", "anna.brock(at)mailbox.example.org"),
    100_002: ("call (743) 555-3824 now", "phone", "(743) 555-3824"),
    100_003: ("call 1 (743) 555-3824 now", "phone", "1 (743) 555-3824"),
    100_004: ("key 0a1b2c3d4e5f60718293a4b5c6d7e8f901234567 here", "secret", "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567"),
}
CLEAN = {
    100_005: "look at home and at work",
    100_006: "seen 4443332 times on 2024-01-12",
    100_007: "order 123456789012 is here",
    100_008: "an internationalisation-compatibility case",
}


@pytest.fixture(scope="module")
def table(spark):
    rows = corpus(4000) + [(k, v[0]) for k, v in PLANTED.items()] + list(CLEAN.items())
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(6)


@pytest.mark.parametrize("sample_rows", [120, 100_000])
def test_hidden_forms_are_found(table, sample_rows):
    model = pd_.fit(table, sample_rows=sample_rows)
    assert set(model.parts) == set(pd_.CANDIDATES)
    got = {r["doc_id"]: r for r in pd_.personal_table(table, model).collect()}
    for doc, (text, kind, span) in PLANTED.items():
        start = text.index(span)
        assert got[doc]["spans"] == f"{kind}:{start}:{start + len(span)}", text
        assert got[doc]["n_email"] == got[doc]["n_phone"] == got[doc]["n_card"] == got[doc]["n_ip"] == 0
    assert all(got[doc]["spans"] == "" for doc in CLEAN)
    base = {r["doc_id"]: r for r in pd_.personal_table(table, None).collect()}
    columns = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    assert all(all(got[d][c] == base[d][c] for c in columns) for d in base)


def test_rare_data_in_a_large_table(spark):
    """Positives are drawn from all rows: a few among thousands are enough."""
    plain = [(i, f"we look at {i % 7} things and at {i % 5} more") for i in range(6000)]
    rare = [(10_000 + i, f"mail jo.{'abcdefgh'[i % 8]}{i}@post.example.com now") for i in range(40)]
    hot = [(20_000 + i, "the same text looks at nothing") for i in range(3000)]
    df = spark.createDataFrame(plain + rare + hot + [(1, "jo at post dot example dot com")], "doc_id long, text string")
    with warnings.catch_warnings(record=True):
        warnings.simplefilter("always")
        model = pd_.fit(df, sample_rows=300)
    assert set(model.parts) == {"email"}
    found = [r["spans"] for r in pd_.personal_table(df, model).where("doc_id < 10000").collect() if r["spans"]]
    assert found == ["email:0:30"]


def test_tables_without_one_of_the_labels(spark):
    df = spark.createDataFrame([(1, "nothing here"), (None, None), (1, "look at this"), (2, "a@b.example")], "doc_id long, text string")
    with pytest.warns(UserWarning, match="only base spans"):
        model = pd_.fit(df.where("doc_id = 1 or doc_id is null"))
    assert model.parts == {}
    assert sorted(r["spans"] for r in pd_.personal_table(df, model).collect()) == ["", "", "", "email:0:11"]
    assert pd_.fit(df.limit(0)) is None
