import hashlib
import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from tests.llm import cases
from veilframe.llm import fingerprint
from veilframe.llm.fingerprint import PrefixHashes, code_points, common_extension, equal_spans, fingerprint_documents


@given(st.text("ab", max_size=60), st.text("ab", max_size=60), st.data())
def test_spans_and_extensions(a, b, data):
    x, y = PrefixHashes(code_points(a)), PrefixHashes(code_points(b))
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    longest = next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))
    assert common_extension(x, i, y, j) == longest
    width = data.draw(st.integers(0, min(len(a) - i, len(b) - j)))
    assert equal_spans(x, i, y, j, width) == (a[i : i + width] == b[j : j + width])


def test_shared_prefix_arrays():
    a, b = "some text é 汉字 " * 9, "some text é 汉字 " * 5 + "other"
    x = PrefixHashes(code_points(a))
    cut = len("some text é 汉字 " * 5)
    shared, own = PrefixHashes(code_points(b), x, cut), PrefixHashes(code_points(b))
    assert all(np.array_equal(p, q) for p, q in zip(shared.sums, own.sums, strict=True))


def check(spark, rows):
    got = fingerprint_documents(cases.documents(spark, rows)).collect()
    order = sorted(((r[0] if r[0] is not None else 2**63 - 1), r[1] or "", r[0]) for r in rows)
    want = []
    for k, (_, text, doc_id) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        n = len(text)
        want.append((doc_id, n, hashlib.sha256((text[: n - n // 4] + following[: n // 4]).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_chars"], r["edited_sha256"])) for r in got)
    return got


def test_edited_texts(spark):
    got = check(spark, cases.rows())
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    prints = {}
    for r in got:
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert prints[0] == prints[1] and prints[0] != prints[2]
    check(spark, cases.rows()[:1])
    check(spark, [])


def test_many_rows_of_one_id(spark, monkeypatch):
    rng = random.Random(2)
    text = lambda: "".join(rng.choice("abcdé汉 ") for _ in range(rng.randint(0, 12)))
    bare = (None,) * 7
    rows = [(None, text(), *bare) for _ in range(300)] + [(7, text(), *bare) for _ in range(200)] + [(9, "the same", *bare) for _ in range(60)] + [(k, text(), *bare) for k in range(100)]
    got = check(spark, rows)
    assert len(got) == len(rows)
    plan = {}
    real = fingerprint._bounds
    monkeypatch.setattr(fingerprint, "_bounds", lambda *a: plan.setdefault("cuts", real(*a)))
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 20)
    check(spark, rows)
    ids, parts = plan["cuts"]
    assert (ids == 7).sum() > 20 and (ids == 2**63 - 1).sum() > 20 and (ids == 9).sum() <= 2 and (parts[ids == 7] >= 0).all()


def test_ids_that_no_double_holds(spark):
    rng = random.Random(6)
    check(spark, [(2**60 + rng.randrange(3000), f"text {k}", *(None,) * 7) for k in range(800)])
    check(spark, [(s * (2**62 + 3 * k), f"text {k}", *(None,) * 7) for k in range(300) for s in (-1, 1)])


def test_texts_on_both_sides_of_the_short_length():
    base = "some words that go on for a while and then some others to be safe, all of them so that there is enough of it"
    printed = lambda n: fingerprint.fingerprint(PrefixHashes(code_points(base[:n])))
    for a, b in ((62, 66), (60, 70), (100, 104)):
        assert fingerprint.likeness(printed(a), printed(b)) > 0.5
    assert fingerprint.likeness(printed(62), printed(62)) == 1


def test_texts_of_any_two_lengths_compare():
    """Against the share of common spans, counted."""
    rng = random.Random(1)
    base = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(400))
    printed = {n: fingerprint.fingerprint(PrefixHashes(code_points(base[:n]))) for n in (20, 40, 63, 64, 100, 127, 128, 129, 200, 400, 2000)}
    for a in printed:
        for b in printed:
            width = fingerprint.SPAN if min(a, b) >= fingerprint.SHORT else fingerprint.SHORT_SPAN
            x, y = ({base[k : k + width] for k in range(n - width + 1)} for n in (a, b))
            true = 2 * len(x & y) / (len(x) + len(y))
            assert abs(fingerprint.likeness(printed[a], printed[b]) - true) < 0.25, (a, b)
    assert fingerprint.likeness(printed[63], printed[128]) > 0.4 and fingerprint.likeness(printed[63], printed[127]) > 0.4


def test_likeness_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = fingerprint_documents(docs).filter("n_chars > 400").toPandas()
    assert got["near_edited"].median() > 0.6 and got["near_next"].median() < 0.1
    assert ((got["edited_common_prefix"] >= got["n_chars"] - got["n_chars"] // 4)).all()
