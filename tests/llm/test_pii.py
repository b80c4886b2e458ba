import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from veilframe.llm import pii
from veilframe.llm.common import held_out

PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plainly(text):
    """The contract, with its own patterns."""

    def good(kind, own):
        digits = [int(c) for c in own if c in "0123456789"]
        if kind == 1:
            return all(int(part) <= 255 for part in own.split("."))
        if kind == 2:
            total = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits)))
            return 14 <= len(digits) <= 19 and total % 10 == 0
        return kind == 0 or 10 <= len(digits) <= 15

    return sorted((m.start(), kind, m.end()) for kind, pattern in enumerate(PLAIN) for m in re.finditer(pattern, text) if good(kind, m.group()))


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    for alphabet in ("a@.", "a@.-_ ", "12.", "19. -", "+1(2) .-", "0123456789 -", "+0123456789().- ", "a1@.+- (é\n"):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            assert pii.base_spans(text) == plainly(text), text
    card = "4111 1111-1111 1111"
    assert pii.line(pii.base_spans(f"x {card}")) == "card:2:21"


def test_patterns_are_linear():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "@" * 400_000, "a@" * 200_000, "a@b" * 130_000, "+1" * 200_000, "1-" * 200_000, "+" + "1(" * 200_000):
        pii.base_spans(text)
        pii.stretches(text)


def small(seed=1):
    own = pii.Tagger(hidden=3, embedding=4, seed=seed)
    rng = np.random.default_rng(seed)
    own.w = {k: x.astype(float) for k, x in own.w.items()}
    own.w["transitions"] = rng.normal(0, 0.5, (pii.TAGS, pii.TAGS))
    return own, rng


def test_gradients_are_those_of_the_loss():
    own, rng = small()
    codes = rng.integers(0, pii.SYMBOLS, (6, 3))
    labels = np.array([[0, 1, 3], [1, 2, 4], [2, 2, 0], [2, 0, 5], [0, 7, 6], [0, 8, 6]])
    value, gradient = own.loss(codes, labels)
    assert value > 0
    for name, weights in own.w.items():
        places = [tuple(rng.integers(0, n) for n in weights.shape) for _ in range(12)]
        if name == "embedding":
            places = [(codes[k % 6, k % 3], k % 4) for k in range(12)]
        for at in places:
            before = weights[at]
            weights[at] = before + 1e-5
            up = own.loss(codes, labels)[0]
            weights[at] = before - 1e-5
            down = own.loss(codes, labels)[0]
            weights[at] = before
            assert gradient[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6), (name, at)


def legal(path):
    return all(pii.LEGAL[a, b] for a, b in itertools.pairwise(path))


def test_the_chain_sums_over_all_legal_paths():
    own, rng = small(2)
    scores = rng.normal(0, 1, (4, 2, pii.TAGS))
    p, _, _, log = own.chain(scores)
    for k in range(2):
        weight = {path: np.exp(sum(scores[t, k, x] for t, x in enumerate(path)) + sum(own.w["transitions"][a, b] for a, b in itertools.pairwise(path))) for path in itertools.product(range(pii.TAGS), repeat=4) if legal(path)}
        total = sum(weight.values())
        assert log[k] == pytest.approx(np.log(total))
        for t in range(4):
            for tag in range(pii.TAGS):
                assert p[t, k, tag] == pytest.approx(sum(w for path, w in weight.items() if path[t] == tag) / total)


def test_best_paths_are_the_best_legal_ones():
    rng = np.random.default_rng(3)
    for _ in range(5):
        p = rng.random((4, pii.TAGS)) ** 3
        best = max((path for path in itertools.product(range(pii.TAGS), repeat=4) if legal(path) and (path[0] == 0 or path[0] % 2)), key=lambda path: sum(np.log(p[t, x]) for t, x in enumerate(path)))
        assert pii.best_path(p).tolist() == list(best)


def test_stretches_hold_every_trigger():
    rng = random.Random(6)
    for _ in range(500):
        text = "".join(rng.choice(["word ", "x" * 40, " ", "\n", "7", "@", "(at)", "é" * 50]) for _ in range(rng.randint(0, 60)))
        found = pii.stretches(text)
        for m in re.finditer(r"[0-9@]|\(at\)", text):
            assert any(a <= max(0, m.start() - pii.CONTEXT) and min(len(text), m.end() + pii.CONTEXT) <= b for a, b in found)
        assert all(a < b for a, b in found) and all(x[1] < y[0] for x, y in itertools.pairwise(found))


@pytest.fixture(scope="module")
def tagger(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    return pii.learn(docs.filter(~held_out(F.col("doc_id"))))


def test_held_out_documents_and_forms_that_no_pattern_takes(spark, tagger):
    """Of documents not learned from: what the patterns find is found without them, and so are other forms put into them; words aren't."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter(held_out(F.col("doc_id"))).select("text").toPandas()["text"].fillna("").tolist()
    own, rng = pii.Finder(tagger), np.random.default_rng(9)
    hits = want = wrong = 0
    for text, found in zip(docs, own.added(docs, [[]] * len(docs)), strict=True):
        base = pii.base_spans(text)
        want += len(base)
        hits += len(set(base) & set(found))
        wrong += sum(not any(a < y and x < b for a, _, b in base) for x, _, y in found)
    assert want > 150 and hits >= 0.9 * want and wrong <= 0.05 * want
    planted, texts_, false = [], [], 0
    clean = [t for t in docs if not pii.base_spans(t)][:100]
    for k, text in enumerate(clean):
        at = text.find(" ", len(text) // 2)
        kind = k % 4
        made = pii.rewritten(kind, rng, "anna", "haus")
        text = f"{text[: at + 1]}{made}{text[at:]}" if at >= 0 else f"{made} {text}"
        planted.append((max(at + 1, 0), kind, max(at + 1, 0) + len(made)))
        texts_.append(text)
    missed = [(p, t) for p, t in zip(planted, texts_, strict=True) if p not in pii.base_spans(t)]
    found = own.added([t for _, t in missed], [pii.base_spans(t) for _, t in missed])
    assert len(missed) > 30 and sum(p in f for (p, _), f in zip(missed, found, strict=True)) >= 0.8 * len(missed)
    false = sum(map(len, own.added(clean, [[]] * len(clean))))
    assert false <= 1


def test_spans_longer_than_windows(tagger):
    """What no window holds whole is put together over windows."""
    text = "write to " + ".".join(["name"] * 40) + "@mail.example.com today"
    assert len(text) > 2 * pii.WINDOW
    assert pii.Finder(tagger, 0.5).added([text], [[]]) == [pii.base_spans(text)]


def test_other_texts_change_nothing(tagger):
    own = pii.Finder(tagger)
    many = [f"call ({k:03}) 555-{k:04} or 10[.]0[.]0[.]{k % 256} " * (k % 7) for k in range(120)]
    together = own.added(many, [pii.base_spans(t) for t in many])
    assert together == [own.added([t], [pii.base_spans(t)])[0] for t in many]
    assert sum(map(len, together)) > 100
    for text, found in zip(many, together, strict=True):
        spans = sorted(found + pii.base_spans(text))
        assert all(x[2] <= y[0] for x, y in itertools.pairwise(sorted(found))) and all(0 <= a < b <= len(text) for a, _, b in spans)


def test_odd_rows(spark, tagger):
    rest = cases.rows()[0][2:]
    rows = cases.rows() + [(300 + k, t, *rest) for k, t in enumerate(["a@b.cc", "+1 (555) 555-1234 1.2.3.4", "4111111111111111" * 3, "1 " * 20_000, "x(at)y.com", "\x00 1.1.1.1"])]
    got = pii.find(cases.documents(spark, rows), tagger).collect()
    want = sorted((str(r[0]), *[sum(s[1] == k for s in plainly(r[1] or "")) for k in range(4)], pii.line(plainly(r[1] or ""))) for r in rows)
    assert sorted((str(r["doc_id"]), r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_spans"]) for r in got) == want
    assert all(set(filter(None, r["base_spans"].split(","))) <= set(r["spans"].split(",")) and len([*filter(None, r["spans"].split(","))]) == r["n_added"] + sum(r[f"n_{k}"] for k in pii.KINDS) for r in got)
    assert pii.find(cases.documents(spark, []), tagger).collect() == []


def test_without_samples_nothing_is_added(spark):
    own = pii.learn(cases.documents(spark, [(1, None, *cases.rows()[0][2:])]))
    assert pii.Finder(own).added(["a(at)b.com (171) 555-2028"], [[]]) == [[]]
