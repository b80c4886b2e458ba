import random

from hypothesis import given
from hypothesis import strategies as st

from tests.llm import cases
from veilframe.llm import decontaminate as dc


def sellers(item, text):
    """Least edits between item and any substring of text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, d in enumerate(item, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
        best = min(best, row[-1])
    return best


@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=40))
def test_bit_parallel_distance(item, text):
    assert dc.Pattern(item, 3).search(text, 0, len(text))[0] == sellers(item, text)


def test_pieces_find_what_brute_force_finds():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    items = [(k, dc.normalise(" ".join(word() for _ in range(rng.randint(3, 25))))) for k in range(12)]
    matcher = dc.Matcher(items, dc.ERROR_RATE, dc.LEAST_PIECE)
    for _ in range(60):
        item = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 10)):
            at = rng.randrange(len(item))
            item[at : at + rng.choice([0, 1])] = rng.choice(["", "z", "q"])
        text = " ".join(word() for _ in range(20)) + " " + "".join(item) + " " + " ".join(word() for _ in range(20))
        want = {i: d for i, t in items if (d := sellers(t, text)) <= dc.budget(len(t))}
        assert {i: d for i, d, _ in matcher.find(text)} == want


def test_leaks_in_rows(spark, monkeypatch):
    item = "A test question about foxes: which of the lazy dogs do they jump over, and why at night?"
    texts = [("x " * 50 + item.upper() + " y" * 50), item.replace(" ", "\n  "), item.replace("foxes", "boxes"), item[: len(item) // 2], None, ""]
    docs = cases.documents(spark, [(k, t, *cases.rows()[0][2:]) for k, t in enumerate(texts)] + [(None, item, *cases.rows()[0][2:])] * 2)
    bench = spark.createDataFrame([(7, item, "x"), (8, item, "y"), (None, item[5:], None), (9, None, None), (10, "", None)], "item_id long, text string, doc_id string")
    got = sorted(((r["doc_id"], r["item_id"], r["edits"]) for r in dc.find_leaks(docs, bench).collect()), key=str)
    assert got == sorted([(d, i, 1 if d == 2 else 0) for d in (0, 1, 2, None, None) for i in (7, 8, None)], key=str)
    kept = dc.without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5]
    monkeypatch.setattr(dc, "BLOCK_CHARS", 100)
    assert sorted(((r["doc_id"], r["item_id"], r["edits"]) for r in dc.find_leaks(docs, bench).collect()), key=str) == got
    assert sorted(r["doc_id"] for r in dc.without_leaks(docs, bench).collect()) == [3, 4, 5]
    assert dc.find_leaks(cases.documents(spark, []), bench).collect() == [] and dc.find_leaks(docs, bench.filter("false")).collect() == []


def test_verbatim_items_of_the_benchmark_are_found(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r["item_id"], dc.normalise(r["text"])) for r in bench.collect()]
    want = {(d["doc_id"], i) for d in docs.collect() for i, t in items if t in dc.normalise(d["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs, bench).collect()}
    assert want and want <= got
