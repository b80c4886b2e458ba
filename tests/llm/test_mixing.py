import math
from collections import Counter

import pytest

from tests.llm import cases
from veilframe.llm.mixing import mix_sources


def poisson(rate, at):
    k, term = 0, math.exp(-rate)
    total = term
    while total <= at:
        k += 1
        term *= rate / k
        total += term
    return k


def expected(rows, weights, seed="mix", target=None):
    import hashlib

    sizes = Counter(r[3] for r in rows)
    weight = {s: weights.get(s, 1.0) for s in sizes}
    out = Counter()
    for r in rows:
        rate = (target or len(rows)) * weight[r[3]] / sum(weight.values()) / sizes[r[3]]
        draws = max(math.ceil(rate / 32), 1)
        key = "" if r[0] is None else r[0]
        unit = lambda i: int(hashlib.md5(f"{seed}|count|{key}|{i}".encode()).hexdigest()[:13], 16) / 2**52
        for c in range(sum(poisson(rate / draws, unit(i)) for i in range(1, draws + 1))):
            out[r[0], r[1], c + 1] += 1
    return out


@pytest.mark.parametrize("weights, target", [({}, None), ({"s0": 5.0, None: 0.0}, 400), ({"s1": 1000.0}, 3000)])
def test_counts_are_inverted_poisson_draws(spark, weights, target):
    got = mix_sources(cases.documents(spark), weights, target_rows=target).collect()
    assert Counter((r["doc_id"], r["text"], r["copy"]) for r in got) == expected(cases.rows(), weights, target=target)


def test_many_sources_give_the_same(spark, monkeypatch):
    from veilframe.llm import mixing

    small = mix_sources(cases.documents(spark), {}, target_rows=60).collect()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    large = mix_sources(cases.documents(spark), {}, target_rows=60).collect()
    assert sorted(map(str, small)) == sorted(map(str, large))


def test_shares_meet_the_weights(spark):
    docs = spark.createDataFrame([(k, "t", "en", "a" if k < 9000 else "b", 1) for k in range(12000)], "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(mix_sources(docs, {"a": 1.0, "b": 3.0}).groupBy("source").count().collect())
    assert abs(got["a"] / 3000 - 1) < 0.08 and abs(got["b"] / 9000 - 1) < 0.08


def test_copies_are_shuffled_and_empty_stays_empty(spark):
    assert mix_sources(cases.documents(spark, []), {}).collect() == []
    keys = [r["shuffle_key"] for r in mix_sources(cases.documents(spark), {}, target_rows=100).coalesce(1).collect()]
    assert len(set(keys)) > 20
    with pytest.raises(ValueError):
        mix_sources(cases.documents(spark), {"s0": -1.0})


def test_any_column_names(spark):
    names = ["_key", "_count", "_table", "_draws", "_salt", "rate", "rows", "_weight", "c0", "c1", "a.b", "Copy2"]
    docs = spark.createDataFrame([(k, f"t{k}", f"s{k % 3}", *range(len(names))) for k in range(30)], ["doc_id", "text", "source", *names])
    got = mix_sources(docs, {}, target_rows=90)
    assert got.columns == [*docs.columns, "copy", "shuffle_key"]
    rows = got.collect()
    assert len(rows) > 60 and all(tuple(r)[3:-2] == tuple(range(len(names))) and r["source"] == f"s{r['doc_id'] % 3}" for r in rows)
