import numpy as np
import pytest

from tests.llm import cases
from veilframe.llm import toxicity
from veilframe.llm.queries import op4_pu_toxicity


def test_gradient_is_that_of_the_risk():
    rows = toxicity.Sparse([np.array([0, 2]), np.array([], int), np.array([1])])
    w = np.array([1.0, 2.0, 4.0])
    assert rows.times(w).tolist() == [5.0, 0.0, 2.0]
    assert rows.back(np.array([1.0, 10.0, 100.0]), 3).tolist() == [1.0, 100.0, 1.0]


def plain_fit(positive, unlabelled, prior):
    """The same estimator row by row: risk by its definition, gradient by finite differences, Adam on it; weights by bucket, bias last, and the steps at which the bracket was negative."""
    columns = sorted({int(c) for r in positive + unlabelled for c in r})
    x = lambda rows: np.array([[float(c in set(r.tolist())) for c in columns] for r in rows])
    p, u = x(positive), x(unlabelled)
    loss = lambda z: np.logaddexp(0, -z).mean()  # noqa: E731  of scores that should be positive

    def parts(w):
        at_p, at_u = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        return prior * loss(at_p), loss(-at_u) - prior * loss(-at_p)

    def followed(w):  # what the step goes down: the whole risk, or the bracket backwards
        first, bracket = parts(w)
        return first + bracket if negative is False else -bracket

    w, m, v, turned = np.zeros(len(columns) + 1), 0.0, 0.0, 0
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, toxicity.STEPS + 1):
        negative = bool(parts(w)[1] < 0)
        turned += negative
        eye = np.eye(len(w)) * 1e-5
        grad = np.array([(followed(w + e) - followed(w - e)) / 2e-5 for e in eye])
        grad[:-1] += toxicity.DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - toxicity.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    low, high = -30.0, 30.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (1 / (1 + np.exp(-(u @ w[:-1] + middle)))).mean() < prior else (low, middle)
    return dict(zip(columns, w[:-1], strict=True)), min(w[-1], low), turned


@pytest.mark.parametrize("shared, prior, turns", [(10.0, 0.05, False), (0.0, 0.4, True)])
def test_against_a_plain_estimator(monkeypatch, shared, prior, turns):
    monkeypatch.setattr(toxicity, "LEAST_Z", 0.0)  # every bucket is a feature
    monkeypatch.setattr(toxicity, "LEAST_DOCS", 0)
    monkeypatch.setattr(toxicity, "_distinct", lambda rows: rows)
    rng = np.random.default_rng(3)
    row = lambda toxic: np.unique(np.concatenate([rng.choice(12, 4), 12 + rng.choice(4, 2) if toxic else 16 + rng.choice(4, 2)])).astype(np.int32)
    positive, unlabelled = [row(True) for _ in range(20)], [row(k < 60 * prior * shared) for k in range(60)]
    model = toxicity.fit(positive, unlabelled, prior)
    weights, bias, turned = plain_fit(positive, unlabelled, prior)
    assert (turned > 0) == turns
    tolerance = 0.05 if turns else 1e-4  # where it turns, the last bit of a risk decides on a step
    assert np.allclose(model.weights[list(weights)], list(weights.values()), atol=tolerance) and abs(model.bias - bias) < 2 * tolerance
    assert np.count_nonzero(model.weights) <= len(weights)


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    got = op4_pu_toxicity(spark, sf).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")["toxic"]
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    held = got[got["held_out"]].join(labels, how="inner")
    rank, positive = held["score"].rank(), held["toxic"] == 1
    p, n = positive.sum(), (~positive).sum()
    assert (rank[positive].sum() - p * (p + 1) / 2) / (p * n) > 0.9
    assert held[~positive]["predicted"].mean() < 0.03
    assert held[positive]["predicted"].mean() > 0.75


def test_unlabelled_positives_do_not_count_as_negative():
    rng = np.random.default_rng(1)
    insult, common = toxicity.features("scum")[0], toxicity.features(" ".join(f"w{k}" for k in range(300)))
    some = lambda: rng.choice(common, 30, False)
    clean, toxic = [some() for _ in range(900)], [np.append(some(), insult) for _ in range(100)]
    model = toxicity.fit(toxic[:50], clean + toxic[50:], 0.05)
    assert model.score("w1 scum w2") > 0.5 > 0.2 > model.score("w1 w2 w3")


def test_odd_rows(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 1), (3, 0), (3, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert len(toxicity.score(docs, model).collect()) == len(cases.rows())
    kept = toxicity.reject(docs, model, threshold=2.0)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    empty = cases.documents(spark, [])
    bare = toxicity.train(empty, labels.filter("false"))
    assert toxicity.score(empty, bare).collect() == [] and 0 <= bare.score("") <= 1


def test_the_prior_is_the_share_of_toxic_labels(spark):
    """Also where most labelled documents are toxic: the unlabelled documents' mean score is that share."""
    rest = cases.rows()[0][2:]
    rng = np.random.default_rng(5)
    word = lambda toxic: " ".join(f"{'bad' if toxic else 'good'}{k}" for k in rng.integers(0, 6, 12))
    rows = [(k, word(k % 10 != 0) + f" w{k}", *rest) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 10 != 0)) for k in range(0, 400)], "doc_id long, toxic int")
    model = toxicity.train(cases.documents(spark, rows), labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(cases.documents(spark, rows), model).collect()}
    assert abs(np.mean(list(got.values())) - 0.9) < 0.03

    assert toxicity.fit([], [], 0.9).score("any") == pytest.approx(0.9) and toxicity.fit([], [], 1.0).score("any") == pytest.approx(1 - toxicity.LEAST_PRIOR)
