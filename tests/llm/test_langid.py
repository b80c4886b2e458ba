import zlib
from collections import Counter, defaultdict
from math import log2

import numpy as np

from tests.llm import cases
from veilframe.llm import langid


def plain_ppm(train: list[bytes], text: bytes) -> float:
    """Code length symbol by symbol over dictionaries."""
    counts = defaultdict(Counter)
    for t in train:
        t = langid.START + t
        for i in range(3, len(t)):
            for order in range(4):
                counts[t[i - order : i]][t[i]] += 1
    text, bits = langid.START + text, 0.0
    for i in range(3, len(text)):
        refused = set()
        for order in range(3, -1, -1):
            own = counts.get(text[i - order : i])
            if not own:
                continue
            left = {s: n for s, n in own.items() if s not in refused}
            whole = sum(left.values()) + len(left)
            if text[i] in left:
                bits -= log2(left[text[i]] / whole)
                break
            if left:
                bits -= log2(len(left) / whole)
            refused |= set(left)
        else:
            bits += log2(256 - len(refused))
    return bits


def test_code_lengths_are_exact():
    train = [b"the cat sat on the mat", "é naïve thé".encode(), b"aaa"]
    keys, number = np.unique(np.concatenate([langid.windows(t.decode()) for t in train]), return_counts=True)
    model = langid.Model(["x"], [langid.ContextTree(keys, number.astype(float))], keys)
    texts = ["the mat", "zzz", "", "q", "thé cat é", "aaaaab"]
    got = model.code_lengths(texts)[:, 0]
    assert np.allclose(got, [plain_ppm(train, t.encode()) for t in texts])


def test_held_out_accuracy_and_form(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from veilframe.llm.queries import op3_ppm_language

    got = op3_ppm_language(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    truth = docs.select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    assert len(got) == len(truth) and got["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in got["held_out"].items())
    held = got[got["held_out"]]
    assert (held["lang_pred"] == truth[held.index]).mean() > 0.95


def test_odd_rows(spark):
    docs = cases.documents(spark)
    model = langid.train(docs)
    got = langid.identify(docs, model).collect()
    assert len(got) == len(cases.rows())
    assert all((r["lang_pred"] == "und") == (not any(map(str.isalpha, t[1] or ""))) for r, t in zip(sorted(got, key=str), sorted(cases.rows(), key=str), strict=False) if r["doc_id"] in (4, 5, 6) and t[0] == r["doc_id"])
    assert {r["lang_pred"] for r in got if r["doc_id"] in (4, 5, 6)} == {"und"}
    empty = cases.documents(spark, [])
    assert langid.identify(empty, langid.train(empty)).collect() == []
    assert {r["lang_pred"] for r in langid.identify(docs, langid.train(empty)).collect()} == {"und"}


def test_what_is_a_letter(spark):
    rest = cases.rows()[0][2:]
    model = langid.train(cases.documents(spark))
    bare, lettered = ["½ ² ③ Ⅳ", "٣ 12 ௧", "\u0301\u0308 _-", "🙂 ⓐ ㊀", "㉈\x00"], ["½ a", "ʰ", "ǅ", "汉", "é", "e\u0301", "ª 1"]
    rows = [(k, t, *rest) for k, t in enumerate(bare + lettered)]
    got = {r["doc_id"]: r for r in langid.identify(cases.documents(spark, rows), model).collect()}
    assert [got[k]["lang_pred"] == "und" for k in range(len(rows))] == [True] * len(bare) + [False] * len(lettered)
    assert all(got[k]["score"] == 0 for k in range(len(bare)))
