import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm import cases
from veilframe.llm import packing, token_count
from veilframe.llm.queries import vocabulary

JSON, RANKS = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")
ODD = [*"ab cZ9.,'s\n\t é汉²Ⅳ\x1c\x1f\x85\xa0 　_-́🙂", "<|endoftext|>", "  ", "'ll", " \n", "ing"]


def odd_texts(n):
    rng = random.Random(3)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_counts_equal_the_library():
    library, own = Tokenizer.from_file(JSON), token_count.TokenCounter(open(JSON, encoding="utf-8").read())
    some = odd_texts(4000) + [r[1] or "" for r in cases.rows()]
    assert [own.count(t) for t in some] == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]


def test_other_vocabularies_are_refused():
    read = json.loads(open(JSON, encoding="utf-8").read())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {**read["pre_tokenizer"], "add_prefix_space": True}}, {"model": {**read["model"], "ignore_merges": True}}, {"added_tokens": [{**read["added_tokens"][0], "lstrip": True}]}):
        with pytest.raises(ValueError, match=next(iter(change)).replace("model", "merges")):
            token_count.TokenCounter(json.dumps({**read, **change}))
    with pytest.raises(ValueError):
        token_count.TokenCounter(open(vocabulary("word_bpe_49k.json"), encoding="utf-8").read())


def test_counts_of_rows(spark):
    library = Tokenizer.from_file(JSON)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_count.count_tokens(cases.documents(spark), JSON).collect())
    want = sorted((str(r[0]), len((r[1] or "").encode()), n := len(library.encode(r[1] or "", add_special_tokens=False).ids), n > 1024) for r in cases.rows())
    assert got == want
    assert token_count.count_tokens(cases.documents(spark, []), JSON).collect() == []


def test_best_fit_matches_a_plain_search():
    rng = random.Random(4)
    for _ in range(30):
        most = rng.choice([1, 7, 64, 100])
        sizes = [rng.randint(0, most) for _ in range(rng.randint(0, 80))]
        space, rows = [], []
        for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            fits = [c for c in space if c >= sizes[k]]
            if fits:
                at = space.index(min(fits))
            else:
                at = len(space)
                space.append(most)
                rows.append([])
            space[at] -= sizes[k]
            rows[at].append(k)
        got = packing.best_fit(sizes, most)
        assert sorted(k for row in got for k in row) == list(range(len(sizes)))
        assert all(sum(sizes[k] for k in row) <= most for row in got)
        assert sorted(sum(sizes[k] for k in row) for row in got) == sorted(sum(sizes[k] for k in row) for row in rows)


def test_round_trip(spark):
    rows = [r for r in cases.rows() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values()) + [(100 + k, t, *rows[0][2:]) for k, t in enumerate(odd_texts(200))]
    docs = cases.documents(spark, rows)
    packed = packing.pack_documents(docs, RANKS, width=100, block_tokens=3000)
    assert {r[0]: r[1] or "" for r in rows} == {r["doc_id"]: r["text"] for r in packing.unpack(packed, RANKS).collect()}
    for r in packed.collect():
        ids, positions, ends = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2"), r["cu_seqlens"]
        assert len(ids) == len(positions) == 100 and ends[0] == 0 and ends[-1] == r["n_tokens"] and (ids[ends[-1] :] == 50256).all()
        assert r["position_resets"] == ends[:-1] and len(r["doc_ids"]) == len(r["doc_offsets"]) == len(ends) - 1
        assert all((positions[a:b] == np.arange(b - a)).all() for a, b in zip(ends, ends[1:], strict=False))


def test_odd_rows_are_packed(spark):
    packed = packing.pack_documents(cases.documents(spark), RANKS)
    assert sorted(map(str, {d for r in packed.collect() for d in r["doc_ids"]})) == sorted(map(str, {r[0] for r in cases.rows()}))
    assert packing.pack_documents(cases.documents(spark, []), RANKS).collect() == []
