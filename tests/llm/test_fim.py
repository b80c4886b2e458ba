import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from veilframe.llm import fim


def test_boundary_lists_select_what_they_were_made_of():
    rng = random.Random(2)
    for step in (1, 2, 3, 9, 100, 5000):
        for size in (1, 2, 63, 64, 65, 511, 512, 513, 4000):
            numbers = np.cumsum([rng.randint(0, step) for _ in range(size)])
            own = fim.BoundaryList(numbers)
            assert [own.select(k) for k in range(size)] == numbers.tolist()
            for k in (-1, size):
                with pytest.raises(IndexError):
                    own.select(k)
    text = "aé汉🙂" * 500
    own = fim.boundaries(text.encode())
    assert own.size == 2001 and all(own.select(k) == len(text[:k].encode()) for k in range(2001))
    assert (len(own.high) + len(own.low)) * 8 < own.size * 5  # about 2 + log2(2.5) bits a number
    assert fim.boundaries(b"").select(0) == 0


def plainly(doc_id, text):
    """The contract, slicing the text itself."""
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def check(spark, rows):
    cuts = fim.fill_in_middle(cases.documents(spark, rows)).withColumn("restored", fim.restored(F.col("output"), F.col("form")))
    got = sorted((str(r["doc_id"]), r["n"], r["form"], str(r["prefix_chars"]), str(r["middle_chars"]), r["output"], r["restored"]) for r in cuts.collect())
    want = []
    for doc_id, text, *_ in rows:
        form, before, middle, output = plainly(doc_id, text or "")
        want.append((str(doc_id), len(text or ""), form, str(before), str(middle), output, text or ""))
    assert got == sorted(want)


def test_odd_rows(spark):
    rest = cases.rows()[0][2:]
    marks = ["<P>", "a<S>b", "<M", "<", "<P", "S><S", "<<P", "P>", "\x00é", "\n<S\n"]
    check(spark, cases.rows() + [(1000 + 50 * k + j, m * (j % 3 + 1), *rest) for k, m in enumerate(marks) for j in range(50)])
    assert fim.fill_in_middle(cases.documents(spark, [])).collect() == []


def test_a_text_that_many_rows_share(spark):
    """A third of all rows share a text, null ids among them: several tasks cut it, each of its ids apart."""
    rest = cases.rows()[0][2:]
    check(spark, [(k if k % 50 else None, "shared é " * 9 if k % 3 == 0 else f"own {k}", *rest) for k in range(1500)])


def test_equal_hashes_join_nothing(spark, monkeypatch):
    """With one hash for all texts they still have lists of their own."""
    monkeypatch.setattr(fim.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    check(spark, cases.rows())
