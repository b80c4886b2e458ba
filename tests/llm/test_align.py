import hashlib
import random
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm import cases
from tests.llm.test_tokens import odd_texts
from veilframe.llm import align
from veilframe.llm.queries import vocabulary
from veilframe.llm.token_count import byte_symbols

JSON, MODEL = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


class Plain:
    """The contract, with the libraries on whole texts and sets of ends."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
        self.a.encode_special_tokens = True
        self.byte = {s: b for b, s in byte_symbols().items()}

    def tokens(self, text):
        if not text:
            return [], []
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()) for i in self.b.encode(text) for p in [self.b.id_to_piece(i)]]
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])

    def groups(self, text):
        sides, ends = self.tokens(text), []
        for side in sides:
            at, own = 0, []
            for _, data in side:
                at += len(data)
                own.append(at)
            ends.append(own)
        common = sorted(set(ends[0]) & set(ends[1]))
        place = {e: k for k, e in enumerate(common)}
        made = [([], []) for _ in common]
        for side in (0, 1):
            k = 0
            for (i, _), end in zip(sides[side], ends[side], strict=True):
                made[k][side].append(i)
                k += end in place
        return made


def plainly(rows):
    own = Plain()
    all_groups = [own.groups(r[1]) for r in rows]
    links = [[(a, b) for x, y in groups for a in x for b in y] for groups in all_groups]
    counts = Counter(p for one in links for p in set(one))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    made = []
    for r, groups, own_links in zip(rows, all_groups, links, strict=True):
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(line.encode()).hexdigest() if groups else ""
        made.append((str(r[0]), sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(own_links), sum(counts[p] == most[p[0]] for p in own_links), sum(counts[p] for p in own_links), digest))
    return sorted(made)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def got(df):
    return sorted((str(r["doc_id"]), *[r[c] for c in COLUMNS[1:]]) for r in df.collect())


def texts():
    rng = random.Random(8)
    odd = ["▁", "a▁b", "<s>", "<0x0A>", " ", "  a", "a  ", "a \n b", "\n\n", "a\x00b", "é́", "ﬁ", "…" * 40, "汉字" * 300, "don't  we'll", "  x", "x\x1c y", "\r\n \r\n", "Ⅳ ½", "don 't 'll a"]
    mixed = ["".join(rng.choice([" ", " ", "the", "ing", "\n", "é", "q", "'s", ".", "\t", "9", "\xa0", "🙂", "x" * 70]) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    return odd + mixed + odd_texts(300)


def test_links_equal_the_contract(spark):
    rest = cases.rows()[0][2:]
    rows = cases.rows() + [(2000 + k, t, *rest) for k, t in enumerate(texts())]
    df = align.align_documents(cases.documents(spark, rows), JSON, MODEL)
    assert sorted(df.columns) == sorted(COLUMNS)
    assert got(df) == plainly(rows)


def test_many_pairs_are_joined_by_a_shuffle(spark):
    rows = cases.rows()
    assert got(align.align_documents(cases.documents(spark, rows), JSON, MODEL, broadcast_pairs=3)) == plainly(rows)


def test_empty_tables(spark):
    assert align.align_documents(cases.documents(spark, []), JSON, MODEL).collect() == []
    assert got(align.align_documents(cases.documents(spark, [(1, None, *cases.rows()[0][2:])]), JSON, MODEL)) == [("1", 0, 0, 0, 0, 0, 0, "")]


def unpacked(row):
    """Tokens of each document's words, from a row of tokenised texts."""
    return {d["doc_id"]: [row["words"][r] for r in d["refs"]] for d in row["docs"]}


def test_forgetting_and_groups_change_nothing(spark, monkeypatch):
    own = align.Encoder(open(JSON, encoding="utf-8").read(), open(MODEL, "rb").read())
    some = texts()[:200]
    whole = unpacked(align._group(own, 0, list(range(len(some))), some).to_pylist()[0])
    monkeypatch.setattr(align, "REMEMBERED", 5)
    for start in range(0, len(some), 7):
        part = align._group(own, 0, list(range(start, start + 7))[: len(some) - start], some[start : start + 7]).to_pylist()[0]
        for doc_id, found in unpacked(part).items():
            assert found == whole[doc_id]


def test_a_word_is_aligned_once_in_two_million_code_points(spark):
    own = [f"word{k % 50} and more of them " * 25 for k in range(2000)]  # 1.2 million
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(own)], "doc_id long, text string").coalesce(1)
    made = align.tokenised(docs, JSON, MODEL).selectExpr("size(docs) AS docs", "size(words) AS words").collect()
    assert [tuple(r) for r in made] == [(2000, len({w for t in own for w in align.words(t)}))]


def test_words_of_several_groups_are_kept_and_no_word_is_learned_alone_for_its_neighbour(monkeypatch):
    own = align.Encoder(open(JSON, encoding="utf-8").read(), open(MODEL, "rb").read())
    seen, tokens = [], own._tokens
    monkeypatch.setattr(own, "_tokens", lambda text: (seen.append(text), tokens(text))[1])
    monkeypatch.setattr(align, "REMEMBERED", 30)
    usual = [f"often{k}" for k in range(20)]
    some = [" ".join([*usual, f"once{group}", f"line{group}\n"]) for group in range(9)]
    rows = [unpacked(align._group(own, 0, [k], [t]).to_pylist()[0])[k] for k, t in enumerate(some)]
    # what several groups had is tokenised once; a word that ends in a line break goes alone, and its block stays whole
    assert seen[:2] == [" ".join([*usual, "once0"]), "line0\n"]
    assert [sum(w in text.split(" ") for text in seen) for w in usual] == [1] * 20
    plain = align.Encoder(open(JSON, encoding="utf-8").read(), open(MODEL, "rb").read())
    for k, t in enumerate(some):
        plain._forget()
        assert rows[k] == unpacked(align._group(plain, 0, [k], [t]).to_pylist()[0])[k]


def test_no_more_than_one_row_of_the_alignment_is_read_at_once(spark, monkeypatch):
    monkeypatch.setattr(align, "GROUP_ROWS", 3)
    made = align.align(cases.documents(spark, [(k, f"word{k}", *cases.rows()[0][2:]) for k in range(20)]).coalesce(1), JSON, MODEL)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in made.inputFiles()]
    groups = [f.row_group(k).num_rows for f in files for k in range(f.num_row_groups)]
    assert sum(groups) == made.count() > 5
    assert set(groups) == {1}


def test_the_batch_size_of_the_session_stays(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with align._sent(spark, 512):
        assert spark.conf.get(name) == "512"
    assert spark.conf.get(name) == before


def test_words_are_cut_where_no_token_reaches():
    for text in texts():
        cut = align.words(text)
        assert " ".join(cut) == text
        assert all(w and not w[-1].isspace() for w in cut[:-1])


def test_other_vocabularies_are_refused(spark):
    docs = cases.documents(spark)
    with pytest.raises(ValueError):
        align.align_documents(docs, vocabulary("word_bpe_49k.json"), MODEL)
    from sentencepiece import sentencepiece_model_pb2

    read = sentencepiece_model_pb2.ModelProto()
    read.ParseFromString(open(MODEL, "rb").read())
    read.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError, match="normalizer"):
        align.check_pieces(read.SerializeToString())
    read.normalizer_spec.remove_extra_whitespaces = False
    read.pieces[400].piece = "of▁the"
    with pytest.raises(ValueError, match="pieces"):
        align.check_pieces(read.SerializeToString())
