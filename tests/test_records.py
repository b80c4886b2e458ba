"""Records of large files that several tasks cut."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from veilframe import sources
from veilframe.errors import InvalidInput
from veilframe.operators.sheet import ROW, headers
from veilframe.sources import plain, records


@pytest.fixture
def blocks(spark):
    """Files are cut into blocks of this many bytes."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def set_to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield set_to
    for k, v in held.items():
        spark.conf.set(k, v)


def rows(df):
    return [tuple(r)[1:] for r in df.orderBy(ROW).collect()]


def test_states_of_lines_are_those_of_a_csv_parser():
    """Against reading character by character."""
    rng = random.Random(3)

    def plainly(line, inside):
        at_start, quoted, k = not inside, inside, 0
        while k < len(line):
            c = line[k]
            if quoted:
                if c == '"' and line[k : k + 2] == '""':
                    k += 1
                elif c == '"':
                    quoted = False
            elif c == '"' and at_start:
                quoted = True
            at_start = c == "," and not quoted
            k += 1
        return int(quoted)

    after = records.quote_states()
    for _ in range(20_000):
        line = "".join(rng.choice('a",,""') for _ in range(rng.randint(0, 12)))
        for state in (0, 1):
            assert after(line, state) == plainly(line, bool(state)), (line, state)
    assert after('"a,' * 100_000, 0) in (0, 1)


def test_quotes_with_line_breaks(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes(b'x,y\n"a""b,"open\nrest",c"d\n"a"b,"open\nrest"\nq"r,s\n')
    assert plain._probe_csv(spark, str(path), ",") == (False, True)
    path.write_bytes(b'x,y\nq"r,s"t\n"u",v\n')
    assert plain._probe_csv(spark, str(path), ",") == (False, False) and rows(plain.read_csv(spark, str(path))) == [('q"r', 's"t'), ("u", "v")]
    path.write_bytes(b'x,y\na"b,"open\nrest"\n')  # quotes are even on the first line and odd on the second
    assert rows(plain.read_csv(spark, str(path))) == [('a"b', "open\nrest")]
    path.write_bytes(b'x,y\na"b,"open\nrest",c"d\n')  # and here even on both
    assert rows(plain.read_csv(spark, str(path))) == rows(plain.read_csv(spark, str(path), multi_line=True)) == [('a"b', "open\nrest")]


@pytest.mark.parametrize("size", [300, 5000, 10**9])
def test_csv_in_blocks(spark, tmp_path, blocks, size):
    rng = random.Random(size)
    want = []
    (tmp_path / "in").mkdir()
    for file in ("a.csv", "b.csv"):
        own = [["h1", "h2", "h\n3"]] + [["".join(rng.choice('ab,"\n\r é') for _ in range(rng.randint(0, 9))) + "." for _ in range(rng.randint(1, 4))] for _ in range(50)]
        own.insert(9, ["long\n" * 300 + "end", '"', "x"])
        held = io.StringIO()
        csv.writer(held, lineterminator=rng.choice(["\n", "\r\n"]), quoting=csv.QUOTE_ALL).writerows(own)
        (tmp_path / "in" / file).write_bytes(held.getvalue().encode())
        want += [tuple((r + [None, None, None])[:3]) for r in own[1:]]
    blocks(size)
    df = plain.read_csv(spark, str(tmp_path / "in"))
    assert headers(df) == ["h1", "h2", "h\n3"]
    # the parser takes a line break of two characters in quotes as one
    same = lambda r: tuple(None if c is None else c.replace("\r\n", "\n") for c in r)
    assert list(map(same, rows(df))) == list(map(same, want))
    assert [r[0] for r in df.select(ROW).orderBy(ROW).collect()] == list(range(1, len(want) + 1))
    if size == 300:
        assert records._lines(spark, str(tmp_path / "in")).rdd.getNumPartitions() > 5


@pytest.mark.parametrize("size", [400, 10**9])
@pytest.mark.parametrize("indent", [None, 1])
def test_json_in_blocks(spark, tmp_path, blocks, size, indent):
    rng = random.Random(size)
    (tmp_path / "in").mkdir()
    want = []
    text = lambda: "".join(rng.choice('{}[],"\\é\n:a') for _ in range(rng.randint(0, 12)))
    for file in ("a.json", "b.json"):
        own = [{"k": text() + ".", "n": {"x": [1, {"y": text()}], "z": "}" * rng.randint(0, 4)}} for _ in range(40)]
        own.insert(5, {"k": "}" * 900 + "." + '"' * 30, "n": None})
        own[9:9] = [7, "text ] }", None, [1, {"a": 2}]]
        (tmp_path / "in" / file).write_text(json.dumps(own, indent=indent, ensure_ascii=False) + rng.choice(["", "\n", " \n "]))
        want += [o["k"] for o in own if isinstance(o, dict)]
    blocks(size)
    df = sources.load(spark, str(tmp_path / "in"), "json")
    assert headers(df) == ["k", "n"]
    got = df.orderBy(ROW).collect()
    assert [r["k"] for r in got] == want and [r[ROW] for r in got] == list(range(1, len(want) + 1))
    assert json.loads(got[0]["n"])["x"][0] == 1


def test_json_that_is_no_array(spark, tmp_path, blocks):
    blocks(9)
    path = tmp_path / "a.json"
    for bad in ('[{"a":1},]', '[{"a":1},,{"a":2}]', "[1 2]", '[{"a":1}', '[{"a":"x]', "[{]}", '[{"a":1}] x', "[,]", '[{"a":1}]}', '[{"a":1}}]'):
        path.write_text(bad)
        with pytest.raises(InvalidInput):
            plain.read_json(spark, str(path)).collect()
            print(bad)
    for good in ("[]", " [ ] ", "[\n]\n"):
        path.write_text(good)
        assert plain.read_json(spark, str(path)).collect() == []
    path.write_text('[{"a":"lone } ] [ { in \\" \\\\"}, {"a" : "\\u007d"}]')
    assert rows(plain.read_json(spark, str(path))) == [('lone } ] [ { in " \\',), ("}",)]


def test_rows_of_several_files_follow_each_other(spark, tmp_path):
    import sqlite3
    import zipfile

    (tmp_path / "docs").mkdir()
    for k in range(3):
        (tmp_path / "docs" / f"{k}.json").write_text('{\n "a": %d,\n "%s": 1}' % (k, "bcd"[k]))
    df = sources.load(spark, str(tmp_path / "docs"), "json")
    assert headers(df) == ["a", "b", "c", "d"] and [(r[ROW], r["a"]) for r in df.orderBy(ROW).collect()] == [(1, "0"), (2, "1"), (3, "2")]

    (tmp_path / "dbs").mkdir()
    for k in range(2):
        with sqlite3.connect(tmp_path / "dbs" / f"{k}.db") as db:
            db.execute("CREATE TABLE t (x INTEGER)")
            db.execute(f"CREATE TABLE a{k} (y TEXT)")
            db.executemany("INSERT INTO t VALUES (?)", [(10 * k + i,) for i in range(3)])
            db.execute(f"INSERT INTO a{k} VALUES ('own')")
        db.close()
    got = sources.load(spark, str(tmp_path / "dbs"), "db").orderBy(ROW).collect()
    assert [(r[ROW], r["__table"], r["x"], r["y"]) for r in got] == [(1, "a0", "", "own"), (2, "t", "0", ""), (3, "t", "1", ""), (4, "t", "2", ""), (5, "a1", "", "own"), (6, "t", "10", ""), (7, "t", "11", ""), (8, "t", "12", "")]

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    (tmp_path / "books").mkdir()
    cell = lambda t: f'<c t="inlineStr"><is><t>{t}</t></is></c>'
    for k, (heads, values) in enumerate([(("p", "q", "p"), ("1", "2", "3")), (("q", "r"), ("4", "5"))]):
        with zipfile.ZipFile(tmp_path / "books" / f"{k}.xlsx", "w") as z:
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row>{"".join(map(cell, heads))}</row><row>{"".join(map(cell, values))}</row></sheetData></worksheet>')
    df = sources.load(spark, str(tmp_path / "books"), "xlsx")
    assert headers(df) == ["p", "q", "r"] and rows(df) == [("3", "2", None), (None, "4", "5")] and [r[ROW] for r in df.orderBy(ROW).collect()] == [1, 2]
    assert df.filter(F.col(ROW) == 2).count() == 1


def test_json_lines_of_files_of_any_sizes_follow_each_other(spark, tmp_path, blocks):
    (tmp_path / "in").mkdir()
    want = []
    for name, n in (("a", 3), ("b", 200), ("c", 40)):  # the largest file is read first
        own = [f"{name}{k}" for k in range(n)]
        (tmp_path / "in" / f"{name}.jsonl").write_text("\n\n".join(json.dumps({"k": x}) for x in own) + "\n \n")
        want += own
    blocks(600)
    got = plain.read_json(spark, str(tmp_path / "in")).orderBy(ROW).collect()
    assert [(r[ROW], r["k"]) for r in got] == list(enumerate(want, 1))


def test_no_whole_line_of_json_reaches_the_driver(spark, tmp_path, monkeypatch):
    kept, first = [], DataFrame.first
    monkeypatch.setattr(DataFrame, "first", lambda self: kept.append(first(self)) or kept[-1])
    for text in (json.dumps([{"k": k} for k in range(500)]), json.dumps({str(k): k for k in range(500)})):
        (tmp_path / "a.json").write_text(text)
        plain.read_json(spark, str(tmp_path / "a.json"))
    assert kept and max(len(str(r)) for r in kept) < 200
    for text in ("} [1]", ' \n}{"a":1}', "}"):
        (tmp_path / "a.json").write_text(text)
        assert plain.read_json(spark, str(tmp_path / "a.json")).columns == [ROW]
