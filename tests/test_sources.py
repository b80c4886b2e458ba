"""Readers, scripts and exports on small files."""

import sqlite3
import zipfile

import pytest

from veilframe import sinks, sources
from veilframe.errors import DataSourceError, DependencyMissing, InvalidInput, Unsupported
from veilframe.operators.sheet import ROW, headers, number_rows
from veilframe.plans.script import ScriptRunner, joined_inserts, statements


@pytest.fixture
def read(spark, tmp_path):
    def run(name, content, **options):
        path = tmp_path / name
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        df = sources.load(spark, str(path), **options)
        return headers(df), [tuple(r)[1:] for r in df.orderBy(ROW).collect()]

    return run


def test_csv(read):
    assert read("a.csv", "a,b\n1\n3,4,5\n") == (["a", "b"], [("1", None), ("3", "4")])
    assert read("b.csv", 'x,y\n"line\nbreak","say ""hi"""\n,z\n') == (["x", "y"], [("line\nbreak", 'say "hi"'), (None, "z")])
    assert read("c.csv", "") == ([], []) and read("d.csv", "a,b\n") == (["a", "b"], [])
    assert read("e.csv", "a,b,a\n1,2,3\n") == (["a", "b"], [("3", "2")])
    with pytest.raises(DataSourceError):
        read("f.csv", b"a\n\xff\n")


def test_json(read):
    assert read("a.json", '[{"a":1},{"a":2,"b":"y"},5]') == (["a", "b"], [("1", None), ("2", "y")])
    assert read("b.json", '[{"c":1,"a":null,"b":{"x":[1, 2]}}]') == (["c", "a", "b"], [("1", None, '{"x":[1,2]}')])
    assert read("c.jsonl", '{"b":true}\n\n{"a":"z"}\n') == (["b", "a"], [("true", None), (None, "z")])
    assert read("d.json", '{\n "a": 1,\n "b": "q"\n}') == (["a", "b"], [("1", "q")])
    assert read("e.json", "hello") == ([], [])
    with pytest.raises(InvalidInput):
        read("f.jsonl", '{"a":1}\nnot json\n')


def test_txt(read):
    assert read("a.txt", "one\r\n\ntwo\rtwo\n") == (["content"], [("one",), ("",), ("two\rtwo",)])
    assert [len(r[0]) for r in read("b.txt", "x" * 4097)[1]] == [4096, 1] and [len(r[0]) for r in read("c.txt", "x" * 8192)[1]] == [4096, 4096]
    assert [r[0] for r in read("d.txt", "x" * 4094 + "中文")[1]] == ["x" * 4094, "中文"]
    assert read("e.txt", "")[1] == [] and read("f.txt", b"a\xff\nb\n")[1] == [("a\ufffd",), ("b",)]


def test_logs(read):
    names, rows = read("a.log", '10.0.0.1 - - [17/Nov/2023:03:44:24 +0000] "GET / HTTP/1.1" 200 - "-" "Mozilla/5.0"\n10.0.0.2 - - [x] "-" 408 0 "-" "-"\nother\n')
    assert len(names) == 12 and rows[0] == ("10.0.0.1", "-", "-", "17/Nov/2023:03:44:24 +0000", "GET", "/", "HTTP/1.1", "200", "0", "-", "Mozilla/5.0", rows[0][-1])
    assert rows[1][4:9] == ("", "", "", "408", "0") and rows[2] == (None,) * 11 + ("other",)
    assert len(read("b.log", 'h - u [t] "GET /x HTTP/1.0" 200 12\n')[0]) == 10
    names, rows = read("c.log", "Jan  1 00:00:01 host sshd[42]: hi there\nJan  1 00:00:02 host cron: no pid\n")
    assert names == ["timestamp", "host", "process", "pid", "message", "raw_line"] and rows[0][2:5] == ("sshd", "42", "hi there") and rows[1][3] == ""
    names, rows = read("d.log", "2024-01-02 03:04:05.6Z ERROR [main] bad thing\n")
    assert names == ["timestamp", "level", "thread", "message", "raw_line"] and rows[0][:4] == ("2024-01-02 03:04:05.6Z", "ERROR", "main", "bad thing")
    assert read("e.log", "free text\n") == (["line"], [("free text",)])


def test_sqlite(read, tmp_path):
    path = tmp_path / "made.db"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE users (id INTEGER, name TEXT)")
        db.execute("CREATE TABLE orders (id INTEGER, user_id INTEGER, amount REAL)")
        db.execute("CREATE TABLE zero (only_here TEXT)")
        db.executemany("INSERT INTO users VALUES (?, ?)", [(1, "a"), (2, None)])
        db.executemany("INSERT INTO orders VALUES (?, ?, ?)", [(7, 1, 9.9), (8, 2, 1.0), (9, 2, 1e20)])
    db.close()
    names, rows = read("x.db", path.read_bytes())
    assert names == ["__table", "id", "user_id", "amount", "name", "only_here"]
    assert rows == [("orders", "7", "1", "9.9", "", ""), ("orders", "8", "2", "1", "", ""), ("orders", "9", "2", "100000000000000000000", "", ""), ("users", "1", "", "", "a", ""), ("users", "2", "", "", "", "")]
    assert read("y.db", b"") == ([], [])
    with pytest.raises(Exception, match="not a database|DataSourceError"):
        read("z.db", b"garbage" * 200)


def test_xlsx(read, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    path = tmp_path / "made.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>name</t></si><si><r><t>va</t></r><r><t>lue</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="inlineStr"><is><t>x</t></is></c><c r="C2"><v>2.0</v></c></row><row><c r="C3" t="b"><v>1</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {main}/>")
    assert read("b.xlsx", path.read_bytes()) == (["name", "value"], [("x", "2"), (None, "true")])


def test_xlsx_dates_and_order(read, tmp_path):
    main, office, package = ('xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006/relationships")
    path = tmp_path / "made.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{office}"><sheets><sheet name="b" sheetId="2" r:id="r2"/><sheet name="a" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="164" formatCode="yyyy&quot;x&quot;mm"/><numFmt numFmtId="165" formatCode="0.00&quot;day&quot;"/></numFmts><cellXfs><xf/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}/>")
        cell = lambda at, v, s: f'<c r="{at}" s="{s}"><v>{v}</v></c>'
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {main}><sheetData><row>{cell("A1", 7, 0)}{cell("B1", 8, 0)}</row><row>{cell("A2", 45292, 1)}{cell("B2", 45292.75, 2)}</row><row>{cell("A3", 0.5, 1)}{cell("B3", 1.5, 3)}</row><row>{cell("A4", 1, 1)}</row></sheetData></worksheet>')
    assert read("c.xlsx", path.read_bytes()) == (["7", "8"], [("2024-01-01", "2024-01-01T18:00:00"), ("12:00:00", "1.5"), ("1900-01-01", None)])


def test_captures(spark, tmp_path):
    path = tmp_path / "d.tsv"
    path.write_text("1\t10.0.0.1\t8.8.8.8\tPOST\thost\t/api\t48656c6c6fzz4\tua\n\n2\t\t\tGET\n")
    rows = [tuple(r) for r in sources.pcap.read_dissected(spark, str(path)).orderBy(ROW).collect()]
    assert rows == [(1, "1", "10.0.0.1", "8.8.8.8", "POST", "host", "/api", "Hello", "ua"), (2, "2", "", "", "GET", "", "", "", "")]
    with pytest.raises(DependencyMissing):
        sources.pcap.read_pcap(spark, str(path), tshark="/no/such/program")


def test_formats(spark):
    assert sources.detect("/x/Y.CSV") == "csv"
    with pytest.raises(Unsupported):
        sources.load(spark, "a.unknown")


def test_statements():
    assert statements("a; -- c;\nb /* ; */ 'x;''y' \"z;\";") == ["a", "b   'x;''y' \"z;\""]


def test_scripts(read, spark):
    users = "CREATE TABLE IF NOT EXISTS users (\n username TEXT, sex TEXT, age INT);\nINSERT INTO users VALUES ('n','男', 3);\nINSERT INTO users (sex, username) VALUES ('女','w'), ('女','v');\n"
    assert read("a.sql", users + "SELECT username, age FROM users WHERE sex = '男';\nUPDATE users SET age = age + 1, username = 'N' WHERE username = 'n';") == (["username", "age"], [("N", "4")])
    assert sorted(read("b.sql", users + "DELETE FROM users WHERE username = 'v';")[1]) == [("n", "男", "3"), ("w", "女", "")]
    dump = "/*!40101 SET NAMES utf8 */;\nUSE `db`;\nLOCK TABLES `t` WRITE;\nCREATE TABLE `t` (`id` int NOT NULL AUTO_INCREMENT, `name` varchar(9) COLLATE utf8_bin COMMENT 'x', PRIMARY KEY (`id`)) ENGINE=InnoDB;\nINSERT INTO `t` VALUES (1,'It\\'s a test'),(2,'path \\\"C:\\\\x\\\"');\nUNLOCK TABLES;"
    assert read("c.sql", dump) == (["id", "name"], [("1", "It's a test"), ("2", 'path "C:\\x"')])
    joined = users + "CREATE TABLE o (who TEXT, n INT); INSERT INTO o VALUES ('n', 2), ('n', 5), ('w', 1); SELECT u.username, sum(o.n) AS total FROM users u JOIN o ON o.who = u.username GROUP BY u.username; SELECT who FROM o WHERE n > 4;"
    assert sorted(read("d.sql", joined)[1]) == [("", "", "n"), ("n", "7", ""), ("w", "1", "")]
    with pytest.raises(DataSourceError):
        ScriptRunner(spark).script("SELECT * FROM nowhere")
    assert read("e.sql", "-- nothing") == ([], [])


def test_scripts_that_change_tables(read, spark):
    made = "CREATE TABLE t (a INT, b TEXT); INSERT INTO t VALUES (1, 'x'), (2, 'y');"
    assert read("f.sql", made + "DROP TABLE t; CREATE TABLE t (c TEXT); INSERT INTO t VALUES ('new');") == (["c"], [("new",)])
    assert read("g.sql", "DROP TABLE IF EXISTS t;" + made + "DROP TABLE IF EXISTS `t`, u; CREATE TABLE t (c TEXT); INSERT INTO t VALUES ('new');") == (["c"], [("new",)])
    assert read("h.sql", made + "CREATE TABLE IF NOT EXISTS t (c TEXT);") == (["a", "b"], [("1", "x"), ("2", "y")])
    assert read("i.sql", made + "ALTER TABLE t ADD COLUMN n DECIMAL(5, 2) NULL, ADD PRIMARY KEY (a); INSERT INTO t VALUES (3, 'z', 0.5); ALTER TABLE t RENAME COLUMN b TO name; ALTER TABLE t DROP COLUMN a;") == (["name", "n"], [("x", ""), ("y", ""), ("z", "0.5")])
    assert read("j.sql", made + "ALTER TABLE t RENAME TO u; INSERT INTO u VALUES (3, 'z');") == (["a", "b"], [("1", "x"), ("2", "y"), ("3", "z")])
    for refused in ("INSERT OR IGNORE INTO t VALUES (1, 'z')", "INSERT OR REPLACE INTO t VALUES (1, 'z')", "INSERT IGNORE INTO t VALUES (1, 'z')", "ALTER TABLE t ADD n INT DEFAULT 5", "ALTER TABLE t MODIFY a TEXT"):
        with pytest.raises(Unsupported):
            ScriptRunner(spark).script(made + refused)
    for wrong in ("DROP TABLE u", "DROP TABLE t", "CREATE TABLE t (c TEXT)", "ALTER TABLE u ADD n INT", "ALTER TABLE t ADD a INT", "ALTER TABLE t RENAME COLUMN q TO r", "ALTER TABLE t RENAME COLUMN a TO b", "ALTER TABLE t DROP COLUMN q"):
        with pytest.raises(DataSourceError):
            ScriptRunner(spark).script(made + wrong)


def sheet(spark, rows, names):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], f"{ROW} long, " + ", ".join(f"`{n}` string" for n in names))


def texts(lines):
    return [r["line"] for r in lines.orderBy(*[c for c in (ROW, "at") if c in lines.columns]).collect()]


def test_declarations_of_scripts(read, spark):
    got = read("a.sql", "CREATE TABLE t (a INT DEFAULT 5, b TEXT DEFAULT 'it''s, (so)', c TEXT DEFAULT NULL, d REAL DEFAULT -1.5, e TEXT NOT NULL DEFAULT \"x\"); INSERT INTO t (c) VALUES ('1'), ('2'); INSERT INTO t (a, e) VALUES (7, 'y');")
    assert got == (["a", "b", "c", "d", "e"], [("5", "it's, (so)", "1", "-1.5", "x"), ("5", "it's, (so)", "2", "-1.5", "x"), ("7", "it's, (so)", "", "-1.5", "y")])
    made = "CREATE TABLE t (a INT PRIMARY KEY, b TEXT UNIQUE, c TEXT, UNIQUE (b, c)); INSERT INTO t VALUES (1, 'x', 'p'), (2, 'y', NULL), (3, NULL, NULL), (4, NULL, NULL);"
    assert len(read("b.sql", made)[1]) == 4
    for refused in ("INSERT INTO t VALUES (1, 'z', 'z')", "INSERT INTO t VALUES (5, 'x', 'z')", "UPDATE t SET b = 'same'", "INSERT INTO t VALUES (6, 'q', 'q'), (6, 'r', 'r')"):
        with pytest.raises(DataSourceError, match="repeat"):
            read("c.sql", made + refused + ";")
    assert len(read("d.sql", made + "DELETE FROM t WHERE a = 1; INSERT INTO t VALUES (1, 'x', 'p');")[1]) == 4
    assert len(read("e.sql", made + "ALTER TABLE t RENAME COLUMN b TO n; INSERT INTO t VALUES (7, 'w', 'w');")[1]) == 5
    with pytest.raises(DataSourceError, match="repeat"):
        read("f.sql", made + "ALTER TABLE t RENAME COLUMN b TO n; INSERT INTO t VALUES (7, 'x', 'w');")
    assert len(read("g.sql", made + "ALTER TABLE t DROP COLUMN b; INSERT INTO t VALUES (7, 'w');")[1]) == 5
    for refused in ("CREATE TABLE n (i INTEGER PRIMARY KEY, b TEXT); INSERT INTO n (b) VALUES ('x');", "CREATE TABLE n (d TEXT DEFAULT CURRENT_TIMESTAMP, b TEXT); INSERT INTO n (b) VALUES ('x');", "CREATE TABLE n (d TEXT DEFAULT (1 + 2), b TEXT); INSERT INTO n (b) VALUES ('x');"):
        with pytest.raises(Unsupported):
            read("h.sql", refused)
    with pytest.raises(DataSourceError, match="nulls"):
        read("i.sql", "CREATE TABLE n (i INT NOT NULL, b TEXT); INSERT INTO n (b) VALUES ('x');")


def test_tables_made_of_queries(read):
    made = "CREATE TABLE t (a INT, b TEXT); INSERT INTO t VALUES (1, 'x'), (2, 'y'); CREATE TABLE u AS SELECT a + 10 AS a, upper(b) AS c FROM t WHERE a > 1; INSERT INTO t VALUES (3, 'z'); INSERT INTO u VALUES (4, 'own');"
    assert read("a.sql", made) == (["a", "c"], [("12", "Y"), ("4", "own")])
    assert read("b.sql", made + "SELECT count(*) AS n FROM t; SELECT c FROM u ORDER BY a;") == (["n", "c"], [("3", ""), ("", "own"), ("", "Y")])


def test_many_inserts_make_one_plan(spark):
    script = ["CREATE TABLE t (a INT, b TEXT)", *[f"INSERT INTO t VALUES ({k}, 'x, {k}')" for k in range(300)], "INSERT INTO t (b) VALUES ('own')", "INSERT INTO t VALUES (7, 'last')"]
    joined = joined_inserts(script)
    assert len(joined) == 4 and joined[0] == script[0] and joined[2:] == script[-2:]
    got = ScriptRunner(spark).script(";".join([*script, "SELECT count(*) AS n, sum(a) AS s, max(b) AS b FROM t"])).result
    assert [tuple(r) for r in got.collect()] == [("302", str(sum(range(300)) + 7), "x, 99")]


def test_exports(spark, tmp_path):
    own = sheet(spark, [("a;b", None), ('say "x"', "l\nm")], ["one", "status"])
    assert texts(sinks.csv_lines(own, sep=";")) == ["﻿one;status", '"a;b";', '"say ""x""";"l\nm"']
    assert texts(sinks.csv_lines(own, ["status"], header=False)) == ["", '"l\nm"']
    import json

    assert [json.loads(x) for x in texts(sinks.json_objects(own))] == [{"one": "a;b", "status": ""}, {"one": 'say "x"', "status": "l\nm"}]
    array = "\n".join(texts(sinks.json_array_lines(own)))
    assert json.loads(array) == [{"one": "a;b", "status": ""}, {"one": 'say "x"', "status": "l\nm"}] and array == json.dumps(json.loads(array), indent=2)
    assert texts(sinks.json_array_lines(own.limit(0))) == ["[", "]"]
    assert texts(sinks.text_lines(own, "{name}: {值}", ["status", "one"])) == ["status: ", "one: a;b", "status: l\nm", 'one: say "x"']
    assert texts(sinks.text_lines(own, "<{one}|{nope}|{status}>")) == ["<a;b||>", '<say "x"||l\nm>']
    assert sinks.separator("custom") == "\t" and sinks.separator("pipe") == "|"
    sinks.write_lines(sinks.csv_lines(own), str(tmp_path / "out"), single_file=True)
    part = next((tmp_path / "out").glob("part-*"))
    assert part.read_bytes() == '﻿one,status\r\na;b,\r\n"say ""x""","l\nm"\r\n'.encode()


def test_row_numbers_follow_the_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.txt").write_text("".join(f"{k}-{i}\n" for i in range(2000 * (k + 1))))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        rows = [tuple(r) for r in number_rows(spark.read.text(str(tmp_path))).orderBy(ROW).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == list(enumerate((f"{k}-{i}" for k in range(3) for i in range(2000 * (k + 1))), 1))
