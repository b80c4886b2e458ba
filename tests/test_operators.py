"""Sheet operators, search, extraction, validation, streams, and the workbench that ties them together."""

import random
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veilframe.errors import InvalidInput, ProcessorError
from veilframe.operators import columns, extract, search, sheet, validate
from veilframe.operators.sheet import ROW
from veilframe.plans.rules import built_in
from veilframe.workbench import Workbench

RULES = {r.id: r for r in built_in()}


def make(spark, rows, *names):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], f"{ROW} long, " + ", ".join(f"`{n}` string" for n in names))


@pytest.fixture(scope="module")
def people(spark):
    return make(spark, [("张三", "13812345678", "vip"), ("李四", "13987654321", "普通"), ("张五", "13700000000", "50%")], "name", "phone", "memo").cache()


def test_search(people):
    ids = lambda df: sorted(r[ROW] for r in df.collect())
    assert ids(search.search_rows(people, "张")) == [1, 3] and ids(search.search_rows(people, "%")) == [3] and ids(search.search_rows(people, "VIP")) == [1]
    assert ids(search.search_rows(people, "")) == [] and ids(search.search_rows(people, "name")) == [] and ids(search.search_rows(people, r"^139\d+$", True)) == [2]
    assert ids(search.search_rows(people, "张", columns=["phone"])) == []
    assert [tuple(r) for r in search.search_cells(people, "13").orderBy(ROW).collect()] == [(1, 1, "13812345678"), (2, 1, "13987654321"), (3, 1, "13700000000")]
    hits = search.with_hits(search.search_rows(people, "张三|12", True), "张三|12", True).collect()[0].asDict(True)
    assert hits["cells"][0] == "张三" and [(h["col_idx"], [(m["start"], m["end"]) for m in h["matches"]]) for h in hits["hits"]] == [(0, [(0, 6)]), (1, [(3, 5)])]
    upper = search.with_hits(search.search_rows(people, "VIP"), "VIP").collect()[0].asDict(True)
    assert [(h["col_idx"], h["matches"]) for h in upper["hits"]] == [(2, [])]
    with pytest.raises(InvalidInput):
        search.search_rows(people, "(", True)


def test_sheets(spark, people):
    assert [r["name"] for r in sheet.page(people, 2, 2).collect()] == ["张五"] and sheet.page(people, 0, 2).count() == 2
    assert sheet.select_rows(people, [1, 3, 9]).count() == 2 and sheet.select_rows(people, []).count() == 0 and sheet.select_rows(people, list(range(2000))).count() == 3
    assert sheet.project(people, ["memo", "name"]).columns == [ROW, "memo", "name"] and sheet.column_cells(people, "name").count() == 3
    assert sorted(map(tuple, sheet.wide(sheet.cells(people), sheet.headers(people)).collect())) == sorted(map(tuple, people.collect()))


def test_row_numbers_of_shuffled_rows(spark):
    wide = spark.range(60_000).select("id", F.repeat(F.md5(F.col("id").cast("string")), 28).alias("_file"))  # 900 bytes a row
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.parallelismFirst", "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4m")
        for first in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", first)
            for rows in (wide.repartitionByRange("id").sortWithinPartitions("id"), wide.orderBy("id")):
                numbered = sheet.number_rows(rows, in_files=False)
                assert numbered.columns == [ROW, "id", "_file"] and numbered.filter(f"{ROW} = id + 1").count() == numbered.count() == 60_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sheet.number_rows(wide.limit(0), in_files=False).count() == 0
    assert [tuple(r) for r in sheet.column_page(sheet.number_rows(spark.range(9).coalesce(1), in_files=False), "id", 4, 3).collect()] == [(5, 4), (6, 5), (7, 6)]


def test_intermediate_tables_can_be_cleaned(spark):
    from veilframe import storage

    sheet.number_rows(spark.range(3), in_files=False)
    assert storage.clean(spark) >= 1 and storage.clean(spark) == 0


def test_json_columns(spark):
    own = make(spark, [('{"a":1}',), ("not-json",), ('{"a":2, "b":{"c":[1, 2]}, "d":null, "e":""}',), ("[1,2,3]",), (None,), ('{"a":1} x',), ('{"a":1},{"a":2}',), ("{}",)], "payload")
    got = columns.expand_json(own, "payload")
    assert got.columns == ["source_row", "a", "b", "d", "e"]
    assert sorted(map(tuple, got.collect())) == [(1, "1", None, None, None), (3, "2", '{"c":[1,2]}', None, None), (8, None, None, None, None)]
    with pytest.raises(InvalidInput):
        columns.expand_json(own, "none")


def finds(df):
    return [tuple(r) for r in df.orderBy("rule_ord", "source_row", "pos").select("source_row", "type_label", "value", "valid", "note").collect()]


def test_extraction(spark):
    own = make(spark, [("from 192.168.1.1 and 256.1.1.1",), ("192.168.01.1 x 6222021234567890128",), (None,), ("none",)], "raw")
    rules = [RULES["ip4-extract"], RULES["bankcard-extract"], RULES["ip4-extract"]]
    got = extract.extract(own, "raw", rules)
    assert finds(got) == [(1, "IPv4地址", "192.168.1.1", True, ""), (1, "IPv4地址", "256.1.1.1", False, "非合法 IPv4 地址"), (2, "IPv4地址", "192.168.01.1", False, "非合法 IPv4 地址"), (2, "银行卡号", "6222021234567890128", True, "")]
    assert [tuple(r) for r in extract.extracted_sheet(got).collect()] == [("IPv4地址", "192.168.1.1"), ("银行卡号", "6222021234567890128")]
    assert extract.rows_without_candidates(own, "raw", rules).first()["skipped"] == 2
    with pytest.raises(InvalidInput):
        extract.extract(own, "raw", [])
    with pytest.raises(InvalidInput):
        extract.extract(own, "raw", [RULES["idcard-validate"]])


def joined_by_hand(rows, rules):
    """Candidates of the joined rows by one scan, each of the row in which it starts."""
    text, starts = "".join(t or "" for t in rows), []
    for i, t in enumerate(rows, 1):
        if t:
            starts.append((sum(len(u or "") for u in rows[: i - 1]), i))
    out = []
    for k, rule in enumerate(rules):
        count = {}
        for m in re.finditer(rule.pattern, text):
            row = max((s, i) for s, i in starts if s <= m.start())[1]
            out.append((row, k, count.get(row, 0), m[0]))
            count[row] = count.get(row, 0) + 1
    return sorted(out)


def test_extraction_from_joined_rows(spark):
    rng = random.Random(4)
    rules = [RULES["ip4-extract"], RULES["bankcard-extract"], RULES["phone-extract"]]
    words = ["192.168.1.1", "6222021234567890128", "13812345678", "é", "汉字", " ", "x", " , ", "10.0.0.1 "]
    text = "".join(rng.choice(words) for _ in range(1500))
    rows, at = [], 0
    while at < len(text):
        size = rng.choice([0, 0, 1, 2, 5, 9, 30, 400])
        rows.append((text[at : at + size] if size else rng.choice(["", None]),))
        at += size
    own = make(spark, rows, "content")
    want = joined_by_hand([t for (t,) in rows], rules)
    for stretch in (64, 1000, 100_000):
        got = extract.joined_candidates(own, "content", rules, 300, stretch).select("source_row", "rule", "pos", "value")
        assert sorted(map(tuple, got.collect())) == want
    for texts, rule, value in ((["prefix 19", "2.168.1.1 suffix"], "ip4-extract", "192.168.1.1"), (["data 6222021234567", "890128 end"], "bankcard-extract", "6222021234567890128")):
        sheet_ = make(spark, [(t,) for t in texts], "raw")
        assert finds(extract.extract(sheet_, "raw", [RULES[rule]], joined=True)) == [(1, RULES[rule].name.removesuffix("提取"), value, True, "")]
        assert extract.rows_without_candidates(sheet_, "raw", [RULES[rule]], joined=True).first()["skipped"] == 1
    assert extract.extract(own.limit(0), "content", rules, joined=True).count() == 0
    ids = make(spark, [("x 1101051949", "女"), ("1231002X", "男"), (" 110105194912310038", "f")], "raw", "sex")
    assert [f[:1] + f[3:] for f in finds(extract.extract(ids, "raw", [RULES["idcard-extract"]], gender_column="sex", joined=True))] == [(1, True, "女"), (3, False, "性别不一致: 身份证推断男，性别列f")]
    zero = make(spark, [("01010519491231002X",), ("none",)], "raw")
    assert extract.rows_without_candidates(zero, "raw", [RULES["idcard-extract"]]).first()["skipped"] == 2
    assert extract.rows_without_candidates(zero, "raw", [RULES["idcard-extract"]], idcard_allow_leading_zero=True).first()["skipped"] == 1


def test_extraction_of_id_cards(spark):
    own = make(spark, [("id 11010519491231002X", "男"), ("110105194912310038", "m"), ("110105194912310021", "女"), ("01010519491231002X", "")], "raw", "sex")
    assert [f[2:] for f in finds(extract.extract(own, "raw", [RULES["idcard-extract"]]))] == [("11010519491231002X", True, "女"), ("110105194912310038", True, "男"), ("110105194912310021", False, "非合法身份证号")]
    crossed = finds(extract.extract(own, "raw", [RULES["idcard-extract"]], gender_column="sex"))
    assert crossed[0][3:] == (False, "性别不一致: 身份证推断女，性别列男") and crossed[1][3:] == (True, "男")
    assert len(finds(extract.extract(own, "raw", [RULES["idcard-extract"]], idcard_allow_leading_zero=True))) == 4
    phones = make(spark, [("13812345678 15912345678",)], "raw")
    assert [f[3] for f in finds(extract.extract(phones, "raw", [RULES["phone-extract"]], phone_prefixes=["159"]))] == [False, True]


PEOPLE = [
    ("admin", "张三", "男", "19491231", "110105194912310038", "13412345678", "北京市朝阳区1号101室"),
    ("lufe1jian", "李四", "女", "19491231", "11010519491231002X", "15987654321", "北京市朝阳区2号102室"),
    ("a-1", "王五", "女", "19500101", "110105194912310038", "1341234567", "nowhere"),
    (None, None, None, None, None, None, None),
]
NAMES = ("username", "name", "sex", "birth", "idcard", "phone", "address")


def column_rules():
    plain = [validate.ColumnRule(c, RULES[f"{c}-validate"]) for c in ("username", "name", "sex", "birth", "phone", "address")]
    return [*plain, validate.ColumnRule("idcard", RULES["idcard-validate"], validate.CrossField("sex", "birth"))]


def test_rows_by_several_rules(spark):
    checked = validate.with_reasons(make(spark, PEOPLE, *NAMES), column_rules())
    good, bad = validate.split(checked)
    assert [r[ROW] for r in good.orderBy(ROW).collect()] == [1, 2] and bad.columns == good.columns == [ROW, *NAMES]
    got = {(r["source_row"], r["field"]): r["reason"] for r in validate.reasons(checked).collect()}
    assert got[3, "username"] == "用户名须为纯字母数字" and got[3, "phone"] == "手机号须为 11 位纯数字" and got[3, "sex"] == "性别不一致: 身份证推断男，性别列女"
    assert got[3, "birth"] == "出生日期与身份证号不一致: 身份证19491231，出生日期19500101" and got[4, "name"] == "值不匹配规则 姓名校验" and (3, "idcard") not in got
    assert [tuple(r) for r in validate.reason_tally(validate.reasons(checked)).collect()] == [("address", 2), ("birth", 2), ("phone", 2)]
    assert validate.reasons(validate.with_reasons(make(spark, PEOPLE, *NAMES), column_rules(), ["134"])).filter("source_row = 2").count() == 1
    with pytest.raises(InvalidInput):
        validate.with_reasons(make(spark, PEOPLE, *NAMES), [])


def test_plans_stay_native_and_scan_once(spark, tmp_path):
    make(spark, PEOPLE, *NAMES).write.parquet(str(tmp_path / "p"))
    own = spark.read.parquet(str(tmp_path / "p"))
    for df in (validate.with_reasons(own, column_rules()), extract.extract(own, "idcard", [RULES["idcard-extract"], RULES["phone-extract"]]), search.search_rows(own, "x")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and not re.search("Python|Pandas|Arrow", plan)
    checked = validate.with_reasons(own, column_rules())
    for df in (validate.reasons(checked), *validate.split(checked)):  # the checksum of an id card is made once
        assert df._jdf.queryExecution().optimizedPlan().toString().count("try_cast(substring(") == 1
    narrow = extract.extract(own, "idcard", [RULES["idcard-extract"]])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<_row_idx:bigint,idcard:string>" in narrow


def test_workbench(spark, tmp_path):
    data = tmp_path / "people.csv"
    data.write_text(",".join(NAMES) + "\n" + "\n".join(",".join(v or "" for v in r) for r in PEOPLE[:3]) + "\n")
    bench = Workbench(spark, str(tmp_path / "bench"))
    made = bench.import_file(str(data))
    one = made["sheet_id"]
    assert made["row_count"] == 3 and made["headers"] == list(NAMES) and bench.page(one, 1, 2)["total"] == 3
    cell = lambda c, r=1, s=None: bench.data(s or one).filter(F.col(ROW) == r).first()[c]
    assert bench.hash(one, "username", "md5") == {"affected": 3, "skipped": 0} and cell("username") == "21232f297a57a5a743894a0e4a801fc3"
    assert bench.mask(one, "phone", replacement="#", template={"keepPrefix": 3, "keepSuffix": 4}) == {"affected": 3} and cell("phone") == "134####5678"
    assert bench.replace(one, "address", "北京", "上海")["affected"] == 2 and bench.replace_all(one, "19491231", "x")["affected"] == 5
    kinds = [(o["kind"], o["id"]) for o in bench.undoable(one)]
    assert [k for k, _ in kinds] == ["replace_all", "replace", "mask", "hash"]
    assert bench.undo(kinds[3][1]) == {"restored": 3} and cell("username") == "admin" and cell("phone") == "134####5678"
    assert bench.redo(kinds[3][1]) == {"restored": 3} and cell("username").startswith("2123")
    assert bench.undo(kinds[0][1])["restored"] == 5 and cell("birth") == "19491231"
    with pytest.raises(ProcessorError):
        bench.undo(1)
    assert bench.base64(one, "name", "encode")["affected"] == 3 and bench.base64(one, "sex", "decode") == {"affected": 0, "skipped": 3} and bench.change_case(one, "idcard", "lower")["affected"] == 1
    assert bench.mask(one, "phone", validate_rule_id="phone-validate")["affected"] == 3 and cell("phone") == "INVALID"
    again = Workbench(spark, str(tmp_path / "bench"))
    assert again.data(one).count() == 3 and [o["undone"] for o in again.undoable(one)][-4:] == [True, False, False, False] and len(again.list_sessions()) == 1
    split = again.validate_split(one, [{"column": "birth", "rule_id": "birth-validate"}, {"column": "username", "rule_id": "username-validate"}])
    assert again.data(split["valid_sheet"]).count() == 3 and again.data(split["invalid_sheet"]).count() == 0 and split["reasons"].count() == 0
    assert again.search_rows(one, "INVALID", page=1, size=2)["total"] == 3 and again.search_cells(one, "INVALID", column="phone")["total"] == 3 and again.search_rows(one, "")["total"] == 0
    assert [s["name"] for s in again.list_sheets(1)] == ["people.csv", "people.csv_校验通过", "people.csv_校验失败"]


def test_workbench_sheets_from_text(spark, tmp_path):
    bench = Workbench(spark, str(tmp_path / "bench"))
    text = tmp_path / "long.txt"
    text.write_text("x" * 4083 + " 6222021234567890128 end")
    made = bench.import_file(str(text))
    assert made["row_count"] == 2
    joined, apart = (bench.extract(made["sheet_id"], "content", ["bankcard-extract"], join_chunks=j) for j in (True, False))
    assert joined["row_count"] == 1 and [tuple(r)[1:] for r in bench.data(joined["sheet_id"]).collect()] == [("银行卡号", "6222021234567890128")] and apart["row_count"] == 0
    lines = tmp_path / "p.jsonl"
    lines.write_text('{"payload":"{\\"a\\":1}"}\n{"payload":"no"}\n{"payload":"{\\"b\\":2}"}\n')
    made = bench.import_file(str(lines))
    opened = bench.expand_json(made["sheet_id"], "payload")
    assert opened["headers"] == ["a", "b"] and opened["row_count"] == 2 and opened["skipped"] == 1
    assert [tuple(r) for r in bench.data(opened["sheet_id"]).orderBy(ROW).collect()] == [(1, "1", None), (2, None, "2")]


def test_streams(spark, tmp_path):
    from veilframe.streaming import extract_stream, finds_by_window, mask_stream

    rows = [("2024-01-01 00:10:00", 1, "ip 10.0.0.1 and 300.1.1.1"), ("2024-01-01 00:20:00", 2, "10.0.0.2"), ("2024-01-01 02:00:00", 3, "1.2.3.4")]
    batch = spark.createDataFrame(rows, "at string, id long, text string").withColumn("at", F.to_timestamp("at"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))

    def result(df, name, mode="append"):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.table(name).collect()))

    rules = [RULES["ip4-extract"]]
    assert [r[0] for r in result(extract_stream(stream, "text", rules, "id").select("source_row", "value", "valid"), "finds")] == [1, 1, 2, 3]
    assert result(mask_stream(stream, {"text": None}).select("text"), "masked")[0][0][0] == "1"
    assert [r[1:] for r in result(finds_by_window(stream, "at", "text", rules), "windows", "complete")] == [("IPv4地址", 2), ("IPv4地址", 1)]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["source_row", "rule_ord", "pos", "type_label", "value", "valid", "note"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_training_data_subpackage(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "veilframe", tmp_path / "veilframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as e; from veilframe.queries import QUERIES; assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) <= set(QUERIES)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
