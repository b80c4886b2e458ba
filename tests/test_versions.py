"""Versions of sheets: cell edits, columns written anew, undo by swapped states, two sessions on one folder."""

import os

import pytest
from pyspark.sql import functions as F

from veilframe.errors import Conflict, InvalidInput
from veilframe.operators.sheet import ROW
from veilframe.workbench import Workbench


def sheet(spark, n=10):
    return spark.createDataFrame([(k, f"a{k}", None if k % 3 == 0 else f"b{k}", f"c{k}") for k in range(1, n + 1)], [ROW, "a", "b", "c"]).toDF(ROW, "a", "b", "x").select(ROW, "a", "b", F.col("x").alias("c d.x"))


def opened(spark, tmp_path, n=10, **options):
    bench = Workbench(spark, str(tmp_path / "bench"), **options)
    return bench, bench.add_sheet(1, "s", sheet(spark, n))


def rows(bench, one, columns=None):
    return {r[0]: tuple(r)[1:] for r in bench.store.read(bench.state(one), columns).collect()}


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)


def test_any_column_names(spark, tmp_path):
    bench = Workbench(spark, str(tmp_path / "bench"))
    one = bench.add_sheet(1, "s", spark.createDataFrame([(1, "x", "y")], f"{ROW} long, `c0` string, `_range` string"))
    assert bench.write_cells(one, [(1, "_range", "z")]) == {"written": 1, "added": 0}
    assert rows(bench, one) == {1: ("x", "z")}
    bench.compact(one)
    assert rows(bench, one) == {1: ("x", "z")}


def edited(bench, one):
    """Edits with repeated cells, nulls, new rows; and what the sheet is then."""
    edits = [(2, "a", "first"), (2, "a", "second"), (5, "b", None), (3, "b", "was null"), (12, "a", "new row"), (40, "b", None), (9, "a", "nine")]
    assert bench.write_cells(one, edits) == {"written": 6, "added": 2}


def plain(n=10):
    return {k: (f"a{k}", None if k % 3 == 0 else f"b{k}") for k in range(1, n + 1)}


def make(spark, tmp_path, **options):
    bench = Workbench(spark, str(tmp_path / "bench"), **options)
    base = spark.createDataFrame([(k, *v) for k, v in plain().items()], f"{ROW} long, a string, b string")
    return bench, bench.add_sheet(1, "s", base)


def wanted():
    want = plain()
    want[2], want[5], want[3], want[12], want[40], want[9] = ("second", "b2"), ("a5", None), ("a3", "was null"), ("new row", None), (None, None), ("nine", None)
    return want


def test_cells_are_put_in(spark, tmp_path):
    bench, one = make(spark, tmp_path)
    edited(bench, one)
    assert rows(bench, one) == wanted() and bench.state(one)["rows"] == 12
    assert rows(bench, one, ["b"]) == {k: v[1:] for k, v in wanted().items()}
    assert bench.page(one, 1, 50)["total"] == 12
    assert bench.write_cells(one, [(2, "a", "third"), (12, "b", "x"), (41, "a", "y")]) == {"written": 3, "added": 1}
    want = wanted() | {2: ("third", "b2"), 12: ("new row", "x"), 41: ("y", None)}
    assert rows(bench, one) == want
    assert bench.change_case(one, "a", "upper") == {"affected": 12, "skipped": 0}
    want = {k: (a and a.upper(), b) for k, (a, b) in want.items()}
    assert rows(bench, one) == want
    assert bench.write_cells(one, []) == {"written": 0, "added": 0}
    assert rows(Workbench(spark, str(tmp_path / "bench")), one) == want


def test_edits_that_cannot_be_put_in(spark, tmp_path):
    bench, one = make(spark, tmp_path)
    for bad in ([(1, "nope", "x")], [(0, "a", "x")], [(None, "a", "x")], [(1, None, "x")]):
        with pytest.raises(InvalidInput):
            bench.write_cells(one, bad)
    table = spark.createDataFrame([(1, "a", "x"), (1, "a", "y")], f"{ROW} long, column string, value string")
    with pytest.raises(InvalidInput):
        bench.write_cells(one, table)
    assert bench.write_cells(one, table.limit(1))["written"] == 1


def test_what_is_written_grows_with_the_edits(spark, tmp_path):
    bench, one = opened(spark, tmp_path, 20_000)
    before = size(tmp_path)
    bench.write_cells(one, [(k, "a", "x") for k in range(1, 20)])
    assert size(tmp_path) - before < before / 10
    before = size(tmp_path)
    operation = bench.undoable(one)[0]["id"]
    bench.undo(operation)
    bench.redo(operation)
    assert size(tmp_path) - before < 10_000


@pytest.mark.parametrize("compacted", [False, True])
def test_undo_of_edits_and_between_others(spark, tmp_path, compacted):
    bench, one = make(spark, tmp_path, range_rows=4)
    edited(bench, one)
    edit = bench.undoable(one)[0]["id"]
    if compacted:
        bench.compact(one)
        assert rows(bench, one) == wanted() and not any(c["cells"] for c in bench.state(one)["columns"].values())
        ranges = bench.state(one)["pieces"]
        assert len(ranges) == 2 and ranges[0]["without"] == ranges[1]["ranges"] == [0, 1, 2, 9]
    assert bench.undo(edit) == {"restored": 6}
    kept = plain() | {12: (None, None), 40: (None, None)}  # cells are put back; rows once added stay
    assert rows(bench, one) == kept
    assert bench.redo(edit) == {"restored": 6} and rows(bench, one) == wanted()
    # another change of the same column comes between: only cells that the edit changed are put back
    bench.replace(one, "a", "a", "A")
    assert bench.undo(edit)["restored"] == 6
    want = {k: (a and a.replace("a", "A"), b) for k, (a, b) in wanted().items()}
    for k, v in {2: "a2", 9: "a9", 12: None}.items():
        want[k] = (v, want[k][1])
    want = {k: (a, kept[k][1]) for k, (a, _) in want.items()}
    assert rows(bench, one) == want
    bench.compact(one)
    assert rows(bench, one) == want


def test_undo_runs_no_job(spark, tmp_path):
    bench, one = make(spark, tmp_path)
    bench.hash(one, "a", "md5")
    operation = bench.undoable(one)[0]["id"]
    spark.sparkContext.setJobGroup("undo", "undo")
    bench.undo(operation)
    bench.redo(operation)
    spark.sparkContext.setJobGroup("other", "other")
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("undo")) == []
    plan = bench.data(one, columns=["b"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_two_sessions(spark, tmp_path):
    bench, one = make(spark, tmp_path)
    other = Workbench(spark, str(tmp_path / "bench"))
    bench.hash(one, "a", "md5")
    with pytest.raises(Conflict):
        other.hash(one, "b", "md5")
    assert rows(other, one) == rows(bench, one)  # it has taken in the other's change
    other.hash(one, "b", "md5")
    assert [o["id"] for o in other.undoable(one)] == [2, 1]
    two = bench.add_sheet(1, "mine", sheet(spark))  # other sheets are no conflict, numbers stay apart
    three = other.add_sheet(1, "theirs", sheet(spark, 3))
    bench.refresh()
    assert (two, three) == (2, 3) and bench.data(three).count() == 3 and [s["position"] for s in bench.list_sheets(1)] == [0, 1, 2]
    assert sorted(os.listdir(tmp_path / "bench" / "log"))[-1] == f"{5:012d}.json"


def test_page_and_total_in_one_job(spark):
    from veilframe.operators import search

    data = spark.range(1, 2001, numPartitions=4).select(F.col("id").alias(ROW), F.concat(F.lit("v"), F.col("id") % 7).alias("a"))
    spark.sparkContext.setJobGroup("page", "page")
    got, total = search.result_page(search.search_cells(data, "v3"), [ROW, "col_idx"], 3, 20)
    spark.sparkContext.setJobGroup("other", "other")
    want = [k for k in range(1, 2001) if k % 7 == 3]
    assert total == len(want) and [r[ROW] for r in got] == want[40:60]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("page")) == 1
    assert search.result_page(search.search_cells(data, "zzz"), [ROW, "col_idx"], 2, 20) == ([], 0)
