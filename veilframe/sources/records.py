"""Records of large files cut at their true starts by many tasks.

Where a record begins depends on all that stands before it: a line break inside quotes ends nothing. But a
block of lines does only one of few things to that state: whatever it is before the block, a small table says
what it is behind it. So tasks first work out a block's table each; composed in order, these tables (a row a
block, on the driver) give each block the state it begins with; then tasks cut the records. A record that goes
on over the end of a block is put together by its number.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.errors import InvalidInput

OUTSIDE, INSIDE = 0, 1


def quote_states(sep: str = ",") -> Callable[[str, int], int]:
    """What a line of a CSV file makes of the state before it: whether it ends inside quotes.

    Quotes open at the beginning of a field only, two of them inside quotes are one character, and what
    follows closing quotes up to the next separator belongs to the field.
    """
    other = re.escape(sep)
    quoted = f'"(?:[^"]++|"")*+"'
    rest = re.compile(f"(?:(?:{quoted}[^{other}]*+|(?!\")[^{other}]*+)(?:{other}|\\Z))*+\\Z")
    closing = re.compile(f'(?:[^"]++|"")*+"[^{other}]*+(?:{other}|\\Z)')

    def after(line: str, state: int) -> int:
        if '"' not in line:
            return state
        at = 0
        if state == INSIDE:
            closed = closing.match(line)
            if not closed:
                return INSIDE
            at = closed.end()
            if at == len(line) and not line.endswith(sep):
                return OUTSIDE
        return OUTSIDE if rest.match(line, at) else INSIDE

    return after


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def csv_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """file, number (1, 2, ... in a file), value of each record of CSV files. Blank lines between records are left out.

    A file is cut by as many tasks as it has blocks.
    """
    after = quote_states(sep)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block: the state behind it for both states before it, and how many records begin in it."""
        file = block = None
        states, starts = [0, 1], [0, 0]

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (file, block, *states, *starts)], ["file", "block", "from_0", "from_1", "starts_0", "starts_1"])

        for batch in batches:
            for own_file, own_block, line in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")), strict=True):
                if (own_file, own_block) != (file, block):
                    if file is not None:
                        yield row()
                    file, block, states, starts = own_file, own_block, [0, 1], [0, 0]
                for k in (0, 1):
                    if states[k] == OUTSIDE and line not in ("", "\r"):
                        starts[k] += 1
                    states[k] = after(line, states[k]) if states[k] == INSIDE or line not in ("", "\r") else OUTSIDE
        if file is not None:
            yield row()

    lines = _lines(spark, path)
    found = lines.mapInArrow(tables, "file string, block long, from_0 long, from_1 long, starts_0 long, starts_1 long").collect()  # a row a block
    first: dict[tuple[str, int], tuple[int, int]] = {}  # the state before a block, and the number of records that begin before it
    file, state, number = None, OUTSIDE, 0
    for r in sorted(found, key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, state, number = r["file"], OUTSIDE, 0
        first[r["file"], r["block"]] = state, number
        number += r[f"starts_{state}"]
        state = r[f"from_{state}"]
    shared = spark.sparkContext.broadcast(first)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records, or the parts of those that go over a block's end, with their numbers."""
        at, state, number, held, part = None, OUTSIDE, 0, [], False
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            names = ["file", "block", "number", "part", "value"]
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()), strict=True)], names)

        for batch in batches:
            for file, block, line in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")), strict=True):
                if (file, block) != at:
                    if held:
                        out.append((*at, number, True, "\n".join(held)))
                    at, held = (file, block), []
                    state, number = shared.value[at]
                    part = state == INSIDE  # what comes first goes on with a record of an earlier block
                if state == OUTSIDE and line in ("", "\r"):
                    continue
                if state == OUTSIDE:
                    number, part = number + 1, False
                held.append(line)
                state = after(line, state)
                if state == OUTSIDE:
                    out.append((file, block, number, part, "\n".join(held)))
                    held = []
            if out:
                yield made()
                out.clear()
        if held:
            out.append((*at, number, True, "\n".join(held)))
        if out:
            yield made()

    pieces = lines.mapInArrow(cut, "file string, block long, number long, part boolean, value string")
    whole = pieces.filter("not part").select("file", "number", "value")
    # of a record in parts, all but the last block hold one part each: the parts of one record are as many as its blocks
    parts = pieces.filter("part").groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "value"))).alias("parts"))
    return whole.unionByName(parts.select("file", "number", F.array_join("parts.value", "\n").alias("value")))


_signs = re.compile(r'["\[\]{},]')
_string_end = re.compile(r'(?:[^"\\]++|\\.)*+"', re.DOTALL)


def _json_signs(text: str, inside: bool) -> Iterator[tuple[int, str]]:
    """Places of brackets, braces and commas outside strings; at the end (len(text), state), state `"` inside a string, else empty. Texts end in a brace or with their file, so no backslash is cut from what it escapes."""
    at = 0
    if inside:
        closed = _string_end.match(text)
        if not closed:
            yield len(text), '"'
            return
        at = closed.end()
    while True:
        sign = _signs.search(text, at)
        if not sign:
            yield len(text), ""
            return
        at = sign.end()
        if sign.group() == '"':
            closed = _string_end.match(text, at)
            if not closed:
                yield len(text), '"'
                return
            at = closed.end()
        else:
            yield sign.start(), sign.group()


def _pieces(batches: Iterator[pa.RecordBatch], bare: dict[str, int]) -> Iterator[tuple[str, int, str, int]]:
    """file, block, text and bytes of what lies between braces that close; each with its brace but for the last of a block that bare names, by file."""
    held = None
    for batch in batches:
        for file, block, text, size in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value", "size")), strict=True):
            if held is not None:
                last = bare.get(held[0]) == held[1] and held[:2] != (file, block)
                yield held[0], held[1], held[2] if last else held[2] + "}", held[3] + 1
            held = file, block, text, size
    if held is not None:
        yield held[0], held[1], held[2] if bare.get(held[0]) == held[1] else held[2] + "}", held[3] + 1


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """file, number (1, 2, ... in a file), value of the elements of files that hold one JSON array each. What isn't an array gives elements that no parser takes.

    Files are read in parts that end at closing braces, also where there is no line break, by as many tasks as
    they have blocks. Of a block is known at first only whether it ends in a string and how much deeper than it
    began, for both states before it, and how many commas it has at each depth.
    """
    text = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.octet_length("value").alias("size"), F.col("_metadata.file_size").alias("whole"))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None

        def row() -> pa.RecordBatch:
            columns = [pa.array([x]) for x in (*at, read, *inside, *depth)] + [pa.array([list(c.items())], pa.map_(pa.int64(), pa.int64())) for c in commas]
            return pa.RecordBatch.from_arrays(columns, ["file", "block", "read", "inside_0", "inside_1", "depth_0", "depth_1", "commas_0", "commas_1"])

        for file, block, piece, size in _pieces(batches, {}):
            if (file, block) != at:
                if at is not None:
                    yield row()
                at, read, inside, depth, commas = (file, block), 0, [False, True], [0, 0], [{}, {}]
            read += size
            for k in (0, 1):
                for _, sign in _json_signs(piece, inside[k]):
                    if sign in ("", '"'):
                        inside[k] = bool(sign)
                    elif sign == ",":
                        commas[k][depth[k]] = commas[k].get(depth[k], 0) + 1
                    else:
                        depth[k] += 1 if sign in "[{" else -1
        if at is not None:
            yield row()

    found = text.drop("whole").mapInArrow(tables, "file string, block long, read long, inside_0 boolean, inside_1 boolean, depth_0 long, depth_1 long, commas_0 map<long,long>, commas_1 map<long,long>").collect()  # a row a block
    sizes = {r["file"]: r["whole"] for r in text.groupBy("file").agg(F.max("whole").alias("whole")).collect()}  # a row a file
    first: dict[tuple[str, int], tuple[bool, int, int]] = {}  # whether a block begins in a string, its depth, and the number of the element it begins in
    bare, total, read, ends, file = {}, {}, {}, {}, None
    for r in sorted(found, key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, inside, depth, number = r["file"], False, 0, 1
        first[file, r["block"]] = inside, depth, number
        k = int(inside)
        number += r[f"commas_{k}"].get(1 - depth, 0)
        inside, depth = r[f"inside_{k}"], depth + r[f"depth_{k}"]
        read[file] = read.get(file, 0) + r["read"]
        bare[file], total[file] = r["block"], number
        ends[file] = inside, depth
    # a file that ends with a brace has as many bytes as were read; one that does not has one less, that brace
    bare = {f: block for f, block in bare.items() if read[f] > sizes[f]}
    for f, end in ends.items():
        if end != (False, -1 if f in bare else 0):
            raise InvalidInput(f"{f} isn't a JSON array")
    shared = spark.sparkContext.broadcast((first, bare, total))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out, whole = None, [], [], False

        def made() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["file", "block", "number", "part", "value"])

        def put(part: bool) -> None:
            own = "".join(held)
            if held and (own.strip() or (whole and total[at[0]] > 1)):  # only an empty array has an element of nothing
                out.append((*at, number, part, own))
            held.clear()

        first, bare, total = shared.value
        for file, block, piece, _ in _pieces(batches, bare):
            if (file, block) != at:
                put(True)
                at = file, block
                inside, depth, number = first[at]
                whole = False  # what comes first may go on with an element of an earlier block
            start = 0
            for place, sign in _json_signs(piece, inside):
                if sign in ("", '"'):
                    inside = bool(sign)
                elif sign == ",":
                    if depth == 1:
                        held.append(piece[start:place])
                        put(not whole)
                        start, number, whole = place + 1, number + 1, True
                elif sign in "[{":
                    depth += 1
                    if depth == 1 and sign == "[":
                        if piece[start:place].strip():
                            held.append(piece[start:place])
                            put(True)
                        start, whole = place + 1, True
                else:
                    depth -= 1
                    if depth == 0:
                        held.append(piece[start:place])
                        put(not whole)
                        start, whole = place + 1, False
            if depth > 0 or inside:
                held.append(piece[start:])
            elif piece[start:].strip():
                held.append(piece[start:])
            if len(out) >= 1000:
                yield made()
                out.clear()
        put(True)
        if out:
            yield made()

    pieces = text.drop("whole").mapInArrow(cut, "file string, block long, number long, part boolean, value string")
    parts = pieces.filter("part").groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "value"))).alias("parts"))
    return pieces.filter("not part").select("file", "number", "value").unionByName(parts.select("file", "number", F.array_join("parts.value", "").alias("value")))
