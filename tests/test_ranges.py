"""JSON arrays and CSV with quoted line ends, cut at every few bytes, against the standard library."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.sources.files import read_csv, read_json
from blockloom.sources.ranges import Bytes, _csv_effect, _csv_records, _json_effect, _json_records


def _whole(path, split, effect, records, states):
    """The records of a file by ranges of ``split`` bytes, states carried by a plain loop."""
    read, found, state = Bytes(str(path)), [], states(None, None)
    for start in range(0, read.size, split):
        end = min(read.size, start + split)
        found += records(read, {"path": str(path), "start": start, "end": end} | state)
        state = states(state, effect(read, start, end))
    return found


def _csv_state(state, effect):
    if state is None:
        return {"quoted": 0}
    return {"quoted": (effect["odd"] if effect["closed"] else effect["odd"] + state["quoted"]) % 2}


def _json_state(state, effect):
    if state is None:
        return {"quoted": 0, "depth": 0}
    return {"quoted": (state["quoted"] + effect["odd"]) % 2,
            "depth": state["depth"] + (effect["inner"] if state["quoted"] else effect["outer"])}


def _json_value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind < 3:
        return "".join(rng.choices('ab"\\{}[],:\n é😀', k=rng.randint(0, 12)))
    if kind < 5:
        return rng.choice([1, -2.5, True, None])
    if kind < 6:
        return [_json_value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {f"k{i}{_json_value(rng, 9)}": _json_value(rng, depth + 1) for i in range(rng.randint(0, 4))}


@pytest.mark.parametrize("split", [1, 2, 3, 7, 64, 10**6])
def test_array_objects_at_any_split(tmp_path, split):
    rng = random.Random(split)
    for n in range(12):
        items = [_json_value(rng) for _ in range(rng.randint(0, 20))]
        path = tmp_path / f"{n}.json"
        text = json.dumps(items, ensure_ascii=bool(n % 2), indent=[None, 1][n % 3 == 0])
        path.write_text(" \n"[:n % 3] + text + "\n " * (n % 2), encoding="utf-8")
        found = _whole(path, split, _json_effect, _json_records, _json_state)
        assert [json.loads(r) for _, r in found] == [x for x in items if isinstance(x, dict)]
        raw = path.read_bytes()
        assert all(raw[at:at + len(r)] == r for at, r in found) and [a for a, _ in found] == sorted(a for a, _ in found)


@pytest.mark.parametrize("broken", ['[{"a": 1} {"b": 2}]', '[{"a": 1},, {"b": 2}]', '[{"a": [1}, {"b": 2}]', '[{"a": 1}', '[{"a": 1}] x', '[x, {"a": 1}]'])
@pytest.mark.parametrize("split", [1, 5, 100])
def test_broken_arrays_fail(tmp_path, broken, split):
    path = tmp_path / "b.json"
    path.write_text(broken)
    with pytest.raises(ValueError):
        _whole(path, split, _json_effect, _json_records, _json_state)


def _cell(rng):
    return "".join(rng.choices(['a', 'b', '"', ',', '\n', '\r\n', ' ', 'é', ';', '""'], k=rng.randint(0, 6)))


@pytest.mark.parametrize("split", [1, 2, 3, 8, 50, 10**6])
@pytest.mark.parametrize("delimiter, ending", [(",", "\n"), ("\t", "\r\n"), (";", "\r"), ("||", "\n")])
def test_csv_records_at_any_split(tmp_path, split, delimiter, ending):
    rng = random.Random(split)
    for n in range(8):
        rows, text = [], ""
        for _ in range(rng.randint(1, 25)):
            row, shown = [], []
            for _ in range(rng.randint(1, 4)):
                if rng.random() < 0.3:  # unquoted, with quotes that are text
                    cell = "".join(rng.choices('ab" é', k=rng.randint(1, 5)))
                    cell = "x" + cell
                    shown.append(cell)
                else:
                    cell = _cell(rng)
                    shown.append('"' + cell.replace('"', '""') + '"')
                row.append(cell)
            rows.append(delimiter.join(shown))
        text = ending.join(rows) + ending * (n % 2)
        path = tmp_path / f"{n}.csv"
        path.write_text(text, encoding="utf-8", newline="")
        named = delimiter.encode()
        found = _whole(path, split, _csv_effect(named), _csv_records(named), _csv_state)
        assert b"".join(r for _, r in found) == path.read_bytes()
        assert [r.decode().removesuffix(ending) for _, r in found] == rows


@pytest.mark.parametrize("split", [150, 1 << 26])
def test_readers_at_small_splits(spark, tmp_path, split):
    rng = random.Random(3)
    items = [{"i": i, "t": _json_value(rng, 9)} if i % 4 else [i] for i in range(60)]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a b.json").write_text(json.dumps(items))
    (tmp_path / "j" / "c.json").write_text("[]")
    (tmp_path / "j" / "d.json").write_text("")
    found = read_json(spark, str(tmp_path / "j"), split_bytes=split).orderBy("_file", "_pos")
    got = [json.loads(r["v"]) for r in found.select(F.to_json("v").alias("v")).collect()]
    assert [g["i"] for g in got] == [x["i"] for x in items if isinstance(x, dict)]
    assert [g.get("t") for g in got] == [x["t"] for x in items if isinstance(x, dict)]

    rows = [[str(i), rng.choice(["", "a,b", 'say "hi"', "two\nlines", "x\r\ny"]), ["1.5", "2", ""][i % 3], ["true", "false"][i % 2]] for i in range(50)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([["id", "te xt", "num", "flag"], *rows, ["7", "long", "1", "true", "more"], ["8", "short"]])
    (tmp_path / "c.csv").write_text(out.getvalue() + "\n\n", newline="")
    df = read_csv(spark, str(tmp_path / "c.csv"), split_bytes=split)
    assert [f.dataType for f in df.schema][:4] == [T.IntegerType(), T.StringType(), T.DoubleType(), T.BooleanType()]
    got = [tuple(r)[:4] for r in df.orderBy("_pos").collect()]
    want = [(int(a), b.replace("\r\n", "\n") or None, float(c) if c else None, d == "true") for a, b, c, d in rows]
    assert [(a, b and b.replace("\r\n", "\n"), c, d) for a, b, c, d in got] == [*want, (8, "short", None, None)]


def test_many_small_files_share_tasks(spark, tmp_path):
    from blockloom.sources.ranges import csv_records, file_ranges
    for i in range(40):
        (tmp_path / f"f{i:02d}.csv").write_text(f"a,b\n{i},x\n")
    (tmp_path / "long.csv").write_text("a,b\n" + "1,x\n" * 300)
    ranges, tasks = file_ranges(spark, [str(tmp_path)], 1 << 20)
    assert tasks == ranges.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and ranges.count() == 41
    assert file_ranges(spark, [str(tmp_path / "long.csv")], 100)[1] == 13  # ranges of one file still are tasks of their own
    records = csv_records(spark, [str(tmp_path)], ",", 100)
    assert records.where("_pos > 0").count() == 340
