"""Byte-range reading of JSON array and quoted CSV files against one-task readers."""

import csv
import io
import json
import random

import pytest

from pairwright.session import local_fs_path
from pairwright.sources import splits as P

SIGNS = ['"', "\\", "{", "}", "[", "]", ",", "\n", " ", "é", "中", "a", "b", ":", '{"', '"}', '\\"', "}{", "x" * 30]


def texts(seed, n):
    rnd = random.Random(seed)
    one = lambda: None if rnd.random() < 0.1 else "".join(rnd.choice(SIGNS) for _ in range(rnd.randrange(0, 25)))
    return [(i, one(), one()) for i in range(n)]


def put(spark, tmp_dir, **files):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(tmp_dir)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    for name, text in files.items():
        with open(f"{local_fs_path(tmp_dir)}/{name}", "w", newline="") as f:
            f.write(text)
    return tmp_dir


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("split_bytes", [None, 150, 2000])
@pytest.mark.parametrize("indent", [None, 1])
def test_json_arrays(spark, tmp_dir, split_bytes, indent):
    rows = texts(split_bytes or 1, 120)
    files = {}
    for k in range(3):
        part = [{"pair_id": i, "NL": n, "FOL": f} for i, n, f in rows[40 * k:40 * k + 40]]
        files[f"f{k}.json"] = json.dumps(part, indent=indent, ensure_ascii=k == 1) + "\n" * k
    files |= {"empty_array.json": "[]", "blank.json": " \n", "nothing.json": ""}
    path = put(spark, tmp_dir, **files)
    got = P.read_json_array_pairs(spark, path, split_bytes=split_bytes)
    assert rows_of(got) == sorted(rows, key=str)
    assert rows_of(spark.read.schema("pair_id long, NL string, FOL string").option("multiLine", True).json(path).where("pair_id IS NOT NULL")) == sorted(rows, key=str)


def test_nested_objects_and_arrays(spark, tmp_dir):
    part = [{"pair_id": i, "extra": {"a": [{"b": "}]"}, [1, {"c": {}}]], "d": {}}, "NL": "n}" * i, "FOL": '{"'} for i in range(20)]
    path = put(spark, tmp_dir, **{"a.json": json.dumps(part)})
    want = sorted(((r["pair_id"], r["NL"], r["FOL"]) for r in part), key=str)
    for split_bytes in (64, 1000):
        assert rows_of(P.read_json_array_pairs(spark, path, split_bytes=split_bytes)) == want


def test_a_record_over_many_splits(spark, tmp_dir):
    rows = [(1, "a", "b"), (2, '}"{,\n' * 2000, "y}" * 500), (3, "c", "d")]
    path = put(spark, tmp_dir, **{"a.json": json.dumps([{"pair_id": i, "NL": n, "FOL": f} for i, n, f in rows])})
    got = P.read_json_array_pairs(spark, path, split_bytes=500)
    assert rows_of(got) == sorted(rows, key=str)


@pytest.mark.parametrize("split_bytes", [None, 110, 1500])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_csv(spark, tmp_dir, split_bytes, end):
    rows = texts(split_bytes or 2, 120)
    files = {}
    for k in range(2):
        out = io.StringIO()
        w = csv.writer(out, quoting=csv.QUOTE_ALL if k else csv.QUOTE_MINIMAL, lineterminator=end)
        w.writerow(["pair_id", "nl\nsentence", "fol_expression"])
        for i, n, f in rows[60 * k:60 * k + 60]:
            # Minimal quoting leaves empty and \\N fields bare: a bare empty field reads as null too, so none is written.
            w.writerow([i, "\\N" if n is None else n or "e", "\\N" if f is None else f or "e"])
        files[f"f{k}.csv"] = out.getvalue()
    path = put(spark, tmp_dir, **files)
    want = sorted(((i, n if n is None else n or "e", f if f is None else f or "e") for i, n, f in rows), key=str)
    assert rows_of(P.read_quoted_csv_pairs(spark, path, split_bytes=split_bytes)) == want


def test_blank_lines_and_no_header(spark, tmp_dir):
    path = put(spark, tmp_dir, **{"a.csv": '1,"x\n\ny",z\n\n2,"",\\N\n3,last,"line"'})
    want = [(1, "x\n\ny", "z"), (2, "", None), (3, "last", "line")]
    for split_bytes in (None, 1, 5):
        assert rows_of(P.read_quoted_csv_pairs(spark, path, header=False, split_bytes=split_bytes)) == want


def test_splits_are_tasks(spark, tmp_dir):
    path = put(spark, tmp_dir, **{"a.json": json.dumps([{"pair_id": i, "NL": "n" * 50, "FOL": "f"} for i in range(1000)])})
    assert P.read_json_array_pairs(spark, path, split_bytes=8000).rdd.getNumPartitions() >= 10
