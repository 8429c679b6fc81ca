"""Folders of files that differ, sidecars of many matches."""

import csv
import gzip
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from touchline.sources import layouts, sidecars, tables

COLS = ["frame", "display_track_id", "class_id", "conf", "x1", "y1", "x2", "y2", "x_m", "homography_state", "note"]


def made(k, n=40):
    rnd = random.Random(k)
    return [{"frame": f, "display_track_id": rnd.randint(1, 9), "class_id": rnd.randint(0, 3), "conf": round(rnd.random(), 3), "x1": rnd.random() * 99, "y1": 1.5, "x2": 3.25, "y2": -1e-9, "x_m": rnd.choice([None, 7.5, "NaN"]), "homography_state": rnd.choice(["ok", "a;b", 'say "hi", you', "x|y"]), "note": f"n{k}"} for f in range(n)]


def text(rows, sep, cols, **kw):
    out = io.StringIO()
    w = csv.DictWriter(out, cols, delimiter=sep, extrasaction="ignore", lineterminator="\n", **kw)
    w.writeheader()
    w.writerows(rows)
    return out.getvalue()


def expected(rows, cols, match):
    val = lambda r, c: None if c not in cols or r[c] in (None, "NaN") else r[c]
    return [(match, *(val(r, c) for c in COLS)) for r in rows]


@pytest.fixture()
def folder(tmp_path):
    """Eight files: each delimiter, other column orders, missing columns, gzip, a byte order mark, quotes, bad lines."""
    rnd, want = random.Random(1), []
    base = tmp_path / "season"
    for k in range(8):
        sep, cols = ",;\t|"[k % 4], list(COLS)
        if k >= 2:
            rnd.shuffle(cols)
        if k == 5:
            cols.remove("x_m")
        rows = made(k)
        data = text(rows, sep, cols, quoting=csv.QUOTE_ALL if k == 3 else csv.QUOTE_MINIMAL)
        where = base / f"match_{10 + k}"
        where.mkdir(parents=True)
        if k == 6:
            with gzip.open(where / "tracks.csv.gz", "wt") as f:
                f.write(data)
        else:
            (where / "tracks.csv").write_text(("﻿" if k == 2 else "\n\n" if k == 7 else "") + data, encoding="utf-8")
        want += expected(rows, cols, 10 + k)
    return base, want


def test_mixed_folder(spark, folder):
    base, want = folder
    df = tables.read_tracks(spark, str(base / "*"), pattern=r"match_(\d+)")
    assert dict(df.dtypes)["conf"] == "double" and dict(df.dtypes)["class_id"] == "int" and dict(df.dtypes)["note"] == "string"
    got = df.select("match_id", *COLS).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_files_in_many_blocks(spark, tmp_path):
    """Blocks behind a file's first know its layout too."""
    rows = {k: made(k, 3000) for k in range(3)}
    for k, cols in enumerate((COLS, COLS[::-1], COLS[3:] + COLS[:3])):
        (tmp_path / f"m{k}.csv").write_text(text(rows[k], ",;,"[k], cols))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = tables.read_tracks(spark, str(tmp_path), pattern=r"m(\d+)\.csv")
        assert df.rdd.getNumPartitions() > 10
        got = df.select("match_id", *COLS).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, (r for k in rows for r in expected(rows[k], COLS, k))))


def test_bad_lines_are_kept_and_counted(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("frame,class_id,note\n1,2,é\n2\n3,1,x,more\nzz,1,y\n\n   \nframe,class_id,note\n".encode() + b"4,0,\xff\n")
    (tmp_path / "b.csv").write_text("class_id;frame\n3;7\n")
    df = tables.read_tracks(spark, str(tmp_path), 5, marks=True)
    assert sorted(tuple(r) for r in df.select(F.coalesce("frame", F.lit(-1)), "class_id", "note", "bad_line", "match_id").fillna({"class_id": -9, "note": ""}).collect()) == [(-1, 1, "y", False, 5), (1, 2, "é", False, 5), (2, -9, "", True, 5), (3, 1, "x", True, 5), (4, 0, "�", False, 5), (7, 3, "", False, 5)]
    assert sorted((r["source_file"][-5:], r["lines"], r["bad_lines"]) for r in tables.line_report(df).collect()) == [("a.csv", 5, 2), ("b.csv", 1, 0)]


def test_reading_does_no_slow_work_a_field(spark, tmp_path):
    """Texts for nothing in any mix of cases; no lower-casing and no search for a column's name in each line."""
    (tmp_path / "a.csv").write_text("frame,conf,note\n1,nAn,NULL\n2,NoNe, nuLL \n3,0.5,nanx\n")
    (tmp_path / "b.csv").write_text("note;frame\nNONE;4\n")
    df = tables.read_tracks(spark, str(tmp_path))
    assert sorted(df.select("frame", "conf", "note").collect()) == [(1, None, None), (2, None, None), (3, 0.5, "nanx"), (4, None, None)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "lower(" not in plan and "array_position" not in plan.split("Join")[0]


def test_alike_files_need_no_join_and_empty_ones_give_nothing(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("frame,class_id\n1,2\n")
    df = tables.read_tracks(spark, str(tmp_path))
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 3 and df.columns == ["frame", "class_id"]
    (tmp_path / "e").mkdir()
    (tmp_path / "e/empty.csv").write_text("")
    (tmp_path / "e/head.csv").write_text("frame|class_id\n")
    assert tables.read_tracks(spark, str(tmp_path / "e")).count() == 0 and tables.read_tracks(spark, str(tmp_path / "e/empty.csv")).columns == []


def test_only_distinct_layouts_come_to_the_driver(spark, folder):
    base, _ = folder
    heads = layouts.headers(layouts.lines(spark, str(base / "*")))
    assert heads.count() == 8 and {r["sep"] for r in heads.collect()} == set(",;\t|")


def matrices(k, n):
    rnd = random.Random(k)
    return {f: [[rnd.choice([1e-7, -3.5, 12345678.125, 0.1]) for _ in range(3)] for _ in range(3)] for f in rnd.sample(range(5000), n)}


@pytest.mark.parametrize("kw", [{}, {"indent": 2}, {"separators": (",", ":")}])
def test_homographies_of_many_matches(spark, tmp_path, kw):
    want = {k: matrices(k, 300) for k in (3, 4, 25)}
    for k, frames in want.items():
        (tmp_path / f"match_{k}.json").write_text(json.dumps({"meta": {"fps": 30.0, "range": [0, 5000], "source": "match 7"}, "frames": frames}, **kw))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        df = sidecars.read_homographies(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 5
        got = {(r["match_id"], r["frame"]): r["h"] for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {(k, f): sum(m, []) for k, frames in want.items() for f, m in frames.items()}
    with pytest.raises(Exception, match="no match id in the path"):
        sidecars.read_homographies(spark, str(tmp_path), pattern="game(\\d+)").collect()


@pytest.mark.parametrize("form", ["lines", "document"])
def test_sidecars_there_and_back(spark, tmp_path, form):
    h = spark.createDataFrame([(m, f, None if f == 2 else [float(f + k) for k in range(9)]) for m in (1, 2, 30) for f in range(5)], "match_id bigint, frame bigint, h array<double>")
    tables.write_homographies(h, str(tmp_path / "h"), form=form)
    back = tables.read_homographies(spark, str(tmp_path / "h"), form=form)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, h.filter("h IS NOT NULL").collect()))
    a = h.select("match_id", "frame", F.expr("array(named_struct('x', 1.5D, 'y', CAST(frame AS DOUBLE)), named_struct('x', -2D, 'y', 0D))").alias("image_pts"), F.expr("array(named_struct('x', 3D, 'y', 4D))").alias("pitch_pts"), "h")
    tables.write_anchors(a, str(tmp_path / "a"), form=form)
    assert sorted(map(repr, tables.read_anchors(spark, str(tmp_path / "a"), form=form).collect())) == sorted(map(repr, a.collect()))


def test_damaged_matrix_is_null(spark, tmp_path):
    (tmp_path / "match_1.json").write_text('{"frames": {"5": [[1, 2, 3], [4, 5], [7, 8, 9]], "6": [[1, 2, 3], [4, 5, 6], [7, 8, 9]]}}')
    assert {r["frame"]: r["h"] for r in sidecars.read_homographies(spark, str(tmp_path)).collect()} == {5: None, 6: [float(k) for k in range(1, 10)]}


def test_tracks_have_a_file_a_match_whatever_the_tasks(spark, sf, tmp_path, monkeypatch):
    """Files grow with the matches, not with matches x tasks."""
    import glob

    from touchline.plans import catalog, source_queries

    spark.read.parquet(f"{sf}/lineitem.parquet").repartition(5).write.parquet(str(tmp_path / "lineitem.parquet"))
    made = iter(("first", "second"))
    monkeypatch.setattr(source_queries, "new_folder", lambda s, name: str(tmp_path / next(made)))
    conf = {"spark.sql.files.openCostInBytes": "1g"}  # a task a file
    for k, x in conf.items():
        spark.conf.set(k, x)
    try:
        got = catalog.QUERIES["s1_read_tracks"](spark, str(tmp_path))
        written = [f for f in glob.glob(f"{tmp_path}/first/*/*/*") if "part-" in f]
        assert len(written) == got.select("match_id").distinct().count() > 0
    finally:
        for k in conf:
            spark.conf.unset(k)
    want = catalog.QUERIES["s1_read_tracks"](spark, sf)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
