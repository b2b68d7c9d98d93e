"""The two jobs: against plain loops, run again, over growing input, and from the command line."""

import json
import math
import os
import re
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

from jobs import cloud_tiles, queries, read_config, text_cells

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(frame):
    return sorted(map(repr, frame.collect()))


@pytest.mark.parametrize("name", ["job1_cloud_tiles", "job2_text_cells"])
def test_registered_query_equals_sql(spark, name):
    frame, con = queries.queries()[name](spark, DATA), duckdb.connect()
    for table in ("lineitem", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    found = con.sql(queries.oracle_sql()[name])
    assert sorted(found.columns) == sorted(frame.columns)
    own = sorted(repr(tuple(r[c] for c in found.columns)) for r in frame.collect())
    assert own == sorted(repr(r) for r in found.fetchall())


def points(spark, path, values):
    spark.createDataFrame(values, "id long, x double, y double, z double").coalesce(2).write.mode("overwrite").parquet(path)


def test_tiles_against_plain_loops(spark, tmp_path):
    import random

    draw = random.Random(4)
    values = [(i, draw.uniform(-3, 3), draw.uniform(-3, 3), draw.choice([0.0, -0.0, 0.5])) for i in range(400)]
    values += [(i + 1000, *values[i][1:]) for i in range(0, 400, 3)]  # places that repeat
    values += [(7, 1.5, 1.5, 40.5), (8, 1.6, 1.5, 40.5), (5, 1.4, 1.5, 40.5)]  # two as near to the centre; a cell without neighbours
    odd = [(1, None, 0.0, 0.0), (2, float("nan"), 0.0, 0.0), (3, 0.0, float("inf"), 0.0), (None, 2.5, 2.5, 0.5)]
    points(spark, f"{tmp_path}/in", values + odd)
    told = cloud_tiles.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", {"cells_per_tile": 2})
    assert told["rows_read"] == len(values) + 4 and told["rows_kept"] == len(values) + 1
    held: dict = {}
    for i, *place in values + odd[3:]:
        held.setdefault(tuple(math.floor(v) for v in place), []).append((i, tuple(v + 0.0 for v in place)))
    got = {(r["ci"], r["cj"], r["ck"]): r for r in cloud_tiles.read_tiles(spark, f"{tmp_path}/out").collect()}
    assert set(got) == set(held) and told["cells_written"] == len(held)
    for cell, inside in held.items():
        places = {p: min((i for i, q in inside if q == p and i is not None), default=None) for _, p in inside}
        far = lambda p: sum((v - (c + 0.5)) * (v - (c + 0.5)) for v, c in zip(p, cell))  # noqa: B023, E731
        best = min(places, key=lambda p: (far(p), places[p] is not None, places[p] or 0))  # noqa: B023
        r = got[cell]
        assert (r["n"], r["positions"], r["id"]) == (len(inside), len(places), places[best])
        assert (r["x"], r["y"], r["z"]) == best
        assert r["neighbours"] == sum(all(abs(a - b) <= 1 for a, b in zip(cell, other)) for other in held) - 1
        assert r["tile"] == "_".join(str(c // 2) for c in cell)
        assert r["weight"] == pytest.approx((len(values) + 1) / len(held) / len(inside))
    summary = {r["tile"]: r["n"] for r in spark.read.parquet(f"{tmp_path}/out/summary").collect()}
    assert summary == dict(sum((Counter({r["tile"]: r["n"]}) for r in got.values()), Counter()))
    dense = cloud_tiles.run(spark, f"{tmp_path}/in", f"{tmp_path}/dense", {"least_neighbours": 1})
    assert dense["cells_written"] == sum(r["neighbours"] > 0 for r in got.values()) < len(held)


def test_tiles_are_replaced_by_a_rerun(spark, tmp_path):
    source, output = f"{tmp_path}/in", f"{tmp_path}/out"
    points(spark, source, [(i, i * 0.7, 0.1, 0.1) for i in range(60)])
    cloud_tiles.run(spark, source, output)
    first = rows(cloud_tiles.read_tiles(spark, output))
    cloud_tiles.run(spark, source, output)
    assert rows(cloud_tiles.read_tiles(spark, output)) == first
    points(spark, source, [(i, i * 0.7, 0.1, 0.1) for i in range(5)])  # tiles that are gone leave no folder
    cloud_tiles.run(spark, source, output)
    assert cloud_tiles.read_tiles(spark, output).count() == 3
    points(spark, source, [])
    assert cloud_tiles.run(spark, source, output) == {"rows_read": 0, "rows_kept": 0, "cells_written": 0}
    with pytest.raises(ValueError):
        cloud_tiles.run(spark, source, output, {"width": 0})


TEXTS = ["the quick brown fox", "LOUD NOISE", "", None, "a a a a a a", " \t\n", "naïve café", "$$$ 123 ###", "word " * 30_000, "the quick brown fox"]


def documents(spark, path, first, n, mode="append"):
    values = [(first + i, TEXTS[(first + i) % len(TEXTS)], [None, "", "en", "fr"][(first + i) % 4], "s") for i in range(n)]
    spark.createDataFrame(values, "doc_id long, text string, lang string, source string").coalesce(1).write.mode(mode).parquet(path)
    return [v[:3] for v in values]


def plain_cells(values):
    out: dict = {}
    for i, text, lang in values:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        letters = sum(map(len, words))
        x = letters / len(words) if words else 0.0
        y = len(set(words)) / len(words) * 4 if words else 0.0
        z = sum(not "a" <= c <= "z" for w in words for c in w) / letters * 4 if letters else 0.0
        key = ("lang-" + (lang or ""), *(math.floor(v / 0.25 + 1e-12) for v in (x, y, z)))
        n, total, low, high = out.get(key, (0, 0, i, i))
        out[key] = (n + 1, total + len(words), min(low, i), max(high, i))
    return out


def cells_of(spark, output):
    return {tuple(r)[:4]: tuple(r)[4:] for r in text_cells.read_cells(spark, output).collect()}


def test_cells_take_only_what_is_new(spark, tmp_path):
    source, output = f"{tmp_path}/in", f"{tmp_path}/out"
    values = documents(spark, source, 0, 23)
    assert text_cells.run(spark, source, output)["rows_read"] == 23
    assert cells_of(spark, output) == plain_cells(values)
    assert text_cells.run(spark, source, output)["rows_read"] == 0  # nothing new
    assert cells_of(spark, output) == plain_cells(values)
    values += documents(spark, source, 23, 40) + documents(spark, source, 63, 9)
    told = text_cells.run(spark, source, output, {"files_per_batch": 1})
    assert told["rows_read"] == 49 and told["batches"] == 2
    assert cells_of(spark, output) == plain_cells(values)


def test_a_broken_run_neither_loses_nor_doubles(spark, tmp_path, monkeypatch):
    source, output = f"{tmp_path}/in", f"{tmp_path}/out"
    values = documents(spark, source, 0, 20) + documents(spark, source, 20, 20) + documents(spark, source, 40, 20)
    real, calls = text_cells.document_points, []

    def breaks(batch, *names):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(batch, *names)

    monkeypatch.setattr(text_cells, "document_points", breaks)
    with pytest.raises(Exception, match="lost"):
        text_cells.run(spark, source, output, {"files_per_batch": 1})
    monkeypatch.setattr(text_cells, "document_points", real)
    assert text_cells.run(spark, source, output, {"files_per_batch": 1})["rows_read"] == 40
    assert cells_of(spark, output) == plain_cells(values)
    # A batch that was written but not yet marked as done is written again in its own place.
    done = spark.read.parquet(f"{output}/deltas").where("batch = 2")
    done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{tmp_path}/copy")
    spark.read.parquet(f"{tmp_path}/copy").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{output}/deltas")
    assert text_cells.run(spark, source, output)["rows_read"] == 0
    assert cells_of(spark, output) == plain_cells(values)


def test_an_empty_table_gives_no_cells(spark, tmp_path):
    documents(spark, f"{tmp_path}/in", 0, 0)
    told = text_cells.run(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert (told["rows_read"], told["cells"]) == (0, 0)


def test_config_and_command_line(spark, tmp_path):
    with pytest.raises(ValueError, match="colour"):
        path = tmp_path / "bad.json"
        path.write_text(json.dumps({"colour": 1}))
        read_config(spark, f"file://{path}", text_cells.DEFAULTS)
    values = documents(spark, f"{tmp_path}/in", 0, 12)
    for name, source, told in (("text_cells", f"{tmp_path}/in", "took 12 new rows"), ("cloud_tiles", f"{DATA}/lineitem.parquet", "to ")):
        run = subprocess.run(
            [sys.executable, "-m", f"jobs.{name}", "--input", source, "--output", f"{tmp_path}/{name}", "--config", f"file://{ROOT}/jobs/{name}.json"],
            cwd=ROOT, env=os.environ | {"SPARK_LOCAL_IP": "127.0.0.1"}, capture_output=True, text=True, timeout=300,
        )
        assert run.returncode == 0, run.stderr[-2000:]
        assert told in run.stderr
    assert cells_of(spark, f"{tmp_path}/text_cells") == plain_cells(values)
    assert cloud_tiles.read_tiles(spark, f"{tmp_path}/cloud_tiles").count() > 1000
