"""The jobs as registered queries: each runs twice over whole tables into one new folder and returns the output as it then stands."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import cloud_tiles, text_cells
from orthant.storage import base_folder

_HERE = os.path.dirname(os.path.abspath(__file__))


def _config(name: str) -> dict:
    with open(f"{_HERE}/{name}.json") as f:  # shipped with the code
        return json.load(f)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{base_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_cloud_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = _folder(spark, "cloud-tiles")
    for _ in range(2):
        cloud_tiles.run(spark, f"{sf_dir}/lineitem.parquet", output, _config("cloud_tiles"))
    return cloud_tiles.read_tiles(spark, output)


def job2_text_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = _folder(spark, "text-cells")
    for _ in range(2):
        text_cells.run(spark, f"{sf_dir}/documents.parquet*", output, _config("text_cells"))  # a pattern, as the table may be a single file
    return text_cells.read_cells(spark, output)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_cloud_tiles, job2_text_cells)}


def _cell(value: str, width: str) -> str:
    """A quotient within rounding of an integer is that integer, as in the library's cells."""
    q = f"(({value}) / {width})"
    return f"(CASE WHEN abs({q} - round_even({q}, 0)) <= 32 * 2.220446049250313e-16 * greatest(1e0, abs({q})) THEN round_even({q}, 0) ELSE floor({q}) END)::BIGINT"


def oracle_sql() -> dict[str, str]:
    place, w = _config("cloud_tiles"), repr(float(_config("text_cells")["width"]))
    width, per = repr(float(place["width"])), place["cells_per_tile"]
    tiles = f"""
WITH p AS (SELECT ({place['id']})::BIGINT AS id, ({place['x']})::DOUBLE AS x, ({place['y']})::DOUBLE AS y, ({place['z']})::DOUBLE AS z FROM lineitem),
u AS (SELECT x, y, z, min(id) AS id, count(*) AS n FROM p WHERE isfinite(x) AND isfinite(y) AND isfinite(z) GROUP BY x, y, z),
c AS (SELECT *, {_cell('x', f'{width}::DOUBLE')} AS ci, {_cell('y', f'{width}::DOUBLE')} AS cj, {_cell('z', f'{width}::DOUBLE')} AS ck FROM u),
f AS (SELECT *, (x - (ci + 0.5e0) * {width}) * (x - (ci + 0.5e0) * {width}) + (y - (cj + 0.5e0) * {width}) * (y - (cj + 0.5e0) * {width}) + (z - (ck + 0.5e0) * {width}) * (z - (ck + 0.5e0) * {width}) AS far FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY ci, cj, ck ORDER BY far, id) AS k FROM f),
o AS (SELECT ci, cj, ck, sum(n)::BIGINT AS n, count(*) AS positions FROM c GROUP BY ci, cj, ck),
s AS (SELECT i, j, k FROM (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j), (SELECT unnest([-1, 0, 1]) AS k) WHERE i <> 0 OR j <> 0 OR k <> 0),
a AS (SELECT o.ci - s.i AS ci, o.cj - s.j AS cj, o.ck - s.k AS ck, count(*) AS neighbours FROM o, s GROUP BY ALL),
k AS (SELECT o.*, coalesce(a.neighbours, 0)::INT AS neighbours FROM o LEFT JOIN a USING (ci, cj, ck) WHERE coalesce(a.neighbours, 0) >= {place['least_neighbours']})
SELECT floor(ci / {per}e0)::BIGINT || '_' || floor(cj / {per}e0)::BIGINT || '_' || floor(ck / {per}e0)::BIGINT AS tile, ci, cj, ck, r.id, r.x, r.y, r.z, k.n, k.positions, k.neighbours,
       ((sum(k.n) OVER ())::DOUBLE / (count(*) OVER ())::DOUBLE) / k.n::DOUBLE AS weight
FROM k JOIN (SELECT ci, cj, ck, id, x, y, z FROM r WHERE k = 1) AS r USING (ci, cj, ck)
"""
    texts = f"""
WITH d AS (SELECT doc_id AS id, 'lang-' || coalesce(lang, '') AS shelf, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
                  length(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS letters,
                  length(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0Da-z]', '', 'g')) AS other FROM documents),
p AS (SELECT id, shelf, len(w) AS words, CASE WHEN len(w) > 0 THEN letters::DOUBLE / len(w)::DOUBLE ELSE 0e0 END AS x,
             CASE WHEN len(w) > 0 THEN len(list_distinct(w))::DOUBLE / len(w)::DOUBLE * 4e0 ELSE 0e0 END AS y,
             CASE WHEN letters > 0 THEN other::DOUBLE / letters::DOUBLE * 4e0 ELSE 0e0 END AS z FROM d),
c AS (SELECT *, {_cell('x', f'{w}::DOUBLE')} AS ci, {_cell('y', f'{w}::DOUBLE')} AS cj, {_cell('z', f'{w}::DOUBLE')} AS ck FROM p)
SELECT shelf, ci, cj, ck, count(*) AS n, sum(words)::BIGINT AS words, min(id) AS first_doc, max(id) AS last_doc FROM c GROUP BY shelf, ci, cj, ck
"""
    return {"job1_cloud_tiles": tiles, "job2_text_cells": texts}
