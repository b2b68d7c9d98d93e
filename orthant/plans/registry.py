"""All registered queries of the point-cloud engine, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orthant.functions import scalar as S
from orthant.operators import cells, spatial, voxel, windows
from orthant.sources import views

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}

Query = Callable[[SparkSession, str], DataFrame]


def register(name: str, sql: str | None = None, *clouds: str) -> Callable[[Query], Query]:
    """Register a query; ``clouds`` are the cloud views that its SQL starts from."""

    def add(f: Query) -> Query:
        _queries[name] = f
        if sql is not None:
            body = sql.strip()
            if clouds:
                head = ", ".join(views.SQL[c] for c in clouds)
                kind = "WITH RECURSIVE" if body.startswith("RECURSIVE") else "WITH"
                body = body.removeprefix("RECURSIVE").strip()
                body = f"{kind} {head}, {body[4:].strip()}" if body.startswith("WITH") else f"{kind} {head} {body}"
            _oracles[name] = body
        return f

    return add


def r9(c: Column | str) -> Column:
    """Round half up at nine digits, the same in both engines."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 1e9 + 0.5) / 1e9


def s9(text: str) -> str:
    return f"floor(({text}) * 1e9 + 0.5e0) / 1e9"


# Three cuboids over the unit cube: centre, extents, rotation row by row.
BOXES = [
    (0, 0.3, 0.3, 0.5, 0.4, 0.3, 0.6, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0),
    (1, 0.7, 0.5, 0.4, 0.3, 0.4, 0.5, 0.6, -0.8, 0.0, 0.8, 0.6, 0.0, 0.0, 0.0, 1.0),
    (2, 0.5, 0.8, 0.8, 0.2, 0.2, 0.2, 1.0, 0.0, 0.0, 0.0, 0.8, -0.6, 0.0, 0.6, 0.8),
]
_BOX_COLUMNS = ["box_id", "cx", "cy", "cz", "dx", "dy", "dz", *[f"r{i}{j}" for i in range(3) for j in range(3)]]


def fixed_boxes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BOXES, "box_id int, " + ", ".join(f"{c} double" for c in _BOX_COLUMNS[1:]))


def _values(rows, first_int: int = 1) -> str:
    one = lambda row: "(" + ", ".join(str(v) if i < first_int else f"{v!r}::DOUBLE" for i, v in enumerate(row)) + ")"
    return "VALUES " + ", ".join(one(r) for r in rows)


_B = f"b({', '.join(_BOX_COLUMNS)}) AS ({_values(BOXES)})"
_Q = [f"abs((x - cx) * r0{j} + (y - cy) * r1{j} + (z - cz) * r2{j}) - d{a} / 2e0" for j, a in enumerate("xyz")]
_DIST = "sqrt(" + " + ".join(f"greatest({q}, 0e0) * greatest({q}, 0e0)" for q in _Q) + ")"
_SIGNED = f"({_DIST} + least(greatest({', '.join(_Q)}), 0e0))"
_CELL = lambda v, o, w: (
    f"(CASE WHEN abs(({v} - {o}) / {w} - round_even(({v} - {o}) / {w}, 0)) <= 32 * 2.220446049250313e-16 * greatest(1e0, abs(({v} - {o}) / {w})) "
    f"THEN round_even(({v} - {o}) / {w}, 0) ELSE floor(({v} - {o}) / {w}) END)::BIGINT"
)


def _cells_sql(view: str, width: str, columns: str = "*") -> str:
    lows = ", ".join(f"min({a}) AS l{a}" for a in "xyz")
    parts = ", ".join(f"{_CELL(a, 'l' + a, width)} AS {c}" for a, c in zip("xyz", ("ci", "cj", "ck")))
    return f"c AS (SELECT {columns}, {parts} FROM {view}, (SELECT {lows} FROM {view}) AS low)"


def _line(spark, d):
    return views.lineitem_cloud(spark, d)


def _emb(spark, d):
    return views.embedding_cloud(spark, d)


# --- scalar functions ------------------------------------------------------------------------------


@register("sigmoid_opacity", f"SELECT id, {s9('1e0 / (1e0 + exp(-4e0 * x))')} AS opacity FROM v_emb WHERE 1e0 / (1e0 + exp(-4e0 * x)) >= 0.1e0", "v_emb")
def _(spark, d):
    opacity = S.sigmoid(4.0 * F.col("x"))
    return _emb(spark, d).where(S.finite("x") & (opacity >= 0.1)).select("id", r9(opacity).alias("opacity"))


@register("sh_dc_color", "SELECT id, " + ", ".join(s9(f"greatest(0e0, least(1e0, 0.5e0 + 0.28209479177387814e0 * {a} * 8e0))") + f" AS {c}" for a, c in zip("xyz", "rgb")) + " FROM v_emb", "v_emb")
def _(spark, d):
    return _emb(spark, d).select("id", *[r9(S.sane_color(S.sh_color(F.col(a) * 8.0))).alias(c) for a, c in zip("xyz", "rgb")])


@register("rgb_normalized", "SELECT p_partkey AS id, (p_size * 5) / 255e0 AS red, (p_partkey % 256) / 255e0 AS green, 7 / 255e0 AS blue FROM part")
def _(spark, d):
    rows = views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 5).alias("red"), (F.col("p_partkey") % 256).alias("green"), F.lit(7).alias("blue"))
    return S.normalize_rgb(rows)


@register(
    "srgb_linear",
    f"""SELECT id, {s9("CASE WHEN v <= 0.04045e0 THEN v / 12.92e0 ELSE pow((v + 0.055e0) / 1.055e0, 2.4e0) END")} AS lin,
    {s9("CASE WHEN v <= 0.0031308e0 THEN v * 12.92e0 ELSE 1.055e0 * pow(v, 1 / 2.4e0) - 0.055e0 END")} AS enc FROM (SELECT p_partkey AS id, p_size / 50e0 AS v FROM part) AS t""",
)
def _(spark, d):
    rows = views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("v"))
    return rows.select("id", r9(S.srgb_to_linear(F.col("v"))).alias("lin"), r9(S.linear_to_srgb(F.col("v"))).alias("enc"))


@register(
    "normalized_coordinates",
    f"""WITH m AS (SELECT min(x) lx, min(y) ly, min(z) lz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS e FROM v_emb)
    SELECT id, {s9('(x - lx) / e')} AS u, {s9('(y - ly) / e')} AS v, {s9('(z - lz) / e')} AS w FROM v_emb, m""",
    "v_emb",
)
def _(spark, d):
    cloud = _emb(spark, d)
    m = cloud.agg(*[F.min(a).alias("l" + a) for a in "xyz"], F.greatest(*[F.max(a) - F.min(a) for a in "xyz"]).alias("e"))
    return cloud.join(F.broadcast(m)).select("id", *[r9((F.col(a) - F.col("l" + a)) / F.col("e")).alias(u) for a, u in zip("xyz", "uvw")])


def _boxed(spark, d, points):
    named = fixed_boxes(spark)
    return points.join(F.broadcast(named.select("box_id", *[F.col(c).alias("b_" + c) for c in named.columns[1:]])))


for _name, _expr, _sql in (
    ("box_distance", lambda b: b.distance(), _DIST),
    ("signed_box_distance", lambda b: b.signed_distance(), _SIGNED),
    ("box_surface_distance", lambda b: b.surface_distance(), f"abs({_SIGNED})"),
):

    @register(_name, f"WITH {_B} SELECT id, box_id, {s9(_sql)} AS d FROM v_emb, b", "v_emb")
    def _(spark, d, expr=_expr):
        return _boxed(spark, d, _emb(spark, d)).select("id", "box_id", r9(expr(S.Box("b_"))).alias("d"))


@register("box_membership", f"WITH {_B} SELECT box_id, count(*) FILTER ({' AND '.join(f'{q} <= 0' for q in _Q)}) AS inside, count(*) FILTER ({' AND '.join(f'{q} <= -0.02e0' for q in _Q)}) AS deep FROM v_line, b GROUP BY box_id", "v_line")
def _(spark, d):
    box = S.Box("b_")
    pairs = _boxed(spark, d, _line(spark, d))
    return pairs.groupBy("box_id").agg(F.count(F.when(box.contains(), 1)).alias("inside"), F.count(F.when(box.contains(-0.02), 1)).alias("deep"))


_CORNER = lambda i, a: f"c{a} + " + " + ".join(f"r{i}{j} * d{b} * (CASE WHEN (corner >> {j}) & 1 = 1 THEN 0.5e0 ELSE -0.5e0 END)" for j, b in enumerate("xyz"))


@register("box_corners", f"SELECT box_id, corner::INT AS corner, {', '.join(s9(_CORNER(i, a)) + f' AS {a}' for i, a in enumerate('xyz'))} FROM v_boxes, range(8) AS t(corner)", "v_boxes")
def _(spark, d):
    return S.box_corners(views.part_boxes(spark, d)).select("box_id", "corner", *[r9(a).alias(a) for a in "xyz"])


@register("face_areas", f"SELECT box_id, side::INT AS side, {s9('CASE side // 2 WHEN 0 THEN dy * dz WHEN 1 THEN dx * dz ELSE dx * dy END')} AS area FROM v_boxes, range(6) AS t(side)", "v_boxes")
def _(spark, d):
    return S.box_faces(views.part_boxes(spark, d)).select("box_id", "side", r9("area").alias("area"))


_SEGMENTS = [(0, (0.0, 0.0, 0.0), (1.0, 0.0, 0.0)), (1, (0.2, 0.2, 0.2), (0.2, 0.2, 0.2)), (2, (0.0, 0.5, 0.1), (0.4, 0.1, 0.6))]
_TRIANGLE = ((0.0, 0.0, 0.0), (0.4, 0.0, 0.1), (0.0, 0.3, -0.1))


def _seg_sql(a, b) -> str:
    ab = [q - p for p, q in zip(a, b)]
    n = sum(v * v for v in ab)
    ap = [f"({c} - {v!r}::DOUBLE)" for c, v in zip("xyz", a)]
    t = "0e0" if n == 0 else "greatest(0e0, least(1e0, (" + " + ".join(f"{p} * {v!r}::DOUBLE" for p, v in zip(ap, ab)) + f") / {n!r}::DOUBLE))"
    return " + ".join(f"({p} - {t} * {v!r}::DOUBLE) * ({p} - {t} * {v!r}::DOUBLE)" for p, v in zip(ap, ab))


@register("segment_distance", f"SELECT id, {s9('sqrt(least(' + ', '.join(_seg_sql(a, b) for _, a, b in _SEGMENTS) + '))')} AS d FROM v_emb", "v_emb")
def _(spark, d):
    segments = spark.createDataFrame([(i, list(a), list(b)) for i, a, b in _SEGMENTS], "seg_id int, a array<double>, b array<double>")
    return spatial.segment_distance(_emb(spark, d), segments).select("id", r9("d").alias("d"))


def _tri_sql() -> str:
    a, b, c = _TRIANGLE
    ab, ac = [q - p for p, q in zip(a, b)], [q - p for p, q in zip(a, c)]
    n = [ab[1] * ac[2] - ab[2] * ac[1], ab[2] * ac[0] - ab[0] * ac[2], ab[0] * ac[1] - ab[1] * ac[0]]
    dot = lambda s, t: sum(x * y for x, y in zip(s, t))
    d00, d01, d11, nn = dot(ab, ab), dot(ab, ac), dot(ac, ac), dot(n, n)
    proj = lambda v: "(" + " + ".join(f"({x} - {p!r}::DOUBLE) * {w!r}::DOUBLE" for x, p, w in zip("xyz", a, v)) + ")"
    v, w = f"({d11!r}::DOUBLE * {proj(ab)} - {d01!r}::DOUBLE * {proj(ac)})", f"({d00!r}::DOUBLE * {proj(ac)} - {d01!r}::DOUBLE * {proj(ab)})"
    edges = f"least({_seg_sql(a, b)}, {_seg_sql(b, c)}, {_seg_sql(c, a)})"
    return f"CASE WHEN {v} >= 0 AND {w} >= 0 AND {v} + {w} <= {nn!r}::DOUBLE THEN {proj(n)} * {proj(n)} / {nn!r}::DOUBLE ELSE {edges} END"


@register("triangle_distance", f"SELECT id, {s9('sqrt(' + _tri_sql() + ')')} AS d FROM v_emb", "v_emb")
def _(spark, d):
    mesh = spark.createDataFrame([(0, *[list(v) for v in _TRIANGLE])], "tri_id int, a array<double>, b array<double>, c array<double>")
    return spatial.nearest_triangle(_emb(spark, d), mesh).select("id", r9("d").alias("d"))


# --- distance joins --------------------------------------------------------------------------------

_PAIRS = "SELECT a.id AS id, b.id AS other_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM"


@register("knn", f"WITH p AS ({_PAIRS} v_emb a JOIN v_emb b ON a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other_id) AS rank FROM p) SELECT id, rank::INT AS rank, other_id, {s9('d')} AS d FROM r WHERE rank <= 8", "v_emb")
def _(spark, d):
    cloud = _emb(spark, d)
    return spatial.nearest_neighbors(cloud, cloud, 8, exclude_self=True).select("id", "rank", "other_id", r9("d").alias("d"))


@register("knn_to_set", f"WITH p AS ({_PAIRS} v_emb a JOIN v_emb b ON a.label <> 0 AND b.label = 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other_id) AS rank FROM p) SELECT id, rank::INT AS rank, other_id, {s9('d')} AS d FROM r WHERE rank <= 3", "v_emb")
def _(spark, d):
    cloud = _emb(spark, d)
    return spatial.nearest_neighbors(cloud.where("label <> 0"), cloud.where("label = 0"), 3).select("id", "rank", "other_id", r9("d").alias("d"))


@register("nearest_one", f"WITH p AS ({_PAIRS} v_emb a JOIN v_emb b ON a.label > 4 AND b.label <= 4), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other_id) AS rank FROM p) SELECT id, other_id, {s9('d')} AS d FROM r WHERE rank = 1", "v_emb")
def _(spark, d):
    cloud = _emb(spark, d)
    return spatial.nearest_neighbors(cloud.where("label > 4"), cloud.where("label <= 4"), 1).select("id", "other_id", r9("d").alias("d"))


_PLACES = "u AS (SELECT x, y, z, min(id) AS id FROM v_part GROUP BY x, y, z)"


@register("nearest_spacing", f"WITH {_PLACES}, p AS ({_PAIRS} u a JOIN u b ON a.id <> b.id), m AS (SELECT id, min(d) AS d FROM p GROUP BY id) SELECT v.id, {s9('m.d')} AS spacing FROM v_part v JOIN u ON v.x = u.x AND v.y = u.y AND v.z = u.z JOIN m ON u.id = m.id", "v_part")
def _(spark, d):
    return spatial.nearest_spacing(views.part_cloud(spark, d)).select("id", r9("spacing").alias("spacing"))


@register("median_spacing", f"WITH p AS ({_PAIRS} v_emb a JOIN v_emb b ON a.id <> b.id), m AS (SELECT id, min(d) AS d FROM p GROUP BY id) SELECT {s9('median(d)')} AS spacing FROM m", "v_emb")
def _(spark, d):
    found = windows.exact_quantiles(spatial.nearest_spacing(_emb(spark, d)), "spacing", (0.5,))
    return spark.createDataFrame([tuple(found)], "spacing double").select(r9("spacing").alias("spacing"))


@register(
    "local_outliers",
    f"""WITH p AS ({_PAIRS} v_emb a JOIN v_emb b ON a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other_id) AS rank FROM p),
    t AS (SELECT id, d AS d3 FROM r WHERE rank = 3), m AS (SELECT r.id, median(t.d3) AS usual FROM r JOIN t ON r.other_id = t.id WHERE rank <= 8 GROUP BY r.id)
    SELECT t.id, d3 > 1.6e0 * usual AS is_outlier FROM t JOIN m ON t.id = m.id""",
    "v_emb",
)
def _(spark, d):
    return spatial.local_outliers(_emb(spark, d), 1.6).select("id", "is_outlier")


@register("radius_join", f"WITH p AS ({_PAIRS} v_emb a, v_emb b) SELECT id, other_id, {s9('d')} AS d FROM p WHERE d <= 0.1e0", "v_emb")
def _(spark, d):
    cloud = _emb(spark, d)
    return spatial.radius_join(cloud, cloud, 0.1).select("id", "other_id", r9("d").alias("d"))


@register("aabb_range_join", "SELECT id FROM v_emb WHERE x BETWEEN -0.1e0 AND 0.1e0 AND y BETWEEN -0.15e0 AND 0.05e0 AND z BETWEEN -0.05e0 AND 0.25e0", "v_emb")
def _(spark, d):
    return spatial.points_in_bounds(_emb(spark, d), (0.0, -0.05, 0.1), (0.1, 0.1, 0.15)).select("id")


@register("box_point_cover", f"WITH {_B} SELECT box_id, id, {s9(_DIST)} AS d FROM v_part, b WHERE {_DIST} <= 0.3e0", "v_part")
def _(spark, d):
    return spatial.box_points(fixed_boxes(spark), views.part_cloud(spark, d), 0.3).select("box_id", "id", r9("d").alias("d"))


@register("box_point_cover_by_cells", f"WITH {_B} SELECT box_id, id, {s9(_DIST)} AS d FROM v_part, b WHERE {_DIST} <= 0.3e0", "v_part")
def _(spark, d):
    return spatial.box_points(fixed_boxes(spark), views.part_cloud(spark, d), 0.3, width=0.5).select("box_id", "id", r9("d").alias("d"))


@register("nearest_box", f"WITH {_B}, p AS (SELECT id, box_id, abs({_SIGNED}) AS d FROM v_emb, b), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, box_id) AS k FROM p) SELECT id, box_id, {s9('d')} AS d FROM r WHERE k = 1", "v_emb")
def _(spark, d):
    return spatial.nearest_box(_emb(spark, d), fixed_boxes(spark)).select("id", "box_id", r9("d").alias("d"))


# --- cells, aggregates -----------------------------------------------------------------------------


@register("cells_count", f"WITH {_cells_sql('v_line', '0.1e0')} SELECT ci, cj, ck, count(*) AS n FROM c GROUP BY ci, cj, ck", "v_line")
def _(spark, d):
    return cells.cell_counts(_line(spark, d), 0.1)


@register("spatial_weights", f"WITH {_cells_sql('v_emb', '0.1e0')}, w AS (SELECT id, 1e0 / count(*) OVER (PARTITION BY ci, cj, ck) AS w FROM c) SELECT id, floor(w / (avg(w) OVER ()) * 1e6 + 0.5e0) / 1e6 AS weight FROM w", "v_emb")
def _(spark, d):
    return cells.spatial_weights(_emb(spark, d), 0.1).select("id", (F.floor(F.col("weight") * 1e6 + 0.5) / 1e6).alias("weight"))


_ADJACENT = "abs(a.ci - b.ci) <= 1 AND abs(a.cj - b.cj) <= 1 AND abs(a.ck - b.ck) <= 1"
_OCC = f"{_cells_sql('v_emb', '0.05e0')}, o AS (SELECT ci, cj, ck, count(*) AS n, row_number() OVER (ORDER BY ci, cj, ck) AS k FROM c GROUP BY ci, cj, ck)"
_REACH = f"e AS (SELECT a.k AS s, b.k AS t FROM o a JOIN o b ON {_ADJACENT}), r(s, t) AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON r.t = e.s), l AS (SELECT s AS k, min(t) AS root FROM r GROUP BY s)"


@register("cell_adjacency", f"WITH {_OCC} SELECT a.ci AS ai, a.cj AS aj, a.ck AS ak, b.ci AS bi, b.cj AS bj, b.ck AS bk FROM o a JOIN o b ON {_ADJACENT} AND a.k < b.k", "v_emb")
def _(spark, d):
    pairs = cells.cell_adjacency(cells.with_cells(_emb(spark, d), 0.05))
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    return pairs.select(*[low[c].alias(n) for c, n in zip(cells.CELL, ("ai", "aj", "ak"))], *[high[c].alias(n) for c, n in zip(cells.CELL, ("bi", "bj", "bk"))])


@register("connected_components", f"RECURSIVE WITH {_OCC}, {_REACH} SELECT o.ci, o.cj, o.ck, m.ci AS ri, m.cj AS rj, m.ck AS rk FROM o JOIN l USING (k) JOIN o m ON m.k = l.root", "v_emb")
def _(spark, d):
    found = cells.cell_components(cells.with_cells(_emb(spark, d), 0.05))
    return found.select(*cells.CELL, *[F.col("component")[c].alias(n) for c, n in zip(cells.CELL, ("ri", "rj", "rk"))])


@register("largest_patch", f"RECURSIVE WITH {_OCC}, {_REACH}, s AS (SELECT root, sum(n)::BIGINT AS n FROM o JOIN l USING (k) GROUP BY root) SELECT max(n) AS largest FROM s", "v_emb")
def _(spark, d):
    return cells.largest_patch(_emb(spark, d), 0.05)


@register(
    "component_coverage",
    f"""RECURSIVE WITH {_B}, {_OCC}, {_REACH}, w AS (SELECT c.*, l.root, 1e0 / o.n AS w FROM c JOIN o ON c.ci = o.ci AND c.cj = o.cj AND c.ck = o.ck JOIN l USING (k)),
    g AS (SELECT id, root, any_value(w) AS w, min({_DIST}) AS d FROM w, b GROUP BY id, root)
    SELECT m.ci AS ri, m.cj AS rj, m.ck AS rk, floor(sum(CASE WHEN d <= 0.2e0 THEN w ELSE 0 END) / sum(w) * 1e6 + 0.5e0) / 1e6 AS coverage FROM g JOIN o m ON m.k = g.root GROUP BY ALL""",
    "v_emb",
)
def _(spark, d):
    """Weighted share of each component that fixed cuboids cover."""
    weighted = cells.spatial_weights(_emb(spark, d), 0.05)
    parts = cells.cell_components(cells.with_cells(_emb(spark, d), 0.05))
    near = spatial.box_points(fixed_boxes(spark), weighted.select("id", "x", "y", "z"), 0.2).select("id").distinct().withColumn("near", F.lit(True))
    rows = weighted.join(parts, list(cells.CELL)).join(near, "id", "left").withColumn("near", F.coalesce("near", F.lit(False)))
    out = cells.component_coverage(rows, F.col("near"))
    return out.select(*[F.col("component")[c].alias(n) for c, n in zip(cells.CELL, ("ri", "rj", "rk"))], (F.floor(F.col("coverage") * 1e6 + 0.5) / 1e6).alias("coverage"))


@register("distinct_positions", "SELECT x, y, z, min(id) AS first_id, count(*) AS n FROM v_part GROUP BY x, y, z", "v_part")
def _(spark, d):
    return cells.distinct_positions(views.part_cloud(spark, d))


@register("weighted_group_sum", f"SELECT l_returnflag, count(*) AS n, {s9('sum(l_tax)')} AS mass, {s9('sum(l_tax * x) / sum(l_tax)')} AS mean_x FROM v_line GROUP BY l_returnflag", "v_line")
def _(spark, d):
    tax = F.sum("l_tax")
    return _line(spark, d).groupBy("l_returnflag").agg(F.count("*").alias("n"), r9(tax).alias("mass"), r9(F.sum(F.col("l_tax") * F.col("x")) / tax).alias("mean_x"))


@register("quantiles", "SELECT " + ", ".join(f"{s9(f'quantile_cont(y, {q})')} AS q{int(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99, 1.0)) + " FROM v_line", "v_line")
def _(spark, d):
    names = ("q50", "q90", "q95", "q99", "q100")
    found = windows.exact_quantiles(_line(spark, d), "y", (0.5, 0.9, 0.95, 0.99, 1.0))
    return spark.createDataFrame([tuple(found)], ", ".join(f"{n} double" for n in names)).select(*[r9(n).alias(n) for n in names])


@register("rms_weighted", f"SELECT label, {s9('sqrt(avg(x * x))')} AS rms, {s9('sum(abs(y) * x) / sum(abs(y))')} AS wmean, {s9('sqrt(sum(abs(y) * x * x) / sum(abs(y)))')} AS wrms FROM v_emb GROUP BY label", "v_emb")
def _(spark, d):
    w, x = F.abs("y"), F.col("x")
    return _emb(spark, d).groupBy("label").agg(r9(F.sqrt(F.avg(x * x))).alias("rms"), r9(F.sum(w * x) / F.sum(w)).alias("wmean"), r9(F.sqrt(F.sum(w * x * x) / F.sum(w))).alias("wrms"))


_MOMENTS = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]


@register("covariance_moments", f"SELECT label, count(*) AS n, {', '.join(s9(f'avg({a} * {b}) - avg({a}) * avg({b})') + f' AS m{a}{b}' for a, b in _MOMENTS)} FROM v_emb GROUP BY label", "v_emb")
def _(spark, d):
    part = [r9(F.avg(F.col(a) * F.col(b)) - F.avg(a) * F.avg(b)).alias(f"m{a}{b}") for a, b in _MOMENTS]
    return _emb(spark, d).groupBy("label").agg(F.count("*").alias("n"), *part)


@register("lower_percentile", f"WITH l AS (SELECT user_id, list_sort(list(y)) AS v FROM v_event GROUP BY user_id) SELECT user_id, {s9('v[floor(0.9e0 * (len(v) - 1))::INT + 1]')} AS p90 FROM l", "v_event")
def _(spark, d):
    lists = views.event_cloud(spark, d).groupBy("user_id").agg(F.sort_array(F.collect_list("y")).alias("v"))
    return lists.select("user_id", r9(F.element_at("v", F.floor(0.9 * (F.size("v") - 1)).cast("int") + 1)).alias("p90"))


@register("extents", f"SELECT label, {', '.join(s9(f'{f}({a})') + f' AS {f}_{a}' for f in ('min', 'max', 'avg') for a in 'xyz')} FROM v_emb GROUP BY label", "v_emb")
def _(spark, d):
    return _emb(spark, d).groupBy("label").agg(*[r9(getattr(F, f)(a)).alias(f"{f}_{a}") for f in ("min", "max", "avg") for a in "xyz"])


@register("coverage_rollup", f"WITH {_B} SELECT box_id, label, count(*) AS n, count(*) FILTER ({_DIST} <= 0.3e0) AS covered FROM v_emb, b GROUP BY ROLLUP (box_id, label)", "v_emb")
def _(spark, d):
    near = S.Box("b_").distance() <= 0.3
    return _boxed(spark, d, _emb(spark, d)).rollup("box_id", "label").agg(F.count("*").alias("n"), F.count(F.when(near, 1)).alias("covered"))


# --- ordered operators -----------------------------------------------------------------------------

_ORIGIN = "-1e0"


@register(
    "spatial_representatives",
    f"""WITH c AS (SELECT *, {', '.join(f"{_CELL(a, '(' + _ORIGIN + ')', '0.2e0')} AS {c}" for a, c in zip('xyz', ('ci', 'cj', 'ck')))} FROM v_emb),
    g AS (SELECT *, {' + '.join(f"({a} - (-1e0 + ({c} + 0.5e0) * 0.2e0)) * ({a} - (-1e0 + ({c} + 0.5e0) * 0.2e0))" for a, c in zip('xyz', ('ci', 'cj', 'ck')))} AS far FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY ci, cj, ck ORDER BY far, id) AS k FROM g) SELECT ci, cj, ck, id FROM r WHERE k = 1""",
    "v_emb",
)
def _(spark, d):
    return cells.spatial_representatives(_emb(spark, d), 0.2, (-1.0, -1.0, -1.0))


@register(
    "gap_runs",
    """WITH s AS (SELECT *, coalesce(x - lag(x) OVER o > 0.5e0, false)::INT AS step FROM v_event WINDOW o AS (PARTITION BY user_id ORDER BY x, id)),
    r AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY x, id) AS run FROM s) SELECT user_id, run::BIGINT AS run, count(*) AS n, min(id) AS first_id FROM r GROUP BY user_id, run""",
    "v_event",
)
def _(spark, d):
    return windows.gap_runs(views.event_cloud(spark, d), ["user_id"], "x", 0.5).groupBy("user_id", "run").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@register("max_gap", f"WITH s AS (SELECT user_id, lead(x) OVER (PARTITION BY user_id ORDER BY x) - x AS gap FROM v_event) SELECT user_id, {s9('max(gap)')} AS gap FROM s GROUP BY user_id HAVING max(gap) IS NOT NULL", "v_event")
def _(spark, d):
    return windows.largest_gap(views.event_cloud(spark, d), ["user_id"], "x").select("user_id", r9("gap").alias("gap"))


@register("rank_weights", f"SELECT id, {s9('CASE WHEN count(*) OVER g > 1 THEN 0.25e0 + 0.75e0 * (row_number() OVER (PARTITION BY user_id ORDER BY y, id) - 1) / (count(*) OVER g - 1) ELSE 1 END')} AS w FROM v_event WINDOW g AS (PARTITION BY user_id)", "v_event")
def _(spark, d):
    return windows.rank_weights(views.event_cloud(spark, d), ["user_id"], "y").select("id", r9("rank_weight").alias("w"))


@register("coverage_curve", f"WITH {_B}, p AS (SELECT id, box_id, {_DIST} AS d FROM v_emb, b), r AS (SELECT id, box_id, min(d) OVER (PARTITION BY id ORDER BY box_id) AS m FROM p), a AS (SELECT box_id, avg((m <= 0.3e0)::INT) AS f, count(*) FILTER (m <= 0.3e0) AS n FROM r GROUP BY box_id) SELECT box_id, {s9('f')} AS covered_fraction, n - coalesce(lag(n) OVER (ORDER BY box_id), 0) AS added_points FROM a", "v_emb")
def _(spark, d):
    pairs = _boxed(spark, d, _emb(spark, d)).select("id", "box_id", S.Box("b_").distance().alias("d"))
    return windows.coverage_curve(pairs, 0.3).select("box_id", r9("covered_fraction").alias("covered_fraction"), "added_points")


@register("running_minimum", f"SELECT id, {s9('min(y) OVER (PARTITION BY user_id ORDER BY id)')} AS least FROM v_event", "v_event")
def _(spark, d):
    return windows.running_minimum(views.event_cloud(spark, d), "user_id", "id", "y").select("id", r9("least").alias("least"))


@register("weighted_median_split", f"WITH r AS (SELECT user_id, x, sum(y) OVER (PARTITION BY user_id ORDER BY x) AS run, sum(y) OVER (PARTITION BY user_id) AS total FROM v_event) SELECT user_id, {s9('min(x)')} AS split FROM r WHERE run >= 0.5e0 * total - 1e-9 GROUP BY user_id", "v_event")
def _(spark, d):
    cloud = views.event_cloud(spark, d)
    return cells.weighted_quantile_split(cloud, "x", "y", 0.5 - 1e-12, ["user_id"]).select("user_id", r9("split").alias("split"))


@register("topk_per_group", "SELECT label, id, k::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY x DESC, id) AS k FROM v_emb) AS t WHERE k <= 4", "v_emb")
def _(spark, d):
    return windows.top_per_group(_emb(spark, d), ["label"], [F.desc("x"), F.col("id")], 4).select("label", "id", "place")


@register("shortlist", "SELECT label, id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY x DESC, id) AS k FROM v_emb) AS t ORDER BY k, label LIMIT 32", "v_emb")
def _(spark, d):
    return windows.round_robin_shortlist(_emb(spark, d), "label", [F.desc("x"), F.col("id")], 32).select("label", "id")


@register("linspace_sample", "WITH r AS (SELECT id, row_number() OVER (ORDER BY y, id) - 1 AS p, count(*) OVER () AS n FROM v_emb), w AS (SELECT DISTINCT floor(i * (n - 1) / 63e0)::BIGINT AS p FROM range(64) AS t(i), (SELECT any_value(n) AS n FROM r) AS m) SELECT id FROM r JOIN w USING (p)", "v_emb")
def _(spark, d):
    return windows.linspace_sample(_emb(spark, d), ["y", "id"], 64).select("id")


@register("largest_remainder", "WITH g AS (SELECT label, count(*) AS mass FROM v_emb GROUP BY label), q AS (SELECT *, 37 * sqrt(mass) / sum(sqrt(mass)) OVER () AS quota FROM g), f AS (SELECT *, floor(quota) AS base, quota - floor(quota) AS rest FROM q), r AS (SELECT *, row_number() OVER (ORDER BY floor(rest * 1e9) DESC, label) AS k, 37 - sum(base) OVER () AS spare FROM f) SELECT label, mass, (base + CASE WHEN k <= spare THEN 1 ELSE 0 END)::BIGINT AS seats FROM r", "v_emb")
def _(spark, d):
    return windows.largest_remainder(_emb(spark, d).groupBy("label").agg(F.count("*").alias("mass")), "label", "mass", 37)


@register("relabel_by_size", "WITH g AS (SELECT label, count(*) AS n, min(id) AS least FROM v_emb GROUP BY label), k AS (SELECT label, row_number() OVER (ORDER BY n DESC, least) - 1 AS region FROM g WHERE n >= 48) SELECT id, coalesce(region, -1)::INT AS region FROM v_emb LEFT JOIN k USING (label)", "v_emb")
def _(spark, d):
    return windows.relabel_by_size(_emb(spark, d), "label", 48).select("id", F.col("region").cast("int").alias("region"))


@register("seeded_sample")
def _(spark, d):
    return windows.seeded_sample(_emb(spark, d), 50, 3).select("id")


@register("weighted_sample")
def _(spark, d):
    return windows.seeded_sample(_emb(spark, d).withColumn("w", F.abs("x")), 50, 3, weight="w").select("id")


# --- sets ------------------------------------------------------------------------------------------

_VOX = "v AS (SELECT DISTINCT floor(x / 0.1e0)::BIGINT AS i, floor(y / 0.1e0)::BIGINT AS j, floor(z / 0.1e0)::BIGINT AS k FROM v_emb)"
_VOX_LOW = "lo AS (SELECT DISTINCT floor(x / 0.1e0)::BIGINT AS i, floor(y / 0.1e0)::BIGINT AS j, floor(z / 0.1e0)::BIGINT AS k FROM v_emb WHERE label < 3)"
_RANGE = lambda c, lo, hi: f"(SELECT unnest(generate_series({lo}, {hi})) AS {c} FROM v)"
_GRID = "m AS (SELECT min(i) li, max(i) hi, min(j) lj, max(j) hj, min(k) lk, max(k) hk FROM v), gi AS (SELECT unnest(generate_series(li, hi)) AS i FROM m), gj AS (SELECT unnest(generate_series(lj, hj)) AS j FROM m), gk AS (SELECT unnest(generate_series(lk, hk)) AS k FROM m), g AS (SELECT i, j, k FROM gi, gj, gk)"


def _voxels(spark, d, rows="true"):
    return voxel.occupancy(_emb(spark, d).where(rows), 0.1)


@register("mask_union", f"WITH {_VOX_LOW}, hi AS (SELECT DISTINCT floor(x / 0.1e0)::BIGINT AS i, floor(y / 0.1e0)::BIGINT AS j, floor(z / 0.1e0)::BIGINT AS k FROM v_emb WHERE label > 6) SELECT * FROM lo UNION SELECT * FROM hi", "v_emb")
def _(spark, d):
    return voxel.safe_region(_voxels(spark, d, "label < 3"), _voxels(spark, d, "label > 6"))


@register("mask_complement", f"WITH {_VOX}, {_GRID} SELECT * FROM g ANTI JOIN v USING (i, j, k)", "v_emb")
def _(spark, d):
    return voxel.complement(_voxels(spark, d))


@register("visible_samples", f"WITH {_B} SELECT id FROM v_emb WHERE NOT EXISTS (SELECT 1 FROM b WHERE {' AND '.join(f'{q} <= 0.1e0' for q in _Q)})", "v_emb")
def _(spark, d):
    cloud = _emb(spark, d)
    inside = _boxed(spark, d, cloud).where(S.Box("b_").contains(0.1)).select("id")
    return cloud.join(inside, "id", "left_anti").select("id")


# --- voxels ----------------------------------------------------------------------------------------


@register("voxel_occupancy", f"WITH {_VOX} SELECT * FROM v", "v_emb")
def _(spark, d):
    return _voxels(spark, d)


@register("dilate", f"WITH {_VOX} SELECT DISTINCT i + a AS i, j + b AS j, k + c AS k FROM v, range(-2, 3) AS p(a), range(-2, 3) AS q(b), range(-2, 3) AS r(c)", "v_emb")
def _(spark, d):
    return voxel.dilate(_voxels(spark, d), 2)


@register("erode", f"WITH {_VOX}, u AS (SELECT DISTINCT i + a AS i, j + b AS j, k + c AS k FROM v, range(-2, 3) AS p(a), range(-2, 3) AS q(b), range(-2, 3) AS r(c)), n AS (SELECT u.i + a AS i, u.j + b AS j, u.k + c AS k FROM u, range(-1, 2) AS p(a), range(-1, 2) AS q(b), range(-1, 2) AS r(c)) SELECT i, j, k FROM n GROUP BY i, j, k HAVING count(*) = 27", "v_emb")
def _(spark, d):
    return voxel.erode(voxel.dilate(_voxels(spark, d), 2), 1)


@register("euclid_band", f"WITH {_VOX} SELECT DISTINCT i + a AS i, j + b AS j, k + c AS k FROM v, range(-2, 3) AS p(a), range(-2, 3) AS q(b), range(-2, 3) AS r(c) WHERE a * a + b * b + c * c <= 2.5000001e0 * 2.5000001e0", "v_emb")
def _(spark, d):
    return voxel.euclidean_band(_voxels(spark, d), 0.25, 0.1)


def _whole(spark, d):
    """All occupied voxels with indices from the cloud's lower corner, and the shape of their bounds."""
    voxels = _voxels(spark, d)
    low = voxels.agg(*[F.min(c).alias(c) for c in "ijk"], *[(F.max(c) - F.min(c) + 1).alias("n" + c) for c in "ijk"]).first()
    if low["i"] is None:
        return voxels, (0, 0, 0)
    return voxels.select(*[(F.col(c) - low[c]).alias(c) for c in "ijk"]), tuple(low["n" + c] for c in "ijk")


_WHOLE = "l AS (SELECT min(i) li, min(j) lj, min(k) lk, max(i) - min(i) + 1 ni, max(j) - min(j) + 1 nj, max(k) - min(k) + 1 nk FROM v), s AS (SELECT i - li AS i, j - lj AS j, k - lk AS k FROM v, l)"


@register("integral_image", f"WITH {_VOX}, {_WHOLE}, gi AS (SELECT unnest(generate_series(0, ni)) AS i FROM l), gj AS (SELECT unnest(generate_series(0, nj)) AS j FROM l), gk AS (SELECT unnest(generate_series(0, nk)) AS k FROM l), g AS (SELECT i, j, k FROM gi, gj, gk) SELECT g.i, g.j, g.k, count(s.i) AS total FROM g LEFT JOIN s ON s.i < g.i AND s.j < g.j AND s.k < g.k GROUP BY g.i, g.j, g.k", "v_emb")
def _(spark, d):
    return voxel.integral_image(*_whole(spark, d))


@register("box_sums", f"WITH {_VOX}, {_WHOLE}, x AS (SELECT 0 AS box_id, 0 AS i0, 0 AS j0, 0 AS k0, ni AS i1, nj AS j1, nk AS k1 FROM l UNION ALL SELECT 1, 0, 0, 0, ni // 2, nj // 2, nk // 2 FROM l UNION ALL SELECT 2, ni // 2, nj // 2, nk // 2, ni, nj, nk FROM l) SELECT box_id, count(s.i) AS n FROM x LEFT JOIN s ON i >= i0 AND i < i1 AND j >= j0 AND j < j1 AND k >= k0 AND k < k1 GROUP BY box_id", "v_emb")
def _(spark, d):
    """Occupied voxels in the bounds of the cloud, and in their lowest and highest eighth."""
    voxels, shape = _whole(spark, d)
    half, none = [n // 2 for n in shape], [0, 0, 0]
    boxes = spark.createDataFrame([(0, *none, *shape), (1, *none, *half), (2, *half, *shape)], "box_id int, i0 int, j0 int, k0 int, i1 int, j1 int, k1 int")
    return voxel.box_sums(voxel.integral_image(voxels, shape), boxes)


_SPACE_BOXES = [(0, -0.2, -0.2, -0.2, 0.2, 0.2, 0.2), (1, -0.13, 0.01, -0.17, 0.11, 0.19, 0.05)]


@register("exterior_fraction_axis", f"WITH {_VOX}, x(box_id, x0, y0, z0, x1, y1, z1) AS ({_values(_SPACE_BOXES)}), o AS (SELECT box_id, sum({' * '.join(f'greatest(0e0, least(({c} + 1) * 0.1e0, {a}1) - greatest({c} * 0.1e0, {a}0))' for a, c in zip('xyz', 'ijk'))}) AS s FROM x, v GROUP BY box_id) SELECT box_id, {s9('1e0 - s / ((x1 - x0) * (y1 - y0) * (z1 - z0))')} AS exterior FROM x JOIN o USING (box_id)", "v_emb")
def _(spark, d):
    boxes = spark.createDataFrame(_SPACE_BOXES, "box_id int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    return voxel.exterior_fraction(_voxels(spark, d), boxes, 0.1).select("box_id", r9("exterior").alias("exterior"))


def _sat_sql(w: float, columns: str = "") -> str:
    h = w / 2
    g = [f"(({c} + 0.5e0) * {w!r}::DOUBLE - c{a})" for a, c in zip("xyz", "ijk")]
    out = [f"abs({g[i]}) < {h!r}::DOUBLE + " + " + ".join(f"abs(r{i}{j}) * d{a} / 2e0" for j, a in enumerate("xyz")) for i in range(3)]
    for j, a in enumerate("xyz"):
        out.append("abs(" + " + ".join(f"{g[i]} * r{i}{j}" for i in range(3)) + f") < d{a} / 2e0 + {h!r}::DOUBLE * (" + " + ".join(f"abs(r{i}{j})" for i in range(3)) + ")")
    for i in range(3):
        a, b = (i + 1) % 3, (i + 2) % 3
        for j in range(3):
            reach = " + ".join(f"d{x} / 2e0 * abs(-r{b}{j} * r{a}{m} + r{a}{j} * r{b}{m})" for m, x in enumerate("xyz"))
            out.append(f"(r{a}{j} * r{a}{j} + r{b}{j} * r{b}{j} <= 1e-24 OR abs(-{g[a]} * r{b}{j} + {g[b]} * r{a}{j}) < {h!r}::DOUBLE * (abs(r{a}{j}) + abs(r{b}{j})) + {reach})")
    return " AND ".join(out)


_CANDIDATES = "a AS (SELECT b.*, i, j, k FROM b, range(-5, 16) AS p(i), range(-5, 16) AS q(j), range(-5, 16) AS r(k))"


def _box_cells_sql(boxes: str, width: str) -> str:
    """CTEs that end in ``a``: each box with the cells of its axis-aligned bounds."""
    reach = lambda i: " + ".join(f"abs(r{i}{j}) * d{b} / 2e0" for j, b in enumerate("xyz"))
    out, source = [], boxes
    for i, (a, c, name) in enumerate(zip("xyz", "ijk", ("a1", "a2", "a"))):
        low, high = (f"floor((c{a} {sign} ({reach(i)})) / {width})::BIGINT" for sign in "-+")
        out.append(f"{name} AS (SELECT *, unnest(generate_series({low}, {high})) AS {c} FROM {source})")
        source = name
    return ", ".join(out)


@register("sat_voxels", f"WITH {_box_cells_sql('v_boxes', '0.1137e0')} SELECT box_id, i, j, k FROM a WHERE {_sat_sql(0.1137)}", "v_boxes")
def _(spark, d):
    return voxel.box_voxels(views.part_boxes(spark, d), 0.1137).where(voxel.box_overlaps_voxel(0.1137)).select("box_id", "i", "j", "k")


@register("certify_boxes", f"WITH {_B}, {_CANDIDATES}, v AS (SELECT DISTINCT floor(x / 0.11e0)::BIGINT AS i, floor(y / 0.11e0)::BIGINT AS j, floor(z / 0.11e0)::BIGINT AS k FROM v_line) SELECT box_id, NOT EXISTS (SELECT 1 FROM a WHERE a.box_id = b.box_id AND {_sat_sql(0.11)} AND NOT EXISTS (SELECT 1 FROM v WHERE v.i = a.i AND v.j = a.j AND v.k = a.k)) AS certified FROM b", "v_line")
def _(spark, d):
    return voxel.certify_boxes(fixed_boxes(spark), voxel.occupancy(_line(spark, d), 0.11), 0.11, strict=True)


@register("voxel_components", f"RECURSIVE WITH {_VOX}, n AS (SELECT *, row_number() OVER (ORDER BY i, j, k) AS q FROM v), e AS (SELECT a.q AS s, b.q AS t FROM n a JOIN n b ON abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) <= 1), r(s, t) AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON r.t = e.s), l AS (SELECT s AS q, min(t) AS root FROM r GROUP BY s), z AS (SELECT root FROM l GROUP BY root HAVING count(*) >= 4) SELECT i, j, k FROM n JOIN l USING (q) JOIN z USING (root)", "v_emb")
def _(spark, d):
    return voxel.label_components(_voxels(spark, d), minimum=4).select("i", "j", "k")


@register("fill_holes", f"RECURSIVE WITH {_VOX}, u AS (SELECT i, j, k FROM v), m AS (SELECT min(i) - 1 li, max(i) + 1 hi, min(j) - 1 lj, max(j) + 1 hj, min(k) - 1 lk, max(k) + 1 hk FROM u), gi AS (SELECT unnest(generate_series(li, hi)) AS i FROM m), gj AS (SELECT unnest(generate_series(lj, hj)) AS j FROM m), gk AS (SELECT unnest(generate_series(lk, hk)) AS k FROM m), g AS (SELECT i, j, k FROM (SELECT i, j, k FROM gi, gj, gk) AS w ANTI JOIN u USING (i, j, k)), o(i, j, k) AS (SELECT li, lj, lk FROM m UNION SELECT g.i, g.j, g.k FROM o JOIN g ON abs(o.i - g.i) <= 1 AND abs(o.j - g.j) <= 1 AND abs(o.k - g.k) <= 1) SELECT i, j, k FROM u UNION SELECT i, j, k FROM (SELECT * FROM g ANTI JOIN o USING (i, j, k)) AS y", "v_emb")
def _(spark, d):
    return voxel.fill_holes(_voxels(spark, d))


@register("clearance", f"WITH {_VOX}, u AS (SELECT DISTINCT i + a AS i, j + b AS j, k + c AS k FROM v, range(-2, 3) AS p(a), range(-2, 3) AS q(b), range(-2, 3) AS r(c)), m AS (SELECT min(i) - 1 li, max(i) + 1 hi, min(j) - 1 lj, max(j) + 1 hj, min(k) - 1 lk, max(k) + 1 hk FROM u), gi AS (SELECT unnest(generate_series(li, hi)) AS i FROM m), gj AS (SELECT unnest(generate_series(lj, hj)) AS j FROM m), gk AS (SELECT unnest(generate_series(lk, hk)) AS k FROM m), e AS (SELECT i, j, k FROM (SELECT i, j, k FROM gi, gj, gk) AS w ANTI JOIN u USING (i, j, k)) SELECT u.i, u.j, u.k, min(greatest(abs(u.i - e.i), abs(u.j - e.j), abs(u.k - e.k))) AS clearance FROM u, e GROUP BY u.i, u.j, u.k", "v_emb")
def _(spark, d):
    return voxel.clearance(voxel.dilate(_voxels(spark, d), 2))


_CUBE = lambda n: f"range({-n}, {n + 1}) AS p(a), range({-n}, {n + 1}) AS q(b), range({-n}, {n + 1}) AS r(c)"


@register(
    "reconstruct_interior",
    f"""RECURSIVE WITH v AS (SELECT DISTINCT floor(x / 0.05e0)::BIGINT AS i, floor(y / 0.05e0)::BIGINT AS j, floor(z / 0.05e0)::BIGINT AS k FROM v_emb), u AS (SELECT DISTINCT i + a AS i, j + b AS j, k + c AS k FROM v, {_CUBE(2)}), m AS (SELECT min(i) - 1 li, max(i) + 1 hi, min(j) - 1 lj, max(j) + 1 hj, min(k) - 1 lk, max(k) + 1 hk FROM u),
    gi AS (SELECT unnest(generate_series(li, hi)) AS i FROM m), gj AS (SELECT unnest(generate_series(lj, hj)) AS j FROM m), gk AS (SELECT unnest(generate_series(lk, hk)) AS k FROM m), g AS (SELECT i, j, k FROM (SELECT i, j, k FROM gi, gj, gk) AS w ANTI JOIN u USING (i, j, k)),
    o(i, j, k) AS (SELECT li, lj, lk FROM m UNION SELECT g.i, g.j, g.k FROM o JOIN g ON abs(o.i - g.i) <= 1 AND abs(o.j - g.j) <= 1 AND abs(o.k - g.k) <= 1), f AS (SELECT i, j, k FROM u UNION SELECT i, j, k FROM (SELECT * FROM g ANTI JOIN o USING (i, j, k)) AS y),
    s AS (SELECT i + a AS i, j + b AS j, k + c AS k FROM f, {_CUBE(3)}), t AS (SELECT i, j, k, row_number() OVER (ORDER BY i, j, k) AS q FROM s GROUP BY i, j, k HAVING count(*) = 343),
    e AS (SELECT a.q AS s, b.q AS t FROM t a JOIN t b ON abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) <= 1), w(s, t) AS (SELECT s, t FROM e UNION SELECT w.s, e.t FROM w JOIN e ON w.t = e.s), l AS (SELECT s AS q, min(t) AS root FROM w GROUP BY s),
    z AS (SELECT root FROM l GROUP BY root HAVING count(*) >= 16) SELECT i, j, k FROM t JOIN l USING (q) JOIN z USING (root)""",
    "v_emb",
)
def _(spark, d):
    """Solid interior of the vectors' voxels."""
    return voxel.reconstruct(voxel.occupancy(_emb(spark, d), 0.05), 2)


@register("ellipsoid_raster", "WITH s AS (SELECT x, y, z, floor(x / 0.05e0)::BIGINT AS ci, floor(y / 0.05e0)::BIGINT AS cj, floor(z / 0.05e0)::BIGINT AS ck FROM v_emb), a AS (SELECT x, y, z, ci + p AS i, cj + q AS j, ck + r AS k FROM s, range(-4, 5) AS u(p), range(-4, 5) AS v(q), range(-4, 5) AS w(r)) SELECT DISTINCT i, j, k FROM a WHERE pow((((i + 0.5e0) * 0.05e0 - x) * -0.28e0 + ((j + 0.5e0) * 0.05e0 - y) * 0.96e0) / 0.03e0, 2) + pow((((i + 0.5e0) * 0.05e0 - x) * -0.96e0 + ((j + 0.5e0) * 0.05e0 - y) * -0.28e0) / 0.02e0, 2) + pow(((k + 0.5e0) * 0.05e0 - z) / 0.04e0, 2) <= 9", "v_emb")
def _(spark, d):
    """Every vector of the table as a splat, turned about z."""
    turn = {"qw": 0.6, "qx": 0.0, "qy": 0.0, "qz": 0.8, "sx": 0.03, "sy": 0.02, "sz": 0.04}
    return voxel.rasterize_ellipsoids(_emb(spark, d).select("x", "y", "z", *[F.lit(v).alias(c) for c, v in turn.items()]), 0.05)


@register("composite_layers")
def _(spark, d):
    donors = views.event_cloud(spark, d).select(
        "user_id", F.col("x").alias("depth"), (F.col("y") % 1.0).alias("alpha"), F.lit(1.0).alias("w"), *[F.lit(v).alias(c) for c, v in zip("rgb", (0.2, 0.4, 0.6))], F.lit(0.1).alias("spacing")
    )
    return windows.composite_layers(donors, ["user_id"])


@register("texel_splat", f"WITH t AS (SELECT floor(x * 40)::BIGINT AS px, floor(y * 40)::BIGINT AS py, l_tax AS w, z FROM v_line) SELECT px, py, {s9('sum(w)')} AS w, {s9('sum(w * z)')} AS wz, {s9('max(z)')} AS top FROM t GROUP BY px, py", "v_line")
def _(spark, d):
    t = _line(spark, d).select(F.floor(F.col("x") * 40).alias("px"), F.floor(F.col("y") * 40).alias("py"), F.col("l_tax").alias("w"), "z")
    return t.groupBy("px", "py").agg(r9(F.sum("w")).alias("w"), r9(F.sum(F.col("w") * F.col("z"))).alias("wz"), r9(F.max("z")).alias("top"))


def _exposed_sql(order: str) -> str:
    """CTEs that end in ``e``: area of each side of the boxes ``v_bounds`` outside those others that satisfy ``order``."""
    parts = []
    for side in range(6):
        axis, (u, v) = "xyz"[side // 2], [c for c in "xyz" if c != "xyz"[side // 2]]
        plane = f"b.{axis}{side % 2}"
        cut = lambda c: (
            f"SELECT b.box_id, p AS {c}a, lead(p) OVER (PARTITION BY b.box_id ORDER BY p) AS {c}b FROM "
            f"(SELECT DISTINCT b.box_id, greatest(b.{c}0, least(b.{c}1, p)) AS p FROM v_bounds b, (SELECT {c}0 AS p FROM v_bounds UNION SELECT {c}1 FROM v_bounds) AS q) AS b"
        )
        hidden = " AND ".join([f"{plane} >= o.{axis}0", f"{plane} <= o.{axis}1", *[f"(s.{c}a + s.{c}b) / 2 >= o.{c}0 AND (s.{c}a + s.{c}b) / 2 <= o.{c}1" for c in (u, v)]])
        parts.append(
            f"SELECT b.box_id, {side} AS side, sum((s.{u}b - s.{u}a) * (s.{v}b - s.{v}a)) AS area FROM v_bounds b JOIN "
            f"(SELECT f.box_id, {u}a, {u}b, {v}a, {v}b FROM ({cut(u)}) AS f JOIN ({cut(v)}) AS g ON f.box_id = g.box_id WHERE {u}b > {u}a AND {v}b > {v}a) AS s ON s.box_id = b.box_id "
            f"WHERE NOT EXISTS (SELECT 1 FROM v_bounds o WHERE {order} AND {hidden}) GROUP BY b.box_id"
        )
    return f"e AS ({' UNION ALL '.join(parts)})"


@register("union_area", f"WITH {_exposed_sql('o.box_id <> b.box_id')} SELECT {s9('sum(area)')} AS area FROM e", "v_bounds")
def _(spark, d):
    """Exposed area of the union of all labels' bounds, from its rectangles."""
    rects = views.union_rectangles(views.label_boxes(spark, d))
    edges = [F.col(f"{a}1") - F.col(f"{a}0") for a in "xyz"]
    area = edges[0] * edges[1] + edges[1] * edges[2] + edges[2] * edges[0]
    return rects.agg(r9(F.sum(area)).alias("area"))


def queries() -> dict[str, Query]:
    from orthant.plans import model_queries  # noqa: F401  registers the rest

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_oracles)
