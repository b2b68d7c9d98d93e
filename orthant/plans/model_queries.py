"""Queries of normals, meshes, fits and textures."""

from __future__ import annotations

from pyspark.sql import functions as F

from orthant.functions import scalar as S
from orthant.operators import cells, mesh, normals, objective, voxel
from orthant.plans.registry import _exposed_sql, r9, register, s9
from orthant.sources import views

_EYE = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]


def _part_neighbours(k: int, own: bool = False) -> str:
    """CTEs that end in ``e``: the nearest of the distinct part positions to each, with their offsets."""
    return f"""q AS (SELECT x, y, min(id) AS id FROM v_part GROUP BY x, y),
    p AS (SELECT a.id, b.id AS other_id, b.x - a.x AS dx, b.y - a.y AS dy, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM q a JOIN q b ON {'true' if own else 'a.id <> b.id'}),
    e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other_id) AS rank FROM p) AS r WHERE rank <= {k})"""


def _part_geometry(k: int) -> str:
    """CTEs that end in ``g``: spacing, the two eigenvalues within the plane and whether the normal is valid."""
    return f"""{_part_neighbours(k)}, s AS (SELECT id, quantile_cont(d, 0.5) AS spacing FROM e WHERE rank <= 3 GROUP BY id),
    m AS (SELECT id, count(*) AS n, avg(dx * dx) - avg(dx) * avg(dx) AS xx, avg(dx * dy) - avg(dx) * avg(dy) AS xy, avg(dy * dy) - avg(dy) * avg(dy) AS yy FROM e JOIN s USING (id) WHERE d > 0 AND d <= 6e0 * spacing * (1 + 1e-10) GROUP BY id),
    l AS (SELECT id, n, (xx + yy - sqrt((xx - yy) * (xx - yy) + 4 * xy * xy)) / 2 AS e1, (xx + yy + sqrt((xx - yy) * (xx - yy) + 4 * xy * xy)) / 2 AS e2 FROM m),
    g AS (SELECT q.id, spacing, e1, e2, coalesce(n >= 8 AND e1 > 1e-5 * (e1 + e2), false) AS valid FROM q LEFT JOIN s USING (id) LEFT JOIN l USING (id))"""


@register("normals", f"WITH {_part_geometry(30)} SELECT id, valid, CASE WHEN valid THEN true END AS upright, {s9('CASE WHEN valid THEN e1 END')} AS e1, {s9('CASE WHEN valid THEN e2 END')} AS e2 FROM g", "v_part")
def _(spark, d):
    """Normals of the planar part cloud: which are valid, that these stand on the plane, and the spread within it."""
    places, edges = normals.neighbourhoods(views.part_cloud(spark, d))
    found = normals.local_geometry(places, edges)
    valid = lambda c: F.when(F.col("valid"), c)
    e = F.col("eigenvalues")
    return found.select("id", "valid", valid(F.abs(F.col("normal")[2]) > 1 - 1e-9).alias("upright"), r9(valid(e[1])).alias("e1"), r9(valid(e[2])).alias("e2"))


@register(
    "edge_tangents",
    f"""WITH {_part_neighbours(24, own=True)}, m AS (SELECT id, count(*) AS n, avg(dx * dx) - avg(dx) * avg(dx) AS xx, avg(dx * dy) - avg(dx) * avg(dy) AS xy, avg(dy * dy) - avg(dy) * avg(dy) AS yy FROM e WHERE d <= 0.0973e0 GROUP BY id),
    l AS (SELECT *, sqrt((xx - yy) * (xx - yy) + 4 * xy * xy) AS s FROM m)
    SELECT id, {s9('CASE WHEN n >= 5 AND xx + yy + s > 2e-20 THEN 2 * s / (xx + yy + s) ELSE 0 END')} AS linearity FROM l""",
    "v_part",
)
def _(spark, d):
    """How far the surroundings of each position of the part cloud follow one line."""
    places = cells.distinct_positions(views.part_cloud(spark, d)).withColumnRenamed("first_id", "id")
    return normals.tangents(places, 0.0973).select("id", r9("linearity").alias("linearity"))


@register("cloud_normals")
def _(spark, d):
    places, edges = normals.neighbourhoods(views.embedding_cloud(spark, d))
    return normals.local_geometry(places, edges).select("id", "valid", r9(F.col("eigenvalues")[0]).alias("e0"), r9(F.col("eigenvalues")[2]).alias("e2"))


@register("edge_scores")
def _(spark, d):
    length = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    cloud = views.embedding_cloud(spark, d).withColumn("length", length).where("length > 0")
    places, edges = normals.neighbourhoods(cloud.select("id", *[(F.col(a) / F.col("length")).alias(a) for a in "xyz"]))  # the unit sphere
    scores = normals.edge_scores(normals.local_geometry(places, edges), edges)
    return scores.select("id", r9("score").alias("score"))


@register(
    "regions",
    f"""RECURSIVE WITH {_part_geometry(24)}, k AS (SELECT DISTINCT e.id AS s, other_id AS t FROM e JOIN g a ON a.id = e.id JOIN g b ON b.id = other_id WHERE a.valid AND b.valid AND d <= 3.5e0 * least(a.spacing, b.spacing)),
    u AS (SELECT s, t FROM k UNION SELECT t, s FROM k UNION SELECT id, id FROM g WHERE valid), r(s, t) AS (SELECT s, t FROM u UNION SELECT r.s, u.t FROM r JOIN u ON r.t = u.s),
    c AS (SELECT s AS id, min(t) AS part FROM r GROUP BY s), z AS (SELECT part, count(*) AS n FROM c GROUP BY part HAVING count(*) >= 20), o AS (SELECT part, row_number() OVER (ORDER BY n DESC, part) - 1 AS region FROM z)
    SELECT g.id, coalesce(region, -1)::INT AS region FROM g LEFT JOIN c USING (id) LEFT JOIN o USING (part)""",
    "v_part",
)
def _(spark, d):
    """Surface regions of the planar part cloud."""
    places, edges = normals.neighbourhoods(views.part_cloud(spark, d), 24)
    return normals.segment_surfaces(places, normals.local_geometry(places, edges), edges)


def _label_boxes(spark, d):
    """The bounds of each label's vectors as the mesh operators take boxes."""
    ends = [(F.col(f"{a}0"), F.col(f"{a}1")) for a in "xyz"]
    eye = F.array(*[F.array(*map(F.lit, row)) for row in _EYE])
    return views.label_boxes(spark, d).select(F.col("box_id").cast("int").alias("box_id"), F.array(*[(a + b) / 2.0 for a, b in ends]).alias("center"), F.array(*[b - a for a, b in ends]).alias("dimensions"), eye.alias("rotation"))


@register("surface_area", f"WITH {_exposed_sql('o.box_id <> b.box_id')} SELECT box_id, side, {s9('area')} AS area FROM e WHERE area > 1e-9", "v_bounds")
def _(spark, d):
    """What of each side of the labels' bounds lies on the surface of their union."""
    return mesh.exposed_polygons(_label_boxes(spark, d)).groupBy("box_id", "side").agg(r9(F.sum("area")).alias("area"))


@register("render_polygons", f"WITH {_exposed_sql('o.box_id < b.box_id')} SELECT box_id, side, {s9('area')} AS area FROM e WHERE area > 1e-9", "v_bounds")
def _(spark, d):
    """What of each side is drawn where boxes come in order and the first one owns a place."""
    return mesh.exposed_polygons(_label_boxes(spark, d), earlier_only=True).groupBy("box_id", "side").agg(r9(F.sum("area")).alias("area"))


@register("surface_samples", f"WITH {_exposed_sql('o.box_id <> b.box_id')} SELECT {s9('sum(area)')} AS area FROM e", "v_bounds")
def _(spark, d):
    """Samples of the union's surface stand for all of its area."""
    tri = mesh.triangles(mesh.exposed_polygons(_label_boxes(spark, d)))
    return mesh.surface_samples(tri, 0.02).agg(r9(F.sum("area")).alias("area"))


@register("support_bounds")
def _(spark, d):
    """Bounds on the share of the labels' union that has vectors near; tests hold them against dense samples."""
    tri = mesh.triangles(mesh.exposed_polygons(_label_boxes(spark, d)))
    found = mesh.support_bounds(tri, views.embedding_cloud(spark, d).select("id", "x", "y", "z"), 0.1)
    return spark.createDataFrame([(found["lower"], found["upper"], found["area"])], "lower double, upper double, area double").select(*[r9(c).alias(c) for c in ("lower", "upper", "area")])


@register(
    "edge_lines",
    f"""WITH p AS (SELECT (p_size % 8) * 4e0 AS x, p_retailprice - 900e0 AS y FROM part GROUP BY ALL), s AS (SELECT *, coalesce(y - lag(y) OVER o > 2.04e0, false)::INT AS step FROM p WINDOW o AS (PARTITION BY x ORDER BY y)),
    r AS (SELECT *, sum(step) OVER (PARTITION BY x ORDER BY y) AS run FROM s) SELECT {s9('x')} AS x, {s9('min(y)')} AS low, {s9('max(y)')} AS high, count(*) AS n FROM r GROUP BY x, run HAVING count(*) >= 10""",
)
def _(spark, d):
    """Parts of each residue of their size along their price: straight edges, cut where prices leave a gap."""
    from orthant.functions.config import LineSettings

    rows = views.table(spark, d, "part").groupBy(((F.col("p_size") % 8) * 4.0).alias("x"), (F.col("p_retailprice") - 900.0).alias("y")).agg(F.min("p_partkey").alias("id"))
    lines, _ = normals.edge_lines(rows.select("id", "x", "y", F.lit(0.0).alias("z"), F.lit(90.0).alias("score")), 0.51, LineSettings(maximum_lines=1024))
    return lines.select(r9(F.col("a")[0]).alias("x"), r9(F.least(F.col("a")[1], F.col("b")[1])).alias("low"), r9(F.greatest(F.col("a")[1], F.col("b")[1])).alias("high"), "n")


@register("region_frames", "SELECT CASE WHEN x < 0.5e0 THEN 0 ELSE 1 END AS region, true AS proper, true AS upright FROM v_part GROUP BY region", "v_part")
def _(spark, d):
    """Two halves of a planar cloud: each frame is a rotation, and one axis stands on the plane."""
    cloud = views.part_cloud(spark, d)
    frames = normals.region_frames(cloud, cloud.select("id", F.when(F.col("x") < 0.5, 0).otherwise(1).alias("region")))
    a = F.col("axes")
    det = sum((a[0][i] * (a[1][(i + 1) % 3] * a[2][(i + 2) % 3] - a[1][(i + 2) % 3] * a[2][(i + 1) % 3]) for i in range(1, 3)), a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]))
    return frames.select("region", (F.abs(det - 1) < 1e-9).alias("proper"), F.exists("axes", lambda v: F.abs(v[2]) > 1 - 1e-9).alias("upright"))


@register("hull_directions")
def _(spark, d):
    """Main normals of the vectors' hull and their shares of its area; tests hold hulls against all triples."""
    from orthant.operators.hull import hull_directions

    found = hull_directions(views.embedding_cloud(spark, d))
    rows = [(n, *map(float, way), share) for n, (way, share) in enumerate(found)]  # a few dozen at most
    return spark.createDataFrame(rows, "rank int, x double, y double, z double, share double").select("rank", *[r9(c).alias(c) for c in ("x", "y", "z", "share")])


@register("greedy_cover")
def _(spark, d):
    """Boxes of a fit of all lineitems for coverage alone: a lattice of quantities and discounts, returned items in a layer of their own."""
    from orthant.functions.config import FitSettings
    from orthant.plans.fit import fit_cuboids

    layer = F.when(F.col("l_returnflag") == "R", 0.5).otherwise(0.0)
    cloud = views.table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") / 50.0).alias("x"), (F.col("l_discount") * 2.0).alias("y"), layer.alias("z"))
    fit = fit_cuboids(cloud, FitSettings(resolution=16, max_cuboids=2, target_surface_support=0.0))
    return mesh.boxes_table(spark, fit.boxes).select("box_id", *[r9(F.col("dimensions")[i]).alias(f"d{i}") for i in range(3)])


@register("bake_face")
def _(spark, d):
    """Texels of a planar cloud's front face, each of the colour that the points around it have."""
    from orthant.operators import texture

    cloud = views.part_cloud(spark, d)
    ends = cloud.agg(*[F.min(a) for a in "xy"], *[F.max(a) for a in "xy"]).first()
    points = cloud.select("id", "x", "y", "z", F.col("x").alias("r"), F.lit(0.4).alias("g"), F.lit(0.2).alias("b"), F.lit(1.0).alias("opacity"), F.lit(0.03).alias("spacing"))
    low, high = (float(ends[0]), float(ends[1])), (float(ends[2]), float(ends[3]))
    boxes = mesh.boxes_table(spark, [{"center": ((low[0] + high[0]) / 2, (low[1] + high[1]) / 2, 0.0), "dimensions": (high[0] - low[0], high[1] - low[1], 0.02), "rotation": _EYE}])
    rects = spark.createDataFrame([(0, 5, 0, 16, 16)], "box_id int, side int, face int, tw int, th int")
    return texture.bake(points, boxes, rects, 0.05).select("face", "px", "py", *[r9(c).alias(c) for c in "rgb"])


@register("atlas_packing", "SELECT 6 * count(*) AS faces, false AS overlap, true AS inside FROM v_bounds", "v_bounds")
def _(spark, d):
    """Rectangles for all faces of the labels' bounds in one atlas."""
    from orthant.operators.texture import pack_atlas

    sides = S.box_faces(mesh.flat_boxes(_label_boxes(spark, d))).orderBy("box_id", "side").select("width", "height").collect()  # six a box
    rects = [(i, *r) for i, r in enumerate(pack_atlas([(r["width"], r["height"]) for r in sides], 512))]
    table = spark.createDataFrame(rects, "face int, x int, y int, w int, h int")
    other = table.select(*[F.col(c).alias("o" + c) for c in table.columns])
    hit = table.join(other, (F.col("face") < F.col("oface")) & (F.col("x") < F.col("ox") + F.col("ow")) & (F.col("ox") < F.col("x") + F.col("w")) & (F.col("y") < F.col("oy") + F.col("oh")) & (F.col("oy") < F.col("y") + F.col("h")))
    return table.agg(F.count("*").alias("faces"), F.lit(hit.count() > 0).alias("overlap"), F.min((F.col("x") >= 0) & (F.col("x") + F.col("w") <= 512) & (F.col("y") + F.col("h") <= 512)).alias("inside"))


@register("streaming_sessions", """WITH e AS (SELECT user_id, ts::TIMESTAMP AS t FROM events), s AS (SELECT *, coalesce(t - lag(t) OVER o >= INTERVAL 12 HOUR, false)::INT AS step FROM e WINDOW o AS (PARTITION BY user_id ORDER BY t)),
r AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY t) AS run FROM s) SELECT user_id, epoch_us(min(t)) AS first, epoch_us(max(t)) AS last, count(*) AS n FROM r GROUP BY user_id, run""")
def _(spark, d):
    """The batch runs of ``gap_runs``, found by a streaming query with session windows."""
    from orthant.streaming import live

    events = live.read_stream(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("t"))
    out = live.drain(live.gap_sessions(events, "t", ["user_id"], "12 hours"))
    return out.select("user_id", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "n")


from orthant.plans import registry as R  # noqa: E402

_FIELD = f"f AS (SELECT id, x, y, z, abs(x) AS w, {R._SIGNED} AS old FROM v_emb, (SELECT * FROM b WHERE box_id = 0) AS o)"
_CAP = lambda s: f"least(abs({s}) / 0.2e0, 1e0)"


@register(
    "trial_scores",
    f"""WITH {R._B}, {_FIELD}, n AS (SELECT f.*, box_id, dx * dy * dz AS v, least(old, {R._SIGNED}) AS new FROM f, (SELECT * FROM b WHERE box_id > 0) AS t),
    g AS (SELECT box_id, any_value(v) AS v, sum(w * (greatest(old, 0e0) > 0.2e0 AND greatest(new, 0e0) <= 0.2e0)::INT) / sum(w) AS a, sum(w * ({_CAP('old')} - {_CAP('new')})) / sum(w) AS s,
    sum(w * ((abs(new) <= 0.2e0)::INT - (abs(old) <= 0.2e0)::INT)) / sum(w) AS c FROM n GROUP BY box_id)
    SELECT box_id, {R.s9('a')} AS volume_gain, {R.s9('s')} AS source_gain, {R.s9('c')} AS coverage_gain, {R.s9('greatest(a + s + c + 0.25e0 * 0.1e0, 0e0) / (1e0 + 2e0 * 0.5e0 * v / 1e0)')} AS score FROM g""",
    "v_emb",
)
def _(spark, d):
    boxes = R.fixed_boxes(spark)
    points = views.embedding_cloud(spark, d).withColumn("weight", F.abs("x"))
    trials = boxes.where("box_id > 0").withColumn("exterior", F.lit(0.5)).withColumn("reverse_gain", F.lit(0.1))
    out = objective.trial_scores(points, boxes.where("box_id = 0"), trials, 0.2, reference_volume=1.0)
    return out.select("box_id", *[r9(c).alias(c) for c in ("volume_gain", "source_gain", "coverage_gain", "score")])


@register("union_field", f"WITH {R._B} SELECT id, {R.s9(f'min({R._SIGNED})')} AS field FROM v_emb, b GROUP BY id", "v_emb")
def _(spark, d):
    return objective.union_field(views.embedding_cloud(spark, d).select("id", "x", "y", "z"), R.fixed_boxes(spark)).select("id", r9("field").alias("field"))


@register("buried_points", "SELECT id FROM v_emb WHERE greatest(abs(x), abs(y), abs(z)) < 0.05e0", "v_emb")
def _(spark, d):
    """Deeper than 0.15 in a cube of half side 0.2."""
    cube = mesh.boxes_table(spark, [{"center": (0, 0, 0), "dimensions": (0.4, 0.4, 0.4), "rotation": _EYE}])
    return objective.buried(views.embedding_cloud(spark, d).select("id", "x", "y", "z"), cube, 0.15).select("id")


@register("distance_metrics", f"WITH {R._B}, p AS (SELECT id, any_value(abs(x)) AS w, min({R._DIST}) AS d FROM v_emb, b GROUP BY id) SELECT count(*) AS n, {R.s9('avg(d)')} AS mean, {R.s9('sqrt(avg(d * d))')} AS rms, {R.s9('sum(w * d) / sum(w)')} AS weighted_mean, {R.s9('sqrt(sum(w * d * d) / sum(w))')} AS weighted_rms, {R.s9('quantile_cont(d, 0.5)')} AS q50, {R.s9('quantile_cont(d, 0.9)')} AS q90, {R.s9('quantile_cont(d, 0.95)')} AS q95, {R.s9('quantile_cont(d, 0.99)')} AS q99, {R.s9('max(d)')} AS q100 FROM p", "v_emb")
def _(spark, d):
    points = views.embedding_cloud(spark, d).select("id", "x", "y", "z").withColumn("weight", F.abs("x"))
    out = objective.distance_metrics(objective.union_field(points, R.fixed_boxes(spark)), F.col("far"))
    return out.select("n", *[r9(c).alias(c) for c in out.columns[1:]])


@register("reverse_error", f"WITH s AS (SELECT id, x, y, z FROM v_emb WHERE label = 0), p AS (SELECT s.id, min(sqrt((s.x - v.x) * (s.x - v.x) + (s.y - v.y) * (s.y - v.y) + (s.z - v.z) * (s.z - v.z))) AS d FROM s, v_emb v WHERE v.label > 4 GROUP BY s.id), i AS (SELECT sum(0.01e0 * least(d / 0.05e0, 4e0)) AS v FROM p) SELECT {R.s9('v / (0.5e0 + v)')} AS reverse_error FROM i", "v_emb")
def _(spark, d):
    cloud = views.embedding_cloud(spark, d)
    samples = cloud.where("label = 0").withColumn("area", F.lit(0.01))
    return objective.reverse_error(samples, cloud.where("label > 4"), 0.05, 0.5).select(r9("reverse_error").alias("reverse_error"))


@register("transfer_normals", "SELECT id, true AS upright FROM v_part", "v_part")
def _(spark, d):
    """Points just above a planar cloud take its normals, whatever their signs."""
    cloud = views.part_cloud(spark, d)
    sign = F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0)
    donors = cloud.withColumn("normal", F.array(F.lit(0.0), F.lit(0.0), sign)).withColumn("spacing", F.lit(0.02))
    found = objective.transfer_normals(cloud.withColumn("z", F.lit(0.001)), donors)
    return found.select("id", (F.abs(F.col("normal")[2]) > 1 - 1e-9).alias("upright"))


@register(
    "normal_votes",
    f"""WITH f AS (SELECT unnest([('x' || r00, 2 * dy * dz), ('y' || r00, 2 * dx * dz), ('z', 2 * dx * dy)]) AS f FROM v_boxes), g AS (SELECT f[1] AS way, sum(f[2]) AS area FROM f GROUP BY way)
    SELECT {s9('area / sum(area) OVER ()')} AS share FROM g""",
    "v_boxes",
)
def _(spark, d):
    """Faces of two families of cuboids vote for five directions, with their shares of the area."""
    votes = objective.normal_votes(S.box_faces(views.part_boxes(spark, d)).select("normal", "area"))
    return spark.createDataFrame([(float(share),) for _, share in votes], "share double").select(r9("share").alias("share"))


@register("weighted_voxel_mass", f"SELECT floor(x / 0.1e0)::BIGINT AS i, floor(y / 0.1e0)::BIGINT AS j, floor(z / 0.1e0)::BIGINT AS k, {R.s9('sum(abs(x))')} AS mass, {R.s9('min(x)')} AS mx FROM v_emb GROUP BY ALL", "v_emb")
def _(spark, d):
    from orthant.plans.fit import voxel_mass

    points = views.embedding_cloud(spark, d).withColumn("weight", F.abs("x"))
    return voxel_mass(points, 0.1).select(*voxel.IJK, r9("mass").alias("mass"), r9("mx").alias("mx"))


@register("representatives_within", "SELECT true AS few, true AS many")
def _(spark, d):
    """As many representatives as a budget of 100 allows, and no more."""
    n = cells.representatives_within(views.embedding_cloud(spark, d), 100).count()
    return spark.createDataFrame([(n <= 100, n >= 80)], "few boolean, many boolean")


@register("panel_layers", f"SELECT floor(y / 0.5e0)::BIGINT AS bin, count(*) AS n, {R.s9('sum(x)')} AS mass FROM v_part GROUP BY bin", "v_part")
def _(spark, d):
    """Layers of a planar cloud along its normal."""
    cloud = views.part_cloud(spark, d)
    return cloud.groupBy(F.floor(F.col("y") / 0.5).alias("bin")).agg(F.count("*").alias("n"), r9(F.sum("x")).alias("mass"))


def _faces_sql() -> str:
    """Grid points of the six sides of the labels' bounds, at most 0.05 apart."""
    parts = []
    for axis in "xyz":
        for end in "01":
            at = {c: f"{c}0 + ({c}1 - {c}0) * (i{c} / n{c}::DOUBLE)" if c != axis else f"{c}{end}" for c in "xyz"}
            u, v = [c for c in "xyz" if c != axis]
            parts.append(f"SELECT {', '.join(f'{e} AS {c}' for c, e in at.items())} FROM (SELECT *, unnest(generate_series(0, n{v})) AS i{v} FROM (SELECT *, unnest(generate_series(0, n{u})) AS i{u} FROM n) AS t) AS t")
    steps = ", ".join(f"greatest(1, ceil(({c}1 - {c}0) / 0.05e0)::INT) AS n{c}" for c in "xyz")
    return f"WITH n AS (SELECT *, {steps} FROM v_bounds) SELECT {', '.join(f'{s9(c)} AS {c}' for c in 'xyz')} FROM ({' UNION '.join(parts)}) AS u"


@register("analytic_clouds", _faces_sql(), "v_bounds")
def _(spark, d):
    """Sampled rectangles: the sides of the labels' bounds."""
    ends = {f"{c}{e}" for c in "xyz" for e in "01"}
    sides = F.array(*[F.struct(*[F.col(f"{c}{end}" if c[0] == axis else c + e).alias(c + e) for c in "xyz" for e in "01"]) for axis in "xyz" for end in "01"])
    rects = views.label_boxes(spark, d).select(F.explode(sides).alias("s")).select(*[f"s.{c}" for c in sorted(ends)])
    return views.sample_rectangles(rects, 0.05).select(*[r9(c).alias(c) for c in "xyz"])


_TURN = [[0.6, -0.8 * 5 / 13, 0.8 * 12 / 13], [0.8, 0.6 * 5 / 13, -0.6 * 12 / 13], [0.0, 12 / 13, 5 / 13]]


def _turned_sql() -> str:
    at = [f"({c} + 0.5e0)" for c in "ijk"]
    dot = lambda w: " + ".join(f"{a} * {float(v)!r}::DOUBLE" for a, v in zip(at, w))
    half = [sum(abs(v) for v in row) / 2 for row in _TURN]
    inner = ", ".join(f"floor({dot([_TURN[a][j] for a in range(3)])})::BIGINT AS {c}" for j, c in enumerate("ijk"))
    ends = ", ".join(f"floor({dot(row)} - {h!r}::DOUBLE + 1e-9)::BIGINT AS l{c}, ceil({dot(row)} + {h!r}::DOUBLE - 1e-9)::BIGINT AS h{c}" for row, h, c in zip(_TURN, half, "ijk"))
    return f"""WITH o AS (SELECT DISTINCT floor(x / 0.1e0)::BIGINT AS i, floor(y / 0.1e0)::BIGINT AS j, floor(z / 0.1e0)::BIGINT AS k FROM v_emb), safe AS (SELECT DISTINCT i + a AS i, j + b AS j, k + c AS k FROM o, range(-1, 2) AS p(a), range(-1, 2) AS q(b), range(-1, 2) AS r(c)),
    t AS (SELECT DISTINCT i + a AS i, j + b AS j, k + c AS k FROM (SELECT {inner} FROM safe) AS s, range(-1, 2) AS p(a), range(-1, 2) AS q(b), range(-1, 2) AS r(c)), e AS (SELECT i, j, k, {ends} FROM t)
    SELECT i, j, k FROM e WHERE NOT EXISTS (SELECT 1 FROM range(0, 3) AS p(a), range(0, 3) AS q(b), range(0, 3) AS r(c) WHERE li + a < hi AND lj + b < hj AND lk + c < hk AND (li + a, lj + b, lk + c) NOT IN (SELECT (i, j, k) FROM safe))"""


@register("turned_cells", _turned_sql(), "v_emb")
def _(spark, d):
    """Cells of a turned lattice that the cells around the vectors hold whole."""
    return voxel.turned_cells(voxel.dilate(voxel.occupancy(views.embedding_cloud(spark, d), 0.1), 1), _TURN)


_COUNTED = "o AS (SELECT DISTINCT floor(x / 0.1e0)::BIGINT AS i, floor(y / 0.1e0)::BIGINT AS j, floor(z / 0.1e0)::BIGINT AS k FROM v_emb WHERE label < 5), s AS (SELECT DISTINCT floor(x / 0.1e0)::BIGINT AS i, floor(y / 0.1e0)::BIGINT AS j, floor(z / 0.1e0)::BIGINT AS k FROM v_emb WHERE label > 2)"


@register("voxel_counts", f"WITH {_COUNTED} SELECT (SELECT count(*) FROM o) AS reference, (SELECT count(*) FROM s) AS conservative, (SELECT count(*) FROM o JOIN s USING (i, j, k)) AS shared", "v_emb")
def _(spark, d):
    cloud = views.embedding_cloud(spark, d)
    return voxel.voxel_counts(reference=voxel.occupancy(cloud.where("label < 5"), 0.1), conservative=voxel.occupancy(cloud.where("label > 2"), 0.1))


def _growth_sql() -> str:
    """Six steps from the middles of occupied cells; at each, cells of the swept box that are not safe bound the way."""
    w, far, steps = "0.1e0", "0.8e0", "4096e0"
    safe = "v AS (SELECT DISTINCT floor(x / 0.1e0)::BIGINT AS i, floor(y / 0.1e0)::BIGINT AS j, floor(z / 0.1e0)::BIGINT AS k FROM v_emb), safe AS (SELECT DISTINCT i + a AS i, j + b AS j, k + c AS k FROM v, range(-1, 2) AS p(a), range(-1, 2) AS q(b), range(-1, 2) AS r(c))"
    out = [safe, f"s0 AS (SELECT i AS bi, j AS bj, k AS bk, (i + 0.5e0) * {w} AS cx, (j + 0.5e0) * {w} AS cy, (k + 0.5e0) * {w} AS cz, 0.025e0 AS dx, 0.025e0 AS dy, 0.025e0 AS dz FROM v)"]
    for turn in range(6):
        a, sign, source = "xyz"[turn // 2], "+" if turn % 2 else "-", f"s{turn}"
        ends = {c: (f"c{c} - d{c} / 2e0", f"c{c} + d{c} / 2e0") for c in "xyz"}
        ends[a] = (ends[a][0], f"{ends[a][1]} + {far}") if sign == "+" else (f"{ends[a][0]} - {far}", ends[a][1])
        cells_sql = source
        for c, n in zip("xyz", "ijk"):
            cells_sql = f"(SELECT *, unnest(generate_series(floor(({ends[c][0]}) / {w})::BIGINT, floor(({ends[c][1]}) / {w})::BIGINT)) AS {n} FROM {cells_sql})"
        gap = {c: f"(({n} + 0.5e0) * {w} - c{c})" for c, n in zip("xyz", "ijk")}
        reach = {c: f"(0.05e0 + d{c} / 2e0)" for c in "xyz"}
        ahead = gap[a] if sign == "+" else f"(-{gap[a]})"
        meets = " AND ".join([f"{ahead} > 1e-9 - {reach[a]}", *[f"abs({gap[c]}) < {reach[c]} - 1e-9" for c in "xyz" if c != a]])
        out.append(f"m{turn} AS (SELECT bi, bj, bk, min(greatest(0e0, {ahead} - {reach[a]})) AS way FROM (SELECT u.* FROM {cells_sql} AS u ANTI JOIN safe ON u.i = safe.i AND u.j = safe.j AND u.k = safe.k) AS u WHERE {meets} GROUP BY bi, bj, bk)")
        t = f"(least(floor(least(coalesce(way, {far}), {far}) / ({far} / {steps}) + 1e-9), 4095) * ({far} / {steps}))"
        out.append(f"s{turn + 1} AS (SELECT bi, bj, bk, " + ", ".join(f"c{c} {sign} {t} / 2e0 AS c{c}" if c == a else f"c{c}" for c in "xyz") + ", " + ", ".join(f"d{c} + {t} AS d{c}" if c == a else f"d{c}" for c in "xyz") + f" FROM {source} LEFT JOIN m{turn} USING (bi, bj, bk))")
    columns = ", ".join(f"{s9(c)} AS {c}" for c in ("cx", "cy", "cz", "dx", "dy", "dz"))
    return f"WITH {', '.join(out)} SELECT bi, bj, bk, {columns} FROM s6"


@register("certified_growth", _growth_sql(), "v_emb")
def _(spark, d):
    """A small box in every occupied cell grows as far as the cells around occupied ones allow."""
    from orthant.operators import growth

    occupied = voxel.occupancy(views.embedding_cloud(spark, d), 0.1)
    at = [((F.col(c) + 0.5) * 0.1).alias("c" + a) for a, c in zip("xyz", voxel.IJK)]
    boxes = occupied.select(F.struct(*[F.col(c).alias("b" + c) for c in voxel.IJK]).alias("box_id"), *at, *[F.lit(0.025).alias("d" + a) for a in "xyz"], *[F.lit(float(i == j)).alias(f"r{i}{j}") for i in range(3) for j in range(3)])
    found = growth.grow_certified(boxes, voxel.dilate(occupied, 1), 0.1, 0.8)
    return found.select("box_id.*", *[r9(c).alias(c) for c in ("cx", "cy", "cz", "dx", "dy", "dz")])


@register("refined_boxes")
def _(spark, d):
    """The fixed cuboids refined to the lineitem cloud, all of it safe; tests hold refinement against plain loops."""
    import numpy as np

    from orthant.operators.refine import refine_boxes

    points = objective.with_field(R._line(spark, d).select("x", "y", "z", (F.col("l_tax") + 0.01).alias("weight")))
    total = points.agg(F.sum("weight")).first()[0]
    boxes = [{"center": np.array(b[1:4]), "dimensions": np.array(b[4:7]), "rotation": np.array(b[7:]).reshape(3, 3), "kind": "fixed"} for b in R.BOXES]
    found = refine_boxes(points, boxes, lambda trials: [True] * len(trials), lambda box: 0.5, 0.05, total=total, deep=0.0, reference_volume=1.0)
    rows = [(i, *map(float, box["center"]), *map(float, box["dimensions"]), score) for i, (box, score) in enumerate(found)]
    return spark.createDataFrame(rows, "box_id int, cx double, cy double, cz double, dx double, dy double, dz double, score double")


_PART_U, _PART_V = "p_size / 50e0", "(p_retailprice - 900e0) / 100e0"
_DIAMOND = [(f"{_PART_U} + 0.0613e0", _PART_V), (_PART_U, f"{_PART_V} + 0.0437e0"), (f"{_PART_U} - 0.0821e0", _PART_V), (_PART_U, f"{_PART_V} - 0.0719e0")]
_INSIDE = " AND ".join(
    f"(({b[0]}) - ({a[0]})) * (y - ({a[1]})) - (({b[1]}) - ({a[1]})) * (x - ({a[0]})) >= -1e-10" for a, b in zip(_DIAMOND, _DIAMOND[1:] + _DIAMOND[:1])
)


@register(
    "texel_mask",
    f"""WITH t AS (SELECT px::INT AS px, py::INT AS py, (px + 0.5e0) * 1.01e0 / 48e0 AS x, 1.2e0 - (py + 0.5e0) * 1.2e0 / 40e0 AS y FROM range(48) AS a(px), range(40) AS b(py))
    SELECT DISTINCT (p_partkey % 5)::INT AS face, px, py FROM part, t WHERE {_INSIDE}""",
)
def _(spark, d):
    """Texels of five faces under a diamond for each part."""
    from orthant.operators import texture

    u, v = F.col("p_size") / 50.0, (F.col("p_retailprice") - 900.0) / 100.0
    corner = lambda a, b: F.struct(a.alias("u"), b.alias("v"))
    uv = F.array(corner(u + 0.0613, v), corner(u, v + 0.0437), corner(u - 0.0821, v), corner(u, v - 0.0719))
    polygons = views.table(spark, d, "part").select((F.col("p_partkey") % 5).cast("int").alias("face"), uv.alias("uv"))
    rects = spark.range(5).select(F.col("id").cast("int").alias("face"), F.lit(1.01).alias("width"), F.lit(1.2).alias("height"), F.lit(48).alias("tw"), F.lit(40).alias("th"))
    return texture.texel_mask(polygons, rects)


_SPHERE = "s AS (SELECT id, x / r AS x, y / r AS y, z / r AS z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS r FROM v_emb) AS q WHERE r > 0)"


@register(
    "sampling_steps",
    f"""WITH {_SPHERE}, p AS (SELECT a.id, b.id AS other_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d, a.x AS nx, a.y AS ny, a.z AS nz, b.x AS mx, b.y AS my, b.z AS mz FROM s a JOIN s b ON a.id <> b.id),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other_id) AS rank FROM p), e AS (SELECT *, min(d) OVER (PARTITION BY id) AS scale FROM k WHERE rank <= 16), c AS (SELECT id, scale AS other_scale FROM e WHERE rank = 1),
    f AS (SELECT e.*, (mx - nx) * nx + (my - ny) * ny + (mz - nz) * nz AS off FROM e JOIN c ON e.other_id = c.id WHERE abs((mx - nx) * nx + (my - ny) * ny + (mz - nz) * nz) <= 0.5e0 * least(scale, other_scale)),
    g AS (SELECT *, mx - nx - off * nx AS tx, my - ny - off * ny AS ty, mz - nz - off * nz AS tz FROM f WHERE d > 0 AND d <= 6e0 * scale * (1 + 1e-10) AND abs(nx * mx + ny * my + nz * mz) >= 0.9063077870366499e0),
    h AS (SELECT id, arg_min(tx, rank) AS wx, arg_min(ty, rank) AS wy, arg_min(tz, rank) AS wz FROM g GROUP BY id),
    i AS (SELECT g.*, (ny * wz - nz * wy) / l AS ax, (nz * wx - nx * wz) / l AS ay, (nx * wy - ny * wx) / l AS az FROM g JOIN (SELECT *, sqrt(wx * wx + wy * wy + wz * wz) AS l FROM h) AS h USING (id)),
    j AS (SELECT id, min(abs(tx * ax + ty * ay + tz * az)) AS step FROM i WHERE abs(tx * ax + ty * ay + tz * az) >= 0.5e0 * sqrt(tx * tx + ty * ty + tz * tz) GROUP BY id)
    SELECT c.id, {R.s9('step')} AS step, {R.s9('CASE WHEN step > 1.5e0 * other_scale THEN 0.36e0 * (step * step - other_scale * other_scale) ELSE 0 END')} AS amount FROM c LEFT JOIN j USING (id)""",
    "v_emb",
)
def _(spark, d):
    """The vectors on the unit sphere, each its own normal: how far the next ones stand across the nearest direction."""
    from orthant.operators import texture
    from orthant.operators.spatial import nearest_neighbors

    length = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    cloud = views.embedding_cloud(spark, d).withColumn("length", length).where("length > 0").select("id", *[(F.col(a) / F.col("length")).alias(a) for a in "xyz"])
    edges = nearest_neighbors(cloud, cloud, 16, exclude_self=True)
    scale = edges.where("rank = 1").select("id", F.col("d").alias("scale"))
    places = cloud.join(scale, "id").withColumn("normal", F.array("x", "y", "z"))
    found = texture.sampling_steps(places, edges)
    return found.select("id", r9("step").alias("step"), r9("amount").alias("amount"))


@register(
    "hidden_faces",
    """WITH c AS (SELECT b.box_id, side, CASE WHEN side // 2 = 0 THEN CASE side % 2 WHEN 0 THEN x0 ELSE x1 END ELSE CASE WHEN (k & 1) = 0 THEN x0 ELSE x1 END END AS x,
    CASE WHEN side // 2 = 1 THEN CASE side % 2 WHEN 0 THEN y0 ELSE y1 END ELSE CASE WHEN (CASE WHEN side // 2 = 0 THEN k & 1 ELSE k >> 1 END) = 0 THEN y0 ELSE y1 END END AS y,
    CASE WHEN side // 2 = 2 THEN CASE side % 2 WHEN 0 THEN z0 ELSE z1 END ELSE CASE WHEN (k >> 1) = 0 THEN z0 ELSE z1 END END AS z FROM v_bounds b, range(6) AS s(side), range(4) AS q(k))
    SELECT DISTINCT box_id, side FROM (SELECT c.box_id, c.side::INT AS side, o.box_id AS other FROM c JOIN v_bounds o ON o.box_id < c.box_id AND c.x > o.x0 AND c.x < o.x1 AND c.y > o.y0 AND c.y < o.y1 AND c.z > o.z0 AND c.z < o.z1) AS h GROUP BY box_id, side, other HAVING count(*) = 4""",
    "v_bounds",
)
def _(spark, d):
    """Sides of the labels' bounds that lie within the bounds of a smaller label."""
    from orthant.operators import texture

    return texture.hidden_faces(mesh.flat_boxes(_label_boxes(spark, d)))


@register("outward_slabs", "SELECT box_id, side::INT AS side, CASE side // 2 WHEN 0 THEN dx <= 0.25e0 * least(dy, dz) WHEN 1 THEN dy <= 0.25e0 * least(dx, dz) ELSE dz <= 0.25e0 * least(dx, dy) END AS outward FROM v_boxes, range(6) AS t(side)", "v_boxes")
def _(spark, d):
    from orthant.operators import texture

    boxes = views.part_boxes(spark, d)
    return texture.outward_slab(S.box_faces(boxes), boxes)


def _edges_sql() -> str:
    """Every texel of a box side against every seed of the same side and of the four around it, unfolded."""
    size = {"x": "1.3e0", "y": "0.9e0", "z": "0.7e0"}
    parts = []
    for side in range(6):
        axis = "xyz"[side // 2]
        others = [c for c in "xyz" if c != axis]
        for source in range(6):
            b = "xyz"[source // 2]
            if source != side and b == axis:
                continue
            sa, sb = (1 if side % 2 else -1), (1 if source % 2 else -1)
            away = f"({size[axis]} / 2 - {sa} * s.{axis})"
            at = {c: f"s.{c}" for c in "xyz"}
            if source != side:
                at[b] = f"({sb} * ({size[b]} / 2 + {away}))"
            one, two = others
            keep = "true" if source == side else f"{away} <= 0.07e0 * (1 + 1e-12)"
            parts.append(f"SELECT t.box_id, t.side, t.px, t.py, sqrt((t.{one} - {at[one]}) * (t.{one} - {at[one]}) + (t.{two} - {at[two]}) * (t.{two} - {at[two]})) AS d FROM t JOIN s ON t.box_id = s.box_id AND t.side = {side} AND s.side = {source} WHERE {keep}")
    # u runs along the longer edge of a side, v along the other one; both from the corner with the least coordinates.
    long = {0: ("y", "z"), 1: ("x", "z"), 2: ("x", "y")}
    at = {c: [] for c in "xyz"}
    for side in range(6):
        u, v = long[side // 2]
        at["xyz"[side // 2]].append(f"WHEN {side} THEN {'' if side % 2 else '-'}{size['xyz'[side // 2]]} / 2")
        at[u].append(f"WHEN {side} THEN (px + 0.5e0) * {size[u]} / 30e0 - {size[u]} / 2")
        at[v].append(f"WHEN {side} THEN (py + 0.5e0) * {size[v]} / 20e0 - {size[v]} / 2")
    place = ", ".join(f"CASE side {' '.join(w)} END AS {c}" for c, w in at.items())
    edge = "CASE side // 2 " + " ".join(f"WHEN {k} THEN least((px + 0.5e0) * {size[u]} / 30e0, {size[u]} - (px + 0.5e0) * {size[u]} / 30e0, (py + 0.5e0) * {size[v]} / 20e0, {size[v]} - (py + 0.5e0) * {size[v]} / 20e0)" for k, (u, v) in long.items()) + " END"
    return f"""WITH c AS (SELECT DISTINCT l_linenumber AS box_id, (l_suppkey % 6)::INT AS side, (l_partkey % 30)::INT AS px, (l_orderkey % 20)::INT AS py FROM lineitem WHERE l_quantity <= 3),
    g AS (SELECT DISTINCT box_id, side::INT AS side, px::INT AS px, py::INT AS py FROM (SELECT DISTINCT l_linenumber AS box_id FROM lineitem), range(6) AS a(side), range(30) AS b(px), range(20) AS c(py)),
    s AS (SELECT box_id, side, px, py, {place} FROM c), t AS (SELECT box_id, side, px, py, {place} FROM (SELECT * FROM g ANTI JOIN c USING (box_id, side, px, py)) AS o WHERE {edge} <= 0.07e0),
    m AS ({' UNION ALL '.join(parts)})
    SELECT box_id, side, px, py, {s9('min(d)')} AS distance FROM m WHERE d <= 0.07e0 * (1 + 1e-12) GROUP BY box_id, side, px, py"""


@register("complete_edges", _edges_sql())
def _(spark, d):
    """Texels that lineitem rows colour on the sides of a box for each line number give their colour to those near the edges."""
    from orthant.operators import texture

    rows = views.table(spark, d, "lineitem")
    numbers = rows.select(F.col("l_linenumber").alias("box_id")).distinct()
    size, frame = {"dx": 1.3, "dy": 0.9, "dz": 0.7}, {f"r{i}{j}": float(i == j) for i in range(3) for j in range(3)}
    boxes = numbers.select("box_id", *[F.lit(0.0).alias("c" + a) for a in "xyz"], *[F.lit(v).alias(n) for n, v in (size | frame).items()])
    seeds = rows.where("l_quantity <= 3").select(F.col("l_linenumber").alias("box_id"), *[(F.col(c) % n).cast("int").alias(t) for c, n, t in (("l_suppkey", 6, "side"), ("l_partkey", 30, "px"), ("l_orderkey", 20, "py"))]).distinct()
    grid = numbers.select("box_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("side"))
    rects = grid.select("box_id", "side", F.lit(30).alias("tw"), F.lit(20).alias("th"))
    every = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("px")).select("*", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("py"))
    open_texels = every.join(seeds, ["box_id", "side", "px", "py"], "left_anti")
    found = texture.complete_edges(open_texels, seeds, boxes, rects, 0.07)
    return found.select("box_id", "side", "px", "py", r9("distance").alias("distance"))


def _donor_sql() -> str:
    """Every part against every texel of one face, in units of its footprint."""
    at = "(0.5e0 - {w} / 2)"
    return f"""WITH p AS (SELECT (p_size / 50e0 - {at.format(w='1.23e0')}) * (24 / 1.23e0) AS tu, ((p_partkey % 97) / 97e0 - {at.format(w='1.11e0')}) * (22 / 1.11e0) AS tv, (p_partkey % 5) * 0.004e0 - 0.01e0 AS off, 0.03e0 + 0.01e0 * (p_partkey % 3) AS s,
    CASE p_partkey % 4 WHEN 0 THEN 0.8e0 WHEN 1 THEN 0.6e0 WHEN 2 THEN 0e0 ELSE 1e0 END AS al, (p_partkey % 7) / 6e0 AS conf, sqrt(0.0009e0 * (p_partkey % 2) / 0.36e0) AS len, p_size / 50e0 AS r FROM part),
    q AS (SELECT *, greatest(s * (24 / 1.23e0), 0.75e0) AS ru, greatest(s * (22 / 1.11e0), 0.75e0) AS rv FROM p WHERE abs(off) <= 2.5e0 * 0.003e0 AND al >= 0.55e0 AND conf > 0),
    k AS (SELECT *, len * 0.6e0 * (24 / 1.23e0) / ru AS ku, len * 0.8e0 * (22 / 1.11e0) / rv AS kv FROM q), f AS (SELECT *, ru * sqrt(1 + ku * ku) AS fu, rv * sqrt(1 + kv * kv) AS fv FROM k),
    t AS (SELECT *, (px + 0.5e0 - tu) / ru AS a, (py + 0.5e0 - tv) / rv AS b FROM f, range(24) AS x(px), range(22) AS y(py) WHERE px >= ceil(tu - 4e0 * fu / 2 - 0.5e0) AND px <= floor(tu + 4e0 * fu / 2 - 0.5e0) AND py >= ceil(tv - 4e0 * fv / 2 - 0.5e0) AND py <= floor(tv + 4e0 * fv / 2 - 0.5e0)
    AND tu > -fu AND tu < 24 + fu AND tv > -fv AND tv < 22 + fv)
    SELECT px::INT AS px, py::INT AS py, count(*) AS n, {R.s9('sum(al * al * al * al * conf * exp(-(a * a + b * b - (a * ku + b * kv) * (a * ku + b * kv) / (1 + ku * ku + kv * kv)) / 2e0))')} AS w, {R.s9('min(-off)')} AS front FROM t GROUP BY px, py"""


@register("donor_texels", _donor_sql())
def _(spark, d):
    """What the parts, as points over one face, give to its texels: stretched footprints weighed by normals and confidence."""
    from orthant.operators import texture

    key = F.col("p_partkey")
    normal = F.when(key % 4 == 0, F.array(F.lit(0.6), F.lit(0.0), F.lit(0.8))).when(key % 4 == 1, F.array(F.lit(0.8), F.lit(0.0), F.lit(-0.6))).when(key % 4 == 2, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    points = views.table(spark, d, "part").select(
        key.alias("id"), (F.col("p_size") / 50.0).alias("x"), ((key % 97) / 97.0).alias("y"), ((key % 5) * 0.004).alias("z"), (F.col("p_size") / 50.0).alias("r"), F.lit(0.4).alias("g"), F.lit(0.2).alias("b"), F.lit(1.0).alias("opacity"),
        (F.lit(0.03) + (key % 3) * 0.01).alias("spacing"), normal.alias("normal"), ((key % 7) / 6.0).alias("confidence"), F.lit(0.6).alias("t0"), F.lit(0.8).alias("t1"), F.lit(0.0).alias("t2"), ((key % 2) * 0.0009).alias("amount"),
    )
    boxes = mesh.boxes_table(spark, [{"center": (0.5, 0.5, 0.0), "dimensions": (1.23, 1.11, 0.02), "rotation": _EYE}])
    rects = spark.createDataFrame([(0, 5, 0, 24, 22, True)], "box_id int, side int, face int, tw int, th int, outward boolean")
    found = texture.donor_texels(points, boxes, rects, 0.003)
    return found.groupBy("px", "py").agg(F.count("*").alias("n"), r9(F.sum("w")).alias("w"), r9(F.min("depth")).alias("front"))


_TEXELS = "SELECT (l_linenumber % 5)::INT AS face, (l_partkey % 30)::INT AS px, (l_orderkey % 20)::INT AS py, min(l_quantity) AS q FROM lineitem GROUP BY ALL"


@register("face_report", f"WITH t AS ({_TEXELS}) SELECT face, count(*) AS texels, {R.s9('avg((q <= 10)::INT)')} AS projected, {R.s9('avg((q > 10 AND q <= 25)::INT)')} AS completed, {R.s9('avg((q > 25)::INT)')} AS uncolored FROM t GROUP BY face")
def _(spark, d):
    """Lineitem rows as texels of five faces, coloured by small quantities: how far each face can be trusted."""
    from orthant.operators import texture

    rows = views.table(spark, d, "lineitem").groupBy((F.col("l_linenumber") % 5).cast("int").alias("face"), (F.col("l_partkey") % 30).cast("int").alias("px"), (F.col("l_orderkey") % 20).cast("int").alias("py")).agg(F.min("l_quantity").alias("q"))
    texels = rows.where("q <= 25").select("face", "px", "py", F.when(F.col("q") <= 10, "observed").otherwise("completed").alias("state"), F.col("q").cast("double").alias("depth"))
    found = texture.face_report(rows.select("face", "px", "py"), texels)
    return found.select("face", "texels", *[r9(c).alias(c) for c in ("projected", "completed", "uncolored")])


@register("face_polygons", f"WITH {_exposed_sql('o.box_id < b.box_id')} SELECT box_id, side, {s9('area')} AS area FROM e WHERE area > 1e-9", "v_bounds")
def _(spark, d):
    """What is drawn of each side of the labels' bounds, in the plane of the side and against the clock."""
    from orthant.operators import texture

    boxes = _label_boxes(spark, d)
    found = texture.face_polygons(mesh.exposed_polygons(boxes, earlier_only=True), S.box_faces(mesh.flat_boxes(boxes)))
    corner = lambda i: F.get("uv", i)
    n = F.size("uv")
    twice = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), lambda i: corner(i)["u"] * corner((i + 1) % n)["v"] - corner((i + 1) % n)["u"] * corner(i)["v"]), F.lit(0.0), lambda s, t: s + t)
    return found.groupBy("box_id", "side").agg(r9(F.sum(twice / 2.0)).alias("area"))


@register("texture_report")
def _(spark, d):
    """The bake of the labels' bounds from all vectors: how much of each face is drawn, observed, completed and open."""
    from orthant.plans.bake import bake_model

    boxes = [{"center": r["center"], "dimensions": r["dimensions"], "rotation": r["rotation"]} for r in _label_boxes(spark, d).orderBy("box_id").collect()]  # one a label
    shade = lambda c: (F.col(c) / 2.0 + 0.5).alias(dict(zip("xyz", "rgb"))[c])
    cloud = views.embedding_cloud(spark, d).select("id", "x", "y", "z", *[shade(c) for c in "xyz"], F.lit(1.0).alias("opacity"))
    model = bake_model(cloud, boxes, 0.02, atlas_size=256)
    rows = [(f["box"], f["side"], f["texels"], f["area"], f["projected"], f["completed"], f["uncolored"]) for f in model.report["faces"]]  # six a label
    return spark.createDataFrame(rows, "box_id int, side int, texels long, area double, projected double, completed double, uncolored double")
