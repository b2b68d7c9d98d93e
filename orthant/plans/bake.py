"""Texture of a whole model: observed colours, short ways over edges, and what each face can be trusted for.

Texels are rows until the atlas is written: points meet texels in joins, the
mask of what is drawn, the completion over edges and the report are joins and
aggregates. The driver keeps the committed boxes' faces and the atlas, both
bounded by settings.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthant.functions.scalar import box_faces
from orthant.operators import mesh, normals, texture
from orthant.operators.spatial import nearest_spacing
from orthant.storage import materialize, release

#: Tolerances within which a point colours a face, and a texel another one over an edge.
DEPTH_FACTOR = 2.5
#: Texels around each face that repeat its border.
PAD = 4


@dataclass
class Face:
    """A side of a box as it is drawn: where it lies in the atlas, and its parts in the plane of the face."""

    box: int
    side: int
    hidden: bool
    outward: bool
    origin: np.ndarray
    u: np.ndarray
    v: np.ndarray
    width: float
    height: float
    rect: tuple[int, int, int, int]
    parts: list[np.ndarray]  # corners (n x 2) in the plane, against the clock

    def in_space(self, part: np.ndarray) -> np.ndarray:
        return self.origin + part[:, :1] * self.u + part[:, 1:] * self.v

    def in_atlas(self, part: np.ndarray, atlas: int) -> np.ndarray:
        x, y, w, h = self.rect
        return np.stack(((x + part[:, 0] / self.width * w) / atlas, (y + part[:, 1] / self.height * h) / atlas), axis=1)


@dataclass
class Bake:
    """A baked model: ``texels`` (``face, px, py, r, g, b, state, depth``), ``visible`` ones, faces and their report."""

    faces: list[Face]
    texels: DataFrame
    visible: DataFrame
    report: dict
    atlas: int

    def image(self, fill: int = 3) -> np.ndarray:
        """The atlas; texels without a colour take a mean of their neighbours, then grey."""
        return texture.atlas_image(self.texels, [f.rect for f in self.faces], self.atlas, fill, PAD)[0]

    def confidence(self) -> np.ndarray:
        """The atlas's twin: observed texels green, all others of a face orange."""
        seen = self.texels.where("state = 'observed'").select("face", "px", "py", F.lit(51 / 255).alias("r"), F.lit(188 / 255).alias("g"), F.lit(147 / 255).alias("b"))
        rows = self.report["faces"]
        rects = self.texels.sparkSession.createDataFrame([(i, *f.rect[2:]) for i, f in enumerate(self.faces)], "face int, tw int, th int") if rows else None
        if rects is None:
            return texture.atlas_image(seen, [], self.atlas, 0, PAD)[0]
        rest = _grid(rects).join(seen.select("face", "px", "py"), ["face", "px", "py"], "left_anti")
        rest = rest.select("face", "px", "py", F.lit(240 / 255).alias("r"), F.lit(145 / 255).alias("g"), F.lit(62 / 255).alias("b"))
        return texture.atlas_image(seen.unionByName(rest), [f.rect for f in self.faces], self.atlas, 0, PAD)[0]


def _grid(rects: DataFrame) -> DataFrame:
    """All texels of rectangles ``tw, th``."""
    rows = rects.withColumn("px", F.explode(F.sequence(F.lit(0), F.col("tw") - 1)))
    return rows.withColumn("py", F.explode(F.sequence(F.lit(0), F.col("th") - 1))).drop("tw", "th")


def donors(cloud: DataFrame) -> DataFrame:
    """``cloud`` (``id x y z r g b opacity``) with ``spacing``, ``normal``, ``confidence`` and the steps of its sampling.

    Positions that repeat share these. A position without a valid normal has
    confidence 0 and colours nothing, unless no position has one: then normals
    do not count.
    """
    own = materialize(nearest_spacing(cloud).where("spacing > 0"), "donors")
    places, edges = normals.neighbourhoods(own)
    shape = materialize(normals.local_geometry(places, edges).where("valid").select("id", "normal", F.col("spacing").alias("scale")), "shape")
    base = own.select("id", "x", "y", "z", "r", "g", "b", "opacity", "spacing")
    if not shape.take(1):
        return base
    known = places.join(shape, "id")
    steps = texture.sampling_steps(known, edges.join(shape.select("id"), "id", "left_semi"))
    given = known.select("id", "normal").join(steps.drop("step"), "id").join(places, "id").select(*[(F.col(a) + 0.0).alias("p" + a) for a in "xyz"], "normal", "t0", "t1", "t2", "amount")
    same = [F.col(a) + 0.0 == F.col("p" + a) for a in "xyz"]
    return base.join(given, same[0] & same[1] & same[2]).drop("px", "py", "pz").withColumn("confidence", F.lit(1.0))


def bake_model(cloud: DataFrame, boxes: list[dict], tolerance: float, *, atlas_size: int = 2048) -> Bake:
    """Colours of all faces of ``boxes`` (in commit order) from a coloured cloud (``id x y z r g b opacity``).

    Faces within an earlier box are hidden and take no texels. A face is drawn
    where no earlier box owns the place. Observed colours come from points
    within ``DEPTH_FACTOR`` tolerances; texels near an edge without one take
    the nearest observed colour over the surface of their own box, as far away
    at most. Only observed texels count as support.
    """
    if not boxes:
        raise ValueError("a model without boxes has no texture")
    spark = cloud.sparkSession
    table = mesh.boxes_table(spark, boxes)
    flat = mesh.flat_boxes(table)
    sides = box_faces(flat).where((F.col("width") > 0) & (F.col("height") > 0))
    thin = texture.outward_slab(sides, flat)
    drawn = texture.face_polygons(mesh.exposed_polygons(table, earlier_only=True), sides)
    drawn = materialize(drawn.select("box_id", "side", "part", "uv", "area"), "drawn")
    shown = sides.join(drawn.groupBy("box_id", "side").agg(F.sum("area").alias("drawn")), ["box_id", "side"], "left")
    shown = shown.join(thin, ["box_id", "side"]).join(texture.hidden_faces(flat).withColumn("inside", F.lit(True)), ["box_id", "side"], "left")
    rows = shown.orderBy("box_id", "side").collect()  # six a committed box
    parts: dict[tuple[int, int], list[np.ndarray]] = {}
    for r in drawn.orderBy("box_id", "side", "part").collect():
        parts.setdefault((r["box_id"], r["side"]), []).append(np.array([(p["u"], p["v"]) for p in r["uv"]]))
    seen = [r for r in rows if r["drawn"] is not None and not r["inside"]]
    rects = texture.pack_atlas([(r["width"], r["height"]) for r in seen], atlas_size, PAD)
    faces = [Face(r["box_id"], r["side"], False, r["outward"], np.array(r["origin"]), np.array(r["u"]), np.array(r["v"]), r["width"], r["height"], rect, parts[r["box_id"], r["side"]]) for r, rect in zip(seen, rects)]
    if not faces:
        raise ValueError("no face of the model is to be seen")
    plan = [(f.box, f.side, i, f.rect[2], f.rect[3], f.width, f.height, bool(f.outward)) for i, f in enumerate(faces)]
    plan = materialize(spark.createDataFrame(plan, "box_id int, side int, face int, tw int, th int, width double, height double, outward boolean"), "faces")
    rect_table = plan.select("box_id", "side", "face", "tw", "th", "outward")

    given = materialize(donors(cloud), "donors")
    observed = materialize(texture.bake(given, table, rect_table, tolerance), "observed")
    keyed = observed.join(F.broadcast(plan.select("face", "box_id", "side")), "face")
    open_texels = _grid(plan.select("box_id", "side", "face", "tw", "th")).join(observed, ["face", "px", "py"], "left_anti")
    found = texture.complete_edges(open_texels, keyed.select("box_id", "side", "px", "py"), flat, rect_table.select("box_id", "side", "tw", "th"), DEPTH_FACTOR * tolerance)
    source = keyed.select("box_id", *[F.col(c).alias("from_" + c) for c in ("side", "px", "py")], "r", "g", "b")
    found = found.join(source, ["box_id", "from_side", "from_px", "from_py"]).join(F.broadcast(plan.select("box_id", "side", "face")), ["box_id", "side"])
    texels = observed.select("face", "px", "py", "r", "g", "b", F.lit("observed").alias("state"), "depth")
    texels = materialize(texels.unionByName(found.select("face", "px", "py", "r", "g", "b", F.lit("completed").alias("state"), F.lit(None).cast("double").alias("depth"))), "texels")
    release(observed)

    # Rows of texels run along v; the mask takes v from the top, so polygons are turned over first.
    turned = drawn.join(F.broadcast(plan), ["box_id", "side"])
    turned = turned.select("face", F.reverse(F.transform("uv", lambda p: F.struct(p["u"].alias("u"), (F.col("height") - p["v"]).alias("v")))).alias("uv"))
    visible = materialize(texture.texel_mask(turned, F.broadcast(plan.select("face", "width", "height", "tw", "th"))), "visible")
    told = {r["face"]: r for r in texture.face_report(visible, texels).collect()}  # one row a face
    return Bake(faces, texels, visible, _report(rows, faces, told, tolerance, atlas_size), atlas_size)


def _report(rows: list, faces: list[Face], told: dict, tolerance: float, atlas: int) -> dict:
    area = {(r["box_id"], r["side"]): r["drawn"] or 0.0 for r in rows}
    details = []
    for i, f in enumerate(faces):
        r = told.get(i)
        shares = {k: r[k] if r else 0.0 for k in ("projected", "completed", "uncolored")}
        details.append({"box": f.box, "side": f.side, "rect": list(f.rect), "area": area[f.box, f.side], "whole_area": f.width * f.height, "outward": bool(f.outward), "texels": r["texels"] if r else 0, **shares, "median_depth": r["depth"] if r else None})
    total = sum(d["area"] for d in details)
    mean = lambda k: sum(d["area"] * d[k] for d in details) / total if total else 0.0
    return {
        "atlas_size": atlas,
        "faces": details,
        "hidden_faces": len(rows) - len(faces),
        "triangles": sum(len(p) - 2 for f in faces for p in f.parts),
        "texels_per_unit": max((f.rect[2] / f.width for f in faces), default=0.0),
        "depth_limit": DEPTH_FACTOR * tolerance,
        "supported_area_fraction": mean("projected"),
        "completed_area_fraction": mean("completed"),
        "uncolored_area_fraction": mean("uncolored"),
    }
