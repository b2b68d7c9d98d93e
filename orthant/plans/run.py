"""Command line: PLY cloud in, certified cuboids, report, texture and exports out.

Exit codes: 0 all gates hold, 3 a partial result, 2 an error.
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import os
import sys
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthant import __version__
from orthant.functions.config import FitSettings
from orthant.operators import mesh, normals
from orthant.plans.bake import bake_model
from orthant.plans.fit import CoverageNotReachedError, Fit, fit_cuboids, gates
from orthant.sources import export
from orthant.sources.ply import clean_cloud, read_ply
from orthant.storage import materialize

#: Settings that a resumed run may change.
RUNTIME = ("max_cuboids", "target_coverage", "target_surface_support", "target_component_coverage")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="orthant", description="Cover a coloured point cloud with certified cuboids.")
    p.add_argument("--ply", required=True, help="input cloud")
    p.add_argument("--output", required=True, help="new folder for all results")
    p.add_argument("--resume", help="folder of an earlier run whose cuboids are kept and continued")
    p.add_argument("--rebake", help="folder of an earlier run whose cuboids are exported again")
    p.add_argument("--min-opacity", type=float, default=0.1)
    p.add_argument("--outlier-distance-factor", type=float, default=50.0)
    p.add_argument("--atlas-size", type=int, default=512)
    p.add_argument("--source-up", default="-y")
    p.add_argument("--units-per-meter", type=float, default=1.0)
    p.add_argument("--no-texture", action="store_true")
    p.add_argument("--diagnostics", action="store_true", help="also write normals, edge scores, regions and edge lines as Parquet")
    for f in dataclasses.fields(FitSettings):
        kind = float if f.name == "tolerance" else type(f.default)
        p.add_argument("--" + f.name.replace("_", "-"), type=kind, default=f.default)
    return p


def session() -> SparkSession:
    return (
        SparkSession.builder.appName("orthant")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", os.environ.get("ORTHANT_PARTITIONS", "64"))
        .getOrCreate()
    )


class Checkpoint:
    """Committed cuboids in two slots used in turn; the manifest names the whole one and its digest."""

    def __init__(self, folder: str, signature: dict):
        self.folder, self.signature, self.slot = folder, signature, 0

    def save(self, boxes: list[dict]) -> None:
        name = f"state-{self.slot}.json"
        self.slot = 1 - self.slot
        export.write_json(f"{self.folder}/{name}", {"boxes": [export.pack_box(b) for b in boxes]})
        export.write_json(
            f"{self.folder}/checkpoint.json",
            {"format_version": 1, "signature": self.signature, "state": name, "sha256": export.file_digest(f"{self.folder}/{name}"), "cuboids": len(boxes)},
        )


def read_checkpoint(folder: str, signature: dict | None) -> list[dict]:
    """Cuboids of an earlier run; ``signature`` None skips the check of settings (rebake)."""
    with open(f"{folder}/checkpoint.json") as f:
        manifest = json.load(f)
    if manifest.get("format_version") != 1:
        raise ValueError("unknown checkpoint version")
    name = manifest["state"]
    if os.path.basename(name) != name:
        raise ValueError("the checkpoint points outside its folder")
    if export.file_digest(f"{folder}/{name}") != manifest["sha256"]:
        raise ValueError("the checkpoint was changed")
    if signature is not None and manifest["signature"] != signature:
        raise ValueError("the checkpoint is of another input or other settings")
    with open(f"{folder}/{name}") as f:
        return [export.unpack_box(b) for b in json.load(f)["boxes"]]


def _signature(digest: str, settings: FitSettings, args: argparse.Namespace) -> dict:
    kept = {k: v for k, v in dataclasses.asdict(settings).items() if k not in RUNTIME}
    return {"input_sha256": digest, "engine": __version__, "min_opacity": args.min_opacity, "outlier": args.outlier_distance_factor, **kept}


def write_results(folder: str, cloud: DataFrame, boxes: list[dict], tolerance: float, args: argparse.Namespace) -> dict:
    """Boxes as Parquet, meshes, and unless switched off the atlas with its twin and report, textured OBJ, GLB and viewer."""
    export.write_obj(folder, boxes)
    export.write_mesh_ply(f"{folder}/cuboids.ply", boxes)
    mesh.boxes_table(cloud.sparkSession, boxes).coalesce(1).write.parquet(f"{folder}/boxes.parquet")
    if args.no_texture or not boxes:
        return {"textured": False}
    model = bake_model(cloud, boxes, tolerance, atlas_size=args.atlas_size)
    picture = export.png(model.image())
    export.write_atomic(f"{folder}/atlas.png", picture)
    export.write_atomic(f"{folder}/confidence.png", export.png(model.confidence()))
    export.write_json(f"{folder}/texture_report.json", model.report)
    drawn: dict[int, list] = {}
    for f in model.faces:
        drawn.setdefault(f.box, []).extend((f.in_space(p), f.in_atlas(p, args.atlas_size)) for p in f.parts)
    export.write_textured_obj(folder, boxes, drawn, "atlas.png")
    export.write_atomic(f"{folder}/cuboids.glb", export.glb(boxes, drawn, picture, args.source_up, args.units_per_meter))
    export.write_atomic(f"{folder}/viewer.html", export.viewer(boxes, {k: [p for p, _ in v] for k, v in drawn.items()}).encode())
    return {"textured": True, "texture_support": model.report["supported_area_fraction"], "completed": model.report["completed_area_fraction"], "uncolored": model.report["uncolored_area_fraction"], "faces": len(model.faces)}


def population(cloud: DataFrame) -> dict:
    """Number of retained points and the sum of their hashes, whatever their order."""
    row = cloud.agg(F.count("*").alias("n"), F.sum(F.xxhash64("id", "x", "y", "z").cast("decimal(20,0)")).alias("hashes")).first()
    return {"points": row["n"], "hashes": str(row["hashes"] or 0)}


def write_diagnostics(folder: str, cloud: DataFrame) -> None:
    """Parquet tables of what the segmentation saw: ``positions`` (normal, edge score, region) and ``edge_lines``."""
    places, edges = normals.neighbourhoods(cloud)
    shape = materialize(normals.local_geometry(places, edges), "shape")
    scores = materialize(normals.edge_scores(shape, edges), "scores")
    scored = places.select("id", "x", "y", "z").join(shape.select("id", "normal", "spacing", "valid"), "id").join(scores, "id", "left")
    spacing = shape.agg(F.median("spacing")).first()[0] or 0.0
    edge_places = scored.where(F.col("score") >= 60.0).select("id", "x", "y", "z", "score")
    lines, _ = normals.edge_lines(edge_places, 1.5 * spacing)
    lines = materialize(lines, "lines")
    regions = normals.segment_surfaces(places, shape, edges, barriers=lines)
    scored.join(regions.select("id", "region"), "id").write.parquet(f"{folder}/diagnostics/positions")
    lines.write.parquet(f"{folder}/diagnostics/edge_lines")


class Log:
    """What a run prints, kept in its folder as well."""

    def __init__(self, folder: str):
        self.path = f"{folder}/run.log"

    def __call__(self, text: str) -> None:
        print(text, flush=True)
        with open(self.path, "a") as f:
            f.write(text + "\n")


def run(args: argparse.Namespace, spark: SparkSession | None = None) -> int:
    if args.resume and args.rebake:
        raise ValueError("--resume and --rebake exclude each other")
    if os.path.exists(args.output):
        raise ValueError(f"{args.output} exists already")
    settings = FitSettings(**{f.name: getattr(args, f.name) for f in dataclasses.fields(FitSettings)})
    spark = spark or session()
    digest = export.file_digest(args.ply)
    signature = _signature(digest, settings, args)
    began = time.time()
    cloud = clean_cloud(read_ply(spark, args.ply), args.min_opacity, args.outlier_distance_factor)
    report: dict = {"engine": __version__, "started_utc": datetime.now(timezone.utc).isoformat(), "settings": dataclasses.asdict(settings), "input_sha256": digest, "population": population(cloud)}
    code = 0

    def same_points(folder: str) -> dict:
        """An earlier run's report, if its cuboids were fitted to the points that are retained now."""
        with open(f"{folder}/report.json") as f:
            old = json.load(f)
        if old["input_sha256"] != digest:
            raise ValueError("the cloud is not the one that the cuboids were fitted to")
        if old.get("population", report["population"]) != report["population"]:
            raise ValueError("the retained points are not those that the cuboids were fitted to")
        return old

    if args.rebake:
        boxes = read_checkpoint(args.rebake, None)
        old = same_points(args.rebake)
        os.makedirs(args.output)
        report |= {k: old[k] for k in ("settings", "stopping_reason", "gates", "curve", "tolerance")} | {"rebaked": True}
        code = 0 if old["gates"]["target_reached"] else 3
        tolerance = old["tolerance"]
        Checkpoint(args.output, signature).save(boxes)
    else:
        committed = read_checkpoint(args.resume, signature) if args.resume else []
        if args.resume and os.path.exists(f"{args.resume}/report.json"):
            same_points(args.resume)
        if len(committed) > settings.max_cuboids:
            raise ValueError("the kept cuboids exceed --max-cuboids")
        os.makedirs(args.output)
        slots = Checkpoint(args.output, signature)
        slots.save(committed)
        try:
            fit: Fit = fit_cuboids(cloud, settings, committed=committed, on_commit=slots.save, progress=Log(args.output))
        except CoverageNotReachedError as error:
            export.write_json(f"{args.output}/report.json", report | {"stopping_reason": str(error), "gates": {"target_reached": False}, "curve": [], "tolerance": 0.0})
            return 3
        boxes, tolerance = committed + fit.boxes[len(committed) :], fit.tolerance
        found = gates(fit, settings)
        reason = fit.reason
        if reason == "target_reached" and not found["target_reached"]:
            reason = "surface_quality_not_reached" if found["minimum_component_coverage"] >= settings.target_component_coverage else "component_quality_not_reached"
        report |= {"stopping_reason": reason, "gates": found, "curve": fit.curve, "tolerance": tolerance}
        code = 0 if found["target_reached"] else 3
    report["cuboids"] = [export.pack_box(b) for b in boxes]
    report["texture"] = write_results(args.output, cloud, boxes, tolerance, args)
    if args.diagnostics:
        write_diagnostics(args.output, cloud)
    if export.file_digest(args.ply) != digest:
        raise ValueError("the input changed during the run")
    report["seconds"] = time.time() - began
    export.write_json(f"{args.output}/report.json", report)
    return code


def main(argv: list[str] | None = None) -> int:
    try:
        return run(parser().parse_args(argv))
    except (ValueError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
