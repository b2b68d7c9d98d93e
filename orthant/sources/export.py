"""Writers of fitted cuboids: OBJ, PLY mesh, GLB, PNG, HTML and JSON, whole or not at all."""

from __future__ import annotations

import base64
import colorsys
import hashlib
import json
import os
import struct
import zlib
from collections.abc import Sequence

import numpy as np

from orthant.functions.config import up_rotation
from orthant.functions.scalar import FACE_CORNERS
from orthant.operators.mesh import corners


def file_digest(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(1 << 20):
            digest.update(chunk)
    return digest.hexdigest()


def write_atomic(path: str, data: bytes) -> None:
    """Write beside the target, flush to disk, then rename."""
    with open(f"{path}.tmp", "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{path}.tmp", path)


def write_json(path: str, value) -> None:
    write_atomic(path, (json.dumps(value, allow_nan=False, indent=2) + "\n").encode())


def pack_box(box: dict) -> dict:
    return {"center": [float(v) for v in box["center"]], "dimensions": [float(v) for v in box["dimensions"]], "rotation": [[float(v) for v in r] for r in box["rotation"]], "kind": box.get("kind", "")}


def unpack_box(value: dict) -> dict:
    """A box read back; its rotation must be proper within 1e-8."""
    r = np.array(value["rotation"], float)
    if r.shape != (3, 3) or np.abs(r.T @ r - np.eye(3)).max() > 1e-8 or abs(np.linalg.det(r) - 1) > 1e-8:
        raise ValueError("a box has an improper rotation")
    return {"center": np.array(value["center"], float), "dimensions": np.array(value["dimensions"], float), "rotation": r, "kind": value.get("kind", "")}


def color(index: int) -> tuple[float, float, float]:
    return colorsys.hsv_to_rgb(index * 0.618033988749895 % 1, 0.65, 0.95)


def write_obj(folder: str, boxes: Sequence[dict], name: str = "cuboids") -> None:
    lines, material = [f"mtllib {name}.mtl"], []
    for i, box in enumerate(boxes):
        lines += [f"o cuboid_{i}", f"usemtl m{i}", *("v " + " ".join(f"{v:.17g}" for v in p) for p in corners(box))]
        lines += ["f " + " ".join(str(8 * i + k + 1) for k in (quad if side % 2 else quad)) for side, quad in enumerate(FACE_CORNERS)]
        material += [f"newmtl m{i}", "Kd " + " ".join(f"{v:.6f}" for v in color(i))]
    write_atomic(f"{folder}/{name}.obj", ("\n".join(lines) + "\n").encode())
    write_atomic(f"{folder}/{name}.mtl", ("\n".join(material) + "\n").encode())


def write_textured_obj(folder: str, boxes: Sequence[dict], polygons: dict[int, list[tuple[np.ndarray, np.ndarray]]], image: str, name: str = "textured") -> None:
    """What is drawn of each box as polygons of their own, with their places in ``image``; v runs upwards in this format."""
    lines, n = [f"mtllib {name}.mtl"], 0
    for i in range(len(boxes)):
        lines += [f"o cuboid_{i}", "usemtl atlas"]
        for p, t in polygons.get(i, []):
            lines += ["v " + " ".join(f"{v:.17g}" for v in q) for q in p]
            lines += [f"vt {u:.17g} {1 - v:.17g}" for u, v in t]
            lines.append("f " + " ".join(f"{n + k}/{n + k}" for k in range(1, len(p) + 1)))
            n += len(p)
    write_atomic(f"{folder}/{name}.obj", ("\n".join(lines) + "\n").encode())
    write_atomic(f"{folder}/{name}.mtl", f"newmtl atlas\nKd 1 1 1\nmap_Kd {image}\n".encode())


def write_mesh_ply(path: str, boxes: Sequence[dict]) -> None:
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {8 * len(boxes)}\nproperty double x\nproperty double y\nproperty double z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nelement face {6 * len(boxes)}\nproperty list uchar int vertex_indices\nend_header\n"
    body = bytearray(head.encode())
    for i, box in enumerate(boxes):
        paint = [round(255 * c) for c in color(i)]
        for p in corners(box):
            body += struct.pack("<3d3B", *p, *paint)
    for i in range(len(boxes)):
        for quad in FACE_CORNERS:
            body += struct.pack("<B4i", 4, *(8 * i + k for k in quad))
    write_atomic(path, bytes(body))


def png(pixels: np.ndarray) -> bytes:
    """An RGB image (height x width x 3 bytes) as PNG."""
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def glb(boxes: Sequence[dict], polygons: dict[int, list[tuple[np.ndarray, np.ndarray]]], image: bytes | None = None, source_up: str = "-y", units_per_meter: float = 1.0) -> bytes:
    """GLB 2.0: a node and a mesh per box; ``polygons`` gives each box's (corners, texture positions).

    Vertices are relative to the box's centre; the root node turns the source's
    up axis to +y and scales to metres, so source coordinates can be had back.
    """
    data, views, accessors, meshes, nodes = bytearray(), [], [], [], []

    def accessor(array: np.ndarray, kind: str, component: int, target: int, bounds: bool = False) -> int:
        while len(data) % 4:
            data.append(0)
        raw = array.tobytes()
        views.append({"buffer": 0, "byteOffset": len(data), "byteLength": len(raw), "target": target})
        data.extend(raw)
        item = {"bufferView": len(views) - 1, "componentType": component, "count": len(array), "type": kind}
        if bounds:
            item |= {"min": array.min(axis=0).tolist(), "max": array.max(axis=0).tolist()}
        accessors.append(item)
        return len(accessors) - 1

    for i, box in enumerate(boxes):
        parts = polygons.get(i, [])
        if not parts:
            continue
        points = np.concatenate([p - box["center"] for p, _ in parts]).astype("<f4")
        uv = np.concatenate([t for _, t in parts]).astype("<f4")
        index, base = [], 0
        for p, _ in parts:
            index += [v for k in range(1, len(p) - 1) for v in (base, base + k, base + k + 1)]
            base += len(p)
        wide = len(points) > 65535
        primitive = {
            "attributes": {"POSITION": accessor(points, "VEC3", 5126, 34962, True), "TEXCOORD_0": accessor(uv, "VEC2", 5126, 34962)},
            "indices": accessor(np.array(index, "<u4" if wide else "<u2"), "SCALAR", 5125 if wide else 5123, 34963),
            "material": 0,
        }
        meshes.append({"name": f"cuboid_{i}", "primitives": [primitive]})
        nodes.append({"name": f"cuboid_{i}", "mesh": len(meshes) - 1, "translation": [float(v) for v in box["center"]]})
    turn = np.eye(4)
    turn[:3, :3] = np.array(up_rotation(source_up)) / units_per_meter
    nodes.append({"name": "source", "children": list(range(len(nodes))), "matrix": turn.T.reshape(-1).tolist(), "extras": {"source_up": source_up, "units_per_meter": units_per_meter}})
    material: dict = {"extensions": {"KHR_materials_unlit": {}}, "pbrMetallicRoughness": {"metallicFactor": 0, "roughnessFactor": 1}, "doubleSided": True}
    doc: dict = {"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [len(nodes) - 1]}], "nodes": nodes, "extensionsUsed": ["KHR_materials_unlit"], "materials": [material]}
    if meshes:
        doc |= {"meshes": meshes}
    if image is not None:
        while len(data) % 4:
            data.append(0)
        views.append({"buffer": 0, "byteOffset": len(data), "byteLength": len(image)})
        data.extend(image)
        doc |= {"images": [{"bufferView": len(views) - 1, "mimeType": "image/png"}], "textures": [{"source": 0}]}
        material["pbrMetallicRoughness"]["baseColorTexture"] = {"index": 0}
    while len(data) % 4:
        data.append(0)
    if data:
        doc |= {"accessors": accessors, "bufferViews": views, "buffers": [{"byteLength": len(data)}]}
    text = json.dumps(doc, allow_nan=False).encode()
    text += b" " * (-len(text) % 4)
    out = struct.pack("<II", len(text), 0x4E4F534A) + text
    if data:
        out += struct.pack("<II", len(data), 0x004E4942) + bytes(data)
    return struct.pack("<III", 0x46546C67, 2, 12 + len(out)) + out


_PAGE = """<!doctype html><meta charset="utf-8"><title>Cuboids</title><style>body{margin:0;background:#181a1f}canvas{width:100vw;height:100vh}</style>
<canvas id="c"></canvas><script>
const V=new Float32Array(Uint8Array.from(atob("@V@"),c=>c.charCodeAt(0)).buffer),C=new Float32Array(Uint8Array.from(atob("@C@"),c=>c.charCodeAt(0)).buffer),ENDS=@ENDS@;
const k=document.getElementById("c"),g=k.getContext("webgl2",{antialias:true});let a=.6,b=.4,z=2.2,d=0;
const sh=(t,s)=>{const o=g.createShader(t);g.shaderSource(o,s);g.compileShader(o);return o},p=g.createProgram();
g.attachShader(p,sh(g.VERTEX_SHADER,"#version 300 es\\nin vec3 v;in vec3 c;uniform vec4 u;out vec3 o;void main(){float s=sin(u.x),q=cos(u.x),t=sin(u.y),w=cos(u.y);vec3 r=vec3(q*v.x+s*v.z,v.y,q*v.z-s*v.x);r=vec3(r.x,w*r.y-t*r.z,t*r.y+w*r.z);o=c;gl_Position=vec4(r.x/u.w,r.y,r.z*.1,u.z-r.z);}"));
g.attachShader(p,sh(g.FRAGMENT_SHADER,"#version 300 es\\nprecision highp float;in vec3 o;out vec4 f;void main(){f=vec4(o,1.);}"));g.linkProgram(p);g.useProgram(p);
[["v",V],["c",C]].forEach(([n,x])=>{const l=g.getAttribLocation(p,n);g.bindBuffer(g.ARRAY_BUFFER,g.createBuffer());g.bufferData(g.ARRAY_BUFFER,x,g.STATIC_DRAW);g.enableVertexAttribArray(l);g.vertexAttribPointer(l,3,g.FLOAT,false,0,0)});
const draw=()=>{k.width=innerWidth;k.height=innerHeight;g.viewport(0,0,k.width,k.height);g.enable(g.DEPTH_TEST);g.clearColor(.09,.1,.12,1);g.clear(g.COLOR_BUFFER_BIT|g.DEPTH_BUFFER_BIT);g.uniform4f(g.getUniformLocation(p,"u"),a,b,z,k.width/k.height);g.drawArrays(g.TRIANGLES,0,ENDS.length?ENDS[ENDS.length-1]:0)};
onpointerdown=()=>d=1;onpointerup=()=>d=0;onpointermove=e=>{if(d){a+=e.movementX*.01;b+=e.movementY*.01;draw()}};onwheel=e=>{z*=Math.exp(e.deltaY*.001);draw()};onresize=draw;draw();
</script>"""


def viewer(boxes: Sequence[dict], polygons: dict[int, list[np.ndarray]]) -> str:
    """A page that shows the boxes without a network: triangles within a unit cube, and where each box ends."""
    points, paint, ends = [], [], []
    for i in range(len(boxes)):
        for p in polygons.get(i, []):
            for k in range(1, len(p) - 1):
                points += [p[0], p[k], p[k + 1]]
                paint += [color(i)] * 3
        ends.append(len(points))
    at = np.array(points, float).reshape(-1, 3)
    if len(at):
        at = (at - (at.min(axis=0) + at.max(axis=0)) / 2) / max(np.ptp(at, axis=0).max(), 1e-300)
    encode = lambda x: base64.b64encode(np.asarray(x, "<f4").tobytes()).decode()
    return _PAGE.replace("@V@", encode(at)).replace("@C@", encode(np.array(paint).reshape(-1, 3))).replace("@ENDS@", json.dumps(ends))
