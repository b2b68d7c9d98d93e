"""Row-local functions of clouds, boxes, faces and colours, as Column expressions.

Everything stays inside code generation. A cuboid is a set of columns: centre
``cx cy cz``, full extents ``dx dy dz`` and a rotation ``r00 .. r22`` whose
columns are the box axes; ``Box`` names them under a prefix.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SH_DC = 0.28209479177387814  # fixed value: the zeroth spherical harmonic
AXES = "xyz"


def finite(*columns: str) -> Column:
    """All given columns are numbers other than NaN and infinities."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in columns])


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def sh_color(f_dc: Column) -> Column:
    return 0.5 + SH_DC * f_dc


def sane_color(c: Column) -> Column:
    """NaN (and null) to 0.65, then clipped to 0..1, infinities included."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.isnan(c) | c.isNull(), 0.65).otherwise(c)))


def normalize_rgb(df: DataFrame, columns: Sequence[str] = ("red", "green", "blue")) -> DataFrame:
    """Divide by 255 unless all three columns are floating and lie within 0..1 over the whole table."""
    types = dict(df.dtypes)
    floating = all(types[c] in ("float", "double") for c in columns)
    if floating:
        clean = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)) for c in columns]
        low, high = df.agg(F.min(F.least(*clean)), F.max(F.greatest(*clean))).first()
        floating = low is None or (low >= 0 and high <= 1)
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("double") / (1.0 if floating else 255.0))
    return df


def srgb_to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)


def snapped_cell(value: Column, origin: Column | float, width: Column | float) -> Column:
    """Cell number floor((value - origin) / width); a quotient within rounding of an integer is that integer."""
    q = (value - origin) / width
    near = F.abs(q - F.rint(q)) <= 32 * 2.220446049250313e-16 * F.greatest(F.lit(1.0), F.abs(q))
    return F.when(near, F.rint(q)).otherwise(F.floor(q)).cast("long")


class Box:
    """Column expressions of one cuboid against the point ``x, y, z`` of the same row."""

    def __init__(self, prefix: str = "", point: Sequence[str] = ("x", "y", "z")):
        self.prefix, self.point = prefix, point

    def col(self, name: str) -> Column:
        return F.col(self.prefix + name)

    def local(self) -> list[Column]:
        """The point in box coordinates."""
        d = [F.col(p) - self.col("c" + a) for p, a in zip(self.point, AXES)]
        return [reduce(lambda s, t: s + t, [d[i] * self.col(f"r{i}{j}") for i in range(3)]) for j in range(3)]

    def over(self) -> list[Column]:
        return [F.abs(q) - self.col("d" + a) / 2.0 for q, a in zip(self.local(), AXES)]

    def distance(self) -> Column:
        """Distance to the box volume, 0 inside."""
        parts = [F.greatest(o, F.lit(0.0)) for o in self.over()]
        return F.sqrt(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2])

    def signed_distance(self) -> Column:
        return self.distance() + F.least(F.greatest(*self.over()), F.lit(0.0))

    def surface_distance(self) -> Column:
        return F.abs(self.signed_distance())

    def contains(self, tolerance: float = 0.0) -> Column:
        """Membership; a negative tolerance asks for the strict interior."""
        return reduce(lambda a, b: a & b, [o <= tolerance for o in self.over()])

    def half_extent(self, axis: int) -> Column:
        """Half of the axis-aligned bounding box along one world axis."""
        return reduce(lambda s, t: s + t, [F.abs(self.col(f"r{axis}{j}")) * self.col("d" + AXES[j]) / 2.0 for j in range(3)])

    def volume(self) -> Column:
        return self.col("dx") * self.col("dy") * self.col("dz")


def box_corners(boxes: DataFrame) -> DataFrame:
    """Eight rows (``box_id``, ``corner``, ``x``, ``y``, ``z``) per box; bit i of ``corner`` is the sign on axis i."""
    out = boxes.withColumn("corner", F.explode(F.sequence(F.lit(0), F.lit(7))))
    sign = [F.when(F.col("corner").bitwiseAND(F.lit(1 << j)) > 0, 0.5).otherwise(-0.5) for j in range(3)]
    at = [F.col("c" + a) + reduce(lambda s, t: s + t, [F.col(f"r{i}{j}") * F.col("d" + AXES[j]) * sign[j] for j in range(3)]) for i, a in enumerate(AXES)]
    return out.select("box_id", "corner", *[c.alias(a) for c, a in zip(at, AXES)])


#: Corner numbers of the faces, longer way round seen from outside: -x +x -y +y -z +z.
FACE_CORNERS = ((0, 4, 6, 2), (1, 3, 7, 5), (0, 1, 5, 4), (2, 6, 7, 3), (0, 2, 3, 1), (4, 5, 7, 6))


def box_faces(boxes: DataFrame) -> DataFrame:
    """Six rows per box: ``side``, ``origin``, unit ``u`` and ``v``, outward ``normal``, ``width`` >= ``height``, ``area``.

    ``u`` runs along the longer edge. Faces of no extent have zero width or height.
    """
    out = boxes.withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(5))))
    axis = F.floor(F.col("side") / 2).cast("int")
    sign = F.when(F.col("side") % 2 == 1, 1.0).otherwise(-1.0)
    pick = lambda values, index: F.element_at(F.array(*values), index + 1)
    dims = [F.col("d" + a) for a in AXES]
    first, second = (axis + 1) % 3, (axis + 2) % 3
    swap = pick(dims, second) > pick(dims, first)
    out = out.withColumn("axis", axis).withColumn("sign", sign).withColumn("ua", F.when(swap, second).otherwise(first)).withColumn("va", F.when(swap, first).otherwise(second))
    column = lambda index: F.array(*[pick([F.col(f"r{i}{j}") for j in range(3)], index) for i in range(3)])
    out = out.withColumn("u", column(F.col("ua"))).withColumn("v", column(F.col("va")))
    out = out.withColumn("normal", F.transform(column(F.col("axis")), lambda c: c * F.col("sign")))
    out = out.withColumn("width", pick(dims, F.col("ua"))).withColumn("height", pick(dims, F.col("va")))
    depth = pick(dims, F.col("axis"))
    origin = [
        F.col("c" + a) + F.col("normal")[i] * depth / 2.0 - F.col("u")[i] * F.col("width") / 2.0 - F.col("v")[i] * F.col("height") / 2.0
        for i, a in enumerate(AXES)
    ]
    return out.select("box_id", "side", F.array(*origin).alias("origin"), "u", "v", "normal", "width", "height", (F.col("width") * F.col("height")).alias("area"))


def face_uv(point: Column, face: str = "") -> list[Column]:
    """Position of a point (array of 3) in the plane of a face."""
    d = F.zip_with(point, F.col(face + "origin"), lambda p, o: p - o)
    dot = lambda axis: F.aggregate(F.zip_with(d, F.col(face + axis), lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    return [dot("u"), dot("v")]


def polygon_area(vertices: Column) -> Column:
    """Area of a planar polygon: an array of structs ``u``, ``v``."""
    n = F.size(vertices)
    cross = F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.get(vertices, i)["u"] * F.get(vertices, (i + 1) % n)["v"] - F.get(vertices, (i + 1) % n)["u"] * F.get(vertices, i)["v"]
    )
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, t: s + t)) / 2.0


def segment_distance_squared(p: Sequence[Column], a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Squared distance from a point to a segment, which may have no length."""
    dot = lambda s, t: s[0] * t[0] + s[1] * t[1] + s[2] * t[2]
    ab, ap = [y - x for x, y in zip(a, b)], [x - y for x, y in zip(p, a)]
    length = dot(ab, ab)
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(ap, ab) / F.when(length > 0, length)))).otherwise(0.0)
    gap = [x - t * y for x, y in zip(ap, ab)]
    return dot(gap, gap)


def triangle_distance_squared(p: Sequence[Column], a: Sequence[Column], b: Sequence[Column], c: Sequence[Column]) -> Column:
    """Squared distance from a point to a triangle: its plane if the foot lies inside, else the nearest edge."""
    dot = lambda s, t: s[0] * t[0] + s[1] * t[1] + s[2] * t[2]
    minus = lambda s, t: [x - y for x, y in zip(s, t)]
    ab, ac, ap = minus(b, a), minus(c, a), minus(p, a)
    n = [ab[1] * ac[2] - ab[2] * ac[1], ab[2] * ac[0] - ab[0] * ac[2], ab[0] * ac[1] - ab[1] * ac[0]]
    nn = dot(n, n)
    d00, d01, d11, d20, d21 = dot(ab, ab), dot(ab, ac), dot(ac, ac), dot(ap, ab), dot(ap, ac)
    v, w = d11 * d20 - d01 * d21, d00 * d21 - d01 * d20  # both scaled by nn
    inside = (nn > 0) & (v >= 0) & (w >= 0) & (v + w <= nn)
    height = dot(ap, n)
    edges = F.least(segment_distance_squared(p, a, b), segment_distance_squared(p, b, c), segment_distance_squared(p, c, a))
    return F.when(inside, height * height / F.when(nn > 0, nn)).otherwise(edges)


def normal_angle(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Angle between two unit normals without regard to sign, in degrees."""
    return F.degrees(F.acos(F.least(F.abs(a[0] * b[0] + a[1] * b[1] + a[2] * b[2]), F.lit(1.0))))


def exterior_cost(volume: Column, reference: Column | float, exterior: Column, penalty: float = 2.0) -> Column:
    return 1.0 + penalty * exterior * volume / reference


def evaluation_tolerance(spacing: float, extent: float, detail: float = 2.0, explicit: float | None = None) -> float:
    return explicit if explicit is not None else detail * max(spacing, 64 * 2.220446049250313e-16 * extent)


def support_status(lower: Column, upper: Column, target: float) -> Column:
    """reached, not_reached or inconclusive; an unknown bound is 0 or 1."""
    low, high = F.coalesce(lower, F.lit(0.0)), F.coalesce(upper, F.lit(1.0))
    return F.when(low >= target, "reached").when(high < target, "not_reached").otherwise("inconclusive")


def palette(label: Column) -> list[Column]:
    """A colour per label by golden-ratio hues; negative labels are grey-blue."""
    hue = (label * 0.618033988749895) % 1.0
    s, v = 0.65, 0.95
    channel = lambda k: v - v * s * F.greatest(F.lit(0.0), F.least((k + hue * 6.0) % 6.0, 4.0 - (k + hue * 6.0) % 6.0, F.lit(1.0)))
    return [F.when(label < 0, rest).otherwise(channel(k)) for k, rest in ((5.0, 0.61), (3.0, 0.64), (1.0, 0.68))]


def quaternion_rotation(w: Column, x: Column, y: Column, z: Column) -> list[list[Column]]:
    """Rotation matrix of a quaternion of any length other than 0."""
    n = F.sqrt(w * w + x * x + y * y + z * z)
    w, x, y, z = w / n, x / n, y / n, z / n
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def splat_radii(rotation: list[list[Column]], scales: Sequence[Column], sigma: float) -> list[Column]:
    """Half extents of the bounding box of a Gaussian splat's ellipsoid."""
    return [sigma * F.sqrt(reduce(lambda a, b: a + b, [rotation[i][j] * rotation[i][j] * scales[j] * scales[j] for j in range(3)])) for i in range(3)]


def frames_equivalent(left: str, right: str, cosine: float) -> Column:
    """Two frames (arrays of 3 axes) agree up to order and sign of their axes."""
    dot = lambda a, b: F.abs(F.aggregate(F.zip_with(a, b, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t))
    return F.forall(left, lambda a: F.exists(right, lambda b: dot(a, b) >= cosine))
