"""Camera, plane and rotation arithmetic as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[Column]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def transform(rotation: Sequence[Vector], shift: Vector, p: Vector) -> list[Column]:
    """World to camera: rotation times point plus shift."""
    return [dot(r, p) + t for r, t in zip(rotation, shift)]


def camera_centre(rotation: Sequence[Vector], shift: Vector) -> list[Column]:
    """Minus the transposed rotation times the shift."""
    return [-(rotation[0][i] * shift[0] + rotation[1][i] * shift[1] + rotation[2][i] * shift[2]) for i in range(3)]


def pixel(cam: Vector, fx: Column, fy: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    return F.try_divide(fx * cam[0], cam[2]) + cx, F.try_divide(fy * cam[1], cam[2]) + cy


def back_project(u: Column, v: Column, depth: Column, fx, fy, cx, cy) -> list[Column]:
    """Camera-space point of a pixel at a depth."""
    return [(u - cx) * depth / fx, (v - cy) * depth / fy, depth]


def quaternion_matrix(q: Sequence[Column]) -> list[list[Column]]:
    """Rotation matrix of an (x, y, z, w) quaternion, normalized first."""
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    x, y, z, w = [c / n for c in q]
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def rotation_angle(a: Sequence[Vector], b: Sequence[Vector]) -> Column:
    """Angle in degrees between two rotations: from the trace of one's transpose times the other."""
    trace = sum((a[i][j] * b[i][j] for i in range(3) for j in range(3)), F.lit(0.0))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))


def direction_angle(a: Vector, b: Vector) -> Column:
    """Angle in degrees between directions; opposite directions count as equal."""
    cosine = F.try_divide(dot(a, b), norm(a) * norm(b))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    return F.least(angle, 180 - angle)


def relative_pose(rot_a: Sequence[Vector], at_a: Vector, rot_b: Sequence[Vector], at_b: Vector) -> tuple[list[list[Column]], list[Column]]:
    """Pose b seen from pose a: the transposed rotation of a times that of b, and times the way from a to b."""
    way = [b - a for a, b in zip(at_a, at_b)]
    turned = [[sum((rot_a[k][i] * rot_b[k][j] for k in range(3)), F.lit(0.0)) for j in range(3)] for i in range(3)]
    return turned, [sum((rot_a[k][i] * way[k] for k in range(3)), F.lit(0.0)) for i in range(3)]


def plane_coordinates(p: Vector, origin: Vector, u: Vector, v: Vector, n: Vector) -> list[Column]:
    d = [a - b for a, b in zip(p, origin)]
    return [dot(d, u), dot(d, v), dot(d, n)]


def major_axis(n: Vector) -> Column:
    """0, 1 or 2: the first axis with the largest absolute component."""
    ax, ay, az = [F.abs(c) for c in n]
    return F.when((ax >= ay) & (ax >= az), 0).when(ay >= az, 1).otherwise(2)


def coarse_normal_bin(n: Vector) -> Column:
    """Signed major axis (0..5); 6 for a zero normal."""
    m = major_axis(n)
    along = F.when(m == 0, n[0]).when(m == 1, n[1]).otherwise(n[2])
    return F.when(dot(n, n) == 0, 6).otherwise(m * 2 + F.when(along < 0, 1).otherwise(0)).cast("int")


def fine_normal_bin(n: Vector, slopes: int = 4) -> Column:
    """Signed major axis times ``slopes`` x ``slopes`` slope bins."""
    m = major_axis(n)
    pick = lambda k: F.when((m + k) % 3 == 0, n[0]).when((m + k) % 3 == 1, n[1]).otherwise(n[2])
    size = F.abs(pick(0))
    slot = lambda k: F.greatest(
        F.lit(0), F.least(F.lit(slopes - 1), F.floor((pick(k) / size + 1) * (slopes / 2)))
    )
    side = F.when(pick(0) < 0, 1).otherwise(0)
    return ((2 * m + side) * slopes * slopes + slot(1) * slopes + slot(2)).cast("int")


def finite(*cols: Column) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def smallest_eigenvalue(cov: dict[str, Column]) -> Column:
    """Smallest eigenvalue of a symmetric 3x3 matrix: trigonometric root of its cubic."""
    xx, yy, zz, xy, xz, yz = (cov[k] for k in ("xx", "yy", "zz", "xy", "xz", "yz"))
    q = (xx + yy + zz) / 3
    p1 = xy * xy + xz * xz + yz * yz
    p2 = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * p1
    p = F.sqrt(p2 / 6)
    a, b, c = xx - q, yy - q, zz - q
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    r = F.coalesce(F.try_divide(det, 2 * p * p * p), F.lit(0.0))
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))) / 3
    third_turn = F.lit(2.0943951023931953)
    return q + 2 * p * F.cos(phi + third_turn)


def eigenvector_candidates(value: Column, cov: dict[str, Column]) -> Column:
    """The cross products of the rows of ``A - value * I``: the longest as (size, x, y, z)."""
    xx, yy, zz = cov["xx"] - value, cov["yy"] - value, cov["zz"] - value
    rows = [[xx, cov["xy"], cov["xz"]], [cov["xy"], yy, cov["yz"]], [cov["xz"], cov["yz"], zz]]
    sized = []
    for i, j in ((0, 1), (0, 2), (1, 2)):
        c = cross(rows[i], rows[j])
        sized.append(F.struct(dot(c, c).alias("size"), c[0].alias("x"), c[1].alias("y"), c[2].alias("z")))
    return F.greatest(*sized)


def unit_positive(v: Vector) -> list[Column]:
    """Unit vector whose dominant component is positive."""
    m = major_axis(v)
    lead = F.when(m == 0, v[0]).when(m == 1, v[1]).otherwise(v[2])
    scale = F.when(lead < 0, -1.0).otherwise(1.0) / norm(v)
    return [F.when(norm(v) > 0, c * scale) for c in v]
