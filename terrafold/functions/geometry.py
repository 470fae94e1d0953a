"""Rigid-body and projective geometry as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str = "", names: str = "xyz") -> Vec:
    return tuple(F.col(prefix + n) for n in names)  # type: ignore[return-value]


def rot_x(v: Vec, a: Column) -> Vec:
    x, y, z = v
    return x, F.cos(a) * y - F.sin(a) * z, F.sin(a) * y + F.cos(a) * z


def rot_y(v: Vec, a: Column) -> Vec:
    x, y, z = v
    return F.cos(a) * x + F.sin(a) * z, y, F.cos(a) * z - F.sin(a) * x


def rot_z(v: Vec, a: Column) -> Vec:
    x, y, z = v
    return F.cos(a) * x - F.sin(a) * y, F.sin(a) * x + F.cos(a) * y, z


def rotate_zxy(v: Vec, rz: Column, rx: Column, ry: Column) -> Vec:
    return rot_y(rot_x(rot_z(v, rz), rx), ry)


def rotate_yxz(v: Vec, ry: Column, rx: Column, rz: Column) -> Vec:
    return rot_z(rot_x(rot_y(v, ry), rx), rz)


def to_map(v: Vec, pose: str = "") -> Vec:
    """Sensor frame to map frame."""
    r, t = vec(pose + "r"), vec(pose + "t")
    return tuple(a + b for a, b in zip(rotate_zxy(v, r[2], r[0], r[1]), t, strict=True))  # type: ignore[return-value]


def to_local(v: Vec, pose: str = "") -> Vec:
    """Map frame to sensor frame, the inverse of :func:`to_map`."""
    r, t = vec(pose + "r"), vec(pose + "t")
    return rotate_yxz(tuple(a - b for a, b in zip(v, t, strict=True)), -r[1], -r[0], -r[2])  # type: ignore[arg-type]


def to_start(v: Vec, s: Column, pose: str = "") -> Vec:
    """Undo the sensor's motion up to share ``s`` of the sweep; ``s`` = 1: from the sweep's end."""
    r, t = vec(pose + "r"), vec(pose + "t")
    return rotate_zxy(tuple(a - s * b for a, b in zip(v, t, strict=True)), -s * r[2], -s * r[0], -s * r[1])  # type: ignore[arg-type]


def to_end(v: Vec, s: Column, pose: str = "") -> Vec:
    """Motion-correct to the sweep's end."""
    r, t = vec(pose + "r"), vec(pose + "t")
    return tuple(a + b for a, b in zip(rotate_yxz(to_start(v, s, pose), r[1], r[0], r[2]), t, strict=True))  # type: ignore[return-value]


def to_time(v: Vec, s: Column, at: Column, pose: str = "") -> Vec:
    """Motion-correct to share ``at`` of the sweep: to its start, then forward by that share."""
    r, t = vec(pose + "r"), vec(pose + "t")
    moved = rotate_yxz(to_start(v, s, pose), at * r[1], at * r[0], at * r[2])
    return tuple(a + at * b for a, b in zip(moved, t, strict=True))  # type: ignore[return-value]


def swap_axes(v: Vec) -> Vec:
    """Sensor axes to pipeline axes."""
    return v[1], v[2], v[0]


def unswap_axes(v: Vec) -> Vec:
    return v[2], v[0], v[1]


def project(v: Vec, p: Sequence[float | Column]) -> Vec:
    """``u, v, w`` of a point under a 3 x 4 matrix in row-major order."""
    row = lambda k: sum((F.lit(c) if isinstance(c, float) else c) * x for c, x in zip(p[k : k + 3], v, strict=True)) + p[k + 3]
    w = row(8)
    return F.try_divide(row(0), w), F.try_divide(row(4), w), w


def pixel(x: Column) -> Column:
    """``int(x + 0.5)``: towards zero; null where that is no integer (a point beside the camera's plane), so it is in no image."""
    return (x + 0.5).try_cast("int")


def in_image(u: Column, v: Column, w: Column, width: int, height: int, front: bool = True) -> Column:
    inside = (u >= 0) & (u < width) & (v >= 0) & (v < height)
    return inside & (w > 0) if front else inside


def back_project(u: Column, v: Column, depth: Column, k_inv: np.ndarray, r_inv: np.ndarray, t: Sequence[float]) -> Vec:
    """``R^-1 (K^-1 [u d, v d, d] - T)``"""
    ray = (u * depth, v * depth, depth)
    cam = [sum(F.lit(float(c)) * x for c, x in zip(row, ray, strict=True)) - float(o) for row, o in zip(k_inv, t, strict=True)]
    return tuple(sum(F.lit(float(c)) * x for c, x in zip(row, cam, strict=True)) for row in r_inv)  # type: ignore[return-value]


def euler_to_matrix(rx: Column, ry: Column, rz: Column) -> list[Column]:
    """Row-major Rz Ry Rx."""
    cx, sx, cy, sy, cz, sz = F.cos(rx), F.sin(rx), F.cos(ry), F.sin(ry), F.cos(rz), F.sin(rz)
    return [cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx, sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx, -sy, cy * sx, cy * cx]


def matrix_to_euler(m: Sequence[Column]) -> Vec:
    """Angles of a row-major rotation; near gimbal lock (``sy < 1e-6``) z is 0."""
    sy = F.sqrt(m[0] * m[0] + m[3] * m[3])
    lock = sy < 1e-6
    return F.when(lock, F.atan2(-m[5], m[4])).otherwise(F.atan2(m[7], m[8])), F.atan2(-m[6], sy), F.when(lock, 0.0).otherwise(F.atan2(m[3], m[0]))


def quaternion_to_rpy(qx: Column, qy: Column, qz: Column, qw: Column) -> Vec:
    roll = F.atan2(2 * (qw * qx + qy * qz), 1 - 2 * (qx * qx + qy * qy))
    pitch = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (qw * qy - qz * qx))))
    return roll, pitch, F.atan2(2 * (qw * qz + qx * qy), 1 - 2 * (qy * qy + qz * qz))


def rpy_to_quaternion(roll: Column, pitch: Column, yaw: Column) -> tuple[Column, Column, Column, Column]:
    cr, sr, cp, sp, cy, sy = F.cos(roll / 2), F.sin(roll / 2), F.cos(pitch / 2), F.sin(pitch / 2), F.cos(yaw / 2), F.sin(yaw / 2)
    return sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy, cr * cp * cy + sr * sp * sy


def without_gravity(ax: Column, ay: Column, az: Column, roll: Column, pitch: Column, g: float = 9.81) -> Vec:
    """Acceleration in pipeline axes without gravity."""
    return ay - F.sin(roll) * F.cos(pitch) * g, az - F.cos(roll) * F.cos(pitch) * g, ax + F.sin(pitch) * g


def rotation_entries(rx: Column, ry: Column, rz: Column) -> list[Column]:
    """Row-major Ry Rx Rz, the rotation of :func:`to_map`."""
    cx, sx, cy, sy, cz, sz = F.cos(rx), F.sin(rx), F.cos(ry), F.sin(ry), F.cos(rz), F.sin(rz)
    return [cy * cz + sy * sx * sz, sy * sx * cz - cy * sz, sy * cx, cx * sz, cx * cz, -sx, cy * sx * sz - sy * cz, sy * sz + cy * sx * cz, cy * cx]


def with_entries(poses: DataFrame) -> DataFrame:
    """Poses with the nine entries ``m0 … m8`` of their rotation, so that pairs of them multiply numbers and no angles."""
    return poses.select("*", *(e.alias(f"m{k}") for k, e in enumerate(rotation_entries(*vec("r")))))


def pair_projection(k: np.ndarray, extrinsic: np.ndarray, from_pose: str = "", to_pose: str = "b_") -> list[Column]:
    """:func:`projection_matrix` as 12 columns, row-major, of two poses from :func:`with_entries`."""
    m, n = ([F.col(f"{p}m{i}") for i in range(9)] for p in (from_pose, to_pose))
    apart = [F.col(f"{from_pose}t{c}") - F.col(f"{to_pose}t{c}") for c in "xyz"]

    def moved(i: int, j: int) -> Column:
        """Entry of the inverse of the second pose times the first; column 3: the shift."""
        return sum((n[3 * r + i] * (m[3 * r + j] if j < 3 else apart[r]) for r in range(1, 3)), n[i] * (m[j] if j < 3 else apart[0]))

    # pipeline axes to sensor axes on both sides
    turned = [[moved((i + 2) % 3, (j + 2) % 3 if j < 3 else 3) for j in range(4)] for i in range(3)]
    camera = np.asarray(k, float) @ extrinsic
    return [sum((float(c) * turned[i][j] for i, c in enumerate(row[:3]) if c), F.lit(float(row[3]) if j == 3 else 0.0)) for row in camera for j in range(4)]


def rot_matrix(axis: str, a: float) -> np.ndarray:
    c, s = math.cos(a), math.sin(a)
    return np.array({"x": [[1, 0, 0], [0, c, -s], [0, s, c]], "y": [[c, 0, s], [0, 1, 0], [-s, 0, c]], "z": [[c, -s, 0], [s, c, 0], [0, 0, 1]]}[axis])


def pose_matrix(rx: float, ry: float, rz: float, tx: float, ty: float, tz: float) -> np.ndarray:
    """4 x 4 sensor to map."""
    m = np.eye(4)
    m[:3, :3] = rot_matrix("y", ry) @ rot_matrix("x", rx) @ rot_matrix("z", rz)
    m[:3, 3] = tx, ty, tz
    return m


def matrix_pose(m: np.ndarray) -> tuple[float, ...]:
    """Angles and position of :func:`pose_matrix`."""
    r = m[:3, :3]
    return math.asin(max(-1.0, min(1.0, -r[1, 2]))), math.atan2(r[0, 2], r[2, 2]), math.atan2(r[1, 0], r[1, 1]), *map(float, m[:3, 3])


def accumulate(pose: np.ndarray, step: np.ndarray, drift_scale: float = 1.0) -> np.ndarray:
    """Compose a pose with the inverse of a sweep's motion; yaw and z of the motion are scaled first."""
    rx, ry, rz, tx, ty, tz = step
    return pose @ np.linalg.inv(pose_matrix(rx, ry * drift_scale, rz, tx, ty, tz * drift_scale))


def associate_to_map(odometry: np.ndarray, before: np.ndarray, mapped: np.ndarray) -> np.ndarray:
    """Fuse a new odometry pose with the last map correction: what moved since ``before`` is applied to ``mapped``."""
    return mapped @ np.linalg.inv(before) @ odometry


def projection_matrix(k: np.ndarray, extrinsic: np.ndarray, from_pose: np.ndarray, to_pose: np.ndarray) -> np.ndarray:
    """3 x 4: pixels of the frame at ``to_pose`` from points in the frame at ``from_pose``."""
    swap = np.array([[0, 1, 0, 0], [0, 0, 1, 0], [1, 0, 0, 0], [0, 0, 0, 1]], float)
    return k @ extrinsic @ np.linalg.inv(swap) @ np.linalg.inv(to_pose) @ from_pose @ swap
