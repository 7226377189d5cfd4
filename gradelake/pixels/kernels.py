"""Raster operators on whole images: one row ``image, width, height, data`` (bytes of r, g, b) in, one row out.

Images are independent, so every operator is a map in Arrow batches; an image is bounded by what a camera gives.
Planes are 32-bit floats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUAD = ("tl_x", "tl_y", "tr_x", "tr_y", "br_x", "br_y", "bl_x", "bl_y")
#: The outline search (least threshold, order statistic, its stride), line search (tolerance, rounds).
LEAST_EDGE, EDGE_SHARE, EDGE_STRIDE, TOLERANCE, ROUNDS = 40.0, 0.92, 17, 3.0, 80
ASPECT = 63.5 / 88.9


def unpacked(data: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, 3)


def gray_of(rgb: np.ndarray) -> np.ndarray:
    return (rgb @ np.array([0.299, 0.587, 0.114])).astype(np.float32)


def neighbours(plane: np.ndarray, mode: str) -> dict[tuple[int, int], np.ndarray]:
    """The plane moved by one in all directions; ``edge`` repeats the border, ``constant`` has zeros there."""
    h, w = plane.shape
    wide = np.pad(plane, 1, mode=mode)
    return {(dy, dx): wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)}


def blurred(plane: np.ndarray) -> np.ndarray:
    return (sum(neighbours(plane.astype(np.float64), "edge").values()) / 9.0).astype(np.float32)


def _inner(values: np.ndarray) -> np.ndarray:
    """Zero on the outermost pixels."""
    out = np.zeros_like(values, np.float32)
    out[1:-1, 1:-1] = values[1:-1, 1:-1]
    return out


def gradient(plane: np.ndarray) -> np.ndarray:
    n = neighbours(plane.astype(np.float64), "constant")
    gx = sum(k * (n[dy, 1] - n[dy, -1]) for dy, k in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(k * (n[1, dx] - n[-1, dx]) for dx, k in ((-1, 1), (0, 2), (1, 1)))
    return _inner(np.hypot(gx, gy))


def laplacian(plane: np.ndarray) -> np.ndarray:
    n = neighbours(plane.astype(np.float64), "constant")
    return _inner(n[0, 1] + n[0, -1] + n[1, 0] + n[-1, 0] - 4 * n[0, 0])


def least_squares(u: np.ndarray, v: np.ndarray) -> tuple[float, float] | None:
    """``v = a u + b``, fitted once more without points two standard deviations off or more; four points at least."""
    if len(u) < 4:
        return None

    def fit(u: np.ndarray, v: np.ndarray) -> tuple[float, float]:
        spread = u - u.mean()
        below = float(spread @ spread)
        a = float(spread @ v) / below if below > 1e-9 else 0.0
        return a, float(v.mean() - a * u.mean())

    a, b = fit(u, v)
    off = v - a * u - b
    near = np.abs(off) < 2 * (float(np.sqrt((off**2).mean())) or 1.0)
    return fit(u[near], v[near]) if 4 <= near.sum() < len(u) else (a, b)


def draws(n: int, rounds: int) -> np.ndarray:
    """Pairs of point numbers from a linear congruential generator seeded by the number of points.  Fixed values: its constants."""
    state, out = (n * 2654435761) & 0xFFFFFFFF, np.empty((rounds, 2), np.int64)
    for i in range(2 * rounds):
        state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
        out[i // 2, i % 2] = state * n >> 32
    return out


def consensus_line(u: np.ndarray, v: np.ndarray, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> tuple[float, float] | None:
    """The line through two points that most points are near to, refitted on those; the first of equals."""
    if len(u) < 4:
        return least_squares(u, v)
    first, second = draws(len(u), rounds).T
    du = u[second] - u[first]
    proper = np.abs(du) >= 1e-6
    if not proper.any():
        return least_squares(u, v)
    first, second, du = first[proper], second[proper], du[proper]
    a = (v[second] - v[first]) / du
    b = v[first] - a * u[first]
    near = np.abs(v[None, :] - (a[:, None] * u[None, :] + b[:, None])) < tolerance
    best = int(near.sum(1).argmax())
    own = near[best]
    return least_squares(u[own], v[own]) if own.sum() >= 4 else (float(a[best]), float(b[best]))


def side_points(strong: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each side, on every third line of the middle, the first strong pixel from outside: along the side, and its depth coordinate."""
    out = {}
    for axis, names in ((0, ("left", "right")), (1, ("top", "bottom"))):
        plane = strong if axis == 0 else strong.T
        lines, length = plane.shape
        at = np.arange(int(lines * 0.15), int(lines * 0.85), 3)
        reach = int(length * 0.45)
        for name, scan in zip(names, (plane[at, 2:reach], plane[at, length - 3 : length - reach : -1]), strict=True):
            found = scan.any(1)
            depth = scan.argmax(1)[found] + 2
            out[name] = (at[found].astype(float), (depth if name in ("left", "top") else length - 1 - depth).astype(float))
    return out


def meet(upright: tuple[float, float], level: tuple[float, float]) -> tuple[float, float]:
    """Where ``x = a y + b`` meets ``y = c x + d``."""
    (a, b), (c, d) = upright, level
    if abs(1 - a * c) < 1e-9:
        return float("nan"), float("nan")  # parallels
    y = (c * b + d) / (1 - a * c)
    return a * y + b, y


@dataclass
class Shape:
    area: float
    aspect: float
    opposite: float
    least_side: float
    angle_off: float
    convex: bool


def shape_of(quad: np.ndarray) -> Shape:
    """Of four corners, clockwise from the top left."""
    sides = np.roll(quad, -1, 0) - quad
    top, right, bottom, left = lengths = np.hypot(*sides.T)
    back = -np.roll(sides, 1, 0)
    cosine = (sides * back).sum(1) / np.maximum(1e-9, lengths * np.roll(lengths, 1))
    before = np.roll(sides, 1, 0)
    turns = before[:, 0] * sides[:, 1] - before[:, 1] * sides[:, 0]
    ratio = min(min(top, bottom) / max(top, bottom, 1e-9), min(left, right) / max(left, right, 1e-9))
    width, height = (top + bottom) / 2, (left + right) / 2
    return Shape(width * height, width / max(height, 1e-9), ratio, float(lengths.min()), float(np.abs(np.degrees(np.arccos(np.clip(cosine, -1, 1))) - 90).max()), bool((turns >= 0).all() or (turns <= 0).all()))


def blown_share(rgb: np.ndarray, quad: np.ndarray) -> float:
    """Overexposed share of every fourth pixel inside, 15 % from the box's sides; 1 if there are none."""
    h, w, _ = rgb.shape
    (x0, y0), (x1, y1) = quad.min(0), quad.max(0)
    mx, my = (x1 - x0) * 0.15, (y1 - y0) * 0.15
    part = rgb[max(0, int(y0 + my)) : min(h, int(y1 - my)) : 4, max(0, int(x0 + mx)) : min(w, int(x1 - mx)) : 4]
    return float((part > 250).all(2).mean()) if part.size else 1.0


def ring_strength(edges: np.ndarray, quad: np.ndarray, near: float, far: float) -> float:
    """Mean gradient in a band inside the box, at three depths along the middle of each side."""
    h, w = edges.shape
    (x0, y0), (x1, y1) = np.maximum(quad.min(0), 0), np.minimum(quad.max(0), [w - 1, h - 1])
    bw, bh = x1 - x0, y1 - y0
    if bw < 20 or bh < 20:
        return 0.0
    along = 0.1 + 0.05 * np.arange(16)
    xs, ys = [], []
    for f in (near, (near + far) / 2, far):
        xs += [x0 + bw * along, x0 + bw * along, np.full(16, x0 + bw * f), np.full(16, x1 - bw * f)]
        ys += [np.full(16, y0 + bh * f), np.full(16, y1 - bh * f), y0 + bh * along, y0 + bh * along]
    return float(edges[np.floor(np.concatenate(ys) + 0.5).astype(int), np.floor(np.concatenate(xs) + 0.5).astype(int)].mean())


def outside_strength(edges: np.ndarray, quad: np.ndarray) -> float:
    """Mean gradient of every third pixel away from the quad's box."""
    h, w = edges.shape
    y, x = np.mgrid[3 : h - 3 : 3, 3 : w - 3 : 3]
    (x0, y0), (x1, y1) = quad.min(0) - 6, quad.max(0) + 6
    away = ~((x > x0) & (x < x1) & (y > y0) & (y < y1))
    return float(edges[y[away], x[away]].mean()) if away.any() else 0.0


def outline(rgb: np.ndarray) -> tuple[np.ndarray, float]:
    """The card's quad and how sure it is: 0.1 without four lines, 0.2 if the quad is no card."""
    h, w, _ = rgb.shape
    frame = lambda m: np.array([[m, m], [w - 1 - m, m], [w - 1 - m, h - 1 - m], [m, h - 1 - m]], float)
    edges = gradient(blurred(gray_of(rgb)))
    ranked = np.sort(edges.ravel()[::EDGE_STRIDE])
    threshold = max(LEAST_EDGE, float(ranked[int(len(ranked) * EDGE_SHARE)]))
    points = side_points(edges > threshold)
    lines = {name: consensus_line(*p) for name, p in points.items()}
    if any(line is None for line in lines.values()):
        return frame(0), 0.1
    quad = np.array([meet(lines[a], lines[b]) for a, b in (("left", "top"), ("right", "top"), ("right", "bottom"), ("left", "bottom"))])
    if not np.isfinite(quad).all():
        return frame(0), 0.1
    s, blown = shape_of(quad), blown_share(rgb, quad)
    coverage, aspect = s.area / (w * h), s.aspect / ASPECT
    inside = (quad > [-0.05 * w, -0.05 * h]).all() and (quad < [1.05 * w, 1.05 * h]).all()
    if not (inside and s.convex and 0.16 < coverage < 0.97 and 0.82 < aspect < 1.22 and s.opposite > 0.7 and s.angle_off < 22 and s.least_side > 0.1 * w and blown < 0.3):
        return quad, 0.2
    # A scan fills the frame; then the first strong edge lies within the card, and there is card outside the quad.
    full = 0.66 < w / h < 0.78 and coverage < 0.85
    if full and outside_strength(edges, quad) > max(15.0, threshold * 0.1) and ring_strength(edges, frame(1), 0.02, 0.045) < threshold * 0.6:
        return frame(1), 0.7
    found = sum(len(u) for u, _ in points.values())
    density = found / ((int(h * 0.85) - int(h * 0.15)) / 3 + (int(w * 0.85) - int(w * 0.15)) / 3) / 2
    return quad, min(1.0, (0.62 + 0.25 * min(1.0, density) + 0.1 * (1 - s.angle_off / 22)) * (0.35 + 0.65 * (1 - min(1.0, blown / 0.4))))


def turned(rgb: np.ndarray) -> np.ndarray:
    """A quarter turn clockwise."""
    return np.rot90(rgb, -1)


def oriented_outline(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Landscape images are turned, unless the card is found clearly better without."""
    if rgb.shape[1] <= 1.1 * rgb.shape[0]:
        return rgb, *outline(rgb)
    upright = np.ascontiguousarray(turned(rgb))
    (quad, sure), (quad2, sure2) = outline(rgb), outline(upright)
    return (upright, quad2, sure2) if sure2 >= sure - 0.1 else (rgb, quad, sure)


def warped(rgb: np.ndarray, quad: np.ndarray, width: int, height: int) -> np.ndarray:
    """The quad as a rectangle: corners are interpolated bilinearly, and so are pixels."""
    u = np.arange(width) / max(1, width - 1)
    v = (np.arange(height) / max(1, height - 1))[:, None]
    at = lambda i: quad[0, i] * (1 - u) * (1 - v) + quad[1, i] * u * (1 - v) + quad[2, i] * u * v + quad[3, i] * (1 - u) * v
    x, y = np.clip(at(0), 0, rgb.shape[1] - 1), np.clip(at(1), 0, rgb.shape[0] - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, rgb.shape[1] - 1), np.minimum(y0 + 1, rgb.shape[0] - 1)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    mixed = (rgb[y0, x0] * (1 - fx) + rgb[y0, x1] * fx) * (1 - fy) + (rgb[y1, x0] * (1 - fx) + rgb[y1, x1] * fx) * fy
    return np.clip(np.rint(mixed), 0, 255).astype(np.uint8)


def text_band(rgb: np.ndarray, x0: float, y0: float, x1: float, y1: float, zoom: int = 3) -> np.ndarray:
    """A band of the image for reading: enlarged, gray, stretched between the 2nd and 98th percentile."""
    h, w, _ = rgb.shape
    part = rgb[int(y0 * h) : max(int(y0 * h) + 1, int(y1 * h)), int(x0 * w) : max(int(x0 * w) + 1, int(x1 * w))]
    ph, pw, _ = part.shape
    corners = np.array([[0, 0], [pw - 1, 0], [pw - 1, ph - 1], [0, ph - 1]], float)
    gray = np.trunc(gray_of(warped(part, corners, pw * zoom, ph * zoom)) + 1e-3).astype(int)
    reached = np.cumsum(np.bincount(gray.ravel(), minlength=256))
    low, high = (int(np.argmax(reached >= reached[-1] * p)) for p in (0.02, 0.98))
    return np.clip(np.trunc((gray - low) * 255 / max(1, high - low)), 0, 255).astype(np.uint8)


def photo_measures(rgb: np.ndarray) -> tuple[float, float, float]:
    """Sharpness (variance of the Laplacian), overexposed share, brightness."""
    gray = gray_of(rgb)
    return float(laplacian(gray).astype(np.float64).var()), float((rgb > 250).all(2).mean()), float(gray.mean())


def _mapped(rows: DataFrame, one: Callable[[dict], dict], ddl: str, schema: pa.Schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([one(row)], schema=schema)

    return rows.mapInArrow(run, ddl)


def packed(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """``image, width, height, data`` of complete rasters ``image, y, x, r, g, b``; a pixel travels as its place and one number."""
    schema = pa.schema([("image", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary())])

    def one(rows: pa.Table) -> pa.Table:
        colors = np.empty(width * height, ">u4")
        colors[rows["at"].to_numpy()] = rows["rgb"].to_numpy()
        data = colors.view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()
        return pa.table([rows["image"].slice(0, 1).combine_chunks(), [width], [height], [data]], schema=schema)

    byte = lambda c, by: F.shiftleft(F.col(c).cast("int"), by)
    rgb = byte("r", 16).bitwiseOR(byte("g", 8)).bitwiseOR(byte("b", 0))
    rows = pixels.select("image", (F.col("y") * width + F.col("x")).cast("int").alias("at"), rgb.alias("rgb"))
    return rows.groupBy("image").applyInArrow(one, "image bigint, width int, height int, data binary")


def channel_sums(images: DataFrame) -> DataFrame:
    """``image, n, r, g, b``: the number of pixels and the sum of each channel."""

    def one(row: dict) -> dict:
        rgb = unpacked(row["data"], row["width"], row["height"]).reshape(-1, 3)
        return {"image": row["image"], "n": len(rgb)} | dict(zip("rgb", rgb.sum(0, np.int64).tolist(), strict=True))

    names = ("image", "n", *"rgb")
    return _mapped(images.select("image", "width", "height", "data"), one, ", ".join(f"{n} bigint" for n in names), pa.schema([(n, pa.int64()) for n in names]))


def detected(images: DataFrame) -> DataFrame:
    """``image``, the quad's corners, ``confidence``, and the photo's measures."""
    names = [*QUAD, "confidence", "sharpness", "glare", "brightness"]

    def one(row: dict) -> dict:
        rgb, quad, sure = oriented_outline(unpacked(row["data"], row["width"], row["height"]))
        return {"image": row["image"]} | dict(zip(names, [*map(float, quad.ravel()), sure, *photo_measures(rgb)], strict=True))

    schema = pa.schema([("image", pa.int64()), *[(n, pa.float64()) for n in names]])
    return _mapped(images.select("image", "width", "height", "data"), one, "image bigint, " + ", ".join(f"{n} double" for n in names), schema)


def rectified(images: DataFrame, width: int = 635, height: int = 889) -> DataFrame:
    """``image, width, height, data`` of the quads ``tl_x ... bl_y`` as upright rectangles."""

    def one(row: dict) -> dict:
        quad = np.array([row[c] for c in QUAD], float).reshape(4, 2)
        flat = warped(unpacked(row["data"], row["width"], row["height"]), quad, width, height)
        return {"image": row["image"], "width": width, "height": height, "data": flat.tobytes()}

    schema = pa.schema([("image", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary())])
    return _mapped(images.select("image", "width", "height", "data", *QUAD), one, "image bigint, width int, height int, data binary", schema)
