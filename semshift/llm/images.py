"""Media columns: copies of images, cropped or edited, by local descriptors.

Corners (least-eigenvalue response, several scales) get an orientation from their intensity centroid and 96 binary tests
turned by it. Descriptors meet on any of four 24-bit tables (pigeonhole: three differing bits or fewer can't miss); images with
such a meeting are candidates, if 128 wider tests, of what lies around the corners, are evidence enough of it. Their corners propose turn, scale
and shift; a pair of images is a copy if enough distinct corners agree on one proposal.

The shipped tables hold no images, so the query draws one for each row of `embeddings` (`drawn`), indexes all of them,
and searches edited copies of the rows whose id is divisible by 50.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

pa.set_memory_pool(pa.system_memory_pool())  # workers give memory back between stages

#: Images that are drawn or described at once.
STACK = 64
#: Pixels for which an image keeps CORNERS corners a scale; larger ones keep more in proportion.
AREA = 72 * 72
#: Pixels within which corners of a query are one place, whatever their scales: each place has one vote.
PLACE = 4.0
#: Radius of the squares whose sums the tests compare.
SMOOTH = 1
#: Scales; corners kept at each; patch radius; binary tests; turns that tests are prepared for.
SCALES, CORNERS, RADIUS, TESTS, TURNS = (1.0, 0.84, 0.7), 16, 9, 96, 72
#: Differing bits of corners that vote; corners that must agree; sizes of proposals: degrees, octaves, pixels.
MOST_BITS, LEAST_VOTES, BIN_TURN, BIN_SCALE, BIN_SHIFT = 14, 6, 20.0, 0.5, 6.0
#: Wider tests; radius of the squares they compare; spread and reach of their ends in pixels.
WIDE, WIDE_SMOOTH, SPREAD, REACH = 128, 2, 12.0, 22.0
#: Evidence of two corners that share a table's value (up to three differing bits can't miss it; of five spread by chance, 0.98 of corners share
#: one): wider tests within both images that agree, less so much for each that differs and for each differing bit. It has to reach this share of
#: the tests that lie within the images at the best placed of their corners, less an allowance, which small images, of few such tests, live on.
DIFFERS, BIT, NEEDED, ALLOWED = 3, 2, 0.28, 10


def _tests(tests: int = TESTS, spread: float = RADIUS / 2.2, reach: float = RADIUS * 0.7, seed: int = 23) -> np.ndarray:
    """Offsets (turn, test, end, y/x): pairs drawn near the centre, turned in steps."""
    rng = np.random.default_rng(seed)
    p = np.clip(rng.standard_normal((tests, 2, 2)) * spread, -reach, reach)
    a = np.arange(TURNS) * 2 * np.pi / TURNS
    rot = np.stack([np.stack([np.cos(a), np.sin(a)], 1), np.stack([-np.sin(a), np.cos(a)], 1)], 1)  # for (y, x)
    return np.rint(np.einsum("tij,ksj->tksi", rot, p)).astype(np.int64)


_OFFSETS, _AROUND = _tests(), _tests(WIDE, SPREAD, REACH, 103)
_Y, _X = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = (_Y**2 + _X**2 <= RADIUS**2).astype(np.float32)


def encode_pgm(pixels: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


#: The head of a binary PGM or PPM file: words between white space and comments, one white space before the samples.
_PNM = re.compile(rb"(P[56])" + rb"(?:\s|#[^\n]*\n)+(\d+)" * 3 + rb"\s")
_GREY = np.array([0.299, 0.587, 0.114])


def decode_pnm(raw: bytes) -> np.ndarray | None:
    m = _PNM.match(raw)
    if m is None:
        return None
    w, h, most, c = int(m[2]), int(m[3]), int(m[4]), 3 if m[1] == b"P6" else 1
    if not 0 < most < 256 or min(w, h) < 1 or w * h * c > len(raw) - m.end():
        return None
    p = np.frombuffer(raw, np.uint8, w * h * c, m.end()).reshape(h, w, c) * (255.0 / most)
    return (p @ _GREY if c == 3 else p[:, :, 0]).astype(np.float32)


def decode_png(raw: bytes) -> np.ndarray | None:
    """Grey pixels of a PNG file with 8-bit samples, without interlacing; transparency is left out of account."""
    at, data, head, palette = 8, [], None, None
    while at + 12 <= len(raw):
        n, kind = int.from_bytes(raw[at : at + 4], "big"), raw[at + 4 : at + 8]
        body = raw[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = (int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big"), *body[8:13])
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 3, 4, 6):
        return None
    w, h, c = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h + 1, w + 1, c), np.uint8)  # a line above and a pixel before, of zeros
    for y in range(h):
        f, x = lines[y, 0], lines[y, 1:].reshape(w, c)
        if f == 0:
            out[y + 1, 1:] = x
        elif f == 1:
            out[y + 1, 1:] = np.cumsum(x, axis=0, dtype=np.uint8)
        elif f == 2:
            out[y + 1, 1:] = x + out[y, 1:]
        else:
            up, left = out[y].astype(int), np.zeros(c, int)
            for i in range(w):
                if f == 3:
                    guess = (left + up[i + 1]) // 2
                else:
                    p = left + up[i + 1] - up[i]
                    da, db, dc = np.abs(p - left), np.abs(p - up[i + 1]), np.abs(p - up[i])
                    guess = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up[i + 1], up[i]))
                left = (x[i] + guess) & 255
                out[y + 1, i + 1] = left
    p = out[1:, 1:].astype(np.float64)
    if palette is not None and head[3] == 3:
        p, c = palette[out[1:, 1:, 0]].astype(np.float64), 3
    return (p[:, :, :3] @ _GREY if c >= 3 else p[:, :, 0]).astype(np.float32)


def decode(raw: bytes | None) -> np.ndarray | None:
    """Grey pixels of a PGM, PPM or PNG file with 8-bit samples; None for null and for anything else."""
    try:
        if not raw:
            return None
        return decode_png(raw) if raw.startswith(b"\x89PNG\r\n\x1a\n") else decode_pnm(raw)
    except (ValueError, IndexError, zlib.error):
        return None


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over (2r+1)-squares of a stack of images, edges repeated."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r + 1, r)
        c = np.cumsum(np.pad(a, pad, mode="edge"), axis=axis, dtype=np.float32)
        n = a.shape[axis]
        take = lambda x, i: x[:, i : i + n] if axis == 1 else x[:, :, i : i + n]  # noqa: B023, E731
        a = take(c, 2 * r + 1) - take(c, 0)
    return a


def _resized(a: np.ndarray, s: float) -> np.ndarray:
    if s == 1.0:
        return a
    h, w = max(1, round(a.shape[1] * s)), max(1, round(a.shape[2] * s))
    y, x = (np.arange(h) + 0.5) / s - 0.5, (np.arange(w) + 0.5) / s - 0.5
    y, x = np.clip(y, 0, a.shape[1] - 1), np.clip(x, 0, a.shape[2] - 1)
    y0, x0 = np.minimum(y.astype(int), max(0, a.shape[1] - 2)), np.minimum(x.astype(int), max(0, a.shape[2] - 2))
    fy, fx = (y - y0).astype(np.float32)[:, None], (x - x0).astype(np.float32)[None]
    y1, x1 = np.minimum(y0 + 1, a.shape[1] - 1), np.minimum(x0 + 1, a.shape[2] - 1)
    return (a[:, y0][:, :, x0] * (1 - fy) + a[:, y1][:, :, x0] * fy) * (1 - fx) + (a[:, y0][:, :, x1] * (1 - fy) + a[:, y1][:, :, x1] * fy) * fx


def describe(stack: np.ndarray) -> dict[str, np.ndarray]:
    """Descriptors of a stack of equally large images: image, y, x (of the full size), octave, turn (degrees), bits (12 bytes),
    wide (16 bytes), seen (16 bytes: the wider tests that lie within the image)."""
    packed = {"bits": TESTS // 8, "wide": WIDE // 8, "seen": WIDE // 8}
    out: dict[str, list] = {k: [] for k in ("image", "y", "x", "octave", "turn", *packed)}
    for s in SCALES:
        a = _resized(stack.astype(np.float32), s)
        n, h, w = a.shape
        m = RADIUS + 1
        if min(h, w) <= 2 * m + 2:
            continue
        gy, gx = np.zeros_like(a), np.zeros_like(a)
        gy[:, 1:-1], gx[:, :, 1:-1] = a[:, 2:] - a[:, :-2], a[:, :, 2:] - a[:, :, :-2]
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)  # the lesser eigenvalue
        inner = r[:, m : h - m, m : w - m]
        peak = np.ones(inner.shape, bool)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    near = r[:, m + dy : h - m + dy, m + dx : w - m + dx]
                    peak &= (inner > near) if (dy, dx) > (0, 0) else (inner >= near)
        strength = np.where(peak & (inner > 500), inner, 0).reshape(n, -1)
        k = min(max(CORNERS, CORNERS * stack.shape[1] * stack.shape[2] // AREA), strength.shape[1])
        best = np.argpartition(-strength, k - 1, axis=1)[:, :k]
        i = np.repeat(np.arange(n), k)
        at = best.ravel()
        good = strength[i, at] > 0
        i, at = i[good], at[good]
        y, x = at // (w - 2 * m) + m, at % (w - 2 * m) + m
        if not len(i):
            continue
        patch = a[i[:, None, None], y[:, None, None] + _Y, x[:, None, None] + _X] * _DISC
        turn = np.degrees(np.arctan2((patch * _Y).sum((1, 2)), (patch * _X).sum((1, 2))))
        smooth = _box(a, SMOOTH)
        step = np.rint(turn / (360 / TURNS)).astype(int) % TURNS
        off = _OFFSETS[step]
        v = smooth[i[:, None, None], y[:, None, None] + off[..., 0], x[:, None, None] + off[..., 1]]
        ay, ax = y[:, None, None] + _AROUND[step, ..., 0], x[:, None, None] + _AROUND[step, ..., 1]
        seen = ((ay > 0) & (ay < h - 1) & (ax > 0) & (ax < w - 1)).all(2)
        around = _box(a, WIDE_SMOOTH)[i[:, None, None], np.clip(ay, 0, h - 1), np.clip(ax, 0, w - 1)]
        out["image"].append(i)
        out["y"].append((y + 0.5) / s)
        out["x"].append((x + 0.5) / s)
        out["octave"].append(np.full(len(i), np.log2(s)))
        out["turn"].append(turn)
        for k, b in (("bits", v[..., 0] < v[..., 1]), ("wide", around[..., 0] < around[..., 1]), ("seen", seen)):
            out[k].append(np.packbits(b, axis=1, bitorder="little"))
    return {k: np.concatenate(v) if v else np.zeros((0, packed[k]) if k in packed else 0, np.uint8 if k in packed else np.float64) for k, v in out.items()}


def descriptors(images: DataFrame, image_id: str = "image_id", image: str = "image") -> DataFrame:
    """image_id, corner, y, x, octave, turn, b0 to b3 (24 bits each), wide0, wide1, seen0, seen1 (64 bits each), most (wider tests within the
    image at the best placed of its corners). What can't be decoded has none."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for at in range(0, whole.num_rows, STACK):
                b = whole.slice(at, STACK)
                ids, pixels = b.column(0).to_pylist(), [decode(r) for r in b.column(1).to_pylist()]
                shapes: dict[tuple, list[int]] = {}
                for i, p in enumerate(pixels):
                    if p is not None:
                        shapes.setdefault(p.shape, []).append(i)
                for rows in shapes.values():
                    d = describe(np.stack([pixels[i] for i in rows]))
                    own = d["image"].astype(int)
                    most = np.zeros(len(rows), np.int32)
                    np.maximum.at(most, own, np.bitwise_count(d["seen"]).sum(1, dtype=np.int32))
                    words = [d["bits"][:, 3 * k].astype(np.int32) | d["bits"][:, 3 * k + 1].astype(np.int32) << 8 | d["bits"][:, 3 * k + 2].astype(np.int32) << 16 for k in range(4)]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[rows[i]] for i in own], pa.int64()), pa.array(np.arange(len(own), dtype=np.int32)), *(pa.array(d[k].astype(np.float32)) for k in ("y", "x", "octave", "turn")), *(pa.array(x) for x in words), *(pa.array(np.ascontiguousarray(d[c]).view(np.int64)[:, k]) for c in ("wide", "seen") for k in range(2)), pa.array(most[own])], ["image_id", "corner", "y", "x", "octave", "turn", "b0", "b1", "b2", "b3", "wide0", "wide1", "seen0", "seen1", "most"])

    rows = images.select(F.col(image_id).cast("long").alias("image_id"), F.col(image).alias("image"))
    return rows.mapInArrow(run, "image_id long, corner int, y float, x float, octave float, turn float, b0 int, b1 int, b2 int, b3 int, wide0 long, wide1 long, seen0 long, seen1 long, most int")


def copies(queries: DataFrame, index: DataFrame) -> DataFrame:
    """query_id, image_id, votes of descriptor tables: images of the index that a query image is a copy of.

    Two corners within three bits share one of the four tables' values, without exception. Images are candidates if they have corners
    that share a value and are evidence enough (see DIFFERS): how many of the wider tests agree counts, not their share alone, as a few,
    at an edge, agree by chance; then all their corners that differ in MOST_BITS or less vote, each place of the query once. Corners of
    unlike images are often alike, their surroundings seldom: so what grows with pairs of images ends within the join of the tables.
    """

    def named(d: DataFrame, p: str) -> DataFrame:
        return d.select(*[F.col(c).alias(p + c) for c in d.columns])

    def keyed(d: DataFrame, p: str) -> DataFrame:
        b = [F.col(f"{p}b{k}").cast("long") for k in range(4)]
        kept = [f"{p}image_id", f"{p}most", f"{p}lo", f"{p}hi", *(f"{p}{c}{k}" for c in ("wide", "seen") for k in range(2))]
        rows = d.withColumns({f"{p}lo": b[0] + b[1] * (1 << 24), f"{p}hi": b[2] + b[3] * (1 << 24)})
        return rows.select(*kept, F.explode(F.array(*[x + (k << 24) for k, x in enumerate(b)])).alias("value"))

    def differing(*pairs: tuple[str, Column | None]) -> Column:
        both = [(F.col(f"q_{c}").bitwiseXOR(F.col(f"m_{c}")), within) for c, within in pairs]
        return sum((F.bit_count(x if within is None else x.bitwiseAND(within)) for x, within in both), F.lit(0))

    around = ["wide0", "wide1", "seen0", "seen1", "most"]
    q, m = named(queries.drop(*around), "q_"), named(index.drop(*around), "m_")
    seen = [F.col(f"q_seen{k}").bitwiseAND(F.col(f"m_seen{k}")) for k in range(2)]
    held = sum((F.bit_count(x) for x in seen), F.lit(0))
    evidence = held - differing(("wide0", seen[0]), ("wide1", seen[1])) * (1 + DIFFERS) - differing(("lo", None), ("hi", None)) * BIT
    alike = evidence >= F.least("q_most", "m_most") * NEEDED - ALLOWED
    pairs = keyed(named(queries, "q_"), "q_").join(keyed(named(index, "m_"), "m_"), "value").where(alike)
    met = stored(pairs.select("q_image_id", "m_image_id").distinct(), "image-candidates")
    j = met.join(q, "q_image_id").join(m, "m_image_id").where(differing(*[(f"b{k}", None) for k in range(4)]) <= MOST_BITS)
    turn = F.col("q_turn") - F.col("m_turn")
    octave = F.col("m_octave") - F.col("q_octave")
    a, s = F.radians(turn), F.pow(F.lit(2.0), octave)
    dx = F.col("q_x") - s * (F.cos(a) * F.col("m_x") - F.sin(a) * F.col("m_y"))
    dy = F.col("q_y") - s * (F.sin(a) * F.col("m_x") + F.cos(a) * F.col("m_y"))
    j = j.select("q_image_id", "m_image_id", (F.round(F.col("q_x") / PLACE) * 100003 + F.round(F.col("q_y") / PLACE)).cast("long").alias("q_corner"), F.pmod(turn, F.lit(360.0)).alias("turn"), octave.alias("oct"), dx.alias("dx"), dy.alias("dy"))
    two = lambda c, w, n: F.explode(F.array(F.floor(F.col(c) / w), F.floor(F.col(c) / w + 0.5) + 1000)).alias(n)  # noqa: E731  overlapping bins
    j = j.select("q_image_id", "m_image_id", "q_corner", F.pmod(F.round(F.col("turn") / BIN_TURN), F.lit(360 / BIN_TURN)).alias("kt"), F.round(F.col("oct") / BIN_SCALE).alias("ko"), "dx", "dy")
    j = j.select("*", two("dx", BIN_SHIFT * 2, "kx")).select("*", two("dy", BIN_SHIFT * 2, "ky"))
    votes = j.groupBy("q_image_id", "m_image_id", "kt", "ko", "kx", "ky").agg(F.countDistinct("q_corner").alias("votes"))
    best = votes.groupBy("q_image_id", "m_image_id").agg(F.max("votes").alias("votes")).where(F.col("votes") >= LEAST_VOTES)
    return best.select(F.col("q_image_id").alias("query_id"), F.col("m_image_id").alias("image_id"), "votes")


def draw(v: np.ndarray, size: int = 72) -> np.ndarray:
    """One image of shaded rectangles for each row of components: places, sizes, greys and waves follow from the components."""
    n, d = v.shape
    g = np.arange(size, dtype=np.float32)
    out = np.full((n, size, size), 128, np.float32)
    u = np.tanh(v * np.sqrt(d) * 0.6).astype(np.float32)
    for k in range(24):
        cx, cy, w, h, c, fx, fy = (u[:, (k * m + o) % d][:, None] for m, o in ((1, 0), (3, 1), (5, 2), (7, 3), (9, 4), (11, 5), (13, 6)))
        dx, dy = g - size * (0.5 + 0.5 * cx), g - size * (0.5 + 0.5 * cy)
        inside = (np.abs(dy) < 6 + 9 * (1 + h))[:, :, None] & (np.abs(dx) < 6 + 9 * (1 + w))[:, None, :]
        wave = np.cos(dx * fx * 0.9)[:, None, :] * np.cos(dy * fy * 0.9)[:, :, None]
        out = np.where(inside, 128 + 60 * c[:, :, None] + 60 * wave, out)
    return out


#: What `edit` can do.
EDITS = ("cropped", "cropped and darker", "turned by a quarter", "smaller by a fifth", "larger by a quarter", "turned by 15 degrees", "noisy")


def edit(pixels: np.ndarray, kind: int, seed: int = 0) -> np.ndarray:
    """An edited copy, by the number of the edit in EDITS."""
    p = pixels
    if kind in (0, 1):
        p = p[5:67, 6:68]
        p = np.clip(p * 0.8 + 15, 0, 255) if kind == 1 else p
    elif kind == 2:
        p = np.rot90(p)
    elif kind in (3, 4):
        p = _resized(p[None], 0.8 if kind == 3 else 1.25)[0]
    elif kind == 5:
        h, w = p.shape
        a, cy, cx = np.radians(15.0), (h - 1) / 2, (w - 1) / 2
        y, x = np.mgrid[0:h, 0:w]
        y, x = cy + (y - cy) * np.cos(a) - (x - cx) * np.sin(a), cx + (y - cy) * np.sin(a) + (x - cx) * np.cos(a)
        y0, x0 = np.clip(np.floor(y).astype(int), 0, h - 2), np.clip(np.floor(x).astype(int), 0, w - 2)
        fy, fx = np.clip(y - y0, 0, 1), np.clip(x - x0, 0, 1)
        p = (p[y0, x0] * (1 - fx) + p[y0, x0 + 1] * fx) * (1 - fy) + (p[y0 + 1, x0] * (1 - fx) + p[y0 + 1, x0 + 1] * fx) * fy
    elif kind == 6:
        p = np.clip(p + 4 * np.random.default_rng(seed).standard_normal(p.shape), 0, 255)
    return p


def drawn(vectors: DataFrame, edited: bool, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """image_id, image (PGM) for each row, or an edited copy. Vectors that are null, empty or not finite have a null image."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for at in range(0, whole.num_rows, STACK):
                b = whole.slice(at, STACK)
                ids, vs = b.column(0).to_pylist(), b.column(1).to_pylist()
                out: list[bytes | None] = [None] * len(ids)
                by: dict[int, list[int]] = {}
                for i, v in enumerate(vs):
                    if v and None not in v and np.isfinite(v).all():
                        by.setdefault(len(v), []).append(i)
                for rows in by.values():
                    for i, p in zip(rows, draw(np.array([vs[i] for i in rows], np.float64)), strict=True):
                        out[i] = encode_pgm(np.rint(edit(p, (ids[i] or 0) // 50 % len(EDITS), abs(ids[i] or 0))) if edited else p)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["image_id", "image"])

    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).mapInArrow(run, "image_id long, image binary")


def find_copies(queries: DataFrame, images: DataFrame) -> DataFrame:
    """query_id, image_id, copies, votes: for each query row the distinct images it is a copy of.

    Both tables hold image_id and image. Equal images are one class, named by its least id, with its number of copies.
    Null, undecodable and featureless images match nothing. Empty tables give no rows.
    """
    spark_key = F.sha2("image", 256).alias("key")
    classes = stored(images.where("image is not null").select("image_id", spark_key, "image").groupBy("key").agg(F.min("image_id").alias("image_id"), F.count(F.lit(1)).alias("copies"), F.min("image").alias("image")), "image-classes")
    asked = stored(queries.where("image is not null").select("image_id", spark_key, "image"), "image-queries")
    reps = asked.groupBy("key").agg(F.min("image_id").alias("image_id"), F.min("image").alias("image"))
    d = stored(descriptors(classes.select("image_id", "image")), "image-descriptors")
    found = copies(stored(descriptors(reps), "query-descriptors"), d)
    members = asked.select(F.col("image_id").alias("member"), "key").join(reps.select("key", F.col("image_id").alias("query_id")), "key")
    out = members.join(found, "query_id").join(classes.select("image_id", "copies"), "image_id")
    return out.select(F.col("member").alias("query_id"), "image_id", "copies", "votes")


def op1_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return find_copies(drawn(v.where(F.col("vec_id") % 50 == 0), True), drawn(v, False))
