"""Cropped and edited copies of images by local descriptors.

Corners are found at scales from the image's own down to the size of a patch, the strongest of each cell of a grid, so
their number grows with the area; around each, the direction from corner to centre of intensity turns a fixed pattern of
brightness comparisons into a 256-bit descriptor. Bands of its bits are the keys of a Hamming table in which the
query images' descriptors meet all others; what is near enough in Hamming distance votes, and an image is a copy if
enough of its votes agree on one shift, turn and scaling.

Images are binary netpbm (P5 grey, P6 colour, 8 bits), the format that needs no library here.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import parts, saved, sized_broadcast

#: Step between scales, side of a grid's cell and corners in one at a scale, distance of corners from the edge.
STEP, CELL, CORNERS, RADIUS = 1.25, 16, 2, 11
#: Bits of a band of the table and number of bands.
BAND_BITS, BANDS = 28, 9
#: Hamming distance that is a vote; votes that must agree, within so many pixels, radians and log scale.
NEAR, LEAST, PIXELS, TURN, SCALING = 32, 5, 4.0, 0.35, 0.45
#: Votes that can agree with each other beyond which not every one's transform is tried.
ENOUGH = 2_000
#: Ids and classes, and features of queries (each of them nine rows of 24 bytes), that may be broadcast at once; with 0 features both sides are shuffled.
BROADCAST_ROWS, BROADCAST_FEATURES = 500_000, 150_000


def _pattern(spread: float = 9, reach: float = 14, seed: int = 9) -> np.ndarray:
    """256 pairs of places to compare, mostly across the direction of the patch, along which brightness rises by its very choice."""
    pairs = np.clip(np.random.default_rng(seed).normal(0, spread, (4096, 2, 2)), -reach, reach)
    along, across = np.abs(pairs[:, 0] - pairs[:, 1]).T
    return _dealt(pairs[(along <= 0.4 * across) & (across > 2)][:256])


def _dealt(pairs: np.ndarray, width: float = 6) -> np.ndarray:
    """The comparisons in an order by which those of a band say different things.

    How alike two comparisons are is their covariance on a smooth picture (Gaussian, of the given width); each band takes in turn
    what is least like what it has. Bands are counted from the lowest bit of each 64, where the last of 64 comparisons is.
    """
    near = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(2) / (2 * width**2))
    one, two = pairs[:, 0], pairs[:, 1]
    like = near(one, one) - near(one, two) - near(two, one) + near(two, two)
    like = np.abs(like / np.sqrt(np.outer(np.diagonal(like), np.diagonal(like))))
    left, bands = list(range(len(pairs))), [[] for _ in range(BANDS)]
    for _ in range(BAND_BITS):
        for band in bands:
            worst = like[np.ix_(left, band)].max(1) if band else np.zeros(len(left))
            band.append(left.pop(int(np.argmin(worst))))
    order = np.array([*sum(bands, []), *left])
    return pairs[order].reshape(4, 64, 2, 2)[:, ::-1].reshape(256, 2, 2)


#: Directions that the pattern is turned to, the places of each in whole pixels, and how far they reach.
TURNS = 64
_AT = 2 * np.pi * np.arange(TURNS)[:, None, None] / TURNS
_TESTS = _pattern()
_X, _Y = (np.rint(a * _TESTS[None, ..., 0] + b * _TESTS[None, ..., 1]).astype(np.int32) for a, b in ((np.cos(_AT), -np.sin(_AT)), (np.sin(_AT), np.cos(_AT))))
REACH = int(max(np.abs(_X).max(), np.abs(_Y).max()))
FEATURE = "media_id long, f int, x float, y float, s float, a float, d array<long>"
#: Pixels that are described at once, and votes that one step of the geometric check holds against all others.
PIXELS_AT_ONCE, VOTES = 1 << 19, 256


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey levels as float32; None for what is not a whole netpbm image."""
    head = re.match(rb"(P[56])(?:\s+#[^\n]*)*\s+(\d+)\s+(\d+)\s+(\d+)\s", data or b"")
    if not head or not 0 < int(head[4]) < 256:
        return None
    w, h, depth = int(head[2]), int(head[3]), 3 if head[1] == b"P6" else 1
    if not w or not h or len(data) - head.end() < w * h * depth:
        return None
    pixels = np.frombuffer(data, np.uint8, w * h * depth, head.end()).reshape(h, w, depth)
    return pixels.astype(np.float32).mean(2)


def encode(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape
    return b"P5 %d %d 255\n" % (w, h) + np.clip(np.rint(pixels), 0, 255).astype(np.uint8).tobytes()


def resized(img: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear sampling of the last two axes at the centres of h x w cells."""

    def along(img: np.ndarray, n: int, axis: int) -> np.ndarray:
        m = img.shape[axis]
        at = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        low = np.minimum(at.astype(int), max(0, m - 2))
        part = (at - low).astype(np.float32).reshape((-1, 1) if axis == -2 else (-1,))
        return np.take(img, low, axis) * (1 - part) + np.take(img, np.minimum(low + 1, m - 1), axis) * part

    return along(along(img, h, -2), w, -1).astype(np.float32)


def _box(img: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of side 2 r + 1 in the last two axes, edges repeated."""
    n, (h, w) = 2 * r + 1, img.shape[-2:]
    p = np.pad(img.astype(np.float32, copy=False), [*[(0, 0)] * (img.ndim - 2), (r, r), (r, r)], mode="edge")
    out = p[..., :h, :].copy()
    for i in range(1, n):
        out += p[..., i : i + h, :]
    p, out = out, out[..., :w].copy()
    for i in range(1, n):
        out += p[..., i : i + w]
    out /= n * n
    return out


def _peaks(r: np.ndarray) -> np.ndarray:
    """Where a value is the largest of the 5 x 5 around it, and more than a trace."""
    h, w = r.shape[-2:]
    top = np.pad(r, [(0, 0), (2, 2), (0, 0)], constant_values=-np.inf)
    top = np.maximum.reduce([top[:, i : i + h] for i in range(5)])
    top = np.pad(top, [(0, 0), (0, 0), (2, 2)], constant_values=-np.inf)
    good = (r >= np.maximum.reduce([top[:, :, i : i + w] for i in range(5)])) & (r > 1e-3)
    good[:, :RADIUS], good[:, -RADIUS:], good[:, :, :RADIUS], good[:, :, -RADIUS:] = False, False, False, False
    return good


def features(imgs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the corners of imgs (n x height x width): the image's number, (x, y, scale, angle) in its own pixels, the descriptor as four 64-bit integers."""
    own, places, bits, scale = [], [], [], 1.0
    while min(imgs.shape[1:]) / scale > 2 * RADIUS + 3:
        h, w = int(imgs.shape[1] / scale), int(imgs.shape[2] / scale)
        at_scale, scale = scale, scale * STEP
        level = _box(resized(imgs, h, w) if at_scale > 1 else imgs, 1)
        gy, gx = np.gradient(level, axis=(1, 2))
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        i, y, x = np.nonzero(_peaks(r))
        if not len(y):
            continue
        cell = (i * (h // CELL + 1) + y // CELL) * (w // CELL + 1) + x // CELL
        order = np.lexsort((x, y, -r[i, y, x], cell))
        first = np.searchsorted(cell[order], cell[order])  # where the cell of each begins
        order = order[np.arange(len(order)) - first < CORNERS]
        i, y, x = i[order], y[order], x[order]
        at = np.arange(-7, 8)
        disc = (at[:, None] ** 2 + at[None, :] ** 2 <= 49).astype(np.float32)
        patch = level[i[:, None, None], y[:, None, None] + at[None, :, None], x[:, None, None] + at[None, None, :]] * disc
        angle = np.arctan2((patch.sum(2) * at).sum(1), (patch.sum(1) * at).sum(1))
        smooth = np.pad(_box(level, 2), [(0, 0), (REACH, REACH), (REACH, REACH)], mode="edge")
        turned = np.rint(angle * (TURNS / (2 * np.pi))).astype(np.int64) % TURNS
        wide = w + 2 * REACH
        spot = (i * (h + 2 * REACH) + y + REACH) * wide + x + REACH
        value = smooth.ravel()[spot[:, None, None] + (_Y * wide + _X)[turned]]
        own.append(i)
        bits.append(value[..., 0] < value[..., 1])
        places.append(np.stack([(x + 0.5) * at_scale, (y + 0.5) * at_scale, np.full(len(x), at_scale), angle], 1))
    if not places:
        return np.zeros(0, np.int64), np.zeros((0, 4), np.float32), np.zeros((0, 4), np.int64)
    packed = np.packbits(np.concatenate(bits), axis=1).view(">i8").astype(np.int64)
    own = np.concatenate(own)
    order = np.argsort(own, kind="stable")
    return own[order], np.concatenate(places).astype(np.float32)[order], packed[order]


def described(images: DataFrame) -> DataFrame:
    """FEATURE rows of images(media_id, image); a null or unreadable image has none. Images of one shape are worked on together."""

    def run(batches):
        for batch in parts(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            shapes: dict[tuple, list] = {}
            for at, data in enumerate(batch.column(1).to_pylist()):
                img = decode(data)
                if img is not None:
                    shapes.setdefault(img.shape, []).append((at, img))
            for (h, w), found in shapes.items():
                size = max(1, PIXELS_AT_ONCE // (h * w))
                for lo in range(0, len(found), size):
                    rows = found[lo : lo + size]
                    own, place, d = features(np.stack([img for _, img in rows]))
                    f = np.arange(len(own)) - np.searchsorted(own, own)
                    media = ids[np.array([at for at, _ in rows])][own] if len(own) else np.zeros(0, np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(own) + 1, 4, dtype=np.int32)), pa.array(d.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(media, pa.int64()), pa.array(f, pa.int32()), *(pa.array(np.ascontiguousarray(place[:, c])) for c in range(4)), lists], ["media_id", "f", "x", "y", "s", "a", "d"])

    return images.select(F.col("media_id").cast("long"), F.col("image").cast("binary")).where("media_id is not null").mapInArrow(run, FEATURE)


def keys(d: Column) -> Column:
    """The bands of a descriptor, each with its place."""

    def band(n: int) -> Column:
        i, low = divmod(n * BAND_BITS, 64)
        bits = F.shiftrightunsigned(d[i], low)
        if low + BAND_BITS > 64:
            bits = bits.bitwiseOR(F.shiftleft(d[i + 1], 64 - low))
        return bits.bitwiseAND(F.lit((1 << BAND_BITS) - 1)) + F.lit(n << BAND_BITS)

    return F.array(*(band(n) for n in range(BANDS)))


def _cells(turn: np.ndarray, scale: np.ndarray):
    """(votes, votes of the cell and its neighbours) of every cell of turn and log scale; whoever can agree is in one of the neighbours."""
    around = int(2 * np.pi / TURN)
    t = np.floor((turn % (2 * np.pi)) * around / (2 * np.pi)).astype(np.int64) % around
    cell = np.stack([t, np.floor(np.log(scale) / SCALING).astype(np.int64)], 1)
    order = np.lexsort(cell.T)
    first = np.flatnonzero(np.concatenate([[True], (cell[order][1:] != cell[order][:-1]).any(1)]))
    held = {tuple(cell[rows[0]]): rows for rows in np.split(order, first[1:])}
    for (x, y), rows in held.items():
        beside = [held.get(((x + i) % around, y + j)) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        yield rows, np.concatenate([r for r in beside if r is not None])


def consensus(one: np.ndarray, two: np.ndarray) -> int:
    """Most votes (rows x, y, scale, angle of the one and the other) that agree with the similarity transform of one of them.

    Votes are tried cell by cell of turn and scale, those first that most can agree with. Where a cell holds very many, as for
    large copies, it is enough to have a transform with which half of all that could do agree.
    """
    turn, scale = two[:, 3] - one[:, 3], two[:, 2] / one[:, 2]
    spots = np.unique(np.rint(one[:, :2] / 2), axis=0, return_inverse=True)[1].ravel()  # votes from one place count once
    best = 0
    cells = [(len(np.unique(spots[near])), rows, near) for rows, near in _cells(turn, scale)]
    for most, rows, near in sorted(cells, key=lambda c: -c[0]):
        if most <= best:
            break
        step = max(1, VOTES * VOTES // len(near))
        for lo in range(0, len(rows), step):
            own = rows[lo : lo + step]
            cos, sin = np.cos(turn[own]) * scale[own], np.sin(turn[own]) * scale[own]
            dx, dy = one[None, near, 0] - one[own, 0, None], one[None, near, 1] - one[own, 1, None]
            x, y = cos[:, None] * dx - sin[:, None] * dy, sin[:, None] * dx + cos[:, None] * dy
            agree = np.hypot(x + two[own, 0, None] - two[None, near, 0], y + two[own, 1, None] - two[None, near, 1]) <= PIXELS * np.maximum(1, two[own, 2, None])
            agree &= np.abs(np.angle(np.exp(1j * (turn[None, near] - turn[own, None])))) <= TURN
            agree &= np.abs(np.log(scale[None, near] / scale[own, None])) <= SCALING
            best = max(best, *(len(np.unique(spots[near[row]])) for row in agree))
            if len(near) > ENOUGH and best >= max(LEAST, most / 2):
                break
    return best


def _once(rows: DataFrame, keys: list[str], counted: DataFrame) -> DataFrame:
    """One of the rows of each key; only those of keys that counted(keys..., times) names as repeated are shuffled."""
    twice = saved(counted.where("times > 1").select(*keys), "twice")
    n_twice = twice.count()
    if not n_twice:
        return rows
    small = sized_broadcast(twice, n_twice, BROADCAST_ROWS)
    return rows.join(small, keys, "left_anti").unionByName(rows.join(small, keys, "left_semi").dropDuplicates(keys))


def _firsts(rows: DataFrame, key: list[str], ids: DataFrame, first: DataFrame, n_first: int) -> DataFrame:
    """The rows whose key is in first. Pictures are only shuffled where both the keys in first and those of the other rows are too many to broadcast."""
    if n_first > BROADCAST_ROWS:
        whole = ids.where("media_id is not null and hash is not null")
        other = saved(whole.join(first.select(*key), key, "left_anti").select(*key).distinct(), "others")
        n_other = other.count()
        if n_other <= BROADCAST_ROWS:
            return rows.where("media_id is not null and hash is not null").join(sized_broadcast(other, n_other, BROADCAST_ROWS), key, "left_anti")
    return rows.join(sized_broadcast(first.select(*key), n_first, BROADCAST_ROWS), key, "left_semi")


def votes(found: DataFrame, asked: DataFrame, n_asked: int) -> DataFrame:
    """(q, g, media_id, one, two): of every feature g of an asked picture the nearest one of each other picture, if near enough.

    Only the asked pictures' descriptors are spread over the table's bands beforehand. They go to the tasks, BROADCAST_FEATURES of them at
    a time, and all others stream past them with their places, so nothing is shuffled but what is near; each such pass is written.
    """
    own = found.join(sized_broadcast(asked, n_asked, BROADCAST_ROWS), "media_id", "left_semi")
    place = F.array("x", "y", "s", "a")
    own = own.select(F.col("media_id").alias("q"), F.col("f").alias("g"), place.alias("one"), *(F.col("d")[i].alias(f"e{i}") for i in range(4)))
    own = saved(own, "asked")
    n_own = own.count()
    passes = -(-n_own // BROADCAST_FEATURES) if BROADCAST_FEATURES else 1
    bits = sum((F.bit_count(F.col("d")[i].bitwiseXOR(F.col(f"e{i}"))) for i in range(4)), F.lit(0))
    near = (F.col("q") != F.col("media_id")) & (bits <= NEAR)
    spread = found.select("media_id", "f", place.alias("two"), "d", F.explode(keys(F.col("d"))).alias("key"))
    out = None
    for n in range(max(1, passes)):
        part = own.where(F.pmod(F.xxhash64("q", "g"), F.lit(max(1, passes))) == n)
        table = part.select("q", "g", F.explode(keys(F.array("e0", "e1", "e2", "e3"))).alias("key"))
        small = lambda df: F.broadcast(df) if BROADCAST_FEATURES else df
        rows = spread.join(small(table), "key").join(small(part), ["q", "g"]).where(near)
        best = rows.groupBy("q", "g", "media_id").agg(F.min(F.struct(bits.alias("b"), "f", "one", "two")).alias("m"))
        best = saved(best.select("q", "g", "media_id", "m.one", "m.two"), "near")
        out = best if out is None else out.unionByName(best)
    return out


def copies(images: DataFrame, query) -> DataFrame:
    """(media_id, class_id, is_query, matches) for every row of images(media_id, image, ...).

    Images of equal bytes are a class, named by its smallest media_id. The classes of images for which ``query``
    (of a column media_id) holds are looked up among all; matches lists the classes that are copies of it, with
    the number of agreeing votes, and is null for the others. Null images are a class together without matches; rows
    with a null media_id are in their class but never its name. Repeated rows come back repeated.
    """
    rows = images.select(F.col("media_id").cast("long").alias("media_id"), F.col("image").cast("binary").alias("image")).withColumn("hash", F.sha2("image", 256))
    ids = saved(rows.select("media_id", "hash", query(F.col("media_id")).alias("is_query")), "ids")
    classes = saved(ids.where("hash is not null").groupBy("hash").agg(F.min("media_id").alias("class_id"), F.max("is_query").alias("asked")), "classes")
    first = classes.where("class_id is not null").select(F.col("class_id").alias("media_id"), "hash", "asked")
    n_first, key = first.count(), ["media_id", "hash"]
    own = _firsts(rows, key, ids, first, n_first)
    own = _once(own, key, ids.where("media_id is not null").groupBy(*key).agg(F.count("*").alias("times")))
    found = saved(described(own.select("media_id", "image")), "features")
    asked = saved(first.where("asked").select("media_id"), "queries")
    n_asked = asked.count()
    met = votes(found, asked, n_asked)
    enough = met.groupBy("q", "media_id").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST).select("q", "media_id")
    met = met.join(saved(enough, "enough"), ["q", "media_id"], "left_semi")
    pairs = met.groupBy("q", "media_id").agg(F.array_sort(F.collect_list(F.struct("g", "one", "two"))).alias("votes"))  # at most a query's corners

    def run(batches):
        for batch in batches:
            for part in parts([batch]):
                n = [consensus(np.array([v["one"] for v in votes]), np.array([v["two"] for v in votes])) for votes in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int32())], ["q", "media_id", "n"])

    agreed = pairs.mapInArrow(run, "q long, media_id long, n int").where(F.col("n") >= LEAST)
    matches = agreed.groupBy(F.col("q").alias("class_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("media_id", "n"))), lambda m: F.concat_ws(":", m["media_id"].cast("string"), m["n"].cast("string"))), ",").alias("matches"))
    matched = asked.withColumnRenamed("media_id", "class_id").join(matches, "class_id", "left").select("class_id", F.coalesce("matches", F.lit("")).alias("matches"))
    out = ids.join(sized_broadcast(classes.select("hash", "class_id"), classes.count(), BROADCAST_ROWS), "hash", "left")
    matched = saved(matched, "matches")
    return out.join(sized_broadcast(matched, n_asked, BROADCAST_ROWS), "class_id", "left").select("media_id", "class_id", F.coalesce("is_query", F.lit(False)).alias("is_query"), "matches")


def rendered(embeddings: DataFrame) -> DataFrame:
    """(media_id, image): the images of the query, drawn from vectors since the tables hold none.

    A vector seeds a texture of 96 x 96 pixels. In every ten ids, those ending in 3, 6 and 9 show the picture of the id
    ending in 0 instead: cropped and enlarged, brightened with noise, or turned by a right angle.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("media_id"), F.col("embedding").cast("array<float>").alias("v"))
    kind = F.pmod("media_id", F.lit(10))
    edited = F.coalesce(kind.isin(3, 6, 9), F.lit(False))
    source = rows.where(kind == 0).select(F.col("media_id").alias("shown"), F.col("v").alias("w"))
    drawn = rows.where(edited).withColumn("shown", F.col("media_id") - kind).join(source, "shown", "left")
    drawn = rows.where(~edited).unionByName(drawn.select("media_id", F.coalesce("w", "v").alias("v")))

    def run(batches):
        for batch in parts(batches):
            images = []
            for media_id, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rng = np.random.default_rng(np.frombuffer(np.asarray(v or [], np.float32).tobytes(), np.uint32))
                img = resized(rng.uniform(0, 255, (16, 16)).astype(np.float32), 96, 96) * 0.7 + resized(rng.uniform(0, 255, (32, 32)).astype(np.float32), 96, 96) * 0.3
                edit = (media_id or 0) % 10
                if edit == 3:
                    img = resized(img[10:86, 12:90], 91, 94)
                elif edit == 6:
                    img = img * 0.85 + 22 + np.random.default_rng(media_id).normal(0, 2, img.shape)
                elif edit == 9:
                    img = np.rot90(img)
                images.append(encode(img))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(images, pa.binary())], ["media_id", "image"])

    return drawn.mapInArrow(run, "media_id long, image binary")


def op4_image_copies(spark, sf_dir: str) -> DataFrame:
    """Every image's class, and the copies of each class that has an id divisible by 50."""
    return copies(rendered(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), lambda c: c % 50 == 0)
