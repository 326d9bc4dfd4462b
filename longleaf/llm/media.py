"""Copies of images by local descriptors, in a media column.

* Corners (Harris) are found at two scales of every image; none is capped, weak ones are no corners.
* Around each, the direction to the centre of brightness turns a fixed set of 128 pairs of points;
  which point of a pair is brighter in the smoothed image gives a bit.  Crops, shifts and changes of
  brightness or contrast leave such bits alone, turned and halved copies nearly so.
* The bits are cut into four words, the tables of a Hamming join: keypoints match if they agree in a
  word and differ in ``far`` bits at most.  The bits are compared inside the join, so a word
  that many unlike corners share gives no rows.
* A match is a shift, turn and change of scale.  Images are linked if ``votes`` places of each
  agree in these (geometric consensus, with bins that overlap by half).  The rarest word that two
  linked images share is none of those commonest words of an image that cover fewer places, so
  leaving these out of the join loses no link; images that met are then matched in all their words.
* First every image meets one leader only (of those that lead its buckets, being the images with
  most company there), so a group of thousands of copies costs a row each.  Then images meet
  their other leaders, and at last all images of their buckets, that are in other
  components, whatever their number; a common word is dealt to many tasks.
* Classes are connected components; images of equal bytes are one node from the start.

Content is binary PGM or PPM (P5, P6, 8 bits).

Cases: null, empty or unreadable content, and images without corners, are alone unless their bytes
are equal to another's (null equals nothing); images are read whole at any size; rows repeat as in
the input; other columns are not read, whatever their names; a null id stays null; class_id is the
smallest id of the class (null if it has none); an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longleaf.llm.common import Tables, map_arrow
from longleaf.llm.graph import components

RADIUS, MARGIN, BITS, TURNS = 7, 9, 128, 72
#: Turns that count as one in the consensus.
SWAY = 6
#: Keypoints of a bucket that meet all others of it in one task.
BLOCK = 512
_HEAD = re.compile(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s")


def decode(content: bytes | None) -> np.ndarray | None:
    """Grey values of a binary PGM or PPM, or None."""
    m = _HEAD.match(content or b"")
    if not m or not 0 < int(m[4]) < 256:
        return None
    wide, high, planes = int(m[2]), int(m[3]), 3 if m[1] == b"6" else 1
    data = np.frombuffer(content, np.uint8, offset=m.end())
    if len(data) < wide * high * planes or not wide * high:
        return None
    return data[: wide * high * planes].reshape(high, wide, planes).mean(axis=2).astype(np.float32)


def encode(grey: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (grey.shape[1], grey.shape[0]) + np.clip(np.rint(grey), 0, 255).astype(np.uint8).tobytes()


def _box(a: np.ndarray) -> np.ndarray:
    """Sums over 3 x 3 places of each image of a stack."""
    p = np.pad(a, ((0, 0), (1, 1), (1, 1)), "edge")
    rows = p[:, :-2] + p[:, 1:-1] + p[:, 2:]
    return rows[:, :, :-2] + rows[:, :, 1:-1] + rows[:, :, 2:]


def _pairs() -> np.ndarray:
    """The fixed point pairs, turned: (turn, pair, end, row and column)."""
    rng = np.random.default_rng(5)
    radius, angle = RADIUS * np.sqrt(rng.random((BITS, 2))), rng.random((BITS, 2)) * 2 * np.pi
    turn = np.arange(TURNS)[:, None, None] * 2 * np.pi / TURNS
    return np.rint(np.stack([radius * np.sin(angle + turn), radius * np.cos(angle + turn)], axis=-1)).astype(np.int64)


_PAIRS = _pairs()
_DISC = np.array([(y, x) for y in range(-RADIUS, RADIUS + 1) for x in range(-RADIUS, RADIUS + 1) if y * y + x * x <= RADIUS * RADIUS])


def keypoints(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Image, place (row, column), turn and packed bits (four words) of the corners of equally large images."""
    if min(stack.shape[1:]) <= 2 * MARGIN:
        return np.zeros(0, np.int64), np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros((0, 4), np.uint32)
    smooth = _box(stack) / 9
    gy, gx = np.gradient(smooth, axis=(1, 2))
    xx, yy, xy = _box(gx * gx), _box(gy * gy), _box(gx * gy)
    strength = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    top = strength
    for axis in (1, 2):  # the largest within three places along each axis
        p = np.pad(top, [(0, 0) if k != axis else (3, 3) for k in range(3)], constant_values=-np.inf)
        n = top.shape[axis]
        top = np.maximum.reduce([p.take(range(d, d + n), axis=axis) for d in range(7)])
    peak = strength == top
    peak &= strength > 400.0
    peak[:, :MARGIN] = peak[:, -MARGIN:] = False
    peak[:, :, :MARGIN] = peak[:, :, -MARGIN:] = False
    image, y, x = np.nonzero(peak)
    if not len(image):
        return image, np.zeros((0, 2), np.int64), image, np.zeros((0, 4), np.uint32)
    disc = smooth[image[:, None], y[:, None] + _DISC[:, 0], x[:, None] + _DISC[:, 1]]
    angle = np.arctan2((disc * _DISC[:, 0]).sum(axis=1), (disc * _DISC[:, 1]).sum(axis=1))
    turn = np.rint(angle / (2 * np.pi) * TURNS).astype(np.int64) % TURNS
    at = _PAIRS[turn]
    smooth = _box(smooth) / 9
    ends = smooth[image[:, None, None], y[:, None, None] + at[..., 0], x[:, None, None] + at[..., 1]]
    bits = ends[:, :, 0] < ends[:, :, 1]
    return image, np.stack([y, x], axis=1), turn, np.packbits(bits, axis=1, bitorder="little").view("<u4")


def describe(contents: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word of each keypoint: its image, its key in the Hamming table, its place (packed) and all its bits (two longs)."""
    shapes: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
    for i, c in enumerate(contents):
        if (grey := decode(c)) is not None:
            shapes.setdefault(grey.shape, []).append((i, grey))
    owner, keys, places, bits = [], [], [], [np.zeros((0, 2), np.int64)]
    for images in shapes.values():
        step = max(1, 2_000_000 // images[0][1].size)
        for k in range(0, len(images), step):
            index = np.array([i for i, _ in images[k : k + step]])
            stack = np.stack([g for _, g in images[k : k + step]])
            for level in (0, 1):
                if level:
                    h, w = stack.shape[1] // 2 * 2, stack.shape[2] // 2 * 2
                    stack = stack[:, :h, :w].reshape(len(stack), h // 2, 2, w // 2, 2).mean(axis=(2, 4))
                image, at, turn, words = keypoints(stack)
                place = (at[:, 0] << level) << 32 | (at[:, 1] << level) << 8 | turn << 1 | level
                owner.append(np.repeat(index[image], 4))
                keys.append((words.astype(np.int64) | np.arange(4) << 32).reshape(-1))
                places.append(np.repeat(place, 4))
                bits.append(np.repeat(np.ascontiguousarray(words).view("<i8"), 4, axis=0))
    flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return flat(owner), flat(keys), flat(places), flat(bits)


def rare_words(keys: list[int], places: list[int], votes: int) -> int:
    """How many of an image's words (commonest last) are left without the commonest ones that cover fewer than votes places."""
    covered: set[int] = set()
    end = len(keys)
    while end:
        start = end - 1
        while start and keys[start - 1] == keys[end - 1]:
            start -= 1
        covered |= set(places[start:end])
        if len(covered) >= votes:
            break
        end = start
    return end


def _codes(*columns: np.ndarray) -> np.ndarray:
    """Equal rows of the columns get equal numbers from 0."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        inverse = np.unique(c, return_inverse=True)[1]
        out = np.unique(out * (inverse.max(initial=0) + 1) + inverse, return_inverse=True)[1]
    return out


def agreeing(pair: np.ndarray, place: np.ndarray, there: np.ndarray, votes: int, cell: int) -> np.ndarray:
    """The pairs of images of which votes places, in either image, agree in scale, turn and shift."""
    y, x, turn, level = (lambda c: c >> 32), (lambda c: c >> 8 & 0xFFFFFF), (lambda c: c >> 1 & 127), (lambda c: c & 1)
    scale, turned = level(there) - level(place), (turn(there) - turn(place)) % TURNS
    ratio, angle = 2.0**scale, turned * (2 * np.pi / TURNS)
    one = _codes(pair)
    n = np.bincount(one)
    py, px = y(place) - (np.bincount(one, y(place)) / n)[one], x(place) - (np.bincount(one, x(place)) / n)[one]  # a turn about the middle moves places least
    dx = x(there) - ratio * (np.cos(angle) * px - np.sin(angle) * py)
    dy = y(there) - ratio * (np.sin(angle) * px + np.cos(angle) * py)
    found = [np.zeros(0, np.int64)]
    for a, b, c in np.ndindex(2, 2, 2):
        group = _codes(pair, scale, (turned + c * SWAY // 2) % TURNS // SWAY, np.floor(dx / cell + a / 2), np.floor(dy / cell + b / 2))
        many = np.ones(group.max(initial=-1) + 1, bool)
        for side in (place, there):
            once = np.unique(_codes(group, side), return_index=True)[1]
            many &= np.bincount(group[once], minlength=len(many)) >= votes
        found.append(pair[many[group]])
    return np.unique(np.concatenate(found))


def matches(n: np.ndarray, keys: np.ndarray, places: np.ndarray, bits: np.ndarray, n2: np.ndarray, keys2: np.ndarray, places2: np.ndarray, bits2: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, place, place2) of every two keypoints of a pair that agree in a word and differ in at most far bits."""
    word = _codes(np.concatenate([np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(n2)), n2)]), np.concatenate([keys, keys2]))
    mine, theirs = word[: len(keys)], word[len(keys) :]
    order = np.argsort(theirs, kind="stable")
    low, high = (np.searchsorted(theirs[order], mine, side) for side in ("left", "right"))
    count = high - low
    at = np.repeat(np.arange(len(mine)), count)
    other = order[np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
    near = np.bitwise_count(bits[at] ^ bits2[other]).sum(axis=1) <= far
    at, other = at[near], other[near]
    return np.repeat(np.arange(len(n)), n)[at], places[at], places2[other]


def _near(far: int, *sides: str) -> Column:
    """Whether the keypoints of both sides of a join differ in at most far bits."""
    x, y = ([F.col(f"{s}.{c}") for c in ("low", "high")] for s in sides)
    return F.bit_count(x[0].bitwiseXOR(y[0])) + F.bit_count(x[1].bitwiseXOR(y[1])) <= far


def linked_images(points: DataFrame, tables: Tables, votes: int, cell: int, far: int) -> DataFrame:
    """Links (a, b) whose components are the classes of images, from their words (node, key, place, low, high)."""
    common = points.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last").select("key", "n")
    listed = points.join(common, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "key", "place", "low", "high"))).alias("p"))

    def rank(batch: pa.RecordBatch) -> dict[str, object]:
        return {"node": batch.column(0), "rare": [rare_words(k, p, votes) for k, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]}

    listed = tables.write(listed.select("node", *[F.col(f"p.{c}").alias(f"{c}s") for c in ("key", "place", "low", "high")]), "listed")
    rare = map_arrow(listed.select("node", "keys", "places"), rank, {"node": "long", "rare": "int"}).where("rare > 0")
    words = tables.write(listed.join(rare, "node"), "words")
    entry = F.explode(F.slice(F.arrays_zip("keys", "lows", "highs"), 1, F.col("rare"))).alias("e")
    has = tables.write(words.select("node", entry).select("node", F.col("e.keys").alias("key"), F.col("e.lows").alias("low"), F.col("e.highs").alias("high")).distinct(), "has")

    def verify(batch: pa.RecordBatch) -> dict[str, object] | None:
        def side(first: int) -> list[np.ndarray]:
            flat = [batch.column(first + k).flatten().to_numpy(zero_copy_only=False) for k in range(4)]
            return [batch.column(first).value_lengths().to_numpy(zero_copy_only=False), *flat[:2], np.stack(flat[2:], axis=1)]

        at = pa.array(agreeing(*matches(*side(2), *side(6), far), votes, cell))
        return {"a": batch.column(0).take(at), "b": batch.column(1).take(at)} if len(at) else None

    def verified(pairs: DataFrame) -> DataFrame:
        names = ("keys", "places", "lows", "highs")
        side = lambda n, mark: words.select(F.col("node").alias(n), *[F.col(c).alias(c + mark) for c in names])
        both = pairs.join(side("a", ""), "a").join(side("b", "2"), "b").select("a", "b", *names, *[f"{c}2" for c in names])
        return tables.write(map_arrow(both, verify, {"a": "long", "b": "long"}), "links")

    pair = [F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")]
    crowd = has.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    standing = has.join(crowd, "key").groupBy("node").agg(F.sum("n").alias("standing"))
    leaders = tables.write(has.join(standing, "node").groupBy("key").agg(F.max(F.struct("standing", "node", "low", "high")).alias("best")).select("key", "best.*"), "leaders")
    led = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") != F.col("y.node")) & _near(far, "x", "y")

    def placed_by(links: DataFrame) -> DataFrame:
        """Keypoints with the components of their images, in buckets of several components."""
        placed = has.join(components(links, tables), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        mixed = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("first"), F.max("comp").alias("last")).where("first <> last")
        return tables.write(placed.join(mixed.select("key", F.ceil(F.col("n") / BLOCK).cast("long").alias("parts")), "key"), "placed")

    # every image with its best leader; with its other leaders in other components; with all others in other components
    best = has.alias("x").join(leaders.alias("y"), led).groupBy("x.node").agg(F.max(F.struct("y.standing", "y.node")).alias("best"))
    tried = tables.write(best.select(F.greatest("node", "best.node").alias("a"), F.least("node", "best.node").alias("b")).distinct(), "tried")
    links = verified(tried)
    placed = placed_by(links)
    head = leaders.join(placed.select("node", F.col("comp").alias("its")).distinct(), "node").alias("y")
    starred = tables.write(placed.alias("x").join(head, led & (F.col("x.comp") != F.col("y.its"))).select(*pair).distinct().join(tried, ["a", "b"], "left_anti"), "starred")
    links = tables.write(links.unionByName(verified(starred)), "links")
    placed = placed_by(links)
    x = placed.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("x")
    y = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).alias("y")
    met = x.join(y, led & (F.col("x.part") == F.col("y.part")) & (F.col("x.comp") < F.col("y.comp"))).select(*pair).distinct()
    return links.unionByName(verified(met.join(tried.union(starred), ["a", "b"], "left_anti")))


def copies(df: DataFrame, content_col: str = "content", id_col: str = "media_id", votes: int = 4, cell: int = 6, far: int = 16) -> DataFrame:
    """media_id, class_id and class_size (rows in the class) of every row."""
    tables = Tables(df.sparkSession)
    media = df.select(F.col(id_col).cast("long").alias("media_id"), F.col(content_col).alias("content"))
    media = media.withColumn("node", F.coalesce(F.xxhash64(F.md5("content")), F.monotonically_increasing_id() - (1 << 62)))

    def words(batch: pa.RecordBatch) -> dict[str, object]:
        owner, keys, places, bits = describe(batch.column(1).to_pylist())
        order = np.argsort(owner, kind="stable")
        n = np.bincount(owner, minlength=batch.num_rows)
        cut = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        many = lambda x: pa.ListArray.from_arrays(cut, pa.array(x[order], pa.int64()))
        return {"media_id": batch.column(0), "node": batch.column(2), "keys": many(keys), "places": many(places), "lows": many(bits[:, 0]), "highs": many(bits[:, 1])}

    described = tables.write(map_arrow(media.select("media_id", "content", "node"), words, {"media_id": "long", "node": "long", "keys": "array<long>", "places": "array<long>", "lows": "array<long>", "highs": "array<long>"}), "described")
    once = described.where("size(keys) > 0").select("node", F.arrays_zip("keys", "places", "lows", "highs").alias("p")).dropDuplicates(["node"])
    points = once.select("node", F.explode("p").alias("p")).select("node", *[F.col(f"p.{c}s").alias(c) for c in ("key", "place", "low", "high")])
    labels = components(linked_images(tables.write(points, "points"), tables, votes, cell, far), tables)
    rows = described.select("media_id", "node").join(labels, "node", "left").select("media_id", F.coalesce("comp", "node").alias("comp"))
    classes = rows.groupBy("comp").agg(F.min("media_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return rows.join(classes, "comp").select("media_id", "class_id", "class_size")


def render(vectors: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", side: int = 48, edited: int = 10) -> DataFrame:
    """A media table made from vectors, as the given tables hold no images: drawings of 48 by 48 points.

    Media 2 x id draws fixed random projections of the vector as light and dark fields; every edited-th id also
    gives media 2 x id + 1, a cropped copy of it with other brightness and contrast.
    """

    cells = 16

    def draw(batch: pa.RecordBatch) -> dict[str, object]:
        ids, out = [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a = np.array([0.0 if x is None else x for x in v or []], np.float64)
            ids.append(None if i is None else 2 * i)
            if not len(a):
                out.append(None)
                continue
            mixed = np.random.default_rng(3).standard_normal((cells * cells, len(a))) @ a
            rank = np.argsort(np.argsort(mixed, kind="stable"), kind="stable").reshape(cells, cells) * (215.0 / (cells * cells - 1)) + 20
            grey = np.kron(rank, np.ones((side // cells, side // cells)))
            out.append(encode(grey))
            if i is not None and i % edited == 0:
                ids.append(2 * i + 1)
                out.append(encode(grey[4:-2, 3:-3] * 0.8 + 25))
        return {"media_id": ids, "content": out}

    return map_arrow(vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")), draw, {"media_id": "long", "content": "binary"})
