"""Embedding near-dedup by PCA-ordered tiled comparison.

Equal vectors of a label are one class with a count; classes are compared. Their unit vectors are rotated to the principal axes of the table
(the eigenvectors of its d x d second moments, summed in the tasks), so that the leading dimensions carry most of each product. Classes are sorted by label and
first axis and cut into tiles of at most ``tile_rows``. Two tiles of a label are compared unless the boxes around them on the leading axes lie so far
apart that no pair can reach the threshold. A comparison adds up products of the leading dimensions first; a pair goes as soon as its partial product plus the
product of both suffix norms (Cauchy-Schwarz) stays below the threshold, and what is left of all dimensions is decided by the cosine of the original
vectors in double precision. The rotation, the boxes and the stops change no result: their bounds have a slack of ``SLACK``.

A comparison gives back, for each class that has a link, the number of vectors it links with and its root in the comparison's own forest: at most as many rows as
both tiles have, however many pairs link. Links are summed, forests are joined to components. Work grows with the square of the largest label
where boxes do not tell tiles apart, which an exact comparison cannot avoid; a label's tiles are compared in as many tasks as they have pairs.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components, a null label or a null vec_id links with nothing
(n_links 0, component_id its own vec_id). Vectors of different lengths do not link. Repeated rows are vectors of their own: equal ones link, and each is returned.
kept is false where vec_id is null. Empty table: no rows. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import stage_table
from .components import components

SLACK = 1e-9
#: Leading dimensions after which pairs are dropped, axes of a tile's box, rows of a block, pairs looked at together.
STOPS, BOX, BLOCK, CHUNK = (8, 16, 32, 64, 128, 256, 512), 16, 512, 1 << 18
#: Share of a block's pairs from which the rest of the products is taken at once.
DENSE = 0.1


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rows_of(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def by_length(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    lengths = np.asarray(b.column(column).value_lengths())
    for d in np.unique(lengths):
        yield b.take(pa.array(np.flatnonzero(lengths == d)))


def axes(classes: DataFrame, sample_lengths: int = 4) -> dict[int, np.ndarray]:
    """The principal axes, largest first, of the unit vectors of the most frequent lengths; other lengths are compared on the axes they have."""
    frequent = [r["d"] for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(sample_lengths).collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part in by_length(b, 0):
                x = unit(rows_of(part.column(0)))
                total[x.shape[1]] = total.get(x.shape[1], 0) + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([m.ravel().tolist() for m in total.values()], pa.list_(pa.float64()))], names=["d", "m"])

    parts = classes.where(F.size("v").isin(frequent)).select("v").mapInArrow(run, "d int, m array<double>")
    # d * d numbers for each of a few lengths, however many tasks there are
    got = parts.select("d", F.posexplode("m").alias("at", "m")).groupBy("d", "at").agg(F.sum("m").alias("m")).toPandas()
    out = {}
    for d, g in got.groupby("d"):
        m = g.sort_values("at").m.to_numpy().reshape(d, d)
        out[int(d)] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]
    return out


def rotated(x: np.ndarray, turn: dict[int, np.ndarray]) -> np.ndarray:
    """Unit vectors on the principal axes."""
    r = turn.get(x.shape[1])
    return unit(x) if r is None else unit(x) @ r


def classes_of(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(node, h1, h2, label, v, n, least): the distinct vectors of each label that can link, with their number and smallest key."""
    v = F.col(vector)
    sound = v.isNotNull() & F.col(label).isNotNull() & F.col(key).isNotNull() & F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(sound).select(*hashes(vector, label), F.col(label).alias("label"), v.alias("v"), F.col(key).alias("key"))
    same = rows.groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("n"), F.min("key").alias("least"))
    return stage_table(same.withColumn("node", F.monotonically_increasing_id()), "classes")


def hashes(vector: str, label: str) -> list:
    """128 bits that name a vector of a label; -0.0 counts as 0.0."""
    v = F.transform(F.col(vector), lambda x: x + 0.0)
    return [F.xxhash64(v, label).alias("h1"), F.xxhash64(F.lit("class"), label, v).alias("h2")]


def tiles_of(classes: DataFrame, turn: dict[int, np.ndarray], tile_rows: int) -> DataFrame:
    """(tile, label, d, nodes, counts, v, low, high): at most tile_rows classes of a label and length, neighbours on the first axis."""
    kind, stored = classes.schema["label"].dataType.simpleString(), stored_as(classes)
    n = classes.count()

    def first_axis(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_length(b, 3):
                z = rotated(rows_of(part.column(3)), turn)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(z), z.shape[1]), pa.int32()), pa.array(z[:, 0])], names=["node", "n", "label", "v", "d", "z"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[pa.RecordBatch] = []
        pid, made = TaskContext.get().partitionId(), 0

        def out() -> pa.RecordBatch:
            nonlocal made
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            x = rows_of(t.column(3))
            z = rotated(x, turn)[:, :BOX]
            made += 1
            one = lambda a, kind: pa.array([a], kind)
            return pa.RecordBatch.from_arrays(
                [one((pid << 32) + made, pa.int64()), t.column(2).slice(0, 1), t.column(4).slice(0, 1), one(t.column(0), pa.list_(pa.int64())), one(t.column(1), pa.list_(pa.int64())), one(x.astype(stored).tobytes(), pa.binary()), one(z.min(0), pa.list_(pa.float64())), one(z.max(0), pa.list_(pa.float64()))],
                names=["tile", "label", "d", "nodes", "counts", "v", "low", "high"],
            )

        for b in batches:
            labels, d = b.column(2).to_pylist(), b.column(4).to_pylist()
            at = 0
            while at < len(labels):
                end = at
                full = tile_rows - sum(h.num_rows for h in held)
                if held and (held[0].column(2)[0].as_py(), held[0].column(4)[0].as_py()) != (labels[at], d[at]) or full <= 0:
                    yield out()
                    held.clear()
                    full = tile_rows
                while end < len(labels) and end - at < full and (labels[end], d[end]) == (labels[at], d[at]):
                    end += 1
                held.append(b.slice(at, end - at))
                at = end
        if held:
            yield out()

    with_axis = classes.select("node", "n", "label", "v").mapInArrow(first_axis, f"node bigint, n bigint, label {kind}, v {classes.schema['v'].dataType.simpleString()}, d int, z double")
    ranges = with_axis.repartitionByRange(max(1, -(-n // tile_rows)), "label", "d", "z", "node").sortWithinPartitions("label", "d", "z", "node")
    return stage_table(ranges.mapInArrow(pack, f"tile bigint, label {kind}, d int, nodes array<bigint>, counts array<bigint>, v binary, low array<double>, high array<double>"), "tiles")


def stored_as(classes: DataFrame) -> type:
    """How tiles hold components: floats as they are, others as doubles."""
    return np.float32 if classes.schema["v"].dataType.elementType == FloatType() else np.float64


def suffixes(z: np.ndarray, stops: list[int]) -> np.ndarray:
    """Norms of what is left of each row after each stop."""
    left = np.cumsum((z * z)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.stack([left[:, s] for s in stops], axis=1)) if stops else np.zeros((len(z), 0))


def close_pairs(x: np.ndarray, y: np.ndarray, zx: np.ndarray, zy: np.ndarray, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of x and y with a cosine of least or more, i < j if both are the same tile, some at a time.

    z are the unit vectors on the principal axes.
    """
    d = x.shape[1]
    stops = [s for s in STOPS if s < d]
    sx, sy = suffixes(zx, stops), suffixes(zy, stops)
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    first = stops[0] if stops else d
    for top in range(0, len(x), BLOCK):
        rows = slice(top, top + BLOCK)
        partial = zx[rows, :first] @ zy[:, :first].T
        reach = partial + sx[rows, :1] * sy[:, 0] if stops else partial
        alive = reach >= least - SLACK
        if np.count_nonzero(alive) > DENSE * alive.size:
            # a crowd: one product of whole vectors is less work than many single ones
            i, j = np.nonzero((x[rows] @ y.T) / (nx[rows, None] * ny) >= least)
            upper = slice(None) if not same else i + top < j
            if len(i[upper]):
                yield i[upper] + top, j[upper]
            continue
        i, j = np.nonzero(alive)
        if same:
            upper = i + top < j
            i, j = i[upper], j[upper]
        for at in range(0, len(i), CHUNK):
            a, b = i[at : at + CHUNK], j[at : at + CHUNK]
            p = partial[a, b]
            a = a + top
            for k, stop in enumerate(stops[1:], 1):
                p = p + np.einsum("ij,ij->i", zx[a, stops[k - 1] : stop], zy[b, stops[k - 1] : stop])
                alive = p + sx[a, k] * sy[b, k] >= least - SLACK
                a, b, p = a[alive], b[alive], p[alive]
            if stops:
                p = p + np.einsum("ij,ij->i", zx[a, stops[-1] :], zy[b, stops[-1] :])
                alive = p >= least - SLACK
                a, b = a[alive], b[alive]
            sure = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b]) >= least
            if sure.any():
                yield a[sure], b[sure]


def merge(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a forest (roots: the root of each place) that pairs link; the smallest place is the root."""
    while True:
        ra, rb = roots[a], roots[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(roots, np.maximum(ra, rb), np.minimum(ra, rb))
        while (roots[roots] != roots).any():
            roots[:] = roots[roots]


def compare(tiles: DataFrame, turn: dict[int, np.ndarray], least: float, stored: type = np.float64) -> DataFrame:
    """(node, links, root): a row for each class of two tiles that has a link, root being the smallest class it reaches by the links of both."""
    box = tiles.select("tile", "label", "d", "low", "high")
    a, b = (box.withColumnsRenamed({c: f"{c}_{s}" for c in ("tile", "low", "high")}) for s in "ab")
    apart = F.aggregate(F.zip_with(F.zip_with("low_a", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))), F.lit(0.0), lambda s, g: s + g * g)
    # the squared distance of unit vectors is 2 - 2 cos
    pairs = a.join(b, ["label", "d"]).where((F.col("tile_a") <= F.col("tile_b")) & (apart <= 2 - 2 * least + SLACK)).select("tile_a", "tile_b")
    side = lambda s: tiles.select(F.col("tile").alias(f"tile_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("d", "nodes", "counts", "v")])
    both = pairs.join(side("a"), "tile_a").join(side("b"), "tile_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k] for n in batch.schema.names}
                same, d = row["tile_a"].as_py() == row["tile_b"].as_py(), row["d_a"].as_py()
                x, y = (np.frombuffer(row[f"v_{s}"].as_buffer(), stored).astype(np.float64).reshape(-1, d) for s in "ab")
                nodes, counts = ([np.asarray(row[f"{c}_{s}"].values) for s in "ab"] for c in ("nodes", "counts"))
                zx = rotated(x, turn)
                zy = zx if same else rotated(y, turn)
                shift = 0 if same else len(x)
                node, count = (p[0] if same else np.concatenate(p) for p in (nodes, counts))
                links, roots = np.zeros(len(node), np.int64), np.arange(len(node))
                for i, j in close_pairs(x, y, zx, zy, least, same):
                    j = j + shift
                    np.add.at(links, i, count[j])
                    np.add.at(links, j, count[i])
                    merge(roots, i, j)
                at = np.flatnonzero(links)
                # the root by node, not by place
                low = np.full(len(node), np.iinfo(np.int64).max)
                np.minimum.at(low, roots, node)
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(links[at]), pa.array(low[roots[at]])], names=["node", "links", "root"])

    # a pair of tiles is a row, and work for a task
    dealt = both.select("tile_a", "tile_b", "d_a", "nodes_a", "counts_a", "v_a", "nodes_b", "counts_b", "v_b")
    return stage_table(dealt.mapInArrow(run, "node bigint, links bigint, root bigint"), "links")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93, tile_rows: int = 4096) -> DataFrame:
    """(key, n_links, component_id, kept) for each row."""
    classes = classes_of(vectors, key, vector, label)
    turn = axes(classes)
    links = compare(tiles_of(classes, turn, tile_rows), turn, least, stored_as(classes))
    linked = links.groupBy("node").agg(F.sum("links").alias("links"))
    root = components(links.where("node != root").select("node", "root"), "node", "root")
    reached = root.join(classes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component_id"))
    found = classes.select("node", "h1", "h2", F.col("n"), "least").join(linked, "node", "left").join(root, "node", "left").join(reached, "root", "left")
    # a row for each class; a class with many copies is one row on this side
    known = found.select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    usable = F.col(label).isNotNull() & F.col(key).isNotNull() & F.col(vector).isNotNull()
    h1, h2 = hashes(vector, label)
    # what cannot link meets no class, and is dealt out evenly
    rows = vectors.select(F.col(key).alias("k"), F.when(usable, h1).otherwise(F.monotonically_increasing_id()).alias("h1"), F.when(usable, h2).otherwise(F.lit(0)).alias("h2"))
    own = F.coalesce("component_id", "k")
    return rows.join(known, ["h1", "h2"], "left").select(F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("k") == own, F.lit(False)).alias("kept"))
