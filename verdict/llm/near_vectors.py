"""Near-duplicate vectors: all pairs above a cosine, by dual traversal of a cover tree that is spread over the cluster.

1. Vectors are scaled to unit length. Equal ones are one class with a weight from the start, so copies meet nobody twice.
2. The upper levels of the tree are built in rounds: nodes with more vectors than a cell may hold are split around centres,
   a net of a bounded sample of the node, and every vector goes to its nearest centre. Radii are measured over all vectors.
   A vector is in one cell; a cell takes ``CELL_BYTES``, whatever the size of the group it comes from.
3. Each cell's own cover tree is built in a task (``cover_tree``), which also traverses it against itself.
4. Pairs of nodes descend from the roots in rounds of joins; covering radii prune them. Pairs of cells that remain meet in
   tiles, all pairs of two blocks of cells in a task, by dual traversal of their trees. A task returns weights per class and
   links that join components only. Tiles are dealt over rounds that shuffle about as much as the cells take, or
   ``ROUND_BYTES``; a round's shuffle files go with it, so disk grows with the vectors and not with the pairs of cells.

Nothing is left to chance: the sample tells where cells are cut, not what is compared. The bounds prune vectors whose
groups are apart, as those of texts are; without any structure (independent random directions) triangle bounds in many
dimensions prune next to nothing at this level, and pairs of cells then grow with the square of the vectors.

Defined results: vectors that are null, empty, zero or hold a null, NaN or infinite component are linked with nothing and
are their own component; vectors of different lengths are not linked; rows that share an id are vectors of their own, and
their component is named by the least id; a null id is the last of all. Of the input only the two columns named are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdict.llm import cover_tree
from verdict.llm.common import checkpointed, hinted
from verdict.llm.components import components

#: Bytes of the vectors of a cell; vectors of a node that are looked at to choose its centres; most centres of a node.
CELL_BYTES, SAMPLE, FAN = 4_000_000, 1024, 64
#: Most cells of a block, about; bytes that a round of tiles may shuffle, at least.
BLOCK, ROUND_BYTES = 8, 1_000_000_000
#: Spark's setting by which a query's shuffle files are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Queries made and run within leave no shuffle files."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def unit_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(vec_id, h, d, x) of (vec_id, embedding): the unit vector's bytes, their 128-bit hash, the length; null if invalid."""
    column = batch.column(1)
    sizes = [0 if s is None else s for s in column.value_lengths().to_pylist()]
    flat = column.flatten()
    ends, missing = np.cumsum(sizes), flat.is_null().to_numpy(zero_copy_only=False)
    values = np.array(flat.fill_null(0).to_numpy(zero_copy_only=False), np.float64)
    values[missing] = np.nan
    found: list[bytes | None] = [None] * len(sizes)
    for size in set(sizes) - {0}:
        rows = np.flatnonzero(np.array(sizes) == size)
        x = values[(ends[rows] - size)[:, None] + np.arange(size)]
        largest = np.abs(x).max(1)
        valid = np.isfinite(largest) & (largest > 0)
        x = x[valid] / largest[valid, None]
        x = x / np.sqrt((x * x).sum(1))[:, None] + 0.0
        for k, row in zip(rows[valid].tolist(), x):
            found[k] = row.tobytes()
    hashes = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in found]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(found, pa.binary())], ["vec_id", "h", "d", "x"])


def unit_vectors(vectors: DataFrame, key: str, value: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield unit_rows(batch)

    return vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{value}`").cast("array<double>").alias("x")).mapInArrow(run, "vec_id long, h binary, d int, x binary")


def matrix(rows: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows.to_pylist()), np.float64).reshape(-1, d)


ROW = "h binary, d int, x binary, weight long, node string, parent string, far double, open boolean"


def split(rows: DataFrame, level: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """One round: ``rows`` (of ``ROW``) after it, the nodes that it found open, and the centres of those that it split.

    ``open`` marks the rows of nodes that the round before has made; ``far`` is the distance to the node's centre.
    """
    per_cell = F.greatest(F.lit(64), F.floor(F.lit(CELL_BYTES) / (F.col("d") * 8))).cast("long")
    sizes = rows.where("open").groupBy("node", "d").agg(F.count("*").alias("n"), F.first("parent").alias("parent"), F.max("far").alias("radius"))
    nodes = checkpointed(sizes.withColumn("parts", F.ceil(F.col("n") / per_cell).cast("int")))
    large = nodes.where("parts > 1").select(F.col("node").alias("at"), "n", "parts")
    if large.isEmpty():
        return rows, nodes, None
    order = F.pmod(F.xxhash64("h", F.lit(level)), F.lit(1 << 40))
    sample = rows.join(hinted(large), F.col("node") == F.col("at")).where(order < F.lit(float(SAMPLE << 40)) / F.col("n"))

    def centres(part: pa.Table) -> pa.Table:
        d, want = part.column("d")[0].as_py(), min(FAN, 2 * part.column("parts")[0].as_py())
        hashes = part.column("h").to_pylist()
        points = matrix(part.column("x").take(pa.array(sorted(range(len(hashes)), key=hashes.__getitem__))), d)
        # Twice as many centres as cells are needed, of a net whose radius is halved until it has as many.
        radius, chosen = 1.0, np.zeros(1, np.int64)
        while len(chosen) < want and radius > 4 * cover_tree.SLACK:
            chosen = np.unique(cover_tree.net(points, radius), return_index=True)[1]
            radius /= 2
        found = [x.tobytes() for x in points[chosen[:want]]]
        return pa.table({"at": part.column("node").slice(0, 1), "centres": pa.array([found if len(found) > 1 else found * want], pa.list_(pa.binary()))})

    chosen = checkpointed(sample.select("node", "h", "d", "x", "parts").groupBy("node").applyInArrow(centres, "at string, centres array<binary>"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, far = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            held = batch.column("at").dictionary_encode()
            codes = held.indices.to_numpy(zero_copy_only=False)
            for k in range(len(held.dictionary)):
                own = np.flatnonzero(codes == k)
                d, middle = batch.column("d")[own[0]].as_py(), batch.column("centres")[own[0]].as_py()
                cosines = matrix(batch.column("x").take(pa.array(own)), d) @ matrix(pa.array(middle), d).T
                number[own], far[own] = cosines.argmax(1), cover_tree.distance(cosines.max(1))
                if len(set(middle)) == 1:  # one direction but for the last bits: any cut will do
                    number[own] = [(int.from_bytes(h) >> 6 * level) % len(middle) for h in batch.column("h").take(pa.array(own)).to_pylist()]
            names = pa.array([f"{a}/{k}" for a, k in zip(batch.column("at").to_pylist(), number.tolist())], pa.string())
            kept = [batch.column(c) for c in ("h", "d", "x", "weight")]
            yield pa.RecordBatch.from_arrays([*kept, names, batch.column("at"), pa.array(far), pa.array([True] * len(far), pa.bool_())], ["h", "d", "x", "weight", "node", "parent", "far", "open"])

    moved = rows.join(hinted(chosen), F.col("node") == F.col("at")).mapInArrow(assign, ROW)
    kept = rows.join(hinted(chosen.select("at")), F.col("node") == F.col("at"), "left_anti").withColumn("open", F.lit(False))
    made = chosen.select("at", F.posexplode("centres").alias("k", "centre")).select(F.concat_ws("/", "at", "k").alias("node"), "centre")
    return checkpointed(moved.unionByName(kept)), nodes, made


def cell_pairs(nodes: DataFrame, depth: int, least: float) -> DataFrame:
    """(a, b): the pairs of different cells that the covering radii leave, by descent from the roots.

    ``nodes`` has node, parent, d, radius, centre and leaf; a root has no parent and no centre.
    """
    reach = float(np.sqrt(2 - 2 * least)) + 10 * cover_tree.SLACK
    own = nodes.select(F.col("node").alias("up"), F.col("node").alias("kid"), "d", "radius", "centre").where("leaf")
    kids = checkpointed(own.unionByName(nodes.where("parent IS NOT NULL").select(F.col("parent").alias("up"), F.col("node").alias("kid"), "d", "radius", "centre")))
    pairs = nodes.where("parent IS NULL").select(F.col("node").alias("a"), F.col("node").alias("b"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for k, (x, y, r, s) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("one", "two", "r", "s")))):
                if x is not None and y is not None:
                    keep[k] = np.linalg.norm(np.frombuffer(x, np.float64) - np.frombuffer(y, np.float64)) - r - s <= reach
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    for _ in range(depth):
        one = kids.select(F.col("up").alias("a"), F.col("kid").alias("x"), F.col("radius").alias("r"), F.col("centre").alias("one"))
        two = kids.select(F.col("up").alias("b"), F.col("kid").alias("y"), F.col("radius").alias("s"), F.col("centre").alias("two"))
        met = pairs.join(hinted(one), "a").join(hinted(two), "b").where("a <> b OR x <= y")
        pairs = checkpointed(met.select(F.col("x").alias("a"), F.col("y").alias("b"), "r", "s", "one", "two").mapInArrow(near, "a string, b string"))
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


CELL = "node string, hashes binary, points binary, weights binary, nodes binary, radii binary, counts binary, labels binary"
FOUND = "h binary, other binary, n long"


def packed_cells(rows: DataFrame, least: float) -> DataFrame:
    """(of ``CELL``) a row per cell: its tree, and what the tree's traversal against itself has found."""

    def pack(part: pa.Table) -> pa.Table:
        d, hashes = part.column("d")[0].as_py(), part.column("h").to_pylist()
        tree = cover_tree.build(matrix(part.column("x"), d))
        weights = np.array(part.column("weight").to_pylist(), np.int64)[tree.order]
        links = cover_tree.Links(weights)
        cover_tree.traverse(tree, None, least, links)
        nodes = np.stack([tree.start, tree.stop, tree.first, tree.last])
        values = [b"".join(hashes[k] for k in tree.order), *(x.tobytes() for x in (tree.points, weights, nodes, tree.radius, links.total(), links.labels))]
        names = ["hashes", "points", "weights", "nodes", "radii", "counts", "labels"]
        return pa.table({"node": part.column("node").slice(0, 1)} | {name: pa.array([value], pa.binary()) for name, value in zip(names, values)})

    return rows.select("node", "h", "d", "x", "weight").groupBy("node").applyInArrow(pack, CELL)


def found_rows(hashes: list[bytes], counts: np.ndarray, u: np.ndarray, v: np.ndarray) -> pa.Table:
    some = np.flatnonzero(counts)
    one = [hashes[k] for k in some.tolist()] + [hashes[k] for k in u.tolist()]
    return pa.table({"h": pa.array(one, pa.binary()), "other": pa.array([None] * len(some) + [hashes[k] for k in v.tolist()], pa.binary()), "n": pa.array(counts[some].tolist() + [0] * len(u), pa.int64())})


def unpacked(row: dict) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    raw = row["hashes"]
    return [raw[k : k + 16] for k in range(0, len(raw), 16)], *(np.frombuffer(row[c], np.int64) for c in ("weights", "counts", "labels"))


def within_cells(cells: DataFrame) -> DataFrame:
    """(of ``FOUND``) weights linked to each class of its own cell, and a link from each class to the first of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, _, counts, labels = unpacked(row)
                moved = np.flatnonzero(labels != np.arange(len(labels)))
                yield from found_rows(hashes, counts, moved, labels[moved]).to_batches()

    return cells.select("hashes", "weights", "counts", "labels").mapInArrow(run, FOUND)


def between_cells(cells: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """(of ``FOUND``) the same of pairs of cells; links are only those that join groups of the two cells."""
    n = cells.count()
    blocks = -(-n // max(1, min(BLOCK, n // 12)))
    one, two = (F.pmod(F.xxhash64(c), F.lit(max(1, blocks))) for c in "ab")
    tiled = checkpointed(pairs.select("a", "b", F.least(one, two).alias("p"), F.greatest(one, two).alias("q")))
    ends = checkpointed(tiled.select(F.col("p").alias("i"), F.col("q").alias("j"), F.explode(F.array("a", "b")).alias("node")).distinct())
    rounds = max(1, -(-ends.count() * CELL_BYTES // max(ROUND_BYTES, n * CELL_BYTES)))
    turn = lambda p, q: F.pmod(F.xxhash64(q, p), F.lit(rounds))

    def tree(row: dict, n: int) -> cover_tree.Tree:
        return cover_tree.Tree(np.frombuffer(row["points"], np.float64).reshape(n, -1), np.arange(n), *np.frombuffer(row["nodes"], np.int64).reshape(4, -1), np.frombuffer(row["radii"], np.float64))

    def meet(one: dict, two: dict) -> pa.Table:
        (h, w, _, x), (g, v, _, y) = unpacked(one), unpacked(two)
        before = np.concatenate([x, y + len(h)])
        links = cover_tree.Links(np.concatenate([w, v]), before)
        cover_tree.traverse(tree(one, len(h)), tree(two, len(g)), least, links)
        # Of each group as it was before, its first class tells what it has been joined to.
        moved = np.flatnonzero((before == np.arange(len(before))) & (links.labels != before))
        return found_rows(h + g, links.total(), moved, links.labels[moved])

    def tile(held: pa.Table, todo: pa.Table) -> pa.Table:
        rows = {row["node"]: row for row in held.to_pylist()}
        return pa.concat_tables([meet(rows[a], rows[b]) for a, b in zip(todo.column("a").to_pylist(), todo.column("b").to_pylist())])

    found = []
    for k in range(rounds):
        held = cells.join(hinted(ends.where(turn("i", "j") == k)), "node").groupBy("i", "j")
        found.append(checkpointed(held.cogroup(tiled.where(turn("p", "q") == k).groupBy("p", "q")).applyInArrow(tile, FOUND)))
    return reduce(DataFrame.unionByName, found)


def near_vectors(vectors: DataFrame, least: float = 0.95, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors``: how many other vectors have a cosine of ``least`` or
    more with it, the least id that links reach, and whether that is its own."""
    with released(vectors.sparkSession):
        rows, named = linked(unit_vectors(vectors, key, value), least)
    out = rows.join(named, F.col("h") == F.col("class"), "left")
    component = F.when(F.col("h").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def linked(units: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(vec_id, h) of all vectors, and (class, n_links, component_id) of all classes of equal ones."""
    rows = checkpointed(units.select("vec_id", "h"))
    classes = units.where("h IS NOT NULL").groupBy("h").agg(F.first("d").alias("d"), F.first("x").alias("x"), F.count("*").alias("weight"), F.min("vec_id").alias("least_id"))
    classes = checkpointed(classes)
    root = F.col("d").cast("string")
    placed = classes.select("h", "d", "x", "weight", root.alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(2.0).alias("far"), F.lit(True).alias("open"))
    levels, made = [], []
    while not made or made[-1] is not None:
        placed, nodes, centres = split(placed, len(levels))
        levels.append(nodes)
        made.append(centres)
    nodes = reduce(DataFrame.unionByName, levels)
    centred = reduce(DataFrame.unionByName, [m for m in made if m is not None], nodes.select("node", F.lit(None).cast("binary").alias("centre")).where("parent IS NULL"))
    nodes = nodes.join(centred, "node").select("node", "parent", "d", "radius", "centre", (F.col("parts") <= 1).alias("leaf"))

    cells = checkpointed(packed_cells(placed, least))
    pairs = cell_pairs(checkpointed(nodes), len(levels) - 1, least)
    found = checkpointed(within_cells(cells).unionByName(between_cells(cells, pairs, least)))
    roots = components(found.where("other IS NOT NULL").select(F.col("h").alias("u"), F.col("other").alias("v")))
    counted = found.where("other IS NULL").groupBy("h").agg(F.sum("n").alias("n"))
    named = classes.select("h", "weight", "least_id").join(counted, "h", "left").join(roots.withColumnRenamed("node", "h"), "h", "left")
    named = checkpointed(named.select("h", "weight", "least_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "h").alias("root")))
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rows, checkpointed(named.join(ids, "root").select(F.col("h").alias("class"), (F.col("weight") - 1 + F.col("n")).alias("n_links"), "component_id"))
