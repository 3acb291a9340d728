"""Vector codes (product quantisation) by Lloyd's rounds over cover trees.

A vector is cut into equal parts; a part's code is the nearest entry of its position's codebook. Components are integers,
``floor(scale * x)``, so distances, sums and means are exact and the same on any number of tasks.

Each task packs its rows into blocks of at most ``block`` vectors and builds a cover tree of every block and part
position: a node covers all points of its subtree within its radius, its first child has its own centre, the centres of
siblings lie apart by more than the radius that children are built with, and that radius halves from level to level.
Points are stored in the order of the tree, so a subtree is a run of them and its sum is the difference of two
cumulative sums. The trees are written once, in the shared folder; a lost executor's blocks are read again.

A round broadcasts the codebooks (``entries`` vectors, whatever the number of rows) and walks each tree from its root. At
a node of radius r whose centre is d from the nearest entry, an entry beyond ``d + 2 r`` is farther from every point of
the subtree. Where all others are beyond, the whole subtree goes to the nearest entry, by cumulative sum; only the
children of the other nodes are compared, down to leaves, whose points coincide and are compared exactly. So very many
copies of one vector cost one comparison a block. The sums of a task leave it as one row for each used entry, and the
driver reads one row an entry and part.

Defined cases: vectors that are null, or hold null or non-finite components, are dropped; vectors shorter than the
longest, and lengths that ``parts`` does not divide, are filled with zeros; vectors of no component have error 0; a null id
comes after all others, and rows that share an id are ordered by their components; with fewer rows than ``entries`` the
codebooks are smaller; an empty table gives an empty result, with the digest of empty codebooks. Components are held to
the magnitude up to which the error of a vector fits a long (about 185,000 for 64 components and a scale of 1,024).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.llm.common import map_arrow, saved


@dataclass(frozen=True)
class Settings:
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    block: int = 2048  # vectors of a tree


#: distances in floating point are right to a part in 2**50; bounds are widened by more
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def bound(width: int) -> int:
    """The largest component at which squared distances of so many components fit 63 bits."""
    return int(math.isqrt(2**61 // max(1, width)))


def integers(lists: pa.Array, width: int, scale: int) -> np.ndarray:
    """One row of integer components a vector, filled with zeros up to ``width``."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    most = bound(width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = np.clip(flat, -most, most).astype(np.int64)
    return out


# ---- cover trees ----
def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to all rows of ``b``: doubles where these hold every product and sum,
    else integers."""
    most = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if 4 * most * most * a.shape[1] < 2**53:
        x, y = a.astype(np.float64), b.astype(np.float64)
        out = x @ (-2.0 * y.T)
        out += np.einsum("ij,ij->i", x, x)[:, None]
        out += np.einsum("ij,ij->i", y, y)
        return out
    out = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):
        out += (a[:, k, None] - b[None, :, k]) ** 2
    return out


@dataclass
class Tree:
    """Nodes in order of levels: a node's points are ``order[start:end]``, of which the first is its centre; its children
    are the nodes ``[child, child + children)``."""

    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray


#: rows that may become centres at a time
CENTRES = 32


def _children(points: np.ndarray, own: np.ndarray, cover: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The points ``own`` dealt to centres that lie apart by more than ``cover``, the first of them ``own[0]``: the points
    in order of their centres, each centre first; where each centre's run starts; and squared distances to it."""
    squared_cover = cover * cover
    runs, starts, far, at = [], [], [], 0
    while len(own):
        near = _squared(points[own], points[own[:CENTRES]])
        among = near[:CENTRES] <= squared_cover
        taken: list[int] = []
        for j in range(near.shape[1]):
            if not among[j, taken].any():
                taken.append(j)
        near = near[:, taken]
        nearest = near.argmin(1)
        distance = near[np.arange(len(own)), nearest]
        inside = np.flatnonzero(distance <= squared_cover)
        # Centres have distance 0 and stand before what else has.
        inside = inside[np.lexsort((inside, distance[inside], nearest[inside]))]
        runs.append(own[inside])
        far.append(distance[inside])
        starts.append(at + np.searchsorted(nearest[inside], np.arange(len(taken))))
        at += len(inside)
        left = np.ones(len(own), bool)
        left[inside] = False
        own = own[left]
    return np.concatenate(runs), np.concatenate(starts), np.concatenate(far)


def build(points: np.ndarray) -> Tree:
    """The cover tree of at least one point. A node whose points coincide is a leaf."""
    n = len(points)
    order = np.arange(n)
    reach = math.sqrt(float(_squared(points, points[:1]).max()))
    start, end, radius = [np.zeros(1, np.int64)], [np.full(1, n)], [np.array([reach])]
    inner, nodes = [], 1
    # Nodes with points that differ: number, run, radius, and the radius that children are built with.
    level = [(0, 0, n, reach, reach / 2)] if reach else []
    while level:
        below = []
        for node, a, b, reach, cover in level:
            # A centre parts its points only with a radius below its own.
            while cover >= reach * (1 - SLACK):
                cover /= 2
            order[a:b], starts, far = _children(points, order[a:b], cover)
            ends = np.append(starts[1:], b - a)
            own = np.sqrt(np.maximum.reduceat(far, starts).astype(np.float64))
            inner.append((node, nodes, len(starts)))
            for k in np.flatnonzero(own):
                below.append((nodes + int(k), a + int(starts[k]), a + int(ends[k]), float(own[k]), cover / 2))
            start.append(a + starts), end.append(a + ends), radius.append(own)
            nodes += len(starts)
        level = below
    child, children = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    if inner:
        at, first, count = np.array(inner, np.int64).T
        child[at], children[at] = first, count
    return Tree(order, np.concatenate(start), np.concatenate(end), np.concatenate(radius), child, children)


def assign(tree: Tree, points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, int]:
    """The runs ``(start, end, entry)`` of the tree's order that go to an entry as a whole, and how many nodes were compared.
    ``points`` are in the tree's order; ties go to the lower entry."""
    runs, compared = [], 0
    nodes = np.zeros(1, np.int64)
    while len(nodes):
        squared, reach = _squared(points[tree.start[nodes]], book), tree.radius[nodes]
        compared += len(nodes)
        best = squared.argmin(1)
        nearest = np.sqrt(squared[np.arange(len(nodes)), best].astype(np.float64))
        limit = (nearest + 2.0 * reach) ** 2 * (1 + SLACK) + SLACK
        sure = (reach == 0.0) | ((squared <= limit[:, None]).sum(1) == 1)
        runs.append(np.stack([tree.start[nodes[sure]], tree.end[nodes[sure]], best[sure]], axis=1))
        open_ = nodes[~sure]
        count = tree.children[open_]
        # The children of all nodes that are not sure, run after run.
        nodes = np.repeat(tree.child[open_] - np.cumsum(count) + count, count) + np.arange(count.sum())
    return np.concatenate(runs), compared


# ---- blocks: a row holds the ids and labels of up to ``block`` vectors and the trees of their parts ----
_ARRAYS = ("order", "start", "end", "radius", "child", "children")


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as reader:
        return reader.read_next_batch()


def _stored(tree: Tree, points: np.ndarray) -> bytes:
    whole_numbers = {name: getattr(tree, name).astype(np.int32) for name in _ARRAYS if name != "radius"}
    columns = {"points": points[tree.order].astype(np.int32).ravel(), **whole_numbers, "radius": tree.radius}
    return _packed(pa.RecordBatch.from_arrays([pa.array([x]) for x in columns.values()], list(columns)))


def _loaded(data: bytes, width: int) -> tuple[Tree, np.ndarray]:
    batch = _unpacked(data)
    found = {name: batch.column(name)[0].values.to_numpy() for name in batch.schema.names}
    points = found.pop("points").astype(np.int64).reshape(len(found["order"]), width)
    return Tree(*(found[x] if x == "radius" else found[x].astype(np.int64) for x in _ARRAYS)), points


def _blocks(rows: DataFrame, width: int, settings: Settings) -> DataFrame:
    """The trees of ``rows``, whose last column is the vector, and their other columns, block by block."""
    own = width // settings.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            vectors = integers(table.column(table.num_columns - 1), width, settings.scale)
            parts = [np.ascontiguousarray(vectors[:, k * own : (k + 1) * own]) for k in range(settings.parts)]
            carried = _packed(table.select(table.schema.names[:-1]))
            columns = [pa.array([carried], pa.binary()), pa.array([[_stored(build(p), p) for p in parts]], pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, ["carried", "trees"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, settings.block - sum(b.num_rows for b in held)))
                at += held[-1].num_rows
                if sum(b.num_rows for b in held) == settings.block:
                    yield block()
                    held = []
        if held:
            yield block()

    return map_arrow(rows, run, "carried binary, trees array<binary>")


def _sums(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """``(part, entry, n, s0, s1, …)``: number and sums of the points that each entry is nearest to."""
    shared, own = blocks.sparkSession.sparkContext.broadcast(books), books.shape[2]
    names = [f"s{k}" for k in range(own)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        count = np.zeros(books.shape[:2], np.int64)
        # Components are below 2**31: the sums of fewer than 2**32 rows of a task fit.
        total = np.zeros(books.shape, np.int64)
        for batch in batches:
            for trees in batch.column(0).to_pylist():
                for k, data in enumerate(trees):
                    tree, points = _loaded(data, own)
                    upto = np.concatenate([np.zeros((1, own), np.int64), np.cumsum(points, axis=0)])
                    start, end, entry = assign(tree, points, books[k])[0].T
                    np.add.at(count[k], entry, end - start)
                    np.add.at(total[k], entry, upto[end] - upto[start])
        part, entry = np.nonzero(count)
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry])]
        columns += [pa.array(total[part, entry, k]) for k in range(own)]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", *names])

    found = map_arrow(blocks.select("trees"), run, ", ".join(["part int, entry int, n bigint", *(f"{s} bigint" for s in names)]))
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col(s).cast("decimal(20,0)")).alias(s) for s in names))


def _moved(books: np.ndarray, sums: DataFrame) -> np.ndarray:
    """The codebooks after a round. Reads one row for each entry and part that has points."""
    books = books.copy()
    for part, entry, n, *total in sums.collect():
        books[part, entry] = [int(s) // int(n) for s in total]
    return books


def _codes(blocks: DataFrame, books: np.ndarray, schema: str) -> DataFrame:
    """What the blocks carry with the code and the error of each vector."""
    shared, own = blocks.sparkSession.sparkContext.broadcast(books), books.shape[2]
    digits = max(2, len(f"{max(0, books.shape[1] - 1):x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        written = np.array([f"{e:0{digits}x}" for e in range(books.shape[1])], object)
        for batch in batches:
            for carried, trees in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = _unpacked(carried)
                error, code = np.zeros(rows.num_rows, np.int64), np.full(rows.num_rows, "", object)
                for k, data in enumerate(trees):
                    tree, points = _loaded(data, own)
                    start, end, entry = assign(tree, points, books[k])[0].T
                    of = np.empty(rows.num_rows, np.int64)
                    in_order = np.argsort(start)
                    of[tree.order] = np.repeat(entry[in_order], (end - start)[in_order])
                    code += written[of]
                    error[tree.order] += ((points - books[k][of[tree.order]]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(code, pa.string()), pa.array(error)], [*rows.schema.names, "code", "error"])

    return map_arrow(blocks, run, f"{schema}, code string, error bigint")


def fit(vectors: DataFrame, width: int, settings: Settings, blocks: DataFrame) -> np.ndarray:
    """The codebooks ``[part, entry, component]`` after all rounds; ``vectors`` has ``id`` and ``v``."""
    first = vectors.orderBy(F.asc_nulls_last("id"), "v").limit(settings.entries).select("v").toArrow()
    start = integers(first.column(0).combine_chunks(), width, settings.scale)
    books = np.ascontiguousarray(start.reshape(len(start), settings.parts, width // settings.parts).swapaxes(0, 1))
    for _ in range(settings.rounds):
        books = _moved(books, _sums(blocks, books))
    return books


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", settings: Settings = Settings()
) -> tuple[DataFrame, np.ndarray]:
    """One row per usable vector, its id, label, ``code`` and ``error``, the squared distance to what the code stands for; and
    the codebooks."""
    label = F.col(f"`{label_col}`") if label_col in vectors.columns else F.lit(None).cast("int")
    rows = vectors.filter(usable(F.col(f"`{vector_col}`"))).select(F.col(f"`{id_col}`").alias("id"), label.alias("label"), F.col(f"`{vector_col}`").alias("v"))
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        none = rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return none.toDF(id_col, label_col, "code", "error"), np.zeros((settings.parts, 0, 0), np.int64)
    width = -(-longest // settings.parts) * settings.parts
    blocks = saved(_blocks(rows, width, settings))
    books = fit(rows.select("id", "v"), width, settings, blocks)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return _codes(blocks, books, schema).toDF(id_col, label_col, "code", "error"), books


#: so many sums of labels are broadcast; more are joined by a shuffle
BROADCAST_LABELS = 100_000


def with_label_error(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """``coded`` with ``label_error``, the sum of errors over equal labels, nulls together. Errors are added up before they
    are shuffled, and only the sums are joined: broadcast where they are few, so that rows of a label that many have are
    not gathered."""
    coded = saved(coded)
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), most).cast("long")
    sums = saved(coded.groupBy(F.col(f"`{label_col}`").alias("_of")).agg(total.alias("label_error")))
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return coded.join(sums, F.col(f"`{label_col}`").eqNullSafe(F.col("_of")), "left").drop("_of")


def decoded(books: np.ndarray, code: str) -> list[int]:
    """The components that a code stands for."""
    digits = len(code) // books.shape[0]
    return [int(x) for k in range(books.shape[0]) for x in books[k, int(code[k * digits : (k + 1) * digits], 16)]]


def books_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))
