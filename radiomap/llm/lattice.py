"""Embedding near-duplicates by E8 lattice hashing.

Each table projects the unit vectors at random to blocks of eight dimensions
and decodes each block to the nearest point of the lattice E8; the points are
the vector's cell. A vector is stored in its own cell of every table and also
probes the neighbouring cells it lies closest to. Vectors that meet in a cell
are compared by cosine in double precision, so every link is true.

The index is sized from the number of vectors and the threshold alone: more
blocks for more vectors, which keeps cells small, and as many tables as a
simulation of pairs exactly at the threshold needs for the recall aimed at
(closer pairs meet more often).

Equal vectors are one row of the search. Rows travel with their vector to a
bucket of cells, which compares cell by cell with bounded matrix products. A cell
that would be too large for one task is laid out over a grid of tasks: storing
rows are dealt to its lines, probing rows to its columns. Pairs never leave a
task. A pair counts in the first table in which its vectors meet, which their keys
in the tables before tell, so that partial counts add up; a vector that has links
in a cell sends on its count and one link to a member of its component there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiomap.llm.graph import components
from radiomap.llm.text import mix
from radiomap.session import materialize

COSINE = 0.9
RECALL = 0.985
#: Cells a vector probes in each table beside its own.
PROBES = 6
#: Standard deviation of a projected coordinate of a unit vector, in units in
#: which the nearest lattice points are sqrt(2) apart.
SPREAD = 0.55
MAX_TABLES = 64
SEED = 20
#: Vectors for which one more task is laid out.
PER_BUCKET = 20_000
#: Rows of a cell beyond which it is laid out over several tasks, and rows of
#: either side that such a task holds.
CELL_ROWS = 10_000
#: Large cells that are sent to every task at most; more are joined by a shuffle.
SENT_CELLS = 50_000
_BLOCK = 1024
#: Pairs whose keys are laid side by side.
_PAIRS = 1 << 17


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    rows = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            rows.append(v)
    rows += [np.array(s) / 2 for s in product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.stack(rows)


SHORTEST = _shortest()


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest integer point with an even sum (the lattice D8)."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    if len(odd):
        off = x[odd] - near[odd]
        worst = np.abs(off).argmax(axis=1)
        near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, which is D8 and D8 moved by one half, to each row."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _key(points: np.ndarray, table: int) -> np.ndarray:
    """A 64-bit key of the points (n, blocks, 8) of one table."""
    key = np.full(len(points), table + 1, np.uint64)
    for column in np.rint(2 * points).astype(np.int64).reshape(len(points), -1).T.view(np.uint64):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key


class Index:
    """The random projections of all tables."""

    def __init__(self, dims: int, blocks: int, tables: int):
        draw = np.random.default_rng(SEED)
        self.dims, self.blocks, self.tables = dims, blocks, tables
        self.planes = draw.standard_normal((tables, dims, 8 * blocks)) * SPREAD

    def cells(self, unit: np.ndarray, table: int) -> np.ndarray:
        """(n, 1 + PROBES) keys: the own cell, then the neighbours by distance."""
        x = (unit @ self.planes[table]).reshape(len(unit), self.blocks, 8)
        own = decode(x.reshape(-1, 8)).reshape(x.shape)
        gain = (x - own) @ SHORTEST.T  # the larger, the nearer is the point moved by that vector
        keys = [_key(own, table)]
        flat = gain.reshape(len(unit), -1)
        rows = np.arange(len(unit))
        best = np.argpartition(-flat, PROBES, axis=1)[:, :PROBES]
        for k in range(PROBES):
            moved = own.copy()
            moved[rows, best[:, k] // 240] += SHORTEST[best[:, k] % 240]
            keys.append(_key(moved, table))
        return np.stack(keys, axis=1)


def meeting_rate(blocks: int, cosine: float = COSINE, pairs: int = 4000, dims: int = 64) -> float:
    """The share of simulated pairs at exactly ``cosine`` that meet in one table."""
    draw = np.random.default_rng(SEED + 1)
    a, b = draw.standard_normal((2, pairs, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    index = Index(dims, blocks, 1)
    x, y = index.cells(a, 0), index.cells(cosine * a + math.sqrt(1 - cosine ** 2) * b, 0)
    return float(((x[:, :1] == y).any(axis=1) | (y[:, :1] == x).any(axis=1)).mean())


def size_index(vectors: int, dims: int, cosine: float = COSINE) -> tuple[int, int]:
    """(blocks, tables): cells for the vectors, tables for the recall."""
    per_block = (math.sqrt(2 * math.pi * math.e) * SPREAD) ** 8
    blocks = max(1, round(math.log(max(vectors, 2) / 100) / math.log(per_block)))
    blocks = max(1, min(blocks, dims // 8 or 1))
    rate = meeting_rate(blocks, cosine, dims=max(dims, 2))
    tables = 1 if rate >= 1 else math.ceil(math.log(1 - RECALL) / math.log(1 - rate)) if rate > 0 else MAX_TABLES
    return blocks, max(1, min(tables, MAX_TABLES))


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    """Packed vectors as rows of unit length in double precision."""
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0.0)  # keeps the squares of extreme values finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _merge(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the components of x and y; ``root`` has the least member of each."""
    while True:
        a, b = root[x], root[y]
        far = a != b
        if not far.any():
            return
        x, y, a, b = x[far], y[far], a[far], b[far]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((up := root[root]) != root).any():
            root[:] = up


def _first_met(keys: np.ndarray, node: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the pairs (x stores, y probes) of a cell count there. ``keys``:
    (rows, tables, keys) of the tables up to that of the cell.

    They have met in no table before; if either finds the other in this one, the
    cell of the lesser node counts."""
    at = np.flatnonzero((node[x] < node[y]) | ~(keys[x, -1] == keys[y, -1, :1]).any(axis=1))
    for t in range(keys.shape[1] - 1):
        a, b = keys[x[at], t], keys[y[at], t]
        at = at[~((a == b[:, :1]) | (b == a[:, :1])).any(axis=1)]
    return at


def _links(table: pa.Table, cosine: float, kind: str) -> pa.Table:
    """(node, id, star, links) of one bucket: for each vector with links in a
    cell, the id of a member of its component there, and the rows it links with
    that count there."""
    tab, cell, line, column, stores, probes, node, ids, copies = (
        table[c].to_numpy() for c in ("tab", "cell", "line", "col", "stores", "probes", "node", "id", "copies"))
    units = _units(table["vector"].to_pylist(), kind)
    packed = table["keys"].to_pylist()
    order = np.lexsort((column, line, cell, tab))
    same = np.ones(len(order), bool)
    same[:1] = False
    for c in (tab, cell, line, column):
        same[1:] &= c[order[1:]] == c[order[:-1]]
    edges = np.append(np.flatnonzero(~same), len(order))
    stored = np.add.reduceat(stores[order].astype(np.int64), edges[:-1])
    out: list[tuple] = []
    for e in np.flatnonzero((stored > 0) & (np.diff(edges) > 1)).tolist():
        rows = order[edges[e]:edges[e + 1]]
        left, right = np.flatnonzero(stores[rows]), np.flatnonzero(probes[rows])
        own, times, root, count, keys = node[rows], copies[rows], np.arange(len(rows)), np.zeros(len(rows), np.int64), None
        for s in range(0, len(left), _BLOCK):
            for t in range(0, len(right), _BLOCK):
                a, b = left[s:s + _BLOCK], right[t:t + _BLOCK]
                i, j = np.nonzero(units[rows[a]] @ units[rows[b]].T >= cosine)
                x, y = a[i], b[j]
                x, y = x[x != y], y[x != y]
                if not len(x):
                    continue
                if keys is None:
                    keys = np.frombuffer(b"".join([packed[r] for r in rows]), np.int64).reshape(len(rows), -1, 1 + PROBES)
                _merge(root, x, y)
                for c in range(0, len(x), _PAIRS):
                    u, v = x[c:c + _PAIRS], y[c:c + _PAIRS]
                    new = _first_met(keys, own, u, v)
                    np.add.at(count, u[new], times[v[new]])
                    np.add.at(count, v[new], times[u[new]])
        if keys is not None:
            linked = np.flatnonzero((count > 0) | (root != np.arange(len(rows))))
            out.append((own[linked], ids[rows[linked]], ids[rows[root[linked]]], count[linked]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.empty(0, np.int64)] * 4
    return pa.table(dict(zip(("node", "id", "star", "links"), columns, strict=True)))


def _packed(batches: Iterator[pa.RecordBatch], dims: int, kind: str) -> Iterator[pa.RecordBatch]:
    """(vec_id, vector as bytes; null where it can't link with anything)."""
    def pack(v: list | None) -> bytes | None:
        if v is None or len(v) != dims or any(x is None for x in v):
            return None
        x = np.array(v, kind)
        return x.tobytes() if np.isfinite(x).all() and x.any() else None

    for batch in batches:
        out = [None if i is None else pack(v) for i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "vector"])


def lay_out(vectors: DataFrame, dims: int, kind: str, cosine: float = COSINE) -> DataFrame:
    """Rows (node, id, copies, vector) by bucket and by the cells they store in
    (``stores``) and probe (``probes``); large cells by line and column of a grid."""
    n = vectors.count()
    blocks, tables = size_index(n, dims, cosine)
    index = Index(dims, blocks, tables)
    each = 1 + PROBES

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _units(batch.column(3).to_pylist(), kind)
            keys = np.stack([index.cells(unit, t).view(np.int64) for t in range(tables)], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k.tobytes() for k in keys], pa.binary())],
                                             ["node", "id", "copies", "vector", "keys"])

    def cells(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            keys = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.int64).reshape(rows, tables, each)
            for t in range(tables):
                rest = [*batch.columns[:4], pc.binary_slice(batch.column(4), 0, 8 * each * (t + 1))] if whole else []
                names = ["node", "id", "copies", "vector", "keys"] if whole else []
                for k in range(each):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(rows, t, np.int32)), pa.array(keys[:, t, k]), pa.array(np.full(rows, k == 0)), *rest],
                        ["tab", "cell", "own", *names])

    row = "node long, id long, copies long, vector binary, keys binary"
    schema = "tab int, cell long, own boolean"
    known = materialize(vectors.select("node", "id", "copies", "vector").mapInArrow(keyed, row), "vector-keys")
    placed = known.mapInArrow(lambda b: cells(b, True), f"{schema}, {row}")
    rows, large = each * n * tables, None
    if n > CELL_ROWS:
        sizes = known.mapInArrow(lambda b: cells(b, False), schema).groupBy("tab", "cell").agg(
            F.count_if("own").alias("storing"), F.count("*").alias("probing")).where(f"storing > 0 and probing > {CELL_ROWS}")
        large = materialize(sizes.select("tab", "cell", *(
            F.ceil(F.col(c) / CELL_ROWS).cast("int").alias(k) for c, k in (("storing", "lines"), ("probing", "cols"))),
            "storing", "probing"), "large-cells")
        rows += large.agg(F.sum(F.expr("storing * cols + probing * lines"))).first()[0] or 0
    if large is None or rows == each * n * tables:
        spread = placed.withColumns({"line": F.lit(0), "col": F.lit(0), "stores": F.col("own"), "probes": F.lit(True)})
    else:
        side = large.select("tab", "cell", "lines", "cols")
        spread = placed.join(F.broadcast(side) if side.count() <= SENT_CELLS else side, ["tab", "cell"], "left")
        spread = spread.withColumns({c: F.coalesce(c, F.lit(1)) for c in ("lines", "cols")})
        spread = spread.withColumns({"my_line": F.expr("int(pmod(xxhash64(node), lines))"),
                                     "my_col": F.expr("int(pmod(xxhash64(node, 1), cols))")})
        at = F.expr("""inline(array_distinct(concat(
            transform(sequence(0, lines - 1), k -> struct(k as line, my_col as col)),
            if(own, transform(sequence(0, cols - 1), k -> struct(my_line as line, k as col)),
               array_repeat(struct(0 as line, my_col as col), 0)))))""")
        spread = spread.select("*", at).withColumns({"stores": F.expr("own and line = my_line"), "probes": F.expr("col = my_col")})
    buckets = max(1, math.ceil(rows / (each * PER_BUCKET)))
    bucket = F.pmod(F.xxhash64("tab", "cell", "line", "col"), F.lit(buckets))
    return spread.select(bucket.alias("bucket"), "tab", "cell", "line", "col", "stores", "probes", "node", "id", "copies",
                         "vector", "keys")


def find_links(vectors: DataFrame, dims: int, kind: str, cosine: float = COSINE) -> DataFrame:
    """(node, id, star, links) of rows (node, id, copies, vector) with distinct
    nodes and packed vectors: the sum of ``links`` by node is the number of rows it
    links with, the links (id, star) have the components of all links."""
    return (lay_out(vectors, dims, kind, cosine).groupBy("bucket")
            .applyInArrow(lambda t: _links(t, cosine, kind), "node long, id long, star long, links long"))


def embedding_groups(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                     cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    A vector that is null, empty, zero, of another length than most or that
    holds a null or non-finite component links with nothing. Equal vectors link
    with each other. Rows that repeat an id count as rows but are one node of a
    component. A row without id is returned with no links and a null component. Other columns,
    labels included, are ignored; an empty table gives an empty table."""
    kind = "<f4" if dict(rows.dtypes)[vector_col] == "array<float>" else "<f8"
    element = "float" if kind == "<f4" else "double"
    source = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{element}>").alias("v"))
    length = source.groupBy(F.size("v").alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").first()
    dims = length["n"] if length else 0
    every = materialize(source.mapInArrow(lambda b: _packed(b, dims, kind), "vec_id long, vector binary"), "vectors")
    usable = every.where("vector is not null")
    same = materialize(usable.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
                       .withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
    found = materialize(find_links(same, max(dims, 1), kind, cosine), "vector-links")
    others = found.groupBy("node").agg(F.sum("links").alias("others"))
    parts = components(found, "id", "star").withColumnRenamed("node", "id")
    known = same.join(others, "node", "left").join(parts, "id", "left").select(
        "vector", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    linked = usable.join(known, "vector").select("vec_id", "n_links", "component_id")
    lone = every.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
