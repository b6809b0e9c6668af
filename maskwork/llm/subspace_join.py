"""Near-duplicate vectors by a subspace pigeonhole join.

1. Vectors become directions; equal vectors collapse to one node that counts its copies. A cosine of ``threshold`` or
   more is a squared distance of ``2 - 2 * threshold`` or less.
2. Directions are rotated (signs and Walsh-Hadamard transforms, so that every coordinate holds a little of each
   input) and split into blocks of few dimensions. Every block gets a share of the squared distance in
   proportion to its variance over all rows. If a pair lies within the whole budget, it lies within the share of at
   least one block: no pair is lost.
3. Each block is a range join: space is cut at the means of its widest coordinates into cells, as many as the rows
   need; a node lives in its own cell and is a guest in every later cell that a ball of the block's radius
   touches. A cell with many rows is cut into parts, and so are its guests.
4. Inside a cell, pairs within the block's share are candidates, and their cosine is computed from the
   whole vectors in double precision. A pair counts in the first block that finds it.

Pairs live inside a task only: what leaves it is one count per node and the edges of a spanning forest.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwork.llm.components import connected_components
from maskwork.session import materialise

THRESHOLD = 0.95
BLOCK_DIMS = 16
CELL_ROWS = 8192  # rows of one part of a cell; its guests come in parts of four times as many
TILE = 1024
SLACK = 1e-4  # shares are this much wider than exact ones, so that rounded coordinates lose nothing
_PIECE = 100_000


def directions(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, filled with zeros to ``width``, and the lengths of the lists."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    out /= np.abs(out).max(axis=1, keepdims=True)  # no square of a component can then overflow, nor all of them vanish
    out /= np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out, sizes


def rotate(x: np.ndarray, seed: int = 17) -> np.ndarray:
    """A fixed rotation of rows whose width is a power of two, by additions only: a row's result never depends on the others."""
    n, width = x.shape
    rng = np.random.default_rng(seed)
    for _ in range(2):
        x = x * rng.choice([-1.0, 1.0], width)
        half = 1
        while half < width:
            pairs = x.reshape(n, width // (2 * half), 2, half)
            x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(n, width)
            half *= 2
    return (x / width).astype(np.float32)  # 1 / sqrt(width) for each of the two


class Space(NamedTuple):
    """The blocks of the rotated space: their coordinates, shares and the coordinates and places of their cuts."""

    width: int
    blocks: list[slice]
    shares: list[float]
    cuts: list[np.ndarray]
    means: np.ndarray

    @classmethod
    def over(cls, n: int, sums: np.ndarray, squares: np.ndarray, budget: float, block_dims: int, cell_rows: int) -> Space:
        means = sums / max(n, 1)
        variance = np.maximum(squares / max(n, 1) - means**2, 0)
        blocks = [slice(at, min(at + block_dims, len(sums))) for at in range(0, len(sums), block_dims)]
        held = np.array([variance[b].sum() for b in blocks])
        # a block in which all rows are alike gets no share, and so finds nothing
        held[held <= 1e-9 * held.sum()] = 0
        if not held.sum():
            held[:] = 1
        depth = max(0, int(np.ceil(np.log2(max(n, 1) / cell_rows))))
        kept = [(b, budget * h / held.sum()) for b, h in zip(blocks, held) if h]
        cuts = [b.start + np.argsort(-variance[b], kind="stable")[:depth] for b, _ in kept]
        return cls(len(sums), [b for b, _ in kept], [share * (1 + SLACK) + 1e-9 for _, share in kept], cuts, means)

    def cells(self, rotated: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row and cell of all homes and guests of one block, and which are homes."""
        cuts = self.cuts[block]
        off = rotated[:, cuts].astype(np.float64) - self.means[cuts]
        home = ((off > 0) << np.arange(len(cuts))).sum(axis=1).astype(np.int64)
        row, cell, cost = np.arange(len(rotated)), home, np.zeros(len(rotated))
        for j in range(len(cuts)):
            further = cost + off[row, j] ** 2
            near = further <= self.shares[block]
            row, cell = np.concatenate([row, row[near]]), np.concatenate([cell, cell[near] ^ (1 << j)])
            cost = np.concatenate([cost, further[near]])
        wanted = cell >= home[row]  # of two touching cells the later one compares
        return row[wanted], cell[wanted], (cell == home[row])[wanted]


def _unit(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _named(vectors: DataFrame) -> DataFrame:
    """vec_id, v and a two-part hash of v (null where v can link with nothing)."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    v = F.col("embedding") if kind in ("float", "double") else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
    good = F.coalesce(F.forall("v", _unit) & F.exists("v", lambda x: x != 0), F.lit(False))
    return rows.select("vec_id", "v", F.when(good, F.xxhash64("v")).alias("k1"), F.when(good, F.xxhash64(F.lit(1), "v")).alias("k2"))


def _space(nodes: DataFrame, budget: float, block_dims: int, cell_rows: int) -> Space | None:
    widest = nodes.agg(F.max(F.size("v"))).first()[0]
    if not widest:
        return None
    width = 1 << (widest - 1).bit_length()

    def run(batches):
        n, sums, squares = 0, np.zeros(width), np.zeros(width)
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                x = rotate(directions(batch.column("v").slice(at, TILE), width)[0]).astype(np.float64)
                n, sums, squares = n + len(x), sums + x.sum(axis=0), squares + (x * x).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width)), pa.array(np.full(width, n)), pa.array(sums), pa.array(squares)], ["at", "n", "sums", "squares"])

    parts = nodes.select("v").mapInArrow(run, "at bigint, n bigint, sums double, squares double")
    total = parts.groupBy("at").agg(F.sum("n"), F.sum("sums"), F.sum("squares")).orderBy("at").collect()  # ``width`` rows
    return Space.over(total[0][1], np.array([r[2] for r in total]), np.array([r[3] for r in total]), budget, block_dims, cell_rows)


def _placed(nodes: DataFrame, space: Space, vectors: bool) -> DataFrame:
    """One row per node, block and cell it is in; without ``vectors`` only block, cell and home."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                rotated = rotate(directions(part.column("v"), space.width)[0])
                for b in range(len(space.blocks)):
                    row, cell, home = space.cells(rotated, b)
                    columns = [pa.array(np.full(len(row), b, np.int32)), pa.array(cell), pa.array(home)]
                    own = part.take(pa.array(row)).columns if vectors else []
                    yield pa.RecordBatch.from_arrays([*columns, *own], ["block", "cell", "home", *(part.schema.names if vectors else [])])

    schema = "block int, cell bigint, home boolean"
    if vectors:
        kind = nodes.schema["v"].dataType.simpleString()
        schema += f", node bigint, copies bigint, v {kind}"
    return nodes.select("node", "copies", "v").mapInArrow(run, schema)


class _Forest:
    """Union-find over positions, many pairs at a time; a root is the least position."""

    def __init__(self) -> None:
        self.up = np.zeros(0, np.int64)

    def grow(self, n: int) -> None:
        self.up = np.concatenate([self.up, np.arange(len(self.up), len(self.up) + n)])

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.up[x]
            if np.array_equal(up, x):
                return x
            x = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            self.up[b] = a


class _Side(NamedTuple):
    node: np.ndarray
    copies: np.ndarray
    unit: np.ndarray
    rotated: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, width: int) -> _Side:
        unit, size = directions(batch.column("v"), width)
        return cls(batch.column("node").to_numpy(), batch.column("copies").to_numpy(), unit, rotate(unit), size)


class _Cell:
    """The pairs of one part of a cell and one part of its guests."""

    def __init__(self, space: Space, threshold: float, block: int, inside: bool) -> None:
        self.space, self.threshold, self.block, self.inside = space, threshold, block, inside
        self.homes: _Side | None = None
        self.waiting: list[_Side] = []
        self.nodes: list[np.ndarray] = []
        self.links: list[np.ndarray] = []
        self.forest = _Forest()

    def _enter(self, side: _Side) -> int:
        at = len(self.forest.up)
        self.forest.grow(len(side.node))
        self.nodes.append(side.node)
        self.links.append(np.zeros(len(side.node)))
        return at

    def add(self, side: _Side, home: bool) -> None:
        if home:
            self.waiting.append(side)
            return
        self._settle()
        if self.homes is not None:
            self._compare(side, self._enter(side), len(self.links) - 1, within=False)

    def _settle(self) -> None:
        if self.waiting:
            self.homes = _Side(*[np.concatenate(x) for x in zip(*self.waiting)])
            self.waiting = []
            self._enter(self.homes)
            if self.inside:
                self._compare(self.homes, 0, 0, within=True)

    def _within(self, b: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether pairs lie within block b's share; the same for a pair in every task."""
        apart = left[:, self.space.blocks[b]].astype(np.float64) - right[:, self.space.blocks[b]]
        return (apart * apart).sum(axis=1) <= self.space.shares[b]

    def _compare(self, side: _Side, at: int, slot: int, within: bool) -> None:
        homes, own = self.homes, self.space.blocks[self.block]
        right = np.ascontiguousarray(side.rotated[:, own])
        square = (right * right).sum(axis=1)
        for start in range(0, len(homes.node), TILE):
            left = homes.rotated[start : start + TILE, own]
            apart = (left * left).sum(axis=1)[:, None] + square[None, :]
            apart -= 2 * (left @ right.T)
            near = apart <= self.space.shares[self.block] + 1e-5
            if within:
                near &= np.arange(len(side.node))[None, :] > np.arange(start, start + len(left))[:, None]
            i, j = np.nonzero(near)
            if not len(i):
                continue
            cosines = homes.unit[start : start + TILE] @ side.unit.T if len(i) * 20 > near.size else None
            for piece in range(0, len(i), _PIECE):
                a, b = i[piece : piece + _PIECE] + start, j[piece : piece + _PIECE]
                cosine = cosines[a - start, b] if cosines is not None else np.einsum("ij,ij->i", homes.unit[a], side.unit[b])
                hit = (cosine >= self.threshold) & (homes.size[a] == side.size[b])
                a, b = a[hit], b[hit]
                x, y = homes.rotated[a], side.rotated[b]
                first = self._within(self.block, x, y)
                for earlier in range(self.block):
                    first &= ~self._within(earlier, x, y)
                a, b = a[first], b[first]
                self.links[0] += np.bincount(a, side.copies[b], len(homes.node))
                self.links[slot] += np.bincount(b, homes.copies[a], len(side.node))
                self.forest.join(a, b + at)

    def result(self) -> pa.RecordBatch:
        self._settle()
        nodes = np.concatenate([*self.nodes, np.zeros(0, np.int64)])
        links = np.concatenate([*self.links, np.zeros(0)]).astype(np.int64)
        roots = self.forest.roots(np.arange(len(nodes)))
        linked, hung = np.flatnonzero(links), np.flatnonzero(roots != np.arange(len(nodes)))
        other = np.concatenate([np.zeros(len(linked), np.int64), nodes[roots[hung]]])
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes[np.concatenate([linked, hung])]), pa.array(other, mask=np.arange(len(other)) < len(linked)),
             pa.array(np.concatenate([links[linked], np.zeros(len(hung), np.int64)]))], ["node", "other", "links"])


def _compared(nodes: DataFrame, space: Space, threshold: float, cell_rows: int) -> DataFrame:
    """(node, other, links): links of a node in one cell (other null) and edges of the cell's forest (links 0)."""
    sizes = _placed(nodes, space, vectors=False).groupBy("block", "cell").agg(
        F.count_if("home").alias("homes"), F.count("*").alias("all"))
    sizes = sizes.where("homes > 0").select(
        "block", "cell", F.ceil(F.col("homes") / cell_rows).cast("int").alias("parts"),
        F.ceil(F.col("all") / (4 * cell_rows)).cast("int").alias("guests"))

    # homes go to their part, once for each part of the guests; homes of a later part are guests in the earlier ones
    part, group = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.pmod(F.hash("node"), F.col("guests")).cast("int")
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    goal = lambda p, g, home: F.struct(p.alias("part"), g.alias("group"), home.alias("home"))
    as_home = F.transform(numbers(F.col("guests")), lambda g: goal(part, g, F.lit(True)))
    as_guest = F.transform(numbers(F.when(F.col("home"), part).otherwise(F.col("parts"))), lambda p: goal(p, group, F.lit(False)))
    dealt = _placed(nodes, space, vectors=True).join(sizes, ["block", "cell"])
    dealt = dealt.select("block", "cell", "node", "copies", "v", F.explode(
        F.when(F.col("home"), F.concat(as_home, as_guest)).otherwise(as_guest)).alias("goal"))
    dealt = dealt.select("block", "cell", "goal.*", "node", "copies", "v")

    def run(batches):
        cell, key = None, None
        for batch in batches:
            marks = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("block", "cell", "part", "group", "home")])
            begins = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for low, high in zip(begins, begins[1:]):
                own = tuple(marks[:4, low].tolist())
                if own != key:
                    if cell is not None:
                        yield cell.result()
                    cell, key = _Cell(space, threshold, own[0], inside=own[3] == 0), own
                for at in range(low, high, 4 * TILE):
                    cell.add(_Side.of(batch.slice(at, min(4 * TILE, high - at)), space.width), bool(marks[4, low]))
        if cell is not None:
            yield cell.result()

    keys = ["block", "cell", "part", "group"]
    # homes come before guests, so that a cell's homes are in memory when the guests pass by
    ordered = dealt.repartition(*keys).sortWithinPartitions(*keys, F.col("home").desc())
    return ordered.mapInArrow(run, "node bigint, other bigint, links bigint")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block_dims: int = BLOCK_DIMS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    ``n_links`` counts the other rows whose cosine with this one is ``threshold`` or more, ``component_id`` is the least id
    of all rows that links connect, ``kept`` tells whether it is the row's own. Null, empty and zero vectors and those with
    null or non-finite components link with nothing and are kept; so do vectors of different lengths. Equal vectors are linked.
    Rows that repeat an id are rows of their own. A row without an id takes part; the component of such rows alone is
    null, and they are kept. Other columns are ignored; an empty table gives no rows.
    """
    named = _named(vectors)
    nodes = materialise(
        named.where("k1 is not null").groupBy("k1", "k2").agg(
            F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("v").alias("v"))
        .withColumn("node", F.xxhash64("k1", "k2")), "nodes")
    space = _space(nodes, 2 - 2 * threshold, block_dims, cell_rows)
    classes = nodes.select("k1", "k2", "node", "least", "copies")
    if space is None:
        classes = classes.select("k1", "k2", "copies", F.lit(0).cast("bigint").alias("links"), F.col("least").alias("component_id"))
    else:
        found = materialise(_compared(nodes, space, threshold, cell_rows), "links")
        counts = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
        labels = connected_components(found.where("other is not null"), "node", "other")
        inside = materialise(classes.select("node", "least").join(labels, "node"), "labels")
        firsts = materialise(inside.groupBy("component").agg(F.min("least").alias("first")), "firsts")
        firsts = inside.select("node", "component").join(firsts, "component").select("node", "first")
        classes = classes.join(counts, "node", "left").join(firsts, "node", "left").select(
            "k1", "k2", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("first", "least").alias("component_id"))
    linked = named.where("k1 is not null").select("vec_id", "k1", "k2").join(classes, ["k1", "k2"]).select(
        "vec_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = named.where("k1 is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def oracle_sql(table: str = "embeddings") -> str:
    """The same in DuckDB's SQL, comparing all pairs."""
    return f"""
with recursive vectors as (
  select row_number() over () as r, vec_id, embedding::double[] as v,
    embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0 as good from {table}),
units as (select r, vec_id, v, sqrt(list_dot_product(v, v)) as size from vectors where good),
links as (
  select a.r as a, b.r as b from units a join units b on a.r <> b.r and len(a.v) = len(b.v)
  where list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.95),
counts as (select a, count(*) as n from links group by a),
reach as (select r as a, r as b from vectors union select reach.a, links.b from reach join links on reach.b = links.a),
firsts as (select a, min(vec_id) as component_id from reach join vectors on reach.b = vectors.r group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id is not distinct from component_id as kept
from vectors left join counts on counts.a = r join firsts on firsts.a = r"""
