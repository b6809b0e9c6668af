"""N-gram Jaccard self-join of documents with Bayesian candidate pruning.

1. A text is the set of its five-word shingles (normalised words; a shorter text is one
   shingle of all its words, a text without words has none). Equal sets collapse to one.
2. MinHash bands name candidates: 40 bands of 5 values miss a pair at similarity 0.8 with
   probability 1e-7, and fewer above. Only pairs that share a band are compared.
3. Texts are seated in blocks of bounded size, texts that bands connect side by side. A text
   also visits each other block where it shares a band with somebody, so a pair of candidates
   meets once, and texts that a chain of bands connects, but no band of their own, never meet.
4. MinHash values of each pair are compared step by step, and the pair is dropped as soon as the
   posterior probability that its similarity reaches the threshold falls under ``TOLERANCE``.
   What stays is verified on the whole shingle sets.

Pairs live inside a task only: what leaves it is one count per document and the edges of a
spanning forest. Classes are built from verified links.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwork.llm.components import connected_components
from maskwork.llm.words import Powers, Words, chunks, mix, plain_table
from maskwork.session import materialise

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 5
STEPS = (16, 32, 64, 96, 128)
TOLERANCE = 1e-9
BLOCK_TEXTS = 2048
BLOCK_CHARS = 6_000_000


def shingle_sets(texts: list, table: np.ndarray, powers: Powers, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out = []
    for a, b in chunks(texts):
        words = Words(texts[a:b], table, powers)
        hashes, bounds = words.shingles(k)
        for d in range(b - a):
            mine = hashes[bounds[d] : bounds[d + 1]]
            if not len(mine) and words.bounds[d + 1] > words.bounds[d]:
                few = words.hashes[words.bounds[d] : words.bounds[d + 1]]
                mine = mix(np.array([hash(tuple(few.tolist())) & (2**64 - 1)], np.uint64))
            out.append(np.unique(mine))
    return out


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """MinHash values, one per factor; the shingles are taken in pieces, so memory is bounded."""
    low = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    narrow = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(narrow), 4096):
        grid = narrow[None, at : at + 4096] * factors[:, :1]
        grid += factors[:, 1:]
        np.minimum(low, grid.min(axis=1), out=low)
    return low


def factors_for(count: int, seed: int) -> np.ndarray:
    drawn = np.random.default_rng(seed).integers(0, 1 << 32, (count, 2), dtype=np.uint64).astype(np.uint32)
    drawn[:, 0] |= 1
    return drawn


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest equal values of ``n`` that keep a pair.

    Under a uniform prior the posterior of the similarity is Beta(m + 1, n - m + 1), and the
    probability of reaching the threshold is that of at most m hits in n + 1 draws at it.
    """
    reach = 0.0
    for m in range(n + 1):
        reach += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if reach >= tolerance:
            return m
    return n


def sketch(documents: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text), the key of the shingle set (k1, k2), its size and its band keys."""

    def run(batches):
        table, powers, factors = plain_table(), Powers(), factors_for(BANDS * ROWS, 11)
        weights = mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
        labels = mix(np.arange(101, 101 + BANDS, dtype=np.uint64))
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), table, powers)
            sizes = np.array([len(s) for s in sets], np.int64)
            k1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            k2 = np.array([mix(s ^ np.uint64(_SALT)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            values = [signature(s, factors) for s in sets if len(s)]
            grid = np.stack(values).astype(np.uint64) if values else np.zeros((0, BANDS * ROWS), np.uint64)
            keys = mix((grid.reshape(-1, BANDS, ROWS) * weights).sum(axis=2, dtype=np.uint64) + labels).view(np.int64)
            bounds = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))])
            bands = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(k1), pa.array(k2), pa.array(sizes), bands],
                ["doc_id", "mark", "k1", "k2", "size", "bands"])

    narrow = documents.select(F.col("doc_id").cast("bigint"), _mark().alias("mark"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id bigint, mark bigint, k1 bigint, k2 bigint, size bigint, bands array<bigint>")


def _mark() -> Column:
    """With the id it names a row by what it holds: rows that repeat an id need not hold the same text."""
    text = F.col("text").cast("string")
    return F.xxhash64(text.isNull(), text)


_SALT = 0x5851F42D4C957F2D


class _Forest:
    """Union-find over positions."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def links_of_block(sets: list[np.ndarray], bands: np.ndarray, nodes: np.ndarray, left: np.ndarray, within: bool,
                   factors: np.ndarray, needs: dict[int, int]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links per text and spanning edges, among the texts of one block (``within``) or between two.

    ``bands`` holds a row of band keys per text; pairs without a key in common are not looked at.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order])
    names, sides = nodes[order], left[order]
    keys = np.ascontiguousarray(np.unique(bands, return_inverse=True)[1].reshape(bands.shape)[order].T.astype(np.int32))
    ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    values = np.stack([signature(sets[i], factors) for i in order])
    mark = np.zeros(ids.max() + 1, np.int32)
    links, forest, edges = np.zeros(len(order), np.int64), _Forest(len(order)), []
    for i in range(len(order) - 1):
        stop = np.searchsorted(sizes, sizes[i] / THRESHOLD + 1e-9, side="right")
        alive = i + 1 + np.flatnonzero((keys[:, i + 1 : stop] == keys[:, i : i + 1]).any(axis=0))
        alive = alive[names[alive] != names[i]] if within else alive[sides[alive] != sides[i]]
        equal, at = np.zeros(len(alive), np.int64), 0
        for step in STEPS:
            if not len(alive):
                break
            equal += (values[alive, at:step] == values[i, at:step]).sum(axis=1)
            keep = equal >= needs[step]
            alive, equal, at = alive[keep], equal[keep], step
        if not len(alive):
            continue
        own = ids[bounds[i] : bounds[i + 1]]
        mark[own] = 1
        if len(alive) * 2 > alive[-1] - alive[0]:
            first, last = alive[0], alive[-1]
            shared = np.add.reduceat(mark[ids[bounds[first] : bounds[last + 1]]], bounds[first : last + 1] - bounds[first])
            shared = shared[alive - first]
        else:
            shared = np.array([mark[ids[bounds[j] : bounds[j + 1]]].sum() for j in alive])
        mark[own] = 0
        hits = alive[shared >= THRESHOLD * (sizes[i] + sizes[alive] - shared) - 1e-9]
        links[hits] += 1
        links[i] += len(hits)
        edges += [(int(names[i]), int(names[j])) for j in hits if forest.join(i, int(j))]
    back = np.empty_like(links)
    back[order] = links
    return back, edges


def _block_rows(members: DataFrame) -> DataFrame:
    """(node, other, links): a count per text and block (other null) and the forest's edges (links 0)."""

    def run(frames):
        table, powers, factors = plain_table(), Powers(), factors_for(STEPS[-1], 13)
        needs = {n: least_matches(n) for n in STEPS}

        def solve(rows: pd.DataFrame) -> pd.DataFrame:
            within = bool(rows["bi"].iloc[0] == rows["bj"].iloc[0])
            nodes = rows["node"].to_numpy()
            left = (rows["block"] == rows["bi"]).to_numpy()
            sets = shingle_sets(rows["text"].tolist(), table, powers)
            links, edges = links_of_block(sets, np.stack(rows["bands"].tolist()), nodes, left, within, factors, needs)
            return pd.DataFrame({
                "node": np.concatenate([nodes, np.array([e[0] for e in edges], np.int64)]),
                "other": pd.array([*[None] * len(nodes), *[e[1] for e in edges]], dtype="Int64"),
                "links": np.concatenate([links, np.zeros(len(edges), np.int64)]),
            })

        held: list[pd.DataFrame] = []
        key = None
        for frame in frames:
            for own, rows in frame.groupby(["bi", "bj"], sort=False):
                if key is not None and own != key:
                    yield solve(pd.concat(held))
                    held = []
                key = own
                held.append(rows)
        if held:
            yield solve(pd.concat(held))

    # rows of one block pair lie together after the sort; a partition holds many small blocks
    dealt = members.repartition("bi", "bj").sortWithinPartitions("bi", "bj")
    return dealt.mapInPandas(run, "node bigint, other bigint, links bigint")


def _parts() -> Column:
    """How many blocks a group needs, by its texts and their length."""
    return F.ceil(F.greatest(F.count("*") / BLOCK_TEXTS, F.sum("size") * 6 / BLOCK_CHARS)).cast("int").alias("parts")


def _visits(placed: DataFrame) -> DataFrame:
    """(node, block, with): the block a text sits in, and each block whose texts it is compared with, its own included.

    A component (of shared bands) that fits is one block. In a larger one, texts sit by the least band key that they
    share with somebody; a key too common for one block is split by the text, rare keys are dealt over the blocks. There a
    text visits only blocks with a text that shares one of its keys.
    """
    sizes = materialise(placed.groupBy("component").agg(_parts()), "sizes")
    placed = placed.join(sizes, "component")
    own = F.xxhash64("component").alias("block")
    small = placed.where("parts = 1").select("node", own, own.alias("with"))

    keyed = placed.where("parts > 1").select("node", "component", F.col("parts").alias("blocks"), "size", F.explode("bands").alias("key"))
    common = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "common")
    keyed = materialise(keyed.join(common, "key"), "keyed")
    homes = materialise(keyed.groupBy("node").agg(*[F.first(c).alias(c) for c in ("component", "blocks", "size")], F.min("key").alias("home")), "homes")
    groups = materialise(homes.groupBy("home").agg(_parts()), "groups")
    split = F.xxhash64("component", "home", F.pmod(F.xxhash64("node"), F.col("parts")))
    dealt = F.xxhash64("component", F.pmod(F.xxhash64("home"), F.col("blocks")))
    seats = materialise(homes.join(groups, "home").select("node", F.when(F.col("parts") > 1, split).otherwise(dealt).alias("block")), "seats")

    seated = materialise(keyed.select("node", "key").join(seats, "node"), "seated")
    spans = materialise(seated.select("key", F.col("block").alias("with")).distinct(), "spans")
    met = seated.join(spans, "key").where("block <> with").select("node", "block", "with").distinct()
    return small.union(seats.select("node", "block", F.col("block").alias("with"))).union(met)


def _linked(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and one row per distinct shingle set of those with an id and a word: k1, k2,
    n_copies, n_links, and the class's first row by id and text (class_id, class_mark).

    The nodes of the graph are the sets (a hash of k1 and k2), not ids, which may repeat.
    """
    sketches = materialise(sketch(documents), "sketches")
    named = sketches.where("size > 0 and doc_id is not null")
    sets = materialise(
        named.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "mark", "bands", "size")).alias("first"), F.count("*").alias("n_copies"))
        .select("k1", "k2", "n_copies", F.xxhash64("k1", "k2").alias("node"), "first.doc_id", "first.mark", "first.bands", "first.size"),
        "sets")

    keyed = sets.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    candidates = connected_components(keyed.join(shared, "key").select("node", "low"), "node", "low")

    placed = materialise(candidates.join(sets.select("node", "doc_id", "mark", "size", "bands"), "node"), "candidates")
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), _mark().alias("mark"), F.col("text").cast("string").alias("text"))
    # both sides grow with the corpus, so neither is ever broadcast; rows that repeat id and text are one here
    members = placed.select("node", "doc_id", "mark", "bands").hint("merge").join(texts, ["doc_id", "mark"])
    members = members.dropDuplicates(["doc_id", "mark"]).join(_visits(placed), "node")
    members = members.select("node", "text", "bands", "block", F.least("block", "with").alias("bi"), F.greatest("block", "with").alias("bj"))

    found = materialise(_block_rows(members), "links")
    labels = connected_components(found.where("other is not null"), "node", "other")
    counts = found.where("other is null").groupBy("node").agg(F.sum("links").alias("n_links"))
    inside = materialise(labels.join(sets.select("node", "doc_id", "mark"), "node"), "labels")
    firsts = materialise(inside.groupBy("component").agg(F.min(F.struct("doc_id", "mark")).alias("first")), "firsts")
    labels = inside.select("node", "component").join(firsts, "component").select("node", "first")
    classes = sets.select("k1", "k2", "node", "doc_id", "mark", "n_copies").join(labels, "node", "left").join(counts, "node", "left")
    return sketches, classes.select(
        "k1", "k2", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("first.doc_id", "doc_id").alias("class_id"), F.coalesce("first.mark", "mark").alias("class_mark"))


def near_classes(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``: doc_id, class_id, n_links, n_copies.

    ``class_id`` is the least id of all documents that links connect (similarity 0.8 or more of
    five-word shingle sets); ``n_links`` counts the other distinct shingle sets this one is linked
    to; ``n_copies`` the rows with the same set. Texts that are null or hold no word are alone in
    their class, with no link. Rows without an id get a null class. Rows that repeat an id with another
    text are documents of their own, so two classes may have one least id. Other columns of the input are
    ignored.
    """
    sketches, classes = _linked(documents)
    named = sketches.where("size > 0 and doc_id is not null")
    linked = named.select("doc_id", "k1", "k2").join(classes, ["k1", "k2"]).select("doc_id", "class_id", "n_links", "n_copies")
    alone = sketches.where("size = 0 or doc_id is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(1).cast("bigint").alias("n_copies"))
    return linked.union(alone)


def keep_one_of_each(documents: DataFrame) -> DataFrame:
    """One row of each class, that of the least id and, among those, of the least text hash, with the columns it came with.

    Rows that repeat an id with another text are told apart by the text; of rows that repeat both, the one
    whose columns have the least hash stays, so every run keeps the same. Rows without an id stay as they are.
    """
    names = documents.columns
    sketches, classes = _linked(documents)
    kept = classes.select(F.col("class_id").alias("__id"), F.col("class_mark").alias("__mark"))
    kept = kept.union(sketches.where("size = 0 and doc_id is not null").select("doc_id", "mark")).distinct()
    rows = documents.select(F.col("doc_id").cast("bigint").alias("__id"), _mark().alias("__mark"), F.struct(*names).alias("__row"))
    chosen = rows.join(kept.hint("merge"), ["__id", "__mark"]).groupBy("__id", "__mark").agg(
        F.min_by("__row", F.xxhash64("__row")).alias("__row"))
    return chosen.select("__row.*").union(documents.where("doc_id is null").select(*names))
