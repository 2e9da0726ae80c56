"""Near-duplicate groups by a chosen-path set similarity join.

Every document is the set of its five-word shingles. Independent trees branch it along the minwise tokens that hash
functions choose for a node: documents that share the token go to the same child. Small nodes are compared exhaustively,
first by sketches, then by full sets; what no tree can split is compared tile by tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lowtide.llm.columns import keep_columns, put_back
from lowtide.llm.registry import query, table
from lowtide.llm.text import mixed, text_bytes
from lowtide.session import materialise

WORDS = 5
PERCENT = 75
#: Independent trees. A pair at the least similarity of 0.75 shares the first token of a tree with that probability, and
#: gets through further levels of two branches with 0.89 or more: all trees miss it with less than 2 in a million.
TREES = 12
BRANCHES = 2
DEPTH = 4
#: Minwise tokens of a sketch, and the share of equal ones from which full sets are compared. A pair at a similarity of 0.75
#: has less than 68 of 128 equal with a probability of 5 in a hundred million (exact binomial).
SKETCH = 128  # at most 255, as counts are kept in bytes
SKETCH_SHARE = 0.53
#: Documents of a node that are compared exhaustively at once, and shingles that they have together: both bound a task.
NODE = 2048
NODE_SHINGLES = 1 << 21

_ROLL = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(data: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words; of the whole sequence where it is shorter."""
    tokens = data.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    n = min(words, len(h))
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mixed(out) * _ROLL + h[k : len(h) - n + 1 + k]
    return np.unique(mixed(out + np.uint64(n)))


def _functions(size: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * size + 1, dtype=np.uint64))
    return seeds[:size] | np.uint64(1), seeds[size:]


def sketch(shingles: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """The least value of the shingles under each of ``size`` hash functions, as 32 bits."""
    a, b = _functions(size)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(shingles), 1024):
        part = shingles[lo : lo + 1024]
        values = ((part[None, :] * a[:, None] + b[:, None]) >> np.uint64(32)).astype(np.uint32)
        np.minimum(out, values.min(axis=1), out=out)
    return out


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, place, n_shingles, set_id, sketch): ``set_id`` is a digest of the whole set, ``place`` finds the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, places = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[list] = [[], [], [], [], []]
            for doc_id, place, raw in zip(doc_ids, places, text_bytes(batch.column(2))):
                s = shingle_hashes(raw)
                row = (doc_id, place, len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, sketch(s).tobytes() if len(s) else None)
                for column, value in zip(rows, row):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], ["doc_id", "place", "n_shingles", "set_id", "sketch"])

    out = "doc_id long, place long, n_shingles long, set_id binary, sketch binary"
    return docs.select("doc_id", F.xxhash64("text").alias("place"), "text").mapInArrow(run, out)


def _token(position) -> F.Column:
    """The sketch's 32-bit token at a position, as a hex string (cheap to cut, equal where the tokens are)."""
    return F.substring(F.col("sketch"), position * 4 + 1, F.lit(4))


def branches(sets: DataFrame, trees: int, depth: int, node: int) -> DataFrame:
    """(node, set_id, sketch): the nodes that are compared, with at least two sets each.

    Level by level, nodes of one set are dropped, small ones are kept, and large ones branch again along BRANCHES
    tokens chosen by the node. A node still large at ``depth`` is cut into tiles by its sets' hashes and returned once
    for each pair of tiles, so that nothing in it goes uncompared and no task gets it whole.
    """
    roots = sets.withColumn("_tree", F.explode(F.array(*[F.lit(i) for i in range(trees)])))
    level = roots.select(F.xxhash64("_tree", _token(F.col("_tree"))).alias("node"), "set_id", "n_shingles")
    done = None
    for d in range(depth + 1):
        level = materialise(level, "level")
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("_n"), F.sum("n_shingles").alias("_s")).where("_n > 1")
        # How many times a node is what one task may hold.
        counted = level.join(sizes, "node").withColumn("_size", F.greatest(F.col("_n") / node, F.col("_s") / NODE_SHINGLES))
        small = counted.where((F.col("_size") <= 1) | (F.col("_n") == 2)).select("node", "set_id")
        done = small if done is None else done.unionByName(small)
        large = materialise(counted.where((F.col("_size") > 1) & (F.col("_n") > 2)), "large")
        if large.isEmpty():
            break
        if d == depth:
            # Tiles of about half a node; each set goes to the pairs of its tile with every tile of its node.
            tiles = F.ceil(F.col("_size") * 2).cast("int")
            tiled = large.withColumn("_t", F.pmod(F.xxhash64("set_id", "node"), tiles.cast("long")).cast("int"))
            other = tiled.withColumn("_o", F.explode(F.sequence(F.lit(0), tiles - 1)))
            pair = F.xxhash64("node", F.least("_t", "_o"), F.greatest("_t", "_o"))
            done = done.unionByName(other.select(pair.alias("node"), "set_id"))
            break
        chosen = large.join(sets.select("set_id", "sketch"), "set_id").withColumn("_b", F.explode(F.array(*[F.lit(i) for i in range(BRANCHES)])))
        at = F.pmod(F.xxhash64("node", "_b"), F.lit(SKETCH - trees)).cast("int") + F.lit(trees)
        level = chosen.select(F.xxhash64("node", "_b", _token(at)).alias("node"), "set_id", "n_shingles")
    return done.join(sets.select("set_id", "sketch"), "set_id")


def _roots(n: int) -> tuple[list[int], "callable"]:
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    return parent, find


def sketch_groups(pdf: pd.DataFrame, share: float = SKETCH_SHARE) -> list[np.ndarray]:
    """Rows of a node that are connected through sketches with at least ``share`` of their tokens equal.

    The low half of each token is compared: pairs that are equal by chance in it are sorted out on the full sets. Tokens
    of one hash function lie together, so counting runs along them.
    """
    s = np.stack([np.frombuffer(x, np.uint32) for x in pdf["sketch"]])
    n, least = len(s), math.ceil(share * s.shape[1])
    by_function = np.ascontiguousarray(s.astype(np.uint16).T)
    parent, find = _roots(n)
    for i in range(n - 1):
        same = (by_function[:, i + 1 :] == by_function[:, i : i + 1]).view(np.uint8)
        for j in np.flatnonzero(np.add.reduce(same, axis=0, dtype=np.uint8) >= least).tolist():
            a, b = find(i), find(i + 1 + j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    root = np.array([find(i) for i in range(n)])
    order = np.argsort(root, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(root[order])) + 1)
    return [g for g in groups if len(g) > 1]


def linked(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Each set with the first of its group, groups joined by pairs of ``percent`` similarity, on the full sets.

    One pass a set: its intersections with all later ones are counted together over their concatenated tokens.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    order = np.argsort(-size, kind="stable")  # only near sizes can be similar, and they lie together
    _, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size[order])])
    seen = np.zeros(int(flat.max()) + 1, bool)
    parent, find = _roots(n)
    for i in range(n - 1):
        mine = size[order[i]]
        last = i + 1
        lo, hi = i + 1, n
        while lo < hi:  # the last set that is not too small
            last = (lo + hi) // 2
            if 100 * size[order[last]] >= percent * mine:
                lo = last + 1
            else:
                hi = last
        last = lo
        if last == i + 1:
            continue
        seen[flat[start[i] : start[i + 1]]] = True
        both = np.add.reduceat(seen[flat[start[i + 1] : start[last]]], start[i + 1 : last] - start[i + 1], dtype=np.int64)
        seen[flat[start[i] : start[i + 1]]] = False
        union = mine + size[order[i + 1 : last]] - both
        for j in np.flatnonzero(100 * both >= percent * union).tolist():
            a, b = find(i), find(i + 1 + j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [(int(order[find(i)]), int(order[i])) for i in range(n) if find(i) != i]


def links(docs: DataFrame, sets: DataFrame, trees: int = TREES, depth: int = DEPTH, node: int = NODE) -> DataFrame:
    """(a, b): set ids of one group, every link confirmed on full sets or following from confirmed ones."""

    def units(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["set_id"].tolist()
        out = []
        for g in sketch_groups(pdf):
            members = sorted(ids[i] for i in g)
            unit = xxhash.xxh3_64_intdigest(b"".join(members))
            out += [(unit - (1 << 63), m) for m in members]
        return pd.DataFrame(out, columns=["unit", "set_id"])

    found = branches(sets, trees, depth, node).groupBy("node").applyInPandas(units, "unit long, set_id binary")
    # Equal groups of several trees are one unit: the tables of (unit, set) are small, texts come after.
    wanted = materialise(found.distinct(), "units")
    where = wanted.join(sets.select("set_id", "_doc", "place"), "set_id")
    placed = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("place"), "text")
    needed = where.select("_doc", "place").distinct()
    texts = placed.join(needed, (placed["_doc"].eqNullSafe(needed["_doc"])) & (placed["place"] == needed["place"]))
    texts = texts.select(placed["_doc"], placed["place"], "text")
    full = where.alias("w").join(texts.alias("t"), F.col("w._doc").eqNullSafe(F.col("t._doc")) & (F.col("w.place") == F.col("t.place")))

    def confirm(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("set_id").sort_values("set_id", ignore_index=True)  # repeated rows have one text
        ids = pdf["set_id"].tolist()
        pairs = linked([shingle_hashes(t.encode()) for t in pdf["text"]])
        return pd.DataFrame([(ids[a], ids[b]) for a, b in pairs], columns=["a", "b"])

    return full.select("unit", "set_id", "text").groupBy("unit").applyInPandas(confirm, "a binary, b binary").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id reachable, by alternating large-star and small-star rounds until nothing changes.

    The edges are what each round rewrites; a hot root's edges are one row per neighbour and are minimised before they
    are shuffled.
    """
    edges = materialise(edges.where("a <> b"), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large.where("a <> b"), "large-star")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = materialise(small, "small-star")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, trees: int = TREES, depth: int = DEPTH, node: int = NODE) -> DataFrame:
    """(doc_id, place, n_shingles, component_id, kept) for every document; ``place`` hashes the text.

    Documents are linked when 100 times the shared shingles reach 75 times all their shingles; ``component_id`` is the
    least ``doc_id`` reachable. Equal sets are one class and are never paired; a class is represented by one text.

    A null text, and one without words, has an empty set, links with nothing and is its own component. A text of fewer
    than five words is one shingle. Rows that repeat an id are kept or dropped alike; a null id is never a component's
    while another is there. An empty table gives no rows. Very long texts only make their own set longer. Other columns,
    whatever they are called, play no part.
    """
    rows = materialise(described(docs), "described")
    some = rows.where("n_shingles > 0")
    sets = some.groupBy("set_id").agg(F.min(F.struct("doc_id", "place")).alias("_at"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles"), F.min("doc_id").alias("_least"))
    sets = materialise(sets.select("set_id", "sketch", "n_shingles", F.col("_at.doc_id").alias("_doc"), F.col("_at.place").alias("place"), "_least"), "sets")
    roots = components(links(docs, sets, trees, depth, node))
    named = sets.select("set_id", "_least").join(roots.withColumnRenamed("id", "set_id"), "set_id", "left")
    named = materialise(named.select("set_id", "_least", F.coalesce("root", "set_id").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("_least").alias("_component"))
    classes = named.join(least, "root").select("set_id", "_component")
    out = rows.select("doc_id", "place", "n_shingles", "set_id").join(classes, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("_component"))
    return out.select("doc_id", "place", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with all their columns, whatever they are called; rows that repeat an id and text are one
    document. Null and empty texts stay. An empty table gives no rows."""
    stay = near_duplicates(docs.select("doc_id", "text"), **options).where("kept").select(F.col("doc_id").alias("_doc"), F.col("place").alias("_place")).distinct()
    rows, names = keep_columns(docs, "doc_id", "text")
    rows = rows.withColumn("_at", F.xxhash64("text"))
    found = rows.join(stay, rows["doc_id"].eqNullSafe(stay["_doc"]) & (rows["_at"] == stay["_place"]), "left_semi")
    return put_back(found, names)


@query("op4_near_dedup")
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("place")
