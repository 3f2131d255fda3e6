"""SimHash near-duplicates: 64-bit fingerprints, joined exactly within a Hamming radius by vantage-point trees.

A tree is grown on the driver over a bounded sample of the distinct fingerprints (at most about
`SAMPLE`, never over an eighth of them). Every node has a vantage point v and a radius m: fingerprints
with d(x, v) <= m go inside, the others outside. By the triangle bound two fingerprints within r of
each other can part at a node only if the inner one has d > m - r, so exactly those boundary
fingerprints are sent to the outer shard as well. Any two within r meet in one shard at least, and no
other branch is visited. A shard goes on splitting in its own task in the same way, down to blocks
whose pairs are all compared. A shard returns a spanning star for each linked group, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import in_arrow, local_components, prepare, spare, stored, texts
from .components import components

SAMPLE = 1 << 18
#: Fingerprints of the sample in a shard; shards number about SAMPLE / LEAF = 16384 at most.
LEAF = 16
#: Fingerprints that go down the tree at once.
ROUTED = 1 << 16
#: Within a shard, blocks of up to this many fingerprints are compared pair by pair.
BLOCK = 1024


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """A-Z lower-cased, words split at ASCII white space; a bit is 1 if set in over half the shingles' XXH64 (seed 42)."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    total, size = np.zeros(64, np.int64), 1 << 16
    for at in range(0, n, size):  # bounded memory for very long texts
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[k : k + shingle]), 42) for k in range(at, min(n, at + size))), np.uint64)
        total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprint_of(hashes: np.ndarray) -> int:
    """The fingerprint of given 64-bit hashes of shingles; 0 for none."""
    total, size = np.zeros(64, np.int64), 1 << 16
    for at in range(0, len(hashes), size):
        total += np.unpackbits(hashes[at : at + size].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long) for every row; a null or empty text has fingerprint 0."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in b.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    docs = texts(df, id_col, text_col)
    kind = docs.schema[0].dataType.simpleString()
    return in_arrow(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("t")), run, f"id {kind}, fp long")


def _split(d: np.ndarray, r: int) -> tuple[int, float]:
    """The radius that parts the distances d, and the share of the larger child with its boundary copies."""
    cuts = np.unique(np.quantile(d, (0.35, 0.42, 0.5, 0.58, 0.65)).astype(np.int64))
    cost = [max((d <= m).sum(), (d > m - r).sum()) / len(d) + ((d <= m) & (d > m - r)).mean() for m in cuts]
    k = int(np.argmin(cost))
    return int(cuts[k]), max((d <= cuts[k]).mean(), (d > cuts[k] - r).mean())


def _vantage(fp: np.ndarray, r: int, rng: np.random.Generator) -> tuple[np.uint64, int, float]:
    """Of a few fingerprints the one that parts a sample best."""
    some = fp if len(fp) <= 2048 else rng.choice(fp, 2048, replace=False)
    best = None
    for v in rng.choice(some, min(8, len(some)), replace=False):
        m, share = _split(np.bitwise_count(some ^ v).astype(np.int64), r)
        if best is None or share < best[2]:
            best = (v, m, share)
    return best


def grow(sample: np.ndarray, r: int, leaf: int = LEAF) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, radius, inside, outside); a child under 0 is shard -1 - child."""
    rng, nodes, shards = np.random.default_rng(7), [], 0

    def build(fp: np.ndarray) -> int:
        nonlocal shards
        if len(fp) > leaf:
            v, m, share = _vantage(fp, r, rng)
            if share < 0.9:
                d = np.bitwise_count(fp ^ v).astype(np.int64)
                nodes.append(None)
                k = len(nodes) - 1
                nodes[k] = (int(v), m, build(fp[d <= m]), build(fp[d > m]))
                return k
        shards += 1
        return -shards

    if build(sample) < 0:
        return []
    return nodes


def route(nodes: list[tuple[int, int, int, int]], fp: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """(position in fp, shard): the home shard of each fingerprint and the outer shards that its boundary reaches."""
    if not nodes:
        return np.arange(len(fp)), np.zeros(len(fp), np.int64)
    at, shard, todo = [], [], [(0, np.arange(len(fp)))]
    while todo:
        k, idx = todo.pop()
        if k < 0:
            at.append(idx)
            shard.append(np.full(len(idx), -1 - k))
        elif len(idx):
            v, m, inside, outside = nodes[k]
            d = np.bitwise_count(fp[idx] ^ np.uint64(v)).astype(np.int64)
            todo += [(inside, idx[d <= m]), (outside, idx[d > m - r])]
    return np.concatenate(at), np.concatenate(shard)


def pairs_within(fp: np.ndarray, r: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions i, j of all pairs of different fingerprints within r of each other, a block at a time (a pair may come twice)."""
    rng, todo = np.random.default_rng(7), [np.arange(len(fp))]
    while todo:
        idx = todo.pop()
        if len(idx) > BLOCK:
            v, m, share = _vantage(fp[idx], r, rng)
            if share < 0.9:
                d = np.bitwise_count(fp[idx] ^ v).astype(np.int64)
                todo += [idx[d <= m], idx[d > m - r]]
                continue
        for at in range(0, len(idx), BLOCK):
            x = fp[idx[at : at + BLOCK]]
            for to in range(at, len(idx), BLOCK):
                a, b = np.nonzero(np.bitwise_count(x[:, None] ^ fp[idx[to : to + BLOCK]][None, :]) <= r)
                on = a + at < b + to
                if on.any():
                    yield idx[a[on] + at], idx[b[on] + to]


def linked_within(fp: np.ndarray, r: int) -> np.ndarray:
    """The smallest position reachable from each fingerprint by links within r; a group of n needs no room for its pairs."""
    lab = np.arange(len(fp))
    for i, j in pairs_within(fp, r):
        i, j = lab[i], lab[j]
        if len(on := np.flatnonzero(i != j)):
            lab = local_components(len(fp), i[on], j[on])[lab]
    return lab


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links between the different fingerprints of distinct(fp long) that connect what all pairs within radius would."""
    spark = prepare(distinct.sparkSession)
    n = distinct.count()
    step = max(8, -(-n // SAMPLE))
    sample = distinct.where(F.pmod(F.xxhash64("fp", F.lit(11)), F.lit(step)) == 0).toPandas()["fp"]
    nodes = grow(np.unique(sample.to_numpy(np.int64).view(np.uint64)), radius)
    tree = spark.sparkContext.broadcast(nodes)  # bounded by the sample

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(fp: np.ndarray) -> pa.RecordBatch:
            at, shard = route(tree.value, fp.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp[at])], names=["shard", "fp"])

        some, n = [], 0
        for b in batches:
            some.append(b.column(0).to_numpy())
            n += len(some[-1])
            if n >= ROUTED:
                yield give(np.concatenate(some))
                some, n = [], 0
        if n:
            yield give(np.concatenate(some))

    def meet(t: pa.Table) -> pa.Table:
        fp = np.unique(t.column("fp").to_numpy().view(np.uint64))
        lab = linked_within(fp, radius)
        on = np.flatnonzero(lab != np.arange(len(fp)))
        return pa.table({"a": fp[on].view(np.int64), "b": fp[lab[on]].view(np.int64)})

    return distinct.select("fp").mapInArrow(send, "shard long, fp long").groupBy("shard").applyInArrow(meet, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp long, component_id): one row for each row of df.

    Documents are linked at `radius` or fewer differing bits; component_id is the smallest id reachable.
    Null and empty texts have fingerprint 0 and link like any other; rows with a null id keep their row,
    and their component has the smallest id that is not null (null if it has none). A bit set in exactly half
    the shingles is 0. Very long texts are read whole, in pieces of bounded memory. Repeated rows come back as
    often; an empty table gives no rows; other columns of df are ignored, so their names don't matter.
    """
    fps = stored(fingerprints(df, id_col, text_col, shingle), "simhash")
    reps = stored(fps.groupBy("fp").agg(F.min("id").alias("first")), "simhash-reps")
    return grouped(fps, components(links(reps.select("fp"), radius)), reps)


def grouped(fps: DataFrame, joined: DataFrame, reps: DataFrame | None = None) -> DataFrame:
    """(id, fp, component_id) of fps(id, fp) by the components joined(node, component) of the fingerprints."""
    reps = stored(fps.groupBy("fp").agg(F.min("id").alias("first")), "simhash-reps") if reps is None else reps
    named = reps.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of = stored(named.join(least, "component").select("fp", "component_id"), "simhash-classes")
    return fps.join(of, "fp").select("id", "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", near=near_duplicates, mark=fingerprint) -> DataFrame:
    """df's rows, as they are, of one document of each group of near duplicates: the one with the smallest id.

    An id stands for one document: of rows that share an id, one stays, that with the smallest hash of its
    text. Rows without an id stay if no row with an id is in their group. near gives the groups, mark the
    fingerprint of a text in them. Null and empty texts are a group like any other; an empty table gives no
    rows; further columns stay as they are, whatever their names.
    """
    found = near(df, id_col, text_col)
    name, fp_col = spare(df, "kept"), spare(df, "fp")
    columns = [F.col(f"`{c}`") for c in df.columns]
    kept = found.where("id = component_id").groupBy(F.col("id").alias(name)).agg(F.count("*").alias("rows"))
    kept = stored(kept, "kept-ids")
    named = df.withColumn(name, F.col(f"`{id_col}`"))
    one = named.join(kept.where("rows = 1").select(name), name, "left_semi").select(*columns)
    if not (again := kept.where("rows > 1").select(name)).isEmpty():
        least = F.min_by(F.struct(*columns), F.xxhash64(F.col(f"`{text_col}`")))  # partial sums: a frequent id is no hot key
        some = named.join(again, name, "left_semi").groupBy(name).agg(least.alias(fp_col))
        one = one.unionByName(some.select(*[F.col(f"`{fp_col}`")[c].alias(c) for c in df.columns]))
    if found.where("id is null").isEmpty():
        return one

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        text = b.column(b.num_columns - 1)
        fp = np.array([mark(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in text], np.uint64)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], names=[*b.schema.names[:-1], fp_col])

    unnamed = df.where(F.col(f"`{id_col}`").isNull()).withColumn(fp_col, F.col(f"`{text_col}`").cast("binary"))
    grouped_ = found.where("id is null and component_id is not null").select(F.col("fp").alias(fp_col)).distinct()
    alone = in_arrow(unnamed, run, StructType([*df.schema.fields, StructField(fp_col, LongType())])).join(grouped_, fp_col, "left_anti")
    return one.unionByName(alone.select(*columns))
