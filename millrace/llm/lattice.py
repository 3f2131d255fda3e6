"""Embedding near-duplicates by lattice hashing: E8 cells of random projections, verified by cosine.

Each of `TABLES` tables turns a vector by a seeded rotation, takes three groups of eight coordinates and
decodes each to its nearest E8 lattice point; the three points are the vector's cell. It is also entered
in the `PROBES` neighbouring cells whose points are next nearest. Vectors that share a cell are compared
in double precision. At a cosine of 0.95, the least that links, a random pair of 64 dimensions shares a
cell of one table with probability 0.75, of three with 0.986, of four with 0.998 and of all six with 0.9995
(measured, both sides probed); closer pairs are missed far more rarely.

Exact copies are grouped first. Cells with one vector are dropped before any vector moves, and so are
cells all of whose members share one larger cell: of a dense group, one cell stays. Large cells are
compared block against block, so a task holds two blocks, and a row of tiles of their products at a time. A pair that shares several cells counts in the smallest one only, which the tasks work out from
the vectors' cell lists; they return sums and spanning stars, never pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, local_components, prepare, release, stored
from .components import components

TABLES, GROUPS, PROBES = 6, 3, 7
#: Lattice scale for 64 dimensions and a cosine of 0.95.
SCALE = 3.25
#: Ids of up to this many cells with company are broadcast to find the vectors in them; more are joined by a shuffle.
BROADCAST_CELLS = 1_000_000
#: Rows of a block of a large cell, and rows of a tile and cells of it that are looked at at once.
BLOCK, TILE, CELLS = 2048, 512, 2048


@lru_cache(1)
def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries +-1, or eight entries +-1/2 with an even number of minus signs."""
    pairs = [np.eye(8)[i] * s + np.eye(8)[j] * t for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    halves = [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(pairs + halves)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: if the sum is odd, the worst rounded entry goes the other way."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1).astype(np.int64) & 1)
    e = x[odd] - r[odd]
    worst = np.abs(e).argmax(1)
    r[odd, worst] += np.where(e[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the nearer of D8 and D8 shifted by 1/2."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@lru_cache(8)
def _table(dim: int, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(projection, hash coefficients of lattice points, hash offsets of the neighbours of each group)."""
    rng, d = np.random.default_rng((dim, table, 8)), max(dim, 8 * GROUPS)
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0][:dim, : 8 * GROUPS] * SCALE * (d / 64) ** 0.5
    coef = rng.integers(-(1 << 62), 1 << 62, 8 * GROUPS, dtype=np.int64)
    step = (2 * minimal_vectors()).astype(np.int64)
    with np.errstate(over="ignore"):
        return turn, coef, np.concatenate([step @ coef[8 * g : 8 * g + 8] for g in range(GROUPS)])


def cells(x: np.ndarray) -> np.ndarray:
    """For rows of unit vectors the hashes of their cells in all tables: TABLES * (1 + PROBES) columns."""
    out, near = [], minimal_vectors()
    for t in range(TABLES):
        turn, coef, offset = _table(x.shape[1], t)
        y = x @ turn
        gain, key = [], np.zeros(len(x), np.int64)
        for g in range(GROUPS):
            part = y[:, 8 * g : 8 * g + 8]
            p = nearest_e8(part)
            gain.append((part - p) @ near.T)
            key += (2 * p).astype(np.int64) @ coef[8 * g : 8 * g + 8]
        probe = np.argpartition(-np.concatenate(gain, 1), PROBES, axis=1)[:, :PROBES]
        out += [key[:, None], key[:, None] + offset[probe]]
    return np.concatenate(out, 1)


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_length(v: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) for each length of the lists."""
    size = np.diff(v.offsets.to_numpy())
    flat = v.flatten().to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(size)])[:-1]
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        yield rows, _unit(flat[(at[rows][:, None] + np.arange(dim)).reshape(-1)], int(dim))


class _Rows:
    """Rows of a cell as arrays: id, m, block, vectors and cell lists, the last two flat with their lengths."""

    def __init__(self, **columns: np.ndarray):
        self.__dict__.update(columns)

    @classmethod
    def of(cls, b: pa.RecordBatch) -> _Rows:
        flat = lambda c: b.column(c).flatten().to_numpy(zero_copy_only=False)
        size = lambda c: np.diff(b.column(c).offsets.to_numpy())
        one = {c: b.column(c).to_numpy() for c in ("gid", "m", "block")}
        return cls(**one, v=flat("v"), v_size=size("v"), cells=flat("cells"), cells_size=size("cells"))

    def ends(self) -> None:
        self.v_end, self.cells_end = (np.concatenate([[0], np.cumsum(x)]) for x in (self.v_size, self.cells_size))

    def cut(self, a: int, b: int) -> _Rows:
        one = {c: getattr(self, c)[a:b] for c in ("gid", "m", "block", "v_size", "cells_size")}
        return _Rows(**one, v=self.v[self.v_end[a] : self.v_end[b]], cells=self.cells[self.cells_end[a] : self.cells_end[b]])

    @classmethod
    def joined(cls, parts: list[_Rows]) -> _Rows:
        return parts[0] if len(parts) == 1 else cls(**{c: np.concatenate([getattr(p, c) for p in parts]) for c in ("gid", "m", "block", "v_size", "cells_size", "v", "cells")})

    def take(self, at: np.ndarray) -> _Rows:
        self.ends()
        pick = lambda x, end, size: np.concatenate([x[:0], *[x[end[i] : end[i] + size[i]] for i in at]])
        one = {c: getattr(self, c)[at] for c in ("gid", "m", "block", "v_size", "cells_size")}
        return _Rows(**one, v=pick(self.v, self.v_end, self.v_size), cells=pick(self.cells, self.cells_end, self.cells_size))


def _compare(key: tuple[int, int, int], c: _Rows, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links within a block of a cell, or between two blocks: (ids, other vectors linked, smallest id linked here).

    Pairs that meet in a smaller cell as well aren't counted here."""
    if len(np.unique(c.v_size)) > 1:  # lengths don't mix
        parts = [_compare(key, c.take(np.flatnonzero(c.v_size == k)), cosine) for k in np.unique(c.v_size)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    n = len(c.gid)
    x = _unit(c.v, int(c.v_size[0]))
    order = np.argsort(c.gid, kind="stable")  # the smallest index of a component is then its smallest id
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    row, before = np.repeat(np.arange(n), c.cells_size), c.cells < key[0]
    cell, at, often = np.unique(c.cells[before], return_inverse=True, return_counts=True)
    at, row = at[often[at] > 1], row[before][often[at] > 1]  # a cell of one row is shared by none
    place = np.cumsum(often > 1) - 1
    at, shared = place[at], int((often > 1).sum())
    sums, lab = np.zeros(n, np.int64), np.arange(n)
    for a in range(0, n, TILE):
        tile = slice(a, min(n, a + TILE))
        hit = x[tile] @ x.T >= cosine
        hit[np.arange(tile.stop - a), np.arange(a, tile.stop)] = False
        if key[1] != key[2]:
            hit &= c.block[tile, None] != c.block[None, :]
        if not hit.any():
            continue
        i, j = np.nonzero(hit)
        i, j = lab[rank[i + a]], lab[rank[j]]
        if len(on := np.flatnonzero(i != j)):
            lab = local_components(n, i[on], j[on])[lab]
        for k in range(0, shared, CELLS):
            some = (at >= k) & (at < k + CELLS)
            z = np.zeros((n, min(CELLS, shared - k)), np.float32)
            z[row[some], at[some] - k] = 1
            hit &= z[tile] @ z.T == 0
        sums[tile] = hit @ c.m
    return c.gid, sums, c.gid[order][lab[rank]]


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """(id, n_links, component_id, kept): one row for each row of df.

    n_links: other vectors found with that cosine or more, component_id: the smallest id reachable by
    links, kept: id = component_id. Vectors that are null, empty, zero, or hold nulls or numbers that
    aren't finite link with nothing, nor do vectors of different lengths. A row without an id has no
    links, no component and isn't kept. An id with several vectors counts as one node for components.
    Repeated rows are copies of each other. Ties: the smallest id names a component. An empty table gives
    no rows; other columns are ignored, so their names don't matter. Vectors may have any length.
    """
    spark = prepare(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("v"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.coalesce(F.col("id").isNotNull() & F.forall("v", number) & F.exists("v", lambda x: x != 0), F.lit(False))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    reps = stored(rows.where(usable).groupBy("v").agg(F.min("id").alias("gid"), F.count("*").alias("m")), "lattice-reps")

    def enter(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = b.column(0).to_numpy()
        for at in range(0, len(ids), 512):
            for rows, x in _by_length(b.column(1).slice(at, 512)):
                k = cells(x)
                yield pa.RecordBatch.from_arrays([pa.array(k.reshape(-1)), pa.array(np.repeat(ids[at + rows], k.shape[1]))], names=["cell", "gid"])

    entered = stored(in_arrow(reps.select("gid", "v"), enter, "cell long, gid long"), "lattice-cells")
    shared = stored(entered.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell"), "lattice-shared")
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_CELLS else shared
    inside = stored(entered.join(shared, "cell").distinct(), "lattice-inside")
    members = stored(inside.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "lattice-members")
    ranked = inside.join(members, "cell").groupBy("gid").agg(F.collect_list(F.struct("n", "cell")).alias("all"))  # at most TABLES * (1 + PROBES)
    ranked = ranked.withColumn("top", F.array_max("all"))
    # the largest cell of all members of a cell holds all their pairs, so the cell itself can go
    used = ranked.select(F.explode("all").alias("one"), "top").groupBy("one.cell", "one.n").agg(F.min("top").alias("least"), F.max("top").alias("most"))
    used = stored(used.where("least <> most or least.cell = cell").select("cell", "n"), "lattice-used")
    held = stored(inside.join(used, "cell"), "lattice-held")
    own = held.groupBy("gid").agg(F.array_sort(F.collect_set("cell")).alias("cells"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("gid", F.lit(2)), blocks).cast("int")
    dealt = held.withColumn("blocks", blocks).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cell", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "gid")
    full = dealt.join(reps.select("gid", "v", "m").join(own, "gid"), "gid").repartition(int(parts), "cell", "one", "two").sortWithinPartitions("cell", "one", "two")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gid", "n", "root"]

        def give(out: list[tuple]) -> pa.RecordBatch:
            g, n, r = (np.concatenate([o[k] for o in out]) for k in range(3))
            on = (n > 0) | (g != r)
            return pa.RecordBatch.from_arrays([pa.array(g[on]), pa.array(n[on].astype(np.int64)), pa.array(r[on])], names=names)

        part, now, out = [], None, []
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy() for c in ("cell", "one", "two")], 1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            rows = _Rows.of(b)
            rows.ends()
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                k = tuple(key[s].tolist())
                if k != now and part:
                    out.append(_compare(now, _Rows.joined(part), cosine))
                    part = []
                now = k
                part.append(rows.cut(s, e))
            if len(out) > 1000:
                yield give(out)
                out = []
        if part:
            out.append(_compare(now, _Rows.joined(part), cosine))
        if out:
            yield give(out)
        release()

    found = stored(full.mapInArrow(verify, "gid long, n long, root long"), "lattice-links")
    sums = found.groupBy("gid").agg(F.sum("n").alias("n"))
    of = components(found.where("gid != root").select(F.col("gid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "gid")
    known = reps.join(sums, "gid", "left").join(of, "gid", "left").select("v", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "gid").alias("component_id"))
    known = stored(known, "lattice-classes")
    good = rows.where(usable).join(known, "v").select("id", "n_links", "component_id")
    alone = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.union(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
