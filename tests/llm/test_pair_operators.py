"""SimHash, lattice hashing and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from hypothesis import example, given, settings
from hypothesis import strategies as st

from millrace.llm import lattice, queries, simhash
from millrace.llm.common import local_components
from millrace.llm.components import components


def groups(n, links):
    """Smallest member of each node's group, by plain search."""
    near = {k: {k} for k in range(n)}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for k in range(n):
        if k not in out:
            todo, seen = [k], {k}
            while todo:
                for x in near[todo.pop()] - seen:
                    seen.add(x)
                    todo.append(x)
            out |= dict.fromkeys(seen, min(seen))
    return [out[k] for k in range(n)]


@given(st.integers(1, 30).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=40))))
@example((6, [(0, 5), (1, 3), (2, 4), (2, 5), (3, 4)]))
@settings(max_examples=1000, deadline=None)
def test_local_components(x):
    n, links = x
    i, j = (np.array([p[k] for p in links], np.int64) for k in (0, 1))
    assert local_components(n, i, j).tolist() == groups(n, links)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(300, 340)] + [(400, k) for k in range(401, 460)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links + links[:20] + [(None, 3)], "a long, b long")).collect()}
    want = groups(460, links)
    assert got == {k: want[k] for k in {x for p in links if p[0] != p[1] for x in p}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# SimHash


def fingerprint(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))]
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text("aAbÉéΣ \t\n\x0b\x0c\r\x85\xa0　", max_size=60))
@settings(max_examples=300)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == fingerprint(text)


def close_sets(rng, n, spread):
    """Random fingerprints with near copies of some of them, and chains."""
    base = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(spread):
        x = rng.choice(base)
        for _ in range(rng.randrange(4)):
            x ^= 1 << rng.randrange(64)
        base.append(x)
    return np.unique(np.array(base, np.uint64))


@pytest.mark.parametrize("seed, n, spread", [(0, 50, 10), (1, 3000, 900), (2, 10, 2500), (3, 1, 0)])
def test_pairs_within_and_shards_lose_no_link(seed, n, spread, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)
    fp = close_sets(random.Random(seed), n, spread)
    d = np.bitwise_count(fp[:, None] ^ fp[None, :])
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(d <= 2, 1)), strict=True)}
    parts = list(simhash.pairs_within(fp, 2))
    i, j = (np.concatenate([np.zeros(0, np.int64), *[p[k] for p in parts]]) for k in (0, 1))
    assert simhash.linked_within(fp, 2).tolist() == groups(len(fp), list(zip(i.tolist(), j.tolist(), strict=True)))
    assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == want
    nodes = simhash.grow(fp[:: 3 if n > 1 else 1], 2, 4)
    at, shard = simhash.route(nodes, fp, 2)
    own = {}
    for a, s in zip(at.tolist(), shard.tolist(), strict=True):
        own.setdefault(a, set()).add(s)
    assert all(own[a] & own[b] for a, b in want) and set(own) == set(range(len(fp)))
    if n > 1000:
        assert len(set(shard.tolist())) > 50 and len(at) < 12 * len(fp)


def test_near_duplicates(docs_of, spark):
    rng = random.Random(4)
    words = ["w%d" % k for k in range(60)]
    texts = []
    for _ in range(60):
        own = [rng.choice(words) for _ in range(rng.randrange(1, 200))]
        texts.append(" ".join(own))
        for _ in range(rng.randrange(4)):
            copy = list(own)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    texts += ["", None, " ", texts[0], texts[0]]
    rng.shuffle(texts)
    fp = np.array([fingerprint(t or "") for t in texts], np.uint64)
    want = groups(len(texts), list(zip(*np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2), strict=True)))
    got = {r.id: (r.fp, r.component_id) for r in simhash.near_duplicates(docs_of(texts)).collect()}
    assert got == {k: (int(fp[k].view(np.int64)), want[k]) for k in range(len(texts))}
    kept = simhash.keep_one(docs_of(texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) and kept.columns == docs_of(texts).columns


def test_simhash_odd_rows(odd_docs, docs_of):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {r.component_id for r in got if r.fp == 0} == {0}  # empty, null and blank texts, the null id's too
    kept = simhash.keep_one(odd_docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd_docs.columns and ids.count(3) == 1 and 0 in ids and 1 not in ids and 8 not in ids
    assert [r.text for r in kept.where("doc_id is null").collect()] == ["a null id"]
    assert simhash.near_duplicates(docs_of([])).count() == 0 == simhash.keep_one(docs_of([])).count()


def test_op8_query(spark, sf):
    got = queries.op8_simhash_near_dedup(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts)
    fp = np.array([fingerprint(texts[i]) for i in ids], np.uint64)
    want = groups(len(ids), list(zip(*np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2), strict=True)))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fp[k]:016x}", ids[want[k]]) for k, i in enumerate(ids)}


# lattice


def test_e8():
    v = lattice.minimal_vectors()
    assert len({tuple(x) for x in v}) == 240 and np.allclose((v * v).sum(1), 2)
    x = np.random.default_rng(0).normal(0, 2, (300, 8))
    p = lattice.nearest_e8(x)
    assert ((p.sum(1) % 2 == 0) & (np.all(p % 1 == 0, 1) | np.all(p % 1 == 0.5, 1))).all()
    d = ((x - p) ** 2).sum(1)
    assert (d <= 1 + 1e-9).all()  # the covering radius
    assert all((d <= ((x - p - w) ** 2).sum(1) + 1e-9).all() for w in v)  # no neighbour is nearer


def near(rng, x, cosine):
    y = rng.standard_normal(len(x))
    y -= y @ x / (x @ x) * x
    return cosine * x / np.linalg.norm(x) + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y)


@pytest.mark.parametrize("dim", [5, 64, 200])
def test_recall_at_the_threshold(dim):
    rng = np.random.default_rng(dim)
    a = rng.standard_normal((400, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = np.array([near(rng, x, 0.95) for x in a])
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    met = np.mean([bool(set(x) & set(y)) for x, y in zip(lattice.cells(a).tolist(), lattice.cells(b).tolist(), strict=True)])
    assert met >= 0.99


def brute(vectors, ids):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    links = []
    for i, v in enumerate(vectors):
        for j in range(i):
            if ok[i] and ok[j] and len(v) == len(vectors[j]):
                a, b = np.array(v, float), np.array(vectors[j], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95:
                    links.append((j, i))
    comp = groups(len(ids), links)
    n = np.bincount(np.array(links, int).reshape(-1), minlength=len(ids))
    return {i: (int(n[k]), ids[comp[k]], comp[k] == k) for k, i in enumerate(ids)}


@pytest.mark.parametrize("block", [1024, 16])
def test_lattice_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK", block)
    rng = np.random.default_rng(1)
    vectors = []
    for k in range(60):
        x = rng.standard_normal(64)
        vectors.append(x)
        for _ in range(int(rng.integers(0, 4))):
            vectors.append(near(rng, x, 0.985))
        if k < 3:
            vectors += [near(rng, x, rng.uniform(0.99, 1)) * 7 for _ in range(40)] + [x] * 20
    vectors = [np.float32(v).tolist() for v in vectors]
    vectors += [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None, *[1.0] * 63], [1.0, 0.0], [1.0, 0.01], [1e-30] * 64, [2e-30] * 64]
    ids = list(range(0, 3 * len(vectors), 3))
    df = spark.createDataFrame(list(zip(ids, vectors, ["l"] * len(ids), strict=True)), "vec_id long, embedding array<float>, cell string").repartition(4)
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(df).collect()}
    want = brute(vectors, ids)
    links = sum(w[0] for w in want.values())
    assert set(got) == set(want) and all(got[i][0] <= want[i][0] for i in ids)
    assert sum(g[0] for g in got.values()) > 0.99 * links and sum(got[i] == want[i] for i in ids) > 0.98 * len(ids)


def test_lattice_odd_tables(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (4, [2.0, 4.0]), (9, [3.0, -1.0])], "vec_id long, embedding array<double>")
    got = sorted(((r.id, r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(df).collect()), key=str)
    assert got == [(4, 2, 4, True), (5, 2, 4, False), (5, 2, 4, False), (9, 0, 9, True), (None, 0, None, False)]
    assert lattice.near_duplicates(df.limit(0)).count() == 0
    assert lattice.near_duplicates(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).first()["kept"]


def test_op2_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op2_lattice_near_dedup(spark, sf).collect()}
    assert got == brute([r.embedding for r in rows], [r.vec_id for r in rows])


def test_columns(spark, sf):
    assert queries.op8_simhash_near_dedup(spark, sf).columns == ["doc_id", "fingerprint", "component_id"]
    assert queries.op2_lattice_near_dedup(spark, sf).dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
