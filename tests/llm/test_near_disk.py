"""What the near-duplicate stage writes, and that nothing is lost by writing less."""

import itertools
import os
import time

import corpus_pipeline
import numpy as np
import pyarrow as pa
from millrace import workspace
from millrace.llm import bpe, common, jaccard, mixing
from millrace.llm import queries as q
from pyspark.sql import functions as F


def _rows(sets, often=None):
    """The listed rows of sets of hashes, whose keys are their numbers."""
    often, cols = np.zeros(jaccard.CELLS, np.uint8) if often is None else often, [[], [], [], []]
    for key, s in enumerate(sets):
        token, part, place, size = jaccard._prefix(s, often)
        for c, x in zip(cols, ((token >> np.uint64(64 - jaccard.TOKEN)).astype(np.int64), np.full(len(token), key), len(s) << 32 | part, place << 32 | size), strict=True):
            c.append(x)
    return [np.concatenate(c) for c in cols]


def _table(cols):
    return pa.table(dict(zip(("token", "key", "of", "at"), cols, strict=True)))


def test_packed_rows_come_back_in_few_bytes():
    rng = np.random.default_rng(1)
    for sizes in ((), (1,), (1, 4, 700, 900, 1100, 5000), tuple(rng.integers(1, 1500, 300))):
        rows = _rows([np.unique(rng.integers(0, 1 << 64, n, np.uint64)) for n in sizes]) if sizes else [np.zeros(0, np.int64)] * 4
        rows[1] = (rows[1] + 1) * -(0x9E3779B97F4A7C15 >> 8)  # any long
        by = np.argsort(rows[0], kind="stable")
        body, keys = jaccard.packed(*rows)
        assert all((x[by] == y).all() for x, y in zip(rows, jaccard.unpacked(body, keys), strict=True))
    assert len(body) + len(keys) < 16 * len(by)


def test_texts_that_only_share_late_passages_are_not_listed_on():
    """All sets share 60 frequent shingles, the last of those they are listed under: no pair may be alike, so no row stays."""
    rng = np.random.default_rng(2)
    often = np.zeros(jaccard.CELLS, np.uint8)
    some = lambda n: rng.integers(0, 1 << 64, n, np.uint64)
    passage, last = some(60), [some(190) for _ in range(6)]
    often[jaccard._cell(passage)] = 9
    often[jaccard._cell(np.concatenate(last))] = 20
    sets = [np.unique(np.r_[some(50), passage, x]) for x in last]
    rows = _rows(sets, often)
    shared = np.isin(rows[0], (passage >> np.uint64(64 - jaccard.TOKEN)).astype(np.int64))
    assert shared.sum() > 6
    assert jaccard.meeting(_table(rows)).num_rows == 0


def test_no_pair_leaves_before_labels_are_known():
    """Also in runs longer than those that are looked through, with copies of rows, and of sets in several parts."""
    rng = np.random.default_rng(3)
    sets = []
    for n in (1, 5, 40, 300, 820, 1024, 1025, 1400, 2100, 4200):
        base = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        for k in range(24 if n == 300 else 4):
            change = k * n // (200 if n == 300 else 30)
            sets.append(np.unique(np.r_[rng.permutation(base)[change:], rng.integers(0, 1 << 64, change + k % 2, np.uint64)]))
    often = rng.integers(0, 9, jaccard.CELLS).astype(np.uint8)
    rows = [np.r_[x, x] for x in _rows(sets, often)]
    met = jaccard.meeting(_table(rows))
    assert met.num_rows == met.group_by(met.column_names).aggregate([]).num_rows
    keys = {}
    for token, key in zip(met.column("token").to_pylist(), met.column("key").to_pylist(), strict=True):
        keys.setdefault(token, set()).add(key)
    pairs = {p for x in keys.values() for p in itertools.combinations(sorted(x), 2)}
    alike = lambda x, y: 9 * len(np.intersect1d(x, y)) >= 4 * (len(x) + len(y))
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(sets[i]) and len(sets[j]) and not np.array_equal(sets[i], sets[j]) and alike(sets[i], sets[j])}
    assert len(want) > 100 and want <= pairs


def test_the_stage_leaves_only_what_its_result_reads(docs_of):
    before = set(workspace._made)
    words = [f"w{k % 97} v{k % 31}" for k in range(400)]
    out = jaccard.near_duplicates(docs_of([" ".join(words[k:]) for k in (0, 1, 2, 90)] + ["", None]))
    left = {os.path.basename(x).rsplit("-", 1)[0] for x in workspace._made if x not in before}
    assert left == {"jaccard-ids", "simhash-reps", "simhash-classes"}
    assert {r.id: r.component_id for r in out.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4}


def test_the_mixture_writes_no_texts_and_draws_the_same(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.union(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))).union(docs.limit(1)).union(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    written = []
    keep = lambda df, name: written.append((name, df.columns)) or common.stored(df, name)
    monkeypatch.setattr(corpus_pipeline, "stored", keep)
    out = corpus_pipeline.mixture(spark, docs, sf)
    assert [n for n, _ in written] == ["pipeline-counts"] and "text" not in written[0][1]
    path, pattern = q.byte_bpe()
    whole = common.stored(bpe.with_counts(docs, path, pattern, "n"), "whole")
    want = mixing.mix(whole, q.mix_domain(F.col("source")), q.mix_weight(), share=q.MIX_SHARE, epochs=q.MIX_EPOCHS, seed=q.MIX_SEED, tokens=F.col("n")).select(*docs.columns)
    assert out.columns == docs.columns and out.count() == want.count() > 0
    assert out.exceptAll(want).isEmpty() and want.exceptAll(out).isEmpty()


def test_shuffle_files_go_with_their_query(spark):
    files = lambda: {f for f in (x.getName() for x in _local_files(spark)) if f.startswith("shuffle_")}
    before = files()
    key = common.FILES_GO
    was = spark.conf.get(key, None)
    table = common.stored(spark.range(50_000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "shuffled")
    kept = common.checkpointed(spark.range(50_000).repartition(3, "id"))
    for _ in range(100):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(key, None) == was
    assert table.count() == 7 and kept.count() == 50_000


def _local_files(spark):
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return [files.apply(k) for k in range(files.size())]
