"""Mixing, centroid clusters and runs: edge cases, and brute-force versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerweave.llm import ann, centroids, mixing, periodic, quality, queries
from ledgerweave.workspace import Workspace


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


# --- mixing ----------------------------------------------------------------------


def shared_out(sizes: dict, weights: dict, most: int = 3) -> dict:
    """Targets by sharing again and again what full sources can't take."""
    rest, open_, targets = sum(sizes.values()), set(sizes), {}
    while open_:
        level = rest / sum(weights[s] for s in open_)
        full = {s for s in open_ if most * sizes[s] <= level * weights[s]}
        if not full:
            return targets | {s: level * weights[s] for s in open_}
        for s in full:
            targets[s] = most * sizes[s]
            rest -= targets[s]
        open_ -= full
    return targets


def sources_frame(spark, seed=3, n=400):
    rng = random.Random(seed)
    names = [None, "", "b", "B", "é", "😀", "zz", "￿", "one", "hot"]
    odds = [3, 1, 2, 5, 1, 1, 9, 2, 1, 60]
    rows = [(i, rng.choices(names, odds)[0], " \n".join(["w"] * rng.randint(0, 40)) or None) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string"), rows


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_mix_targets_and_copies(spark, broadcast):
    frame, rows = sources_frame(spark)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + n_words(t)
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: 1 + i % 3 for i, s in enumerate(names)}
    expected = shared_out(sizes, weights)
    planned = mixing.plan(Workspace(spark, "mix"), frame, broadcast_sources=broadcast)
    found = planned.collect()
    again = mixing.plan(Workspace(spark, "mix"), frame.repartition(7), broadcast_sources=broadcast).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, again), key=str)
    assert len(found) == len(rows) and sum(expected.values()) == pytest.approx(sum(sizes.values()))
    for r in found:
        assert r["size"] == n_words(rows[r.doc_id][2]) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(expected[r.source])
        assert np.floor(r.rate) <= r.copies <= np.ceil(r.rate) <= 3
    for s in sizes:
        own = [r for r in found if r.source == s]
        share = own[0].rate % 1
        spread = (share * (1 - share) * sum(r["size"] ** 2 for r in own)) ** 0.5
        assert abs(sum(r["size"] * r.copies for r in own) - own[0].target) <= 4.5 * spread + 1e-6


def test_emitted_copies(spark):
    frame, rows = sources_frame(spark, n=60)
    frame = frame.withColumn("Copies", F.lit("clash")).withColumn("TARGET", F.lit(1))
    ws = Workspace(spark, "mix")
    found = mixing.fit(ws, frame)
    counted = {r.doc_id: r.copies for r in mixing.with_copies(ws, frame, found).collect()}
    emitted = mixing.emit(ws, frame, found).collect()
    assert sorted((r.doc_id, r["copy"], r.text or "") for r in emitted) == sorted(
        (i, c, t or "") for i, _, t in rows for c in range(1, counted[i] + 1)
    )


def test_mix_edge_cases(spark, docs, none):
    def plan(frame):
        return mixing.plan(Workspace(spark, "mix"), frame, source="lang").collect()

    assert plan(none) == []
    rows = plan(docs)
    assert {r.doc_id: r["size"] for r in rows} == {r.doc_id: n_words(r.text) for r in docs.collect()}
    assert all(r.copies == 0 and r.target == 0 for r in plan(docs.where("doc_id <= 2")))
    twice = docs.withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id"))).union(docs.select(docs.columns))
    assert len(plan(twice)) == 2 * docs.count()


# --- clusters ----------------------------------------------------------------------


def lloyd(vectors: list, clusters: int, rounds: int):
    """``vectors``: (key, components), all kept; integer arithmetic without limits."""
    scaled = [(k, [int(np.floor(64.0 * float(x))) for x in v]) for k, v in vectors]
    named = sorted(scaled, key=lambda kv: (hashlib.sha256(f"1:{kv[0]}".encode()).hexdigest(), kv[1]))
    centers = [v for _, v in named[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centers))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in scaled]
        for i in range(len(centers)):
            inside = [v for (_, v), o in zip(scaled, own) if o == i]
            if inside:
                centers[i] = [sum(column) // len(inside) for column in zip(*inside)]
    return [(k, *reversed(nearest(v))) for k, v in scaled], centers


def test_clusters_equal_plain_rounds(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.integers(-3, 4, (300, 5)) / 7)]
    rows += [(1000 + i, rows[i][1]) for i in range(40)]  # equal vectors, and ties
    rows += [(7, rows[7][1]), (7, rows[8][1])]  # a key more than once
    odd = [(1, None), (2, []), (3, [1.0] * 4), (4, [1.0, None, 1.0, 1.0, 1.0]), (5, [float("nan")] * 5), (6, [float("inf")] * 5)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("Cluster", F.lit("clash"))
    for clusters, rounds in ((16, 3), (4, 0), (1, 2)):
        found, centers = centroids.cluster(Workspace(spark, "c"), frame.repartition(5), clusters, rounds, 5)
        expected, plain = lloyd(rows, clusters, rounds)
        assert centers.tolist() == plain
        assert sorted((r.vec_id, r.cluster, r.distance) for r in found.collect()) == sorted(expected)
    joined = centroids.with_inertia(found, centers).collect()
    assert {r.inertia for r in joined} == {sum(e[2] for e in expected)}
    assert {r.centroid_sha256 for r in joined} == {hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in plain}


def test_clusters_edge_cases(spark):
    empty = spark.createDataFrame([(1, None), (None, [])], "vec_id long, embedding array<float>")
    found, centers = centroids.cluster(Workspace(spark, "c"), empty, 16, 3, 64)
    assert centroids.with_inertia(found, centers).count() == 0
    few = spark.createDataFrame([(1, [0.5, -0.5]), (None, [0.25, 3.0])], "vec_id long, embedding array<float>")
    found, centers = centroids.cluster(Workspace(spark, "c"), few, 16, 3, 2)
    assert centers.tolist() == [[32, -32], [16, 192]] and {r.distance for r in found.collect()} == {0}
    huge = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="components"):
        centroids.cluster(Workspace(spark, "c"), huge, 16, 3, 2)


# --- runs ----------------------------------------------------------------------


def plain_runs(words, min_words=6, min_periods=4):
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            long = i + q - start
            if long >= max(min_words, min_periods * q):
                part = words[start : start + long]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    found.append((start, long, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_lyndon(codes):
    def is_lyndon(w):
        return all(w < w[k:] for k in range(1, len(w)))

    return [max(m for m in range(1, len(codes) - i + 1) if is_lyndon(codes[i : i + m])) for i in range(len(codes))]


def test_groups_give_longest_lyndon_words():
    rng = random.Random(1)
    for _ in range(300):
        kinds = rng.randint(1, 4)
        codes = [rng.randrange(kinds) for _ in range(rng.randint(0, 24))]
        assert periodic.lyndon_lengths(codes, kinds) == plain_lyndon(codes)


@pytest.mark.parametrize("least, periods", [(6, 4), (2, 2), (1, 3)])
def test_runs_equal_plain_search(least, periods):
    rng = random.Random(2)
    for _ in range(500):
        n, kinds = rng.randint(0, 60), rng.randint(1, 5)
        words = [rng.randrange(kinds) for _ in range(n)]
        if n > 4 and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(3, 10)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert periodic.runs_of(words, least, periods) == plain_runs(words, least, periods)


def test_long_runs():
    assert periodic.runs_of(["x"] * 100_000) == [(0, 100_000, 1)]
    assert periodic.runs_of([i % 3000 for i in range(100_000)]) == [(0, 100_000, 3000)]
    assert periodic.runs_of(list(range(50_000))) == []


def test_runs_edge_cases(spark, docs, none):
    docs = docs.withColumn("RUNS", F.lit("clash"))
    found = {r.doc_id: r for r in periodic.find_runs(docs).collect()}
    assert periodic.find_runs(none).count() == 0
    assert [found[i].n_words for i in range(4)] == [0, 0, 0, 1] and found[0].collapsed == ""
    assert [tuple(r) for r in found[8].runs] == [(0, 30_000, 1)] and found[8].collapsed == "word"
    assert found[4].collapsed == found[5].collapsed == docs.where("doc_id = 4").first().text


def test_the_query_equals_a_plain_version(spark, tmp_path):
    rng = random.Random(8)
    texts = [None, "", " \t", "a", "b\x0bb  b\nb b b b b b"]
    texts += [" ".join(rng.choice("abcdef") + "é" * rng.randint(0, 1) for _ in range(rng.randint(1, 90))) for _ in range(150)]
    frame = spark.createDataFrame([*enumerate(texts), (None, "x x x x x x x")], "doc_id long, text string")
    frame.withColumn("n_runs", F.lit(9)).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op13_runs(spark, str(tmp_path)).collect()}
    assert len(found) == len(texts) + 1 and found[None].n_runs == 1
    spliced = 0
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, spliced = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)], spliced + 1
        runs = plain_runs(words)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        row = found[i]
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        assert row.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        left = " ".join(w for k, w in enumerate(words) if k not in gone)
        assert row.collapsed_sha256 == hashlib.sha256(left.encode()).hexdigest()
    assert spliced > 5
    types = dict(queries.op13_runs(spark, str(tmp_path)).dtypes)
    assert set(types.values()) == {"bigint", "string"}


# --- earlier operators on odd tables ---------------------------------------------------


def test_statistics_give_way_to_clashing_names(spark):
    frame = spark.createDataFrame([(1, "a b c", "x", 5.0)], "doc_id long, text string, N_words string, digit_share double")
    found = quality.statistics(frame).first()
    assert (found.doc_id, found.n_words, found.digit_share) == (1, 3, 0.0)


def test_neighbours_of_repeated_keys(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(60, 8)))]
    frame = spark.createDataFrame(rows + rows[:20] + [(5, rows[7][1])], "vec_id long, embedding array<double>")
    found = ann.nearest(Workspace(spark, "ann"), frame, F.col("vec_id") % 20 == 0, k=5, probes=32).collect()
    vectors = {}
    for i, v in [*rows, (5, rows[7][1])]:
        vectors.setdefault(i, []).append(v)
    for q in (0, 20, 40):
        near = sorted((-max(np.dot(rows[q][1], v) for v in vs), i) for i, vs in vectors.items() if i != q)[:5]
        assert [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] == [i for _, i in near]
