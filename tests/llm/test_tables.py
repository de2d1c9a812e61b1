"""Near copies, neighbours, URLs, quality rules, shards and the pipeline: edge cases, and brute-force versions."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerweave.llm import ann, neardup, quality, sharding, urls
from ledgerweave.workspace import Workspace


def copies(seed=4, families=12, members=14):
    """Families of texts with a word changed here and there, so that similarities lie on both sides of the limit."""
    rng = np.random.default_rng(seed)
    texts = [None, "", "one two", "ONE two", "one", "x " * 5_000]
    for _ in range(families):
        base = [f"w{i}" for i in rng.integers(0, 5_000, 60)]
        for m in range(members):
            words = list(base)
            for at in rng.integers(0, 60, m // 3):
                words[at] = f"n{rng.integers(0, 10**6)}"
            texts.append(" ".join(words))
        texts.append(texts[-1])
    return texts


def classes(texts, words, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        n = min(words, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def test_near_copies_equal_all_pairs(spark, monkeypatch):
    texts = copies()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("KEPT", F.lit(0))
    for words, percent, few in ((3, 85, 8), (5, 80, 1)):
        monkeypatch.setattr(neardup, "FEW", few)
        expected, sizes = classes(texts, words, percent)
        found = neardup.near_copies(Workspace(spark, "n"), frame, words=words, percent=percent).collect()
        assert {r.doc_id: r.component_id for r in found} == dict(enumerate(expected))
        assert {r.doc_id: r.n_shingles for r in found} == dict(enumerate(sizes))
        assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_copies_edge_cases(spark, docs, none):
    assert neardup.near_copies(Workspace(spark, "n"), none).count() == 0
    twice = docs.select("doc_id", "text").union(docs.select(F.lit(None).cast("long"), "text"))
    rows = neardup.near_copies(Workspace(spark, "n"), twice.union(docs.select("doc_id", "text"))).collect()
    assert len(rows) == 3 * docs.count()
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    assert {r.component_id for r in rows if r.doc_id in (0, 1, 2)} == {0, 1, 2}


def test_distance_misses_hardly_any():
    rng = np.random.default_rng(0)
    for percent in (80, 85):
        r = neardup.distance(percent, neardup.POSITIONS, 16)
        assert (rng.binomial(neardup.POSITIONS, 1 - percent / 100, 200_000) > r).mean() < 1e-4
        assert 2 * len(neardup.chunks(r)) > r


def test_neighbours(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(600, 16)).astype(np.float32)
    v[300:400] = v[40]  # a query's vector and a hundred copies
    rows = [(i, [float(x) for x in x]) for i, x in enumerate(v)]
    rows += [(600, None), (620, [0.0] * 16), (640, [float("nan")] * 16), (660, [None] * 16), (680, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("Rank", F.lit("x"))
    found = ann.nearest(Workspace(spark, "a"), frame, F.col("vec_id") % 20 == 0).toPandas()
    assert set(found.query_id) == set(range(0, 600, 20))
    scores = v.astype(float) @ v.astype(float).T
    hits = 0
    for q, part in found.groupby("query_id"):
        order = np.lexsort((np.arange(600), -scores[q]))
        best = [i for i in order if i != q][:20]
        got = part.sort_values("rank")
        assert got["rank"].tolist() == list(range(1, 21)) and q not in got.vec_id.values
        assert np.allclose(got.score, scores[q][got.vec_id]) and (np.diff(got.score) <= 0).all()
        hits += len(set(best) & set(got.vec_id))
    assert hits >= 0.9 * 600
    copied = found[found.query_id == 40].sort_values("rank")
    assert copied.vec_id.tolist() == list(range(300, 320))
    assert ann.nearest(Workspace(spark, "a"), frame.where("vec_id >= 600 and vec_id < 680"), F.lit(True)).count() == 0


def test_urls(spark):
    rules = [urls.Rule("allow", "com/"), urls.Rule("block", "a-b.com/x/"), urls.Rule("block", "net/pre"),
             urls.Rule("block", "*.bad.*", 1), urls.Rule("block", "spam.*/*/ads/", 1)]
    cases = {
        "http://COM/": "com/", "http://x.com": None, "https://q.a-b.com/x/1?y": "a-b.com/x/", "http://a-b.com/X/": "com/",
        "http://aXb.com/x/": "com/", "http://n.net/prefix": "net/pre", "http://n.net/Pre": None, "x": None, "": None,
        None: None, "http://u.bad.org/": "*.bad.*", "http://spam.org/k/ads/1": "spam.*/*/ads/", "http://notcom/": None,
        "http://a.com:80/": None,
    }
    rows = [(i, u) for i, u in enumerate(cases)] + [(0, "http://COM/"), (None, "http://COM/")]
    frame = spark.createDataFrame(rows, "page_id long, url string").withColumn("HOST", F.lit(1))
    found = urls.verdicts(frame, rules).collect()
    assert len(found) == len(rows)
    by = {r.page_id: r for r in found}
    for i, (_, rule) in enumerate(cases.items()):
        assert by[i].pattern == rule and by[i].verdict == ("allow" if rule in (None, "com/") else "block")
    assert (by[0].host, by[0].path, by[9].host, by[9].path) == ("com", "/", "", "")
    assert urls.verdicts(frame.where("false"), rules).count() == 0
    assert urls.verdicts(frame, []).where("verdict <> 'allow'").count() == 0


def test_many_url_rules_equal_plain_matching(spark):
    """Thousands of rules with wild cards, exceptions and tiers against every rule tried on every URL."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    pick = lambda: str(rng.choice(words))
    shapes = [lambda: f"{pick()}.com/", lambda: f"{pick()}.{pick()}.com/{pick()}/", lambda: f"{pick()}.*", lambda: f"*/{pick()}/*.gif",
              lambda: f"{pick()}-{pick()}.org/{pick()}", lambda: f"{pick()}*{pick()}.net/"]
    made = {shapes[i % len(shapes)](): i for i in range(3000)}
    rules = [urls.Rule("allow" if i % 7 == 0 else "block", pattern, i % 3) for pattern, i in made.items()]
    made_urls = [f"http://{pick()}.{pick()}.com/{pick()}/{pick()}.gif" for _ in range(60)] + [f"https://{pick()}-{pick()}.org/{pick()}" for _ in range(30)]
    made_urls += [f"ftp://{pick()}.{pick()}.net/{pick()}/x.gif?{pick()}" for _ in range(30)]
    frame = spark.createDataFrame(list(enumerate(made_urls)), "page_id long, url string")
    compiled = [(r.tier, -len(r.pattern), r.pattern, r.verdict, re.compile(r.regex)) for r in rules]
    decided = 0
    for r in urls.verdicts(frame, rules).collect():
        target = r.host + r.path
        fits = min((entry[:4] for entry in compiled if entry[4].search(target)), default=None)
        assert (r.tier, r.pattern, r.verdict) == ((fits[0], *fits[2:]) if fits else (None, None, "allow"))
        decided += fits is not None
    assert decided > 30


def test_quality_statistics_equal_plain_counting(spark, docs, none):
    rng = np.random.default_rng(9)
    made = [" ".join(rng.choice(list("abc"), n)) for n in (7, 8, 9, 16, 40, 400)] + ["#a $\n#a $\n\n x\n x\n"]
    frame = docs.select("doc_id", "text").union(
        spark.createDataFrame([(100 + i, t) for i, t in enumerate(made)], "doc_id long, text string")
    )
    texts = {r.doc_id: r.text or "" for r in frame.collect()}
    for r in quality.statistics(frame).collect():
        text = texts[r.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        seen = Counter(windows)
        again = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
    assert quality.statistics(none).count() == 0


def test_quality_learns_a_conjunction(spark, none):
    rows = [(i, " ".join(["w#" if i % 3 == 0 and j % 4 == 0 else f"w{j}" for j in range(30 + i % 50)])) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = frame.selectExpr("doc_id", "int(doc_id % 3 <> 0) as quality")
    ws = Workspace(spark, "q")
    stats = ws.write(quality.statistics(frame), "stats")
    rules = quality.learn(ws, stats, labels)
    assert rules
    judged = quality.judge(stats, rules).join(labels, "doc_id")
    assert judged.where("kept <> (quality = 1)").count() == 0
    assert quality.learn(ws, stats, labels.where("quality = 1")) == []
    assert quality.judge(stats, []).where("kept = base_failed").count() == 0
    assert quality.judge(quality.statistics(none), rules).count() == 0


def test_shards_are_minimax(spark, docs, none):
    rng = np.random.default_rng(3)
    texts = ["t" * int(n) for n in rng.integers(0, 60, 500)] + ["hot" * 9] * 200 + [None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("SHARD", F.lit(1))
    for shards in (1, 3, 8):
        found = sharding.shard(Workspace(spark, "s"), frame, shards).toPandas()
        sizes = Counter()
        for t in texts:
            sizes[hashlib.sha256((t or "").encode()).digest()] += len(t or "") + 1
        ordered = [sizes[d] for d in sorted(sizes)]

        def runs(capacity):
            n, held = 1, 0
            for size in ordered:
                n, held = (n + 1, size) if held + size > capacity else (n, held + size)
            return n

        least = next(c for c in range(max(ordered), sum(ordered) + 1) if runs(c) <= shards)
        assert found.groupby("shard")["size"].sum().max() == least
        assert found.assign(text=[texts[i] or "" for i in found.doc_id]).groupby("text").shard.nunique().max() == 1
        for _, part in found.groupby("shard"):
            assert sorted(part.slot) == list(range(len(part)))
    assert sharding.shard(Workspace(spark, "s"), none, 8).count() == 0
    assert sharding.shard(Workspace(spark, "s"), docs, 8).count() == docs.count()


def test_pipeline_stages_take_effect(spark, tmp_path):
    clean = "the quiet river runs slowly past the old mill and the tall green trees by the road number {}"
    rows = [(i, f"{clean.format(i)} {' '.join(f'extra{i}x{j}' for j in range(30))}") for i in range(60)]
    rows += [(100 + i, f"{clean.format(i)} wretched scoundrel {' '.join(f'more{i}x{j}' for j in range(25))}") for i in range(40)]
    rows += [(200, rows[0][1]), (201, rows[1][1]), (202, "12345 678"), (203, None), (204, "")]
    documents = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars"
    )
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    labels = documents.selectExpr("doc_id", "1 as quality", "int(doc_id >= 100 and doc_id < 140) as toxic")
    labels.where("doc_id < 200").write.parquet(f"{tmp_path}/labels.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left.append({r.doc_id for r in docs.select("doc_id").distinct().collect()})
        assert name == "packing" or docs.columns == documents.columns
    assert left[0] == {*range(60), 200, 201, 202, 203, 204}
    assert left[1] == {*range(60), 200, 201} and left[2] == left[3] == set(range(60))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == left[3]
