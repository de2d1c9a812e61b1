from __future__ import annotations

import pytest

import reference_models as model

from pyspark.sql import functions as F

from ledgerweave.sources import sinks
from ledgerweave.plans import queries
from ledgerweave.plans.queries import QUERIES
from ledgerweave.streaming.ledger import Ledger, edge_stream
from ledgerweave.streaming.recent import RecentBlocks
from ledgerweave.workspace import Workspace
from test_merges import transfers

SCHEMA = "tnum double, sender long, receiver long, amount double"


def batches(spark, rows, size):
    for at in range(0, len(rows), size):
        part = [(float(seq), u, v, w) for seq, u, v, w in rows[at : at + size]]
        yield spark.createDataFrame(part, SCHEMA)


def test_micro_batches_equal_one_replay_and_repeats_change_nothing(spark, tmp_path):
    rows = transfers(90, 40, seed=5)
    book = Ledger(spark, str(tmp_path / "book"), csv_folder=str(tmp_path / "csv"))
    for i, batch in enumerate(batches(spark, rows, 30)):
        book.apply(batch, i)
        if i == 1:
            book.apply(batch, i)  # as after a failure
    expected = model.components([(u, v) for _, u, v, _ in rows])
    assert {r.account: r.component for r in book.members(2).collect()} == expected
    assert book.stats(2).agg({"edges": "sum", "accounts": "sum"}).first()[:] == (90, len(expected))
    scores = model.merge_scores(rows)
    alerts = {r.time: r for r in book.alerts().collect()}
    assert sorted(alerts) == [float(s) for s in sorted(scores)]
    for seq, (root, _, distinct, out_hh, density, *_) in scores.items():
        a = alerts[float(seq)]
        assert (a.root, a.distinct, a.out_hh) == (str(root), distinct, out_hh) and abs(a.density - density) < 1e-6
    assert sinks.read_alerts(spark, str(tmp_path / "csv")).count() == len(scores)


def test_refinement_feeds_back(spark, tmp_path):
    book = Ledger(spark, str(tmp_path / "book"), refine_on_high=True, window_edges=50)
    # Small merges first, then a jump that scores high; only 1 and 2 pay each other both ways.
    first = [(1.0, 1, 2, 1.0), (2.0, 2, 1, 1.0), (3.0, 2, 3, 1.0), (4.0, 3, 4, 1.0), (5.0, 4, 5, 90_000.0)]
    book.apply(spark.createDataFrame(first, SCHEMA), 0)
    assert {r.level for r in book.alerts().collect()} >= {"HIGH"}
    assert {r.account: r.component for r in book.members(0).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert sorted(map(tuple, book.stats(0).collect())) == [(1, 2, 2), (3, 1, 0), (4, 1, 0), (5, 1, 0)]
    book.apply(spark.createDataFrame([(6.0, 5, 9, 1.0)], SCHEMA), 1)
    assert {r.account: r.component for r in book.members(1).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 9: 5}


def test_file_stream(spark, tmp_path):
    rows = transfers(40, 20, seed=8)
    source = str(tmp_path / "in")
    for batch in batches(spark, rows, 20):
        batch.coalesce(1).write.mode("append").parquet(source)
    book = Ledger(spark, str(tmp_path / "book"))
    run = book.start(edge_stream(spark, source, SCHEMA, files_per_batch=1), str(tmp_path / "checkpoint"))
    run.awaitTermination()
    members = book.members(run.lastProgress["batchId"])
    assert {r.account: r.component for r in members.collect()} == model.components([(u, v) for _, u, v, _ in rows])


@pytest.mark.parametrize("parts", [1, 3])
def test_windows_of_a_table_that_is_a_folder(spark, tmp_path, parts):
    """Closed and open windows together are all windows."""
    rows = [(i, 86_400 * (i // 9) + 5_000 * (i % 9), i % 4, "t", float(i % 50), "{}") for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, at long, user_id long, event_type string, value double, props string")
    events = events.select("event_id", F.timestamp_seconds("at").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props")
    events.repartition(parts).write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["stream_windowed_flow"](spark, str(tmp_path))
    expected = {}
    for _, at, user, _, value, _ in rows:
        key = (at // 86_400 * 86_400, user)
        edges, outflow = expected.get(key, (0, 0))
        expected[key] = (edges + 1, outflow + int(max(1.0, value)))
    assert {(r.start, r.sender): (r.edges, r.outflow) for r in found.collect()} == expected


def stored_rows(spark, book, version):
    part = book.version(version).parts[version]
    return {kind: spark.read.parquet(f"{part}/{kind}").count() for kind in ("members", "stats", "history", "flow")}


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    """A large state, then small batches: rows written follow the batch; folding the log changes nothing."""
    rows = [(i + 1, 10 * (i // 9), 10 * (i // 9) + 1 + i % 9, 5.0) for i in range(900)]
    small = [(901, 0, 10, 2.0), (902, 5, 5, 1.0), (903, 11, 5, 3.0), (904, 7_000, 7_001, 2.0)]
    parts = [rows, small[:2], small[2:3], small[3:]]
    book, stored = Ledger(spark, str(tmp_path / "book"), compact_every=3), []
    for i, part in enumerate(parts):
        book.apply(next(batches(spark, part, 10**6)), i)
        stored.append(stored_rows(spark, book, i))
    assert stored[1] == {"members": 0, "stats": 1, "history": 1, "flow": 2}
    assert stored[2]["members"] == 1000  # the log folded
    assert stored[3] == {"members": 2, "stats": 1, "history": 1, "flow": 1}
    everything = rows + small
    expected = model.components([(u, v) for _, u, v, _ in everything])
    counts: dict = {}
    for _, u, _, _ in everything:
        counts[expected[u]] = counts.get(expected[u], 0) + 1
    sizes: dict = {}
    for root in expected.values():
        sizes[root] = sizes.get(root, 0) + 1
    scores = model.merge_scores(everything)
    assert {r.account: r.component for r in book.members(3).collect()} == expected
    assert {r.component: (r.accounts, r.edges) for r in book.stats(3).collect()} == {c: (sizes[c], counts[c]) for c in sizes}
    found = {r.time: (r.distinct, r.out_hh) for r in book.alerts().collect()}
    assert found == {float(s): (row[2], row[3]) for s, row in scores.items()}


def test_lagged_transfers_are_applied_in_order_of_time(spark, tmp_path):
    rows = transfers(60, 25, seed=12)
    shuffled = sorted(rows, key=lambda r: r[0] + (7 if r[0] % 3 else 0))
    book = Ledger(spark, str(tmp_path / "book"), lag=10.0)
    for i in range(2):
        book.apply(next(batches(spark, shuffled[30 * i : 30 * i + 30], 30)), i)
    assert book.edges(1).count() < 60
    last = book.drain(1)
    applied = {r.seq: (r.tnum, r.sender, r.receiver) for r in book.edges(last).collect()}
    assert applied == {seq: (float(seq), u, v) for seq, u, v, _ in rows}
    scores = model.merge_scores(rows)
    assert {r.time: r.out_hh for r in book.alerts().collect()} == {float(s): row[3] for s, row in scores.items()}


def test_all_applied_transfers_are_kept(spark, tmp_path):
    """More than two million, in three batches; with a window the latest are."""
    rows = spark.range(2_100_000).select(
        F.col("id").cast("double").alias("tnum"), (F.col("id") % 7).alias("sender"), F.lit(9).cast("long").alias("receiver"), F.lit(1.0).alias("amount")
    )
    book = Ledger(spark, str(tmp_path / "book"))
    for i in range(3):
        book.apply(rows.where(F.floor(F.col("tnum") / 700_000) == i), i)
    assert book.edges(2).agg(F.count("*"), F.min("seq"), F.max("seq")).first()[:] == (2_100_000, 1, 2_100_000)
    kept = Ledger(spark, str(tmp_path / "kept"), window_edges=10)
    for i in range(4):
        kept.apply(rows.where(F.floor(F.col("tnum") / 8) == i), i)
    assert sorted(r.seq for r in kept.edges(3).collect()) == list(range(23, 33))


def blocks_of(rows, window, mutual):
    """account -> block among the latest transfers, from scratch."""
    late = {(u, v) for _, u, v, _ in rows[-window:] if u != v}
    return model.components([(u, v) for u, v in late if not mutual or (v, u) in late])


@pytest.mark.parametrize("mutual", [True, False])
def test_blocks_of_a_sliding_window(spark, tmp_path, mutual):
    """Links expire, blocks fall apart and grow again; every window up to the longest is right after every batch."""
    rows = transfers(120, 12, seed=31)
    kept = RecentBlocks(spark, str(tmp_path / "recent"), mutual, window_edges=70, compact_every=2)
    parts = list(batches(spark, rows, 30))
    ws, fell_apart = Workspace(spark), False
    for i, batch in enumerate(parts):
        kept.apply(batch, i)
        if i == 2:
            kept.apply(batch, i)  # as after a failure
        so_far = rows[: 30 * (i + 1)]
        for window in (70, 25):
            found = {r.account: r.block for r in kept.blocks(ws, i, window).collect()}
            assert found == blocks_of(so_far, window, mutual)
        fell_apart |= blocks_of(so_far, 25, mutual) != blocks_of(so_far, 70, mutual)
        forest = kept.forest(i).collect()
        assert len(forest) == len(found := blocks_of(so_far, 70, mutual)) - len(set(found.values()))
    assert fell_apart
    with pytest.raises(ValueError):
        kept.forest(3, 71)


def test_a_batch_without_links(spark, tmp_path):
    """Empty batches and self loops link nothing; loops count as transfers, so that earlier links expire."""
    kept, ws = RecentBlocks(spark, str(tmp_path / "recent"), window_edges=3), Workspace(spark)
    kept.apply(spark.createDataFrame([], SCHEMA), 0)
    assert kept.blocks(ws, 0).collect() == []
    kept.apply(spark.createDataFrame([(1.0, 1, 2, 1.0), (2.0, 2, 1, 1.0)], SCHEMA), 1)
    kept.apply(spark.createDataFrame([(3.0, 7, 7, 1.0)], SCHEMA), 2)
    assert sorted(map(tuple, kept.blocks(ws, 2).collect())) == [(1, 1), (2, 1)]
    kept.apply(spark.createDataFrame([(4.0, 7, 7, 1.0), (None, 8, 8, 1.0)], SCHEMA), 3)
    assert kept.blocks(ws, 3).collect() == []


def test_a_part_of_the_arrivals_is_several_files_and_one_batch(spark, monkeypatch):
    monkeypatch.setattr(queries, "ARRIVED_ROWS", 300)
    ws = Workspace(spark)
    rows = spark.range(2_700).withColumn("part", F.col("id") % 3)
    folder, files = queries._arrive(ws, rows, [F.col("part") == i for i in range(3)], [900] * 3)
    assert files == 3
    stored = spark.read.parquet(folder).withColumn("file", F.input_file_name())
    spread = stored.groupBy("part").agg(F.count_distinct("file").alias("files"), F.count("*").alias("rows")).collect()
    assert sorted(map(tuple, spread)) == [(i, 3, 900) for i in range(3)]
    batches = {}
    stream = edge_stream(spark, folder, rows.schema, files_per_batch=files).writeStream
    stream = stream.foreachBatch(lambda df, i: batches.update({i: sorted(r.id for r in df.collect())}))
    stream.option("checkpointLocation", f"{ws.root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert batches == {i: list(range(i, 2_700, 3)) for i in range(3)}
    assert queries._arrive(Workspace(spark), rows, [F.lit(True)], [10])[1] == 1
