"""One-row summary of the components, the busiest senders and the last merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions import scoring
from ledgerweave.operators.sketches import CMS_WIDTH, KMV_K, cms_figures, kmv_estimate, kmv_samples
from ledgerweave.operators.skew import GROUP_ROWS
from ledgerweave.operators.stats import component_stats, extremes, top_senders
from ledgerweave.workspace import Workspace


def last_merge(scored: DataFrame) -> DataFrame:
    """The newest merge event with its level marker and reason; no row if nothing merged."""
    figures = ["root", "sender", "receiver", "s", "z_distinct", "z_out_hh", "z_density", "distinct", "out_hh", "density", "level"]
    newest = scored.agg(F.max(F.struct("seq", *figures)).alias("m")).where("m IS NOT NULL").select("m.*")
    z = [F.col(c) for c in ("z_distinct", "z_out_hh", "z_density")]
    return newest.withColumn("marker", scoring.level_marker(F.col("level"))).withColumn("reason", scoring.reason(*z))


def summary(
    ws: Workspace,
    txn: DataFrame,
    members: DataFrame,
    scored: DataFrame,
    topk: int = 5,
    recent: int = 10_000,
    kmv_k: int = KMV_K,
    width: int = CMS_WIDTH,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Counts, largest, densest, top senders, last merge, and the accuracy of the largest."""
    stats = ws.write(component_stats(txn, members), "stats")
    overall = extremes(stats)
    entry = F.struct("place", "account", "component", "est_out", "bound")
    busiest = top_senders(txn, members, topk, recent, width, stats).agg(
        F.sort_array(F.collect_list(entry)).alias("top_senders")  # topk entries
    )
    merge = last_merge(scored)
    merge = merge.select(F.struct(*merge.columns).alias("last_merge")).agg(F.first("last_merge").alias("last_merge"))
    head = overall.select(F.col("largest").alias("component"))
    members_of_largest = members.join(F.broadcast(head), "component")
    kmv = kmv_estimate(kmv_samples(members_of_largest, kmv_k), kmv_k)
    cms = cms_figures(stats.join(F.broadcast(head), "component"), width)
    accuracy = kmv.join(cms, "component").agg(
        F.first(F.struct("k", "n_samples", "r_k", "rel_error_theory", "estimate")).alias("kmv"),
        F.first(F.struct("w", "d", "epsilon", "delta", "n_out", "n_in", "bound_out", "bound_in")).alias("cms"),
    )
    # Four one-row results side by side.
    result = overall
    for one_row in (busiest, merge, accuracy):
        result = result.withColumn("_one", F.lit(1)).join(one_row.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return result


def report(summary_row: DataFrame) -> DataFrame:
    """The summary as ``(item, value)`` lines; layout is left to the caller."""
    top = F.transform(
        "top_senders",
        lambda s: F.concat_ws(
            "", s["place"].cast("string"), F.lit(":"), s["account"].cast("string"), F.lit("/"),
            s["component"].cast("string"), F.lit("~"), s["est_out"].cast("string"),
            F.lit(" (+"), s["bound"].cast("long").cast("string"), F.lit(")"),
        ),
    )
    lines = {
        "components": F.col("num_components"),
        "edges": F.col("num_edges"),
        "largest": F.col("largest"),
        "largest_accounts": F.col("largest_accounts"),
        "densest": F.col("densest"),
        "top_senders": F.concat_ws(", ", top),
        "last_merge_seq": F.col("last_merge.seq"),
        "last_merge_root": F.col("last_merge.root"),
        "last_merge_marker": F.col("last_merge.marker"),
        "last_merge_reason": F.col("last_merge.reason"),
        "kmv_samples": F.col("kmv.n_samples"),
        "kmv_r_k": F.coalesce(F.col("kmv.r_k").cast("string"), F.lit("none")),
        "cms_bound_out": F.col("cms.bound_out").cast("long"),
    }
    entries = [F.struct(F.lit(k).alias("item"), v.cast("string").alias("value")) for k, v in lines.items()]
    return summary_row.select(F.inline(F.array(*entries)))
