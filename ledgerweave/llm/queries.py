"""The registered queries of the operators for training data."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm import (
    ann,
    bpe,
    centroids,
    langid,
    mixing,
    neardup,
    packing,
    periodic,
    quality,
    sharding,
    toxicity,
    urls,
    wordpiece,
)
from ledgerweave.llm.text import fold, table
from ledgerweave.workspace import Workspace


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by classifiers trained on four of five folds."""
    ws = Workspace(spark, "op1")
    docs = table(spark, sf_dir, "documents")
    known = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    training = toxicity.sample(docs.where(fold("doc_id", 5) != 0), known)
    model = toxicity.fit(ws, training, toxicity.prior_of(known))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted"
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents by profiles learned on two of three folds."""
    ws = Workspace(spark, "op3")
    docs = table(spark, sf_dir, "documents")
    profiles = langid.fit(ws, langid.sample(docs.where(fold("doc_id", 3) != 1)))
    return langid.predict(docs.select("doc_id", "text"), profiles).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "likeness"
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2,048 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(Workspace(spark, "op4"), docs, public_tokenizers.path("byte_bpe_50k.json"))


def op8_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies among all documents: three-word shingles, similarity 0.85."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_copies(Workspace(spark, "op8"), docs, words=3, percent=85)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of all documents, the base rule, and the verdict of a learned decision list."""
    ws = Workspace(spark, "op6")
    stats = ws.write(quality.statistics(table(spark, sf_dir, "documents").select("doc_id", "text")), "stats")
    rules = quality.learn(ws, stats, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality.judge(stats, rules).select("doc_id", *counts, "base_failed", "kept", "rule")


def op7_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy longest-match piece counts of all documents over the byte-level vocabulary."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = wordpiece.count_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_words", "n_pieces", "n_unknown")


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near-equal bytes, equal texts together."""
    dealt = sharding.shard(Workspace(spark, "op9"), table(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return dealt.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))
    return made.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


#: The rules that the query is asked to apply.
RULES = [
    urls.Rule("allow", "com/"),
    urls.Rule("block", "example.com/en/"),
    urls.Rule("allow", "www.example.com/en/"),
    urls.Rule("block", "net/es/"),
    urls.Rule("block", "net/fr/"),
]
#: Host labels, or beginnings of such before a hyphen, of gambling, medicines, loans, adverts,
#: link farms, pirated copies and adult sites.
JUNK_LABELS = (
    "adserver adclick ads-track affiliate-links backlinks bet-now betting bingo-bonus buy-followers buy-pills casino casino-win "
    "cheap-pills click-track crack-download doorway escorts fake-watches free-bets free-casino free-pills hot-singles jackpot "
    "keygen link-farm link-exchange loan-shark lottery-win online-casino online-pharmacy payday-loans pill-shop poker-bonus "
    "popunder porn replica-watches seo-farm slots spam spam-farm spin-win sportsbook stream-free torrents traffic-exchange "
    "viagra warez win-prize xxx"
).split()
#: The method's own, for URLs that none of those fits.
OWN_RULES = [urls.Rule("block", pattern, 1) for label in JUNK_LABELS for pattern in (f"{label}.*", f"{label}-*")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page URLs."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urls.verdicts(pages, [*RULES, *OWN_RULES])
    return judged.select(
        "page_id", "host", "path", F.when(F.col("tier") == 0, F.col("pattern")).alias("rule"), "verdict"
    )


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth, by inner product."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(Workspace(spark, "op5"), vectors, F.col("vec_id") % 20 == 0)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of all documents a mix of their sources by the weights 1, 2, 3 takes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    planned = mixing.plan(Workspace(spark, "op11"), docs, mixing.cycled((1, 2, 3)))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return planned.select("doc_id", "size", "source_size", "target", taken)


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of all vectors of 64 components after three rounds."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    assigned, found = centroids.cluster(Workspace(spark, "op12"), vectors, 16, 3, 64)
    return centroids.with_inertia(assigned, found).drop("x")


def spliced(text: str, key: str) -> Column:
    """The text; for keys whose crc32 ends in 0, its words with a stretch of them repeated to the end."""
    blank = r"[\x20\x09-\x0D]+"
    number = F.crc32(F.col(key).cast("string").cast("binary"))

    def let(value: Column, body: Callable[[Column], Column]) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    def repeated(words: Column) -> Column:
        n, g = F.size(words), F.floor(number / 10)
        head = (g % n).cast("int")
        period = (1 + F.floor((n - head) / (3 + g % 8))).cast("int")
        unit = F.slice(words, head + 1, period)
        tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - head) / period).cast("int"))), 1, n - head)
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, head), tail), " ")).otherwise("")

    words = F.filter(F.split(F.col(text), blank), lambda w: w != "")
    return F.when(number % 10 == 0, let(words, repeated)).otherwise(F.col(text))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words in all documents, and digests of them and of the texts without their repeats."""
    docs = table(spark, sf_dir, "documents").select("doc_id", spliced("text", "doc_id").alias("text"))
    found = periodic.find_runs(docs)

    def better(best: Column, run: Column) -> Column:
        """The run of greatest length / period; the earlier one, by start and then period, of equals."""
        beyond = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | beyond, run).otherwise(best)

    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    listed = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    best = found.withColumn("best", F.aggregate("runs", none, better))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_url_filter": op2_url_filter,
    "op3_language": op3_language,
    "op4_packing": op4_packing,
    "op5_neighbours": op5_neighbours,
    "op6_quality": op6_quality,
    "op7_piece_counts": op7_piece_counts,
    "op8_near_copies": op8_near_copies,
    "op9_shards": op9_shards,
    "op10_bpe": op10_bpe,
    "op11_mixing": op11_mixing,
    "op12_clusters": op12_clusters,
    "op13_runs": op13_runs,
}

MIX_SQL = r"""
        WITH sized AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
        ), sources AS (
            SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
            FROM sized GROUP BY source
        ), levelled AS (
            SELECT *, 3 * source_size AS room, coalesce(sum(3 * source_size) OVER before, 0)::BIGINT AS room_before,
                   coalesce(sum(weight) OVER before, 0)::BIGINT AS weight_before,
                   (SELECT sum(source_size) FROM sources)::BIGINT AS whole, (SELECT sum(weight) FROM sources)::BIGINT AS weights
            FROM sources
            WINDOW before AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), judged AS (
            SELECT *, room / weight <= (whole - room_before) / (weights - weight_before) AS is_full FROM levelled
        ), aimed AS (
            SELECT *, CASE WHEN is_full THEN room::DOUBLE ELSE
                (whole - (SELECT coalesce(sum(room), 0) FROM judged WHERE is_full)::BIGINT)::DOUBLE * weight
                / (weights - (SELECT coalesce(sum(weight), 0) FROM judged WHERE is_full)::BIGINT) END AS target FROM judged
        ), rated AS (
            SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM aimed
        )
        SELECT doc_id, size, source_size, target,
               size * (floor(rate)::BIGINT + (('0x' || substr(sha256('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT
                                              / 4503599627370496.0::DOUBLE < rate - floor(rate))::BIGINT) AS taken
        FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source"""


def clusters_sql(clusters: int = 16, rounds: int = 3, length: int = 64) -> str:
    """Each round as one more pair of tables: the nearest centroid of every vector, and the new centroids."""
    parts = [
        f"""kept AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
            WHERE len(embedding) = {length} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "pieces AS MATERIALIZED (SELECT row, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM kept)",
        f"""first AS (SELECT x, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM kept
            QUALIFY c < {clusters})""",
        "centroid0 AS MATERIALIZED (SELECT c, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM first)",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""near{r} AS MATERIALIZED (
            SELECT row, c, distance FROM (
                SELECT p.row, k.c, sum((p.v - k.v) * (p.v - k.v))::BIGINT AS distance
                FROM pieces p JOIN centroid{r} k ON k.i = p.i GROUP BY ALL)
            QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, c) = 1)"""
        )
        if r < rounds:
            parts.append(
                f"""centroid{r + 1} AS MATERIALIZED (
            SELECT k.c, k.i, coalesce(m.v, k.v) AS v FROM centroid{r} k LEFT JOIN (
                SELECT c, i, (s - (s % n + n) % n) // n AS v FROM (
                    SELECT c, i, sum(v)::BIGINT AS s, count(*) AS n FROM near{r} JOIN pieces USING (row) GROUP BY ALL)) m
            ON m.c = k.c AND m.i = k.i)"""
            )
    return f"""WITH {", ".join(parts)},
        named AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM centroid{rounds} GROUP BY c)
        SELECT vec_id, c::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
               (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM near{rounds} JOIN kept USING (row) JOIN named USING (c)"""


ORACLE_SQL: dict[str, str] = {
    "op11_mixing": MIX_SQL,
    "op12_clusters": clusters_sql(),
    "op2_url_filter": """
        WITH parts AS (
            SELECT page_id,
                   coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages
        ), judged AS (
            SELECT *, '.' || host AS dotted,
                   CASE WHEN dotted LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                        WHEN dotted LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
                        WHEN dotted LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
                        WHEN dotted LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
                        WHEN dotted LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule
            FROM parts
        )
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
                    WHEN rule IS NOT NULL OR regexp_matches(host || path, 'JUNK') THEN 'block'
                    ELSE 'allow' END AS verdict
        FROM judged""".replace("JUNK", "|".join(r.regex.removeprefix("(?s)") for r in OWN_RULES)),
}
