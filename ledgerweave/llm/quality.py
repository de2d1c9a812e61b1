"""Quality rules: statistics of a text, and a decision list learned from labels.

The list is grown by sequential covering.  Each rule is a conjunction of thresholds on
statistics: literal after literal is added, each time the one that gains most on the labelled
rows the list doesn't cover yet, then literals are pruned from the end on rows set aside.
Rules say "reject"; a rule that isn't precise enough on the rows set aside ends the list.
What comes out is one ordered conditional expression.

Statistics, counting and judging are DataFrame functions only.  The search reads a small
table of bins and gets back a count per statistic and bin.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.workspace import Workspace

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Labelled rows the list is learned from at most, about; chosen by a hash of their key.
MAX_LABELLED = 60_000
#: Bins of a statistic, rules of a list, thresholds of a rule.
BINS, MAX_RULES, MAX_LITERALS = 24, 8, 3
#: Share of a rule's rows that must be bad, among those set aside, and bad rows it must cover in all.
PRECISION, SUPPORT = 0.95, 5
#: Statistics that rules may use.
FEATURES = [
    "n_words",
    "word_length",
    "symbol_share",
    "distinct_share",
    "repeat_share",
    "dup_line_share",
    "upper_share",
    "mark_share",
    "digit_share",
]

_BLANK = r"[\x20\x09-\x0D]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, worked out once, however often the body or a lambda in it asks."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: str) -> Column:
    """What stands between ASCII white space."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), _BLANK), lambda w: w != "")


def repeated_words(found: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more, each word once.

    The windows' hashes are sorted with their places, so that equal ones are neighbours.
    """

    def covered(places: Column) -> Column:
        reach = F.transform(
            places,
            lambda p, i: F.when(i + 1 < F.size(places), F.least(F.lit(window), F.get(places, i + 1) - p)).otherwise(window),
        )
        return F.aggregate(reach, F.lit(0), lambda total, n: total + n)

    def same(pairs: Column) -> Column:
        def twin(i: Column) -> Column:
            own = F.get(pairs, i)["h"]
            return (own == F.get(pairs, i + 1)["h"]) | ((i > 0) & (own == F.get(pairs, F.greatest(i - 1, F.lit(0)))["h"]))

        twins = F.filter(F.transform(pairs, lambda pair, i: F.when(twin(i), pair["p"])), lambda p: p.isNotNull())
        return _let(F.sort_array(twins), covered)

    def of(found: Column) -> Column:
        hashed = F.transform(
            F.sequence(F.lit(1), F.size(found) - window + 1), lambda i: F.xxhash64(F.slice(found, i, window))
        )
        return _let(
            hashed,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
                _let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), same)
            ),
        )

    return F.when(F.size(found) >= window, of(found)).otherwise(0)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words`` and the ``FEATURES``.  A null text has none of anything; shares of nothing are 0.
    Columns named like these, in any case, give way."""
    body = F.coalesce(F.col(text), F.lit(""))
    made = {"word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *FEATURES}
    kept = [f"`{c}`" for c in docs.columns if c != text and c.lower() not in made]
    found = docs.select(*kept, body.alias("_text"), words(text).alias("_words"))

    def count_of(kind: str) -> Column:
        return F.length("_text") - F.length(F.regexp_replace("_text", kind, ""))

    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    dup_lines = _let(lines, lambda found: F.struct(F.size(found).alias("n"), F.size(F.array_distinct(found)).alias("d")))
    measured = found.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda total, w: total + F.length(w)).alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        dup_lines.alias("_lines"),
        _let(F.col("_words"), lambda found: repeated_words(found)).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct("_words")).alias("_distinct"),
        count_of("[A-Z]").alias("_upper"),
        count_of("[!?]").alias("_marks"),
        count_of("[0-9]").alias("_digits"),
    )

    def share(part: str | Column, whole: str | Column) -> Column:
        whole = F.col(whole) if isinstance(whole, str) else whole
        return F.when(whole > 0, part / whole).otherwise(0.0).cast("double")

    return measured.select(
        *kept,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.col("_lines.n") - F.col("_lines.d")).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        share(F.col("word_chars"), "n_words").alias("word_length"),
        share(F.col("n_symbols"), "word_chars").alias("symbol_share"),
        share(F.col("_distinct"), "n_words").alias("distinct_share"),
        share(F.col("n_repeat_words"), "n_words").alias("repeat_share"),
        share(F.col("_lines.n") - F.col("_lines.d"), F.col("_lines.n")).alias("dup_line_share"),
        share(F.col("_upper"), "word_chars").alias("upper_share"),
        share(F.col("_marks"), "word_chars").alias("mark_share"),
        share(F.col("_digits"), "word_chars").alias("digit_share"),
    )


def base_failed() -> Column:
    """Too short, or mostly made of repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Literal:
    """``feature >= value`` if ``above``, else ``feature < value``."""

    feature: str
    above: bool
    value: float
    bin: int

    def holds(self) -> Column:
        return F.col(self.feature) >= self.value if self.above else F.col(self.feature) < self.value

    def holds_in_bins(self) -> Column:
        return F.col(self.feature) >= self.bin if self.above else F.col(self.feature) < self.bin

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.value:.6g}"


Rule = tuple[Literal, ...]


def _all(literals: Rule, in_bins: bool = False) -> Column:
    return reduce(Column.__and__, [x.holds_in_bins() if in_bins else x.holds() for x in literals], F.lit(True))


def _binned(ws: Workspace, known: DataFrame) -> tuple[DataFrame, dict[str, list[float]]]:
    """Labelled rows with each feature as the number of thresholds at or below it, and those thresholds."""
    quantiles = known.agg(
        *[F.percentile_approx(f, [i / BINS for i in range(1, BINS)] + [0.98, 0.995], 10_000).alias(f) for f in FEATURES]
    ).first()
    edges = {f: sorted({float(q) for q in quantiles[f] or []}) for f in FEATURES}
    bins = [
        sum([(F.col(f) >= e).cast("int") for e in edges[f]], F.lit(0)).alias(f) for f in FEATURES
    ]
    held_out = (F.pmod(F.xxhash64("_key", F.lit("prune")), F.lit(3)) == 0).alias("held_out")
    return ws.write(known.select("bad", held_out, *bins), "bins"), edges


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """What a literal that leaves p of p0 bad and n of n0 good rows gains, in bits over the bad rows."""
    from math import log2

    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p else 0.0


def _best_literal(rows: DataFrame, edges: dict[str, list[float]]) -> tuple[Literal | None, int, int]:
    """The literal of largest gain on ``rows``, and the bad and good rows it leaves."""
    each = F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in FEATURES]))
    counted = rows.select("bad", each).groupBy("feature", "bin").agg(
        F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")
    )
    counts = {(r.feature, r.bin): (r.p, r.n) for r in counted.collect()}
    best: tuple[float, Literal | None, int, int] = (0.0, None, 0, 0)
    for f in FEATURES:
        table = [counts.get((f, b), (0, 0)) for b in range(len(edges[f]) + 1)]
        p0, n0 = (sum(c[i] for c in table) for i in (0, 1))
        below = (0, 0)
        for b, edge in enumerate(edges[f], 1):
            below = (below[0] + table[b - 1][0], below[1] + table[b - 1][1])
            for above, (p, n) in ((False, below), (True, (p0 - below[0], n0 - below[1]))):
                gain = _gain(p, n, p0, n0)
                if gain > best[0] + 1e-9:
                    best = (gain, Literal(f, above, edge, b), p, n)
    return best[1:]


def learn(ws: Workspace, stats: DataFrame, labels: DataFrame, key: str = "doc_id") -> list[Rule]:
    """Rules for bad texts, from ``labels`` (``key``, ``quality`` 1 or 0); none without rows of both kinds."""
    marked = labels.where("quality in (0, 1)").groupBy(key).agg((F.min("quality") == 0).alias("bad"))
    known = ws.write(stats.join(marked, key).withColumnRenamed(key, "_key"), "known", bad="bad")
    share = MAX_LABELLED / max(1, ws.rows(known))
    if share < 1:
        chance = F.pmod(F.xxhash64("_key", F.lit("quality")), F.lit(1 << 30)) / (1 << 30)
        known = known.where(chance < share)
    if not 0 < ws.count(known, "bad") < ws.rows(known) if share >= 1 else False:
        return []
    table, edges = _binned(ws, known)
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        covered = reduce(Column.__or__, [_all(r, True) for r in rules], F.lit(False))
        open_rows = table.where(~covered)
        grown: list[Literal] = []
        while len(grown) < MAX_LITERALS:
            literal, bad, good = _best_literal(open_rows.where(~F.col("held_out") & _all(tuple(grown), True)), edges)
            if literal is None:
                break
            grown.append(literal)
            if not good:
                break
        if not grown:
            break
        # Rows set aside: bad and good ones for each beginning of the conjunction.
        heads = [tuple(grown[:i]) for i in range(1, len(grown) + 1)]
        tested = open_rows.where("held_out").agg(
            *[F.count_if(_all(h, True) & (F.col("bad") if bad else ~F.col("bad"))) for h in heads for bad in (True, False)]
        ).first()
        scored = [(tested[2 * i], tested[2 * i + 1], h) for i, h in enumerate(heads)]
        p, n, rule = max(scored, key=lambda s: ((s[0] - s[1]) / (s[0] + s[1]) if s[0] + s[1] else -1, -len(s[2])))
        if p < SUPPORT or p < PRECISION * (p + n):
            break
        rules.append(rule)
    return rules


def expression(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the number of the first rule that fits, or null."""
    if not rules:
        return F.lit(None).cast("int")
    first, *rest = list(enumerate(rules, 1))
    listed = F.when(_all(first[1]), F.lit(first[0]))
    for number, rule in rest:
        listed = listed.when(_all(rule), F.lit(number))
    return listed


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """``stats`` with ``base_failed``, ``rule`` (the first that fits) and ``kept``.

    Null and empty texts have no words and fail the base; repeated rows are judged each; an empty table
    stays empty.
    """
    judged = stats.withColumn("base_failed", base_failed()).withColumn("rule", expression(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
