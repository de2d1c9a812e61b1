"""Near copies by a multi-index Hamming join of b-bit MinHash signatures.

A text's signature holds, for each of ``BITS`` random orders of all word shingles, one bit of
the text's first shingle in that order; the first ``POSITIONS`` places also keep 16 bits, to
be indexed.  Two sets of Jaccard similarity t differ in a place of b bits with probability
(1 - t)(1 - 2^-b), so pairs at the similarity asked for or above are within a distance ``r``
of each other but for a chance of ``MISS``.

The index finds *all* pairs within distance r of the 16-bit places: these are split in m chunks
with 2 m > r, so that by the pigeonhole principle at least one chunk of such a pair has one
error or none.  Per chunk each place in turn is left out, and what remains is a key.  Keys also
carry a class of set size, as similar sets are of similar size; sets just below a border visit
the next class.

No bucket of copies is expanded into all pairs.  Equal sets are folded first.  Then every member of a
bucket is paired with the smallest member only; the links confirmed give groups.  What is left
are members of different groups in one bucket.  Groups of few members there are paired member
by member, if the long signatures are near enough; a larger group stands as one partner for a
member of a smaller one, and the two meet in tiles of ``TILE`` texts by ``TILE``, which return
one link of them at most.  Texts that share much but are no copies stay groups of one, so a bucket of n
such texts costs n^2 comparisons of signatures (not of texts).  Every link is confirmed on the full shingle sets of the whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.text import Memo, once
from ledgerweave.operators.components import components
from ledgerweave.workspace import Workspace

POSITIONS = 40
BITS = 512
#: Chance that a pair of exactly the similarity asked for is further apart than the distance allows.
MISS = 1e-5
#: Members of a group up to which a bucket takes them one by one.
FEW = 8
#: Texts of either side that are compared with each other in one go.
TILE = 256
#: Partners of one text that one task confirms.
PARTNERS = 64

_U = np.uint64
_rng = np.random.default_rng(20_240_229)
_FLIP = _rng.integers(0, 2**63, (BITS, 1), dtype=np.uint64)
_TIMES = _rng.integers(0, 2**63, (BITS, 1), dtype=np.uint64) | _U(1)
_WORDS = [f"bits{i}" for i in range(BITS // 64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over the whole range."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Distinct 64-bit hashes of the word sequences of the text, rising.

    Words are what stands between ASCII white space, A-Z taken as a-z.  A text with fewer words is
    one sequence, and one without any has none.
    """
    memo = once("word hashes", lambda: Memo(xxhash.xxh3_64_intdigest, 200_000))
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return np.zeros(0, _U)
    h = np.fromiter(map(memo.__getitem__, split), _U, len(split))
    width = min(words, len(h))
    hashed = np.full(len(h) - width + 1, width, _U)
    for i in range(width):
        hashed = _mixed(hashed * _U(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
    return np.unique(hashed)


def signature(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 16-bit places and the long signature, 64 places to a number, of a set that is not empty."""
    least = np.full(BITS, 2**64 - 1, _U)
    for start in range(0, len(found), 256):
        np.minimum(least, ((found[start : start + 256] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    spread = _mixed(least)
    return (spread[:POSITIONS] >> _U(16)).astype(np.uint16), np.packbits(spread & _U(1) == 1).view(np.int64)


def distance(percent: int, places: int, bits: int) -> int:
    """The smallest r that pairs of that similarity exceed with a chance of ``MISS`` at most."""
    p = (1 - percent / 100) * (1 - 2.0**-bits)
    tail = 1.0
    for r in range(places):
        tail -= math.comb(places, r) * p**r * (1 - p) ** (places - r)
        if tail <= MISS:
            return r
    return places


def chunks(r: int) -> list[np.ndarray]:
    """The places in the least number of chunks of which at least one has one error or none."""
    return np.array_split(np.arange(POSITIONS), min(POSITIONS, r // 2 + 1))


def size_classes(n: int, percent: int) -> list[int]:
    """Doubling classes of set size in which a set has to look for sets at least as large."""
    own = math.floor(math.log2(n))
    up = math.floor(math.log2(n * 100 / percent) + 1e-9)
    return list(range(own, up + 1))


def index_keys(place: np.ndarray, n: int, percent: int, split: list[np.ndarray]) -> list[int]:
    """Keys of a signature, for a set of n shingles."""
    keys = [
        xxhash.xxh3_64_intdigest(place[chunk[chunk != left_out]].tobytes(), seed=(c << 32) | int(left_out))
        for chunk in split
        for left_out in chunk
        for c in size_classes(n, percent)
    ]
    return np.array(keys, _U).astype(np.int64).tolist()


def _signed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``(id, n, fingerprint, keys, bits0, bits1, ...)``; without keys and signature for an empty set."""
    split = chunks(distance(percent, POSITIONS, 16))
    columns = ["n", "fingerprint", "keys", *_WORDS]

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for document in batch["text"]:
                found = shingles(document, words)
                if not len(found):
                    rows.append((0, None, None, *[None] * len(_WORDS)))
                    continue
                place, bits = signature(found)
                print_ = xxhash.xxh3_128_digest(found.tobytes())
                rows.append((len(found), print_, index_keys(place, len(found), percent, split), *bits.tolist()))
            made = {name: pd.Series(list(v), dtype=object) for name, v in zip(columns, zip(*rows))}
            yield pd.DataFrame({"id": batch["id"], **made})

    bits = ", ".join(f"{w} long" for w in _WORDS)
    return docs.mapInPandas(sign, f"id long, n long, fingerprint binary, keys array<long>, {bits}")


def _apart(one: str, two: str) -> Column:
    """Places in which two long signatures differ."""
    return sum(F.bit_count(F.col(f"{one}.{w}").bitwiseXOR(F.col(f"{two}.{w}"))) for w in _WORDS)


def _ranked_texts(needed: DataFrame, docs: DataFrame, *dealt: str) -> DataFrame:
    """``needed`` with the texts of its ``id``, dealt by some columns; in each deal lower ranks come first."""
    return needed.join(docs, "id").repartition(*dealt).sortWithinPartitions(*dealt, "rank")


def _similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * common >= percent * (len(one) + len(two) - common)


def _confirmed_pairs(ws: Workspace, pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` whose full shingle sets have the similarity.

    The partners of a text are brought to it, a text of many partners to several tasks.  A task holds
    the set of one text at a time.
    """
    pairs = ws.write(pairs, "candidates")
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("shares"))
    share = F.pmod(F.xxhash64("b"), F.col("shares")).cast("int")
    theirs = pairs.join(shares, "a").select("a", F.col("b").alias("id"), share.alias("share"), F.lit(1).alias("rank"))
    each = F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    own = shares.select("a", F.col("a").alias("id"), each.alias("share"), F.lit(0).alias("rank"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, None
        for batch in batches:
            linked = []
            for a, b, rank, text in zip(batch["a"], batch["id"], batch["rank"], batch["text"]):
                found = shingles(text, words)
                if rank == 0:
                    current, held = a, found
                elif a == current and _similar(held, found, percent):
                    linked.append((a, b))
            yield pd.DataFrame(linked, columns=["a", "b"], dtype=np.int64)

    side_by_side = _ranked_texts(theirs.unionByName(own), docs, "a", "share").select("a", "id", "rank", "text")
    return ws.write(side_by_side.mapInPandas(compare, "a long, b long"), "links")


def _confirmed_groups(
    ws: Workspace, pairs: DataFrame, grouped: DataFrame, docs: DataFrame, words: int, percent: int
) -> DataFrame:
    """A link of each text ``a`` to a member of the group ``b`` that has the similarity, if there is one.

    Both sides are cut into parts of about ``TILE``; every part of the texts meets every part of the group.
    """
    pairs = ws.write(pairs, "candidates")
    sizes = grouped.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("cols"))
    parts = pairs.groupBy(F.col("b").alias("component")).agg(F.ceil(F.count("*") / TILE).cast("int").alias("rows"))
    tiles = ws.write(parts.join(sizes, "component"), "tiles")

    def part(key: str, of: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(of)).cast("int")

    def every(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    of_pairs = pairs.withColumnRenamed("b", "component").join(tiles, "component")
    texts = of_pairs.select(
        "component", part("a", "rows").alias("row"), every("cols").alias("col"), F.col("a").alias("id"), F.lit(0).alias("rank")
    )
    members = grouped.join(tiles, "component").select(
        "component", every("rows").alias("row"), part("account", "cols").alias("col"), F.col("account").alias("id"), F.lit(1).alias("rank")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, waiting = None, {}
        for batch in batches:
            linked = []
            for t, i, rank, text in zip(zip(batch["component"], batch["row"], batch["col"]), batch["id"], batch["rank"], batch["text"]):
                if t != tile:
                    tile, waiting = t, {}
                found = shingles(text, words)
                if rank == 0:
                    waiting[i] = found
                    continue
                for x in [x for x, own in waiting.items() if _similar(own, found, percent)]:
                    linked.append((x, i))
                    del waiting[x]
            yield pd.DataFrame(linked, columns=["a", "b"], dtype=np.int64)

    dealt = ("component", "row", "col")
    side_by_side = _ranked_texts(texts.unionByName(members), docs, *dealt).select(*dealt, "id", "rank", "text")
    return ws.write(side_by_side.mapInPandas(compare, "a long, b long"), "links")


def _across(ws: Workspace, shared: DataFrame, signs: DataFrame, grouped: DataFrame, r: int) -> DataFrame:
    """``(a, b, whole)``: texts of different groups that share a bucket, or a text and a group if ``whole``."""
    in_group = grouped.select(F.col("account").alias("id"), "component")
    members = shared.select("key", "id").join(in_group, "id", "left")
    members = ws.write(members.withColumn("component", F.coalesce("component", "id")), "members")
    there = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    held = there.groupBy("key").agg(F.count("*").alias("groups")).where("groups > 1").select("key")
    divided = ws.write(members.join(there.join(held, "key"), ["key", "component"]).join(signs, "id"), "divided")
    few = divided.where(F.col("n") <= FEW)
    many = divided.where(F.col("n") > FEW).groupBy("key", "component").agg(
        F.max("n").alias("n"), F.lit(None).cast("long").alias("id"), *[F.lit(None).cast("long").alias(w) for w in _WORDS]
    )
    met = divided.alias("p").join(few.unionByName(many).alias("t"), F.col("p.key") == F.col("t.key")).where(
        "p.component <> t.component and (p.n < t.n or (p.n = t.n and p.component < t.component))"
    )
    near = met.where(F.col("t.id").isNull() | (_apart("p", "t") <= r))
    whole = F.col("t.id").isNull()
    return near.select(
        F.col("p.id").alias("a"), F.coalesce("t.id", "t.component").alias("b"), whole.alias("whole")
    ).distinct()


def near_copies(
    ws: Workspace, docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """``(key, n_shingles, component_id, kept)``, one row per row of ``docs``.

    Texts are linked if 100 * |common shingles| >= percent * |all shingles| of the two; a component is
    named after its smallest key, which alone is kept.  Null and empty texts have no shingles, are linked
    with nothing and are kept.  Rows of one key count as one document.  A row without a key is in no
    component and is kept.  An empty table gives no rows; other columns are left behind.
    """
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    signed = ws.write(_signed(docs, words, percent), "signed")
    usable = signed.where("n > 0 and id is not null")
    folded = usable.groupBy("fingerprint").agg(
        F.min("id").alias("id"), *[F.any_value(c).alias(c) for c in ("keys", *_WORDS)]
    )
    folded = ws.write(folded, "folded")
    signs = folded.select("id", *_WORDS)
    indexed = folded.select("id", F.explode("keys").alias("key"))
    met = indexed.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("_last")).where("first < _last")
    shared = ws.write(indexed.join(met.select("key", "first"), "key"), "shared")

    # From here on only texts that share a bucket move.
    texts = ws.write(docs.join(shared.select("id").distinct(), "id", "left_semi"), "texts")

    r = distance(percent, BITS, 1)
    stars = shared.where("id <> first").select("first", "id").distinct()
    first = signs.withColumnRenamed("id", "first").alias("p")
    stars = stars.join(first, "first").join(signs.alias("t"), "id").where(_apart("p", "t") <= r)
    near = _confirmed_pairs(ws, stars.select(F.col("first").alias("a"), F.col("id").alias("b")), texts, words, percent)
    grouped = ws.write(components(ws, near, "a", "b"), "grouped")
    across = ws.write(_across(ws, shared, signs, grouped, r), "across")
    rest = _confirmed_pairs(ws, across.where("not whole").select("a", "b"), texts, words, percent)
    far = _confirmed_groups(ws, across.where("whole").select("a", "b"), grouped, texts, words, percent)
    equal = usable.join(folded.select("fingerprint", F.col("id").alias("first")), "fingerprint")
    same = equal.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    final = components(ws, near.union(rest).union(far).union(same), "a", "b")

    of = signed.select("id", F.col("n").alias("n_shingles")).join(
        final.select(F.col("account").alias("id"), "component"), "id", "left"
    )
    component = F.coalesce("component", "id")
    return of.select(
        F.col("id").alias(key),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
