"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point.  Three
letters in a row are bound into one vector: the first is rotated by two places,
the second by one, and all three are multiplied.  A text's vector bundles (adds)
those of all its letter triples; runs of anything but letters count as one blank.
A language's prototype bundles the unit vectors of its texts.  A text belongs to
the prototype of largest cosine, after what all prototypes share is taken off
both sides (Joshi, Halseth, Kanerva 2016, with centring).

Prototypes come from a bounded sample of texts per language; every text is read
whole and compared inside Spark tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.text import Memo, once, with_columns
from ledgerweave.workspace import Workspace

DIMENSIONS = 1_024
#: Texts per language that the prototypes are made of, about; chosen by a hash of their key.
MAX_PER_LANGUAGE = 4_000
#: Every worker holds all prototypes, so there may be no more than this.
MAX_LANGUAGES = 512
#: The answer for a text without a letter.
UNDETERMINED = "und"

_BLOCK = 4_096  # triples bundled at a time
_CACHED = 12_288  # triple vectors a worker keeps
_GROUP = 64  # texts multiplied at a time
_BITS = 21  # of a code point


def triples(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter triples, three code points packed in one number each, and how often each occurs."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    letter = once("letters", lambda: np.array([chr(i).isalpha() for i in range(0x110000)]))[codes]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.concatenate([[32], np.where(letter, codes, 32), [32]])
    blank = codes == 32
    codes = codes[~(blank & np.concatenate([[False], blank[:-1]]))]
    packed = (codes[:-2] << (2 * _BITS)) | (codes[1:-1] << _BITS) | codes[2:]
    return np.unique(packed, return_counts=True)


class Encoder:
    """Bundles of triple vectors; keeps vectors it has made before, up to a bound."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.letters = Memo(
            lambda code: np.random.default_rng(code).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1, 8_192
        )
        self.place: dict[int, int] = {}
        self.kept = np.zeros((_CACHED, dimensions), np.float32)

    def _bound(self, packed: np.ndarray) -> np.ndarray:
        mask = (1 << _BITS) - 1
        first, second, third = (
            np.array([self.letters[int(c)] for c in (packed >> shift) & mask]) for shift in (2 * _BITS, _BITS, 0)
        )
        return np.roll(first, 2, axis=1) * np.roll(second, 1, axis=1) * third

    def vectors(self, packed: np.ndarray) -> np.ndarray:
        """A row per triple; at most ``_BLOCK`` of them."""
        missing = [int(p) for p in packed if int(p) not in self.place]
        if missing:
            if len(self.place) + len(missing) > _CACHED:
                self.place.clear()
                missing = [int(p) for p in packed]
            at = len(self.place)
            self.kept[at : at + len(missing)] = self._bound(np.array(missing, np.int64))
            self.place.update(zip(missing, range(at, at + len(missing))))
        return self.kept[[self.place[int(p)] for p in packed]]

    def encode(self, texts: list[str | None]) -> np.ndarray:
        """A unit vector per text; zero where there is no letter."""
        found = [triples(t) for t in texts]
        known, where = np.unique(np.concatenate([t for t, _ in found]), return_inverse=True)
        row = np.repeat(np.arange(len(texts)), [len(t) for t, _ in found])
        counts = np.concatenate([n for _, n in found]).astype(np.float32)
        bundled = np.zeros((len(texts), self.dimensions), np.float32)
        for start in range(0, len(known), _BLOCK):
            within = (where >= start) & (where < start + _BLOCK)
            block = known[start : start + _BLOCK]
            times = np.zeros((len(texts), len(block)), np.float32)
            times[row[within], where[within] - start] = counts[within]
            bundled += times @ self.vectors(block)
        length = np.linalg.norm(bundled, axis=1, keepdims=True)
        return bundled / np.where(length > 0, length, 1)


@dataclass(frozen=True)
class Profiles:
    """Languages in order, and a unit prototype for each."""

    languages: tuple[str, ...]
    prototypes: np.ndarray

    def judge(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each vector: the language's number, the cosine after centring, and the plain cosine."""
        shared = self.prototypes.mean(axis=0) if len(self.languages) > 1 else np.zeros(self.prototypes.shape[1])
        own, theirs = vectors - shared, self.prototypes - shared
        scale = np.linalg.norm(own, axis=1, keepdims=True) * np.linalg.norm(theirs, axis=1)
        cosine = np.clip((own @ theirs.T) / np.where(scale > 0, scale, 1), -1, 1)
        best = cosine.argmax(axis=1)
        rows = np.arange(len(vectors))
        return best, cosine[rows, best], (vectors @ self.prototypes.T)[rows, best]


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``(text, lang)``: all texts of small languages and about ``MAX_PER_LANGUAGE`` of the others."""
    counts = docs.where(F.col(lang).isNotNull()).groupBy(lang).count().limit(MAX_LANGUAGES + 1)
    sizes = {r[lang]: r["count"] for r in counts.collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; merge some or raise MAX_LANGUAGES")
    if not sizes:
        return docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.lit(False))
    share = F.lit(0.0)
    for name, n in sorted(sizes.items()):
        share = F.when(F.col(lang) == name, F.lit(min(1.0, MAX_PER_LANGUAGE / n))).otherwise(share)
    chance = F.pmod(F.xxhash64(F.col(key), F.lit("language")), F.lit(1 << 30)) / (1 << 30)
    return docs.where((chance < share) & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang")
    )


def fit(ws: Workspace, texts: DataFrame, tasks: int = 16) -> Profiles:
    """Prototypes from ``(text, lang)``.

    The sample is written once and bundled by ``tasks`` tasks, so that at most ``tasks`` times
    ``MAX_LANGUAGES`` vectors reach the driver.
    """

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, sums = once("encoder", Encoder), {}
        for batch in batches:
            for lang, group in batch.groupby("lang")["text"]:
                for start in range(0, len(group), _GROUP):
                    added = encoder.encode(list(group[start : start + _GROUP])).sum(axis=0, dtype=float)
                    sums[lang] = sums.get(lang, 0) + added
        vectors = pd.Series([v.tobytes() for v in sums.values()], dtype=object)
        yield pd.DataFrame({"lang": pd.Series(list(sums), dtype=object), "vector": vectors})

    rows = ws.write(texts, "language").coalesce(tasks)
    parts = rows.mapInPandas(bundle, "lang string, vector binary").orderBy("lang", "vector").collect()
    totals: dict[str, np.ndarray] = {}
    for part in parts:
        totals[part.lang] = totals.get(part.lang, 0) + np.frombuffer(part.vector)
    used = {name: v for name, v in sorted(totals.items()) if np.linalg.norm(v) > 0}
    prototypes = np.array([v / np.linalg.norm(v) for v in used.values()]).reshape(len(used), DIMENSIONS)
    return Profiles(tuple(used), prototypes.astype(np.float32))


def judge(profiles: Profiles) -> Column:
    """A function from text to ``(lang_pred, score, likeness)``, for use in ``withColumn``."""

    @F.pandas_udf("lang_pred string, score double, likeness double")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = once("encoder", Encoder)
        names = np.array([*profiles.languages, UNDETERMINED], dtype=object)
        for texts in batches:
            out = []
            for start in range(0, len(texts), _GROUP):
                vectors = encoder.encode(list(texts[start : start + _GROUP]))
                best, cosine, plain = (np.zeros(len(vectors), int), *np.zeros((2, len(vectors))))
                if profiles.languages:
                    best, cosine, plain = profiles.judge(vectors)
                unread = ~vectors.any(axis=1) | (len(profiles.languages) == 0)
                out.append(
                    pd.DataFrame(
                        {
                            "lang_pred": pd.Series(names[np.where(unread, len(profiles.languages), best)], dtype=object),
                            "score": np.where(unread, 0.0, (1 + cosine) / 2),
                            "likeness": np.where(unread, 0.0, plain),
                        }
                    )
                )
            yield pd.concat(out, ignore_index=True)

    return judged


def predict(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``likeness`` (cosine with the language's prototype).

    Null texts and texts without a letter, or without any language learned, get ``und``, 0 and 0;
    ties go to the language of smaller name; repeated rows get the same answer each; columns named
    like the results give way.
    """
    read = with_columns(docs, _judged=judge(profiles)(F.col(text)))
    made = {name: F.col("_judged")[name] for name in ("lang_pred", "score", "likeness")}
    return with_columns(read, **made).drop("_judged")
