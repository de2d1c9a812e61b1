"""Runs of words: stretches that repeat with a smallest period, and texts with the repeats taken out.

Every run holds a Lyndon word that is the longest one beginning at its place, under an order
of the words or under the reverse of it.  Those longest Lyndon words come out of the first
phase of a suffix sorter (Baier 2016): suffixes are grouped by their first word; groups are
taken from the greatest down, and each group's prefix is appended to the prefixes of the
suffixes right before its members, which moves those to new, greater groups.  What a group
holds when its turn comes is the longest Lyndon word at each of its members.  Each such word is
then extended both ways, as far as words one length apart are equal: the longest common
extensions of its two ends.

A text is worked on by itself, in time and memory proportional to its words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.text import with_columns

#: A run is at least this many words and at least this many periods long.
MIN_WORDS, MIN_PERIODS = 6, 4

_GONE: list[int] = []  # members of a group whose turn is over


def lyndon_lengths(codes: Sequence[int], kinds: int) -> list[int]:
    """Length of the longest Lyndon word that begins at each place; codes are below ``kinds``.

    Places not yet taken begin blocks that lie end to end; ``before[e]`` is where the block that ends
    at ``e`` begins.  A group's members in ascending order therefore find what stands right before them,
    also where members follow each other.
    """
    n = len(codes)
    members: list[list[int]] = [[] for _ in range(kinds)]
    for place, code in enumerate(codes):
        members[code].append(place)
    group = list(codes)
    length = [1] * kinds
    alive = [len(m) for m in members]
    lower, upper = list(range(-1, kinds - 1)), [*range(1, kinds), -1]
    before = list(range(-1, n))
    found = [0] * n

    def move(places: list[int], old: int, longer: int) -> None:
        """Take places out of a group and into a new one right above it, whose prefix is that much longer."""
        if alive[old] == len(places):
            length[old] += longer
            return
        new = len(members)
        for place in places:
            group[place] = new
        members.append(places)
        alive.append(len(places))
        alive[old] -= len(places)
        length.append(length[old] + longer)
        above = upper[old]
        lower.append(old)
        upper.append(above)
        upper[old] = new
        lower[above] = new  # there is always one above: the group whose turn it is

    top = kinds - 1
    while top >= 0:
        size = length[top]
        taken = members[top]
        if alive[top] != len(taken):
            taken = [p for p in taken if group[p] == top]
        members[top] = _GONE
        if len(taken) == 1:
            place = taken[0]
            found[place] = size
            left = before[place]
            before[place + size] = left
            if left >= 0:
                old = group[left]
                if alive[old] == 1:
                    length[old] += size
                else:
                    move([left], old, size)
        else:
            # Each place before, with how many members stand after it in a row; places ascend.
            follows: list[list[int]] = []
            last = -1
            for place in taken:
                found[place] = size
                left = before[place]
                before[place + size] = left
                if left >= 0:
                    if left == last:
                        follows[-1][1] += 1
                    else:
                        follows.append([left, 1])
                        last = left
            sorted_out: dict[tuple[int, int], list[int]] = {}
            for left, times in follows:
                sorted_out.setdefault((times, group[left]), []).append(left)
            # More of the prefix means a greater group, so those leave first and end up highest.
            for times, old in sorted(sorted_out, reverse=True):
                move(sorted_out[times, old], old, times * size)
        top = lower[top]
    return found


def _first_difference(codes: np.ndarray, at: int, period: int, step: int) -> int:
    """How far on from ``at``, in direction ``step``, words one period apart stay equal."""
    far, chunk = 0, 16
    while True:
        if step > 0:
            one, two = codes[at + far : at + far + chunk], codes[at + far + period : at + far + period + chunk]
            one = one[: len(two)]
        else:
            stop = at - far
            start = max(0, stop - chunk)
            one, two = codes[start:stop][::-1], codes[start + period : stop + period][::-1]
        if not len(one):
            return far
        differs = one != two
        first = int(differs.argmax())
        if differs[first]:
            return far + first
        far += len(one)
        chunk *= 2


def runs_of(words: Sequence, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run, by start, then period.

    ``min_periods`` is 2 at least.
    """
    n = len(words)
    if n < max(min_words, min_periods):
        return []
    codes_by_word: dict = {}
    codes = [codes_by_word.setdefault(w, len(codes_by_word)) for w in words]
    kinds = len(codes_by_word)
    series = np.array(codes, dtype=np.int32)
    places = np.arange(n)
    roots = []
    for order in (codes, [kinds - 1 - c for c in codes]):
        lengths = np.array(lyndon_lengths(order, kinds))
        # A run goes on for at least this long behind the first of its Lyndon words; looked at in three places.
        ahead = (min_periods - 2) * lengths
        ok = places + ahead + lengths < n
        at, size, ahead = places[ok], lengths[ok], ahead[ok]
        same = series[at] == series[at + size]
        for offset in (ahead // 2, ahead):
            same &= series[at + offset] == series[at + offset + size]
        at, size = at[same], size[same]
        roots.append(np.stack([size, at], axis=1))
    found, period, upto = [], 0, 0
    candidates = np.unique(np.concatenate(roots), axis=0)
    for size, at in candidates.tolist():
        if size == period and at < upto:
            continue
        start = at - _first_difference(series, at, size, -1)
        period, upto = size, at + _first_difference(series, at, size, 1)
        long = upto + size - start
        if long >= max(min_words, min_periods * size):
            found.append((start, long, size))
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words: Sequence, runs: Sequence[tuple[int, int, int]]) -> list:
    """The words that no run holds beyond its first period."""
    kept = np.ones(len(words), dtype=bool)
    for start, long, period in runs:
        kept[start + period : start + long] = False
    return [words[i] for i in np.flatnonzero(kept)] if runs else list(words)


def find_runs(
    docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS
) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length and period in words) and ``collapsed`` text.

    Words are what stands between ASCII white space.  A run is a stretch whose words one period apart are
    equal, that can't be extended, and that is long enough; its period is its smallest.  ``collapsed`` keeps
    the first period of each run, joined by one blank.  Null and empty texts have no words, no runs and an
    empty ``collapsed``; repeated rows get the same each; an empty table stays empty; columns named like the
    results give way.  A text is handled whole and takes about 200 bytes a word.
    """

    @F.pandas_udf("n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                words = (t or "").encode("utf-8", "surrogatepass").split()
                runs = runs_of(words, min_words, min_periods)
                rest = b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass")
                rows.append((len(words), [dict(zip(("start", "length", "period"), run)) for run in runs], rest))
            yield pd.DataFrame(rows, columns=["n_words", "runs", "collapsed"])

    made = with_columns(docs, _found=found(F.col(text)))
    return with_columns(made, **{n: F.col("_found")[n] for n in ("n_words", "runs", "collapsed")}).drop("_found")
