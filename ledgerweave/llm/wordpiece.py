"""Word-piece counts by a linear longest-match automaton.

Greedy longest match looks back over a word each time a match breaks off.  The automaton
does not: a trie of the vocabulary gets a failure link per node, which leads to where
matching goes on once the pieces that are certain have been popped, and holds how many
those are (Song, Salcianu, Song, Dopson, Zhou 2021).  A count thus needs one step per
byte and an addition per link followed; no piece is built.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.text import Memo, once, with_columns

_NOWHERE = -1
_START, _INSIDE = 0, 1  # where a word begins, and where a piece has just ended


class LongestMatch:
    """Counts the pieces that greedy longest match cuts a word into.

    ``first`` are the pieces that may begin a word, ``later`` those that may follow another piece.
    """

    def __init__(self, first: Iterable[bytes], later: Iterable[bytes]):
        self.step: list[dict[int, int]] = [{}, {}]
        whole = [False, False]
        for root, pieces in ((_START, first), (_INSIDE, later)):
            for piece in pieces:
                node = root
                for byte in piece:
                    if byte not in self.step[node]:
                        self.step[node][byte] = len(self.step)
                        self.step.append({})
                        whole.append(False)
                    node = self.step[node][byte]
                whole[node] = len(piece) > 0 or whole[node]
        self.link = [_NOWHERE] * len(self.step)
        self.popped = [0] * len(self.step)
        queue = deque([_START, _INSIDE])
        while queue:
            node = queue.popleft()
            for byte, child in self.step[node].items():
                if whole[child]:
                    self.link[child], self.popped[child] = _INSIDE, 1
                else:
                    at, popped = self.link[node], self.popped[node]
                    while at != _NOWHERE and byte not in self.step[at]:
                        at, popped = self.link[at], popped + self.popped[at]
                    if at != _NOWHERE:
                        self.link[child], self.popped[child] = self.step[at][byte], popped
                queue.append(child)

    def count(self, word: bytes) -> int | None:
        """Pieces of the word, or None if it can't be cut into pieces."""
        if not word:
            return 0
        node, total = _START, 0
        for byte in word:
            while byte not in self.step[node]:
                if self.link[node] == _NOWHERE:
                    return None
                total += self.popped[node]
                node = self.link[node]
            node = self.step[node][byte]
        while node != _INSIDE:
            if self.link[node] == _NOWHERE:
                return None
            total += self.popped[node]
            node = self.link[node]
        return total


def marked(vocabulary: Iterable[str], mark: str = "##") -> LongestMatch:
    """From a word-piece vocabulary, in which ``mark`` stands before pieces that follow another."""
    tokens = list(vocabulary)
    later = [t[len(mark) :].encode() for t in tokens if t.startswith(mark) and len(t) > len(mark)]
    return LongestMatch([t.encode() for t in tokens if not t.startswith(mark)], later)


def byte_symbols() -> dict[str, int]:
    """The symbol that stands for each byte in byte-level vocabularies: itself if printable Latin-1, else the next free one from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_level(path: str) -> LongestMatch:
    """From a byte-level tokenizer file: pieces that begin with a blank begin a word, the others follow.

    Both kinds hold every needed single byte (the blank alone; each byte), so all words can be cut.
    """
    symbols = byte_symbols()
    vocab = json.loads(Path(path).read_text(encoding="utf-8"))["model"]["vocab"]
    tokens = [bytes(symbols[c] for c in t) for t in vocab if all(c in symbols for c in t)]
    return LongestMatch([t for t in tokens if t[:1] == b" "], [t for t in tokens if t[:1] != b" "])


def count_pieces(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_pieces`` and ``n_unknown`` (words that can't be cut; one piece each).

    Words are what stands between ASCII white space.  Null and empty texts have none; repeated rows get
    the same each; an empty table stays empty; columns named like the results give way.
    """

    @F.pandas_udf("n_words long, n_pieces long, n_unknown long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = once(("pieces", path), lambda: byte_level(path))
        memo = once(("piece counts", path), lambda: Memo(lambda w: automaton.count(b" " + w), 200_000))
        for texts in batches:
            rows = []
            for t in texts:
                found = list(map(memo.__getitem__, (t or "").encode("utf-8", "surrogatepass").split()))
                unknown = found.count(None)
                rows.append((len(found), sum(filter(None, found)) + unknown, unknown))
            yield pd.DataFrame(rows, columns=["n_words", "n_pieces", "n_unknown"])

    made = with_columns(docs, _counted=counted(F.col(text)))
    names = ("n_words", "n_pieces", "n_unknown")
    return with_columns(made, **{n: F.col("_counted")[n] for n in names}).drop("_counted")
