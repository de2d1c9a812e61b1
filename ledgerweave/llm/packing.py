"""Packing documents into sequences by vector best fit.

A sequence has three capacities: tokens, pieces of documents, and attention cost (the
sum of squared piece lengths).  Pieces are placed from the longest down.  Of the open
sequences that have room in every capacity, one is chosen by a score over what is left
of them: the largest weighted dot product of demand and residue, or the smallest
residual norm after placing (Panigrahy, Talwar, Uyeda, Wieder 2011); without any, a new
sequence opens.

Tokenising and cutting run inside the tasks that read the documents.  Only the list of
pieces (a few numbers each) is shuffled, into groups of about ``GROUP_PIECES`` pieces
that are packed independently; such a group is thousands of sequences, so that the few
it leaves part empty do not count.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.text import Known, once
from ledgerweave.workspace import Workspace

SEQUENCE_TOKENS = 2_048
END_OF_DOCUMENT = 0
#: Pieces packed by one task at a time.
GROUP_PIECES = 8_192

# Pre-tokens reach across a space only where that space stands between white space and more of it, or the end.
_ACROSS = re.compile(r"\s \s|\s $")


# Texts of these characters are cut into words here by the rule of byte-level files, others by the library.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_PLAIN = re.compile(f"[\n -~{_LETTERS}]*")
# No space but single ones, and no lines but within words: what the library cuts as told when lines are put between.
_JOINABLE = re.compile(" ?[!-~" + _LETTERS + "]+")
_PLAIN_WORD = re.compile(f" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+|\\s+(?!\\S)|\\s+")
_WORDS = 1_000_000  # held by a worker
_TOGETHER = 200  # words encoded as one text


class ByteBpe:
    """Token ids of a byte-level BPE file, as little-endian unsigned 32-bit numbers.

    Texts are cut into words as the file's rule does, and the ids of each are kept; words recur far more often than
    not.  A pre-token of this kind of file holds no space but a leading one, so a text with unusual characters is cut
    at its spaces first, and its parts that have them are encoded as they stand.  Texts where that does not hold, or with a
    special token's name in them, are encoded in one go.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and words are too short to share out
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = Known(_WORDS)
        line = self._direct(["\n"])[0]
        self.line = int.from_bytes(line, "little") if len(line) == 4 else None

    def _direct(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in found)]

    def _joined(self, words: list[str]) -> list[bytes]:
        """The ids of words that can stand on lines of their own, of which many are encoded as one text."""
        texts = ["\n".join(words[i : i + _TOGETHER]) for i in range(0, len(words), _TOGETHER)]
        out: list[bytes] = []
        for encoded in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(encoded.ids, "<u4")
            lines, raw = 4 * np.flatnonzero(ids == self.line), ids.tobytes()
            out += [raw[start:end] for start, end in zip([0, *(lines + 4).tolist()], [*lines.tolist(), len(raw)])]
        return out

    def _prepare(self, wanted: set[str]) -> None:
        """Encode the words that are not known yet."""
        missing = self.words.lacking(wanted)
        joinable = [w for w in missing if _JOINABLE.fullmatch(w)] if self.line is not None else []
        found = self._joined(joinable)
        if len(found) == len(joinable):
            missing = missing.difference(joinable)
            self.words.younger.update(zip(joinable, found))
        others = list(missing)
        self.words.younger.update(zip(others, self._direct(others)))

    def _cut(self, text: str) -> list[str] | None:
        if any(s in text for s in self.special):
            return None
        if _PLAIN.fullmatch(text):
            return _PLAIN_WORD.findall(text)
        if _ACROSS.search(text):
            return None
        first, *others = text.split(" ")
        parts = [first, *[" " + p for p in others]]
        return list(chain.from_iterable(_PLAIN_WORD.findall(p) if _PLAIN.fullmatch(p) else [p] for p in parts))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        collecting = gc.isenabled()
        gc.disable()  # there are no cycles here, and each search for some would walk all that is kept
        try:
            split = [self._cut(t) for t in texts]
            self._prepare(set().union(*filter(None, split)))
            known = self.words.younger.__getitem__
            encoded = [self._direct([t])[0] if words is None else b"".join(map(known, words)) for t, words in zip(texts, split)]
        finally:
            if collecting:
                gc.enable()
        yield from encoded


def cut(length: int, most: int) -> Iterator[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document; all but the first are full."""
    first = (length - 1) % most + 1
    yield 0, first
    for start in range(first, length, most):
        yield start, most


def pieces(path: str, most: int = SEQUENCE_TOKENS) -> Column:
    """A function from text to its pieces ``(piece, start, length, ids_crc32)``.

    A document is its token ids and then ``END_OF_DOCUMENT``; a null text counts as empty, so
    every row has a piece.
    """
    end = np.array([END_OF_DOCUMENT], "<u4").tobytes()

    @F.pandas_udf("array<struct<piece int, start long, length long, ids_crc32 long>>")
    def cut_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = once(("byte_bpe", path), lambda: ByteBpe(path))
        for texts in batches:
            out = []
            for encoded in encoder.encode([t or "" for t in texts]):
                ids = encoded + end
                out.append(
                    [
                        {"piece": i, "start": s, "length": n, "ids_crc32": zlib.crc32(ids[4 * s : 4 * (s + n)])}
                        for i, (s, n) in enumerate(cut(len(ids) // 4, most))
                    ]
                )
            yield pd.Series(out, dtype=object)

    return cut_texts


def best_fit(
    lengths: np.ndarray,
    tokens: int = SEQUENCE_TOKENS,
    documents: int | None = None,
    attention: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1),
    rule: str = "norm",
) -> tuple[np.ndarray, np.ndarray]:
    """``(sequence, offset)`` of each piece; pieces no longer than ``tokens``, in any order.

    ``documents`` and ``attention`` bound the pieces and the sum of squared lengths of a sequence
    (a piece that alone costs more than ``attention`` stands alone).  ``rule`` is ``norm`` (smallest
    weighted norm of what is left) or ``dot`` (largest weighted product of demand and residue).
    Capacities, demands and residues are taken as shares of the whole; ties go to the oldest sequence.
    """
    scale = np.array([tokens, documents or tokens, attention or float(tokens) ** 2], float)
    squared = np.array(weights, float)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left = np.zeros((len(lengths), 3))  # residues of the open sequences
    number = np.zeros(len(lengths), np.int64)
    is_open = opened = 0
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    shortest = int(lengths.min()) if len(lengths) else 0
    for at in order:
        n = int(lengths[at])
        demand = np.array([n, 1.0, float(n) ** 2]) / scale
        rest = left[:is_open] - demand
        fits = np.flatnonzero((rest >= -1e-12).all(axis=1))
        if len(fits):
            score = -(rest[fits] ** 2 @ squared) if rule == "norm" else left[:is_open][fits] @ (squared * demand)
            chosen = int(fits[score.argmax()])
        else:
            chosen, left[is_open], number[is_open] = is_open, 1.0, opened
            is_open, opened = is_open + 1, opened + 1
        sequence[at], offset[at] = number[chosen], round((1 - left[chosen, 0]) * tokens)
        left[chosen] -= demand
        if left[chosen, 0] * tokens < shortest - 1e-6:  # no piece fits any more; close it, keeping the others in order
            left[chosen : is_open - 1] = left[chosen + 1 : is_open]
            number[chosen : is_open - 1] = number[chosen + 1 : is_open]
            is_open -= 1
    return sequence, offset


def pack(
    ws: Workspace,
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    tokens: int = SEQUENCE_TOKENS,
    documents: int | None = None,
    attention: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1),
    rule: str = "norm",
) -> DataFrame:
    """One row per piece: ``key``, piece, start, length, ids_crc32, sequence_id, offset.

    ``path`` names a byte-level tokenizer file every executor can open.  Null texts count as empty;
    repeated rows are packed each; an empty table gives no rows; other columns are left behind.
    """
    cut_up = docs.select(F.col(key), F.inline(pieces(path, tokens)(F.col(text))))
    # The row's number spreads repeated rows over the groups; it is stored, so that a repeated task deals alike.
    listed = ws.write(cut_up.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, round(ws.rows(listed) / GROUP_PIECES))

    def place(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_row", ignore_index=True)
        sequence, offset = best_fit(
            rows["length"].to_numpy(), tokens, documents, attention, weights, rule
        )
        return rows.assign(sequence_id=(int(group[0]) << 32) + sequence, offset=offset).drop(columns=["_row", "_group"])

    kind = dict(listed.dtypes)[key]
    return (
        listed.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
        .groupBy("_group")
        .applyInPandas(
            place,
            f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
        )
    )
