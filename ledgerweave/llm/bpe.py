"""Exact BPE ids by dynamic programming over prefixes, and decoding.

Merging pair by pair is replaced by one pass over a word.  The BPE encoding of a prefix
ends in one token only; if that last token is known for every shorter prefix, then among
the tokens that end at a place the right one is the one that stays apart from the last
token before it.  An automaton over the vocabulary names the tokens that end at each
place; two neighbouring tokens stay apart if undoing their merges from the latest to the
earliest never meets a pair across their border that would have merged first.  Back-pointers
from the end of the word then give the ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import deque
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.text import Known, Memo, once, with_columns
from ledgerweave.llm.wordpiece import byte_symbols

_END = "\n"  # stands for the suffix that marks the end of a word; no byte-level symbol is a line feed
_NEVER = 1 << 60
_PARTS, _WORDS = 600_000, 300_000  # held by a worker

# Texts of these characters need no composing, and lower case and the classes of characters are beyond doubt;
# they are cut here by the rule that the file states, others by the library.
_PLAIN = re.compile("[\n!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*")
_PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")
#: Fixed value: that rule.
_WORDS_RULE = json.dumps(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class Merges:
    """Vocabulary and merge ranks, and which tokens may stand side by side."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str | None = None):
        inner = {t: self._inner(t, suffix) for t in vocab}
        self.text = {i: inner[t] for t, i in vocab.items()}
        self.ids = {text: i for i, text in self.text.items()}
        self.rank: dict[int, int] = {}  # of the merge that makes a token; none for a single symbol
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        for rank, (left, right) in enumerate(merges):
            made = vocab[left + right]
            self.rank[made], self.halves[made] = rank, (vocab[left], vocab[right])
            self.pairs[vocab[left], vocab[right]] = rank
        self.apart = Memo(lambda pair: self.stays_apart(*pair, _NEVER), 500_000)
        self.reached = {i for i in vocab.values() if i not in self.rank}
        for made, rank in sorted(self.rank.items(), key=lambda item: item[1]):
            left, right = self.halves[made]
            if left in self.reached and right in self.reached and self.stays_apart(left, right, rank):
                self.reached.add(made)

    @staticmethod
    def _inner(token: str, suffix: str | None) -> str:
        return token[: -len(suffix)] + _END if suffix and token.endswith(suffix) else token

    def stays_apart(self, left: int, right: int, before: int) -> bool:
        """Whether no merge of rank under ``before`` joins the two across their border.

        Equal merges happen from left to right: a border loses a tie with the token to its left,
        and wins one with the token to its right.
        """
        while True:
            if self.pairs.get((left, right), _NEVER) < before:
                return False
            of_left, of_right = self.rank.get(left, -1), self.rank.get(right, -1)
            if of_left == of_right == -1:
                return True
            if of_left > of_right:
                before, left = of_left, self.halves[left][1]
            else:
                before, right = of_right + 1, self.halves[right][0]


class Automaton:
    """Names, for every place of a text, the vocabulary's words that end there, longest first."""

    def __init__(self, words: dict[str, int]):
        self.step: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, ...]] = [()]
        for word, value in words.items():
            state = 0
            for c in word:
                if c not in self.step[state]:
                    self.step[state][c] = len(self.step)
                    self.step.append({})
                    self.ends.append(())
                state = self.step[state][c]
            self.ends[state] = (value,)
        self.shorter = [0] * len(self.step)
        queue = deque(self.step[0].values())
        while queue:
            state = queue.popleft()
            self.ends[state] += self.ends[self.shorter[state]]
            for c, child in self.step[state].items():
                back = self.shorter[state]
                while back and c not in self.step[back]:
                    back = self.shorter[back]
                self.shorter[child] = self.step[back].get(c, 0)
                queue.append(child)


class Bpe:
    """Encoder for a tokenizer file whose model is BPE with an end-of-word suffix or without one.

    The file's own normalizer and pre-tokenizer cut a text into words; both are the tokenizers
    library's.  What a word becomes is worked out here.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        self.suffix = model.get("end_of_word_suffix")
        self.merges = Merges(model["vocab"], [tuple(m) for m in model["merges"]], self.suffix)
        self.automaton = Automaton({text: i for text, i in self.merges.ids.items() if i in self.merges.reached})
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.token = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        named = "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.named = re.compile(f"({named})") if named else None
        self.plain = _WORDS_RULE in json.dumps(json.loads(Path(path).read_text(encoding="utf-8"))["pre_tokenizer"])
        self.length = {i: len(text) for i, text in self.merges.text.items()}
        self.symbol = {byte: symbol for symbol, byte in byte_symbols().items()}
        self.words = Known(_WORDS)
        #: By what stands between two blanks: number of tokens, ids as text, tokens as text.
        self.parts = Known(_PARTS)

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of pre-tokenized words.

        The words are taken in order, so that what is known of a prefix serves the next word too.
        """
        done, before = {}, ""
        last: list[int | None] = [None]
        states = [0]
        length, apart = self.length, self.merges.apart
        step, shorter, ends = self.automaton.step, self.automaton.shorter, self.automaton.ends
        for word in sorted(words):
            text = word + _END if self.suffix else word
            same, most = 0, min(len(text), len(before))
            while same < most and text[same] == before[same]:
                same += 1
            del last[same + 1 :], states[same + 1 :]
            state, before = states[same], text
            for place in range(same + 1, len(text) + 1):
                c = text[place - 1]
                while state and c not in step[state]:
                    state = shorter[state]
                state = step[state].get(c, 0)
                states.append(state)
                for token in ends[state]:
                    start = place - length[token]
                    if start == 0 or (last[start] is not None and apart[last[start], token]):
                        last.append(token)
                        break
                else:
                    last.append(None)
            ids, place = [], len(text)
            while place:
                if last[place] is None:
                    raise ValueError(f"the vocabulary does not cover {word!r}")
                ids.append(last[place])
                place -= length[last[place]]
            done[word] = tuple(ids[::-1])
        return done

    def _cut(self, text: str) -> list[str | int]:
        """Words of a text, and ids of the special tokens named in it, as the library finds them."""
        if self.plain and _PLAIN.fullmatch(text) and "<|" not in text:
            found = _PLAIN_WORD.findall(text.lower())
            return [w if w.isascii() else "".join([self.symbol[b] for b in w.encode()]) for w in found]
        words: list[str | int] = []
        for piece in self.named.split(text) if self.named else [text]:
            if piece in self.special:
                words.append(self.special[piece])
            elif piece:
                normal = self.tokenizer.normalizer.normalize_str(piece) if self.tokenizer.normalizer else piece
                words += [word for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        return words

    def ids(self, text: str) -> list[int]:
        """Ids of any text; names of special tokens in it become their ids, as with the library."""
        words = self._cut(text)
        known = self.encode_words({w for w in words if isinstance(w, str)})
        return [i for w in words for i in (known[w] if isinstance(w, str) else (w,))]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens side by side with a blank between, which is decoding where a file names no decoder."""
        return " ".join([self.token[i] for i in ids])

    def _prepare(self, texts: list[str]) -> None:
        """Encode what stands between the blanks of these texts and is not known yet."""
        wanted = set()
        for text in texts:
            wanted.update(text.split(" "))
        cut = {p: self._cut(p) for p in self.parts.lacking(wanted)}
        new = self.words.lacking({w for found in cut.values() for w in found if isinstance(w, str)})
        words = self.words.younger
        words.update(self.encode_words(new))
        for part, found in cut.items():
            ids = [i for w in found for i in (words[w] if isinstance(w, str) else (w,))]
            self.parts.younger[part] = len(ids), " ".join(map(str, ids)), self.decode(ids)

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: number of tokens, and SHA-256 of the ids as text and of the decoded text.

        White space ends a word in these files and leaves nothing, so the parts between blanks are
        encoded one by one and kept, as most of them recur.
        """
        self._prepare(texts)
        for text in texts:
            found = [p for p in map(self.parts.younger.__getitem__, text.split(" ")) if p[0]]
            ids, decoded = (" ".join([p[k] for p in found]).encode() for k in (1, 2))
            yield sum([p[0] for p in found]), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def encoder(path: str) -> Bpe:
    """The worker's encoder for a file whose normalizer and pre-tokenizer drop white space, and that has no decoder."""
    return once(("bpe", path), lambda: Bpe(path))


def encode_udf(path: str) -> Column:
    """A function from text to its ids."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoder(path)
        for texts in batches:
            yield pd.Series([bpe.ids(t or "") for t in texts], dtype=object)

    return encode


def decode_udf(path: str) -> Column:
    """A function from ids to the decoded text."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoder(path)
        for lists in batches:
            yield pd.Series([bpe.decode([] if ids is None else ids) for ids in lists], dtype=object)

    return decode


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    Null texts count as empty (no tokens); repeated rows get the same each; an empty table stays empty;
    columns named like the results give way.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digested(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = encoder(path)
        for texts in batches:
            n, ids, decoded = zip(*bpe.digests([t or "" for t in texts]))
            yield pd.DataFrame(
                {
                    "n_tokens": n,
                    "ids_sha256": pd.Series(ids, dtype=object),
                    "decoded_sha256": pd.Series(decoded, dtype=object),
                }
            )

    made = with_columns(docs, _digest=digested(F.col(text)))
    names = ("n_tokens", "ids_sha256", "decoded_sha256")
    return with_columns(made, **{n: F.col("_digest")[n] for n in names}).drop("_digest")
