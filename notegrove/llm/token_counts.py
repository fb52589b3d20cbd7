"""Token counts that follow edits: a segment tree over the pre-tokens of a text.

The leaves of a tree are short runs of pre-tokens with their characters and tokens; inner nodes hold the sums of both. An
edit is found by descending on characters; only the pre-tokens it touches, with the context that could change their
borders, are encoded anew, and the sums above their leaves are updated.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from ._common import BEYOND_LATIN, LETTER, NUMBER, SPACE, small_batches

#: Pre-tokens in a leaf when a tree is built; a leaf that edits have made longer than LONGEST makes the tree new.
LEAF, LONGEST = 32, 512
CACHED_LENGTH, CACHED_WORDS = 48, 400_000
#: A pre-token's end can depend on this many characters after it, through the lookaheads of the pattern.
LOOKAHEAD = 2

Edit = tuple[int, int, str]


class Counter:
    """Pre-tokens and token counts of a rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._plain = re.compile(
            f"'(?:s|t|re|ve|m|ll|d)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
        )
        self._wide = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self._known: dict[str, int] = {}

    def pattern(self, wide: bool) -> re.Pattern:
        """The faster one knows the characters below LATIN_END only; below it both find the same."""
        return self._wide if wide else self._plain

    def tokens(self, word: str) -> int:
        n = self._known.get(word)
        if n is None:
            n = len(self._encoding.encode_ordinary(word))
            if len(word) <= CACHED_LENGTH:
                if len(self._known) >= CACHED_WORDS:
                    self._known.clear()
                self._known[word] = n
        return n


@lru_cache(maxsize=2)
def load(path: str) -> Counter:
    return Counter(path)


class TokenTree:
    """The tree of one text. n_tokens and n_chars are its root; encoded counts the pre-tokens encoded since it was built."""

    def __init__(self, text: str, counter: Counter):
        self.counter, self.encoded, self.wide = counter, 0, BEYOND_LATIN.search(text) is not None
        self._build(text)

    def _build(self, text: str) -> None:
        words = self.counter.pattern(self.wide).findall(text)
        self._set([*map(len, words)], [*map(self.counter.tokens, words)])

    def _set(self, chars: list[int], tokens: list[int]) -> None:
        self.leaves = [(chars[i : i + LEAF], tokens[i : i + LEAF]) for i in range(0, len(chars), LEAF)] or [([], [])]
        n = len(self.leaves)
        self.size = 1 << (n - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        if chars:
            at = np.arange(0, len(chars), LEAF)
            self.sums[self.size : self.size + n, 0] = np.add.reduceat(np.array(chars, np.int64), at)
            self.sums[self.size : self.size + n, 1] = np.add.reduceat(np.array(tokens, np.int64), at)
        level = self.size
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level].reshape(-1, 2, 2).sum(axis=1)
            level //= 2

    @property
    def n_chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def n_pretokens(self) -> int:
        return sum(len(chars) for chars, _ in self.leaves)

    def _leaf(self, char: int) -> tuple[int, int]:
        """The leaf of a character, and where it starts; the last one with characters for the end of the text."""
        node, start = 1, 0
        char = min(char, self.n_chars - 1)
        while node < self.size:
            node *= 2
            left = int(self.sums[node, 0])
            if char - start >= left:
                start, node = start + left, node + 1
        return node - self.size, start

    def _store(self, leaf: int, chars: list[int], tokens: list[int]) -> None:
        self.leaves[leaf] = (chars, tokens)
        node = self.size + leaf
        self.sums[node] = sum(chars), sum(tokens)
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def replace(self, before: str, edit: Edit) -> str:
        """Replace before[start:end], before being the tree's text, and return the new text."""
        start, end, new = edit
        after = before[:start] + new + before[end:]
        self.wide = self.wide or BEYOND_LATIN.search(new) is not None
        if not before:
            self._build(after)
            self.encoded += self.n_pretokens
            return after
        shift = len(after) - len(before)
        first, at = self._leaf(max(0, start - LOOKAHEAD))
        # the first pre-token that can see the edit
        ends = [*accumulate(self.leaves[first][0], initial=at)]
        skip = max(0, bisect_right(ends, start - LOOKAHEAD) - 1)
        skip = min(skip, len(self.leaves[first][0]))
        border = ends[skip]
        # old borders from there on, leaf by leaf, until a new border past the edit falls on one
        chars, tokens = self.leaves[first][0][:skip], self.leaves[first][1][:skip]
        last, old, i = first, border, skip
        position = border
        for m in self.counter.pattern(self.wide).finditer(after, border):
            chars.append(m.end() - m.start())
            tokens.append(self.counter.tokens(m[0]))
            self.encoded += 1
            position = m.end()
            if position < start + len(new):
                continue
            while old + shift < position or old < end:
                while i >= len(self.leaves[last][0]):
                    last, i = last + 1, 0
                old, i = old + self.leaves[last][0][i], i + 1
            if old + shift == position:
                break
        else:
            last, i = len(self.leaves) - 1, len(self.leaves[-1][0])
        chars, tokens = chars + self.leaves[last][0][i:], tokens + self.leaves[last][1][i:]
        for leaf in range(first + 1, last + 1):
            self._store(leaf, [], [])
        self._store(first, chars, tokens)
        if len(chars) > LONGEST:
            self._set([n for c, _ in self.leaves for n in c], [n for _, t in self.leaves for n in t])
        return after


_NUMBER = re.compile(r"[0-9][0-9 ().-]{5,}[0-9]")


def cleaning_edits(text: str) -> list[Edit]:
    """Edits of a usual cleaning step: a long number becomes a placeholder, a line equal to an earlier one goes. By
    position, the last first, so that each leaves the places of the rest as they are."""
    edits = [(m.start(), m.end(), "[number]") for m in _NUMBER.finditer(text)]
    seen, at = set(), 0
    lines = text.split("\n")
    if len(set(lines)) < len(lines):
        for line in lines:
            if line in seen:
                start, end = max(0, at - 1), at + len(line)
                edits = [e for e in edits if e[1] <= start or e[0] >= end] + [(start, end, "")]
            seen.add(line)
            at += len(line) + 1
    return sorted(edits, reverse=True)


def count(docs: DataFrame, ranks: str, text: str = "text", edits=cleaning_edits) -> DataFrame:
    """doc_id, n_tokens of every whole text, n_pretokens, and what edits(text), a list of (start, end, new) from the last to
    the first, makes of it: n_edits, n_tokens_edited, n_reencoded (pre-tokens encoded for the edits). A null or empty text
    has no tokens. Other columns of docs are ignored; repeated rows give repeated rows. ranks: a rank file's place."""
    small_batches(docs.sparkSession)
    names = ["n_tokens", "n_pretokens", "n_edits", "n_tokens_edited", "n_reencoded"]

    def run(batches):
        counter = load(ranks)
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                t = t or ""
                tree = TokenTree(t, counter)
                row = [tree.n_tokens, tree.n_pretokens]
                found = edits(t)
                for edit in found:
                    t = tree.replace(t, edit)
                rows.append((*row, len(found), tree.n_tokens, tree.encoded))
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    schema = ", ".join(f"{n} long" for n in ["doc_id", *names])
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", f"cast(`{text}` as string) as text").mapInArrow(run, schema)
