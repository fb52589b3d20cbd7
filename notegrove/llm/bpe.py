"""BPE encoding and decoding by dynamic programming over prefixes.

For a merge list in which each merge uses only pieces made by earlier merges, the pieces of every prefix of a
word end in one token that does not depend on what follows it in the dynamic programme: the longest match whose
pair with the last token of the rest can stand side by side. So one token for each prefix is stored, and the ids
are read off the back-pointers. Matches come from the suffix links of an automaton over the vocabulary.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import BEYOND_LATIN, LETTER, NUMBER, SPACE, small_batches

#: Words over this length are encoded but not remembered; the memory of a worker is bounded by these two.
CACHED_LENGTH, CACHED_WORDS = 48, 400_000
END = "</w>"
NEVER = float("inf")


class _Known(dict):
    """Entries seen before; bounded."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        entry = self.make(key)
        if len(key) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[key] = entry
        return entry


class WordBpe:
    """A tokenizer file with word ends: normalisation, pre-tokens, ids of a text, text of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.text_of = {i: t for t, i in vocab.items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.text_of |= {i: t for t, i in self.special.items()}
        self._split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        #: Printable stand-ins of bytes: those of Latin-1 that print stand for themselves, the rest follow from 256 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.sign = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self._pattern = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
        self._path, self._library = path, None
        self._build(vocab, [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self._words = _Known(self._word)
        self._chunks = _Known(self._chunk)

    def _build(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        """Symbols are code points 0-255 for bytes within a word and 256-511 for its last byte."""
        symbols, self.rank, parts = {}, {}, {}
        for b, s in self.sign.items():
            symbols[vocab[s]], symbols[vocab[s + END]] = chr(b), chr(256 + b)
        for r, (a, b) in enumerate(merges):
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            self.rank[x, y] = r
            parts[made] = (x, y, r)
            symbols[made] = symbols[x] + symbols[y]
        #: The tokens at a token's right and left edge as it grows, each with the merge that ends it.
        self.right, self.left = ({i: self._edge(i, side, parts) for i in symbols} for side in (1, 0))
        self.length = {i: len(s) for i, s in symbols.items()}
        self._pairs: dict[tuple[int, int], bool] = {}
        own = {i: True for i in symbols if i not in parts}  # tokens that encode to themselves
        for i, (x, y, r) in parts.items():
            own[i] = own[x] and own[y] and self._stand(x, y, r)
        self.machine = ahocorasick.Automaton()
        for i, s in symbols.items():
            if own[i]:
                self.machine.add_word(s, i)
        self.machine.make_automaton()

    @staticmethod
    def _edge(token: int, side: int, parts: dict[int, tuple[int, int, int]]) -> list[tuple[int, float]]:
        edge, end = [], NEVER
        while True:
            edge.append((token, end))
            if token not in parts:
                return edge
            end, token = parts[token][2], parts[token][side]

    def _stand(self, a: int, b: int, before: float = NEVER) -> bool:
        """Whether no merge across the border of a and b comes first, up to the merge `before`. Of equal merges
        the leftmost comes first: at the end of a piece of a it is a's own, at that of a piece of b it isn't."""
        rank = self.rank
        for x, dies in self.right[a]:
            for y, ends in self.left[b]:
                r = rank.get((x, y))
                if r is not None and r < before and r < dies and r <= ends:
                    return False
        return True

    def compatible(self, a: int, b: int) -> bool:
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            known = self._pairs[a, b] = self._stand(a, b)
        return known

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        text = "".join(map(chr, word[:-1])) + chr(256 + word[-1])
        last: list[int] = [-1] * (len(text) + 1)
        length, compatible, done = self.length, self.compatible, -1
        for end, token in self.machine.iter(text):
            if end == done:
                continue
            before = last[end + 1 - length[token]]
            if before < 0 and end + 1 != length[token]:
                continue
            if before < 0 or compatible(before, token):
                last[end + 1], done = token, end
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= length[last[at]]
        return ids[::-1]

    def pretokens(self, text: str) -> list[str]:
        """Lower-case words, digits and runs of signs of a text that has no special token."""
        if BEYOND_LATIN.search(text) is None:
            return self._pattern.findall(text.lower())
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        known = self._library
        back = {s: b for b, s in self.sign.items()}
        words = known.pre_tokenizer.pre_tokenize_str(known.normalizer.normalize_str(text))
        return [bytes(back[c] for c in w).decode("utf-8", "surrogateescape") for w, _ in words]

    def _word(self, word: str) -> tuple[str, str, int]:
        ids = self.encode_word(word.encode("utf-8", "surrogateescape"))
        return " ".join(map(str, ids)), self.decode(ids), len(ids)

    def _chunk(self, chunk: bytes) -> tuple[str, str, int]:
        found = [self._words[w] for w in self.pretokens(chunk.decode("utf-8", "surrogatepass"))]
        if len(found) == 1:
            return found[0]
        return " ".join([e[0] for e in found]), " ".join([e[1] for e in found]), sum([e[2] for e in found])

    def _plain(self, text: str) -> list[tuple[str, str, int]]:
        """No pre-token crosses ASCII white space, and white space itself has none, so a text is its chunks.
        Beyond Latin the normalisation could join characters, so such a text is one chunk."""
        if BEYOND_LATIN.search(text) is not None:
            return [self._chunk(text.encode("utf-8", "surrogatepass"))]
        return [*map(self._chunks.__getitem__, text.lower().encode().split())]

    def entries(self, text: str) -> list[tuple[str, str, int]]:
        """For each piece of a text its ids joined by spaces, their decoded text and their number."""
        pieces = self._split.split(text) if self._split and "<|" in text else [text]
        found = []
        for piece in pieces:
            found += [(str(self.special[piece]), piece, 1)] if piece in self.special else self._plain(piece)
        # only white space beyond ASCII, or a text of nothing else, makes a chunk without a pre-token
        return found if text.isascii() else [e for e in found if e[2]]

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _, _ in self.entries(text) for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by spaces."""
        return " ".join([self.text_of[i] for i in ids])


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """One tokenizer for each Python worker."""
    return WordBpe(path)


def encode(docs: DataFrame, tokenizer: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, and with with_ids the ids and the
    decoded text. tokenizer: the file's place, the same on every executor. A null text counts as empty: no
    tokens, the hashes of the empty string. Other columns of docs are ignored; repeated rows give repeated rows."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches):
        bpe = load(tokenizer)
        sha = hashlib.sha256
        for batch in batches:
            out: list[list] = [[] for _ in range(5 if with_ids else 3)]
            for t in batch.column(1).to_pylist():
                parts, texts, counts = zip(*found, strict=True) if t and (found := bpe.entries(t)) else ((), (), ())
                ids, back = " ".join(parts), " ".join(texts)
                row = [sum(counts), sha(ids.encode()).hexdigest(), sha(back.encode()).hexdigest()]
                row += [[*map(int, ids.split())], back] if with_ids else []
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(out) + 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=False))], names=names)

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", f"cast(`{text}` as string) as text").mapInArrow(run, schema)
