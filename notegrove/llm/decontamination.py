"""Benchmark decontamination: q-gram counts in overlapping diagonal bands, then banded alignment.

By the q-gram lemma a region of a text within k edits of an item of m characters shares m + 1 - q(k + 1) q-grams with it,
all on k + 1 neighbouring diagonals (place in the text less place in the item). Bands of diagonals overlap by half, so one
band holds them all. An item's q-grams that most other items have too may be left out if the bound is lowered as much.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import small_batches, written

Q = 10
#: Edits allowed for each character of an item.
RATE = 0.06
#: Characters of items that one pass over the texts looks for, which bounds what each task holds (some 150 MB); more items take
#: more passes.
PASS_CHARS = 2_000_000
#: Characters hashed at a time.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_GAP = 0x110000  # no character


def lowered(text: str) -> str:
    """Lower case and plain spaces, place for place."""
    low = text.lower()
    low = low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " ", 160: " "})


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q = 8 + 2 characters from each place on, by doubling."""
    powers = [np.uint64(pow(_BASE, 2**k, 2**64)) for k in range(3)]
    one = codes.astype(np.uint64) + np.uint64(1)
    two = one[:-1] * powers[0] + one[1:]
    four = two[:-2] * powers[1] + two[2:]
    eight = four[:-4] * powers[2] + four[4:]
    return eight[:-2] * powers[1] + two[8:]


@dataclass
class Item:
    item_id: int
    text: str
    budget: int
    bound: int
    width: int


class Index:
    """Items and the places of their q-grams; items too short to have one are looked up as they are."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.short = None
        if short := [row for row in rows if len(row[1]) < Q]:
            self.short = ahocorasick.Automaton()
            for item_id, text in short:
                self.short.add_word(text, (text, [*self.short.get(text, (text, []))[1], item_id]))
            self.short.make_automaton()
        rows = [row for row in rows if len(row[1]) >= Q]
        grams = [_grams(_codes(t)) for _, t in rows]
        unique, seen = np.unique(np.concatenate([np.unique(g) for g in grams]) if grams else np.zeros(0, np.uint64), return_counts=True)
        self.items, kept = [], []
        for (item_id, text), own in zip(rows, grams, strict=True):
            m = len(text)
            budget = min(int(RATE * m), (m + 1) // Q - 1)
            bound = m + 1 - Q * (budget + 1)
            spread = seen[np.searchsorted(unique, own)]
            drop = min(bound // 2, int((spread > 2).sum()))
            places = np.sort(np.argsort(spread, kind="stable")[: len(own) - drop])
            self.items.append(Item(item_id, text, budget, bound - drop, max(16, budget)))
            kept.append((own[places], places))
        hashes = np.concatenate([g for g, _ in kept]) if kept else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.first, self.count = np.unique(hashes[order], return_index=True, return_counts=True)
        self.item = np.repeat(np.arange(len(kept)), [len(p) for _, p in kept])[order]
        self.place = (np.concatenate([p for _, p in kept]) if kept else np.zeros(0, int))[order]
        self.widths = np.array([i.width for i in self.items])
        self.bounds = np.array([i.bound for i in self.items])
        self.shift = np.uint64(64 - max(16, int(max(1, 64 * len(self.hashes))).bit_length()))
        self.marks = np.zeros(1 << int(64 - self.shift), bool)
        self.marks[self._slot(self.hashes)] = True

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)

    def _hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose q-gram some item has, and which of the distinct q-grams."""
        places, which = [], []
        for start in range(0, len(codes) - Q + 1, BLOCK):
            grams = _grams(codes[start : start + BLOCK + Q - 1])
            at = np.flatnonzero(self.marks[self._slot(grams)])
            found = np.searchsorted(self.hashes, grams[at])
            true = self.hashes[np.minimum(found, len(self.hashes) - 1)] == grams[at]
            places.append(at[true] + start)
            which.append(found[true])
        return (np.concatenate(places), np.concatenate(which)) if places else (np.zeros(0, int), np.zeros(0, int))

    def regions(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, item, diagonal at which a band starts) of each band that holds enough q-grams."""
        if not len(self.hashes) or not texts:
            return []
        gap = np.full(Q, _GAP, np.uint32)
        codes = np.concatenate([x for t in texts for x in (_codes(t), gap)])
        starts = np.cumsum([0] + [len(t) + Q for t in texts])
        places, which = self._hits(codes)
        out = []
        # q-grams of one text stay in one part; a part has some hits at most, or one text's
        text = np.searchsorted(starts, places, side="right") - 1
        load = np.cumsum(self.count[which]) if len(which) else np.zeros(0, int)
        cut = 0
        while cut < len(places):
            end = int(np.searchsorted(load, (load[cut - 1] if cut else 0) + 2_000_000, side="right"))
            end = max(end, cut + 1)
            if end < len(places):
                inside = int(np.searchsorted(text, text[end], side="left"))
                end = inside if inside > cut else int(np.searchsorted(text, text[cut], side="right"))
            out += self._bands(text[cut:end], places[cut:end] - starts[text[cut:end]], which[cut:end], len(texts))
            cut = end
        return out

    def _bands(self, text: np.ndarray, place: np.ndarray, which: np.ndarray, n: int) -> list[tuple[int, int, int]]:
        counts = self.count[which]
        each = np.repeat(np.arange(len(which)), counts)
        entry = np.repeat(self.first[which] - np.cumsum(counts) + counts, counts) + np.arange(len(each))
        item = self.item[entry]
        diagonal = place[each] - self.place[entry]
        band = np.floor_divide(diagonal, self.widths[item])
        low = int(band.min()) - 1
        span = int(band.max()) - low + 2
        key = (text[each].astype(np.int64) * len(self.items) + item) * span + (band - low)
        keys, hits = np.unique(key, return_counts=True)
        # band b of two widths: the hits of its own width and of the next
        both = np.unique(np.concatenate([keys, keys - 1]))
        total = np.zeros(len(both), np.int64)
        for k in (0, 1):
            total[np.searchsorted(both, keys - k)] += hits
        which_item = (both // span) % len(self.items)
        full = total >= self.bounds[which_item]
        return [(int(k // span // len(self.items)), int(i), int((k % span + low) * self.widths[i])) for k, i in zip(both[full], which_item[full], strict=True)]

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item_id, start, end, edits): for each text and item the places with fewest edits, apart from each other."""
        low = [lowered(t) for t in texts]
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for t, i, diagonal in self.regions(low):
            item = self.items[i]
            m = len(item.text)
            start, end = max(0, diagonal - item.budget), min(len(low[t]), diagonal + 2 * item.width + m + item.budget)
            region = low[t][start:end]
            at = region.find(item.text)
            got = (at, at + m, 0) if at >= 0 else align(item.text, region, item.budget)
            if got:
                found.setdefault((t, i), []).append((got[2], start + got[0], start + got[1]))
        out = []
        for t, whole in enumerate(low if self.short else ()):
            free: dict[str, int] = {}
            for last, (short, ids) in self.short.iter(whole):
                end = last + 1
                start = end - len(short)
                alone = not (whole[start - 1 : start].isalnum() or whole[end : end + 1].isalnum())
                if alone and start >= free.get(short, 0):
                    free[short] = end
                    out += [(t, item_id, start, end, 0) for item_id in ids]
        for (t, i), places in found.items():
            taken: list[tuple[int, int]] = []
            for edits, start, end in sorted(set(places)):
                if all(end <= a or start >= b for a, b in taken):
                    taken.append((start, end))
                    out.append((t, self.items[i].item_id, start, end, edits))
        return out


def _last_row(item: np.ndarray, region: np.ndarray, band: int) -> np.ndarray:
    """Fewest edits between the whole item and a stretch of the region that ends at each place; the stretch starts anywhere.
    Cells off the band of diagonals 0 to len(region) - len(item), widened by `band`, aren't filled."""
    n, m = len(region), len(item)
    wide, far = n - m + 2 * band + 1, n + m + 1
    place = np.arange(wide)
    padded = np.full(wide + m, _GAP, np.uint32)  # padded[j + band] is the region's character j
    inside = region[: max(0, wide + m - band)]
    padded[band : band + len(inside)] = inside
    row = np.where((place >= band) & (place - band <= n), 0, far)  # cell d: item place i, region place i + d - band
    for i in range(m):
        change = row + (padded[i : i + wide] != item[i])
        left_out = np.append(row[1:], far) + 1
        row = np.minimum(change, left_out)
        row = np.minimum.accumulate(row - place) + place
        at = i + 1 + place - band
        row = np.where((at >= 0) & (at <= n), row, far)
    ends = np.full(n + 1, far)
    at = m + place - band
    good = (at >= 0) & (at <= n)
    ends[at[good]] = row[good]
    return ends


def align(item: str, region: str, budget: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the stretch of region with fewest edits, the first end and then the shortest, or None."""
    if len(region) < len(item) - budget:
        return None
    a, b = _codes(item), _codes(region)
    band = budget + max(0, len(item) - len(region))
    ends = _last_row(a, b, band)
    end = int(ends.argmin())
    edits = int(ends[end])
    if edits > budget:
        return None
    back = _last_row(a[::-1], b[:end][::-1], budget + max(0, len(item) - end))
    near = np.flatnonzero(back == edits)
    return end - int(near[0]), end, edits


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of the items, PASS_CHARS characters at most in each but for a single longer item. Items are read in blocks
    by id; a null item or one without a character but white space can't be found."""
    texts = benchmark.selectExpr("cast(item_id as bigint) as item_id", "cast(text as string) as text").filter("length(text) > 0").distinct()
    rows, size = [], 0
    for r in texts.orderBy("item_id", "text").toLocalIterator():
        low = lowered(r["text"]).strip()
        if not low:
            continue
        if rows and size + len(low) > PASS_CHARS:
            yield Index(rows)
            rows, size = [], 0
        rows.append((r["item_id"], low))
        size += len(low)
    if rows:
        yield Index(rows)


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, item_id, start_char, end_char (exclusive) and edits of each region of a whole text within RATE edits a character
    of a whole item, after lower-casing and with all white space alike; items of under Q characters as they are, between
    characters other than letters and digits. Null and empty texts have none; texts of any length are searched whole. Other
    columns are ignored; repeated rows of docs give repeated rows, repeated items count once. With more than one pass each
    pass is written before the next index is made."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "item_id", "start_char", "end_char", "edits"]
    schema = ", ".join(f"{n} long" for n in names)
    source = docs.selectExpr("cast(doc_id as bigint) as doc_id", f"cast(`{text}` as string) as text")

    def runner(index):
        def run(batches):
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[t], *rest) for t, *rest in index.matches([t or "" for t in batch.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=names)

        return run

    parts = []
    for index in indexes(benchmark):
        if parts:
            parts[-1] = written(parts[-1], "leaks")
        parts.append(source.mapInArrow(runner(index), schema))
    out = parts[0] if parts else source.sparkSession.createDataFrame([], schema)
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs without the rows whose text holds an item; every column and every other row stays as it is, nothing is
    shuffled."""
    small_batches(docs.sparkSession)
    column = docs.columns.index(text)

    def runner(index):
        def run(batches):
            for batch in batches:
                hit = {t for t, *_ in index.matches([t or "" for t in batch.column(column).to_pylist()])}
                yield batch.filter(pa.array([t not in hit for t in range(batch.num_rows)], pa.bool_()))

        return run

    for k, index in enumerate(indexes(benchmark)):
        docs = (written(docs, "leaks-left") if k else docs).mapInArrow(runner(index), docs.schema)
    return docs
