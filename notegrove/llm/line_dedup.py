"""Line dedup by an exact set-similarity join.

A line is the set of its words. Lines with equal sets are one class. Words are ordered by rarity; two sets at or above the
similarity share a word among the rarest few of each (prefix filter), at places that leave room for enough others
(positional filter), and their sizes are close (length filter). Where the first word that two sets share is frequent, they
share further words soon after it, and meet in the list of those words together: lists stay short. Parity bitmaps of the
sets bound their difference from below, so hardly a wrong pair is left to be verified on the words. Every occurrence of a
class but its first goes, and the first too where an earlier class is similar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import released, small_batches, written
from ._packed import DEALT, Marks, dealt, dealt_ragged, gathered, mixed, partitions, payloads, ragged, runs, summed, unragged
from ._words import Words, blocks, words_of

#: Lines are similar if 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Smaller sets are similar to equal ones only: one word more or less is too much.
LEAST_WORDS = PERCENT // (100 - PERCENT)
#: Entries of the table of word counts, by the leading bits of a word's hash.
COUNTER_BITS = 22
#: Members a list may be expected to have. Where a word's list would be longer, sets are listed under more words.
LONG = 4096
#: Lines from which on lists may be longer, by the square root of the lines: were they not, more and more words would be too
#: frequent for a list, and the lists that a set is in would multiply.
MANY_LINES = 1 << 21
#: Words that one list can ask for; similar sets that aren't equal share LEAST_WORDS at least.
MOST_KEYS = LEAST_WORDS
#: Records that a task gathers before it sends them: a few megabytes, which the JVM holds outside its heap.
GATHERED = 50_000

_CLASS = ["<u8", "<u8", "<i8", "<i4", "<i4", "<u8", "<u8"]  # two halves of the set's hash, doc, line, n, two halves of the parity
_MEMBER = ["<i4", "<i4", "<i4", "<i8", "<u8", "<u8"]  # n, place, line, doc, two halves of the parity
_POST = ["<u4", *_MEMBER]  # with the list's key


def prefix_sizes(n: np.ndarray) -> np.ndarray:
    """Of sets of n words, so many of the rarest that similar sets share one of them."""
    return n - -(-PERCENT * n // 100) + 1


class Rarity:
    """A rank for each word by how often it occurs in lines: exact counts of all words with the same leading bits of the hash,
    on a scale of eighths of a power of two. 4 MB, whatever the corpus."""

    def __init__(self, counts: np.ndarray, n_lines: int):
        self.ranks = np.minimum(255, np.ceil(8 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)
        self.at_most = 2 ** (np.arange(256) / 8)  # occurrences of a word of each rank
        self.n_lines = max(1, n_lines)

    @classmethod
    def of(cls, docs: DataFrame) -> Rarity:
        size = 1 << COUNTER_BITS

        def entries(batches):
            for batch in batches:
                hashes, lines = [], 0
                for block in blocks(batch, 1):
                    words = words_of(block.column(1))
                    hashes.append((words.hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.int64))
                    lines += np.count_nonzero(np.diff(words.line, prepend=-1))
                at = np.append(np.concatenate(hashes), size) if hashes else np.array([size])
                yield at, np.append(np.ones(len(at) - 1, np.int64), lines)

        counts = summed(docs, entries, size + 1)
        return cls(counts[:size], int(counts[size]))

    def longest(self, long: int) -> int:
        """Members a list may be expected to have, where it is `long` in a small corpus."""
        return int(long * max(1, self.n_lines / MANY_LINES) ** 0.5)

    def rank(self, keys: np.ndarray) -> np.ndarray:
        """keys: the leading 32 bits of the words' hashes."""
        return self.ranks[keys >> np.uint32(32 - COUNTER_BITS)]


def sets_of(words: Words, rarity: Rarity) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line with a word: a word's number, where its set starts in the hashes, and how many it has; hashes, the rarest
    word of a set first."""
    h = words.hashes
    bits = int(words.line[-1]).bit_length() if len(h) else 0
    rank = rarity.rank((h >> np.uint64(32)).astype(np.uint32)).astype(np.uint64)
    key = (words.line.astype(np.uint64) << np.uint64(64 - bits) if bits else np.uint64(0)) | rank << np.uint64(56 - bits) | h >> np.uint64(8 + bits)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    if (h[order[1:]] != h[order[:-1]])[same].any():  # bits that the key has no room for decide
        order = np.lexsort((h, rank, words.line))
        same = (h[order[1:]] == h[order[:-1]]) & (words.line[order[1:]] == words.line[order[:-1]])
    order = order[np.append(True, ~same)[: len(order)]]
    line = words.line[order]
    start = np.flatnonzero(np.diff(line, prepend=-1))
    return order[start], start, np.diff(np.append(start, len(line))), h[order]


def _kept_words(n: np.ndarray) -> np.ndarray:
    """So many words of a set go with its class: those that its lists may be named after."""
    return np.where(n < LEAST_WORDS, 0, np.minimum(n, prefix_sizes(n) + MOST_KEYS - 1))


def _first_ones(id0: np.ndarray, id1: np.ndarray, doc: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold the first place of their set; rows with later places of a set, each place once."""
    order = np.lexsort((line, doc, id1, id0))
    new_set = np.append(True, (id0[order[1:]] != id0[order[:-1]]) | (id1[order[1:]] != id1[order[:-1]]))[: len(order)]
    new_place = np.append(True, (doc[order[1:]] != doc[order[:-1]]) | (line[order[1:]] != line[order[:-1]]))[: len(order)]
    first = order[new_set]
    return first, order[~new_set & new_place]


def _hashes_of(h: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Two halves of a hash of each set, and of the parities of how many of its words have each of 128 hashes."""
    halves = [np.add.reduceat((h ^ h >> np.uint64(29)) * m ^ h >> np.uint64(k), start) for m, k in ((np.uint64(0x9E3779B97F4A7C15), 31), (np.uint64(0xC2B2AE3D27D4EB4F), 27))]
    bit, high = np.uint64(1) << (h & np.uint64(63)), (h & np.uint64(64)).astype(bool)
    return halves + [np.bitwise_xor.reduceat(np.where(side, bit, np.uint64(0)), start) for side in (~high, high)]


def classes_of(docs: DataFrame, rarity: Rarity) -> DataFrame:
    """Rows of two kinds. payload: classes with their first places and rarest words. doc, line: places of later occurrences."""
    n_parts = partitions(docs.sparkSession)

    def sent(held) -> Iterator[pa.RecordBatch]:
        columns, words = [np.concatenate([h[k] for h in held]) for k in range(7)], np.concatenate([h[7] for h in held])
        sizes = _kept_words(columns[4])
        first, later = _first_ones(*columns[:4])
        part = (columns[0][first] % np.uint64(n_parts)).astype(np.int64)
        yield dealt_ragged(part, [c[first] for c in columns], _CLASS, words, (np.cumsum(sizes) - sizes)[first], sizes[first])
        places = [columns[2][later], columns[3][later]]
        yield dealt((mixed(*places) % np.uint64(n_parts)).astype(np.int64) + n_parts, places)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for block in blocks(batch, 1):
                found = words_of(block.column(1))
                word, start, n, h = sets_of(found, rarity)
                if not len(start):
                    continue
                id0, id1, low, high = _hashes_of(h, start)
                doc = block.column(0).to_numpy()[found.text[word]]
                keys = (h[runs(start, _kept_words(n))] >> np.uint64(32)).astype("<u4")
                held.append([id0, id1, doc, found.number[word].astype(np.int32), n.astype(np.int32), low, high, keys])
                size += len(start) + len(keys) // 8
                if size >= GATHERED:
                    yield from sent(held)
                    held, size = [], 0
        if held:
            yield from sent(held)

    def merge(batches):
        blobs = []
        for batch in batches:
            for part, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part < n_parts:
                    blobs.append(payload)
                    continue
                doc, line = gathered([payload], ["<i8", "<i4"])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(doc), pa.binary()), pa.array(doc), pa.array(line)], names=["payload", "doc", "line"])
        columns, words = unragged(blobs, _CLASS, "<u4")
        first, later = _first_ones(*columns[:4])
        places = [columns[2][later], columns[3][later]]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(later), pa.binary()), pa.array(places[0]), pa.array(places[1])], names=["payload", "doc", "line"])
        sizes = _kept_words(columns[4])
        starts = np.cumsum(sizes) - sizes
        for k in range(0, len(first), GATHERED):
            rows = first[k : k + GATHERED]
            blob = ragged([c[rows] for c in columns], _CLASS, words[runs(starts[rows], sizes[rows])])
            yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32())], names=["payload", "doc", "line"])

    return docs.mapInArrow(run, DEALT).repartitionById(n_parts, "part").mapInArrow(merge, "payload binary, doc long, line int")


def listed(n: np.ndarray, starts: np.ndarray, words: np.ndarray, rarity: Rarity, long: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set, key and place of the first word of each list that a set is in. Two similar sets meet in the list that the first
    words which they share name: one word, or, where that list would be long, two to MOST_KEYS of them. Which depends on the
    words alone, so both sets name the same."""
    prefix = prefix_sizes(n)
    own = np.repeat(np.arange(len(n)), prefix)
    place = runs(np.zeros(len(n), np.int64), prefix)
    first, key, expected, out = place, np.zeros(len(own), np.uint32), np.full(len(own), float(rarity.n_lines)), []
    for asked in range(1, MOST_KEYS + 1):
        word = words[starts[own] + place]
        key = (mixed(key, word) >> np.uint64(32)).astype(np.uint32) if asked > 1 else word
        expected = expected * rarity.at_most[rarity.rank(word)] / rarity.n_lines
        done = (expected <= long) | (asked == MOST_KEYS)
        out.append((own[done], key[done], first[done]))
        own, key, place, first, expected = own[~done], key[~done], place[~done], first[~done], expected[~done]
        if not len(own):
            break
        more = prefix[own] + asked - place - 1  # places after this one where the next shared word can be
        at = np.repeat(np.arange(len(own)), more)
        place = runs(place + 1, more)
        own, key, first, expected = own[at], key[at], first[at], expected[at]
    own, key, first = (np.concatenate(x) for x in zip(*out, strict=True))
    return own, key, first


def _posts(batches, rarity: Rarity, long: int, late: Marks | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Key and member columns of the classes in each of their lists; with late, of those that it admits."""
    for payload in payloads(batches):
        columns, words = unragged([payload], _CLASS, "<u4")
        doc, line, n, *parity = columns[2:]
        n = n.astype(np.int64)
        sizes = _kept_words(n)
        starts, rows = np.cumsum(sizes) - sizes, np.flatnonzero((n >= LEAST_WORDS) & (True if late is None else late.admits(mixed(doc, line))))
        for k in range(0, len(rows), GATHERED // 8):
            part = rows[k : k + GATHERED // 8]
            own, key, place = listed(n[part], starts[part], words, rarity, long)
            own = part[own]
            yield key, n[own], place, line[own], doc[own], *(p[own] for p in parity)


class Lists:
    """What a list is named after, and how its members are dealt and compared."""

    def __init__(self, classes: DataFrame, rarity: Rarity, long: int):
        self.packed = classes.filter("payload is not null").select(F.lit(0).alias("part"), "payload")
        self.rarity, self.long, self.n_parts = rarity, rarity.longest(long), partitions(classes.sparkSession)

    def likeliest(self) -> DataFrame:
        """For each class that has a partner before it by all filters, the likeliest: doc, line, late_doc, late_line, and more
        (whether there are others)."""
        rarity, n_parts, long = self.rarity, self.n_parts, self.long

        def sent(batches):
            for key, *member in _posts(batches, rarity, long):
                yield dealt((mixed(key) % np.uint64(n_parts)).astype(np.int64), [c.astype(k, copy=False) for c, k in zip((key, *member), _POST, strict=True)])

        def compare(batches):
            key, *member = gathered(payloads(batches), _POST)
            yield from _compared(key, Members(member), None, long)

        met = self._met(self.packed.mapInArrow(sent, DEALT).repartitionById(n_parts, "part").mapInArrow(compare, _PAIRS), None)
        place = F.struct("doc", "line")
        best = met.groupBy("late_doc", "late_line").agg(F.min(F.struct("apart", "doc", "line")).alias("e"), F.min(place).alias("least"), F.max(place).alias("most"), F.max("others").alias("others"))
        out = written(best.select("e.doc", "e.line", "late_doc", "late_line", (F.col("others") | (F.col("least") != F.col("most"))).alias("more")), "line-pairs")
        released(met)
        return out

    def verified(self, late: Marks, docs: DataFrame) -> DataFrame:
        """late_doc and late_line of the classes admitted by late that have a similar one before them, whichever it is. The lists
        with such classes are compared once more, and name the members that pass all filters with one of them: members, not
        pairs, of which there may be far more. Those lists of those members are then compared on whole sets."""
        rarity, n_parts, long = self.rarity, self.n_parts, self.long

        def count(batches):
            yield pa.RecordBatch.from_pydict({"n": [sum(len(key) for key, *_ in _posts(batches, rarity, long, late))]})

        def keys(batches):
            for key, n, *_ in _posts(batches, rarity, long, late):
                yield np.concatenate([mixed(key, _band(n) + k) for k in (-1, 0, 1)])

        posts = self.packed.mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
        wanted = Marks.over(self.packed, keys, 3 * posts)

        def sent(batches):
            for key, *member in _posts(batches, rarity, long):
                few = wanted.admits(mixed(key, _band(member[0])))
                key, member = key[few], [c[few] for c in member]
                yield dealt((mixed(key) % np.uint64(n_parts)).astype(np.int64), [c.astype(k, copy=False) for c, k in zip((key, *member), _POST, strict=True)])

        def compare(batches):
            key, *member = gathered(payloads(batches), _POST)
            yield from _compared(key, Members(member), late, long)

        near = self._met(self.packed.mapInArrow(sent, DEALT).repartitionById(n_parts, "part").mapInArrow(compare, _PAIRS), late)

        def hashes(batch):
            key, doc, line = (c.to_numpy() for c in batch.columns)
            return np.concatenate([mixed(key, doc, line), mixed(doc, line), mixed(doc)])

        members = Marks.of(near.select("list", "doc", "line"), hashes, 3)

        def whole(batches):
            for number, doc, n, start, h in _marked_sets(batches, members, rarity):
                parity = _hashes_of(h, start)[2:]
                able = np.flatnonzero(n >= LEAST_WORDS)
                own, key, place = listed(n[able], start[able], (h >> np.uint64(32)).astype("<u4"), rarity, long)
                own = able[own]
                few = members.admits(mixed(key, doc[own], number[own]))
                own, key, place = own[few], key[few], place[few]
                part = (mixed(key) % np.uint64(n_parts)).astype(np.int64)
                yield dealt_ragged(part, [key, n[own], place, number[own], doc[own], *(p[own] for p in parity)], _POST, h, start[own], n[own])

        def decide(batches):
            (key, *member), sets = unragged(payloads(batches), _POST, "<u8")
            yield from _compared(key, Members(member, sets), late, long)

        met = self._met(docs.mapInArrow(whole, DEALT).repartitionById(n_parts, "part").mapInArrow(decide, _PAIRS), late)
        out = written(met.select("late_doc", "late_line").distinct(), "line-gone")
        released(near, met)
        return out

    def _met(self, found: DataFrame, late: Marks | None) -> DataFrame:
        """What the comparison of whole lists found, with what is found across the chunks of longer ones."""
        found = written(found, "line-met")
        chunks = found.filter("payload is not null")
        if chunks.isEmpty():
            return found
        out = written(found.filter("payload is null").unionByName(_across(chunks, late)), "line-met")
        released(found)
        return out


_PAIRS = "apart int, doc long, line int, late_doc long, late_line int, others boolean, list long, chunk int, payload binary"
_ARROW = pa.schema(
    [("apart", pa.int32()), ("doc", pa.int64()), ("line", pa.int32()), ("late_doc", pa.int64()), ("late_line", pa.int32()), ("others", pa.bool_())]
    + [("list", pa.int64()), ("chunk", pa.int32()), ("payload", pa.binary())]
)
#: Comparisons at a time.
COMPARED = 1 << 20
#: Partners that pass all filters, from which on a list isn't searched for more of a place: the likeliest is verified, and where
#: it fails, all lists of the place are searched for all partners. A group of similar lines has a pair for any two of them.
ENOUGH = 32


def _band(n: np.ndarray) -> np.ndarray:
    """Sizes of similar sets are in the same band or in neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(100 / PERCENT) * (1 - 1e-9)).astype(np.int64)


class Members:
    """Members of lists, perhaps with their whole sets."""

    def __init__(self, columns: list[np.ndarray], sets: np.ndarray | None = None):
        self.columns, self.sets = columns, sets
        self.n, self.place, self.line, self.doc, self.low, self.high = columns
        self.n = self.n.astype(np.int64)
        self.starts = np.cumsum(self.n) - self.n

    def taken(self, rows: np.ndarray) -> Members:
        return Members([c[rows] for c in self.columns], None if self.sets is None else self.sets[runs(self.starts[rows], self.n[rows])])

    def packed(self) -> bytes:
        return ragged(self.columns, _MEMBER, np.zeros(0, "<u8") if self.sets is None else self.sets)

    @classmethod
    def of(cls, blobs: list[bytes]) -> Members:
        columns, sets = unragged(blobs, _MEMBER, "<u8")
        return cls(columns, sets if len(sets) else None)

    def spare(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the sets of the rows may differ in and be similar, less those in which they do at least."""
        both = self.n[i] + self.n[j]
        return both - 2 * -(-PERCENT * both // (100 + PERCENT)) - np.bitwise_count(self.low[i] ^ self.low[j]) - np.bitwise_count(self.high[i] ^ self.high[j])

    def alike(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of rows that pass the positional filter and that of the parities."""
        need = -(-PERCENT * (self.n[i] + self.n[j]) // (100 + PERCENT))
        good = np.minimum(self.n[i] - self.place[i], self.n[j] - self.place[j]) >= need
        i, j = i[good], j[good]
        good = self.spare(i, j) >= 0
        return i[good], j[good]

    def similar(self, i: int, j: int) -> bool:
        a, b = (self.sets[self.starts[k] : self.starts[k] + self.n[k]] for k in (i, j))
        shared = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * shared >= PERCENT * (len(a) + len(b) - shared)

    def pairs(self, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        """Of pairs of rows, the later place second, for each later place its likeliest partner, and whether there are others;
        where whole sets are there, a partner that is similar."""
        doc, line = self.doc, self.line
        spare = self.spare(i, j)
        order = np.lexsort((line[i], doc[i], -spare, line[j], doc[j]))
        i, j, spare = i[order], j[order], spare[order]
        start = np.flatnonzero(np.append(True, (doc[j[1:]] != doc[j[:-1]]) | (line[j[1:]] != line[j[:-1]]))[: len(j)])
        ends = np.append(start[1:], len(j))[: len(start)]
        if self.sets is not None:
            found = (next((k for k in range(a, b) if self.similar(i[k], j[k])), None) for a, b in zip(start, ends, strict=True))
            start = ends = np.array([k for k in found if k is not None], np.int64)
        others = pa.array(ends - start > 1)
        i, j, spare = i[start], j[start], spare[start]
        columns = [pa.array(c, t) for c, t in ((-spare, pa.int32()), (doc[i], pa.int64()), (line[i], pa.int32()), (doc[j], pa.int64()), (line[j], pa.int32()))]
        return pa.RecordBatch.from_arrays([*columns, others, pa.nulls(len(i), pa.int64()), pa.nulls(len(i), pa.int32()), pa.nulls(len(i), pa.binary())], schema=_ARROW)


class Search:
    """What the comparison of members finds: for later places their likeliest partner. With late, of the later places that it
    admits: all members of their pairs, with the list's key; or, where whole sets are there, a partner that is similar. So a
    task finds no more rows than it has members, or ENOUGH times as many, however many pairs there are."""

    def __init__(self, key: np.ndarray, members: Members, late: Marks | None):
        self.key, self.members, self.names = key, members, late is not None and members.sets is None
        places = np.lexsort((members.line, members.doc))
        doc, line = members.doc[places], members.line[places]
        self.rank = np.empty(len(places), np.int64)
        self.rank[places] = np.cumsum((doc != np.roll(doc, 1)) | (line != np.roll(line, 1)))
        self.open = np.ones(len(places), bool) if late is None else late.admits(mixed(members.doc, members.line))
        self.found = np.zeros(len(places), np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Compare pairs of rows."""
        swap = self.rank[i] > self.rank[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        few = self.open[j] & (self.rank[i] != self.rank[j])
        i, j = self.members.alike(i[few], j[few])
        if self.names:
            self.found[i] = self.found[j] = 1
            return
        if self.members.sets is None:
            np.add.at(self.found, j, 1)
            self.open[j[self.found[j] >= ENOUGH]] = False
        self.held.append((i, j))
        self.waiting += len(i)
        if self.waiting >= COMPARED:
            yield self._sent()

    def _sent(self) -> pa.RecordBatch:
        out = self.members.pairs(*(np.concatenate(x) for x in zip(*self.held, strict=True)))
        if self.members.sets is not None:  # one similar partner is enough
            gone = mixed(out.column("late_doc").to_numpy(), out.column("late_line").to_numpy())
            self.open &= ~np.isin(mixed(self.members.doc, self.members.line), gone)
        self.held, self.waiting = [], 0
        return out

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.names:
            rows = np.flatnonzero(self.found)
            columns = {"doc": self.members.doc[rows], "line": self.members.line[rows], "list": self.key[rows].astype(np.int64)}
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(rows), f.type) for f in _ARROW], schema=_ARROW)
        elif self.held:
            yield self._sent()


def _compared(key: np.ndarray, members: Members, late: Marks | None, long: int) -> Iterator[pa.RecordBatch]:
    """The pairs within each list. A list of more than `long` members is handed on in chunks, which other tasks compare two by two."""
    order = np.argsort(key.astype(np.uint64) << np.uint64(32) | members.n.astype(np.uint64))
    key, members = key[order], members.taken(order)
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    sizes = np.diff(np.append(starts, len(key)))
    for a, size in zip(starts[sizes > long], sizes[sizes > long], strict=True):
        for k, b in enumerate(range(a, a + size, long)):
            blob = members.taken(np.arange(b, min(b + long, a + size))).packed()
            row = {"apart": [0], "doc": [0], "line": [0], "late_doc": [0], "late_line": [0], "others": [None], "list": [int(key[a])], "chunk": [k], "payload": [blob]}
            yield pa.RecordBatch.from_pydict(row, _ARROW)
    # each member against the one k places on, while a set that large can be similar
    i, end, n, k = np.flatnonzero(np.repeat(sizes <= long, sizes)), np.repeat(starts + sizes, sizes), members.n, 1
    search = Search(key, members, late)
    while len(i):
        i = i[i + k < end[i]]
        i = i[100 * n[i] >= PERCENT * n[i + k]]
        yield from search.add(i, i + k)
        k += 1
    yield from search.end()


def _across(chunks: DataFrame, late: Marks | None) -> DataFrame:
    """The pairs of lists that are handed on in chunks: any two chunks of a list meet in one task."""
    counts = chunks.groupBy("list").agg(F.max("chunk").alias("last"))
    met = chunks.join(counts, "list").selectExpr("list", "chunk", "payload", "explode(sequence(0, last)) as other")
    keys = ["list", "low", "high"]
    met = met.selectExpr("list", "least(chunk, other) as low", "greatest(chunk, other) as high", "payload")

    def run(batches):
        held, last = [], None
        for batch in batches:
            for *key, payload in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held and key != last:
                    yield from compared(held, last[0])
                    held = []
                last = key
                held.append(payload)
        if held:
            yield from compared(held, last[0])

    def compared(held, key):
        members, half = Members.of(held), len(Members.of(held[:1]).n)
        left = np.arange(half)
        right = np.arange(half, len(members.n)) if len(held) > 1 else left
        step = max(1, COMPARED // max(1, len(right)))
        search = Search(np.full(len(members.n), key), members, late)
        for a in range(0, half, step):
            i, j = (x.ravel() for x in np.meshgrid(left[a : a + step], right, indexing="ij"))
            good = 100 * np.minimum(members.n[i], members.n[j]) >= PERCENT * np.maximum(members.n[i], members.n[j])
            good &= (i < j) if right is left else True
            yield from search.add(i[good], j[good])
        yield from search.end()

    return met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, _PAIRS)


def _marked_sets(batches, marks: Marks, rarity: Rarity | None) -> Iterator[tuple[np.ndarray, ...]]:
    """Of the lines whose documents and places are marked: line, doc, size, start, and the words of their sets, the rarest first
    (without rarity: all their words, in their order)."""
    for batch in batches:
        batch = batch.filter(pa.array(marks.admits(mixed(batch.column(0).to_numpy()))))
        for block in blocks(batch, 1):
            words = words_of(block.column(1))
            few = marks.admits(mixed(block.column(0).to_numpy()[words.text], words.number))
            words = Words(words.text[few], words.line[few], words.number[few], words.hashes[few])
            if rarity is None:
                h, start = words.hashes, np.flatnonzero(np.diff(words.line, prepend=-1))
                word, n = start, np.diff(np.append(start, len(h)))
            else:
                word, start, n, h = sets_of(words, rarity)
            if len(start):
                yield words.number[word].astype(np.int32), block.column(0).to_numpy()[words.text[word]], n, start, h


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """late_doc and late_line of the pairs whose word sets are similar, counted on the words of the whole lines."""
    places = pairs.select("doc", "line").unionByName(pairs.selectExpr("late_doc as doc", "late_line as line"))
    marks = Marks.of(places, lambda batch: np.append(mixed(batch.column(0).to_numpy()), mixed(*(c.to_numpy() for c in batch.columns))), 2)

    def run(batches):
        for number, doc, _, start, h in _marked_sets(batches, marks, None):
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(h)), pa.int32()), pa.array(h.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(number), lists], names=["doc", "line", "words"])

    sets = docs.mapInArrow(run, "doc long, line int, words array<long>").withColumn("words", F.array_distinct("words"))
    sets = written(sets, "line-sets")
    both = pairs.join(sets, ["doc", "line"]).join(sets.toDF("late_doc", "late_line", "late_words"), ["late_doc", "late_line"])
    shared = F.size(F.array_intersect("words", "late_words"))
    good = both.filter(100 * shared >= PERCENT * (F.size("words") + F.size("late_words") - shared)).select("late_doc", "late_line")
    out = written(good.distinct(), "line-gone")
    released(sets)
    return out


def removals(docs: DataFrame, text: str = "text", long: int = LONG) -> DataFrame:
    """doc_id and removed: the numbers of its lines that go, of every document that loses a line."""
    small_batches(docs.sparkSession)
    source = docs.selectExpr("cast(doc_id as bigint) as doc_id", f"cast(`{text}` as string) as text").filter("doc_id is not null")
    rarity = Rarity.of(source)
    classes = written(classes_of(source, rarity), "line-classes")
    lists = Lists(classes, rarity, long)
    found = lists.likeliest()
    gone = verified(found, source)
    # where the likeliest partner failed, others may not
    left = written(found.filter("more").select("late_doc", "late_line").join(gone, ["late_doc", "late_line"], "left_anti"), "line-left")
    tables = [classes, found, gone, left]
    if not left.isEmpty():
        tables.append(lists.verified(Marks.of(left, lambda batch: mixed(*(c.to_numpy() for c in batch.columns))), source))
        gone = gone.unionByName(tables[-1])
    lost = classes.filter("payload is null").select("doc", "line").unionByName(gone.toDF("doc", "line"))
    out = written(lost.groupBy(F.col("doc").alias("doc_id")).agg(F.array_sort(F.collect_set("line")).alias("removed")), "line-removals")
    released(*tables)
    return out


def clean(docs: DataFrame, text: str = "text", long: int = LONG) -> DataFrame:
    """docs with the repeated lines taken out of text, and removed (their numbers; null where none), in
    place of a column of that name. Lines without a word
    stay, as do null and empty texts. The first of equal or similar lines, by doc_id and line
    number, stays, whether or not its own similar lines went. Texts of any length are worked on whole. doc_id is a key:
    repeated rows of a document are one document
    and all keep the same lines; rows without doc_id are left alone."""
    lost = removals(docs, text, long)
    names = [c for c in docs.columns if c != "removed"]
    other = "doc_id" + "_" * max(map(len, names))  # a name that docs doesn't have
    joined = docs.join(lost.hint("shuffle_hash").withColumnRenamed("doc_id", other), F.col("doc_id") == F.col(other), "left").select(*(docs[c] for c in names), lost["removed"])
    column = names.index(text)
    schema = joined.schema

    def run(batches):
        for batch in batches:
            texts, gone = batch.column(column).to_pylist(), batch.column("removed").to_pylist()
            for k, numbers in enumerate(gone):
                if numbers:
                    out = set(numbers)
                    texts[k] = "\n".join([x for i, x in enumerate(texts[k].split("\n")) if i not in out])
            yield batch.set_column(column, batch.schema.field(column), pa.array(texts, batch.schema.field(column).type))

    return joined.mapInArrow(run, schema)


def summary(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, removed (numbers of lines, joined by commas) and text_sha256 of what is left (null text:
    no line, the hash of the empty string) of every document."""
    whole = docs.select("doc_id", F.col(text).cast("string").alias("text"))
    done = clean(whole.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))))
    left = F.coalesce("text", F.lit(""))
    lost = F.coalesce(F.size("removed"), F.lit(0))
    return done.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("n_lines").cast("bigint").alias("n_lines"), lost.cast("bigint").alias("n_removed"),
        F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"), F.sha2(left, 256).alias("text_sha256"),
    )
