"""MinHash near-duplicates by an inverted join over signature coordinates.

Texts with equal shingle sets are one class. A class is posted under the (coordinate, value) pairs of its signature. A pair
of classes that agrees in `least` of COORDINATES coordinates meets in a list even if each class is posted under its
COORDINATES - least + 1 rarest pairs only (prefix), so long lists are skipped. Within a list every member is first compared
with the list's most central class; the links found are confirmed on full shingle sets and merged into components; then
only members of different components are compared, block by block. No list is ever expanded into its pairs.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cached_property
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import released, small_batches, written

COORDINATES = 32
#: Chance at most that two sets of just the linked similarity agree in fewer coordinates than asked for.
MISSED = 1e-6
#: Members of a list whose signatures a task compares with as many others: some hundred bytes each.
PART = 1024
#: Classes whose texts a task compares with as many others, and shingles that their sets hold together.
BLOCK, BLOCK_SHINGLES = 256, 500_000
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


@dataclass(frozen=True)
class Likeness:
    """Two sets are linked if 100 * intersection >= percent * union; sets hold shingles of `words` words."""

    words: int = 5
    percent: int = 80

    @cached_property
    def least(self) -> int:
        """Coordinates that a linked pair agrees in but for a chance of MISSED."""
        p, below, k = self.percent / 100, 0.0, 0
        while True:
            below += comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k)
            if below > MISSED:
                return k
            k += 1

    def linked(self, n: int, m: int, both: int) -> bool:
        return 100 * both >= self.percent * (n + m - both)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text: A-Z lower-cased, words between ASCII white space. Fewer words
    than a shingle has are one shingle; no words, no shingle."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(w) - words + 1
    h = w[:n].copy()
    for k in range(1, words):
        h *= _ODD[0]
        h += w[k : n + k]
    h ^= h >> np.uint64(32)
    h *= _ODD[1]
    h ^= h >> np.uint64(29)
    return np.unique(h)


_random = np.random.default_rng(20240229)
_MASKS = _random.integers(0, 2**64, COORDINATES, np.uint64)
_FACTORS = _random.integers(0, 2**63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """For each coordinate the least of its own hash over the set."""
    least = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 4096):
        mixed = (hashes[i : i + 4096, None] ^ _MASKS) * _FACTORS
        mixed ^= mixed >> np.uint64(31)
        mixed *= _ODD[2]
        least = np.minimum(least, mixed.min(axis=0))
    return least


def signed(docs: DataFrame, like: Likeness, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_id (16 bytes; null for an empty set), posts (the coordinates' values, each marked with its
    coordinate) and brief (32 bits of each) of every whole text."""
    small_batches(docs.sparkSession)
    words, coordinate = like.words, np.arange(COORDINATES, dtype=np.uint64)

    def run(batches):
        for batch in batches:
            counts, ids, posts, briefs = [], [], [], []
            for t in batch.column(1).to_pylist():
                h = shingles(t, words)
                counts.append(len(h))
                if not len(h):
                    ids.append(None), posts.append(None), briefs.append(None)
                    continue
                least = signature(h)
                ids.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                posts.append(((least >> np.uint64(16)) << np.uint64(6) | coordinate).astype(np.int64))
                briefs.append((least >> np.uint64(20)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(posts, pa.list_(pa.int64())), pa.array(briefs, pa.binary())],
                names=["doc_id", "n_shingles", "set_id", "posts", "brief"],
            )

    source = docs.selectExpr("cast(doc_id as bigint) as doc_id", f"cast(`{text}` as string) as text")
    return source.mapInArrow(run, "doc_id long, n_shingles long, set_id binary, posts array<long>, brief binary")


def posted(classes: DataFrame, like: Likeness) -> DataFrame:
    """one (class id), n, brief, weight, prefix, inside and block of the classes that can have a partner. prefix: the values,
    among the rarest of the signature, that other classes have too; inside marks their coordinates. weight: how many classes
    share its values in all. block: classes whose most common value is the same, BLOCK of them at most or so."""
    values = classes.select("one", F.explode("posts").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("classes")).filter("classes > 1")
    by_class = values.join(shared, "value").groupBy("one").agg(F.array_sort(F.collect_list(F.struct("classes", "value"))).alias("common"))
    prefix = COORDINATES - like.least + 1
    short = F.lit(prefix - COORDINATES) + F.size("common")  # values that only this class has come first in its prefix
    kept = by_class.select("one", short.alias("short"), "common").filter("short > 0").selectExpr(
        "one", "aggregate(common, 0L, (a, c) -> a + c.classes) as weight", "transform(slice(common, 1, short), c -> c.value) as prefix", "element_at(common, -1) as home"
    )
    both = kept.join(classes.select("one", "n", "brief"), "one").withColumn(
        "blocks", F.ceil(F.expr(f"home.classes * greatest(1 / {BLOCK}D, n / {BLOCK_SHINGLES}D)"))
    )
    return both.selectExpr(
        "one", "n", "brief", "weight", "prefix", "aggregate(prefix, 0L, (a, v) -> a | shiftleft(1L, cast(v & 63 as int))) as inside",
        "xxhash64(home.value, blocks, pmod(xxhash64(one), blocks)) as block",
    )


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(axis=-1)


def runs(batches, keys: int):
    """Rows with equal first columns, out of batches sorted by them."""
    held, last = [], None
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        changed = np.zeros(max(0, batch.num_rows - 1), bool)
        for c in columns:
            changed |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(changed) + 1).tolist()] if batch.num_rows else []
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(c[start] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _pairs(pairs: np.ndarray) -> pa.RecordBatch:
    pairs = pairs.reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["one", "two"])


def _briefs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, COORDINATES)


def star_pairs(posts: DataFrame, like: Likeness) -> DataFrame:
    """Pairs (one, two) of a class and the most central class of a list of both."""
    lists = posts.select(F.explode("prefix").alias("value"), "one", "n", "brief", "weight")
    centre = lists.groupBy("value").agg(F.count("*").alias("members"), F.max(F.struct("weight", (-F.col("one")).alias("minus"), "n", "brief")).alias("c"))
    # a table of its own, so that the join has its own exchange and Spark can split a long list's partition
    centre = written(centre.filter("members > 1").selectExpr("value", "-c.minus as two", "c.n as m", "c.brief as other"), "dedup-centres")
    ratio, least = like.percent, like.least
    pairs = lists.join(centre, "value").filter(f"one <> two and 100 * least(n, m) >= {ratio} * greatest(n, m)")

    def run(batches):
        for batch in batches:
            good = _agreeing(_briefs(batch.column("brief")), _briefs(batch.column("other"))) >= least
            yield batch.select(["one", "two"]).filter(pa.array(good))

    out = written(pairs.select("one", "two", "brief", "other").mapInArrow(run, "one long, two long").distinct(), "dedup-pairs")
    released(centre)
    return out


def open_groups(posts: DataFrame, component: DataFrame, like: Likeness) -> DataFrame:
    """key and one: for each two blocks of classes, those members that share a list with a member of another component and
    agree with it in enough coordinates. A long list is dealt into parts of about PART members, and each two parts are
    compared by one task. Members are named, not pairs: there may be far more of these."""
    lists = posts.join(component, "one", "left").select(
        F.explode("prefix").alias("value"), "one", "n", "brief", "inside", "block", F.coalesce("component", "one").alias("component")
    )
    open_lists = lists.groupBy("value").agg(F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high"))
    open_lists = open_lists.filter("low <> high").select("value", F.ceil(F.col("members") / PART).cast("int").alias("blocks"))
    open_lists = written(open_lists, "dedup-open-lists")  # as with the centres
    dealt = lists.join(open_lists, "value").selectExpr("*", "cast(pmod(xxhash64(one), blocks) as int) as own")
    # block k meets each block: the lower number first
    met = dealt.selectExpr("*", "explode(sequence(0, blocks - 1)) as k").selectExpr(
        "value", "least(own, k) as first", "greatest(own, k) as second", "own", "one", "n", "component", "inside", "block", "brief"
    )
    ratio, least = like.percent, like.least
    bits = np.left_shift(1, np.arange(COORDINATES, dtype=np.int64))

    def run(batches):
        for group in runs(batches, 3):
            value, first, second, own, one, n, component, inside, block = (c.to_numpy() for c in group.columns[:9])
            brief, here = _briefs(group.column("brief")), 1 << int(value[0] & 63)
            left, pairs = np.flatnonzero(own == first), [np.zeros((0, 2), np.int64)]
            right = left if first[0] == second[0] else np.flatnonzero(own != first)
            for i in left:
                to = right[(component[right] != component[i]) & (100 * np.minimum(n[right], n[i]) >= ratio * np.maximum(n[right], n[i]))]
                to = to[to > i] if right is left else to
                alike = brief[to] == brief[i]
                # a pair that shares several lists comes out of that of its first coordinate
                shared = (alike @ bits) & inside[to] & inside[i]
                to = to[(alike.sum(axis=1) >= least) & ((shared & -shared) == here)]
                pairs.append(np.column_stack([np.full(len(to), i), to]))
            at = np.concatenate(pairs)
            blocks = np.sort(block[at], axis=1)
            found, which = np.unique(blocks, axis=0, return_inverse=True)
            members = [np.unique(one[at[which.ravel() == k]]) for k in range(len(found))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[:, 0], pa.int64()), pa.array(found[:, 1], pa.int64()), pa.array(members, pa.list_(pa.int64()))], names=["low", "high", "members"]
            )

    keys = ["value", "first", "second"]
    groups = met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "low long, high long, members array<long>")
    whole = groups.groupBy("low", "high").agg(F.array_distinct(F.flatten(F.collect_list("members"))).alias("members"))
    out = written(whole.select(F.xxhash64("low", "high").alias("key"), F.explode("members").alias("one")), "dedup-groups")
    released(open_lists)
    return out


def paired_groups(pairs: DataFrame, posts: DataFrame) -> DataFrame:
    """key and one of the members of the pairs, by the blocks of both."""
    one, two = (posts.select(F.col("one").alias(c), F.col("block").alias(f"block_{c}")) for c in ("one", "two"))
    low, high = F.least("block_one", "block_two"), F.greatest("block_one", "block_two")
    dealt = pairs.join(one, "one").join(two, "two").select(F.xxhash64(low, high).alias("key"), F.explode(F.array("one", "two")).alias("one"))
    return dealt.distinct()


def confirmed(groups: DataFrame, docs: DataFrame, like: Likeness, text: str = "text") -> DataFrame:
    """Links (one, two) that join what is linked within each group (key, one): a task makes the full shingle sets of a group,
    two blocks at most, from the whole texts and compares them all; of the links found it names as many as join the
    members."""
    texts = docs.selectExpr("cast(doc_id as bigint) as one", f"cast(`{text}` as string) as text")
    rows = groups.hint("shuffle_hash").join(texts, "one").select("key", "one", "text")
    words = like.words
    small_batches(docs.sparkSession)

    def run(batches):
        for group in runs(batches, 1):
            members = dict(zip(group.column("one").to_pylist(), group.column("text").to_pylist(), strict=True))
            one = np.array(list(members), np.int64)
            sets = [shingles(t, words) for t in members.values()]
            at = np.column_stack(np.triu_indices(len(sets), 1))
            size = np.array([len(x) for x in sets])
            n = size[at].sum(axis=1)
            near = 100 * size[at].min(axis=1) >= like.percent * size[at].max(axis=1)
            at, n = at[near], n[near]
            both = _common(sets, at)
            yield _pairs(one[_forest(at[100 * both >= like.percent * (n - both)], len(sets))])

    return rows.repartition("key").sortWithinPartitions("key", "one").mapInArrow(run, "one long, two long")


def _forest(links: np.ndarray, n: int) -> np.ndarray:
    """As many of the links as join what all of them join."""
    root, out = list(range(n)), []
    for k, (a, b) in enumerate(links.tolist()):
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append(k)
    return links[out]


def _common(sets: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs of sets: one by one where they are few, else as a product of the table that
    says which set holds which element, over the elements that two sets or more hold."""
    if len(at) <= 2 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in at], np.int64)
    _, element, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    who = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared = holders > 1
    number = np.cumsum(shared) - 1
    keep = shared[element]
    who, element = who[keep], number[element[keep]]
    order = np.argsort(element, kind="stable")
    who, element = who[order], element[order]
    product = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(shared.sum()), 8192):
        a, b = np.searchsorted(element, [start, start + 8192])
        held = np.zeros((len(sets), 8192), np.float32)
        held[who[a:b], element[a:b] - start] = 1
        product += held @ held.T
    return product[at[:, 0], at[:, 1]].round().astype(np.int64)


def components(links: DataFrame) -> DataFrame:
    """one and component (the least class id reachable) of every class that has a link. Labels go to neighbours and then jump
    to their own label's label, so the rounds grow with the logarithm of the longest chain."""
    edges = written(links.unionByName(links.selectExpr("two as one", "one as two")).distinct(), "dedup-edges")
    labels = written(edges.groupBy("one").agg(F.least(F.col("one"), F.min("two")).alias("component")), "dedup-labels")
    while True:
        near = edges.join(labels.select(F.col("one").alias("two"), "component"), "two").groupBy("one").agg(F.min("component").alias("near"))
        moved = labels.select("one", "component").join(near, "one").select("one", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        target = moved.select(F.col("one").alias("component"), F.col("component").alias("further"))
        jumped = written(
            moved.join(target, "component", "left").select("one", F.least("component", "further").alias("component"), "before"), "dedup-labels"
        )
        released(labels)
        labels = jumped
        if jumped.filter("component <> before").isEmpty():
            released(edges)
            return jumped


def group(docs: DataFrame, like: Likeness, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable over links, its own included) and kept (doc_id is
    component_id) of every document. Null texts and texts without words have an empty set and are linked with nothing.
    doc_id is a key; repeated rows of a document give repeated rows. Rows without doc_id are linked with nothing: their
    component_id is null and they are kept. Texts of any length are worked on whole. Other columns are ignored."""
    every = written(signed(docs, like, text), "dedup-signed")
    first = every.filter("n_shingles > 0 and doc_id is not null").groupBy("set_id").agg(F.min(F.struct("doc_id", "n_shingles", "posts", "brief")).alias("c"))
    classes = written(first.selectExpr("set_id", "c.doc_id as one", "c.n_shingles as n", "c.posts", "c.brief"), "dedup-classes")
    posts = written(posted(classes, like), "dedup-posts")
    pairs = star_pairs(posts, like)
    groups = written(paired_groups(pairs, posts), "dedup-groups")
    links = written(confirmed(groups, docs, like, text), "dedup-links")
    component = components(links)
    rest = open_groups(posts, component, like)
    if not rest.isEmpty():
        more = written(confirmed(rest, docs, like, text), "dedup-links")
        closed, component = component, components(links.unionByName(more))
        released(closed, more)
    released(posts, pairs, groups, links, rest)
    by_set = classes.join(component, "one", "left").select("set_id", F.coalesce("component", "one").alias("component_id"))
    out = every.select("doc_id", "n_shingles", "set_id").join(by_set, "set_id", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
