"""Link lint: unresolved targets, broken headings and blocks, suggestions for typos."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions.text import slugify
from . import graph

# Codes of the findings.
UNRESOLVED = {"wikilink": "W001", "markdown": "W004", "embed": "W005"}
BROKEN_HEADING, BROKEN_BLOCK = "W002", "W003"
TITLES = {"W001": "Unresolved wikilink", "W002": "Broken heading anchor", "W003": "Broken block reference", "W004": "Unresolved markdown link", "W005": "Unresolved embed"}
LEAST_SIMILARITY, SUGGESTED = 0.6, 3


def suggestions(asked: DataFrame, known: DataFrame) -> DataFrame:
    """name and suggested: up to three known names, nearest first. Candidates meet by length and by a piece they must share:
    of two names within d edits (a transposition touches two characters), cut into 2d + 1 pieces, one piece of the asked
    name stays whole and moves by d places at most; so no name is compared with all."""

    def keyed(df: DataFrame, mine: bool) -> DataFrame:
        @F.pandas_udf("array<string>")
        def keys(names: pd.Series) -> pd.Series:
            return names.map(lambda s: sorted(_pieces(s) if mine else _places(s)))

        return df.select(F.col("name"), F.explode(keys("name")).alias("key"))

    left = keyed(asked.select("name").distinct(), True)
    right = keyed(known.select("name").distinct(), False).withColumnRenamed("name", "candidate")
    pairs = left.join(right, "key").select("name", "candidate").distinct()
    return _nearest(pairs, ["name"])


def suggestions_within(asked: DataFrame, known: DataFrame) -> DataFrame:
    """doc, name and suggested, as suggestions, among the known names of the same note: a note's headings or block ids are
    few, and all are compared."""
    pairs = asked.select("doc", "name").distinct().join(known.select("doc", F.col("name").alias("candidate")).distinct(), "doc")
    return _nearest(pairs, ["doc", "name"])


def _nearest(pairs: DataFrame, by: list[str]) -> DataFrame:
    """The columns `by` and suggested: candidates of a name near enough, nearest first, each once whatever its case."""
    scored = pairs.filter(F.lower("name") != F.lower("candidate")).withColumn("d", fuzzy.osa_column("name", "candidate"))
    n, m = F.length("name"), F.length("candidate")
    most = F.when(n <= 3, 1).when(n <= 7, 2).otherwise(3)
    near = scored.withColumn("sim", 1 - F.col("d") / F.greatest(n, m)).filter((F.col("d") <= most) & (F.col("sim") >= LEAST_SIMILARITY))
    best = graph.first_by(near.withColumn("_k", F.concat_ws("\x00", *by, F.lower("candidate"))), "_k", "d", F.desc("sim"), "candidate")
    top = best.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("d", F.desc("sim"), "candidate"))).filter(F.col("n") <= SUGGESTED)
    return top.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "candidate"))), lambda x: x["candidate"]).alias("suggested"))


def _cut(n: int, parts: int) -> list[tuple[int, int]]:
    parts = min(parts, n) or 1
    return [(n * k // parts, n * (k + 1) // parts) for k in range(parts)]


def _fold(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def _pieces(s: str) -> set[str]:
    """Of the asked name for each length a partner may have: its pieces with their places, or the length alone where the
    name has no more pieces than edits can touch."""
    s, d = _fold(s), fuzzy.allowed(len(s))
    if len(s) <= 2 * d:
        return {f"{m}|" for m in range(max(0, len(s) - d), len(s) + d + 1)}
    return {f"{m}|{len(s)}|{k}|{s[a:b]}" for m in range(len(s) - d, len(s) + d + 1) for k, (a, b) in enumerate(_cut(len(s), 2 * d + 1))}


def _places(t: str) -> set[str]:
    """Of a known name for each length an asked name may have: what could be each of that name's pieces."""
    t, out, m = _fold(t), set(), len(t)
    out.add(f"{m}|")
    for n in range(max(1, m - 3), m + 4):
        d = fuzzy.allowed(n)
        if abs(n - m) <= d and n > 2 * d:
            for k, (a, b) in enumerate(_cut(n, 2 * d + 1)):
                out |= {f"{m}|{n}|{k}|{t[x : x + b - a]}" for x in range(max(0, a - d), min(m - (b - a), a + d) + 1)}
    return out


def lint(t: dict[str, DataFrame], strict: bool = False) -> DataFrame:
    """code, title, severity, doc_id, line, col_end, target, snippet and suggested of every finding. strict makes unresolved
    targets errors; broken anchors stay warnings."""
    docs = t["documents"]
    links = graph.resolved(t["links"], docs, graph.LINT_ORDER, last=True)
    code = F.coalesce(*(F.when(F.col("link_type") == k, v) for k, v in UNRESOLVED.items()))
    lost = links.filter("doc is null").select(code.alias("code"), *_SHOWN, F.col("target_note").alias("name"), F.lit("error" if strict else "warning").alias("severity"))
    known = docs.select(F.col("title").alias("name")).unionByName(docs.select(F.explode(F.transform("aliases", F.lower)).alias("name"))).distinct()
    found = lost.join(suggestions(lost, known), "name", "left").withColumn("suggested", F.transform("suggested", lambda s: F.concat(F.lit("[["), s, F.lit("]]"))))
    return _reported(found).unionByName(broken_anchors(t, links))


def broken_anchors(t: dict[str, DataFrame], links: DataFrame | None = None) -> DataFrame:
    """The findings of lint on headings and blocks that the linked notes don't have."""
    links = graph.resolved(t["links"], t["documents"], graph.LINT_ORDER, last=True) if links is None else links
    names = t["sections"].select(F.col("doc_id").alias("doc"), F.col("heading").alias("name")).distinct()
    heads = names.select("doc", F.explode(F.array(F.lower("name"), slugify(F.col("name")))).alias("key")).distinct()
    asked = links.filter("doc is not null and target_heading is not null")
    own = asked.withColumn("key", F.lower("target_heading")).join(heads, ["doc", "key"], "left_anti").withColumn("key", slugify(F.col("target_heading")))
    no_head = own.join(heads, ["doc", "key"], "left_anti").drop("key").withColumn("name", F.col("target_heading"))
    blocks = t["block_ids"].select(F.col("doc_id").alias("doc"), F.col("block_id").alias("target_block")).distinct()
    asked = links.filter("doc is not null and target_block is not null")
    no_block = asked.join(blocks, ["doc", "target_block"], "left_anti").withColumn("name", F.col("target_block"))
    out = []
    for code, rows, known, mark in ((BROKEN_HEADING, no_head, names, "#"), (BROKEN_BLOCK, no_block, blocks.withColumnRenamed("target_block", "name"), "#^")):
        near = rows.join(suggestions_within(rows, known), ["doc", "name"], "left")
        written_out = F.transform("suggested", lambda s: F.concat(F.lit("[["), F.col("target_note"), F.lit(mark), s, F.lit("]]")))
        anchors = near.select(F.lit(code).alias("code"), *_SHOWN, F.concat_ws(mark, "target_note", "name").alias("name"), F.lit("warning").alias("severity"), written_out.alias("suggested"))
        out.append(_reported(anchors))
    return out[0].unionByName(out[1])


_SHOWN = ("source_doc_id", "line_number", "target_note", "context_snippet")


def _reported(found: DataFrame) -> DataFrame:
    title = F.coalesce(*(F.when(F.col("code") == k, v) for k, v in TITLES.items()))
    return found.select(
        "code", title.alias("title"), "severity", F.col("source_doc_id").alias("doc_id"), F.col("line_number").alias("line"), (F.octet_length("target_note") + 4).alias("col_end"),
        F.col("name").alias("target"), F.col("context_snippet").alias("snippet"), F.coalesce("suggested", F.array().cast("array<string>")).alias("suggested"),
    )


def wanted(findings: DataFrame) -> DataFrame:
    """Unresolved targets by how often they are asked for, with the notes that do."""
    lost = findings.filter(F.col("code").isin(*UNRESOLVED.values()))
    out = lost.groupBy("target").agg(F.count("*").alias("ref_count"), F.array_sort(F.collect_set("doc_id")).alias("files"), F.first("suggested").alias("suggested"))
    return out.orderBy(F.desc("ref_count"), "target")


def totals(findings: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """One row: notes and links scanned, errors and warnings."""
    by = findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return by.crossJoin(t["documents"].agg(F.count("*").alias("documents"))).crossJoin(t["links"].agg(F.count("*").alias("links")))


def exit_code(findings: DataFrame, strict: bool) -> int:
    return int(strict and not findings.isEmpty())
