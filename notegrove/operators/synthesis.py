"""Generated pages: topic maps, the index, the orphan list."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized_tag, topic_title
from . import graph

# The markers around a generated block, and how many hubs and connections a page shows.
BEGIN, END = "<!-- BEGIN SYNTHESIS -->", "<!-- END SYNTHESIS -->"
TOPIC_HUBS, INDEX_HUBS, CONNECTIONS = 5, 7, 10


def summaries(t: dict[str, DataFrame], g: graph.Graph, ranks: DataFrame) -> DataFrame:
    """title, path, tags, word_count, in_degree, out_degree, pagerank of every note, by rank and title."""
    d = graph.degrees(g).select("id", "in_degree", "out_degree")
    notes = g.vertices.filter("node_type = 'document'").join(d, "id").join(ranks.select("id", "pagerank"), "id", "left")
    return notes.fillna(0.0, ["pagerank"]).select("id", "title", "path", "tags", "word_count", "in_degree", "out_degree", "pagerank").orderBy(F.desc("pagerank"), "title")


def topics(t: dict[str, DataFrame]) -> DataFrame:
    """First parts of the tags."""
    first = F.split(normalized_tag(F.col("tag")), "/")[0]
    return t["tags"].select(first.alias("topic")).filter("topic <> ''").distinct().orderBy("topic")


def taxonomy(members: DataFrame) -> DataFrame:
    """node, depth, is_leaf and n_notes for every prefix of the tags (tag, title); a note counts at its own tag."""
    own = members.select(normalized_tag(F.col("tag")).alias("tag"), "title").distinct()
    prefixes = own.select("tag", "title", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(F.split("tag", "/"))), lambda n: F.array_join(F.slice(F.split("tag", "/"), 1, n), "/"))).alias("depth", "node"))
    full = F.col("node") == F.col("tag")
    out = prefixes.groupBy("node").agg(F.min("depth").alias("depth"), F.count_if(full).alias("n_notes"), (~F.max(~full)).alias("is_leaf"))
    return out.select("node", F.col("depth").cast("bigint").alias("depth"), "n_notes", "is_leaf")


def in_topic(topic: str, any_part: bool = True) -> Column:
    """Over tags and title: the tag, a tag below it, any part of one (any_part), or the title has it."""
    low = topic.lower()

    def fits(tag: Column) -> Column:
        own = normalized_tag(tag)
        test = (own == low) | own.startswith(low + "/")
        return test | F.array_contains(F.split(own, "/"), low) if any_part else test

    return F.exists("tags", fits) | F.lower("title").contains(low)


def connections(t: dict[str, DataFrame], notes: DataFrame, topic: str) -> DataFrame:
    """Targets outside the topic that its notes link to most."""
    own = notes.filter(in_topic(topic)).select("id", F.lower("title").alias("low"))
    links = t["links"].join(own.select(F.col("id").alias("source_doc_id")), "source_doc_id", "left_semi")
    away = links.join(own.select("low"), F.lower("target_note") == F.col("low"), "left_anti")
    return away.groupBy("target_note").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target_note").limit(CONNECTIONS)


def _taxonomy_lines(rows) -> list[str]:
    lines, by_node = [], {}
    for r in rows:
        for tag in r["tags"] or ["untagged"]:
            by_node.setdefault(tag.lstrip("#").lower(), []).append(r["title"])
    nodes = {"/".join(tag.split("/")[: k + 1]) for tag in by_node for k in range(tag.count("/") + 1)}
    for node in sorted(nodes):
        depth = min(max(node.count("/") + 3, 2), 6)
        lines += [f"{'#' * depth} #{node}", "", *(f"- [[{x}]]" for x in dict.fromkeys(by_node.get(node, []))), ""]
    return lines


def topic_page(t: dict[str, DataFrame], notes: DataFrame, topic: str) -> tuple[str, str]:
    """File name and body of a topic's map. The page lists the topic's notes, so it is as long as they are many."""
    name = notes.sparkSession.createDataFrame([(topic,)], "t string").select(topic_title(F.col("t")).alias("n")).head()["n"]
    rows = notes.filter(in_topic(topic)).orderBy(F.desc("pagerank"), "title").collect()
    body = ["## Topic Overview", "", f"- **Topic**: `{topic}`", f"- **Total Notes**: {len(rows)}", "- **Ordering**: Hub Centrality (PageRank descending)", ""]
    if rows:
        hubs = (f"- [[{r['title']}]] · Hub Score: {r['pagerank']:.2f} (In: {r['in_degree']}, Out: {r['out_degree']})" for r in rows[:TOPIC_HUBS])
        body += ["### Key Hub Notes & Core Concepts", "", *hubs, ""]
    if any(r["tags"] for r in rows):
        body += ["### Taxonomy Breakdown", "", *_taxonomy_lines([r for r in rows if r["tags"]])]
    every = [f"- [[{r['title']}]] · Hub: {r['pagerank']:.2f}" for r in rows] or ["_No notes currently categorized under this topic._"]
    body += ["### Note Index", "", *every, ""]
    if away := connections(t, notes, topic).collect():
        body += ["### Connected Vault Concepts", "", "Outgoing references connecting this topic to broader knowledge:", ""]
        body += [*(f"- [[{r['target_note']}]] ({r['n']} references)" for r in away), ""]
    return f"MOC - {name}.md", "\n".join(body)


def index_page(t: dict[str, DataFrame], g: graph.Graph, notes: DataFrame) -> str:
    rows = notes.orderBy(F.desc("pagerank"), "title").collect()
    lost, wanted, found = graph.orphans(g).orderBy("title").collect(), graph.wanted(g).collect(), topics(t).collect()
    names = [r["n"] for r in topics(t).select(topic_title(F.col("topic")).alias("n")).collect()]
    body = ["# Index", "", "## Overview", "", f"{len(rows)} notes, {sum(r['word_count'] for r in rows)} words, {len(found)} topics, {len(lost)} orphans, {len(wanted)} wanted.", ""]
    body += ["## Maps", "", *(f"- [[MOC - {n}]]" for n in names), "", "## Hubs", "", *(f"- [[{r['title']}]] ({r['pagerank']:.3f})" for r in rows[:INDEX_HUBS]), ""]
    body += ["## Taxonomy", "", *_taxonomy_lines([r for r in rows if r["tags"]]), "## Untagged", "", *(f"- [[{r['title']}]]" for r in rows if not r["tags"]), ""]
    return "\n".join([*body, "## Health", "", *(f"- wanted: [[{r['title']}]] ({r['ref_count']})" for r in wanted), *(f"- orphan: [[{r['title']}]]" for r in lost), ""])


def orphans_page(g: graph.Graph) -> str:
    return "\n".join(["# Orphans", "", *(f"- [[{r['title']}]]" for r in graph.orphans(g).orderBy("title").collect()), ""])


def merged(old: str | None, block: str, header: str = "") -> str:
    """old with the marked block replaced, or added at its end; alone under a header where there was nothing. Doing it twice
    changes nothing."""
    marked = f"{BEGIN}\n{block.strip()}\n{END}"
    if not old or not old.strip():
        return f"{header}{marked}\n"
    start, end = old.find(BEGIN), old.find(END)
    if 0 <= start < end:
        return old[:start] + marked + old[end + len(END) :]
    return f"{old.rstrip()}\n\n{marked}\n"


def write_pages(root: str, pages: dict[str, str], dry_run: bool = False) -> dict[str, str]:
    """Each page merged into its file; what was written, or would be."""
    out = {}
    for name, body in pages.items():
        path = Path(root, name)
        out[name] = merged(path.read_text(encoding="utf-8") if path.exists() else None, body)
        if not dry_run:
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(out[name], encoding="utf-8")
    return out


def pages(t: dict[str, DataFrame], g: graph.Graph, ranks: DataFrame, topic: str | None = None) -> dict[str, str]:
    """Maps of one topic or all (General without topics), the index and the orphan list, by file name."""
    notes = summaries(t, g, ranks)
    chosen = [topic] if topic else [r["topic"] for r in topics(t).collect()] or ["General"]
    made = dict(topic_page(t, notes, x) for x in chosen)
    return made if topic else made | {"Index.md": index_page(t, g, notes), "Orphans.md": orphans_page(g)}
