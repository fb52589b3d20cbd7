"""The engine over one vault: ingest, the query catalogue, and what the tools and the command line call."""

from __future__ import annotations

import json
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .index import SavedVault
from .operators import catalogue, diagnostics, fts, graph, markdown, rag, retrieval, synthesis, topology
from .sources import vault


class VaultEngine:
    """notes: path and content. Tables, graph, ranks and index are made once, when first asked for."""

    def __init__(self, spark: SparkSession, notes: DataFrame):
        self.spark, self.notes = spark, notes

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> VaultEngine:
        return cls(spark, vault.files(spark, root))

    @classmethod
    def saved(cls, spark: SparkSession, root: str) -> VaultEngine:
        """Over the tables that an index keeps, without parsing a note."""
        engine = cls(spark, spark.createDataFrame([], "path string, content string"))
        engine.__dict__["tables"] = SavedVault(spark, root).tables()
        return engine

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        return markdown.tables(markdown.parse(self.notes).persist())

    @cached_property
    def graph(self) -> graph.Graph:
        return graph.build(self.tables)

    @cached_property
    def ranks(self) -> DataFrame:
        return graph.pagerank(self.graph)

    @cached_property
    def index(self) -> fts.Index:
        ix = fts.index(self.tables["chunks"])
        return fts.Index(ix.postings.persist(), ix.lengths.persist(), ix.size)

    def search(self, query: str, limit: int = 20, tag: str | None = None) -> DataFrame:
        hits = fts.search(self.index, query, 2 * limit if tag else limit)
        rows = hits.join(self.tables["chunks"].withColumnRenamed("chunk_id", "id"), "id")
        rows = catalogue.with_tag(rows, self.tables, tag) if tag else rows
        rows = fts.snippets(rows, query).select("id", "doc_id", "title", "breadcrumbs", "snippet", "score")
        return rows.orderBy("score", "id").limit(limit)

    def hybrid(self, query: str, query_vector=None, embeddings=None, limit: int = 10) -> DataFrame:
        return retrieval.hybrid(self.tables["chunks"].drop("doc_id", "ord"), self.index, embeddings, query, query_vector, limit)

    def note(self, name: str) -> dict[str, DataFrame] | None:
        """The document with its sections, its links and the links to it."""
        d = catalogue.lookup(self.tables, name)
        row = d.head()
        if row is None:
            return None
        parts = {"document": d, "backlinks": catalogue.backlinks(self.tables, row["title"])}
        return parts | {n: catalogue.of_document(self.tables, n, row["doc_id"]) for n in ("sections", "links")}

    def backlinks(self, name: str) -> DataFrame:
        return catalogue.backlinks(self.tables, name).orderBy("title", "line_number")

    def neighbours(self, name: str, depth: int = 1) -> DataFrame:
        return graph.hops_from(self.graph, name, depth)

    def unresolved(self) -> DataFrame:
        return catalogue.unresolved_links(self.tables)

    def stats(self) -> DataFrame:
        return catalogue.stats(self.tables)

    def check(self, strict: bool = False) -> DataFrame:
        return diagnostics.lint(self.tables, strict)

    def path(self, source: str, target: str) -> list[str] | None:
        return graph.shortest_path(self.graph, source, target)

    def orphans(self) -> DataFrame:
        return graph.orphans(self.graph)

    def wanted(self) -> DataFrame:
        return graph.wanted(self.graph)

    def graph_rag(self, seeds: list[str], hops: int = rag.DEFAULT_HOPS, paths: int = rag.DEFAULT_PATHS, content: bool = True) -> dict:
        g = rag.build(self.tables)
        return rag.context(g, self.tables, rag.ranks(g), seeds, hops, paths, content)

    def moc(self, topic: str | None = None, root: str | None = None) -> dict[str, str]:
        made = synthesis.pages(self.tables, self.graph, self.ranks, topic)
        return synthesis.write_pages(root, made) if root else made

    def topology(self, config: topology.Config = topology.Config()) -> DataFrame:
        return topology.train(graph.adjacency(self.graph), config)

    def similar(self, name: str, k: int = 10, embeddings: DataFrame | None = None) -> DataFrame:
        return topology.similar(embeddings or self.topology(), self.graph.vertices, name, k)

    def completion(self, text: str) -> DataFrame:
        """label and insert for a line typed so far: titles and aliases after [[, tags after #."""
        t = self.tables
        if "[[" in text and "]]" not in text.rpartition("[[")[2]:
            start = text.rpartition("[[")[2].lower()
            titles = t["documents"].select(F.col("title").alias("label"), F.col("title").alias("insert"))
            aliases = t["documents"].select(F.explode("aliases").alias("label"), "title").select("label", F.concat_ws("|", "title", "label").alias("insert"))
            return titles.unionByName(aliases).filter(F.lower("label").startswith(start)).orderBy("label", "insert")
        if "#" in text and not text.rpartition("#")[2].count(" "):
            start = text.rpartition("#")[2].lower()
            return t["tags"].select(F.col("tag").alias("label"), F.col("tag").alias("insert")).distinct().filter(F.lower("label").startswith(start)).orderBy("label")
        return self.spark.createDataFrame([], "label string, insert string")

    def definition(self, name: str, heading: str | None = None) -> dict | None:
        """path and line (from 0) of a note, or of a heading in it."""
        d = catalogue.lookup(self.tables, name).head()
        if d is None:
            return None
        s = self.tables["sections"].filter((F.col("doc_id") == d["doc_id"]) & (F.lower("heading") == (heading or "").lower())).orderBy("ord").head() if heading else None
        return {"path": d["path"], "line": s["line_start"] - 1 if s else 0}

    def hover(self, name: str, heading: str | None = None) -> str | None:
        d = catalogue.lookup(self.tables, name).head()
        if d is None:
            return None
        s = self.tables["sections"].filter(F.col("doc_id") == d["doc_id"])
        row = (s.filter(F.lower("heading") == heading.lower()) if heading else s).orderBy("ord").head()
        return (row["content"] if heading else row["content"][:800]) if row else None

    def graph_stats(self) -> dict:
        """Counts of notes, wanted notes, links, orphans, and the ten notes of the highest rank."""
        g = self.graph
        kinds = {r["node_type"]: r["n"] for r in g.vertices.groupBy("node_type").agg(F.count("*").alias("n")).collect()}
        top = self.ranks.join(g.vertices.select("id", "title"), "id").orderBy(F.desc("pagerank"), "title").limit(10).select("title", F.round("pagerank", 6).alias("pagerank"))
        return {"documents": kinds.get("document", 0), "dangling": kinds.get("dangling", 0), "links": g.edges.count(), "orphans": self.orphans().count(), "top": json_rows(top)}

    def d3(self) -> str:
        """The graph as JSON for a force-directed view; as large as the graph."""
        nodes, links = graph.export(self.graph, self.ranks)
        return json.dumps({"nodes": [json.loads(x) for x in nodes.toJSON().collect()], "links": [json.loads(x) for x in links.toJSON().collect()]})


def json_rows(df: DataFrame) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().collect()]
