"""Queries over the note tables, and the writes that keep them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import markdown

Tables = dict[str, DataFrame]
#: Child tables and the column that names their document.
OWNER = {"sections": "doc_id", "links": "source_doc_id", "tags": "doc_id", "attributes": "doc_id", "chunks": "doc_id", "block_ids": "doc_id"}


def documents(t: Tables) -> DataFrame:
    return t["documents"].orderBy("title", "doc_id")


def paths(t: Tables) -> DataFrame:
    return t["documents"].select("path").orderBy("path")


def of_document(t: Tables, name: str, doc_id: str) -> DataFrame:
    """Chunks, sections or links of a document in the order of its lines."""
    order = ("line_number", "ord") if name in ("links", "tags") else ("line_start", "ord")
    return t[name].filter(F.col(OWNER[name]) == doc_id).orderBy(*order)


def lookup(t: Tables, query: str) -> DataFrame:
    """The document with that id, else path, else title (case aside)."""
    d, q = t["documents"], F.lit(query)
    rank = F.when(F.col("doc_id") == q, 0).when(F.col("path") == q, 1).when(F.lower("title") == F.lower(q), 2)
    return d.withColumn("rank", rank).filter("rank is not null").orderBy("rank", "doc_id").limit(1).drop("rank")


def backlinks(t: Tables, target: str | None = None) -> DataFrame:
    """target (lower case), title and path of the linking note, line, snippet and type of each link to it; of all targets
    without one."""
    links = t["links"].withColumn("target", F.lower("target_note"))
    links = links.filter(F.col("target") == target.lower()) if target else links
    d = t["documents"].select(F.col("doc_id").alias("source_doc_id"), "title", "path")
    return links.join(d, "source_doc_id").select("target", "title", "path", "line_number", "context_snippet", "link_type")


def _missing(t: Tables) -> DataFrame:
    d = t["documents"]
    links = t["links"].join(d.select(F.col("title").alias("target_note")), "target_note", "left_anti")
    return links.join(d.select(F.col("path").alias("target_note")), "target_note", "left_anti")


def unresolved_links(t: Tables) -> DataFrame:
    """Targets that are no title and no path: how many notes link there, and which."""
    d = t["documents"].select(F.col("doc_id").alias("source_doc_id"), "title")
    grouped = _missing(t).join(d, "source_doc_id").groupBy(F.lower("target_note").alias("target_key"))
    found = grouped.agg(F.min("target_note").alias("target_note"), F.countDistinct("source_doc_id").alias("ref_count"), F.array_sort(F.collect_set("title")).alias("sources"))
    return found.orderBy(F.desc("ref_count"), "target_note")


def orphan_notes(t: Tables) -> DataFrame:
    """Notes without links out, and linked to by neither title nor path."""
    d, links = t["documents"], t["links"]
    out = d.join(links.select(F.col("source_doc_id").alias("doc_id")), "doc_id", "left_anti")
    out = out.join(links.select(F.lower("target_note").alias("k")), F.lower("title") == F.col("k"), "left_anti")
    return out.join(links.select(F.col("target_note").alias("path")), "path", "left_anti").select("doc_id", "title", "path")


def stats(t: Tables) -> DataFrame:
    """One row: how many documents, sections, links, tags and chunks, and words in all."""
    counts = [t[n].agg(F.count("*").alias(n)) for n in ("documents", "sections", "links", "tags", "chunks")]
    out = t["documents"].agg(F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"))
    for c in counts:
        out = out.crossJoin(c)  # one row each
    return out


def tag_counts(t: Tables) -> DataFrame:
    """Different documents of each tag."""
    return t["tags"].groupBy(F.regexp_replace("tag", "^#", "").alias("tag")).agg(F.countDistinct("doc_id").alias("n_docs"))


def tags(t: Tables) -> DataFrame:
    return t["tags"].select("tag").distinct().orderBy("tag")


def with_tag(hits: DataFrame, t: Tables, tag: str) -> DataFrame:
    """Hits whose document has the tag."""
    has = t["tags"].filter(F.col("tag").isin(tag, f"#{tag}")).select("doc_id").distinct()
    return hits.join(has, "doc_id", "left_semi")


def title_has(hits: DataFrame, text: str) -> DataFrame:
    return hits.filter(F.lower("title").contains(text.lower()))


def changes(files: DataFrame, manifest: DataFrame, full: bool = False) -> DataFrame:
    """path and action (insert, update, delete, unchanged) of files (path, mtime, file_size, hash) against the manifest. Equal
    time and size count as unchanged, and so does an equal hash."""
    m = manifest.select("path", F.col("mtime").alias("m_mtime"), F.col("file_size").alias("m_size"), F.col("hash").alias("m_hash"))
    same = (F.col("mtime") == F.col("m_mtime")) & (F.col("file_size") == F.col("m_size")) | (F.col("hash") == F.col("m_hash"))
    same = F.lit(False) if full else same
    action = F.when(F.col("m_hash").isNull(), "insert").when(F.col("hash").isNull(), "delete").when(same, "unchanged").otherwise("update")
    return files.join(m, "path", "full_outer").select("path", action.alias("action"))


def without_documents(t: Tables, gone: DataFrame) -> Tables:
    """All tables without the documents in gone (doc_id): children go with their document."""
    gone = gone.select("doc_id").distinct()
    out = {"documents": t["documents"].join(gone, "doc_id", "left_anti")}
    for name, owner in OWNER.items():
        out[name] = t[name].join(gone.withColumnRenamed("doc_id", owner), owner, "left_anti").select(t[name].columns)
    return out


def upserted(t: Tables, new: Tables) -> Tables:
    """t with the documents of new in place of their old versions."""
    left = without_documents(t, new["documents"])
    return {name: left[name].unionByName(new[name].select(left[name].columns)) for name in left}


def purged(t: Tables, active: DataFrame) -> Tables:
    """Without documents whose path isn't among the active ones."""
    return without_documents(t, t["documents"].join(active.select("path"), "path", "left_anti"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def bucket(doc_id: str = "doc_id", buckets: int = 256) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")


def save(t: Tables, root: str, buckets: int = 256) -> None:
    """Each table under root, by bucket of its document: a later save of some documents' buckets overwrites those only."""
    for name, df in t.items():
        owner = OWNER.get(name, "doc_id")
        out = df.withColumn("doc_bucket", bucket(owner, buckets)).repartition("doc_bucket")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_bucket").parquet(f"{root}/{name}")


def load(spark, root: str) -> Tables:
    """The saved tables; one without a row has no file to tell its columns."""
    empty = markdown.tables(spark.createDataFrame([], markdown.PARSED))
    return {name: spark.read.schema(df.withColumn("doc_bucket", F.lit(0)).schema).parquet(f"{root}/{name}").select(df.columns) for name, df in empty.items()}
