"""Sources: folders of notes, event streams, and a vault rendered from relational tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Beside folders whose names start with a dot.
NOT_NOTES = ("node_modules",)


def rule_pattern(rule: str) -> tuple[str, bool] | None:
    """A line of an ignore file as a regular expression on relative paths, and whether it takes files out (else back in)."""
    rule = rule.rstrip()
    if not rule or rule.startswith("#"):
        return None
    out, rule = not rule.startswith("!"), rule.removeprefix("!").removeprefix("\\")
    folder, rule = rule.endswith("/"), rule.rstrip("/")
    anchored, rule = "/" in rule, rule.lstrip("/")
    pieces = re.split(r"(\*\*/|/\*\*$|\*|\?)", rule)
    said = {"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}
    body = "".join(said.get(x) or re.escape(x) for x in pieces)
    return ("^" if anchored else "(?:^|/)") + body + ("/" if folder else "(?:/|$)"), out


def ignored(spark: SparkSession, root: str, path: Column) -> Column:
    """Whether the ignore file at the root takes a path out: the last rule that fits decides."""
    jvm, out = spark.sparkContext._jvm, F.lit(False)
    file = jvm.org.apache.hadoop.fs.Path(root, ".gitignore")  # Spark's readers pass over hidden files
    fs = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(file):
        return out
    stream = fs.open(file)
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    for pattern, takes_out in filter(None, map(rule_pattern, text.splitlines())):
        out = F.when(path.rlike(pattern), takes_out).otherwise(out)
    return out


def files(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), mtime (ms), file_size, content of the Markdown files below root, of any size, that aren't hidden and
    that the root's .gitignore leaves in."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    base = re.sub("^file:/*", "/", root.rstrip("/")) if root.startswith("file:") else root.rstrip("/")
    decoded = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    relative = F.substr(decoded, F.locate(base + "/", decoded) + F.lit(len(base) + 1))
    seen = raw.select(relative.alias("path"), F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("file_size"), F.decode("content", "UTF-8").alias("content"))
    return seen.filter(~F.col("path").rlike(r"(^|/)\.") & ~ignored(spark, root, F.col("path")))


def is_watched(path: str = "path") -> Column:
    """Markdown by its ending, in no folder that is hidden or holds no notes."""
    folders = F.split(F.regexp_extract(path, "^(.*)/[^/]*$", 1), "/")
    return F.lower(F.col(path)).rlike(r"\.(md|markdown)$") & ~F.exists(folders, lambda f: f.startswith(".") | f.isin(*NOT_NOTES))


def demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content of one note for each part and supplier. A part links to the suppliers of its line items (by a
    wikilink, an embed or a Markdown link, by line number) and to parts numbered like their orders, most of which don't
    exist; a supplier links to its nation, which has no note. A region's note has no links, but a preamble and a fence; a
    nation's log links to a heading, a block, an embed and a file that aren't there."""
    part, supplier, item, region, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "supplier", "lineitem", "region", "nation"))
    # numbers are dealt out by their part once, and become text where they are grouped
    items = item.select(F.col("l_partkey").alias("p_partkey"), "l_suppkey", "l_orderkey", (F.col("l_linenumber") % 3).alias("kind")).repartition("p_partkey")
    name, kind = F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")), F.col("kind")
    link = F.when(kind == 0, F.concat(F.lit("[["), name, F.lit("]]"))).when(kind == 1, F.concat(F.lit("![["), name, F.lit("]]")))
    link = link.otherwise(F.concat(F.lit("[see]("), name, F.lit(".md)")))
    line = F.concat(F.lit("- "), link, F.lit(" for [[Part "), F.col("l_orderkey").cast("string"), F.lit("]]"))
    lines = items.select("p_partkey", line.alias("line")).groupBy("p_partkey").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("lines"))
    key = F.col("p_partkey").cast("string")
    head = F.concat(
        F.lit("---\ntitle: Part "), key, F.lit("\naliases: [P"), key, F.lit("]\ntags: [brand/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))),
        F.lit(", type/"), F.lower("p_type"), F.lit("]\n---\n# Part "), key, F.lit("\n"), F.col("p_name"), F.lit(" [size:: "), F.col("p_size").cast("string"),
        F.lit("]\n\n## Supply\n"), F.coalesce("lines", F.lit("none")), F.lit("\n"),
    )
    parts = part.join(lines, "p_partkey", "left").select(F.concat(F.lit("Part "), key, F.lit(".md")).alias("path"), head.alias("content"))
    own = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("# Supplier "), own, F.lit("\nOf [[Nation "), F.col("s_nationkey").cast("string"), F.lit("]]. #supplier\n"))
    suppliers = supplier.select(F.concat(F.lit("Supplier "), own, F.lit(".md")).alias("path"), text.alias("content"))
    own = F.col("r_regionkey").cast("string")
    text = F.concat(F.lit("Before it: none.\n\n```\n# No heading\n[[No link]] #none\n```\n\n# Region "), own, F.lit("\n"), F.col("r_name"), F.lit(" `[[No link]]`\n"))
    regions = region.select(F.concat(F.lit("Region "), own, F.lit(".md")).alias("path"), text.alias("content"))
    own = F.col("n_nationkey").cast("string")
    text = F.concat(F.lit("# Log "), own, F.lit("\n[[Part 1#Suply]] and [[Part 1#^none]]\n![[Lost "), own, F.lit("]] [x](Missing "), own, F.lit(".md)\n"))
    logs = nation.select(F.concat(F.lit("Log "), own, F.lit(".md")).alias("path"), text.alias("content"))
    return parts.unionByName(suppliers).unionByName(regions).unionByName(logs)


def file_events(spark: SparkSession, path: str, schema: str = "path string, kind string, ts timestamp") -> DataFrame:
    """A stream of file events from a folder of JSON lines."""
    return spark.readStream.schema(schema).json(path)
