"""Scalar functions as column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the query-intent rules.
CODE_PARTS = ("::", "->", "()", "_")
CODE_STARTS = ("#", "fn ", "struct ", "class ", "impl ", "enum ", "trait ", "interface ", "type ", "def ", "let ")
CODE_ENDS = (".rs", ".md", ".ts", ".py")
QUESTION_WORDS = ("how", "why", "what", "where", "when", "explain", "describe", "difference")
INTENT_WEIGHTS = {"code": (0.85, 0.15), "natural_language": (0.20, 0.80), "balanced": (0.50, 0.50)}

# Fixed values of the rerank rules.
TITLE_EXACT, TITLE_PARTIAL, HEADING_END, HEADING_PART, TAG_MATCH, RANK_SHARE, BOOST_CAP = 2.5, 1.6, 2.0, 1.3, 1.5, 0.2, 5.0
RRF_K = 60
#: Files over this size are not read.
MAX_BYTES = 10 * 1024 * 1024


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def word_count(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).cast("bigint")


def slugify(text: Column) -> Column:
    """Lower case; every run of other than letters and numbers becomes one dash; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")


def block_id(line: Column) -> Column:
    """The block id that ends a line after its last caret, or null."""
    found = F.regexp_extract(line, r"\^\s*([\p{L}\p{N}_-]+)\s*$", 1)
    return F.when(found != "", found)


def fts_query(text: Column) -> Column:
    """Each word, bare of punctuation at its ends, as a quoted prefix; joined by OR."""
    words = F.transform(F.split(text, r"(?U)\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}_-]+|[^\p{L}\p{N}_-]+$", ""))
    kept = F.filter(words, lambda w: w != "")
    return F.array_join(F.transform(kept, lambda w: F.concat(F.lit('"'), w, F.lit('"*'))), " OR ")


def query_intent(query: Column) -> Column:
    """code, natural_language or balanced."""
    q = F.regexp_replace(query, r"(?U)^\s+|\s+$", "")
    low = F.lower(q)
    code = _any([q.contains(p) for p in CODE_PARTS] + [q.startswith(p) for p in CODE_STARTS] + [q.endswith(p) for p in CODE_ENDS] + [q.startswith('"') & q.endswith('"')])
    words = F.filter(F.split(low, r"(?U)\s+"), lambda w: w != "")
    asks = low.endswith("?") | F.arrays_overlap(words, F.array(*map(F.lit, QUESTION_WORDS))) | (F.size(words) >= 5)
    return F.when(code, "code").when(asks, "natural_language").otherwise("balanced")


def intent_weights(query: Column) -> tuple[Column, Column]:
    """Weights of the BM25 and of the vector ranks."""
    intent = query_intent(query)
    pick = lambda k: F.coalesce(*(F.when(intent == name, w[k]) for name, w in INTENT_WEIGHTS.items()))
    return pick(0), pick(1)


def _stripped(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def rerank_boost(query: Column, title: Column, breadcrumbs: Column, tags: Column, pagerank: Column) -> Column:
    """Product of the title, heading, tag and rank boosts, BOOST_CAP at most."""
    q, t, b = _stripped(query), _stripped(title), _stripped(breadcrumbs)
    by_title = F.when(t == q, TITLE_EXACT).when(t.contains(q) | q.contains(t), TITLE_PARTIAL).otherwise(1.0)
    by_heading = F.when(b.endswith(q), HEADING_END).when(b.contains(q), HEADING_PART).otherwise(1.0)
    by_tag = F.when(F.exists(tags, lambda x: q.contains(F.lower(F.regexp_replace(x, "^#+", "")))), TAG_MATCH).otherwise(1.0)
    by_rank = 1.0 + RANK_SHARE * F.least(F.greatest(pagerank, F.lit(0.0)), F.lit(1.0))
    return F.least(by_title * by_heading * by_tag * by_rank, F.lit(BOOST_CAP))


def rrf_term(rank: Column, weight: Column | float = 1.0) -> Column:
    """weight / (60 + rank); 0 without a rank."""
    return F.coalesce((F.lit(weight) if isinstance(weight, float) else weight) / (F.lit(float(RRF_K)) + rank), F.lit(0.0))


def normalized_tag(tag: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(tag), "^#+", ""))


def topic_title(topic: Column) -> Column:
    """Three letters at most go to upper case; else each part of the path gets a capital and parts are joined by ` - `."""
    parts = F.transform(F.split(topic, "/"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000)))
    named = F.when(topic.rlike(r"^\p{L}{1,3}$"), F.upper(topic)).otherwise(F.array_join(parts, " - "))
    return F.regexp_replace(named, r"[/\\:]", "-")


def escape_html(text: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("/", "&#x2F;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def is_safe_url(url: Column) -> Column:
    """False for script-like and file schemes; true for http(s), mailto://, a fragment, or no scheme at all."""
    bare = F.lower(F.regexp_replace(url, r"[\s\p{Cntrl}]", ""))
    bad = _any(bare.startswith(s) for s in ("javascript:", "vbscript:", "file:", "data:"))
    good = _any(bare.startswith(s) for s in ("http://", "https://", "mailto://", "#")) | ~bare.contains(":")
    return ~bad & good


def script_safe_json(json: Column) -> Column:
    for plain, escaped in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        json = F.replace(json, F.lit(plain), F.lit(escaped))
    return json


def lexical_path(path: Column) -> Column:
    """A struct of the path without `.` and `..` steps, and error: null_byte, absolute, drive or escape, else null."""
    unix = F.replace(path, F.lit("\\"), F.lit("/"))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("out"))

    def step(acc, part):
        up = F.slice(acc["parts"], 1, F.greatest(F.size(acc["parts"]) - 1, F.lit(0)))
        return F.struct(
            F.when(part.isin("", "."), acc["parts"]).when(part == "..", up).otherwise(F.concat(acc["parts"], F.array(part))).alias("parts"),
            (acc["out"] | ((part == "..") & (F.size(acc["parts"]) == 0))).alias("out"),
        )

    walked = F.aggregate(F.split(unix, "/"), start, step)
    error = (
        F.when(path.contains("\x00"), "null_byte")
        .when(unix.startswith("/"), "absolute")
        .when(unix.rlike("^[A-Za-z]:"), "drive")
        .when(walked["out"], "escape")
    )
    return F.struct(F.when(error.isNull(), F.array_join(walked["parts"], "/")).alias("path"), error.alias("error"))


def within_size(n_bytes: Column) -> Column:
    return n_bytes <= MAX_BYTES


def linear_path(titles: Column, relations: Column) -> Column:
    """[[A]] --[rel]--> [[B]] ..."""
    steps = F.transform(titles, lambda t, i: F.concat(F.when(i > 0, F.concat(F.lit(" --["), F.get(relations, i - 1), F.lit("]--> "))).otherwise(""), F.lit("[["), t, F.lit("]]")))
    return F.array_join(steps, "")


def node_radius(pagerank: Column, dangling: Column) -> Column:
    return F.when(dangling, 5.0).otherwise(F.least(6.0 + 18.0 * pagerank, F.lit(24.0)))


def register(spark) -> None:
    """Named SQL functions for the expressions that need one argument."""
    from . import fuzzy

    for name, body in {
        "ng_slugify": "regexp_replace(regexp_replace(lower(s), '[^\\\\p{L}\\\\p{N}]+', '-'), '^-|-$', '')",
        "ng_tag": "lower(regexp_replace(trim(s), '^#+', ''))",
    }.items():
        spark.sql(f"create or replace temporary function {name}(s string) returns string return {body}")
    spark.udf.register("ng_osa", fuzzy.osa_column)
