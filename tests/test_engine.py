"""The engine over small vaults; expected values come from the behaviour to match."""

import io
import json
import random
import re
import sqlite3
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from notegrove import index, lsp, tools
from notegrove.engine import VaultEngine
from notegrove.functions import fuzzy, security
from notegrove.functions import text as fx
from notegrove.operators import catalogue, diagnostics, fts, graph, markdown, rag, synthesis, topology, vectors
from notegrove.plans import catalogue as queries
from notegrove.sources import vault
from notegrove.streaming import watch

NOTES = {
    "Alpha.md": "---\ntitle: Alpha\naliases: [First]\ntags: [ai/ml, cs]\nstatus: active\n---\n# Alpha\nSee [[Beta]] and [[Gamma#Parts]].\n\n## Parts\n`[[Masked]]` #inline ![[Beta]] [go](sub/Delta.md) size:: big\nRef ^blk-1\n",
    "Beta.md": "# Beta\nrunning runner to [[Gamma]]. [[Gama]] [[Alpha#Nope]] [[Alpha^missing]] #ai/ml\n",
    "Gamma.md": "# Gamma\nnothing here\n## Parts\nmore [[Unwritten]] [[Unwritten]]\n",
    "sub/Delta.md": "lonely words in [[First]]\n",
    "Lone.md": "# Lone\nby itself\n",
}


@pytest.fixture(scope="module")
def engine(spark):
    return VaultEngine(spark, spark.createDataFrame([*NOTES.items()], "path string, content string"))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_parse_note():
    r = markdown.parse_note("Alpha.md", NOTES["Alpha.md"])
    assert r["title"] == "Alpha" and r["aliases"] == ["First"]
    assert json.loads(r["frontmatter_json"])["extra"] == {"status": "active"}
    assert [(s["level"], s["breadcrumbs"]) for s in r["sections"]] == [(1, ["Alpha"]), (2, ["Alpha", "Parts"])]
    assert [(x["link_type"], x["target_note"], x["target_heading"]) for x in r["links"]] == [
        ("wikilink", "Beta", None), ("wikilink", "Gamma", "Parts"), ("embed", "Beta", None), ("markdown", "sub/Delta", None)]
    assert [t["tag"] for t in r["tags"]] == ["ai/ml", "cs", "inline"] and r["block_ids"] == ["blk-1"]
    assert [(a["key"], a["value"]) for a in r["attributes"]] == [("size", "big")]
    assert r["links"][0]["line_number"] == 8


def test_breadcrumbs_pop():
    r = markdown.parse_note("x.md", "# A\n## B\n### C\n## D\n")
    assert [s["breadcrumbs"] for s in r["sections"]] == [["A"], ["A", "B"], ["A", "B", "C"], ["A", "D"]]
    assert [s["level"] for s in r["sections"]] == [1, 2, 3, 2]


def test_code_hides_links_and_tags():
    r = markdown.parse_note("x.md", "#valid-tag\n```python\n# not [[a]] #fake\n```\n[[Real]] #second-tag $x #no$\n")
    assert [x["target_note"] for x in r["links"]] == ["Real"] and [t["tag"] for t in r["tags"]] == ["valid-tag", "second-tag"]


def test_block_links_and_bad_yaml():
    r = markdown.parse_note("x.md", "[[MyNote#^block-abc|Custom Label]] [Relative](subfolder/target.md)")
    assert (r["links"][0]["target_block"], r["links"][0]["alias"]) == ("block-abc", "Custom Label")
    assert r["links"][1]["target_note"] == "subfolder/target"
    assert markdown.frontmatter("---\na: [1\n---\nbody")[2] == 0


def test_chunks_of_long_sections():
    paragraphs = [" ".join(["w"] * 200) for _ in range(4)]
    r = markdown.parse_note("x.md", "# H\n\n" + "\n\n".join(paragraphs))
    assert [len(c["content"].split()) for c in r["chunks"]] == [202, 200, 200, 200]
    assert [c["chunk_id"] for c in r["chunks"]] == [f"x-md::0::{k}" for k in range(4)]


def test_catalogue(engine):
    t = engine.tables
    assert engine.stats().head().asDict() == {"words": engine.stats().head()["words"], "documents": 5, "sections": 7, "links": 11, "tags": 4, "chunks": 7}
    assert rows(engine.backlinks("beta"), "title", "link_type") == [("Alpha", "embed"), ("Alpha", "wikilink")]
    found = {r["target_note"]: (r["ref_count"], r["sources"]) for r in engine.unresolved().collect()}
    assert found["Unwritten"] == (1, ["Gamma"]) and found["First"] == (1, ["Delta"]) and "Beta" not in found
    assert rows(catalogue.orphan_notes(t), "title") == [("Lone",)]
    assert rows(catalogue.tag_counts(t), "tag", "n_docs") == [("ai/ml", 2), ("cs", 1), ("inline", 1)]
    assert catalogue.lookup(t, "alpha").head()["path"] == "Alpha.md"
    note = engine.note("Alpha")
    assert note["sections"].count() == 2 and note["links"].count() == 4 and note["backlinks"].count() == 2


def test_upsert_and_delete(spark, engine, tmp_path):
    new = VaultEngine(spark, spark.createDataFrame([("Beta.md", "# Beta\n[[Alpha]]")], "path string, content string")).tables
    t = catalogue.upserted(engine.tables, new)
    assert t["documents"].count() == 5 and rows(t["links"].filter("source_doc_id = 'Beta.md'"), "target_note") == [("Alpha",)]
    assert catalogue.purged(t, spark.createDataFrame([("Beta.md",)], "path string"))["links"].count() == 1
    catalogue.save(t, str(tmp_path / "v"), 4)
    assert catalogue.load(spark, str(tmp_path / "v"))["sections"].count() == t["sections"].count()


def test_long_notes_are_indexed(spark, tmp_path):
    long = "# Long\n" + "word " * (2 * 2**20 + 2**18) + "\n[[Short]]\n"
    (tmp_path / "Long.md").write_text(long)
    (tmp_path / "Short.md").write_text("# Short\n")
    e = VaultEngine.open(spark, str(tmp_path))
    assert len(long) > 10 * 2**20 and {r["path"]: r["file_size"] for r in e.notes.drop("content").collect()} == {"Long.md": len(long), "Short.md": 8}
    assert rows(e.backlinks("Short"), "title") == [("Long",)]


def test_changes(spark):
    s = "path string, mtime long, file_size long, hash string"
    files = spark.createDataFrame([("a", 1, 1, "x"), ("b", 2, 1, "y"), ("c", 5, 5, "z"), ("d", 9, 9, "same")], s)
    old = spark.createDataFrame([("a", 1, 1, "old"), ("b", 1, 1, "w"), ("d", 1, 1, "same"), ("e", 1, 1, "q")], s)
    assert rows(catalogue.changes(files, old), "path", "action") == [("a", "unchanged"), ("b", "update"), ("c", "insert"), ("d", "unchanged"), ("e", "delete")]


def test_graph(engine):
    g = engine.graph
    d = {r["title"]: (r["in_degree"], r["out_degree"]) for r in graph.degrees(g).collect()}
    assert d["Beta"] == (2, 4) and d["Unwritten"] == (2, 0) and d["Delta"] == (1, 1) and d["Lone"] == (0, 0)
    assert engine.path("Alpha", "Unwritten") == ["Alpha", "Gamma", "Unwritten"]
    assert engine.path("Alpha", "Lone") is None and engine.path("Lone", "Lone") == ["Lone"]
    assert rows(engine.wanted(), "title", "ref_count") == [("Gama", 1), ("Unwritten", 2)]
    assert rows(engine.orphans(), "title") == [("Lone",)]
    assert rows(graph.hops_from(g, "Alpha", 1), "id", "hops")[0] == ("Alpha.md", 0)


def test_ways_longer_than_64_links(spark):
    n = 67
    names = [f"n{k:03}" for k in range(n)]
    e = spark.createDataFrame([*zip(names, names[1:], strict=False)], "src string, dst string").coalesce(1)
    vertices = spark.createDataFrame([(x, x) for x in names], "id string, title string").coalesce(1)
    assert graph.shortest_path(graph.Graph(vertices, e), names[0], names[-1]) == names
    costs = e.withColumn("relation", F.lit("wikilink")).withColumn("cost", F.lit(1.0))
    # a dear short way, so that its end gets cheaper only in the last round
    costs = costs.unionByName(spark.createDataFrame([(names[0], names[-1], "wikilink", 100.0)], costs.schema))
    tree = rag.steiner_tree(rag.ContextGraph(vertices, costs), [names[0], names[-1]])
    assert tree["nodes"] == names and tree["cost"] == n - 1 and len(tree["edges"]) == n - 1


def test_pagerank_by_brute_force(engine):
    g = engine.graph
    ids = sorted(r["id"] for r in g.vertices.collect())
    edges = [(ids.index(r["src"]), ids.index(r["dst"])) for r in g.edges.collect()]
    n = len(ids)
    rank, out = np.full(n, 1 / n), np.bincount([a for a, _ in edges], minlength=n)
    for _ in range(30):
        new = np.full(n, 0.15 / n + 0.85 * rank[out == 0].sum() / n)
        for a, b in edges:
            new[b] += 0.85 * rank[a] / out[a]
        rank = new
    want = (rank - rank.min()) / max(rank.max() - rank.min(), 1e-6)
    got = {r["id"]: r["pagerank"] for r in engine.ranks.collect()}
    assert np.allclose([got[i] for i in ids], want, atol=1e-9)


def test_fts_scores_match_sqlite(spark):
    texts = ["the running runner runs", "a runner in the café", "nothing to see here", "cafe culture and running shoes", "runner runner runner"]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(title, content, tokenize='porter unicode61 remove_diacritics 2')")
    db.executemany("insert into f values (?, ?)", [(f"t{i}", t) for i, t in enumerate(texts)])
    ix = fts.index(spark.createDataFrame([(f"t{i}", f"t{i}", t) for i, t in enumerate(texts)], "id string, title string, content string"), "id", ("title", "content"))
    for q in ("runner", "cafe", "running OR culture", "runner NOT cafe", '"running shoes"', "cult*", "runner AND cafe"):
        want = dict(db.execute("select title, bm25(f, 2.0, 1.0) from f where f match ?", (q,)).fetchall())
        got = {r["id"]: r["score"] for r in fts.search(ix, q).collect()}
        assert got.keys() == want.keys(), q
        if "*" not in q and "NOT" not in q and '"' not in q:
            assert all(abs(got[k] - want[k]) < 1e-6 for k in want), (q, got, want)


def test_search_takes_any_text(engine):
    for q in ("a()", '"', "AND OR NOT", "(((", "", "Gamma -x ::"):
        engine.search(q).collect()
    assert "<b>runner</b>" in engine.search("runner").head()["snippet"]


def test_vectors(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(300, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    q = v.filter("vec_id < 20").withColumnRenamed("vec_id", "query_id")
    exact = vectors.top_k(v, q, 10)
    want = {(i, int(j)) for i in range(20) for j in np.argsort(-(x @ x[i]))[:10]}
    assert {(r["query_id"], r["vec_id"]) for r in exact.collect()} == want
    for found, least in ((vectors.top_k(v, q, 10, quantised=True), 0.95), (vectors.hnsw_top_k(v, q, 10, rows_each=150), 0.85)):
        assert vectors.recall(found, exact).agg(F.avg("recall")).first()[0] >= least
    s = v.select("vec_id", vectors.sq8(F.col("embedding")).alias("s"), "embedding")
    err = s.select(F.abs(vectors.sq8_to_vector(F.col("s"), F.col("embedding")) - 1).alias("e")).agg(F.max("e")).first()[0]
    assert err < 0.005
    zero = spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(vectors.sq8(F.col("v")).alias("s")).head()["s"]
    assert list(zero["data"]) == [0, 0] and zero["inv_norm"] == 1.0


def test_embedding_reads_whole_texts(spark):
    texts = [(0, "same " * 600), (1, "same " * 600 + "other " * 900), (2, "other")]
    e = {r["k"]: np.array(r["embedding"]) for r in vectors.embedded(spark.createDataFrame(texts, "k int, t string"), "k", "t").collect()}
    assert e[1] @ e[2] > 0.8 > e[0] @ e[2]


def test_osa_and_suggestions(spark):
    assert [fuzzy.osa(*p) for p in (("ca", "abc"), ("ab", "ba"), ("Machne", "machine"), ("", "ab"))] == [3, 1, 1, 2]
    rng = random.Random(3)
    names = ["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 14))).strip() or "z" for _ in range(160)]
    asked, known = names[:60], names[60:]
    got = {r["name"]: r["suggested"] for r in diagnostics.suggestions(*(spark.createDataFrame([(n,) for n in x], "name string") for x in (asked, known))).collect()}
    for a in set(asked):
        fit = {k for k in known if k.lower() != a.lower() and fuzzy.osa(a, k) <= fuzzy.allowed(len(a)) and 1 - fuzzy.osa(a, k) / max(len(a), len(k)) >= 0.6}
        order = sorted(fit, key=lambda k: (fuzzy.osa(a, k), -(1 - fuzzy.osa(a, k) / max(len(a), len(k))), k))
        assert got.get(a, []) == order[:3], a


def test_lint(engine):
    found = {(r["code"], r["target"]): r for r in engine.check().collect()}
    assert found["W001", "Gama"]["suggested"] == ["[[Gamma]]"]
    assert ("W002", "Alpha#Nope") in found and ("W003", "Alpha#^missing") in found and ("W001", "Unwritten") in found
    assert len(found) == 4 and diagnostics.exit_code(engine.check(True), True) == 1
    assert {r["severity"] for r in engine.check(True).collect()} == {"error", "warning"}


def test_rag(spark):
    notes = {"A.md": "[[B]] [[C]]", "B.md": "[[D]]", "C.md": "[[D]]", "D.md": "end"}
    e = VaultEngine(spark, spark.createDataFrame([*notes.items()], "path string, content string"))
    out = e.graph_rag(["A", "D"])
    page = out["markdown"]
    assert "## Connective Reasoning Paths\n1. `[[A]] --[wikilink]--> [[B]] --[wikilink]--> [[D]]`" in page and "- **Seed Concepts**: [[A]], [[D]]\n- **Steiner Bridge Concepts**: [[B]]\n- **Steiner Tree Weight**: 2.00\n" in page
    assert "### [[D]]\n- **File**: `D.md`\n- **Centrality (PageRank)**: " in page and "```markdown\nend\n```" in page
    assert rag.to_markdown(["A"], [], {"nodes": [], "edges": [], "cost": 0.0}, []).count("*No multi-hop") == 1
    assert out["paths"][0]["titles"] in (["A", "B", "D"], ["A", "C", "D"])
    assert out["tree"]["nodes"] == ["A.md", "B.md", "D.md"] and out["tree"]["cost"] == pytest.approx(2.0)
    g = rag.build(e.tables)
    assert rag.simple_paths(g, "A.md", "D.md", 3, 10).count() == 2


def test_context_queries_take_tags(spark, monkeypatch):
    vault_of(spark, monkeypatch, {"Part 1.md": "#x [[Supplier 1]]", "Part 2.md": "#x #y", "Part 3.md": "#y", "Supplier 1.md": "end"})
    tree = {(r["src"], r["dst"], r["relation"], r["cost"]) for r in queries.g17_steiner_tree(spark, "").collect()}
    assert tree == {("Supplier 1.md", "Part 1.md", "backlink", 1.3), ("Part 1.md", "Part 2.md", "tag:x", 1.5)}
    assert tuple(queries.g15_context_paths(spark, "").head()) == (3, 1) and tuple(queries.g15_radial_paths(spark, "").head()) == (1, 1)
    found = rag.simple_paths(rag.build(queries._vault(spark, "")), "Part 1.md", None, 2, None, ("backlink",))
    assert rows(found, "ids") == [(["Part 1.md", "Part 2.md"],), (["Part 1.md", "Part 2.md", "Part 3.md"],), (["Part 1.md", "Supplier 1.md"],)]


def test_node2vec(spark):
    notes = {"Rust.md": "[[Cargo]] [[Memory Safety]]", "Cargo.md": "[[Rust]] [[Memory Safety]]", "Memory Safety.md": "[[Rust]]", "Cooking.md": "[[Pasta]]", "Pasta.md": "[[Cooking]]"}
    e = VaultEngine(spark, spark.createDataFrame([*notes.items()], "path string, content string"))
    config = topology.Config(dimensions=16, walks=10, walk_length=10, epochs=20, rate=0.05)
    assert e.similar("[[Rust]]", 1, e.topology(config)).head()["title"] in ("Cargo", "Memory Safety")
    w = topology.walks(graph.adjacency(e.graph), topology.Config(p=0.5, q=2.0, walk_length=6, walks=2))
    edges = {(r["u"], r["v"]) for r in graph.adjacency(e.graph).collect()}
    assert w.count() == 10 and all((a, b) in edges for r in w.collect() for a, b in zip(r["nodes"], r["nodes"][1:], strict=False))


def vault_of(spark, monkeypatch, notes):
    """The queries over the tables of these notes in place of the driver's."""
    tables = VaultEngine(spark, spark.createDataFrame([*notes.items()], "path string, content string")).tables
    monkeypatch.setattr(queries, "_vault", lambda spark, sf_dir: tables)


def test_walks_of_the_query(spark, monkeypatch):
    vault_of(spark, monkeypatch, {"A.md": "[[B]] [[C]]", "B.md": "[[C]] [[D]]", "C.md": "end", "D.md": "[[A]]", "Lone.md": "alone"})
    got = queries.g21_walks(spark, "").collect()
    edges = {(r["u"], r["v"]) for r in queries.graph.adjacency(queries._graph(spark, "")).collect()}
    assert len({r["walk"] for r in got}) == len(got) == 40 and {len(r["nodes"]) for r in got} == {20}
    assert all(e in edges for r in got for e in zip(r["nodes"], r["nodes"][1:], strict=False))


def test_walks_follow_weights(spark):
    star = spark.createDataFrame([("a", "b", 3.0), ("a", "c", 1.0), ("b", "a", 3.0), ("c", "a", 1.0)], "u string, v string, weight double")
    got = [r["nodes"] for r in topology.walks(star, topology.Config(walks=2000, walk_length=2)).collect() if r["nodes"][0] == "a"]
    assert len(got) == 2000 and abs(sum(x[1] == "b" for x in got) / 2000 - 0.75) < 0.05


def test_synthesis(engine, tmp_path):
    once = synthesis.merged("mine\n", "made")
    assert once.startswith("mine") and synthesis.merged(once, "made") == once and "new" in synthesis.merged(once, "new")
    pages = engine.moc(root=str(tmp_path))
    assert {"MOC - AI.md", "MOC - CS.md", "Index.md", "Orphans.md"} <= pages.keys()
    topic = pages["MOC - AI.md"]
    assert "- **Topic**: `ai`\n- **Total Notes**: " in topic and "(In: " in topic and "### Note Index" in topic
    assert "#ai/ml" in (tmp_path / "MOC - AI.md").read_text() and "[[Lone]]" in pages["Orphans.md"]
    members = engine.tables["tags"].join(engine.tables["documents"], "doc_id").select("tag", "title")
    assert rows(synthesis.taxonomy(members), "node", "n_notes", "is_leaf")[:2] == [("ai", 0, False), ("ai/ml", 2, True)]


def test_text_functions(spark):
    q = ["Foo::bar", "src/main.rs", "how does it work", "graph index", '"exact"', "one two three four five"]
    df = spark.createDataFrame([(x,) for x in q], "q string")
    assert [r[0] for r in df.select(fx.query_intent(F.col("q"))).collect()] == ["code", "code", "natural_language", "balanced", "code", "natural_language"]
    urls = {"https://x.y": True, "javascript:alert(1)": False, "java\nscript:x": False, "#a": True, "rel/path": True, "mailto:a@b": False, "data:x": False}
    got = {r["u"]: r["s"] for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", fx.is_safe_url(F.col("u")).alias("s")).collect()}
    assert got == urls
    p = {"Notes/Sub/A.md": ("Notes/Sub/A.md", None), "../../etc/passwd": (None, "escape"), "a/./b/../c": ("a/c", None), "/x": (None, "absolute"), "C:/x": (None, "drive"), "a/../../b": (None, "escape")}
    got = {r["p"]: (r["l"]["path"], r["l"]["error"]) for r in spark.createDataFrame([(x,) for x in p], "p string").select("p", fx.lexical_path(F.col("p")).alias("l")).collect()}
    assert got == p
    one = spark.createDataFrame([("<a href='x'>&</a>", "  Hé, Wörld! 2 ", "ai/deep learning")], "h string, s string, t string")
    r = one.select(fx.escape_html(F.col("h")).alias("h"), fx.slugify(F.col("s")).alias("s"), fx.topic_title(F.col("t")).alias("t"), fx.fts_query(F.col("s")).alias("f")).head()
    assert r["h"] == "&lt;a href=&#x27;x&#x27;&gt;&amp;&lt;&#x2F;a&gt;" and r["s"] == "hé-wörld-2" and r["t"] == "Ai - Deep learning" and r["f"] == '"Hé"* OR "Wörld"* OR "2"*'


def test_queries_keep_every_row(spark, monkeypatch):
    urls = {1: "http://Bücher.example/Straße 1/", 2: None, 3: "https://例え.jp/a", 4: "http://a.b/c"}
    monkeypatch.setattr(queries, "_read", lambda spark, sf_dir, name: spark.createDataFrame([*urls.items()], "page_id long, url string"))
    got = {r["page_id"]: r["slug"] for r in queries.p24_slugify(spark, "").collect()}
    assert got == {1: "http-bücher-example-straße-1", 2: None, 3: "https-例え-jp-a", 4: "http-a-b-c"}
    vault_of(spark, monkeypatch, {"Supplier 1.md": "a", "Part 1.md": "b", "Other.md": "c"})
    assert [r["title"] for r in queries.s08_documents(spark, "").collect()] == ["Other", "Part 1", "Supplier 1"]


def test_settled_events(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    ms = lambda n: t0 + timedelta(milliseconds=n)
    data = [("a", "create", ms(0)), ("a", "modify", ms(100)), ("b", "create", ms(0)), ("b", "remove", ms(50)), ("c", "remove", ms(0)), ("c", "create", ms(300)), ("d", "modify", ms(0)), ("d", "remove", ms(5000))]
    events = spark.createDataFrame(data, "path string, kind string, ts timestamp")
    want = [("a", "create"), ("c", "modify"), ("d", "modify"), ("d", "remove")]
    assert rows(watch.settled(events), "path", "action") == want
    events.unionByName(spark.createDataFrame([("z", "modify", ms(60_000))], events.schema)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = []
    q = watch.sync(watch.settled(stream), lambda up, gone: got.extend([("up", r["path"]) for r in up.collect()] + [("gone", r["path"]) for r in gone.collect()]), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sorted(got) == [("gone", "d"), ("up", "a"), ("up", "c"), ("up", "d")]


def test_tools(engine):
    ask = lambda **m: json.loads(tools.call(engine, json.dumps({"jsonrpc": "2.0", "id": 1} | m)))
    assert len(ask(method="tools/list")["result"]["tools"]) == 8
    assert json.loads(ask(method="tools/call", params={"name": "stats"})["result"]["content"][0]["text"])["documents"] == 5
    assert ask(method="nope")["error"]["code"] == -32601 and json.loads(tools.call(engine, "{"))["error"]["code"] == -32700
    assert ask(method="tools/call", params={"name": "nope"})["error"]["code"] == -32000
    assert tools.http(engine, "/api/backlinks?note=Beta")[0] == 200 and tools.http(engine, "/x")[0] == 404
    assert engine.definition("Alpha", "Parts") == {"path": "Alpha.md", "line": 9} and engine.hover("Lone").startswith("# Lone")
    assert [r["label"] for r in engine.completion("see [[al").collect()] == ["Alpha"]


def test_link_and_field_scanners():
    links = markdown.wikilinks
    assert links("a [[N]] ![[M#H^b|x|y]] [[#h]] [[N#]] [[N|]] [[ ]] [[N^b]] [[N#^b]] [[a]b]] [[x [[y]]") == [
        ("wikilink", "N", None, None, None), ("embed", "M", "H", "b", "x|y"), ("wikilink", "N", None, "b", None), ("wikilink", "N", None, "b", None),
        ("wikilink", "x [[y", None, None, None),
    ]
    fields = markdown.fields
    assert fields("[a:: 1] b:: two, c::three [d::] e:: [f:: 4]") == [("a", "1"), ("f", "4"), ("b", "two"), ("c", "three [d::"), ("e", "[f:: 4")]
    assert fields("[k:: v] k:: w") == [("k", "v")] and fields("x:y::z ::q") == []


def test_front_matter_without_fields_is_dropped():
    note = markdown.parse_note("a.md", "---\n- one\n---\n\nText \n")
    assert [s["content"] for s in note["sections"]] == ["Text"] and note["title"] == "a"
    assert markdown.parse_note("a.md", "---\nx: [\n---\nText")["sections"][0]["content"].startswith("---")


def test_files_of_a_folder(spark, tmp_path):
    root = tmp_path / "it's a vault"
    for name in ("a.md", "sub/b c+d.md", "drafts/x.md", "drafts/keep.md", ".hidden/y.md", "node/z.md", "old.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("# T\n")
    (root / ".gitignore").write_text("# rules\ndrafts/*\n!drafts/keep.md\nnode/\n/old*\n")
    assert {r["path"] for r in vault.files(spark, str(root)).collect()} == {"a.md", "sub/b c+d.md", "drafts/keep.md"}


def test_broken_anchors_suggest_what_the_note_has(spark):
    notes = spark.createDataFrame([("a.md", "# Introduction\ntext ^block-one\n"), ("b.md", "[[a#Introductoin]] [[a#^block-on]] [[a#Nothing like it]]\n")], "path string, content string")
    found = diagnostics.lint(markdown.tables(markdown.parse(notes)))
    got = {(r["code"], r["target"]): r["suggested"] for r in found.collect()}
    assert got == {("W002", "a#Introductoin"): ["[[a#Introduction]]"], ("W003", "a#^block-on"): ["[[a#^block-one]]"], ("W002", "a#Nothing like it"): []}


def test_saved_vault_follows_its_folder(spark, tmp_path):
    folder, saved = tmp_path / "notes", index.SavedVault(spark, str(tmp_path / "saved"))
    folder.mkdir()
    write = lambda name, text: (folder / name).write_text(text)
    write("a.md", "# A\n[[B]] #one\n"), write("b.md", "# B\n"), write("c.md", "# C\n[[A]]\n")
    done = lambda **k: {r["path"]: r["action"] for r in saved.refresh(str(folder), **k).collect()}
    assert done() == {"a.md": "insert", "b.md": "insert", "c.md": "insert"} and done() == {}
    write("a.md", "# A\n[[C]] and more\n"), (folder / "c.md").unlink(), write("d.md", "# D\n")
    assert done(only=spark.createDataFrame([("d.md",)], "path string")) == {"d.md": "insert"}
    assert done() == {"a.md": "update", "c.md": "delete"}
    fresh, kept = VaultEngine.open(spark, str(folder)).tables, VaultEngine.saved(spark, saved.root).tables
    for name, rows in fresh.items():
        assert sorted(map(str, rows.collect())) == sorted(map(str, kept[name].select(rows.columns).collect())), name
    assert {r["path"] for r in saved.manifest().collect()} == {"a.md", "b.md", "d.md"} and saved.events().count() == 6
    saved.applier(str(folder))(spark.createDataFrame([("a.md",)], "path string"), spark.createDataFrame([("b.md",)], "path string"))
    assert saved.events().count() == 6  # nothing had changed
    assert set(done(full=True).values()) == {"update"}


def test_saved_embeddings(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, embedding array<double>")
    root = str(tmp_path / "vectors")
    index.save_embeddings(rows, "m1", root), index.save_embeddings(rows.limit(1), "m2", root), index.save_embeddings(rows, "m1", root)
    assert index.load_embeddings(spark, root).count() == 3 and index.load_embeddings(spark, root, "m1", ["b"]).head()["embedding"] == [0.0, 1.0]


def test_security(spark, tmp_path):
    (tmp_path / "v").mkdir(), (tmp_path / "v" / "a.md").write_text("x"), (tmp_path / "out.md").write_text("y")
    (tmp_path / "v" / "link.md").symlink_to(tmp_path / "out.md")
    root = str(tmp_path / "v")
    assert security.read_note(root, "s/../a.md") == "x"
    for bad in ("../out.md", "/etc/passwd", "link.md", "C:/x", "a\x00", "s/../../out.md"):
        with pytest.raises(security.OutsideVault):
            security.within_vault(root, bad)
    notes = {"a": "1 {b} {c}", "b": "2 {a}", "c": "3 {zzz}"}
    embeds = lambda t: [(m.start(), m.end(), m[1]) for m in re.finditer(r"\{(\w+)\}", t)]
    assert security.embedded_text("a", notes, embeds) == "1 2 <!-- embed cycle: a --> 3 {zzz}"
    deep = {f"n{k}": f"{{n{k + 1}}}" for k in range(9)} | {"n9": "end"}
    assert security.embedded_text("n0", deep, embeds) == "<!-- embed too deep: n6 -->"
    assert security.path_of(security.uri_of("/a b/é.md")) == "/a b/é.md"
    df = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<double>").select(security.packed_vector("v").alias("b"))
    assert [r["v"] for r in df.select(security.unpacked_vector("b").alias("v")).collect()] == [[1.5, -2.0], None]


def test_language_server(spark):
    notes = [("a.md", "# Alpha\nFirst words.\n## Part\nMore.\n"), ("b.md", "# Beta\n[[Alpha#Part]]\n")]
    uri, line = "file:///v/b.md", "see [[Alpha#Part]] and [[Alhpa]]"
    at = lambda c: {"textDocument": {"uri": uri}, "position": {"line": 0, "character": c}}
    asked = [
        {"id": 1, "method": "initialize", "params": {"rootUri": "file:///v"}}, {"method": "textDocument/didOpen", "params": {"textDocument": {"uri": uri, "text": line}}},
        {"id": 2, "method": "textDocument/definition", "params": at(8)}, {"id": 3, "method": "textDocument/hover", "params": at(8)},
        {"id": 4, "method": "textDocument/completion", "params": at(8)}, {"id": 5, "method": "shutdown"}, {"method": "exit"},
    ]
    source, sink = io.BytesIO(), io.BytesIO()
    for m in asked:
        lsp.write_message(source, m)
    source.seek(0)
    assert lsp.language_server(VaultEngine(spark, spark.createDataFrame(notes, "path string, content string")), source, sink) == 0
    sink.seek(0)
    out = [*iter(lambda: lsp.read_message(sink), None)]
    assert out[0]["result"]["capabilities"]["hoverProvider"] and [d["code"] for d in out[1]["params"]["diagnostics"]] == ["W001"]
    assert out[2]["result"] == {"uri": "file:///v/a.md", "range": {k: {"line": 2, "character": 0} for k in ("start", "end")}}
    assert out[3]["result"]["contents"]["value"].startswith("## Part") and [x["label"] for x in out[4]["result"]] == ["Alpha"]


def test_context_ranks_and_focus(spark):
    notes = [("a.md", "# A\n[[B]] #t\n"), ("b.md", "# B\n"), ("c.md", "# C\n#t\n"), ("d.md", "# D\n[[A]]\n"), ("e.md", "# E\n[[D]]\n")]
    e = VaultEngine(spark, spark.createDataFrame(notes, "path string, content string"))
    ranks = {r["id"]: r["raw"] for r in rag.ranks(rag.build(e.tables)).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and max(ranks, key=ranks.get) == "a.md" and ranks["c.md"] > ranks["e.md"] * 0.5
    near = graph.focus(e.graph, "A", 1)
    assert {r["title"] for r in near.vertices.collect()} == {"A", "B", "D"} and near.edges.count() == 2


def test_vector_sweep_and_errors(spark):
    v = vectors.random_vectors(spark, 600, 24)
    q = v.filter("vec_id % 40 = 0").withColumnRenamed("vec_id", "query_id")
    rows = {(r["k"], r["method"]): r["recall"] for r in vectors.sweep(v, q, (5, 10))}
    assert rows[5, "exact"] == 1.0 and min(rows.values()) >= 0.9 and len(rows) == 6
    e = vectors.sq8_errors(v).head()
    assert e["pairs"] > 100 and e["mean_error"] < 0.005 and e["max_error"] < 0.02
    p = vectors.percentiles(spark.range(1, 101).selectExpr("cast(id as double) as ms", "'x' as kind"), "ms", "kind").head()
    assert (p["n"], p["mean"], p["p50"], p["p95"], p["p99"]) == (100, 50.5, 50.0, 95.0, 99.0)


def test_index_recall_on_the_driver_vectors(spark):
    rows = queries.v11_hnsw_recall(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) >= 25 and np.mean([r["recall"] for r in rows]) >= 0.9


def test_query_blocks(spark, monkeypatch):
    v = vectors.random_vectors(spark, 90, 8)
    q = v.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    whole = [sorted(map(tuple, f(v, q, 3).collect())) for f in (vectors.top_k, vectors.hnsw_top_k)]
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 4)
    assert [sorted(map(tuple, f(v, q, 3).collect())) for f in (vectors.top_k, vectors.hnsw_top_k)] == whole and len(whole[0]) == 27


def test_walks_draw_by_weight(spark):
    links = [("a", "b", 1.0), ("a", "c", 3.0), ("a", "d", 0.5), ("c", "d", 2.0)]
    both = spark.createDataFrame(links + [(v, u, w) for u, v, w in links], "u string, v string, weight double")
    slots = topology._dealt(both)
    assert slots.count() <= 2 * both.count() and slots.select("u", "v").distinct().count() == both.count()
    rows = topology.walks(both, topology.Config(walks=400, walk_length=3)).collect()
    assert len(rows) == 1600 and all(len(r["nodes"]) == 3 for r in rows)
    steps = [(r["nodes"][k], r["nodes"][k + 1]) for r in rows for k in (0, 1)]
    out = [v for u, v in steps if u == "a"]
    assert {*steps} <= {(r["u"], r["v"]) for r in both.collect()}
    assert all(abs(out.count(v) / len(out) - w / 4.5) < 0.06 for u, v, w in links if u == "a")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_plain_front_matter_needs_no_yaml(monkeypatch):
    monkeypatch.setattr(markdown.yaml, "load", lambda *a: pytest.fail("parsed as YAML"))
    r = markdown.parse_note("a.md", "---\ntitle: A b\naliases: [P1]\ntags: [x, y/z]\n---\nText")
    assert (r["title"], r["aliases"], [t["tag"] for t in r["tags"]]) == ("A b", ["P1"], ["x", "y/z"])
    monkeypatch.undo()
    r = markdown.parse_note("a.md", "---\ntitle: yes\ntags: [on, x]\n---\nText")
    assert (r["title"], [t["tag"] for t in r["tags"]]) == ("true", ["true", "x"])


def test_demo_vault_deals_out_numbers(spark):
    dealt = plan(vault.demo(spark, "/root/testdata/sf0.001"))
    assert "RepartitionByExpression [p_partkey" in dealt and "collect_list(line" in dealt


def test_links_are_dealt_out_once(spark):
    notes = {"A.md": "[[b]] [[sub/c]] [[C]]", "sub/A.md": "[[b]] [[c]] [[B t]] [[no]]", "sub/c.md": "x", "B.md": "# B t\n", "sub/b.md": "x"}
    t = VaultEngine(spark, spark.createDataFrame([*notes.items()], "path string, content string")).tables
    found = graph.resolved(t["links"], t["documents"])
    assert "Aggregate [source_doc_id" not in plan(found) and found.columns == [*t["links"].columns, "doc"]
    root = [("A.md", "C", "sub/c.md"), ("A.md", "b", "B.md"), ("A.md", "sub/c", "sub/c.md")]
    assert rows(found, "source_doc_id", "target_note", "doc")[:3] == root
    assert {r["target_note"]: r["doc"] for r in found.filter("source_doc_id = 'sub/A.md'").collect()} == {"b": "B.md", "c": "sub/c.md", "B t": "B.md", "no": None}


def test_written_graphs_stay_where_they_are(spark, monkeypatch):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("b", "a", 2.0), ("c", "c", 1.0)], "src string, dst string, weight double")
    vertices = spark.createDataFrame([(x, x) for x in "abc"], "id string, title string")
    names, settled = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df, name: names.append(name) or settled(df, name))
    g = graph.Graph(vertices, e, True)
    assert graph.shortest_path(g, "a", "c") == ["a", "b", "c"] and "path-edges" not in names
    assert rows(graph.hops_from(g, "a", 2), "id", "hops") == [("a", 0), ("b", 1), ("c", 2)]
    assert "Union" not in plan(graph.adjacency(g)) and rows(graph.adjacency(g), "u", "v", "weight") == [("a", "b", 3.0), ("b", "a", 3.0), ("b", "c", 1.0), ("c", "b", 1.0)]


def test_records_come_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(markdown, "BATCH_CHARS", 1000)
    from pyspark.sql.pandas.types import to_arrow_schema
    import pyarrow as pa

    empty = markdown.parse(spark.createDataFrame([], "path string, content string"))
    batch = pa.RecordBatch.from_arrays([pa.array([f"{k}.md" for k in range(20)]), pa.array(["[[x]] " * 60, None] * 10)], names=["path", "content"])
    found = [*markdown.records([batch], to_arrow_schema(empty.schema))]
    assert sum(b.num_rows for b in found) == 20 and max(b.num_rows for b in found) <= 6
    assert [len(x) for b in found for x in b.column("links").to_pylist()] == [60, 0] * 10


def test_pagerank_rounds_leave_nothing_behind(spark, monkeypatch):
    links = [("a", "b"), ("a", "x"), ("a", "x"), ("b", "a"), ("b", "c"), ("c", "y"), ("c", "c"), ("z", "a")]
    vertices = spark.createDataFrame([(x,) for x in "abcxyzw"], "id string")
    written, gone, settled, released = [], [], graph.settled, graph.released
    monkeypatch.setattr(graph, "settled", lambda df, name: written.append(settled(df, name)) or written[-1])
    monkeypatch.setattr(graph, "released", lambda *t: gone.extend(t) or released(*t))
    g = graph.Graph(vertices, spark.createDataFrame(links, "src string, dst string"), True)
    got = {r["id"]: r["raw"] for r in graph.pagerank(g, 4).collect()}
    assert {x._stage_path for x in written} - {x._stage_path for x in gone} == {written[-1]._stage_path}
    ids, n = "abcxyzw", 7
    rank = dict.fromkeys(ids, 1 / n)
    out = {x: sum(a == x for a, _ in links) for x in ids}
    for _ in range(4):
        new = dict.fromkeys(ids, 0.15 / n + 0.85 * sum(rank[x] for x in ids if not out[x]) / n)
        for a, b in links:
            new[b] += 0.85 * rank[a] / out[a]
        rank = new
    assert all(abs(got[x] - rank[x]) < 1e-12 for x in ids)


def test_exact_search_takes_small_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    v = vectors.random_vectors(spark, 2500, 4).repartition(1)
    q = v.filter("vec_id % 900 = 0").withColumnRenamed("vec_id", "query_id")
    got = vectors.top_k(v, q, 5)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in v.collect()}
    for i in (0, 900, 1800):
        order = sorted(x, key=lambda k: (-float(x[k] @ x[i]), k))[:5]
        assert [r["vec_id"] for r in got.filter(F.col("query_id") == i).orderBy("rank").collect()] == order
