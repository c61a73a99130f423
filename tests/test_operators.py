"""Operators of the core on small tables: expressions, graph edge cases, orphans, sources."""

import pytest
from pyspark.sql import functions as F

from weftline import config, errors
from weftline import queries as core
from weftline.functions import embedding, ids, text
from weftline.operators import check, graph, orphans, parse
from weftline.operators import search as retrieval
from weftline.plans import runtime
from weftline.sources import files


def one(spark, expr, **cells):
    names = list(cells)
    schema = ", ".join(f"{n} {'array<double>' if isinstance(v, list) else 'string'}" for n, v in cells.items())
    return spark.createDataFrame([tuple(cells[n] for n in names)], schema).select(expr.alias("r")).first()["r"]


def test_ids(spark):
    cases = {"a:b": (None, "a", "b"), "p:x/a:b": ("p:x", "a", "b"), "a:b:c": (None, "a", "b:c"), "/a:b": (None, "/a", "b"), "x//a:b": ("x/", "a", "b"), "ab": None, ":b": None, "a:": None, "": None}
    for given, want in cases.items():
        got = one(spark, ids.parse_id("c"), c=given)
        assert (tuple(got) if got else None) == want, given
        if want:
            assert one(spark, ids.format_id(F.lit(want[0]).cast("string"), F.lit(want[1]), F.lit(want[2])), c=given) == given
    assert one(spark, ids.local_id("c"), c="p:x/a:b") == "a:b"


def test_references(spark):
    read = lambda c: one(spark, ids.parse_reference("c"), c=c)
    assert (r := read(" a:b | Name ")).kind == "resolved" and (r.target, r.display) == ("a:b", "Name")
    assert read("a:b|").display == "" and read("a:b").display is None and read("Note: hi").target == "Note: hi"
    assert (r := read("?person: the one: him")).kind == "unresolved" and (r.type_guess, r.descriptor) == ("person", "the one: him")
    assert read("?: x").type_guess is None and read("?x") is None and read("?x:  ") is None and read("nothing") is None and read(None) is None
    assert one(spark, ids.reference_value("c"), c=" [[ a:b ]] ") == "a:b"
    shaped = {"a:b": "a", "[[a:b]]": "a", "a: b": None, "?a:b": None, "a b:c": None, "https://x.org": "https", "é:x": None, ":x": None}
    for given, want in shaped.items():
        assert one(spark, ids.referenced_type("c"), c=given) == want, given


def test_paths(spark):
    cases = [("a/x.md", "a/y.md", "./y.md"), ("a/x.md", "a/d/y.md", "./d/y.md"), ("a/b/x.md", "a/y.md", "../y.md"), ("a/b/x.md", "c/y.md", "../../c/y.md"), ("x.md", "y.md", "./y.md"), ("a/b/x.md", "a/c/d/y.md", "../c/d/y.md")]
    for source, target, want in cases:
        assert one(spark, ids.relative_path("s", "t"), s=source, t=target) == want
    assert one(spark, ids.file_stem("c"), c="a/b/jane.doe.md") == "jane.doe"


def test_text(spark):
    assert one(spark, text.tokens("c"), c="One, two ONE İX!") == ["one", "two", "i̇x"]
    assert one(spark, text.term_frequency("c", ["aa"]), c="aaaaa AA") == 3
    body = " ".join(f"w{i}" for i in range(30)) + " Needle " + " ".join(f"v{i}" for i in range(30))
    assert one(spark, text.snippet("c", ["needle"]), c=body) == "w26 w27 w28 w29 Needle v0 v1 v2 v3 v4 v5 v6"
    assert one(spark, text.snippet("c", ["nope"]), c=body) == " ".join(f"w{i}" for i in range(12))
    for a, b, want in (([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0], [1.0, 2.0], 0.0), ([], [], 0.0), ([0.0, 0.0], [1.0, 0.0], 0.0)):
        assert one(spark, text.cosine("a", "b"), a=a, b=b) == pytest.approx(want)
    assert "naive" in one(spark, text.index_tokens("c"), c="Naïve approach")
    vectors = [[1.0, 0.0], [3.0, 4.0], [0.0, 0.0], [], None, [1.0], [float("nan"), 1.0], [None, 1.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "i int, v array<float>")
    got = {r["i"]: r["similarity"] for r in text.with_cosine(df, "v", [2.0, 0.0]).collect()}
    assert got == pytest.approx({0: 1.0, 1: 0.6} | dict.fromkeys(range(2, 8), 0.0))


def nodes_of(spark, links):
    return spark.createDataFrame([(i, i.split(":")[0], f"{i}.md", "{}", i, [], s) for i, s in links.items()], "id string, type string, path string, frontmatter string, name string, aliases array<string>, superseded_by string")


def test_redirects(spark):
    nodes = nodes_of(spark, {"a:1": "a:2", "a:2": "a:3", "a:3": None, "a:4": "a:5", "a:5": "a:4", "a:6": "a:6", "a:7": "gone:x", "a:8": ""})
    asked = spark.createDataFrame([(f"a:{i}",) for i in range(1, 10)] + [("a:1",), (None,)], "id string")
    got = {r["requested"]: (r["resolved"], r["missing"]) for r in graph.resolve_all(nodes, asked).collect()}
    assert got == {"a:1": ("a:3", None), "a:2": ("a:3", None), "a:3": ("a:3", None), "a:4": ("a:4", None), "a:5": ("a:5", None), "a:6": ("a:6", None), "a:7": (None, "gone:x"), "a:8": ("a:8", None), "a:9": (None, "a:9")}
    assert graph.resolve_all(nodes.where("false"), asked.where("false")).collect() == []


def test_long_chains(spark):
    """Chains of 1,200 end in logarithmic rounds, with tails into a cycle and a chain that ends nowhere."""
    n = 1200
    links = {f"a:{i}": f"a:{i + 1}" for i in range(n)} | {f"a:{n}": None}
    links |= {f"b:{i}": f"b:{i + 1}" for i in range(n)} | {f"b:{n}": f"b:{n - 3}"}  # a tail into a cycle of four
    links |= {f"c:{i}": f"c:{i + 1}" for i in range(n)}
    nodes = nodes_of(spark, links)
    got = {r["requested"]: (r["resolved"], r["missing"]) for r in graph.resolve_all(nodes, nodes.select("id")).collect()}
    want = {f"a:{i}": (f"a:{n}", None) for i in range(n + 1)} | {f"b:{i}": (f"b:{max(i, n - 3)}", None) for i in range(n + 1)} | {f"c:{i}": (None, f"c:{n}") for i in range(n)}
    assert got == want


def test_traversal(spark):
    nodes = nodes_of(spark, dict.fromkeys(["a:1", "a:2", "a:3", "a:4"]))
    edges = spark.createDataFrame([("a:1", "a:2", "x", 5, 0), ("a:1", "a:2", "first", 2, 1), ("a:1", "a:9", "x", 1, 2), ("a:9", "a:4", "x", 1, 0), ("a:2", "a:1", "x", 1, 0), ("a:2", "a:3", "x", 1, 1), ("a:1", "a:1", "x", 1, 3)], "from_id string, to_id string, ref_type string, line int, seq int")
    got = [(r["id"], r["distance"], r["ref_type"]) for r in graph.refs(nodes, edges, "a:1", 5).collect()]
    assert got == [("a:2", 1, "first"), ("a:3", 2, "x")]
    assert graph.refs(nodes, edges, "a:none", 2).collect() == []


def test_reach_is_traversal_of_a_type(spark):
    """Cycles, self-links, repeated links, loose ends and targets that start themselves; as traverse has it from every node."""
    nodes = nodes_of(spark, dict.fromkeys(["a:1", "a:2", "b:1", "b:2", "b:3", "c:1", "c:2", "d:1"])).repartition(3)
    links = [("a:1", "a:2"), ("a:1", "a:2"), ("a:1", "a:9"), ("a:9", "b:1"), ("a:2", "b:1"), ("b:1", "b:2"), ("b:2", "b:1"), ("b:2", "b:2"), ("b:2", "c:1"), ("c:1", "a:1"), ("c:1", "b:3"), ("a:1", "b:3"), ("b:3", "c:2"), ("z:1", "b:2")]
    edges = spark.createDataFrame([(a, b, "x", i, i) for i, (a, b) in enumerate(links)], "from_id string, to_id string, ref_type string, line int, seq int")
    for depth in (0, 1, 4):
        every = {tuple(r) for r in graph.traverse(nodes, edges, nodes.select("id"), depth).drop("ref_type", "line").collect()}
        for type in ("b", "d") if depth else ("b",):
            got = [tuple(r) for r in graph.reach(nodes, edges, type, depth).collect()]
            assert sorted(got) == sorted(r for r in every if r[2] == type), (depth, type)
        assert bool(depth) == any(r[2] == "b" for r in every)
    assert graph.reach(nodes.where("false"), edges, "b", 2).collect() == []


def test_type_filter_moves_no_pairs_of_other_types(spark, tmp_path):
    """200 notes that all lead to each other: 40,000 pairs, of which 200 are of the type asked for."""
    from weftline.queries import QUERIES

    n, at = 200, "timestamp_ntz'2024-01-01'"
    hub = f"SELECT 'system:s' AS id UNION ALL SELECT 'note:hub' UNION ALL SELECT concat('note:', id) FROM range({n})"
    spark.sql(f"SELECT id, split(id, ':')[0] AS type, id AS path, '{{}}' AS frontmatter, id AS name, array('') AS aliases, '' AS superseded_by, {at} AS indexed_at, CAST(NULL AS timestamp_ntz) AS deleted_at FROM ({hub})").write.parquet(f"{tmp_path}/nodes.parquet")
    ends = f"SELECT concat('note:', id) AS f, 'note:hub' AS t FROM range({n}) UNION ALL SELECT 'note:hub', concat('note:', id) FROM range({n}) UNION ALL SELECT 'note:hub', 'system:s'"
    spark.sql(f"SELECT monotonically_increasing_id() AS edge_id, f AS from_id, t AS to_id, 'x' AS ref_type, 'inline' AS origin, f AS source_file, 1 AS line, 1 AS seq FROM ({ends})").write.parquet(f"{tmp_path}/edges.parquet")
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
    quantiles = spark.sparkContext._gateway.new_array(jvm.double, 0)

    def moved():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, quantiles, jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = moved()
    rows = QUERIES["refs_type_filter"](spark, str(tmp_path)).collect()
    assert sorted((r["start"], r["id"], r["distance"]) for r in rows) == sorted([("note:hub", "system:s", 1), *((f"note:{i}", "system:s", 2) for i in range(n))])
    assert sum(v for k, v in moved().items() if k not in before) < n * n / 4


def test_orphans(spark):
    nodes = spark.sql("""SELECT * FROM VALUES ('n:1', timestamp_ntz'2024-01-01', CAST(NULL AS timestamp_ntz)), ('n:2', timestamp_ntz'2024-01-01', timestamp_ntz'2024-02-01'),
      ('n:3', timestamp_ntz'2024-05-01', NULL), ('n:4', timestamp_ntz'2024-01-01', NULL), ('n:5', timestamp_ntz'2024-01-01', NULL), ('n:1', timestamp_ntz'2024-01-01', NULL) AS t(id, indexed_at, deleted_at)""")
    rows = [(1, "n:1"), (2, " n:2\t"), (3, "n:3"), (4, "N:1"), (5, None), (6, "  "), (7, "n:4"), (8, "n:5"), (1, "n:1"), (4, "N:1")]
    table = spark.createDataFrame(rows, "row bigint, ref string").withColumn("indexed_at", F.expr("timestamp_ntz'2024-03-05 10:00:00'")).withColumn("kind", F.lit("clash"))
    links = spark.createDataFrame([("n:4", "gone"), ("n:5", "n:4"), ("n:4", "n:5"), ("n:1", ""), ("n:1", "n:1")], "child string, parent string")
    found = orphans.find_orphans([orphans.references(table, "t", "row", "ref")], nodes, links)
    assert sorted(tuple(r) for r in found.collect()) == [
        ("t", 2, "2024-03", "deleted", "direct", 0),
        ("t", 3, "2024-03", "late", "direct", 0),
        ("t", 4, "2024-03", "missing", "direct", 0),
        ("t", 7, "2024-03", "inherited", "inherited", 1),
        ("t", 8, "2024-03", "inherited", "inherited", 2),
    ]
    none = orphans.find_orphans([orphans.references(table, "t", "row", "ref")], nodes.where("false"), links.where("false"))
    assert {r["kind"] for r in none.collect()} == {"missing"}


def test_hot_references_and_deep_cascades(spark):
    nodes = spark.sql("SELECT concat('n:', id) AS id, timestamp_ntz'2024-01-01' AS indexed_at, CAST(NULL AS timestamp_ntz) AS deleted_at FROM range(1300)")
    links = spark.createDataFrame([("n:0", "gone"), *((f"n:{i}", f"n:{i - 1}") for i in range(1, 1200)), ("n:0", "n:1199")], "child string, parent string")
    rows = [(i, "n:70" if i % 3 else f"n:{i % 80}") for i in range(900)] + [(1000 + i, "gone") for i in range(300)]
    table = spark.createDataFrame(rows, "row bigint, ref string").withColumn("indexed_at", F.expr("timestamp_ntz'2024-03-05 10:00:00'"))
    found = [sorted(tuple(r) for r in orphans.find_orphans([orphans.references(table, "t", "row", "ref")], nodes, links, hot_rows=h, salt=4).collect()) for h in (10**9, 200)]
    depth = {f"n:{i}": i + 1 for i in range(1200)}
    want = sorted([("t", i, "2024-03", "inherited", "inherited", depth[r]) for i, r in rows if r in depth] + [("t", i, "2024-03", "missing", "direct", 0) for i, r in rows if r == "gone"])
    assert found == [want, want]


def test_parse_file():
    loader = parse.yaml_loader()
    got = parse.parse_file("a/jane.md", "---\r\nid: d7\r\ntype: t\r\nwhen: 2026-06-10\r\nat: 12:30\r\nok: yes\r\nsee: [a:b, 7]\r\n'quoted': c:d\r\n---\r\n# T\r\n[[x:y]] [[z\r\n~~~\r\n[[no:no]]\r\n~~~\r\n## S \r\nbody\r\n", loader)
    assert got["strings"]["when"] == "2026-06-10" and got["strings"]["at"] == "12:30" and got["strings"]["ok"] == "yes"
    assert [(r["key"], r["value"], r["line"]) for r in got["refs"] if ":" in r["value"] and r["key"] != "at"] == [("quoted", "c:d", 0), ("see", "a:b", 7)]
    assert got["links"] == [{"inner": "x:y", "line": 11}] and got["display_name"] == "T"
    assert [(s["heading"], s["line"], s["body"]) for s in got["sections"]] == [("", 10, "# T\n[[x:y]] [[z\n~~~\n[[no:no]]\n~~~"), ("S", 15, "body")]
    for bad in ("", "text", "---\nid: a\ntype: b\n", "---\nid: 7\ntype: b\n---\n", "---\n- a\n---\n", "---\nid: ' '\ntype: b\n---\n", "---\na: [\n---\n", None):
        assert parse.parse_file("x.md", bad, loader) is None
    for prose, want in (("# A\n# B\n", "stem"), ("```\n# A\n```\n", "stem"), ("  # A\n", "A"), ("## A\n", "stem")):
        assert parse.parse_file("q/stem.md", "---\nid: a\ntype: b\n---\n" + prose, loader)["display_name"] == want


def test_globs():
    c = config.Config(include=("knowledge/**/*.md",), exclude=("**/drafts/**",))
    assert files.in_scope(c, "knowledge/a.md") and files.in_scope(c, "knowledge/x/y/a.md")
    assert not files.in_scope(c, "other/a.md") and not files.in_scope(c, "knowledge/drafts/a.md") and not files.in_scope(c, "knowledge/a.txt")
    with pytest.raises(errors.ConfigError):
        files.glob_regex("a[b")


def test_config(tmp_path):
    path = tmp_path / "c.toml"
    assert config.Config.load(path) == config.Config()
    path.write_text('scope_field = "area"\nunknown = 1\n[embeddings]\nprovider = "command"\ndimensions = 8\n')
    assert (c := config.Config.load(path)).scope_field == "area" and c.embeddings.provider == "command"
    for bad in ("include = 3", "a = [", '[embeddings]\nprovider = "x"'):
        path.write_text(bad)
        with pytest.raises(errors.ConfigError):
            config.Config.load(path)


def test_embedders(spark, tmp_path):
    local = embedding.LocalEmbedder(16)
    v, zero = local.embed(["One one two", " ?"])
    assert sum(x * x for x in v) == pytest.approx(1) and zero == [0.0] * 16
    command = embedding.CommandEmbedder("python3 -c 'import json,sys; print(json.dumps([[len(t)] for t in json.load(sys.stdin)]))'")
    assert command.embed(["ab", ""]) == [[2.0], [0.0]]
    for bad in ("", "exit 3", "echo x", "echo [[1]]"):
        with pytest.raises(errors.WeftlineError):
            embedding.CommandEmbedder(bad).embed(["a", "b"])
    assert embedding.parse_response('{"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}', 2) == [[1], [2]]
    assert embedding.fill_empty(["a", " ", "b"], [[1.0], [2.0]], 1) == [[1.0], [0.0], [2.0]]
    assert embedding.parse_env("# c\nexport A='x'\nB = \"y\"\nbad\n") == {"A": "x", "B": "y"}
    sections = spark.createDataFrame([("a",), ("a",), ("b",)], "body string")
    first = embedding.embed_missing(sections, None, local)
    assert first.count() == 2 and embedding.embed_missing(sections, first, local).count() == 0


def test_search_counts_heading_hits_in_suggestions_only(spark):
    nodes = nodes_of(spark, {"a:1": None, "a:2": None})
    sections = spark.createDataFrame([("a:1", 1, "Turbine", "none"), ("a:2", 1, "", "turbines turbine"), ("a:2", 9, "", "turbine")], "node_id string, line int, heading string, body string")
    index = retrieval.section_tokens(sections)
    got = {r["id"]: (r["score"], [a["line"] for a in r["anchors"]]) for r in retrieval.search(nodes, sections, "Turbine", index=index).collect()}
    assert got == {"a:2": (3.0, [1, 9])}
    assert {r["id"] for r in retrieval.suggest(nodes, sections, "turbine", index=index).collect()} == {"a:1", "a:2"}


def test_checks_on_empty_tables(spark):
    nodes = nodes_of(spark, {"a:1": None}).where("false")
    edges = spark.createDataFrame([], "from_id string, to_id string, ref_type string, origin string, source_file string, line int, seq int")
    assert check.check(nodes, nodes.select("id", "path"), edges, ["a"]).collect() == []


def test_runtime(spark, tmp_path):
    df = spark.range(10)
    assert runtime.small_enough(df, 10) and not runtime.small_enough(df, 9)
    assert runtime.cut(df).count() == 10 and runtime.written(df).count() == 10


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_queries_equal_their_sql(spark, sf, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = core.queries()[name](spark, sf)
    ran = con.execute(core.oracle_sql()[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == sorted(df.columns)
    shown = lambda v: round(v, 6) if isinstance(v, float) else list(v) if isinstance(v, (list, tuple)) else v
    want = sorted(repr([shown(r[names.index(c)]) for c in sorted(names)]) for r in ran.fetchall())
    assert sorted(repr([shown(r[c]) for c in sorted(names)]) for r in df.collect()) == want
