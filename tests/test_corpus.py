"""End to end on the garden corpus: write files, commit, index, ask."""

import io
import json

import pytest

from tests import corpora
from weftline import api, cli, output, server
from weftline.errors import IdNotFound, IndexCorrupt, IndexNotBuilt, NoRepo, UsageError
from weftline.functions.embedding import secret
from weftline.plans import store


class Flat:
    """Vectors that say whether a text names fleece or figs; other texts get zero vectors."""

    def embed(self, texts):
        return [[float("fleece" in t.lower()), float("fig" in t.lower())] for t in texts]

    def dimensions(self):
        return 2


@pytest.fixture(scope="module")
def garden(spark, tmp_path_factory):
    c = api.Corpus(spark, corpora.make(tmp_path_factory.mktemp("garden")), embedder=Flat())
    c.built = c.index()
    return c


def ids(rows, key="id"):
    return [r[key] for r in rows]


def test_what_is_indexed(garden):
    s = garden.status()
    assert s["nodes"]["by_type"] == {"bed": 4, "entry": 2, "pest": 1, "plant": 4, "year": 1} and s["nodes"]["total"] == 12
    # references: south-wall 3, frame 1, rocket 1, mint 1, june 6, july 2
    assert s["edges"] == garden.built["edges"] == 14
    assert s["source"] == "committed" and s["last_indexed_commit"] == garden.built["commit"] and s["commits_behind_head"] == 0
    # a file without text below its frontmatter has no section
    assert s["embeddings"]["sections"] == garden.store().sections.count() == 13


@pytest.mark.parametrize(
    ("asked", "found"),
    [("bed:south-wall", "bed:south-wall"), ("bed:slope", "bed:south-wall"), ("bed:terrace", "bed:south-wall"), ("plant:nettle", "plant:nettle"), ("plant:mint", "plant:mint")],
)
def test_resolve(garden, asked, found):
    r = garden.resolve(asked)
    assert r["id"] == found and (r.get("requested_id"), r["superseded_by"]) == ((None, None) if asked == found else (asked, found))
    assert not {"id", "type"} & set(r["frontmatter"])


def test_ids_that_are_not_there(garden):
    for call in (garden.resolve, garden.render):
        with pytest.raises(IdNotFound, match="plant:quince"):
            call("plant:quince")
    for bad in ("quince", ":quince", "plant:"):
        for call in (garden.resolve, garden.backlinks, garden.refs):
            with pytest.raises(UsageError):
                call(bad)


def test_display_names(garden):
    name = lambda i: garden.resolve(i)["frontmatter"]["name"]
    assert (name("bed:frame"), name("plant:mint"), name("plant:fig")) == ("Cold Frame", "mint", "Fig")


def test_backlinks_are_ordered_by_referrer_and_line(garden):
    rows = garden.backlinks("plant:rocket")["backlinks"]
    assert [(r["id"], r["ref_type"], r["line"]) for r in rows] == [("bed:frame", "grows", 4), ("bed:south-wall", "grows", 5), ("entry:june-31", "inline", 8)]
    assert ids(garden.backlinks("plant:rocket", type="bed", limit=1)["backlinks"]) == ["bed:frame"]
    assert garden.backlinks("bed:south-wall")["count"] == 0  # redirects are not followed


def test_traversal_by_depth(garden):
    at = lambda d, **o: {r["id"]: r["distance"] for r in garden.refs("entry:july-31", depth=d, **o)["refs"]}
    assert at(0) == {} and at(1) == {"entry:june-31": 1, "year:y31": 1}
    assert at(2) == at(1) | {"pest:flea-beetle": 2, "bed:terrace": 2, "plant:rocket": 2, "bed:slope": 2, "bed:frame": 2}
    assert at(9) == at(2) and at(2, type="bed") == {"bed:frame": 2, "bed:slope": 2, "bed:terrace": 2}
    rows = garden.refs("entry:july-31", depth=2)["refs"]
    assert [(r["distance"], r["id"]) for r in rows] == sorted((r["distance"], r["id"]) for r in rows)


def test_loose_ends(garden):
    every = [(r["path"], r["line"], r["type_guess"], r["descriptor"]) for r in garden.unresolved()["unresolved"]]
    assert every == [("beds/plants/rocket.md", 5, "pest", "the grey slug"), ("log/y31/july.md", 6, "tool", "a long hoe"), ("log/y31/june.md", 8, None, "the man next door")]
    assert garden.unresolved(type="pest")["count"] == 1 and garden.unresolved(scope="year:y31")["count"] == 2 and garden.unresolved(scope="year:y30")["count"] == 0


def test_hybrid_search(garden):
    """Text, names and vectors add up; anchors come in the order of lines, a name's anchor only where text gave none."""
    got = garden.search("flea beetle")["results"]
    assert [(r["id"], r["score"], [a["line"] for a in r["anchors"]]) for r in got] == [("pest:flea-beetle", 5.0, []), ("plant:rocket", 4.0, [9])]
    fleece = {r["id"]: r for r in garden.search("fleece", threshold=0.9)["results"]}
    # june: a heading alone is no occurrence, the body has one; each text with fleece is at cosine 1
    assert {i: round(r["score"], 6) for i, r in fleece.items()} == {"entry:june-31": 2.0, "entry:july-31": 3.0, "plant:rocket": 2.0}
    assert fleece["entry:june-31"]["anchors"] == [{"heading": "Fleece", "line": 10, "snippet": "Put fleece over [[bed:slope]] and [[bed:frame]]. ~~~ [[tool:drawn-only]] ~~~"}]
    named = garden.search("brown")["results"]
    assert [(r["id"], r["score"], r["anchors"][0]["heading"]) for r in named] == [("plant:fig", 5.0, "Pruning")]
    assert garden.search("fleece", type="plant")["count"] == 1 and ids(garden.search("fleece", scope="year:y31")["results"]) == ["entry:july-31", "entry:june-31"]
    assert garden.search("xylophone")["count"] == garden.search(" ?! ")["count"] == 0 and garden.search("fleece", limit=1)["count"] == 1


def test_suggestions(garden):
    assert [(r["id"], r["score"]) for r in garden.suggest("Flea Beetle")["suggestions"]] == [("pest:flea-beetle", 3.0), ("plant:rocket", 0.5)]
    assert ids(garden.suggest("carica")["suggestions"]) == ["plant:fig"] and garden.suggest("carica", type="bed")["count"] == 0 and garden.suggest("\t")["count"] == 0


def test_report_of_a_sound_corpus(garden):
    report, failed = garden.check()
    assert not failed and report["violations"] == [] and garden.check(strict=True)[1]
    assert [(w["kind"], w["id"], w.get("to")) for w in report["warnings"]] == [("drift", "plant:mint", "plant:nettle"), ("drift", "entry:july-31", "entry:june-31"), ("drift", "entry:june-31", "plant:rocket"), ("drift", "entry:june-31", "bed:frame"), ("drift", "entry:june-31", "bed:slope")]


def test_rendering(garden):
    text = garden.render("entry:june-31")["markdown"]
    assert "[salad](../../beds/plants/rocket.md) eaten, says the man next door." in text
    assert "over [South Wall](../../beds/south-wall.md) and [Cold Frame](../../beds/frame.md)." in text and "[[tool:drawn-only]]" in text
    assert garden.render("bed:terrace")["id"] == "bed:south-wall"


def test_server_and_commands_agree(garden, spark, capsys):
    calls = {1: ("resolve", {"id": "bed:slope"}), 2: ("refs", {"id": "entry:july-31", "depth": 2}), 3: ("resolve", {"id": "tool:none"}), 4: ("backlinks", {}), 5: ("sow", {})}
    lines = [json.dumps({"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": n, "arguments": a}}) for i, (n, a) in calls.items()]
    lines += [json.dumps({"jsonrpc": "2.0", "id": 6, "method": "initialize"}), json.dumps({"jsonrpc": "2.0", "id": 7, "method": "tools/list"}), "", "{", json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"})]
    lines += [json.dumps({"jsonrpc": "2.0", "id": 8, "method": "ping"}), json.dumps({"jsonrpc": "2.0", "id": 9, "method": "sow"}), json.dumps({"jsonrpc": "2.0", "id": 10})]
    out = io.StringIO()
    server.serve(garden, io.StringIO("\n".join(lines)), out)
    answers = {a["id"]: a for a in map(json.loads, out.getvalue().splitlines())}
    assert set(answers) == {None, *range(1, 11)}
    value = lambda i: json.loads(answers[i]["result"]["content"][0]["text"])
    assert value(1) == garden.resolve("bed:slope") and value(2) == garden.refs("entry:july-31", 2) and answers[3]["result"]["isError"]
    assert {i: answers[i]["error"]["code"] for i in (4, 5, 9, 10, None)} == {4: -32602, 5: -32602, 9: -32601, 10: -32600, None: -32700}
    assert set(ids(answers[7]["result"]["tools"], "name")) == set(server.TOOLS)

    run = lambda *a: cli.main(["--repo", str(garden.root), *a], spark)
    assert run("--json", "resolve", "bed:slope") == 0 and json.loads(capsys.readouterr().out) == garden.resolve("bed:slope")
    assert run("resolve", "tool:none") == 5 and "tool:none" in capsys.readouterr().err
    assert run("--json", "sow") == 2 and json.loads(capsys.readouterr().out)["error"]["kind"] == "usage"
    assert run("check") == 0 and run("check", "--strict") == 6
    for command in ("status", "backlinks plant:fig", "refs plant:fig", "search fleece", "suggest fig", "unresolved", "render plant:fig", "search zzz", "unresolved --type tool"):
        capsys.readouterr()
        assert run(*command.split()) == 0 and capsys.readouterr().out.strip()


def test_texts_for_nothing_found():
    empty = {
        "backlinks": {"id": "a:b", "backlinks": [], "count": 0}, "refs": {"id": "a:b", "depth": 1, "refs": [], "count": 0}, "search": {"query": "q", "results": [], "count": 0},
        "suggest": {"descriptor": "d", "suggestions": [], "count": 0}, "unresolved": {"unresolved": [], "count": 0},
    }
    for command, value in empty.items():
        assert output.human(command, value).startswith("no ")


def tables(spark, root):
    opened = store.open_store(spark, root)
    return {t: sorted(map(str, opened.table(t).collect())) for t in store.TABLES if t != "embed_cache"}


def test_incremental_build_equals_a_full_one(spark, tmp_path):
    root = corpora.make(tmp_path / "g")
    c = api.Corpus(spark, root, embedder=Flat())
    c.index()
    first = c.store()
    corpora.write(root, {"beds/frame.md": "---\nid: frame\ntype: bed\nname: Frame\n---\nNow [[plant:melon]].\n", "beds/plants/melon.md": "---\nid: melon\ntype: plant\n---\n# Charentais\n", "log/y31/july.md": "no node any more\n"})
    (root / "beds/plants/fig.md").rename(root / "beds/fig.md")
    (root / "beds/plants/_nettle.md").unlink()
    corpora.commit(root)
    assert c.status()["commits_behind_head"] == 1
    c.index()
    assert first.nodes.count() == 12  # a reader of the snapshot before still has its files
    after = tables(spark, root)
    c.index(full=True)
    assert tables(spark, root) == after
    assert c.resolve("plant:melon")["frontmatter"]["name"] == "Charentais" and c.resolve("plant:fig")["path"] == "beds/fig.md"
    assert [(v["kind"], v["from"], v["to"]) for v in c.check()[0]["violations"]] == [("dangling_ref", "plant:mint", "plant:nettle")]
    untouched = c.store().meta["last_indexed_commit"]
    assert c.index()["commit"] == untouched and tables(spark, root) == after  # nothing changed


def test_files_on_disk(spark, tmp_path):
    root = corpora.make(tmp_path / "g")
    c = api.Corpus(spark, root, embedder=Flat())
    c.index()
    committed = tables(spark, root)
    c.index(working_tree=True)
    assert tables(spark, root) == committed  # names that begin with a dot or an underline are read too
    corpora.write(root, {"beds/plants/fig.md": "---\nid: fig\ntype: plant\nname: Fig, uncommitted\n---\n"})
    assert c.render("plant:fig")["markdown"] == "---\nid: fig\ntype: plant\nname: Fig, uncommitted\n---\n"  # the file as it is now
    assert c.check(working_tree=True)[0]["ok"] and c.resolve("plant:fig")["frontmatter"]["name"] == "Fig, uncommitted"
    assert (c.status()["source"], c.status()["last_indexed_commit"]) == ("working-tree", None)
    c.index()
    assert tables(spark, root) == committed
    before = c.status()
    c.index(re_embed=True)
    assert c.status() == before and tables(spark, root) == committed


def test_a_corpus_of_other_file_names(spark, tmp_path):
    files = {"n/a.markdown": "---\nid: a\ntype: bed\n---\nx\n", "n/_b.markdown": "---\nid: b\ntype: bed\n---\ny\n", "n/c.md": "---\nid: c\ntype: bed\n---\n"}
    root = tmp_path / "g"
    api.init(root)
    (root / ".weftline" / "config.toml").write_text('include = ["**/*.markdown"]\n')
    corpora.write(root, files)
    c = api.Corpus(spark, root, embedder=Flat())
    assert c.index()["nodes"] == 2 and c.index(working_tree=True)["nodes"] == 2


def test_ids_within_years(spark, tmp_path):
    files = {f"log/{y}/{n}.md": f"---\nid: {n}\ntype: entry\nyear: year:{y}\n---\nSee [[entry:harvest]] of {y}.\n" for y in ("y1", "y2") for n in ("sowing", "harvest")}
    files |= {f"log/{y}/index.md": f"---\nid: {y}\ntype: year\n---\n" for y in ("y1", "y2")}
    c = api.Corpus(spark, corpora.make(tmp_path / "g", files, corpora.CONFIG + 'scoped_types = ["entry"]\n'), embedder=Flat())
    assert c.index()["nodes"] == 6
    assert c.resolve("year:y2/entry:sowing")["path"] == "log/y2/sowing.md"
    assert ids(c.refs("year:y1/entry:sowing")["refs"]) == ["year:y1", "year:y1/entry:harvest"] and c.check()[0]["ok"]
    assert ids(c.search("harvest", scope="year:y2")["results"]) == ["entry:harvest", "entry:sowing"]
    assert "[harvest](./harvest.md) of y2" in c.render("year:y2/entry:sowing")["markdown"]


def test_report_of_a_broken_corpus(spark, tmp_path):
    files = {
        "beds/one.md": "---\nid: bean\ntype: plant\nnote: see [[plant:pea]]\nnested: [[bed:x]]\nsoil: ph:six\nlink: \"[[bed:gone]]\"\n---\n[[tool:spade]] [[tool:spade]]\n",
        "beds/two.md": "---\nid: bean\ntype: plant\n---\n",
        "beds/apart.md": "---\nid: apart\ntype: tool\nmade: by hand, 1950\n---\n",
        "beds/bad-yaml.md": "---\nid: {\ntype: plant\n---\n",
        "beds/number.md": "---\nid: 12\ntype: plant\n---\n",
    }
    c = api.Corpus(spark, corpora.make(tmp_path / "g", files), embedder=Flat())
    assert c.index()["nodes"] == 2
    report, failed = c.check()
    assert failed and not report["ok"]
    assert [(v["kind"], v.get("paths"), v.get("to"), v.get("line")) for v in report["violations"]] == [
        ("duplicate_id", ["beds/one.md", "beds/two.md"], None, None), ("dangling_ref", None, "bed:gone", 7), ("dangling_ref", None, "tool:spade", 9), ("dangling_ref", None, "tool:spade", 9)]
    assert {(w["kind"], w["id"], w.get("field"), w.get("value"), w.get("to")) for w in report["warnings"]} == {
        ("orphan", "tool:apart", None, None, None), ("drift", "plant:bean", None, None, "tool:spade"), ("frontmatter_wikilink", "plant:bean", "note", None, None),
        ("frontmatter_wikilink", "plant:bean", "nested", None, None), ("frontmatter_wikilink", "plant:bean", "link", None, None), ("unknown_type", "plant:bean", "soil", "ph:six", None)}


def test_before_and_behind_an_index(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    with pytest.raises(NoRepo):
        api.Corpus(spark)
    root = tmp_path / "g"
    api.init(root)
    with pytest.raises(UsageError):
        api.init(root)
    c = api.Corpus(spark, root, embedder=Flat())
    assert c.status()["schema_version"] is None and c.status()["nodes"]["total"] == 0
    with pytest.raises(IndexNotBuilt):
        c.unresolved()
    corpora.write(root, {"knowledge/a.md": "---\nid: a\ntype: system\n---\npumps\n"})
    assert c.index()["nodes"] == 1 and c.search("pumps")["count"] == 1  # without git: the files on disk
    opened = store.open_store(spark, root)
    opened.meta["schema_version"] = store.SCHEMA_VERSION + 1
    store.write_meta(opened)
    with pytest.raises(IndexCorrupt):
        c.search("pumps")
    assert c.status()["schema_version"] == store.SCHEMA_VERSION + 1
    c.index(full=True)
    assert c.search("pumps")["count"] == 1


def test_files_that_arrive_as_a_stream(spark, tmp_path):
    from weftline.config import Config
    from weftline.streaming import incremental

    root, out, mark = (str(tmp_path / n) for n in ("files", "out", "mark"))
    config = Config(id_prefixes=("bed", "plant"))

    def run() -> dict:
        incremental.index_stream(incremental.read_stream(spark, root), out, mark, config).awaitTermination(120)
        file = {"node_versions": "path", "edges": "source_file"}
        return {t: {tuple(r) for r in incremental.current(spark, out, t, f).select(*c).collect()} for (t, f), c in zip(file.items(), (("id", "name"), ("from_id", "to_id")), strict=True)}

    corpora.write(tmp_path / "files", {"a.md": "---\nid: a\ntype: bed\nname: One\ngrows: plant:x\n---\n", "b.md": "---\nid: x\ntype: plant\nname: X\n---\n"})
    assert run() == {"node_versions": {("bed:a", "One"), ("plant:x", "X")}, "edges": {("bed:a", "plant:x")}}
    corpora.write(tmp_path / "files", {"c/a2.md": "---\nid: c\ntype: bed\nname: Two\n---\n[[plant:x]]\n"})
    assert run() == {"node_versions": {("bed:a", "One"), ("bed:c", "Two"), ("plant:x", "X")}, "edges": {("bed:a", "plant:x"), ("bed:c", "plant:x")}}


def test_secrets_come_from_the_marker_folder(tmp_path, monkeypatch):
    monkeypatch.delenv("SOME_KEY", raising=False)
    api.init(tmp_path)
    (tmp_path / ".env").write_text("SOME_KEY=committed\n")
    assert secret("SOME_KEY", tmp_path) is None
    (tmp_path / ".weftline" / ".env").write_text("SOME_KEY='kept apart'\n")
    assert secret("SOME_KEY", tmp_path) == "kept apart"
    monkeypatch.setenv("SOME_KEY", "set")
    assert secret("SOME_KEY", tmp_path) == "set"
