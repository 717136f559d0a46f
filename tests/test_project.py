"""A scripted repository, from git to graph, questions, report, vault and tools."""

import json
import os
import subprocess

import pytest

from weft import cli
from weft.model import FileGraph
from weft.operators import evaluate, graph
from weft.plans import build, protocol, report, tools, vault
from weft.sources import files, git

START, DAY = 1_600_000_000, 86_400


class Repo:
    def __init__(self, root):
        self.root, self.day = root, 0
        self.git("init", "-q", "-b", "main")
        self.git("config", "user.email", "a@b.c")
        self.git("config", "user.name", "someone")

    def git(self, *args):
        when = f"{START + self.day * DAY} +0000"
        env = os.environ | {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when}
        return subprocess.run(["git", "-C", str(self.root), *args], check=True, capture_output=True, text=True, env=env).stdout


    def put(self, name, text):
        p = self.root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    def commit(self, message):
        self.git("add", "-A")
        self.git("commit", "-q", "-m", message)
        self.day += 1


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    r = Repo(tmp_path_factory.mktemp("project"))
    r.put("pkg/__init__.py", "")
    r.put("pkg/core.py", "import pkg.util\n\n\ndef run():\n    return pkg.util.x\n" + "# more\n" * 30)
    r.put("pkg/util.py", "x = 1\n" + "# some\n" * 30)
    r.put("settings.toml", "a = 1\n")
    r.commit("first")
    r.put("pkg/core.py", (r.root / "pkg/core.py").read_text() + "# a\n")
    r.put("pkg/util.py", (r.root / "pkg/util.py").read_text() + "# a\n")
    r.commit("both")
    (r.root / "src").mkdir()
    r.git("mv", "pkg", "src/pkg")
    r.commit("move")
    for n in ("core", "util"):
        r.put(f"src/pkg/{n}.py", (r.root / f"src/pkg/{n}.py").read_text() + "# b\n")
    r.put("tests/test_core.py", "from pkg import core\nfrom pkg.core import run\n")
    r.commit("both and a test")
    for k in range(3):
        r.put("src/pkg/core.py", (r.root / "src/pkg/core.py").read_text() + f"# c{k}\n")
        r.put("settings.toml", f"a = {k + 2}\n")
        r.commit(f"config {k}")
    r.put("docs/index.md", "See [core](../src/pkg/core.py) and `pkg.util`, `src/pkg/util.py`.\n")
    r.put("web/app.js", "import {a} from './lib';\nconst b = require('./lib');\n")
    r.put("web/lib/index.js", "export const a = 1;\n")
    r.put("naïve.py", "import os\n")
    r.commit("docs")
    return r


@pytest.fixture(scope="module")
def g(spark, repo) -> FileGraph:
    return build.build_graph(spark, repo.root)


def edges(g, layer):
    return {(r["a"], r["b"]): r for r in g.layer(layer).collect()}


def test_files(g, repo):
    names = {r["id"] for r in g.files().collect()}
    assert {"src/pkg/core.py", "src/pkg/__init__.py", "settings.toml", "docs/index.md", "naïve.py", "web/lib/index.js"} <= names
    node = {r["id"]: r for r in g.nodes.collect()}
    assert node["tests/test_core.py"]["is_test"] and node["dir:."]["kind"] == "dir"
    assert node["src/pkg/core.py"]["lines"] == (repo.root / "src/pkg/core.py").read_bytes().count(b"\n")
    assert node["src/pkg/core.py"]["changes"] == 7  # the move included


def test_layers(g):
    structure = edges(g, "structure")
    assert ("src/pkg/core.py", "src/pkg/util.py") in structure and ("src/pkg/core.py", "tests/test_core.py") in structure
    assert structure["src/pkg/core.py", "tests/test_core.py"]["detail"]["symbols"] == ["core", "run"]
    assert structure["web/app.js", "web/lib/index.js"]["weight"] == 2.0
    evolution = edges(g, "evolution")
    assert evolution["src/pkg/core.py", "src/pkg/util.py"]["detail"]["count"] == 4
    assert evolution["settings.toml", "src/pkg/core.py"]["detail"]["count"] == 4
    assert edges(g, "hierarchy")["src/pkg/core.py", "tests/test_core.py"]["kinds"] == ["tests"]
    docs = edges(g, "docs")
    assert docs["docs/index.md", "src/pkg/core.py"]["weight"] == 1.0
    assert docs["docs/index.md", "src/pkg/util.py"]["weight"] == 0.5 and docs["docs/index.md", "src/pkg/util.py"]["detail"]["mentions"] == 2


def test_questions(g):
    rows = graph.related_files(g, ["src/pkg/core.py"], 5).orderBy("rank").collect()
    assert rows[0]["path"] in ("src/pkg/util.py", "settings.toml") and all(r["reasons"] for r in rows)
    assert any("changed together in 4 commits" in r["reasons"] for r in rows)
    loop = graph.related_files(g, ["src/pkg/core.py"], 5, method="loop").orderBy("rank").collect()
    assert [r["path"] for r in loop] == [r["path"] for r in rows]
    assert all(abs(a["score"] - b["score"]) < 2e-4 for a, b in zip(rows, loop))
    code = graph.related_files(g, ["src/pkg/core.py"], 5, code_only=True).collect()
    assert all(r["path"].endswith((".py", ".js")) for r in code)
    hidden = graph.hidden_dependencies(g, 3).collect()
    assert [(h["a"], h["b"], h["category"], h["structural_distance"]) for h in hidden] == [("settings.toml", "src/pkg/core.py", "config_code", None)]
    told = graph.explain_file(g, "src/pkg/core.py")
    assert told["language"] == "python" and told["layers"]["docs"][0]["path"] == "docs/index.md"
    with pytest.raises(KeyError):
        graph.explain_file(g, "nothing.py")
    way = graph.connection_path(g, "docs/index.md", "settings.toml")
    assert way[0]["from"] == "docs/index.md" and way[-1]["to"] == "settings.toml"
    assert graph.connection_path(g, "settings.toml", "settings.toml") == []
    with pytest.raises(ValueError):
        graph.connection_path(g, "settings.toml", "nothing.py")
    members = g.communities.collect()
    assert {m["file"] for m in members} == {r["id"] for r in g.files().collect()} and min(m["community"] for m in members) == 0


def test_keeping(spark, g, repo, tmp_path):
    build.save(g, tmp_path / "kept")
    again = build.load(spark, tmp_path / "kept")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(again.edges) == key(g.edges) and key(again.nodes) == key(g.nodes) and again.meta == g.meta
    there = build.from_json(spark, build.to_json(g))
    assert key(there.edges.select("a", "b", "weight", "kinds")) == key(g.edges.select("a", "b", "weight", "kinds")) and there.meta == g.meta
    with pytest.raises(ValueError):
        build.from_json(spark, json.dumps(json.loads(build.to_json(g)) | {"format": 0}))
    assert build.is_current(g, repo.root)


def test_report_and_vault(g, tmp_path):
    text = report.render(g)
    assert "`settings.toml` | `src/pkg/core.py` | config code" in text and "| evolution |" in text
    out = vault.export(g, tmp_path / "vault")
    note = (out / "src/pkg/core.py.md").read_text()
    assert "[[src/pkg/util.py|util.py]] — 4 commits" in note and "## Hidden dependencies" in note and "## Tests" in note
    assert json.loads((out / ".obsidian/graph.json").read_text())["colorGroups"]
    vault.export(g, tmp_path / "vault", "sr")
    assert "комита" in (out / "src/pkg/core.py.md").read_text()
    (tmp_path / "other").mkdir()
    with pytest.raises(FileExistsError):
        vault.export(g, tmp_path / "other")


def test_tools_and_cli(spark, repo, capsys, monkeypatch):
    named = tools.tools(tools.GraphStore(spark, repo.root))
    assert len(named) == 8
    assert named["rebuild_graph"]()["files"] == 9
    assert named["related_files"](["src/pkg/core.py"], 2)[0]["reasons"]
    with pytest.raises(tools.RequestError, match="Did you mean: src/pkg/core.py"):
        named["explain_file"]("src/pkg/cor.py")
    with pytest.raises(tools.RequestError):
        named["explain_file"]("/etc/passwd")
    assert named["hidden_dependencies"]()[0]["a"] == "settings.toml"
    assert set(named["rebuild_graph"]()["edges"]) >= {"hierarchy", "structure", "evolution"}
    with pytest.raises(tools.RequestError, match="language must be one of"):
        named["export_obsidian"]("somewhere", "de")
    monkeypatch.setattr(cli, "session", lambda: spark)
    assert cli.main(["hidden", "--repo", str(repo.root)]) == 0
    assert "settings.toml" in capsys.readouterr().out
    assert cli.main(["explain", "--repo", str(repo.root), "none.py"]) == 1
    assert cli.main(["related", "--repo", str(repo.root), "src/pkg/core.py", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)


def test_ranker_is_kept_until_rebuilt(spark, repo):
    store = tools.GraphStore(spark, repo.root)
    first = store.ranker()
    assert store.ranker() is first
    store.get(rebuild=True)
    assert store.ranker() is not first


def test_protocol(spark, repo, tmp_path):
    known = tools.tools(tools.GraphStore(spark, repo.root))
    (tmp_path / "full").mkdir()
    (tmp_path / "full" / "x").write_text("x")

    def ask(method, number=1, **params):
        return json.dumps({"jsonrpc": "2.0", "id": number, "method": method, "params": params})

    def call(name, **arguments):
        return ask("tools/call", name, name=name, arguments=arguments)

    lines = [
        ask("initialize", 0, protocolVersion="2024-11-05"), json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), "", ask("ping", "p"), ask("tools/list"),
        call("related_files", paths=["src/pkg/core.py"], limit=2), call("explain_file", path="src/pkg/cor.py"), call("explain_file", path="/etc/passwd"), call("export_obsidian", target_directory=str(tmp_path / "full")),
        call("project_report"), call("connection_path", source="src/pkg/core.py", target="src/pkg/util.py"), call("nothing"), call("related_files", paths="src"), call("related_files", limit=1), ask("prompts/list"), "{", "[]",
    ]
    said = [json.loads(x) for x in protocol.serve(known, lines)]
    assert len(said) == len(lines) - 2 and all(x["jsonrpc"] == "2.0" for x in said)
    start, ping, listed, related, wrong, outside, occupied, text, path, *errors = said
    assert start["result"]["protocolVersion"] == "2024-11-05" and start["result"]["serverInfo"]["name"] == "weft" and ping == {"jsonrpc": "2.0", "id": "p", "result": {}}
    named = {t["name"]: t for t in listed["result"]["tools"]}
    assert len(named) == 8 and all(t["description"] for t in named.values())
    assert named["related_files"]["inputSchema"]["required"] == ["paths"] and named["hidden_dependencies"]["inputSchema"]["properties"]["limit"] == {"type": "integer", "default": 15}
    assert named["communities"]["annotations"]["readOnlyHint"] and not named["rebuild_graph"]["annotations"]["readOnlyHint"]
    rows = json.loads(related["result"]["content"][0]["text"])
    assert len(rows) == 2 and related["result"]["structuredContent"] == {"result": rows}
    for x, part in ((wrong, "Did you mean: src/pkg/core.py"), (outside, "outside the project"), (occupied, "")):
        assert x["result"]["isError"] and part in x["result"]["content"][0]["text"]
    assert "# " in text["result"]["content"][0]["text"] and path["result"]["structuredContent"]["result"]
    assert [x["error"]["code"] for x in errors] == [protocol.PARAMETERS] * 3 + [protocol.UNKNOWN, protocol.BROKEN, protocol.INVALID]


def test_past_revision_and_time_split(spark, repo):
    chain = git.first_parents(spark, repo.root)
    assert chain.count() == 8
    moments = spark.createDataFrame([(START + 2 * DAY + 5,), (5,)], "moment bigint")
    at = {r["moment"]: r["sha"] for r in evaluate.revision_at(chain, moments).collect()}
    shas = [r["sha"] for r in chain.orderBy("seq").collect()]
    assert at == {START + 2 * DAY + 5: shas[2], 5: shas[0]}
    past = build.build_graph_at(spark, repo.root, shas[2], with_communities=False)
    assert past.meta["commits"] == 3 and edges(past, "evolution")["src/pkg/core.py", "src/pkg/util.py"]["detail"]["count"] == 3
    later = git.history_after(spark, repo.root, shas[2], "HEAD", git.files_at(spark, repo.root, shas[2]))
    assert later.where("file = 'src/pkg/core.py'").count() == 4
    unrenamed = git.history_until(spark, repo.root, shas[2], git.files_at(spark, repo.root, shas[2]), follow_renames=False)
    assert unrenamed.where("file like 'src/%'").select("sha").distinct().count() == 1


def test_walk_without_repository(spark, tmp_path):
    for name in ("app.py", "node_modules/x.js", ".venv/y.py", "build/z.py", "docs/index.md", "pkg/__init__.py", "big.py", "x.png", ".dot.yml"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("a" * (1_000_001 if name == "big.py" else 3))
    assert [r["path"] for r in files.scan(spark, tmp_path).orderBy("path").collect()] == [".dot.yml", "app.py", "docs/index.md", "pkg/__init__.py"]
    g = build.build_graph(spark, tmp_path)
    assert g.meta["weights"]["hierarchy"] == 0.7 and g.meta["revision"] == ""
