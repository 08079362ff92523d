"""The catalogue operators on a generated hub, and every query against its SQL."""

from __future__ import annotations

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.text import tokens
from sparkloom.operators import deps, manifest, prep, review, search, versions
from sparkloom.plans import queries
from sparkloom.plans.schemas import CODE_RULES, GENERIC, INDUSTRY, PROMPT_RULES, REQUIRED, taxonomy
from sparkloom.sources import packages
from sparkloom.streaming.review import review_files, stream_review

FOLDER = "/root/testdata/sf0.001"
PROMPT = "You are a helper. Task: sort. Output JSON. Example: a. If there is nothing, say so."


def put(top: Path, root: str, category: str, agent: str, files: dict[str, str]) -> None:
    for name, text in files.items():
        path = top / root / category / agent / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")


def described(**changes) -> str:
    base = {"name": "good", "id": "1", "description": "d", "author": "a", "version": "1.0.0", "system_prompt": PROMPT, "skills": [{"name": "sum", "custom": True}, {"name": "web", "custom": False}], "mcps": [], "kb_refs": ["k"], "params": {"max_steps": "5"}, "examples": [{"turn": 0, "role": "user", "text": "hi"}]}
    return json.dumps({k: v for k, v in (base | changes).items() if v is not None}, ensure_ascii=False)


@pytest.fixture(scope="module")
def hub(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree") / "hub"
    put(top, GENERIC, "数据处理", "good", {"agent.json": described(), "README.md": "r", "CHANGELOG.md": "1.0.0 first", "skills/sum.md": "add"})
    put(top, GENERIC, "不存在", "odd", {"agent.json": described(name="odd", description=None, system_prompt=" "), "mcps/run.py": "import os\nos.system('x')\n"})
    put(top, INDUSTRY, "教育", "broken", {"agent.json": "{bad", "README.md": "mail me a@b.org"})
    put(top, INDUSTRY, "医疗", "bare", {"README.md": "r"})
    return str(top)


def test_scan_and_checks(spark, hub):
    files = packages.scan_packages(spark, hub).cache()
    assert {r["kind"] for r in files.collect()} == {"manifest", "readme", "changelog", "skill", "mcp"}
    assert {r["agent"]: r["rule"] for r in review.check_structure(files).join(files.select("agent_key", "agent").distinct(), "agent_key").collect()} == {"bare": "manifest_missing", "odd": "readme_missing"}
    agents = packages.parse_manifests(files.filter("kind = 'manifest'")).cache()
    assert {r["agent"]: r["status"] for r in agents.collect()} == {"good": "ok", "odd": "ok", "broken": "corrupt"}
    good = agents.filter("status = 'ok'")
    missing = {(r["agent_key"].rpartition("/")[2], r["rule"]) for r in review.check_completeness(good, REQUIRED).collect()}
    assert missing == {("odd", "blank_description"), ("odd", "blank_system_prompt")}
    assert {r["agent_key"].rpartition("/")[2] for r in review.lint_prompts(good, PROMPT_RULES).collect()} == {"odd"}
    placed = deps.assign_taxonomy(files.select("root", "category", "agent").distinct(), taxonomy(spark), ["root", "category"])
    assert {r["agent"]: r["severity"] for r in placed.collect()} == {"good": None, "odd": "warn", "broken": "fail", "bare": None}
    bindings = manifest.flatten_bindings(good)
    registry = spark.createDataFrame([("skill", "mail")], "kind string, name string")
    assert {r["name"] for r in deps.missing_platform_deps(bindings, registry, ["kind", "name"]).collect()} == {"web"}
    present = files.filter("kind in ('skill', 'mcp')").select("agent_key", "kind", packages.custom_name(F.col("file")).alias("name"))
    status = {(r["agent_key"].rpartition("/")[2], r["name"]): r["status"] for r in deps.reconcile_bundles(bindings.filter("custom"), present, ["agent_key", "kind", "name"]).collect()}
    assert status == {("good", "sum"): "ok", ("odd", "sum"): "not_bundled", ("odd", "run"): "unused"}
    assert [(r["line_no"], r["rule"]) for r in review.scan_code(files.filter("kind = 'mcp'"), CODE_RULES).collect()] == [(2, "shell")]
    covered = {r["agent_key"].rpartition("/")[2]: r["covered"] for r in review.changelog_coverage(good, files.filter("kind = 'changelog'")).collect()}
    assert covered == {"good": True, "odd": False}
    assert manifest.flatten_params(good, {"max_steps": "int"}).first()["typed"] == 5.0
    assert manifest.flatten_kb_refs(good).count() == 2 and manifest.flatten_examples(good).count() == 2


def test_verdicts(spark):
    agents = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "agent_key string")
    found = spark.createDataFrame([("a", "r", "warn", ""), ("b", "r", "fail", ""), ("c", "r", "unknown", "")], "agent_key string, rule string, severity string, evidence string")
    tests = spark.createDataFrame([("a", True), ("b", True), ("c", True)], "agent_key string, passed boolean")
    assert {r["agent_key"]: r["verdict"] for r in review.review_verdict(agents, [found], tests).collect()} == {"a": "pass", "b": "fail", "c": "needs-human", "d": "needs-human"}


def test_versions(spark):
    rows = [("a", 1, "1.9.0", "x"), ("a", 2, "1.10.0", "y"), ("b", 1, "1.0", "x"), ("b", 2, "1.0.0", "y"), ("c", 1, "1.0", "x"), ("c", 2, "v2-beta", "y"), ("d", 1, None, "x"), ("d", 2, "1", "x")]
    out = versions.version_audit(spark.createDataFrame(rows, "agent_key string, snapshot_ts int, version string, content_hash string"))
    assert {r["agent_key"]: r["status"] for r in out.collect()} == {"a": "ok", "b": "fail", "c": "unknown"}


def test_stream_equals_batch(spark, hub, tmp_path):
    landing, out, state = tmp_path / "hub", str(tmp_path / "out"), str(tmp_path / "state")
    names = sorted(p.relative_to(hub) for p in Path(hub).rglob("*") if p.is_file())
    for half in (names[::2], names[1::2]):
        for n in half:
            (landing / n).parent.mkdir(parents=True, exist_ok=True)
            (landing / n).write_bytes((Path(hub) / n).read_bytes())
        stream_review(spark, str(landing), out, state)
    columns = ["agent_key", "rule", "severity", "evidence"]
    batch = review_files(packages.scan_packages(spark, hub).select("path", "content")).select(columns)
    assert sorted(map(tuple, spark.read.parquet(out).select(columns).collect())) == sorted(map(tuple, batch.collect()))


def test_text_helpers(spark):
    df = spark.createDataFrame([(1, "数据 清洗"), (2, None), (3, "A b-C")], "id int, t string")
    assert {r["id"]: r["x"] for r in df.select("id", tokens(F.col("t"), "char").alias("x")).collect()} == {1: ["数据", "据清", "清洗"], 2: [], 3: ["ab", "bc"]}
    once = df.select(prep.clean_text(F.lit("a ### b\t\n c\x07 %%%")).alias("t"))
    assert once.first()["t"] == "a b c" == once.select(prep.clean_text(F.col("t")).alias("t")).first()["t"]
    same = spark.createDataFrame([(1, "a b c d e"), (2, "A  b c d e"), (3, "x"), (4, None)], "id int, t string")
    assert {(r["id"], r["kept"]) for r in search.exact_duplicates(same, "id", "t").collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}
    assert search.near_duplicates(same, "id", "t", 3, 0.8).count() == 0


def test_xml_and_json_keep_rows(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string").write.json(str(tmp_path / "j"))
    back = packages.convert_format(spark, str(tmp_path / "j"), "json", str(tmp_path / "x"), "xml", "id long, t string")
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, "b")]


def normal(value):
    return None if value is None or value != value else round(value, 9) if isinstance(value, float) else value


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no fixture tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for path in Path(FOLDER).iterdir():
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    own, sql = queries.QUERIES[name](spark, FOLDER), db.sql(queries.ORACLE_SQL[name])
    assert sorted(own.columns) == sorted(sql.columns)
    places = [sql.columns.index(c) for c in own.columns]
    key = lambda row: tuple(map(str, row))
    assert sorted((tuple(map(normal, r)) for r in own.collect()), key=key) == sorted((tuple(normal(r[i]) for i in places) for r in sql.fetchall()), key=key)


def test_related_items_in_blocks(spark, monkeypatch):
    from sparkloom.operators import vectors

    rows = [(i, [((i * 37 + j * 11) % 23) / 7 - 1.5 for j in range(6)]) for i in range(120)]
    every = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = every.filter("vec_id % 2 = 0")
    at_once = {tuple(r) for r in vectors.nearest(every, asked, 4).collect()}
    assert len(at_once) == 240
    monkeypatch.setattr(vectors, "QUERIES", 7)
    assert {tuple(r) for r in vectors.nearest(every, asked, 4).collect()} == at_once


def test_near_duplicates_by_bands(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join([*words[:100], "new", *words[101:]]), " ".join(reversed(words)), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    exact = {tuple(r) for r in search.near_duplicates(docs, "id", "t", 3, 0.8).collect()}
    assert {r[:2] for r in exact} == {(0, 1)}
    assert {tuple(r) for r in search.near_duplicates(docs, "id", "t", 3, 0.8, approximate=(20, 3)).collect()} == exact


def test_smoothing_across_ranges(spark):
    from sparkloom.operators import aggregates

    rows = [("a", i, float(i * i % 17)) for i in range(300)] + [("b", 1, 2.0), ("b", 2, None), ("c", 5, 1.0)]
    df = spark.createDataFrame(rows, "p string, o int, v double")
    for n in (1, 4, 120):
        got = {(r["p"], r["o"]): r["moving_average"] for r in aggregates.smooth_and_scale(df, "p", ["o"], "v", n).collect()}
        assert len(got) == len(rows)
        for p, o, _ in rows:
            near = [v for q, k, v in rows if q == p and k <= o][-n:]
            known = [v for v in near if v is not None]
            assert (got[p, o] is None) if not known else abs(got[p, o] - sum(known) / len(known)) < 1e-9


def test_exact_median(spark):
    import statistics

    for values in ([], [None], [3.0], [1.0, 2.0], [5.0] * 50 + [1.0, None, 9.0], [float(i * 37 % 101) for i in range(100)]):
        known = [v for v in values if v is not None]
        got = prep.median(spark.createDataFrame([(v,) for v in values], "v double"), "v")
        assert got == (statistics.median(known) if known else None)


def test_facets_of_parameters(spark):
    agents = spark.createDataFrame([(1, {"k": "5", "m": "x"}), (2, {"k": "n"}), (3, None), (4, {"k": "50"})], "id int, params map<string,string>")
    ids = lambda **kw: {r["id"] for r in manifest.facet_filter(agents, **kw).collect()}
    assert ids(params={"k": (1, 9)}) == {1} and ids(params={"m": "x"}) == {1} and ids(params={"k": [5, 50]}) == {1, 4} and ids(params={"k": 5}, id=4) == set()
