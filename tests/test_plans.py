"""Schemas, rules, prompts, guards, images, files and sinks."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from formloom import images, netguard
from formloom import schema as sc
from formloom.operators import evaluate, finalize, registry, store
from formloom.plans import prompts
from formloom.plans.rules import RuleError, compile_rule, failed_rules, names_in
from formloom.schema import FieldDef, Rule, Schema, SchemaError
from formloom.sources import completions, files
from formloom.sources.regions import located, padded
from formloom.streaming import ingest as streaming

SCOPE = {"a": "number", "b": "number", "s": "text", "n": "number", "rows": "list", "e": "list"}
VALUES = "1 AS a, 2 AS b, 'x' AS s, CAST(NULL AS INT) AS n, CAST(NULL AS ARRAY<STRUCT<d: STRING>>) AS rows, array(1) AS e"


@pytest.mark.parametrize(
    "rule,failed",
    [
        ("a < b", False), ("a > b", True), ("0 <= a <= 5", False), ("n > 1", False), ("n == None", False), ("n is not None", True), ("missing > 3 or a > b", False), ("a > b or missing > 3", False),
        ("s in ['x', 'y']", False), ("s not in ['x']", True), ("len(rows or []) > 0", True), ("len(e) == 1", False), ("a + b == 3", False), ("b / a >= 2", False), ("a if b > 1 else missing", False),
        ("missing if b > 1 else a", False), ("not s", True), ("s == 1", True), ("n + 1 > 0", False), ("s != 'x' or len(rows or []) > 0", True), ("a - 1", True), ("a is None or 0 <= a <= 120", False), ("5 > b > 3 > missing", True),
    ],
)
def test_rules(spark, rule, failed):
    row = spark.sql(f"SELECT {VALUES}").select(compile_rule(rule, {k: (F.col(k), t) for k, t in SCOPE.items()}).alias("r")).first().r
    assert (row.failed, row.error) == (failed, False)


def test_rule_errors(spark):
    row = spark.sql("SELECT 1 AS a, 0 AS b").select(compile_rule("a / b > 1", {"a": (F.col("a"), "number"), "b": (F.col("b"), "number")}).alias("r")).first().r
    assert row.error and not row.failed
    for bad in ("__import__('os')", "a.b", "-a > 1", "a % 2 == 0", "[x for x in e]", "lambda: 1"):
        with pytest.raises(RuleError):
            compile_rule(bad, {"a": (F.col("a"), "number"), "e": (F.col("e"), "list")})
    assert names_in("len(a or []) > 0 or b") == {"a", "b"}


def test_rules_by_page_type(spark):
    schema = Schema("s", page_types=("x", "y"), fields=(FieldDef("a", "integer"), FieldDef("only_y", "integer", page_type="y")), rules=(Rule("only_y > 5", message="low"),))
    df = spark.sql("SELECT 1 AS a, 1 AS only_y")
    assert failed_rules(df, schema, "x").first().failed_rules == []
    got = failed_rules(df, schema, "y").first().failed_rules[0]
    assert (got.message, got.names) == ("cross-field rule failed: low", ["only_y"])


def test_schema(tmp_path):
    (tmp_path / "a.yaml").write_text("schema_id: one\nfields:\n- {name: x, type: integer, min: 0, max: 5}\n")
    (tmp_path / "b.yaml").write_text("schema_id: two\npage_types: [{id: p}]\nfields:\n- {name: x, type: string, page_type: p}\n- {name: y, type: string}\n")
    (tmp_path / "c.yaml").write_text("schema_id: bad\nfields:\n- {name: x, type: enum}\n")
    assert [s.schema_id for s in sc.list_schemas(tmp_path)] == ["one", "two"]
    two = sc.find_schema(tmp_path, "two")
    assert [f.name for f in two.fields_for("q")] == ["y"] and [f.name for f in two.fields_for(None)] == ["x", "y"]
    with pytest.raises(SchemaError):
        FieldDef("x", "integer", required=True, min=3, max=1)
    FieldDef("x", "integer", min=3, max=1)
    with pytest.raises(SchemaError):
        sc.find_schema(tmp_path, "none")
    with pytest.raises(FileNotFoundError):
        sc.load_config(tmp_path / "none.yaml")


def test_prompts():
    table = FieldDef("v", "table", columns=(FieldDef("t", "float"),), max_rows=3)
    assert prompts.value_schema(table)["maxItems"] == 3
    assert prompts.value_schema(FieldDef("e", "enum", values=("a",)))["enum"] == ["a", None]
    assert "v" in prompts.field_prompt(table, Schema("s")) and "shape" in prompts.repair_prompt(table)
    assert prompts.spark_value_type(table) == "array<struct<t:double>>"
    assert prompts.version_key(None, verify=True) == prompts.PROMPT_VERSION
    keys = [prompts.version_key("grid"), prompts.version_key("grid", ("table",)), prompts.version_key("grid", verify=True), prompts.version_key("grid", verify=True, verify_model="org/m"), prompts.version_key("other")]
    assert len(set(keys)) == 5 and all(k.startswith(prompts.PROMPT_VERSION + ".") for k in keys)
    assert prompts.version_key("grid", ("table", "date"), True, "org/m") == prompts.version_key("grid", ("date", "table"), True, "m")
    said = prompts.field_prompt(FieldDef("age", "integer", min=0.0, max=120.0, extract_hint="in years"), Schema("s"))
    assert all(x in said for x in ("age", "integer", "0 or more", "120 or less", "in years"))


def test_netguard():
    assert netguard.problems("http://127.0.0.1:8000/v1", env={}) == []
    assert len(netguard.problems("http://example.org", env={"HTTP_PROXY": "http://proxy:1", "OPENAI_API_KEY": "k"})) == 3
    assert netguard.problems("http://box", ["box"], env={"HTTP_PROXY": "http://localhost:1"}) == []
    import socket

    with netguard.outbound_only(), pytest.raises(netguard.Blocked):
        socket.create_connection(("203.0.113.1", 9), timeout=1)


def test_engine_registry(spark):
    with pytest.raises(KeyError):
        completions.engine("none")

    class Fixed:
        name, version, model = "fixed", "1", "m"

        def complete(self, system, user, images, json_schema=None):
            if user == "fail":
                raise RuntimeError("no")
            return completions.Completion(user.upper(), "m", 1.0)

    req = spark.createDataFrame([("p", "f", "primary", "page", "hi", None, None), ("p", "g", "primary", "page", "fail", None, None)], "page_id string, field_name string, role string, source string, user string, json_schema string, image binary")
    got = {r.field_name: r for r in completions.ask(req, Fixed, "s").collect()}
    assert got["f"].text == "HI" and got["g"].error == "no"
    assert completions.replay(req, completions.ask(req, Fixed, "s")).count() == 2


def page(tilt=0.0, h=900, w=700):
    img = np.full((h, w), 245, np.uint8)
    x = np.arange(40, w - 40)
    for y in range(100, h - 100, 50):
        for t in range(3):
            img[np.clip(np.rint(y + t + np.tan(np.radians(tilt)) * (x - w / 2)).astype(int), 0, h - 1), x] = 40
    return img


def test_images():
    assert images.skew_degrees(np.full((300, 300), 250, np.uint8)) == 0.0
    for tilt in (0.0, 2.0, -3.0):
        assert images.skew_degrees(page(tilt)) == pytest.approx(tilt, abs=0.25)
    fixed, angle = images.preprocess(page(2.0), max_edge=2400)
    assert angle == pytest.approx(2.0, abs=0.25) and abs(images.skew_degrees(fixed)) <= 0.3
    assert images.cap_long_edge(page(), 450).shape == (450, 350)
    lines = images.ruled_lines(page())
    assert len(lines) == 14 and lines == sorted(lines)
    assert images.ruled_lines(np.full((300, 300), 250, np.uint8)) == []
    assert images.crop(page(), (10, 10, 50, 60), 24).shape == (84, 74)
    noisy = np.clip(page(h=60, w=60).astype(int) + np.random.default_rng(1).integers(-4, 5, (60, 60)), 0, 255).astype(np.uint8)
    assert images.denoise(noisy).std() <= noisy.std()


def test_png_round_trip():
    import struct
    import zlib

    rng = np.random.default_rng(3)
    for img in (rng.integers(0, 256, (7, 5, 3), dtype=np.uint8), np.full((4, 9, 3), 7, np.uint8)):
        assert (images.png_array(images.png_bytes(img)) == img).all()
    assert (images.png_array(images.png_bytes(img[..., 0])) == img).all()
    # Every row filter, by the format's own definitions.
    img = rng.integers(0, 256, (5, 6, 3), dtype=np.uint8)
    raw, flat = b"", img.reshape(5, 18).astype(int)
    for y in range(5):
        line = bytearray()
        for i in range(18):
            a, b, c = (flat[y, i - 3] if i >= 3 else 0), (flat[y - 1, i] if y else 0), (flat[y - 1, i - 3] if y and i >= 3 else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((flat[y, i] - [0, a, b, (a + b) // 2, paeth][y]) & 255)
        raw += bytes([y]) + bytes(line)
    plain = images.png_bytes(img)
    at = plain.index(b"IDAT")
    size = struct.unpack(">I", plain[at - 4 : at])[0]
    body = zlib.compress(raw)
    made = plain[: at - 4] + struct.pack(">I", len(body)) + b"IDAT" + body + struct.pack(">I", zlib.crc32(b"IDAT" + body)) + plain[at + 8 + size :]
    assert (images.png_array(made) == img).all()
    with pytest.raises(ValueError):
        images.png_array(b"GIF89a")


def test_line_heights_one_by_one():
    """Against a scan row by row."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        cover = np.repeat(rng.choice([0.0, 0.1, 0.25, 0.3, 0.4, 0.9], 30), rng.integers(1, 25, 30))
        ys, y = [], 0
        for y in range(len(cover)):
            inside = y > 0 and cover[y - 1] >= 0.21
            if cover[y] >= 0.35 and not any(s <= y < e for s, e, _ in ys):
                e = next((k for k in range(y, len(cover)) if cover[k] < 0.21), len(cover))
                ys.append((y, e, inside))
        found = [(s + e) // 2 for s, e, _ in ys]
        gaps = np.diff(found)
        good = len(found) >= 4 and np.median(gaps) >= 8 and np.percentile(gaps, 90) <= 4 * np.median(gaps)
        assert images.line_heights(cover, 1000) == ([round(v / 1000, 4) for v in found] if good else [])


def test_gold_invariants(spark):
    from formloom.operators import invariants

    schema = Schema("s", page_types=("x", "y"), fields=(
        FieldDef("age", "integer", min=0.0, max=120.0), FieldDef("kind", "enum", values=("a", "b")), FieldDef("note", "string", max_length=3, page_type="x"),
        FieldDef("rows", "table", page_type="y", columns=(FieldDef("t", "float", min=30.0, max=45.0), FieldDef("d", "string")), max_rows=2),
    ))
    cases = [("age", "34", None), ("age", "null", None), ("age", '"34"', "not an integer"), ("age", "121", "out of range"), ("kind", '"a"', None), ("kind", '"A"', "not a member"), ("note", '"abc"', None), ("note", '"abcd"', "too long"), ("note", "5", "not a text"),
             ("rows", "null", "not a list of rows"), ("rows", "[]", None), ("rows", '[{"t": 36.5, "d": null}]', None), ("rows", '[{"t": 36.5}]', "columns differ"), ("rows", '[{"t": 50, "d": "x"}]', "cell out of range"), ("rows", '[{"t": "x", "d": "x"}]', "cell out of range"), ("rows", '{"t": 1}', "not a list of rows"),
             ("rows", '[{"t":31,"d":""},{"t":31,"d":""},{"t":31,"d":""}]', "too many rows")]
    df = spark.createDataFrame([(i, f, v) for i, (f, v, _) in enumerate(cases)], "i int, field_name string, gold_json string")
    got = {r.i: r.problem for r in invariants.gold_problems(df, schema).collect()}
    assert got == {i: p for i, (_, _, p) in enumerate(cases) if p}
    pages = spark.createDataFrame([("p", "x"), ("q", "y"), ("r", None)], "page_id string, page_type string")
    gold = spark.createDataFrame([("p", "age"), ("p", "kind"), ("q", "age"), ("q", "kind"), ("q", "rows")], "page_id string, field_name string")
    assert [tuple(r) for r in invariants.gold_uncovered(gold, pages, sc.field_defs(spark, schema)).collect()] == [("p", "note")]


def test_token_matches_one_by_one(spark):
    """Against every pair of every page; long and common tokens alike."""
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, " ".join(["the", *(f"w{k}" for k in rng.integers(0, 14, rng.integers(0, 7)))]) if i % 11 else "--") for i in range(90)]
    got = [(i, p, " ".join(w for k, w in enumerate(t.split(" ")) if (i + k) % 3)) for i, p, t in rows]
    schema = "k int, page int, text string"
    a, b = evaluate.token_matches(spark.createDataFrame(rows, schema), spark.createDataFrame(got, schema), "page", "text", "text", "k")
    import re

    sets = lambda rs: [(k, p, set(re.findall("[a-z0-9]+", t))) for k, p, t in rs]
    near = [(g, c) for g, p, x in sets(rows) for c, q, y in sets(got) if p == q and x and len(x & y) / len(x) >= 0.6]
    assert {r.k for r in a.where("hit").collect()} == {g for g, _ in near} and a.count() == 90
    assert {r.k for r in b.where("spurious").collect()} == {i for i, *_ in got} - {c for _, c in near} and b.count() == 90


def test_boxes(spark):
    text = json.dumps({"regions": [{"label": "age", "bbox_2d": [0, 0, 500, 500]}, {"label": "label 'name': x", "bbox_2d": [1, 2, 3, 1000]}, {"label": "age name", "bbox_2d": [0, 0, 9, 9]}, {"label": "age", "bbox_2d": [9, 9, 1, 1]}, {"label": "age", "bbox_2d": [1, 1]}]})
    df = spark.createDataFrame([("p", text, 1000, 2000), ("q", "none", 10, 10)], "page_id string, text string, width_px int, height_px int")
    got = {(r.page_id, r.field_name): r.bbox for r in located(df, ["age", "name"]).collect()}
    assert got == {("p", "age"): [0, 0, 500, 1000], ("p", "name"): [1, 4, 3, 2000]}
    assert spark.range(1).select(padded(F.array(*map(F.lit, (5, 5, 50, 60))), F.lit(60), F.lit(70), 24)).first()[0] == [0, 0, 60, 70]


def decoder(content):  # sent by value: tests are no package of the workers
    if content == b"bad":
        raise ValueError("broken")
    return [(10, 20, content)] * (2 if content.startswith(b"two") else 1)


def test_ingest(spark, tmp_path):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    src = tmp_path / "in"
    (src / "sub").mkdir(parents=True)
    for name, body in (("a.png", b"one"), ("sub/b.PNG", b"one"), ("c.tif", b"two"), ("d.png", b"bad"), ("e.txt", b"x"), (".h.png", b"y"), ("g.pdf", b"pdf")):
        (src / name).write_bytes(body)
    scanned = files.scan(spark, str(src))
    assert scanned.count() == 5
    none = spark.createDataFrame([], store.TABLES["documents"])
    docs, pages, results = files.ingest(scanned, none, {".png": decoder, ".tif": decoder}, "s", F.current_timestamp())
    assert {r.source_path.rsplit("/", 1)[1]: r.page_count for r in docs.collect()} == {"a.png": 1, "c.tif": 2}
    assert pages.count() == 3
    assert {r.outcome: r.n for r in store.outcomes(results).collect()} == {"ingested": 2, "duplicate": 1, "failed": 2}
    out = tmp_path / "store"
    for _ in range(2):
        streaming.start(spark, str(src), str(out), str(tmp_path / "cp"), {".png": decoder, ".tif": decoder}).awaitTermination()
    (src / "again.png").write_bytes(b"one")
    (src / "new.png").write_bytes(b"three")
    streaming.start(spark, str(src), str(out), str(tmp_path / "cp"), {".png": decoder, ".tif": decoder}).awaitTermination()
    assert streaming.table(spark, str(out), "documents").count() == 3
    assert streaming.table(spark, str(out), "pages").count() == 4


def records(spark):
    rows = [("r1", "d1", "s", "a.png", "2025-01-01", {"age": "34", "when": "null", "ok": "true", "meds": '[{"d": "x"}]', "name": '"A, B"'}), ("r2", "d2", "s", "b.png", "2025-01-02", {"age": "null", "extra": "1.5"})]
    return spark.createDataFrame(rows, "record_id string, doc_id string, schema_id string, source_path string, finalized_at string, final map<string,string>")


def test_sinks(spark, tmp_path):
    recs = records(spark)
    assert set(finalize.field_order(recs)) == {"age", "when", "ok", "meds", "name", "extra"} and finalize.field_order(recs)[-1] == "extra"
    rows = {r.record_id: r for r in finalize.csv_rows(recs).collect()}
    assert (rows["r1"].age, rows["r1"].when, rows["r1"].ok, rows["r1"].meds, rows["r1"]["name"], rows["r1"].extra) == ("34", "", "True", '[{"d": "x"}]', "A, B", "")
    finalize.write_csv(recs, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').where("record_id = 'r1'").first()
    assert back["name"] == "A, B"
    finalize.write_jsonl(recs, str(tmp_path / "jsonl"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "jsonl")).collect()]
    assert {x["record_id"]: x["fields"] for x in lines}["r1"] == {"age": 34, "when": None, "ok": True, "meds": [{"d": "x"}], "name": "A, B"}


def test_registry(spark, monkeypatch):
    recs, sent = records(spark), []

    def post(url, data):
        sent.append(json.loads(data["data"]))
        return 200, json.dumps({"count": len(sent[-1])})

    settings = {"api_url": "https://reg.example.org/api/", "token_env": "TOK", "field_map": {"age": "years", "meds": "drugs"}}
    with pytest.raises(registry.RegistryError):
        registry.send(recs, settings, ())
    with pytest.raises(registry.RegistryError):
        registry.send(recs, settings, ("reg.example.org",), post)
    monkeypatch.setenv("TOK", "secret")
    assert registry.send(recs, settings, ("reg.example.org",), post).count() == 2
    assert {"record_id": "r1", "years": "34", "drugs": '[{"d": "x"}]'} in sent[0]
    with pytest.raises(registry.RegistryError, match="1 of 2"):
        registry.send(recs, settings, ("reg.example.org",), lambda u, d: (200, '{"count": 1}'))
    with pytest.raises(registry.RegistryError, match="HTTP 500"):
        registry.send(recs, settings, ("reg.example.org",), lambda u, d: (500, "down"))


def test_report(spark):
    rows = spark.createDataFrame([("age", True, True, False, True, "1", "1"), ("age", True, False, False, True, "2", None), ("sex", True, True, True, False, None, None)], "field_name string, found boolean, ok boolean, flagged boolean, legible boolean, value string, gold_value string")
    text = evaluate.render_markdown(evaluate.scorecard(rows), "held", ["X_1"], ["X_1.age"])
    assert "| age | 2 | 50% | 50% | 0% | 50% | 100% | 100% |" in text
    assert "| **overall** | 3 | 67% | 50% | 33% | 50% | 50% | 50% |" in text and "Missing pages" in text


def test_gold(spark, tmp_path):
    path = tmp_path / "gold.csv"
    path.write_text('pair_id,page_no,field_name,gold_json\nA_1,1,age,3\nA_1,1,age,4\nA_1,1,m,"[{""d"": ""x, y""}]"\n')
    got = {r.field_name: r.gold_json for r in evaluate.load_gold(spark, str(path)).collect()}
    assert got == {"age": "4", "m": '[{"d": "x, y"}]'}
