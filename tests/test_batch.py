"""A whole extraction batch over stored replies."""

import json

from pyspark.sql import functions as F

from formloom.operators.batch import extract_batch
from formloom.schema import FieldDef, Rule, Schema

SCHEMA = Schema(
    "s", page_types=("note", "rx"), default_page_type="note",
    fields=(
        FieldDef("document_type", "enum", values=("note", "rx")), FieldDef("age", "integer", min=0.0, max=120.0), FieldDef("plan", "string", page_type="note"),
        FieldDef("meds", "table", page_type="rx", columns=(FieldDef("drug", "string"),)),
    ),
    rules=(Rule("document_type != 'rx' or len(meds or []) > 0", message="no drugs"), Rule("age is None or age < 100")),
)


def env(value, raw=None, conf=0.95, legible=True):
    return json.dumps({"value": value, "legible": legible, "confidence": conf, "raw_transcription": raw, "note": None})


REPLIES = [
    ("p1", "document_type", "page", "primary", env("rx", "rx")), ("p1", "age", "page", "primary", env(34, "34")), ("p1", "meds", "page", "primary", env([], "none")),
    ("p2", "document_type", "page", "primary", env(None)), ("p2", "age", "page", "primary", "??"), ("p2", "age", "page", "retry", env(101, "101")), ("p2", "plan", "crop", "primary", env("rest", "rest")), ("p2", "plan", "page", "primary", env("wrong")),
    ("p2", "plan", "page", "verify", env("sleep", "sleep")), ("p3", "age", "page", "primary", env(5, "5")), ("p1", "age", "page", "verify", env(34, "34")),
]


def test_batch(spark):
    replies = spark.createDataFrame([(*r, 10.0, "m") for r in REPLIES], "page_id string, field_name string, source string, role string, text string, latency_ms double, model string")
    pages = spark.createDataFrame([("p1", None), ("p2", None), ("p3", "rx")], "page_id string, page_type string")
    before = spark.createDataFrame([("p3", "meds", '[{"drug":"x"}]', "v1"), ("p3", "age", "7", "v0")], "page_id string, field_name string, value string, prompt_version string")
    crops = spark.createDataFrame([("p2", "plan", "r9", "c.png")], "page_id string, field_name string, region_id string, crop_path string")
    typed, rows = extract_batch(pages, replies, SCHEMA, before, "v1", F.lit("2025-01-01"), crops=crops, crop_types=("string",), verify=True)
    assert {r.page_id: r.page_type for r in typed.collect()} == {"p1": "rx", "p2": "note", "p3": "rx"}
    got = {(r.page_id, r.field_name): r for r in rows.collect()}
    assert set(got) == {("p1", "document_type"), ("p1", "age"), ("p1", "meds"), ("p2", "document_type"), ("p2", "age"), ("p2", "plan"), ("p3", "age")}
    assert not got["p1", "age"].flagged and got["p1", "age"].value == "34" and got["p1", "age"].latency_ms == 20
    assert got["p1", "meds"].flag_reason == "cross-field rule failed: no drugs" == got["p1", "document_type"].flag_reason
    assert got["p2", "age"].value == "101" and got["p2", "age"].flag_reason == "cross-field rule failed: age is None or age < 100" and got["p2", "age"].latency_ms == 20
    plan = got["p2", "plan"]
    assert plan.value == '"rest"' and plan.flag_reason == "verify pass disagreement: second read from the whole page gave \"sleep\"" and plan.region_id == "r9"
    assert abs(plan.composite - 0.475) < 1e-9 and plan.note == "verify read: 'sleep'"
    assert not got["p3", "age"].flagged
    again = extract_batch(typed, replies, SCHEMA, rows.select("page_id", "field_name", "value", "prompt_version").unionByName(before), "v1", F.lit("2025-01-02"), verify=True)[1]
    assert again.count() == 0


class Reader:
    """Answers by the field that a prompt asks for."""

    name, version, model = "reader", "1", "m"
    SAYS = {"document_type": "note", "age": 34, "plan": "rest"}

    def complete(self, system, user, images, json_schema=None):
        from formloom.sources.completions import Completion

        assert images and images[0].startswith(b"\x89PNG")
        field = user.split(",")[0]
        if field == "plan" and "last answer" not in user:
            return Completion("well, rest", "m", 3.0)
        return Completion(json.dumps({"value": self.SAYS[field], "legible": True, "confidence": 0.99, "raw_transcription": str(self.SAYS[field]), "note": None}), "m", 5.0)


def test_run_from_files_to_records(spark, tmp_path):
    """Ingest with images kept, a run, review, records; then nothing is left to do."""
    import sys

    import numpy as np
    from pyspark import cloudpickle

    from formloom import images
    from formloom.operators import review, store
    from formloom.operators import run as runs
    from formloom.schema import Config
    from formloom.sources import files, regions

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    src, path = tmp_path / "in", str(tmp_path / "store")
    src.mkdir()
    for name, shade in (("A_1.png", 200), ("A_2.png", 90)):
        (src / name).write_bytes(images.png_bytes(np.full((300, 500, 3), shade, np.uint8)))
    (src / "bad.png").write_bytes(b"no image")
    docs, pages, results = files.ingest(files.scan(spark, str(src)), runs.table(spark, path, "documents"), files.available_decoders(), "s", F.current_timestamp(), images.prepared(max_edge=250))
    docs = docs.persist()
    assert {r.outcome: r.n for r in store.outcomes(results).collect()} == {"ingested": 2, "failed": 1}
    store.append("pages", files.with_page_images(pages, f"{path}/images"), path)
    store.append("documents", docs, path)
    rows = runs.table(spark, path, "pages").collect()
    assert len(rows) == 2 and all((r.width_px, r.height_px, r.deskew_angle) == (250, 150, 0.0) for r in rows)
    assert sorted(images.png_array(files.read_image(r.image_path))[0, 0, 0] for r in rows) == [90, 200]
    assert not list((tmp_path / "store" / "images").rglob("*.part"))

    boxes = spark.createDataFrame([(rows[0].page_id, "age", [10, 10, 60, 40]), (rows[0].page_id, "plan", [0, 0, 30, 30])], "page_id string, field_name string, bbox array<int>")
    found, crops = regions.cut_out(runs.table(spark, path, "pages"), boxes, f"{path}/images", "grid", "1", margin=5)
    store.append("regions", found, path)
    cut = {r.field_name: images.png_array(files.read_image(r.crop_path)).shape for r in crops.collect()}
    assert cut == {"age": (40, 60, 3), "plan": (35, 35, 3)} and runs.table(spark, path, "regions").count() == 2

    config, at = Config(), F.lit("2025-01-01").cast("timestamp")
    counts = {r.outcome: r.n for r in runs.run(spark, path, SCHEMA, config, Reader, at=at).collect()}
    assert counts == {"asked as primary": 6, "asked as retry": 2}
    got = runs.table(spark, path, "extractions").collect()
    assert {(r.field_name, r.value, r.model_name) for r in got} == {("document_type", '"note"', "m"), ("age", "34", "m"), ("plan", '"rest"', "m")} and len(got) == 6
    assert {r.status for r in runs.table(spark, path, "documents").collect()} == {"extracted"} and {r.page_type for r in runs.table(spark, path, "pages").collect()} == {"note"}
    assert runs.run(spark, path, SCHEMA, config, Reader, at=at).collect() == [] and runs.table(spark, path, "extractions").count() == 6

    flagged = [r for r in got if r.flagged]
    assert {r.field_name for r in flagged} == {"document_type"} or not flagged
    age = next(r.extraction_id for r in got if r.field_name == "age")
    said = [(age, "correct", '"Ad"'), (age, "correct", "200"), (age, "correct", "35"), (age, "correct", None), (age, "accept", "7"), (age, "burn", None), ("none", "accept", None), (age, "correct", "{"), (age, "reject", None)]
    given = spark.createDataFrame([(*r, "me", None) for r in said], "extraction_id string, action string, corrected_value string, reviewer string, comment string")
    judged = [(r.action, r.corrected_value, r.problem) for r in review.checked(given, runs.table(spark, path, "extractions"), SCHEMA).collect()]
    assert sorted(judged, key=str) == sorted([
        ("correct", None, "age: coercion failed -- 'Ad' is not an integer"), ("correct", None, "age: coercion failed -- 200 is above max 120.0"), ("correct", "35", None), ("correct", "null", None), ("accept", None, None),
        ("burn", None, "no such action: 'burn'"), ("accept", None, "no such extraction"), ("correct", None, "the correction is no JSON value"), ("reject", None, None),
    ], key=str)
    keep = review.checked(given.where("corrected_value = '35'"), runs.table(spark, path, "extractions"), SCHEMA)
    store.append("reviews", review.accepted(keep, F.lit("2025-01-02").cast("timestamp")), path)
    assert runs.finalize_documents(spark, path, at=at).count() == 0
    final = [json.loads(r.final_json) for r in runs.table(spark, path, "records").collect()]
    assert sorted(x["age"] for x in final) == [34, 35] and {r.status for r in runs.table(spark, path, "documents").collect()} == {"finalized"}
    assert runs.finalize_documents(spark, path, at=at).count() == 0 and runs.table(spark, path, "records").count() == 2
