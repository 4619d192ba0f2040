"""Coercion, scoring, comparison and JSON repair, case by case."""

import json

import pytest
from pyspark.sql import functions as F

from formloom.functions import coerce as co
from formloom.functions import compare, score, text
from formloom.functions.jsonrepair import balanced_object, envelope, parsed, repair
from formloom.operators.extract import read_fields
from formloom.schema import FieldDef, Schema

AGE = FieldDef("age", "integer", min=0.0, max=120.0)
TABLE = FieldDef("v", "table", columns=(FieldDef("temp", "float", min=25.0, max=45.0), FieldDef("pulse", "integer")), max_rows=2)
CASES = [
    (AGE, "34", 34, None), (AGE, '" +34 "', 34, None), (AGE, "34.0", 34, None), (AGE, "1e2", 100, None),
    (AGE, "34.5", None, "34.5 has a fractional part"), (AGE, "true", None, "boolean is not an integer"), (AGE, '"34 years"', None, "'34 years' is not an integer"),
    (AGE, "121", None, "121 is above max 120.0"), (AGE, "-1", None, "-1 is below min 0.0"), (AGE, "[1]", None, "cannot coerce list to integer"), (AGE, "null", None, None),
    (FieldDef("n", "integer"), "12345678901234567890", 12345678901234567890, None), (FieldDef("n", "integer"), '"-99999999999999999999999"', -99999999999999999999999, None), (AGE, "12345678901234567890", None, "12345678901234567890 is above max 120.0"),
    (FieldDef("n", "integer"), '"' + "9" * 40 + '"', None, "9" * 40 + " has more than 38 digits"), (FieldDef("n", "integer"), "9223372036854775807", 9223372036854775807, None), (AGE, '{"a": 1}', None, "cannot coerce dict to integer"),
    (FieldDef("b", "boolean"), '["view", "View"]', None, "['view', 'View'] is not a boolean"), (FieldDef("b", "boolean"), '{"a": [1, null, true], "b\'s": 2.5}', None, "{'a': [1, None, True], \"b's\": 2.5} is not a boolean"), (FieldDef("b", "boolean"), "[]", None, "[] is not a boolean"),
    (FieldDef("c", "checkbox_group", values=("blood",)), '["blood", null, "x"]', None, "None is not one of ['blood']"), (FieldDef("c", "checkbox_group", values=("blood",)), '[["blood"]]', None, "['blood'] is not one of ['blood']"),
    (FieldDef("t", "float"), '".5"', 0.5, None), (FieldDef("t", "float"), '"5."', 5.0, None), (FieldDef("t", "float"), '"1e3"', None, "'1e3' is not a number"), (FieldDef("t", "float"), "7", 7.0, None),
    (FieldDef("d", "date"), '" 1/2/2025 "', "1/2/2025", None), (FieldDef("d", "date"), '"31/02/2025"', None, "'31/02/2025' does not parse as %d/%m/%Y"), (FieldDef("d", "date"), "5", None, "date must be a string, got int"),
    (FieldDef("d", "date", format="%Y-%m-%d"), '"2025-03-04"', "2025-03-04", None),
    (FieldDef("e", "enum", values=("Male", "Female")), '" male "', "Male", None), (FieldDef("e", "enum", values=("Male",)), '"x"', None, "'x' is not one of ['Male']"),
    (FieldDef("b", "boolean"), '"TRUE"', True, None), (FieldDef("b", "boolean"), "false", False, None), (FieldDef("b", "boolean"), "1", None, "1 is not a boolean"),
    (FieldDef("c", "checkbox_group", values=("blood", "urine")), '["Urine","blood","blood"]', ["urine", "blood", "blood"], None), (FieldDef("c", "checkbox_group", values=("blood",)), '["x"]', None, "'x' is not one of ['blood']"),
    (FieldDef("c", "checkbox_group", values=("blood",)), '"blood"', None, "checkbox_group must be a list"),
    (FieldDef("s", "string", max_length=3), '"\\u00a0abc\\n"', "abc", None), (FieldDef("s", "string", max_length=3), '"abcd"', None, "length 4 exceeds max_length 3"),
    (FieldDef("s", "string", regex="[a-z]+"), '"ab1"', None, "'ab1' does not match [a-z]+"), (FieldDef("s", "free_text"), "3", None, "expected a string, got int"),
    (TABLE, '[{"temp": "36.6"}]', [{"temp": 36.6, "pulse": None}], None), (TABLE, "[]", [], None), (TABLE, '[{"temp": 50}]', None, "row 0: temp: coercion failed -- 50.0 is above max 45.0"),
    (TABLE, '[{"x": 1}]', None, "row 0 has unknown columns ['x']"), (TABLE, '[{},{},{}]', None, "3 rows exceeds max_rows 2"), (TABLE, "[1]", None, "row 0 is not an object"), (TABLE, '{"temp": 1}', None, "table must be a list of row objects"),
]


@pytest.mark.parametrize("fd,raw,value,error", CASES)
def test_coerce(spark, fd, raw, value, error):
    row = spark.range(1).select(co.coerce(F.try_parse_json(F.lit(raw)), fd).alias("c")).first().c
    got = [r.asDict() for r in row.value] if fd.type == "table" and row.value is not None else row.value
    assert got == value
    assert row.error == (None if error is None else f"{fd.name}: coercion failed -- {error}")


def test_json_text(spark):
    row = spark.range(1).select(co.json_text(F.lit("a\"b")).alias("s"), co.json_text(F.lit(None).cast("int")).alias("n"), co.json_text(F.array(F.lit(1))).alias("a")).first()
    assert (json.loads(row.s), row.n, row.a) == ('a"b', "null", "[1]")


REPAIRS = [
    ('{"value": NaN, "legible": true}', {"value": None, "legible": True}), ('{"a": [-Infinity]}', {"a": [None]}),
    ('{"a": 1}', {"a": 1}), ('  {"a": 1}\n', {"a": 1}), ('```json\n{"a": 1}\n```', {"a": 1}), ('```\n{"a": 1}```', {"a": 1}), ('Sure: {"a": {"b": 2}} done', {"a": {"b": 2}}),
    ('x {"a": "}{"} y', {"a": "}{"}), ('{"a": 1,}', {"a": 1}), ('{"a": [1, 2,],}', {"a": [1, 2]}), ('<think>{"a": 0}</think>{"a": 1}', {"a": 1}), ("", None), ("no", None), ('{"a": 1', None), ("[1]", None), ("{'a': None}", None),
    ('[{"a": 1}]', {"a": 1}), ('{"a": 1, "a": 2}', {"a": 2}), ('{"q": "say \\"{\\" now"} tail', {"q": 'say "{" now'}),
]


@pytest.mark.parametrize("raw,want", REPAIRS)
def test_repair(raw, want):
    got = repair(raw)
    assert (None if got is None else json.loads(got)) == want


def test_repair_in_spark(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(REPAIRS)], "i int, t string")
    got = {r.i: r.j for r in parsed(df, "t", "v").select("i", F.to_json("v").alias("j")).collect()}
    for i, (_, want) in enumerate(REPAIRS):
        assert (None if got[i] is None else json.loads(got[i])) == want


def test_balanced():
    assert balanced_object('a {"x": "}"} b') == '{"x": "}"}'
    assert balanced_object("{ {") is None


def test_envelope(spark):
    def env(t):
        return spark.range(1).select(envelope(F.try_parse_json(F.lit(t))).alias("e")).select("e.legible", "e.confidence", "e.raw_transcription", "e.note").first()

    assert tuple(env('{"value": 1}')) == (False, 0.0, None, None)
    assert tuple(env('{"legible": true, "confidence": true, "raw_transcription": 5, "note": null}')) == (True, 1.0, "5", None)
    assert tuple(env('{"legible": "no", "confidence": "0.9", "note": "x"}')) == (True, 0.0, None, "x")


@pytest.mark.parametrize(
    "fd,value,raw,want",
    [
        (AGE, "34", "34 yrs", 1.0), (AGE, "34", "43", 0.0), (AGE, "34", None, 0.5), (AGE, "CAST(NULL AS INT)", "x", 1.0), (AGE, "-3", "-3", 0.0),
        (FieldDef("t", "float"), "36.5D", "T 36.50 C", 1.0), (FieldDef("d", "date"), "'05/03/2025'", "5 March", 1.0), (FieldDef("d", "date"), "'05/03/2025'", "'25", 1.0),
        (FieldDef("d", "date"), "'05/03/2025'", "7 June", 0.0), (FieldDef("s", "string"), "'x'", "y", 1.0),
    ],
)
def test_agreement(spark, fd, value, raw, want):
    assert spark.range(1).select(score.agreement(F.expr(value), F.lit(raw).cast("string"), fd)).first()[0] == want


def test_outcome(spark):
    fd = FieldDef("age", "integer", required=True)
    out = score.outcome(F.lit(None).cast("bigint"), F.lit("bad"), F.lit(False), F.lit(2.0), F.lit(None).cast("string"), fd, 0.85)
    row = spark.range(1).select(out.alias("o")).first().o
    assert row.flag_reason == "coercion/validation failed; model reports illegible; required field is null"
    assert row.composite == pytest.approx(0.2)
    low = score.outcome(F.lit(5).cast("bigint"), F.lit(None).cast("string"), F.lit(True), F.lit(0.84), F.lit("5"), fd, 0.85)
    assert spark.range(1).select(low.alias("o")).first().o.flag_reason == "composite confidence 0.84 below threshold 0.85"


def test_matching(spark):
    def same(a, b):
        return spark.range(1).select(compare.texts_match(F.lit(a).cast("string"), F.lit(b).cast("string"))).first()[0]

    assert same("E. J", "e j") and same("Ｏ’Neil", "o'neil") and same("5×3", "5 x 3".replace(" ", "")) and same(None, None)
    assert not same("a", None) and not same("a", "b")
    nums = spark.range(1).select(compare.numbers_match(F.lit(1.0), F.lit(1.0 + 1e-12)), compare.numbers_match(F.lit(1), F.lit(2))).first()
    assert tuple(nums) == (True, False)
    got = F.array(F.struct(F.lit(36.5).alias("temp"), F.lit(None).cast("bigint").alias("pulse")))
    fd = FieldDef("v", "table", columns=(FieldDef("temp", "float"), FieldDef("pulse", "integer")))
    assert spark.range(1).select(compare.values_match(got, got, fd)).first()[0]


def test_comparison_form_of_other_texts(spark):
    """Texts that are not in compatibility form, one by one."""
    import re
    import unicodedata

    texts = ["Ｏ’Neil  ×３", "ﬁne\u00a0Ｄr．", "\u2460 a—b–c", "e\u0301t\u00e9, ÉTÉ", "\u3000x\u2003y\x1f", "½ ㎎", "", "İI ß ẞ"]

    def form(x):
        x = unicodedata.normalize("NFKC", x)
        for a, b in (("’", "'"), ("‘", "'"), ("–", "-"), ("—", "-"), ("×", "x")):
            x = x.replace(a, b)
        return re.sub(r"\s+", " ", re.sub(r"[.,;:\-'’]", " ", x)).strip().lower()

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", text.comparison_form(F.col("t")).alias("f"), F.array_sort(text.token_set(F.col("t"))).alias("k")).collect()
    assert {r.i: r.f for r in got} == {i: form(x) for i, x in enumerate(texts)}
    assert {r.i: r.k for r in got} == {i: sorted(set(re.findall("[a-z0-9]+", unicodedata.normalize("NFKC", x).lower()))) for i, x in enumerate(texts)}


def test_percent_and_strip(spark):
    row = spark.range(1).select(text.percent(F.lit(1), F.lit(8)), text.percent(F.lit(3), F.lit(8)), text.percent(F.lit(1), F.lit(0)), text.strip(F.lit("  a b ")), text.pair_id(F.lit("AMR_004_HTR")), text.pair_id(F.lit("x_1"))).first()
    assert tuple(row) == ("12%", "38%", "-", "a b", "AMR_004", None)


def test_read_fields(spark):
    schema = Schema("s", fields=(FieldDef("age", "integer"), FieldDef("name", "string")))
    rows = [
        ("p1", "age", "primary", '{"value": 34, "legible": true, "confidence": 0.95, "raw_transcription": "34"}', 10.0),
        ("p1", "name", "primary", "garbage", 5.0), ("p1", "name", "retry", '{"value": "Ann", "legible": true, "confidence": 0.5}', 7.0),
        ("p2", "age", "primary", "garbage", 3.0),
    ]
    got = {(r.page_id, r.field_name): r for r in read_fields(spark.createDataFrame(rows, "page_id string, field_name string, role string, text string, latency_ms double"), schema.fields, 0.85).collect()}
    assert got["p1", "age"].value == "34" and not got["p1", "age"].flagged
    assert got["p1", "name"].value == '"Ann"' and got["p1", "name"].flagged and got["p1", "name"].latency_ms == 12
    bad = got["p2", "age"]
    assert (bad.value, bad.validation_status, bad.flag_reason, bad.legible) == ("null", "unparsed", score.UNPARSED, None)
