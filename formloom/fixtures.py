"""The driver's tables seen as provenance tables.

Each projection is SQL that Spark and DuckDB run alike; it is the only place
where both sides share text.  Names in braces are tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DAY = "CAST(CAST({c} AS DATE) AS STRING)"
FIELD = "concat('f', CAST(l_linenumber AS STRING))"

PROJECTIONS: dict[str, str] = {
    "documents": """
        SELECT c_custkey AS doc_id, c_mktsegment AS schema_id, concat('AMR_', CAST(c_custkey % 50 AS STRING), '_', c_name, '.png') AS source_path,
               CASE WHEN c_custkey % 17 = 0 THEN 'failed' ELSE 'ingested' END AS status, c_custkey % 97 AS ingested_at
        FROM {customer}""",
    "pages": """
        SELECT o_orderkey AS page_id, o_custkey AS doc_id,
               CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS page_no,
               CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS page_type
        FROM {orders}""",
    # (order, line) repeats: later rows are runs with another prompt version.
    "extractions": f"""
        SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', {DAY.format(c="l_shipdate")}, '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS extraction_id,
               l_orderkey AS page_id, {FIELD} AS field_name, {DAY.format(c="l_shipdate")} AS created_at,
               CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS value,
               concat('v', CAST(l_suppkey % 2 AS STRING)) AS prompt_version,
               CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE concat('r', CAST(l_orderkey AS STRING)) END AS region_id,
               l_linestatus = 'F' AS legible, 1.0 - (l_discount + 0.0) AS model_confidence,
               CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE concat('read ', CAST(CAST(l_quantity + CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE 0 END AS INT) AS STRING), ' units') END AS raw_transcription,
               (l_returnflag = 'R' OR l_discount > 0.08) AS flagged, CAST(l_suppkey % 40 AS INT) AS latency_ms
        FROM {{lineitem}}""",
    "gold": f"""
        SELECT page_id, field_name, CASE WHEN tie1 % 5 = 0 THEN NULL WHEN tie1 % 7 = 0 THEN q + 1 ELSE q END AS gold_value
        FROM (SELECT l_orderkey AS page_id, {FIELD} AS field_name, l_partkey AS tie1, CAST(l_quantity AS INT) AS q,
                     row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn
              FROM {{lineitem}}) t
        WHERE rn = 1 AND page_id % 9 <> 0""",
    # Two events for each of some orders' lines: the later one counts.
    "reviews": f"""
        SELECT concat(CAST(e.event_id AS STRING), '/', x.extraction_id) AS review_id, x.extraction_id, CAST(e.ts AS STRING) AS reviewed_at,
               CASE WHEN e.event_type = 'error' THEN 'reject' WHEN e.event_type IN ('click', 'purchase') THEN 'correct' ELSE 'accept' END AS action,
               CAST(CAST(floor(e.value) AS INT) AS STRING) AS corrected_value
        FROM {{events}} e JOIN (
            SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', {DAY.format(c="l_shipdate")}, '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS extraction_id, l_orderkey
            FROM {{lineitem}} WHERE l_linenumber <= 5) x ON x.l_orderkey = CAST(floor(e.event_id / 2.0) AS BIGINT) * 3""",
    "regions": """
        SELECT concat('r', CAST(o_orderkey AS STRING)) AS region_id, o_orderkey AS page_id, CAST(o_orderkey % 1000 AS INT) AS x0, CAST(o_custkey % 1000 AS INT) AS y0
        FROM {orders} WHERE o_orderkey % 5 <> 0""",
    "field_defs": """
        SELECT * FROM (VALUES (0, 'f1', CAST(NULL AS STRING)), (1, 'f2', NULL), (2, 'f3', 'F'), (3, 'f4', 'F'), (4, 'f5', 'O'), (5, 'f6', 'O'), (6, 'f7', NULL), (7, 'f8', 'O'))
        AS t(pos, field_name, field_page_type)""",
    "completions": """
        SELECT event_id, event_id % 7 AS kind, user_id, event_type,
               CASE event_id % 7
                 WHEN 0 THEN props
                 WHEN 1 THEN concat('```json', chr(10), props, chr(10), '```')
                 WHEN 2 THEN concat('Here it is: ', props, ' done')
                 WHEN 3 THEN replace(props, '}', ',}')
                 WHEN 4 THEN concat('<think>{"k": -1}</think>', props)
                 WHEN 5 THEN concat('[', props, ']')
                 ELSE concat('no json ', event_type) END AS text
        FROM {events}""",
    # Words of different case and spelling as JSON values of every kind.
    "raw_values": """
        SELECT event_id,
               CASE event_id % 12
                 WHEN 0 THEN CAST(event_id % 150 AS STRING)
                 WHEN 1 THEN concat('"', CAST(event_id % 150 AS STRING), '"')
                 WHEN 2 THEN concat(CAST(event_id % 150 AS STRING), '.0')
                 WHEN 3 THEN concat(CAST(event_id % 150 AS STRING), '.5')
                 WHEN 4 THEN concat('" ', CAST(event_id % 150 AS STRING), '.25 "')
                 WHEN 5 THEN 'true'
                 WHEN 6 THEN 'null'
                 WHEN 7 THEN concat('"', CAST(event_id % 150 AS STRING), ' years"')
                 WHEN 8 THEN concat('"', upper(event_type), '"')
                 WHEN 9 THEN concat('" ', event_type, ' "')
                 WHEN 10 THEN concat('["', event_type, '", "View"]')
                 ELSE concat('"', CAST(1 + event_id % 31 AS STRING), '/', CAST(1 + event_id % 14 AS STRING), '/20', CAST(10 + event_id % 20 AS STRING), '"') END AS raw
        FROM {events}""",
    "table_values": """
        SELECT event_id,
               CASE event_id % 5
                 WHEN 0 THEN concat('[{"drug": "', event_type, '", "dose": ', CAST(event_id % 20 AS STRING), '}]')
                 WHEN 1 THEN concat('[{"drug": "', event_type, '"}, {"drug": null, "dose": "', CAST(event_id % 20 AS STRING), '"}]')
                 WHEN 2 THEN concat('[{"drug": "', event_type, '", "unit": "mg"}]')
                 WHEN 3 THEN concat('[{"drug": "', event_type, '", "dose": "', CAST(event_id % 20 AS STRING), ' mg"}]')
                 ELSE concat('{"drug": "', event_type, '"}') END AS raw
        FROM {events}""",
}


def tables_of(name: str) -> list[str]:
    import re

    return sorted(set(re.findall(r"(?<!\{)\{(\w+)\}", PROJECTIONS[name])))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection as a DataFrame."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(name)}
    text = PROJECTIONS[name]
    for t in used:
        used[t].createOrReplaceTempView(f"fx_src_{t}")
        text = text.replace("{" + t + "}", f"fx_src_{t}")
    return spark.sql(text)


def ctes(*names: str) -> str:
    """WITH clause of projections for DuckDB."""
    parts = []
    for n in names:
        text = PROJECTIONS[n]
        for t in tables_of(n):
            text = text.replace("{" + t + "}", t)
        parts.append(f"{'fx_' + n} AS ({text})")
    return "WITH " + ",\n".join(parts) + "\n"
