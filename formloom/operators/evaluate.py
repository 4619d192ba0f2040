"""Scores of stored readings against a gold set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import covers, first_word, percent, token_set
from .latest import newest

COUNTERS = ("n", "correct", "flagged", "auto_accepted", "auto_accepted_correct", "false_negative_flags", "halluc_opportunities", "hallucinations", "hallucinations_escaped")


def load_gold(spark, path: str) -> DataFrame:
    """(pair_id, field_name, gold_json) of a gold CSV; of repeated (pair, field)
    the last line counts."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"')
    # A file of quoted line breaks is read by one task, in order.
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file")).withColumn("_line", F.monotonically_increasing_id())
    return newest(rows, ["pair_id", "field_name"], ["_file", "_line"], ["gold_json"])


def pair_documents(documents: DataFrame, pair: Column) -> DataFrame:
    """The newest document of each pair id."""
    return newest(documents.withColumn("pair_id", pair).where("pair_id IS NOT NULL"), ["pair_id"], ["ingested_at", "doc_id"], ["doc_id"])


def newest_readings(extractions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest reading of each key, whatever its page or prompt version."""
    return newest(extractions, keys, order)


def newest_of_field(extractions: DataFrame, pages: DataFrame, field: str, order: list[str]) -> DataFrame:
    """The newest reading of one field for each document, whatever its page."""
    rows = extractions.where(F.col("field_name") == field).join(pages.select("page_id", "doc_id"), "page_id")
    return newest(rows, ["doc_id"], order)


def judged(gold: DataFrame, readings: DataFrame, keys: list[str], match: Column) -> DataFrame:
    """Gold rows with the reading of their key and `ok`; without one, found is
    false."""
    rows = gold.join(readings.withColumn("found", F.lit(True)), keys, "left")
    return rows.withColumn("found", F.coalesce("found", F.lit(False))).withColumn("ok", match)


def scorecard(rows: DataFrame, field: str = "field_name", value: str = "value", gold: str = "gold_value") -> DataFrame:
    """The counters of each field and of all (field null).
    `rows` has found, ok, flagged, legible, value and gold."""
    ok, flagged = F.col("ok"), F.coalesce(F.col("flagged"), F.lit(False))
    invented = F.col(gold).isNull() & F.col(value).isNotNull() & F.coalesce(F.col("legible"), F.lit(False))
    tests = (F.lit(True), ok, flagged, ~flagged, ~flagged & ok, ~flagged & ~ok, F.col(gold).isNull(), invented, invented & ~flagged)
    sums = [F.count_if(t).alias(n) for n, t in zip(COUNTERS, tests)]
    # By field first: the grand total is made of a few rows, not of every row twice.
    by_field = rows.where("found").groupBy(field).agg(*sums)
    return by_field.rollup(field).agg(*[F.sum(n).alias(n) for n in COUNTERS])


def ratios(scores: DataFrame) -> DataFrame:
    def part(num, den):
        return F.try_divide(F.col(num).cast("double"), F.col(den).cast("double"))

    return scores.select(
        "*",
        part("correct", "n").alias("exact"),
        part("auto_accepted_correct", "auto_accepted").alias("auto_accuracy"),
        part("flagged", "n").alias("flag_rate"),
        part("false_negative_flags", "auto_accepted").alias("fn_flag_rate"),
        part("hallucinations", "halluc_opportunities").alias("halluc_rate"),
        part("hallucinations_escaped", "halluc_opportunities").alias("halluc_escaped_rate"),
    )


def missing_pairs(gold: DataFrame, pairs: DataFrame) -> DataFrame:
    return gold.select("pair_id").distinct().join(pairs, "pair_id", "left_anti")


def null_share(gold: DataFrame, value: str) -> DataFrame:
    return gold.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value).isNull()).alias("n_null"))


def render_markdown(scores: DataFrame, set_name: str, missing_pages: list[str] = (), missing: list[str] = (), field: str = "field_name") -> str:
    """The report; `scores` has a row for each declared field, which is few."""
    shown = [("correct", "n"), ("auto_accepted_correct", "auto_accepted"), ("flagged", "n"), ("false_negative_flags", "auto_accepted"), ("hallucinations", "halluc_opportunities"), ("hallucinations_escaped", "halluc_opportunities")]
    cells = [percent(F.col(a), F.col(b)).alias(f"c{i}") for i, (a, b) in enumerate(shown)]
    rows = sorted(scores.select(field, "n", *cells).collect(), key=lambda r: (r[0] is None, r[0]))
    out = [f"# Eval report -- **{set_name} set**", ""]
    if set_name == "flow":
        out += ["> The flow set shows that the parts work together. It is no measure of accuracy; the held-out set is.", ""]
    out += ["| field | n | exact acc | auto-acc acc | flag rate | FN flag rate | halluc | halluc esc. |", "|---|--:|--:|--:|--:|--:|--:|--:|"]
    out += ["| " + " | ".join(["**overall**" if r[0] is None else r[0], *map(str, r[1:])]) + " |" for r in rows]
    if missing_pages:
        out += ["", f"Missing pages (gold but never extracted): {', '.join(missing_pages)}"]
    if missing:
        out += ["", f"Missing fields: {len(missing)} (first 10: {', '.join(missing[:10])})"]
    return "\n".join(out)


# ---------------------------------------------------------------- token scores

def token_matches(gold: DataFrame, got: DataFrame, page: str, gold_text: str, got_text: str, key: str, composed: bool = False, share: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Gold rows with `hit`, and readings with `spurious`, within each page;
    `key` tells the rows of each side apart.

    A gold row of n tokens is hit by a reading of its page that has at least
    need = ceil(share * n) of them, so that has one of any n - need + 1.  Only
    the n - need + 1 that fewest readings of the page have are joined on; the
    pairs found are verified once.
    """
    g = gold.select(page, F.col(key).alias("_g"), token_set(F.col(gold_text), composed).alias("_gt"))
    c = got.select(page, F.col(key).alias("_c"), token_set(F.col(got_text), composed).alias("_ct"))
    read = c.select(page, "_c", F.explode("_ct").alias("_t"))
    often = read.groupBy(page, "_t").agg(F.count(F.lit(1)).alias("_f"))
    each = g.select(page, "_g", F.explode("_gt").alias("_t")).join(often, [page, "_t"], "left")
    # As many tokens as a text has.
    ranked = each.groupBy(page, "_g").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_f", F.lit(0)).alias("_f"), "_t"))).alias("_o"))
    kept = F.size("_o") - F.ceil(F.size("_o") * F.lit(share) - F.lit(1e-9)).cast("int") + 1
    prefix = ranked.select(page, "_g", F.explode(F.slice("_o", F.lit(1), kept)).alias("_p")).where("_p._f > 0").select(page, "_g", F.col("_p._t").alias("_t"))
    pairs = prefix.join(read, [page, "_t"]).select(page, "_g", "_c").distinct()
    near = pairs.join(g, [page, "_g"]).join(c, [page, "_c"]).where(covers(F.col("_gt"), F.col("_ct"), share))
    hits = near.select(page, F.col("_g").alias(key)).distinct().withColumn("hit", F.lit(True))
    used = near.select(page, F.col("_c").alias(key)).distinct().withColumn("_used", F.lit(True))
    gold_rows = gold.join(hits, [page, key], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    got_rows = got.join(used, [page, key], "left").withColumn("spurious", F.col("_used").isNull()).drop("_used")
    return gold_rows, got_rows


def token_scores(gold_rows: DataFrame, got_rows: DataFrame) -> DataFrame:
    """tp, fn, fp, precision, recall, f1; 0 where undefined."""
    a = gold_rows.agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("fn"))
    b = got_rows.agg(F.count_if("spurious").alias("fp"))
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double")), F.lit(0.0))
    # One row each.
    return a.withColumn("_k", F.lit(1)).join(F.broadcast(b.withColumn("_k", F.lit(1))), "_k").select("tp", "fn", "fp", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def brand_recall(gold: DataFrame, got: DataFrame, page: str, gold_text: str, got_text: str, composed: bool = False) -> DataFrame:
    """How many gold rows' first words are among their page's tokens."""
    read = got.select(page, F.explode(token_set(F.col(got_text), composed)).alias("brand")).distinct().withColumn("_r", F.lit(True))
    named = gold.withColumn("brand", F.lower(first_word(F.col(gold_text)))).where("brand IS NOT NULL")
    return named.join(read, [page, "brand"], "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_r").isNotNull()).alias("read"))


def page_rates(pages: DataFrame) -> DataFrame:
    """Share of pages read exactly, and of pages with a flag."""
    return pages.agg(F.count(F.lit(1)).alias("pages"), F.avg(F.col("exact").cast("double")).alias("exact_rate"), F.avg(F.col("flagged").cast("double")).alias("flag_rate"))


