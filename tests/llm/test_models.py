"""Classifiers, mixing and the pipeline: held-out accuracy and exact parts."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from formloom.llm import linear
from formloom.llm import op05_quality as quality
from formloom.llm import op08_mixing as mixing
from formloom.llm import op09_toxicity as toxicity
from formloom.llm.common import NOT_WORD, words

MID, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


# The bars of the rarer toxic class are lower: with this table's 3,000 rows, inner
# folds have a recall of 0.83.
@pytest.mark.parametrize("name,label,threshold,recall,precision", [("op5_quality", "quality", 0.3, 0.95, 0.95), ("op9_toxicity", "toxic", 0.5, 0.75, 0.9)])
def test_held_out_recall_and_precision(spark, run, name, label, threshold, recall, precision):
    got = run(name, LARGE)
    assert (got.held_out == got.doc_id.map(held)).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= threshold).astype(int)).all()
    marks = spark.read.parquet(f"{LARGE}/labels.parquet").toPandas()
    rows = got.merge(marks, on="doc_id")
    rows = rows[rows.held_out]
    for kind in (0, 1):
        said, true = rows.predicted == kind, rows[label] == kind
        assert (said & true).sum() >= (recall if kind else 0.95) * true.sum() and (said & true).sum() >= (precision if kind else 0.95) * said.sum(), kind


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores])
def test_classifier_edges(edge, empty, labels, scores):
    got = scores(edge, labels).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
    assert scores(empty, labels).count() == 0
    assert {round(r.score, 6) for r in scores(edge, labels.limit(0)).collect()} == {0.5}
    one = labels.where("doc_id = 5")
    assert all(0 <= r.score <= 1 for r in scores(edge, one).collect())


def test_held_out_rows_are_not_read(spark, documents):
    marks = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = marks.withColumn("toxic", F.when(linear.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit_toxicity(documents, marks), toxicity.fit_toxicity(documents, flipped)
    assert (a.index == b.index).all() and (a.columns == b.columns).all() and a.bias == b.bias


def test_sample_is_bounded(spark):
    """By rows and by bytes, a doc_id that many rows have being one row."""
    rows = [(i % 50, f"w{i % 50} " * 100) for i in range(500)] + [(i, "z") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    marks = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(3, 0)] * 9, "doc_id long, toxic int")
    every = linear.training_rows(docs, marks, "toxic", 1000, 1 << 30).collect()
    ids = sorted(r._id for r in every)
    assert ids == [i for i in range(50) if not held(i)] and all(r.text in {t for d, t in rows if d == r._id} for r in every)
    assert {r._id: r.y for r in every}[4] == 0 and len({r._id: r.y for r in every}) == len(every)
    assert len(linear.training_rows(docs, marks, "toxic", 7, 1 << 30).collect()) == 7
    few = linear.training_rows(docs, marks, "toxic", 1000, 1200).collect()
    assert 0 < sum(len(r.text) for r in few) <= 1200 and {(r._id, r.text) for r in few} < {(r._id, r.text) for r in every}
    assert len(linear.training_rows(docs.where("text <> 'z'"), marks, "toxic", 1000, 5).collect()) == 1


def test_features_match_words():
    import re

    texts = ["Ab cd, ef-gh", "", "x", "ÉÉ b2!!"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    s, e, b = words(data, offsets, NOT_WORD)
    got = [[data[s[k] : e[k]].tobytes() for k in range(b[d], b[d + 1])] for d in range(len(texts))]
    want = [[w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)] for t in texts]
    assert got == want
    doc, feat = linear.skip_gram_features(18)(data, offsets)
    assert np.bincount(doc, minlength=4).tolist() == [4 + 3 + 2, 0, 1, 2 + 1]


def indicator_rows(n=200, seed=0):
    rng = np.random.default_rng(seed)
    rows = [np.unique(np.append(rng.integers(10, 500, 8), 1 if k % 2 else 2)) for k in range(n)]
    return rows, np.cumsum([0, *map(len, rows)]), np.array([k % 2 for k in range(n)], float)


def test_models_separate():
    rows, bounds, y = indicator_rows()
    feat, doc = np.concatenate(rows), linear.of_documents(bounds)
    model = linear.fit_nbsvm(bounds, feat, y, 10)
    m = linear.nbsvm_margins(model.dense(10), model.bias, doc, feat, 200)
    assert ((m > 0) == (y > 0.5)).mean() > 0.99
    w = linear.fit_ftrl(bounds, feat, y, 10)
    assert (((linear.ftrl_margins(w.dense(10), w.bias, doc, feat, 200)) > 0) == (y > 0.5)).mean() > 0.99
    assert len(w.index) < 100


def test_dual_coordinate_descent_by_hand():
    """Plain Python over dicts gives the same weights."""
    rows, bounds, y = indicator_rows(40, 4)
    rows[7] = rows[7][:0]
    bounds = np.cumsum([0, *map(len, rows)])
    got = linear.fit_nbsvm(bounds, np.concatenate(rows), y, 9, rounds=12, seed=7)
    pos, neg = {}, {}
    for r, label in zip(rows, y):
        for f in r.tolist():
            side = pos if label else neg
            side[f] = side.get(f, 0) + 1
    all_pos, all_neg = sum(pos.values()) + 512, sum(neg.values()) + 512
    ratio = {f: math.log((pos.get(f, 0) + 1) / all_pos / ((neg.get(f, 0) + 1) / all_neg)) for f in pos.keys() | neg.keys()}
    xs = []
    for r in rows:
        norm = math.sqrt(sum(ratio[f] ** 2 for f in r.tolist())) or 1.0
        xs.append({f: ratio[f] / norm for f in r.tolist()})
    w, bias, dual, order, rng = dict.fromkeys(ratio, 0.0), 0.0, [0.0] * 40, np.arange(40), np.random.default_rng(7)
    for _ in range(12):
        rng.shuffle(order)
        moved = 0.0
        for i in order.tolist():
            sign = 1 if y[i] else -1
            margin = sign * (sum(w[f] * v for f, v in xs[i].items()) + bias)
            new = min(max(dual[i] + (1 - margin) / 2, 0.0), 0.3 * 0.5 / 0.5)
            step, dual[i] = (new - dual[i]) * sign, new
            for f, v in xs[i].items():
                w[f] += step * v
            bias += step
            moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    dense = got.dense(9)
    assert abs(got.bias - bias) < 1e-6
    for f in range(512):
        assert abs(dense[0][f] - w.get(f, 0.0)) < 1e-6 and abs(dense[1][f] - ratio.get(f, 0.0)) < 1e-6


def test_ftrl_by_hand():
    """Plain Python, coordinate by coordinate, gives the same weights."""
    rows, bounds, y = indicator_rows(60, 5)
    got = linear.fit_ftrl(bounds, np.concatenate(rows), y, 9, alpha=2.0, beta=1.0, l1=0.7, l2=1.0, rounds=3, seed=11)
    z, n = {}, {}

    def weight(c, l1):
        if abs(z.get(c, 0.0)) <= l1:
            return 0.0
        return -(z[c] - math.copysign(l1, z[c])) / ((1.0 + math.sqrt(n[c])) / 2.0 + 1.0)

    rng = np.random.default_rng(11)
    for _ in range(3):
        for i in rng.permutation(60).tolist():
            at = [*((f, 0.7) for f in rows[i].tolist()), ("bias", 0.0)]
            ws = {c: weight(c, l1) for c, l1 in at}
            g = 1 / (1 + math.exp(-sum(ws.values()))) - y[i]
            for c, _ in at:
                old = n.get(c, 0.0)
                n[c] = old + g * g
                z[c] = z.get(c, 0.0) + g - (math.sqrt(n[c]) - math.sqrt(old)) / 2.0 * ws[c]
    dense = got.dense(9)[0]
    assert abs(got.bias - weight("bias", 0.0)) < 1e-6 and 0 < len(got.index) < 300
    for f in range(512):
        assert abs(dense[f] - (weight(f, 0.7) if f in z else 0.0)) < 1e-6


def test_op8(spark, run):
    got = run("op8_mixing", MID)
    names = sorted(got.posteriors[0])
    post = got.posteriors.map(lambda x: [x[n] for n in names]).tolist()
    total, post = got.n_tokens.sum(), np.array(post)
    assert np.allclose(post.sum(axis=1), 1) and (got.rate >= 0).all()
    shares = dict(zip(names, (got.n_tokens * got.rate).to_numpy() @ post / total))
    want = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}
    assert all(abs(shares[k] - v) < 1e-4 for k, v in want.items())
    assert (got.miss < 1e-4).all() and abs(max(abs(shares[k] - v) for k, v in want.items()) - got.miss[0]) < 1e-6
    assert abs((got.copies * got.n_tokens).sum() / (got.rate * got.n_tokens).sum() - 1) < 0.1
    lang = spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "lang").toPandas()
    assert (got.merge(lang, on="doc_id").eval("domain == lang")).mean() > 0.97


def memberships(spark, t, p):
    return spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p)], "t long, p array<double>")


def shares_after(t, p, steps):
    return p.T @ (t * mixing.rates(p, steps)) / t.sum()


def least_squares(t, p, w, steps=60_000):
    """Nonnegative least squares by plain projected gradient, one by one."""
    r, t = np.ones(len(t)), t / t.sum()
    for _ in range(steps):
        r = np.maximum(r - p @ (p.T @ (t * r) - w), 0)
    return p.T @ (t * r)


def test_op8_steps_reach_the_targets(spark):
    rng = np.random.default_rng(1)
    t, p = rng.integers(1, 50, 400).astype(float), rng.dirichlet([0.3, 0.3, 0.3], 400)
    w = np.array([0.7, 0.2, 0.1])
    steps, miss = mixing.fit_steps(memberships(spark, t, p), w)
    assert (mixing.rates(p, steps) >= 0).all() and abs(np.abs(shares_after(t, p, steps) - w).max() - miss) < 1e-9 and miss <= mixing.CLOSE
    # A domain with 2 % of the tokens and target 0.5: its rates are 25 and over.
    one = np.array([0] * 980 + [1] * 20)
    p = 0.96 * np.eye(2)[one] + 0.02
    steps, miss = mixing.fit_steps(memberships(spark, np.full(1000, 7.0), p), np.array([0.5, 0.5]))
    assert miss <= 1e-4 and mixing.rates(p, steps).max() > 20
    # 100 domains.
    t, p = rng.integers(1, 90, 3000).astype(float), 0.9 * np.eye(100)[rng.integers(0, 100, 3000)] + 0.001
    w = rng.dirichlet(np.full(100, 3.0))
    steps, miss = mixing.fit_steps(memberships(spark, t, p), w)
    assert miss <= 1e-4 and np.abs(shares_after(t, p, steps) - w).max() <= 1e-4


def test_op8_targets_out_of_reach(spark):
    """Every document is half of the first domain: the least squares point."""
    rng = np.random.default_rng(3)
    t, q = rng.integers(1, 50, 200).astype(float), rng.dirichlet([0.5, 0.5], 200)
    p = np.column_stack([np.full(200, 0.5), q / 2])
    w = np.array([0.0, 0.9, 0.1])
    steps, miss = mixing.fit_steps(memberships(spark, t, p), w)
    want = least_squares(t, p, w)
    assert np.abs(shares_after(t, p, steps) - want).max() < 0.01 and abs(miss - np.abs(want - w).max()) < 0.01 and miss > 0.1


def test_op8_many_domains(spark):
    """No domain is left out; the sample has rows of each."""
    rows = [(i, " ".join(f"d{i % 100}w{(i * 7 + k) % 9}" for k in range(12)), f"dom{i % 100:03}") for i in range(1500)]
    rows += [(5000 + i, "d0w1 d0w2 d0w3", "dom000") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    got = mixing.mixture_report(df, df.select("doc_id", "domain"), {f"dom{i:03}": 1 + i % 3 for i in range(100)}).toPandas()
    assert len(got.posteriors[0]) == 100 and (got.miss <= 1e-4).all()
    assert (got.merge(df.select("doc_id", "domain").toPandas(), on="doc_id").eval("domain_x == domain_y")).mean() > 0.95


def test_op8_edges(spark, edge, empty):
    labelled = edge.select("doc_id", F.col("lang").alias("domain"))
    got = mixing.mixture_report(edge, labelled, {"en": 1.0, "de": 1.0}).collect()
    assert len(got) == edge.count() and all(r.rate == 1.0 for r in got if r.n_tokens == 0)
    got = mixing.mixture_report(edge, labelled.limit(0), {"en": 1.0}).collect()
    assert len(got) == edge.count() and {r.rate for r in got} == {1.0}
    assert mixing.mixture_report(empty, labelled.limit(0), {}).count() == 0


def test_stages_on_edges(spark, edge, empty, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    columns = edge.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, edge, str(tmp_path))
        assert out.columns == columns, name
        if "mixing" in name:  # rates have no bound: rows repeat until targets are met, but all tokens together stay
            words = lambda df: df.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), " ")))).first()[0]
            assert words(out) <= 3 * words(edge)
        else:
            assert out.count() <= edge.count()
        assert stage(spark, empty, str(tmp_path)).count() == 0
    kept = corpus_pipeline.STAGES[2][1](spark, edge, str(tmp_path)).select("doc_id", "text").collect()
    assert sorted(r.doc_id for r in kept if r.text and r.text.startswith("a b c")) == [5]
    assert sorted(r.doc_id for r in kept if r.text and "wo" in r.text.lower() and len(r.text) < 20) == [12, ]
    assert corpus_pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0


def test_near_duplicate_stage_judges_rows(spark):
    """Clashing and null ids: of each group one row stays, and no other text."""
    a, b, c = "a b c d e f g h i j k l", "one two three four five six", "red green blue white black grey"
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (3, c, "x"), (3, "alone " * 9, "x"), (None, c, "x"), (None, "only here is this text", "x"), (4, b, "y"), (3, c, "z"), (3, c, "w"), (5, "", "p"), (5, None, "q"), (None, " ", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    stage = corpus_pipeline.STAGES[2][1]
    for again in (df, df.repartition(7), df.orderBy(F.rand(3))):
        got = sorted(map(tuple, stage(spark, again, "").collect()), key=str)
        if again is df:
            first = got
        assert got == first
    kept = [r[:2] for r in got]
    assert sorted(kept, key=str) == sorted([(1, a), (2, b), (3, c), (3, "alone " * 9), (None, "only here is this text"), (5, ""), (5, None), (None, " ")], key=str)


def test_pipeline(spark, documents, run):
    marks = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, documents, "/root/testdata/sf0.001")
    rows = kept.join(marks, "doc_id").toPandas()
    assert (rows.quality == 1).mean() > 0.95
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} and out.count() > 0
    assert len(corpus_pipeline.STAGES) == 5
