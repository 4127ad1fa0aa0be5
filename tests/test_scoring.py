import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.errors import SourceError, VerifyError
from sparkloom.functions import text
from sparkloom.plans import calibration, compare, scoring
from sparkloom.sources import records


def runs(tmp_path, name, rows):
    (tmp_path / name).write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    return str(tmp_path / name)


def test_paired_scores(spark, tmp_path):
    q = {"max_tokens": 64, "questions": [{"id": i, "lang": "en", "category": c, "prompt": "p", "answer": "a", "checks": [k]} for i, c, k in (("q1", "math", {"type": "number", "value": 4}), ("q2", "fact", {"type": "contains", "patterns": ["Ｐａｒｉｓ"]}), ("q3", "open", {"type": "open"}))]}
    (tmp_path / "q.json").write_text(json.dumps(q, indent=1))
    questions = records.read_questions(spark, str(tmp_path / "q.json"))
    side = lambda *out: [{"id": f"q{i + 1}", "raw_output": x, "gen_s": i + 0.5, "max_tokens": 64, "temp": 0.0} for i, x in enumerate(out)]
    a = records.read_runs(spark, runs(tmp_path, "a", [{"id": "q1", "raw_output": "old"}, *side("4", "It is PARIS!", "x")]))
    b = records.read_runs(spark, runs(tmp_path, "b", [*side("4 or 5", "paris", "x " * 3), {"id": "q9", "raw_output": ""}]))
    items = scoring.paired(questions, a, b).cache()
    s = scoring.summary(items).first()
    assert (s.n_questions, s.n_scored, s.n_open, s.source_accuracy, s.candidate_accuracy, s.verdict_agreement, s.n_flips) == (3, 2, 1, 1.0, 0.5, 0.5, 1)
    assert [r.id for r in scoring.flips(items).collect()] == ["q1"]
    assert {r.category: (r.source_correct, r.candidate_correct, r.n) for r in scoring.by_category(items).collect()} == {"math": (1, 0, 1), "fact": (1, 1, 1)}
    t = scoring.timings(items, "source_gen_s").first()
    assert (t.total_s, t.mean_s, t.median_s) == (4.5, 1.5, 1.5)
    stricter = scoring.judged(items.withColumn("checks", F.when(F.col("id") == "q2", F.expr("filter(checks, x -> false)")).otherwise(F.col("checks"))))
    assert [r.id for r in scoring.changed_verdicts(items, stricter).collect()] == ["q2"]
    with pytest.raises(VerifyError):
        scoring.paired(questions, a, b.where("id <> 'q2'"))
    assert scoring.paired(questions, a, b.where("id <> 'q2'"), partial=True).count() == 2
    both = a.withColumn("side", F.lit("a")).unionByName(b.where("id <> 'q9'").withColumn("side", F.lit("b")))
    assert scoring.check_parameters(both) == (64, 0.0)
    with pytest.raises(VerifyError):
        scoring.check_parameters(both.withColumn("temp", F.when(F.col("side") == "b", 1.0).otherwise(0.0)))


def test_strict_records(spark, tmp_path):
    good = [{"id": "1", "letter": "A", "answer_key": "A"}, {"id": "2", "letter": None, "answer_key": "B"}]
    assert records.read_runs_strict(spark, runs(tmp_path, "g", good)).count() == 2
    for name, rows in (("twice", [*good, good[0]]), ("nameless", [{"letter": "A"}]), ("none", [])):
        with pytest.raises(SourceError):
            records.read_runs_strict(spark, runs(tmp_path, name, rows))


def test_sides_and_gate(spark):
    rows = [(s, str(i), "A", "h", "A" if i < n else "B", "x", False, False, False, 1.0, 64, 0.0) for s, n in (("src", 9), ("good", 9), ("bad", 3)) for i in range(10)]
    df = spark.createDataFrame(rows, "side string, id string, answer_key string, prompt_sha256 string, letter string, raw_output string, truncated boolean, repetition boolean, extra_text boolean, gen_s double, max_tokens int, temp double")
    scoring.check_sides(df)
    got = {r.side: r for r in scoring.gate(scoring.choice_scores(df), "src").collect()}
    assert got["src"].passed is None and got["good"].passed and not got["bad"].passed and got["bad"].accuracy_gap_pp == 60.0
    for bad in (df.where("side <> 'bad' or id <> '3'"), df.withColumn("answer_key", F.when(F.expr("side = 'bad' and id = '3'"), "C").otherwise(F.col("answer_key"))), df.withColumn("temp", F.when(F.col("side") == "bad", 1.0).otherwise(0.0))):
        with pytest.raises(VerifyError):
            scoring.check_sides(bad)
    assert "| bad |" in scoring.markdown(scoring.gate(scoring.choice_scores(df), "src").select("side", "passed"))


def test_choice_sets_subsets_and_assets(spark, tmp_path):
    choices = [("a", "q", (["1", "(B)"], ["x", "y"]), "2"), ("b", "q", (["A"], ["x", "y"]), "A"), ("c", "q", (["A"], ["x"]), "Z")]
    df = spark.createDataFrame(choices, "id string, question string, choices struct<label:array<string>,text:array<string>>, answerKey string")
    r = records.choice_set(df).collect()
    assert [(x.id, x.labels, x.answer_key) for x in r] == [("a", ["A", "B"], "B")]
    many = spark.range(50).select(F.format_string("%03d", "id").alias("id"))
    one, two = records.subset(many, 10, 42), records.subset(many.repartition(7), 10, 42)
    assert one.count() == 10 and records.subset_hash(one) == records.subset_hash(two) != records.subset_hash(records.subset(many, 10, 43))
    root = tmp_path / "assets"
    (root / "sub").mkdir(parents=True)
    for n in ("a.bin", "sub/b.bin", ".hidden"):
        (root / n).write_bytes(n.encode())
    found = records.read_assets(spark, str(root))
    assert sorted(x.path for x in found.collect()) == ["a.bin", "sub/b.bin"]
    manifest = spark.createDataFrame([(x.path, x.size, x.sha256) for x in found.collect()] + [("gone", 1, "x")], "path string, size bigint, sha256 string")
    (root / "a.bin").write_bytes(b"A.bin")
    (root / "sub/b.bin").write_bytes(b"longer now")
    assert {x.path: x.failure for x in records.manifest_failures(manifest, records.read_assets(spark, str(root))).collect()} == {"a.bin": "sha256", "sub/b.bin": "size", "gone": "missing"}
    assets = spark.createDataFrame([("r1", "old"), ("r2", "old")], "repo string, revision string")
    logged = records.with_revision(assets, spark.createDataFrame([("r1", "new")], "repo string, revision string"))
    assert {x.repo: x.revision for x in logged.collect()} == {"r1": "new", "r2": "old"}


def test_generation_bar(spark):
    df = spark.createDataFrame([("a", "A long enough text to pass the bar, surely."), ("a", "ok"), ("b", ""), ("b", "x" * 40), ("c", "short")], "k string, output string")
    assert {r.k: r.passed for r in scoring.generation_bar(df, ["k"]).collect()} == {"a": True, "b": False, "c": False}


def test_tensor_statistics(spark):
    r = np.random.default_rng(1)
    a, b = r.normal(size=(4, 8)), r.normal(size=(4, 8))
    frame = lambda key, x: [(key, i, [float(v) for v in row]) for i, row in enumerate(x)]
    make = lambda rows: spark.createDataFrame(rows, "key string, row bigint, values array<double>")
    ours = make(frame("m", a) + frame("same", b) + frame("odd", a) + frame("mine", a) + frame("tiny", [[1e-9, 1.0]]))
    ref = make(frame("m", b) + frame("same", b) + frame("odd", a[:, :4]) + frame("theirs", a) + frame("tiny", [[2e-9, 1.0]]))
    got = {x.key: x for x in compare.tensor_stats(ours, ref).collect()}
    m = got["m"]
    assert math.isclose(m.max_abs, abs(a - b).max()) and math.isclose(m.rel_l2, np.sqrt(((a - b) ** 2).sum() / (b**2).sum())) and math.isclose(m.cosine, (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()))
    assert got["same"].bit_exact and got["same"].equal_after_f16 and not m.equal_after_bf16
    assert {k: got[k].status for k in ("odd", "mine", "theirs")} == {"odd": "shape_mismatch", "mine": "ours only", "theirs": "reference only"}
    assert got["tiny"].flushed_to_zero == 1 and not got["tiny"].bit_exact and got["tiny"].equal_after_f16
    s = compare.summarised(compare.tensor_stats(ours, ref)).first()
    assert (s.tensors, s.matched, s.shape_mismatches, s.bit_exact) == (6, 3, 1, 1)
    att = compare.attribution(make(frame("language_model.model.layers.3.q.weight", a)), make(frame("model.layers.3.q.weight", b))).first()
    assert att.cls == "layer.q" and math.isclose(att.sum_sq, ((a - b) ** 2).sum())


def test_profiles_and_configs(spark):
    quant = {"bits": 4, "group_size": 64, "mode": "affine", "model.layers.0.q": {"bits": 8, "group_size": 32}, "model.layers.1.q": {"bits": 4}, "lm_head": {"bits": 6}}
    keys = spark.createDataFrame([("model.layers.0.q.weight", [4, 8]), ("model.layers.0.q.scales", [4, 1]), ("model.norm.weight", [8])], "key string, shape array<bigint>")
    p = compare.profile(spark, quant, keys)
    assert {(r.module, r.cls, r.bits, r.group_size, r.numel) for r in p.collect()} == {("model.layers.0.q", "layer.q", 8, 32, 32), ("model.layers.1.q", "layer.q", 4, 64, 1), ("lm_head", "lm_head", 6, 64, 1)}
    assert {r.cls: (r.histogram, r.distinct_bits) for r in compare.class_bits(p).collect()} == {"layer.q": ({4: 1, 8: 1}, [4, 8]), "lm_head": ({6: 1}, [6])}
    assert [r.key for r in compare.unquantized(keys, p).collect()] == ["model.norm.weight"]
    diff = compare.config_diff(compare.config_frame(spark, {"a": 1, "b": {"c": None, "d": [1]}}), compare.config_frame(spark, {"a": 2, "b": {"d": [1], "e": 0}}))
    assert {r.path: r.status for r in diff.collect()} == {"a": "differing", "b.c": "only_ours", "b.e": "only_reference"}
    index, present = spark.createDataFrame([("k", "s1"), ("l", "s2")], "key string, shard string"), spark.createDataFrame([("s1",)], "shard string")
    assert sorted(r.problem for r in compare.structural_problems(spark, index, present, {"model_type": "x"}).collect()) == ["missing file s2", "no architectures"]


def test_calibration(spark):
    r = np.random.default_rng(2)
    ref, cand, target = r.normal(size=(12, 5)), 300 * r.normal(size=(12, 5)), r.integers(0, 5, 12)
    soft = lambda x: x - x.max(1, keepdims=True) - np.log(np.exp(x - x.max(1, keepdims=True)).sum(1, keepdims=True))
    rows = [(i // 4, i, ref[i].tolist(), cand[i].tolist(), int(target[i])) for i in range(12)]
    got = calibration.losses(spark.createDataFrame(rows, "win int, pos int, reference array<double>, candidate array<double>, target int")).first()
    p, q, at = soft(ref), soft(cand), np.arange(12)
    assert math.isclose(got.nll_ref, -p[at, target].mean()) and math.isclose(got.nll, -q[at, target].mean()) and math.isclose(got.kl, (np.exp(p) * (p - q)).sum(1).mean()) and math.isclose(got.delta_ce, got.nll - got.nll_ref)
    w = spark.createDataFrame([([*range(n)],) for n in (0, 3, 4, 5, 9)], "ids array<bigint>").select(calibration.token_windows(F.col("ids"), 4).alias("w"), calibration.token_windows(F.col("ids"), 4, 1).alias("v")).collect()
    assert [len(x.w) for x in w] == [0, 0, 0, 1, 2] and [len(x.v) for x in w] == [0, 0, 0, 1, 1] and w[4].w[1] == [4, 5, 6, 7]
    scores = spark.createDataFrame([(1, "A", "B", 1.0), (1, "B", "B", 2.5), (2, "A", "B", 1.0), (2, "B", "B", 1.0), (3, "A", "E", 1.0)], "id int, option string, answer string, score double")
    m = calibration.choice_metrics(scores, scores).first()
    assert (m.n_questions, m.n_skipped, m.mc_letter_acc, m.mean_letter_margin) == (2, 1, 0.5, 0.75)
    lp = spark.createDataFrame([(1, "A", k, [-1.0 - k, -2.0]) for k in range(3)], "id int, option string, pos int, lp array<double>")
    tok = spark.createDataFrame([(1, "A", 0, 0), (1, "A", 2, 1)], "id int, option string, at int, token int")
    assert calibration.continuation(lp, tok).first().total == -3.0


def test_rendering(spark):
    x = spark.range(1).select(text.render_prompt(F.lit(" Why? "), F.array(F.lit("A"), F.lit("B")), F.array(F.lit("x"), F.lit("y"))).alias("p")).first().p
    assert x == "The following is a multiple choice question. Answer with only the letter of the correct option.\n\nQuestion: Why?\nA. x\nB. y\nAnswer:"
