"""Hand-computed cases of the record-linkage operators."""

import inspect
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from spindrift.functions import normalize, similarity
from spindrift.operators import audits, blocking, classes, evidence, metrics, policy, scoring, splits, tiles, training, validate
from spindrift.operators.scoring import C, S1
from spindrift.plans import queries
from spindrift.sources import files, packaging
from spindrift.streaming import incremental


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def entities(spark, rows):
    raw = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")
    return normalize.derived_fields(normalize.normalized_records(raw))


def test_normalisation(spark):
    rows = entities(spark, [("S1-1", "Café & Straße, Inc.", "12  Main-Street 90210", "USA"), ("S1-2", None, None, None), (None, "x", "y", "z"), ("S1-3", "Ærø Øl", "0000 sw1a1aa", " Peru ")])
    got = {r.entity_id: r for r in rows.collect()}
    assert set(got) == {"S1-1", "S1-2", "S1-3"}
    assert got["S1-1"].name_norm == "cafe strasse inc" and got["S1-1"].core == "cafe strasse"
    assert got["S1-1"].address_norm == "12 main street 90210" and got["S1-1"].country_norm == "us"
    assert got["S1-1"].canon_compact == "12mainst90210"
    assert (got["S1-1"].number, got["S1-1"].digits, got["S1-1"].postal) == ("12", "1290210", "90210")
    assert got["S1-2"].full_key == "||||" and got["S1-2"].postal_like == "" and got["S1-2"].last_postal == ""
    assert got["S1-3"].name_norm == "aero ol" and got["S1-3"].postal_like == "sw1a1aa"
    assert got["S1-3"].nonzero == "" or got["S1-3"].nonzero == "000011"
    assert got["S1-3"].country_norm == "peru"


def test_absent_columns_count_as_empty(spark):
    raw = spark.createDataFrame([("S1-1",)], "entity_id string")
    assert values(normalize.normalized_records(raw), "name_norm", "country_norm") == [("", "")]


def test_similarity_kernels_against_brute_force():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            previous = 0
            for j, y in enumerate(b, 1):
                previous, row[j] = row[j], previous + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd ", k=rng.randint(0, 70))) for _ in range(2))
        assert similarity.lcs_length(a, b) == lcs(a, b)
    assert similarity.indel("", "a") == similarity.indel(None, None) == 0.0
    assert similarity.jaro_winkler_of("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert similarity.jaro_winkler_of("dixon", "dicksonx") == pytest.approx(0.813333, abs=1e-6)


def test_part_columns(spark):
    df = spark.createDataFrame([("abcdefghij",), ("abc",)], "name string")
    got = values(df, *(blocking.part_column("name", cut, n).alias(str(i)) for i, (cut, n) in enumerate((("<", 3), (">", 3), ("~", 6), ("/", 3), (None, 0)))))
    assert got == [("abc", "hij", "cdefgh", "3", "abcdefghij"), ("abc", "abc", "abc", "1", "abc")]


def test_caps_drop_hot_keys_before_the_join(spark):
    left = entities(spark, [(f"S1-{i}", "hot name", f"{i} a street 90001", "us") for i in range(5)] + [("S1-9", "rare", "9 b", "us")])
    right = entities(spark, [("S2-1", "hot name", "x", "us"), ("S2-2", "rare", "y", "us"), ("S2-3", "rare", "z", "fr")])
    spec = blocking.BlockSpec("n", "name<3", cap=4)
    assert values(blocking.block_pairs(left, right, [spec]), S1, C) == [("S1-9", "S2-2")]
    assert values(blocking.window_capped_pairs(left, right, spec), S1, C) == [("S1-9", "S2-2")]
    assert values(blocking.pair_estimates(left, right, [spec]), "block", "pairs") == [("n", 1)]
    open_ = blocking.BlockSpec("o", "name<3")
    assert blocking.within_budget(left, right, [open_, spec], 5, None) == [spec]
    assert blocking.within_budget(left, right, [spec, open_], None, 7) == [spec, open_]


def test_a_block_without_pairs_is_not_chosen(spark):
    left = entities(spark, [(f"S1-{i}", "hot name", "", "us") for i in range(3)])
    right = entities(spark, [("S2-1", "hot name", "", "us")])
    over, open_ = blocking.BlockSpec("n", "name<3", cap=2), blocking.BlockSpec("o", "name<3")
    assert blocking.within_budget(left, right, [over, open_], 5, None) == [open_]


def test_guarded_pairs_lose_none_over_the_budget(spark, monkeypatch):
    left = entities(spark, [(f"S1-{i}", f"name {i % 3}", f"{i % 2} main street 90001", "us") for i in range(12)])
    right = entities(spark, [(f"S2-{i}", f"name {i % 3}", f"{i % 2} main street 90001", "us") for i in range(9)])
    wanted = sorted(values(blocking.block_pairs(left, right, blocking.TIGHT), S1, C, "block_name", "is_exact"))
    for budgets in ((4, 10), (40, 60)):
        monkeypatch.setitem(blocking.BUDGETS, "tight", budgets)
        assert sorted(values(blocking.guarded_pairs(left, right, "tight"), S1, C, "block_name", "is_exact")) == wanted
    a, b, c = (blocking.BlockSpec(x, "name") for x in "abc")
    assert blocking.budgeted_joins({"a": 3, "b": 9, "c": 4}, [a, b, c], 5, 6) == [[b], [a], [c]]


def test_classes_score_as_records_do(spark):
    rng = random.Random(4)
    rows = lambda p, n: [(f"{p}-{i}", rng.choice(["red bolt", "red bolt inc", "blue nut", ""]), rng.choice(["1 a street 90001", "2 a street 90001", ""]), rng.choice(["us", "peru"])) for i in range(n)]
    left, right = entities(spark, rows("S1", 40)), entities(spark, rows("S2", 60))
    specs = [blocking.EXACT[1], blocking.BlockSpec("name", "name<3"), blocking.BlockSpec("other", "number", only="S3"), blocking.BlockSpec("address", "addr>5", 90, only="S2")]
    plain = scoring.scored(evidence.aggregated(blocking.block_pairs(left, right, specs)), left, right)
    columns = sorted(plain.columns)
    wanted = sorted(values(plain, *columns))
    assert len(wanted) > 300 and sorted(values(classes.scored(left, right, specs), *columns)) == wanted
    at = columns.index("base_rank")
    assert sorted(values(classes.scored(left, right, specs, 7), *columns)) == [r for r in wanted if r[at] <= 7]
    capped = [blocking.BlockSpec("n", "name<3", cap=30)]
    pairs = lambda df: sorted(values(df, S1, C, "evidence_rows", "block_names"))
    assert pairs(classes.aggregated(left, right, capped)) == pairs(evidence.aggregated(blocking.block_pairs(left, right, capped)))
    # fewer pairs are scored than made, and an id that is repeated is paired by record
    both = classes.of_both(left, right, specs)
    assert both[0].classes < 25 and classes.block_pairs(both, specs).count() * 2 < blocking.block_pairs(left, right, specs).count()
    twice = left.union(left.limit(3))
    assert classes.of_both(twice, right, specs) is None
    assert pairs(classes.aggregated(twice, right, specs)) == pairs(evidence.aggregated(blocking.block_pairs(twice, right, specs)))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_candidates_move_no_pairs(spark, monkeypatch):
    """Pairs between classes are aggregated where they are made, and each task keeps a record's best."""
    rows = lambda p, n: [(f"{p}-{i}", f"name {i % 9}", f"{i % 5} main street 90001", "us") for i in range(n)]
    left, right = entities(spark, rows("S1", 300)), entities(spark, rows("S2", 200))
    specs = [blocking.EXACT[1], blocking.BlockSpec("name", "name<3"), blocking.BlockSpec("address", "addr>5")]
    both = classes.of_both(left, right, specs)
    pairs = evidence.aggregated(classes.block_pairs(both, specs))
    assert not [x for x in plan_of(pairs).splitlines() if "hashpartitioning(source1" in x]
    assert "Partial" in plan_of(classes.scored(left, right, specs, 1)).split("Exchange hashpartitioning(source1")[1].splitlines()[1]
    monkeypatch.setattr(classes, "DEALT", 2)
    wanted = sorted(values(pairs, *pairs.columns))
    for most in (classes.MAX_CLASSES, 1):
        monkeypatch.setattr(classes, "MAX_CLASSES", most)
        assert sorted(values(evidence.aggregated(classes.block_pairs(both, specs)), *pairs.columns)) == wanted
    top = scoring.scored(evidence.aggregated(blocking.block_pairs(left, right, specs)), left, right).where("base_rank <= 2")
    assert sorted(values(classes.scored(left, right, specs, 2), S1, C, "base_rank")) == sorted(values(top, S1, C, "base_rank"))


def test_truth_by_groups_is_truth_by_pairs(spark):
    left = spark.createDataFrame([("S1-1", 1), ("S1-2", 1), ("S1-3", 2), ("S1-4", 9)], f"{S1} string, left_group int")
    right = spark.createDataFrame([("S2-1", 5), ("S2-2", 5), ("S3-1", 6), ("S3-2", 7)], f"{C} string, right_group int")
    linked = metrics.LinkedTruth(left, right, spark.createDataFrame([(1, 5), (1, 6), (2, 6)], "left_group int, right_group int"))
    tops = spark.createDataFrame([("S1-1", "S2-1", 3.0), ("S1-2", "S3-2", 2.0), ("S1-3", "S3-1", 2.0), ("S1-4", "S2-2", 1.0), ("S1-5", "S9-1", 0.5)], f"{S1} string, {C} string, u double")
    ids = spark.createDataFrame([(f"S1-{i}",) for i in range(1, 7)], "entity_id string")
    for truth in (linked, linked.of("S2")):
        pairs = truth.pairs()
        assert sorted(values(metrics.truth_counts(truth), S1, "truth")) == sorted(values(metrics.truth_counts(pairs), S1, "truth"))
        both = [metrics.policy_table(ids, t, tops) for t in (truth, pairs)]
        assert len({str(sorted(values(t, *t.columns))) for t in both}) == 1
    assert sorted(values(linked.of("S2").pairs(), S1, C)) == [(f"S1-{i}", f"S2-{j}") for i in (1, 2) for j in (1, 2)]
    assert sorted(values(metrics.flagged(tops, linked, "hit"), S1, "hit")) == [("S1-1", 1), ("S1-2", None), ("S1-3", 1), ("S1-4", None), ("S1-5", None)]


def _sources(spark):
    rows = lambda p, n: [(f"{p}-{i}", f"name {i % 4}" if i % 7 else "", f"{i % 3} main street {90001 + i % 2}", "us") for i in range(n)]
    return entities(spark, rows("S1", 40)), entities(spark, rows("S2", 30)), entities(spark, rows("S3", 20))


def test_coverage_of_classes_is_that_of_records(spark):
    left, right, _ = _sources(spark)
    groups = lambda df, key, name: df.select(F.col("entity_id").alias(key), (F.regexp_extract("entity_id", r"(\d+)$", 1).cast("int") % 5).alias(name)).where(f"{name} < 4")
    links = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 3)], "left_group int, right_group int")
    truth = metrics.LinkedTruth(groups(left, S1, "left_group"), groups(right, C, "right_group"), links)
    baseline, added = [blocking.EXACT[3], blocking.BlockSpec("capped", "name<6", 6)], [blocking.BlockSpec("postal", "postal name<6"), blocking.BlockSpec("more", "addr<2", 14)]
    plain = audits.coverage_audit(truth.pairs(), blocking.block_pairs(left, right, baseline), blocking.block_pairs(left, right, added))
    both = classes.grouped_classes(left, right, baseline + added, truth)
    got = audits.coverage_of_classes(truth, classes.true_pairs(both, baseline, added, truth))
    assert got.columns == plain.columns and values(got, *got.columns) == values(plain, *plain.columns)
    plain_pool = metrics.pool_audit(truth.pairs(), blocking.block_pairs(left, right, baseline), blocking.block_pairs(left, right, added))
    pool = classes.pool_audit(both, baseline, added, truth)
    assert pool.columns == plain_pool.columns and values(pool, *pool.columns) == values(plain_pool, *pool.columns)
    assert plain.first().new_recovered > 0 and plain.first().baseline_covered > 0


def test_candidate_lists_of_classes_are_those_of_records(spark):
    left, second, third = _sources(spark)
    specs = [blocking.EXACT[0], blocking.BlockSpec("capped", "name<6 number", 6)]
    pairs = blocking.block_pairs(left, second, specs).unionByName(blocking.block_pairs(left, third, specs))
    wanted = sorted(values(evidence.candidate_lists(left, pairs), S1, "candidate_entity_ids"))
    lists = classes.candidate_lists(left, [second, third], specs)
    assert sorted(values(lists, S1, "candidate_entity_ids")) == wanted
    assert any(x is None for _, x in wanted) and any("S2" in x and "S3" in x for _, x in wanted if x)
    assert classes.candidate_lists(left.union(left.limit(1)), [second], specs) is None


def test_empty_fields_have_no_key(spark):
    rows = entities(spark, [("S1-1", "", "12 a", "us"), ("S1-2", "abc", "no digits", "us"), ("S1-3", "abc", "12 a", "")])
    assert blocking.keyed(rows, blocking.DIGITS).count() == 0


def ranked_fixture(spark):
    return spark.createDataFrame([("S1-1", "S2-b", 5.0), ("S1-1", "S2-a", 5.0), ("S1-1", "S2-c", 9.0), ("S1-2", "S2-a", 1.0)], f"{S1} string, {C} string, u double")


def test_rank_ties_end_in_the_id(spark):
    got = values(scoring.ranked(ranked_fixture(spark), "u", "r").orderBy(S1, "r"), S1, C, "r")
    assert got == [("S1-1", "S2-c", 1), ("S1-1", "S2-a", 2), ("S1-1", "S2-b", 3), ("S1-2", "S2-a", 1)]


def test_margin_of_a_single_candidate_is_infinite(spark):
    two = policy.best_two(scoring.ranked(ranked_fixture(spark), "u", "r"), "r", "u")
    assert dict(values(two, S1, "margin")) == {"S1-1": 4.0, "S1-2": math.inf}


def test_f05(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (0, 1, 0), (2, 1, 1), (1, 2, 1)], "t int, p int, h int")
    assert [round(x, 6) for (x,) in values(df, metrics.f05(F.col("t"), F.col("p"), F.col("h")))] == [1.0, 0.0, 0.0, round(1.25 / 1.5, 6), round(1.25 / 2.25, 6)]


def sweep_fixture(spark):
    records = spark.createDataFrame([(f"S1-{i}",) for i in range(4)], "entity_id string")
    truth = spark.createDataFrame([("S1-0", "S2-0"), ("S1-0", "S3-0"), ("S1-1", "S2-1")], f"{S1} string, {C} string")
    a = spark.createDataFrame([("S1-0", "S2-0", 9.0), ("S1-1", "S2-9", 7.0), ("S1-3", "S2-3", 7.0)], f"{S1} string, {C} string, u double")
    b = spark.createDataFrame([("S1-0", "S3-0", 8.0), ("S1-1", "S3-1", 2.0)], f"{S1} string, {C} string, u double")
    return records, truth, a, b


def test_threshold_sweep_matches_direct_evaluation(spark):
    records, truth, a, b = sweep_fixture(spark)
    none = metrics.policy_table(records, truth, a.limit(0))
    tops = a.unionByName(b)
    curve = {r.threshold: r for r in metrics.threshold_curve(none, tops, "u", truth).collect()}
    assert set(curve) == {9.0, 8.0, 7.0, 2.0}
    for t, r in curve.items():
        direct = metrics.policy_metrics(metrics.policy_table(records, truth, tops.where(F.col("u") >= t))).collect()[0]
        assert (r.macro_f05, r.n_predicted, r.n_hits) == (direct.macro_f05, direct.n_predicted, direct.n_hits)
    assert metrics.best_threshold(none, tops, "u", truth).collect()[0].threshold == 8.0


def test_joint_sweep_matches_the_grid(spark):
    records, truth, a, b = sweep_fixture(spark)
    none = metrics.policy_table(records, truth, a.limit(0))
    grid = metrics.threshold_grid(none, a, b, "u", truth, [9.0, 7.0, 100.0], [8.0, 2.0, 100.0]).collect()
    joint = metrics.joint_thresholds(none, a, b, "u", truth).collect()[0]
    assert joint.macro_f05 == max(r.macro_f05 for r in grid)
    assert (joint.threshold_a, joint.threshold_b) == (9.0, 8.0)


def test_joint_sweep_is_exact_over_many_utilities(spark):
    # candidates are true from one utility on: just one pair of thresholds is right
    n, right = 1500, (701, 1103)
    records = spark.createDataFrame([(f"S1-{i}",) for i in range(n)], "entity_id string")
    pairs, tops = [], {"a": [], "b": []}
    for side, name, at in (("a", "S2", right[0]), ("b", "S3", right[1])):
        for i in range(n):
            tops[side].append((f"S1-{i}", f"{name}-{i}", float(i)))
            if i >= at:
                pairs.append((f"S1-{i}", f"{name}-{i}"))
    truth = spark.createDataFrame(pairs, f"{S1} string, {C} string")
    a, b = (spark.createDataFrame(tops[p], f"{S1} string, {C} string, u double") for p in "ab")
    none = metrics.policy_table(records, truth, a.limit(0))
    got = metrics.joint_thresholds(none, a, b, "u", truth).collect()[0]
    assert (got.threshold_a, got.threshold_b, got.macro_f05) == (701.0, 1103.0, 1.0)


def test_splits_are_disjoint_and_portable(spark):
    ids = spark.createDataFrame([(f"S1-{i}",) for i in range(2000)], "entity_id string")
    old = ids.where(splits.in_validation(F.col("entity_id")))
    fresh = splits.salted_sample(ids, "entity_id", "X", 10, [old])
    assert splits.overlap({"a": old, "b": fresh}, "entity_id").count() == 0
    assert 300 < old.count() < 500 and 100 < fresh.count() < 220
    import hashlib

    assert values(spark.range(1).select(splits.portable_hash(F.lit("S1-1"))), "*") == [(int(hashlib.md5(b"S1-1").hexdigest()[:12], 16),)]


def test_pairwise_ranker_learns_and_round_trips(spark):
    rng = random.Random(0)
    rows = []
    for i in range(200):
        for j in range(4):
            good = j == 0
            rows.append((f"S1-{i}", f"S2-{i}-{j}", float(min(1, max(0, rng.gauss(0.8 if good else 0.4, 0.1)))), 0.5, 0, 0, 1, 0.9, 0.9, 1, 1, 0, 10.0 + j, rng.randint(1, 4), int(good)))
    names = [S1, C, "name_similarity", "address_similarity", "name_exact", "address_exact", "country_exact", "name_length_ratio", "address_length_ratio", "evidence_rows", "evidence_file_count", "exact_key_count", "base_score", "base_rank", "label"]
    df = scoring.derived_features(spark.createDataFrame(rows, names))
    model = training.fit_pairwise(training.pair_differences(df))
    again = training.LinearRanker.from_json(model.to_json())
    first = again.ranked(df).where("rank = 1")
    assert first.agg(F.avg("label")).collect()[0][0] > 0.95


def test_pointwise_query_trains_like_production(spark, sf_dir, monkeypatch):
    asked = {}

    def fit(rows, **given):
        asked.update({k: p.default for k, p in wanted.parameters.items() if p.default is not p.empty} | given)
        raise StopIteration

    wanted = inspect.signature(training.fit_pointwise)
    monkeypatch.setattr(queries.training, "fit_pointwise", fit)
    with pytest.raises(StopIteration):
        queries.queries()["pointwise_ranking"](spark, sf_dir)
    assert (asked["trees"], asked["depth"], asked["least"]) == (200, 5, 50)


def test_validator_rules(spark):
    lines = spark.createDataFrame([(x,) for x in (f"{S1}\tmatched_entity_ids", "S1-1\tS2-1,S2-1", "S1-1\t", "S1-2 S2-1", "", "S1-3\tS1-1,X-1", "S1-9\tS2-404")], "value string")
    parsed = validate.parsed_lines(lines, f"{S1}\tmatched_entity_ids")
    required = spark.createDataFrame([("S1-1",), ("S1-3",), ("S1-4",)], "entity_id string")
    known = spark.createDataFrame([("S2-1",)], "entity_id string")
    got = set(values(validate.list_faults(parsed, required, known), "rule", "subject"))
    assert got == {("row_without_tab", "S1-2 S2-1"), ("duplicate_row", "S1-1"), ("repeated_id", "S1-1"), ("self_match", "S1-1"), ("wrong_prefix", "X-1"), ("missing_record", "S1-4"), ("extra_record", "S1-9"), ("unknown_id", "S2-404")}
    assert validate.header_fault("a,b", "matching") == "comma-separated"
    assert validate.header_fault(f"{S1}\tmatched_entity_ids\n", "matching") is None
    assert validate.header_fault("", "matching") == "empty file"
    candidates = spark.createDataFrame([("S1-3", ["S2-7"])], f"{S1} string, ids array<string>")
    matching = spark.createDataFrame([("S1-3", ["S2-8"]), ("S1-1", [])], f"{S1} string, ids array<string>")
    assert values(validate.outside_candidates(matching, candidates), "subject") == [("S1-3",)]


def test_files_round_trip(spark, tmp_path):
    path = tmp_path / "r.tsv"
    path.write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tNA\t1 \"q\" st\tUS\nS1-2\tAb\t\tnull\n")
    assert values(files.read_records(spark, str(path)), "*") == [("S1-1", None, '1 "q" st', "US"), ("S1-2", "Ab", None, None)]
    results = spark.createDataFrame([("S1-2", None), ("S1-1", "S2-1,S3-1")], f"{S1} string, matched_entity_ids string")
    files.write_results(results, str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*")).read_text()
    assert part == f"{S1}\tmatched_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\n"
    assert files.read_results(spark, str(tmp_path / "out"), (S1, "matched_entity_ids")).count() == 2
    assert files.empty(spark).count() == 0
    first = files.stage(results, str(tmp_path), "s", {"a": 1})
    assert files.stage(results.limit(0), str(tmp_path), "s", {"a": 1}).count() == first.count() == 2
    assert files.stage(results.limit(0), str(tmp_path), "s", {"a": 2}).count() == 0
    files.write_table(results.withColumn("shard", F.lit(20)).unionByName(results.withColumn("shard", F.lit(2))), str(tmp_path / "p"), partition_by=["shard"])
    assert spark.read.parquet(str(tmp_path / "p")).where("shard = 2").count() == 2
    assert files.candidate_tables(spark, [str(tmp_path / "p")]) == []
    assert '"n": 2' in files.manifest(results.agg(F.count("*").alias("n")))


def test_publish_and_package(tmp_path):
    a = tmp_path / "a.tsv"
    for text in ("one", "two"):
        a.write_text(text)
        packaging.publish([a], tmp_path / "live")
    assert (tmp_path / "live" / "a.tsv").read_text() == "two"
    assert len(list(tmp_path.glob("live-backup-*"))) == 1
    sums = packaging.package([tmp_path / "live" / "a.tsv"], tmp_path / "x.zip")
    assert len(sums["a.tsv"]) == 64
    with pytest.raises(FileExistsError):
        packaging.package([], tmp_path / "x.zip")


def test_stream_matches_like_a_batch(spark, tmp_path):
    source = tmp_path / "in"
    raw = spark.createDataFrame([("S1-1", "red widget", "5 main street 90001", "us"), ("S1-2", "blue bolt", "7 main street 90002", "us")], "entity_id string, business_name string, business_address string, country string")
    raw.write.parquet(str(source))
    targets = entities(spark, [("S2-1", "red widgets", "5 main street 90001", "us"), ("S2-2", "green", "1 x 90009", "us")])
    stream = spark.readStream.schema(raw.schema).parquet(str(source))
    incremental.match_stream(stream, targets, blocking.POSTAL, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert values(spark.read.parquet(str(tmp_path / "out")), S1, C) == [("S1-1", "S2-1")]


def test_evidence_counts_blocks_once(spark):
    pairs = spark.createDataFrame([("S1-1", "S2-1", "a", 1), ("S1-1", "S2-1", "a", 1), ("S1-1", "S2-1", "b", 0)], f"{S1} string, {C} string, block_name string, is_exact int")
    assert values(evidence.aggregated(pairs), "evidence_rows", "evidence_file_count", "exact_key_count", "block_names") == [(3, 2, 2, "a,b")]
    assert values(evidence.match_keys(pairs), "match_keys", "exact_key_count") == [("a|b", 2)]


def test_similarity_in_batches():
    rng = random.Random(2)
    for letters in ("ab ", "abcdefé日", "".join(map(chr, range(0x4E00, 0x4E00 + 700)))):
        texts = ["".join(rng.choices(letters, k=rng.choice([0, 1, 15, 16, 17, 31, 32, 33, 63, 64, 65, 90]))) for _ in range(400)] + [None]
        a, b = rng.choices(texts, k=500), rng.choices(texts, k=500)
        assert similarity.indels(a, b).tolist() == [similarity.indel(x, y) for x, y in zip(a, b, strict=True)]
        assert similarity.jaro_winklers(a, b).tolist() == [similarity.jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)]
    assert similarity.indels([], []).tolist() == similarity.jaro_winklers([], []).tolist() == []


def test_names_in_other_scripts_stay_apart_and_never_become_empty(spark):
    names = ["東京", "京東", "Москва", "МОСКВА", "Αθήνα", "ไทย", "עברית", "٣", "\U0001f600", "Й", "Й", "и"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "i int, x string").select("i", normalize.normalized_text(F.col("x")).alias("y"))
    got = [y for _, y in sorted(values(df, "i", "y"))]
    assert got[0] != got[1] and got[2] == got[3] == "moskva" and got[4] == "athena" and got[7] == "3"
    assert got[8] == "" and all(y for x, y in zip(names, got, strict=True) if x != "\U0001f600")
    assert got[9] == got[10] == got[11] == "i"


def test_blocks_for_one_target_only(spark):
    rows = entities(spark, [(f"S{k}-{i}", "acme tools", "12 main street 90210", "us") for k in (1, 2, 3) for i in (1, 2)])
    made = values(blocking.keyed(rows, blocking.INFERENCE), "block", "id")
    assert {i[:2] for b, i in made if b == "v4_num_address_safe"} == {"S1", "S3"} == {i[:2] for b, i in made if b == "v4_address_first4_last4_len"}
    assert {i[:2] for b, i in made if b == "v5_name_first3_postal"} == {"S1", "S2", "S3"}


def test_keys_by_hand(spark):
    """Keys of one record, written out."""
    row = entities(spark, [("S1-1", "Acme Tools Ltd", "0012 Main Street 90210", "usa")])
    wanted = {
        "name_f3_l2_len5": "us|acm|td|2",
        "name_f2_l3_postal": "us|90210|ac|ltd",
        "name_f2_addr_f3_len5": "us|ac|001|3",
        "addr_f4_tail4_name_f1": "us|0012|0210|a",
        "postal_addr_f3_tail2_name_f1": "us|90210|001|10|a",
        "num_addr_name_prefix4": "us|001290210|acme",
        "num_addr_name_f1_l2": "us|001290210|a|td",
        "name_f1_addr_f4_tail2": "us|a|0012|10",
    }
    got = dict(values(blocking.keyed(row, blocking.RECOVERY), "block", "key"))
    assert {k: got[k] for k in wanted} == wanted
    union = dict(values(blocking.keyed(row, blocking.UNION), "block", "key"))
    assert union == {"num_addr_name_prefix2": "us|001290210|ac", "addr_last2_postal": "us|90210|10", "name_last_token_postal": "us|90210|ltd", "name_first1_postal": "us|90210|a"}
    inference = dict(values(blocking.keyed(row, blocking.INFERENCE), "block", "key"))
    assert inference["v4_address_first4_last4_len"] == "us|0012|0210|22"
    assert inference["v5_name_first3_postal"] == "us|acm|90210"
    assert inference["v9_num_addr_name_prefix3"] == "us|001290210|acm"


def test_holdouts_are_locked(spark):
    ranked = spark.createDataFrame([("a", "S2-1", 1), ("a", "S2-2", 2), ("b", "S2-3", 30), ("c", "S2-4", 1)], f"{S1} string, {C} string, r int")
    truth = spark.createDataFrame([("a", "S2-2"), ("b", "S2-3"), ("b", "S2-9"), ("d", "S2-1"), ("c", "S2-4")], f"{S1} string, {C} string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], f"{S1} string")
    (row,) = audits.holdout_evaluation(truth, ranked, ids("a", "b", "d", "a"), ids("c"), "r").collect()
    assert (row.truth_pairs, row.truth_records, row.covered, row.covered_at_1, row.covered_at_3, row.covered_at_20) == (4, 3, 2, 0, 1, 1)
    assert (row.missed_not_candidate, row.missed_rank_over_20, row.candidate_rows, row.records_without_candidates) == (2, 1, 3, 1)
    with pytest.raises(ValueError):
        audits.holdout_evaluation(truth, ranked, ids("a"), ids("a", "z"), "r")


def test_neighbouring_thresholds(spark):
    tops = spark.createDataFrame([(float(u),) for u in [1, 2, 2, 3, 5, 8, 13, 21]] + [(None,)], "u double")
    assert audits.neighbours(tops, "u", 4.0, 2) == [2.0, 3.0, 5.0, 8.0, 13.0]
    assert audits.neighbours(tops, "u", 100.0, 2) == [8.0, 13.0, 21.0]
    assert audits.neighbours(tops.limit(0), "u", 1.0) == []


def test_new_truth_histograms(spark):
    pair = f"{S1} string, {C} string"
    truth = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("c", "w")], pair)
    evidence_rows = spark.createDataFrame([("a", "x", 2, "p,q"), ("a", "y", 1, "p"), ("b", "z", 1, "p"), ("e", "x", 1, "p")], f"{pair}, evidence_file_count long, block_names string")
    got = values(audits.new_truth_histograms(truth, spark.createDataFrame([("b", "z")], pair), evidence_rows, 1), "by", "value", "n")
    assert sorted(got) == [("number", "1", 1), ("number", "2", 1), ("pattern", "p", 1)]


def test_the_pairwise_ranker_is_an_optimum(spark):
    """No coefficient can move: the gradient of the penalised loss is zero."""
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        x = [rng.gauss(0.4 if i < 3 else 0, 1) for i in range(len(scoring.FEATURES))]
        rows += [(*x, 1), (*(-v for v in x), 0)]
    df = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in scoring.FEATURES) + ", pair_label int")
    model = training.fit_pairwise(df)
    gradient = [0.0] * len(scoring.FEATURES)
    for *x, label in rows:
        z = [(v - m) / s for v, m, s in zip(x, model.mean, model.scale, strict=True)]
        error = 1 / (1 + math.exp(-model.intercept - sum(a * b for a, b in zip(z, model.coefficients, strict=True)))) - label
        gradient = [g + error * v for g, v in zip(gradient, z, strict=True)]
    assert max(abs(g + w) / len(rows) for g, w in zip(gradient, model.coefficients, strict=True)) < 1e-3


def test_discovery_and_submissions(spark, tmp_path):
    pairs = spark.createDataFrame([("S1-1", "S2-2", 1), ("S1-1", "S2-1", 2), ("S1-2", "S2-3", 7)], f"{S1} string, {C} string, place int")
    pairs.coalesce(1).write.parquet(str(tmp_path / "in/deep/er"))
    pairs.select(S1).coalesce(1).write.parquet(str(tmp_path / "in/other"))
    found = files.discover_candidates(spark, str(tmp_path / "in"))
    assert len(found) == 1 and "/deep/er/" in found[0]
    assert files.read_tables(spark, *found).count() == 3
    paths = files.write_submissions(pairs, str(tmp_path / "out"), "place", (1, 5))
    assert sorted(paths) == [1, 5]
    lines = spark.read.text(paths[5]).collect()
    assert [r.value for r in lines] == [f"{S1},{C},rank", "S1-1,S2-2,1", "S1-1,S2-1,2"]
    assert spark.read.option("header", True).csv(paths[1]).count() == 1


def test_candidates_by_strength(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "w", 2), ("a", "v", 2), ("b", "u", 1)], f"{S1} string, {C} string, exact_key_count long")
    assert values(evidence.by_strength(rows), S1, C) == [("a", "v"), ("a", "w"), ("a", "x"), ("b", "u")]


@pytest.fixture(scope="module")
def copied(spark, sf_dir, tmp_path_factory):
    """Parts in eight copies with other keys, so that most records have equal ones."""
    folder = str(tmp_path_factory.mktemp("copied"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    step = part.agg(F.max("p_partkey")).first()[0] + 1
    copies = part.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("p_partkey", F.col("p_partkey") + F.col("i") * step).drop("i")
    copies.coalesce(2).write.parquet(f"{folder}/part.parquet")
    return folder


def by_sql(folder, name):
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{folder}/part.parquet/*.parquet'")
    wanted = con.sql(queries.oracle_sql()[name])
    return wanted.columns, wanted.fetchall()


def close(got, wanted):
    """Equal rows; the last of six digits may be rounded otherwise."""
    order = lambda rows: sorted(rows, key=lambda r: repr([v for v in r if not isinstance(v, float)]))
    return len(got) == len(wanted) and all(a == pytest.approx(b, abs=2e-6) for a, b in zip(order(got), order(wanted), strict=True))


def never(*_):
    raise AssertionError("pairs of records are joined with truth")


@pytest.mark.parametrize("name", ["pair_differences", "labelled_pairs", "pointwise_rows", "linear_utilities"])
def test_labels_and_ranks_are_made_between_classes(spark, copied, monkeypatch, name):
    monkeypatch.setattr(queries.training, "labelled", never)
    columns, wanted = by_sql(copied, name)
    got = queries.queries()[name](spark, copied)
    assert wanted and close(values(got, *columns), wanted)


def test_pairwise_ranking_scores_classes(spark, copied, monkeypatch):
    from spindrift.plans.audit_queries import _FIXED

    monkeypatch.setattr(queries.training, "labelled", never)
    monkeypatch.setattr(queries.training, "fit_pairwise", lambda _: _FIXED)
    got = queries.queries()["pairwise_ranking"](spark, copied).orderBy(S1, "rank").collect()
    utilities = {r[:2]: r[2] for r in by_sql(copied, "linear_utilities")[1]}
    labels = {r[:2]: r[3:] for r in by_sql(copied, "labelled_pairs")[1]}
    assert len(got) == len(labels) and all(utilities[r[:2]] == pytest.approx(r.utility, abs=2e-6) and labels[r[:2]] == (r.label, r.is_validation) for r in got)
    for a, b in zip(got, got[1:], strict=False):
        assert b.rank == (a.rank + 1 if a[0] == b[0] else 1) and (b.rank == 1 or a.utility >= b.utility)


def test_pointwise_ranking_learns_from_classes(spark, copied, monkeypatch):
    monkeypatch.setattr(queries.training, "labelled", never)
    asked, fit = {}, training.fit_pointwise

    def small(rows):
        asked.update({r.label: r.n for r in rows.groupBy("label").agg(F.sum("n").alias("n")).collect()}, rows=rows.count())
        return fit(rows, trees=2, depth=2, least=1)

    monkeypatch.setattr(queries.training, "fit_pointwise", small)
    got = queries.queries()["pointwise_ranking"](spark, copied).orderBy(S1, "rank").collect()
    labels = {r[:2]: r[3] for r in by_sql(copied, "labelled_pairs")[1]}
    assert len(got) == len(labels) and all(labels[r[:2]] == r.label for r in got)
    for a, b in zip(got, got[1:], strict=False):
        assert b.rank == (a.rank + 1 if a[0] == b[0] else 1) and (b.rank == 1 or a.probability_1 >= b.probability_1)
    learnt = [r[3] for r in by_sql(copied, "pointwise_rows")[1]]
    assert (asked[0], asked[1]) == (learnt.count(0), learnt.count(1)) and asked["rows"] < len(learnt)


def test_first_candidates_come_from_tiles(spark, monkeypatch):
    """Pairs of a hot key and of other blocks are met once, in tiles of few classes, with the scores of
    whole ranking; no plan makes a row a pair."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    address = lambda i: None if i % 11 == 0 else word(rng.choice([3, 20, 70, 90])) + f" {rng.randint(1, 9)} 9000{i % 3}"
    rows = lambda s: [(f"S{s}-{i}", ("hot name" if i % 3 else f"name {i % 5}") if i % 7 else None, address(i), ("US", "usa", "India", None)[i % 4]) for i in range(90)]
    left, right = entities(spark, rows(1)), entities(spark, rows(2) + [("S2-900", "hot name", "1 road 90001", "US"), ("S2-901", "hot name", "1 road 90001", "US")])
    specs = queries.POOL + blocking.AUGMENTED["S2"]
    assert [specs[i].name for i in tiles.makers(specs)] == [s.name for s in specs if s.name not in ("full_key", "name_address_key", "name_country_key")]
    wanted = [r.asDict() for r in scoring.scored(evidence.aggregated(blocking.block_pairs(left, right, specs)), left, right).collect()]
    for tile, chunk in ((2048, 1 << 15), (7, 50)):
        monkeypatch.setattr(tiles, "TILE", tile)
        monkeypatch.setattr(tiles, "CHUNK", chunk)
        for most in (1, 4):
            found = classes.scored(left, right, specs, most)
            assert "block_name#" not in plan_of(found)
            key = lambda r: (r[S1], r[C])
            assert sorted((r.asDict() for r in found.collect()), key=key) == sorted((r for r in wanted if r["base_rank"] <= most), key=key)


def test_tile_scores_round_as_sql_does():
    import numpy as np

    assert tiles.rounded(np.array([0.0000005, 0.0078125, 2 / 3, 1.0, 33.1234565])).tolist() == [0.000001, 0.007813, 0.666667, 1.0, 33.123457]


def test_recall_by_groups_makes_no_truth_pairs(spark):
    left = spark.createDataFrame([(f"S1-{i}", i % 3) for i in range(9)], f"{S1} string, left_group int")
    right = spark.createDataFrame([(f"S2-{i}", i % 2) for i in range(6)], f"{C} string, right_group int")
    truth = metrics.LinkedTruth(left, right, spark.createDataFrame([(0, 1), (2, 0), (2, 1)], "left_group int, right_group int"))
    ranked = spark.createDataFrame([(f"S1-{i}", f"S2-{j}", j + 1) for i in range(9) for j in range(5)], f"{S1} string, {C} string, r bigint")
    assert values(metrics.recall_at(truth, ranked, "r", (1, 3)), "*") == values(metrics.recall_at(truth.pairs(), ranked, "r", (1, 3)), "*")
