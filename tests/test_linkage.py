import inspect
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from kinlink import registry
from kinlink.operators import blocking, explore, features, learn, metrics, validate
from kinlink.plans import linkage
from kinlink.profiles import FORMULA_A, GATED, PACKAGE, PACKAGE_STRICT, PROFILES
from kinlink.sources import entities, sinks
from kinlink.streaming import ingest

SF = "/root/testdata/sf0.001"
NORMAL = "entity_id string, source string, clean_name string, clean_address string, state string, country string, house_number string, business_name string, business_address string"


def records(spark, rows):
    return spark.createDataFrame([(i, s, n, a, st, c, "12", n, a) for i, s, n, a, st, c in rows], NORMAL)


@pytest.fixture
def query(spark):
    return records(spark, [("S1-1", "S1", "b retail", "12 main street", "Texas", "US"), ("S1-2", "S1", "nothing", "zz", None, None)])


@pytest.fixture
def pool(spark):
    return records(
        spark,
        [
            ("C1", "S2", "b retail", "12 main street", "Texas", "US"),
            ("C2", "S3", "bretail", "9 oak avenue", "Texas", "US"),
            ("C3", "S2", "zeta", "12 main road", "Ohio", "US"),
            ("C4", "S2", "zeta", "7 elm lane", "Texas", "US"),
            ("C5", "S2", "b retail", "12 main street", "Texas", "France"),
        ],
    )


def test_hand_scored_blocking(query, pool):
    got = blocking.block_topk(query, pool).orderBy("rank").collect()
    assert [(r.entity_id, r.name_overlap_len1, r.name_overlap_gt1, r.address_overlap_count, r.state_match, r.matching_score) for r in got] == [("C1", 1, 1, 3, 1, 13.0), ("C2", 0, 1, 0, 1, 6.0), ("C3", 0, 0, 2, 0, 4.0)]


def test_gate_and_formulas(query, pool):
    assert [r.entity_id for r in blocking.block_topk(query, pool, GATED).orderBy("rank").collect()] == ["C1", "C2"]
    got = {r.entity_id: (r.name, r.matching_score) for r in blocking.formula_a(query, pool).collect()}
    assert got == {"C1": (2, 8.0), "C2": (2, 5.0), "C3": (0, 2.0)}
    assert FORMULA_A.weights == {"name": 2.0, "addr": 1.0, "state": 1.0}


@pytest.mark.parametrize("frequent", [0, 1, 5, 10**6])
@pytest.mark.parametrize("profile", ["package", "gated"])
def test_pruning_changes_nothing(spark, frequent, profile):
    s1, pool = registry._norm(spark, SF)
    want = {tuple(r) for r in blocking.block_topk(s1, pool, PROFILES[profile]).collect()}
    assert {tuple(r) for r in blocking.pruned_candidates(s1, pool, PROFILES[profile], frequent).collect()} == want


def test_top_k_is_nested(spark):
    from dataclasses import replace

    s1, pool = registry._norm(spark, SF)
    few, more = ({(r.s1_entity_id, r.entity_id) for r in blocking.block_topk(s1, pool, replace(PACKAGE, top_k=k)).collect()} for k in (3, 4))
    assert few <= more


def test_plans_have_no_cross_products(spark):
    s1, pool = registry._norm(spark, SF)
    plan = linkage.linked_pairs(s1, pool)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert "WindowGroupLimit" in plan


def test_features(query, pool):
    rows = {r.candidate_id: r for r in features.pair_features(query, blocking.top_candidates(query, pool)).collect()}
    a, b = rows["C1"], rows["C2"]
    assert (a.word_jaccard, a.is_exact_core_match, a.house_number_match, a.both_exact_and_state, a.score_per_word) == (1.0, 1, 1, 1, 6.5)
    assert (b.common_words_count, b.word_jaccard, b.is_substring_match, b.source_is_s3, b.score_per_word) == (0, 0.0, 0, 1, 6.0)
    strict = features.pair_features(query, blocking.top_candidates(query, pool, PACKAGE_STRICT), PACKAGE_STRICT)
    assert strict.agg(F.max("has_house_num_cand")).first()[0] == 0
    assert rows["C1"].__fields__[3:] == features.FEATURES


def test_truth(spark):
    truth = spark.createDataFrame([("S1-1", "S2-1, S3-2,"), ("S1-2", None), ("S1-3", " ")], entities.TRUTH)
    assert {tuple(r) for r in entities.truth_pairs(truth).collect()} == {("S1-1", "S2-1"), ("S1-1", "S3-2")}
    assert {tuple(r) for r in entities.truth_pairs(truth, strict_reference=True).collect()} >= {("S1-2", "nan")}


def test_entity_scores(spark):
    cases = [("", ""), ("", "a"), ("a", ""), ("ab", "ab"), ("ab", "a"), ("a", "ab"), ("a", "b")]
    s1 = spark.createDataFrame([(str(i),) for i in range(7)], "entity_id string")
    pairs = lambda k: spark.createDataFrame([(str(i), x) for i, c in enumerate(cases) for x in c[k]], "s1_id string, candidate_id string")
    got = {r.s1_id: r.f05 for r in metrics.entity_f05(s1, pairs(0), pairs(1)).collect()}
    assert [got[str(i)] for i in range(7)] == pytest.approx([1, 0, 0, 1, 5 / 6, 5 / 9, 0])
    assert metrics.macro_f05(s1, pairs(0), pairs(1)).first()[0] == pytest.approx(61 / 126)


def test_threshold_by_entities_equals_direct(spark):
    s1 = spark.createDataFrame([("a",), ("b",), ("c",)], "entity_id string")
    truth = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "z")], "s1_id string, candidate_id string")
    rows = spark.createDataFrame([("a", "x", 1, 0.9), ("a", "w", 0, 0.4), ("b", "y", 1, 0.55), ("c", "q", 0, 0.2)], "s1_id string, candidate_id string, label int, score double")
    got = {round(r.threshold, 2): r.macro_f05 for r in metrics.macro_threshold(s1, truth, rows).collect()}
    for t in (0.1, 0.2, 0.21, 0.4, 0.41, 0.55, 0.56, 0.9):
        want = metrics.macro_f05(s1, truth, rows.where(F.col("score") >= t)).first()[0]
        assert got[t] == pytest.approx(want)


def test_metrics_on_nothing(spark):
    none = spark.createDataFrame([], "label int, score double")
    assert metrics.best_threshold(none).first().threshold == 0.5
    assert metrics.prf_at(none, 0.5).count() == 1 and metrics.roc_auc(none).first()[0] == 0.0


def test_tables_round_trip(spark, tmp_path):
    (tmp_path / "e.tsv").write_text('entity_id\tcountry\tbusiness_name\tbusiness_address\nS2-1\tUS\tNA\t"a ""b"" c"\nS2-2\tFrance\té\t\n')
    got = [tuple(r) for r in entities.read_entities(spark, str(tmp_path / "e.tsv")).orderBy("entity_id").collect()]
    assert got == [("S2-1", None, 'a "b" c', "US"), ("S2-2", "é", None, "France")]
    lists = spark.createDataFrame([("S1-1", "S2-1,S3-1"), ("S1-2", "")], "source1_entity_id string, matched_entity_ids string")
    sinks.write_lists(lists, str(tmp_path / "out"), single_file=True, order_by="source1_entity_id")
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text() == "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\n"
    names = sinks.write_archive(str(tmp_path / "s.zip"), [str(part)], "kinlink/sources")
    assert "code/entities.py" in names and len(zipfile.ZipFile(tmp_path / "s.zip").namelist()) == len(names)


def test_cache_and_paths(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([("a",)], "clean_name string")

    for _ in range(2):
        assert entities.cached(spark, str(tmp_path / "c"), build).count() == 1
    assert len(calls) == 1
    assert entities.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "c")]).endswith("c")
    with pytest.raises(FileNotFoundError):
        entities.first_existing(spark, [str(tmp_path / "no")])


@pytest.fixture
def files(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
        return str(path)

    write("s1.tsv", "entity_id\tx\nS1-1\ta\nS1-2\tb\n\n")
    write("s2.tsv", "entity_id\tx\nS2-1\ta\n")
    write("s3.tsv", "entity_id\tx\nS3-1\ta\n")
    return write, tmp_path


HEAD = "source1_entity_id\tmatched_entity_ids\n"


@pytest.mark.parametrize(
    "body,fault",
    [
        (HEAD + "S1-1\tS2-1,S3-1\nS1-2\t\n\n", None),
        ("source1_entity_id,matched_entity_ids\n", "commas"),
        ("id\tids\n", "header"),
        ("", "empty"),
        (HEAD + "S1-1\t\nS1-2\n", "without a tab"),
        (HEAD + "S1-1\t\nS1-1\t\nS1-2\t\n", "repeated records"),
        (HEAD + "S1-1\tS2-1,S2-1\nS1-2\t\n", "ids repeated"),
        (HEAD + "S1-1\tS1-9\nS1-2\t\n", "matched with source 1"),
        (HEAD + "S1-1\tX-1\nS1-2\t\n", "prefix"),
        (HEAD + "S1-1\tS2-1,,S3-1\nS1-2\t\n", "prefix"),
        (HEAD + "S1-1\tS2-999\nS1-2\t\n", "unknown ids"),
        (HEAD + "S1-1\t\n", "records missing"),
        (HEAD + "S1-1\t\nS1-2\t\nS1-3\t\n", "not in source 1"),
        (HEAD.encode() + b"S1-1\t\xff\xfe\nS1-2\t\n", "UTF-8"),
        (HEAD + "S1-1\tS2-1\textra\nS1-2\t\n", "unknown ids"),
    ],
)
def test_validator(spark, files, body, fault):
    write, at = files
    report = validate.validate(spark, str(at / "s1.tsv"), write("m.tsv", body), None, (str(at / "s2.tsv"), str(at / "s3.tsv")), check_ids=True)
    assert report.exit_code == (fault is not None)
    if fault:
        assert any(fault in e for e in report.errors)


def test_validator_warnings(spark, files):
    write, at = files
    match, cand = write("m.tsv", HEAD + "S1-1\tS2-1\nS1-2\tS3-9\n"), write("c.tsv", "source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1\nS1-2\t\n")
    report = validate.validate(spark, str(at / "s1.tsv"), match, cand, (str(at / "gone.tsv"),), check_ids=True)
    assert report.exit_code == 0 and any("no candidates" in w for w in report.warnings) and any("gone" in w for w in report.warnings)
    assert report.stats[match] == {"rows": 2, "non_empty": 2, "empty": 0}
    assert validate.validate(spark, str(at / "none.tsv"), match).exit_code == 1
    assert any("missing" in e for e in validate.validate(spark, str(at / "s1.tsv"), str(at / "none.tsv")).errors)


def test_folds_keep_groups_and_are_even(spark):
    pairs = spark.range(5000).select((F.col("id") % 400).cast("string").alias("s1_id"))
    folds = learn.group_folds(pairs)
    assert folds.count() == 400
    sizes = [r.n for r in folds.groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) < 30


def test_learning_end_to_end(spark, tmp_path):
    pairs = registry._labelled(spark, SF)
    models, scored = learn.train_folds(pairs, k=2, trees=3)
    assert scored.count() == pairs.count()
    mean = learn.ensemble(models, pairs)
    assert mean.where("score < 0 or score > 1").count() == 0
    learn.save(models, str(tmp_path / "m"))
    again = learn.ensemble(learn.load(str(tmp_path / "m"), 2), pairs)
    key = ["s1_id", "candidate_id"]
    assert mean.select(*key, F.round("score", 9)).exceptAll(again.select(*key, F.round("score", 9))).isEmpty()
    lists = explore.filled_lists(registry._norm(spark, SF)[0], explore.match_lists(learn.decide(mean, 0.5)))
    assert explore.prediction_totals(lists).first().records == registry._norm(spark, SF)[0].count()


def test_arrivals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tb retail\t12 Main St, Dallas, TX\tUS\n")
    pool = linkage.normalized(spark.createDataFrame([("S2-1", "B Retail", "12 Main Street, Dallas, TX", "US", "S2")], "entity_id string, business_name string, business_address string, country string, source string"))
    got = []
    ingest.link_arrivals(spark, str(tmp_path / "in"), pool, lambda df, n: got.extend((n, r.s1_entity_id, r.entity_id) for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert got == [(0, "S1-1", "S2-1")]


def test_learning_queries_use_the_production_folds_and_trees(monkeypatch):
    calls, signature = [], inspect.signature(learn.train_folds)

    def fake(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        calls.append((bound.arguments["k"], bound.arguments["trees"]))
        raise InterruptedError

    monkeypatch.setattr(learn, "train_folds", fake)
    monkeypatch.setattr(registry, "_labelled", lambda spark, d: None)
    for name in ("oof_scores", "feature_importance"):
        with pytest.raises(InterruptedError):
            registry.queries()[name](None, "")
    assert calls == [(5, 1000)] * 2


def test_hot_tokens_are_cut_into_cells_and_lose_nothing(spark, monkeypatch):
    left = spark.createDataFrame([(f"a{i}", "US", "t" if i % 3 else f"u{i % 7}") for i in range(60)], "s1 string, country string, token string")
    right = spark.createDataFrame([(f"b{i}", "US", "t" if i % 2 else f"u{i % 5}") for i in range(90)], "id string, country string, token string")
    want = sorted(map(tuple, left.join(right, ["country", "token"]).select("s1", "id").collect()))
    for hot in (1, 7, 1000):
        got = sorted(map(tuple, blocking.dealt_join(left, right, ["country", "token"], "s1", "id", hot).select("s1", "id").collect()))
        assert got == want
    s1, pool = registry._norm(spark, "/root/testdata/sf0.001")
    whole = [sorted(map(tuple, f(s1, pool).select("s1_entity_id", "entity_id", "rank").collect())) for f in (blocking.block_topk, blocking.pruned_candidates)]
    monkeypatch.setattr(blocking, "HOT", 3)
    assert [sorted(map(tuple, f(s1, pool).select("s1_entity_id", "entity_id", "rank").collect())) for f in (blocking.block_topk, blocking.pruned_candidates)] == whole


def test_lines_of_parts_are_numbered_under_one_header(spark, tmp_path):
    rows = spark.createDataFrame([(f"S1-{i:02}", f"S2-{i}") for i in range(9)], "source1_entity_id string, matched_entity_ids string").repartition(3)
    sinks.write_lists(rows, str(tmp_path / "parts"))
    got = sorted(map(tuple, entities.read_lines(spark, str(tmp_path / "parts")).collect()))
    assert [n for n, _ in got] == list(range(1, 11)) and got[0][1].startswith("source1") and sum("source1" in v for _, v in got) == 1
    (tmp_path / "one.tsv").write_text("h\tx\n\nS1-1\ta\nh\tx\n")
    assert [tuple(r) for r in entities.read_lines(spark, str(tmp_path / "one.tsv")).orderBy("line_no").collect()] == [(1, "h\tx"), (2, ""), (3, "S1-1\ta"), (4, "h\tx")]


def test_features_fall_back_to_csv(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(1, 0.5)], "a int, b double")
    assert sinks.write_features(rows, str(tmp_path / "f")).endswith("f")

    def refuses(self, path):
        raise OSError(path)

    monkeypatch.setattr(type(rows.write), "parquet", refuses)
    with pytest.warns(UserWarning):
        used = sinks.write_features(rows, str(tmp_path / "g"))
    assert used.endswith(".csv") and entities.reload_features(spark, None, str(tmp_path / "none"), used).count() == 1


def test_boosting_ends_early_and_says_when(spark):
    pairs = registry._labelled(spark, "/root/testdata/sf0.01")
    models, scored = learn.train_folds(pairs, k=2, trees=40)
    assert len(learn.best_iterations(models)) == 2 and all(1 <= n <= 40 for n in learn.best_iterations(models))
    assert scored.groupBy("s1_id").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty()


def test_percents_round_as_c_does(spark):
    pairs = [(15, 48), (1, 16), (3, 16), (321, 2000), (1, 3), (0, 7), (7, 7), (1, 2000), (3, 2000), (1999, 2000)]
    got = spark.createDataFrame(pairs, "f long, n long").select("f", "n", metrics.percent(100.0 * F.col("f") / F.col("n")).alias("p")).collect()
    assert {(r.f, r.n): r.p for r in got} == {(f, n): f"{100.0 * f / n:.1f}%" for f, n in pairs}


def test_tiles_equal_brute_force_and_shuffle_no_pairs(spark, monkeypatch):
    """Small cells, copies, missing states, ties: against a double loop in Python."""
    import random

    from kinlink.operators import tiles

    r = random.Random(3)
    words = ["oak", "elm", "a", "b", "lime", "oaklime", "elma", "group"]

    def record(i, side):
        return (f"{side}{i}", r.choice(["US", "France", None]), r.choice(["x", "y", None]), " ".join(r.choices(words, k=r.randrange(4))), " ".join(r.choices(words, k=r.randrange(3))))

    left, right = [record(i, "Q") for i in range(40)], [record(i, "C") for i in range(70)]
    schema = "entity_id string, country string, state string, clean_name string, clean_address string"
    s1, pool = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)

    def brute():
        for q in left:
            n = q[3].split()
            gt1 = {w for w in n if len(w) > 1} | ({"".join(n)} if len(n) > 1 else set())
            for c in right:
                if q[1] is not None and q[1] == c[1]:
                    cn = set(c[3].split())
                    len1 = len({w for w in n if len(w) == 1} & cn)
                    more, addr = len(gt1 & {w for w in cn if len(w) > 1}), len({w for w in q[4].split() if len(w) > 1} & set(c[4].split()))
                    if len1 + more + addr:
                        same = int(q[2] is not None and q[2] == c[2])
                        yield q[0], c[0], len1, more, addr, same, 1.0 * len1 + 4 * more + 2 * addr + 2 * same

    want = sorted(brute())
    for cells in ((8192, 32768), (3, 4)):
        monkeypatch.setattr(tiles, "QUERY_CELL", cells[0])
        monkeypatch.setattr(tiles, "POOL_CELL", cells[1])
        every = blocking.scored_candidates(s1, pool)
        assert sorted(map(tuple, every.collect())) == want
        got = {(x.s1_entity_id, x.entity_id, x.rank) for x in blocking.block_topk(s1, pool).where("rank <= 3").collect()}
        best = {q: sorted((-x[6], x[1]) for x in want if x[0] == q)[:3] for q in {x[0] for x in want}}
        assert got == {(q, c, k + 1) for q, rows in best.items() for k, (_, c) in enumerate(rows)}
    assert "hashpartitioning(s1_entity_id" not in every._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["score_a", "state_match"])
def test_all_pairs_shuffle_records_not_cells(spark, monkeypatch, name):
    """Over many cells a record is shuffled twice at most, once in a cell, once with it, and all pairs are handed out."""
    from kinlink.operators import tiles

    def written():
        none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, spark.sparkContext._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    schema = "entity_id string, country string, state string, clean_name string, clean_address string"
    s1 = spark.createDataFrame([(f"Q{i}", "US", "x", "oak elm", f"lane w{i % 7}") for i in range(200)], schema)
    pool = spark.createDataFrame([(f"C{i}", "US", "x", "oak fir", f"road w{i % 5}") for i in range(300)], schema)
    monkeypatch.setattr(tiles, "QUERY_CELL", 50)
    monkeypatch.setattr(tiles, "POOL_CELL", 50)
    rows = blocking.formula_a(s1, pool) if name == "score_a" else blocking.scored_candidates(s1, pool)
    before = written()
    got = rows.select("s1_entity_id", "entity_id", "addr").collect()
    assert written() - before < 3 * (200 + 300)
    assert sorted(map(tuple, got)) == sorted((f"Q{i}", f"C{j}", int(i % 7 == j % 5)) for i in range(200) for j in range(300))


def _frequent_words(spark):
    """Records of words of which some are frequent, as in texts."""
    import random

    r = random.Random(7)
    some = lambda k: " ".join(f"w{int(300 * r.random() ** 3)}" for _ in range(k))
    schema = "entity_id string, country string, state string, clean_name string, clean_address string"
    sides = ([(f"{side}-{i:06d}", "US", r.choice(["x", "y", None]), some(4), some(8)) for i in range(n)] for side, n in (("S1", 200), ("S2", 4000)))
    return tuple(spark.createDataFrame(rows, schema) for rows in sides)


def _bits_a_pair(rows, path):
    """Bits of Parquet a row, without what a file has besides."""
    import pyarrow.parquet as pq

    rows.write.parquet(str(path))
    groups = [m.row_group(i) for f in path.glob("*.parquet") for m in [pq.read_metadata(f)] for i in range(m.num_row_groups)]
    return 8 * sum(g.column(i).total_compressed_size for g in groups for i in range(g.num_columns)) / sum(g.num_rows for g in groups)


@pytest.mark.parametrize("name, bits", [("score_a", 12), ("state_match", 5)])
def test_all_pairs_are_written_small(spark, monkeypatch, tmp_path, name, bits):
    """All pairs are handed out in an order in which columns of files are runs."""
    monkeypatch.setattr(registry, "_norm", lambda *_: _frequent_words(spark))
    assert _bits_a_pair(registry.queries()[name](spark, ""), tmp_path / "pairs") < bits


def test_pairs_of_many_common_words(spark, monkeypatch):
    """Counters of more values than two bytes tell apart, more queries in a cell than are taken at once, equal ids."""
    from kinlink.operators import tiles

    monkeypatch.setattr(tiles, "PAIR_STRIP", 3)
    words = [f"w{i}" for i in range(400)]
    schema = "entity_id string, country string, state string, clean_name string, clean_address string"
    left = [(f"Q{i % 7}", "US", "x", " ".join(words[: 40 * i]), " ".join(words[: 35 * i])) for i in range(10)]
    right = [(f"C{i % 6}", "US", "xy"[i % 2], " ".join(words[30 * i :]), " ".join(words[20 * i :])) for i in range(12)]
    got = blocking.formula_a(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).drop("matching_score")
    common = lambda a, b: len(set(a.split()) & set(b.split()))
    want = [(q[0], c[0], common(q[3], c[3]), common(q[4], c[4]), int(q[2] == c[2])) for q in left for c in right]
    assert sorted(map(tuple, got.collect())) == sorted(x for x in want if x[2] or x[3])


def test_equal_keys_count_as_pairs_do_and_pairs_are_no_rows(spark):
    """Truth by key against truth by pairs: groups of copies, missing names, records and candidates without a match."""
    import random

    r = random.Random(5)
    names = ["oak", "OAK", "elm", "lime", "", None, "fir"]
    s1 = spark.createDataFrame([(f"S1-{i}", r.choice(names), "US") for i in range(30)], "entity_id string, business_name string, country string")
    pool = spark.createDataFrame([(f"S2-{i}", r.choice(names[:-1]), "US") for i in range(60)], s1.schema)
    drawn = [(f"S1-{i}", f"S2-{c}", k + 1) for i in range(25) for k, c in enumerate(r.sample(range(60), 12))]
    top = spark.createDataFrame(drawn, "s1_entity_id string, entity_id string, rank int")
    keys = entities.adapted_keys(s1, pool)
    truth = keys[0].join(keys[1], "key").select("s1_id", "candidate_id")
    pairs = top.select(F.col("s1_entity_id").alias("s1_id"), F.col("entity_id").alias("candidate_id"))

    def same(a, b):
        assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))

    per, direct = metrics.per_record_by_key(*keys, top), metrics.per_record(metrics.truth_ranks(truth, top))
    same(per, direct)
    same(metrics.counted_f05(s1, metrics.key_counts(*keys), features.with_key_labels(pairs, *keys)), metrics.entity_f05(s1, truth, pairs))
    same(features.with_key_labels(pairs, *keys), features.with_labels(pairs, truth))
    ranks = [x["rank"] for x in metrics.truth_ranks(truth, top).collect()]
    band = lambda x: "Missed" if x is None else "1" if x == 1 else "2-5" if x <= 5 else "6-10" if x <= 10 else "11-15"
    assert {x.band: x.n for x in metrics.rank_bands(per).collect()} == {b: sum(band(x) == b for x in ranks) for b in set(map(band, ranks))}


@pytest.mark.parametrize("name", ["rank_bands", "blocking_recall", "entity_f05", "oof_scores", "feature_importance"])
def test_true_pairs_are_not_expanded(spark, monkeypatch, name):
    def expanded(*_, **__):
        raise AssertionError("pairs of equal names became rows")

    monkeypatch.setattr(entities, "adapted_truth", expanded)
    monkeypatch.setattr(learn, "train_folds", lambda pairs: ([], pairs.withColumn("score", F.lit(0.0))))
    monkeypatch.setattr(learn, "importances", lambda spark, models: spark.range(1))
    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count()


def test_records_are_normalised_once(spark):
    """Queries that join records to their candidates read them from a table."""
    for name in ("pair_attach", "common_tokens", "blocking_summary"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "documents.parquet" not in plan and "regexp_replace" not in plan
