"""Similarity joins against all pairs, with frequent tokens; words within words; deep and cyclic sections; marks of projects."""

import random

import pytest
from pyspark.sql import functions as F

from trialscope.operators import inference, sections
from trialscope.operators.merge import oldest_mark, project_marks
from trialscope.operators.sections import section_paths


def sets(spark, rows):
    return spark.createDataFrame(rows, "id long, tokens array<string>").withColumn("n", F.size("tokens"))


@pytest.mark.parametrize("heavy", [1_000_000, 500])
def test_classes_equal_all_pairs_with_a_token_in_every_set(spark, monkeypatch, heavy):
    monkeypatch.setattr(inference, "HEAVY", heavy)
    monkeypatch.setattr(inference, "PART", 20)
    rnd = random.Random(2)
    side = lambda n: [(i, ["hot", *dict.fromkeys(rnd.choices([f"w{k}" for k in range(25)], k=rnd.randint(0, 6)))]) for i in range(n)]
    a, b = side(150), side(170)
    for least in (0.2, 0.6):
        want = {(i, j): len(set(x) & set(y)) / len(set(x) | set(y)) for i, x in a for j, y in b}
        want = {k: s for k, s in want.items() if s >= least}
        got = inference.jaccard_pairs(sets(spark, a), sets(spark, b), least).collect()
        assert {(r.a, r.b): pytest.approx(r.score) for r in got} == want and len(got) == len(want)
    links = {r.id: (r.class_id, r.links) for r in inference.jaccard_links(sets(spark, a), sets(spark, b), 0.6).collect()}
    assert links == {i: (min(j for j, y in a if set(y) == set(x)), sum((i, j) in want for j, _ in b)) for i, x in a}


def test_parts_of_a_frequent_token_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(inference, "HEAVY", 1000)
    monkeypatch.setattr(inference, "PART", 50)
    prefixes = spark.range(2000).select((F.col("id") % 2).cast("int").alias("side"), F.lit("hot").alias("token"), F.col("id").alias("set"), F.lit(3).alias("n"), F.lit(3).alias("rest"))
    joined = inference._met(prefixes, 0.2)
    assert joined.count() == 1_000_000
    plan = joined._jdf.queryExecution().toString()
    assert "r_part" in plan


def test_pairs_of_members_are_made_in_bounded_parts_and_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(inference, "PART", 10)
    monkeypatch.setattr(inference, "TASK_PAIRS", 100)
    side = lambda n: sets(spark, [(i if i else None, ["a", "b"] if i % 2 else ["a", "b", "c"]) for i in range(n)])
    got = inference.jaccard_pairs(side(80), side(60), 0.6)
    assert got.rdd.getNumPartitions() == 48
    assert max(got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()) < 1000
    assert {(r.a, r.b): round(r.score, 3) for r in got.collect()} == {(i or None, j or None): 1.0 if i % 2 == j % 2 else 0.667 for i in range(80) for j in range(60)}
    assert got.count() == 80 * 60


def test_words_within_words(spark):
    rnd = random.Random(4)
    words = lambda: sorted({"".join(rnd.choices("abc", k=rnd.randint(2, 7))) for _ in range(120)})
    a, b = words(), words()
    got = inference.word_matches(spark.createDataFrame([(w,) for w in a], "ta string"), spark.createDataFrame([(w,) for w in b], "tb string")).collect()
    assert sorted(map(tuple, got)) == sorted((x, y) for x in a for y in b if x in y or y in x)


def test_deep_and_cyclic_sections(spark):
    rows = [(i, i - 1 if i > 1 else None, f"s{i}") for i in range(1, 1001)] + [(2000, 2001, "a"), (2001, 2002, "b"), (2002, 2000, "c"), (2003, 2000, "d"), (3000, 9999, "lost"), (4000, 4000, "self")]
    got = {r.id: r.path for r in section_paths(spark.createDataFrame(rows, "id long, parent_id long, name string")).collect()}
    assert len(got) == len(rows) and got[1000] == " / ".join(f"s{i}" for i in range(1, 1001)) and got[3000] == "lost"
    assert (got[2000], got[2003], got[4000]) == ("? / c / b / a", "? / c / b / a / d", "? / self")
    assert section_paths(spark.createDataFrame([], "id long, parent_id long, name string")).count() == 0


def test_long_paths_are_not_written_in_each_round(spark, monkeypatch):
    names = []

    def kept(df, name):
        out = spark.createDataFrame(df.collect(), df.schema)
        names.append(out.agg(F.sum(F.size(F.split("path", " / ")))).first()[0] or 0)
        return out

    monkeypatch.setattr(sections, "kept", kept)
    rows = [(i, i - 1 if i % 1000 != 1 else None, f"s{i}") for i in range(1, 2001)]
    got = {r.id: r.path for r in section_paths(spark.createDataFrame(rows, "id long, parent_id long, name string")).collect()}
    assert got == {i: " / ".join(f"s{j}" for j in range((i - 1) // 1000 * 1000 + 1, i + 1)) for i, _, _ in rows}
    assert sum(names) < 500_000  # all paths together have a million


def test_branches_that_end_in_anchored_cycles(spark):
    rows = [(i, i - 1 if i else 9, f"s{i}") for i in range(10)] + [(1000 + i, 999 + i if i else 7, "t") for i in range(14)] + [(2000 + i, 1999 + i if i else None, "u") for i in range(40)]
    got = {r.id: r.path for r in section_paths(spark.createDataFrame(rows, "id long, parent_id long, name string")).collect()}
    names, up = {i: n for i, _, n in rows}, {i: p for i, p, _ in rows}

    def path(i):
        seen, out = [], []
        while i is not None and i not in seen:
            seen.append(i)
            out.append(names[i])
            i = up[i]
        return " / ".join(["?"] * (i is not None) + out[::-1])

    assert got == {i: path(i) for i in names}


def test_marks_of_requested_projects(spark):
    rows = spark.sql("SELECT * FROM VALUES ('A', TIMESTAMP'2024-01-05 10:00:00'), ('A', TIMESTAMP'2024-01-02 00:00:00'), ('B', TIMESTAMP'2024-01-03 00:00:00'), ('C', TIMESTAMP'2020-01-01 00:00:00') AS t(project_key, updated_at)")
    asked = lambda *p: spark.createDataFrame([(x,) for x in p], "project_key string")
    told = lambda m: {r.project_key: str(r.since) for r in m.collect()}
    two, new = project_marks(rows, asked("A", "B"), "project_key", "updated_at"), project_marks(rows, asked("A", "N"), "project_key", "updated_at")
    assert told(two) == {"A": "2024-01-05 09:00:00", "B": "2024-01-02 23:00:00"} and str(oldest_mark(two).first().since) == "2024-01-02 23:00:00"
    assert told(new) == {"A": "2024-01-05 09:00:00", "N": "None"} and oldest_mark(new).first().since is None
    assert told(project_marks(rows, asked("A"), "project_key", "updated_at", full=True)) == {"A": "None"}
    assert told(project_marks(rows, asked("A", "N"), "project_key", "updated_at", explicit="2021-01-01 00:00:00")) == {"A": "2021-01-01 00:00:00", "N": "2021-01-01 00:00:00"}


def test_bridges_of_many_copies_keep_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(inference, "PART", 30)
    monkeypatch.setattr(inference, "TASK_PAIRS", 1000)
    kept_rows, keep = [], inference.kept
    monkeypatch.setattr(inference, "kept", lambda df, name: (kept_rows.append((name, (out := keep(df, name)).count())), out)[1])
    # An issue and a case with two titles each that are equal, copies of one title, and near copies for the third step.
    issues = [(f"P-{i}", "log in twice") for i in range(100)] + [("P-0", "pay now"), ("P-7", ""), ("Q-1", "red green blue white"), ("Q-2", "red green blue white"), ("R-1", "one two three four")]
    cases = [(i, "Verify that log in twice") for i in range(120)] + [(0, "pay now"), (500, "red green blue white black"), (501, "one two three four five"), (502, None)]
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    issue, case = frame(issues, "issue_key string, summary string"), frame(cases, "tr_case_id long, title string")
    auto, test = frame([("P-1", 1)], "issue_key string, test_case_id long"), frame([(1, 5)], "test_case_id long, tr_case_id long")
    out = inference.bridge_waterfall(auto, test, issue, case, frame([(6,)], "tr_case_id long"))
    got = sorted((r.issue_key, r.tr_case_id, r.strategy) for r in out.collect())
    want = [("P-1", 5, "A"), ("R-1", 501, "C")] + [(f"P-{i}", c, "B") for i in range(100) for c in range(120) if c not in (5, 6)]
    assert got == sorted(want)
    assert max(n for _, n in kept_rows) < 1000 < len(want)


def test_projects_are_synced_without_dealing_issues_by_project(spark):
    from trialscope.operators import ingest

    pages = spark.createDataFrame([('{"issues":[{"key":"P0-1","fields":{"summary":"new","updated":"2024-01-05T00:00:00.000+0000"}},{"key":"P1-1","fields":{"summary":"other","updated":"2024-01-05T00:00:00.000+0000"}}]}',)], "text string")
    issues = ingest.landed.issues(pages).limit(0)
    asked = spark.createDataFrame([("P0", None)], "project_key string, since timestamp")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ingest.sync_issue_projects(issues, pages, asked)
        assert [(r.issue_key, r.summary) for r in out.collect()] == [("P0-1", "new")]
        assert "hashpartitioning(project_key" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_what_is_shuffled_for_pairs_grows_as_the_members(spark, monkeypatch):
    """Parts grow with the root of the pairs, so that there are some TASKS cells at most."""
    monkeypatch.setattr(inference, "PART", 10)
    monkeypatch.setattr(inference, "TASKS", 16)
    for n in (200, 400):
        issues = spark.range(n).select(F.concat(F.lit("P-"), F.col("id").cast("string")).alias("issue_key"), F.lit("log in").alias("summary"))
        cases = spark.range(n).select(F.col("id").alias("tr_case_id"), F.lit("log in").alias("title"))
        none = cases.select("tr_case_id").limit(0)
        seen, deal = [], type(cases).repartition
        monkeypatch.setattr(type(cases), "repartition", lambda self, *a: (seen.append(self), deal(self, *a))[1])
        pairs = inference.bridge_by_title(issues, cases, none, none)
        monkeypatch.setattr(type(cases), "repartition", deal)
        assert [df.selectExpr("sum(size(ids))").first()[0] for df in seen] == [4 * n, 4 * n]
        assert pairs.distinct().count() == pairs.count() == n * n
