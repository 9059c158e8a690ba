import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalogspark.operators import bm25, compare, evaluate, observe, plan, search, stats, views
from catalogspark.operators import families as fam
from catalogspark.operators.diff import carried_forward, snapshot_diff
from catalogspark.operators.graph import connected_components


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 240)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {v: find(v) for v in root}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_diff_statuses(spark):
    s = "id string, title string, org_name string, modified_date string"
    prev = spark.createDataFrame([("a", "A", "o", None), ("b", "B", "o", "1"), ("c", "C", "o", "1"), ("i", "I", "o", "1"), ("w", "W", "o", "1")], s)
    cur = spark.createDataFrame([("a", "A", "o", None), ("b", "B", "o", "2"), ("d", "D", "o", "1"), ("i", "J", "p", "1"), ("z", "Z", "o", "1")], s)
    ids = lambda x: spark.createDataFrame([(x,)], "record_id string")
    got = {r.record_id: (r.status, r.changed_fields) for r in snapshot_diff(prev, cur, "id", ["title", "org_name", "modified_date"], prev_missing=ids("z"), withdrawn=ids("w")).collect()}
    assert got == {"b": ("MODIFIED", ["modified_date"]), "c": ("MISSING_FROM_SNAPSHOT", None), "d": ("ADDED", None), "i": ("POSSIBLE_IDENTITY_CHANGE", ["title", "org_name"]), "z": ("REAPPEARED", None), "w": ("OFFICIALLY_WITHDRAWN", None)}
    feed = snapshot_diff(prev, cur, "id", ["title"], identity=())
    assert carried_forward(feed.limit(0), feed) is feed and carried_forward(feed, feed.limit(0)) is feed


def test_families(spark):
    rows = [("1", "k1", "구로구 현황(2023)", "A"), ("2", "k2", "구로구 현황(2024)", "A"), ("3", "k3", "구로구 현황(2024)", "B"), ("4", "k4", "버스_가나다_노선도", "A"), ("5", "k5", "버스_라마바_노선도", "A"), ("6", "k6", "버스_사아자_노선도", "A"), ("7", "k7", "자치 예산", "C"), ("8", "k8", "다른 이름", "C")]
    rec = spark.createDataFrame([(*r, []) for r in rows], "record_id string, list_key string, title string, org string, regions array<string>")
    st_ = spark.createDataFrame([("k7", "h", 5), ("k8", "h", 5), ("k1", "n", 2), ("k4", "n", 2)], "list_key string, structure_hash string, column_count int")
    f, m = fam.detect_families(rec, st_)
    groups = {}
    for r in m.collect():
        groups.setdefault(r.family_id, set()).add(r.record_id)
    assert sorted(map(sorted, groups.values())) == [["1", "2"], ["4", "5", "6"], ["7", "8"]]
    by = {frozenset(groups[r.family_id]): r for r in f.collect()}
    assert by[frozenset("12")].relation == "TIME_LIKE" and by[frozenset("456")].signals == ["PATTERN"]
    assert by[frozenset("78")].evidence == "PLUS_STRUCTURE" and by[frozenset("78")].review == "UNREVIEWED"
    sheet = spark.createDataFrame([("x", "NOT_A_FAMILY"), ("y", " ")], "family_id string, review string")
    old = spark.createDataFrame([("x", "CONFIRMED_FAMILY"), ("y", "CONFIRMED_FAMILY")], "family_id string, review string")
    assert {tuple(r) for r in fam.merge_reviews(old, sheet).collect()} == {("x", "NOT_A_FAMILY"), ("y", "CONFIRMED_FAMILY")}


@settings(max_examples=5, deadline=None)
@given(st.integers(1, 7), st.integers(0, 30))
def test_pages_have_no_gaps(spark, size, n):
    df = spark.range(n).select(F.col("id"), (F.col("id") % 3).alias("k"))
    seen, offset = [], 0
    while True:
        rows = sorted(stats.page(df, [F.col("k"), F.col("id")], offset, size).collect(), key=lambda r: r.row_no)
        seen += [r.id for r in rows]
        if not rows or not rows[0].has_more:
            break
        offset += size
    assert seen == sorted(range(n), key=lambda i: (i % 3, i))


def test_search(spark):
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "apple apple"), (3, "red car"), (4, None)], "id long, text string")
    q = spark.createDataFrame([("and", "red apple"), ("or", "apple car"), ("none", "zzz"), ("blank", "")], "query_id string, text string")
    got = bm25.bm25(q, docs, "id", {"text": 2.0}).collect()
    assert {(r.query_id, r.mode) for r in got} == {("and", "AND"), ("or", "OR")}
    assert [r.doc for r in got if r.query_id == "and"] == [1] and {r.doc for r in got if r.query_id == "or"} == {1, 2, 3}
    asked = spark.createDataFrame([("q", "서울 버스 CSV 부산 월간", ["updateCycle"])], "query_id string, text string, skip array<string>")
    r = search.interpret(asked).head()
    assert (r.region, r.format, r.updateCycle, r.listType, r.rest) == ("KR-11", "CSV", None, None, "버스 부산 월간")


def test_stored_index_serves_the_same(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"red {'apple ' * (i % 4)}w{i % 7}", "apple" if i % 5 else "pear tree") for i in range(60)], "id long, text string, title string")
    fields = {"text": 1.0, "title": 4.0}
    q = spark.createDataFrame([("a", "apple w3"), ("b", "pear"), ("c", "zzz apple"), ("n", "nothing")], "query_id string, text string")
    bm25.write_index(docs, "id", fields, f"file://{tmp_path}/index")
    index = bm25.read_index(spark, f"file://{tmp_path}/index")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(bm25.bm25(q, docs, "id", fields)) == key(bm25.bm25(q, None, "id", fields, index=index))
    asked = q.select(F.explode(bm25.terms_of(F.col("text"))).alias("term"))
    read = bm25.in_shards(index["postings"], asked)
    assert "PartitionFilters: [shard" in read._jdf.queryExecution().toString()
    assert {r.term for r in read.select("term").distinct().collect()} < {r.term for r in index["postings"].select("term").distinct().collect()}
    assert index["postings"].where("term = ''").count() == 60


def test_views_and_family_totals(spark):
    m = spark.createDataFrame([("b", 2, 0.5), ("a", 1, 0.5), ("c", 0, 0.0), ("d", 3, 0.1)], "query_id string, relevant int, ndcg double")
    assert [r.query_id for r in views.worst(m, 2).collect()] == ["d", "a"]
    none = fam.family_totals(None, F.lit(1), spark).head()
    assert (none.available, none.families) == (False, None)
    f = spark.createDataFrame([("CATALOG_ONLY", "UNREVIEWED", 2), ("PLUS_STRUCTURE", "UNREVIEWED", 5)], "evidence string, review string, n_members long")
    r = fam.family_totals(f, F.lit(9).cast("bigint")).head()
    assert (r.families, r.member_records, r.files_total, r.by_evidence, r.by_review) == (2, 7, 9, {"CATALOG_ONLY": 1, "PLUS_STRUCTURE": 1}, {"UNREVIEWED": 2})
    empty = fam.family_totals(f.limit(0), F.lit(9).cast("bigint")).head()
    assert (empty.available, empty.families, empty.by_review) == (True, 0, {})


def test_types_and_screening(spark):
    cases = {"INTEGER": ["1", "-20"], "NUMBER": ["1.5", "2"], "DATE_LIKE": ["2024-01-02", "2024/1/2"], "BOOL_LIKE": ["Y", "예"], "STRING": ["a", "1"], "EMPTY": [" ", ""], None: []}
    for want, v in cases.items():
        df = spark.createDataFrame([(v,)], "v array<string>")
        assert df.select(observe.observe_type(F.col("v"))).head()[0] == want
    screen = lambda n, v: spark.createDataFrame([(n, v)], "n string, v array<string>").select(observe.screen(F.col("n"), F.col("v")).alias("s")).head().s
    assert screen("전화번호", [])["reason"] == "column-name:전화" and screen("대표자명", [])["status"] == "WITHHELD" and screen("시설명", ["강당"])["status"] == "CLEAR"
    assert screen("x", ["900101-1234567"])["reason"] == "value-pattern:rrn" and screen("x", ["901301-1234567"])["status"] == "CLEAR"
    assert screen("x", ["a@b.co"])["reason"] == "value-pattern:email" and screen("x", ["y" * 81])["reason"] == "free-text-heuristic"
    p = spark.createDataFrame([("['a', None, 3]",), ("[1,",), ("  ",), (None,), ("{}",), ("(1, 2)",), ("[None]",), ("[]",)], "s string").select(observe.parse_samples(F.col("s")).alias("p")).collect()
    assert [(r.p.ok, r.p["values"]) for r in p] == [(True, ["a", "None", "3"]), (False, None), (None, None), (None, None), (False, None), (False, None), (True, ["None"]), (True, [])]
    p_status = spark.createDataFrame([("전화번호", None, None), ("전화번호", False, None), ("전화번호", True, []), ("전화번호", True, ["1"]), ("시설명", True, ["강당"])], "n string, ok boolean, v array<string>")
    got = [tuple(r.s) for r in p_status.select(observe.assessed(F.col("n"), F.col("ok"), F.coalesce("v", F.array().cast("array<string>"))).alias("s")).collect()]
    assert got == [("NOT_ASSESSED", None), ("NOT_ASSESSED", "sample-parse-failed"), ("NOT_ASSESSED", None), ("WITHHELD", "column-name:전화"), ("CLEAR", None)]


def test_ingest_rejects_late_islands(spark):
    rows = [(1, "k", "f", "s", 1, "a", "['1']"), (2, "k", "f", "s", 2, "b", None), (3, "k2", "f", "s", 2, "x", "['1']"), (4, "k", "f", "s", 3, "late", "['1']"), (5, None, "f", "s", 1, "n", None)]
    p = spark.createDataFrame(rows, "row_no long, list_key string, file_name string, sheet string, ordinal int, name string, samples string")
    out = observe.ingest(p, spark.createDataFrame([("k", True)], "list_key string, open boolean"))
    assert {(r.list_key, r.status) for r in out["assets"].collect()} == {("k", "AVAILABLE"), ("k2", "COLLECTION_FAILED")}
    assert {(r.reason, r.n) for r in out["rejected"].collect()} == {("NO_KEY", 1), ("NON_CONTIGUOUS", 1)}
    assert {(r.name, r.example_status) for r in out["columns"].collect()} == {("a", "AVAILABLE"), ("b", "NOT_COLLECTED")}


def test_ingest_keeps_a_run_around_rejected_rows(spark):
    rows = [(2, "k", "f", "s", 1, "a", None), (3, None, "f", "s", 9, "bad", None), (4, "k", " ", "s", 9, "bad", None), (5, "k", "f", "s", 2, "b", None), (6, "j", "f", "s", 1, "x", None), (7, "k", "f", "s", 3, "late", None)]
    p = spark.createDataFrame(rows, "row_no long, list_key string, file_name string, sheet string, ordinal int, name string, samples string")
    out = observe.ingest(p, spark.createDataFrame([], "list_key string, open boolean"))
    assert {(r.list_key, r.status, r.n_columns) for r in out["assets"].collect()} == {("k", "AVAILABLE", 2), ("j", "AVAILABLE", 1)}
    assert {(r.reason, r.n) for r in out["rejected"].collect()} == {("NO_KEY", 1), ("NO_FILE", 1), ("NON_CONTIGUOUS", 1)}
    assert {(r.list_key, r.column_name) for r in observe.column_index(out).collect()} == {("k", "a"), ("k", "b"), ("j", "x")}
    numbers = spark.range(1, 1001).select(F.col("id").alias("n"))
    got = observe._numbered_without(numbers, "n", F.col("n") % 7 == 0, "g", 50).orderBy("n").collect()
    assert [r.g for r in got] == list(range(1, len(got) + 1))


def test_plan_rules(spark):
    df = spark.createDataFrame([("서울의 버스 정류장 위치를 분석하고 싶다",)], "p string")
    terms, region = plan.extract_terms(F.col("p"))
    assert tuple(df.select(terms, region).head()) == (["버스", "정류장", "위치"], "KR-11")
    cand = spark.createDataFrame([(1, "a", ["위도", "경도"]), (1, "b", ["위도", "경도", "주소"]), (1, "c", ["위도"])], "plan_id int, record_id string, columns array<string>")
    assert [(r.key, r.observed_in) for r in plan.join_keys(cand).collect()] == [("좌표(위도·경도)", ["a", "b"])]
    roles = cand.select("record_id", plan.assign_roles(F.lit("병원 현황"), F.col("columns"), F.lit(5)).alias("r")).collect()
    assert roles[0].r == ["SUPPLY", "SPATIAL"]
    rows = cand.withColumn("roles", plan.assign_roles(F.lit("x"), F.array().cast("array<string>"), F.lit(1))).withColumns({"spatial_listed": F.col("record_id") == "a", "temporal_listed": F.lit(False)})
    got = {r.role: r.status for r in plan.needs(rows, spark.createDataFrame([(1, "수요 분석")], "plan_id int, purpose string")).collect()}
    assert got == {"PRIMARY": "SATISFIED", "SPATIAL": "PARTIAL", "TEMPORAL": "UNSATISFIED", "DEMAND": "UNSATISFIED", "SUPPLY": "UNSATISFIED"}


def test_whole_plan(spark):
    s = "record_id string, list_key string, title string, org_name string, list_type string, list_url string, theme_top string, modified_date string, spatial_raw string, description string, keywords array<string>, regions array<struct<code:string,evidence:string>>, typical boolean, higher long, rows long"
    seoul = [("KR-11", "EXPLICIT_SPATIAL")]
    rows = [
        ("1", "k1", "버스 정류장 위치", "o", "FILE", "u", "교통", "2024-01-01", "서울", "d", ["버스"], seoul, True, 1, 10),
        ("2", "k2", "버스 이용객 현황", "o", "API", "u", "교통", None, None, "d", [], [], False, 1, 10),
        ("3", "k3", "버스 코드", "o", "STD", "u", "교통", None, None, "d", [], seoul, False, 0, 10),
    ]
    listings = spark.createDataFrame(rows, s)
    cols = spark.createDataFrame([("1", ["위도", "경도", "기준일"]), ("3", ["위도", "경도"])], "record_id string, columns array<string>")
    asked = [(1, "서울의 버스 수요를 분석하고 싶다", None), (2, "버스 수요", "KR-26"), (3, "x", None), (4, "버스 현황", "달나라"), (5, "고래 자료", "KR-11")]
    got = {r.plan_id: r for r in plan.build_plans(spark.createDataFrame(asked, "plan_id int, purpose string, region string"), listings, cols).collect()}
    one = got[1]
    assert (one.status, one.terms, one.region, one.region_source, one.searches) == ("DRAFT", ["버스", "수요"], "KR-11", "PURPOSE_TEXT", 1)
    assert {c.record_id for c in one.candidates} == {"1", "3"}
    first = next(c for c in one.candidates if c.record_id == "1")
    assert first.roles == ["PRIMARY", "SUPPLY", "SPATIAL", "TEMPORAL"] and first.signals.completeness == "TYPICAL" and first.signals.structure == "FILE_OBSERVATION"
    assert "title matches 버스" in first.reasons and first.limitations == ["NOT_ASSESSED", "SAMPLE_BASED_STRUCTURE"]
    assert {n.role: n.status for n in one.needs} == {"PRIMARY": "SATISFIED", "SPATIAL": "SATISFIED", "TEMPORAL": "SATISFIED", "DEMAND": "UNSATISFIED", "SUPPLY": "SATISFIED", "REFERENCE": "SATISFIED"}
    assert [k.key for k in one.join_keys] == ["좌표(위도·경도)"] and one.missing == ["DEMAND"] and one.next_checks[-1] == "SEARCH_MISSING_NEEDS_ANEW"
    assert (got[2].region, got[2].region_source, got[2].searches, len(got[2].candidates)) == ("KR-26", "PARAMETER", 2, 3)
    assert got[3].error and got[3].status is None and got[4].error == "unknown region: 달나라" and got[4].candidates is None
    assert (got[5].candidates, got[5].searches, {n.status for n in got[5].needs}) == (None, 2, {"UNSATISFIED"})


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([("q", 1, 5), ("q", 2, 6), ("q", 3, 7), ("e", 1, 1)], "query_id string, rank int, doc long")
    rel = spark.createDataFrame([("q", 5), ("q", 7), ("q", 9), ("none", 3)], "query_id string, doc long")
    m = {r.query_id: r for r in evaluate.rank_metrics(ranked, rel).collect()}
    assert m["q"].precision == 0.2 and abs(m["q"].recall - 2 / 3) < 1e-9 and abs(m["q"].ndcg - 1.5 / (1 + 0.6309297535714575 + 0.5)) < 1e-9
    mean = evaluate.mean_metrics(evaluate.rank_metrics(ranked, rel), spark.createDataFrame([("q",), ("e",), ("none",), ("zero",)], "query_id string")).head()
    assert (mean.queries, mean.judged, mean.zero_rate) == (4, 2, 0.5)


def test_compare(spark):
    m = spark.createDataFrame([(1, "a", ["x", "y"]), (1, "a", ["y", "x"]), (2, None, ["x"])], "group_id int, t string, f array<string>")
    got = {(r.group_id, r.field): r.shared for r in compare.compare(m, ["t", "f"]).collect()}
    assert got == {(1, "t"): True, (1, "f"): False, (2, "t"): True, (2, "f"): True}


def test_usage_streams(spark, tmp_path):
    from catalogspark.streaming import usage

    t0 = dt.datetime(2026, 1, 1)
    rows = [(t0 + dt.timedelta(seconds=10 * i), "/api/search", 200, 5, "1.1.1.1", "Mozilla/5.0", "q" * 300, False, False) for i in range(10)]
    rows += [(t0, "/api/x", 200, 1, "2.2.2.2", "Claude-User", "q", True, True), (t0, "/health", 200, 1, "2.2.2.2", None, None, None, None)]
    src = f"file://{tmp_path}/in"
    spark.createDataFrame(rows, usage.LOG).write.json(src)
    stream = spark.readStream.schema(usage.LOG).json(src)
    usage.append_log(stream, b"k", f"file://{tmp_path}/log", f"file://{tmp_path}/c1").awaitTermination(120)
    log = spark.read.json(f"file://{tmp_path}/log")
    assert usage.read_log(spark, f"file://{tmp_path}/log").where("day = date'2026-01-01' and ts is not null and length(anon) = 12").count() == 10
    assert log.count() == 10 and {len(r.q) for r in log.collect()} == {200} and {r.client for r in log.collect()} == {"other"}
    anon = usage.anonymized(stream, b"k")
    q = usage.hourly_quality(anon).writeStream.format("memory").queryName("hourly").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/c3").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.n for r in spark.table("hourly").collect()] == [10]
    kept = usage.retained(log.withColumn("day", F.to_date("day")), F.lit("2027-01-02").cast("date"))
    assert kept.count() == 0
