import csv
import json

import pytest
from pyspark.sql import functions as F

from catalogspark.functions import vocabulary as V
from catalogspark.functions.text import coded, empty_to_null, hmac_sha256, norm_title, safe_int, split_first, title_tokens, tokens, ttrim
from catalogspark.operators import quality
from catalogspark.operators.diff import feed_summary
from catalogspark.operators.regions import match_gazetteer


def one(spark, *cols, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).head()


def test_text_rules(spark):
    c = F.col("v")
    r = one(spark, tokens(c, "[+,/]", upper=True), v="JSON+XML/ csv,json")
    assert r[0] == ["JSON", "XML", "CSV"]
    assert one(spark, tokens(c, ","), v="a,b, a ,c")[0] == ["a", "b", "c"]
    assert one(spark, tokens(c, ","), v="-")[0] == []
    for value, want in (("1,234", 1234), ("abc", None), ("-", None), (" 9999 ", 9999), (None, None), ("-1", -1)):
        assert one(spark, safe_int(c), v=value)[0] == want if value is not None else True
    assert one(spark, ttrim(c), v="\t　x y\n")[0] == "x y"
    assert [one(spark, empty_to_null(c), v=v)[0] for v in ("", " - ", "null", "없음", "x")] == [None, None, None, None, "x"]
    top, sub = split_first(c)
    assert tuple(one(spark, top, sub, v="교통 - 버스 - 노선")) == ("교통", "버스 - 노선")
    assert tuple(one(spark, top, sub, v="교통")) == ("교통", None)
    assert [one(spark, coded(c, V.CYCLES), v=v)[0] for v in ("연간", "-", "", "몰라")] == ["ANNUAL", "UNSPECIFIED", "UNSPECIFIED", "OTHER"]
    assert one(spark, norm_title(c), v="강남구_버스(2024)_현황_2023년")[0] == "강남구버스현황"
    assert one(spark, title_tokens(c), v="a_b c·d-e")[0] == ["a", "b", "c", "d", "e"]


def test_hmac_equals_the_library(spark):
    import hashlib
    import hmac

    for key in (b"k", b"x" * 100):
        assert one(spark, hmac_sha256(key, F.col("v")), v="10.0.0.1")[0] == hmac.new(key, b"10.0.0.1", hashlib.sha256).hexdigest()


def test_regions(spark):
    ev = {e: (F.col(x), V.EVIDENCE[e]) for e, x in zip(V.EVIDENCE, ("s", "t", "o", "d"), strict=True)}
    got = one(spark, match_gazetteer(ev), s="-", t="서울 버스", o="광주시", d="서울시와 부산")[0]
    assert [(r.code, r.evidence, r.confidence) for r in got] == [("KR-11", "INFERRED_FROM_TITLE", 0.8), ("KR-29", "INFERRED_FROM_PUBLISHER", 0.3), ("KR-26", "INFERRED_FROM_DESCRIPTION", 0.5)]


def test_freshness(spark):
    ref = F.lit("2026-07-01").cast("date")
    cases = [("DAILY", "2026-06-24", "FRESH"), ("DAILY", "2026-06-23", "POSSIBLY_STALE"), ("ANNUAL", "2027-01-01", "FRESH"), ("OTHER", "2026-06-30", "UNKNOWN"), ("DAILY", None, "UNKNOWN")]
    for cycle, date, want in cases:
        assert one(spark, quality.freshness(F.lit(cycle), F.lit(date).try_cast("date"), ref))[0] == want


def test_indices_by_hand(spark):
    df = spark.createDataFrame([(1, "K", 9999), (2, "K", -1), (3, "3", 5), (4, "4", 7)], "record_id int, list_key string, row_count long")
    r = quality.quality_indices(df, "list_key", ["row_count"]).head()
    assert (r.d5_03, r.d6_01, r.level) == (0.5, 0.75, "DM-0")
    assert quality.quality_indices(df.limit(0), "list_key", ["row_count"]).head().level == "SCHEMA_ONLY"


def test_systemic_collapse(spark):
    df = spark.createDataFrame([(str(i), "T", "f", "v", 0.9) for i in range(6)] + [("1", "U", "f", "v", 0.9)], "record_id string, issue_type string, field string, source_value string, confidence double")
    got = quality.collapse_systemic(df, 10).collect()
    assert sorted((r.record_id, r.issue_type) for r in got) == [("1", "U"), ("@catalog", "T")]
    assert quality.collapse_systemic(df, 13).count() == 7


HEADER = list(V.SNAPSHOT_COLUMNS)


def snapshot_rows(n, drop=(), touch=()):
    rows = []
    for i in range(n):
        if i in drop:
            continue
        r = dict.fromkeys(HEADER, "-")
        r |= {"목록키": f"{10000000 + i}", "목록유형": "FILE", "목록명": f"구{i % 5}_버스 현황_{2000 + i}", "분류체계": "교통 - 버스", "제공기관": "서울특별시", "업데이트 주기": "연간", "전체행": "1,234", "확장자(데이터포맷)": "CSV+JSON", "키워드": 'a,b"c', "설명": "두 줄\n설명", "이용허락범위": "공공저작물_출처표시", "목록 URL": "https://x.example/1", "수정일": "2026-01-02" if i not in touch else "2026-05-05", "국가중점여부": "N", "표준데이터여부": "Y"}
        rows.append(r)
    rows.append(rows[0] | {"목록키": "99", "목록유형": "FILE"})
    rows.append(rows[0] | {"목록키": "99", "목록유형": "API", "신청가능 트래픽": "1000"})
    rows.append(rows[0] | {"목록키": "77", "전체행": "9999", "관리부서 전화번호": "`02-1", "목록 URL": "ftp.example"})
    return rows


def write_csv(path, rows, encoding="utf-8-sig"):
    with open(path, "w", encoding=encoding, newline="") as f:
        w = csv.DictWriter(f, HEADER)
        w.writeheader()
        w.writerows(rows)
    return f"file://{path}"


def test_build(spark, tmp_path):
    from catalogspark.plans.build import GateError, build
    from catalogspark.sources.export import published, read_published

    out = f"file://{tmp_path}/release"
    t = build(spark, write_csv(tmp_path / "a.csv", snapshot_rows(12)), "2026-06", out)
    rows = {r.record_id: r for r in t["listings"].collect()}
    assert len(rows) == 15 and {"99-FILE", "99-API", "77"} <= set(rows)
    r = rows["10000003"]
    assert (r.formats, r.row_count, r.update_cycle, r.license_code, r.description, r.theme_sub) == (["CSV", "JSON"], 1234, "ANNUAL", "KOGL_BY", "두 줄\n설명", "버스")
    assert r.source_row_no == 5 and '"목록키":"10000003"' in r.source_json and r.profile == "FILE"
    kinds = {(x.record_id, x.issue_type) for x in t["issues"].collect()}
    assert {("77", "LEADING_QUOTE_ARTIFACT"), ("77", "INVALID_URL_FORMAT"), ("99-API", "DUPLICATE_LIST_KEY"), ("99-FILE", "DUPLICATE_LIST_KEY")} <= kinds
    assert {r["file"]: r["lines"] for r in t["manifest"].collect()}["datasets"] == 15
    assert t["families"].count() >= 1
    t2 = build(spark, write_csv(tmp_path / "b.csv", snapshot_rows(12, drop={4}, touch={5})), "2026-07", out, previous="2026-06")
    assert {(x.record_id, x.status) for x in t2["changes"].collect()} == {("10000004", "MISSING_FROM_SNAPSHOT"), ("10000005", "MODIFIED")}
    assert read_published(spark, out, "listings", "2026-06").count() == 15
    # a record that was missing comes back, and a rebuild keeps the feed and replaces the release
    t3 = build(spark, write_csv(tmp_path / "d.csv", snapshot_rows(12, drop={6}, touch={5})), "2026-08", out, previous="2026-07")
    feed = {x.record_id: x for x in t3["changes"].collect()}
    assert {k: x.status for k, x in feed.items()} == {"10000004": "REAPPEARED", "10000006": "MISSING_FROM_SNAPSHOT"}
    assert feed["10000006"].title.startswith("구1_버스") and feed["10000006"].base_snapshot == "2026-07"
    folder = published(spark, out).where("snapshot = '2026-08'").head().folder
    build(spark, write_csv(tmp_path / "d.csv", snapshot_rows(12, drop={6}, touch={5})), "2026-08", out, previous="2026-08")
    assert published(spark, out).where("snapshot = '2026-08'").head().folder != folder
    assert {x.record_id: x.status for x in read_published(spark, out, "changes", "2026-08").collect()} == {"10000004": "REAPPEARED", "10000006": "MISSING_FROM_SNAPSHOT"}
    s = feed_summary(read_published(spark, out, "changes", "2026-08"), spark).head()
    assert (s.base_snapshot, s.summary, s.base_unavailable) == ("2026-07", {"MISSING_FROM_SNAPSHOT": 1, "REAPPEARED": 1}, None)
    assert feed_summary(None, spark).head().base_unavailable == "FIRST_SNAPSHOT_OR_DIFF_NOT_GENERATED"
    doc = json.loads(spark.read.text(f"{folder}/bulk/datasets").orderBy(F.desc("value")).head().value)
    assert doc["kdp:qualityTier"] is None and doc["publisher"]["foaf:name"] == "서울특별시" and doc["accrualPeriodicity"][1]["@id"].endswith("/ANNUAL")
    assert json.loads(spark.read.text(f"{folder}/catalog").head().value)["kdp:datasetCount"] == 14
    bad = snapshot_rows(3)
    bad[0]["목록유형"] = "ODD"
    with pytest.raises(GateError):
        build(spark, write_csv(tmp_path / "c.csv", bad), "2026-09", out)
    assert read_published(spark, out, "listings", "2026-09") is None


def test_side_inputs(spark, tmp_path):
    from catalogspark.sources import catalog as src

    path = lambda n: f"file://{tmp_path}/{n}"
    header = [*src.V.PROFILE_COLUMNS, "else"]
    with open(tmp_path / "p.csv", "w", encoding="utf-8-sig", newline="") as f:
        w = csv.DictWriter(f, header)
        w.writeheader()
        w.writerow(dict.fromkeys(header, "x") | {"dataID": "k", "열순번": " 3 ", "컬럼명_샘플": "['a,\n']"})
        w.writerow(dict.fromkeys(header, "x") | {"열순번": "no"})
    rows = src.read_profile(spark, path("p.csv")).orderBy("row_no").collect()
    assert [(r.row_no, r.list_key, r.ordinal, r.samples) for r in rows] == [(2, "k", 3, "['a,\n']"), (3, "x", None, "x")]
    (tmp_path / "sheet.csv").write_text("family_id,note,verdict (a/b)\nfam-1,n,CONFIRMED_FAMILY\nfam-2,n,\n")
    assert [tuple(r) for r in src.read_review_sheet(spark, path("sheet.csv")).collect()] == [("fam-1", "CONFIRMED_FAMILY"), ("fam-2", None)]
    (tmp_path / "w.json").write_text('{"recordIds": ["a", "b"]}')
    assert [r.record_id for r in src.read_withdrawn(spark, path("w.json")).collect()] == ["a", "b"]
    (tmp_path / "r.json").write_text('{"families": {"fam-1": {"reviewStatus": "NOT_A_FAMILY", "note": ""}}}')
    assert [tuple(r) for r in src.read_reviews(spark, path("r.json")).collect()] == [("fam-1", "NOT_A_FAMILY")]
    (tmp_path / "golden.json").write_text('{"queries": [{"id": "G1", "pattern": "a"}, {"id": "G2", "pattern": "b"}]}')
    assert [r.id for r in src.read_golden(spark, path("golden.json")).collect()] == ["G1", "G2"]
    for n in ("case-b.json", "case-a.json", "other.json"):
        (tmp_path / n).write_text('{"caseId": "%s"}' % n)
    assert [r.file for r in src.read_cases(spark, path("")).collect()] == ["case-a.json", "case-b.json"]
    lacking = [c for c in HEADER if c != "목록명"]
    (tmp_path / "l.csv").write_text(",".join(lacking) + "\n" + ",".join("x" for _ in lacking) + "\n")
    with pytest.raises(src.SourceError, match="목록명"):
        src.read_snapshot(spark, path("l.csv"))
    blank = write_csv(tmp_path / "k.csv", [r | {"목록키": " "} for r in snapshot_rows(1)])
    with pytest.raises(src.SourceError, match="without a key"):
        src.read_snapshot(spark, blank)
    stored = src.manifest(spark, path("w.json"))
    assert src.changed_files(stored, stored).isEmpty() and not src.changed_files(stored.withColumn("sha256", F.lit("0")), stored).isEmpty()
    with pytest.raises(Exception, match="no discoverability"):
        quality.discoverability(spark.createDataFrame([], "list_key string, title string, description string, org_name string, license_code string, keywords array<string>, modified_date string, created_date string, list_url string")).collect()


def test_encodings(spark, tmp_path):
    from catalogspark.sources import catalog as src

    write_csv(tmp_path / "u.csv", snapshot_rows(2))
    cp = write_csv(tmp_path / "k.csv", snapshot_rows(2), "cp949")
    (tmp_path / "bad.csv").write_bytes(b"\xff\xfe\x00\xd8ok")
    got = {r.path.rsplit("/", 1)[1]: r.encoding for r in src.detect_encodings(spark, f"file://{tmp_path}/*.csv").collect()}
    assert got == {"u.csv": "UTF-8", "k.csv": "CP949", "bad.csv": None}
    assert src.read_snapshot(spark, cp, "CP949").select("`목록유형`").distinct().count() == 2
    m = src.manifest(spark, f"file://{tmp_path}/u.csv").head()
    assert m.bytes == (tmp_path / "u.csv").stat().st_size and m.lines > 5
    assert src.read_withdrawn(spark, f"file://{tmp_path}/none.json").count() == 0
    with pytest.raises(src.SourceError):
        src.read_snapshot(spark, cp, "CP949", min_rows=100)
