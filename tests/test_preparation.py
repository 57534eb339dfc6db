import datetime as dt
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from leaseweave.__main__ import arguments, contract_day
from leaseweave.config import COLUMN_MAP, EngineConfig
from leaseweave.functions import scalars as S
from leaseweave.operators import cleaning, datasets, features, model, quality, serving
from leaseweave.plans import preprocess, train
from leaseweave.sources import raw, tables
from leaseweave.streaming import refresh

HEADER = ",".join(f'"{c}"' for c in COLUMN_MAP)


def line(no, day="05", deposit="21,525", name="케이하우스", ym="202112"):
    cells = [str(no), "서울특별시 서대문구 북가좌동", "295-9", "0295", "0009", name, "전세", "59.9300", ym, day, deposit, "0", "-1", "2014", "증가로23길 46", "202112~202312", "신규", "-", "", "", "연립다세대"]
    return ",".join(f'"{c}"' for c in cells)


def write_csv(path, rows, preamble=3, encoding="cp949"):
    above = ["시군구 : 서울특별시 서대문구", "실거래구분 : 전월세"][: max(0, preamble)] + ["안내"] * max(0, preamble - 2)
    path.write_bytes("\n".join([*above, HEADER, *rows]).encode(encoding))


@pytest.mark.parametrize("preamble", [0, 3, 15, 22])
def test_header_is_found_below_any_preamble(tmp_path, preamble):
    write_csv(tmp_path / "a.csv", [line(1)], preamble)
    (facts, rows), = raw.tables_of(str(tmp_path / "a.csv"), (tmp_path / "a.csv").read_bytes())
    assert facts["header_line_index"] == preamble and rows[0]["본번"] == "0295" and facts["encoding"] == "cp949"


def test_a_file_without_header_is_reported(tmp_path):
    (facts, rows), = raw.tables_of("x.csv", b"a,b\n1,2\n")
    assert not facts["ok"] and not rows and "header" in facts["error"]


def workbook(path, sheets):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            body = "".join("<row>" + "".join(f'<c r="{chr(65 + c)}{n + 1}"' + (f"><v>{v}</v></c>" if isinstance(v, float) else f' t="inlineStr"><is><t>{v}</t></is></c>') for c, v in enumerate(r)) + "</row>" for n, r in enumerate(rows))
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def test_workbook_sheets(tmp_path):
    row = [c.strip('"') for c in line(1).replace('"21,525"', '"5000"').split(",")]
    bare = [1.0, *row[1:]]
    workbook(tmp_path / "b.xlsx", {"one": [list(COLUMN_MAP), row, list(COLUMN_MAP), row], "two": [bare], "bad": [["x", "y"]]})
    got = list(raw.tables_of("b.xlsx", (tmp_path / "b.xlsx").read_bytes()))
    assert [f["ok"] for f, _ in got] == [True, True, False]
    assert len(got[0][1]) == 2 and got[0][0]["n_repeated_header_rows"] == 1
    assert got[1][0]["header_inferred"] and got[1][1][0]["NO"] == "1"


def test_whole_preparation(spark, tmp_path):
    source = tmp_path / "raw"
    source.mkdir()
    days = [f"{d:02d}" for d in range(1, 21)]
    write_csv(source / "a.csv", [line(i, d, "5,000") for i, d in enumerate(days)] + [line(99, "20", "5,000")])
    write_csv(source / "b.csv", [line(i, d, "5,000") for i, d in enumerate(days[:5])] + [line(7, "31", "1", ym="202102"), line(8, "01", "-")], 0, "utf-8")
    (source / "~$a.csv").write_text("lock")
    (source / "bad.csv").write_text("x")
    out = preprocess.run(spark, str(source), str(tmp_path / "out"), recheck=20)
    assert (out["rows"], out["mismatches"]) == (22, 0)
    assert "tables 3 (not readable: 1)" in out["text"] and "Contracts 22" in out["text"] and "Model table monthly" in out["text"]
    df = spark.read.parquet(str(tmp_path / "out" / "all_transactions"))
    rows = df.orderBy("tx_id").collect()
    assert [r["tx_id"] for r in rows] == list(range(22)) and [r["contract_date"] for r in rows] == sorted(r["contract_date"] for r in rows)
    last = rows[-1]
    assert last["dong_tx_count_90d"] == 19 and last["property_last_price"] == 5000.0 and last["lease_duration_months"] == 24.0
    assert {r["is_duplicate_candidate"] for r in rows if r["contract_date"].day == 20} == {1}
    assert spark.read.parquet(str(tmp_path / "out" / "model_jeonse")).count() == 21
    assert spark.read.csv(str(tmp_path / "out" / "input_files"), header=True).where("ok = 'false'").count() == 1


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_parsing(spark):
    one = lambda xs, f, kind="string": values(spark, [(x,) for x in xs], f"c {kind}", f(F.col("c")))
    assert one(["21,525", "-", "1d", "inf", "", None, "-1", ".5"], S.parse_number) == [21525.0, None, None, None, None, None, -1.0, 0.5]
    assert one(["\t 0295　", "-", " ", "nan", "㎡", None], lambda c: S.missing_to_null(S.nfkc(c))) == ["0295", None, None, None, "m2", None]
    assert one([14.99, 15.0, 20.0, 85.0, 1000.0, -1.0, None], S.area_bin, "double") == ["0-15", "15-20", "20-25", "85+", "85+", None, None]
    assert one(["(461-0)", "(461)", "(461-0)x", None], S.is_address_name) == [1, 1, 0, 0]
    assert one(["202201~202401", "202201 ~ 202203", "202401~202201", "abc", "202213~202301", None], lambda c: S.months_between_firsts(S.period_month(c, 1), S.period_month(c, 2))) == [24.0, 2.0, -24.0, None, None, None]
    days = values(spark, [("202402", "29"), ("202302", "29"), ("202413", "1"), (None, "1"), ("202403", "7")], "a string, b string", S.parse_day(F.col("a"), F.col("b")))
    assert days == [dt.date(2024, 2, 29), None, None, None, dt.date(2024, 3, 7)]
    assert one([25136.0, 20000.0, 9999.5, 30.0], S.won, "double") == ["2억 5,136만원", "2억원", "1억원", "30만원"]


def test_copies_are_kept_as_often_as_in_the_fullest_table(spark):
    rows = [(0, i, "k", None) for i in range(2)] + [(1, 0, "k", None)] + [(2, i, "k", None) for i in range(3)] + [(0, 9, "z", "v")]
    df = spark.createDataFrame(rows, "t int, _seq int, a string, b string")
    kept = cleaning.remove_duplicates(df, ["a", "b"], "t", ["_seq"], candidates=["a"])
    assert sorted((r["a"], r["is_duplicate_candidate"]) for r in kept.collect()) == [("k", 1)] * 3 + [("z", 0)]
    assert cleaning.within_table_copies(df, ["a", "b"], "t").first()[0] == 3


def test_dense_ids(spark):
    df = spark.createDataFrame([(i, (i * 7919) % 500) for i in range(500)], "k int, v int")
    rows = cleaning.with_dense_id(df, ["v", "k"], "n", ranges=7).orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(500)) and [r["v"] for r in rows] == sorted(r["v"] for r in rows)


def test_features_that_leak_are_refused(spark):
    for kind in datasets.KINDS:
        assert not set(datasets.model_features(kind)) & datasets.FORBIDDEN_BY_KIND[kind]
        assert datasets.KINDS[kind][1] not in datasets.horizon_features(kind)
    with pytest.raises(ValueError):
        datasets.model_dataset(spark.range(1), "jeonse", features=["price_10k"])


def test_outliers_fall_back_where_a_group_is_small(spark):
    rows = [("g", "f", 100.0 + i % 3) for i in range(30)] + [("g", "f", 1e6)] + [("g", "h", 101.0)] * 5 + [("g", "h", None), ("g", "h", 1e7)]
    df = spark.createDataFrame(rows, "g string, f string, v double")
    flags = quality.with_outlier_flag(df, F.col("v"), ("g", "f"), ("g",), "o", 3.0, 30).select("v", "o").collect()
    assert sorted(r["v"] for r in flags if r["o"]) == [1e6, 1e7]


def test_nearest_place_ties_and_nulls(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0)], "id int, lat double, lon double")
    places = spark.createDataFrame([(0, "east", 0.0, 0.01), (1, "west", 0.0, -0.01)], "idx int, name string, lat double, lon double")
    out = {r["id"]: r for r in features.nearest_place(points, places, "id", "name", 2000).collect()}
    assert out[1]["nearest_place"] == "east" and out[1]["n_within"] == 2 and out[1]["dist_m"] == 1112.0
    assert out[2]["dist_m"] is None


def test_nearest_place_of_scattered_points_equals_a_plain_loop(spark):
    r = random.Random(3)
    points = [(i, r.choice((37.5, 0.0, -60.0, 80.0)) + r.uniform(-0.3, 0.3), r.choice((127.0, 179.95, -179.95, 0.0)) + r.uniform(-0.04, 0.04)) for i in range(150)] + [(900, None, 1.0), (901, 37.5, 127.0), (901, 37.5, 127.0)]
    places = [(i, f"p{i % 40}", r.choice((37.5, 0.0, 80.0)) + r.uniform(-0.3, 0.3), r.choice((127.0, 179.95, -179.95)) + r.uniform(-0.04, 0.04)) for i in range(80)] + [(99, "none", None, None)]
    p = spark.createDataFrame(points, "id int, lat double, lon double")
    got = features.nearest_place(p, spark.createDataFrame(places, "idx int, name string, lat double, lon double"), "id", "name", 5000).collect()
    assert len(got) == len(points)

    def metres(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 6371000 * math.asin(math.sqrt(min(1, math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    where = {i: (lat, lon) for i, lat, lon in points}
    for row in got:
        lat, lon = where[row["id"]]
        if lat is None:
            assert row["dist_m"] is None
            continue
        all_ = sorted((metres(lat, lon, a, b), i, n) for i, n, a, b in places if a is not None)
        assert row["nearest_place"] == all_[0][2] and abs(row["dist_m"] - all_[0][0]) <= 0.51 and row["n_within"] == sum(d <= 5000 for d, _, _ in all_)


def test_conformal_and_rollup(spark):
    rows = [(h, 100.0, 90.0, 100.0, 110.0 if i else 95.0) for h, n in ((0, 1), (30, 10)) for i in range(n)]
    df = spark.createDataFrame(rows, "horizon_days int, target double, m_lo double, m_mid double, m_hi double")
    adj = {r["horizon_days"]: r for r in model.conformal_adjustment(df, "m").collect()}
    assert adj[0]["n"] == 1 and adj[30]["adjustment"] < 0.06
    out = {r["horizon_days"]: r for r in model.metrics_rollup(df, "m").collect()}
    assert out[None]["n"] == 11 and out[0]["coverage_80"] == 0.0


def test_quantile_forest_ranges(spark):
    rows = [(i, "a" if i % 2 else "b", float(i % 2) + (i % 10) / 10) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, k string, _y double")
    out = model.QuantileForest(["k"], trees=4, depth=2).fit(df).predict(df).collect()
    for r in out:
        base = 1.0 if r["k"] == "a" else 0.0
        assert base <= r["q_lo"] <= r["q_mid"] <= r["q_hi"] <= base + 0.91


def test_training_saves_a_model_that_serves(spark, tmp_path):
    r = random.Random(4)
    rows = []
    for i in range(900):
        day = dt.date(2021, 1, 1) + dt.timedelta(r.randrange(2000))
        deposit = 5000.0 + 10 * (i % 40) + r.random() * 300
        rows.append((i, day, "동작구", "흑석동", r.choice(("전세", "월세")), "연립다세대", "다세대", f"p{i % 30}", deposit, 50.0 + i % 9, "new", 20.0 + i % 4, float(i % 5), 2000.0, 0, f"b{i % 30}", "r", 37.5 + (i % 30) * 1e-4, 126.95, 100.0, 1, 50.0))
    schema = "tx_id long, contract_date date, gu string, dong string, rent_type string, housing_category string, housing_type string, property_id string, deposit_10k double, monthly_rent_10k double, contract_type_clean string, area_m2 double, floor double, built_year double, building_name_is_address int, building_name string, full_road_address string, lat double, lon double, station_dist_m double, n_stations_1km int, univ_dist_m double"
    df = spark.createDataFrame(rows, schema).withColumn("area_bin", S.area_bin(F.col("area_m2")))
    df = features.add_floor_features(features.add_date_features(df)).withColumns({"price_10k": S.price(F.col("rent_type"), F.col("deposit_10k"), F.col("monthly_rent_10k")), "building_age": F.lit(20), "deposit_per_m2": F.col("deposit_10k") / F.col("area_m2")})
    cfg = EngineConfig(horizons=(0, 60))
    out = train.run(spark, df, str(tmp_path), cfg, rounds=4, depth=3, min_rows=20, rate=0.3)
    assert set(out) == {"jeonse", "monthly"} and out["jeonse"]["model"]["by_horizon"].count() == 3
    loaded = train.load(spark, f"{tmp_path}/monthly_model")
    assert loaded["kind"] == "monthly" and spark.read.parquet(f"{tmp_path}/monthly_model/levels").where("feature = 'gu' AND level = 0").first()["value"] == "동작구"
    p = serving.predict(df, {"school_name": "중앙대학교", "lat": 37.5, "lon": 126.95}, "월세", dt.date(2026, 6, 1), dt.date(2026, 7, 25), train.price_rows(loaded), listing_price=60.0, cfg=cfg)
    assert 45 < p.range_low <= p.expected <= p.range_high < 65 and p.horizon_days == 54 and p.deposit_10k
    text = serving.formatted(p)
    assert "중앙대학교" in text and p.price_check["verdict"] in text and len(text.splitlines()) == 6 + len(p.examples)


def test_command_line():
    a = arguments(["prepare", "in", "out", "--include-unknown", "--exclude-gu", "노원구"])
    assert a.todo == "prepare" and a.include_unknown and a.exclude_gu == ["노원구"]
    a = arguments(["predict", "tx", "schools", "models", "중앙대", "--date", "2026-09-01", "--rent-type", "월세"])
    assert a.date == dt.date(2026, 9, 1) and a.rent_type == "월세" and a.asof is None
    a = arguments(["predict", "tx", "schools", "models", "이대", "--months", "6", "--housing", "오피스텔", "--json"])
    assert a.housing == "오피스텔" and a.json and contract_day(dt.date(2026, 8, 31), a.date, a.months) == dt.date(2027, 2, 28)
    assert contract_day(dt.date(2026, 8, 31), None, None) == dt.date(2026, 8, 31) and contract_day(dt.date(2026, 8, 31), dt.date(2026, 9, 9), None) == dt.date(2026, 9, 9)
    for wrong in (["nothing"], ["predict", "tx", "schools", "models", "이대", "--months", "7"]):
        with pytest.raises(SystemExit):
            arguments(wrong)


def test_mixture(spark):
    df = spark.createDataFrame([(80.0, 100.0, 130.0, 1)], "lo double, mid double, hi double, weight long")
    q = serving.mixture_quantiles(df)
    assert [round(x, 1) for x in q] == [80.0, 100.0, 130.0]
    assert serving.verdict(24.9) == "저렴" and serving.verdict(75) == "적정" and serving.verdict(91) == "비쌈"


def test_serving_query(spark):
    days = [dt.date(2026, 1, 1) + dt.timedelta(i) for i in range(200)]
    rows = [(i, d, "동작구", "흑석동", "전세", "연립다세대", "다세대", f"p{i % 40}", 100.0 + i % 7, 100.0 + i % 7, None, "new", 20.0 + i % 4, float(i % 5), 2000.0, 0, f"b{i % 40}", "r", 37.5 + (i % 40) * 1e-4, 126.95, 100.0, 1, 50.0) for i, d in enumerate(days)]
    schema = "tx_id long, contract_date date, gu string, dong string, rent_type string, housing_category string, housing_type string, property_id string, price_10k double, deposit_10k double, monthly_rent_10k double, contract_type_clean string, area_m2 double, floor double, built_year double, building_name_is_address int, building_name string, full_road_address string, lat double, lon double, station_dist_m double, n_stations_1km int, univ_dist_m double"
    h = spark.createDataFrame(rows, schema).withColumn("area_bin", S.area_bin(F.col("area_m2")))
    schools = spark.createDataFrame([(0, "중앙대학교 서울캠퍼스", "중앙대학교", 37.5, 126.95)], "idx int, school_name string, query string, lat double, lon double")
    school = serving.find_school(schools, "중 대", {"중대": "중앙대학교"})
    level = F.coalesce("dong_price_median_90d", F.lit(100.0))
    p = serving.predict(h, school, "전세", dt.date(2026, 7, 20), dt.date(2026, 9, 20), lambda rows, horizon: rows.select((level * 0.9).alias("lo"), level.alias("mid"), (level * 1.1).alias("hi"), "weight"), "원룸", listing_price=104.0)
    assert serving.find_school(schools, "중대")["idx"] == 0  # a short name
    seen = []
    serving.predict(h, school, "전세", dt.date(2026, 7, 20), dt.date(2027, 2, 20), lambda rows, horizon: (seen.append(rows.select("horizon_days", "nearest_horizon").first()), rows.select((level * 0.9).alias("lo"), level.alias("mid"), (level * 1.1).alias("hi"), "weight"))[1], "원룸")
    assert [tuple(r) for r in seen] == [(180, 180), (0, 0)]  # 215 days ahead
    assert p.radius_m == 1000 and p.n_buildings == 40 and p.range_low < p.expected < p.range_high and p.price_check["verdict"] == "적정" and len(p.examples) == 5
    with pytest.raises(ValueError):
        serving.find_school(schools, "없는학교")


def test_geocode_and_grid(spark):
    a = spark.createDataFrame([("a", "ra", "la"), ("b", "rb", "lb"), ("c", "rc", "lc"), ("d", "rd", "ld")], "address string, road_address string, location string")
    known = spark.createDataFrame([("a", 1.0, 1.0), ("rb", 2.0, 2.0), ("lc", 3.0, 3.0)], "key string, lat double, lon double")
    assert [(r["address"], r["precision"]) for r in tables.geocode(a, known).orderBy("address").collect()] == [("a", "jibun"), ("b", "road"), ("c", "dong"), ("d", "failed")]
    assert tables.grid_centres(spark, 37.0, 37.1, 127.0, 127.1).count() == 48


def test_refresh_rewrites_touched_districts(spark, tmp_path):
    schema = "tx_id long, contract_date date, gu string, dong string, rent_type string, housing_category string, area_bin string, property_id string, price_10k double, deposit_10k double"
    part = lambda ids, gu: spark.createDataFrame([(i, dt.date(2024, 1, 1 + i), gu, "d", "r", "c", "b", "p", 10.0 * i, 1.0) for i in ids], schema)
    part(range(1, 6), "x").write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: refresh.refresh(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "h"), str(tmp_path / "f"), str(tmp_path / "c")).awaitTermination()
    run()
    part(range(6, 9), "x").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    out = {r["tx_id"]: r["dong_tx_count_90d"] for r in spark.read.parquet(str(tmp_path / "f")).collect()}
    assert out == {i: i - 1 for i in range(1, 9)}
