"""Log lines, thresholds, lookups and items."""

import datetime

from pyspark.sql import Row
from pyspark.sql import functions as F

from tiltmine.functions import items as I
from tiltmine.functions.discretize import with_speed
from tiltmine.operators import enrich
from tiltmine.sources import thresholds, weblog

LINE = '192.0.2.7 [Sunday, 14-Nov-2010 06:27:03 +0100] "?ets=css:203,tabs:110" 200 "http://example.test/a" "UA/1.0 (x; y)" "example.test"'


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_line(spark):
    r = weblog.parse(lines(spark, LINE)).first()
    assert (r.ip, r.ip_number, r.time_s, r.status, r.url, r.ua, r.domain) == ("192.0.2.7", 3221225991, 1289712423, 200, "http://example.test/a", "UA/1.0 (x; y)", "example.test")
    assert r.episodes == [Row(name="css", duration_ms=203), Row(name="tabs", duration_ms=110)]


def test_large_durations_and_half_hour_zones(spark):
    line = LINE.replace("css:203", "css:70000").replace("+0100", "+0530")
    r = weblog.parse(lines(spark, "prefix " + line + " suffix")).first()
    assert r.episodes[0].duration_ms == 70000 and r.time_s == 1289712423 + 3600 - 19800


def test_corrupt_lines_are_kept_aside(spark):
    df = lines(spark, LINE, "nonsense", None, "", LINE.replace("14-Nov-2010", "99-Xxx-2010"))
    assert weblog.parse(df).count() == 1 and weblog.corrupt(df).count() == 4


def test_text_files(spark, tmp_path):
    (tmp_path / "a.log").write_text(LINE + "\n" + LINE + "\n")
    assert weblog.parse(weblog.read(spark, str(tmp_path / "a.log"))).count() == 2
    got = []
    q = weblog.stream(spark, str(tmp_path)).writeStream.foreachBatch(lambda b, e: got.append(weblog.parse(b).count())).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(got) == 2


def test_addresses(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("256.1.1.1",), ("1.2.3",), (None,)], "a string")
    assert [r[0] for r in df.select(weblog.ipv4(F.col("a"))).collect()] == [16909060, None, None, None]


def test_thresholds(spark):
    t = thresholds.default(spark)
    assert t.count() == 75 and t.select("episode").distinct().count() == 25
    rows = spark.createDataFrame([("css", d) for d in (100, 101, 500, 501, 65535, 65536)] + [("unknown", 1), ("css", None)], "name string, duration_ms int")
    assert [r.speed for r in with_speed(rows, t).orderBy("name", F.col("duration_ms").asc_nulls_last()).collect()] == ["fast", "acceptable", "acceptable", "slow", "slow", None, None, None]


def test_ragged_thresholds(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,fast,10,slow\n\nb,only\nbroken\n")
    assert {(r.episode, r.speed, r.max_ms) for r in thresholds.read(spark, str(tmp_path / "t.csv")).collect()} == {("a", "fast", 10), ("a", "slow", 65535), ("b", "only", 65535)}


def dims(spark):
    ranges = spark.createDataFrame([(3221225984, 3221226239, "EU", "BE", "VLG", "Hasselt", "ISP1"), (0, 4294967295, "XX", None, None, None, None)], "lo long, hi long, continent string, country string, region string, city string, isp string")
    agents = spark.createDataFrame([("*", "any", None, None, None, None, False), ("UA/1.*", "Win", "UA", "1.0", 1, 0, True)], "pattern string, platform string, browser_name string, browser_version string, version_major int, version_minor int, is_mobile boolean")
    return ranges, agents


def test_transactions(spark):
    views = enrich.expand(weblog.parse(lines(spark, LINE, LINE.replace('" 200 "', '" 404 "').replace("192.0.2.7", "8.8.8.8").replace("UA/1.0", "Other"))), *dims(spark))
    assert not {"ip", "ua", "domain"} & set(views.columns)
    tx = I.to_transactions(views, lambda df: with_speed(df, thresholds.default(spark)))
    got = sorted(map(sorted, (r["items"] for r in tx.collect())), key=len)
    assert len(got) == 4
    known = next(t for t in got if "episode:css" in t and "ua:isMobile" in t)
    assert known == sorted(["episode:css", "duration:acceptable", "url:http://example.test/a", "location:EU", "location:EU:BE", "location:EU:BE:VLG", "isp:BE:ISP1", "ua:Win", "ua:Win:UA", "ua:Win:UA:1", "ua:Win:UA:1:0", "ua:isMobile"])
    other = next(t for t in got if "status:404" in t)
    assert "location:XX" in other and "ua:any" in other and not any(x.startswith("isp") for x in other)


def test_lookup_misses_are_null(spark):
    ranges, agents = dims(spark)
    views = weblog.parse(lines(spark, LINE.replace("192.0.2.7", "8.8.8.8")))
    assert enrich.locate(views, ranges.where("lo > 0")).first().location is None
    assert enrich.identify_agents(views, agents.where("pattern <> '*'").where("false")).first().agent is None


def test_episode_of(spark):
    df = spark.createDataFrame([(["duration:slow", "episode:css", "x:y"],), (["x:y"],)], "items array<string>")
    assert [tuple(r) for r in df.select(I.episode_of(F.col("items")), I.circumstances_of(F.col("items"))).collect()][0] == ("episode:css", ["duration:slow", "x:y"])


def test_hierarchy(spark):
    df = spark.createDataFrame([("location:EU:BE",), ("location:AS",), ("duration:slow",), ("url:http://x",), ("ua::b",)], "item string")
    tree = I.hierarchy(df)
    assert [(r.path, r.parent, r.label, r.depth) for r in tree.collect()] == [
        ("location", None, "location", 1), ("location:AS", "location", "AS", 2), ("location:EU", "location", "EU", 2), ("location:EU:BE", "location:EU", "BE", 3), ("ua", None, "ua", 1), ("ua:b", "ua", "b", 2)
    ]
    assert [r.path for r in I.complete(tree, "ua, LOCATION:e").collect()] == ["location:EU", "location:EU:BE"]


def test_log_time_is_the_same_in_any_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        assert weblog.parse(lines(spark, LINE)).first().time_s == 1289712423
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert datetime.datetime.fromtimestamp(1289712423, datetime.UTC).hour == 5
