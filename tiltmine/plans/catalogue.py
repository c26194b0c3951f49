"""Query catalogue: key -> (spark, sf_dir) -> DataFrame, and the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltmine.functions import items as I
from tiltmine.functions import tilted
from tiltmine.operators import enrich, mining, rules, windows
from tiltmine.operators.constraints import Constraints, Kind, defaults
from tiltmine.options import Options, epsilon_of, margin_of
from tiltmine.plans import ingest, report
from tiltmine.plans.analyst import Analyst, statistics, why_slow
from tiltmine.plans.events import ingested, speeds, table, transactions, views
from tiltmine.sources import thresholds, weblog
from tiltmine.storage import fresh_folder, store
from tiltmine.streaming import state as streaming

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---- shared SQL

_EV = """
ev as (
  select e.event_id, epoch_us(e.ts) // 1000000 as time_s, epoch_us(e.ts) // 900000000 as quarter, e.event_type,
    cast(floor(e.value) as int) as duration_ms,
    case when floor(e.value) <= t.fast then 'fast' when floor(e.value) <= t.acceptable then 'acceptable' when floor(e.value) <= 65535 then 'slow' end as speed,
    r.r_name as region, n.n_name as nation, c.c_mktsegment as segment, cast(json_extract(e.props, '$.k') as int) as k
  from events e
  left join (values ('click', 15, 70), ('view', 20, 80), ('purchase', 15, 60), ('signup', 10, 50), ('error', 25, 100)) t(name, fast, acceptable) on t.name = e.event_type
  left join customer c on c.c_custkey = e.user_id
  left join nation n on n.n_nationkey = c.c_nationkey
  left join region r on r.r_regionkey = n.n_regionkey
), tx as (
  select *, list_sort(list_filter([
    'episode:' || event_type, 'duration:' || speed, 'segment:' || segment, case when k <> 0 then 'status:' || cast(k // 25 as varchar) end,
    'location:' || region, 'location:' || region || ':' || nation], lambda x: x is not null)) as items
  from ev
), it as (select event_id, quarter, unnest(items) as item from tx)"""
_BATCH = """, q as (select quarter, row_number() over (order by quarter) - 1 as batch_id from (select distinct quarter from ev)),
n as (select max(batch_id) + 1 as n from q),
tb as (
  select j as batch_id, quarter, case
    when j >= 4 * h0 then n - 1 - j when j // 4 >= 24 * d0 then 4 + h0 - 1 - j // 4 when j // 96 >= 31 * m0 then 28 + d0 - 1 - j // 96
    when j // 2976 >= 12 * y0 then 59 + m0 - 1 - j // 2976 when j // 35712 = y0 - 1 then 71 end as bucket
  from (select *, case when m0 > 0 then (m0 - 1) // 12 else 0 end as y0 from (select *, case when d0 > 0 then (d0 - 1) // 31 else 0 end as m0
    from (select *, case when h0 > 0 then (h0 - 1) // 24 else 0 end as d0 from (select batch_id as j, quarter, n, (n - 1) // 4 as h0 from q, n))))
)"""
#: itemsets of one to three items, over the whole table
_SETS = """, total as (select count(*) as n_events from ev),
s1 as (select item as s, [item] as l, count(*) as support from it group by item),
s2 as (select a.item || '|' || b.item as s, [a.item, b.item] as l, count(*) as support from it a join it b on a.event_id = b.event_id and a.item < b.item group by a.item, b.item),
s3 as (select a.item || '|' || b.item || '|' || c.item as s, [a.item, b.item, c.item] as l, count(*) as support
  from it a join it b on a.event_id = b.event_id and a.item < b.item join it c on a.event_id = c.event_id and b.item < c.item group by a.item, b.item, c.item),
sets as (select * from s1 union all select * from s2 union all select * from s3)"""


def _flat(sets: DataFrame, column: str = "items") -> DataFrame:
    return sets.withColumn(column, F.array_join(column, "|"))


def _least(spark: SparkSession, sf_dir: str, share: float) -> int:
    return mining.minimum_count(share, table(spark, sf_dir, "events").count())


def _sets(spark: SparkSession, sf_dir: str, share: float, size: int, constraints: Constraints | None = None) -> DataFrame:
    return mining.frequent_itemsets(ingested(spark, sf_dir), _least(spark, sf_dir, share), constraints, size)


# ---- parsing, items, lookups


@query(f"with {_EV} select event_id, event_type, duration_ms, speed from ev")
def discretize_speed(spark, sf_dir):
    return views(spark, sf_dir).select("event_id", "event_type", "duration_ms", "speed")


@query(f"with {_EV} select event_id, array_to_string(items, '|') as items from tx")
def event_transactions(spark, sf_dir):
    return _flat(transactions(spark, sf_dir).select("event_id", "items"))


@query(f"with {_EV} select event_id, case when k <> 0 then 'status:' || cast(k // 25 as varchar) end as status_item from ev")
def status_item_projection(spark, sf_dir):
    return views(spark, sf_dir).select("event_id", I.item("status", F.col("status")).alias("status_item"))


def _lines(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))
    ip = F.concat_ws(".", F.lit("10"), F.floor(F.col("user_id") / 65536) % 256, F.floor(F.col("user_id") / 256) % 256, F.col("user_id") % 256)
    ets = F.concat(F.col("event_type"), F.lit(":"), F.floor("value").cast("int").cast("string"), F.lit(",total:"), (F.floor("value").cast("int") * 2).cast("string"))
    url, ua = F.concat(F.lit("http://example.test/p/"), F.col("k").cast("string")), F.concat(F.lit("Agent/1."), (F.col("event_id") % 3).cast("string"), F.lit(" (x; y)"))
    time = F.timestamp_seconds(windows.epoch_seconds(F.col("ts")))
    return e.select("event_id", weblog.format_line(ip, time, ets, F.lit(200) + F.col("k"), url, ua, F.lit("example.test")).alias("value"))


@query("""
select event_id, '10.' || cast(user_id // 65536 % 256 as varchar) || '.' || cast(user_id // 256 % 256 as varchar) || '.' || cast(user_id % 256 as varchar) as ip,
  10 * 16777216 + user_id as ip_number, epoch_us(ts) // 1000000 as time_s, event_type as episode, cast(floor(value) as int) as duration_ms,
  cast(floor(value) as int) * 2 as total_ms, 200 + cast(json_extract(props, '$.k') as int) as status,
  'http://example.test/p/' || cast(json_extract(props, '$.k') as varchar) as url, 'Agent/1.' || cast(event_id % 3 as varchar) || ' (x; y)' as ua, 'example.test' as domain
from events""")
def log_line_roundtrip(spark, sf_dir):
    p = weblog.parse(_lines(spark, sf_dir))
    return p.select("event_id", "ip", "ip_number", "time_s", F.col("episodes")[0]["name"].alias("episode"), F.col("episodes")[0]["duration_ms"].alias("duration_ms"), F.col("episodes")[1]["duration_ms"].alias("total_ms"), "status", "url", "ua", "domain")


@query("select event_id, 'broken ' || cast(event_id as varchar) as value from events where event_id % 7 = 0")
def corrupt_lines(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    broken = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("broken "), F.col("event_id").cast("string"))).otherwise(F.col("value"))
    return weblog.corrupt(lines.withColumn("value", broken)).select("event_id", "value")


@query(f"with {_EV} select event_id, region, nation, segment from ev")
def geo_enrich(spark, sf_dir):
    return views(spark, sf_dir).select("event_id", "region", "nation", "segment")


@query("""
with a as (select event_id, user_id * 104729 % 26214400 as ip_number from events),
d as (select n_nationkey * 1048576 as lo, n_nationkey * 1048576 + 1048575 as hi, n_name from nation where n_nationkey % 3 <> 0)
select event_id, ip_number, n_name as country from a left join d on ip_number between lo and hi""")
def ip_range_lookup(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").where(F.col("n_nationkey") % 3 != 0)
    lo = F.col("n_nationkey").cast("long") * 1048576
    dim = nation.select(lo.alias("lo"), (lo + 1048575).alias("hi"), F.lit("X").alias("continent"), F.col("n_name").alias("country"), *[F.lit(None).cast("string").alias(c) for c in ("region", "city", "isp")])
    asked = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 104729 % 26214400).alias("ip_number"))
    return enrich.locate(asked, dim).select("event_id", "ip_number", F.col("location.country").alias("country"))


@query("""
with a as (select event_id, event_type || '/' || cast(event_id % 10 as varchar) as ua from events),
d(pattern, rx, platform, mobile) as (values ('*', '.*', 'any', false), ('click*', 'click.*', 'web', false), ('click/?', 'click/.', 'phone', true), ('view/[1-5]', 'view/[1-5]', 'tv', false)),
m as (select event_id, ua, platform, mobile, row_number() over (partition by event_id order by length(pattern) desc, pattern desc) as r from a join d on regexp_full_match(ua, rx))
select event_id, ua, platform, mobile as is_mobile from m where r = 1""")
def agent_lookup(spark, sf_dir):
    dim = spark.createDataFrame([("*", "any", False), ("click*", "web", False), ("click/?", "phone", True), ("view/[1-5]", "tv", False)], "pattern string, platform string, is_mobile boolean")
    dim = dim.select("pattern", "platform", *[F.lit(None).cast("string").alias(c) for c in ("browser_name", "browser_version")], *[F.lit(None).cast("int").alias(c) for c in ("version_major", "version_minor")], "is_mobile")
    asked = table(spark, sf_dir, "events").select("event_id", F.concat_ws("/", "event_type", (F.col("event_id") % 10).cast("string")).alias("ua"))
    return enrich.identify_agents(asked, dim).select("event_id", "ua", "agent.platform", "agent.is_mobile")


@query("""
select * from (values ('click', 'fast', 15), ('click', 'acceptable', 70), ('click', 'slow', 65535), ('view', 'fast', 20), ('view', 'acceptable', 80), ('view', 'slow', 65535),
  ('purchase', 'fast', 15), ('purchase', 'acceptable', 60), ('purchase', 'slow', 65535), ('signup', 'fast', 10), ('signup', 'acceptable', 50), ('signup', 'slow', 65535),
  ('error', 'fast', 25), ('error', 'acceptable', 100), ('error', 'slow', 65535)) t(episode, speed, max_ms)""")
def threshold_rows(spark, sf_dir):
    return speeds(spark)


@query("select 0.05 as sigma, 0.04 as epsilon, 0.2 as margin, 25 as episodes")
def option_scalars(spark, sf_dir):
    o, episodes = Options(), thresholds.default(spark).agg(F.count_distinct("episode").cast("int").alias("episodes"))
    return episodes.select(F.lit(o.sigma).alias("sigma"), F.lit(round(epsilon_of(o.sigma, 0.2), 6)).alias("epsilon"), F.lit(round(margin_of(o.sigma, o.epsilon), 6)).alias("margin"), "episodes")


@query(f"""with {_EV}, p as (select distinct unnest(list_transform(range(1, len(string_split(item, ':')) + 1), lambda i: string_split(item, ':')[1:i])) as p from it where item not like 'duration:%')
select array_to_string(p, ':') as path, case when len(p) > 1 then array_to_string(p[1:len(p) - 1], ':') end as parent, p[len(p)] as label, cast(len(p) as int) as depth from p""")
def concept_hierarchy(spark, sf_dir):
    return I.hierarchy(ingested(spark, sf_dir).select(F.explode("items").alias("item")).distinct())


@query(f"with {_EV} select distinct item as path from it where upper(item) like 'LOCATION:A%' union select distinct 'location:' || region from ev where upper(region) like 'A%'")
def hierarchy_completion(spark, sf_dir):
    return I.complete(concept_hierarchy(spark, sf_dir), "episode:click, Location:a")


# ---- itemsets


@query(f"with {_EV} select item, count(*) as support from it group by item")
def item_support(spark, sf_dir):
    return mining.item_support(ingested(spark, sf_dir))


@query(f"with {_EV}, c as (select item, count(*) as support from it group by item having count(*) >= (select ceil(round(0.05 * count(*), 9)) from ev)) select item, support, cast(row_number() over (order by support desc, item) as int) as position from c")
def frequent_items_ranked(spark, sf_dir):
    return mining.ranked_items(ingested(spark, sf_dir), _least(spark, sf_dir, 0.05))


@query(f"with {_EV} {_SETS} select s as items, support from s2, total where support >= ceil(round(0.02 * n_events, 9))")
def pairs_support(spark, sf_dir):
    return _flat(_sets(spark, sf_dir, 0.02, 2).where(F.size("items") == 2))


@query(f"with {_EV} {_SETS} select s as items, support from s3, total where support >= ceil(round(0.01 * n_events, 9))")
def triples_support(spark, sf_dir):
    return _flat(_sets(spark, sf_dir, 0.01, 3).where(F.size("items") == 3))


@query(f"with {_EV} {_SETS} select s as items, support from sets, total where len(l) <= 2 and support >= ceil(round(0.05 * n_events, 9))")
def itemsets_fp_growth(spark, sf_dir):
    """The same sets by MLlib's FP-growth."""
    from pyspark.ml.fpm import FPGrowth

    n, least = table(spark, sf_dir, "events").count(), _least(spark, sf_dir, 0.05)
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n).fit(ingested(spark, sf_dir).select("items"))
    return _flat(model.freqItemsets.where(F.size("items") <= 2).select(F.array_sort("items").alias("items"), F.col("freq").alias("support")))


@query("""
with b as (select distinct l_orderkey, p_brand from lineitem join part on p_partkey = l_partkey), total as (select count(distinct l_orderkey) as n from b)
select x.p_brand || '|' || y.p_brand as items, count(*) as support from b x join b y on x.l_orderkey = y.l_orderkey and x.p_brand < y.p_brand
group by all having count(*) >= (select ceil(round(0.002 * n, 9)) from total)""")
def basket_pairs(spark, sf_dir):
    bought = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand")
    baskets = bought.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_brand")).alias("items"))
    return _flat(mining.frequent_itemsets(baskets, mining.minimum_count(0.002, baskets.count()), max_len=2).where(F.size("items") == 2))


@query(f"with {_EV} select 'duration:slow|location:ASIA' as items, count(*) as support from tx where list_has_all(items, ['duration:slow', 'location:ASIA']) union all select 'episode:click', count(*) from tx where list_contains(items, 'episode:click') union all select 'episode:click|episode:view', 0")
def support_of_itemsets(spark, sf_dir):
    wanted = spark.createDataFrame([(["location:ASIA", "duration:slow"],), (["episode:click"],), (["episode:click", "episode:view"],)], "items array<string>")
    return _flat(mining.support_of(ingested(spark, sf_dir), wanted))


def _constrained(name: str, constraints: Constraints, test: str, size: int = 2, share: float = 0.02):
    sql = f"with {_EV} {_SETS} select s as items, support from sets, total where len(l) <= {size} and support >= ceil(round({share} * n_events, 9)) and {test}"

    def run(spark, sf_dir):
        return _flat(_sets(spark, sf_dir, share, size, constraints))

    run.__name__ = name
    query(sql)(run)


_SLOW_ASIA = "['duration:slow', 'location:ASIA']"
_constrained("itemsets_match_any", Constraints().add(Kind.ANY, "duration:slow", "location:ASIA"), f"list_has_any(l, {_SLOW_ASIA})")
_constrained("itemsets_match_all", Constraints().add(Kind.ALL, "duration:slow", "location:ASIA"), f"list_has_all(l, {_SLOW_ASIA})")
_constrained("itemsets_exclude_all", Constraints().add(Kind.NONE, "duration:slow", "location:ASIA"), f"not list_has_any(l, {_SLOW_ASIA})")
_constrained("itemsets_exclude_any", Constraints().add(Kind.NOT_ALL, "duration:slow", "location:ASIA"), f"not list_has_all(l, {_SLOW_ASIA})")
_constrained("itemsets_set_any", Constraints().add(Kind.ANY, "duration:fast").set(Kind.ANY, ["episode:view", "segment:BUILDING"]), "list_has_any(l, ['episode:view', 'segment:BUILDING'])")
_constrained("itemsets_wildcard", Constraints().add(Kind.ANY, "location:A*A", "segment:*", "duration:slow").add(Kind.NONE, "status:[01]*"), "len(list_filter(l, lambda x: regexp_full_match(x, 'location:A.*A'))) > 0 and len(list_filter(l, lambda x: x like 'segment:%')) > 0 and list_contains(l, 'duration:slow')", 3, 0.005)
_constrained("itemsets_wildcard_none", Constraints().add(Kind.ANY, "segment:*").add(Kind.NONE, "status:[01]*", "location:*"), "len(list_filter(l, lambda x: x like 'segment:%')) > 0 and len(list_filter(l, lambda x: regexp_full_match(x, 'status:[01].*') or x like 'location:%')) = 0")
_constrained("itemsets_wildcard_all", Constraints().add(Kind.ALL, "duration:s*"), "list_contains(l, 'duration:slow')")
_constrained("itemsets_wildcard_not_all", Constraints().add(Kind.NOT_ALL, "episode:cl*", "segment:*"), "not list_contains(l, 'episode:click')")


@query(f"with {_EV} select distinct item from it where item like 'segment:%' or item like 'location:A%A' or item = 'episode:click'")
def constraint_items(spark, sf_dir):
    """The items of all categories of a kind, together."""
    wanted = Constraints().add(Kind.ANY, "segment:*", "location:A*A", "episode:click", "episode:unknown")
    return wanted.items_of(Kind.ANY, ingested(spark, sf_dir).select(F.explode("items").alias("item")))


# ---- rules

_VOCABULARY = """, voc as materialized (select item, row_number() over (order by item) as i from (select distinct item from it))"""


def _numbered(name: str, test: str, from_: str = "") -> str:
    """Frequent itemsets of one to three items as numbers a < b < c (0: none) of ``voc``: {name}_s; {name}_n has the events."""
    return f""", {name}_i as materialized (select event_id, i from it join voc using (item) {from_}),
{name}_n as materialized (select count(*) as n from ev {from_}),
{name}_p as materialized (select x.event_id, x.i as a, y.i as b from {name}_i x join {name}_i y on x.event_id = y.event_id and x.i < y.i),
{name}_a as materialized (
  select i as a, 0 as b, 0 as c, count(*) as support from {name}_i group by i union all
  select a, b, 0, count(*) from {name}_p group by a, b union all
  select p.a, p.b, z.i, count(*) from {name}_p p join {name}_i z on z.event_id = p.event_id and z.i > p.b group by p.a, p.b, z.i),
{name}_s as materialized (select a, b, c, support from {name}_a, {name}_n where {test})"""


def _split(name: str, consequent: str) -> str:
    """Rules x1, x2 => y1, y2 of {name}_s: every way to split two and three items."""
    return f"""{_numbered(name, "support >= ceil(round(0.02 * n, 9))")},
w as materialized (
  select a as x1, 0 as x2, b as y1, 0 as y2, support from {name}_s where b > 0 and c = 0 union all select b, 0, a, 0, support from {name}_s where b > 0 and c = 0 union all
  select a, b, c, 0, support from {name}_s where c > 0 union all select a, c, b, 0, support from {name}_s where c > 0 union all select b, c, a, 0, support from {name}_s where c > 0 union all
  select a, 0, b, c, support from {name}_s where c > 0 union all select b, 0, a, c, support from {name}_s where c > 0 union all select c, 0, a, b, support from {name}_s where c > 0)
select v1.item || coalesce('|' || v2.item, '') as antecedent, v3.item || coalesce('|' || v4.item, '') as consequent, w.support, round(w.support / s.support, 6) as confidence
from w join {name}_s s on s.a = x1 and s.b = x2 and s.c = 0 join voc v1 on v1.i = x1 left join voc v2 on v2.i = x2 join voc v3 on v3.i = y1 left join voc v4 on v4.i = y2
where w.support / s.support >= 0.2 and {consequent}"""


@query(f"with {_EV} {_VOCABULARY} {_split('u', 'y2 = 0')}")
def rules_single_consequent(spark, sf_dir):
    sets = store(_sets(spark, sf_dir, 0.02, 3), "itemsets")
    return _flat(_flat(rules.mine(sets, sets, 0.2, max_consequent=1), "antecedent"), "consequent").withColumn("confidence", F.round("confidence", 6))


@query(f"with {_EV} {_VOCABULARY} " + _split("u", "regexp_full_match(v3.item, '(duration|segment):.*') and coalesce(regexp_full_match(v4.item, '(duration|segment):.*'), true)"))
def rules_multi_consequent(spark, sf_dir):
    sets = store(_sets(spark, sf_dir, 0.02, 3), "itemsets")
    may = Constraints().add(Kind.NONE, "episode:*", "location:*", "status:*")
    return _flat(_flat(rules.mine(sets, sets, 0.2, may), "antecedent"), "consequent").withColumn("confidence", F.round("confidence", 6))


@query(f"""with {_EV}, a as (select unnest([event_type, event_type || '|' || region, event_type || '|' || segment]) as antecedent, speed = 'slow' as slow from ev)
select antecedent, count(*) as events, count_if(slow) as support, round(count_if(slow) / count(*), 6) as confidence from a where antecedent is not null
group by antecedent having count_if(slow) > (select ceil(round(0.01 * count(*), 9)) from ev) and count_if(slow) / count(*) >= 0.2""")
def why_slow_query(spark, sf_dir):
    tx = ingested(spark, sf_dir)
    kinds = F.array_compact(F.array("event_type", F.concat("event_type", F.lit("|"), "region"), F.concat("event_type", F.lit("|"), "segment")))
    found = why_slow(tx, kinds, F.col("speed") == "slow", table(spark, sf_dir, "events").count(), Options(sigma=0.01, epsilon=0.008))
    return found.withColumn("confidence", F.round("confidence", 6))


QUERIES["why_slow"] = QUERIES.pop("why_slow_query")
ORACLES["why_slow"] = ORACLES.pop("why_slow_query")


# ---- time


@query(f"with {_EV} {_BATCH} select quarter, batch_id, count(*) as events from ev join q using (quarter) group by all")
def quarter_batches(spark, sf_dir):
    return ingested(spark, sf_dir).groupBy("quarter", F.col("batch_id").cast("long").alias("batch_id")).agg(F.count(F.lit(1)).alias("events"))


@query(f"with {_EV} select quarter, quarter - (select min(quarter) from ev) as batch_id, count(*) as events from ev group by quarter")
def calendar_batches(spark, sf_dir):
    rows = windows.with_batches(ingested(spark, sf_dir).select("quarter"), calendar=True)
    return rows.groupBy("quarter", F.col("batch_id").cast("long").alias("batch_id")).agg(F.count(F.lit(1)).alias("events"))


@query(f"""with {_EV} {_BATCH} select batch_id, count(distinct l.l_orderkey) as events, count(*) as transactions, round(count(*) / count(distinct l.l_orderkey), 6) as ratio
from lineitem l join (select o_orderkey, row_number() over (order by m) - 1 as batch_id from (select distinct date_trunc('month', o_orderdate) as m from orders) d join orders on date_trunc('month', o_orderdate) = m where false union all
  select o_orderkey, dense_rank() over (order by date_trunc('month', o_orderdate)) - 1 from orders) o on o_orderkey = l_orderkey group by batch_id""")
def events_per_batch(spark, sf_dir):
    """Orders as page views of many episodes, in monthly batches."""
    orders = table(spark, sf_dir, "orders").withColumn("quarter", F.year("o_orderdate") * 12 + F.month("o_orderdate"))
    lines = table(spark, sf_dir, "lineitem").join(windows.with_batches(orders.select("o_orderkey", "quarter")), F.col("l_orderkey") == F.col("o_orderkey"))
    return windows.batch_sizes(lines, "l_orderkey").select(F.col("batch_id").cast("long").alias("batch_id"), "events", "transactions", F.round("ratio", 6).alias("ratio"))


@query(f"with {_EV} select event_id, quarter, max(quarter) over (order by event_id rows between unbounded preceding and current row) as open_quarter from ev")
def late_rows_open_batch(spark, sf_dir):
    return windows.open_quarter(ingested(spark, sf_dir).select("event_id", "quarter"), "event_id", chunk=1000).select("event_id", "quarter", "open_quarter")


@query(f"with {_EV} {_BATCH} select batch_id, cast(bucket as int) as bucket from tb")
def tilted_buckets(spark, sf_dir):
    b = ingested(spark, sf_dir).select(F.col("batch_id").cast("long").alias("batch_id")).distinct()
    n = b.agg(F.max("batch_id")).first()[0] + 1
    return b.select("batch_id", tilted.bucket(n, F.col("batch_id")).alias("bucket"))


def _item_state(spark, sf_dir) -> tuple[DataFrame, int]:
    b = ingested(spark, sf_dir)
    n = b.agg(F.max("batch_id")).first()[0] + 1
    return mining.item_support(b, by=("batch_id",)).withColumnRenamed("item", "pattern"), n


@query(f"with {_EV} {_BATCH} select item as pattern, cast(bucket as int) as bucket, count(*) as support from it join tb using (quarter) where bucket is not null group by all")
def tilted_windows(spark, sf_dir):
    return tilted.windows(*_item_state(spark, sf_dir))


@query(f"with {_EV} {_BATCH} select item as pattern, count(*) as support from it join tb using (quarter) where bucket between 4 and 34 group by all")
def tilted_range_sum(spark, sf_dir):
    s, n = _item_state(spark, sf_dir)
    return tilted.range_sum(s, n, 4, 34)


@query(f"""with {_EV} {_BATCH} select name, item as pattern, count(*) as support from it join tb using (quarter)
join (values ('quarter', 0, 0), ('hour', 4, 4), ('day', 28, 28), ('week', 28, 34), ('month', 59, 59), ('year', 71, 71), ('all', 0, 71)) r(name, lo, hi) on bucket between lo and hi group by all""")
def named_range_support(spark, sf_dir):
    s, n = _item_state(spark, sf_dir)
    window = tilted.windows(s, n)
    spans = F.broadcast(spark.createDataFrame([(k, *v) for k, v in tilted.RANGES.items()], "name string, lo int, hi int"))
    return window.join(spans, F.col("bucket").between(F.col("lo"), F.col("hi"))).groupBy("name", "pattern").agg(F.sum("support").alias("support"))


@query(f"""with {_EV}, t as (select min(time_s) as t0, max(time_s) // 900 * 900 + 900 as latest from ev)
select name, greatest(t0, latest - 900 * far) as start_s, latest - 900 * near as end_s from t,
(values ('quarter', 0, 1), ('hour', 4, 8), ('day', 100, 196), ('week', 100, 772), ('month', 3076, 6052), ('year', 38788, 74500), ('all', 0, 74500)) r(name, near, far)""")
def range_to_clock(spark, sf_dir):
    t = ingested(spark, sf_dir).agg(F.min("time_s").alias("a"), F.max("time_s").alias("b")).first()
    rows = [(name, c.start, c.end) for name, span in tilted.RANGES.items() for c in [tilted.clock(t.a, t.b, *span)]]
    return spark.createDataFrame(rows, "name string, start_s long, end_s long")


_WINDOW = """, w as (select item as pattern, bucket, count(*) as support from it join tb using (quarter) where bucket is not null group by all),
z as (select bucket, count(*) as size from ev join tb using (quarter) where bucket is not null group by bucket)"""


@query(f"with {_EV} {_BATCH} {_WINDOW} select pattern, cast(bucket as int) as bucket, support, cast(sum(support) over (partition by pattern order by bucket desc) as bigint) as cumulative from w")
def cumulative_tails(spark, sf_dir):
    return windows.cumulative_tail(tilted.windows(*_item_state(spark, sf_dir)))


@query(f"""with {_EV} {_BATCH} {_WINDOW}, a as (
  select pattern, bucket, support < ceil(round(0.25 * size, 9)) as low, sum(support) over o as s, sum(size) over o as z, support, size
  from w join z using (bucket) window o as (partition by pattern order by bucket desc)),
b as (select *, bool_and(low) over (partition by pattern order by bucket desc) as tail from a),
c as (select *, bool_and(tail and s < ceil(round(0.21 * z, 9))) over (partition by pattern order by bucket desc) as below from b),
d as (select pattern, min(case when below then bucket end) as m from c group by pattern)
select pattern, case when m <= 0 then 0 when m <= 4 then 4 when m <= 28 then 28 when m <= 59 then 59 when m <= 71 then 71 end as drop_from from d""")
def tail_prune_decision(spark, sf_dir):
    s, n = _item_state(spark, sf_dir)
    sizes = windows.batch_sizes(ingested(spark, sf_dir), "event_id").withColumn("bucket", tilted.bucket(n, F.col("batch_id"))).where("bucket is not null").groupBy("bucket").agg(F.sum("events").alias("size"))
    return windows.droppable_tails(tilted.windows(s, n), sizes, 0.25, 0.21)


@query(f"with {_EV} {_BATCH} {_WINDOW} select pattern, array_to_string(list_transform(range(0, 30), lambda i: coalesce(cast(list_filter(b, lambda x: x[1] = i)[1][2] as varchar), '-')), ',') as buckets from (select pattern, list([bucket, support]) as b from w where bucket < 30 group by pattern)")
def window_dump(spark, sf_dir):
    dumped = tilted.dump(tilted.windows(*_item_state(spark, sf_dir)), 30)
    return dumped.select("pattern", F.array_join(F.transform("buckets", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",").alias("buckets"))


# ---- ranges

_OPTIONS = Options(sigma=0.004, epsilon=0.003, confidence=0.25, max_len=3)
_OLDER, _NEWER = (35, 41), "week"


def _ranged(name: str, lo: int, hi: int) -> str:
    """Itemsets of buckets lo..hi, and the rules that say what is slow: x1, x2 => slow."""
    return _numbered(name, "support > ceil(round(0.004 * n, 9))", f"join tb using (quarter) where bucket between {lo} and {hi}") + f""",
{name}_x as materialized (select case when a = k then b else a end as x1, case when c = k then b else c end as x2, support from {name}_s, (select i as k from voc where item = 'duration:slow') where b > 0 and k in (a, b, c)),
{name}_r as materialized (
  select x1, x2, v1.item || coalesce('|' || v2.item, '') as antecedent, 'duration:slow' as consequent, x.support, x.support / s.support as confidence
  from {name}_x x join {name}_s s on s.a = x1 and s.b = x2 and s.c = 0 join voc v1 on v1.i = x1 left join voc v2 on v2.i = x2
  where x.support / s.support >= 0.25 and (v1.item like 'episode:%' or coalesce(v2.item, '') like 'episode:%'))"""


_NEW, _OLD = _VOCABULARY + _ranged("new", 28, 34), _ranged("old", 35, 41)
_BOTH = f"""{_NEW} {_OLD}, cmp as materialized (
  select coalesce(n.antecedent, o.antecedent) as antecedent, coalesce(n.consequent, o.consequent) as consequent, coalesce(n.support, o.support) as support,
    coalesce(n.confidence, o.confidence) as confidence, case when n.antecedent is null then 'older' when o.antecedent is null then 'newer' else 'both' end as kind,
    case when n.antecedent is null then -1.0 when o.antecedent is null then 1.0 else n.confidence - o.confidence end as confidence_change,
    case when n.antecedent is null then -1.0 when o.antecedent is null then 1.0 else n.support / (select n from new_n) - o.support / (select n from old_n) end as support_change
  from new_r n full join old_r o on n.x1 = o.x1 and n.x2 = o.x2)"""


def _analyst(spark, sf_dir) -> Analyst:
    return Analyst(_OPTIONS).analyze(ingested(spark, sf_dir))


def _shown(r: DataFrame) -> DataFrame:
    return _flat(_flat(r, "antecedent"), "consequent").withColumn("confidence", F.round("confidence", 6))


@query(f"with {_EV} {_BATCH} {_NEW} select v1.item || coalesce('|' || v2.item, '') || coalesce('|' || v3.item, '') as items, support from new_s join voc v1 on v1.i = a left join voc v2 on v2.i = b left join voc v3 on v3.i = c")
def range_itemsets(spark, sf_dir):
    return _flat(_analyst(spark, sf_dir).itemsets_of(_NEWER))


@query(f"with {_EV} {_BATCH} {_NEW} select antecedent, consequent, support, round(confidence, 6) as confidence from new_r")
def mine_range(spark, sf_dir):
    return _shown(_analyst(spark, sf_dir).mine(_NEWER))


@query(f"with {_EV} {_BATCH} {_BOTH} select antecedent, consequent, support, round(confidence, 6) as confidence, kind, round(confidence_change, 6) as confidence_change, round(support_change, 6) as support_change from cmp")
def compare_ranges(spark, sf_dir):
    return _shown(_analyst(spark, sf_dir).compare(_OLDER, _NEWER)).withColumn("confidence_change", F.round("confidence_change", 6)).withColumn("support_change", F.round("support_change", 6))


@query(f"with {_EV} {_BATCH} {_BOTH} select antecedent, consequent, support, round(confidence, 6) as confidence from cmp where kind = 'both'")
def intersected_rules(spark, sf_dir):
    a = _analyst(spark, sf_dir)
    return _shown(rules.intersected(a.mine(_OLDER), a.mine(_NEWER)))


@query(f"with {_EV} {_BATCH} {_BOTH} select antecedent, consequent, support, round(confidence, 6) as confidence from cmp where kind = 'newer'")
def newer_only_rules(spark, sf_dir):
    a = _analyst(spark, sf_dir)
    return _shown(rules.only_in(a.mine(_NEWER), a.mine(_OLDER)))


@query(f"with {_EV} {_BATCH} {_BOTH} select antecedent, consequent, support, round(confidence, 6) as confidence from cmp where kind = 'older'")
def older_only_rules(spark, sf_dir):
    a = _analyst(spark, sf_dir)
    return _shown(rules.only_in(a.mine(_OLDER), a.mine(_NEWER)))


@query(f"with {_EV} {_BATCH} select (select count(*) from ev join tb using (quarter) where bucket between 28 and 34 or bucket between 30 and 41) as nested_events, (select count(*) from ev join tb using (quarter) where bucket between 28 and 41) as touching_events")
def compared_event_counts(spark, sf_dir):
    a = _analyst(spark, sf_dir)
    return spark.createDataFrame([(a.events_of_both((30, 41), (28, 34)), a.events_of_both((35, 41), (28, 34)))], "nested_events long, touching_events long")


_REPORT = """select regexp_extract(antecedent, 'episode:([^|]*)', 1) as episode, array_to_string(list_filter(string_split(antecedent, '|'), lambda v: v not like 'episode:%'), ', ') as circumstances,
  round(confidence * 100, 2) as pct_slow, support as n_slow, round(support * 100 / (select n from new_n), 2) as pct_events from new_r"""


@query(f"with {_EV} {_BATCH} {_NEW} {_REPORT}")
def report_mine(spark, sf_dir):
    a = _analyst(spark, sf_dir)
    return report.mined(a.mine(_NEWER), a.events(_NEWER))


@query(f"with {_EV} {_BATCH} {_NEW}, rep as ({_REPORT}) select * from rep where episode ilike '%R%' and regexp_matches(circumstances, '(?i)segment:.*u')")
def report_filtered(spark, sf_dir):
    return report.sort(report.Filter.parse("episode:R, Segment:*u").apply(report_mine(spark, sf_dir)))


@query(f"""with {_EV} {_BATCH} {_BOTH}, u as (select count(*) as n from ev join tb using (quarter) where bucket between 28 and 41)
select regexp_extract(antecedent, 'episode:([^|]*)', 1) as episode, array_to_string(list_filter(string_split(antecedent, '|'), lambda v: v not like 'episode:%'), ', ') as circumstances, kind,
  round(confidence * 100, 2) as pct_slow, case when confidence_change > 0 then '+' else '' end || printf('%.2f', round(confidence_change * 100, 2) + 0.0) as pct_slow_change,
  case when support_change > 0 then '+' else '' end || printf('%.2f', round(support_change * 100, 2) + 0.0) as n_slow_change, support as n_slow, round(support * 100 / case kind when 'newer' then (select n from new_n) when 'older' then (select n from old_n) else (select n from u) end, 2) as pct_events
from cmp""")
def report_compare(spark, sf_dir):
    a = _analyst(spark, sf_dir)
    return report.compared(a.compare(_OLDER, _NEWER), a.events(_OLDER), a.events(_NEWER), a.events_of_both(_OLDER, _NEWER))


@query(f"""with {_EV}, s as (select item, count(*) as support from it group by item)
select min(time_s) as start_s, max(time_s) as end_s, count(*) as page_views, count(*) as transactions, (select count(*) from s) as unique_items,
  (select count(*) from s where support >= (select ceil(round(0.05 * count(*), 9)) from ev)) as frequent_items, (select count(*) from s) * 84 as item_bytes from ev""")
def dataset_stats(spark, sf_dir):
    return statistics(ingested(spark, sf_dir))


@query(f"""with {_EV} {_SETS}, s as (select item, count(*) as support from it group by item), e as (select count(*) as n from ev),
p as (select l, support from sets, e where len(l) <= 2 and support >= ceil(round(0.04 * n, 9))),
firsts as (select distinct case when x.support > y.support or (x.support = y.support and x.item < y.item) then x.item else y.item end as item from p join s x on x.item = l[1] join s y on y.item = l[2] where len(l) = 2)
select min(time_s) as start_s, max(time_s) as end_s, count(*) as page_views, count(*) as transactions, (select count(*) from s) as unique_items, (select count(*) from s, e where support >= ceil(round(0.05 * n, 9))) as frequent_items,
  (select count(*) from s) * 84 as item_bytes, (select count(*) from p) as patterns, (select count(*) from p) as nodes, (select count(*) from p) - (select count(*) from firsts) as leaves, (select count(*) from p) * 304 + 12 as pattern_bytes from ev""")
def pattern_stats(spark, sf_dir):
    """The statistics with the patterns and the tree that holds them."""
    return statistics(ingested(spark, sf_dir), max_len=2)


@query(f"with {_EV} {_BATCH}, f as (select quarter, count(distinct item) as found from it group by quarter) select batch_id, round(count(*) / 900, 9) as page_views_per_s, round(count(*) / 900, 9) as episodes_per_s, round(any_value(found) / 900, 9) as patterns_per_s from ev join q using (quarter) join f using (quarter) group by batch_id")
def batch_rates(spark, sf_dir):
    """Page views, episodes and patterns a second, of each batch."""
    tx = ingested(spark, sf_dir)
    found = streaming.rates(windows.batch_sizes(tx, "event_id"), mining.by_batch(tx, 1))
    return found.select(F.col("batch_id").cast("long").alias("batch_id"), *[F.round(c, 9).alias(c) for c in found.columns[1:]])


@query(f"with {_EV} {_BATCH} select item as pattern, cast(bucket as int) as bucket, count(*) as support from it join tb using (quarter) where bucket < 28 group by all")
def dropped_tails(spark, sf_dir):
    """Windows without days and all that is older."""
    state, n = _item_state(spark, sf_dir)
    return tilted.windows(tilted.drop_tail(state, n, 2), n)


@query(f"""with {_EV} {_BATCH}, p as (select x.event_id, x.quarter, x.item as a, y.item as b from it x join it y on x.event_id = y.event_id and x.item < y.item)
select item as pattern, cast(bucket as int) as bucket, count(*) as support from it join tb using (quarter) where bucket is not null group by all union all
select a || '|' || b, cast(bucket as int), count(*) from p join tb using (quarter) where bucket is not null group by a, b, bucket""")
def exact_replay(spark, sf_dir):
    """Windows of all itemsets of one and two items, of exact state that was folded in four parts."""
    state = streaming.ExactState(spark, fresh_folder(spark, "state"), max_len=2)
    tx = ingested(spark, sf_dir)
    for part in range(4):
        state.fold(tx.where(F.col("event_id") % 4 == part), part, "event_id")
    found = tilted.windows(_flat(state.patterns()).withColumnRenamed("items", "pattern"), state.sizes().count())
    return found.select("pattern", "bucket", "support")


# ---- log lines


def _places(spark, sf_dir) -> DataFrame:
    """Address ranges of 64 addresses for each nation."""
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    n, lo = F.col("n_nationkey").cast("long"), F.col("n_nationkey").cast("long") * 64 + 10 * 16777216
    return nation.select(
        lo.alias("lo"), (lo + 63).alias("hi"), F.col("r_name").alias("continent"), F.col("n_name").alias("country"), F.when(n % 2 == 0, F.concat(F.lit("R"), n.cast("string"))).alias("region"),
        F.lit("anywhere").alias("city"), F.when(n % 5 != 0, F.concat(F.lit("ISP"), (n % 3).cast("string"))).alias("isp"),
    )


def _agents(spark) -> DataFrame:
    rows = [("*", "any", None, None, None, None, False), ("Agent/1.0*", "Win", "A", "1.0", 1, 0, False), ("Agent/1.[1x] (?; *", "Phone", "A", "1.1", 1, None, True)]
    return spark.createDataFrame(rows, "pattern string, platform string, browser_name string, browser_version string, version_major int, version_minor int, is_mobile boolean")


def _line_transactions(spark, sf_dir, lines: DataFrame) -> DataFrame:
    return ingest.transactions_of(lines, _places(spark, sf_dir), _agents(spark), bounds=speeds(spark))


_LT = """, lt as materialized (
  select e.event_id * 2 + x.second as tx, e.event_id, e.time_s, e.quarter, x.name, list_sort(list_filter([
    'url:http://example.test/p/' || cast(e.k as varchar), case when e.k <> 0 then 'status:' || cast(200 + e.k as varchar) end, 'episode:' || x.name, case when x.second = 0 then 'duration:' || e.speed end,
    'location:' || r_name, 'location:' || r_name || ':' || n_name, case when n_nationkey % 2 = 0 then 'location:' || r_name || ':' || n_name || ':R' || cast(n_nationkey as varchar) end,
    case when n_nationkey % 5 <> 0 then 'isp:' || n_name || ':ISP' || cast(n_nationkey % 3 as varchar) end,
    case e.event_id % 3 when 0 then 'ua:Win' when 1 then 'ua:Phone' else 'ua:any' end, case e.event_id % 3 when 0 then 'ua:Win:A' when 1 then 'ua:Phone:A' end,
    case e.event_id % 3 when 0 then 'ua:Win:A:1' when 1 then 'ua:Phone:A:1' end, case e.event_id % 3 when 0 then 'ua:Win:A:1:0' when 1 then 'ua:isMobile' end], lambda v: v is not null)) as items
  from ev e join (select event_id, user_id from events) u using (event_id) cross join (select 0 as second union all select 1) s
  left join (select * from nation join region on n_regionkey = r_regionkey) d on u.user_id between d.n_nationkey * 64 and d.n_nationkey * 64 + 63
  cross join lateral (select s.second as second, case when s.second = 0 then e.event_type else 'total' end as name) x)"""


@query(f"with {_EV} {_LT} select event_id, time_s, quarter, name, array_to_string(items, '|') as items from lt")
def line_transactions(spark, sf_dir):
    """Log lines read from text files, parsed, looked up, and made transactions: one for each episode."""
    at = fresh_folder(spark, "lines")
    _lines(spark, sf_dir).select(F.concat_ws(" ", F.col("event_id").cast("string"), "value").alias("value")).write.text(at)
    lines = weblog.read(spark, at).withColumn("event_id", F.substring_index("value", " ", 1).cast("long"))
    return _flat(_line_transactions(spark, sf_dir, lines).select("event_id", "time_s", "quarter", "name", "items"))


def _streamed(spark, sf_dir) -> streaming.ExactState:
    """State of a stream of text files, two at a time."""
    at = fresh_folder(spark, "stream")
    _lines(spark, sf_dir).select("value").repartition(4).write.text(f"{at}/lines")
    state = streaming.ExactState(spark, f"{at}/state", max_len=2)
    streaming.follow(weblog.stream(spark, f"{at}/lines", 2), lambda lines: _line_transactions(spark, sf_dir, lines), state, f"{at}/checkpoint")
    return state


_STREAMED = Options(sigma=0.02, epsilon=0.016, confidence=0.1, max_len=2)
_LTS = _LT + """, li as (select tx, quarter, unnest(items) as item from lt),
voc as materialized (select item, row_number() over (order by item) as i from (select distinct item from li)),
own as materialized (select tx, i from li join tb using (quarter) join voc using (item) where bucket between 28 and 34),
size as materialized (select count(*) as n from ev join tb using (quarter) where bucket between 28 and 34),
found as materialized (select i as a, 0 as b, count(*) as support from own group by i union all select x.i, y.i, count(*) from own x join own y on x.tx = y.tx and x.i < y.i group by x.i, y.i),
sets as materialized (select a, b, support from found, size where support > ceil(round(0.02 * n, 9)))"""


@query(f"with {_EV} {_BATCH} {_LTS} select v1.item || coalesce('|' || v2.item, '') as items, support from sets join voc v1 on v1.i = a left join voc v2 on v2.i = b")
def stream_lines_itemsets(spark, sf_dir):
    """Frequent itemsets of the last week, of state that a stream of log lines was folded into."""
    state = _streamed(spark, sf_dir)
    return _flat(Analyst(_STREAMED).load(state.patterns(), state.sizes()).itemsets_of(_NEWER))


@query(f"""with {_EV} {_BATCH} {_LTS}, k as (select i as k from voc where item = 'duration:slow'), r as (select case when a = k then b else a end as x, support from sets, k where b > 0 and k in (a, b))
select item as antecedent, 'duration:slow' as consequent, r.support, round(r.support / s.support, 6) as confidence from r join sets s on s.a = x and s.b = 0 join voc on i = x where r.support / s.support >= 0.1""")
def stream_lines_rules(spark, sf_dir):
    """Rules of the last week, of the same state, for any circumstance."""
    state = _streamed(spark, sf_dir)
    a = Analyst(_STREAMED).load(state.patterns(), state.sizes())
    a.itemsets = Constraints()
    return _shown(a.mine(_NEWER))


# ---- streams


@query(f"""with {_EV} select quarter, 'episode:' || event_type as item, count(*) as support from ev
where (quarter + 1) * 900 <= (select epoch_us(max(ts)) / 1000000 - 900 from events) group by all""")
def stream_exact_replay(spark, sf_dir):
    """Closed quarters of a stream of event files; the open ones wait."""
    at, source = fresh_folder(spark, "stream"), f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # watermarks need a zoned timestamp
    try:
        events = spark.readStream.schema(schema).parquet(source + "*").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("item", I.item("episode", F.col("event_type")))
        counts = streaming.stream_quarters(events, "ts", ["item"])
        streaming.run_available(counts, lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}"), f"{at}/checkpoint")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    return spark.read.parquet(f"{at}/out").select("quarter", "item", "support")


#: Seven batches; A..F are items.
FIXTURE = [
    ["ABCD", "AB", "AC", "ABC", "AD", "ACD", "CB", "BC", "CD", "CE"],
    ["A", "A", "C", *["CAD"] * 20], ["AB"] * 20, ["AD"] * 20, ["E"], ["E"], ["F"],
]


#: What is left of them: sums of the hour of the first four, and the three quarters after it.
_HOUR = {"A": 68, "AB": 23, "AD": 43, "B": 25, "C": 29, "AC": 24, "ACD": 22, "BC": 4, "CD": 23, "D": 44}
_LEFT = [(p, 4, n) for p, n in _HOUR.items()] + [(p, b, 0) for p in _HOUR for b in (0, 1, 2)] + [("E", 0, 0), ("E", 1, 1), ("E", 2, 1), ("F", 0, 1), ("F", 1, 0), ("F", 2, 0)]


@query("select * from (values " + ", ".join(f"('{p}', {b}, {n}::bigint)" for p, b, n in _LEFT) + ") t(pattern, bucket, support)")
def stream_pruned_fixture(spark, sf_dir):
    """Windows after seven batches in pruned state."""
    state = streaming.PrunedState(spark, fresh_folder(spark, "state"), 0.4, 0.05)
    for b, batch in enumerate(FIXTURE):
        state.process(spark.createDataFrame([(i, sorted(set(t))) for i, t in enumerate(batch)], "line_id long, items array<string>"), b)
    return state.windows(len(FIXTURE) - 1).select(F.array_join(F.array_sort("pattern"), "").alias("pattern"), "bucket", "support")


#: Batches of five days for the replay of pruned state.
PRUNED = Options(sigma=0.1, epsilon=0.05, batch_seconds=5 * 86_400)


@query()
def stream_pruned_replay(spark, sf_dir):
    """Windows of pruned state after all events, in long batches; no SQL, held against the plain algorithm in the tests."""
    tx = ingested(spark, sf_dir).select("event_id", windows.quarter(F.col("time_s"), PRUNED.batch_seconds).alias("quarter"), "items")
    tx = store(windows.with_batches(tx), "batches")
    state = streaming.PrunedState(spark, fresh_folder(spark, "state"), PRUNED.sigma, PRUNED.epsilon)
    n = streaming.replay(tx, state, "event_id")
    return state.windows(n - 1).select(F.array_join(F.array_sort("pattern"), "|").alias("pattern"), "bucket", "support")


__all__ = ["QUERIES", "ORACLES", "defaults"]
