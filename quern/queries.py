"""The library's operators over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import rng
from quern.functions.proportion import design_effect, median_of, wilson
from quern.operators import annotate, association, cosine, doctor, explore, sampling, search, series, terms
from quern.operators import union as unions
from quern.plans.entries import View, adapt, select_states, signatures, validate
from quern.plans.spec import Property, TypeSpec, type_hash
from quern.sources import records
from quern.streaming import batch, handlers, stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def line_view(spark: SparkSession, d: str) -> View:
    """Order lines as entries: discount is not applicable to open lines that were not returned, tax of zero is not measured."""
    return adapt(
        table(spark, d, "lineitem"), "concat(l_orderkey, '-', l_linenumber)",
        {
            "returnflag": ("enum", "l_returnflag"), "linestatus": ("enum", "l_linestatus"), "quantity": ("integer", "cast(l_quantity as bigint)"),
            "discount": ("integer", "case when l_linestatus = 'F' or l_quantity > 40 then cast(round(l_discount * 100) as bigint) end"), "tax": ("integer", "nullif(cast(round(l_tax * 100) as bigint), 0)"),
            "shipped": ("timestamp", "date_format(l_shipdate, 'yyyy-MM-dd')"),
        },
        recorded_at="date_format(l_shipdate, 'yyyy-MM-dd')", not_applicable={"discount": "l_linestatus = 'O' and l_quantity <= 20"}, keep=("l_suppkey",),
    )


LINES = """
with lines as (
  select l_orderkey || '-' || l_linenumber as id, strftime(l_shipdate, '%Y-%m-%d') as recorded_at, l_suppkey, l_returnflag as returnflag, l_linestatus as linestatus, cast(l_quantity as bigint) as quantity,
    case when l_linestatus = 'F' or l_quantity > 40 then cast(round(l_discount * 100) as bigint) end as discount, nullif(cast(round(l_tax * 100) as bigint), 0) as tax, strftime(l_shipdate, '%Y-%m-%d') as shipped,
    l_linestatus = 'O' and l_quantity <= 20 as na_discount
  from lineitem),
long as (
  select id, 'returnflag' as property, case when returnflag is null then 'not_measured' else 'measured' end as state, returnflag as value from lines
  union all select id, 'linestatus', case when linestatus is null then 'not_measured' else 'measured' end, linestatus from lines
  union all select id, 'quantity', case when quantity is null then 'not_measured' else 'measured' end, cast(quantity as varchar) from lines
  union all select id, 'discount', case when discount is not null then 'measured' when na_discount then 'not_applicable' else 'not_measured' end, cast(discount as varchar) from lines
  union all select id, 'tax', case when tax is null then 'not_measured' else 'measured' end, cast(tax as varchar) from lines
  union all select id, 'shipped', case when shipped is null then 'not_measured' else 'measured' end, shipped from lines)
"""


@query(LINES + "select p.property, s.state, (select count(*) from long l where l.property = p.property and l.state = s.state) as n from (select distinct property from long) p, (values ('measured'), ('not_applicable'), ('not_measured'), ('not_declared')) s(state)")
def a1_profile_states(spark: SparkSession, d: str) -> DataFrame:
    return explore.profile_states(line_view(spark, d))


@query(LINES + "select count(*) as n, min(recorded_at) as first, max(recorded_at) as last from lines")
def a1_profile_entries(spark: SparkSession, d: str) -> DataFrame:
    return explore.profile_entries(line_view(spark, d))


@query(LINES + "select property, count(distinct value) as n_distinct from long where state = 'measured' group by property")
def a3_profile_distinct(spark: SparkSession, d: str) -> DataFrame:
    return explore.profile_distinct(line_view(spark, d), ["returnflag", "linestatus", "quantity", "discount", "tax", "shipped"])


@query(LINES + "select * from (select property, value, count(*) as n, row_number() over (partition by property order by count(*) desc, value) as place from long where state = 'measured' and property in ('returnflag', 'discount', 'shipped') group by property, value) where place <= 10")
def a4_profile_top_values(spark: SparkSession, d: str) -> DataFrame:
    return explore.top_values(line_view(spark, d), ["returnflag", "discount", "shipped"])


@query(LINES + "select 'quantity' as property, cast(min(quantity) as varchar) as least, cast(max(quantity) as varchar) as most from lines union all select 'shipped', min(shipped), max(shipped) from lines union all select 'discount', cast(min(discount) as varchar), cast(max(discount) as varchar) from lines")
def a5_profile_ranges(spark: SparkSession, d: str) -> DataFrame:
    return explore.profile_ranges(line_view(spark, d), ["quantity", "shipped", "discount"])


@query(LINES + "select value, case when state <> 'measured' then state end as state, count(*) as n, row_number() over (order by count(*) desc, coalesce(value, chr(65535) || state)) as place from long where property = 'discount' group by value, long.state qualify place <= 5")
def a7_group_one_key(spark: SparkSession, d: str) -> DataFrame:
    return explore.group_one(line_view(spark, d), "discount", 5)


@query(LINES + "select returnflag as a_value, cast(null as varchar) as a_state, linestatus as b_value, cast(null as varchar) as b_state, count(*) as n from lines group by returnflag, linestatus")
def a8_crosstab_returnflag_linestatus(spark: SparkSession, d: str) -> DataFrame:
    return explore.crosstab(line_view(spark, d), "returnflag", "linestatus")


@query("""
with a as (select p_brand from part group by p_brand order by count(*) desc, p_brand limit 3),
b as (select p_type from part group by p_type order by count(*) desc, p_type limit 3)
select p_brand as a_value, cast(null as varchar) as a_state, p_type as b_value, cast(null as varchar) as b_state, count(*) as n from part where p_brand in (from a) and p_type in (from b) group by p_brand, p_type""")
def a8_crosstab_topk_brand_type(spark: SparkSession, d: str) -> DataFrame:
    view = adapt(table(spark, d, "part"), "p_partkey", {"brand": ("string", "p_brand"), "type": ("string", "p_type")})
    return explore.crosstab(view, "brand", "type", 3)


@query(LINES + "select cast(tax as varchar) as value, case when tax is null then 'not_measured' end as state, l_suppkey as cluster, count(*) as n from lines group by all")
def a10_cluster_cells(spark: SparkSession, d: str) -> DataFrame:
    return explore.cluster_cells(line_view(spark, d), "tax", "l_suppkey")


@query(LINES + "select id, case when discount is not null then cast(discount as varchar) when na_discount then 'not_applicable' else 'not_measured' end as discount, coalesce(cast(tax as varchar), 'not_measured') as tax from lines where quantity > 45 and returnflag = 'R'")
def p6_filter_p9_select(spark: SparkSession, d: str) -> DataFrame:
    return select_states(line_view(spark, d).where("quantity > 45 and returnflag = 'R'"), ["discount", "tax"])


@query(LINES + "select id, property, state, value from long where property in ('discount', 'tax')")
def p11_signatures(spark: SparkSession, d: str) -> DataFrame:
    return signatures(line_view(spark, d), ["discount", "tax"])


@query("""
select event_id as id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as recorded_at, json_extract_string(props, '$.k') as k, 'measured' as k_state, event_type as kind, 'measured' as kind_state
from events""")
def p1_view_projection(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    view = adapt(made, "event_id", {"k": ("string", "k"), "kind": ("enum", "event_type")}, recorded_at="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")")
    return view.df


ORDERS = "select cast(o_orderkey as varchar) as id, strftime(o_orderdate, '%Y-%m-%d') as recorded_at, o_orderpriority as priority from orders"


def order_view(spark: SparkSession, d: str) -> View:
    return adapt(table(spark, d, "orders"), "cast(o_orderkey as string)", {"priority": ("enum", "o_orderpriority")}, recorded_at="date_format(o_orderdate, 'yyyy-MM-dd')")


@query(f"select id, recorded_at, priority, 'measured' as priority_state from ({ORDERS}) where recorded_at > '1997-03-05' or (recorded_at = '1997-03-05' and id > '5000') order by recorded_at, id limit 51")
def w1_page_keyset(spark: SparkSession, d: str) -> DataFrame:
    return explore.page(order_view(spark, d), 50, ("1997-03-05", "5000"))


@query(f"with o as ({ORDERS}), n as (select *, (row_number() over (order by recorded_at, id) - 1) // 1000 as chunk from o) select cast(chunk as bigint) as chunk, count(*) as n, min(recorded_at) as least, max(recorded_at) as most from n group by chunk")
def s17_dump_chunks(spark: SparkSession, d: str) -> DataFrame:
    return explore.dump_chunks(order_view(spark, d), 1000, ["recorded_at", "id"]).drop("characters")


SUPPLIER_YES = "select l_suppkey as cluster, count(*) as size, count(*) filter (where l_returnflag = 'R') as successes from lineitem group by l_suppkey"


@query("""
with g as (select l_returnflag as value, count(*) as n, count(*) filter (where l_linestatus = 'F') as s from lineitem group by l_returnflag),
w as (select value, n, s, s::double / n as p, 1.959963984540054 as z from g)
select value, n, s as successes, round(p, 6) as p, round(greatest(0, least(p, (p + z*z/(2*n)) / (1 + z*z/n) - z / (1 + z*z/n) * sqrt(p*(1-p)/n + z*z/(4.0*n*n)))), 6) as lower,
  round(least(1, greatest(p, (p + z*z/(2*n)) / (1 + z*z/n) + z / (1 + z*z/n) * sqrt(p*(1-p)/n + z*z/(4.0*n*n)))), 6) as upper from w""")
def t1_wilson(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("value")).agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("successes"))
    w = wilson(F.col("successes"), F.col("n"))
    return rounded(g.select("value", "n", "successes", w["p"].alias("p"), w["lower"].alias("lower"), w["upper"].alias("upper")), "p", "lower", "upper")


@query(f"""
with c as ({SUPPLIER_YES}), s as (select count(*) as k, sum(size)::double as n, sum(successes)::double as y, sum(size::double*size) as m2, sum(successes::double*successes/size) as b, sum(successes - successes::double*successes/size) as w from c),
m as (select *, (b - y*y/n) / (k-1) as msb, w / (n-k) as msw, (n - m2/n) / (k-1) as m0 from s),
r as (select *, greatest(0, least(1, (msb - msw) / (msb + (m0-1)*msw))) as rho from m)
select k as clusters, cast(n as bigint) as n, cast(y as bigint) as successes, round(rho, 6) as rho, round(1 + (m2/n - 1)*rho, 6) as deff from r""")
def t2_design_effect(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("cluster")).agg(F.count("*").alias("size"), F.count_if(F.col("l_returnflag") == "R").alias("successes"))
    out = design_effect(g).withColumn("n", F.col("n").cast("long")).withColumn("successes", F.col("successes").cast("long"))
    return rounded(out, "rho", "deff")


ASSOC_TABLES = """
with base as (select o_orderstatus as status, o_orderpriority as priority, c_mktsegment as segment, cast(c_nationkey as varchar) as nation from orders join customer on o_custkey = c_custkey),
pairs as (
  select 'status' as a, 'priority' as b, status as va, priority as vb from base union all select 'status', 'segment', status, segment from base union all select 'status', 'nation', status, nation from base
  union all select 'priority', 'segment', priority, segment from base union all select 'priority', 'nation', priority, nation from base union all select 'segment', 'nation', segment, nation from base),
cells as (select a, b, va, vb, count(*) as n from pairs group by all),
ma as (select a, b, va, sum(n) as ra from cells group by all), mb as (select a, b, vb, sum(n) as rb from cells group by all), t as (select a, b, sum(n)::double as t from cells group by all),
grid as (select ma.a, ma.b, ma.va, mb.vb, ra * rb / t.t as e, coalesce(n, 0) as o, t.t from ma join mb on ma.a = mb.a and ma.b = mb.b join t on ma.a = t.a and ma.b = t.b left join cells c on c.a = ma.a and c.b = ma.b and c.va = ma.va and c.vb = mb.vb),
chi as (select a, b, any_value(t) as t, sum((o - e) * (o - e) / e) as chi2, min(e) as least_expected, count(distinct va) as r, count(distinct vb) as c, sum(case when o > 0 then o / t * log2(o * t / (e * t)) else 0 end) as bits from grid group by a, b),
ha as (select a, b, -sum(ra / t * log2(ra / t)) as h from ma join t using (a, b) group by a, b), hb as (select a, b, -sum(rb / t * log2(rb / t)) as h from mb join t using (a, b) group by a, b)"""

ASSOC = ASSOC_TABLES + """
select chi.a, chi.b, cast(t as bigint) as n, r as rows, c as cols, round(chi2, 4) as chi2, (r - 1) * (c - 1) as df, round(sqrt(chi2 / (t * (least(r, c) - 1))), 6) as v, round(bits, 6) as bits,
  round(least(1, 2 * bits / (ha.h + hb.h)), 6) as uncertainty, round(least(1, bits / hb.h), 6) as a_tells_b, round(least(1, bits / ha.h), 6) as b_tells_a, round(least_expected, 4) as least_expected
from chi join ha using (a, b) join hb using (a, b)"""


def assoc_base(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), "o_orderkey")


@query(ASSOC)
def t3_association_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = association.pair_statistics(association.pair_counts(assoc_base(spark, d), ["status", "priority", "segment", "nation"]))
    s = s.drop("pair", "definitional", "v_corrected").withColumn("chi2", F.round("chi2", 4)).withColumn("least_expected", F.round("least_expected", 4))
    return rounded(s, "v", "bits", "uncertainty", "a_tells_b", "b_tells_a")


#: The tail of chi-square as the Poisson sum that it equals for an even number of degrees, which these columns' sizes always give.
RANKED = ASSOC_TABLES + """,
s as (select chi.a, chi.b, t, r, c, chi2, (r - 1) * (c - 1) as df, greatest(0, chi2 / t - (r - 1) * (c - 1) / (t - 1)) as phi, least(r - (r - 1)**2 / (t - 1), c - (c - 1)**2 / (t - 1)) - 1 as under,
  bits, least(1, 2 * bits / (ha.h + hb.h)) as uncertainty, least(1, bits / hb.h) as a_tells_b, least(1, bits / ha.h) as b_tells_a, least_expected from chi join ha using (a, b) join hb using (a, b)),
p as (select *, list_sum(list_transform(range(0, df // 2), lambda k: exp(k * ln(chi2 / 2) - chi2 / 2 - lgamma(k + 1)))) as p from s where greatest(a_tells_b, b_tells_a) < 0.5),
ranked as (select *, count(*) over () * p / count(*) over (order by p) as q from p)
select a, b, cast(t as bigint) as n, r as rows, c as cols, round(chi2, 4) as chi2, df, round(sqrt(chi2 / (t * (least(r, c) - 1))), 6) as v, round(sqrt(phi / under), 6) as v_corrected, round(bits, 6) as bits,
  round(uncertainty, 6) as uncertainty, round(a_tells_b, 6) as a_tells_b, round(b_tells_a, 6) as b_tells_a, round(least_expected, 4) as least_expected, round(p, 6) as p,
  round(least(1, min(q) over (order by p desc)), 6) as p_adjusted
from ranked"""


@query(RANKED)
def t10_rank_associations(spark: SparkSession, d: str) -> DataFrame:
    s = association.rank_associations(assoc_base(spark, d), ["status", "priority", "segment", "nation"])
    s = s.drop("pair", "definitional").withColumn("chi2", F.round("chi2", 4)).withColumn("least_expected", F.round("least_expected", 4))
    return rounded(s, "v", "v_corrected", "bits", "uncertainty", "a_tells_b", "b_tells_a", "p", "p_adjusted")


@query()
def t7_permutation_control(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("weekday", series.weekday(F.col("ts"))).withColumn("large", (F.col("value") > 50).cast("string"))
    return association.permutation_control(events, ["event_type", "weekday", "large"], ["event_id"])


@query("""
with p as (select n_nationkey as id, round((n_nationkey * 37 % 25 + 1) / 200.0, 6) as p from nation), m as (select *, row_number() over (order by p) as r, count(*) over () as m from p)
select id, p, round(least(1.0, min(m * p / r) over (order by p desc rows unbounded preceding)), 6) as p_adjusted from m""")
def t9_benjamini_hochberg(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.round((F.col("n_nationkey") * 37 % 25 + 1) / 200.0, 6).alias("p"))
    return rounded(association.benjamini_hochberg(p), "p_adjusted")


RULE_ITEMS = """
with items as (
  select cast(o_orderkey as varchar) as id, 'priority=' || o_orderpriority as item from orders union all select cast(o_orderkey as varchar), 'status=' || o_orderstatus from orders
  union all select cast(o_orderkey as varchar), 'segment=' || c_mktsegment from orders join customer on o_custkey = c_custkey),
n as (select count(distinct id) as n from items), one as (select item, count(*) as c from items group by item)"""

RULES = RULE_ITEMS + """,
two as (select a.item as x, b.item as y, count(*) as c from items a join items b on a.id = b.id and a.item <> b.item group by all)
select x as antecedent, y as consequent, two.c as support, ox.c as n_antecedent, oy.c as n_consequent, n.n, round(two.c::double / ox.c, 6) as confidence, round(two.c::double / ox.c / (oy.c::double / n.n), 6) as lift
from two join one ox on ox.item = x join one oy on oy.item = y, n where two.c >= 20"""


def order_items(spark: SparkSession, d: str) -> DataFrame:
    base = assoc_base(spark, d)
    return base.select(F.col("o_orderkey").alias("id"), F.explode(F.array(F.concat(F.lit("priority="), "priority"), F.concat(F.lit("status="), "status"), F.concat(F.lit("segment="), "segment"))).alias("item"))


@query(RULES)
def t11_association_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = association.association_rules(order_items(spark, d), most=2)
    out = rules.select(F.col("antecedent")[0].alias("antecedent"), "consequent", "support", "n_antecedent", "n_consequent", "n", "confidence", "lift")
    return rounded(out, "confidence", "lift")


RULES_OF_THREE = RULE_ITEMS + """,
single as (select a.item as antecedent, b.item as consequent, count(*) as support from items a join items b on a.id = b.id and a.item <> b.item group by all having count(*) >= 20),
pair as (select a.item as x, b.item as y, count(*) as c from items a join items b on a.id = b.id and a.item < b.item group by all),
double as (select a.item as x, b.item as y, c.item as consequent, count(*) as support from items a join items b on a.id = b.id and a.item < b.item join items c on c.id = a.id and c.item not in (a.item, b.item) group by all having count(*) >= 20),
rules as (
  select antecedent, consequent, support, c as n_antecedent, cast(null as double) as best from single join one on item = antecedent
  union all select d.x || ' & ' || d.y, d.consequent, d.support, pair.c, greatest(sx.support::double / ox.c, sy.support::double / oy.c)
  from double d join pair on pair.x = d.x and pair.y = d.y join single sx on sx.antecedent = d.x and sx.consequent = d.consequent join single sy on sy.antecedent = d.y and sy.consequent = d.consequent
    join one ox on ox.item = d.x join one oy on oy.item = d.y),
v as (select antecedent, consequent, support, n_antecedent, one.c as n_consequent, n.n as n, support::double / n_antecedent as p, 1.959963984540054 as z, one.c::double / n.n as base, best from rules join one on one.item = consequent, n),
w as (select *, (p + z * z / (2 * n_antecedent)) / (1 + z * z / n_antecedent) as centre, z / (1 + z * z / n_antecedent) * sqrt(p * (1 - p) / n_antecedent + z * z / (4.0 * n_antecedent * n_antecedent)) as half from v)
select antecedent, consequent, support, n_antecedent, n_consequent, n, round(p, 6) as confidence, round(greatest(0, least(p, centre - half)), 6) as lower, round(least(1, greatest(p, centre + half)), 6) as upper,
  round(p / base, 6) as lift, greatest(0, least(p, centre - half)) > base as informative, p > greatest(coalesce(best, 0), base) as productive
from w"""


@query(RULES_OF_THREE)
def t11_association_rules_of_three(spark: SparkSession, d: str) -> DataFrame:
    rules = association.association_rules(order_items(spark, d)).withColumn("antecedent", F.array_join("antecedent", " & "))
    return rounded(rules, "confidence", "lower", "upper", "lift")


@query("select strftime(g.d, '%Y-%m-%d') as label, coalesce(n, 0) as n from (select unnest(generate_series(min(ts)::date, max(ts)::date, interval 1 day)) as d from events) g left join (select ts::date as day, count(*) as n from events group by 1) e on e.day = g.d::date")
def a19_rate_series_daily(spark: SparkSession, d: str) -> DataFrame:
    return series.rate_series(table(spark, d, "events"), "ts")


@query("select strftime(g.d, '%Y-%m-%d') as label, coalesce(n, 0) as n from (select unnest(generate_series(min(date_trunc('week', o_orderdate))::date, max(date_trunc('week', o_orderdate))::date, interval 7 day)) as d from orders) g left join (select date_trunc('week', o_orderdate)::date as w, count(*) as n from orders group by 1) e on e.w = g.d::date")
def a19_rate_series_weekly(spark: SparkSession, d: str) -> DataFrame:
    return series.rate_series(table(spark, d, "orders"), "o_orderdate", "week")


def priority_series(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM").alias("label")).agg(F.count("*").cast("double").alias("value"))


@query("""
with s as (select o_orderpriority as series, strftime(o_orderdate, '%Y-%m') as label, count(*)::double as value from orders group by all),
net as (select a.series, a.label, sum(sign(a.value - b.value)) as net, count(*) as n from s a join s b on a.series = b.series group by all),
u as (select series, label, n, sum(net) over (partition by series order by label) as u, row_number() over (partition by series order by label) as i from net),
best as (select series, n, label, abs(u) as k, row_number() over (partition by series order by abs(u) desc, i) as r from u where i < n)
select series, n, label as at, k::double as statistic, round(least(1, 2 * exp(-6.0 * k * k / (n::double * n * n + n * n))), 6) as p from best where r = 1""")
def t12_pettitt(spark: SparkSession, d: str) -> DataFrame:
    return rounded(series.change_points(priority_series(spark, d)).drop("p_adjusted"), "p")


@query()
def t13_cusum(spark: SparkSession, d: str) -> DataFrame:
    return series.change_points(priority_series(spark, d), "cusum")


@query("""
with l as (select user_id, event_type as v, row_number() over (partition by user_id order by ts, event_id) as i, lag(event_type) over (partition by user_id order by ts, event_id) as p from events),
r as (select *, sum(case when p is null or p <> v then 1 else 0 end) over (partition by user_id order by i) as run from l),
runs as (select user_id, run, v, count(*) as n from r group by all), counts as (select user_id, v, sum(n) as c from runs group by all),
per as (select user_id, sum(c) as size, 1 + (sum(c) - 1) * (1 - sum((c / (select sum(n) from runs x where x.user_id = counts.user_id)) ** 2)) as e from counts group by user_id)
select cast((select sum(n) from runs) as bigint) as rows, (select count(distinct user_id) from runs) as partitions, (select count(*) from runs) as runs, (select max(n) from runs) as longest, round((select sum(e) from per), 4) as expected_runs,
  round((select sum(n) from runs) / (select count(*) from runs), 6) as rows_per_run, round((select count(*) from runs) / (select sum(e) from per), 6) as runs_per_expected, (select sum(n) from runs) / (select count(*) from runs) >= 2 as state_like""")
def w5_run_structure(spark: SparkSession, d: str) -> DataFrame:
    out = series.run_structure(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])
    return rounded(out.withColumn("expected_runs", F.round("expected_runs", 4)), "rows_per_run", "runs_per_expected")


@query("select event_id, user_id, event_type from (select *, lag(event_type) over w as p, row_number() over w as i from events window w as (partition by user_id order by ts, event_id)) where i = 1 or p is distinct from event_type")
def w9_first_of_runs(spark: SparkSession, d: str) -> DataFrame:
    return series.first_of_runs(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("""
select conv_id, turn, row_number() over w - 1 as seq, cast(sum(case when role = 'system' then 1 else 0 end) over w as bigint) as segment, cast(sum(case when role = 'assistant' then 1 else 0 end) over w as bigint) as call
from conversations window w as (partition by conv_id order by turn, role, text rows unbounded preceding)""")
def w11_w12_turn_numbering(spark: SparkSession, d: str) -> DataFrame:
    out = series.number_turns(table(spark, d, "conversations"), "conv_id", ["turn", "role", "text"], F.col("role") == "system", F.col("role") == "assistant")
    return out.select("conv_id", "turn", F.col("seq").cast("long").alias("seq"), "segment", "call")


@query("select event_id from (select event_id, row_number() over (order by ts, event_id) - 1 as i, count(*) over () as n from events) where i in (select k * n // 40 from range(40) t(k))")
def w7_spread_sample(spark: SparkSession, d: str) -> DataFrame:
    return series.spread_sample(table(spark, d, "events").select("ts", "event_id"), 40, ["ts", "event_id"]).select("event_id")


LABELS = "with ann as (select doc_id as entry_id, case when quality = 0 then 'low' else 'high' end as label, 1 as t from labels union all select doc_id, 'toxic', 2 from labels where toxic = 1)"


def label_annotations(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    first = labels.select(F.col("doc_id").alias("entry_id"), F.when(F.col("quality") == 0, "low").otherwise("high").alias("label"), F.lit(1).alias("at"))
    return first.unionByName(labels.filter("toxic = 1").select(F.col("doc_id").alias("entry_id"), F.lit("toxic").alias("label"), F.lit(2).alias("at")))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumnRenamed("doc_id", "id")


@query(LABELS + " select entry_id, max_by(label, t) as label from ann group by entry_id")
def p4_latest_label(spark: SparkSession, d: str) -> DataFrame:
    return annotate.latest_labels(label_annotations(spark, d), ["at"])


@query(LABELS + " select label, count(*) as n from (select entry_id, max_by(label, t) as label from ann group by entry_id) group by label")
def a6_invalidated_counts(spark: SparkSession, d: str) -> DataFrame:
    return annotate.invalidated_counts(label_annotations(spark, d), ["at"])


@query("select doc_id as id, lang, source from documents where doc_id in (select doc_id from labels where toxic = 1)")
def p5_struck(spark: SparkSession, d: str) -> DataFrame:
    return annotate.struck(documents(spark, d).select("id", "lang", "source"), label_annotations(spark, d).filter("label = 'toxic'"))


@query("select doc_id as id, lang, source from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def p5_standing(spark: SparkSession, d: str) -> DataFrame:
    return annotate.standing(documents(spark, d).select("id", "lang", "source"), label_annotations(spark, d).filter("label = 'toxic'"))


@query(LABELS + """, inside as (select distinct entry_id, label from ann where entry_id in (select doc_id from documents)), c as (select count(*) as c from documents), l as (select count(distinct entry_id) as n from inside)
select label, count(*) as n from inside group by label union all select 'considered', c from c union all select 'labelled', n from l union all select 'unclassified', c - n from c, l""")
def a11_scheme_census(spark: SparkSession, d: str) -> DataFrame:
    return annotate.census(documents(spark, d), label_annotations(spark, d))


@query("""
with r as (select 1 - quality as a, toxic as b from labels), s as (select count(*)::double as n, count(*) filter (where a = b) as agree, (sum(a)::double * sum(b) + sum(1 - a)::double * sum(1 - b)) as products from r)
select cast(n as bigint) as n, 0 as only_a, 0 as only_b, agree, round(agree / n, 6) as observed, round(products / (n * n), 6) as expected, round((agree / n - products / (n * n)) / (1 - products / (n * n)), 6) as kappa from s""")
def n10_kappa(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    a, b = labels.select(F.col("doc_id").alias("id"), (1 - F.col("quality")).cast("string").alias("label")), labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("string").alias("label"))
    return rounded(annotate.kappa(a, b).withColumn("only_a", F.col("only_a").cast("int")).withColumn("only_b", F.col("only_b").cast("int")), "observed", "expected", "kappa")


LENGTH_RULE = "case when n_chars < 200 then '0' else '1' end"


@query(f"""
with b as (select cast(quality as varchar) as t, {LENGTH_RULE} as p from labels join documents using (doc_id))
select l.label, count(*) filter (where t = l.label) as support, count(*) filter (where p = l.label) as predicted, count(*) filter (where t = l.label and p = l.label) as hits,
  round(count(*) filter (where t = l.label and p = l.label)::double / nullif(count(*) filter (where p = l.label), 0), 6) as precision, round(count(*) filter (where t = l.label and p = l.label)::double / nullif(count(*) filter (where t = l.label), 0), 6) as recall
from b, (values ('0'), ('1')) l(label) group by l.label""")
def n7_backtest_length_rule(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    truth = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("label")).join(docs.select("id"), "id", "left_semi")
    found = annotate.backtest(truth, docs.select("id", F.expr(LENGTH_RULE).alias("label")))
    out = found.select("label", "support", "predicted", "hits", F.col("precision.p").alias("precision"), F.col("recall.p").alias("recall"))
    return rounded(out, "precision", "recall")


@query("select doc_id as id, ('0x' || substr(sha256('quern' || chr(0) || doc_id), 1, 8))::bigint / 4294967296.0 < 0.2 as held_out from documents")
def n8_holdout_split(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("id", rng.is_held_out(F.col("id").cast("string"), 0.2).alias("held_out"))


@query("select user_id, case when ('0x' || substr(sha256('holdout-arm' || chr(0) || user_id || chr(0) || 'nudge' || chr(0) || '3'), 1, 8))::bigint / 4294967296.0 < 0.5 then 'held_out' else 'delivered' end as arm from (select distinct user_id from events)")
def n9_arms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id").distinct().withColumn("arm", rng.arm_of(F.col("user_id").cast("string"), "nudge", 3, 0.5))


ANNOTATE_RULES = [{"label": "short", "kind": "sql", "query": "n_chars < 300"}, {"label": "license", "kind": "fts", "query": "license copyright"}, {"label": "german", "kind": "sql", "query": "lang = 'de'"}]


@query("select doc_id as id, case when n_chars < 300 then 'short' when contains(lower(text), 'license') or contains(lower(text), 'copyright') then 'license' else 'german' end as label from documents where n_chars < 300 or contains(lower(text), 'license') or contains(lower(text), 'copyright') or lang = 'de'")
def n3_annotate_first_rule_wins(spark: SparkSession, d: str) -> DataFrame:
    return annotate.apply_rules(documents(spark, d).withColumnRenamed("text", "evidence_text"), ANNOTATE_RULES)


SEARCH = "apache license warranty"


@query("select count(*) as documents, count(text) as indexed, count(*) filter (where contains(lower(text), 'apache') or contains(lower(text), 'license') or contains(lower(text), 'warranty')) as matched from documents")
def f4_count_matches(spark: SparkSession, d: str) -> DataFrame:
    return search.count_matches(table(spark, d, "documents"), SEARCH)


@query("""
with t as (select unnest(['apache', 'license', 'warranty']) as term), x as (select doc_id, lower(text) as lt, greatest(length(text) - 2, 0) as size from documents where text is not null),
s as (select count(*) as n, avg(size) as mean from x), f as (select term, (select count(*) from x where contains(lt, term)) as df from t),
o as (select doc_id, size, term, (length(lt) - length(replace(lt, term, ''))) / length(term) as tf from x, t)
select doc_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) as score
from o join f using (term), s group by doc_id having sum(tf) > 0 order by score desc, doc_id limit 20""")
def f3_search_bm25(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.search(table(spark, d, "documents"), SEARCH, "doc_id"), "score")


@query("select * from (select property, value, count(*) as n from (select 'type' as property, p_type as value from part union all select 'name', p_name from part) where contains(lower(value), 'promo') or contains(lower(value), 'econ') group by all order by n desc, property, value limit 5)")
def a15_property_value_matches(spark: SparkSession, d: str) -> DataFrame:
    view = adapt(table(spark, d, "part"), "p_partkey", {"type": ("string", "p_type"), "name": ("string", "p_name")})
    return search.property_value_matches(signatures(view, ["type", "name"]), "promo econ")


TOKENS = "unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t <> '')) as term"


@query(f"""
with w as (select lang as g, {TOKENS} from documents), c as (select g, term, count(*) as n from w group by all), bg as (select term, sum(n) as corpus from c group by term having sum(n) >= 50),
sz as (select g, sum(n) as size from c group by g), t as (select sum(n) as t, (select count(*) from bg)::double as a0 from c),
cells as (select sz.g, bg.term, coalesce(c.n, 0) as inside, corpus - coalesce(c.n, 0) as outside, a0 * corpus / t as alpha, size, t, a0 from bg cross join sz cross join t left join c on c.g = sz.g and c.term = bg.term),
xy as (select *, inside + alpha as x, outside + alpha as y from cells)
select g as "group", term, cast(inside as bigint) as inside, cast(outside as bigint) as outside, round(ln(x / (size + a0 - x)) - ln(y / (t - size + a0 - y)), 5) as log_odds, round((ln(x / (size + a0 - x)) - ln(y / (t - size + a0 - y))) / sqrt(1 / x + 1 / y), 5) as z from xy""")
def t21_distinctive_terms(spark: SparkSession, d: str) -> DataFrame:
    found = terms.distinctive_terms(table(spark, d, "documents"), "lang", least=50)
    return found.select("group", "term", "inside", "outside", F.round("log_odds", 5).alias("log_odds"), F.round("z", 5).alias("z"))


@query(f"""
with w as (select lang as g, {TOKENS} from documents), c as (select g, term, count(*) as n from w group by all), bg as (select term, sum(n) as corpus from c group by term having sum(n) >= 2),
sz as (select g, sum(n) as size from c group by g), t as (select sum(n) as t, (select count(*) from bg)::double as a0 from c),
cells as (select sz.g, bg.term, coalesce(c.n, 0) as inside, corpus - coalesce(c.n, 0) as outside, a0 * corpus / t as alpha, size, t, a0 from bg cross join sz cross join t left join c on c.g = sz.g and c.term = bg.term),
xy as (select *, inside + alpha as x, outside + alpha as y from cells)
select g as "group", term, cast(inside as bigint) as inside, cast(outside as bigint) as outside, round(ln(x / (size + a0 - x)) - ln(y / (t - size + a0 - y)), 5) as log_odds, round((ln(x / (size + a0 - x)) - ln(y / (t - size + a0 - y))) / sqrt(1 / x + 1 / y), 5) as z from xy""")
def t21_distinctive_terms_all(spark: SparkSession, d: str) -> DataFrame:
    """The default family: every term that occurs twice or more."""
    found = terms.distinctive_terms(table(spark, d, "documents"), "lang")
    return found.select("group", "term", "inside", "outside", F.round("log_odds", 5).alias("log_odds"), F.round("z", 5).alias("z"))


TFIDF = f"""
with w as (select item_id as id, {TOKENS} from benchmark), tf as (select id, term, count(*) as c from w group by all), df as (select term, count(*) as df from tf group by term), n as (select count(*)::double as n from benchmark),
x as (select id, term, (1 + ln(c)) * ln(n / df) as w from tf join df using (term), n where df < n), nm as (select id, sqrt(sum(w * w)) as norm from x group by id), v as (select id, term, w / norm as weight from x join nm using (id))"""


@query(TFIDF + " select id, term, round(weight, 6) as weight from v")
def t15_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(terms.tfidf(table(spark, d, "benchmark"), "item_id"), "weight")


@query(TFIDF + " select a.id as a, b.id as b, round(sum(a.weight * b.weight), 6) as cosine from v a join v b on a.term = b.term and a.id <> b.id where a.id % 50 = 0 group by all")
def t16_cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cosine.cosine_pairs(table(spark, d, "benchmark"), F.expr("item_id % 50 = 0"), "item_id", digits=6)


TFIDF_DOCUMENTS = f"""
with w as (select doc_id as id, {TOKENS} from documents), tf as (select id, term, count(*) as c from w group by all), df as (select term, count(*) as df from tf group by term), n as (select count(*)::double as n from documents),
x as (select id, term, (1 + ln(c)) * ln(n / df) as w from tf join df using (term), n where df < n), nm as (select id, sqrt(sum(w * w)) as norm from x group by id), v as (select id, term, w / norm as weight from x join nm using (id))"""


@query(TFIDF_DOCUMENTS + " select id, term, round(weight, 6) as weight from v")
def t15_tfidf_documents(spark: SparkSession, d: str) -> DataFrame:
    return rounded(terms.tfidf(table(spark, d, "documents"), "doc_id"), "weight")


@query(TFIDF_DOCUMENTS + " select a.id as a, b.id as b, round(sum(a.weight * b.weight), 6) as cosine from v a join v b on a.term = b.term and a.id <> b.id where a.id % 50 = 0 group by all")
def t16_cosine_pairs_documents(spark: SparkSession, d: str) -> DataFrame:
    return cosine.cosine_pairs(table(spark, d, "documents"), F.expr("doc_id % 50 = 0"), "doc_id", digits=6)


@query("""
with recursive t as (select doc_id as id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t <> '') as t from documents),
s as (select id, len(t) as n_tokens, case when len(t) > 3 then list_distinct(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' '))) when len(t) > 0 then [array_to_string(t, ' ')] else [] end as shingles from t),
x as (select id, len(shingles) as n, unnest(shingles) as s from s),
e as materialized (select a.id as a, b.id as b from x a join x b on a.s = b.s and a.id <> b.id and least(a.n, b.n) >= 0.9 * greatest(a.n, b.n) - 1e-9 group by a.id, b.id, a.n, b.n having count(*)::double / (a.n + b.n - count(*)) >= 0.9),
r as (select id, id as g from s union select r.id, e.b from r join e on e.a = r.g),
c as (select id, min(g) as g from r group by id)
select id, g as "group", first_value(id) over (partition by g order by n_tokens desc, id) as representative from c join s using (id)""")
def t20_collapse_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return terms.collapse_near_duplicates(table(spark, d, "documents"), "doc_id")


@query()
def t17_cluster_documents(spark: SparkSession, d: str) -> DataFrame:
    return terms.cluster_documents(table(spark, d, "benchmark"), "item_id", threshold=0.9)


OUTLIER_COLUMNS = ["event_type", "weekday"]


@query("""
with e as (select event_id, event_type, strftime(ts, '%a') as weekday from events), n as (select count(*)::double as n from e), a as (select event_type, count(*) as c from e group by 1), b as (select weekday, count(*) as c from e group by 1)
select event_id, round(-ln(a.c / n) - ln(b.c / n), 6) as score from e join a using (event_type) join b using (weekday), n order by score desc, event_id limit 50""")
def r5_outlier_sample(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("weekday", series.weekday(F.col("ts")))
    scores = rounded(sampling.outlier_scores(events, "event_id", OUTLIER_COLUMNS), "score")
    return scores.orderBy(F.desc("score"), "event_id").limit(50)


@query()
def r1_random_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.random_sample(table(spark, d, "orders"), "o_orderkey", 100)


@query()
def r2_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_sample(table(spark, d, "orders"), "o_orderkey", "o_orderpriority", 100)


@query("""
with recursive heads as (select p_brand as b, p_size as s, min(p_partkey) as id from part group by all),
r as (
  select 0 as step, cast([] as varchar[]) as covered, cast(null as bigint) as id
  union all select step + 1, list_concat(covered, ['b' || heads.b, 's' || heads.s]), heads.id from r, heads where step < 60 and not list_has_all(covered, ['b' || heads.b, 's' || heads.s])
  qualify row_number() over (order by list_contains(covered, 'b' || heads.b)::int + list_contains(covered, 's' || heads.s)::int, heads.id) = 1)
select * from part where p_partkey in (select id from r where id is not null)""")
def r4_diverse_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.diverse_sample(table(spark, d, "part"), "p_partkey", ["p_brand", "p_size"], 60)


@query("select event_type, coalesce(median(value), 0) as median_value from events group by event_type")
def t23_median(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(median_of(F.col("value")).alias("median_value"))


@query("select o_orderstatus as project, o_orderkey as id, strftime(o_orderdate, '%Y-%m-%d') as recorded_at, o_orderpriority as priority from orders where o_orderstatus in ('F', 'O')")
def u1_union_projects(spark: SparkSession, d: str) -> DataFrame:
    spec = TypeSpec("order", (Property("priority", "enum", enum_values=("1-URGENT",)),))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("recorded_at"), F.col("o_orderpriority").alias("priority"), "o_orderstatus").withColumn("type_hash", F.lit(type_hash(spec)))
    projects = {s: orders.filter(F.col("o_orderstatus") == s).drop("o_orderstatus") for s in ("F", "O")}
    return unions.union_entries(projects, type_hash(spec)).drop("type_hash")


@query()
def t18_clustering_null(spark: SparkSession, d: str) -> DataFrame:
    return terms.clustering_null(table(spark, d, "benchmark"), "item_id", threshold=0.9)


EVENT_SPEC = TypeSpec("event", (Property("k", "integer", True), Property("kind", "enum", enum_values=("view", "click", "purchase")), Property("value", "duration")))


@query("""
with e as (select event_id as id, event_type not in ('view', 'click', 'purchase') as bad_kind, value < 0 as bad_value, event_id % 5 = 0 as no_k from events)
select id, cast(bad_kind as int) + cast(coalesce(bad_value, false) as int) + cast(no_k as int) as errors, 0 as warnings from e""")
def p15_validate(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    k = F.when(F.col("event_id") % 5 != 0, F.get_json_object("props", "$.k").cast("long"))
    rows = events.select(F.col("event_id").alias("id"), F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("kind"), "value")).alias("properties_json"), F.lit("[]").alias("na_json"))
    return validate(rows, EVENT_SPEC).select("id", F.size("errors").alias("errors"), F.size("warnings").alias("warnings"))


@query("select text, count(*) as n from documents where text is not null group by text having count(*) > 1")
def u4_repeated_records(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "documents").select(F.col("text").alias("id"), "doc_id").filter("id is not null")
    return unions.collapse_exact(both)[1].withColumnRenamed("id", "text")


@query("select doc_id as id from documents where doc_id not in (select doc_id from labels)")
def s21_lost_ids(spark: SparkSession, d: str) -> DataFrame:
    return unions.lost_ids(documents(spark, d), table(spark, d, "labels").withColumnRenamed("doc_id", "id"))


@query("select 'entry' as kind, cast(event_id as varchar) as id, event_type as event_type, user_id from events")
def s9_s15_lines_round_trip(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), "event_type", "user_id")
    back = F.from_json("line", "event_type string, user_id long")
    return records.to_lines(events).withColumn("b", back).select("kind", "id", "b.event_type", "b.user_id")


@query("select doc_id as id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t <> '')[1] as first, len(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t <> '')) as n from documents")
def t25_tokenize(spark: SparkSession, d: str) -> DataFrame:
    t = search.tokens(F.col("text"))
    return documents(spark, d).select("id", F.get(t, 0).alias("first"), F.size(t).cast("long").alias("n"))


@query(LABELS + ", a as (select 'quality' as scheme, 1 as scheme_version, t as created_at from ann) select scheme, scheme_version, created_at, count(*) as n from a group by all")
def a12_annotation_passes(spark: SparkSession, d: str) -> DataFrame:
    made = label_annotations(spark, d).select(F.lit("quality").alias("scheme"), F.lit(1).alias("scheme_version"), F.col("at").alias("created_at"))
    return annotate.passes(made)


@query("select cast(doc_id as varchar)[1:1] as version, count(*) as n from documents where doc_id not in (select doc_id from labels where toxic = 1) group by 1")
def a13_open_by_version(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).withColumn("id", F.col("id").cast("string"))
    gone = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("entry_id"))
    return doctor.open_by_version(docs, gone, 1, 1)


@query("select 'lang' as identity, lang as value, count(distinct doc_id) as lines from documents group by lang union all select 'source', source, count(distinct doc_id) from documents group by source")
def a17_identity_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return doctor.identity_vocabulary(table(spark, d, "documents").withColumnRenamed("doc_id", "line"), ["lang", "source"])


@query("select event_type as type_name, user_id % 3 as type_version, count(*) as n, strftime(min(ts), '%Y-%m-%d') as first, strftime(max(ts), '%Y-%m-%d') as last from events group by all")
def n12_version_drift(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("event_type").alias("type_name"), (F.col("user_id") % 3).alias("type_version"), F.date_format("ts", "yyyy-MM-dd").alias("recorded_at"))
    return doctor.version_drift(events)


# Streams of the events table: one per user, every event a call, errors as ends of a unit.


def user_stream(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("session_id"), F.lit("main").alias("agent_id"), F.row_number().over(w).cast("long").alias("seq"), F.col("event_type").alias("kind"), F.row_number().over(w).cast("long").alias("call"),
        F.col("value").cast("double").alias("value"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("event_id").cast("string").alias("id"),
    )
    return events


STREAM_SQL = "with s as (select cast(user_id as varchar) as session_id, 'main' as agent_id, row_number() over (partition by user_id order by ts, event_id) as seq, event_type as kind, value, cast(event_id as varchar) as id from events)"


def emit(spark: SparkSession, d: str, program: dict) -> DataFrame:
    return batch.run(user_stream(spark, d), handlers.parse(program))


@query(STREAM_SQL + ", j as (select t.session_id, t.agent_id, t.seq, t.id, (select min(m.seq) from s m where m.session_id = t.session_id and m.kind = 'purchase' and m.seq > t.seq) as m, (select min(u.seq) from s u where u.session_id = t.session_id and u.kind = 'error' and u.seq > t.seq) as u from s t where t.kind = 'view') select j.session_id, j.agent_id, j.seq, j.id as trigger, s.id as match from j join s on s.session_id = j.session_id and s.seq = j.m where j.u is null or j.m < j.u")
def j11_handler_first(spark: SparkSession, d: str) -> DataFrame:
    return emit(spark, d, {"on": "view", "window": {"until": "error", "first": {"on": "purchase"}}, "emit": {"trigger": "${id}", "match": "${match.id}"}})


@query(STREAM_SQL + ", j as (select t.session_id, t.agent_id, t.seq, t.id, (select min(u.seq) from s u where u.session_id = t.session_id and u.kind = 'signup' and u.seq > t.seq) as u from s t where t.kind = 'view') select session_id, agent_id, seq, id as trigger from j where u is not null and not exists (select 1 from s m where m.session_id = j.session_id and m.kind = 'error' and m.seq > j.seq and m.seq < j.u)")
def j12_handler_absent(spark: SparkSession, d: str) -> DataFrame:
    return emit(spark, d, {"on": "view", "window": {"until": "signup", "absent": {"on": "error"}}, "emit": {"trigger": "${id}"}})


@query(STREAM_SQL + ", j as (select t.session_id, t.agent_id, t.seq, t.id, (select count(*) from s m where m.session_id = t.session_id and m.kind = 'click' and m.seq > t.seq and m.seq <= t.seq + 10) as n, (select max(seq) from s e where e.session_id = t.session_id) as top from s t where t.kind = 'error') select session_id, agent_id, seq, id as trigger, cast(n as varchar) as clicks from j where n >= 2 and seq + 10 < top")
def j13_handler_count(spark: SparkSession, d: str) -> DataFrame:
    return emit(spark, d, {"on": "error", "window": {"calls": 10, "count": {"on": "click", "at_least": 2}}, "emit": {"trigger": "${id}", "clicks": "${count}"}})


@query(STREAM_SQL + ", j as (select t.*, (select max(b.seq) from s b where b.session_id = t.session_id and b.kind = 'click' and b.seq < t.seq) as b from s t where t.kind = 'purchase' and t.value > 20) select j.session_id, j.agent_id, j.seq, j.id as purchase, s.id as click from j join s on s.session_id = j.session_id and s.seq = j.b")
def j14_handler_before(spark: SparkSession, d: str) -> DataFrame:
    return emit(spark, d, {"on": "purchase", "where": {"value": {"gt": 20}}, "before": {"on": "click"}, "emit": {"purchase": "${id}", "click": "${before.id}"}})


@query(STREAM_SQL + ", j as (select t.session_id, t.agent_id, t.seq, t.id, t.value, (select min(u.seq) from s u where u.session_id = t.session_id and u.kind = 'signup' and u.seq > t.seq) as u from s t where t.kind = 'purchase') select session_id, agent_id, seq, id as purchase, cast((select count(*) from s m where m.session_id = j.session_id and m.kind in ('purchase', 'view') and m.value > j.value and m.seq > j.seq and m.seq < j.u) as varchar) as larger from j where u is not null and (select count(*) from s m where m.session_id = j.session_id and m.kind in ('purchase', 'view') and m.value > j.value and m.seq > j.seq and m.seq < j.u) >= 1")
def j13_handler_count_larger(spark: SparkSession, d: str) -> DataFrame:
    watchers = [{"on": k, "where": {"value": {"gt": "$value"}}} for k in ("purchase", "view")]
    return emit(spark, d, {"on": "purchase", "window": {"until": "signup", "count": {"any": watchers, "at_least": 1}}, "emit": {"purchase": "${id}", "larger": "${count}"}})


@query(STREAM_SQL + " select t.session_id, t.agent_id, t.seq, t.id as purchase from s t where t.kind = 'purchase' and exists (select 1 from s b where b.session_id = t.session_id and b.kind = 'view' and b.seq < t.seq and b.value > t.value)")
def j15_handler_saw(spark: SparkSession, d: str) -> DataFrame:
    program = {"on": "purchase", "scope": "session", "saw": {"on": "view", "where": {"value": {"gt": "$value"}}}, "emit": {"purchase": "${id}"}}
    return batch.run(user_stream(spark, d).withColumn("offer", F.col("seq")), handlers.parse(program))


@query(STREAM_SQL + " select session_id, agent_id, count(*) filter (where kind = 'view') as triggers, count(*) filter (where kind = 'view' and value > 0) as rows from s group by all")
def a18_replay_units(spark: SparkSession, d: str) -> DataFrame:
    """Every view is a trigger; each amount above zero that it brings is a row."""
    events = user_stream(spark, d).withColumn("amounts", F.filter(F.array("value"), lambda v: v > 0))
    found = stream.replay_counts(events, handlers.parse({"on": "view", "each": {"field": "amounts", "as": "amount"}, "emit": {"id": "${id}", "amount": "${amount}"}}))
    return found.select("session_id", "agent_id", "triggers", "rows")


@query("""
with u as (select user_id, case when ('0x' || substr(sha256('holdout-arm' || chr(0) || user_id || chr(0) || 'nudge' || chr(0) || '3'), 1, 8))::bigint / 4294967296.0 < 0.5 then 'held_out' else 'delivered' end as arm, min(ts) as a, max(ts) as b, count(*) filter (where event_type = 'error') as n from events group by user_id),
m as (select min(ts) + (max(ts) - min(ts)) / 2 as middle from events), p as (select u.*, case when b < middle then 'before' when a >= middle then 'after' else 'straddling' end as span from u, m)
select arm, span, count(*) as units, count(*) filter (where n > 0) as hit from p group by all""")
def t24_compare_arms(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    units = events.groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), (F.count_if(F.col("event_type") == "error") > 0).alias("hit"))
    units = units.withColumn("arm", rng.arm_of(F.col("user_id").cast("string"), "nudge", 3, 0.5))
    told = events.agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2").alias("at")).head()
    return unions.compare_arms(units, F.lit(told["at"]))


