"""Queries of projections, rules, joins, roll-ups and scalar functions, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqloom.functions import signal, text
from seqloom.operators import rules
from seqloom.operators import sequence as seq
from seqloom.operators import statistics as st
from seqloom.operators import temporal as tm
from seqloom.plans.catalogue import _DIMS, EV, WD, K, O, _dims, ev, query, rnd, tb
from seqloom.sinks import forms
from seqloom.sources import text_entries as src


@query("prj02_entry_line", """SELECT l_orderkey, l_linenumber, l_shipmode || '=' || l_returnflag || ',' || CAST(CAST(l_linenumber AS DOUBLE) AS VARCHAR) AS line FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem)""")
def _(spark, sf):
    x = tb(spark, sf, "lineitem")
    return x.select("l_orderkey", "l_linenumber", forms.entry_line(F.col("l_linestatus"), F.col("l_returnflag"), F.col("l_linenumber")).alias("line"))


@query("prj03_derived_times", """SELECT l_orderkey, l_linenumber, l_quantity AS start_ms, round(l_quantity + l_extendedprice, 2) AS end_ms, round(greatest(0, l_quantity - 100 * l_discount), 4) AS effective_start FROM lineitem""")
def _(spark, sf):
    x = tb(spark, sf, "lineitem")
    q = F.col("l_quantity")
    return x.select("l_orderkey", "l_linenumber", q.alias("start_ms"), F.round(q + F.col("l_extendedprice"), 2).alias("end_ms"), F.round(F.greatest(F.lit(0.0), q - 100 * F.col("l_discount")), 4).alias("effective_start"))


_CODES = "codes AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS code FROM (SELECT DISTINCT event_type FROM events WHERE event_type <> 'view'))"


def _codes(spark, sf):
    kinds = tb(spark, sf, "events").where("event_type <> 'view'").select("event_type").distinct()
    return kinds.withColumn("code", F.row_number().over(Window.orderBy("event_type")).cast("long"))  # one row for each label of an inventory


@query("prj15_one_hot", f"""WITH {_CODES}, c AS (SELECT event_id, coalesce(code, 1) AS code FROM events LEFT JOIN codes USING (event_type)) SELECT event_id, CAST(i AS INT) AS i, CAST(code = i AS INT) AS hot FROM c, (SELECT unnest(range(0, 6)) AS i)""")
def _(spark, sf):
    x = tb(spark, sf, "events").select("event_id", "event_type").join(F.broadcast(_codes(spark, sf)), "event_type", "left")
    hot = F.expr("transform(sequence(0, 5), i -> CAST(i = coalesce(code, 1) AS INT))")
    return x.select("event_id", F.posexplode(hot).alias("i", "hot"))


@query("jn11_code_with_default", f"""WITH {_CODES} SELECT event_id, coalesce(code, 1) AS code FROM events LEFT JOIN codes USING (event_type)""")
def _(spark, sf):
    x = tb(spark, sf, "events").select("event_id", "event_type").join(F.broadcast(_codes(spark, sf)), "event_type", "left")
    return x.select("event_id", F.coalesce("code", F.lit(1)).alias("code"))


@query("prj23_names", """SELECT event_id, event_type || '_pitch' || printf('%.1f', event_id / 10.0) || '.wav' AS name FROM events""")
def _(spark, sf):
    return tb(spark, sf, "events").select("event_id", F.format_string("%s_pitch%.1f.wav", "event_type", F.col("event_id") / 10.0).alias("name"))


@query("prj24_severity_text", """SELECT event_type, CASE event_type WHEN 'purchase' THEN 'Critical' WHEN 'click' THEN 'Error' WHEN 'view' THEN 'Warning' ELSE 'Info' END AS severity, count(*) AS n FROM events GROUP BY 1, 2""")
def _(spark, sf):
    kind = F.coalesce(F.create_map(*map(F.lit, ("purchase", "Critical", "click", "Error", "view", "Warning")))[F.col("event_type")], F.lit("Info"))
    return tb(spark, sf, "events").groupBy("event_type", kind.alias("severity")).agg(F.count("*").alias("n"))


@query("prj29_map_blend", """SELECT o_orderkey, k, CAST(trunc(coalesce(a, 0) + (coalesce(b, 0) - coalesce(a, 0)) * 0.25) AS INT) AS v FROM (
SELECT o_orderkey, 'g' AS k, o_orderkey % 7 AS a, o_orderkey % 11 AS b FROM orders UNION ALL SELECT o_orderkey, 'bre', 40, NULL FROM orders UNION ALL SELECT o_orderkey, 'bri', NULL, o_orderkey % 50 FROM orders)""")
def _(spark, sf):
    k = "CAST(o_orderkey % {} AS INT)".format
    blend = F.expr(f"map_zip_with(map('g', {k(7)}, 'bre', 40), map('g', {k(11)}, 'bri', {k(50)}), (k, a, b) -> CAST(coalesce(a, 0) + (coalesce(b, 0) - coalesce(a, 0)) * 0.25D AS INT))")
    return tb(spark, sf, "orders").select("o_orderkey", F.explode(blend).alias("k", "v"))


@query("flt02_issues", """SELECT l_orderkey, l_linenumber, rule FROM (SELECT *, 'quantity_small' AS rule FROM lineitem WHERE NOT l_quantity >= 10 UNION ALL SELECT *, 'price_large' FROM lineitem WHERE NOT l_extendedprice < 40000
UNION ALL SELECT *, 'no_discount' FROM lineitem WHERE NOT l_discount > 0)""")
def _(spark, sf):
    q, p, d = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount")
    checks = {"quantity_small": ("error", q >= 10), "price_large": ("warning", p < 40000), "no_discount": ("info", d > 0)}
    return rules.issues(tb(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], checks).drop("severity")


@query("ag09_category_scores", """WITH i AS (SELECT l_orderkey, 'quantity' AS c, 5 AS w FROM lineitem WHERE l_quantity < 10 UNION ALL SELECT l_orderkey, 'price', 2 FROM lineitem WHERE l_extendedprice >= 40000 UNION ALL SELECT l_orderkey, 'discount', 1 FROM lineitem WHERE l_discount <= 0)
SELECT l_orderkey, count(*) AS n, count(DISTINCT c) AS categories, round(CAST(greatest(0, 1 - sum(w) / 100) AS DOUBLE), 6) AS consistency, round(CAST(greatest(0, 1 - count(*) / 10) AS DOUBLE), 6) AS integrity FROM i GROUP BY 1""")
def _(spark, sf):
    q, p, d = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount")
    checks = {"quantity": ("error", q >= 10), "price": ("warning", p < 40000), "discount": ("info", d > 0)}
    return rnd(rules.category_scores(rules.issues(tb(spark, sf, "lineitem"), ["l_orderkey"], checks), "l_orderkey", "rule", "severity"), "consistency", "integrity")


@query("flt03_consistent", """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 0 AND l_discount >= 0 AND l_tax >= 0 AND l_discount + l_tax > 0 AND l_extendedprice / 1000000 <= 2 * (l_discount + l_tax)""")
def _(spark, sf):
    ok = rules.timing_consistent(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_extendedprice") / 1000000)
    return tb(spark, sf, "lineitem").where(ok).select("l_orderkey", "l_linenumber")


_ALIAS = "CASE c_custkey % 5 WHEN 0 THEN 'a ka' WHEN 1 THEN 'ka' WHEN 2 THEN 'shi' WHEN 3 THEN 'o' ELSE '- ka' END"


@query("flt05_alias_kind", """SELECT CASE c_custkey % 5 WHEN 0 THEN 'VCV' WHEN 1 THEN 'CV' WHEN 3 THEN 'V' ELSE 'other' END AS kind, count(*) AS n FROM customer GROUP BY 1""")
def _(spark, sf):
    return tb(spark, sf, "customer").groupBy(rules.alias_kind(F.expr(_ALIAS)).alias("kind")).agg(F.count("*").alias("n"))


_QS = "(VALUES ('q1', 'in'), ('q2', 'ro'), ('q3', '*')) q(question, pattern)"


@query("flt10_questions", f"""SELECT p_partkey, question FROM part, {_QS} WHERE contains(p_name, pattern)""")
def _(spark, sf):
    qs = spark.createDataFrame([("q1", "in"), ("q2", "ro"), ("q3", "*")], "question string, pattern string")
    return rules.matching(tb(spark, sf, "part").select("p_partkey", "p_name"), qs, "p_name", "pattern").select("p_partkey", "question")


@query("flt10_question_globs", """SELECT p_partkey, question FROM part, (VALUES ('q1', '%in%'), ('q2', '%a_e%')) q(question, pattern) WHERE p_name LIKE replace(pattern, '_', '%')""")
def _(spark, sf):
    qs = spark.createDataFrame([("q1", "*in*"), ("q2", "*a*e*")], "question string, pattern string")
    return rules.matching(tb(spark, sf, "part").select("p_partkey", "p_name"), qs, "p_name", "pattern", glob=True).select("p_partkey", "question")


@query("flt13_ranges", """SELECT vec_id, list_min(embedding) >= -3 AND list_max(embedding) <= 3 AS inside FROM embeddings""")
def _(spark, sf):
    return tb(spark, sf, "embeddings").select("vec_id", F.forall("embedding", lambda x: (x >= -3) & (x <= 3)).alias("inside"))


@query("flt15_metadata", """SELECT n_nationkey, regexp_full_match(lower(substr(n_name, 1, 2)), '[a-z]{2}') AND length(n_name) <= 64 AND regexp_full_match(n_name, '[A-Za-z0-9_\\-\\s]+') AS valid FROM nation""")
def _(spark, sf):
    n = F.col("n_name")
    return tb(spark, sf, "nation").select("n_nationkey", (F.lower(F.substring(n, 1, 2)).rlike("^[a-z]{2}$") & (F.length(n) <= 64) & n.rlike("^[A-Za-z0-9_\\-\\s]+$")).alias("valid"))


@query("flt22_excluded", """SELECT page_id, url FROM pages WHERE lower(split_part(url, '/', 4)) NOT IN ('tmp', 'cache', 'backup') AND NOT starts_with(split_part(url, '/', 4), '.')""")
def _(spark, sf):
    folder = F.split_part("url", F.lit("/"), F.lit(4))
    return tb(spark, sf, "pages").where(~F.lower(folder).isin("tmp", "cache", "backup") & ~folder.startswith(".")).select("page_id", "url")


@query("flt26_flag_format", """SELECT event_id, regexp_full_match(event_type || CAST(event_id % 30 AS VARCHAR), '([a-zA-Z]+[+-]?\\d+)*') AS ok, regexp_full_match(event_type, '([a-zA-Z]+[+-]?\\d+)*') AS bare FROM events""")
def _(spark, sf):
    p = "^([a-zA-Z]+[+-]?\\d+)*$"
    return tb(spark, sf, "events").select("event_id", F.concat("event_type", (F.col("event_id") % 30).cast("string")).rlike(p).alias("ok"), F.col("event_type").rlike(p).alias("bare"))


@query("jn09_by_alias", """SELECT p.p_partkey, s.s_suppkey FROM part p JOIN supplier s ON p.p_size = s.s_nationkey""")
def _(spark, sf):
    p, s = tb(spark, sf, "part").select("p_partkey", "p_size"), tb(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return tm.paired(p, s, "p_size", "s_nationkey").select("p_partkey", "s_suppkey")


@query("jn14_group_or_global", """WITH g AS (SELECT label, var_pop(v) AS v FROM (SELECT label, CAST(embedding[1] AS DOUBLE) AS v FROM embeddings) WHERE label < 3 GROUP BY 1), a AS (SELECT var_pop(CAST(embedding[1] AS DOUBLE)) AS v FROM embeddings)
SELECT e.vec_id, round(coalesce(g.v, a.v), 6) AS target FROM embeddings e LEFT JOIN g USING (label) CROSS JOIN a""")
def _(spark, sf):
    e = tb(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("v"))
    known = e.where("label < 3").groupBy("label").agg(F.var_pop("v").alias("g"))
    overall = e.agg(F.var_pop("v").alias("all"))
    return e.join(F.broadcast(known), "label", "left").crossJoin(F.broadcast(overall)).select("vec_id", F.round(F.coalesce("g", "all"), 6).alias("target"))  # the right side is one row


@query("jn16_first_containing", f"""WITH {EV} SELECT p.event_id, arg_min(s.event_id, (s.t, s.event_id)) AS span FROM ev p JOIN ev s ON p.user_id = s.user_id AND s.event_type = 'login' AND p.t >= s.t AND p.t < s.t + 7200000000 GROUP BY 1""")
def _(spark, sf):
    e = ev(spark, sf)
    spans = e.where("event_type = 'login'").select("user_id", F.col("event_id").alias("span"), F.col("t").alias("s"), (F.col("t") + 7_200_000_000).alias("e"))
    return tm.inside(e.select("user_id", "event_id", "t"), spans, K, "t", "s", "e", 3_600_000_000).groupBy("event_id").agg(F.min_by("span", F.struct("s", "span")).alias("span"))


_DAYS = "d AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1, 2)"


@query("jn20_regressions", f"""WITH {_DAYS}, l AS (SELECT event_type, max(day) AS last FROM d GROUP BY 1), c AS (SELECT d.event_type, d.v AS now FROM d JOIN l ON d.event_type = l.event_type AND day = last),
p AS (SELECT d.event_type, CAST(d.day AS VARCHAR) AS day, (now - v) / v * 100 AS pct FROM c JOIN d USING (event_type) JOIN l USING (event_type) WHERE d.day < l.last AND v > 0)
SELECT event_type, day, round(pct, 6) AS pct, CASE WHEN pct > 50 THEN 'critical' WHEN pct > 25 THEN 'high' WHEN pct > 15 THEN 'medium' ELSE 'low' END AS severity FROM p WHERE pct > 5""")
def _(spark, sf):
    d = tb(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    now = d.groupBy("event_type").agg(F.max("day").alias("last"), F.max_by("v", "day").alias("now"))
    pct = (F.col("now") - F.col("v")) / F.col("v") * 100
    x = d.join(now, "event_type").where("day < last AND v > 0").withColumn("pct", pct).where("pct > 5")
    kind = F.when(F.col("pct") > 50, "critical").when(F.col("pct") > 25, "high").when(F.col("pct") > 15, "medium").otherwise("low")
    return x.select("event_type", F.col("day").cast("string").alias("day"), F.round("pct", 6).alias("pct"), kind.alias("severity"))


@query("jn22_similar", """WITH m AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(0, 64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2)
SELECT a.label AS a, b.label AS b, round(sqrt(sum((a.m - b.m) * (a.m - b.m))), 5) AS distance FROM m a JOIN m b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2 HAVING sqrt(sum((a.m - b.m) * (a.m - b.m))) <= 4""")
def _(spark, sf):
    m = _dims(spark, sf).groupBy("label", "dim").agg(F.avg("x").alias("m"))
    a, b = m.select(F.col("label").alias("a"), "dim", F.col("m").alias("x")), m.select(F.col("label").alias("b"), "dim", F.col("m").alias("y"))
    d = a.join(b, "dim").where("a <> b").groupBy("a", "b").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))).alias("distance"))  # labels of an inventory
    return d.where("distance <= 4").withColumn("distance", F.round("distance", 5))


@query("ag10_coverage", """WITH r AS (SELECT DISTINCT c_nationkey AS k FROM customer), f AS (SELECT DISTINCT s_nationkey AS k FROM supplier) SELECT count(*) AS required, count(f.k) AS found, round(100.0 * count(f.k) / count(*), 6) AS percent FROM r LEFT JOIN f USING (k)""")
def _(spark, sf):
    r, f = tb(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).distinct(), tb(spark, sf, "supplier").select(F.col("s_nationkey").alias("j")).distinct()
    return r.join(f, r.k == f.j, "left").agg(F.count("*").alias("required"), F.count("j").alias("found"), F.round(100.0 * F.count("j") / F.count("*"), 6).alias("percent"))


@query("ag18_decays", f"""WITH {EV}, d AS (SELECT user_id, abs(value - lag(value) OVER {WD}) AS d FROM ev) SELECT user_id, round(avg(exp(-d / 50)), 6) AS onset, round(avg(coalesce(exp(-d / 100), 0.5)), 6) AS pitch FROM d GROUP BY 1""")
def _(spark, sf):
    d = ev(spark, sf).select("user_id", F.abs(F.col("value") - F.lag("value").over(seq.over(K, O))).alias("d"))
    return rnd(d.groupBy("user_id").agg(F.avg(F.exp(-F.col("d") / 50)).alias("onset"), F.avg(F.coalesce(F.exp(-F.col("d") / 100), F.lit(0.5))).alias("pitch")), "onset", "pitch")


@query("ag28_dim_variance", f"""WITH {_DIMS} SELECT CAST(dim AS INT) AS dim, round(greatest(var_pop(x), 1e-6), 6) AS variance FROM dims GROUP BY 1""")
def _(spark, sf):
    return rnd(_dims(spark, sf).groupBy("dim").agg(F.greatest(F.var_pop("x"), F.lit(1e-6)).alias("variance")), "variance")


@query("ag43_contour", f"""WITH {EV}, x AS (SELECT user_id, value, lag(value) OVER {WD} AS b FROM ev) SELECT user_id, round(coalesce(count(*) FILTER (WHERE abs(value - b) <= 0.2 * b) / nullif(count(b), 0), 1), 6) AS continuity, round(max(value) - min(value), 6) AS span FROM x GROUP BY 1""")
def _(spark, sf):
    x = ev(spark, sf).select("user_id", "value", F.lag("value").over(seq.over(K, O)).alias("b"))
    near = F.count_if(F.abs(F.col("value") - F.col("b")) <= 0.2 * F.col("b"))
    return rnd(x.groupBy("user_id").agg(F.coalesce(F.try_divide(near, F.count("b")), F.lit(1.0)).alias("continuity"), (F.max("value") - F.min("value")).alias("span")), "continuity", "span")


@query("ag44_centroid", f"""WITH {_DIMS} SELECT vec_id, round(sum(dim * abs(x)) / sum(abs(x)), 5) AS centroid, round(max(x) - min(x), 5) AS span FROM dims GROUP BY 1""")
def _(spark, sf):
    e = F.transform("embedding", lambda v: v.cast("double"))
    x = tb(spark, sf, "embeddings").select("vec_id", e.alias("e"))
    sums = F.aggregate(F.transform("e", lambda v, i: F.struct((F.abs(v) * i).alias("a"), F.abs(v).alias("b"))), F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), lambda s, v: F.struct((s["a"] + v["a"]).alias("a"), (s["b"] + v["b"]).alias("b")))
    return x.select("vec_id", sums.alias("s"), (F.array_max("e") - F.array_min("e")).alias("span")).select("vec_id", F.round(F.col("s.a") / F.col("s.b"), 5).alias("centroid"), F.round("span", 5).alias("span"))


@query("ag46_levels", f"""WITH {_DIMS} SELECT vec_id, round(sqrt(avg(x * x)), 5) AS rms, round(max(abs(x)), 5) AS peak, round(20 * log10(max(abs(x)) / sqrt(avg(x * x))), 5) AS crest FROM dims GROUP BY 1""")
def _(spark, sf):
    d = _dims(spark, sf).groupBy("vec_id").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.max(F.abs("x")).alias("peak"))
    return d.select("vec_id", F.round("rms", 5).alias("rms"), F.round("peak", 5).alias("peak"), F.round(20 * F.log10(F.col("peak") / F.col("rms")), 5).alias("crest"))


_NEXT = "nx AS (SELECT a.vec_id, CAST(unnest(a.embedding) AS DOUBLE) AS x, CAST(unnest(b.embedding) AS DOUBLE) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


@query("ag45_snr", f"""WITH {_NEXT} SELECT vec_id, round(10 * log10(sum(x * x) / sum((x - y) * (x - y))), 5) AS snr, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 5) AS similarity, round(sqrt(avg((x - y) * (x - y))), 5) AS rms_difference FROM nx GROUP BY 1""")
def _(spark, sf):
    e = tb(spark, sf, "embeddings")
    x = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    x = x.select("vec_id", F.inline(F.arrays_zip("a", "b"))).select("vec_id", F.col("a").cast("double").alias("x"), F.col("b").cast("double").alias("y"))
    s = x.groupBy("vec_id").agg(F.sum(F.expr("x * x")).alias("xx"), F.sum(F.expr("y * y")).alias("yy"), F.sum(F.expr("x * y")).alias("xy"), F.sum(F.expr("(x - y) * (x - y)")).alias("d"), F.count("*").alias("n"))
    return s.select("vec_id", F.expr("round(10 * log10(xx / d), 5)").alias("snr"), F.expr("round(xy / sqrt(xx * yy), 5)").alias("similarity"), F.expr("round(sqrt(d / n), 5)").alias("rms_difference"))


@query("ag50_wins", """WITH p AS (SELECT user_id, avg(value) FILTER (WHERE event_type = 'click') AS a, avg(value) FILTER (WHERE event_type = 'view') AS b FROM events GROUP BY 1 HAVING a IS NOT NULL AND b IS NOT NULL)
SELECT CASE WHEN abs(a - b) < 5 THEN 'tie' WHEN a > b THEN 'a' ELSE 'b' END AS winner, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM p GROUP BY 1""")
def _(spark, sf):
    p = tb(spark, sf, "events").groupBy("user_id").agg(*(st.exact_mean(F.when(F.col("event_type") == k, F.col("value"))).alias(n) for k, n in (("click", "a"), ("view", "b")))).where("a IS NOT NULL AND b IS NOT NULL")
    won = F.when(F.abs(F.col("a") - F.col("b")) < 5, "tie").when(F.col("a") > F.col("b"), "a").otherwise("b")
    x = p.groupBy(won.alias("winner")).agg(F.count("*").alias("n"))
    return x.crossJoin(F.broadcast(x.agg(F.sum("n").alias("all")))).select("winner", "n", F.round(100.0 * F.col("n") / F.col("all"), 6).alias("percent"))  # three rows by one


@query("ag57_effect", """WITH b AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s, count(value) AS n FROM events GROUP BY 1), a AS (SELECT avg(value) AS mu FROM events) SELECT event_type, round((m - mu) / (s / sqrt(n)), 6) AS t, round((m - mu) / s, 6) AS d, round(m - 1.96 * s / sqrt(n), 6) AS low, round(m + 1.96 * s / sqrt(n), 6) AS high FROM b, a WHERE s > 0""")
def _(spark, sf):
    e = tb(spark, sf, "events")
    b = e.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count("value").alias("n")).where("s > 0")
    x = b.crossJoin(F.broadcast(e.agg(F.avg("value").alias("mu"))))  # the right side is one row
    x = x.selectExpr("event_type", "(m - mu) / (s / sqrt(n)) AS t", "(m - mu) / s AS d", "m - 1.96D * s / sqrt(n) AS low", "m + 1.96D * s / sqrt(n) AS high")
    return rnd(x, "t", "d", "low", "high")


@query("win07_accent", f"""WITH {EV}, a AS (SELECT *, row_number() OVER {WD} - 1 AS i FROM ev), m AS (SELECT user_id, arg_min(i, (-value, i)) AS top FROM a GROUP BY 1) SELECT event_id, round(least(1, greatest(0, exp(-0.5 * abs(i - top)))), 6) AS accent FROM a JOIN m USING (user_id)""")
def _(spark, sf):
    x = ev(spark, sf).withColumn("i", F.row_number().over(seq.over(K, O)) - 1)
    x = x.withColumn("top", F.min_by("i", F.struct(-F.col("value"), "i")).over(Window.partitionBy(*K)))
    return x.select("event_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(-0.5 * F.abs(F.col("i") - F.col("top"))))), 6).alias("accent"))


@query("win09_coherence", f"""WITH {EV}, x AS (SELECT user_id, t - lag(t) OVER {WD} AS gap, value, lag(value) OVER {WD} AS b FROM ev) SELECT user_id, round(avg(exp(-gap / 3600000000.0) * exp(-abs(ln((value + 1) / (b + 1))))), 6) AS coherence FROM x WHERE gap IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    w = seq.over(K, O)
    x = ev(spark, sf).select("user_id", (F.col("t") - F.lag("t").over(w)).alias("gap"), "value", F.lag("value").over(w).alias("b")).where("gap IS NOT NULL")
    return rnd(x.groupBy("user_id").agg(F.avg(F.expr("exp(-gap / 3600000000.0D) * exp(-abs(ln((value + 1) / (b + 1))))")).alias("coherence")), "coherence")


@query("win18_convergence", f"""WITH {EV}, x AS (SELECT event_id, row_number() OVER {WD} AS i, avg(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS a, avg(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AS b FROM ev)
SELECT event_id, round((a - b) / abs(b), 6) AS improvement, abs((a - b) / b) < 0.1 AS converged FROM x WHERE i >= 6 AND b <> 0""")
def _(spark, sf):
    w = seq.over(K, O)
    x = ev(spark, sf).select("event_id", F.row_number().over(w).alias("i"), F.avg("value").over(w.rowsBetween(-2, 0)).alias("a"), F.avg("value").over(w.rowsBetween(-5, -3)).alias("b")).where("i >= 6 AND b <> 0")
    return x.select("event_id", F.expr("round((a - b) / abs(b), 6)").alias("improvement"), F.expr("abs((a - b) / b) < 0.1D").alias("converged"))


@query("win15_tempo", """WITH c AS (SELECT user_id, event_id, event_id * 480 AS tick, 60 + event_id % 90 AS bpm FROM events), s AS (SELECT *, lead(tick) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY user_id ORDER BY tick))
SELECT event_id, round(sum((tick - before) / 480.0 * 60.0 / prev_bpm) OVER (PARTITION BY user_id ORDER BY tick), 4) AS seconds FROM (SELECT *, lag(tick, 1, tick) OVER w AS before, lag(bpm, 1, 120) OVER w AS prev_bpm FROM s WINDOW w AS (PARTITION BY user_id ORDER BY tick))""")
def _(spark, sf):
    x = tb(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") * 480).alias("tick"), (60 + F.col("event_id") % 90).alias("bpm"))
    x = seq.tempo_seconds(x, K, "tick", "bpm", 480)
    return x.select("event_id", F.round("seconds", 4).alias("seconds"))


@query("fn_s01_encodings", """SELECT doc_id, CASE WHEN strlen(text) = 0 THEN 'UNKNOWN' WHEN strlen(text) = length(text) THEN 'ASCII' ELSE 'UTF-8' END AS encoding FROM documents WHERE text IS NOT NULL""")
def _(spark, sf):
    return tb(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", text.encoding(F.encode("text", "UTF-8")).alias("encoding"))


@query("fn_s04_alias", r"""SELECT doc_id, length(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))) AS n FROM documents""")
def _(spark, sf):
    return tb(spark, sf, "documents").select("doc_id", F.length(text.alias(F.col("text"))).cast("long").alias("n"))


@query("fn_s08_phoneme_parts", """SELECT event_type, CASE WHEN right(event_type, 1) IN ('a', 'i', 'u', 'e', 'o') THEN right(event_type, 1) ELSE '' END AS vowel, left(event_type, length(event_type) - 1) AS consonant, count(*) AS n FROM events GROUP BY 1""")
def _(spark, sf):
    x = tb(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return x.select("event_type", text.vowel(F.col("event_type")).alias("vowel"), text.consonant(F.col("event_type")).alias("consonant"), "n")


@query("fn_s09_nth_word", r"""SELECT p_partkey, coalesce(w[p_partkey % 4 + 1], w[len(w)]) AS word FROM (SELECT p_partkey, regexp_extract_all(p_name, '\S+') AS w FROM part)""")
def _(spark, sf):
    return tb(spark, sf, "part").select("p_partkey", text.nth_word(F.col("p_name"), (F.col("p_partkey") % 4).cast("int")).alias("word"))


@query("fn_s12_versions", """SELECT o_orderkey, CAST(o_orderkey % 3 AS INT) AS major, CAST(o_orderkey % 10 AS INT) AS minor, o_orderkey % 3 = 1 AND o_orderkey % 10 >= 5 AS fits FROM orders""")
def _(spark, sf):
    x = tb(spark, sf, "orders").select("o_orderkey", text.version(F.concat_ws(".", (F.col("o_orderkey") % 3).cast("string"), (F.col("o_orderkey") % 10).cast("string"))).alias("v"))
    return x.select("o_orderkey", "v.major", "v.minor", text.compatible(F.col("v"), text.version(F.lit("1.5"))).alias("fits"))


@query("fn_s13_csv_field", """SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[,"\\n\\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS field FROM conversations""")
def _(spark, sf):
    return tb(spark, sf, "conversations").select("conv_id", "turn", text.csv_field(F.col("text")).alias("field"))


# one decimal, halves up
_SIZE = " ".join(f"WHEN b >= {1024**k} THEN printf('%.1f', floor(b / {1024**k}.0::DOUBLE * 10 + 0.5) / 10) || ' {unit}'" for k, unit in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")))


@query("fn_s14_sizes", f"""SELECT doc_id, CASE {_SIZE} ELSE CAST(b AS VARCHAR) || ' B' END AS size FROM (SELECT doc_id, CAST(n_chars AS BIGINT) * [1, 1024, 1048576, 1073741824][1 + doc_id % 4] AS b FROM documents)""")
def _(spark, sf):
    by = F.element_at(F.array(*(F.lit(1024**k) for k in range(4))), (1 + F.col("doc_id") % 4).cast("int"))
    return tb(spark, sf, "documents").select("doc_id", text.file_size(F.col("n_chars").cast("long") * by).alias("size"))


@query("fn_d02_label_times", """SELECT event_id, CAST(event_id * 10000 AS VARCHAR) || ' ' || CAST((event_id + 150) * 10000 AS VARCHAR) || ' ' || event_type AS line, CAST(event_id // 5 AS VARCHAR) AS frame FROM events""")
def _(spark, sf):
    i = F.col("event_id")
    return tb(spark, sf, "events").select("event_id", forms.label_line(i, i + 150, F.col("event_type")).alias("line"), text.label_time(i, "frames").alias("frame"))


@query("fn_m05_scalers", """WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS d, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1) SELECT event_id, round(CASE WHEN d <= 1e-8 THEN 0 ELSE (value - m) / d END, 6) AS z, round(CASE WHEN hi - lo <= 1e-8 THEN 0 ELSE (value - lo) / (hi - lo) END, 6) AS u, round(ln(greatest(value, 1e-8) + 1), 6) AS l FROM events JOIN s USING (event_type)""")
def _(spark, sf):
    e = tb(spark, sf, "events").select("event_id", "event_type", "value")
    s = e.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("d"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    x = e.join(F.broadcast(s), "event_type")  # one row for each label of an inventory
    return rnd(x.selectExpr("event_id", "CASE WHEN d <= 1e-8D THEN 0D ELSE (value - m) / d END AS z", "CASE WHEN hi - lo <= 1e-8D THEN 0D ELSE (value - lo) / (hi - lo) END AS u", "ln(greatest(value, 1e-8D) + 1) AS l"), "z", "u", "l")


@query("fn_m15_powers", """SELECT o_orderkey, o_orderkey & (o_orderkey - 1) = 0 AS is_power, CAST(pow(2, ceil(log2(o_orderkey))) AS BIGINT) AS next_power FROM orders WHERE o_orderkey > 0""")
def _(spark, sf):
    k = F.col("o_orderkey")
    return tb(spark, sf, "orders").where("o_orderkey > 0").select("o_orderkey", (F.bit_count(k) == 1).alias("is_power"), F.pow(F.lit(2.0), F.ceil(F.log2(k))).cast("long").alias("next_power"))


@query("fn_m16_checksums", """SELECT doc_id, sha256(coalesce(text, '')) AS sha, md5(coalesce(text, '')) AS md FROM documents""")
def _(spark, sf):
    c = F.coalesce("text", F.lit(""))
    return tb(spark, sf, "documents").select("doc_id", F.sha2(c, 256).alias("sha"), F.md5(c).alias("md"))


@query("snk08_metric_rows", """SELECT event_type, metric, round(value, 6) AS value FROM (SELECT event_type, avg(value) AS mean, max(value) AS most, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1) UNPIVOT (value FOR metric IN (mean, most, n))""")
def _(spark, sf):
    x = tb(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.max("value").alias("most"), F.count("*").alias("n"))
    return rnd(forms.metric_rows(x, ["event_type"], ["mean", "most", "n"]), "value")


@query("snk03_question_lines", """SELECT p_partkey, 'QS "' || p_brand || '" { ' || p_type || ' }' AS line FROM part""")
def _(spark, sf):
    return tb(spark, sf, "part").select("p_partkey", forms.question_line(F.col("p_brand"), F.col("p_type")).alias("line"))


@query("src14_sniff", """SELECT doc_id, CASE WHEN contains(f, '/A:') THEN 'hts' WHEN contains(f, 'ms') THEN 'utau' ELSE 'extended' END AS format FROM (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS f FROM documents)""")
def _(spark, sf):
    return tb(spark, sf, "documents").select("doc_id", src.label_format(F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))).alias("format"))


@query("str19_sessions", f"""WITH {EV}, g AS (SELECT *, CASE WHEN t - lag(t) OVER {WD} < 1800000000 THEN 0 ELSE 1 END AS fresh FROM ev), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM g)
SELECT user_id, min(t) AS start, max(t) + 1800000000 AS stop, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def _(spark, sf):
    x = tb(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return x.select("user_id", F.unix_micros("w.start").alias("start"), F.unix_micros("w.end").alias("stop"), "n", "total")


@query("arr03_peak", f"""WITH {_DIMS} SELECT vec_id, CAST(dim AS INT) AS i, round(x / max(abs(x)) OVER (PARTITION BY vec_id), 5) AS x FROM dims""")
def _(spark, sf):
    x = tb(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    return x.select("vec_id", F.posexplode(signal.peak_normalised("e")).alias("i", "x")).withColumn("x", F.round("x", 5))


@query("arr15_transform", f"""WITH {_DIMS}, k AS (SELECT unnest(range(0, 8)) AS k) SELECT vec_id, CAST(k AS INT) AS k, round(sqrt(power(sum(x * cos(2 * pi() * k * dim / 64)), 2) + power(sum(x * sin(2 * pi() * k * dim / 64)), 2)), 4) AS magnitude FROM dims, k GROUP BY 1, 2""")
def _(spark, sf):
    x = tb(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    return x.select("vec_id", F.posexplode(signal.magnitudes("e", 64, 8)).alias("k", "magnitude")).withColumn("magnitude", F.round("magnitude", 4))


@query("arr16_padded", f"""WITH r AS (SELECT vec_id, embedding AS e, unnest(range(0, 80)) AS i FROM embeddings) SELECT vec_id, CAST(i AS INT) AS i, round(coalesce(CAST(e[i + 1] AS DOUBLE), 0), 5) AS x FROM r""")
def _(spark, sf):
    x = tb(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    return x.select("vec_id", F.posexplode(signal.padded("e", 80)).alias("i", "x")).withColumn("x", F.round("x", 5))


@query("arr07_tilt", f"""WITH {_DIMS} SELECT vec_id, CAST(dim AS INT) AS i, round(x + ln(power(10, 3.0 * dim / 63 / 20)), 5) AS x FROM dims""")
def _(spark, sf):
    x = tb(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    return x.select("vec_id", F.posexplode(signal.tilted("e", 3.0)).alias("i", "x")).withColumn("x", F.round("x", 5))


@query("arr10_more_windows", """SELECT vec_id, CAST(i AS INT) AS i, round(x * (0.35875 - 0.48829 * cos(2 * pi() * i / 63) + 0.14128 * cos(4 * pi() * i / 63) - 0.01168 * cos(6 * pi() * i / 63)), 6) AS blackman_harris,
round(x * (0.355768 - 0.487396 * cos(2 * pi() * i / 63) + 0.144232 * cos(4 * pi() * i / 63) - 0.012604 * cos(6 * pi() * i / 63)), 6) AS nuttall,
round(x * CASE WHEN least(i, 63 - i) < 15.75 THEN 0.5 * (1 - cos(4 * pi() * least(i, 63 - i) / 63)) ELSE 1 END, 6) AS tukey FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)""")
def _(spark, sf):
    kinds = ("blackman_harris", "nuttall", "tukey")
    x = tb(spark, sf, "embeddings").select("vec_id", *(F.zip_with("embedding", signal.window(k, 64), lambda v, w: v.cast("double") * w).alias(k) for k in kinds))
    return x.select("vec_id", F.posexplode(F.arrays_zip(*kinds)).alias("i", "w")).select("vec_id", "i", *(F.round(F.col("w")[k], 6).alias(k) for k in kinds))
