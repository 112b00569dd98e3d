"""Named queries over the test tables, each with its SQL counterpart.

Roles: events are timed segments (user: sequence, event_type: label, value: control value); embeddings are frames; orders and line items
are references to check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import signal
from seqloom.operators import sequence as seq
from seqloom.operators import statistics as st
from seqloom.operators import temporal as tm
from seqloom.sources import text_entries as src
from seqloom.streaming import telemetry

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
K, O = ["user_id"], ["t", "event_id"]  # noqa: E741
EV = "ev AS (SELECT event_id, epoch_us(ts) AS t, user_id, event_type, value FROM events)"
WD = "(PARTITION BY user_id ORDER BY t, event_id)"


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql.strip()
        return f

    return add


def tb(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ev(spark: SparkSession, sf: str) -> DataFrame:
    return tb(spark, sf, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "user_id", "event_type", "value")


def rnd(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def quinphone(spark, sf):
    return seq.context(ev(spark, sf), K, O, "event_type").select("event_id", "l2", "l1", F.col("event_type").alias("c"), "r1", "r2")


FLAGSHIP = query("win03_quinphone", f"""WITH {EV} SELECT event_id, lag(event_type, 2, 'sil') OVER w AS l2, lag(event_type, 1, 'sil') OVER w AS l1, event_type AS c,
lead(event_type, 1, 'sil') OVER w AS r1, lead(event_type, 2, 'sil') OVER w AS r2 FROM ev WINDOW w AS {WD}""")(quinphone)


@query("win01_context3", f"""WITH {EV} SELECT event_id, lag(event_type, 3, '<SIL>') OVER w AS l3, lead(event_type, 3, '<SIL>') OVER w AS r3 FROM ev WINDOW w AS {WD}""")
def _(spark, sf):
    return seq.context(ev(spark, sf), K, O, "event_type", 3, "<SIL>").select("event_id", "l3", "r3")


@query("win05_islands", f"""WITH {EV}, g AS (SELECT user_id, value, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM ev)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, round(sum(value), 6) AS total FROM g GROUP BY ALL""")
def _(spark, sf):
    x = seq.islands(ev(spark, sf), K, O, F.col("event_type") == "purchase")
    return x.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("win06_positions", f"""WITH {EV} SELECT event_id, row_number() OVER w - 1 AS from_start, count(*) OVER (PARTITION BY user_id) - row_number() OVER w AS to_end, count(*) OVER (PARTITION BY user_id) AS length,
round((row_number() OVER w - 1) / count(*) OVER (PARTITION BY user_id), 6) AS ratio, row_number() OVER w = 1 AS initial, row_number() OVER w = count(*) OVER (PARTITION BY user_id) AS final FROM ev WINDOW w AS {WD}""")
def _(spark, sf):
    return rnd(seq.positions(ev(spark, sf), K, O), "ratio").select("event_id", F.col("from_start").cast("long"), F.col("to_end").cast("long"), "length", "ratio", "initial", "final")


@query("win08_gaps", f"""WITH {EV} SELECT event_id, t - lag(t + 60000000) OVER {WD} AS gap FROM ev""")
def _(spark, sf):
    return seq.gaps(ev(spark, sf).withColumn("e", F.col("t") + 60_000_000), K, O, "t", "e").select("event_id", "gap")


@query("win10_smoothed", f"""WITH {EV} SELECT event_id, round(coalesce(0.5 * value + 0.25 * lag(value + 1) OVER w + 0.25 * lead(value) OVER w, value), 6) AS smooth FROM ev WINDOW w AS {WD}""")
def _(spark, sf):
    return rnd(seq.smoothed(ev(spark, sf).withColumn("e", F.col("value") + 1), K, O, "value", "e"), "smooth").select("event_id", "smooth")


@query("win11_deltas", f"""WITH {EV}, d AS (SELECT *, coalesce((lead(value) OVER w - lag(value) OVER w) * 0.5, lead(value) OVER w - value, value - lag(value) OVER w, 0) AS delta FROM ev WINDOW w AS {WD})
SELECT event_id, round(delta, 6) AS delta, round(coalesce((lead(delta) OVER w - lag(delta) OVER w) * 0.5, lead(delta) OVER w - delta, delta - lag(delta) OVER w, 0), 6) AS delta2 FROM d WINDOW w AS {WD}""")
def _(spark, sf):
    return rnd(seq.deltas(ev(spark, sf), K, O, "value"), "delta", "delta2").select("event_id", "delta", "delta2")


@query("win12_peaks", f"""WITH {EV}, p AS (SELECT event_id, value, value > lag(value, 1) OVER w AND value > lag(value, 2) OVER w AND value > lead(value, 1) OVER w AND value > lead(value, 2) OVER w AS k FROM ev WINDOW w AS {WD}) SELECT event_id, value FROM p WHERE k""")
def _(spark, sf):
    return seq.peaks(ev(spark, sf), K, O, "value").select("event_id", "value")


@query("win13_roughness", f"""WITH {EV}, d AS (SELECT user_id, lag(value) OVER w - 2 * value + lead(value) OVER w AS d FROM ev WINDOW w AS {WD}) SELECT user_id, round(avg(d * d), 6) AS roughness FROM d WHERE d IS NOT NULL GROUP BY user_id""")
def _(spark, sf):
    return rnd(seq.roughness(ev(spark, sf), K, O, "value"), "roughness")


@query("win14_running", f"""WITH {EV} SELECT event_id, round(coalesce(sum(CASE WHEN value > 1 THEN 44100 / value ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS pulse FROM ev""")
def _(spark, sf):
    return seq.running(ev(spark, sf), K, O, F.when(F.col("value") > 1, 44100 / F.col("value")).otherwise(0.0), "pulse").select("event_id", F.round("pulse", 4).alias("pulse"))


@query("win16_boundaries", f"""WITH {EV}, a AS (SELECT user_id, event_type, row_number() OVER w - 1 AS pos, event_type IS DISTINCT FROM lag(event_type) OVER w AS fresh FROM ev WINDOW w AS {WD}),
b AS (SELECT *, sum(CASE WHEN fresh OR pos = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) - 1 AS run FROM a) SELECT user_id, CAST(run AS BIGINT) AS run, event_type, min(pos) AS first, max(pos) AS last, count(*) AS frames FROM b GROUP BY ALL""")
def _(spark, sf):
    x = seq.boundaries(ev(spark, sf), K, O, "event_type")
    return x.select("user_id", "run", "event_type", F.col("first").cast("long"), F.col("last").cast("long"), "frames")


@query("win17_rolling", f"""WITH {EV} SELECT event_id, round(avg(value) OVER w, 6) AS roll_mean, max(value) OVER w AS roll_max, count(value) OVER w AS roll_n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    return rnd(seq.rolling(ev(spark, sf), K, O, "value", 10), "roll_mean").select("event_id", "roll_mean", "roll_max", "roll_n")


@query("win19_outliers", """WITH s AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s, count(value) AS n FROM events GROUP BY 1) SELECT event_id, value FROM events JOIN s USING (event_type) WHERE n < 3 OR abs(value - m) <= 2 * s""")
def _(spark, sf):
    return seq.without_outliers(ev(spark, sf), ["event_type"], "value").select("event_id", "value")


@query("win20_control_limits", f"""WITH {EV} SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY t RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW), 6) AS mean_before,
value > avg(value) OVER a + 3 * stddev_samp(value) OVER a OR value < avg(value) OVER a - 3 * stddev_samp(value) OVER a AS out FROM ev WINDOW a AS (PARTITION BY event_type)""")
def _(spark, sf):
    return rnd(seq.control_limits(ev(spark, sf), ["event_type"], "t", "value", 3_600_000_000), "mean_before").select("event_id", "mean_before", "out")


@query("win21_crossings", f"""WITH {EV}, s AS (SELECT user_id, value >= 50 AS s, lag(value >= 50) OVER {WD} AS b FROM ev) SELECT user_id, CAST(coalesce(sum(CASE WHEN s <> b THEN 1 ELSE 0 END), 0) AS BIGINT) AS crossings, round(coalesce(sum(CASE WHEN s <> b THEN 1 ELSE 0 END), 0) / count(*), 6) AS rate FROM s GROUP BY 1""")
def _(spark, sf):
    return rnd(seq.crossings(ev(spark, sf), K, O, F.col("value") - 50), "rate")


@query("win23_ranks", """SELECT event_id, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER (PARTITION BY event_type ORDER BY value, event_id) AS q, round(percent_rank() OVER w, 6) AS p, round(cume_dist() OVER w, 6) AS c FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value)""")
def _(spark, sf):
    w = Window.partitionBy("event_type").orderBy("value")
    return ev(spark, sf).select("event_id", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"), F.ntile(4).over(Window.partitionBy("event_type").orderBy("value", "event_id")).cast("long").alias("q"), F.round(F.percent_rank().over(w), 6).alias("p"), F.round(F.cume_dist().over(w), 6).alias("c"))


@query("ag31_exponential_mean", f"""WITH RECURSIVE {EV}, o AS MATERIALIZED (SELECT user_id, value, row_number() OVER {WD} AS n, count(*) OVER (PARTITION BY user_id) AS c FROM ev),
r AS (SELECT user_id, n, c, value AS ema FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.n, o.c, 0.9 * r.ema + 0.1 * o.value FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1) SELECT user_id, round(ema, 6) AS ema FROM r WHERE n = c""")
def _(spark, sf):
    return rnd(seq.exponential_mean(ev(spark, sf), K, O, "value"), "ema")


@query("srt09_split_tail", f"""WITH {EV} SELECT event_id, CASE WHEN row_number() OVER {WD} <= floor(count(*) OVER (PARTITION BY user_id) * (1 - 0.2)) THEN 'train' ELSE 'validation' END AS part FROM ev""")
def _(spark, sf):
    return seq.split_tail(ev(spark, sf), K, O, 0.2).select("event_id", "part")


@query("srt03_top_k", """SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25""")
def _(spark, sf):
    return tb(spark, sf, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(25)


@query("srt05_arg_max", """SELECT user_id, arg_max(event_id, value) AS event_id, max(value) AS value FROM events GROUP BY 1""")
def _(spark, sf):
    # of rows with the greatest value that with the smallest id, whatever order they come in
    first = F.when(F.col("value").isNotNull() & F.col("event_id").isNotNull(), F.struct("value", F.bitwise_not("event_id")))
    return tb(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_id", first).alias("event_id"), F.max("value").alias("value"))


def _notes(spark, sf):
    e = ev(spark, sf)
    return e.where("event_type = 'purchase'").select("user_id", "event_id", F.col("t").alias("nt")), e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("entry"), F.col("t").alias("et"))


_N = f"{EV}, p AS (SELECT n.event_id, e.event_id AS entry, abs(n.t - e.t) AS distance FROM ev n JOIN ev e ON n.user_id = e.user_id AND n.event_type = 'purchase' AND e.event_type = 'click' AND abs(n.t - e.t) < 3600000000)"


@query("jn01_nearest", f"""WITH {_N} SELECT event_id, entry, distance FROM p QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY distance, entry) = 1""")
def _(spark, sf):
    n, e = _notes(spark, sf)
    return tm.nearest(n, e, "event_id", "nt", "et", 3_600_000_000, K, "entry").select("event_id", "entry", "distance")


@query("jn02_first_within", f"""WITH {_N} SELECT event_id, min(entry) AS entry FROM p GROUP BY 1""")
def _(spark, sf):
    n, e = _notes(spark, sf)
    return tm.nearest(n, e, "event_id", "nt", "et", 3_600_000_000, K, "entry", first=True).select("event_id", "entry")


@query("jn04_in_force", f"""WITH {EV}, c AS (SELECT user_id, t, arg_max(value, event_id) AS v FROM ev WHERE event_type = 'view' GROUP BY 1, 2) SELECT e.event_id, c.v AS value_in_force FROM (SELECT * FROM ev WHERE event_type = 'purchase') e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.t >= c.t""")
def _(spark, sf):
    e = ev(spark, sf)
    return tm.in_force(e.where("event_type = 'purchase'").select("user_id", "event_id", "t"), e.where("event_type = 'view'"), K, "t", "value", "event_id").select("event_id", "value_in_force")


@query("jn05_interpolated", f"""WITH {EV}, c AS (SELECT user_id, t, max(value) AS v FROM ev WHERE event_type = 'view' GROUP BY 1, 2), e AS (SELECT * FROM ev WHERE event_type = 'purchase'),
a AS (SELECT e.event_id, e.user_id, e.t, c.t AS ta, c.v AS va FROM e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.t >= c.t), b AS (SELECT a.*, c.t AS tb, c.v AS vb FROM a ASOF LEFT JOIN c ON a.user_id = c.user_id AND a.t <= c.t)
SELECT event_id, round(CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL OR tb = ta THEN va ELSE va + (vb - va) * (t - ta) / (tb - ta) END, 6) AS curve FROM b""")
def _(spark, sf):
    e = ev(spark, sf)
    knots = e.where("event_type = 'view'").groupBy("user_id", "t").agg(F.max("value").alias("value"))
    return rnd(tm.interpolated(e.where("event_type = 'purchase'").select("user_id", "event_id", "t"), knots, K, "t", "value"), "curve").select("event_id", "curve")


@query("jn15_inside", f"""WITH {EV} SELECT p.event_id, s.event_id AS span FROM ev p JOIN ev s ON p.user_id = s.user_id AND s.event_type = 'signup' AND p.t >= s.t AND p.t < s.t + 86400000000""")
def _(spark, sf):
    e = ev(spark, sf)
    spans = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("span"), F.col("t").alias("s"), (F.col("t") + 86_400_000_000).alias("e"))
    return tm.inside(e.select("user_id", "event_id", "t"), spans, K, "t", "s", "e", 43_200_000_000).select("event_id", "span")


@query("jn06_missing", """SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(spark, sf):
    return tb(spark, sf, "documents").select("doc_id").join(tb(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("jn07_orphans", """SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25)""")
def _(spark, sf):
    used = tb(spark, sf, "lineitem").where("l_quantity > 25").select("l_orderkey")
    o = tb(spark, sf, "orders").select("o_orderkey")
    return o.join(used, o.o_orderkey == used.l_orderkey, "left_anti")


@query("jn08_existence", """SELECT lang, count(*) AS entries, count(*) FILTER (WHERE l.doc_id IS NULL) AS missing FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def _(spark, sf):
    l = tb(spark, sf, "labels").select(F.col("doc_id").alias("k"))  # noqa: E741
    d = tb(spark, sf, "documents").select("doc_id", "lang")
    return d.join(l, d.doc_id == l.k, "left").groupBy("lang").agg(F.count("*").alias("entries"), F.count_if(F.col("k").isNull()).alias("missing"))


@query("jn10_default_lookup", """SELECT c_custkey, coalesce(n_name, 'SILENCE') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON n_nationkey = c_nationkey""")
def _(spark, sf):
    dim = tb(spark, sf, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").cast("string").alias("k"), "n_name")
    return tm.with_default(tb(spark, sf, "customer").select("c_custkey", "c_nationkey"), dim, F.col("c_nationkey").cast("string"), "k", "n_name", F.lit("SILENCE")).select("c_custkey", "n_name")


@query("jn18_positional_compare", """SELECT coalesce(a.conv_id, b.conv_id - 1) AS conv_id, greatest(count(a.role), count(b.role)) AS n, count(*) FILTER (WHERE a.role = b.role) AS same FROM conversations a FULL JOIN conversations b ON b.conv_id = a.conv_id + 1 AND b.turn = a.turn GROUP BY 1""")
def _(spark, sf):
    c = tb(spark, sf, "conversations").select("conv_id", "turn", "role")
    return seq.compared(c.withColumnRenamed("role", "a"), c.select((F.col("conv_id") - 1).alias("conv_id"), "turn", F.col("role").alias("b")), ["conv_id"], "turn", "a", "b").select("conv_id", "n", "same")


@query("jn27_overlaps", f"""WITH {EV} SELECT a.event_id AS a, b.event_id AS b FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(a.t - b.t) < 600000000""")
def _(spark, sf):
    e = ev(spark, sf)
    left, right = e.select("user_id", F.col("event_id").alias("a"), F.col("t").alias("ta")), e.select("user_id", F.col("event_id").alias("b"), F.col("t").alias("tb"))
    return tm.within(left, right, "ta", "tb", 600_000_000, K).where("a < b").select("a", "b")


@query("ag01_profile", """SELECT event_type, count(*) AS total, count(DISTINCT user_id) AS names, count(DISTINCT CAST(ts AS DATE)) AS files, count(*) FILTER (WHERE value <> 0) AS timed, count(user_id) - count(DISTINCT user_id) AS extra FROM events GROUP BY 1""")
def _(spark, sf):
    return st.profile(tb(spark, sf, "events").withColumn("day", F.to_date("ts")), ["event_type"], "user_id", "day", F.col("value") != 0)


@query("ag02_duplicates", """SELECT text, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""")
def _(spark, sf):
    return tb(spark, sf, "documents").groupBy("text").agg(F.count("*").alias("n")).where("n > 1")


@query("ag06_extensions", """SELECT lower(regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '(\\.[A-Za-z0-9]+)$', 1)) AS ext, count(*) AS n FROM pages GROUP BY 1""")
def _(spark, sf):
    path = F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    return tb(spark, sf, "pages").groupBy(F.lower(F.regexp_extract(path, "(\\.[A-Za-z0-9]+)$", 1)).alias("ext")).agg(F.count("*").alias("n"))


@query("ag08_severity", """WITH c AS (SELECT user_id, count(*) FILTER (WHERE value > 300) AS critical, count(*) FILTER (WHERE value > 200 AND value <= 300) AS error, count(*) FILTER (WHERE value > 100 AND value <= 200) AS warning, count(*) FILTER (WHERE value <= 100) AS info FROM events GROUP BY 1)
SELECT *, CAST(round(greatest(0, 1 - (0.5 * critical + 0.2 * error + 0.05 * warning + 0.01 * info)), 6) AS DOUBLE) AS score, critical = 0 AND error = 0 AS valid, critical = 0 AS usable FROM c""")
def _(spark, sf):
    kind = F.when(F.col("value") > 300, "critical").when(F.col("value") > 200, "error").when(F.col("value") > 100, "warning").otherwise("info")
    return rnd(st.severity_score(tb(spark, sf, "events"), "user_id", kind), "score")


@query("ag25_normaliser", """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS least, max(value) AS most, list_sort(list(value))[count(*) // 4 + 1] AS q25, list_sort(list(value))[count(*) // 2 + 1] AS median, list_sort(list(value))[3 * count(*) // 4 + 1] AS q75 FROM events GROUP BY 1""")
def _(spark, sf):
    return rnd(st.normaliser(tb(spark, sf, "events"), ["event_type"], "value"), "mean", "std")


def _dims(spark, sf):
    return tb(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


_DIMS = "dims AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


@query("ag29_global_variance", f"""WITH {_DIMS} SELECT label, CAST(dim AS INT) AS dim, count(*) AS frames, round(avg(x), 6) AS mean, round(greatest(var_pop(x), 1e-6), 6) AS variance FROM dims GROUP BY GROUPING SETS ((label, dim), (dim))""")
def _(spark, sf):
    return rnd(st.global_variance(_dims(spark, sf), "label", "dim", "x"), "mean", "variance")


_PAIR = "pr AS (SELECT a.vec_id, a.label, a.embedding AS a, b.embedding AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _pairs(spark, sf):
    e = tb(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


@query("ag38_spectral_distance", f"""WITH {_PAIR}, d AS (SELECT vec_id, label, unnest(a[2:]) AS x, unnest(b[2:]) AS y FROM pr), f AS (SELECT vec_id, label, sqrt(sum(CAST(x - y AS DOUBLE) * CAST(x - y AS DOUBLE))) AS s FROM d GROUP BY ALL) SELECT label, round(20 / ln(10) * avg(s), 4) AS distance, count(*) AS frames FROM f GROUP BY 1""")
def _(spark, sf):
    return st.spectral_distance(_pairs(spark, sf), ["label"], "a", "b").select("label", F.round("distance", 4).alias("distance"), "frames")


@query("ag39_voiced_rmse", f"""WITH {EV}, x AS (SELECT user_id, value AS a, lead(value) OVER {WD} AS b FROM ev) SELECT user_id, round(coalesce(sqrt(avg((a - b) * (a - b)) FILTER (WHERE a > 50 AND b > 50)), -1), 6) AS rmse, count(*) FILTER (WHERE a > 50 AND b > 50) AS pairs FROM x GROUP BY 1""")
def _(spark, sf):
    x = ev(spark, sf).select("user_id", F.col("value").alias("a"), F.lead("value").over(seq.over(K, O)).alias("b"))
    return rnd(st.voiced_rmse(x, K, "a", "b", 50.0), "rmse")


@query("ag40_correlation", f"""WITH {_PAIR}, d AS (SELECT vec_id, CAST(unnest(a) AS DOUBLE) AS x, CAST(unnest(b) AS DOUBLE) AS y FROM pr) SELECT vec_id, round((avg(x * y) - avg(x) * avg(y)) / sqrt(var_pop(x) * var_pop(y)), 6) AS r FROM d GROUP BY 1""")
def _(spark, sf):
    x = _pairs(spark, sf).select("vec_id", F.inline(F.arrays_zip("a", "b"))).select("vec_id", F.col("a").cast("double"), F.col("b").cast("double"))
    return rnd(st.correlation(x, ["vec_id"], "a", "b"), "r")


@query("ag41_spread", """SELECT user_id, count(value) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(coalesce(stddev_samp(value), 0), 6) AS std FROM events GROUP BY 1""")
def _(spark, sf):
    return rnd(st.spread(tb(spark, sf, "events"), K, "value"), "mean", "median", "std")


@query("ag34_sufficient", """SELECT l_returnflag, round(sum(l_discount), 4) AS s0, round(sum(l_discount * l_quantity), 4) AS s1, round(sum(l_discount * l_quantity * l_quantity), 4) AS s2 FROM lineitem GROUP BY 1""")
def _(spark, sf):
    x = st.sufficient(tb(spark, sf, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity")
    return x.select("l_returnflag", *(F.round(c, 4).alias(c) for c in ("s0", "s1", "s2")))


@query("ag37_transitions", f"""WITH {EV}, s AS (SELECT event_type AS from_state, lead(event_type) OVER {WD} AS to_state FROM ev) SELECT from_state, to_state, count(*) AS steps, round(count(*) / sum(count(*)) OVER (PARTITION BY from_state), 6) AS share FROM s WHERE to_state IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    return rnd(st.transitions(ev(spark, sf), K, O, "event_type"), "share")


@query("ag59_cube", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def _(spark, sf):
    return tb(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("ag56_baseline", """SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 10""")
def _(spark, sf):
    x = tb(spark, sf, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("n"))
    return x.where("n >= 10")


@query("jn_revenue_by_nation", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def _(spark, sf):
    l = tb(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")  # noqa: E741
    o, c, n = tb(spark, sf, "orders").select("o_orderkey", "o_custkey"), tb(spark, sf, "customer").select("c_custkey", "c_nationkey"), tb(spark, sf, "nation").select("n_nationkey", "n_name")
    x = l.join(o, l.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey)
    return x.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("orders"))


@query("set01_coverage", """SELECT 'missing' AS side, c_custkey AS k FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000) UNION ALL SELECT 'both', c_custkey FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 100000)""")
def _(spark, sf):
    c, o = tb(spark, sf, "customer").select(F.col("c_custkey").alias("k")), tb(spark, sf, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("k"))
    return c.exceptAll(o.distinct()).select(F.lit("missing").alias("side"), "k").unionByName(c.intersect(o).select(F.lit("both").alias("side"), "k"))


@query("prj18_triphones", f"""WITH {EV} SELECT event_id, lag(event_type, 1, 'sil') OVER w || '-' || event_type || '+' || lead(event_type, 1, 'sil') OVER w AS name FROM ev WINDOW w AS {WD}""")
def _(spark, sf):
    return seq.context(ev(spark, sf), K, O, "event_type", 1).select("event_id", F.concat("l1", F.lit("-"), "event_type", F.lit("+"), "r1").alias("name"))


@query("fn_notes", """SELECT vec_id, label + 60 AS note, round(440 * pow(2, (label + 60 - 69) / 12.0), 6) AS hertz FROM embeddings""")
def _(spark, sf):
    note = F.col("label") + 60
    return tb(spark, sf, "embeddings").select("vec_id", note.alias("note"), F.round(signal.hertz(note), 6).alias("hertz"))


@query("arr09_cepstra", f"""WITH {_DIMS}, k AS (SELECT unnest(range(0, 4)) AS k) SELECT vec_id, CAST(k AS INT) AS k, round(s * CASE WHEN k = 0 THEN sqrt(1 / 64) ELSE sqrt(2 / 64) END, 5) AS c FROM (SELECT vec_id, k, sum(x * cos(pi() * k * (2 * dim + 1) / 128)) AS s FROM dims, k GROUP BY vec_id, k)""")
def _(spark, sf):
    x = tb(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    return x.select("vec_id", F.posexplode(signal.cepstra("e", 64, 4)).alias("k", "c")).withColumn("c", F.round("c", 5))


@query("arr02_resample", f"""WITH i AS (SELECT vec_id, embedding AS e, unnest(range(0, 96)) AS i FROM embeddings) SELECT vec_id, CAST(i AS INT) AS i, round(CASE WHEN CAST(floor(i / 1.5) AS INT) + 1 < 64 THEN e[CAST(floor(i / 1.5) AS INT) + 1] + (CAST(e[CAST(floor(i / 1.5) AS INT) + 2] AS DOUBLE) - CAST(e[CAST(floor(i / 1.5) AS INT) + 1] AS DOUBLE)) * (i / 1.5 - floor(i / 1.5)) ELSE e[64] END, 5) AS x FROM i""")
def _(spark, sf):
    x = tb(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    return x.select("vec_id", F.posexplode(signal.resample("e", 1.5)).alias("i", "x")).withColumn("x", F.round("x", 5))


@query("arr10_windows", """SELECT vec_id, CAST(i AS INT) AS i, round(x * (0.5 - 0.5 * cos(2 * pi() * i / 63)), 6) AS hann, round(x * (0.54 - 0.46 * cos(2 * pi() * i / 63)), 6) AS hamming, round(x * (0.42 - 0.5 * cos(2 * pi() * i / 63) + 0.08 * cos(4 * pi() * i / 63)), 6) AS blackman FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)""")
def _(spark, sf):
    kinds = ("hann", "hamming", "blackman")
    x = tb(spark, sf, "embeddings").select("vec_id", *(F.zip_with("embedding", signal.window(k, 64), lambda v, w: v.cast("double") * w).alias(k) for k in kinds))
    return x.select("vec_id", F.posexplode(F.arrays_zip(*kinds)).alias("i", "w")).select("vec_id", "i", *(F.round(F.col("w")[k], 6).alias(k) for k in kinds))


@query("ml03_assign", """WITH c AS (SELECT vec_id AS cid, embedding AS c FROM embeddings WHERE vec_id < 8), d AS (SELECT e.vec_id, c.cid, unnest(e.embedding) AS x, unnest(c.c) AS y FROM embeddings e, c), s AS (SELECT vec_id, cid, sum(CAST(x - y AS DOUBLE) * CAST(x - y AS DOUBLE)) AS d FROM d GROUP BY ALL) SELECT vec_id, arg_min(cid, d) AS cid FROM s GROUP BY 1""")
def _(spark, sf):
    e = tb(spark, sf, "embeddings")
    return st.kmeans_step(e, e.where("vec_id < 8").select(F.col("vec_id").alias("cid"), F.col("embedding").alias("c")), "vec_id", "embedding").select("vec_id", "cid")


@query("str13_telemetry", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(avg(value), 6) AS mean_latency, max(value) AS max_latency FROM events GROUP BY 1""")
def _(spark, sf):
    x = tb(spark, sf, "events").select("ts", F.col("value").alias("latency"), F.lit(0.0).alias("cpu"), F.lit(0.0).alias("util"), F.lit(0).alias("underruns"), F.lit(0).alias("overflows"))
    return rnd(telemetry.windows(x, size="1 hour").select("start", "n", "mean_latency", "max_latency"), "mean_latency")


@query("src06_entries", """SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(replace(l, chr(13), '')) <> '' AND NOT starts_with(trim(replace(l, chr(13), '')), '#') AND NOT contains(l, '=') GROUP BY 1""")
def _(spark, sf):
    lines = tb(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    _, bad = src.entries(lines, ["doc_id"], "line_no", "line")
    return bad.where("message = \"Missing '=' separator\"").groupBy("doc_id").agg(F.count("*").alias("lines"))
