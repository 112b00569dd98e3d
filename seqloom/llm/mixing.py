"""Mixing sources to target weights by iterative proportional fitting, built-in functions only.

Documents are counted once into cells (source, language, topic). Raking scales the cells' token weights to each marginal in turn until all
three hold; no cell's weight rises above what drawing all its documents gives, and what it can't take the others of its value take. A
document is then drawn with the probability that its cell's weight gives it, by a hash of its id, so that the expected draw has the
budget and the marginals. A marginal share that even all documents of its value could not fill is lowered to what they can, and the
others of the dimension share the rest (``aims``); ``marginals`` returns wanted, reachable, expected and drawn shares.

Cells are few against documents, but sources may be many: up to ``LOCAL_CELLS`` cells (checked) the sweeps run in one task, whose
windows need no exchange; beyond that each sweep is a grouped sum and a join for each marginal, written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.shared import fits, free_name, materialise, maybe_broadcast

#: Sweeps at a time; after them more follow while a marginal is further than TOLERANCE from its target, MOST_TURNS times at most.
SWEEPS, TOLERANCE, MOST_TURNS = 16, 5e-3, 5
LOCAL_CELLS = 20_000
#: Target share of a marginal value: its share of tokens to this power, made to add up to one.
TEMPER = 0.5
#: Share of all tokens to draw.
BUDGET = 0.5
DIMENSIONS = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    """A plain topic by surface cues of the whole text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(t, F.lit("http")) | F.contains(t, F.lit("@")), "web").when(F.contains(t, F.lit("icense")) | F.contains(t, F.lit("opyright")), "legal")
        .when(F.length(F.regexp_replace(t, "[^0-9]++", "")) * 50 > F.length(t), "numeric").when(F.length(F.regexp_replace(t, "[^A-Z]++", "")) * 10 > F.length(t), "shouted").otherwise("prose")
    )


def token_count(text: Column) -> Column:
    """Runs of letters and digits, characters beyond ASCII counting as letters."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[0-9A-Za-z\\x80-\\x{10FFFF}]++")).cast("long")


def unit(doc_id: Column) -> Column:
    """A number in [0, 1) from the md5 of the id's text; null counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def wanted(cells: DataFrame, by: str, temper: float = TEMPER, given: DataFrame | None = None) -> DataFrame:
    """(by, share, target): a value's share of all tokens, and its tempered share, or that of a given table (by, target) over the values
    that have tokens; targets add up to one. Values that the table does not name get 0; names that repeat are added up."""
    held = cells.groupBy(by).agg(F.sum("tokens").cast("double").alias("_n"))
    if given is None:
        one = held.select(by, "_n", F.pow("_n", F.lit(temper)).alias("_t"))
    else:
        table = given.groupBy(F.col(by).alias("_k")).agg(F.sum("target").cast("double").alias("_g"))
        one = held.join(table, F.col(by).eqNullSafe(F.col("_k")), "left").select(by, "_n", F.when(F.col("_n") > 0, F.coalesce("_g", F.lit(0.0))).otherwise(0.0).alias("_t"))
    whole = F.broadcast(one.agg(F.sum("_n").alias("_all"), F.sum("_t").alias("_sum")))  # one row
    return one.crossJoin(whole).select(by, F.when(F.col("_all") > 0, F.col("_n") / F.col("_all")).otherwise(0.0).alias("share"), F.when(F.col("_sum") > 0, F.col("_t") / F.col("_sum")).otherwise(0.0).alias("target"))


def aims(cells: DataFrame, by: str, temper: float = TEMPER, given: DataFrame | None = None, budget: float | None = None) -> DataFrame:
    """(by, wanted, target): the wanted shares and those that can be reached: no value gets more than all its documents, whose share of
    the draw is share / budget, and what it leaves goes to the others in proportion. Without a budget all can be reached."""
    table = materialise(wanted(cells, by, temper, given), f"wanted-{by}")
    if budget is None:
        return table.select(by, F.col("target").alias("wanted"), "target")
    full, scale = F.lit(False), 1.0
    most, before = F.col("share") / F.lit(float(budget)), -1
    while True:  # each turn fills one more value at least
        full = most <= F.col("target") * F.lit(scale)
        n, held, free = table.agg(F.coalesce(F.count_if(full), F.lit(0)), F.coalesce(F.sum(F.when(full, most)), F.lit(0.0)), F.coalesce(F.sum(F.when(full, 0.0).otherwise(F.col("target"))), F.lit(0.0))).first()
        if n == before or not free:
            break
        before, scale = n, (1 - held) / free
    return table.select(by, F.col("target").alias("wanted"), F.least(most, F.col("target") * F.lit(scale)).alias("target"))


def rake(
    cells: DataFrame, sweeps: int = SWEEPS, temper: float = TEMPER, dimensions: tuple[str, ...] = DIMENSIONS, local: int = LOCAL_CELLS, given: dict[str, DataFrame] | None = None,
    budget: float | None = None, tolerance: float = TOLERANCE,
) -> DataFrame:
    """cells (dimensions, tokens) with ``weight``: shares of the drawn tokens that have the marginals of ``aims`` and stay near the cells'
    own; with a budget no weight exceeds that of all the cell's documents.

    Sweeps go on, ``sweeps`` at a time, until no marginal is further than ``tolerance`` from its target, or MOST_TURNS times: targets of
    several dimensions can contradict each other where cells are missing. Cells without tokens get weight 0; null is a value of its own; an
    empty table stays empty."""
    given = given or {}
    whole = cells.agg(F.sum("tokens").cast("double")).first()[0] or 1.0
    small = fits(cells, local)
    aim = {d: materialise(aims(cells, d, temper, given.get(d), budget).select(F.col(d).alias(f"_k{d}"), F.col("target").alias(f"_t{d}")), f"aim-{d}") for d in dimensions}
    most = F.col("tokens") / F.lit(whole * budget) if budget else F.lit(float("inf"))
    now = cells.withColumn("weight", F.col("tokens") / F.lit(whole))
    if small:
        now = now.coalesce(1)
    for d in dimensions:
        now = now.join(F.broadcast(aim[d]) if small else aim[d], F.col(d).eqNullSafe(F.col(f"_k{d}"))).drop(f"_k{d}")
    now = materialise(now, "rake")
    for _ in range(MOST_TURNS):
        if small:
            now = now.coalesce(1)
        for _ in range(sweeps):
            for d in dimensions:
                if small:
                    now = now.withColumn("_s", F.sum("weight").over(Window.partitionBy(d)))
                else:
                    sums = now.groupBy(F.col(d).alias("_k")).agg(F.sum("weight").alias("_s"))
                    now = now.join(sums, F.col(d).eqNullSafe(F.col("_k"))).drop("_k")
                now = now.withColumn("weight", F.when(F.col("_s") > 0, F.least(most, F.col("weight") * F.col(f"_t{d}") / F.col("_s"))).otherwise(0.0)).drop("_s")
            if not small:
                now = materialise(now, "rake")
        now = materialise(now, "rake")
        off = [now.groupBy(d).agg(F.abs(F.sum("weight") - F.max(f"_t{d}")).alias("off")).agg(F.max("off")).first()[0] or 0.0 for d in dimensions]
        if max(off) <= tolerance:
            break
    return now.drop(*(f"_t{d}" for d in dimensions))


def _cell_columns(text: str, source: str, lang: str, topic: Column | None) -> list[Column]:
    topic = topic_of(F.col(text)) if topic is None else topic
    return [F.col(source).alias("source"), F.col(lang).alias("lang"), topic.alias("topic"), token_count(F.col(text)).alias("n_tokens")]


def _chances(rows: DataFrame, budget: float, sweeps: int, given: dict[str, DataFrame] | None, calibrate: bool) -> DataFrame:
    """(_source, _lang, _topic, weight, probability) of each cell of the rows."""
    cells = materialise(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    raked = materialise(rake(cells, sweeps, given=given, budget=None if calibrate else budget), "raked")
    whole = raked.agg(F.sum("tokens").cast("double")).first()[0] or 1.0
    if calibrate:
        most = raked.where("tokens > 0").agg(F.max(F.col("weight") * F.lit(whole) / F.col("tokens"))).first()[0]
        budget = min(budget, 1 / most) if most else budget
    chance = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(budget) * F.col("weight") * F.lit(whole) / F.col("tokens"))).otherwise(0.0)
    return raked.select(*(F.col(d).alias(f"_{d}") for d in DIMENSIONS), "weight", chance.alias("probability"))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None, budget: float = BUDGET, sweeps: int = SWEEPS,
    given: dict[str, DataFrame] | None = None, calibrate: bool = False,
) -> DataFrame:
    """(id, source, lang, topic, n_tokens, weight, probability, sampled) for each row of docs.

    weight is the cell's share of the draw; a document's probability is budget * weight / (the cell's share of all tokens), at most 1.
    Shares that the budget does not allow are lowered to what can be reached, see ``aims``. With ``calibrate`` no share is lowered; instead
    the budget is, to the largest at which no probability exceeds 1, however few rows that leaves. ``given`` has target tables, see
    ``wanted``; ``marginals`` tells what was reached.
    Null sources and languages are values of their own; null texts have no tokens and the probability of their cell, which is 0 where
    no row of the cell has tokens; rows that repeat an id each have the probability of their own cell; an empty table gives an empty one."""
    rows = materialise(docs.select(F.col(doc_id).alias("id"), *_cell_columns(text, source, lang, topic)), "mix")
    cell = maybe_broadcast(_chances(rows, budget, sweeps, given, calibrate))
    same = F.lit(True)
    for d in DIMENSIONS:
        same = same & F.col(d).eqNullSafe(F.col(f"_{d}"))
    return rows.join(cell, same).drop(*(f"_{d}" for d in DIMENSIONS)).withColumn("sampled", unit(F.col("id")) < F.col("probability"))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of ``op10_mixing``, weights and probabilities rounded to nine places."""
    return mix(docs).select(F.col("id").alias("doc_id"), "source", "lang", "topic", "n_tokens", F.round("weight", 9).alias("weight"), F.round("probability", 9).alias("probability"), "sampled")


def marginals(mixed: DataFrame, given: dict[str, DataFrame] | None = None, budget: float | None = BUDGET) -> DataFrame:
    """(dimension, value, wanted, target, expected, drawn) of a result of ``mix``: wanted and reachable shares of the drawn tokens, the
    expected and the drawn ones, null where nothing is expected or drawn. budget None: of a calibrated draw."""
    n, given = F.col("n_tokens"), given or {}
    cells = materialise(mixed.groupBy(*DIMENSIONS).agg(F.sum(n).alias("tokens"), F.sum(n * F.col("probability")).alias("expected"), F.sum(F.when(F.col("sampled"), n).otherwise(0)).cast("double").alias("drawn")), "drawn")
    whole = cells.agg(F.sum("expected"), F.sum("drawn")).first()
    share = lambda c, all_: (F.sum(c) / F.lit(all_ or None)).alias(c)
    parts = [
        cells.groupBy(F.col(d).alias("value")).agg(share("expected", whole[0]), share("drawn", whole[1])).join(aims(cells, d, given=given.get(d), budget=budget), F.col("value").eqNullSafe(F.col(d)))
        .select(F.lit(d).alias("dimension"), "value", "wanted", "target", "expected", "drawn") for d in DIMENSIONS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def sample(
    docs: DataFrame, budget: float = BUDGET, given: dict[str, DataFrame] | None = None, calibrate: bool = False, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None,
) -> DataFrame:
    """The drawn rows of docs with their columns, then topic, tokens and probability as ``mix_topic``, ``mix_tokens`` and
    ``mix_probability`` (with an underscore at the end where docs has a column of that name).

    Each row is drawn by its own cell; of rows that repeat an id in different cells some may stay and others go. Nulls as in ``mix``."""
    rows = materialise(docs.select(*_cell_columns(text, source, lang, topic)), "mix")
    cell = maybe_broadcast(_chances(rows, budget, SWEEPS, given, calibrate))
    names = [free_name(n, docs) for n in ("mix_topic", "mix_tokens", "mix_probability", "mix_source", "mix_lang")]
    made = _cell_columns(text, source, lang, topic)
    full = docs.select("*", made[2].alias(names[0]), made[3].alias(names[1]), made[0].alias(names[3]), made[1].alias(names[4]))
    cell = cell.select(*(F.col(f"_{d}").alias(free_name(f"cell_{d}", full)) for d in DIMENSIONS), F.col("probability").alias(names[2]))
    same = F.lit(True)
    for at, of in zip((names[3], names[4], names[0]), cell.columns[:3], strict=True):
        same = same & F.col(at).eqNullSafe(F.col(of))
    drawn = full.join(cell, same).where(unit(F.col(doc_id)) < F.col(names[2]))
    return drawn.select(*docs.columns, *names[:3])


def sql(sweeps: int = SWEEPS) -> str:
    """The same for DuckDB, one step of the raking in each table; its one turn of sweeps is what a table needs that TOLERANCE then holds for."""
    cue = """CASE WHEN contains(t, 'http') OR contains(t, '@') THEN 'web' WHEN contains(t, 'icense') OR contains(t, 'opyright') THEN 'legal'
 WHEN length(translate(t, '0123456789', '')) * 50 < length(t) * 49 THEN 'numeric' WHEN length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) * 10 < length(t) * 9 THEN 'shouted' ELSE 'prose' END"""
    steps = [
        "d0 AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, source, lang FROM documents)",
        f"d AS MATERIALIZED (SELECT doc_id, source, lang, {cue} AS topic, CAST(len(regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS BIGINT) AS n_tokens FROM d0)",
        "c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM d GROUP BY ALL)",
        "every AS MATERIALIZED (SELECT sum(tokens) AS tokens FROM c)",
    ]
    for x in DIMENSIONS:
        # values in the order in which they fill up: one is full if it is at the scale that the fuller ones before it leave
        steps.append(f"a_{x} AS MATERIALIZED (SELECT {x}, n / {BUDGET} / sum(n) OVER () AS most, t / sum(t) OVER () AS want FROM (SELECT {x}, sum(tokens) AS n, pow(sum(tokens), {TEMPER}) AS t FROM c GROUP BY {x}))")
        steps.append(f"o_{x} AS MATERIALIZED (SELECT *, coalesce(sum(most) OVER before, 0) AS held, 1 - coalesce(sum(want) OVER before, 0) AS free FROM a_{x} WINDOW before AS (ORDER BY CASE WHEN want > 0 THEN most / want ELSE 1e300 END, {x} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
        steps.append(f"l_{x} AS MATERIALIZED (SELECT (1 - coalesce(sum(most) FILTER (is_full), 0)) / sum(want) FILTER (NOT is_full) AS scale FROM (SELECT *, most * free <= want * (1 - held) AS is_full FROM o_{x}))")
        steps.append(f"t_{x} AS MATERIALIZED (SELECT {x}, least(most, want * scale) AS target FROM a_{x}, l_{x})")
    steps.append("w0 AS MATERIALIZED (SELECT source, lang, topic, tokens, tokens / (SELECT tokens FROM every) AS weight FROM c)")
    k = 0
    for _ in range(sweeps):
        for x in DIMENSIONS:
            k += 1
            steps.append(f"w{k} AS MATERIALIZED (SELECT w.source, w.lang, w.topic, tokens, CASE WHEN s > 0 THEN least(tokens / ((SELECT tokens FROM every) * {BUDGET}), weight * target / s) ELSE 0 END AS weight FROM (SELECT *, sum(weight) OVER (PARTITION BY {x}) AS s FROM w{k - 1}) w JOIN t_{x} t ON w.{x} IS NOT DISTINCT FROM t.{x})")
    steps.append(f"p AS (SELECT *, CASE WHEN tokens > 0 THEN least(1.0, {BUDGET} * weight * (SELECT tokens FROM every) / tokens) ELSE 0 END AS probability FROM w{k})")
    return "WITH " + ",\n".join(steps) + """
SELECT d.doc_id, d.source, d.lang, d.topic, n_tokens, round(weight, 9) AS weight, round(probability, 9) AS probability,
       CAST('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < probability AS sampled
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic = p.topic
"""
