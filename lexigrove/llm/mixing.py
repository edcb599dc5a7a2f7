"""Mixing sources to target weights by entropy balancing.

Of all document rates that meet each constraint's tokens, those nearest to 1 in relative entropy are
exponentially tilted: exp(sum of one multiplier for each constraint that a document falls under).
The multipliers solve a convex dual; its Newton steps are aggregations over a table of cells, one for
each combination of constraint groups, with the tokens that it holds.  Groups of constraints (sources,
languages, ...) take turns, and within a group the Hessian is diagonal, so that a step needs no solver;
steps are taken on the logarithm of each constraint's tokens, which one group alone meets at once.

Rates are rounded to copies by systematic sampling: within a source, documents in order of size get
their floor and each 1/fraction-th one more, so that the tokens taken differ from the target by at
most about one document's size.  Documents are numbered by ranges, whatever the source's size.

Null sources are one source, the last.  Documents without words have size 0 and any rate meets them.
Rows that are equal in source, size and id are interchangeable: some may be taken more often.
Columns of the input pass through expand() whatever their names; mix() returns columns of its own.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RE, fresh, numbered, one_of, stage, table

MOST = 3.0  #: copies of a document at most
_PHASE = 0.381966  #: where the sampling starts; no simple fraction, so that no rate hits it exactly


def sizes(docs: DataFrame, text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(SPACE_RE)), F.lit(0)).cast("long")


def targets(totals: DataFrame, most: float = MOST) -> DataFrame:
    """(source, source_size, n, target) for totals (source, source_size, n).

    Sources in order of code points, null last, weigh 1, 2, 3, repeating.  A target stops at ``most``
    times its source's size and the excess goes to the others by weight: the level L at which
    sum(min(most * size, L * weight)) is the sum of all sizes.
    """
    x = numbered(totals, [F.col("source").asc_nulls_last()], "number").withColumn("weight", ((F.col("number") - 1) % 3 + 1).cast("double")).withColumn("cap", most * F.col("source_size"))
    x = stage(x, "weights")
    total, open_, sources = x.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double"), F.coalesce(F.sum("weight"), F.lit(0.0)), F.count("*")).first()
    fixed, closed = 0.0, 0
    while open_:  # the level rises until no more sources stop below it
        over = F.lit((total - fixed) / open_) * F.col("weight") > F.col("cap")
        n, fixed_, left = x.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if n == closed:
            break
        fixed, open_, closed = fixed_, left, n
    share = F.lit(total - fixed) * F.col("weight") / F.lit(open_) if open_ else F.col("cap")
    return x.select("source", "source_size", "n", F.least(share, F.col("cap")).alias("target"))


def balance(cells: DataFrame, goals: dict[str, DataFrame], tolerance: float = 1e-12, max_rounds: int = 200) -> DataFrame:
    """cells with rate, the exponential tilt under which each value of each group has its target of tokens.

    cells: group columns and tokens.  goals: for each group column, (its values under the column's
    name, target).  Targets without tokens can't be met and are left alone; goals that contradict each
    other raise.
    """
    log, off = fresh(cells, "log", "off")
    kept = cells.columns
    cells = cells.withColumn(log, F.lit(0.0))
    for _ in range(max_rounds):
        worst = 0.0
        for group, goal in goals.items():
            now = cells.groupBy(F.col(group).alias("value_")).agg(F.sum(F.col("tokens") * F.exp(log)).alias("now"), F.sum("tokens").alias("held"))
            step = now.join(goal.select(F.col(group).alias("goal_"), "target"), F.col("value_").eqNullSafe(F.col("goal_"))).where("held > 0")
            # Newton on log(now) = log(target), whose derivative is 1; a target of 0 drives the rate to 0 at once
            met = (F.col("target") > 0) & (F.col("now") > 0)
            step = step.select("value_", F.when(F.col("target") <= 0, F.lit(-745.0)).when(met, F.log(F.col("target") / F.col("now"))).otherwise(0.0).alias("step_"), F.when(met, F.abs(F.col("target") / F.col("now") - 1)).otherwise(0.0).alias(off))
            cells = cells.drop(off).join(step, F.col(group).eqNullSafe(F.col("value_")), "left")
            cells = stage(cells.select(*kept, F.greatest(F.col(log) + F.coalesce("step_", F.lit(0.0)), F.lit(-745.0)).alias(log), off), "cells")
            worst = max(worst, cells.agg(F.max(off)).first()[0] or 0.0)
        if worst <= tolerance:
            return cells.withColumn("rate", F.when(F.col(log) <= -745, 0.0).otherwise(F.exp(log))).drop(log, off)
    raise RuntimeError(f"the goals contradict each other: one is off by a share of {worst:.3g} after {max_rounds} rounds")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", most: float = MOST, mark=None) -> DataFrame:
    """(doc_id, source, size, mark, source_size, target, rate, copies), a row for each row of docs; reruns agree.

    mark: a column to carry along, by which rows equal in source, size and id are told apart.
    """
    rows = stage(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), sizes(docs, text).alias("size"), (F.lit(0) if mark is None else mark).alias("mark")), "sizes")
    totals = stage(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "totals")
    goals = targets(totals, most)
    rates = balance(totals.select("source", F.col("source_size").alias("tokens")), {"source": goals}).select(F.col("source").alias("_source"), "rate")
    plan = goals.join(rates, F.col("source").eqNullSafe(F.col("_source"))).select(F.col("source").alias("_source"), "source_size", "target", F.least("rate", F.lit(most)).alias("rate"))
    rows = numbered(rows.withColumn("tie", F.monotonically_increasing_id()), ["source", "size", "doc_id", "mark", "tie"], "rank", ("source",))
    rows = rows.join(stage(plan, "plan"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.floor(F.col("rate") + 1e-9)
    part = F.greatest(F.col("rate") - whole, F.lit(0.0))
    extra = F.floor(F.col("rank") * part + _PHASE) - F.floor((F.col("rank") - 1) * part + _PHASE)
    return rows.withColumn("copies", (whole + extra).cast("int")).select("doc_id", "source", "size", "mark", "source_size", "target", "rate", "copies")


def expand(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", most: float = MOST) -> DataFrame:
    """docs with each row repeated by its copies under mix(); of rows that are equal in id, source and text one stands for all."""
    i, s, m, copies, many, mark, number = fresh(docs, "i", "s", "m", "copies", "rows", "mark", "number")
    found = mix(docs, doc_id, text, source, most, F.xxhash64(text)).groupBy("doc_id", "source", "mark").agg(F.sum("copies").cast("int").alias(copies), F.count("*").alias(many))
    found = stage(found.select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("mark").alias(m), copies, many), "copies")
    rows = docs.withColumn(mark, F.xxhash64(text))
    rows = rows.join(found, F.col(doc_id).eqNullSafe(F.col(i)) & F.col(source).eqNullSafe(F.col(s)) & (F.col(mark) == F.col(m))).where(F.col(copies) > 0)
    one = rows.where(F.col(many) == 1).unionByName(one_of(rows.where(F.col(many) > 1), i, s, m))
    return one.withColumn(number, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_entropy_balancing(spark, sf_dir):
    """The words that the mix takes of each document, by whole tables."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{SPACE_RE}')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM d GROUP BY source),
c AS (SELECT *, 3.0::DOUBLE * source_size AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed, sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
      FROM c WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)),
l AS (SELECT fixed AS lf, open AS lo FROM f WHERE (total - fixed) / open * weight <= cap ORDER BY cap / weight LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN lf IS NULL OR (total - lf) * weight / lo > cap THEN cap ELSE (total - lf) * weight / lo END AS target FROM f LEFT JOIN l ON true),
r AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 1 END AS rate, row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) AS rank
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate + 1e-9) + floor(rank * greatest(rate - floor(rate + 1e-9), 0) + {_PHASE}) - floor((rank - 1) * greatest(rate - floor(rate + 1e-9), 0) + {_PHASE})))::BIGINT AS taken
FROM r
"""
