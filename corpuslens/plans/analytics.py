"""Queries over labels, time and keys."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..operators import metrics as M
from ..operators import models as ML_
from ..operators import answers as A
from ..operators import audit as U
from ..operators import order as O
from ..operators import prompts as P
from ..operators import similarity as SI
from ..sources import sinks
from . import table

CATALOGUE: dict = {}


def query(sql: str | None = None):
    def add(run):
        CATALOGUE[run.__name__] = (run, sql)
        return run

    return add


# synthetic labels: L1 by arithmetic on the id, L2 as a delimited cell
L1 = "'L1-0' || (1 + ({} * 31) % 7)"
L2 = "CASE WHEN {0} % 5 = 0 THEN '' ELSE concat_ws('|', CASE WHEN {0} % 2 = 0 THEN 'L2-01' END, CASE WHEN {0} % 3 = 0 THEN 'L2-02' END, ' L2-0' || (3 + {0} % 4)) END"


def l1(i):
    return F.concat(F.lit("L1-0"), (1 + (i * 31) % 7).cast("string"))


def l2_cell(i):
    return F.when(i % 5 == 0, "").otherwise(F.concat_ws("|", F.when(i % 2 == 0, "L2-01"), F.when(i % 3 == 0, "L2-02"), F.concat(F.lit(" L2-0"), (3 + i % 4).cast("string"))))


EV = f"SELECT *, {L1.format('event_id')} AS l1, list_filter(list_transform(string_split({L2.format('event_id')}, '|'), lambda x: trim(x)), lambda x: x <> '') AS l2 FROM events"


def events(spark, sf):
    i = F.col("event_id")
    return table(spark, sf, "events").withColumns({"l1": l1(i), "l2": T.parse_labels(l2_cell(i))})


def space(spark, prefix: str, n: int):
    return spark.range(1, n + 1).select(F.format_string(prefix + "-%02d", "id").alias("label"))


@query(f"WITH e AS ({EV}) SELECT l1, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 8) AS share FROM e GROUP BY l1")
def l1_distribution(spark, sf):
    return M.value_counts(events(spark, sf), "l1").select("l1", "n", F.round("share", 8).alias("share"))


@query(f"WITH e AS ({EV}), t AS (SELECT count(*) AS rows, count(*) FILTER (len(l2) = 0) AS empty FROM e), x AS (SELECT unnest(l2) AS label FROM e) SELECT label, count(*) AS n, round(count(*) / CAST(any_value(rows) AS DOUBLE), 8) AS prevalence, round(any_value(empty) / CAST(any_value(rows) AS DOUBLE), 8) AS empty_rate FROM x, t GROUP BY label")
def l2_prevalence(spark, sf):
    e = events(spark, sf)
    t = e.agg(F.count("*").alias("rows"), F.count_if(F.size("l2") == 0).alias("empty"))
    x = e.select(F.explode("l2").alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return x.crossJoin(F.broadcast(t)).select("label", "n", F.round(F.col("n") / F.col("rows"), 8).alias("prevalence"), F.round(F.col("empty") / F.col("rows"), 8).alias("empty_rate"))


@query(f"WITH e AS ({EV}), c AS (SELECT array_to_string(list_sort(l2), '|') AS combo, count(*) AS n FROM e WHERE len(l2) > 0 GROUP BY 1) SELECT combo, n FROM c ORDER BY n DESC, combo LIMIT 10")
def l2_combinations_topk(spark, sf):
    c = events(spark, sf).where(F.size("l2") > 0).groupBy(F.array_join(F.array_sort("l2"), "|").alias("combo")).agg(F.count("*").alias("n"))
    return c.orderBy(F.desc("n"), "combo").limit(10)


@query(f"WITH e AS ({EV}), c AS (SELECT l1 AS label, count(*) AS n FROM e GROUP BY 1), s AS (SELECT 'L1-' || lpad(CAST(r AS VARCHAR), 2, '0') AS label FROM range(1, 10) t(r)) SELECT label, coalesce(n, 0) AS n, 2000 - coalesce(n, 0) AS gap FROM s LEFT JOIN c USING (label) WHERE coalesce(n, 0) < 2000")
def label_gaps(spark, sf):
    return M.label_gaps(events(spark, sf), "l1", space(spark, "L1", 9), 2000)


@query(f"""WITH e AS ({EV}), a AS (SELECT 'L1-' || lpad(CAST(r AS VARCHAR), 2, '0') AS label FROM range(1, 10) t(r)), b AS (SELECT 'L2-' || lpad(CAST(r AS VARCHAR), 2, '0') AS label FROM range(1, 16) t(r)),
x AS (SELECT l1 AS label, count(*) AS n FROM e GROUP BY 1), y AS (SELECT unnest(l2) AS label FROM e), z AS (SELECT label, count(*) AS n FROM y GROUP BY 1), m AS (SELECT avg(len(l2)) AS m FROM e),
g AS (SELECT CAST(sum(greatest(0, 2000 - coalesce(n, 0))) AS BIGINT) AS l1_gap FROM a LEFT JOIN x USING (label)), h AS (SELECT CAST(sum(greatest(0, 1500 - coalesce(n, 0))) AS BIGINT) AS l2_gap FROM b LEFT JOIN z USING (label))
SELECT l1_gap, l2_gap, CAST(floor(l2_gap / m) AS BIGINT) AS by_l2, greatest(l1_gap, CAST(floor(l2_gap / m) AS BIGINT)) AS recommended FROM g, h, m""")
def gap_totals(spark, sf):
    e = events(spark, sf)
    mean = U.profile(e, "l1", "l2").first()["labels_per_row"]
    return U.gap_totals(M.label_gaps(e, "l1", space(spark, "L1", 9), 2000), M.label_gaps(e.select(F.explode("l2").alias("l2")), "l2", space(spark, "L2", 15), 1500), mean)


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, grouping_id(o_orderpriority, o_orderstatus) AS gid FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def crosstab_margins(spark, sf):
    return table(spark, sf, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))


GOLD = f"SELECT d.doc_id, {L1.format('d.doc_id')} AS pred, CASE WHEN l.quality = 1 THEN {L1.format('d.doc_id')} WHEN l.quality = 0 THEN 'L1-0' || (1 + (d.doc_id * 31 + l.toxic + 1) % 7) END AS gold FROM documents d LEFT JOIN labels l USING (doc_id)"


def gold(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    i = F.col("doc_id")
    other = F.concat(F.lit("L1-0"), (1 + (i * 31 + F.col("toxic") + 1) % 7).cast("string"))
    return d.select("doc_id", l1(i).alias("pred"), F.when(F.col("quality") == 1, l1(i)).when(F.col("quality") == 0, other).alias("gold"))


CELLS = f"g AS ({GOLD}), v AS (SELECT * FROM g WHERE gold IS NOT NULL), s AS (SELECT gold AS l FROM v UNION SELECT pred FROM v), c AS (SELECT a.l AS \"true\", b.l AS pred, (SELECT count(*) FROM v WHERE v.gold = a.l AND v.pred = b.l) AS n FROM s a, s b)"


@query(f'WITH {CELLS} SELECT "true", pred, n FROM c')
def confusion_matrix(spark, sf):
    return M.confusion(gold(spark, sf), "gold", "pred")


PRF = """p AS (SELECT t.l AS label, CASE WHEN pr = 0 THEN 0 ELSE hit / CAST(pr AS DOUBLE) END AS precision, CASE WHEN support = 0 THEN 0 ELSE hit / CAST(support AS DOUBLE) END AS recall, support FROM
 (SELECT "true" AS l, sum(n) AS support, sum(CASE WHEN "true" = pred THEN n ELSE 0 END) AS hit FROM c GROUP BY 1) t JOIN (SELECT pred AS l, sum(n) AS pr FROM c GROUP BY 1) q USING (l)),
f AS (SELECT label, precision, recall, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1, support FROM p)"""


@query(f"WITH {CELLS}, {PRF} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM f")
def prf_per_label(spark, sf):
    p = M.precision_recall(M.confusion(gold(spark, sf), "gold", "pred"))
    return p.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"WITH {CELLS}, {PRF} SELECT round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f")
def macro_weighted_f1(spark, sf):
    s = M.summary_f1(M.precision_recall(M.confusion(gold(spark, sf), "gold", "pred")))
    return s.select(F.round("macro_f1", 6).alias("macro_f1"), F.round("weighted_f1", 6).alias("weighted_f1"))


@query(f"WITH g AS ({GOLD}) SELECT pred, count(*) AS n, round(avg(CASE WHEN pred = gold THEN 1.0 ELSE 0.0 END), 6) AS match_rate FROM g WHERE gold IS NOT NULL GROUP BY pred")
def compare_target_actual(spark, sf):
    return gold(spark, sf).where("gold IS NOT NULL").groupBy("pred").agg(F.count("*").alias("n"), F.round(F.avg((F.col("pred") == F.col("gold")).cast("double")), 6).alias("match_rate"))


@query(f"WITH g AS ({GOLD}), c AS (SELECT gold, pred, count(*) AS n FROM g WHERE gold IS NOT NULL GROUP BY 1, 2) SELECT gold, string_agg(pred || ':' || n, ', ' ORDER BY pred) AS distribution FROM c GROUP BY gold")
def prediction_distribution(spark, sf):
    return M.prediction_distribution(M.confusion(gold(spark, sf), "gold", "pred")).withColumnRenamed("true", "gold")


@query(f"WITH {CELLS} SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(CASE WHEN \"true\" = pred THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 6) AS accuracy FROM c")
def l1_accuracy(spark, sf):
    return M.accuracy(M.confusion(gold(spark, sf), "gold", "pred")).select("n", F.round("accuracy", 6).alias("accuracy"))


@query(f"""WITH g AS ({GOLD}), e AS (SELECT doc_id, concat_ws('|', CASE WHEN doc_id % 6 = 0 THEN 'Low_Conf' END, CASE WHEN doc_id % 9 = 0 THEN 'Has_Note' END, CASE WHEN coalesce(gold, 'nan') <> pred THEN 'Wrong_L1' END, CASE WHEN doc_id % 4 > 0 AND doc_id % 5 <> doc_id % 4 AND doc_id % 5 <> 4 THEN 'L2_No_Overlap' END) AS r FROM g) SELECT CASE WHEN r = '' THEN 'Other' ELSE r END AS reason, count(*) AS n FROM e GROUP BY 1""")
def error_cases(spark, sf):
    i, none = F.col("doc_id"), F.array().cast("array<string>")
    a = F.when(i % 4 > 0, F.array((i % 4).cast("string"), F.lit("4"))).otherwise(none)
    b = F.when(i % 5 < 5, F.array((i % 5).cast("string")))
    r = M.error_reasons(F.when(i % 6 == 0, "low").otherwise("high"), F.when(i % 9 == 0, "x"), F.col("gold"), F.col("pred"), a, b)
    return gold(spark, sf).groupBy(r.alias("reason")).agg(F.count("*").alias("n"))


ML = f"SELECT event_id, list_distinct(l2) AS a, list_filter(list_distinct(l2), lambda x: x <> 'L2-0' || (1 + event_id % 6)) AS b FROM ({EV})"


def multilabel(spark, sf):
    miss = F.concat(F.lit("L2-0"), (1 + F.col("event_id") % 6).cast("string"))
    e = events(spark, sf).withColumn("miss", miss)
    return e.select("event_id", F.array_distinct("l2").alias("a"), F.array_remove(F.array_distinct("l2"), F.col("miss")).alias("b"))


@query(f"WITH m AS ({ML}), x AS (SELECT b, unnest(a) AS ref FROM m), y AS (SELECT ref, unnest(b) AS pred FROM x) SELECT ref, pred, count(*) AS n FROM y GROUP BY 1, 2")
def multilabel_confusion(spark, sf):
    return M.multilabel_cells(multilabel(spark, sf), "a", "b")


@query(f"""WITH m AS ({ML}), a AS (SELECT label, count(*) AS support FROM (SELECT unnest(a) AS label FROM m) GROUP BY 1), b AS (SELECT label, count(*) AS predicted FROM (SELECT unnest(b) AS label FROM m) GROUP BY 1),
h AS (SELECT label, count(*) AS hit FROM (SELECT unnest(list_intersect(a, b)) AS label FROM m) GROUP BY 1),
j AS (SELECT label, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(hit, 0) AS hit FROM a FULL JOIN b USING (label) LEFT JOIN h USING (label))
SELECT label, support, predicted, hit, round(hit / CAST(predicted AS DOUBLE), 6) AS precision, round(hit / CAST(support AS DOUBLE), 6) AS recall, round(2.0 * hit / (predicted + support), 6) AS f1 FROM j""")
def multilabel_prf(spark, sf):
    s = M.multilabel_scores(multilabel(spark, sf), "a", "b")
    return s.select("label", "support", "predicted", "hit", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH m AS ({ML}), a AS (SELECT label, count(*) AS support FROM (SELECT unnest(a) AS label FROM m) GROUP BY 1), b AS (SELECT label, count(*) AS predicted FROM (SELECT unnest(b) AS label FROM m) GROUP BY 1),
h AS (SELECT label, count(*) AS hit FROM (SELECT unnest(list_intersect(a, b)) AS label FROM m) GROUP BY 1), j AS (SELECT label, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(hit, 0) AS hit FROM a FULL JOIN b USING (label) LEFT JOIN h USING (label))
SELECT round(2.0 * sum(hit) / (sum(predicted) + sum(support)), 6) AS micro_f1, round(avg(2.0 * hit / (predicted + support)), 6) AS macro_f1 FROM j""")
def multilabel_f1(spark, sf):
    return M.micro_macro(M.multilabel_scores(multilabel(spark, sf), "a", "b")).select(F.round("micro_f1", 6).alias("micro_f1"), F.round("macro_f1", 6).alias("macro_f1"))


@query(f"""WITH m AS ({ML}), x AS (SELECT b, unnest(a) AS ref FROM m), y AS (SELECT ref, unnest(b) AS pred FROM x), c AS (SELECT ref, pred, count(*) AS n FROM y GROUP BY 1, 2) SELECT ref, string_agg(pred || ':' || n, ', ' ORDER BY n DESC, pred) AS distribution FROM c GROUP BY ref""")
def multilabel_distribution(spark, sf):
    cells = M.multilabel_cells(multilabel(spark, sf), "a", "b").withColumnRenamed("ref", "true")
    return M.prediction_distribution(cells, by_count=True).withColumnRenamed("true", "ref")


@query(f"""WITH g AS ({GOLD}), v AS (SELECT *, doc_id % 4 > 0 AND doc_id % 3 > 0 AS hit FROM g WHERE gold IS NOT NULL) SELECT count(*) FILTER (hit) AS n_subset, count(*) FILTER (NOT hit) AS n_excluded, round(avg(CASE WHEN hit THEN CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END END), 6) AS accuracy FROM v""")
def conditional_l1(spark, sf):
    i, none = F.col("doc_id"), F.array().cast("array<string>")
    g = gold(spark, sf).withColumns({"a": F.when(i % 4 > 0, F.array(F.lit("x"))).otherwise(none), "b": F.when(i % 3 > 0, F.array(F.lit("y"))).otherwise(none)})
    return U.conditional(g, "gold", "pred", "a", "b")[1].withColumn("accuracy", F.round("accuracy", 6))


@query(f"""WITH g AS ({GOLD}), v AS (SELECT * FROM g WHERE gold IS NOT NULL AND doc_id % 4 > 0 AND doc_id % 3 > 0), s AS (SELECT gold AS l FROM v UNION SELECT pred FROM v), c AS (SELECT a.l AS "true", b.l AS pred, (SELECT count(*) FROM v WHERE v.gold = a.l AND v.pred = b.l) AS n FROM s a, s b), {PRF}
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM f""")
def conditional_prf(spark, sf):
    i, none = F.col("doc_id"), F.array().cast("array<string>")
    g = gold(spark, sf).withColumns({"a": F.when(i % 4 > 0, F.array(F.lit("x"))).otherwise(none), "b": F.when(i % 3 > 0, F.array(F.lit("y"))).otherwise(none)})
    p = M.precision_recall(U.conditional(g, "gold", "pred", "a", "b")[0])
    return p.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("""WITH a AS (SELECT lang, count(*) AS n_a, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share_a FROM documents GROUP BY 1), b AS (SELECT lang, count(*) AS n_b, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share_b FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY 1)
SELECT lang, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, round((coalesce(share_a, 0) - coalesce(share_b, 0)) * 100, 6) AS diff_pp, abs((coalesce(share_a, 0) - coalesce(share_b, 0)) * 100) > 2 AS flag FROM a FULL JOIN b USING (lang)""")
def drift_compare(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    bad = d.join(table(spark, sf, "labels").where("quality = 0").select("doc_id"), "doc_id")
    return M.drift(d, bad, "lang", 2.0).select("lang", "n_a", "n_b", F.round("diff_pp", 6).alias("diff_pp"), "flag")


@query("""WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS o FROM orders GROUP BY 1, 2), r AS (SELECT a, sum(o) AS r FROM c GROUP BY 1), k AS (SELECT b, sum(o) AS k FROM c GROUP BY 1), t AS (SELECT sum(o) AS t FROM c),
e AS (SELECT a, b, coalesce(o, 0) AS o, r * k / CAST(t AS DOUBLE) AS e, t FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c USING (a, b)), s AS (SELECT sum((o - e) * (o - e) / e) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof, CAST(max(t) AS BIGINT) AS n, least(count(DISTINCT a), count(DISTINCT b)) - 1 AS low FROM e)
SELECT round(chi2, 6) AS chi2, dof, n, round(sqrt(chi2 / (n * low)), 6) AS cramers_v FROM s""")
def chi2_cramers_v(spark, sf):
    c = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return M.chi_square(c, "o_orderpriority", "o_orderstatus").select(F.round("chi2", 6).alias("chi2"), "dof", "n", F.round("cramers_v", 6).alias("cramers_v"))


@query(f"""WITH e AS ({EV}), s AS (SELECT l1, 'event_type' AS dim, event_type AS value FROM e UNION ALL SELECT l1, 'user_id', CAST(user_id AS VARCHAR) FROM e), n AS (SELECT dim, value, l1, count(*) AS c FROM s GROUP BY 1, 2, 3), t AS (SELECT dim, value, sum(c) AS n, max(c) AS m FROM n GROUP BY 1, 2 HAVING sum(c) >= 20)
SELECT dim, value, CAST(t.n AS BIGINT) AS n, max(l1) AS top_label, round(m / CAST(t.n AS DOUBLE), 6) AS top_share, m / CAST(t.n AS DOUBLE) >= 0.17 AS dominant FROM t JOIN n USING (dim, value) WHERE c = m GROUP BY dim, value, t.n, m""")
def slice_diagnostics(spark, sf):
    return M.slice_flags(events(spark, sf), ["event_type", "user_id"], "l1", 20, 0.17).select("dim", "value", "n", "top_label", F.round("top_share", 6).alias("top_share"), "dominant")


@query(f"""WITH e AS ({EV}), c AS (SELECT l1, l2, count(*) AS corpus_n FROM (SELECT l1, unnest(l2) AS l2, event_id FROM e) GROUP BY 1, 2), v AS (SELECT l1, l2, count(*) AS val_n FROM (SELECT l1, unnest(l2) AS l2, event_id FROM e WHERE event_id % 50 = 0) GROUP BY 1, 2),
p AS (SELECT * FROM (VALUES ('L1-01', 'L2-01'), ('L1-09', 'L2-02'), ('L1-03', 'L2-09')) t(l1, l2)), t AS (SELECT l1, l2, 'theoretical_low_prior' AS reason, coalesce(corpus_n, 0) AS corpus_n, CASE WHEN l1 IN (SELECT l1 FROM v) AND l2 IN (SELECT l2 FROM v) THEN coalesce(val_n, 0) END AS validation_n FROM p LEFT JOIN c USING (l1, l2) LEFT JOIN v USING (l1, l2))
SELECT l1 AS "L1", l2 AS "L2", reason, corpus_n, validation_n FROM t UNION ALL SELECT l1, l2, 'zero_in_validation_high_in_corpus', corpus_n, 0 FROM c LEFT JOIN v USING (l1, l2) WHERE corpus_n >= 20 AND val_n IS NULL""")
def joint_low_prior(spark, sf):
    e = events(spark, sf)
    pairs = U.low_prior_pairs(spark, [("L1-01", "L2-01"), ("L1-09", "L2-02")], spark.createDataFrame([(" L1-03", "L2-09 ")], "L1 string, L2 string"))
    return U.joint_flags(U.joint_counts(e, "l1", "l2"), U.joint_counts(e.where(F.col("event_id") % 50 == 0), "l1", "l2"), pairs)


@query(f"""WITH e AS ({EV}), s AS (SELECT l1, l2, 'type' AS slice, event_type AS key FROM e UNION ALL SELECT l1, l2, 'user', CAST(user_id AS VARCHAR) FROM e), n AS (SELECT slice, key, l1, count(*) AS c FROM s GROUP BY 1, 2, 3), f AS (SELECT slice, key, CAST(sum(c) AS BIGINT) AS n, max(c) AS m FROM n GROUP BY 1, 2 HAVING sum(c) >= 20),
t AS (SELECT slice, key, f.n, min(l1) AS top_L1, max(m) AS m FROM f JOIN n USING (slice, key) WHERE c = m GROUP BY slice, key, f.n), x AS (SELECT slice, key, l2, count(*) AS c FROM (SELECT slice, key, unnest(l2) AS l2 FROM s) GROUP BY 1, 2, 3), y AS (SELECT slice, key, max(c) AS top FROM x GROUP BY 1, 2), z AS (SELECT slice, key, any_value(top) AS top, avg(CASE WHEN c < top THEN c END) AS mean FROM x JOIN y USING (slice, key) GROUP BY 1, 2)
SELECT slice, key, n, top_L1, round(m / CAST(n AS DOUBLE), 6) AS top_L1_share, round(coalesce(top, 0) / CAST(n AS DOUBLE), 6) AS max_L2_row_prev, concat_ws('|', CASE WHEN m / CAST(n AS DOUBLE) >= 0.17 THEN 'dominant_L1' END, CASE WHEN (top / CAST(n AS DOUBLE)) / (mean / n + 1e-9) > 1.9 THEN 'skewed_L2_vs_slice_mean' END) AS flags FROM t LEFT JOIN z USING (slice, key)""")
def slice_skew(spark, sf):
    f = U.skew_flags(events(spark, sf), {"type": "event_type", "user": "user_id"}, "l1", "l2", 20, 0.17, 1.9)
    return f.withColumns({c: F.round(c, 6) for c in ("top_L1_share", "max_L2_row_prev")})


@query(f"""WITH e AS ({EV}), s AS (SELECT avg(CASE WHEN len(l2) = 0 THEN 1.0 ELSE 0.0 END) AS c, avg(CASE WHEN event_id % 10 = 0 THEN CASE WHEN len(l2) = 0 THEN 1.0 ELSE 0.0 END END) AS v FROM e) SELECT round(c, 6) AS corpus_rate, round(v, 6) AS validation_rate, CASE WHEN c > 0.30 AND c > v + 0.10 THEN 'high' WHEN c < 0.10 AND c < v - 0.08 THEN 'low' ELSE 'ok' END AS warning, v < 0.18 OR v > 0.20 AS unusual FROM s""")
def empty_l2_gate(spark, sf):
    none = (F.size("l2") == 0).cast("double")
    s = events(spark, sf).agg(F.avg(none).alias("c"), F.avg(F.when(F.col("event_id") % 10 == 0, none)).alias("v"))
    return s.select(F.round("c", 6).alias("corpus_rate"), F.round("v", 6).alias("validation_rate"), M.empty_warning(F.col("c"), F.col("v")).alias("warning"), U.empty_band(F.col("v")).alias("unusual"))


@query(f"WITH e AS ({EV}), o AS (SELECT list_distinct(l2) AS l FROM e), x AS (SELECT l, unnest(l) AS a FROM o), y AS (SELECT a, unnest(l) AS b FROM x) SELECT a, b, count(*) AS n FROM y WHERE a <> b GROUP BY 1, 2")
def cooccurrence(spark, sf):
    return M.cooccurrence(events(spark, sf), "l2")


SEGMENTS = {"BUILDING": "b", "MACHINERY": "m", "HOUSEHOLD": "h"}
_T2 = f"WITH j AS (SELECT o_orderpriority AS label, c_mktsegment AS g FROM orders JOIN customer ON o_custkey = c_custkey), t AS (SELECT {', '.join(f"count(*) FILTER (g = '{g}') AS t{k}" for g, k in SEGMENTS.items())} FROM j), c AS (SELECT label, {', '.join(f"count(*) FILTER (g = '{g}') AS n_{k}" for g, k in SEGMENTS.items())} FROM j GROUP BY 1), s AS (SELECT unnest(['1-URGENT', '2-HIGH', '9-NONE']) AS label)"


@query(f"{_T2} SELECT label, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}, CASE WHEN t{k} = 0 THEN 0 ELSE round_even(100.0 * coalesce(n_{k}, 0) / t{k}, 1) END AS pct_within_{k}' for k in SEGMENTS.values())}, {' + '.join(f'coalesce(n_{k}, 0)' for k in SEGMENTS.values())} AS n_total FROM s LEFT JOIN c USING (label), t")
def table2_wide(spark, sf):
    j = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderpriority").alias("p"), "c_mktsegment")
    labels = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("9-NONE",)], "label string")
    return M.wide_shares(j, "c_mktsegment", "p", SEGMENTS, labels)


@query(f"""WITH e AS ({EV}), b AS (SELECT event_type, count(*) AS n FROM e GROUP BY 1), h AS (SELECT event_type, l1 AS label, count(*) AS hits FROM e GROUP BY 1, 2), s AS (SELECT 'L1-' || lpad(CAST(r AS VARCHAR), 2, '0') AS label FROM range(1, 10) t(r)) SELECT event_type, label, round(coalesce(hits, 0) / CAST(n AS DOUBLE), 8) AS share FROM b CROSS JOIN s LEFT JOIN h USING (event_type, label)""")
def figure1_shares(spark, sf):
    return M.share_matrix(events(spark, sf), "event_type", "l1", space(spark, "L1", 9)).withColumn("share", F.round("share", 8))


@query(f"""WITH e AS ({EV}), w AS (SELECT * FROM e WHERE len(l2) > 0), b AS (SELECT event_type, count(*) AS n FROM w GROUP BY 1), h AS (SELECT event_type, label, count(*) AS hits FROM (SELECT event_type, unnest(list_distinct(l2)) AS label, event_id FROM w) GROUP BY 1, 2), s AS (SELECT 'L2-' || lpad(CAST(r AS VARCHAR), 2, '0') AS label FROM range(1, 9) t(r))
SELECT event_type, label, n, coalesce(hits, 0) AS hits, round(coalesce(hits, 0) / CAST(n AS DOUBLE), 8) AS prevalence FROM b CROSS JOIN s LEFT JOIN h USING (event_type, label)""")
def table3_prev_grid(spark, sf):
    g = M.prevalence_grid(events(spark, sf), "event_type", "l2", space(spark, "L2", 8))
    return g.withColumn("prevalence", F.round("prevalence", 8))


L2_ORDER = [f"L2-0{i}" for i in range(1, 8)]


@query(f"""WITH e AS ({EV}), c AS (SELECT l1 AS label, count(*) AS n, {', '.join(f"count(*) FILTER (list_contains(l2, '{x}')) AS h{i}" for i, x in enumerate(L2_ORDER))} FROM e GROUP BY 1), s AS (SELECT 'L1-' || lpad(CAST(r AS VARCHAR), 2, '0') AS label FROM range(1, 10) t(r))
SELECT label, coalesce(n, 0) AS n, {', '.join(f'CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE round_even(100.0 * h{i} / n, 1) END AS "{x}"' for i, x in enumerate(L2_ORDER))} FROM s LEFT JOIN c USING (label)""")
def table5_joint(spark, sf):
    return M.joint_wide(events(spark, sf), "l1", "l2", space(spark, "L1", 9), L2_ORDER)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "9-NONE"]


@query("SELECT strftime(o_orderdate, '%Y-%m') AS period, " + ", ".join(f"round(avg(CASE WHEN o_orderpriority = '{p}' THEN 1.0 ELSE 0.0 END), 8) AS \"{p}\"" for p in PRIORITIES) + " FROM orders GROUP BY 1")
def l1_trend_month(spark, sf):
    o = table(spark, sf, "orders").select(T.period(F.col("o_orderdate")).alias("period"), "o_orderpriority")
    t = M.trend_wide(o, "period", "o_orderpriority", PRIORITIES)
    return t.select("period", *[F.round(F.col(f"`{p}`"), 8).alias(p) for p in PRIORITIES])


@query(f"""WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS period FROM ({EV})), b AS (SELECT period, count(*) AS n FROM e GROUP BY 1), h AS (SELECT period, label, count(*) AS n FROM (SELECT period, unnest(l2) AS label FROM e) GROUP BY 1, 2) SELECT period, label, h.n, round(h.n / CAST(b.n AS DOUBLE), 8) AS prevalence FROM h JOIN b USING (period)""")
def l2_trend(spark, sf):
    e = events(spark, sf).withColumn("period", F.date_format("ts", "yyyy-MM-dd"))
    return M.trend_long(e, "period", "l2").withColumn("prevalence", F.round("prevalence", 8))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 1.0 ELSE 0.0 END) AS share FROM events GROUP BY 1), c AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS DATE) AS day)
SELECT strftime(day, '%Y-%m-%d') AS day, round(coalesce(share, 0), 8) AS share, round(avg(coalesce(share, 0)) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 8) AS ma FROM c LEFT JOIN d USING (day)""")
def daily_share_ma7(spark, sf):
    e = table(spark, sf, "events")
    first = e.agg(F.min("event_type").alias("first"))
    d = e.crossJoin(F.broadcast(first)).groupBy(F.to_date("ts").alias("day")).agg(F.avg((F.col("event_type") == F.col("first")).cast("double")).alias("share"))
    return O.moving_average(d, "day", "share").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("share", 8).alias("share"), F.round("ma", 8).alias("ma"))


@query("SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")
def weekly_bins(spark, sf):
    return table(spark, sf, "events").groupBy(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("SELECT o_orderkey, CASE WHEN floor(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-13')) < 90 THEN 'within_3m' WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-13') < 180 THEN 'within_6m' ELSE 'over_6m' END AS bucket FROM orders")
def time_bucket(spark, sf):
    days = F.datediff(F.lit("1998-01-13").cast("date"), F.to_date("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", F.when(days.isNull(), "unknown").when(days < 90, "within_3m").when(days < 180, "within_6m").otherwise("over_6m").alias("bucket"))


PHASES = [("1996-07-01", "Primary season"), ("1997-11-25", "Nomination period"), ("1998-12-16", "General campaign"), ("2000-01-12", "Final sprint")]


@query("SELECT CASE " + " ".join(f"WHEN CAST(o_orderdate AS DATE) < DATE '{b}' THEN '{n}'" for b, n in PHASES) + " ELSE 'Post-election' END AS phase, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY 1, 2")
def election_phase_profile(spark, sf):
    p = T.interval_label(F.to_date("o_orderdate"), PHASES, "Post-election", "No valid date")
    return table(spark, sf, "orders").groupBy(p.alias("phase"), "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


@query("""WITH v AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM embeddings), c AS (SELECT pos, avg(CAST(x AS DOUBLE)) AS c FROM v WHERE label = 0 GROUP BY 1),
s AS (SELECT vec_id, sum(x * c) / (sqrt(sum(CAST(x AS DOUBLE) * x)) * sqrt(sum(c * c))) AS sim FROM v JOIN c USING (pos) GROUP BY 1), q AS (SELECT quantile_cont(sim, 0.2) AS k, quantile_cont(sim, 0.05) AS d FROM s)
SELECT vec_id, round(sim, 4) AS sim, CASE WHEN sim >= greatest(0.42, k) THEN 'KEEP' WHEN sim < least(0.28, d) THEN 'DROP' ELSE 'REVIEW' END AS status FROM s, q""")
def centroid_cosine_threshold(spark, sf):
    """Cosine similarity with a label's centroid and the adaptive three-way threshold."""
    e = table(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    s = e.crossJoin(F.broadcast(SI.centroid(e.where("label = 0"), "v"))).select("vec_id", SI.cosine(F.col("v"), F.col("centroid")).alias("sim"))  # one row
    q = s.agg(F.percentile("sim", F.lit(0.2)).alias("q20"), F.percentile("sim", F.lit(0.05)).alias("q05"))
    return s.crossJoin(F.broadcast(q)).select("vec_id", F.round("sim", 4).alias("sim"), ML_.semantic_status(F.col("sim"), q).alias("status"))


@query("""WITH u AS (SELECT o_custkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS batch, o_orderkey AS ord, o_orderstatus AS st FROM orders), f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY batch, ord) = 1) SELECT id, batch, ord, st FROM f""")
def batch_merge_first_wins(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("st"))
    return A.merge_batches([o.where(F.col("ord") % 3 == r) for r in range(3)], "ord").select("id", "batch", "ord", "st")


VALID = [f"L1-0{i}" for i in range(1, 8)]


@query("""WITH p AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), r AS (SELECT event_id, k % 11 AS e, CASE WHEN k % 9 > 7 THEN 'xx' ELSE 'L1-0' || (k % 9) || '_name' END AS raw, k FROM p), c AS (SELECT *, CASE WHEN regexp_extract(raw, '^(L1-\\d+)', 1) <> '' THEN regexp_extract(raw, '^(L1-\\d+)', 1) ELSE raw END AS code FROM r),
d AS (SELECT event_id, code, CASE WHEN k % 9 = 0 THEN 'missing response' WHEN e = 0 THEN 'Empty content' WHEN code NOT IN ('L1-01','L1-02','L1-03','L1-04','L1-05','L1-06','L1-07') THEN 'invalid L1 code' ELSE '' END AS error FROM c)
SELECT event_id, CASE WHEN error = '' THEN code END AS "L1_label", error AS "L1_error" FROM d""")
def llm_response_parse(spark, sf):
    """Codes out of JSON answers, held against the codebook."""
    ref, answers = _asked(spark, sf)
    return A.join_answers(ref, answers, "event_id", VALID, None).select("event_id", "L1_label", "L1_error")


def _asked(spark, sf):
    """Events as rows asked about, and answers to most of them; some are empty, some labels unknown."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf, "events").select("event_id", k.alias("k"))
    first = F.when(F.col("k") % 9 > 7, "xx").otherwise(F.concat(F.lit("L1-0"), (F.col("k") % 9).cast("string"), F.lit("_name")))
    second = F.when(F.col("k") % 5 == 0, F.lit('"L2-01"')).otherwise(F.concat(F.lit('["L2-0'), (F.col("k") % 5).cast("string"), F.lit('", " L2-03 ", "zz"]')))
    body = F.concat(F.lit('{"L1": "'), first, F.lit('", "L1_cot": "c", "L2": '), second, F.lit("}"))
    empty = F.col("k") % 11 == 0
    answers = e.where(F.col("k") % 9 != 0).select("event_id", F.when(~empty, body).alias("content"), F.when(empty, "Empty content").alias("error"))
    return e.select("event_id"), answers


@query("""WITH p AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
d AS (SELECT event_id, k % 9 = 0 AS missing, k % 11 = 0 AS empty, k % 5 AS m FROM p)
SELECT event_id, CASE WHEN missing OR empty OR m = 0 THEN '' WHEN m <= 3 THEN 'L2-0' || m || '|L2-03' ELSE 'L2-03' END AS "L2_labels", CASE WHEN missing THEN '' WHEN empty THEN 'Empty content' WHEN m = 0 THEN 'L2 field not a list' ELSE '' END AS "L2_error", CASE WHEN missing OR empty OR m = 0 THEN 0 WHEN m <= 3 THEN 1 ELSE 2 END AS "L2_dropped" FROM d""")
def llm_l2_parse(spark, sf):
    """Label lists out of JSON answers: unknown labels dropped, no answer no error."""
    ref, answers = _asked(spark, sf)
    return A.join_answers(ref, answers, "event_id", None, ["L2-01", "L2-02", "L2-03"]).select("event_id", "L2_labels", "L2_error", "L2_dropped")


@query("""WITH p AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), d AS (SELECT k % 9 = 0 AS missing, k % 11 = 0 AS empty, k % 5 AS m, k % 9 BETWEEN 1 AND 7 AS ok FROM p), f AS (SELECT *, missing OR empty OR m = 0 AS none FROM d)
SELECT count(*) AS n_rows, count(*) FILTER (NOT missing AND NOT empty AND ok) AS n_l1_valid, count(*) FILTER (missing OR empty OR NOT ok) AS n_l1_error, count(*) FILTER (none) AS n_l2_empty, count(*) FILTER (NOT none) AS n_l2_rows_dropped, CAST(coalesce(sum(CASE WHEN none THEN 0 WHEN m <= 3 THEN 1 ELSE 2 END), 0) AS BIGINT) AS n_l2_dropped FROM f""")
def answer_quality(spark, sf):
    ref, answers = _asked(spark, sf)
    return A.answer_quality(A.join_answers(ref, answers, "event_id", VALID, ["L2-01", "L2-02", "L2-03"]))


@query("""WITH p AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT CASE WHEN k % 9 = 0 THEN 'missing response' WHEN k % 11 = 0 THEN 'Empty content' ELSE 'invalid L1 code' END AS error, count(*) AS n FROM p WHERE k % 9 = 0 OR k % 11 = 0 OR k % 9 = 8 GROUP BY 1""")
def answer_errors(spark, sf):
    ref, answers = _asked(spark, sf)
    return A.error_counts(A.join_answers(ref, answers, "event_id", VALID, None), "L1_error")


@query(f"""WITH m AS ({ML}), r AS (SELECT event_id, a AS x, b AS y, CASE WHEN event_id % 4 = 0 THEN a ELSE b END AS z, 'L1-0' || (1 + event_id % 7) AS p, CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'L1-0' || (1 + event_id % 7) END AS q FROM m),
j AS (SELECT CASE WHEN len(list_distinct(x || y)) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / CAST(len(list_distinct(x || y)) AS DOUBLE) END AS j1, CASE WHEN len(list_distinct(x || z)) = 0 THEN 1.0 ELSE len(list_intersect(x, z)) / CAST(len(list_distinct(x || z)) AS DOUBLE) END AS j2, CASE WHEN len(list_distinct(y || z)) = 0 THEN 1.0 ELSE len(list_intersect(y, z)) / CAST(len(list_distinct(y || z)) AS DOUBLE) END AS j3, coalesce(p = q, false) AS agree FROM r),
s AS (SELECT count(*) AS n, avg(CASE WHEN agree THEN 1.0 ELSE 0.0 END) AS a, avg(least(j1, j2, j3)) AS m, avg(CASE WHEN least(j1, j2, j3) >= 0.8 THEN 1.0 ELSE 0.0 END) AS t FROM j) SELECT n, round(a, 6) AS l1_agreement, round(m, 6) AS l2_mean_min_jaccard, round(t, 6) AS l2_share_stable, a < 0.85 AS vote_l1, t < 0.80 AS vote_l2 FROM s""")
def stability_jaccard(spark, sf):
    i = F.col("event_id")
    label = F.concat(F.lit("L1-0"), (1 + i % 7).cast("string"))
    r = multilabel(spark, sf).withColumns({"z": F.when(i % 4 == 0, F.col("a")).otherwise(F.col("b")), "p": label, "q": F.when(i % 6 != 0, label)})
    s = A.stability(r, ["p", "q", "p"], ["a", "b", "z"])
    return s.withColumns({c: F.round(c, 6) for c in ("l1_agreement", "l2_mean_min_jaccard", "l2_share_stable")})


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark, sf):
    return O.latest(table(spark, sf, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("SELECT event_id, ts FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 80")
def notes_latest80(spark, sf):
    return table(spark, sf, "events").where("user_id = 7").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(80)


@query("SELECT o_orderkey AS custom_id, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 50) AS BIGINT) AS part FROM orders WHERE o_orderstatus = 'P'")
def request_parts(spark, sf):
    """Fixed-size request parts in the order of their ids."""
    return P.request_parts(table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("custom_id")), "custom_id")


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 40)")
def resume_missing_parts(spark, sf):
    done = table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def best_status_per_part(spark, sf):
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return O.latest(table(spark, sf, "orders"), ["o_custkey"], [rank.asc(), F.asc("o_orderkey")]).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT count(*) AS n_docs, round(avg(CASE WHEN rn > 1 THEN 1.0 ELSE 0.0 END), 6) AS dup_rate, count(*) FILTER (length(text) < 100) AS n_short, count(*) FILTER (contains(text, '|')) AS n_flagged FROM (SELECT text, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents)")
def quick_report(spark, sf):
    g = table(spark, sf, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.count("*").alias("n"), F.count_if(F.length("text") < 100).alias("s"), F.count_if(F.contains("text", F.lit("|"))).alias("f"))
    return g.agg(F.sum("n").alias("n_docs"), F.round(F.sum(F.col("n") - 1) / F.sum("n"), 6).alias("dup_rate"), F.sum("s").alias("n_short"), F.sum("f").alias("n_flagged"))


@query("SELECT least(b, 59) AS bin, round(least(b, 59) * (800 / 60.0), 6) AS low, count(*) AS n FROM (SELECT CAST(floor(least(length(text), 800) / (800 / 60.0)) AS BIGINT) AS b FROM documents) GROUP BY ALL")
def length_histogram(spark, sf):
    return sinks.histogram(table(spark, sf, "documents"), F.length("text"), 800, 60).withColumn("low", F.round("low", 6))