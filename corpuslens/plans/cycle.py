"""Queries round annotation: ingest, samples, requests, answers, audit. Inputs are made from the test
tables by arithmetic that both engines can do."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers as A
from ..operators import audit as U
from ..operators import ingest as I
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import order as O
from ..operators import prompts as P
from ..operators import rules as R
from ..operators import sampling as SA
from ..sources import sinks
from . import table
from .analytics import EV, events

CATALOGUE: dict = {}


def query(sql: str | None = None):
    def add(run):
        CATALOGUE[run.__name__] = (run, sql)
        return run

    return add


def choose(c, *values):
    """values[c] for c from 0 on, the last beyond."""
    out = F.when(c == 0, values[0])
    for i, v in enumerate(values[1:-1], 1):
        out = out.when(c == i, v)
    return out.otherwise(values[-1])


@query("""
WITH p AS (SELECT url, html, CASE page_id % 4 WHEN 0 THEN '2023-07-0' || (1 + page_id % 9) WHEN 1 THEN '2023/07/15 10:30' WHEN 2 THEN '2023-07-15T08:00:00+08:00' ELSE 'soon' END AS d, CASE WHEN page_id % 5 = 0 THEN '' ELSE 'web' END AS s FROM pages)
SELECT s || '_' || substr(md5(url || '' || substr(html, 1, 100)), 1, 12) AS doc_id, CASE WHEN s = '' THEN 'file' ELSE s END AS source, d AS date, strftime(coalesce(try_strptime(d, '%Y-%m-%d'), try_strptime(d, '%Y/%m/%d %H:%M'), try_strptime(left(d, 19), '%Y-%m-%dT%H:%M:%S')), '%Y-%m-%d %H:%M') AS date_std, d <> 'soon' AS date_parse_ok FROM p
""")
def normalize_documents(spark, sf):
    """Raw pages under other names to documents with keys and dates."""
    i = F.col("page_id")
    when = choose(i % 4, F.concat(F.lit("2023-07-0"), (1 + i % 9).cast("string")), "2023/07/15 10:30", "2023-07-15T08:00:00+08:00", "soon")
    raw = table(spark, sf, "pages").select(F.col("url").alias("link"), F.col("html").alias("body"), when.alias("pub_time"), F.when(i % 5 == 0, "").otherwise("web").alias("source"))
    d = I.default_source(I.normalize_columns(raw), F.lit("file"))
    return d.select("doc_id", "source", "date", F.date_format("date_std", "yyyy-MM-dd HH:mm").alias("date_std"), "date_parse_ok")


@query("""
WITH d AS (SELECT doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean FROM documents)
SELECT doc_id, text AS content_orig, clean AS content_clean, nfc_normalize(clean) AS content_norm, CAST(clean <> text AND clean <> '' AS INT) AS space_norm FROM d
""")
def dual_text(spark, sf):
    d = I.dual_text(table(spark, sf, "documents").select("doc_id", F.col("text").alias("content")))
    return d.select("doc_id", "content_orig", "content_clean", "content_norm", "clean_meta.space_norm")


@query("""
WITH d AS (SELECT doc_id, source AS s, lang AS f, CASE doc_id % 3 WHEN 0 THEN '2024-0' || (1 + doc_id % 9) || '-15' WHEN 1 THEN '2023/11/30 09:00' ELSE 'x' END AS date FROM documents),
c AS (SELECT *, CASE WHEN contains(s, 'src3') OR contains(s, 'src1') THEN 'Ann' WHEN contains(s, 'src2') THEN 'Bob' ELSE 'Unknown' END AS candidate FROM d)
SELECT doc_id, candidate, CASE candidate WHEN 'Ann' THEN 'X' WHEN 'Bob' THEN 'Y' ELSE 'Unknown' END AS party, CASE WHEN contains(f, 'fr') THEN 'social_media' WHEN contains(f, 'de') OR contains(f, 'es') THEN 'conference' ELSE 'news' END AS source_type,
 coalesce(strftime(coalesce(try_strptime(date, '%Y-%m-%d'), try_strptime(date, '%Y/%m/%d %H:%M')), '%Y-%m'), '_nodate') AS _period FROM c
""")
def derived_columns(spark, sf):
    i = F.col("doc_id")
    when = choose(i % 3, F.concat(F.lit("2024-0"), (1 + i % 9).cast("string"), F.lit("-15")), "2023/11/30 09:00", "x")
    d = table(spark, sf, "documents").select("doc_id", "source", F.col("lang").alias("_source_file"), when.alias("date"))
    out = I.derived_columns(d, [(["src3", "SRC1"], "Ann"), (["src1"], "Ann"), (["src2"], "Bob")], [("Ann", "X"), ("Bob", "Y")], [(["fr"], "social_media"), (["de", "es"], "conference")])
    return out.select("doc_id", "candidate", "party", "source_type", "_period")


@query("""
SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN '(blank)' WHEN contains(source, 'src1') OR contains(source, '5') THEN 'Tens' WHEN contains(source, 'src0') THEN 'Zero' ELSE source END AS outlet,
 CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE lang END AS shown, source || '.tar' AS bare, replace(replace(lang || ':a/b', ':', '_'), '/', '_') AS safe FROM documents
""")
def source_names(spark, sf):
    raw = F.when(F.col("doc_id") % 6 == 0, " ").otherwise(F.col("source"))
    outlet = T.substring_label(raw, [(["src1", "5"], "Tens"), (["src0"], "Zero")], raw, "(blank)")
    return table(spark, sf, "documents").select("doc_id", outlet.alias("outlet"), T.display(F.col("lang"), {"en": "English", "fr": "French"}).alias("shown"), T.without_suffix(F.concat(F.lit(" "), "source", F.lit(".tar.CSV"))).alias("bare"), T.file_safe(F.concat("lang", F.lit(":a/b"))).alias("safe"))


@query("""
SELECT doc_id, (contains(text, 'that') OR contains(text, 'pour')) AND NOT (contains(text, 'with a') OR contains(text, 'pour le')) AS key_hit,
 NOT regexp_matches(text, 'un[ae]s') AND (CAST(contains(text, 'the ') AS INT) + CAST(contains(text, 'der ') AS INT) >= 2 OR contains(text, 'from')) AS priority FROM documents
""")
def strong_and_priority(spark, sf):
    c = F.col("text")
    return table(spark, sf, "documents").select("doc_id", T.strong_keys(c, ["that", "pour"], ["with a", "pour le"]).alias("key_hit"), R.priority_bypass(c, R.bucket_score(c, [["the "], ["der "]]), ["from"], "un[ae]s").alias("priority"))


@query("""
WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Head 2024/01/02 10:00 2024/01/02  11:30 ' || text WHEN 1 THEN text || ' 2024/01/02 10:00 end' ELSE text END AS x FROM documents),
l AS (SELECT *, regexp_extract(substr(x, 1, 200), '(?s)^(.*\\d{4}/\\d{2}/\\d{2}\\s+\\d{2}:\\d{2})', 1) AS lead FROM d)
SELECT doc_id, CASE WHEN lead <> '' THEN regexp_replace(substr(x, length(lead) + 1), '^\\s+|\\s+$', '', 'g') ELSE x END AS body FROM l
""")
def lead_timestamps(spark, sf):
    i, c = F.col("doc_id"), F.col("text")
    x = choose(i % 3, F.concat(F.lit("Head 2024/01/02 10:00 2024/01/02  11:30 "), c), F.concat(c, F.lit(" 2024/01/02 10:00 end")), c)
    return table(spark, sf, "documents").select("doc_id", T.strip_lead_timestamps(x).alias("body"))


@query(f"""
WITH c AS (SELECT conv_id, turn, role, text, lag(text, 1, '') OVER w AS p, lead(text, 1, '') OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), t AS (SELECT *, trim(coalesce(text, ''), ' ' || chr(10) || chr(9)) AS s, trim(coalesce(p, ''), ' ' || chr(10) || chr(9)) AS a, trim(coalesce(n, ''), ' ' || chr(10) || chr(9)) AS b FROM c)
SELECT 'req_' || md5(conv_id || '-' || turn) AS custom_id, 0.2 AS temperature, CASE WHEN a = '' AND b = '' THEN '{P.INSTRUCTION}' || s ELSE '{P.BEFORE}' || a || chr(10) || '{P.TARGET}' || s || chr(10) || '{P.AFTER}' || b END AS content FROM t WHERE s <> ''
""")
def paired_requests(spark, sf):
    """Requests of one of two layers; ids are shared with the reference rows."""
    c = O.link_context(table(spark, sf, "conversations"), "conv_id", "turn", "text")
    ref, asked = P.paired_requests(c, "text", F.concat_ws("-", "conv_id", "turn"), "m", {"L1": F.lit("one"), "L2": F.lit("two")}, {"L1": 0.0, "L2": 0.2})
    both = asked["L2"].join(ref.select("custom_id"), "custom_id", "left_semi").join(asked["L1"].select("custom_id"), "custom_id", "left_semi")
    return both.select("custom_id", "body.temperature", F.col("body.messages")[1]["content"].alias("content"))


@query("""
WITH g AS (SELECT n_nationkey AS o, 'N-' || n_nationkey AS id, n_name AS cn, r_name AS def, CASE WHEN n_nationkey % 3 = 0 THEN 'N/A' WHEN n_nationkey % 3 = 1 THEN 'in ' || n_name END AS inc, CASE WHEN n_nationkey % 2 = 0 THEN 'not ' || r_name END AS exc FROM nation JOIN region ON n_regionkey = r_regionkey),
t AS (SELECT o, id, '[' || id || '_' || cn || '] 定義:' || def || chr(10) || CASE WHEN o % 3 = 1 THEN ' + ' || inc || chr(10) ELSE '' END || coalesce(' - ' || exc || chr(10), '') || CASE WHEN o % 4 = 0 THEN ' [例1] ex ' || o || chr(10) || ' [對比] vs ' || o || chr(10) ELSE '' END AS x FROM g)
SELECT 'Head' || chr(10) || string_agg(x, '' ORDER BY o) || 'Rules' || 'Legal: ' || string_agg(id, ', ' ORDER BY o) AS prompt FROM t
""")
def codebook_prompt(spark, sf):
    """A codebook with criteria and examples as one system message."""
    k = F.col("n_nationkey")
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    guide = n.select(k.alias("o"), F.concat(F.lit("N-"), k.cast("string")).alias("label_id"), F.col("n_name").alias("label_cn"), F.col("r_name").alias("core_definition"), F.when(k % 3 == 0, "N/A").when(k % 3 == 1, F.concat(F.lit("in "), "n_name")).alias("inclusion_criteria"), F.when(k % 2 == 0, F.concat(F.lit("not "), "r_name")).alias("exclusion_criteria"))
    shown = guide.where("o % 4 = 0").select("label_id", F.concat(F.lit("ex "), "o").alias("Fewshot_v1"), F.concat(F.lit("vs "), "o").alias("Fewshot_contrast"), "o")
    shown = shown.unionByName(shown.withColumns({"o": F.col("o") + 100, "Fewshot_v1": F.lit("later")}))
    book = P.codebook_text(guide, "o", shown)
    return book.select(P.system_prompt(book, "Head\n", "Rules", None, "Legal: {labels}").alias("prompt"))


@query("""
WITH p AS (SELECT n_name AS s, CASE n_regionkey WHEN 0 THEN '_other' ELSE 'R' || n_regionkey END AS g FROM nation WHERE n_nationkey % 5 < 4), q AS (SELECT c_custkey AS id FROM customer WHERE c_custkey <= 40),
m AS (SELECT id, s, md5('7:' || id || ':g:' || g) AS gh, md5('7:' || id || ':c:' || s) AS h FROM q, p), t AS (SELECT *, row_number() OVER (PARTITION BY id, gh ORDER BY h) AS turn FROM m),
r AS (SELECT id, s, row_number() OVER (PARTITION BY id ORDER BY turn, gh) AS rn, count(*) OVER (PARTITION BY id) AS n FROM t), k AS (SELECT CAST(unnest(range(0, 27)) AS BIGINT) AS k)
SELECT id, string_agg(s, '|' ORDER BY k) AS cases FROM r JOIN k ON rn = k % n + 1 GROUP BY id
""")
def hard_case_draws(spark, sf):
    """Cases drawn for each request, balanced over strata, again from the start when they run out."""
    n = table(spark, sf, "nation").where("n_nationkey % 5 < 4")
    pool = n.select(F.lit("L1").alias("layer"), F.when(F.col("n_regionkey") == 0, " ").otherwise(F.concat(F.lit("R"), "n_regionkey")).alias("stratum"), F.col("n_name").alias("sentence"), F.lit("L1-01").alias("gold_L1"))
    ids = table(spark, sf, "customer").where("c_custkey <= 40").select(F.col("c_custkey").alias("id"))
    drawn = P.draw_cases(ids, P.hard_pool(pool, "L1"), "id", 27, "7")
    return drawn.select("id", F.array_join(F.transform("cases", lambda r: r["sentence"]), "|").alias("cases"))


@query("""
WITH s AS (SELECT doc_id, lang AS g, CASE WHEN doc_id % 7 < 3 THEN 'news' WHEN doc_id % 7 = 3 THEN CASE WHEN lang = 'es' THEN 'news' ELSE 'conference' END WHEN doc_id % 7 < 6 THEN 'social_media' ELSE 'other' END AS st, CASE doc_id % 4 WHEN 0 THEN 'within_3m' WHEN 1 THEN 'within_6m' WHEN 2 THEN 'over_6m' ELSE 'unknown' END AS p, md5('5:' || doc_id) AS h FROM documents),
q AS (SELECT *, CASE st WHEN 'news' THEN 20 WHEN 'conference' THEN 12 WHEN 'social_media' THEN 4 ELSE 0 END AS quota FROM s),
a AS (SELECT *, st <> 'conference' AND p <> 'unknown' AND row_number() OVER (PARTITION BY g, st, p ORDER BY h, doc_id) <= quota // 3 AS even FROM q),
b AS (SELECT *, row_number() OVER (PARTITION BY g, st ORDER BY even DESC, h, doc_id) <= quota AS taken, 40 - max(CASE WHEN st = 'news' THEN 20 ELSE 0 END) OVER (PARTITION BY g) - max(CASE WHEN st = 'conference' THEN 12 ELSE 0 END) OVER (PARTITION BY g) - max(CASE WHEN st = 'social_media' THEN 4 ELSE 0 END) OVER (PARTITION BY g) AS rest FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY taken, h, doc_id) AS extra FROM b)
SELECT doc_id, g, st, p FROM c WHERE taken OR extra <= rest
""")
def validation_sample(spark, sf):
    """Quotas by source and period of each group, with refill."""
    i = F.col("doc_id")
    st = F.when(i % 7 < 3, "news").when(i % 7 == 3, F.when(F.col("lang") == "es", "news").otherwise("conference")).when(i % 7 < 6, "social_media").otherwise("other")
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("g"), st.alias("st"), choose(i % 4, *SA.PERIODS, "unknown").alias("p"))
    return SA.validation_sample(d, "g", "st", "p", "doc_id", {"news": 20, "conference": 12, "social_media": 4}, ["conference"], 40, "5")


@query("""
WITH d AS (SELECT doc_id, lang, md5('8:' || doc_id) AS h FROM documents), c AS (SELECT doc_id, lang FROM d WHERE doc_id % 9 = 0 AND doc_id < 200), m AS (SELECT greatest(0, 50 - count(*)) AS m FROM c), p AS (SELECT 'en' AS lang, 0 AS i UNION ALL SELECT 'fr', 1 UNION ALL SELECT 'de', 2),
r AS (SELECT d.doc_id, d.lang, i, row_number() OVER (PARTITION BY d.lang ORDER BY h, d.doc_id) AS rn FROM d JOIN p USING (lang) WHERE d.doc_id NOT IN (SELECT doc_id FROM c))
SELECT doc_id, lang FROM c UNION ALL SELECT doc_id, lang FROM r, m WHERE rn <= m // 3 + CASE WHEN i < m % 3 THEN 1 ELSE 0 END
""")
def sample_top_up(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return SA.top_up(d, d.where("doc_id % 9 = 0 AND doc_id < 200"), "lang", ["en", "fr", "de"], "doc_id", 50, "8")


@query("""
WITH t AS (SELECT text, min(doc_id) AS o FROM documents WHERE text IS NOT NULL GROUP BY text),
a AS (SELECT text, 0 AS bucket FROM t WHERE contains(text, 'that ') ORDER BY md5('3:0:' || text), text LIMIT 19), b AS (SELECT text, 1 AS bucket FROM t WHERE contains(text, 'pour') ORDER BY md5('3:1:' || text), text LIMIT 16), c AS (SELECT text, 2 AS bucket FROM t WHERE contains(text, 'zzzz') LIMIT 12),
s AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c), f AS (SELECT text, row_number() OVER (ORDER BY o, text) AS rn FROM t WHERE text NOT IN (SELECT text FROM s))
SELECT md5(text) AS h, bucket FROM s UNION ALL SELECT md5(text), -1 FROM f WHERE rn <= 48 - (SELECT count(*) FROM s)
""")
def seed_texts(spark, sf):
    s = SA.pick_seeds(table(spark, sf, "documents"), "text", "doc_id", [(["that "], 0.40), (["pour"], 0.35), (["zzzz"], 0.25)], 48, "3")
    return s.select(F.md5(F.col("text").cast("binary")).alias("h"), "bucket")


@query("""
WITH n AS (SELECT n_nationkey AS k, CASE WHEN n_regionkey = 0 THEN '_other' ELSE 'R' || n_regionkey END AS g, CASE WHEN n_regionkey = 0 THEN '' ELSE 'R' || n_regionkey END AS s FROM nation), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY md5('2:' || k), k) AS round FROM n),
o AS (SELECT k, row_number() OVER (ORDER BY round, md5('2:' || s), k) AS i, count(*) OVER () AS n FROM r), a AS (SELECT unnest(range(0, 3)) AS a)
SELECT k, CAST(a AS INT) AS again FROM o, a WHERE a * n + i <= 60
""")
def draw_with_replacement(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_regionkey") == 0, "").otherwise(F.concat(F.lit("R"), "n_regionkey")).alias("s"))
    return SA.draw_balanced(n, "s", "k", 60, "2").select("k", "again")


@query()
def gap_sample(spark, sf):
    """Candidates for two labels that are short of examples, by keywords, score and caps."""
    i = F.col("doc_id")
    d = table(spark, sf, "documents").select("doc_id", "text", "source", (i % 9).cast("string").alias("date"), ((i * 37) % 101).cast("double").alias("score"))
    return SA.gap_sample(d, {"L1-01": 30, "L1-02": 12}, {"L1-01": ["That ", "POUR"]}, "text", "score", "doc_id", "source", "date", "4").drop("text")


@query(f"""
WITH e AS ({EV}), a AS (SELECT l1, count(*) AS a FROM e GROUP BY 1), b AS (SELECT l1, count(*) AS b FROM e WHERE event_id % 13 = 0 GROUP BY 1), j AS (SELECT coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b USING (l1)), t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM j),
x AS (SELECT sum((a - (a + b) * ta / (ta + tb)) * (a - (a + b) * ta / (ta + tb)) / ((a + b) * ta / (ta + tb)) + (b - (a + b) * tb / (ta + tb)) * (b - (a + b) * tb / (ta + tb)) / ((a + b) * tb / (ta + tb))) AS chi2, count(*) - 1 AS dof, CAST(any_value(ta + tb) AS BIGINT) AS n FROM j, t)
SELECT round(chi2, 6) AS chi2, dof, n, round(sqrt(chi2 / n), 6) AS cramers_v, '' AS note FROM x
""")
def chi2_homogeneity(spark, sf):
    e = events(spark, sf)
    h = U.homogeneity(M.value_counts(e, "l1"), M.value_counts(e.where("event_id % 13 = 0"), "l1"), "l1")
    return h.select(F.round("chi2", 6).alias("chi2"), "dof", "n", F.round("cramers_v", 6).alias("cramers_v"), "note")


@query("""
WITH d AS (SELECT doc_id, md5(substr(text, 1, 256)) AS key, round(doc_id % 40 / 100.0 - 0.2, 2) AS m1, round(doc_id % 30 / 100.0 - 0.1, 2) AS m2 FROM documents), s AS (SELECT key, min(doc_id) AS o FROM d GROUP BY key),
k AS (SELECT s.key, round(s.o % 40 / 100.0 - 0.2, 2) AS m FROM s)
SELECT doc_id, CAST(CASE WHEN s.o % 3 = 0 THEN 0.5 ELSE 0.25 END AS DOUBLE) AS margin, CASE WHEN s.o % 3 = 0 THEN 'KEEP' ELSE 'NEW' END AS status, CASE WHEN m1 > 0 AND m1 < 0.1 THEN CASE WHEN m2 >= 0.1 THEN 'KEEP' WHEN m2 <= 0 THEN 'DROP' ELSE 'REVIEW' END WHEN m1 >= 0.1 THEN 'KEEP' ELSE 'DROP' END AS two_stage FROM d JOIN s USING (key)
""")
def remembered_scores(spark, sf):
    """Scores from a memo where a text's key is in it, new ones for the others, and the two-stage rule."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    known = d.withColumn("key", T.memo_key(F.col("text"))).groupBy("key").agg(F.min("doc_id").alias("o")).where("o % 3 = 0")
    memo = known.select("key", F.lit(0.5).alias("margin"), F.lit("KEEP").alias("status"), F.lit(2).alias("at")).unionByName(known.select("key", F.lit(0.1).alias("margin"), F.lit("DROP").alias("status"), F.lit(1).alias("at")))
    rows, _ = ML.remembered(d, "text", memo, lambda asked: asked.select("key", F.lit(0.25).alias("margin"), F.lit("NEW").alias("status")))
    i = F.col("doc_id")
    labels = {"p": F.greatest(F.round(i % 40 / 100.0 - 0.2, 2), F.lit(0.0)), "n": F.greatest(F.round(0.2 - i % 40 / 100.0, 2), F.lit(0.0))}
    scores = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), v)])
    staged = ML.two_stage(F.round(ML.margin(scores, ["p", "q"], ["n"]), 2), F.round(i % 30 / 100.0 - 0.1, 2))
    return rows.select("doc_id", "margin", "status", staged["status"].alias("two_stage"))


@query("""
WITH d AS (SELECT doc_id, doc_id % 83 / 100.0 AS sim, CASE WHEN doc_id % 83 >= 42 THEN 'KEEP' WHEN doc_id % 83 < 28 THEN 'DROP' ELSE 'REVIEW' END AS st FROM documents), n AS (SELECT least(200, greatest(1, CAST(floor(count(*) * 0.05) AS BIGINT))) AS n FROM d),
b AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY sim DESC, doc_id) AS r FROM d WHERE st = 'DROP') WHERE r <= (SELECT n FROM n))
SELECT doc_id, CASE WHEN b.doc_id IS NOT NULL AND doc_id % 2 = 0 THEN 'REVIEW' ELSE st END AS st, CASE WHEN b.doc_id IS NOT NULL THEN CASE WHEN doc_id % 2 = 0 THEN 'KEEP' ELSE 'DROP' END END AS nli_status FROM d LEFT JOIN b USING (doc_id)
""")
def semantic_rescue(spark, sf):
    i = F.col("doc_id")
    d = table(spark, sf, "documents").select("doc_id", (i % 83 / 100.0).alias("sim")).withColumn("st", ML.semantic_status(F.col("sim")))
    judge = lambda rows: rows.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "KEEP").otherwise("DROP").alias("nli_status"), F.lit(0.3).alias("nli_score"))
    return ML.rescue(d, "sim", "st", "doc_id", judge).select("doc_id", "st", "nli_status")


@query("""
WITH a AS (SELECT o_orderkey AS id, o_orderpriority AS l FROM orders WHERE o_orderkey % 2 = 0), r AS (SELECT * FROM (SELECT l_orderkey AS id, l_linenumber AS o, l_partkey AS m FROM lineitem WHERE l_linenumber > 1) QUALIFY row_number() OVER (PARTITION BY id ORDER BY o, m) = 1)
SELECT a.id, l, m AS "L1_label_ref" FROM a LEFT JOIN r USING (id)
""")
def reference_join(spark, sf):
    """Rows with the first of the reference's rows of their id."""
    a = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("l"))
    r = table(spark, sf, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("label"), F.struct("l_linenumber", "l_partkey").alias("o"))
    return A.with_reference(a, r, {"label": "L1_label_ref", "none": "x"}, "o")


@query("""
WITH a AS (SELECT o_custkey AS id, min(o_orderkey) AS k FROM orders GROUP BY 1), l AS (SELECT id, 'P' || (k % 5) AS lab FROM a), t AS (SELECT c_custkey AS id, 'P' || (c_custkey % 5) AS target FROM customer)
SELECT target AS target_l1, count(*) AS n, round(avg(CASE WHEN target = lab THEN 1.0 ELSE 0.0 END), 6) AS match_rate FROM l JOIN t USING (id) GROUP BY 1
""")
def target_match(spark, sf):
    k = F.col("o_orderkey")
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.concat(F.lit("P"), (k % 5).cast("string")).alias("L1_label"), k.alias("o"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("P"), (F.col("c_custkey") % 5).cast("string")).alias("target_l1"), F.col("c_custkey").alias("o"))
    return A.compare_targets(a, c, "o").groupBy("target_l1").agg(F.count("*").alias("n"), F.round(F.avg(F.col("match").cast("double")), 6).alias("match_rate"))


@query("""
SELECT doc_id AS id, lang, 'ann' AS annotator_id, CASE WHEN doc_id % 3 = 0 THEN 'L1-0' || (doc_id % 7) ELSE '' END AS "your_L1", CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'L2-01' ELSE '' END AS "your_L2", doc_id % 3 = 0 AND doc_id % 5 = 0 AS unsure FROM documents WHERE lang IN ('en', 'fr') AND source IN ('src1', 'src2', 'src3')
""")
def annotation_export(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    i = F.col("id")
    mine = d.where("id % 3 = 0").select(F.lit("ann").alias("annotator_id"), i.cast("string").alias("utterance_id"), F.concat(F.lit("L1-0"), (i % 7).cast("string")).alias("l1_label"), F.when(i % 2 == 0, "L2-01").alias("l2_labels"), (i % 5 == 0).alias("unsure"))
    other = mine.withColumns({"annotator_id": F.lit("bob"), "l1_label": F.lit("x")})
    seen = R.facets(d, {"lang": ["en", "fr"], "source": ["src1", "src2", "src3"], "id": []})
    return A.annotation_export(seen, mine.unionByName(other), "ann").drop("source")


@query("""
WITH d AS (SELECT date_diff('day', DATE '1970-01-05', CAST(ts AS DATE)) AS n, event_type, value FROM events) SELECT strftime(DATE '1970-01-05' + CAST(n // 14 * 14 AS INT), '%Y-%m-%d') AS bin, event_type, round(avg(value), 6) AS value FROM d GROUP BY ALL
""")
def biweekly_bins(spark, sf):
    return O.time_bins(table(spark, sf, "events"), "ts", "value", ["event_type"], 2).select(F.date_format("bin", "yyyy-MM-dd").alias("bin"), "event_type", F.round("value", 6).alias("value"))


@query(f"""
WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type AS g, l2 FROM ({EV}) WHERE user_id % 3 > 0), d AS (SELECT day, g, label, count(*) AS n, avg(CASE WHEN list_contains(l2, label) THEN 1.0 ELSE 0.0 END) AS share FROM e, (SELECT unnest(['L2-01', 'L2-05']) AS label) GROUP BY 1, 2, 3),
c AS (SELECT g, label, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY 1, 2)
SELECT g, label, strftime(day, '%Y-%m-%d') AS day, round(avg(coalesce(share, 0)) OVER (PARTITION BY g, label ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 8) AS ma FROM c LEFT JOIN d USING (g, label, day)
""")
def group_trend(spark, sf):
    """Seven-day averages of daily shares by group and label."""
    d = O.daily_shares(events(spark, sf).where("user_id % 3 > 0"), "ts", "event_type", "l2", ["L2-01", "L2-05"])
    return O.moving_average(d, "day", "share", 7, ["event_type", "label"]).select(F.col("event_type").alias("g"), "label", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("ma", 8).alias("ma"))


@query(f"WITH e AS ({EV}), o AS (SELECT list_filter(list_distinct(l2), lambda x: x IN ('L2-01', 'L2-02', 'L2-03', 'L2-04')) AS l FROM e), x AS (SELECT l, unnest(l) AS a FROM o), y AS (SELECT a, unnest(l) AS b FROM x) SELECT a, b, count(*) AS n FROM y GROUP BY 1, 2")
def cooccurrence_known(spark, sf):
    return M.cooccurrence(events(spark, sf), "l2", diagonal=True, known=["L2-01", "L2-02", "L2-03", "L2-04"])


@query("""
SELECT count(*) AS n, count(*) FILTER (upper(s) = 'REVIEW') AS n_review, count(*) FILTER (upper(s) = 'KEEP') AS n_keep, round(count(*) FILTER (upper(s) = 'KEEP') / CAST(nullif(count(*) FILTER (upper(s) = 'REVIEW'), 0) AS DOUBLE), 6) AS rate FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'Review' WHEN 1 THEN 'KEEP' ELSE 'DROP' END AS s FROM documents)
""")
def pipeline_counters(spark, sf):
    i = F.col("doc_id")
    d = table(spark, sf, "documents").select(choose(i % 4, "Review", "KEEP", "DROP").alias("final_status"))
    c = R.status_counters(d, {"n_keep": F.upper("final_status") == "KEEP"}).crossJoin(R.review_count(d))  # one row each
    return c.select("n", "n_review", "n_keep", F.round(M.addition_rate(F.col("n_keep"), F.col("n_review")), 6).alias("rate"))


@query("""
WITH f AS (SELECT CASE WHEN regexp_matches(text, '"[^"]+"') THEN 'quote' WHEN regexp_matches(text, 'tion') THEN 'claim' ELSE 'context' END AS role, contains(text, 'that') OR contains(text, 'pour') AS sp, contains(text, 'der ') AS pr FROM documents)
SELECT count(*) AS n_units, round(avg(CASE role WHEN 'quote' THEN 1.0 ELSE 0.0 END), 6) AS share_quote, round(avg(CASE role WHEN 'claim' THEN 1.0 ELSE 0.0 END), 6) AS share_claim, round(avg(CASE role WHEN 'context' THEN 1.0 ELSE 0.0 END), 6) AS share_context, round(avg(CASE WHEN sp THEN 1.0 ELSE 0.0 END), 6) AS share_speaker, round(avg(CASE WHEN pr THEN 1.0 ELSE 0.0 END), 6) AS share_procedural FROM f
""")
def unit_report(spark, sf):
    u = I.enrich_units(table(spark, sf, "documents"), "text", {"that": "A", "pour": "B"}, {"les": "x"}, ["der "], [("p", ["und"])], '"[^"]+"', "tion")
    r = M.unit_report(u, F.size("speakers") > 0, F.col("proc_symbolic_flag"))
    return r.select("n_units", *[F.round(c, 6).alias(c) for c in r.columns[1:]])


@query("""
SELECT lang, n_a, round_even(share_a * 100, 1) AS pct_a, n_b, round_even(share_b * 100, 1) AS pct_b, round_even((share_a - share_b) * 100, 1) AS diff_pp FROM (SELECT lang, coalesce(n_a, 0) AS n_a, coalesce(share_a, 0) AS share_a, coalesce(n_b, 0) AS n_b, coalesce(share_b, 0) AS share_b FROM (SELECT lang, count(*) AS n_a, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share_a FROM documents GROUP BY 1) FULL JOIN (SELECT lang, count(*) AS n_b, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share_b FROM documents WHERE doc_id % 4 = 0 GROUP BY 1) USING (lang))
""")
def manuscript_table(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return U.manuscript_drift(M.drift(d, d.where("doc_id % 4 = 0"), "lang"), "lang")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) AS id FROM customer")
def numbered_ids(spark, sf):
    return O.numbered(table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"], "id").select("c_custkey", "id")


@query("""
SELECT c_custkey, r AS replicate, CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b ELSE least(a, b, c) END AS vote FROM (SELECT c_custkey, 'L' || (c_custkey % 2) AS a, 'L' || (c_custkey % 3) AS b, 'L' || (c_custkey % 5) AS c FROM customer), (SELECT CAST(unnest(range(0, 3)) AS INT) AS r)
""")
def replicated_votes(spark, sf):
    k = F.col("c_custkey")
    v = A.majority([F.concat(F.lit("L"), (k % n).cast("string")) for n in (2, 3, 5)])
    return P.replicated(table(spark, sf, "customer").select("c_custkey", v.alias("vote")))


@query("SELECT DISTINCT l_orderkey AS part FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def remaining_parts(spark, sf):
    parts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("part")).distinct()
    return sinks.remaining_parts(parts, table(spark, sf, "orders").select(F.col("o_orderkey").alias("part"), F.col("o_orderstatus").alias("status")), gone=["F"])


@query("""
WITH d AS (SELECT doc_id, list_sort(list_distinct(list_concat(['a', 'b'], [lang]))) AS u FROM documents) SELECT doc_id, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12)) AS BIGINT) AS h, CASE WHEN doc_id % 5 = 0 THEN 'NA' WHEN doc_id % 5 = 1 THEN '0.0500' ELSE '0.1234' END AS p, array_to_string(u, ',') AS terms FROM d
""")
def small_functions(spark, sf):
    i = F.col("doc_id")
    p = F.when(i % 5 == 1, 0.05).when(i % 5 > 1, 0.12344)
    return table(spark, sf, "documents").select("doc_id", T.hash_int(i.cast("string")).alias("h"), T.p_display(p).alias("p"), F.array_join(F.array_sort(F.array_union(F.array(F.lit("a"), F.lit("b")), F.array("lang"))), ",").alias("terms"))
