"""Queries over texts: cleaning, rules, context, duplicates, sampling. The test tables hold Latin
script, so lexicons are Latin here; operators take them as parameters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..operators import order as O
from ..operators import rules as R
from ..operators import segment as S
from ..operators import sampling as SA
from ..operators import similarity as SI
from . import spread, table

CATALOGUE: dict = {}


def query(sql: str | None = None):
    def add(run):
        CATALOGUE[run.__name__] = (run, sql)
        return run

    return add


WS = "[ \\t\\n\\v\\f\\r\\x1c-\\x1f\\x{85}\\p{Z}]"  # white space as the library's patterns have it


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


@query("""
WITH u AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line FROM documents),
v AS (SELECT doc_id, source, lang, trim(regexp_replace(line, '[ \\t]+', ' ', 'g')) AS line FROM u),
w AS (SELECT lang, source, line, min(doc_id) AS doc_id FROM v WHERE length(line) >= 5 GROUP BY lang, source, line)
SELECT source, lang, count(*) AS n_units, round(avg(length(line)), 6) AS mean_chars,
  round(100.0 * avg(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END), 6) AS l2_nonempty_pct FROM w GROUP BY source, lang
""")
def table1_profile(spark, sf):
    """Corpus profile: distinct lines as units, by source and language. Lines meet by 128 bits of hash."""
    d = spread(table(spark, sf, "documents")).select("doc_id", "source", "lang", F.explode(F.split("text", "\n")).alias("line"))
    d = d.withColumn("line", F.trim(F.regexp_replace("line", "[ \\t]+", " "))).withColumn("chars", F.length("line")).where("chars >= 5")
    d = d.select("doc_id", "source", "lang", "chars", F.xxhash64("line").alias("a"), F.xxhash64("line", F.lit(7)).alias("b"))
    u = d.groupBy("lang", "source", "a", "b").agg(F.min("doc_id").alias("doc_id"), F.max("chars").alias("chars"))
    return u.groupBy("source", "lang").agg(F.count("*").alias("n_units"), F.round(F.avg("chars"), 6).alias("mean_chars"), F.round(100 * F.avg(F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1)), 6).alias("l2_nonempty_pct"))


@query("""
WITH a AS (SELECT page_id, len(regexp_extract_all(html, 'https?://\\S+')) AS url_removed, regexp_replace(html, 'https?://\\S+', '<URL>', 'g') AS t FROM pages),
b AS (SELECT page_id, url_removed, len(regexp_extract_all(t, '<[^>]+>')) AS html_removed, regexp_replace(t, '<[^>]+>', '<HTML>', 'g') AS t FROM a),
c AS (SELECT *, regexp_replace(t, 'que[^<]{0,9}$|<HTML>$', '') AS p FROM b), d AS (SELECT *, trim(regexp_replace(p, '\\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url_removed, html_removed, CAST(p <> t AS INT) AS promo_trim, CAST(text <> p AND text <> '' AS INT) AS space_norm, text FROM d
""")
def clean_text_meta(spark, sf):
    c = T.light_clean(F.col("html"), ["que[^<]{0,9}$|<HTML>$"])
    return table(spark, sf, "pages").select("page_id", c.alias("c")).select("page_id", "c.url_removed", "c.html_removed", "c.promo_trim", "c.space_norm", "c.text")


@query("""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, 'https?://\\S+', '', 'g'), '@[\\w\\p{L}]+', '', 'g'), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS text FROM pages
""")
def html_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.preprocess(F.col("html")).alias("text"))


@query("SELECT page_id, 'web_' || substr(md5(url || '' || substr(html, 1, 100)), 1, 12) AS doc_key FROM pages")
def surrogate_key(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.surrogate_key(F.lit("web"), F.col("url"), F.lit(""), F.col("html")).alias("doc_key"))


@query("""
SELECT CASE WHEN regexp_matches(text, '"[^"]+"') THEN 'quote' WHEN regexp_matches(text, 'that|with') THEN 'claim' ELSE 'context' END AS role, count(*) AS n FROM documents GROUP BY 1
""")
def role_classify(spark, sf):
    return table(spark, sf, "documents").groupBy(T.unit_role(F.col("text"), '"[^"]+"', "that|with").alias("role")).agg(F.count("*").alias("n"))


@query("""
SELECT conv_id, turn, regexp_matches(text, 'the|der|les') AS procedural,
 CASE WHEN regexp_matches(text, 'that|with') THEN 'debate' WHEN regexp_matches(text, 'dans|pour') THEN 'legislative' WHEN regexp_matches(text, 'und|nicht') THEN 'campaigning' ELSE '' END AS event_phase FROM conversations
""")
def event_flags(spark, sf):
    c = F.col("text")
    phases = [("debate", ["that", "with"]), ("legislative", ["dans", "pour"]), ("campaigning", ["und", "nicht"])]
    return table(spark, sf, "conversations").select("conv_id", "turn", T.any_term(c, ["the", "der", "les"]).alias("procedural"), T.event_phase(c, phases).alias("event_phase"))


ACTORS, INST, BLACK = ["that ", "avec"], ["with ", "pour", "die "], ["zzz", "|", "%%%"]


@query("""
WITH t AS (SELECT doc_id, text || chr(10) || lower(text) AS b FROM documents),
f AS (SELECT doc_id, CASE WHEN contains(b, '%%%') THEN '%%%' WHEN contains(b, 'zzz') THEN 'zzz' WHEN contains(b, '|') THEN '|' END AS black,
 contains(b, 'that ') OR contains(b, 'avec') AS actor, contains(b, 'with ') OR contains(b, 'pour') OR contains(b, 'die ') AS inst FROM t)
SELECT doc_id, black IS NULL AND inst AS keep, CASE WHEN black IS NOT NULL THEN 'blacklist:' || black WHEN actor AND inst THEN 'cooccur' WHEN inst THEN 'institution_only' ELSE 'no_hit' END AS reason FROM f
""")
def hard_rule(spark, sf):
    return table(spark, sf, "documents").select("doc_id", R.hard_rule(F.col("text"), ACTORS, INST, BLACK).alias("r")).select("doc_id", "r.keep", "r.reason")


@query("""
WITH t AS (SELECT doc_id, text, text || chr(10) || lower(text) AS b FROM documents),
f AS (SELECT doc_id, CAST(contains(text, 'the ') AS INT) + CAST(contains(text, 'der ') AS INT) + CAST(contains(text, 'los ') OR contains(text, 'les ') AS INT) AS score,
 regexp_matches(text, 'un[ae]s') AS odd, contains(text, 'that ') OR contains(text, 'avec') AS actor,
 CAST(contains(b, 'with ') AS INT) + CAST(contains(b, 'pour') AS INT) + CAST(contains(b, 'die ') AS INT) AS inst_cnt, contains(text, 'from') AS core, contains(text, 'sur ') AS strong FROM t),
g AS (SELECT doc_id, score, inst_cnt, CASE WHEN score >= 2 AND NOT odd THEN 'region' WHEN actor AND inst_cnt > 0 THEN 'cooccur' WHEN core THEN 'core' WHEN inst_cnt >= 2 THEN 'institutions' WHEN strong THEN 'anchor' ELSE 'none' END AS reason FROM f)
SELECT doc_id, score, inst_cnt, reason <> 'none' AS passed, reason FROM g
""")
def policy_gate(spark, sf):
    c = F.col("text")
    d = table(spark, sf, "documents").withColumn("score", R.bucket_score(c, [["the "], ["der "], ["los ", "les "]]))
    return d.select("doc_id", "score", R.policy_gate(c, F.col("score"), ACTORS, INST, ["from"], ["sur "], "un[ae]s").alias("g")).select("doc_id", "score", "g.inst_cnt", "g.passed", "g.reason")


@query("""
WITH f AS (SELECT doc_id, text, (doc_id % 100) / 100.0 AS s, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE round((doc_id % 31) / 100.0 - 0.1, 6) END AS m, contains(text, 'that ') OR contains(text, 'pour') AS own FROM documents)
SELECT doc_id, CASE WHEN (contains(text, '%%%') OR contains(text, '|')) AND NOT own THEN 'REVIEW_DROP' WHEN contains(text, 'le ') AND contains(text, 'de ') AND NOT contains(text, 'dans') AND NOT own THEN 'REVIEW_DROP'
 WHEN s >= 0.40 OR own OR m >= 0.10 OR contains(text, 'with the') THEN 'REVIEW_KEEP' WHEN contains(text, 'und ') THEN 'REVIEW_CONTEXT' WHEN m > 0 AND m < 0.10 THEN 'REVIEW_CONTEXT' ELSE 'REVIEW_DROP' END AS status FROM f
""")
def review_refine(spark, sf):
    i = F.col("doc_id")
    s, m = (i % 100) / 100.0, F.when(i % 7 != 0, F.round((i % 31) / 100.0 - 0.1, 6))
    status = R.refine_review(F.col("text"), s, m, ["that "], ["pour"], ["%%%", "|"], ["with the"], ["und "], [["le "], ["de "]], ["dans"])
    return table(spark, sf, "documents").select("doc_id", status.alias("status"))


@query("""
WITH f AS (SELECT event_id, event_id % 11 = 0 AS black, CASE WHEN event_id % 3 = 0 THEN 'cooccur' WHEN event_id % 3 = 1 THEN 'none' ELSE 'core' END AS gr, event_id % 13 = 0 AS pri, CASE WHEN event_id % 2 = 0 THEN 'institution_only' ELSE 'cooccur' END AS hr,
 CASE event_id % 5 WHEN 0 THEN 'KEEP' WHEN 1 THEN 'DROP' ELSE 'REVIEW' END AS sem, CASE event_id % 7 WHEN 0 THEN 'KEEP' WHEN 1 THEN 'DROP' WHEN 2 THEN 'DROP' ELSE 'REVIEW' END AS nli, (event_id % 9) / 10.0 - 0.4 AS sc, event_id % 17 = 0 AS hit FROM events)
SELECT event_id, CASE WHEN black THEN 'DROP' WHEN gr = 'cooccur' AND nli = 'DROP' AND sc <= -0.15 THEN 'REVIEW' WHEN gr = 'cooccur' THEN 'KEEP' WHEN pri THEN 'KEEP' WHEN gr <> 'none' THEN 'KEEP'
 WHEN hr = 'institution_only' AND sem = 'KEEP' AND nli = 'KEEP' THEN 'KEEP' WHEN hr = 'institution_only' THEN 'REVIEW' WHEN nli = 'KEEP' THEN 'KEEP' WHEN sem = 'DROP' AND hit THEN 'REVIEW' WHEN sem = 'DROP' THEN 'DROP'
 WHEN nli = 'DROP' AND (sc > 0 OR hit) THEN 'REVIEW' WHEN nli = 'DROP' THEN 'DROP' WHEN sem = 'KEEP' THEN 'KEEP' ELSE 'REVIEW' END AS final_status FROM f
""")
def final_decision(spark, sf):
    i = F.col("event_id")
    gate = F.when(i % 3 == 0, "cooccur").when(i % 3 == 1, "none").otherwise("core")
    sem = F.when(i % 5 == 0, "KEEP").when(i % 5 == 1, "DROP").otherwise("REVIEW")
    nli = F.when(i % 7 == 0, "KEEP").when((i % 7).isin(1, 2), "DROP").otherwise("REVIEW")
    hard = F.when(i % 2 == 0, "institution_only").otherwise("cooccur")
    return table(spark, sf, "events").select("event_id", R.final_decision(i % 11 == 0, gate, gate != "none", i % 13 == 0, hard, sem, nli, F.round((i % 9) / 10.0 - 0.4, 6), i % 17 == 0).alias("final_status"))


@query(f"""
WITH u AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT {stripped('line')} AS text FROM u),
c AS (SELECT text, CASE WHEN contains(text, '###') THEN {stripped("substr(text, 1, strpos(text, '###') - 1)")} WHEN contains(text, '***') THEN {stripped("substr(text, 1, strpos(text, '***') - 1)")} ELSE text END AS cut FROM t),
b AS (SELECT text, cut, CASE WHEN contains(cut, '%%%') THEN {stripped("substr(cut, 1, strpos(cut, '%%%') - 1)")} ELSE cut END AS bare FROM c),
l AS (SELECT *, regexp_extract(bare, '(?s)^(.*?[A-Z]{{4,}}!* )', 1) AS lead FROM b), d AS (SELECT *, CASE WHEN lead <> '' THEN {stripped('substr(bare, length(lead) + 1)')} ELSE bare END AS body FROM l),
r AS (SELECT CASE WHEN text = '' THEN 'empty' WHEN cut = '' THEN 'editor_mark_empty' WHEN bare = '' THEN 'copyright_empty' WHEN regexp_matches(bare, '[$]{{3}}$') THEN 'copyright_tail' WHEN length(body) < 10 THEN 'too_short' WHEN length(body) < 40 AND regexp_matches(body, '^[^.!?]*$') THEN 'no_end' ELSE 'kept' END AS reason FROM d)
SELECT reason, count(*) AS n FROM r GROUP BY reason
""")
def news_clean_reasons(spark, sf):
    u = spread(table(spark, sf, "documents")).select(F.explode(F.split("text", "\n")).alias("line"))
    c = R.clean_article_sentence(F.col("line"), ["###", "***"], "%%%", "[$]{3}$", "[A-Z]{4,}!* ", residue=[("^[^.!?]*$", "no_end")], short=40)
    return u.select(c.alias("c")).groupBy(F.coalesce("c.reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""
WITH f AS (SELECT conv_id, turn, coalesce(text, '') AS t, turn % 3 <> 1 AS ctx FROM conversations), g AS (SELECT *, CASE WHEN regexp_matches(t, '#\\S+') THEN {stripped("regexp_replace(t, '#\\S+', '', 'g')")} ELSE t END AS cleaned FROM f),
h AS (SELECT *, len(regexp_extract_all(cleaned, '[A-Za-z]')) / nullif(CAST(length(regexp_replace(cleaned, '\\s', '', 'g')) AS DOUBLE), 0) AS latin FROM g)
SELECT conv_id, turn, cleaned, CASE WHEN regexp_matches(t, '^#\\S+$') THEN 'hashtag_only' WHEN ctx AND latin > 0.97 AND NOT regexp_matches(cleaned, 'tion') THEN 'mostly_latin' WHEN ctx AND (conv_id % 10) / 10.0 < 0.2 THEN 'low_similarity' END AS drop_reason FROM h
""")
def post_clean(spark, sf):
    d = table(spark, sf, "conversations").withColumns({"sim": (F.col("conv_id") % 10) / 10.0, "kind": F.when(F.col("turn") % 3 != 1, "Context").otherwise("quote")})
    return R.clean_posts(d, "text", "kind", "sim", 0.2, "tion", 0.97).select("conv_id", "turn", "cleaned", "drop_reason")


@query("""
WITH f AS (SELECT conv_id, turn, text, (starts_with(text, 'The') OR starts_with(text, 'Und')) AND NOT contains(text, 'with ') AND (contains(text, 'ing') OR contains(text, 'ung')) AS p FROM conversations)
SELECT CASE WHEN p THEN 'DROP_PROCEDURAL' WHEN length(text) >= 120 THEN 'KEEP' WHEN regexp_matches(text, '^[A-Z][a-z]{1,3}[ .,]') THEN 'DROP_FILLER' WHEN regexp_matches(text, 'tion') THEN 'KEEP_AUTO' ELSE 'KEEP' END AS action, count(*) AS n FROM f GROUP BY 1
""")
def debate_clean(spark, sf):
    c = F.col("text")
    a = R.debate_action(c, R.procedural(c, ["The", "Und"], ["with "], ["ing", "ung"]), "^[A-Z][a-z]{1,3}[ .,]", "tion", 120)
    return table(spark, sf, "conversations").groupBy(a.alias("action")).agg(F.count("*").alias("n"))


@query("""
WITH f AS (SELECT conv_id, turn, text, role = 'user' AS h, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS session FROM conversations WHERE trim(text) <> '')
SELECT conv_id, session, max(CASE WHEN h THEN text END) AS speaker, coalesce(string_agg(CASE WHEN NOT h THEN text END, ' ' ORDER BY turn), '') AS content, count(*) FILTER (NOT h) AS n_lines FROM f GROUP BY conv_id, session
""")
def speaker_sessionise(spark, sf):
    return O.sessions(table(spark, sf, "conversations"), "conv_id", "turn", "text", F.col("role") == "user")


@query("""
WITH f AS (SELECT *, conv_id || '_u' || turn AS unit_id FROM conversations WHERE length(text) BETWEEN 5 AND 400)
SELECT conv_id, unit_id, lag(text, 1, '') OVER w AS prev, lead(text, 1, '') OVER w AS next FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY unit_id)
""")
def relink_prev_next(spark, sf):
    """Context links anew after the length gate, in the order of the unit ids as text."""
    c = table(spark, sf, "conversations").where(F.length("text").between(5, 400)).withColumn("unit_id", F.concat_ws("_u", "conv_id", "turn"))
    return O.link_context(c, "conv_id", "unit_id", "text").select("conv_id", "unit_id", "prev", "next")


@query("SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 AS dup_flag FROM documents")
def dup_flags(spark, sf):
    return O.flag_duplicates(table(spark, sf, "documents"), F.md5(F.col("text").cast("binary")), "doc_id").select("doc_id", "dup_flag")


TIERED = "SELECT *, md5(text) AS unit_hash, CAST(replace(source, 'src', '') AS INT) % 4 AS tier FROM documents"


def _tiered(spark, sf):
    return table(spark, sf, "documents").withColumns({"unit_hash": F.md5(F.col("text").cast("binary")), "tier": F.regexp_replace("source", "src", "").cast("int") % 4})


@query(f"WITH d AS ({TIERED}) SELECT doc_id, tier FROM d QUALIFY row_number() OVER (PARTITION BY unit_hash ORDER BY tier DESC, doc_id) = 1")
def priority_dedup(spark, sf):
    return O.priority_dedup(_tiered(spark, sf), "unit_hash", "tier", "doc_id").select("doc_id", "tier")


@query(f"""WITH d AS ({TIERED}), r AS (SELECT doc_id, tier, row_number() OVER w AS rn, first_value(source) OVER w AS winner_source, first_value(tier) OVER w AS winner_tier FROM d WINDOW w AS (PARTITION BY unit_hash ORDER BY tier DESC, doc_id))
SELECT doc_id, tier, winner_source, winner_tier FROM r WHERE rn > 1""")
def dedup_losers(spark, sf):
    return O.dedup_losers(_tiered(spark, sf), "unit_hash", "tier", "doc_id", ["source", "tier"]).select("doc_id", "tier", "winner_source", "winner_tier")


@query(f"""WITH d AS ({TIERED}), k AS (SELECT source FROM d QUALIFY row_number() OVER (PARTITION BY unit_hash ORDER BY tier DESC, doc_id) = 1),
a AS (SELECT source, count(*) AS n_before FROM d GROUP BY source), b AS (SELECT source, count(*) AS n_after FROM k GROUP BY source)
SELECT source, n_before, coalesce(n_after, 0) AS n_after, n_before - coalesce(n_after, 0) AS n_dropped FROM a LEFT JOIN b USING (source)""")
def dedup_counts(spark, sf):
    d = _tiered(spark, sf)
    a = d.groupBy("source").agg(F.count("*").alias("n_before"))
    b = O.priority_dedup(d, "unit_hash", "tier", "doc_id").groupBy("source").agg(F.count("*").alias("n_after"))
    after = F.coalesce("n_after", F.lit(0))
    return a.join(b, "source", "left").select("source", "n_before", after.alias("n_after"), (F.col("n_before") - after).alias("n_dropped"))


@query("""
SELECT doc_id, list_filter(['that', 'with', 'pour', 'und'], lambda x: contains(text, x)) AS speakers, list_transform(list_filter([{'t': 'the', 'c': 'en'}, {'t': 'der', 'c': 'de'}, {'t': 'les', 'c': 'fr'}], lambda x: contains(text, x.t)), lambda x: x.t || '|' || x.c) AS targets FROM documents
""")
def speakers_targets(spark, sf):
    pairs = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(c).alias("c")) for t, c in (("the", "en"), ("der", "de"), ("les", "fr"))])
    hits = F.transform(F.filter(pairs, lambda x: F.contains(F.col("text"), x["t"])), lambda x: F.concat_ws("|", x["t"], x["c"]))
    return table(spark, sf, "documents").select("doc_id", T.terms_in(F.col("text"), ["that", "with", "pour", "und"]).alias("speakers"), hits.alias("targets"))


@query("SELECT doc_id, md5('42:' || doc_id) AS h FROM documents ORDER BY h, doc_id LIMIT 50")
def seeded_sample(spark, sf):
    d = O.seeded_sample(table(spark, sf, "documents").select("doc_id"), "doc_id", 50, "42")
    return d.select("doc_id", O.sample_rank("42", F.col("doc_id")).alias("h"))


@query("SELECT doc_id, source, lang, rn FROM (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY md5('7:' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 3")
def stratified_sample(spark, sf):
    return O.stratified_sample(table(spark, sf, "documents").select("doc_id", "source", "lang"), ["source", "lang"], "doc_id", 3, "7")


@query("""
WITH r AS (SELECT doc_id, lang, md5('9:' || doc_id) AS h, row_number() OVER (PARTITION BY lang ORDER BY md5('9:' || doc_id), doc_id) AS rn FROM documents),
q AS (SELECT *, CASE WHEN rn > CASE lang WHEN 'en' THEN 50 WHEN 'fr' THEN 30 WHEN 'de' THEN 10 ELSE 0 END THEN 1 ELSE 0 END AS refill FROM r)
SELECT doc_id, lang, refill FROM q ORDER BY refill, h, doc_id LIMIT 100
""")
def quota_sample(spark, sf):
    return O.quota_sample(table(spark, sf, "documents").select("doc_id", "lang"), "lang", {"en": 50, "fr": 30, "de": 10}, "doc_id", 100, "9")


@query("""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('5:' || doc_id), doc_id) AS round FROM documents)
SELECT doc_id, source, round FROM r ORDER BY round, md5('5:' || source), doc_id LIMIT 45
""")
def balanced_draw(spark, sf):
    return O.balanced_draw(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 45, "5")


@query("""
WITH f AS (SELECT doc_id, length(text) AS n, round((doc_id % 100) / 100.0, 2) AS sim, round((doc_id % 31) / 100.0, 2) AS m, contains(text, 'that') AS a, contains(text, 'pour') OR contains(text, 'und') AS b, contains(text, 'with') AS sp, contains(text, 'les ') AS tg, contains(text, 'der ') AS pr,
 CASE WHEN regexp_matches(text, '"[^"]+"') THEN 'quote' WHEN regexp_matches(text, 'tion') THEN 'claim' ELSE 'context' END AS role FROM documents),
s AS (SELECT doc_id, CAST(round((CASE WHEN sim BETWEEN 0.45 AND 0.60 THEN 2.0 ELSE 0 END) + (CASE WHEN m BETWEEN 0.05 AND 0.20 THEN 1.5 ELSE 0 END) + (CASE WHEN a THEN 1.0 ELSE 0 END) + (CASE WHEN b THEN 1.0 ELSE 0 END) + (CASE WHEN sp THEN 1.0 ELSE 0 END) + (CASE WHEN tg THEN 0.8 ELSE 0 END) + (CASE WHEN pr THEN 0.5 ELSE 0 END) + (CASE role WHEN 'quote' THEN 1.5 WHEN 'claim' THEN 1.0 ELSE 0 END) + (CASE WHEN n BETWEEN 50 AND 200 THEN 0.5 ELSE 0 END), 2) AS DOUBLE) AS score,
 concat_ws('|', CASE WHEN sim BETWEEN 0.45 AND 0.60 THEN 'boundary_semantic' END, CASE WHEN m BETWEEN 0.05 AND 0.20 THEN 'boundary_nli' END, CASE WHEN a THEN 'l2_L2-01' END, CASE WHEN b THEN 'l2_L2-02' END, CASE WHEN sp THEN 'has_speaker' END, CASE WHEN tg THEN 'has_target' END, CASE WHEN pr THEN 'procedural' END, CASE WHEN role <> 'context' THEN role END, CASE WHEN n BETWEEN 50 AND 200 THEN 'good_length' END) AS reasons FROM f),
n AS (SELECT least(200, greatest(1, CAST(floor(0.05 * count(*)) AS BIGINT))) AS n FROM documents)
SELECT doc_id, score, reasons FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rn FROM s) WHERE rn <= (SELECT n FROM n)
""")
def score_topk(spark, sf):
    d, c, i = table(spark, sf, "documents"), F.col("text"), F.col("doc_id")
    has = lambda x: F.contains(c, F.lit(x))
    s = SA.sample_score(c, F.round((i % 100) / 100.0, 2), F.round((i % 31) / 100.0, 2), {"L2-01": ["that"], "L2-02": ["pour", "und"]}, has("with"), has("les "), has("der "), T.unit_role(c, '"[^"]+"', "tion"))
    n = d.agg(F.least(F.lit(200), F.greatest(F.lit(1), F.floor(0.05 * F.count("*")))).alias("n"))
    top = d.select("doc_id", s.alias("s")).select("doc_id", "s.score", "s.reasons").orderBy(F.desc("score"), "doc_id").limit(200)
    top = top.withColumn("rn", F.row_number().over(W.orderBy(F.desc("score"), "doc_id")))  # 200 rows
    return top.crossJoin(F.broadcast(n)).where("rn <= n").select("doc_id", "score", "reasons")


@query("""
SELECT len(regexp_extract_all(text, '[A-Za-z]')) AS latin, len(regexp_extract_all(text, '[0-9]')) AS digits, length(text) AS chars, doc_id FROM documents
""")
def class_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit("[A-Za-z]")).alias("latin"), F.regexp_count("text", F.lit("[0-9]")).alias("digits"), F.length("text").alias("chars"))


@query("SELECT doc_id FROM documents WHERE length(trim(text)) >= 10 AND length(text) BETWEEN 5 AND 1000")
def length_gate(spark, sf):
    return table(spark, sf, "documents").where((F.length(F.trim("text")) >= 10) & F.length("text").between(5, 1000)).select("doc_id")


@query("""
WITH d AS (SELECT doc_id, text, length(text) AS dl FROM documents), n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d), df AS (SELECT c, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS c FROM d) GROUP BY c),
i AS (SELECT c, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, n), e AS (SELECT 0.25 * avg(idf) AS eps FROM i), q AS (SELECT c, count(*) AS k FROM (SELECT unnest(['Z', 'ü', 'x', 'Z', 'ñ', 'W']) AS c) GROUP BY c),
t AS (SELECT doc_id, dl, c, k, length(text) - length(replace(text, c, '')) AS tf FROM d, q),
s AS (SELECT doc_id, round(sum(CASE WHEN tf > 0 THEN k * (CASE WHEN idf < 0 THEN eps ELSE idf END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END), 6) AS score FROM t JOIN i USING (c), e, n GROUP BY doc_id),
b AS (SELECT min(score) AS b FROM (SELECT score, row_number() OVER (ORDER BY score) AS rn, count(*) OVER () AS n FROM s) WHERE rn > floor(n * 0.7))
SELECT doc_id, score, score >= b AS top FROM s, b
""")
def bm25(spark, sf):
    """BM25 over characters, and the best three in ten."""
    scored = SI.char_bm25(table(spark, sf, "documents"), "doc_id", "text", "ZüxZñW")
    return SA.top_share(scored.withColumn("score", F.round("score", 6)), "score", 0.3)


@query()
def segment_sentences(spark, sf):
    """Sentence units with context links."""
    u = S.to_units(spread(table(spark, sf, "documents")), "doc_id", F.col("text"))
    return O.link_context(u, "doc_id", "idx", "sentence")


@query()
def nfkc_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.nfkc(T.light_clean(F.col("text"))["text"]).alias("content_norm"))


@query()
def html_unescape(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.unescape(F.col("html")).alias("html"))


@query()
def greedy_gap_sample(spark, sf):
    """Per language, the best-scored documents with at most three of a source."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", ((F.col("doc_id") * 37) % 101).cast("double").alias("score"))
    return O.greedy_capped(O.cap_candidates(d, "lang", "score", "doc_id", "source", 3, 40), "lang", "score", "doc_id", {"source": 3}, 40)
