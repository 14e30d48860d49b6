"""Operators round annotation that no SQL over the test tables covers: edges, samplers, models, reports."""

import json
import math
import random
import zipfile  # noqa: F401

from pyspark.sql import functions as F

from corpuslens import lexicons as L
from corpuslens import sources as S
from corpuslens.functions import text as T
from corpuslens.operators import answers as A
from corpuslens.operators import audit as U
from corpuslens.operators import ingest as I
from corpuslens.operators import metrics as M
from corpuslens.operators import models as ML
from corpuslens.operators import order as O
from corpuslens.operators import prompts as P
from corpuslens.operators import rules as R
from corpuslens.operators import sampling as SA
from corpuslens.operators import segment
from corpuslens.sources import sinks


def one(spark, column, **values):
    return spark.createDataFrame([values]).select(column.alias("x")).first()["x"]


def test_names_and_dates(spark):
    got = [one(spark, T.substring_label(F.col("s"), L.OUTLETS, F.col("s"), "(blank)"), s=s) for s in ("x/ChinaTimes_1", "a_ltn", "TVBS", "辩论", "Meeting", " ", "other")]
    assert got == ["China Times", "LTN (Liberty Times)", "TVBS", "Televised debate", "Policy forum (televised)", "(blank)", "other"]
    rows = spark.createDataFrame([("01_Ho_x", "03_X_datasets/a", "2023-11-24"), ("賴", "debate", "2024-01-13 10:00:00"), ("02_ke", "n", ""), ("x", "n", None)], "source string, _source_file string, date string")
    got = [(r["candidate"], r["party"], r["source_type"], r["_period"]) for r in I.derived_columns(rows, L.CANDIDATES, L.PARTIES, L.SOURCE_TYPES_BY_FILE).collect()]
    assert got == [("侯友宜", "KMT", "social_media", "2023-11"), ("赖清德", "DPP", "conference", "2024-01"), ("柯文哲", "TPP", "news", "_nodate"), ("Unknown", "Unknown", "news", "_nodate")]
    kept = I.derived_columns(rows.withColumn("candidate", F.lit("c")), L.CANDIDATES, L.PARTIES, L.SOURCE_TYPES_BY_FILE).first()
    assert (kept["candidate"], kept["party"]) == ("c", "Unknown")
    phases = [one(spark, T.interval_label(T.parse_date(F.col("d")).cast("date"), L.PHASES, "Post-election", "No valid date"), d=d) for d in ("2023-06-30", "2023-07-01", "2023-11-25", "2024-01-11", "2024-01-13", "2024-01-14", "x")]
    assert phases == ["Primary season", "Nomination period", "Post-registration interregnum", "General campaign", "Final sprint / Election day", "Post-election", "No valid date"]
    assert one(spark, T.p_display(F.col("p")), p=3e-10) == "<1e-8 (exact 3.00e-10)" and one(spark, T.p_display(F.col("p")), p=float("nan")) == "NA"
    assert [one(spark, SA.time_period(F.col("d").cast("timestamp"), "2024-01-13"), d=d) for d in ("2024-02-01", "2023-10-15 00:00:01", "2023-10-15", "2023-01-01")] == ["within_3m", "within_3m", "within_6m", "over_6m"]


def test_cleaners(spark):
    def clean(s):
        c = R.clean_article_sentence(F.col("s"), L.EDITORS, L.COPYRIGHT_FROM, L.COPYRIGHT_END, L.BYLINE, residue=L.EDITOR_RESIDUE)
        return tuple(spark.createDataFrame([(s,)], "s string").select(c.alias("c")).first()["c"])

    body = "這是一個有十五個字以上的新聞句子沒有錯吧。"
    assert clean(None) == clean("  ") == (None, "empty") and clean("（編輯:甲）乙") == (None, "editor_mark_empty")
    assert clean(body + "（編輯:王小明）1130101") == (body, None) and clean("本網站之文字、圖片") == (None, "copyright_empty")
    assert clean("（中央社記者甲台北1日電）" + body) == (body, None) and clean("標題 2024/01/01 10:00 2024/01/02 11:00 " + body) == (body, None)
    assert clean("2024/01/01 10:00 2024/01/02 11:00 " + "字" * 200) == (None, "lead_timestamps")
    assert clean("太短了") == (None, "too_short") and clean("責任編輯是王小明先生啦") == (None, "editor_residue")
    late = "字" * 210 + "2024/01/01 10:00 尾"
    assert clean(late) == (late, None)  # a time stamp beyond the beginning is text
    posts = spark.createDataFrame([("#tag", "context"), ("Good morning #x everyone", "context"), ("Good morning everyone", "quote"), ("Taiwan election now", "Context"), ("早安 good morning 大家", "context")], "t string, role string")
    got = [(r["cleaned"], r["drop_reason"]) for r in R.clean_posts(posts, "t", "role", keep="(?i)taiwan").collect()]
    assert got == [("", "hashtag_only"), ("Good morning  everyone", "mostly_latin"), ("Good morning everyone", None), ("Taiwan election now", None), ("早安 good morning 大家", None)]
    assert one(spark, T.strong_keys(F.col("s"), L.STRONG_KEYS, L.ANTI_KEYS), s="主權與統一發票") is False and one(spark, T.strong_keys(F.col("s"), L.STRONG_KEYS, L.ANTI_KEYS), s="主權") is True
    assert one(spark, R.priority_bypass(F.col("s"), R.bucket_score(F.col("s"), L.REGION_BUCKETS), ["國防"], L.AMBIGUOUS), s="台灣總統與統一獅") is False


def test_documents_to_units(spark):
    raw = spark.createDataFrame([("", "標題", "侯友宜表示：我們支持立法院三讀。大家都很高興。", "u1", "2024-01-01"), ("", "標題", "短", "u2", "x"), ("", "標題", "侯友宜表示：我們支持立法院三讀。大家都很高興。", "u1", "2024-01-01")], "doc_id string, title string, text string, url string, pub_time string")
    docs = I.dual_text(I.default_source(I.normalize_columns(raw), F.lit("file")), promo=L.PROMO)
    ids = sorted(r["doc_id"] for r in docs.collect())
    assert all(i.startswith("_") and len(i) == 13 for i in ids) and ids[0] != ids[2]
    given = I.normalize_columns(raw.withColumn("doc_id", F.when(F.col("url") == "u2", "d2").otherwise("")))
    assert sorted(r["doc_id"] for r in given.collect()) == ["", "", "d2"]  # one id is there: none is made
    lexicon = {"actors": L.ACTOR_PARTY, "categories": L.INSTITUTION_CATEGORY, "procedural": L.PROCEDURAL, "phases": L.EVENT_PHASES, "quote": segment.QUOTE, "claim": "|".join(segment.SAY)}
    d, units = I.documents_to_units(docs.withColumn("doc_id", F.concat("doc_id", F.monotonically_increasing_id().cast("string"))), **lexicon)
    assert sorted(r["doc_dup_flag"] for r in d.collect()) == [False, False, True]
    got = units.where("NOT unit_dup_flag").orderBy("unit_id").collect()
    assert [r["sentence"] for r in got] == ["侯友宜表示:我們支持立法院三讀。", "大家都很高興。"]
    assert (got[0]["role"], got[0]["speakers"][0]["party"], got[0]["targets"], got[0]["event_phase"], got[0]["next"], got[0]["prev"]) == ("claim", "KMT", ["立法院|institution", "三讀|procedure"], "legislative", "大家都很高興。", "")


def test_scans_and_sinks(spark, tmp_path):
    base = str(tmp_path)
    units = spark.createDataFrame([("d1", "d1_u000", "句子", "quote", "", "", [("甲", "K")], ["t|c"], True, "p", "h", False, "s", "2024")], "doc_id string, unit_id string, sentence string, role string, prev string, next string, speakers array<struct<name:string,party:string>>, targets array<string>, proc_symbolic_flag boolean, event_phase string, unit_hash string, unit_dup_flag boolean, source string, date string")
    sinks.write_units(units, base + "/units")
    got = S.read_units(spark, base + "/units").first()
    assert (got["sentence"], json.loads(got["speakers"]), got["source"], got["date"]) == ("句子", [{"name": "甲", "party": "K"}], "s", "2024")
    sinks.write_mirrored(units.select("sentence", F.lit("news").alias("corpus"), F.lit("a_units.csv").alias("source_file")), base + "/mirror")
    assert S.read_csv(spark, base + "/mirror", "sentence string").first()["sentence"] == "句子"
    sinks.write_documents(units, base + "/docs")
    assert json.loads(S.read_strings(spark, base + "/docs").first()["speakers"]) == [{"name": "甲", "party": "K"}]
    files = spark.createDataFrame([("01_Ho_units.csv",), ("02_Ke_units_CONTEXT.csv",), ("09_units.csv",), ("03_Lai_units.csv",), ("x.csv",)], "source_file string")
    got = S.by_file_name(S.main_files(files), "news", L.CANDIDATES, L.PARTIES, date=F.lit("2023-12-14")).orderBy("source_file").collect()
    assert [(r["candidate"], r["party"], r["source_type"]) for r in got] == [("侯友宜", "KMT", "news"), ("赖清德", "DPP", "news")]
    (tmp_path / "pool.csv").write_text("layer,stratum\nL1,a\n")
    (tmp_path / "guide.csv").write_text("label_id,label_cn\nL1-01,甲\n", encoding="utf-8-sig")
    found, notes = S.read_guides(spark, {"l1": base + "/guide.csv", "hard_pool": base + "/pool.csv", "fewshot": base + "/none.csv", "l2": None}, {"l1": ["label_id", "boundary_test"], "hard_pool": ["layer", "gold_L1"]})
    assert set(found) == {"l1"} and notes == ["l1: missing columns boundary_test", "hard_pool: missing columns gold_L1", "hard_pool: none"] or set(found) == {"l1"} and len(notes) == 4
    assert found["l1"].columns == ["label_id", "label_cn"]
    sinks.write_stats(spark, base + "/s.json", {"n": 3, "by": spark.createDataFrame([("a", 1)], "k string, n long"), "x": {"y": {1, 2}}})
    assert json.loads((tmp_path / "s.json").read_text()) == {"n": 3, "by": [{"k": "a", "n": 1}], "x": {"y": [1, 2]}}
    sinks.merge_report(spark, base + "/r.json", "l1", {"rows": 1})
    assert sinks.merge_report(spark, base + "/r.json", "l2", {"rows": 2}) == {"l1": {"rows": 1}, "l2": {"rows": 2}}
    sinks.write_report(spark, base + "/r.md", "Title", [("One", spark.createDataFrame([("a|b", 0.5)], "k string, v double")), ("Two", None)])
    assert (tmp_path / "r.md").read_text() == "# Title\n\n## One\n\n| k | v |\n|---|---|\n| a\\|b | 0.5000 |\n\n## Two\n\n(nothing to show)\n"
    m = sinks.manifest(spark, [base + "/pool.csv"], {"seed": 42}, "abc")
    import hashlib

    assert m["files"][0]["sha256"] == hashlib.sha256((tmp_path / "pool.csv").read_bytes()).hexdigest() and m["parameters"] == {"seed": 42}
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1/final.csv").write_text("x")
    (tmp_path / "latest_run.txt").write_text("run1\n")
    assert S.resolve_run(spark, base, ["merged_run.txt", "latest_run.txt"], ["best.csv", "final.csv"]) == base + "/run1/final.csv" and S.resolve_run(spark, base, [], ["final.csv"]) is None
    (tmp_path / "memo.jsonl").write_text('{"key":"a","margin":0.1,"status":"KEEP"}\nbroken\n{"key":"a","margin":0.2,"status":"DROP"}\n')
    rows = spark.createDataFrame([("x",), ("x",), (None,)], "t string")
    memo = S.read_memo(spark, base + "/memo.jsonl").withColumn("key", T.memo_key(F.lit("x")))
    assert S.read_memo(spark, base + "/nothing").count() == 0 and memo.count() == 2
    asked = []
    scored, new = ML.remembered(rows, "t", memo, lambda q: (asked.append(q.count()), q.select("key", F.lit(0.9).alias("margin"), F.lit("NEW").alias("status")))[1])
    assert sorted(map(str, ((r["t"], r["margin"], r["status"]) for r in scored.collect()))) == sorted(map(str, [("x", 0.2, "DROP"), ("x", 0.2, "DROP"), (None, 0.9, "NEW")])) and asked == [1] and new.count() == 1
    pages = {None: (['{"part":1}', '{"part":2}'], "c"), "c": (['{"part":3}'], None)}
    assert S.land_pages(spark, pages.__getitem__, base + "/pages", "part long").agg(F.sum("part")).first()[0] == 6
    sinks.append_notes(spark.createDataFrame([("n1",)], "note string"), base + "/notes")
    sinks.append_notes(spark.createDataFrame([("n2",)], "note string"), base + "/notes")
    assert spark.read.json(base + "/notes").count() == 2
    parts = P.request_parts(spark.range(120), "id", 50)
    sinks.write_parts(parts, base + "/parts")
    assert sorted(r["n"] for r in spark.read.json(base + "/parts").groupBy("part").agg(F.count("*").alias("n")).collect()) == [20, 50, 50]


def test_submit():
    class Service:
        def __init__(self):
            self.made, self.asked = [], {}

        def create(self, part):
            if part == "p3" and not self.asked.get("p3"):
                self.asked["p3"] = 1
                raise RuntimeError("Rate limit")
            self.made.append(part)
            return f"b{len(self.made)}"

        def status(self, batch):
            n = self.asked[batch] = self.asked.get(batch, 0) + 1
            if batch == "b2":
                return "failed", "Enqueued token limit reached"
            if batch == "b5":
                return "failed", "bad file"
            return ("validating", "in_progress", "in_progress", "completed")[min(n, 4) - 1], ""

    waits, service = [], Service()
    done = sinks.submit_parts(service, ["p1", "p2", "p3", "p4", "p5"], most=1, wait=waits.append)
    assert done == {"p1": "b1", "p2": "b3", "p3": "b4"} and 600 in waits and 300 in waits and 120 in waits


def test_prompts(spark):
    assert one(spark, P.user_text(F.col("s"), F.col("p"), F.lit(None).cast("string")), s=" 句 ", p=" ") == P.INSTRUCTION + "句"
    assert one(spark, P.user_text(F.col("s"), F.col("p"), F.lit("")), s="句", p="前") == f"{P.BEFORE}前\n{P.TARGET}句\n{P.AFTER}"
    pool = spark.createDataFrame([("L1", "a", '說"好"', "L1-03_x", "", "", None, "note"), ("BOTH", "b", "句", "L1-01", "L2-01| L2-02", "why", "", ""), ("L2", "b", "無", "L1-01", " ", "", "", "")], "layer string, stratum string, sentence string, gold_L1 string, gold_L2 string, gold_L1_cot string, gold_L2_cot string, notes string")
    asked = spark.createDataFrame([(i,) for i in range(4)], "id long")
    first = P.hard_pool(pool, "L1")
    drawn = P.draw_cases(asked, first, "id", 4, "s").withColumn("text", P.cases_text(F.col("cases"), "L1", "H\n", "doubt"))
    got = drawn.orderBy("id").collect()
    assert all(len(r["cases"]) == 4 and len({c["stratum"] for c in r["cases"][:2]}) == 2 for r in got)
    assert all('文本："說\\"好\\""\n參考輸出：{"L1_cot":"doubt","L1":"L1-03"}\n類型：note\n' in r["text"] for r in got) and got[0]["text"].startswith("H\n[HC-L1-1] ")
    assert drawn.orderBy("id").collect() == got and len({str([c["sentence"] for c in r["cases"]]) for r in P.draw_cases(spark.range(40), first, "id", 1, "s").collect()}) == 2
    second = P.draw_cases(asked, P.hard_pool(pool, "L2"), "id", 1, "s").select(P.cases_text(F.col("cases"), "L2", "", "doubt").alias("t")).first()["t"]
    assert second == '[HC-L2-1] 已知L1：L1-01\n文本："句"\n參考輸出：{"L2_cot":"doubt","L2":["L2-01","L2-02"]}\n\n'
    assert P.hard_pool(pool.drop("gold_L1"), "L1") is None
    none = P.draw_cases(asked, first.limit(0), "id", 2, "s")
    assert {len(r["cases"]) for r in none.collect()} == {0}


def test_answers(spark):
    ref = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "custom_id string")
    got = spark.createDataFrame([("a", '{"L1":"L1-01_x","L2":["L2-01","zz"," "],"L1_cot":"c"}', None), ("b", None, "JSON Parse Error"), ("d", '{"L1":"L9","L2":"L2-01"}', None)], "custom_id string, content string, error string")
    rows = {r["custom_id"]: r for r in A.join_answers(ref, got, "custom_id", ["L1-01"], ["L2-01"]).collect()}
    assert [(rows[k]["L1_label"], rows[k]["L1_error"], rows[k]["L2_labels"], rows[k]["L2_error"], rows[k]["L2_dropped"]) for k in "abcd"] == [
        ("L1-01", "", "L2-01", "", 1), (None, "JSON Parse Error", "", "JSON Parse Error", 0), (None, "missing response", "", "", 0), (None, "invalid L1 code", "", "L2 field not a list", 0)
    ]
    runs = spark.createDataFrame([("x", "x", "x", ["a"], ["a"], ["a"]), ("x", "x", None, ["a", "b"], ["a"], []), (None, None, None, [], [], [])], "p string, q string, r string, a array<string>, b array<string>, c array<string>")
    s = A.stability(runs, ["p", "q", "r"], ["a", "b", "c"]).first()
    assert (s["n"], round(s["l1_agreement"], 4), round(s["l2_mean_min_jaccard"], 4), s["vote_l1"]) == (3, 0.3333, 0.6667, True)
    assert [one(spark, A.majority([F.col(c) for c in "abc"]), a=a, b=b, c=c) for a, b, c in (("y", "x", "y"), ("z", "y", "x"), ("", "q", "q"))] == ["y", "x", "q"]
    rows = spark.createDataFrame([("s1",)], "sentence string")
    assert A.with_reference(rows, spark.createDataFrame([(1, "L")], "id long, L1 string"), {"L1": "ref"}, "id") is rows
    by_text = A.with_reference(rows, spark.createDataFrame([("s1", "L", 2), ("s1", "M", 1)], "sentence string, L1 string, o long"), {"L1": "ref"}, "o").first()
    assert by_text["ref"] == "M"


def test_models(spark):
    rows = spark.createDataFrame([("ab",), (None,)], "t string")
    got = ML.embed(rows, "t", lambda: lambda texts: [[len(x), 1.0] for x in texts], 1).collect()
    assert sorted(tuple(r["embedding"]) for r in got) == [(0.0, 1.0), (2.0, 1.0)]
    staged = [tuple(spark.range(1).select(ML.two_stage(F.lit(a), F.lit(b).cast("double")).alias("s")).first()["s"]) for a, b in ((0.1, 0.0), (0.05, 0.2), (0.05, -0.1), (0.05, None), (0.0, 0.9))]
    assert staged == [(0.1, "KEEP", False), (0.2, "KEEP", True), (-0.1, "DROP", True), (0.05, "REVIEW", False), (0.0, "DROP", False)]


def test_audit(spark):
    for x, k in ((3.84, 1), (5.33, 2), (20.0, 9), (0.5, 4), (60.0, 30)):
        # against a sum over the density
        n, top = 200_000, 400.0
        step = (top - x) / n
        f = lambda t: math.exp((k / 2 - 1) * math.log(t) - t / 2 - k / 2 * math.log(2) - math.lgamma(k / 2))  # noqa: E731, B023
        area = sum(f(x + (i + 0.5) * step) for i in range(n)) * step
        assert abs(U.chi_square_p(x, k) - area) < 1e-6
    assert U.chi_square_p(0.0, 3) == 1.0 and U.chi_square_p(None, 3) is None
    table = spark.createDataFrame([("a", "x", 12), ("a", "y", 5), ("b", "x", 9), ("b", "y", 16)], "r string, c string, n long")
    plain, yates = M.chi_square(table, "r", "c").first()["chi2"], M.chi_square(table, "r", "c", yates=True).first()["chi2"]
    assert (round(plain, 4), round(yates, 4)) == (4.8471, 3.5571) or abs(plain - yates) > 0.5
    single = U.homogeneity(spark.createDataFrame([("x", 3)], "l string, n long"), spark.createDataFrame([("x", 4)], "l string, n long"), "l").first()
    assert single["chi2"] is None and single["note"] == "fewer than two labels"
    ok = U.gates([], "ok", 2, 3, {"l1_agreement": 0.9, "l2_share_stable": 0.8})
    assert ok["passed"] and ok["stable"] and ok["descriptive_allowed"]
    assert not U.gates(["L1-01"], "ok", 0, 0)["passed"] and not U.gates([], "high", 0, 0)["passed"] and not U.gates([], "ok", 5, 0, max_anomalies=4)["passed"]
    assert not U.gates([], "ok", 0, 0)["descriptive_allowed"] and U.gates([], "ok", 0, 0, without_stability=True)["descriptive_allowed"] and U.gates(["x"], "ok", 0, 0, force=True)["descriptive_allowed"]
    rows = spark.createDataFrame([(" L1-01 ", ["a", "a"]), (None, ["a"]), ("L1-02", [])], "L1_label string, l2 array<string>")
    valid = U.valid_l1(rows)
    p = U.profile(valid, "L1_label", "l2").first()
    assert (p["n"], p["empty_rate"], p["labels_per_row"]) == (2, 0.5, 1.0)
    assert [tuple(r) for r in U.row_prevalence(valid, "l2").collect()] == [("a", 2, 1.0)]
    flags = spark.createDataFrame([("L1-01", "a")], "L1 string, L2 string")
    assert U.cell_samples(valid.withColumn("id", F.lit(1)), flags, "L1_label", "l2", "id", 5, "s").count() == 1


def test_numbers_and_trends(spark):
    r = random.Random(5)
    rows = [(r.choice(["b", "a", None, "c" * r.randrange(3)]), i) for i in range(500)]
    got = O.numbered(spark.createDataFrame(rows, "k string, i long"), ["k", "i"], "n").collect()
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    assert sorted((x["n"], x["k"], x["i"]) for x in got) == [(n, k, i) for n, (k, i) in enumerate(want, 1)]
    assert O.numbered(spark.createDataFrame([], "k string"), ["k"], "n").count() == 0
    top = SA.top_share(spark.createDataFrame([(i, float(i // 2)) for i in range(20)], "i long, s double"), "s", 0.3)
    assert sorted(x["i"] for x in top.where("top").collect()) == list(range(14, 20))


def test_gap_sample_walks_all_candidates(spark):
    """Against a walk over every candidate, with both caps, blanks and ties."""
    r = random.Random(11)
    rows = [(i, r.choice(["Economy grows", "the eCONomy", "rain", "sun"]), r.choice(["", None, "s1", "s2", "s3", "s4"]), r.choice(["", "d1", "d2", "d3", "d4", "d5"]), float(r.randrange(12))) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, t string, source string, date string, score double")
    import hashlib

    for gap, words in ((4, ["economy"]), (60, ["ECON"]), (70, ["rain"]), (5, [])):
        hits = [x for x in rows if any(w.lower() in x[1].lower() for w in words)]
        rest = sorted((x for x in rows if x not in hits), key=lambda x: (hashlib.md5(f"7:L:{x[0]}".encode()).hexdigest(), x[0]))
        pool = hits + rest[: max(0, (3 if words else 5) * gap - len(hits))]
        target = int(gap * (2.0 if gap <= 20 else 1.5 if gap <= 50 else 1.3))
        most = (3, 2) if gap <= 50 else (7, 4)
        taken, used = set(), ({}, {})
        for x in sorted(pool, key=lambda x: (-x[4], x[0])):
            if len(taken) == target:
                break
            keys = (x[2], x[3])
            if any(k and used[j].get(k, 0) >= most[j] for j, k in enumerate(keys)):
                continue
            for j, k in enumerate(keys):
                used[j][k] = used[j].get(k, 0) + 1
            taken.add(x[0])
        got = SA.gap_sample(df, {"L": gap}, {"L": words}, "t", "score", "id", "source", "date", "7").collect()
        assert {x["id"] for x in got} == taken and len(got) == len(taken) and {x["target_l1"] for x in got} == {"L"}


def test_candidates(spark):
    rows = spark.createDataFrame([("01_hou meeting", "s1"), ("x_datasets 柯", "s2")], "source string, sentence string")
    got = I.format_candidates(rows, ["source"], L.CANDIDATES, L.PARTIES, L.SOURCE_TYPES_BY_SOURCE).orderBy("id").collect()
    assert [(r["id"], r["candidate"], r["party"], r["source_type"], r["date"]) for r in got] == [(1, "侯友宜", "KMT", "conference", ""), (2, "柯文哲", "TPP", "social_media", "")]
    kept = I.format_candidates(rows.withColumns({"unit_id": F.col("sentence"), "candidate": F.lit("c"), "party": F.lit("p")}), ["source"], L.CANDIDATES, L.PARTIES, L.SOURCE_TYPES_BY_SOURCE).first()
    assert (kept["id"], kept["candidate"]) == ("s1", "c")
