"""Golden cases of the text operators."""

from pyspark.sql import functions as F

from corpuslens import lexicons
from corpuslens.functions import text as T
from corpuslens.operators import metrics as M
from corpuslens.operators import order as O
from corpuslens.operators.segment import fuse_quotes, protected, split_sentences
from corpuslens.sources import read_csv_multi, read_responses, read_transcripts, tier, undecodable, write_requests


def one(spark, column, **values):
    return spark.createDataFrame([values]).select(column.alias("x")).first()["x"]


def test_light_clean(spark):
    got = one(spark, T.light_clean(F.col("t")), t="看 https://x.y/z <b>好</b>")
    assert (got["text"], got["url_removed"], got["html_removed"], got["space_norm"]) == ("看 <HTML> <HTML>好<HTML>", 1, 3, 0)
    assert one(spark, T.light_clean(F.col("t")), t="  \n ").asDict() == {"text": "", "url_removed": 0, "html_removed": 0, "promo_trim": 0, "space_norm": 0}
    got = one(spark, T.light_clean(F.col("t"), lexicons.PROMO), t="（記者甲攝） 正文  透過 Google News ")
    assert (got["text"], got["promo_trim"], got["space_norm"]) == ("正文", 2, 1)


def test_labels(spark):
    assert one(spark, T.parse_labels(F.col("t")), t=" L2-01 | |L2-03|") == ["L2-01", "L2-03"]
    assert one(spark, T.label_code(F.col("t")), t="L1-03_x") == "L1-03"
    assert one(spark, T.label_code(F.col("t")), t="xx") == "xx"


def test_segments():
    assert split_sentences("你好世界。今天天氣很好!謝謝") == ["你好世界。", "今天天氣很好! 謝謝"]
    assert split_sentences("他說「今天下雨。明天放晴。」然後離開會場。") == ["他說「今天下雨。明天放晴。」然後離開會場。"]
    assert split_sentences(None) == split_sentences("  ") == []
    assert protected("a(b)c)") == [(1, 3)]
    assert fuse_quotes(["他表示", "「好」", "x"]) == ["他表示 「好」", "x"]
    assert fuse_quotes(["某人抨擊", "'no'", "他痛批", "好", ""]) == ["某人抨擊 'no'", "他痛批", "好", ""]
    # an ender of several characters is one; every kind of bracket protects
    assert split_sentences("真的是這樣子嗎？！好的好的好的……然後就沒有了。") == ["真的是這樣子嗎？！", "好的好的好的……", "然後就沒有了。"]
    for a, b in ("“”", "‘’", "『』", "「」", "（）", "()", "《》", "〈〉", "【】", "〔〕", "[]", "{}"):
        assert split_sentences(f"前面的話{a}一句。二句！{b}後面的話。再來一句話。") == [f"前面的話{a}一句。二句！{b}後面的話。", "再來一句話。"]
    assert split_sentences("沒有關的（一句話。還有一句話。") == ["沒有關的（一句話。", "還有一句話。"]
    long = "字" * 100
    assert split_sentences(f"{long}；{long}") == [f"{long}；", long]
    assert split_sentences(f"{long}並且{long}例如{long}") == [long, f"並且{long}例如{long}"]
    assert split_sentences(f"{long}（因此{long}）同時{long}") == [f"{long}（因此{long}）", f"同時{long}"]
    assert split_sentences(f"但是{long}所以{long}") == [f"但是{long}所以{long}"]  # the first connector begins the piece
    import random

    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice("字詞「」（）()[]。！？…;； \n但是x.") for _ in range(r.randrange(60)))
        assert "".join("".join(split_sentences(text)).split()) == "".join(text.split())


def test_precision_recall(spark):
    rows = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B"), ("B", "B"), ("C", "A")], "t string, p string")
    per = M.precision_recall(M.confusion(rows, "t", "p"))
    got = {r["label"]: (round(r["precision"], 4), round(r["recall"], 4), round(r["f1"], 4), r["support"]) for r in per.collect()}
    assert got == {"A": (0.5, 0.5, 0.5, 2), "B": (0.6667, 1.0, 0.8, 2), "C": (0.0, 0.0, 0.0, 1)}
    s = M.summary_f1(per).first()
    assert (round(s["macro_f1"], 4), round(s["weighted_f1"], 4)) == (0.4333, 0.52)


def test_chi_square(spark):
    rows = spark.createDataFrame([(r, k, n) for r, v in ((0, (10, 20, 30)), (1, (20, 20, 20))) for k, n in enumerate(v)], "a int, b int, n int")
    got = M.chi_square(rows, "a", "b").first()
    assert (round(got["chi2"], 4), got["dof"], round(got["cramers_v"], 4)) == (5.3333, 2, 0.2108)


def test_moving_average(spark):
    rows = spark.sql("SELECT * FROM VALUES (DATE'2024-01-01', 0.7D), (DATE'2024-01-03', 0.7D) AS t(day, v)")
    assert [round(r["ma"], 4) for r in O.moving_average(rows, "day", "v").orderBy("day").collect()] == [0.7, 0.35, 0.4667]


def test_priority_dedup(spark):
    rows = spark.createDataFrame([("h", 1, 1), ("h", 3, 2), ("h", 3, 3), ("", 0, 4), ("", 0, 5)], "k string, tier int, o int")
    assert sorted(r["o"] for r in O.priority_dedup(rows, "k", "tier", "o").collect()) == [2, 4, 5]


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("主持人\n歡迎大家。\n\n今天開始。\n候選人\n謝謝，各位。".encode())
    got = [(r["speaker"], r["content"]) for r in read_transcripts(spark, str(tmp_path / "a.txt")).orderBy("session").collect()]
    assert got == [("主持人", "歡迎大家。 今天開始。"), ("候選人", "謝謝，各位。")]
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv/b.csv").write_bytes("标题,内容\n甲,乙".encode("gbk"))
    (tmp_path / "csv/c.csv").write_text('标题,内容\n丙,"丁\n戊"\n', encoding="utf-8-sig")
    (tmp_path / "csv/d.csv").write_bytes(b"\xff\xff\xff")
    got = read_csv_multi(spark, str(tmp_path / "csv"))
    assert got.columns == ["标题", "内容", "source_path"] and sorted((r[0], r[1]) for r in got.collect()) == [("丙", "丁\n戊"), ("甲", "乙")]
    assert [r["path"].split("/")[-1] for r in undecodable(spark, str(tmp_path / "csv")).collect()] == ["d.csv"]
    assert one(spark, tier(F.col("p"), [("news", 1), ("x", 2)]), p="/data/News/a.csv") == 1
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(120)], "id long, t string").coalesce(1)
    write_requests(rows, str(tmp_path / "req"), F.col("id").cast("string"), "m", "s", F.col("t"))
    assert len(list((tmp_path / "req").glob("part-*"))) == 3
    (tmp_path / "res").mkdir()
    (tmp_path / "res/1.jsonl").write_text('{"custom_id":"a","response":{"body":{"choices":[{"message":{"content":"{\\"L1\\":\\"x\\"}"}}]}}}\n{"custom_id":"b"}\n')
    assert {r["custom_id"]: r["error"] for r in read_responses(spark, str(tmp_path / "res")).collect()} == {"a": None, "b": "Empty content"}
    (tmp_path / "a_later").mkdir()
    (tmp_path / "a_later/0.jsonl").write_text('{"custom_id":"a","response":{"body":{"choices":[{"message":{"content":"not JSON"}}]}}}\n')
    got = read_responses(spark, [str(tmp_path / "res"), str(tmp_path / "a_later")]).collect()  # the later batch, whatever the names
    assert {r["custom_id"]: r["error"] for r in got} == {"a": "JSON Parse Error", "b": "Empty content"}


def test_streaming(spark, tmp_path):
    from corpuslens.streaming import upsert_sink, windowed_counts

    spark.sql("SELECT TIMESTAMP'2024-01-01' + make_interval(0,0,0,id) AS ts, 'a' AS label, id AS user FROM range(10)").select("ts", "label", F.col("user").cast("int").alias("user")).write.parquet(str(tmp_path / "in"))
    schema = "ts timestamp, label string, user int"
    q = windowed_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "ts", "label", size="1 day", slide="1 day").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == 10
    q = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(upsert_sink(str(tmp_path / "out"), ["label"], "ts")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    from corpuslens.streaming import drop_duplicates

    q = drop_duplicates(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "ts", "label").writeStream.outputMode("append").format("memory").queryName("d").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT count(*) FROM d").first()[0] == 1


def test_without_training_operators():
    """The entry points import where the training-data folders are absent."""
    import os
    import shutil
    import subprocess
    import sys
    import tempfile

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.TemporaryDirectory() as t:
        shutil.copytree(os.path.join(root, "corpuslens"), f"{t}/corpuslens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(os.path.join(root, "__spark_entry__.py"), t)
        code = "import __spark_entry__ as e; q = e.queries(); assert 'table1_profile' in q and 'pipeline' not in q; e.oracle_sql()"
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        subprocess.run([sys.executable, "-c", code], cwd=t, env=env, check=True)
        if os.path.exists(os.path.join(root, "corpus_pipeline.py")):  # left behind, it must not matter either
            shutil.copy(os.path.join(root, "corpus_pipeline.py"), t)
            subprocess.run([sys.executable, "-c", code], cwd=t, env=env, check=True)


def test_greedy_gap_sample_walks_all_rows(spark, tmp_path):
    import random

    from corpuslens.plans import catalogue

    r = random.Random(4)
    rows = [(i, r.choice(["en", "en", "fr", None]), r.choice([None, "", " ", *[f"src{k}" for k in range(12)]])) for i in r.sample(range(9000), 2400)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    want = set()
    for lang in ("en", "fr", None):
        used, took = {}, 0
        for i, _, source in sorted((x for x in rows if x[1] == lang), key=lambda x: (-((x[0] * 37) % 101), x[0])):
            if took < 40 and (not source or used.get(source, 0) < 3):
                used[source] = used.get(source, 0) + 1
                took += 1
                want.add((i, lang, source))
    got = catalogue()["greedy_gap_sample"][0](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(x["doc_id"], x["lang"], x["source"]) for x in got} == want
