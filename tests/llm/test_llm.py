"""The training-data operators against brute force on small and odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpuslens.llm import chat, common, decontaminate, html_text, jaccard_join, langid, line_quality, lm_score, packing, pu_quality, repeats
from corpuslens.llm.suffix_array import permuted_prefixes, suffix_array

DOCS = "doc_id long, text string, lang string, source string, n_chars long, a long, tokens string"
LONG = "Lorem dolor sit amet. " * 3000


def odd(spark):
    """Nulls, empty, blank, very long and repeated rows, ties, and extra columns with clashing names."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    base = " ".join(word() for _ in range(150))
    words = base.split()
    near = " ".join([*words[:80], "changed", *words[81:]])
    texts = [base, base, near, None, "", " \n\t", "Ünï cödé ünï", "one", LONG, base + " " + " ".join(word() for _ in range(60)), " ".join(word() for _ in range(90)) + " " + base, "a" * 900]
    rows = [(i, t, "en" if i % 2 else None, None, None, 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[7], (None, base, "en", "s", 1, 1, "x")], DOCS)


def test_suffix_array():
    r = random.Random(1)
    for n in (*range(12), 60, 200):
        for k in (1, 2, 5, 200):
            t = np.array([r.randrange(k) for _ in range(n)] * r.choice((1, 3)), np.uint8)
            b = bytes(t)
            want = sorted(range(len(b)), key=lambda i: b[i:])
            assert suffix_array(t, 256).tolist() == want
            p = permuted_prefixes(t, np.array(want, np.int64))
            for x, y in zip(want, want[1:]):
                m = 0
                while max(x, y) + m < len(b) and b[x + m] == b[y + m]:
                    m += 1
                assert p[y] == m


def test_suffix_array_of_long_texts():
    """Large alphabets, long repeats and runs, against ranks by doubling."""
    r = random.Random(1)
    for trial in range(24):
        n, k = r.choice((2500, 6000)), r.choice((2, 5, 50, 3000, 100_000))
        t = ([r.randrange(k) for _ in range(n // r.choice((1, 2, 7, 100)))] * 200)[:n]
        for _ in range(5 * (trial % 3)):
            t[r.randrange(len(t))] = r.randrange(k)
        t = np.array([1] * n if trial % 9 == 0 else t, np.int64)
        n, k = len(t), int(t.max()) + 1
        rank, h = t.copy(), 1
        while h <= n:
            _, rank = np.unique(rank * (n + k + 5) + np.r_[rank[h:] + 1, np.zeros(h, np.int64)][:n], return_inverse=True)
            h *= 2
        sa = suffix_array(t, k)
        assert (np.argsort(rank) == sa).all()
        p = permuted_prefixes(t, sa)
        for _ in range(50):
            i = r.randrange(1, n)
            x, y, m = sa[i - 1], sa[i], 0
            while max(x, y) + m < n and t[x + m] == t[y + m]:
                m += 1
            assert p[y] == m


def brute_repeats(texts, window):
    raws = [(t or "").encode() for t in texts]
    count = Counter(b[k : k + window] for b in raws for k in range(len(b) - window + 1))
    out = []
    for b in raws:
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if count[b[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats(spark, hot):
    docs = odd(spark).where("doc_id IS NULL OR doc_id <> 8")
    rows = docs.collect()
    want = sorted(brute_repeats([r["text"] for r in rows], 400))
    got = repeats.remove_repeats(docs, hot=hot)
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()) == want
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeated_passage_stage(spark, hot, monkeypatch):
    import corpus_pipeline

    r = random.Random(6)
    word = lambda low, high: "".join(r.choice("abcdefghij") for _ in range(r.randint(low, high)))
    fill = lambda n: " ".join(word(3, 9) for _ in range(n))
    texts = []
    for n in (49, 50, 51, 52, 55, 60, 90):
        for low, high in ((1, 1), (1, 9), (4, 6)):
            shared = " ".join(word(low, high) for _ in range(n))
            texts += [f"{fill(20)} {shared} {fill(8)}", f"{fill(5)}\n{shared} {fill(30)}"]
    half, other = fill(40), fill(40)
    texts += [f"{half} {other}", f"{half} {fill(30)}", f"{fill(30)} {other}", "x " * 60, fill(51), fill(30)]
    texts.append(texts[-2])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    spans = [[m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] for t in texts]
    windows = [[(w[k][0], w[k + 50][1]) for k in range(len(w) - 50)] for w in spans]
    count = Counter(t[a:b] for t, own in zip(texts, windows) for a, b in own)
    want = {}
    for i, (t, own) in enumerate(zip(texts, windows)):
        gone = {x for a, b in own if count[t[a:b]] > 1 for x in range(a, b)}
        kept = "".join(c for x, c in enumerate(t) if x not in gone)
        if kept.strip():
            want[i] = kept
    assert sum(len(want.get(i, "")) < len(t) for i, t in enumerate(texts)) > 20
    monkeypatch.setattr(repeats.repeated_word_spans, "__defaults__", (51, hot))
    got = {x["doc_id"]: (x["text"], x["n_chars"]) for x in corpus_pipeline.repeated_passage_stage(spark, docs, "").collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def brute_components(rows, k, percent):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[x : x + k]) for x in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    lead = {i: i for i in sets}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                lead[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_signatures_of_linked_sets_meet():
    """Every linked pair has a signature that passes the position bound, whatever is rare."""
    r = random.Random(9)
    for percent in (50, 80, 85):
        for pair_from in (0, 3, 6, 99):
            for _ in range(60):
                n = r.choice((1, 2, 3, 5, 8, 20, 60))
                base = r.sample(range(400), n)
                other = [x for x in base if r.random() > 0.1] + r.sample(range(400, 800), r.randrange(1 + n // 6))
                sets = [set(base), set(other) or {base[0]}]
                shared, union = len(sets[0] & sets[1]), len(sets[0] | sets[1])
                if 100 * shared < percent * union or sets[0] == sets[1]:
                    continue
                sh = np.array([x for s in sets for x in s], np.uint64)
                row = np.repeat([0, 1], [len(s) for s in sets])
                size = np.array([len(s) for s in sets])
                often = (sh * np.uint64(7919) % np.uint64(8)).astype(np.int64)
                sigs, counts, singles, rare = jaccard_join.signatures(sh, row, often, size, percent, pair_from)
                own = []
                for x in (0, 1):
                    mine = sigs[counts[:x].sum() :][: counts[x]].tolist()
                    assert len(mine) <= 2 * size[x] + 1
                    own.append({s: (i, 0) if i < singles[x] else (rare[x] + i - singles[x], i - singles[x]) for i, s in enumerate(mine)})
                met = [(own[0][s], own[1][s]) for s in own[0].keys() & own[1].keys()]
                assert any((100 + percent) * (min(a, b) + min(size[0] - p, size[1] - q)) >= percent * size.sum() for (p, a), (q, b) in met)


def test_frequent_summary():
    token, c = np.empty(0, np.uint64), np.empty(0, np.int64)
    parts = [np.array([5] * 9 + [7] * 3 + [k], np.uint64) for k in range(100, 120)]
    for p in parts:
        token, c = jaccard_join._fold(token, c, [p])
    assert dict(zip(token.tolist(), c.tolist())) == {5: 180, 7: 60, **{k: 1 for k in range(100, 120)}}


def test_common_words_fill_no_buckets(spark):
    """Texts that share shingles of common words only, by chance, have no signature in common, although
    no token is known to be frequent."""
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("abcdef") if x % 12 < 6 else f"w{i}x{x}" for x in range(240))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = jaccard_join._signatures(docs, 3, 85, jaccard_join._frequent(docs, 3, 10**6), 1024)
    assert sets.agg({"n_sigs": "sum"}).first()[0] > 4000
    assert jaccard_join._buckets(sets, 4).count() == 0


def test_pairs_compared_in_turns(spark, monkeypatch):
    r = random.Random(8)
    base = [f"w{x}" for x in range(80)]
    rows = [(i, " ".join(f"y{i}x{x}" if r.random() < i / 60 else w for x, w in enumerate(base))) for i in range(7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[x : x + 2]) for x in range(79)} for i, t in rows}
    every = [(a, b) for a in sets for b in sets if a < b]
    want = {(a, b) for a, b in every if 100 * len(sets[a] & sets[b]) >= 70 * len(sets[a] | sets[b])}
    names, write = [], jaccard_join.scratch
    monkeypatch.setattr(jaccard_join, "scratch", lambda df, name, *a, **k: names.append(name) or write(df, name, *a, **k))
    monkeypatch.setattr(jaccard_join, "PAIRS", 1)
    pairs = write(spark.createDataFrame(every, "a long, b long"), "pairs")
    got = jaccard_join._verified(pairs, docs, jaccard_join._tokens(docs, docs.select("doc_id"), 2, True), 2, 70)
    assert {tuple(x) for x in got.collect()} == want and 0 < len(want) < len(every) and names.count("likely") == 4


def test_jaccard_of_many_sets(spark, monkeypatch):
    """Where ids are too many to be sent to all tasks, the tables are dealt out, with the same result."""
    rows = [(x["doc_id"], x["text"]) for x in odd(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "SMALL", 0)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.jaccard_components(docs, 4, 60).collect()}
    assert got == brute_components(rows, 4, 60)


@pytest.mark.parametrize("pair_from", [1024, 0])
def test_jaccard(spark, pair_from):
    r = random.Random(4)
    base = [[f"w{r.randrange(400)}" for _ in range(60)] for _ in range(4)]
    rows = []
    for i in range(60):
        w = list(base[i % 4])
        for _ in range(r.randint(0, 4)):
            w[r.randrange(60)] = f"x{r.randrange(1000)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 4, 85)
    got = jaccard_join.jaccard_components(docs, 4, 85, frequent_floor=3, pair_from=pair_from)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got.collect()} == want
    some = odd(spark).where("doc_id IS NOT NULL")
    want = brute_components({(x["doc_id"], x["text"]) for x in some.collect()}, 4, 85)
    got = jaccard_join.jaccard_components(odd(spark), 4, 85).collect()
    assert len(got) == 14 and {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got if x["doc_id"] is not None} == want
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_containment(spark):
    docs = odd(spark)
    text = docs.where("doc_id = 0").first()["text"]
    items = spark.createDataFrame([(1, " ".join(text.split()[20:60])), (2, "one"), (3, None), (None, text), (4, "no such words are in any of these")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(0, 1), (1, 1), (2, 1), (9, 1), (10, 1), (7, 2)}
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {None, 3, 4, 5, 6, 8, 11}
    assert decontaminate.contaminated(docs, items.limit(0)).count() == decontaminate.contaminated(docs.limit(0), items).count() == 0


def test_containment_by_size(spark):
    """Items of one word to hundreds, in documents of every length, against brute force."""
    r = random.Random(12)
    word = lambda: f"w{r.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((1, 2, 4, 5, 6, 9, 17, 40, 90, 200, 300))]
    docs = []
    for i in range(80):
        own = items[i % len(items)][1].split()
        if i % 3 == 0 and len(own) > 9:
            own[r.randrange(len(own))] = "changed"
        cut = own[: len(own) * (10 - i % 4) // 10] if i % 2 else own
        docs.append((i, " ".join([word() for _ in range(r.randrange(40))] + cut + [word() for _ in range(r.randrange(40))])))
    tokens = lambda t: (lambda w: {tuple(w[x : x + 5]) for x in range(len(w) - 4)} if len(w) > 4 else {tuple(w)})(t.split())
    want = {(d, i): len(tokens(x) & tokens(t)) for d, t in docs for i, x in items if 100 * len(tokens(x) & tokens(t)) >= 80 * len(tokens(x))}
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x["doc_id"], x["item_id"]): x["n_shared"] for x in got.collect()} == want and len(want) > 30


def test_scratch_tables(spark, tmp_path):
    import os

    one = common.scratch(spark.range(10).repartition(2), "one")
    path = one.__dict__["scratch_path"]
    two = common.scratch(one.groupBy((one.id % 3).alias("k")).count(), "two", [one])
    assert not os.path.exists(path) and two.count() == 3
    common.discard(two, spark.range(1))


def test_join_skewed(spark):
    rows = spark.createDataFrame([(1 if i < 900 else i, i) for i in range(1000)] + [(None, 1)], "k long, v long")
    keys = common.scratch(rows.where("k % 2 = 1").groupBy("k").agg({"*": "count"}).withColumnRenamed("count(1)", "n"), "keys")
    for how in ("inner", "left_semi", "left_anti"):
        want = rows.join(keys, ["k"], how)
        assert sorted(map(str, common.join_skewed(rows, keys, ["k"], "n", how).collect())) == sorted(map(str, want.collect()))


def test_row_keys(spark):
    rows = [(5, "a"), (None, "b"), (7, "c"), (7, "d"), (None, "b"), (9, None), (7, "c")]
    got = common.row_keys(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(str, rows))
    keys = [r["row_key"] for r in got]
    assert len(set(keys)) == 7 and all(r["row_key"] == r["doc_id"] if r["doc_id"] in (5, 9) else r["row_key"] > 9 for r in got)
    top = common.row_keys(spark.createDataFrame([(2**63 - 1, "a"), (3, "b"), (3, "c")], "doc_id long, text string")).collect()
    assert len({r["row_key"] for r in top}) == 3 and all(r["row_key"] < 3 or r["doc_id"] > 3 for r in top)
    plain = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert common.row_keys(plain).first()["row_key"] == 1 and common.row_keys(plain.limit(0)).count() == 0


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_odd_rows(spark):
    """Null and repeated ids: rows neither vanish nor multiply, and decisions follow the texts."""
    import corpus_pipeline as p

    r = random.Random(14)
    fill = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(n))
    a, b, c, shared, item = fill(90), fill(90), fill(90), fill(60), fill(40)
    rows = [(1, a), (None, a), (1, b), (None, c), (2, None), (3, ""), (4, f"{fill(20)} {shared}"), (4, f"{shared.upper()}\n{fill(20)}"), (None, f"{fill(9)} {item}")]
    docs = spark.createDataFrame([(i, t, "en", "s", 7) for i, t in rows], COLUMNS)
    texts = lambda d: sorted((x["doc_id"] or 0, x["text"] or "") for x in d.collect())
    given = texts(docs)
    got = texts(p.near_duplicate_stage(spark, docs, ""))
    assert len(got) == 8 and sum(t == a for _, t in got) == 1 and {t for _, t in got} == {t for _, t in given}
    got = p.repeated_passage_stage(spark, docs, "")
    assert got.columns == docs.columns and all(x["n_chars"] == len(x["text"]) for x in got.collect())
    assert sorted(len(t.split()) for _, t in texts(got)) == [20, 20, 49, 90, 90]  # both copies of a go
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(path := f"{common.shared_dir(spark)}/odd/benchmark.parquet")
    got = p.decontamination_stage(spark, docs, path.removesuffix("/benchmark.parquet"))
    assert got.columns == docs.columns and texts(got) == sorted(x for x in given if item not in x[1])
    got = p.packing_stage(spark, docs, "").collect()
    assert sum(x["length"] for x in got if x["doc_id"] is None) > 0 and len(got) == 9
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, path.removesuffix("/benchmark.parquet")).count() == 0


def test_pipeline(spark, tmp_path):
    """run() against each rule by brute force on what its stage was given."""
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    kept = p.language_stage(spark, docs, sf).collect()
    assert {(x["doc_id"], x["text"]) for x in kept} <= {(x["doc_id"], x["text"]) for x in docs.collect()} and len(kept) > 150
    lead = brute_components([(x["doc_id"], x["text"]) for x in kept], 5, 80)
    texts = {x["doc_id"]: x["text"] for x in kept if lead[x["doc_id"]][1] == x["doc_id"]}
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    spans = {i: [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] for i, t in texts.items()}
    words = {i: [texts[i][a:b].translate(low) for a, b in own] for i, own in spans.items()}
    count = Counter(tuple(w[k : k + 51]) for w in words.values() for k in range(len(w) - 50))
    cut = {}
    for i, t in texts.items():
        lost = {x for k in range(len(spans[i]) - 50) if count[tuple(words[i][k : k + 51])] > 1 for x in range(k, k + 51)}
        gone = {y for x in lost for y in range(spans[i][x][0], spans[i][x + 1][0] if x + 1 in lost else spans[i][x][1])}
        rest = "".join(c for x, c in enumerate(t) if x not in gone)
        if re.search(r"[^\x20\x09-\x0D]", rest):
            cut[i] = rest
    sets = lambda t: (lambda w: {tuple(w[x : x + 5]) for x in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())(re.findall(r"[^\x20\x09-\x0D]+", t.translate(low)))
    items = [s for x in common.table(spark, sf, "benchmark").collect() if (s := sets(x["text"] or ""))]
    clean = {i: t for i, t in cut.items() if not any(100 * len(s & own) >= 80 * len(s) for own in [sets(t)] for s in items)}
    whole = Tokenizer.from_file(packing.tokenizer_paths()[0])
    want = set()
    for i, t in clean.items():
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or min(1024, len(ids))
        at = [0, *range(first, len(ids), 1024), len(ids)]
        want |= {(i, k, at[k], at[k + 1] - at[k], zlib.crc32(ids[at[k] : at[k + 1]].tobytes())) for k in range(len(at) - 1)}
    got = p.run(spark, sf).collect()
    assert {(x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got} == want and len(got) == len(want)


def test_packing(spark):
    docs = odd(spark)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_paths()[0])
    got = [r.asDict() for r in packing.pack_documents(docs, 256).collect()]
    for row in docs.where("doc_id IS NOT NULL AND doc_id <> 7").collect():
        ids = np.array([*whole.encode(row["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted((r for r in got if r["doc_id"] == row["doc_id"]), key=lambda r: r["piece"])
        assert sum(r["length"] for r in own) == len(ids) and all(r["length"] == 256 for r in own[1:])
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 256
    assert packing.pack_documents(docs.limit(0)).count() == 0
    wide = "".join(chr(c) for c in range(0x20, 0x3100, 7)) + " ".join(chr(c) for c in range(0x10000, 0x1F700, 97))
    r = random.Random(8)
    mixed = ["".join(r.choice("aZ09 .,'\n\t  éßñ日🤖\u00a0\u200d\u0301'sll") for _ in range(60)) for _ in range(400)]
    for t in ("x<|endoftext|>y", "  a\n\n b", "日本語 🤖 it's", wide, *mixed):
        assert packing.token_ids(t, packing.tokenizer_paths()) == whole.encode(t, add_special_tokens=False).ids


def test_best_two_fit():
    r = np.random.default_rng(0)
    lengths = r.integers(1, 101, 3000)
    where, offset = packing.best_two_fit(lengths, 100)
    fill = np.bincount(where, weights=lengths)
    assert fill.max() <= 100 and len(fill) <= 1.03 * lengths.sum() / 100 + 20
    # 60 + 30 leaves 10; 30 makes way for 21 + 19
    assert len(set(packing.best_two_fit(np.array([60, 30, 21, 19]), 100)[0].tolist())) == 2


def test_quality_rules(spark):
    docs = odd(spark)
    got = {r["doc_id"]: r for r in line_quality.quality_rules(docs).collect()}
    for row in docs.where("doc_id IS NOT NULL").collect():
        t = row["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        r = got[row["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_symbols"], r["n_dup_lines"]) == (sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)))
        bad = [x for x in lines if line_quality.line_fails(x)]
        assert (r["lines_removed"], r["chars_removed"]) == (len(bad), sum(map(len, bad)))
        assert r["kept"] == (not r["base_failed"] and 2 * sum(map(len, bad)) <= sum(map(len, lines)))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    assert line_quality.line_fails("a | b | c | d") == "navigation" and line_quality.line_fails("This is a sentence.") is None
    long = "A sentence of an article in which somebody tells us a rather long story, " * 5
    assert line_quality.line_fails(long + "and not to read more.") is None and line_quality.line_fails("Please accept cookies. " * 40) == "boilerplate"
    assert line_quality.line_fails("All rights reserved.") == "boilerplate" and line_quality.line_fails("THIS IS SHOUTED LOUD!") == "shouting"
    assert line_quality.quality_rules(docs.limit(0)).count() == 0


def test_language(spark):
    r = random.Random(3)
    stems = {"aa": ["lorum", "ipsa", "dola"], "bb": ["kwych", "zxeth", "brygg"]}
    rows = [(i, " ".join(r.choice(stems[lang]) + r.choice("xyz") for _ in range(40)), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net, classes = langid.train_language_model(docs.where("doc_id % 4 <> 2"))
    got = langid.identify_language(docs.where("doc_id % 4 = 2"), net, classes, ["lang"]).collect()
    assert classes == ["aa", "bb"] and np.mean([x["lang"] == x["lang_pred"] for x in got]) > 0.95
    strange = {x["doc_id"]: x for x in langid.identify_language(odd(spark), net, classes).collect()}
    assert all(strange[i]["lang_pred"] == "und" for i in (3, 4, 5)) and strange[8]["lang_pred"] in classes
    assert [langid.has_letter(t) for t in (None, "", "² ½ 3 _", "² ñ", "字")] == [False, False, False, True, True]
    short = spark.createDataFrame([(i, w, lang) for i, (w, lang) in enumerate([("the cat", "en"), ("le chat", "fr")] * 10 + [("der Hund und die Katze " * 9, "de")] * 5)] + [(None, "el gato", "es")] * 3, "doc_id long, text string, lang string")
    assert langid.train_language_model(short)[1] == ["de", "en", "es", "fr"]
    assert len(langid.training_windows(short, 4, 6)[0]) <= 24
    none, empty = langid.train_language_model(docs.limit(0))
    assert langid.identify_language(docs, none, empty).where("lang_pred = 'und' AND score = 0").count() == 120


def test_quality_classifier(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 > 0
        words = [f"{r.choice('abcdefgh')}{r.choice('aeiou')}{r.choice('lmnr')}{r.choice('aeio')}" for _ in range(40)]
        rows.append((i, " ".join(words) + "." if good else "### ".join(words[:3] * 12)))
        if i % 3:
            labels.append((i, int(good)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    net = pu_quality.train_quality_model(docs, lab)
    got = pu_quality.score_quality(docs, net).collect()
    assert np.mean([(x["doc_id"] % 4 > 0) == x["predicted"] for x in got]) > 0.95
    assert pu_quality.score_quality(odd(spark), net).where("score BETWEEN 0 AND 1").count() == 14
    assert pu_quality.train_quality_model(docs, lab.limit(0)) is None
    assert abs(net.prior - 0.75) < 0.1
    again = pu_quality.train_quality_model(docs, lab.where("quality = 1"))  # label 0 teaches nothing
    assert all(np.array_equal(a, b) for a, b in zip(net.params(), again.params()))


def test_prior():
    r = np.random.default_rng(3)
    for share in (0.2, 0.6, 0.9):
        rows = lambda n, good: r.normal(1.5 if good else -1.5, 1, (n, pu_quality.FEATURES))
        unlabelled = r.permutation(np.concatenate([rows(int(3000 * share), True), rows(3000 - int(3000 * share), False)]))
        assert abs(pu_quality.estimate_prior(rows(2000, True), unlabelled) - share) < 0.07


def test_html():
    page = '<html><head><title>T</title></head><body><div class="top-menu"><a href="/">Home</a></div><article><h1>Head &amp; line</h1><p>One\n two <b>three</b>.<p>Second<br>row.</p><div id="comments"><p>Nice post!</p></div></article><aside>x</aside><footer>f</footer></body></html>'
    assert html_text.main_text(page) == "Head & line\n\nOne two three.\n\nSecond row."
    body = "<div>" + "".join(f"<p>{'Long paragraph of text, number %d, that goes on for a while and then stops.' % i}</p>" for i in range(4)) + "</div>"
    loose = f'<body><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul><!-- <p>no</p> --><script>var a = "<p>no</p>";</script>{body}<form><p>Sign up</p></form></body>'
    assert html_text.main_text(loose).count("Long paragraph") == 4 and "Sign" not in html_text.main_text(loose) and html_text.main_text("") == ""


def test_broken_html():
    body = "".join(f"<p>Paragraph number {i} of the article that goes on for quite a while and then ends.</p>" for i in range(5))
    want = "\n\n".join(f"Paragraph number {i} of the article that goes on for quite a while and then ends." for i in range(5))
    for page in (
        f"<html><head><title>T</title><meta charset=utf-8><body>{body}</body></html>",
        f"<html><head><title>T</title><div>{body}</div></html>",
        f"<body><svg width=1 /><div>{body}</div></body>",
        f"<body><iframe src=x /><div>{body}</div></body>",
        f"<body><iframe src=x><div>{body}</div></body>",
        f"<body><nav><ul><li><a href=/>Home</a></li></ul><div>{body}</div></body>",
        f'<body><div class="content has-sidebar">{body}</div></body>',
        f"<body><article><p>Read also: a teaser of another story here.</p></article><div id=story>{body}</div></body>",
        f'<body><div id=story>{body}</div><div class="comments-area"><p>{"I do not agree with this. " * 9}</p></div><p>© 2024 Some Company Limited, all over the world.</p></body>',
        f"<body><form id=f><div>{body}</div></form></body>",
    ):
        got = html_text.main_text(page)
        assert got in (want, "Read also: a teaser of another story here.\n\n" + want)
    odd = f"<article>{body}<p>where <math><mi>x</mi></math> is <object>known</object> a<!-- c -->b &lt; c.</p></article>"
    assert html_text.main_text(odd).endswith("\n\nwhere x is known ab < c.")


def test_pages(spark):
    page = "<article><p>Text of a page.</p></article>"
    pages = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "x"), (None, "v", "", "x"), (3, "w", "<p>" + LONG + "</p>", "x")], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"] or 0, r["url"] or "", r["text"], r["n_chars"]) for r in html_text.extract_pages(pages).collect())
    assert got == [(0, "v", "", 0), (1, "u", "Text of a page.", 15), (1, "u", "Text of a page.", 15), (2, "", "", 0), (3, "w", LONG.strip(), len(LONG.strip()))]
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_reply_trees(spark):
    rows = [(1, 1, None, 0.0, "user", "q<|end|>&lt;"), (1, 2, 1, 1.0, "assistant", "bad"), (1, 3, 1, 2.0, "assistant", "good </s>&#124;"), (1, 4, 3, 0.5, "user", None), (2, 1, 9, None, "us|er", ""), (3, 1, 2, 1.0, "user", "loop"), (3, 2, 1, 1.0, "user", "loop")]
    m = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, score double, role string, text string")
    made = chat.format_paths(m)
    back = {r["tree_id"]: r for r in chat.read_back(made).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [("user", "q<|end|>&lt;"), ("assistant", "good </s>&#124;"), ("user", "")]
    assert back[1]["loss"] == ["good </s>&#124;"] and [(t["role"], t["text"]) for t in back[2]["turns"]] == [("us|er", "")] and 3 not in back
    for r in made.where("tree_id = 1").collect():
        assert [r["formatted"][s["start"] - 1 : s["start"] - 1 + s["length"]] for s in r["loss_spans"]] == ["good &lt;/s>&amp;#124;"]
    assert {r["leaf_id"] for r in chat.format_paths(m, keep=2).where("tree_id = 1").collect()} == {4, 2}
    assert chat.format_paths(m.limit(0)).count() == 0


def test_scores(spark, monkeypatch):
    import math

    from pyspark.sql import functions as F

    docs = odd(spark)
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    tokens = {r["doc_id"]: [*re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(low)), None] for r in docs.collect()}
    train = Counter()
    for r in docs.collect():
        if r["doc_id"] is None or r["doc_id"] % 2:
            train.update(tokens[r["doc_id"]])
    n, v = sum(train.values()), len(train)
    for kept in (500_000, 3):
        monkeypatch.setattr(lm_score, "KNOWN_WORDS", kept)
        for r in lm_score.score_documents(docs, F.col("doc_id") % 2 == 0).collect():
            w = tokens[r["doc_id"]]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(train[x] > 0 for x in w), n)
            assert math.isclose(r["base_score"], sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9) and r["score"] < 0


def test_scores_of_an_empty_table(spark):
    from pyspark.sql import functions as F

    assert lm_score.score_documents(odd(spark).limit(0), F.lit(False)).count() == 0
    got = lm_score.score_documents(odd(spark), F.lit(True)).collect()  # nothing to learn from
    assert all(r["train_tokens"] == r["n_known"] == 0 and np.isfinite(r["score"]) and np.isfinite(r["base_score"]) for r in got)


def test_words_spelled_together():
    """Ids of words encoded in one text are those of each word alone, and cut where the words are."""
    paths, r = packing.tokenizer_paths(), np.random.default_rng(5)
    plain = ["Hello", "it's", "x", "3.14", "naïve", "日本語", "...", "'s", "a" * 3000, "¿qué?", "e\u0301", "0"]
    odd_words = ["\u00a0", "a\u00a0", "\u00a0\u00a0b", "\u2003x\u3000", "\x1cz", "<|endoftext|>", "a<|endoftext|>b"]
    for words in ([], ["a"], plain, odd_words, plain + odd_words, [str(x) for x in r.integers(0, 10**9, 500)]):
        for _ in range(5):
            words = [words[i] for i in r.permutation(len(words))]
            data = np.frombuffer("\n".join(words).encode(), np.uint8)
            sizes = np.array([len(w.encode()) for w in words], np.int64)
            start = np.cumsum(sizes + 1) - sizes - 1
            ids, n = lm_score._spelled(data, start, start + sizes, paths)
            low = [w.encode().lower().decode() for w in words]
            assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == (packing.word_ids(low, paths) if words else [[]])


def test_tokens_read_back():
    """Equal words of any rows have equal hashes, others do not; every row ends with the end."""
    texts = ["", "One two one", "  two\tONE ", "x" * 40, "\u00a0 \u00a0", " ".join(f"w{i}" for i in range(300))]
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    ids, sizes, token = lm_score._subwords(np.frombuffer("".join(texts).encode(), np.uint8), offsets, packing.tokenizer_paths())
    ends = np.cumsum(sizes)
    bits = [np.packbits(token[e - n : e]).tobytes() for e, n in zip(ends, sizes)]
    hashes, row = lm_score._tokens(pa.array(bits, pa.binary()), ids, sizes)
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    want = [(i, w) for i, t in enumerate(texts) for w in [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(low)), None]]
    assert row.tolist() == [i for i, _ in want] and (ids[ends - 1] == lm_score.END).all()
    assert len({(h, w) for h, (_, w) in zip(hashes.tolist(), want)}) == len({w for _, w in want}) == len(set(hashes.tolist()))


def test_windows_learned_from():
    row = np.repeat([0, 1, 2, 3], [1, 5, 40, 3])
    for thin in (1, 2, 7, 50):
        kept = lm_score._thinned(row, thin)
        counts = np.bincount(row[kept], minlength=4)
        assert (counts >= 1).all() and (abs(counts - np.bincount(row) / thin) <= 1).all()


def test_every_window_is_learned_from():
    """However large the table, the rounds take every window, each once after the first round."""
    r = np.random.default_rng(3)
    sizes = np.array([1, 5, 33, 900, 2, 4000, 64])
    ids = r.integers(0, lm_score.IDS, sizes.sum()).astype(np.uint16)
    windows = lambda **k: Counter(zip(*(map(bytes, x) for x in lm_score._batches(ids, sizes, 0, **k)[:3]), strict=True))
    for subwords in (100, 10**8, 10**9):
        rounds = lm_score._schedule(subwords, 4, lm_score.ROUNDS)
        got = sum((windows(thin=thin, part=part) for thin, part in rounds[len(lm_score.ROUNDS) - 1 :]), Counter())
        assert got == windows() and (len(rounds) > 2) == (subwords > 100)


def test_scores_beat_word_parts_alone(spark):
    """On held-out text the model is better than smoothed counts of single subword ids."""
    from corpuslens.llm.queries import _fold

    docs = common.table(spark, "/root/testdata/sf0.01", "documents").where("text IS NOT NULL")
    got = lm_score.score_documents(docs, _fold(5) == 1).where("held_out").agg({"score": "sum", "n_subwords": "sum"}).first()
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    paths, ids = packing.tokenizer_paths(), {False: Counter(), True: Counter()}
    for r in docs.select("text", (_fold(5) == 1).alias("held")).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"].translate(low))
        ids[r["held"]].update(x for w in packing.word_ids(words, paths) for x in w)
        ids[r["held"]][-1] += 1
    n, v = sum(ids[False].values()), len(ids[False])
    unigram = sum(c * np.log10((ids[False][x] + 0.5) / (n + 0.5 * (v + 1))) for x, c in ids[True].items()) / sum(ids[True].values())
    assert got["sum(score)"] / got["sum(n_subwords)"] > unigram + 0.1


def test_scores_learn_from_every_training_row(spark, monkeypatch):
    from pyspark.sql import functions as F

    words = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(6)]
    rows = [(i, t) for i, t in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(32)) != 0).coalesce(1)
    assert docs.count() > 3
    score = lambda d: {r["doc_id"]: r["score"] for r in lm_score.score_documents(d, F.col("doc_id") < 0).collect()}
    got = score(docs)
    monkeypatch.setattr(lm_score, "_train", lambda d, vocabulary, *a, **k: lm_score.CausalModel(vocabulary.inputs, vocabulary.outputs))
    first = score(docs)
    assert all(got[i] > first[i] + 1 for i in first)  # better than the first weights


def test_output_classes_in_two_steps():
    """A target costs a group's and a slot's score, not every class's, and the probabilities of all classes
    sum to one; large scores are no trouble."""
    r = np.random.default_rng(2)
    for outputs, scale in ((256, 1), (7, 1), (1, 1), (31, 60)):
        model = lm_score.CausalModel(20, outputs)
        assert len(model.top) + model.out.shape[1] <= 2 * outputs**0.5 + 1
        for name in model.names:
            setattr(model, name, getattr(model, name).astype(np.float64) * scale)
        c = r.integers(0, 20, (1, lm_score.CONTEXT))
        real = np.ones(c.shape, bool)
        every = np.array([model.log_probs(c, np.full(c.shape, y), real) for y in range(outputs)])
        assert np.allclose(np.exp(every).sum(axis=0), 1)
        x = (model.embed[c] + model.place)[0]
        a = np.where(np.tri(lm_score.CONTEXT, dtype=bool), x @ model.wq @ x.T * lm_score.WIDTH**-0.5, -np.inf)
        a = np.exp(a - a.max(axis=1, keepdims=True))
        h = np.c_[x + a / a.sum(axis=1, keepdims=True) @ x @ model.wv, np.ones(len(x))]
        soft = lambda z: z - z.max(axis=1, keepdims=True) - np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True))
        groups = soft(h @ model.top.T)
        for y in range(outputs):
            g, slot = divmod(y, model.slots)
            have = min(model.slots, outputs - g * model.slots)
            assert np.allclose(every[y], groups[:, g] + soft(h @ model.out[g, :have].T)[:, slot])
        late = real & (np.arange(lm_score.CONTEXT) >= lm_score.OVERLAP)
        y = r.integers(0, outputs, c.shape)
        assert np.allclose(model.log_probs(c, y, late), model.log_probs(c, y, real)[lm_score.OVERLAP :])


def test_model_gradients():
    r = np.random.default_rng(1)
    model = lm_score.CausalModel(10, 6)
    for name in model.names:
        setattr(model, name, getattr(model, name).astype(np.float64))
    c, y = r.integers(0, 10, (3, lm_score.CONTEXT)), r.integers(0, 6, (3, lm_score.CONTEXT))
    real = r.random((3, lm_score.CONTEXT)) < 0.8
    loss = lambda: -model.log_probs(c, y, real).sum() / real.sum()
    for p, g in zip(model.params(), model.gradients(c, y, real)):
        i = tuple(r.integers(0, s) for s in p.shape)
        old = p[i]
        p[i] = old + 1e-4
        up = loss()
        p[i] = old - 1e-4
        down = loss()
        p[i] = old
        assert abs((up - down) / 2e-4 - g[i]) < 1e-3
