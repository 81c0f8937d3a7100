import hashlib
import random
import re
from collections import Counter, defaultdict

import helpers
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sieveframe.llm import embeddings, graph, linededup, mixing, ngram_join, sentencepiece, toxicity

docs, corpus, words = helpers.docs, helpers.corpus, helpers.words


def forest(ids, links):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_connected_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2050)] + [(5, 5)]
    got = {x.node: x.component for x in graph.connected_components(spark.createDataFrame(edges + [(None, 1)], "u bigint, v bigint")).collect()}
    assert got == forest({i for e in edges for i in e}, edges)
    assert graph.connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# 3: n-gram join ------------------------------------------------------------------------------------------------------
def links_by_force(rows):
    """(doc_id, n_links, component_id, kept) of each row, rows being the nodes."""
    sets = [set(ngram_join.shingles(t).tolist()) if i is not None else set() for i, t, *_ in rows]
    n, links = Counter(), []
    for x in range(len(sets)):
        for y in range(x):
            if sets[x] and sets[y] and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                n[x] += 1
                n[y] += 1
                links.append((x, y))
    comp = forest(range(len(sets)), links)
    head, first = {}, {}
    for x, (i, t, *_) in enumerate(rows):
        if sets[x]:
            head[comp[x]] = min(head.get(comp[x], i), i)
    for x, (i, t, *_) in enumerate(rows):
        if sets[x] and head[comp[x]] == i:
            first.setdefault(comp[x], set()).add(t)
    return Counter((i, n[x], head[comp[x]] if sets[x] else i) for x, (i, *_) in enumerate(rows)), [(head[c], t) for c, t in first.items()], links


def test_ngram_join_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 400)  # several blocks to a cluster
    monkeypatch.setattr(ngram_join, "MEMBERS", 7)
    monkeypatch.setattr(ngram_join, "BUCKET", 5)
    monkeypatch.setattr(ngram_join, "HOT_SHARE", 20)  # many hot keys
    rows = corpus(25)
    base = words(500, 120)
    for k in range(30):  # a group of near copies, all different
        w = list(base)
        w[10 + k] = f"x{k}"
        rows.append((1000 + k, " ".join(w), "en", "s", 1))
    rows += [(2000, " ".join(base), "en", "s", 1)] * 70  # many copies
    x, y, z = (" ".join(words(600 + k, 90)) for k in range(3))
    near = lambda t: t.replace(t.split()[45], "other", 1)
    # one id, several texts: near copies of different documents, and one that is no copy at all
    rows += [(3001, x, "en", "s", 1), (3001, y, "en", "s", 1), (3002, near(x), "en", "s", 1), (3003, near(y), "en", "s", 1), (3005, z, "en", "s", 1), (3005, x.upper(), "en", "s", 1), (3006, x, "en", "s", 1), (3006, x.upper(), "en", "s", 1)]
    want, first, links = links_by_force(rows)
    got = ngram_join.near_duplicates(docs(spark, rows)).collect()
    assert Counter((g.doc_id, g.n_links, g.component_id) for g in got) == want
    assert len(links) > 800
    by = {(g.doc_id, g.text_hash): g.kept for g in got}
    hashes = {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t, *_ in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    for head, texts_of in first:  # one row, or equal rows, of each component
        assert sum(by[(head, hashes[t])] for t in texts_of) == 1
    assert sum(by.values()) == len(first) + len({(i, t or "") for i, t, *_ in rows if i is None or not (t or "").split()})
    assert by[(3005, hashes[z])] and not by[(3005, hashes[x.upper()])] and by[(3001, hashes[x])] and by[(3001, hashes[y])] and not by[(3006, hashes[x])]
    assert ngram_join.near_duplicates(docs(spark, [])).count() == 0


def test_ngram_join_units_stay_small(spark, monkeypatch):
    """A cluster of very many short texts is dealt over many units."""
    base = words(501, 40)
    rows = [(k, " ".join([*base[: k % 35], f"x{k}", *base[k % 35 :]]), "en", "s", 1) for k in range(1200)]
    monkeypatch.setattr(ngram_join, "MEMBERS", 100)
    sizes = []
    real = ngram_join.cluster_links
    monkeypatch.setattr(ngram_join, "cluster_links", lambda loaded, *a: (sizes.append(loaded.groupBy("cluster", "block").count().agg(F.max("count"), F.count("*")).first()), real(loaded, *a))[1])
    got = ngram_join.near_duplicates(docs(spark, rows))
    want, _, _ = links_by_force(rows)
    assert Counter((g.doc_id, g.n_links, g.component_id) for g in got.collect()) == want
    assert sizes[0][0] < 200 and sizes[0][1] >= 10


def test_pruning_keeps_what_can_reach_the_threshold():
    need = ngram_join.least_matches(96, 0.8, 1e-6)
    assert list(need) == sorted(need) and need[0] >= 1 and need[-1] < 0.8 * 96
    assert ngram_join.minhash(np.arange(5000, dtype=np.uint64)).shape == (96,)
    assert len(ngram_join.shingles("a b c")) == 1 and len(ngram_join.shingles(" \n")) == 0


# 4: embeddings -------------------------------------------------------------------------------------------------------
def test_embeddings_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 50)
    monkeypatch.setattr(embeddings, "SMALL", 10)
    r = np.random.default_rng(3)
    x = r.standard_normal((700, 24))
    x[100:160] = x[7] + 0.12 * r.standard_normal((60, 24))  # a large group around the threshold
    x[200:230] = x[8] * np.arange(1, 31)[:, None]  # copies but for their length
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] + [1.0] * 23), (904, [None] + [1.0] * 23), (905, [float("inf")] * 24), (906, [1.0] * 12), (907, [2.0] * 12), (908, x[3].tolist()), (None, x[3].tolist()), (908, x[3].tolist())]
    good = [(k, i, np.array(v, float)) for k, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    n, links = Counter(), []
    for a, (k, i, v) in enumerate(good):
        for m, j, w in good[:a]:
            if len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.95:
                n[k] += 1
                n[m] += 1
                links.append((i, j))
    comp = forest({i for i, _ in rows if i is not None}, links)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, label int, dim string").repartition(3)
    got = embeddings.near_duplicates(df, cell=40).collect()
    assert len(got) == len(rows)
    have = {g.vec_id: g for g in got}
    found = sum(have[i].n_links for i in have if i is not None and i != 908)
    want = sum(n[k] for k, (i, _) in enumerate(rows) if i is not None and i != 908)
    assert 0.9 * want <= found <= want and want > 2000  # recall; none below the threshold
    assert all(have[i].n_links <= n[k] for k, (i, _) in enumerate(rows) if i is not None)
    assert all(have[i].component_id == comp[i] for i in range(200, 230)) and have[907].component_id == 906
    assert all(have[i].n_links == 0 and have[i].kept for i in (900, 901, 902, 903, 904, 905, None))
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_embedding_links_count_at_both_ends(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SMALL", 10)
    r = np.random.default_rng(4)
    x = r.standard_normal((400, 24))
    turn = r.standard_normal((400, 24))
    unit = lambda v: v / np.sqrt((v * v).sum(1))[:, None]
    x = unit(x)
    y = 0.955 * x + np.sqrt(1 - 0.955**2) * unit(turn - (turn * x).sum(1)[:, None] * x)
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([x, y]))]
    got = {g.vec_id: g for g in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), recall=0.5, cell=10).collect()}
    ends = [(got[k].n_links, got[k + 400].n_links, got[k + 400].component_id) for k in range(400)]
    assert all(a == b and c == (k if a else k + 400) for k, (a, b, c) in enumerate(ends))
    assert 250 < sum(a for a, *_ in ends) < 400


def test_embeddings_of_very_many_lengths(spark):
    rows = [(k, [1.0] * (1 + k // 3)) for k in range(300)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert all(g.n_links == 2 and g.component_id == g.vec_id // 3 * 3 for g in got)


def test_multi_sequence_is_in_order():
    a, b = [0.0, 0.1, 0.5, 0.9], [0.0, 0.2, 0.3]
    got = [a[i] + b[j] for i, j in embeddings.multi_sequence(a, b, 0.6)]
    assert got == sorted(got) and len(got) == sum(p + q <= 0.6 for p in a for q in b)


# 7: lines ------------------------------------------------------------------------------------------------------------
def lines_by_force(rows):
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\f\r"))
    owners = defaultdict(set)
    for i, t, *_ in rows:
        if i is not None:
            for s in (t or "").split("\n"):
                owners[key(s)].add(i)
    out = Counter()
    for i, t, *_ in rows:
        parts = (t or "").split("\n")
        kept = [s for s in parts if i is None or len(key(s)) < 10 or len(owners[key(s)]) < 2 or min(owners[key(s)]) == i]
        out[(i, len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("share", [2000, 20])
def test_line_dedup_matches_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(linededup, "HOT_SHARE", share)
    hot = "This line is in very many documents"
    rows = corpus() + [(2000 + k, f"{hot}\nown line number {k}\n{hot.upper()} ", "en", "s", 1) for k in range(150)] + [(3000, "\n".join([hot, "x"] * 400), None, None, 0), (3001, "\n".join(["x"] * 1000 + [hot] + ["y"] * 1000 + [hot, "end"]), None, None, 0)]
    got = linededup.dedup_lines(docs(spark, rows)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("h")).collect()
    assert Counter(map(tuple, got)) == lines_by_force(rows)
    assert linededup.dedup_lines(docs(spark, [])).count() == 0
    far = [r for r in linededup.keep_bitmaps(docs(spark, rows).select("doc_id", "text")).collect() if r.doc_id == 3001]
    assert [(w.word, bin(w.bits).count("1")) for w in far[0].keeps] == [(1000 // 63, 62), (2001 // 63, 62)]  # words that keep all are left out


# 10: mixing ----------------------------------------------------------------------------------------------------------
def targets_by_force(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        level = rest / max(1e-9, sum(w[s] for s in order if s not in full))
        over = {s for s in order if s not in full and level * w[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else level * w[s] for s in order}
        full |= over


def test_mixing_takes_equal_rows_each(spark):
    """Equal rows, null ids and one id with several texts: each row has its share, in the plan and in the mixture."""
    rows = [(1, "a b c d e f g h", "en", "s", 1)] * 9000 + [(None, f"w{k} x y", None, "t", 1) for k in range(400)] + [(7, f"v{k} x y z", None, None, 1) for k in range(300)] + [(None, None, None, "t", 0)] * 50
    df = docs(spark, rows)
    got = mixing.plan(df, shard_words=500).collect()
    assert len(got) == len(rows) and all(0 <= g.taken <= 2 * g.size for g in got)
    taken, want = Counter(), {g.source: g.target for g in got}
    for g in got:
        taken[g.source] += g.taken
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 5 for s in want)
    out = Counter()
    for r in mixing.mix(df, shard_words=500).collect():
        out[(r.doc_id, r.source)] += len(r.text.split())
    per = Counter()
    for g in got:
        per[(g.doc_id, g.source)] += g.taken
    assert out == +per


def test_mixing_very_many_sources(spark):
    rows = [(k, "a b c " * (k % 7), None, f"host{k % 900}", 0) for k in range(3000)]
    got = mixing.plan(docs(spark, rows)).collect()
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(t.split())
    want = targets_by_force(sizes)
    taken = Counter()
    for g in got:
        assert abs(g.target - want[g.source]) < 1e-6
        taken[g.source] += g.taken
    assert all(abs(taken[s] - want[s]) <= 2 for s in sizes)


def test_mixing(spark, monkeypatch):
    rows = corpus() + [(5000 + k, " ".join(words(k, 300)), "en", "huge", 1) for k in range(60)] + [(6000, None, "en", "empty", 0)]
    df = docs(spark, rows)
    got = mixing.plan(df, shard_words=2000).collect()
    assert len(got) == len(rows)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += count(t)
    want = targets_by_force(sizes)
    taken = Counter()
    for g in got:
        assert g.source_size == sizes[g.source] and abs(g.target - want[g.source]) < 1e-6 and 0 <= g.taken <= 2 * g.size
        taken[g.source] += g.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.03 * t + 5
    again = mixing.plan(df.repartition(7), shard_words=2000).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))
    assert mixing.plan(docs(spark, [])).count() == 0
    assert {g.taken for g in mixing.plan(docs(spark, [(1, None, None, None, 0)])).collect()} == {0}


def test_apportionment_takes_the_highest_quotients(spark):
    r = random.Random(2)
    for seats in (0, 7, 100):
        votes = [r.randrange(1, 500) for _ in range(25)] + [9000]
        df = spark.createDataFrame([(0, k, v, seats) for k, v in enumerate(votes)], "g int, k int, v bigint, seats bigint")
        got = {x.k: x.quota for x in mixing.apportion(df, ["g"], ["k"], "v", "seats").collect()}
        want = Counter()
        for _ in range(seats):
            want[max(range(len(votes)), key=lambda k: (votes[k] / (2 * want[k] + 1), -k))] += 1
        assert got == {k: want[k] for k in range(len(votes))}


# the pipeline --------------------------------------------------------------------------------------------------------
def test_pipeline_stages_against_brute_force(spark, tmp_path):
    rows = [r for r in corpus(40) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values()) + [(700 + k, " ".join(words(k + 70, 50) + ["vileword"] * 2), "en", "s1", 1) for k in range(30)]
    base = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for c in ("drops", "row", "full", "pieces", "size", "of", "th", "predicted", "n_dropped", "owner"):  # names that the operators use themselves
        base = base.withColumn(c, F.lit("x"))
    base.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(i >= 700)) for i, *_ in rows]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf, now = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, now, sf)
    assert clean.columns == now.columns and {r.doc_id for r in clean.collect()} == {i for i, *_ in rows if i < 700}
    lined = stages["line_dedup"](spark, clean, sf)
    have = [tuple(r) for r in lined.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert lined.columns == now.columns and Counter(hashlib.sha256(r[1].encode()).hexdigest() for r in have) == Counter({h: n for h, n in Counter(k[3] for k in lines_by_force([r for r in rows if r[0] < 700]).elements()).items()})
    assert all(r[4] == len(r[1]) for r in have)
    single = stages["ngram_jaccard_join"](spark, lined, sf)
    gone = {r.doc_id for r in ngram_join.near_duplicates(lined).where("not kept").collect()}
    assert {r.doc_id for r in single.collect()} == {r[0] for r in have} - gone
    mixed = stages["mixing"](spark, single, sf)
    plan = {r.doc_id: r for r in mixing.plan(single).collect()}
    words_out = Counter()
    for r in mixed.collect():
        words_out[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert words_out == Counter({i: p.taken for i, p in plan.items() if p.taken})
    out = stages["sentencepiece"](spark, mixed, sf).collect()
    m = sentencepiece.machine(sentencepiece.default_model())
    assert Counter((r.doc_id, r.n_tokens) for r in out) == Counter((r.doc_id, len(m.encode(r.text)) // 4) for r in mixed.collect())
    assert corpus_pipeline.run(spark, sf).count() == len(out)


def test_pipeline_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, one id with several texts, no rows at all."""
    x, y = (" ".join(words(800 + k, 90)) for k in range(2))
    rows = [(5, y), (5, x), (2, x.replace(x.split()[40], "other", 1)), (None, x), (None, None), (7, None), (8, ""), (9, " \n"), (11, y.replace(y.split()[3], "q", 1)), (12, "word " * 400), (12, "word " * 400)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, __id string, text_hash bigint, gone_id bigint, row string, __th bigint, __predicted int"
    base = spark.createDataFrame([(i, t, None, "s", 0, "k", "z", 1, 2, "w", 3, 4) for i, t in rows], schema)
    base.write.parquet(str(tmp_path / "a/documents.parquet"))
    base.where("false").write.parquet(str(tmp_path / "b/documents.parquet"))
    for folder in "ab":
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / f"{folder}/labels.parquet"))
    out = corpus_pipeline.drop_near_copies(spark, base, str(tmp_path / "a"))
    assert out.columns == base.columns
    kept = Counter((r.doc_id, r.text) for r in out.collect())
    assert kept == Counter((i, t) for i, t in rows if (i, t) not in ((5, x), (11, rows[8][1])))  # a namesake that is no copy stays
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.dedup_lines, corpus_pipeline.mix_sources):
        assert stage(spark, base, str(tmp_path / "a")).columns == base.columns
    assert corpus_pipeline.drop_toxic(spark, base, str(tmp_path / "a")).count() == len(rows)
    assert corpus_pipeline.dedup_lines(spark, base, str(tmp_path / "a")).count() == len(rows)
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path / "a")).count() >= 4


def test_toxicity_filter_agrees_with_scores(spark):
    rows = [(k, " ".join(words(k, 40) + (["vileword"] if k % 4 == 0 else [])), "en", "s", 0) for k in range(160)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(160)], "doc_id bigint, quality int, toxic int")
    df = docs(spark, rows)
    model = toxicity.train(df.select("doc_id", "text"), labels)
    assert {r.doc_id for r in toxicity.apply(model, df).where("predicted = 0").collect()} == {r.doc_id for r in toxicity.without_toxic(model, df).collect()}


def test_mixing_small_sources(spark):
    rows = [(k, "w " * 100, "en", source, 200) for source, lo, n in (("a", 0, 900), ("b", 1000, 50), ("c", 2000, 8)) for k in range(lo, lo + n)]
    got = mixing.plan(docs(spark, rows)).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert len(got) == 3 and all(abs(g.taken - g.target) <= max(2, 0.002 * g.target) for g in got)
