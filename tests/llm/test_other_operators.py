"""Mixing, language identification, vectors, and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from claraudit.llm import flat_graph, hamming_search, language_id, mixing
from tests.conftest import DATA
from tests.llm.conftest import CLASHING, rows_of


def mixed(spark, sources, weights=None, **how):
    docs = rows_of(spark, ["t"] * len(sources), source=sources)
    w = spark.createDataFrame(weights, "source string, weight double") if weights else None
    return docs, sorted(mixing.mix(docs, w, **how).select("mix_position", "mix_slot", "source", "doc_id", *CLASHING).collect())


def test_mixing_keeps_shares(spark):
    sources = ["a"] * 60 + ["b"] * 30 + [None] * 30 + ["c"] * 7
    _, rows = mixed(spark, sources, [("a", 0.5), ("b", 0.25), (None, 0.125), ("c", 0.125)], block_docs=2, period=8)
    assert [r[0] for r in rows] == list(range(len(sources))) and sorted(r[3] for r in rows) == list(range(len(sources)))
    slots = {}
    for r in rows:
        assert slots.setdefault(r[1], r[2]) == r[2]
    order = [slots[i] for i in range(len(slots))]
    share = {"a": 4 / 8, "b": 2 / 8, None: 1 / 8, "c": 1 / 8}
    for t in range(1, 33):  # c has 4 blocks: until it ends, every share holds within a block
        for s, w in share.items():
            assert abs(order[:t].count(s) - t * w) < 1


def test_mixing_edges(spark):
    docs, rows = mixed(spark, ["a"] * 3)
    assert [r[0] for r in rows] == [0, 1, 2]
    assert mixing.mix(docs.limit(0)).count() == 0
    twice = mixing.mix(docs.unionByName(docs)).collect()
    assert sorted(r.mix_position for r in twice) == list(range(6))
    with pytest.raises(ValueError, match="sources"):
        old, mixing.MAX_SOURCES = mixing.MAX_SOURCES, 1
        try:
            mixing.mix(rows_of(spark, ["t", "t"], source=["a", "b"]))
        finally:
            mixing.MAX_SOURCES = old


def mix_order(spark, sizes, weights, **how):
    data = [(s, i) for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(data)], "doc_id long, source string")
    w = spark.createDataFrame(weights, "source string, weight double") if weights else None
    rows = mixing.mix(docs, w, block_docs=1, **how).orderBy("mix_position").collect()
    assert [r.mix_position for r in rows] == list(range(len(data))) and sorted(r.doc_id for r in rows) == list(range(len(data)))
    return [r.source for r in rows]


def test_mixing_exact_weights(spark):
    # both end with slot 2000; weights that no period of 200 holds
    order = mix_order(spark, {"a": 195, "b": 1805, "none": 5}, [("a", 0.0975), ("b", 0.9025), ("none", 0.0)], period=300)
    had = 0
    for t, s in enumerate(order[:2000], 1):
        had += s == "a"
        assert abs(had - t * 0.0975) < 1
    assert order[2000:] == ["none"] * 5


def test_mixing_many_sources(spark):
    sizes = {f"s{i:03}": 4 for i in range(520)} | {"hot": 1040}
    order = mix_order(spark, sizes, None)
    share = 1040**0.5 / (1040**0.5 + 520 * 2)
    ends = int(4 / (2 / (1040**0.5 + 520 * 2)))  # until the others end, all at once
    had = 0
    for t, s in enumerate(order[:ends], 1):
        had += s == "hot"
        assert abs(had - t * share) < 1
    last = {}
    for t, s in enumerate(order[:ends], 1):
        last[s] = last.get(s, 0) + 1
        assert s == "hot" or t > (last[s] - 1) * ends / 4


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = language_id.identify(docs, keep=("lang",)).collect()
    held = [r for r in out if r.held_out and r.lang is not None]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) > 0
    assert sum(r.rejected for r in out) <= 0.02 * len(out) and all(0 <= r.score <= 1 for r in out)


def test_kneser_ney_by_hand(spark):
    """Interpolated Kneser-Ney of order 3 over a tiny corpus, by its textbook formulas."""
    import math
    from collections import Counter, defaultdict

    words = ["abab", "abc", "ab", "bca", "cab", "bb"]
    docs = spark.createDataFrame([(" ".join(words), "x")], "text string, lang string").select("lang", "text")
    grams = docs.mapInArrow(language_id._count(3), language_id.COUNTS)
    from pyspark.sql import functions as F

    summed = grams.groupBy("lang", "n", "gram").agg(F.first("context").alias("context"), F.first("shorter").alias("shorter"), F.max("at_start").alias("at_start"), F.sum("times").alias("times")).toPandas()
    model = language_id.build_model(summed, 3)
    full = [f"^{w}$".replace("$", "^") for w in words]
    counts = {n: Counter() for n in (1, 2, 3)}
    for w in full:
        for i in range(1, len(w)):
            for n in (1, 2, 3):
                if i - n + 1 >= 0:
                    counts[n][(w[i - n + 1 : i + 1], i - n + 1 == 0 and n > 1)] += 1
    start = lambda n: {g for (g, s) in counts[n] if s}
    c = {3: Counter()}
    for (g, _), k in counts[3].items():
        c[3][g] += k
    for n in (1, 2):
        c[n] = Counter()
        seen = defaultdict(set)
        for g, _ in counts[n + 1]:
            seen[g[1:]].add(g[0])
        for (g, _), k in counts[n].items():
            c[n][g] = sum(v for (x, _), v in counts[n].items() if x == g) if g in start(n) else max(1, len(seen[g]))
    floor = max(20.0, -math.log2(0.001 / 5000))

    def discount(n):
        one, two = (sum(v == k for v in c[n].values()) for k in (1, 2))
        return one / (one + 2 * two) if one and two else 0.5

    def p(g):
        n = len(g)
        if n == 1:
            return c[1][g] / sum(c[1].values()) * 0.999 if g in c[1] else 2**-floor
        same = [v for x, v in c[n].items() if x[:-1] == g[:-1]]
        below = p(g[1:])
        if not same:
            return below
        down = discount(n) * len(same) / sum(same)
        return ((c[n][g] - discount(n)) / sum(same) if g in c[n] else 0) + down * below

    for w in ("abab", "bc", "cc", "acb", "bbb"):
        x = f"^{w}^"
        want = -sum(math.log2(p(x[max(0, i - 2) : i + 1])) for i in range(1, len(x)))
        assert model.word_bits([w])[0][0, 0] == pytest.approx(want, rel=1e-4), w


def test_small_languages_are_learned(spark):
    rows = [(i, f"{w} " * 30, lang) for i, (lang, w) in enumerate([("one", "zxzx qyqy"), ("two", "mnop lolo"), ("two", "mnmn lop")] * 2)]
    docs = spark.createDataFrame([r for r in rows], "doc_id long, text string, lang string")
    out = {r.doc_id: (r.lang_pred, r.rejected) for r in language_id.identify(docs).collect()}
    known = {r.lang for r in docs.filter(~language_id.held_out()).select("lang").distinct().collect()}
    assert all(out[i] == (lang, False) for i, _, lang in rows if lang in known)


def test_language_edges(spark):
    texts = [None, "\U0001f600 \u3002", "123 !!!", "the house is on the hill and the river"] * 30 + ["das haus steht auf dem berg und der fluss"] * 30
    docs = rows_of(spark, texts, lang=["en"] * 120 + ["de"] * 30)
    out = language_id.identify(docs).collect()
    for r in out:
        assert (r.lang_pred == "und") == (r.doc_id < 120 and r.doc_id % 4 < 3)
        if r.lang_pred == "und":
            assert r.score == 0 and r.rejected
    assert {r.lang_pred for r in out if r.doc_id >= 120} == {"de"}
    assert language_id.identify(docs.limit(0)).count() == 0
    none = language_id.identify(rows_of(spark, ["abc"], lang=[None])).collect()
    assert none[0].lang_pred == "und" and none[0].rejected


def vectors_of(spark, rows):
    data = [(i, v, 0, *["x"] * len(CLASHING)) for i, v in rows]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, " + ", ".join(f"{c} string" for c in CLASHING))


def test_flat_graph(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 16))
    x = [*(centers[i % 12] + rng.normal(size=16) * 0.12 for i in range(240)), *rng.normal(size=(200, 16))]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(500 + i, rows[3][1]) for i in range(40)] + [(600, None), (601, []), (602, [0.0] * 16), (603, [float("nan")] * 16), (604, [1.0, 2.0]), (605, [None] * 16)]
    out = {r.vec_id: r for r in flat_graph.near_duplicates(vectors_of(spark, rows), shard_points=64).collect()}
    good = {i: np.array(v, np.float32).astype(np.float64) for i, v in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    ids = sorted(good)
    m = np.stack([good[i] for i in ids])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    hit = m @ m.T >= 0.9
    truth = dict(zip(ids, hit.sum(1) - 1, strict=True))
    assert set(out) == {i for i, _ in rows}
    assert all(out[i].n_links <= truth.get(i, 0) for i in out)
    assert sum(out[i].n_links for i in out) >= 0.97 * sum(truth.values())
    for i in (600, 601, 602, 603, 604, 605):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True)
    assert {out[500 + i].component_id for i in range(40)} == {out[3].component_id}
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.values())
    assert flat_graph.near_duplicates(vectors_of(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("how", [{}, {"centroids": 3, "shard_points": 60}])
def test_flat_graph_recall_and_magnitudes(spark, how):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(60, 16))
    x = [centers[i % 60] + rng.normal(size=16) * 0.15 for i in range(900)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, [1e200, 0.0]), (5001, [1e200, 0.0]), (5002, [1e-160, 0.0]), (5003, [2e-160, 0.0]), (None, [1.0, 0.0])]
    out = flat_graph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), **how).collect()
    u = np.stack(x) / np.linalg.norm(np.stack(x), axis=1, keepdims=True)
    truth = (u @ u.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r for r in out}
    assert len(out) == len(rows) and all(got[i].n_links <= truth[i] for i in range(900))
    assert sum(got[i].n_links for i in range(900)) >= 0.9 * truth.sum() and out[0].audit_links > 0
    assert [(got[i].n_links, got[i].component_id) for i in (5000, 5001, 5002, 5003)] == [(3, 5000)] * 4
    assert got[None].n_links == 0


def test_flat_graph_audits_nothing_without_links(spark):
    out = flat_graph.near_duplicates(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert {(r.vec_id, r.n_links, r.recall) for r in out} == {(0, 0, None), (1, 0, None)}


def test_range_search_finds_all_in_a_ball():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=32) + rng.normal(size=(150, 32)) * 0.05, rng.normal(size=(100, 32))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = flat_graph.range_search(x, flat_graph.robust_prune(x), 0.9)
    found = {(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if x[i] @ x[j] >= 0.9}
    truth = {(i, j) for i in range(250) for j in range(i + 1, 250) if x[i] @ x[j] >= 0.9}
    assert found <= truth and len(found) >= 0.99 * len(truth)


def code_of(v):
    return sum(1 << i for i, x in enumerate(v) if x > 0)


@pytest.mark.parametrize(("n", "blocks"), [(60, None), (700, None), (700, (7, 40))])
def test_hamming_top_k(spark, n, blocks, monkeypatch):
    if blocks:  # every query scans, in many blocks
        monkeypatch.setattr(hamming_search, "QUERY_BLOCK", blocks[0])
        monkeypatch.setattr(hamming_search, "CODE_BLOCK", blocks[1])
        monkeypatch.setattr(hamming_search, "_affordable", lambda radius: F.lit(False))
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(size=64).astype(np.float32).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[20][1]) for i in range(45)] + [(2000, None), (2020, [float("nan")] * 64), (2040, [])]
    out = {}
    for r in hamming_search.hamming_top_k(vectors_of(spark, rows), k=5).collect():
        out.setdefault(r.query_id, {})[r["rank"]] = (r.distance, r.id)
    codes = {i: code_of(v) for i, v in rows if v and not np.isnan(v).any()}
    for q in codes:
        if q % 20 == 0:
            truth = sorted((bin(codes[q] ^ c).count("1"), i) for i, c in codes.items() if i != q)[:5]
            assert [out[q][k] for k in range(1, 6)] == truth
    assert set(out) == {q for q in codes if q % 20 == 0}
    assert hamming_search.hamming_top_k(vectors_of(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("lengths,segments", [([100], None), ([60, 64, 200], None), ([1100, 70], 30)])
def test_hamming_uses_all_components(spark, lengths, segments):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        v = rng.normal(size=lengths[i % len(lengths)])
        if i % 4 == 1:  # a near copy of an earlier vector of this length
            at = i - len(lengths) * rng.integers(1, 1 + i // len(lengths)) if i >= len(lengths) else i
            v = np.array(rows[at][1]) * np.where(rng.random(len(v)) < 0.05, -1, 1) if at < i else v
        rows.append((i, v.astype(np.float32).tolist()))
    out = {}
    for r in hamming_search.hamming_top_k(vectors_of(spark, rows), k=5, segments=segments).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.distance, r.id))
    for q in range(0, 240, 20):
        near = sorted((sum((x > 0) != (y > 0) for x, y in zip(rows[q][1], v, strict=True)), i) for i, v in rows if i != q and len(v) == len(rows[q][1]))
        assert sorted(out[q]) == [(k, *x) for k, x in enumerate(near[:5], 1)]


def test_pipeline(spark, texts):
    import corpus_pipeline as c
    from claraudit.llm.common import file_order, staged

    docs = rows_of(spark, [*texts, *["the river and the house are in the valley of the hill"] * 3], source=None).drop(*CLASHING)
    kept = [docs]
    for name, stage in c.STAGES:
        kept.append(staged(stage(spark, kept[-1], ""), name))
        if name != "best_fit_packing":
            assert kept[-1].columns == list(c.COLUMNS)
    first = {r.doc_id for r in kept[1].collect()}
    second = {r.doc_id for r in kept[2].collect()}
    third = {r.doc_id: r.text for r in kept[3].collect()}
    fourth = {r.doc_id: r.text for r in kept[4].collect()}
    assert second < first and set(third) <= second and third == fourth
    assert {r.doc_id for r in kept[5].collect()} == set(fourth)
    # packing sees the documents in the order of the mix
    mix = [r.doc_id for r in mixing.mix(kept[3]).orderBy("mix_position").collect()]
    assert [r.doc_id for r in file_order(kept[4]).orderBy("_order").collect()] == mix
    assert {r.doc_id: r.row for r in kept[5].filter("piece = 0").collect()} == {x: i for i, x in enumerate(mix)}
    empty = docs.limit(0)
    for _, stage in c.STAGES:
        empty = stage(spark, empty, "")
        assert empty.count() == 0


@pytest.mark.parametrize("name", ["op4_fingerprint_index", "op8_minhash_join", "op10_hamming_top_k"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from claraudit.llm import queries

    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.queries()[name](spark, DATA)
    cols = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(want)


@pytest.mark.parametrize("name", ["op1_token_counts", "op2_min_cost_flow", "op3_best_fit", "op5_pfair_mix", "op6_kneser_ney", "op7_flat_graph", "op9_bit_planes"])
def test_queries_keep_all_rows(spark, name):
    from claraudit.llm import queries

    rows = queries.queries()[name](spark, DATA)
    key, table = ("vec_id", "embeddings") if name == "op7_flat_graph" else ("doc_id", "documents")
    if name == "op3_best_fit":
        rows = rows.filter("piece = 0")
    want = spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect()
    assert sorted(r[0] for r in rows.select(key).collect()) == sorted(r[0] for r in want)
