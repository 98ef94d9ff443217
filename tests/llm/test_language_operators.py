"""Importance resampling, the n-gram model and the divergence audit against brute force over small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from claraudit.llm import importance, kneser_ney_lm, source_audit
from claraudit.llm import queries as llm
from claraudit.llm.words import Texts
from tests.conftest import DATA
from tests.llm.conftest import rows_of

ODD = ["Été ÉTÉ été", "a-b c2d 2 ..", "x\x00y", "中文 文 中文", "a" * 50_000, "İI ı", "the the THE"]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- importance resampling


def brute_resample(rows, target, shortest, longest, buckets, percent, min_words):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        return w, [" ".join(w[i : i + n]) for n in range(shortest, longest + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in xs for f in features(x)[1]) for xs in ([r[1] for r in rows], target))
    total_s, total_t = sum(s.values()), sum(t.values())
    out = []
    for doc, text in rows:
        w, fs = features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in map(bucket, fs)]
        weight = sum(gain) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(w), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[5] = k
    return out


@pytest.mark.parametrize("how", [(1, 1, 10_000, 30, 20), (1, 3, 64, 50, 2), (2, 2, 1, 100, 0)])
def test_resampling_equals_brute_force(spark, texts, how, monkeypatch):
    shortest, longest, buckets, percent, min_words = how
    if longest == 3:
        monkeypatch.setattr(importance, "TRIE_BYTES", 1)  # a new trie for each slice
    docs = rows_of(spark, [*texts, *ODD])
    target = ["w1 w2 W3 été", None, "", "the the 中文 w7 w8"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), shortest=shortest, longest=longest, buckets=buckets, percent=percent, min_words=min_words, keep=("source",))
    assert got.columns == ["doc_id", "source", "n_words", "n_features", "weight", "score", "rank"]
    got = sorted([r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]] for r in got.collect())
    assert got == sorted(brute_resample(rows, target, *how))


def test_resampling_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None), (1, "a b"), (1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    got = importance.resample(docs, none, percent=100, min_words=1).collect()
    assert sorted(r["rank"] for r in got if r.n_words) == [1, 2, 3, 4] and [r["rank"] for r in got if not r.n_words] == [None]
    assert importance.resample(docs.limit(0), none).count() == 0


def test_trie_states_go_on_from_the_parent():
    trie = importance.WordTrie(3, 1 << 20)
    t = Texts.of(__import__("pyarrow").array(["a bc d", "bc d", ""]))
    found = {(length, int(r), int(trie.levels[length - 1].crc[n])) for length, node, row, _ in trie.paths(t) for n, r in zip(node, row, strict=True)}
    crc = lambda x: zlib.crc32(x.encode())
    assert found == {(1, 0, crc("a")), (1, 0, crc("bc")), (1, 0, crc("d")), (2, 0, crc("a bc")), (2, 0, crc("bc d")), (3, 0, crc("a bc d")), (1, 1, crc("bc")), (1, 1, crc("d")), (2, 1, crc("bc d"))}
    assert len(trie.levels[1].crc) == 2  # "bc d" is one node


# --- the language model


class Brute:
    """Interpolated modified Kneser-Ney by definition."""

    def __init__(self, texts, order):
        self.order, docs = order, [self.tokens(t) for t in texts]
        self.counts = Counter(w for d in docs for w in d)
        adjusted = {order: Counter()}
        for d in docs:
            q = ["<s>", *d]
            adjusted[order].update(tuple(q[i - order + 1 : i + 1]) for i in range(max(1, order - 1), len(q)))
        for m in range(order - 1, 0, -1):
            adjusted[m] = Counter(g[1:] for g in adjusted[m + 1])
            if m > 1:
                adjusted[m].update(tuple(["<s>", *d][:m]) for d in docs if len(d) + 1 >= m)
        self.adjusted, self.sums = adjusted, defaultdict(lambda: [0, 0.0])
        cut = {m: kneser_ney_lm.discounts(*[sum(v == k for v in adjusted[m].values()) for k in (1, 2, 3, 4)]) for m in adjusted}
        self.cut = lambda m, a: [0, *cut[m]][min(a, 3)]
        for m, grams in adjusted.items():
            for g, a in grams.items():
                x = self.sums[m, g[:-1]]
                x[0] += a
                x[1] += self.cut(m, a)

    @staticmethod
    def tokens(text):
        return [*re.findall(r"[^\x20\x09-\x0D]+", lowered(text)), "</s>"]

    def p(self, h, w):
        low = self.p(h[1:], w) if h else 1 / (len(self.counts) + 1)
        total, free = self.sums.get((len(h) + 1, h), (0, 0))
        a = self.adjusted[len(h) + 1].get((*h, w), 0)
        return (a - self.cut(len(h) + 1, a) + free * low) / total if total else low

    def score(self, text):
        q = ["<s>", *self.tokens(text)]
        return sum(math.log10(self.p(tuple(q[max(0, i - self.order + 1) : i]), q[i])) for i in range(1, len(q)))

    def base(self, text):
        n, v = sum(self.counts.values()), len(self.counts)
        return sum(math.log10((self.counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in self.tokens(text))


@pytest.mark.parametrize(("order", "how"), [(2, {}), (2, {"shard_words": 30, "shard_tokens": 60}), (3, {"shard_words": 100, "shard_tokens": 200, "coarse": 4})])
def test_model_equals_the_definition(spark, texts, order, how, monkeypatch):
    if how:
        monkeypatch.setattr(kneser_ney_lm, "HELD_GRAMS", 500)
        monkeypatch.setattr(kneser_ney_lm, "WORD_BYTES", 2000)
    docs = rows_of(spark, [*texts, *ODD])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    brute = Brute([t for d, t in rows if zlib.crc32(str(d).encode()) % 10], order)
    model = kneser_ney_lm.train(docs.filter(~kneser_ney_lm.held_out()), order=order, **how)
    assert model.tokens == sum(brute.counts.values()) and model.size == len(brute.counts)
    got = {r.doc_id: r for r in kneser_ney_lm.score(docs, model).collect()}
    for doc, text in rows:
        r, tokens = got[doc], brute.tokens(text)
        assert (r.n_tokens, r.n_known) == (len(tokens), sum(w in brute.counts for w in tokens))
        assert r.score == pytest.approx(brute.score(text), abs=1e-7) and r.base_score == pytest.approx(brute.base(text), abs=1e-7)


def test_model_shares_add_up(spark, texts):
    """All words, the end and one unknown word have probability 1 together, behind any context."""
    model = kneser_ney_lm.train(rows_of(spark, texts), shard_words=50, shard_tokens=100)
    brute = Brute(texts, 2)
    words_ = [w for w in brute.counts if w != "</s>"] + ["never-seen"]
    for context in ("w1", "one", "never-seen", ""):
        pairs = spark.createDataFrame([(i, f"{context} {w}") for i, w in enumerate([*words_, ""])], "doc_id long, text string")
        both, alone = kneser_ney_lm.score(pairs, model).collect(), brute.p(("<s>",), context) if context else 1.0
        ended = {w: brute.p((w,), "</s>") for w in words_}
        total = sum(10**r.score / alone / (ended[words_[r.doc_id]] if r.doc_id < len(words_) else 1.0) for r in both)
        assert total == pytest.approx(1, abs=1e-6)


def test_model_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "a a"), (None, "a a")], "doc_id long, text string")
    none = kneser_ney_lm.train(docs.limit(0))
    assert [(r.n_known, r.score, r.base_score) for r in kneser_ney_lm.score(docs, none).collect()] == [(0, 0.0, 0.0)] * 4
    model = kneser_ney_lm.train(docs)
    got = kneser_ney_lm.perplexity(kneser_ney_lm.score(docs, model)).collect()
    assert [r.n_known for r in got] == [1, 1, 3, 3] and all(1 <= r.perplexity < 10 for r in got)
    assert kneser_ney_lm.score(docs.limit(0), model).count() == 0
    with pytest.raises(ValueError, match="mounted"):
        kneser_ney_lm.local_root("hdfs://a/b")


def test_words_of_one_hash_are_told_apart(tmp_path):
    import pyarrow as pa

    words_ = pa.array(["longer-word-one", "longer-word-two", "third-long-word"])
    table = pa.table({"shard": [0] * 3, "word": words_, "h": np.array([5, 5, 5], np.int64), "n": [7, 8, 9]})
    kneser_ney_lm._write_words(str(tmp_path))(table)
    vocab = kneser_ney_lm.Vocabulary(str(tmp_path), 1, np.array([0, 3, 3]), 1)
    t = Texts.of(pa.array(["third-long-word", "longer-word-one", "fourth-longword", "longer-word-two"]))
    ids, counts = vocab.find(t.data, t.bounds[:-1], t.bounds[1:], np.full(4, 5, np.uint64))
    assert counts.tolist() == [9, 7, 0, 8] and sorted(ids.tolist()) == [-1, 2, 3, 4]


def test_scores_beat_the_base_on_held_out_documents(spark):
    got = llm.queries()["op12_kneser_ney_lm"](spark, DATA).filter("held_out").selectExpr("sum(score) s", "sum(base_score) b", "count(*) n").first()
    assert got.n > 0 and got.s > got.b


# --- the divergence audit


def brute_divergence(rows, min_docs, top):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")) for lang, source, text in rows]
    rows = [(lang, source, [lowered(w) for w in ws]) for lang, source, ws in rows]
    share = lambda c, n, v: 1 + 1_000_000_000 * (c + 2) // (n + 2 * v)
    f = lambda p, q: (p - q) * (p - q) // (p + q)
    out = []
    for lang in {r[0] for r in rows}:
        docs = [r for r in rows if r[0] == lang]
        in_docs = Counter(t for d in docs for t in set(d[2]))
        terms = [t for t in in_docs if in_docs[t] >= min_docs]
        by = {s: Counter() for s in {d[1] for d in docs}}
        for d in docs:
            by[d[1]].update(t for t in d[2] if in_docs[t] >= min_docs)
        whole = sum(by.values(), Counter())
        p = {s: {t: share(c[t], sum(c.values()), len(terms)) for t in terms} for s, c in by.items()}
        q = {t: share(whole[t], sum(whole.values()), len(terms)) for t in terms}
        for s in by:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in terms), o.encode()) for o in by if o != s)
            own = sorted((-f(p[s][t], q[t]), t.encode()) for t in terms if by[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -value, k) for part, found in (("pair", pairs), ("term", own)) for k, (value, item) in enumerate(found, 1)]
    return out


@pytest.mark.parametrize("held", [None, 5])
def test_divergence_equals_brute_force(spark, texts, held, monkeypatch):
    if held:
        monkeypatch.setattr(source_audit, "HELD_ROWS", held)
    data = [*texts, *ODD] * 2
    lang = [["en", "de", None, "no"][i % 7 % 4] for i in range(len(data))]
    source = [["a", "b", None, "", "c", "文"][i % 11 % 6] for i in range(len(data))]
    docs = rows_of(spark, data, lang=lang, source=source).unionByName(rows_of(spark, [None, "..."], lang=["xx", "xx"], source=["only", "two"]))
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    for min_docs, top in ((2, 3), (10, 10)):
        got = source_audit.source_divergence(docs, min_docs=min_docs, top=top)
        assert sorted(tuple(r) for r in got.collect()) == sorted(brute_divergence(rows, min_docs, top))
    assert source_audit.source_divergence(docs.limit(0)).count() == 0


def test_shares_stay_exact_beyond_64_bits(spark):
    n, total, v = 2 * 10**12 + 7, 10**13 + 3, 10**7
    got = spark.range(1).select(source_audit.share(__import__("pyspark").sql.functions.lit(n), __import__("pyspark").sql.functions.lit(total), __import__("pyspark").sql.functions.lit(v)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * v)


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op13_source_divergence"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = c.sql(llm.oracle_sql()[name])
    got = llm.queries()[name](spark, DATA).select(*want.columns)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want.fetchall()))
