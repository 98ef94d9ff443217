"""Operators on texts against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from claraudit.llm import fingerprint_index, minhash_join, packing, resharding, separator_scan, token_files
from claraudit.llm.tokens import Encoder, vocabulary
from claraudit.llm.words import Texts
from tests.llm.conftest import rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ids_of(file, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(file))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize(("file", "splits"), [("byte_bpe_50k.json", "spaced"), ("word_bpe_49k.json", "words")])
def test_encoder_is_exact(file, splits):
    odd = ["", " ", "a \n y", "  b", "x 　 \n\ny  z \n", "Ça va <|endoftext|> b\t\tc\x1f d", "İstanbul ΣΑΣ é ́x", "\n\n", "a" * 300, "日本語 テスト。  x", "it's we'll 123 4567 !!! ...?", "é, é, ×,÷;"]
    ids, bounds = Encoder(vocabulary(file), splits).encode(Texts.of(pa.array(odd)))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == ids_of(file, odd)


def test_separator_scan_stitches_blocks(spark, texts, tmp_path):
    docs = rows_of(spark, texts)
    path = f"file://{tmp_path}/flat"
    separator_scan.write_flat(docs, path, file_ids=500)
    want = {i: len(x) for i, x in enumerate(ids_of("word_bpe_49k.json", texts))}
    for block in (3, 64, 1 << 18):
        found = separator_scan.separator_scan(spark, f"{path}/kind=ids", block=block)
        from pyspark.sql import functions as F

        found = found.withColumn("file", F.regexp_extract("stream", "file=([^/]*)", 1)).join(separator_scan.document_names(spark, f"{path}/kind=names"), ["file", "ordinal"]).collect()
        assert {r.doc_id: r.n_tokens for r in found} == want and all(r.terminated for r in found)
        by_file = defaultdict(list)
        for r in found:
            by_file[r.file].append((r.ordinal, r.start, r.n_tokens))
        for rows in by_file.values():
            at = 0
            for k, (ordinal, start, n) in enumerate(sorted(rows)):
                assert (ordinal, start) == (k, at)
                at += n + 1


def test_separator_scan_of_bare_files(spark, tmp_path):
    (tmp_path / "f").mkdir()
    np.array([5, 6, 0, 0, 7, 8, 9, 0, 4], "<u2").tofile(tmp_path / "f" / "a.bin")
    (tmp_path / "f" / "empty.bin").write_bytes(b"")
    found = separator_scan.separator_scan(spark, f"file://{tmp_path}/f", block=2).orderBy("ordinal").collect()
    assert [(r.start, r.n_tokens, r.terminated) for r in found] == [(0, 2, True), (3, 0, True), (4, 3, True), (8, 1, False)]


def test_separator_scan_crosses_files(spark, tmp_path):
    (tmp_path / "f").mkdir()
    ids = np.random.default_rng(2).integers(0, 4, 300).astype("<u4")
    for k, (a, b) in enumerate([(0, 7), (7, 8), (8, 150), (150, 150), (150, 300)]):
        ids[a:b].tofile(tmp_path / "f" / f"part-{k}.bin")
    found = separator_scan.separator_scan(spark, f"file://{tmp_path}/f", block=16, dtype="<u4").orderBy("ordinal").collect()
    want, at = [], 0
    for end in np.flatnonzero(ids == 0).tolist():
        want.append((at, end - at, True))
        at = end + 1
    want += [(at, 300 - at, False)] if at < 300 else []
    assert [(r.start, r.n_tokens, r.terminated) for r in found] == want


def test_min_cost_flow_moves_fewest_bytes():
    flow = resharding.plan_transfers([10, 0, 5], [5, 5, 5])
    assert flow == [[5, 5, 0], [0, 0, 0], [0, 0, 5]]
    rng = np.random.default_rng(1)
    for _ in range(20):
        old = rng.integers(0, 50, 5).tolist()
        new = resharding.even_capacities(sum(old), 3)
        flow = resharding.plan_transfers(old, new)
        assert [sum(r) for r in flow] == old and all(sum(f[j] for f in flow) <= c for j, c in enumerate(new))
        assert sum(flow[i][i] for i in range(3)) == sum(min(old[i], new[i]) for i in range(3))


def test_heavy_groups_move_fewest_bytes():
    from itertools import product

    assert resharding.place_heavy([(1, 2, 9), (2, 0, 8)], [0, 0, 0], [10, 10]) == ({1: 1, 2: 0}, set())
    rng = np.random.default_rng(4)
    for _ in range(100):
        n = int(rng.integers(2, 4))
        groups = [(i, int(rng.integers(0, 4)), int(rng.integers(1, 9))) for i in range(int(rng.integers(1, 6)))]
        light = rng.integers(0, 9, 4).tolist()
        caps = resharding.even_capacities(sum(light) + sum(g[2] for g in groups), n)
        placed, split = resharding.place_heavy(groups, light, caps)
        tried = [resharding.moved_bytes(groups, w, light, caps) for w in product(range(n), repeat=len(groups))]
        best = min((x for x in tried if x is not None), default=None)
        assert split or resharding.moved_bytes(groups, [placed[g[0]] for g in groups], light, caps) == best


def test_resharding(spark, texts, tmp_path):
    from pathlib import Path

    texts = [*texts, *["the same text " * 20] * 20, *[f"filler {i} " * (i % 9 + 1) for i in range(400)]]
    docs = rows_of(spark, texts)
    out, plan = resharding.reshard(docs, path=f"file://{tmp_path}/r")
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    sizes, slots, shard_of, moved = Counter(), defaultdict(list), {}, 0
    for r in rows:
        t = texts[r.doc_id]
        n = len((t or "").encode()) + 1
        assert r.text == t
        sizes[r.shard] += n
        moved += n * (r.shard != r.old_shard)
        slots[r.shard].append(r.slot)
        assert shard_of.setdefault(t, r.shard) == r.shard
    assert set(sizes) <= set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    big = max(len((t or "").encode()) for t in texts)
    assert max(sizes.values()) <= max(plan["capacities"]) + big
    assert plan["bound"] <= plan["bytes_moved"] and abs(moved - plan["bytes_moved"]) <= 8 * big
    # files that nothing leaves are read where they were written
    assert plan["kept"] and plan["affected"]
    new = {int(p.name[6:]) for p in Path(tmp_path, "r", "new").glob("shard=*")}
    assert {r.shard for r in rows if r.shard != r.old_shard} <= new
    assert all(r.old_shard == r.shard for r in rows if r.shard not in new)
    assert resharding.reshard(docs.limit(0))[0].count() == 0


def test_lower_bound_and_best_fit():
    from itertools import product

    def best(sizes, cap):
        for n in range(1, len(sizes) + 1):
            for where in product(range(n), repeat=len(sizes)):
                if all(sum(s for s, w in zip(sizes, where, strict=True) if w == b) <= cap for b in range(n)):
                    return n
        return 0

    rng = np.random.default_rng(3)
    for _ in range(25):
        sizes = rng.integers(1, 21, 5)
        least = packing.lower_bound(sizes, 20)
        bins, offsets, made = packing.best_fit_decreasing(sizes, 20)
        assert least <= best(sizes.tolist(), 20) <= made
        for b in range(made):
            at = 0
            for o, s in sorted(zip(offsets[bins == b], sizes[bins == b], strict=True)):
                assert o == at
                at += s
            assert at <= 20


def test_packing(spark, texts):
    docs = rows_of(spark, texts)
    out = packing.pack(packing.token_pieces(docs, capacity=64), capacity=64, per_partition=40).collect()
    want = [[*x, 0] for x in ids_of("byte_bpe_50k.json", texts)]
    place, by_doc = defaultdict(list), defaultdict(list)
    for r in out:
        place[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for rows in place.values():
        at = 0
        for o, n in sorted(rows):
            assert o == at
            at += n
        assert at <= 64
    for i, ids in enumerate(want):
        pieces = sorted(by_doc[i])
        assert [p[0] for p in pieces] == list(range(len(pieces))) and sum(p[2] for p in pieces) == len(ids)
        assert all(p[2] == 64 for p in pieces[1:]) and (len(pieces) == 1) == (len(ids) <= 64)
        for _, s, n, crc in pieces:
            assert crc == zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())
    assert len(place) <= packing.lower_bound(np.array([r.length for r in out]), 64) + 1
    assert packing.pack_documents(docs.limit(0)).count() == 0


def removed(texts, size=13):
    words = [WORD.findall(t or "") for t in texts]
    first = {}
    for i, w in enumerate(words):
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), i)
    out = {}
    for i, w in enumerate(words):
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("how", [{"batches": 1}, {"batches": 3}, {"batches": 4, "key_bits": 16, "coarse_bits": 2, "bucket_bytes": 1 << 12}])
def test_substring_dedup(spark, texts, how):
    # short keys collide: the words decide then
    docs = rows_of(spark, texts)
    out = fingerprint_index.dedup_substrings(docs, **how, keep=("bucket", "_id", "home")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in out} == removed(texts)
    assert {r._id for r in out} == {"x"}


def test_substring_dedup_edges(spark, texts):
    docs = rows_of(spark, texts)
    assert fingerprint_index.dedup_substrings(docs.limit(0)).count() == 0
    twice = docs.unionByName(docs.filter("doc_id = 5"))  # the same row again is no earlier document
    again = {(r.doc_id, r.n_removed) for r in fingerprint_index.dedup_substrings(twice).filter("doc_id = 5").collect()}
    assert again == {(5, 0)}
    kept = fingerprint_index.dedup_substrings(docs, original=True).collect()
    assert all(r.text == (texts[r.doc_id]) for r in kept if r.n_removed == 0)


def test_index_goes_on_in_another_object(spark, texts, tmp_path):
    from pyspark.sql import functions as F

    docs = rows_of(spark, texts).select(F.col("doc_id").alias("_id"), F.col("doc_id").alias("d"), F.col("text").alias("_text"))
    path, got, levels = f"file://{tmp_path}/index", {}, []
    for lo, hi in ((0, 9), (9, 20), (20, 30), (30, 99)):
        index = fingerprint_index.FingerprintIndex(spark, path)
        out = index.add(docs.filter(f"_id >= {lo} and _id < {hi}"), text_bytes=1000)
        got |= {r.d: (r.n_words, r.n_removed, r._text) for r in out.collect()}
        levels.append(sorted(r["level"] for r in index.state["runs"]))
        index.close()
    assert got == removed(texts) and levels == [[0], [1], [0, 1], [2]]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("log_")]


def test_pack_ints():
    for x in (np.zeros(0, np.uint64), np.zeros(5, np.uint64), np.array([1, 2**63, 255, 256], np.uint64), np.arange(70000, dtype=np.uint64)):
        assert (fingerprint_index.unpack_ints(fingerprint_index.pack_ints(x)) == x).all()


def jaccard_truth(texts):
    sets = []
    for t in texts:
        w = WORD.findall(t or "")
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links = {i: {j for j in range(len(sets)) if i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9} for i in range(len(sets))}
    comp = {}
    for i in range(len(sets)):
        if i not in comp:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in comp:
                    comp[k] = i
                    todo += links[k]
    return links, comp


@pytest.mark.parametrize("how", [{}, {"few": 2, "block": 3}])
def test_jaccard_join(spark, texts, how):
    links, comp = jaccard_truth(texts)
    out = minhash_join.jaccard_groups(rows_of(spark, texts), **how).collect()
    assert {r.doc_id: (r.n_links, r.component_id) for r in out} == {i: (len(links[i]), comp[i]) for i in links}
    same = defaultdict(list)
    for i, t in enumerate(texts):
        same[t if WORD.search(t or "") else i].append(i)
    assert {r.doc_id: r.class_id for r in out} == {i: min(g) for g in same.values() for i in g}


def test_jaccard_join_edges(spark, texts):
    docs = rows_of(spark, texts)
    assert minhash_join.jaccard_groups(docs.limit(0)).count() == 0
    one = {(r.doc_id, r.n_links) for r in minhash_join.jaccard_groups(docs.unionByName(docs)).collect()}
    assert one == {(r.doc_id, r.n_links) for r in minhash_join.jaccard_groups(docs).collect()}
    bands, rows = minhash_join.bands_for(0.8, 0.9999, 192)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_files_round_trip(spark, texts, tmp_path, planes):
    path = f"file://{tmp_path}/{planes}"
    token_files.write_tokens(rows_of(spark, texts), path, planes=planes, block_ids=100)
    want = [[*x, 1] for x in ids_of("word_bpe_49k.json", texts)]
    assert {r.doc_id: r.ids for r in token_files.read_ids(spark, path).collect()} == dict(enumerate(want))
    docs = token_files.read_documents(spark, path).join(token_files.segment_starts(spark, path), ["shard", "segment"]).collect()
    at = 0
    for r in sorted(docs, key=lambda r: r.doc_id):
        ids = want[r.doc_id]
        assert (r.segment_start + r["at"], r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_sha_of_kept_text(spark, texts):
    from pyspark.sql import functions as F

    out = fingerprint_index.dedup_substrings(rows_of(spark, texts)).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("s")).collect()
    assert {r.doc_id: r.s for r in out} == {i: hashlib.sha256(x[2].encode()).hexdigest() for i, x in removed(texts).items()}


def odd_words():
    """Pairs of different words that polynomial hashes modulo powers of two can't tell apart."""
    for n in (1024, 2048, 4096):
        w = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        yield w, w.translate(str.maketrans("ab", "ba"))


def test_words_that_hashes_confuse(spark, monkeypatch):
    from claraudit.llm import words

    pairs = list(odd_words())
    assert len(set(words.words(Texts.of(pa.array([" ".join(x for p in pairs for x in p)]))).hashes().tolist())) == 6
    tail = " ".join(f"t{i}" for i in range(12))
    texts = [f"{x} {tail}" for p in pairs for x in p]
    ids, bounds = Encoder(vocabulary("byte_bpe_50k.json"), "spaced").encode(Texts.of(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == ids_of("byte_bpe_50k.json", texts)
    docs = rows_of(spark, texts)
    assert {r.n_removed for r in fingerprint_index.dedup_substrings(docs).collect()} == {0}
    assert {r.n_links for r in minhash_join.jaccard_groups(rows_of(spark, [f"{x} tail" for p in pairs for x in p])).collect()} == {0}


def test_equal_hashes_are_no_equal_words(monkeypatch):
    from claraudit.llm import words

    # all longer words share one hash: bytes decide
    real = words.hash_pieces
    monkeypatch.setattr(words, "hash_pieces", lambda d, s, e: np.where(e - s > 7, np.uint64(5), real(d, s, e)))
    texts = ["alphabetic betabetic alphabetic x", "gammabetic betabetic " + "long" * 40, "long" * 40 + " longlong alphabetic"]
    t = Texts.of(pa.array(texts))
    code, first = words.words(t).exact_codes()
    names = " ".join(texts).split()
    assert len(first) == len(set(names)) and all((code[i] == code[j]) == (names[i] == names[j]) for i in range(len(names)) for j in range(len(names)))
    ids, bounds = Encoder(vocabulary("word_bpe_49k.json"), "words").encode(t)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == ids_of("word_bpe_49k.json", texts)
    grams, at = minhash_join.exact_ngrams(t, 2)
    got = [set(grams[a:b].tolist()) for a, b in zip(at, at[1:], strict=False)]
    assert [len(g) for g in got] == [3, 2, 2] and not got[0] & got[2]


def nameless(spark, texts):
    """documents with null and repeated doc_ids."""
    data = [(None if i % 3 == 0 else i // 2, t, "a", "en", 1) for i, t in enumerate(texts)]
    return data, spark.createDataFrame(data, "doc_id long, text string, source string, lang string, n_chars long")


def test_rows_without_ids_stay(spark, texts, tmp_path):
    from claraudit.llm import language_id, mixing

    data, docs = nameless(spark, texts)
    ids = Counter(str(d[0]) for d in data)
    count = lambda rows: Counter(str(r.doc_id) for r in rows.collect())
    assert count(fingerprint_index.dedup_substrings(docs)) == ids
    assert count(resharding.reshard(docs)[0]) == ids
    assert count(mixing.mix(docs)) == ids
    assert count(language_id.identify(docs)) == ids
    assert count(packing.pack_documents(docs).filter("piece = 0")) == ids
    token_files.write_tokens(docs, f"file://{tmp_path}/t")
    assert count(token_files.read_documents(spark, f"file://{tmp_path}/t")) == ids
    separator_scan.write_flat(docs, f"file://{tmp_path}/f")
    assert count(separator_scan.document_names(spark, f"file://{tmp_path}/f/kind=names")) == ids
    found = minhash_join.jaccard_groups(docs).collect()
    named = Counter((d[0], d[1] or "") for d in data)
    assert len(found) == sum(n if k[0] is None else 1 for k, n in named.items())


def test_order_is_kept_in_packing(spark):
    docs = spark.createDataFrame([(i, "word " * 20, 999 - i) for i in range(1000)], "doc_id long, text string, at long")
    out = packing.pack(packing.token_pieces(docs, capacity=128, order="at"), capacity=128, per_partition=100, ordered=True).filter("sequence_id < 72057594037927936").collect()
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id >> 24].append(r.row)
    spans = [(min(x), max(x)) for _, x in sorted(by.items())]
    assert len(spans) == 10 and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
