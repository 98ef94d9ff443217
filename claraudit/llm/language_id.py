"""Language identification by interpolated Kneser-Ney character models (operator 6).

One model a language. Text is lower-cased and cut into words; a word is its letters (any other character counts as one
class) between two word marks, and the model gives each character's probability after up to ORDER - 1 characters of its
word. Counts are of interpolated Kneser-Ney: the highest order counts occurrences, lower orders count the distinct
characters in front, and each order gives a discount's mass to the next lower one.

A model is a sorted array of n-gram hashes; each has a run of entries (language, probability, mass passed down), so only
what was seen takes room. All languages share the hash array, and one search serves all. A character's probability
starts at its longest known n-gram and multiplies what longer known contexts pass down.

Training: of each language's labelled documents outside the held-out quarter those with the smallest hashes, up to
`train_docs` documents and `train_chars` characters (less where many languages share `model_chars`), one at least; the
next `calibration_docs` calibrate. Counts are summed up by Spark; the summed tables are bounded by the sample and go to the
driver. More than MAX_LANGS distinct labels raise. Scoring takes every whole text. A task scores each distinct word
once. The language with the lowest cross-entropy a character wins.

Calibrated rejection: on the calibration documents (on the training documents of a language that has no others) the
cross-entropy of a word has a mean and a deviation for each language; a text is rejected if its cross-entropy lies above
what `reject_z` deviations of a mean of its number of words, the calibration sample's own extremes and a margin of
`reject_margin` bits a character allow.

Defined results: a text that is null or has no letter is `und`, score 0 and rejected; with no labelled document every
text is; a tie goes to the first language by name; rows that repeat stay; an empty table gives no rows. lang, source and
doc_id are never used to predict. Columns named in `keep` are carried along.
"""

from __future__ import annotations

import math
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claraudit.llm.common import held, release, staged
from claraudit.llm.words import Remembered, Texts, mix, words

ORDER, TRAIN_DOCS, TRAIN_CHARS, CALIBRATION_DOCS, REJECT_Z, REJECT_MARGIN = 5, 300, 1_500_000, 200, 6.0, 2.5
#: Characters of the training sample over all languages, and how many languages there may be.
MODEL_CHARS, MAX_LANGS = 12_000_000, 1000
SLICE = 2 << 20
#: Bytes of distinct words and their scores that a task remembers, and words scored at once.
REMEMBERED_BYTES, TOGETHER = 24 << 20, 1 << 13
#: Sharpness of the score: how a difference in bits a character turns into a probability.
SHARPNESS = 4.0
_U = np.uint64
MARK, OTHER = 1, 2


def held_out(doc_id: str = "doc_id"):
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4) == 2


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point below 0x3000: its code, itself + 3 for letters and marks, else OTHER; and whether it's a letter."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x3000)]
    return np.array([c + 3 if k in "LM" else OTHER for c, k in enumerate(kinds)], np.int64), np.array([k == "L" for k in kinds])


_CODES, _LETTERS = _tables()


def codes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each code point, whether it's a letter)."""
    low = np.minimum(points, 0x2FFF)
    code, letter = _CODES[low], _LETTERS[low]
    high = np.flatnonzero(points >= 0x3000)
    if len(high):
        some, inverse = np.unique(points[high], return_inverse=True)
        is_letter = np.array([unicodedata.category(chr(c))[0] == "L" for c in some.tolist()])
        code[high], letter[high] = np.where(is_letter, some + 3, OTHER)[inverse], is_letter[inverse]
    return code, letter


def word_grams(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all words, each word between marks: (codes, word of each position, position in its word, whether the
    word has a letter). The first mark of a word is context only."""
    lengths = np.array([len(x) for x in names], np.int64)
    points = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    total = lengths + 2
    starts = np.cumsum(total) - total
    out = np.full(int(total.sum()), MARK, np.int64)
    inner = np.repeat(starts + 1 - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    out[inner], letter = codes(points)
    word = np.repeat(np.arange(len(names)), total)
    place = np.arange(len(out)) - starts[word]
    letters = np.bincount(np.repeat(np.arange(len(names)), lengths)[letter], minlength=len(names)) > 0
    return out, word, place, letters


_FACTOR = 0x9FB21C651E98DF25


def gram_hashes(code: np.ndarray, order: int) -> list[np.ndarray]:
    """For n from 0 to order the hash of the n-gram that ends at each position (whatever word it begins in)."""
    total, power, out = np.zeros(len(code), _U), 1, [np.full(len(code), mix(np.zeros(1, _U))[0])]
    for n in range(1, order + 1):
        shifted = np.zeros(len(code), _U)
        shifted[n - 1 :] = code[: len(code) - n + 1]
        total = total + shifted * _U(power)
        power = power * _FACTOR % (1 << 64)
        out.append(mix(total + _U(n * power % (1 << 64))))
    return out


def _before(x: np.ndarray) -> np.ndarray:
    """Each position's value at the position before."""
    return np.concatenate([x[:1], x[:-1]])


def slice_words(part: Texts) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-cased words of a slice, the code of each word occurrence, the row of each."""
    w = words(part)
    code, example = w.exact_codes()
    raw = part.data.tobytes()
    return [raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(w.starts[example].tolist(), w.ends[example].tolist(), strict=True)], code, w.row_of()


def _count(order: int):
    """(lang, text) -> (lang, n, gram, context, shorter, n_count): highest-order occurrences of each word's n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for a, part in Texts.of(batch.column(1)).parts(SLICE):
                names, code, row = slice_words(part)
                chars, word, place, _ = word_grams(names)
                grams = gram_hashes(chars, order)
                for lang in sorted(set(langs[a : a + len(part)])):
                    times = np.bincount(code[(langs[a : a + len(part)] == lang)[row]], minlength=len(names))[word]
                    for n in range(1, order + 1):
                        use = (place >= max(1, n - 1)) & (times > 0)
                        uniq, first, inv = np.unique(grams[n][use], return_index=True, return_inverse=True)
                        total = np.bincount(inv, weights=times[use], minlength=len(uniq)).astype(np.int64)
                        context, shorter, at_start = _before(grams[n - 1])[use][first], grams[n - 1][use][first], (place == n - 1)[use][first]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(uniq)), pa.array(np.full(len(uniq), n, np.int32)), pa.array(uniq.view(np.int64)), pa.array(context.view(np.int64)), pa.array(shorter.view(np.int64)), pa.array(at_start), pa.array(total)],
                            ["lang", "n", "gram", "context", "shorter", "at_start", "times"],
                        )

    return run


COUNTS = "lang string, n int, gram long, context long, shorter long, at_start boolean, times long"


class Model:
    """hashes: sorted; entries runs[i] to runs[i + 1] - 1 are those of hashes[i]: lang (number), gain (log2 probability of the
    n-gram's last character, where it is the longest known one), down (log2 of the mass that the n-gram as a context
    passes down; 0 where it is none)."""

    def __init__(self, langs: list[str], hashes: np.ndarray, runs: np.ndarray, lang: np.ndarray, gain: np.ndarray, down: np.ndarray, order: int, floor: float):
        self.langs, self.hashes, self.runs, self.lang, self.gain, self.down = langs, hashes, runs, lang, gain, down
        self.order, self.floor, self.name = order, floor, uuid.uuid4().hex
        self.mean, self.deviation, self.slack = np.zeros(len(langs)), np.ones(len(langs)), np.zeros(len(langs))
        # where the hashes of each leading part begin: about one hash a part
        self.shift = 64 - max(1, math.ceil(math.log2(max(2, len(hashes)))))
        self.edges = np.searchsorted(hashes, np.arange(1 << (64 - self.shift), dtype=_U) << _U(self.shift)).astype(np.int32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 if there is none."""
        at, last = self.edges[(h >> _U(self.shift)).astype(np.int64)], len(self.hashes) - 1
        todo = np.arange(len(h))
        while len(todo):
            todo = todo[at[todo] <= last]
            todo = todo[self.hashes[at[todo]] < h[todo]]
            at[todo] += 1
        return np.where(self.hashes[np.minimum(at, last)] == h, at, -1)

    def _entries(self, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, entry) for all entries of the hashes at `at`."""
        rows, at = rows[at >= 0], at[at >= 0]
        n = self.runs[at + 1] - self.runs[at]
        ends = np.cumsum(n)
        return np.repeat(rows, n), np.repeat(self.runs[at] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)

    def word_bits(self, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits of each word in each language (words x languages), predicted characters, whether the word has a letter."""
        code, word, place, letters = word_grams(names)
        found = [None, *[np.where(place >= max(1, n - 1), self._find(h), -1) for n, h in enumerate(gram_hashes(code, self.order)[1:], 1)]]
        bits, width = np.zeros(len(code) * len(self.langs)), len(self.langs)
        missing = np.repeat(place > 0, width)
        for n in range(self.order, 0, -1):
            rows = np.flatnonzero(missing.reshape(-1, width).any(1) & (place >= max(1, n - 1)))
            row, entry = self._entries(rows, found[n][rows])
            cell = row * width + self.lang[entry]
            here = missing[cell]
            bits[cell[here]] -= self.gain[entry[here]]
            missing[cell[here]] = False
            if n > 1:
                row, entry = self._entries(rows, found[n - 1][rows - 1])  # the context: it ends one character before
                cell = row * width + self.lang[entry]
                bits[cell] -= np.where(missing[cell], self.down[entry], 0)
        bits[missing] += self.floor
        out, starts = np.zeros((len(names), width)), np.flatnonzero(place == 0)
        if len(starts):
            out = np.add.reduceat(bits.reshape(-1, width), starts, axis=0)
        return out, np.diff(np.append(starts, len(code))) - 1, letters

    def score(self, part: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy in bits a character, rows x languages; words; characters; whether a letter is there)."""
        bits, chars, letters, code, row = self.bits_of(part)
        n, k = len(part), len(self.langs)
        total = np.stack([np.bincount(row, weights=bits[code, j], minlength=n) for j in range(k)], 1) if len(code) else np.zeros((n, k))
        count = np.bincount(row, weights=chars[code], minlength=n) if len(code) else np.zeros(n)
        some = np.bincount(row, weights=letters[code], minlength=n) > 0 if len(code) else np.zeros(n, bool)
        return total / np.maximum(count, 1)[:, None], np.bincount(row, minlength=n), count, some

    def bits_of(self, part: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """word_bits() of a slice's distinct words, the code of each word occurrence, the row of each."""
        w = words(part)
        hashes = w.hashes()
        code, first = w.exact_codes(hashes)
        bits, chars, letters = held(("words", self.name), lambda: Scored(self)).of(part.data, w.starts[first], w.ends[first], hashes[first])
        return bits, chars, letters, code, w.row_of()


class Scored:
    """A model's scores of words, each computed once by a task."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.known, self.table = Remembered(), (np.zeros((0, len(self.model.langs)), np.float32), np.zeros(0, np.int32), np.zeros(0, bool))

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
        if self.known.bytes() + sum(x.nbytes for x in self.table) > REMEMBERED_BYTES:
            self._clear()
        rows = self.known.find(data, starts, ends, hashes)
        new = np.flatnonzero(rows < 0)
        if len(new):
            rows[new] = self.known.add(data, starts[new], ends[new], hashes[new])
            raw, parts = data.tobytes(), [self.table]
            some = max(16, TOGETHER * 4 // max(4, len(self.model.langs)))
            for i in range(0, len(new), some):  # a few words at a time: each takes arrays of all orders and languages
                at = new[i : i + some]
                names = [raw[x:y].decode("utf-8", "replace").lower() for x, y in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
                parts.append(self.model.word_bits(names))
            self.table = tuple(np.concatenate([p[i] for p in parts]).astype(self.table[i].dtype) for i in range(3))
        return tuple(x[rows] for x in self.table)


def build_model(counts: pd.DataFrame, order: int) -> Model:
    """Interpolated Kneser-Ney from summed counts (COUNTS)."""
    langs, parts, floor = sorted(counts["lang"].unique()), [], max(20.0, -float(np.log2(0.001 / 5000)))
    for j, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        by_n = {n: own[own["n"] == n].set_index("gram") for n in range(1, order + 1)}
        gains, downs = [], []
        lower: pd.Series | None = None  # probability of each n-gram's last character at the order below
        for n in range(1, order + 1):
            t = by_n[n].copy()
            if n < order:  # continuation counts; n-grams at a word's start have no character in front: occurrences
                distinct = by_n[n + 1].groupby("shorter").size()
                t["c"] = np.where(t["at_start"] & (n > 1), t["times"], np.maximum(1, distinct.reindex(t.index).fillna(0)))
            else:
                t["c"] = t["times"]
            ones, twos = int((t["c"] == 1).sum()), int((t["c"] == 2).sum())
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            if n == 1:
                p = t["c"] / t["c"].sum() * 0.999
            else:
                sums = t.groupby("context")["c"].agg(["sum", "size"])
                down = discount * sums["size"] / sums["sum"]
                below = lower.reindex(t["shorter"]).fillna(2.0**-floor).to_numpy()
                p = (t["c"] - discount) / sums["sum"].reindex(t["context"]).to_numpy() + down.reindex(t["context"]).to_numpy() * below
                downs.append(np.log2(down))
            lower = pd.Series(np.asarray(p, float), t.index)
            gains.append(np.log2(lower.clip(lower=1e-12)))
        gain = pd.concat(gains)
        down = pd.concat([x.rename("down") for x in downs]).reindex(gain.index).fillna(0.0) if downs else gain * 0
        parts.append((gain.index.to_numpy(np.int64).view(_U), np.full(len(gain), j, np.int32), gain.to_numpy(np.float32), down.to_numpy(np.float32)))
    hashes, lang, gain, down = (np.concatenate(x) for x in zip(*parts, strict=True))
    order_ = np.lexsort((lang, hashes))
    distinct, first = np.unique(hashes[order_], return_index=True)
    return Model(langs, distinct, np.append(first, len(hashes)).astype(np.int64), lang[order_], gain[order_], down[order_], order, floor)


def _calibrate(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for a, part in Texts.of(batch.column(1)).parts(SLICE):
                bits, chars, _, code, row = model.bits_of(part)
                at = np.array([model.langs.index(x) for x in langs[a : a + len(part)]])
                value = (bits / np.maximum(chars, 1)[:, None])[code, at[row]]
                n = np.bincount(row, minlength=len(part))
                s1, s2 = (np.bincount(row, weights=value**e, minlength=len(part)) for e in (1, 2))
                entropy = model.score(part)[0][np.arange(len(part)), at]
                yield pa.RecordBatch.from_arrays([pa.array(langs[a : a + len(part)].tolist()), pa.array(n), pa.array(s1), pa.array(s2), pa.array(entropy)], ["lang", "n", "s1", "s2", "entropy"])

    return run


def train(docs: DataFrame, *, order: int = ORDER, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS, calibration_docs: int = CALIBRATION_DOCS, reject_z: float = REJECT_Z, reject_margin: float = REJECT_MARGIN, model_chars: int = MODEL_CHARS) -> Model | None:
    """Fit on documents with a language and outside the held-out quarter; None where there is none."""
    labelled = docs.filter(~held_out()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.lit(6), "doc_id").alias("h")).filter("lang is not null and text is not null")
    stats = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGS + 1).collect()}
    if not stats:
        return None
    if len(stats) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    wanted, chars = train_docs + calibration_docs, min(train_chars, model_chars // len(stats))
    # candidates: twice what is wanted; then the smallest hashes among them
    unit = F.pmod(F.xxhash64("h", F.crc32(F.col("text").cast("binary"))), F.lit(1 << 30)) / float(1 << 30)
    cuts = [(lang, 2 * wanted / n) for lang, n in stats.items() if n > 2 * wanted]
    near = F.coalesce(F.create_map(*[F.lit(x) for pair in cuts for x in pair])[F.col("lang")], F.lit(2.0)) if cuts else F.lit(2.0)
    some = staged(labelled.withColumn("u", unit).filter(F.col("u") < near), "language-candidates")
    by = Window.partitionBy("lang").orderBy("u", "h")
    some = some.withColumn("rank", F.row_number().over(by)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("lang")))
    some = some.withColumn("first", F.least(F.lit(train_docs), F.ceil(F.col("n") * train_docs / wanted)))
    some = some.withColumn("part", F.col("rank") > F.col("first")).filter(F.col("rank") <= F.col("first") + calibration_docs)
    sofar = F.sum(F.length("text")).over(Window.partitionBy("lang", "part").orderBy("u", "h").rowsBetween(Window.unboundedPreceding, -1))
    some = some.withColumn("sofar", F.coalesce(sofar, F.lit(0))).filter(F.col("sofar") < chars)
    sample = staged(some.select(F.when(F.col("part"), "test").otherwise("train").alias("use"), "lang", "text"), "language-sample")
    grams = sample.filter("use = 'train'").select("lang", "text").mapInArrow(_count(order), COUNTS)
    summed = grams.groupBy("lang", "n", "gram").agg(F.first("context").alias("context"), F.first("shorter").alias("shorter"), F.max("at_start").alias("at_start"), F.sum("times").alias("times"))
    counts = summed.toPandas()  # bounded by the sample
    if not len(counts):
        return None
    model = build_model(counts, order)
    tested = {r["lang"] for r in sample.filter("use = 'test'").select("lang").distinct().collect()}  # MAX_LANGS at most
    use = (F.col("use") == "test") | ~F.col("lang").isin(list(tested)) if tested else F.lit(True)
    facts = sample.filter(use & F.col("lang").isin(model.langs)).select("lang", "text").mapInArrow(_calibrate(model), "lang string, n long, s1 double, s2 double, entropy double").toPandas()
    for j, lang in enumerate(model.langs):
        own = facts[(facts["lang"] == lang) & (facts["n"] > 0)]
        if len(own):
            n = own["n"].sum()
            model.mean[j] = float(np.median(own["entropy"]))
            model.deviation[j] = max(0.1, float(np.sqrt(max(0.0, own["s2"].sum() / n - (own["s1"].sum() / n) ** 2))))
            beyond = own["entropy"] - model.mean[j] - reject_z * model.deviation[j] / np.sqrt(own["n"])
            model.slack[j] = reject_margin + max(0.0, float(np.quantile(beyond, 0.98)))
        else:
            model.mean[j] = np.inf
    return model


def _predict(shared, reject_z: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            last = batch.num_columns - 1
            for a, part in Texts.of(batch.column(last)).parts(SLICE):
                h, n, _, letters = model.score(part)
                best = h.argmin(1)
                low = h[np.arange(len(h)), best]
                score = 1 / np.exp2(-SHARPNESS * (h - low[:, None])).sum(1)
                allowed = model.mean[best] + model.slack[best] + reject_z * model.deviation[best] / np.sqrt(np.maximum(n, 1))
                names = np.array([*model.langs, "und"], object)[np.where(letters, best, len(model.langs))]
                columns = [batch.column(i).slice(a, len(part)) for i in range(last + 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names.tolist(), pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(~letters | (low > allowed)), pa.array(low)], [*batch.schema.names, "lang_pred", "score", "rejected", "bits"])
                release()
        release(0)

    return run


def identify(docs: DataFrame, *, keep: tuple[str, ...] = (), reject_z: float = REJECT_Z, **how) -> DataFrame:
    """doc_id, held_out, the columns of `keep`, text, lang_pred, score, rejected, bits (cross-entropy a character)."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("_doc"), held_out().alias("_held"), *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], F.col("text").cast("string").alias("_text"))
    names = {"_doc": "doc_id", "_held": "held_out", "_text": "text"} | {f"_keep{i}": c for i, c in enumerate(keep)}
    model = train(docs, reject_z=reject_z, **how)
    if model is None:
        out = base.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "rejected": F.lit(True), "bits": F.lit(None).cast("double")})
    else:
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields)
        out = base.mapInArrow(_predict(spark.sparkContext.broadcast(model), reject_z), f"{schema}, lang_pred string, score double, rejected boolean, bits double")
    return out.select(*[F.col(c).alias(names.get(c, c)) for c in out.columns])


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "held_out", "lang_pred", "score", "rejected")


QUERIES = {"op6_kneser_ney": op6_kneser_ney}
SQL: dict[str, str] = {}
