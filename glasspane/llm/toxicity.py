"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text are densities and rates, so that length alone changes none: terms of a seed
lexicon and of a learned lexicon in a hundred words (also weighted, and different ones only), the
most that a stretch of PEAK bytes holds, those that stand near the second person, the second
person, the shares of capitals, marks and symbols, and how often terms appear only once disguises
are undone (digits and signs for letters, letters spaced out). The learned lexicon is the words
that set apart the toxic texts of the training sample, of which near-copies count once. Trees are
fitted on most of the sample; the rest calibrates their probability (isotonic regression).

Labels outside the training part, lang, source and ids have no part in a score. Null text is
empty and is scored like any other. Without both labels in the sample every score is the
sample's mean label (0 if there is none).
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import xxhash
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_block, release, stored, table, utf8
from .quality import labelled_sample, remainder

#: Labelled rows that are learned from, at most, and the share that calibrates.
SAMPLE, CALIBRATION = 16_000, 0.3
#: Learned terms, at most; the share of toxic texts that must hold one; least ratio of shares.
LEARNED, SUPPORT, RATIO = 200, 0.02, 8.0
#: Bytes between a term and a second person near it; bytes of the stretch that a peak is taken in.
NEAR, PEAK = 40, 200
#: Insults of general English (fixed values).
SEEDS = (
    "idiot", "idiots", "moron", "morons", "stupid", "dumb", "fool", "loser", "losers", "trash", "garbage", "scum", "pathetic", "worthless", "disgusting", "clown",
    "jerk", "creep", "freak", "pig", "rat", "vermin", "filth", "filthy", "ugly", "useless", "hate", "kill", "die", "imbecile", "retard", "cretin", "dunce",
)
#: Second-person words of the languages in view (fixed values).
SECOND = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "vous", "votre", "ton", "ta", "usted", "ustedes", "ti", "tus")
UNMASK = bytes.maketrans(b"0134578@$!|", b"oieastbasil")
SPACED = re.compile(r"(?<![a-z\x80-\xff])[a-z](?:[.\-*_ ][a-z]){3,}(?![a-z\x80-\xff])")
WORD = re.compile(r"[^\W\d_]{3,}")
BEYOND_ASCII = re.compile(r"[^\x00-\x7f]+")
N_FEATURES = 14

_joins = np.zeros(256, bool)
_joins[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
JOINS = [bool(x) for x in _joins]


def _bytes_as_text(word: str) -> str:
    return word.encode().decode("latin-1")


def lowered(raw: bytes) -> tuple[bytes, int]:
    """A text with the letters of any script in lower case, and the bytes of capitals outside ASCII."""
    if raw.isascii():
        return raw.lower(), 0
    text = raw.decode("utf-8", "replace")
    others = "".join(BEYOND_ASCII.findall(text))
    return text.lower().encode(), len("".join(filter(str.isupper, others)).encode())


class Reader:
    """Features of texts, for one learned lexicon (word to weight)."""

    def __init__(self, learned: dict[str, float]):
        self.machine = ahocorasick.Automaton()
        terms: dict[str, list] = {}
        for w in SECOND:
            terms.setdefault(w, ["", 0.0, False])[2] = True
        for w in SEEDS:
            terms.setdefault(w, ["", 0.0, False])[0] = "seed"
        for w, weight in learned.items():
            terms.setdefault(w, ["", 0.0, False])[1] = weight
        for w, (seed, weight, second) in terms.items():
            form = _bytes_as_text(w)
            self.machine.add_word(form, (w, len(form), bool(seed), weight, second))
        self.machine.make_automaton()

    def _hits(self, text: str) -> list[tuple[int, int, tuple]]:
        out, n = [], len(text)
        for last, term in self.machine.iter(text):
            start = last + 1 - term[1]
            if (start == 0 or not JOINS[ord(text[start - 1])]) and (last + 1 == n or not JOINS[ord(text[last + 1])]):
                out.append((start, last + 1, term))
        return out

    def features(self, raw: bytes) -> list[float]:
        low, more_capitals = lowered(raw)
        text = low.decode("latin-1")
        hits = self._hits(text)
        terms = [h for h in hits if h[2][2] or h[2][3]]
        second = [h[0] for h in hits if h[2][4]]
        places = {h[0] for h in terms}
        masked = 0
        bare = low.translate(UNMASK)
        if bare != low:
            masked = sum(1 for h in self._hits(bare.decode("latin-1")) if (h[2][2] or h[2][3]) and h[0] not in places and h[1] - h[0] > 3)
        spaced = sum(1 for m in SPACED.finditer(text) if any(h[2][2] or h[2][3] for h in self._hits(re.sub(r"[.\-*_ ]", "", m[0]))))
        near, at = 0, 0
        for h in terms:
            while at < len(second) and second[at] < h[0] - NEAR:
                at += 1
            near += at < len(second) and second[at] <= h[1] + NEAR
        kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
        capitals, small = int(kinds[65:91].sum()) + more_capitals, int(kinds[97:123].sum()) + int(kinds[128:].sum()) - more_capitals
        per_words = 100 / max(1, int(kinds[[32, 9, 10, 13]].sum()) + 1)
        size = max(1, len(raw))
        return [
            sum(h[2][2] for h in terms) * per_words,
            sum(h[2][3] > 0 for h in terms) * per_words,
            sum(h[2][3] for h in terms) * per_words,
            len({h[2][0] for h in terms if h[2][2]}) * per_words,
            len({h[2][0] for h in terms if h[2][3]}) * per_words,
            near * per_words,
            near / max(1, len(terms)),
            len(second) * per_words,
            capitals / max(1, capitals + small),
            100 * int(kinds[[33, 63]].sum()) / size,
            100 * int(kinds[[35, 36, 37, 38, 42, 64, 94]].sum()) / size,
            masked * per_words,
            spaced * per_words,
            100 * _most_in_a_stretch([h[0] for h in terms]) / PEAK,
        ]


def _most_in_a_stretch(starts: list[int]) -> int:
    most = first = 0
    for i, at in enumerate(starts):
        while at - starts[first] >= PEAK:
            first += 1
        most = max(most, i + 1 - first)
    return most


def _near_copy_key(words: list[str]) -> int:
    """Least hash of the 3-word shingles; near-copies mostly share it."""
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    return min(xxhash.xxh64_intdigest(g) for g in grams) >> 1


def learned_lexicon(sample: DataFrame) -> dict[str, float]:
    """Word to log ratio of its share in toxic and in other texts; at most LEARNED words."""

    def make():
        def work(block):
            texts = [WORD.findall(t.decode("utf-8", "replace").lower()) for t in block["text"]]
            return {"copy": [_near_copy_key(t) for t in texts], "label": block["label"], "words": [sorted(set(t)) for t in texts]}

        return work

    texts = stored(per_block(sample, "text", make, "copy bigint, label int, words array<string>").dropDuplicates(["copy", "label"]))
    n = {r.label: r["count"] for r in texts.groupBy("label").count().collect()}
    if len(n) < 2:
        release(texts)
        return {}
    counts = texts.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    ratio = (F.col("toxic") + 0.5) / (n[1] + 1) / ((F.col("clean") + 0.5) / (n[0] + 1))
    chosen = counts.where((F.col("toxic") >= max(3, SUPPORT * n[1])) & (ratio >= RATIO)).orderBy(F.desc("toxic"), "word").limit(LEARNED)
    found = {r.word: float(np.log(r.ratio)) for r in chosen.select("word", ratio.alias("ratio")).collect()}
    release(texts)
    return found


class Model:
    def __init__(self, learned: dict[str, float], trees, isotonic, mean: float):
        self.learned, self.trees, self.isotonic, self.mean = learned, trees, isotonic, mean


def features(rows: DataFrame, learned: dict[str, float], keep: str = "") -> DataFrame:
    """doc_id, the features of text (UTF-8), and columns to keep (a schema)."""
    kept = [x.split(" ")[0] for x in keep.split(", ") if x]

    def make():
        reader = Reader(learned)
        return lambda block: {"doc_id": block["doc_id"], "dense": [reader.features(t) for t in block["text"]]} | {k: block[k] for k in kept}

    return per_block(rows, "text", make, "doc_id bigint, dense array<double>" + (f", {keep}" if keep else "")).withColumn("features", array_to_vector("dense")).drop("dense")


def fit(docs: DataFrame, labels: DataFrame, training: Column, label: str = "toxic", most: int = SAMPLE) -> Model:
    """Lexicon, trees and calibration from at most `most` training rows."""
    sample = stored(labelled_sample(docs, labels, label, training, most))
    learned = learned_lexicon(sample)
    kept = stored(features(sample, learned, "label int").select("doc_id", "label", vector_to_array("features").alias("dense")))
    release(sample)
    rows = kept.withColumn("features", array_to_vector("dense"))
    n = rows.agg(F.count("*").alias("n"), F.coalesce(F.avg("label"), F.lit(0.0)).alias("mean"), F.countDistinct("label").alias("kinds")).first()
    if n.kinds < 2:
        release(kept)
        return Model(learned, None, None, n.mean)
    holds_back = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(1000)) < int(1000 * CALIBRATION)
    target = F.col("label").cast("double").alias("target")
    trees = GBTClassifier(featuresCol="features", labelCol="target", maxIter=20, maxDepth=3, stepSize=0.3, subsamplingRate=1.0, seed=7).fit(rows.where(~holds_back).select("features", target).coalesce(4))
    ranked = trees.transform(rows.where(holds_back).select("features", target)).select(vector_to_array("probability")[1].alias("p"), "target")
    isotonic = IsotonicRegression(featuresCol="p", labelCol="target", predictionCol="calibrated").fit(ranked) if not ranked.isEmpty() else None
    release(kept)
    return Model(learned, trees, isotonic, n.mean)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, 0 to 1, for every row. Where calibration is flat, a thousandth of the
    trees' own probability keeps the order."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8().alias("text"))
    if model.trees is None:
        return rows.select("doc_id", F.lit(float(model.mean)).alias("score"))
    found = model.trees.transform(features(rows, model.learned)).select("doc_id", vector_to_array("probability")[1].alias("p"))
    if model.isotonic is None:
        return found.select("doc_id", F.col("p").alias("score"))
    found = model.isotonic.transform(found)
    return found.select("doc_id", (F.least(F.greatest("calibrated", F.lit(0.0)), F.lit(1.0)) * 0.999 + F.col("p") * 0.001).alias("score"))


def op3_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scores(docs, fit(docs, table(spark, sf_dir, "labels"), remainder(5) != 0))
    return found.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
