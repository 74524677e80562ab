"""URL filters: rules first, then a classifier over the words of host and path.

Host names run words together. A unigram model (word counts of all page texts without markup, in
any script) and Viterbi split each distinct part of a host into its likeliest words. Candidates are
found by joins, without a cap on the length of words or parts: a word is looked up by its beginning,
of the largest power of two letters that it has, so a part has a few keys for each letter. The best
path is found for each part by itself.

Multinomial naive Bayes, over host words and path tokens of all urls, then tells blocked from
allowed. A seed word marks a host as blocked; the classifier learns from these hosts against all
others what else tells them apart, with the seed words themselves left out of its features. A url
is blocked if its host is marked or its score, the log odds, is above 0.

Null urls and urls without "://" have an empty host and path, and no rule; like any url without a
known token they get the verdict of the prior, which is allow unless most urls are blocked.
Where no host, or every host, holds a seed word, scores are that of the prior.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_block, release, ship, stored, table, utf8

#: Words that mark a host as blocked for training (fixed values).
SEEDS = ("spam", "pills", "casino", "bets", "adult", "porn", "xxx", "viagra", "warez", "malware", "phish", "phishing", "ads", "lottery", "jackpot")
#: verdict and rule of the production query (fixed values of its contract).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Token weights up to this many go to every task (about 10 MB); more are joined by a shuffle.
BROADCAST_TOKENS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TEXT_WORD = re.compile(r"[^\W\d_]+")
#: What isn't text: raw elements and comments to their end, other tags, references.
MARKUP = re.compile(r"<(script|style)\b|<!--|<[^<>]*>|&#?\w+;", re.I)


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits (of equals the last in order of text), and its verdict; null if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def without_markup(html: str) -> str:
    """The text between tags; a script, style or comment without an end reaches to the end."""
    out, at = [], 0
    while m := MARKUP.search(html, at):
        out.append(html[at : m.start()])
        at = m.end()
        if m[1] or m[0] == "<!--":
            close = "-->" if m[0] == "<!--" else f"</{m[1]}"
            end = re.compile(re.escape(close), re.I).search(html, at)
            at = end.end() if end else len(html)
    return " ".join([*out, html[at:]])


def word_counts(pages: DataFrame, text: str = "html") -> DataFrame:
    """word, n: lower-case words of all texts without markup, summed within tasks first."""

    def make():
        def work(block):
            counts: Counter = Counter()
            for t in block["text"]:
                counts.update(TEXT_WORD.findall(without_markup(t.decode("utf-8", "replace")).lower()))
            return {"word": list(counts), "n": list(counts.values())}

        return work

    return per_block(pages.select(utf8(text).alias("text")), "text", make, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def best_split(part: str, known: dict[tuple[int, int], float], unknown: float) -> list[str]:
    """Words of greatest total log probability; known: of substrings by (start, length). A
    substring that isn't a word costs `unknown` and ten times less for every letter."""
    ending: dict[int, list[tuple[int, float]]] = {}
    for (start, size), p in known.items():
        ending.setdefault(start + size, []).append((start, p))
    letter = math.log(10)
    best, back = [0.0], [0]
    run, since = -math.inf, 0  # the best end in an unknown piece, and where that began
    for end in range(1, len(part) + 1):
        if (fresh := best[end - 1] + unknown) > run:
            run, since = fresh, end - 1
        run -= letter
        score, start = max([(best[s] + p, s) for s, p in ending.get(end, ())] + [(run, since)])
        best.append(score)
        back.append(start)
    words, end = [], len(part)
    while end:
        words.append(part[back[end] : end])
        end = back[end]
    return words[::-1]


def _beginning(word: Column) -> Column:
    """The first 1, 2, 4, 8, ... letters: as many as there are."""
    return F.substring(word, F.lit(1), F.pow(F.lit(2.0), F.floor(F.log2(F.length(word)) + 1e-9)).cast("int"))


def segmented(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """part (distinct, not null) and words, its likeliest split by the unigram counts."""
    ship(parts.sparkSession)
    total = float(counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n) + 1
    n = F.length("part")
    cuts = parts.select("part", F.explode(F.sequence(F.lit(1), n)).alias("start")).where(n > 0)
    left = n - F.col("start") + 1
    sizes = F.transform(F.sequence(F.lit(0), F.floor(F.log2(left) + 1e-9).cast("int")), lambda i: F.pow(F.lit(2.0), i).cast("int"))
    keys = cuts.select("part", "start", F.explode(sizes).alias("size")).select("part", "start", F.expr("substring(part, start, size)").alias("key"))
    words = counts.select("word", "n", _beginning(F.col("word")).alias("key"))
    found = keys.join(words, "key").where(F.expr("substring(part, start, length(word)) = word"))
    found = found.select("part", F.struct((F.col("start") - 1).alias("start"), F.length("word").alias("size"), F.log(F.col("n") / total).alias("p")).alias("piece"))
    grouped = parts.where(n > 0).join(found.groupBy("part").agg(F.collect_list("piece").alias("pieces")), "part", "left")

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for part, pieces in batches:
            yield pd.Series([best_split(p, {(c["start"], c["size"]): c["p"] for c in ([] if found is None else found)}, -math.log(total)) for p, found in zip(part, pieces, strict=True)], dtype=object)

    return grouped.select("part", split("part", "pieces").alias("words"))


def path_tokens(path: Column) -> Column:
    """Lower-case letters and digits in runs; a number counts by its length."""
    runs = F.regexp_extract_all(F.lower(path), F.lit("([a-z]+|[0-9]+)"), F.lit(1))
    return F.transform(runs, lambda t: F.concat(F.lit("p:"), F.when(t.rlike("^[0-9]"), F.concat(F.lit("#"), F.length(t).cast("string"))).otherwise(t)))


def _with_weights(rows: DataFrame, weights: DataFrame, size: int) -> DataFrame:
    return rows.join(F.broadcast(weights) if size <= BROADCAST_TOKENS else weights, "token", "left")


def url_scores(pages: DataFrame, seeds: tuple[str, ...] = SEEDS, training: Column | None = None, seed_features: bool = True) -> DataFrame:
    """Distinct host and path with score, the log odds of being blocked, and marked, whether the host
    holds a seed word and so is learned as blocked. training: hosts (a condition on host) that are
    learned from, by default all. seed_features: whether seed words count in the score too."""
    host, path = host_and_path()
    pairs = stored(pages.select(host.alias("host"), path.alias("path")).groupBy("host", "path").agg(F.count("*").alias("n")))
    hosts = stored(pairs.groupBy("host").agg(F.sum("n").alias("n")))
    parts = hosts.select("host", F.explode(F.regexp_extract_all(F.lower("host"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("part"))
    vocabulary = stored(word_counts(pages))
    split = segmented(parts.select("part").distinct(), vocabulary)
    words = stored(parts.join(split, "part").select("host", F.explode("words").alias("word")))
    counted = F.lit(True) if seed_features else ~F.col("word").isin(*seeds)
    seen = words.groupBy("host").agg(F.max(F.col("word").isin(*seeds)).alias("bad"), F.collect_list(F.when(counted, F.concat(F.lit("h:"), "word"))).alias("tokens"))
    marked = stored(hosts.join(seen, "host", "left").select("host", "n", F.coalesce("bad", F.lit(False)).alias("bad"), F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), (F.lit(True) if training is None else training).alias("learned")))

    known = marked.where("learned")
    labelled = pairs.join(known.select("host", "bad"), "host")
    both = known.select(F.explode("tokens").alias("token"), "bad", "n").union(labelled.select(F.explode(path_tokens(F.col("path"))).alias("token"), "bad", "n"))
    amount = lambda bad: F.coalesce(F.sum(F.when(F.col("bad") == bad, F.col("n"))), F.lit(0))
    counts = stored(both.groupBy("token").agg(amount(True).alias("bad"), amount(False).alias("good")))
    sums = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    urls = known.agg(amount(True).alias("bad"), amount(False).alias("good")).first()
    prior = math.log((urls.bad + 1) / (urls.good + 1))
    v = max(1, sums.v)
    w = F.log((F.col("bad") + 1) / F.lit(float(sums.bad + v))) - F.log((F.col("good") + 1) / F.lit(float(sums.good + v)))
    weights = counts.select("token", (w if urls.bad and urls.good else F.lit(0.0)).alias("w"))
    total = F.coalesce(F.sum("w"), F.lit(0.0))
    by_host = _with_weights(marked.select("host", "bad", F.explode_outer("tokens").alias("token")), weights, sums.v).groupBy("host", "bad").agg(total.alias("of_host"))
    by_pair = _with_weights(pairs.select("host", "path", F.explode_outer(path_tokens(F.col("path"))).alias("token")), weights, sums.v).groupBy("host", "path").agg(total.alias("of_path"))
    scores = stored(stored(by_pair).join(stored(by_host), "host").select("host", "path", (F.col("of_host") + F.col("of_path") + F.lit(prior)).alias("score"), F.col("bad").alias("marked")))
    release(pairs, hosts, vocabulary, words, marked, counts)
    return scores


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row."""
    scored = url_scores(pages, seeds)
    host, path = host_and_path()
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), path.alias("path")).join(scored, ["host", "path"])
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") > 0, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
