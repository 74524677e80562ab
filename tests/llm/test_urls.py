import itertools
import math
import random
import re

import pytest

from glasspane.llm import urls

SCHEMA = "page_id long, url string, html string, host string, n int"


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
    path = rest[end:]
    stop = min([i for i, c in enumerate(path) if c in "?#"], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def brute_rule(host, path):
    fits = []
    for says, text in urls.RULES:
        name, _, rest = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(text), text, says))
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme", "http://", "http://Example.ORG", "http://example.org/", "https://www.EXAMPLE.org/es/1?x=/y#z", "x://example.org/en/15", "x://example.org/en/2", "x://notexample.org/es/",
    "x://a.com/fr/9", "x://a.com/de/9", "x://com/de/", "x://a.net?/fr/", "x://a.com#/fr/", "x://a://b/c", "ÄX://ÄÖ.COM/DE/", "x://a.com\n/fr/x", "://org/", "x://org", "x://.org/",
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "some words", "h", 1) for i, u in enumerate(URLS)], SCHEMA)
    got = {r.page_id: r for r in urls.judged(pages).collect()}
    for i, u in enumerate(URLS):
        host, path = split_url(u)
        rule, says = brute_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == (says or ("block" if got[i].score > 0 else "allow"))  # no seed word in these


def test_best_split_equals_all_splits():
    r = random.Random(2)
    known_words = {"a": 0.1, "ab": 0.2, "bc": 0.05, "abc": 0.01, "cab": 0.2, "b": 0.01}
    unknown = -5.0
    for _ in range(200):
        part = "".join(r.choice("abcx") for _ in range(r.randint(1, 8)))
        known = {(s, n): math.log(known_words[part[s : s + n]]) for s in range(len(part)) for n in range(1, len(part) - s + 1) if part[s : s + n] in known_words}
        cost = lambda words: sum(math.log(known_words[w]) if w in known_words else unknown - math.log(10) * len(w) for w in words)
        every = []
        for cuts in itertools.product([0, 1], repeat=len(part) - 1):
            words, at = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    words.append(part[at:i])
                    at = i
            every.append([*words, part[at:]])
        found = urls.best_split(part, known, unknown)
        assert "".join(found) == part and abs(cost(found) - max(map(cost, every))) < 1e-9


def test_segmentation_over_tables(spark):
    counts = spark.createDataFrame([("cheap", 50), ("pills", 40), ("a", 500), ("the", 900)], "word string, n long")
    parts = spark.createDataFrame([("cheappills",), ("thecheap",), ("zzz",), ("",)], "part string")
    got = {r.part: r.words for r in urls.segmented(parts, counts).collect()}
    assert got["cheappills"] == ["cheap", "pills"] and got["thecheap"] == ["the", "cheap"] and got["zzz"] == ["zzz"] and "" not in got


def training_pages():
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        host = random.Random(i).choice(["cheappills", "casinowin", "freebets"] if bad else ["gardenworld", "booklovers", "citynews"])
        rows.append((i, f"http://{host}.net/{'offer' if bad else 'story'}/{i}", "cheap pills casino win free bets garden world book lovers city news and more", "h", 1))
    return [*rows, (400, "http://unseenplace.net/offer/1", "x", "h", 1), (401, "http://unseenplace.net/story/1", "x", "h", 1), (402, "http://cheapbets.net/", "x", "h", 1)]


def test_verdicts(spark):
    got = {r.page_id: r for r in urls.judged(spark.createDataFrame(training_pages(), SCHEMA)).collect()}
    assert all((got[i].verdict == "block") == (i % 4 == 0) for i in range(400))
    assert got[400].score > got[401].score and got[402].verdict == "block"
    assert got[0].score > 0 and got[1].score < 0
    plain = {(r.host, r.path): r.score for r in urls.url_scores(spark.createDataFrame(training_pages(), SCHEMA), seed_features=False).collect()}
    assert plain[got[0].host, got[0].path] > 0 > plain[got[1].host, got[1].path]  # without the seed words


def test_the_classifier_decides_not_the_list(spark):
    """A seed word in one host among many of the same words and paths that have none: it is allowed."""
    rows = [(i, f"http://gardenworld{'www'[: i % 3]}.net/story/page", "garden world casino", "h", 1) for i in range(300)]
    rows += [(300, "http://gardenworldcasino.net/story/page", "x", "h", 1)]
    rows += [(i, f"http://gardenworld.net/casino{i}", "x", "h", 1) for i in range(301, 310)]
    found = {r.page_id: r for r in urls.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    marked = {(r.host, r.path): r.marked for r in urls.url_scores(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert marked[found[300].host, found[300].path] and (found[300].verdict == "block") == (found[300].score > 0)


def test_held_out_hosts_without_their_seed_words(spark):
    """Learned from some hosts, the others' scores (no seed word is a feature) tell them apart."""
    from pyspark.sql import functions as F

    good, bad = ["garden", "book", "city", "river", "music"], ["cheap", "win", "free", "fast", "best"]
    pages = []
    for i in range(400):
        r = random.Random(i)
        name = r.choice(bad) + r.choice(["pills", "casino", "bets"]) if i % 4 == 0 else r.choice(good) + r.choice(["world", "news", "lovers"])
        pages.append((i, f"http://{name}{'www'[: i % 3]}.net/{r.choice(['offer', 'bonus']) if i % 4 == 0 else r.choice(['story', 'page'])}/{i}", " ".join([*good, *bad, "pills casino bets world news lovers"]), "h", 1))
    frame = spark.createDataFrame(pages, SCHEMA)
    out = F.crc32(F.col("host").cast("binary")) % 3 == 0
    found = urls.url_scores(frame, training=~out, seed_features=False).where(out).collect()
    assert len({r.host for r in found}) > 5 and {r.marked for r in found} == {True, False}
    assert sum((r.score > 0) == r.marked for r in found) >= 0.98 * len(found)


def brute_verdicts(rows, seeds=urls.SEEDS):
    """page_id to (score, marked): word counts, best splits and naive Bayes with plain loops."""
    counts = {}
    for _, _, html in rows:
        text = re.sub(r"(?is)<script\b.*?</script|<style\b.*?</style|<!--.*?-->", " ", html or "")
        for w in re.findall(r"[^\W\d_]+", re.sub(r"<[^<>]*>|&#?\w+;", " ", text).lower()):
            counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values()) + 1
    splits = {}

    def split(part):
        if part not in splits:
            known = {(a, b - a): math.log(counts[part[a:b]] / total) for a in range(len(part)) for b in range(a + 1, len(part) + 1) if part[a:b] in counts}
            splits[part] = urls.best_split(part, known, -math.log(total))
        return splits[part]

    places = {i: split_url(u) for i, u, _ in rows}
    words = {h: [w for p in re.findall(r"[^\W\d_]+", h.lower()) for w in split(p)] for h, _ in places.values()}
    of_path = lambda p: ["p:" + (f"#{len(t)}" if t[0].isdigit() else t) for t in re.findall("[a-z]+|[0-9]+", p.lower())]
    features, marked = {}, {}
    for i, (h, p) in places.items():
        marked[i] = any(w in seeds for w in words[h])
        features[i] = ["h:" + w for w in words[h]] + of_path(p)
    table = {}
    for i, tokens in features.items():
        for t in tokens:
            table.setdefault(t, [0, 0])[marked[i]] += 1
    good, bad = (sum(x[k] for x in table.values()) for k in (0, 1))
    n = sum(marked.values())
    prior = math.log((n + 1) / (len(rows) - n + 1))
    weight = {t: math.log((b + 1) / (bad + len(table))) - math.log((g + 1) / (good + len(table))) if 0 < n < len(rows) else 0.0 for t, (g, b) in table.items()}
    return {i: (prior + sum(weight[t] for t in tokens), marked[i]) for i, tokens in features.items()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_scores_and_verdicts_equal_brute_force(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    want = brute_verdicts(rows)
    got = {r.page_id: r for r in urls.judged(pages).collect()}
    assert got.keys() == want.keys()
    assert sum((score > 0) == bad for score, bad in want.values()) >= 0.98 * len(want)
    for i, (score, _) in want.items():
        assert abs(got[i].score - score) < 1e-6
        says = brute_rule(got[i].host, got[i].path)[1]
        assert got[i].verdict == (says or ("block" if score > 0 else "allow"))


def test_markup():
    html = "<p class='x'>One<b>two</b> &amp; &#233;<script>var no = '<p>';</SCRIPT> three<!-- no <b> --> four < five <style>no"
    assert urls.TEXT_WORD.findall(urls.without_markup(html)) == ["One", "two", "three", "four", "five"]
    assert urls.without_markup("<" * 100_000 + "a") .endswith("a") and urls.without_markup("<script>" * 50_000).strip() == ""
    assert urls.without_markup("<!-- " * 50_000).strip() == "" and urls.without_markup("") == ""


def test_words_of_any_length_and_script(spark):
    long = "abcdefghijklmnopqrstuvwxyz" * 3
    counts = spark.createDataFrame([(long, 5), ("x", 9), ("gärten", 4), ("книга", 3), ("мир", 8)], "word string, n long")
    parts = spark.createDataFrame([(long + "x",), ("gärtenx",), ("мирмиркнига",), ("q" * 3000,)], "part string")
    got = {r.part: r.words for r in urls.segmented(parts, counts).collect()}
    assert got == {long + "x": [long, "x"], "gärtenx": ["gärten", "x"], "мирмиркнига": ["мир", "мир", "книга"], "q" * 3000: ["q" * 3000]}


def test_large_vocabularies_are_joined_by_a_shuffle(spark, monkeypatch):
    pages = spark.createDataFrame(training_pages(), SCHEMA)
    one = sorted(map(tuple, urls.judged(pages).collect()))
    monkeypatch.setattr(urls, "BROADCAST_TOKENS", 0)
    assert sorted(map(tuple, urls.judged(pages).collect())) == one


def test_odd_rows(spark):
    rows = [(1, "http://a.net/x", None, "h", 1), (1, "http://a.net/x", None, "h", 1), (None, None, "", "h", 1), (2, "http://" + "verylong" * 500 + ".net/", "w", "h", 1)]
    got = urls.judged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.page_id, r.verdict) for r in got), key=str) == [(1, "allow"), (1, "allow"), (2, "allow"), (None, "allow")]
    assert urls.judged(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_over_a_whole_table(spark):
    d = "/root/testdata/sf0.01"
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = {r.page_id: r for r in urls.op9_url_filter(spark, d).collect()}
    assert got.keys() == pages.keys()
    for i, u in pages.items():
        host, path = split_url(u)
        rule, says = brute_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == says if rule else got[i].verdict in ("allow", "block")
        if rule is None and any(s in host for s in ("cheap-pills", "casino-win", "adult-x")):
            assert got[i].verdict == "block"
