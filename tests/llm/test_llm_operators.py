"""Each operator on small tables with every awkward row, against brute force."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.llm import (
    curriculum,
    decontaminate,
    host_quality,
    jaccard_join,
    language_gru,
    pii,
    toxicity,
    url_rules,
    warc_index,
    weight_tree,
)
from hindcast.llm.components import components
from hindcast.llm.order import numbered

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def some_docs(seed=1, n=60):
    """Nulls in any column, empty texts, a long one, copies, repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gámma", "d", "e-f", "日本", "x#y", "$$", "ten", "eleven", "twelve"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 9, 10, 11, 40]))) for _ in range(n)]
    texts += [None, "", " \n\t ", "a b c d e a b c d e f", "same line\nsame line\nother\n\nsame line ", "one two " * 3000]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["s1", "s2", "ß", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [(1000 + i, texts[0], "en", "s1", 1) for i in range(5)]
    return [*rows, rows[3], rows[3], (None, "null key here", "en", None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(some_docs(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


# --- 1 quality rules -----------------------------------------------------------------------------------------------


def measures(text):
    words = SPACED.findall(text or "")
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return (len(words), sum(map(len, words)), symbols, len(lines), len(lines) - len(set(lines)), len(inside))


def test_measures_and_host_verdicts(spark, docs, empty):
    clashing = docs.withColumn("n_words", F.lit("mine")).withColumn("kept", F.lit(1))
    found = rows_of(host_quality.judged(clashing).select("doc_id", *host_quality.MEASURES))
    assert found == Counter((r[0], *measures(r[1])) for r in some_docs())
    assert host_quality.judged(empty).count() == 0
    good = "The quick brown fox jumps over a lazy dog and then it runs far away today"
    hosts = [(i, good, "en", "good", 1) for i in range(40)] + [(100 + i, "$ $ $ " + good + " # # # #", "en", "bad", 1) for i in range(40)]
    verdict = {r["source"]: r["kept"] for r in host_quality.judged(spark.createDataFrame(hosts, DOCS)).collect()}
    assert verdict == {"good": True, "bad": False}


def test_rates_shrink_towards_the_hosts(spark):
    rows = [("a", 1)] * 1 + [("b", 0)] * 200 + [("c", 1)] * 10 + [("c", 0)] * 190
    df = spark.createDataFrame(rows, "source string, n int")
    rate = {r["source"]: r["bad_rate"] for r in host_quality.host_rates(df, "source", {"bad": "n > 0"}).collect()}
    assert rate["b"] < rate["c"] < rate["a"] < 1


# --- 2 sharding ----------------------------------------------------------------------------------------------------


def test_shards(spark, docs, empty):
    found = weight_tree.sharded(docs, 16).collect()
    assert len(found) == len(some_docs()) and weight_tree.sharded(empty, 16).count() == 0
    by_shard = defaultdict(list)
    for r in found:
        by_shard[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in some_docs()
    )


def test_tree_shares_and_movement(spark):
    keys = spark.range(40_000)
    shares = lambda tree: Counter(r[0] for r in keys.select(weight_tree.shard_of(F.col("id"), tree)).collect())
    counts = shares(weight_tree.tree(16))
    assert set(counts) == set(range(16)) and all(abs(c - 2500) < 300 for c in counts.values())
    weighted = shares(weight_tree.tree(4, weights={0: 3.0, 3: 0.0}))
    assert 3 not in weighted and abs(weighted[0] - 24_000) < 800
    # a changed weight in one region: rows move only into or out of that region
    columns = [weight_tree.shard_of(F.col("id"), weight_tree.tree(16, weights=w)) for w in ({}, {2: 4.0})]
    moved = [(a, b) for a, b in keys.select(*columns).collect() if a != b]
    assert moved and all(a < 8 or b < 8 for a, b in moved)
    grown = [weight_tree.shard_of(F.col("id"), weight_tree.tree(n)) for n in (17, 18)]
    assert {b for a, b in keys.select(*grown).collect() if a != b} == {17}


# --- 3 toxicity ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, patterns",
    [
        ("you are an idiot", {"insult+target": 1}),
        ("what an idiot. Idiots!", {"insult": 2}),
        ("you are not an idiot", {"insult-denied+target": 1}),
        ("he said you idiot", {"insult-reported+target": 1}),
        ("not one of these many is an idiot", {"insult+target": 1}),
        ("i will kill you", {"threat+target": 1}),
        ("he never would kill a big idiot", {"insult+target": 1, "threat-denied+target": 1}),
        ("Sie sagte: du bist ein idiot", {"insult-reported+target": 1}),
        ('He said: "you are an idiot"', {"insult-reported+target": 1}),
        ("you are an idiot, he said", {"insult-reported+target": 1}),
        ("you are not an idiot, she wrote", {"insult-reported+target": 1}),
        ("he said it. you are an idiot", {"insult+target": 1}),
        ("note: you are an idiot", {"insult+target": 1}),
        ("fine words; " * 3000 + "you idiot; " * 3000, {"insult+target": 3000}),
        ("a killer deidiot", {}),
        ("", {}),
        (None, {}),
    ],
)
def test_grammar(text, patterns):
    assert dict(toxicity.Grammar(["idiot"]).counts(text)) == patterns


def test_toxicity_learns_stems_and_scores_all(spark, docs, empty):
    rng = random.Random(5)
    plain = lambda: " ".join("".join(rng.choice("abcdeo") for _ in range(6)) for _ in range(30))
    rows = [(i, plain() + (" vrodak" + rng.choice("xyz") + " " + plain() if i % 4 == 0 else ""), "en", "s", 1) for i in range(400)]
    labels = [(i, int(i % 4 == 0)) for i in range(400)] + [(8, 0), (None, 1)]
    df = spark.createDataFrame(rows, DOCS)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, table)
    assert model.stems == ("vrodak",)
    found = toxicity.scored(df.withColumn("score", F.lit("mine")), model).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    odd = toxicity.scored(docs, model).collect()
    assert len(odd) == len(some_docs()) and all(0 <= r["score"] < 0.5 for r in odd)
    assert toxicity.scored(empty, toxicity.fit(empty, table.limit(0))).count() == 0


# --- 4 WARC --------------------------------------------------------------------------------------------------------


def test_loser_tree_merges_like_heapq():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 7, 8):
        runs = [sorted((rng.randrange(9), i) for _ in range(rng.randrange(6))) for i in range(k)]
        tree = warc_index.LoserTree([[(x, x) for x in r] for r in runs])
        assert [row for _run, (_key, row) in tree] == list(heapq.merge(*runs))


def test_archives_round_trip(spark, tmp_path):
    big = "x\r\n\r\nWARC/1.1\r\n" + "é" * 120
    pages = [(1, "http://B.a.org/x?q#f", big), (2, "https://b.A.org/x?q", big), (3, None, None), (4, "", ""), (5, "http://b.a.org/x?q", "tiny")]
    pages += [(6, "nonsense", "tiny"), (7, "http://c.com/\r\n: y", "z" * 100_000), (7, "http://c.com/\r\n: y", "z" * 100_000), (None, "http://c.com", "q")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("run", F.lit(1)).repartition(2)
    path = f"{tmp_path}/warc"
    plan = warc_index.planned(df)
    warc_index.write_archives(plan, path, volume_bytes=2000)
    read = warc_index.read_archives(spark, path)
    index = warc_index.capture_index(read).collect()
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in index) == Counter(
        (p, len((h or "").encode()), digest(h)) for p, _u, h in pages
    )
    revisits = {r["page_id"]: r["refers_to"] for r in index if r["record_type"] == "revisit"}
    assert revisits == {2: 1}
    ordered = sorted(index, key=lambda r: (r["range_no"], r["position"]))
    keys = [(r["url_key"], r["capture_time"], r["page_id"] or -1) for r in ordered]
    assert keys == sorted(keys)
    assert [r["capture_no"] for r in ordered if r["url_key"] == "org,a,b)/x?q"] == [1, 2, 3]
    assert warc_index.capture_index(warc_index.read_archives(spark, path).limit(0)).count() == 0
    assert warc_index.archived(df.limit(0)).count() == 0


# --- 5 URL filters -------------------------------------------------------------------------------------------------


def test_url_rules_against_brute_force(spark):
    rng = random.Random(3)
    labels, parts = ["a", "b", "ab", "org"], ["/", "/x", "/x/", "/xy", "/x/z", ""]
    rules = {(".".join(rng.choice(labels) for _ in range(rng.randrange(1, 4))), rng.choice(parts)) for _ in range(25)}
    rules = [(rng.choice(["allow", "block"]), h, p) for h, p in sorted(rules)]
    urls = [None, "", "no scheme", "http://", "x://B.ORG?q", "http://a.org/x://b"]
    urls += ["http://" + ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5))) + rng.choice(parts) + rng.choice(parts) for _ in range(300)]
    pages = [(i, u) for i, u in enumerate(urls)] * 2
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("mine"))

    def expected(url):
        match = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        if not match:
            return "", "", None, "allow"
        host, path = lower(match[1]), match[2]
        fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if ("." + host).endswith("." + h) and path.startswith(p)]
        return host, path, *(max(fits)[2:] if fits else (None, "allow"))

    found = rows_of(url_rules.judged(df, url_rules.rules_table(spark, rules)))
    assert found == Counter((i, *expected(u)) for i, u in pages)
    assert url_rules.judged(df.limit(0), url_rules.rules_table(spark, rules)).count() == 0
    none = url_rules.judged(df, url_rules.rules_table(spark, rules).limit(0))
    assert {r["verdict"] for r in none.collect()} == {"allow"}


# --- 6 benchmark decontamination -----------------------------------------------------------------------------------


def brute_hits(text, items):
    words, hit, named = ALNUM.findall(lower(text)), set(), set()
    for item, passage in items:
        tokens = ALNUM.findall(lower(passage))
        size = min(10, len(tokens))
        grams = {tuple(tokens[i : i + size]) for i in range(len(tokens) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                named.add("" if item is None else str(item))
    return len(words), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)


def test_decontamination_against_brute_force(spark, empty):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "B", "cé", "d1", "ee"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 9, 10, 14])))) for i in range(14)]
    items = [x for x in items if len(x[1].split()) not in (1, 2) or x[0] % 5 == 0] + [(50, items[-1][1]), (51, None), (None, "zz zz zz"), (9, "a a-a, a")]
    texts = [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(40)] + [None, "", "!!"]
    texts += ["x " * 50 + (p or "") + ". y" for _, p in items] + ["q " * 200_000 + items[0][1]]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:2], DOCS)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = Counter((r[0], *brute_hits(r[1], items)) for r in rows + rows[:2])
    assert rows_of(decontaminate.judged(df, benchmark)) == expected
    assert rows_of(decontaminate.judged(df, benchmark, block_bytes=60)) == expected
    kept = decontaminate.clean(df.withColumn("hits", F.lit(1)), benchmark)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k[0] for k in expected.elements() if not k[-1])
    for r in decontaminate.without_spans(df.where("doc_id between 43 and 60"), benchmark).collect():
        words, hit = len(ALNUM.findall(lower(rows[r["doc_id"]][1]))), brute_hits(rows[r["doc_id"]][1], items)[1]
        assert len(ALNUM.findall(lower(r["text"]))) == words - hit
    assert decontaminate.judged(empty, benchmark).count() == 0
    assert decontaminate.clean(df, benchmark.limit(0)).count() == len(rows) + 2


# --- 7 n-gram Jaccard join -----------------------------------------------------------------------------------------


def brute_components(rows, sim):
    def shingles(text):
        w = SPACED.findall(lower(text))
        return frozenset(tuple(w[i : i + sim.words]) for i in range(max(1, len(w) - sim.words + 1))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        k = len(sets[i] & sets[j])
        if sets[i] and sets[j] and sim.over * k >= sim.times * (len(sets[i]) + len(sets[j]) - k):
            parent[find(j)] = find(i)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return Counter((rows[i][0], len(sets[i]), min(groups[find(i)])) for i in range(len(rows)))


def near_copies(seed=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(30)]
    rows = []
    for size in (1, 2, 3, 6, 12, 40, 80, 200):
        base = [word() for _ in range(size)]
        for _ in range(7):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(size)] = word()
            rows.append(" ".join(copy))
        rows += [" ".join(passage + base), " ".join(base).upper()]
    rows += [" ".join(passage + [word() for _ in range(40)]) for _ in range(15)] + [None, "", " "]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows))


@pytest.mark.parametrize("words, times", [(3, 90), (5, 80)])
def test_jaccard_join_against_brute_force(spark, monkeypatch, words, times):
    monkeypatch.setattr(jaccard_join, "CLASSES", ((3, 2), (6, 3)))  # combinations of both sizes, blocks of few documents
    monkeypatch.setattr(jaccard_join, "BLOCK", 6)
    rows = near_copies()
    rows += [rows[0], rows[0], rows[5]]
    rng = random.Random(4)  # texts with wide sketches: about as many words differ as may, and a few shared passages
    long = [f"w{rng.randrange(400)}" for _ in range(1500)]
    for i in range(12):
        copy = long[: 700 + 100 * (i % 3)] if i < 9 else [f"v{rng.randrange(400)}" for _ in range(700)] + long[:30]
        for at in rng.sample(range(len(copy)), 3 * i):
            copy[at] = "other"
        rows.append((1000 + i, " ".join(copy)))
    sim = jaccard_join.Similarity(words, times, 100)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("mine")).repartition(3)
    found = jaccard_join.joined(df, similarity=sim).select("key", "n_shingles", "component_id")
    assert rows_of(found) == brute_components(rows, sim)


def test_a_group_of_near_copies_is_compared_about_once(spark, monkeypatch):
    rng = random.Random(12)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(80):  # some link to most others, some to none
        copy = list(base)
        for at in rng.sample(range(120), rng.randrange(6)):
            copy[at] = f"other{i}"
        rows.append((i, " ".join([*copy, f"end{i}"])))
    tables, write = {}, jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", lambda df, name: tables.update({name: write(df, name)}) or tables[name])
    monkeypatch.setattr(jaccard_join, "CLASSES", ((3, 2), (6, 3)))
    sim = jaccard_join.Similarity(5, 80, 100)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = rows_of(jaccard_join.joined(df, similarity=sim, links=False).select("key", "n_shingles", "component_id"))
    assert found == brute_components(rows, sim) and 2 <= len({c for _, _, c in found}) <= 60
    assert tables["large"].count() > 200  # that share these entries
    assert tables["forest"].count() <= 4 * len(rows)


def test_merged_entries_keep_every_pair(spark):
    rng = random.Random(3)
    sets = [rng.sample(range(k, k + 12), rng.randrange(3, 12)) for k in (0, 5, 40) for _ in range(25)]
    sets += [[200, *range(300 + 10 * i, 310 + 10 * i)] for i in range(5)]  # one node in common: not worth a merge
    members = spark.createDataFrame([(e, n) for e, nodes in enumerate(sets) for n in nodes], "entry long, node long")
    groups = defaultdict(set)
    rows = jaccard_join._merged(members).collect()
    for r in rows:
        groups[r["entry"]].add(r["node"])
    pairs = lambda parts: {p for nodes in parts for p in itertools.combinations(sorted(nodes), 2)}
    assert sum(map(len, groups.values())) == len(rows)
    assert pairs(sets) <= pairs(groups.values())
    assert sum(len(g) ** 2 for g in groups.values()) < sum(len(g) ** 2 for g in sets) / 2
    assert all(set(s) in groups.values() for s in sets[-5:])
    assert jaccard_join._merged(members.limit(0)).count() == 0


@pytest.mark.parametrize("words, times", [(3, 90), (5, 80)])
def test_jaccard_join_in_blocks_of_six(spark, monkeypatch, words, times):
    monkeypatch.setattr(jaccard_join, "CLASSES", ((3, 2), (6, 3)))
    monkeypatch.setattr(jaccard_join, "BLOCK", 6)
    monkeypatch.setattr(jaccard_join, "SKETCHED", 1)
    rows = near_copies()
    rng = random.Random(8)
    base = [f"w{rng.randrange(400)}" for _ in range(900)]
    for i in range(30):  # about as many words differ as may
        copy = list(base)
        for at in rng.sample(range(900), 2 * i):
            copy[at] = f"other{i}"
        rows.append((1000 + i, " ".join(copy)))
    sim = jaccard_join.Similarity(words, times, 100)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = jaccard_join.joined(df, similarity=sim, links=False).select("key", "n_shingles", "component_id")
    assert rows_of(found) == brute_components(rows, sim)


def brute_links(rows, sim):
    def shingles(text):
        w = SPACED.findall(lower(text))
        return frozenset(tuple(w[i : i + sim.words]) for i in range(max(1, len(w) - sim.words + 1))) if w else frozenset()

    sets, links = [shingles(t) for _, t in rows], [0] * len(rows)
    for i, j in itertools.combinations(range(len(rows)), 2):
        k = len(sets[i] & sets[j])
        if sets[i] and sets[j] and sim.over * k >= sim.times * (len(sets[i]) + len(sets[j]) - k):
            links[i] += 1
            links[j] += 1
    return Counter((rows[i][0], links[i]) for i in range(len(rows)))


@pytest.mark.parametrize("words, times, tokens", [(3, 90, 1 << 20), (5, 80, 1 << 20), (3, 90, 200)])
def test_links_inside_components_are_counted(spark, monkeypatch, words, times, tokens):
    monkeypatch.setattr(jaccard_join, "BLOCK", 6)
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", tokens)
    rows = near_copies()
    rows += [rows[0], rows[0], rows[5]]  # documents that repeat, linked to each other and to what their text links to
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    for i in range(25):  # a group of which every two link, and a chain of which neighbours do
        rows.append((2000 + i, " ".join([*base, f"end{i}"])))
        rows.append((3000 + i, " ".join(f"c{j}" for j in range(6 * i, 6 * i + 150 + rng.randrange(3)))))
    sim = jaccard_join.Similarity(words, times, 100)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = brute_links(rows, sim)
    assert max(n for _, n in expected) >= 24
    assert rows_of(jaccard_join.joined(df, similarity=sim).select("key", "n_links")) == expected
    assert rows_of(jaccard_join.joined(df.limit(0), similarity=sim).select("key", "n_links")) == Counter()


def test_one_of_each_keeps_each_group_once(spark, empty):
    texts = ["a b c d e f g h"] * 4 + ["A b c d e f g h", "z y x w v u t s", None, None, ""]
    rows = [(i + 1, t, "en", None, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[0], rows[5], (6, "other text of the same key", "en", None, 1)], DOCS)
    kept = sorted((r["doc_id"], r["text"] or "") for r in jaccard_join.one_of_each(df).collect())
    assert kept == [(1, texts[0]), (6, "other text of the same key"), (6, texts[5]), (7, ""), (8, ""), (9, "")]
    assert jaccard_join.one_of_each(empty).count() == 0 and jaccard_join.one_of_each(df).columns == df.columns


def test_prefixes_always_earn_enough():
    """Any mixture of token classes reaches the number of tokens a linked set must share."""
    rng = np.random.default_rng(1)
    for times in (80, 90):
        sim = jaccard_join.Similarity(3, times, 100)
        for n in [*range(4, 60), 200]:
            for classes in (np.zeros(n), np.ones(n), np.full(n, 2), rng.integers(0, 3, n)):
                x = np.sort(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
                lacking = sim.lacking(n)
                y = np.delete(x, rng.choice(n, lacking, replace=False))
                cx = classes.astype(np.int8)
                cy = cx[np.isin(x, y)]
                a, b = jaccard_join.signatures(x, cx, sim, (2, 3)), jaccard_join.signatures(y, cy, sim, (2, 3))
                assert np.intersect1d(a, b).size, (times, n)


def test_frequent_tokens_add_few_entries():
    """A set whose tokens have all become frequent, as in a group that grows, has a bounded multiple of the entries."""
    rng = np.random.default_rng(4)
    for times in (80, 90):
        sim, rare, often = jaccard_join.Similarity(5, times, 100), 0, 0
        for n in range(40, 640, 20):
            x = np.sort(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            rare += jaccard_join.signatures(x, np.zeros(n, np.int8), sim, (2, 3)).size
            often += jaccard_join.signatures(x, np.full(n, 2, np.int8), sim, (2, 3)).size
        assert often <= 20 * rare, (times, often / rare)


def test_cells_twice_the_size_always_earn_enough():
    """Where cells lose the most tokens (two classes lose 1 and 2 in each), a set still reaches what a linked one shares."""
    for times in (80, 85, 90, 99):
        sim = jaccard_join.Similarity(3, times, 100)
        for n in range(1, 2000):
            if sim.sizes(n) != (n, n):  # else only equal sets link, which are one node
                level = jaccard_join._cell_levels(n, sim)[-1]
                assert n - 3 * 2 ** max(0, level - 1) > sim.lacking(n), (times, n)


def test_sets_short_of_tokens_meet_in_larger_cells():
    """Both classes in every cell, one and two tokens of each: the cells of their size give nothing."""
    sim = jaccard_join.Similarity(3, 80, 100)
    for n in (32, 64, 128, 256, 500):
        level = jaccard_join._cell_levels(n, sim)[-1]
        width = 2 ** (64 - level)
        places = [(i * width + j, c) for i in range(2**level) for j, c in ((1, 1), (2, 2), (3, 2))][:n]
        x, cx = np.array([t for t, _ in places], np.uint64), np.array([c for _, c in places], np.int8)
        assert jaccard_join._combined(x, cx, (2, 3), level, level, 1) == ([], 1)
        n = len(x)
        rng = np.random.default_rng(n)
        for _ in range(20):
            keep = np.sort(rng.permutation(n)[sim.lacking(n) :])
            a, b = (jaccard_join.signatures(x[i], cx[i], sim, (2, 3)) for i in (np.arange(n), keep))
            assert np.intersect1d(a, b).size, n


def test_copies_are_indexed_once(spark, monkeypatch):
    near = " ".join(f"w{i}" for i in range(40))
    rows = [(i, (near, near + " end")[i % 2]) for i in range(30)] + [(100 + i, f"other {i} text of its own") for i in range(5)]
    tables, write = {}, jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", lambda df, name: tables.update({name: write(df, name)}) or tables[name])
    sim = jaccard_join.Similarity(5, 80, 100)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = rows_of(jaccard_join.joined(df, similarity=sim, links=False).select("key", "n_shingles", "component_id"))
    assert found == brute_components(rows, sim) and {c for _, _, c in found} == {0, *range(100, 105)}
    assert {r["rows"] for r in tables["entries"].collect()} == {2}  # two texts, not thirty documents
    assert tables["large"].count() == tables["members"].count() == 0


def test_wide_sketches_bound_the_difference():
    """Sketches of any two widths differ in no more bits than the sets in tokens, and fold to the narrow one."""
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 9000).astype(np.uint64) * np.uint64(2)
    for n, m in ((0, 1), (512, 513), (600, 540), (513, 1025), (1024, 8192), (5000, 4800), (9000, 30)):
        x, y = np.unique(pool[:n]), np.unique(rng.permutation(pool)[:m])
        a, b = (jaccard_join._wide(t) or jaccard_join._sketch(t) for t in (x, y))
        assert jaccard_join._apart(a, b) == jaccard_join._apart(b, a) <= len(np.setxor1d(x, y))
        assert jaccard_join._apart(a, jaccard_join._sketch(x)) == 0 and 8 * len(a) >= n
    assert jaccard_join._wide(pool[:512]) is None
    far = [jaccard_join._wide(pool[i : i + 4000]) for i in (0, 4000)]
    assert (100 + 80) * jaccard_join._apart(*far) > (100 - 80) * 8000  # two long texts with nothing in common


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (300, 200), (200, 300)]
    found = defaultdict(set)
    for r in components(spark.createDataFrame(links, "a long, b long")).collect():
        found[r["root"]].add(r["node"])
    assert sorted(map(sorted, found.values())) == [list(range(31)), list(range(100, 120)), [200, 300]]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 8 mixing ------------------------------------------------------------------------------------------------------


def test_mixture(spark, docs, empty):
    mix = curriculum.mixed(docs.withColumn("size", F.lit("mine")), cell_rows=4)
    rows = mix.collect()
    assert len(rows) == len(some_docs())
    assert rows_of(mix.select("doc_id", "taken")) == rows_of(curriculum.mixed(docs.repartition(7), cell_rows=1000).select("doc_id", "taken"))
    names = sorted({r["source"] for r in rows if r["source"] is not None}, key=lambda s: [ord(c) for c in s]) + [None]
    sizes = {s: sum(len(SPACED.findall(r["text"] or "")) for r in rows if r["source"] == s) for s in names}
    weight, wanted, full = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()), set()
    while True:
        unit = (wanted - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and unit * weight[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    for s in names:
        own = [r for r in rows if r["source"] == s]
        target = float(2 * sizes[s]) if s in full else unit * weight[s]
        assert {r["target"] for r in own} == {target} and sum(r["taken"] for r in own) == int(target)
        assert all(0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[s] for r in own)
    assert curriculum.mixed(empty).count() == 0 and curriculum.stream(curriculum.mixed(docs)).columns == docs.columns


def test_schedules_are_inverted(spark):
    shares = spark.range(101).select((F.col("id") / 100).alias("s"))
    for knots in curriculum.SCHEDULES:
        back = shares.withColumn("t", curriculum.time_of(F.col("s"), knots)).withColumn("back", curriculum.demand_at(F.col("t"), knots))
        rows = back.orderBy("s").collect()
        assert all(abs(r["back"] - r["s"]) < 1e-9 for r in rows) and [r["t"] for r in rows] == sorted(r["t"] for r in rows)


def test_numbered(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("x"), "id")
    rows = numbered(df, [F.col("x").asc(), F.col("id").asc()], "place").collect()
    assert [r["place"] for r in sorted(rows, key=lambda r: (r["x"], r["id"]))] == list(range(500))


# --- 9 language ----------------------------------------------------------------------------------------------------


def test_gradients_of_the_network():
    network = language_gru.Network.fresh(3, 4, 0)
    network.inputs, network.recurrent = [x.astype(float) for x in network.inputs], [x.astype(float) for x in network.recurrent]
    network.output, network.bias = network.output.astype(float), network.bias.astype(float)
    rng = np.random.default_rng(0)
    lengths, codes, labels = np.array([3, 5, 1, 4]), rng.integers(0, 256, (5, 4)), np.array([0, 1, 2, 1])
    inside = np.arange(5)[:, None] < lengths
    for p, g in zip(network.parameters(), network.gradients(codes, inside, labels)[1]):
        at, step = np.unravel_index(np.abs(g).argmax(), g.shape), 1e-3
        value, losses = p[at], []
        for x in (value + step, value - step):
            p[at] = x
            losses.append(network.gradients(codes, inside, labels)[0])
        p[at] = value
        assert (losses[0] - losses[1]) / (2 * step) == pytest.approx(g[at], rel=1e-2, abs=1e-5)


def test_language_of_odd_rows(spark, docs, empty):
    model = language_gru.fit(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise(F.col("lang"))))
    rows = language_gru.labelled(docs.withColumn("score", F.lit("mine")), model).collect()
    assert len(rows) == len(some_docs()) and model.languages == ["en"]
    for r in rows:
        letters = re.search(r"[^\W\d_]", r["text"] or "")
        assert r["lang_pred"] == ("en" if letters else "und") and (0 < r["score"] <= 1 if letters else r["score"] == 0)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 4 == 2)
    assert language_gru.labelled(empty, language_gru.fit(empty)).count() == 0


# --- 10 personal data ----------------------------------------------------------------------------------------------


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def brute_pii(text):
    found = []
    patterns = [
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    ]
    for order, pattern in enumerate(patterns):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = (True, all(int(x) <= 255 for x in m[0].split(".")) if order == 1 else True, 14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15)
            if good[order]:
                found.append((m.start(), order, m.end()))
    kinds = ["email", "ip", "card", "phone"]
    spans = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found))
    return *(sum(k == i for _, k, _ in found) for i in range(4)), hashlib.sha256(spans.encode()).hexdigest()


def test_personal_data_against_brute_force(spark, docs, empty):
    rng = random.Random(7)
    bits = ["a.b@c.de", "a@b.c_x@y.org", "@", "1.2.3.4", "256.1.1.1", "0255.1.2.3.4", "4111 1111-1111 1111", "4111111111111112", "+1 (555) 010-9999",
            "é日", " ", "\n", "+", "-", ".", "12", "x" * 40, "1" * 25, "card ", "00.1.2.003"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(400)]
    texts += [None, "", "x" * 50_000 + "@y.z", "1 " * 20_000, "9" * 30_000]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS).withColumn("pii", F.lit("mine"))
    assert rows_of(pii.report(df).drop("spans")) == Counter((i, *brute_pii(t)) for i, t, *_ in rows)
    assert pii.report(docs).count() == len(some_docs()) and pii.report(empty).count() == 0


def test_further_kinds_need_checks_and_context(spark):
    texts = ["my iban DE89370400440532013000 ok", "DE89370400440532013001", "social security 123-45-6789", "code 123-45-6789"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["spans"] for r in pii.report(df).collect()} == {0: "iban:8:30", 1: "", 2: "ssn:16:27", 3: ""}
    assert [r["text"] for r in pii.redacted(df).orderBy("doc_id").collect()][0] == "my iban [iban] ok"
