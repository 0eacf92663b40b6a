import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtspark.llm import decontaminate as D
from courtspark.llm import grams, jaccard_join
from courtspark.llm.graph import connected_components
from courtspark.llm.jaccard_join import jaccard_rows, one_of_each
from courtspark.llm.url_filter import url_filter


def classes(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize(("kind", "broadcast"), [("random", True), ("path", True), ("star", False), ("random", False), ("none", True)])
def test_components(spark, monkeypatch, kind, broadcast):
    monkeypatch.setattr("courtspark.llm.graph.BROADCAST_ROWS", 1000 if broadcast else 0)
    rng = random.Random(2)
    edges = {
        "random": [(rng.randrange(120), rng.randrange(120)) for _ in range(90)],
        "path": [(i, i + 1) for i in rng.sample(range(60), 55)],
        "star": [(500, i) for i in range(300)] + [(None, 3), (7, None)],
        "none": [],
    }[kind]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = classes([(a, b) for a, b in edges if a is not None and b is not None and a != b])
    assert got == {k: v for k, v in want.items()}


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(texts, k, percent):
    sets = {i: shingles(t, k) for i, t in texts}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    of = classes(links)
    return {i: (len(sets[i]), of.get(i, i)) for i in sets}


def family(rng, size, words, edits):
    base = [rng.choice("the of and to in on by") + str(rng.randrange(30)) for _ in range(words)]
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize(("k", "percent", "tile"), [(4, 85, 4096), (5, 80, 3), (2, 50, 2)])
def test_jaccard_components_are_brute_force(docs, k, percent, tile):
    rng = random.Random(k)
    texts = [t for _ in range(6) for t in family(rng, 12, rng.randrange(5, 90), 3)]
    passage = " ".join(f"shared{i}" for i in range(12))
    texts += [passage + " " + " ".join(str(rng.random()) for _ in range(rng.randrange(12))) for _ in range(30)]
    texts += ["", None, " \n\t", "one", "One", "a b", "a  B", "a b c", "x " * 3000, "x " * 2999, "y"]
    rng.shuffle(texts)
    got = {r["doc_id"]: (r["n"], r["component_id"]) for r in jaccard_rows(docs(texts), k, percent, tile=tile).collect()}
    assert got == brute(list(enumerate(texts)), k, percent)


def test_one_of_each_keeps_columns_blanks_and_one_repeat(docs):
    t = "a b c d e f g h"
    df = docs([(5, t), (5, t), (2, t.upper()), (9, ""), (9, ""), (None, "q r s"), (None, "q r s"), (3, "other words here")])
    got = one_of_each(df)
    assert got.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == [("2", t.upper()), ("3", "other words here"), ("9", ""), ("9", ""), ("None", "q r s")]
    assert one_of_each(docs([])).count() == 0


def plain_alignment(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_is_plain_smith_waterman():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 14))] for _ in range(2))
        score, start, end = D.smith_waterman(np.array(a), np.array(b))
        assert score == plain_alignment(a, b)
        assert plain_alignment(a, b[start:end]) == score


def test_edited_and_verbatim_items_are_found_and_clean_texts_left(docs, spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(15, 50)))) for i in range(20)] + [(20, None), (21, "tiny")]
    texts, planted = [], set()
    for i in range(120):
        body = [word() for _ in range(rng.randrange(0, 200))]
        if i % 3 == 0:
            k = rng.randrange(20)
            copy = items[k][1].split()
            for _ in range(len(copy) // 10 if i % 2 else 0):
                copy[rng.randrange(len(copy))] = word()
            at = rng.randrange(len(body) + 1)
            body[at:at] = copy
            planted.add((i, k))
        texts.append(", ".join(body).upper() if i % 4 == 0 else " ".join(body))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = D.decontaminate(docs(texts), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == planted
    for r in found:
        words = D._document_words(texts[r["doc_id"]].encode())[r["first_word"] : r["end_word"]]
        own = grams.word_hashes(items[r["item_id"]][1].encode(), grams.SIGNS)
        assert len(set(words.tolist()) & set(own.tolist())) >= 0.7 * len(set(own.tolist()))
    kept = D.clean(docs(texts), bench)
    assert {r["doc_id"] for r in kept.collect()} == set(range(120)) - {d for d, _ in planted}
    assert kept.columns == docs(texts).columns


def test_an_item_repeated_everywhere_is_found_everywhere(docs, spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(1, item), (2, "only once here and never again in any text")], "item_id long, text string")
    assert D.decontaminate(docs([f"x{i} {item} y{i}" for i in range(80)]), bench).count() == 80


def test_an_edited_item_repeated_everywhere_and_short_items_are_found_everywhere(docs, spark):
    words = [f"word{i}" for i in range(15)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "never anywhere in any text"), (3, "two short"), (4, "one")], "item_id long, text string")
    words[4] = words[9] = "edited"
    texts = [f"x{i} {' '.join(words)} y{i}" for i in range(3000)] + ["here are Two, short words", "two", "short two", "one"]
    found = D.decontaminate(docs(texts), bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["score"]) for r in found) == [*((i, 1, 0.8) for i in range(3000)), (3000, 3, 1.0), (3003, 4, 1.0)]
    assert [r["doc_id"] for r in D.clean(docs(texts), bench).collect()] == [3001, 3002]


def test_decontaminate_of_nulls_blocks_and_nothing(docs, spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"item {i} has these words of its own {i}") for i in range(9)], "item_id long, text string")
    monkeypatch.setattr(D, "ITEM_WORDS", 20)
    rows = [(1, None), (2, ""), (None, "item 3 has these words of its own 3"), (4, "item 8 has these words of its own 8"), (4, "item 8 has these words of its own 8")]
    assert {(r["doc_id"], r["item_id"]) for r in D.decontaminate(docs(rows), bench).where("score = 1").collect()} == {(None, 3), (4, 8)}
    assert D.decontaminate(docs([]), bench).count() == 0
    assert D.decontaminate(docs(rows), bench.limit(0)).count() == 0 and D.clean(docs(rows), bench.limit(0)).count() == 5


def test_url_classes(spark):
    pages = [
        (1, "http://a.org/x", '<link rel="canonical" href="http://b.example.com/en/1">'),
        (2, "https://b.example.com/en/1/", None),
        (3, "http://c.org/", "<meta http-equiv=refresh content='0; url=http://a.org/x'>"),
        (4, "http://d.org", "<link rel=canonical href=//www.example.com/en/>"),
        (5, "http://d.org/?utm_source=q#f", ""),
        (6, None, None),
        (7, "no host", ""),
        (8, "HTTP://X.NET/es/1?q#f", ""),
        (8, "HTTP://X.NET/es/1?q#f", ""),
        (9, "http://net/es", "<link rel=canonical href=mailto:x>"),
        (10, "http://e.org/p", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'clash' as host", "'clash' as row")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter(df, redirects=spark.createDataFrame([("http://e.org/p", "http://q.net/fr/z"), (None, "x")], "from_url string, to_url string")).collect())
    assert got == [
        (1, "a.org", "/x", None, "block"), (2, "b.example.com", "/en/1/", "example.com/en/", "block"), (3, "c.org", "/", None, "block"), (4, "d.org", "", None, "allow"),
        (5, "d.org", "/", None, "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "x.net", "/es/1", "net/es/", "block"), (8, "x.net", "/es/1", "net/es/", "block"),
        (9, "net", "/es", None, "allow"), (10, "e.org", "/p", None, "block"),
    ]
    assert url_filter(df.limit(0)).count() == 0


def test_tags_in_capitals_and_targets_relative_to_the_page_are_links(spark):
    pages = [
        (1, "http://a.org/x", '<META HTTP-EQUIV="Refresh" CONTENT="0; URL=http://b.net/es/1">'),
        (2, "http://c.org/x", '<LINK REL="Canonical" HREF="http://b.net/es/2">'),
        (3, "http://d.org/one/two/p.html?q", '<link rel="canonical" href="page2.html">'),
        (4, "http://d.org/one/two/page2.html", '<meta http-equiv="REFRESH" content="1;url=../../up/./z?k=1#f">'),
        (5, "https://d.org/up/z?k=1", '<link rel="canonical" href="http://b.net/fr/">'),
        (6, "http://e.org", '<link rel="canonical" href="f">'),
        (7, "http://e.org/f", '<link rel="canonical" href="?k=2">'),
        (8, "http://e.org/f?k=2", '<link rel="canonical" href="/../a/..//g/.">'),
        (9, "http://e.org//g/", '<link rel="canonical" href="//b.net/fr/">'),
        (10, "http://g.org/a", '<link rel="canonical" href="#top">'),
        (11, "http://g.org/b", '<link rel="canonical" href="javascript:b"><meta http-equiv=refresh content=5>'),
    ]
    got = {r["page_id"]: r for r in url_filter(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {i: got[i]["verdict"] for i in got} == {i: "block" if i < 10 else "allow" for i in range(1, 12)}
    assert got[10]["component"] == "g.org/a" and got[11]["component"] == "g.org/b"


def test_an_explicit_allow_in_a_class_takes_precedence(spark):
    link = lambda to: f'<link href="{to}" rel=canonical>'
    pages = [(1, "http://a.org/", link("http://b.org/")), (2, "http://b.org/", link("http://c.com/")), (3, "http://z.net/es/", link("http://a.org/"))]
    got = {r["page_id"]: r["verdict"] for r in url_filter(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block"}


@pytest.mark.parametrize("m", [40, 80])
def test_groups_that_nearly_link_cost_rows_in_proportion(docs, monkeypatch, m):
    from courtspark.llm import jaccard_join as J

    rng = random.Random(m)
    shared = [f"w{k}" for k in range(120)]
    texts = []
    for g in range(2):
        for k in range(m):
            own = [*shared, *(f"g{g}x{i}" for i in range(12))]
            own[rng.randrange(120)] = f"e{g}y{k}"
            texts.append(" ".join(own))
    sent, proven, made = [], [], []
    plain, tested, products = J._verified, J._unlinked, J._products

    def counted(*a, **k):
        made.append(products(*a, **k).cache())
        return made[-1]

    monkeypatch.setattr(J, "_products", counted)
    monkeypatch.setattr(J, "_verified", lambda *a: sent.append(a[-1].count()) or plain(*a))
    monkeypatch.setattr(J, "_unlinked", lambda *a: proven.append(tested(*a)) or proven[-1])
    got = {r["doc_id"]: r["component_id"] for r in J.jaccard_rows(docs(texts), 4, 85).collect()}
    sets = [{tuple(t.split()[i : i + 4]) for i in range(129)} for t in texts]
    links = [(a, b) for a in range(2 * m) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = classes(links)
    assert got == {i: want.get(i, i) for i in range(2 * m)} and set(got.values()) == {0, m}
    assert sum(sent) <= 10 * m and len(proven[0]) <= 1  # the prefixes alone may keep the groups apart
    assert sum(p.count() for p in made) <= 10 * m


def test_column_names_that_operators_use_inside(docs):
    from courtspark.llm.mixing import mix

    df = docs([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None)])
    for c in ("_id", "_hash", "id", "hash", "_key", "_n", "_source", "_rate", "_cdf", "rate", "cdf", "of_source", "times", "key", "Id"):
        df = df if c.lower() in [x.lower() for x in df.columns] else df.selectExpr("*", f"'clash' as {c}")
    kept = one_of_each(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    mixed = mix(df, budget=3.0)
    assert set(df.columns) - {"copy"} <= set(mixed.columns) and {r["_key"] for r in mixed.collect()} == {"clash"}


def test_url_filter_is_its_sql_on_pages_with_links(spark, tmp_path):
    import duckdb

    from courtspark.llm import url_filter as U

    rng = random.Random(4)
    hosts = ["example.com", "www.example.com", "a.net", "b.net", "c.org", "D.org"]
    paths = ["", "/", "/en/", "/en/x", "/es/a/b", "/fr/", "/q/../r/", "/deep/er/page"]
    links = ["http://b.net/es/", "HTTPS://c.org/q", "//a.net/fr/", "/en/x", "../up", "./same", "next?utm_source=1", "?a=1", "#top", "", "mailto:x@y", "../../..", "sub/..", "http://d.org/q/../r"]
    pages = []
    for i in range(160):
        to = rng.choice(links)
        tag = rng.choice([f'<link rel="canonical" href="{to}">', f"<LINK HREF='{to}' REL=Canonical>", f'<meta http-equiv="refresh" content="0; url={to}">', f"<META HTTP-EQUIV=Refresh CONTENT='1;URL={to}'>", "<p>none</p>"])
        pages.append((i, rng.choice([None, "no host"]) if i % 40 == 7 else f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '', '?a=1', '?ref=2', '#f'])}", None if i % 31 == 5 else f"<html>{tag}</html>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df.coalesce(1).write.parquet(str(tmp_path / "p"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/p/*.parquet'")
    got = U.url_filter(df)
    want = con.execute(f"select {', '.join(got.columns)} from ({U.SQL['op7_url_filter']})").fetchall()
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert text(got.collect()) == text(want)
    assert got.groupBy("component").count().where("component is not null and count > 3").count() >= 3


def test_a_large_group_of_near_copies_is_brute_force(docs):
    rng = random.Random(8)
    texts = [*family(rng, 250, 60, 9), *family(rng, 40, 60, 2), *[" ".join(str(rng.random()) for _ in range(30)) for _ in range(20)]]
    got = {r["doc_id"]: (r["n"], r["component_id"]) for r in jaccard_rows(docs(texts), 5, 80, tile=64).collect()}
    assert got == brute(list(enumerate(texts)), 5, 80)


def test_every_passage_of_an_item_is_reported_once(docs, spark):
    words = [f"item{i}" for i in range(12)]
    copy = [*words]
    copy[6] = "edited"
    text = " ".join(["x", *words, "y z", *copy, *words])
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    found = D.decontaminate(docs([text, text, ""]), bench).collect()
    assert sorted((r["doc_id"], r["first_word"], r["end_word"], r["score"] == 1) for r in found) == sorted((d, a, b, s) for d in (0, 1) for a, b, s in ((1, 13, True), (15, 27, False), (27, 39, True)))


@pytest.mark.parametrize(("rate", "floor"), [(0.0, 1.0), (0.1, 0.97), (0.2, 0.9)])
def test_recall_by_edit_rate(rate, floor):
    rng = random.Random(int(rate * 100))
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    items = [[word() for _ in range(rng.randrange(15, 50))] for _ in range(300)]
    bench = D.Benchmark([(i, grams.word_hashes(" ".join(w).encode(), grams.SIGNS)) for i, w in enumerate(items)])
    hits = 0
    for i, w in enumerate(items):
        copy = [word() if rng.random() < rate else x for x in w]
        text = " ".join([word() for _ in range(40)] + copy + [word() for _ in range(40)])
        hits += i in {m[0] for m in D.align(text.encode(), bench, D.THRESHOLD)}
    assert hits >= floor * len(items)


def test_very_long_texts(docs, spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    long = " ".join(f"w{i}" for i in range(120_000))
    found = D.decontaminate(docs([f"{long} {item} {long}", "y" * 2_000_000]), bench).collect()
    assert [(r["doc_id"], r["first_word"], r["end_word"]) for r in found] == [(0, 120_000, 120_010)]
    pages = spark.createDataFrame([(1, "http://a.org/" + "p/" * 50_000, "z" * 3_000_000 + "<link rel=canonical href=http://b.net/es/>")], "page_id long, url string, html string")
    assert url_filter(pages).first()["verdict"] == "block"


def test_many_redirects_are_brute_force(spark):
    """Chains, cycles, hubs and stray pairs over 12,000 addresses, against plain union and find."""
    rng = random.Random(12)
    pairs = [(i, i + 1) for i in range(0, 3000) if i % 40 != 39]
    pairs += [(3000 + i, 3000 + (i // 30) * 30 + (i + 1) % 30) for i in range(1500)]
    pairs += [(4500, 4501 + i) for i in range(2500)] + [(4501 + i, 7100) for i in range(0, 2500, 900)]
    pairs += [(rng.randrange(7200, 12000), rng.randrange(7200, 12000)) for _ in range(4500)]
    bad, good = set(rng.sample(range(12000), 300)), set(rng.sample(range(12000), 60))
    url = lambda i: f"http://s{i}.{'net/es' if i in bad else 'com' if i in good else 'org'}/p{i}"
    pages = spark.createDataFrame([(i, url(i), None) for i in range(12000)], "page_id long, url string, html string")
    redirects = spark.createDataFrame([(url(a), url(b)) for a, b in pairs], "from_url string, to_url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter(pages, redirects=redirects).collect()}
    of = classes(pairs)
    held = {}
    for i in range(12000):
        held.setdefault(of.get(i, i), set()).add(i)
    want = {}
    for members in held.values():
        blocked = any(i in bad for i in members) and not any(i in good and i not in bad for i in members)
        for i in members:
            want[i] = "block" if i in bad else "allow" if i in good else "block" if blocked else "allow"
    assert got == want


def _invented(rng):
    return "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))


@pytest.mark.parametrize(("rate", "floor"), [(0.2, 0.98), (0.25, 0.98), (0.3, 0.98)])
def test_short_items_whose_alignment_passes_are_found(rate, floor):
    """Items of 5 to 14 words, words replaced at random: those that a search of the whole text accepts."""
    rng = random.Random(int(rate * 100) + 1)
    items = [[_invented(rng) for _ in range(rng.randrange(5, 15))] for _ in range(400)]
    hashed = [grams.word_hashes(" ".join(w).encode(), grams.SIGNS) for w in items]
    bench, hits, passing = D.Benchmark(list(enumerate(hashed))), 0, 0
    for i, w in enumerate(items):
        copy = [_invented(rng) if rng.random() < rate else x for x in w]
        text = " ".join([_invented(rng) for _ in range(40)] + copy + [_invented(rng) for _ in range(40)]).encode()
        if D.smith_waterman(hashed[i], D._document_words(text))[0] >= max(len(w), D.LEAST):
            passing += 1
            hits += i in {m[0] for m in D.align(text, bench, D.THRESHOLD)}
    assert passing > 200 and hits >= floor * passing


def test_every_third_word_edited_is_found():
    words = [f"w{i}" for i in range(42)]
    bench = D.Benchmark([(7, grams.word_hashes(" ".join(words).encode(), grams.SIGNS))])
    copy = [f"edit{i}" if i % 4 == 3 else w for i, w in enumerate(words)]
    assert [m[0] for m in D.align(" ".join(copy).encode(), bench, D.THRESHOLD)] == [7]


@pytest.mark.parametrize("copies", [1, 2, 3, 5, 400])
def test_back_to_back_copies_of_an_item_that_repeats_itself(copies):
    words = "a b c d e f g h a b c d i j k l".split()
    bench = D.Benchmark([(1, grams.word_hashes(" ".join(words).encode(), grams.SIGNS))])
    found = D.align(" ".join(["x", "y", *words * copies, "z"]).encode(), bench, D.THRESHOLD)
    assert [m[2:] for m in found] == [(1.0, 2 + 16 * k, 18 + 16 * k) for k in range(copies)]


def test_frequent_runs_are_no_seeds_but_runs_of_copies_are(docs, spark):
    """What many different texts say is frequent; what one passage says in many copies is not."""
    rng = random.Random(3)
    item, told = "alpha beta of the gamma delta epsilon zeta", "this is of the"
    texts = [f"{_invented(rng)} of the {_invented(rng)}" for _ in range(300)] + [f"so {item} it"] * 300
    hashed = [(i, grams.word_hashes(t.encode(), grams.SIGNS)) for i, t in enumerate((item, told))]
    frequent = D._frequent(docs(texts).select(D.F.col("text").cast("binary").alias("text")), hashed)
    of_the = grams.gram_hashes(grams.word_hashes(b"of the", grams.SIGNS), 2)
    assert frequent[2].tolist() == of_the.tolist() and not len(frequent[3])
    seeds, _, place = D.Benchmark(hashed, frequent).seeds[2]
    assert of_the[0] not in seeds and len(seeds) == 8
    found = D.decontaminate(docs(texts), spark.createDataFrame([(0, item), (1, told)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["score"]) for r in found) == [(i, 0, 1.0) for i in range(300, 600)]


def test_rows_of_tiles_grow_with_a_block_and_not_with_its_square(spark):
    def tiled(n):
        entries = spark.range(n).selectExpr("0L as anchor", "id % 7 as gram", "10 as n", "1 as at", "0 as before", "id as row", "if(id % 3 = 0, 0L, id) as component")
        return jaccard_join._tiles(entries, spark.createDataFrame([(0, n)], "anchor long, held long"), 10)

    few, many = tiled(200), tiled(800)
    assert many.count() < 5 * few.count()
    meet = lambda x, y: F.col(f"{x}.tile") == F.col(f"{y}.tile")
    pairs = many.alias("x").join(many.alias("y"), meet("x", "y")).where("x.row < y.row and x.component <> y.component and (x.side <> y.side or x.side < 0)")
    assert pairs.select("x.row", "y.row").count() == 800 * 799 // 2 - 267 * 266 // 2


@pytest.mark.parametrize("stage", range(3))
def test_stages_hand_python_few_texts_at_a_time_and_need_no_plain_workers(spark, tmp_path, monkeypatch, docs, stage):
    """Batches of 10,000 whole texts, and a second set of workers for an empty table, took the memory of an executor."""
    import corpus_pipeline
    from courtspark.llm.common import TEXTS

    df = docs([f"w{i} " + " ".join(f"x{i % 300}y{k}" for k in range(12)) + " idiot" * (i % 9 == 0) for i in range(3 * TEXTS)], extra=False).coalesce(1)
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(3 * TEXTS)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(f"x7y{k}" for k in range(12)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    many, batches, plain = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), []
    map_in_arrow, create = type(df).mapInArrow, type(spark).createDataFrame

    def watched(self, f, *args, **kwargs):
        def run(rows):
            def seen():
                for b in rows:
                    if "text" in b.schema.names:
                        batches.add(1)
                        many.add(int(b.num_rows > TEXTS))
                    yield b

            yield from f(seen())

        return map_in_arrow(self, run, *args, **kwargs)

    def created(self, data, *args, **kwargs):
        plain.extend([type(data)] if isinstance(data, list) else [])
        return create(self, data, *args, **kwargs)

    monkeypatch.setattr(type(df), "mapInArrow", watched)
    monkeypatch.setattr(type(spark), "createDataFrame", created)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    kept = corpus_pipeline.STAGES[stage][1](spark, df, str(tmp_path)).count()
    assert 0 < kept <= 3 * TEXTS
    assert batches.value > 0 and many.value == 0 and not plain and spark.conf.get(key) == before
