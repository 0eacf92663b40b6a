import random
import re
import time

import pytest

from courtspark.llm import grams
from courtspark.llm.license_scan import WORDS as LINE_WORDS
from courtspark.llm.license_scan import Notice, Scanner, license_scan, op3_license_scan
from courtspark.llm.token_counts import TOKENIZER, _counter, token_counts

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def test_base_phrases_are_brute_force(spark, sf_dir):
    got = {r["doc_id"]: r for r in op3_license_scan(spark, sf_dir).collect()}
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        words = WORDS.findall(lower(r["text"]))
        at = [(i, k) for k, p in phrases.items() for i in range(len(words)) if words[i : i + len(p)] == p]
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"], g["base_labels"]) == (len(words), len(at), ",".join(sorted({k for _, k in at})))
        assert (g["first_word"], g["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(filter(None, g["base_labels"].split(","))) <= set(g["labels"].split(",")) and 0 <= g["score"] <= 1


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("MIT License mit license MIT LICENSE", [("mit", 0, 0), ("mit", 2, 0), ("mit", 4, 0)]),
        ("the apache licence, mit-license; permit license", [("apache", 1, 1), ("mit", 3, 0)]),
        ("GNU general publik licence", [("gpl", 1, 2)]),
        ("Permission is hereby granted, free of charge to any persons", [("mit", 0, 1)]),
        ("mit licensexyz apache licensing", []),
        ("", []),
    ],
)
def test_fuzzy_notices(text, labels):
    _, found = Scanner().spans(text.encode())
    assert sorted((n.label, w, e) for n, w, _, e in found) == sorted(labels)


def test_any_planted_edit_is_found():
    rng = random.Random(3)
    notice = Notice("x", "redistribution and use in source and binary forms", 5)
    scanner = Scanner((notice,))
    for _ in range(150):
        s = list(notice.phrase)
        for _ in range(rng.randrange(6)):
            i = rng.randrange(1, len(s) - 1)
            if s[i] != " ":
                s[i] = rng.choice("abcxyz")
        text = "noise words here " * rng.randrange(3) + "".join(s) + " more"
        _, found = scanner.spans(text.encode())
        assert len(found) == 1


def edited(rng, phrase, edits):
    """``phrase`` with up to that many bytes inserted, deleted or replaced anywhere, ends included."""
    s = list(phrase)
    for _ in range(edits):
        kind, i = rng.choice("ids"), rng.randrange(len(s) + 1)
        if kind == "i":
            s.insert(i, rng.choice("abcxyz "))
        elif i < len(s):
            s[i : i + 1] = rng.choice("abcxyz") if kind == "s" else ""
    return re.sub(" +", " ", "".join(s)).strip()


def test_edits_at_every_place_are_found_as_an_unseeded_search_finds_them():
    rng = random.Random(11)
    scanner = Scanner()
    lost = found = 0
    for k in range(3000):
        notice, _, _, fuzzy = scanner.notices[k % len(scanner.notices)]
        text = ("some noise a " * rng.randrange(3) + edited(rng, notice.phrase, notice.errors) + " and more " * rng.randrange(2)).encode()
        line = b" ".join(LINE_WORDS(text))
        want = fuzzy.search(line) is not None
        got = any(n is notice for n, *_ in scanner.spans(text)[1])
        assert got <= want
        found += want
        lost += want and not got
    assert found > 2000 and lost == 0


def test_places_and_edits_are_those_of_an_unseeded_search():
    rng = random.Random(23)
    scanner = Scanner()
    seen = 0
    for k in range(600):
        notice, _, _, fuzzy = scanner.notices[k % len(scanner.notices)]
        parts = [edited(rng, notice.phrase, rng.randrange(notice.errors + 1)) for _ in range(rng.randrange(1, 4))]
        text = "".join(f"{'quux zork vim ' * rng.randrange(4, 9)}{p} " for p in parts) + "zork quux"
        line = b" ".join(LINE_WORDS(text.encode()))
        want = []
        for m in fuzzy.finditer(line):
            want.append((line[: m.start()].count(b" "), m.group().count(b" ") + 1, sum(m.fuzzy_counts)))
        got = [(w, n, e) for x, w, n, e in scanner.spans(text.encode())[1] if x is notice]
        if len(want) == len(got) == len(parts):
            seen += 1
            assert [(w, e) for w, _, e in got] == [(w, e) for w, _, e in want], text
    assert seen > 350  # in the others an edit joined or split words at an edge


def test_many_matches_in_one_text_take_linear_time():
    scanner, took = Scanner(), []
    for n in (11_000, 88_000):
        text = b"mit licence mit license " * (n // 2)
        began = time.process_time()
        words, found = scanner.spans(text)
        took.append(time.process_time() - began)
        own = [(w, e) for x, w, _, e in found if x.label == "mit"]
        assert words == 2 * n and own == [(2 * i, 1 - i % 2) for i in range(n)]
    assert len(text) > 1_000_000 and took[1] < 20 * took[0]


def test_scan_of_nulls_repeats_and_nothing(docs):
    rows = license_scan(docs([(1, None), (1, "mit license"), (1, "mit license"), (None, "x" * 100000)])).collect()
    assert sorted((r["n_words"], len(r["matches"])) for r in rows) == [(0, 0), (1, 0), (2, 1), (2, 1)]
    assert license_scan(docs([])).count() == 0


@pytest.fixture(scope="module")
def library():
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    return P.path(TOKENIZER), sentencepiece.SentencePieceProcessor(model_file=P.path(TOKENIZER))


def test_counts_are_the_library_s(library, spark, sf_dir):
    path, sp = library
    texts = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), path).collect()}
    for i, t in texts:
        n = len(sp.encode(t))
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len(t.encode()), n > 4096)


def test_counts_of_odd_strings(library):
    path, sp = library
    count, rng = _counter(path), random.Random(5)
    for _ in range(4000):
        t = "".join(rng.choice("ab  \n\t▁é ñ漢字😀<s>0x0A\"the ing \x00　ﬁ") for _ in range(rng.randrange(40)))
        assert count(t) == len(sp.encode(t))
    for t in ("a" * 50000, " " * 3001, "<s></s><unk><0x0A>"):
        assert count(t) == len(sp.encode(t))


def test_counts_of_nulls_repeats_and_nothing(library, docs):
    rows = token_counts(docs([(1, None), (2, ""), (3, "a b"), (3, "a b")]), library[0]).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 0, 0, False), (2, 0, 0, False), (3, 3, 2, False), (3, 3, 2, False)]
    assert token_counts(docs([]), library[0]).count() == 0


def test_word_hashes_follow_words():
    rng = random.Random(1)
    known = {}
    for _ in range(200):
        text = "".join(rng.choice("ab A\t\né€") for _ in range(rng.randrange(80)))
        words = re.findall(rb"[^\x20\x09-\x0D]+", lower(text).encode())
        hashes = grams.word_hashes(text.encode()).tolist()
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes, strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_long_texts_hash_as_their_parts():
    text = (b"word " * 40000) + b"z" * 200000 + b" end"
    hashes = grams.word_hashes(text)
    assert len(hashes) == 40002 and len(set(hashes[:40000].tolist())) == 1
    assert hashes[-1] == grams.word_hashes(b"end")[0] and hashes[-2] == grams.word_hashes(b"z" * 200000)[0]
