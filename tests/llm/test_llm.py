"""Each operator against a brute-force version on a small table with nulls, empty and long texts, ties, repeats and extra columns."""

import base64
import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pitpanel.llm import bpe, components, exact_dedup, html_extract, importance, licenses, mixing, ngram_join, phrases, quality_model, quality_rules, simhash, substring, url_filter
from pitpanel.llm.fm_index import FMIndex
from pitpanel.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, label string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 6)))
    base = [" ".join(word() for _ in range(n)) for n in (3, 4, 5, 40, 60, 120, 300)]
    passage = " ".join(word() for _ in range(50))
    out = [None, "", " \t\n", "One two", "one TWO", *base]
    for b in base[3:]:
        w = b.split()
        for k in range(6):
            v = list(w)
            v[r.randrange(len(v))] = word()
            out.append(" ".join(v).upper() if k == 5 else " ".join(v))
    out += [f"{word()} {passage} {word()}" for _ in range(5)] + [base[4]] * 4 + ["go " * 200, "go " * 200 + "x", "á" * 3000, "a b c d"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None, "de"][i % 3], [None, "b", "a", "a"][i % 4], len(t or ""), 7, "x") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[8], (None, "one two", "en", "b", 7, 7, "x")], SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_equals_reference_tokenizer(docs, empty):
    import tiktoken

    ranks, pattern = tokenizer()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})
    for r in docs.select("doc_id", "text").join(bpe.round_trip(docs, ranks, pattern), "doc_id").collect():
        ids, t = enc.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t).hexdigest())
    both = bpe.decode_documents(bpe.encode_documents(docs, ranks, pattern), ranks, pattern)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in both.collect()) and both.columns[: len(docs.columns)] == docs.columns
    assert bpe.round_trip(empty, ranks, pattern).count() == 0
    v = bpe.vocabulary(ranks, pattern)
    for p in ("a" * 5000, "xyz" * 40, "é" * 70, "\x1c \x1d", "日本語" * 30, "<|endoftext|>"):
        assert list(v.encode([p])[0]) == enc.encode_ordinary(p)


def test_quality_base_counts_and_cutoffs(spark, docs, empty):
    for t in texts():
        w, s = WORD.findall(t or ""), set()
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        for i in range(len(w) - 4):
            if c[tuple(w[i : i + 5])] > 1:
                s.update(range(i, i + 5))
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert quality_rules.base_counts(t) == (len(w), sum(map(len, w)), sum((t or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(s))
    assert quality_rules.binomial_tail(2, 10, 0.3) == pytest.approx(sum(__import__("math").comb(10, i) * 0.3**i * 0.7 ** (10 - i) for i in range(3)))
    r = random.Random(1)
    good = [(i, " ".join("word" + str(r.randrange(999)) for _ in range(30)), "en", "s", 1, 1, "x") for i in range(1500)]
    bad = [(5000 + i, " ".join("w$$$" + str(r.randrange(999)) for _ in range(30)), "en", "s", 1, 1, "x") for i in range(50)]
    labels = spark.createDataFrame([(i, int(i < 5000)) for i, *_ in good + bad], "doc_id long, quality int")
    got = {x["doc_id"]: x["kept"] for x in quality_rules.judge(spark.createDataFrame(good + bad, SCHEMA), labels).collect()}
    assert all(got[i] for i in range(1500)) and not any(got[5000 + i] for i in range(50))
    none = quality_rules.judge(docs, labels.limit(0))
    assert none.count() == docs.count() and none.filter("kept = base_failed").count() == 0 and quality_rules.judge(empty, labels).count() == 0


def brute_cutoffs(stats, good):
    """The same search over plain counts, with exact fractions for the binomial tail."""
    from fractions import Fraction
    from math import comb

    strata = {}
    for r in stats:
        if r["doc_id"] in good and r["n_words"] >= 10 and 100 * r["n_repeat_words"] <= 20 * r["n_words"]:
            strata.setdefault(r["lang"], {})[r["doc_id"]] = r
    out = {}
    for lang, rows in strata.items():
        out[lang] = {}
        for rule, (over, under, sign, grid) in quality_rules.RULES.items():
            for c in grid:
                hit = sum((100 * r[over] > c * r[under]) if sign > 0 else (100 * r[over] < c * r[under]) for r in rows.values())
                n, p = len(rows), Fraction(5, 100) / len(quality_rules.RULES)
                tail = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(hit + 1)) if hit < 60 else 1
                if tail > Fraction(5, 100) / (len(quality_rules.RULES) * len(strata)):
                    break
                out[lang][rule] = c
    return out


def test_quality_verdicts_equal_a_plain_search(spark):
    r = random.Random(8)
    rows = []
    for i in range(2600):
        lang = ("en", "de", None)[i % 3 if i < 2400 else 0]
        n, noise = r.randint(12, 40), r.random() < 0.004
        words = ["w" * r.randint(2, 9) + str(r.randrange(999)) + ("$$" if noise or r.random() < 0.01 else "") for _ in range(n)]
        rows.append((i, " ".join(words) + ("\nsame line here\nsame line here" if r.random() < 0.01 else ""), lang, "s", 1, 1, "x"))
    rows += rows[:40]  # repeated rows are one document's evidence
    docs, good = spark.createDataFrame(rows, SCHEMA), {i for i in range(2600) if i % 4}
    labels = spark.createDataFrame([(i, 1) for i in good] + [(i, 0) for i in range(0, 2600, 4)], "doc_id long, quality int")
    stats = [x.asDict() for x in quality_rules.statistics(docs).collect()]
    limits = brute_cutoffs(stats, good)
    assert limits["en"] and any(limits[k] != limits["en"] for k in limits)
    want = {}
    for x in stats:
        base = x["n_words"] < 10 or 100 * x["n_repeat_words"] > 20 * x["n_words"]
        hit = any((100 * x[o] > limits[x["lang"]][k] * x[u]) if sign > 0 else (100 * x[o] < limits[x["lang"]][k] * x[u]) for k, (o, u, sign, _) in quality_rules.RULES.items() if k in limits[x["lang"]])
        want[x["doc_id"]] = not base and not hit
    got = quality_rules.judge(docs, labels).collect()
    assert len(got) == len(rows) and {x["doc_id"]: x["kept"] for x in got} == want and 0 < sum(want.values()) < len(want)


def test_urls_judged_as_plain_python_does(spark):
    r = random.Random(3)
    part = lambda *xs: r.choice(xs)
    urls = [part("http://", "https://", "", "x://y://") + part("", "www.", "a.b.") + part("example", "notexample", "EXAMPLE", "x") + part(".com", ".net", ".org", ".com.evil.org") + part("", "/", "/en/", "/EN/", "/es/1", "/fr", "/fr/x") + part("", "?q=/es/", "#t") for _ in range(400)]

    def plain(url):
        host = path = ""
        if "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split(r"[/?#]", rest, maxsplit=1)[0]
            path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
            host = host.translate(LOW)
        fit = [rule for rule, _ in url_filter.RULES if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith(rule[rule.index("/") :])]
        return host, path, max(fit, key=len, default=None)

    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    for x in got:
        host, path, rule = plain(urls[x["page_id"]])
        assert (x["host"], x["path"], x["rule"]) == (host, path, rule)
        assert x["verdict"] == (dict(url_filter.RULES)[rule] if rule else "block" if x["block_score"] >= 0.5 else "allow")


def test_url_model_on_held_out_labels(spark):
    from pitpanel.llm import url_labels

    rows = url_labels.table(spark).withColumn("held", F.crc32(F.concat("host", "path").cast("binary")) % 5 == 0).persist()
    held = rows.filter("held").withColumn("url", F.concat(F.lit("http://"), "host", "path")).withColumn("page_id", F.monotonically_increasing_id())
    got = url_filter.judge(held, (), rows.filter("not held")).join(held.select("page_id", "label"), "page_id").toPandas()
    assert len(got) > 300 and ((got.verdict == "block") == (got.label == 1)).mean() > 0.9


def walked(trees, row):
    """The probability that a plain walk from node to node gives."""
    total = trees.base
    for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf, strict=True):
        node = 0
        for _ in range(quality_model.DEPTH):
            node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
        total += leaf[node - (2**quality_model.DEPTH - 1)]
    return 1 / (1 + np.exp(-total))


def test_trees_walk_as_a_plain_loop_does():
    r = np.random.default_rng(6)
    x, y = r.normal(size=(400, 5)), r.integers(0, 2, 400).astype(float)
    y[x[:, 0] + x[:, 3] > 0.5] = 1
    trees = quality_model.fit(x, y)
    for row, p in zip(x[:60], trees.probability(x[:60]), strict=True):
        assert p == pytest.approx(walked(trees, row))
    assert ((trees.probability(x) >= 0.5) == (y == 1)).mean() > 0.8


def test_training_rows_are_bounded_by_ids(spark):
    docs = spark.createDataFrame([(i % 2 + 3, f"word {i}") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (4, 0), (3, 0)], "doc_id long, quality int")
    seen = []
    fit = quality_model.fit
    quality_model.fit = lambda x, y: seen.append(len(x)) or fit(x, y)
    try:
        quality_model.train(docs, labels)
    finally:
        quality_model.fit = fit
    assert seen[0] <= 2


def test_url_rules_and_model(spark):
    urls = ["http://A.example.com/de/1?x", "https://example.com/en/", "https://www.example.com/en/2#t", "http://x.net/es/1", "http://x.org/de/4", "nothing", None, "http://com", "http://spam.org/en/9"]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, host int")
    r = {x["page_id"]: x for x in url_filter.judge(pages).collect()}
    assert [r[i]["rule"] for i in range(9)] == ["com/", "example.com/en/", "www.example.com/en/", "net/es/", None, None, None, None, None]
    assert (r[0]["host"], r[0]["path"], r[0]["verdict"], r[5]["host"], r[7]["path"]) == ("a.example.com", "/de/1", "allow", "", "")
    assert r[4]["verdict"] in ("allow", "block") and url_filter.judge(pages.limit(0)).count() == 0
    labelled = spark.createDataFrame([(f"shop{i}.org", "/a", 0) for i in range(30)] + [(f"casino{i}.org", "/a", 1) for i in range(30)], "host string, path string, label int")
    q = spark.createDataFrame([(1, "http://casino77.org/a"), (2, "http://shop88.org/a")], "page_id long, url string")
    assert {x["page_id"]: x["verdict"] for x in url_filter.judge(q, (), labelled).collect()} == {1: "block", 2: "allow"}


def test_url_model_learns_names_not_languages(spark):
    bad = ["poker-king", "bestpills", "super-bets", "adult-cams", "payday-cash"]
    good = ["thersh", "city-library", "oak-garden", "ththon", "melodan"]
    frames = [(s, end, lang) for s in ("", "www.", "m.") for end in ("com", "net", "org") for lang in ("en", "de", "es", "fr")]
    rows = [(f"{i}", f"https://{s}{name}.example.{end}/{lang}/{i * 37 + 5}") for i, (name, (s, end, lang)) in enumerate((n, f) for n in bad + good for f in frames)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id string, url string"), ()).collect()
    wrong = Counter(any(b in r["host"] for b in bad) for r in got if (r["verdict"] == "block") != any(b in r["host"] for b in bad))
    assert len(got) == 360 and max(wrong[True], wrong[False]) <= 18, wrong  # 10 % of either kind
    first = url_filter.judge(spark.createDataFrame(rows[-1:] + [("a", f"http://x{i}.net/es/1") for i in range(50)], "page_id string, url string"))
    alone = url_filter.judge(spark.createDataFrame(rows[-1:], "page_id string, url string"))
    assert first.filter("page_id <> 'a'").collect() == alone.collect()  # URLs that rules decide teach nothing


def test_classifier(spark, docs, empty):
    r = random.Random(2)
    rows = [(i, " ".join(("w" + str(r.randrange(99))) + ("$$$" if i % 3 == 0 else "") for _ in range(r.randint(5, 40))), "en", "s", 1, 1, "x") for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(900)], "doc_id long, quality int")
    got = quality_model.classify(spark.createDataFrame(rows, SCHEMA), labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert 200 < len(held) < 400 and (held.predicted == held.quality).mean() > 0.97 and got.score.between(0, 1).all()
    one = quality_model.classify(docs, labels.filter("quality = 1"))
    assert one.count() == docs.count() and one.filter("score is null").count() == 0 and quality_model.classify(empty, labels).count() == 0
    assert quality_model.keep_good(docs, labels).columns == docs.columns


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if all(label[label[i]] == label[i] for i in label):
            break
    return sets, label


@pytest.mark.parametrize(("frequent", "large"), [(16, 64), (2, 3)])
def test_ngram_join_finds_every_link(docs, empty, monkeypatch, frequent, large):
    monkeypatch.setattr(ngram_join, "LEAST_FREQUENT", frequent)  # with 2 and 3 all copies go through combinations and pivots
    monkeypatch.setattr(ngram_join, "LARGE", large)
    monkeypatch.setattr(ngram_join, "HOT", 4096 if large == 64 else 4)  # with 4 entries of copies are dealt out by node
    rows = [(r["doc_id"], r["text"]) for r in docs.filter("doc_id is not null").select("doc_id", "text").distinct().collect()]
    sets, label = brute_components(rows)
    got = ngram_join.near_groups(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), label[r["doc_id"]])
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [3]
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(label.values())
    assert ngram_join.near_groups(empty).count() == 0


def test_index_entries_share_one_in_both_prefixes():
    r = np.random.default_rng(4)
    frequent = np.unique(r.integers(0, 2**32, 400).astype(np.uint32))
    known = ngram_join.Frequent(frequent, frequent[::3])
    pool = (frequent.astype(np.uint64) << np.uint64(32)) | r.integers(0, 2**32, len(frequent)).astype(np.uint64)
    pairs = 0
    for _ in range(600):
        n, rare = int(r.integers(2, 200)), int(r.integers(0, 60))
        a = np.unique(np.concatenate((r.choice(pool, min(n, 390), False), r.integers(0, 2**63, rare).astype(np.uint64))))
        d = int(r.integers(0, ngram_join.may_differ(len(a)) + 1))
        b = np.unique(np.concatenate((r.permutation(a)[d:], r.integers(0, 2**63, int(r.integers(0, 4))).astype(np.uint64))))
        shared = len(np.intersect1d(a, b))
        assert ngram_join.bits_differ(ngram_join.bitmap(a), ngram_join.bitmap(b)) <= len(a) + len(b) - 2 * shared
        if 100 * shared >= 80 * (len(a) + len(b) - shared) and len(b) > 1 and not np.array_equal(a, b):
            assert shared >= (need := ngram_join.overlap(len(a), len(b)))
            sides = [dict(zip(*(x.tolist() for x in ngram_join.index_entries(x, known)[:2]), strict=True)) for x in (a, b)]
            assert any(sides[0][e] <= len(a) - need and sides[1][e] <= len(b) - need for e in sides[0].keys() & sides[1].keys())
            pairs += 1
    assert pairs > 200


def test_keep_one_with_repeated_and_null_ids(spark):
    words = [f"w{i}" for i in range(60)]
    text, near, other = " ".join(words), " ".join([*words[:59], "x"]), " ".join(reversed(words))
    rows = [(1, text, "en", "s", 1, 1, "x"), (1, other, "en", "s", 1, 1, "x"), (2, near, "en", "s", 1, 1, "x"), (1, text, "de", "s", 1, 1, "x"), (None, near + " y", "en", "s", 1, 1, "x"), (None, "only this", "b", "s", 1, 1, "x"), (None, "only this", "a", "s", 1, 1, "x"), (5, "", "en", "s", 1, 1, "x"), (5, "", "en", "s", 1, 1, "x"), (None, None, "en", "s", 1, 1, "x")]
    clash = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("n_chars", "keep_id").withColumnRenamed("node", "_keep").withColumnRenamed("source", "hash")
    got = ngram_join.keep_one(clash)
    assert got.columns == clash.columns
    assert sorted(((r["doc_id"], r["text"], r["lang"]) for r in got.collect()), key=repr) == sorted([(1, text, "de"), (1, other, "en"), (None, "only this", "a"), (5, "", "en"), (5, "", "en"), (None, None, "en")], key=repr)
    assert ngram_join.keep_one(clash.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_mixing_targets_and_thresholds(docs, empty):
    got = mixing.mix_sources(docs).collect()
    src = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes = Counter()
    for r in got:
        sizes[src[r["doc_id"]]] += r["size"]
    order = [*sorted(s for s in sizes if s is not None), *([None] if None in sizes else [])]
    weight, total, left = {s: i % 3 + 1.0 for i, s in enumerate(order)}, float(sum(sizes.values())), dict(sizes)
    target, open_, rest = {}, set(order), total
    while open_:
        over = {s for s in open_ if rest * weight[s] / sum(weight[x] for x in open_) > 3 * sizes[s]}
        if not over:
            target |= {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        open_, rest = open_ - over, rest - sum(3 * sizes[s] for s in over)
    taken, biggest = Counter(), Counter()
    for r in got:
        s = src[r["doc_id"]]
        taken[s] += r["taken"]
        biggest[s] = max(biggest[s], 2 * r["size"])
        assert r["target"] == pytest.approx(target[s]) and r["source_size"] == left[s] and 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= biggest[s] for s in order)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_sources(docs.repartition(5)).collect()), key=repr)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.select(F.sum(mixing.word_count())).first()[0] == sum(taken.values()) and mixing.mix_sources(empty).count() == 0


def brute_windows(rows):
    words = [WORD.findall(t or "") for _, t in rows]
    c = Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {j for k in range(len(w) - 34) if c[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [5_000, 2])
def test_substring_dedup(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(substring, "LEAST_HOT", hot)  # with 2 every searched anchor's windows travel alone
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r)[:4] for r in substring.remove_repeats(docs).collect()), key=repr) == brute_windows(rows)
    assert substring.remove_repeats(empty).count() == 0


def test_fm_index_matching_statistics():
    r = np.random.default_rng(1)
    seqs = [r.integers(0, 3, int(n)).astype(np.uint64) for n in r.integers(5, 60, 12)]
    weights = r.integers(1, 4, 12)
    index = FMIndex(seqs, weights)
    count = lambda p: sum(int(w) for s, w in zip(seqs, weights, strict=True) for k in range(len(s) - len(p) + 1) if np.array_equal(s[k : k + len(p)], p))
    for s in seqs:
        ends = np.arange(1, len(s) + 1)
        got = index.longest(index.codes(s), ends, np.minimum(ends, 40))
        for e, n in zip(ends, got, strict=True):
            assert (n == 0 or count(s[e - n : e]) >= 2) and (n == min(e, 40) or count(s[e - n - 1 : e]) < 2)


def test_segments_are_named_by_their_words():
    r = np.random.default_rng(2)
    texts = [r.integers(0, 2**63, n).astype(np.uint64) for n in (300, 0, 20, 90, 35)]
    texts[3][5:85] = texts[0][100:180]
    counts = np.array([len(t) for t in texts])
    words = substring.Words(np.concatenate(texts), counts)
    assert words.names(np.array([100]), np.array([140]))[0] == words.names(np.array([325]), np.array([365]))[0] != words.names(np.array([325]), np.array([366]))[0]
    found = substring.Segments(words)
    for text, first, last, anchor in zip(found.text, found.first - words.begins[found.text], found.last - words.begins[found.text], found.anchor, strict=True):
        for w in range(first, last):  # each window's anchor is the least name of its 8-word runs
            at = words.begins[text] + w + np.arange(28)
            assert w + 35 <= counts[text] and words.names(at, at + 8).min() == anchor
    assert sum(found.last - found.first) == (300 - 34) + (90 - 34) + 1 and set(found.text) == {0, 3, 4}


def test_exact_groups(docs, empty):
    groups = {}
    for r in docs.collect():
        groups.setdefault((r["text"] or "").translate(LOW), []).append(r["doc_id"])
    for r in exact_dedup.exact_groups(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        g = groups[(r["text"] or "").translate(LOW)]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(x for x in g if x is not None), len(g), r["doc_id"] == max(x for x in g if x is not None))
        assert r["text_sha256"] == hashlib.sha256((r["text"] or "").translate(LOW).encode()).hexdigest()
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups) and exact_dedup.exact_groups(empty).count() == 0


def test_exact_lookup_decides(docs, monkeypatch):
    want = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(docs).collect()}
    look_up = exact_dedup.look_up
    none = lambda batch, history: look_up(batch.limit(0), history).unionByName(batch.select("digest", "keep_id", "n", F.lit(False).alias("member")))
    monkeypatch.setattr(exact_dedup, "look_up", none)
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(docs).collect()} != want


def test_exact_history_is_a_table_and_batches_move_it_on(spark, tmp_path):
    rows = lambda ids: exact_dedup.summed(spark.createDataFrame([(hashlib.sha256(b"%d" % (i % 50)).digest(), i) for i in ids], "digest binary, keep_id long"), 7)
    exact_dedup.build_history(rows(range(40))).write.parquet(str(tmp_path / "history"))
    found = exact_dedup.look_up(rows(range(40, 200)), spark.read.parquet(str(tmp_path / "history"))).collect()
    member = {bytes(r["digest"]): (r["keep_id"], r["n"]) for r in found if r["member"]}
    assert member == {hashlib.sha256(b"%d" % k).digest(): (150 + k, 4) for k in range(40)}
    assert {bytes(r["digest"]) for r in found if not r["member"]} == {hashlib.sha256(b"%d" % k).digest() for k in range(40, 50)}


def test_deduplicate_clashing_names_and_total_order(spark):
    rows = [(1, "A b", "en", "s", 1, 1, "x"), (2, "a B", "en", "s", 1, 1, "x"), (2, "a b", "de", "s", 1, 1, "x"), (None, "a b", "aa", "s", 1, 1, "x"), (None, "c", "y", "s", 1, 1, "x"), (None, "C", "x", "s", 1, 1, "x"), (7, None, "en", "s", 1, 1, "x"), (6, "", "en", "s", 1, 1, "x")]
    clash = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"n_chars": "digest", "node": "_keep", "source": "id", "label": "row"})
    got = exact_dedup.deduplicate(clash)
    assert got.columns == clash.columns
    assert sorted(((r["doc_id"], r["text"], r["lang"]) for r in got.collect()), key=repr) == sorted([(2, "a B", "en"), (None, "C", "x"), (7, None, "en")], key=repr)
    assert exact_dedup.deduplicate(clash.limit(0)).count() == 0


def test_perfect_hash_is_minimal_and_checks_bytes():
    keys = np.random.default_rng(3).integers(0, 2**63, (5000, 4)).astype(np.uint64)
    seeds, slots = exact_dedup.build_table(keys)
    assert sorted(slots.tolist()) == list(range(5000)) and np.array_equal(exact_dedup.find_slots(keys, seeds, 5000), slots)


def test_licenses(spark, docs, empty):
    rows = [(1, "Some prose.\nReleased under the MIT License.\nMore", "en", "s", 1, 1, "x"), (2, "This work is licensed under the GNU General Public License, version 3. And prose goes on.", "en", "s", 1, 1, "x"), (3, "The license of poets", "en", "s", 1, 1, "x")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1]["license"], got[1]["dice"], got[2]["license"], got[3]["license"], got[3]["n_licenses"]) == ("MIT", 1.0, "GPL-3.0", None, 0)
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.LEAST_DICE)
    for _, _, notice in licenses.TEMPLATES:  # size bounds drop no notice that reaches the threshold
        g = licenses.bigrams(notice)
        best = max(2 * len(g & t) / (len(g) + len(t)) for _, _, t in scanner.templates)
        assert scanner.best(g)[0] == best
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(empty).count() == 0


def test_licenses_wrapped_embedded_and_texts():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.LEAST_DICE)
    named = lambda text: [x[0] for x in scanner.scan(text)]
    for name, _, notice in licenses.TEMPLATES:
        words = notice.split()
        for mark in (" * ", "# ", "// ", "REM "):
            block = "\n".join(mark + " ".join(words[k : k + 6]) for k in range(0, len(words), 6))
            assert named(f"Prose about poets and other things\n{block}\nint main and so on") == [name], (name, block)
    got = scanner.scan("This dataset is released under the MIT License and may be reused. " + "Other words go on here. " * 50)
    assert [(x[0], x[2], x[3]) for x in got] == [("MIT", 1.0, "released under the MIT License")]
    assert named("Words.\nLicensed under CC BY-NC-SA 3.0.\n") == ["CC-BY-NC-SA-3.0"]
    assert named("GNU LESSER GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n  This version of the GNU Lesser General Public License incorporates\nthe terms and conditions of version 3 of the GNU General Public\nLicense, supplemented by the additional permissions listed below.\n\n 0. Additional Definitions.") == ["LGPL-3.0"]
    assert named("all rights " * 3000) == [] == named("The license of the work is under the terms of poets")


def test_license_windows_equal_every_window():
    """The best coefficient of any run of words, found by trying them all."""
    r = random.Random(12)
    templates = [t for t in licenses.TEMPLATES if len(t[2].split()) <= 14]
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.LEAST_DICE)
    hit = 0
    for _ in range(40):
        name, _, notice = r.choice(templates)
        words = notice.split()
        for _ in range(r.randrange(3)):
            words[r.randrange(len(words))] = "zebra"
        text = " ".join(["alpha", "beta", "gamma", *words, "delta", "of", "the", "license", "omega"])
        plain = re.findall(r"[a-z0-9]+", text.lower())
        best = {}
        for t_name, _, t in templates:
            grams = licenses.bigrams(t)
            for i in range(len(plain)):
                for j in range(i + 2, len(plain) + 1):
                    own = set(zip(plain[i:j], plain[i + 1 : j]))
                    dice = 2 * len(own & grams) / (len(own) + len(grams))
                    if dice >= licenses.LEAST_DICE and dice > best.get(t_name, 0):
                        best[t_name] = dice
        got = {x[0]: x[2] for x in scanner.scan(text)}
        assert bool(got) == bool(best) and got.keys() <= best.keys(), (text, got, best)
        if best:
            assert max(got.values()) == pytest.approx(max(best.values())), (text, got, best)
            hit += 1
    assert 10 < hit < 40


def test_html(spark):
    page = '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy</div><!-- x --><article><h1>Big &amp; small</h1><p>One\n  two<br>three <b>four</b></p><p>Five<p>Six</article><div id="comments"><p>No!</p></div><footer>&copy; me</footer></body>'
    assert html_extract.main_text(page) == "Big & small\nOne two three four\nFive\nSix"
    prose = "This is a longer paragraph of the article which says several things in a row. " * 2
    plain = f'<body><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul><div class="cookie-notice">Accept?</div><div><p>{prose}</p><p>Short.</p><p>{prose}</p></div><aside>Side</aside><form>Mail</form></body>'
    assert html_extract.main_text(plain) == f"{prose.strip()}\nShort.\n{prose.strip()}"
    pages = spark.createDataFrame([(1, "u", page, "t"), (2, None, None, "t"), (3, "u", "", "t"), (None, "u", "<p>", "t")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract(pages).collect()}
    assert got[2] == got[3] == got[None] == ("", 0) and got[1][1] == len(got[1][0]) and html_extract.extract(pages.limit(0)).count() == 0
    assert html_extract.main_text("<article>" + "<p>x &lt; y</p>" * 3) == "x < y\nx < y\nx < y" == html.unescape("x &lt; y\nx &lt; y\nx &lt; y")


def test_html_skipped_elements_leave_no_state():
    prose = "This is a longer paragraph of the page which says several things in a row. " * 2
    for skipped in ('<a class="skip-link" href="#c">Skip</a>', '<article class="related"><p>Other</p></article>', '<article class="comment"><p>Me too</p></article>'):
        assert html_extract.main_text(f"<body>{skipped}<div><p>{prose}</p><p>{prose}</p></div></body>") == f"{prose.strip()}\n{prose.strip()}"


def test_html_names_and_thresholds_lose_no_article():
    prose = "This is a longer paragraph of the article which says several things in a row. " * 2
    for page in (
        f'<div class="container has-sidebar"><p>{prose}</p><div class="sidebar">Other</div></div>',
        f'<article class="post comments-open"><p>{prose}</p><div id="comments"><div class="comment">{prose}</div><div class="comment">{prose}</div></div></article>',
        f'<div class="with-comments"><nav>Home</nav><article><p>{prose}</p></article></div><div id="comments"><p>{prose * 9}</p></div>',
        f'<form id="page"><div class="search-page no-sidebar"><h1>{prose}</h1></div><ul class="related"><li><a href="/x">{prose}</a></li></ul></form>',
    ):
        assert html_extract.main_text(f"<body>{page}</body>") == prose.strip()
    assert html_extract.main_text("<body><ul><li><a href='/a'>Home</a></li></ul><div class='share'>Go</div><div><p>短い記事です。</p><p>Brief.</p></div></body>") == "短い記事です。\nBrief."
    linked = f"Read <a href='/b'>{prose.strip()}</a> too."
    got = html_extract.main_text(f"<p>{prose}</p><p>{linked}</p><p><a href='/c'>All of it</a></p><p>{prose}</p><p>{linked}</p><ul><li><a href='/d'>Home</a></li></ul>")
    assert got.split("\n") == [prose.strip(), f"Read {prose.strip()} too.", "All of it", prose.strip(), f"Read {prose.strip()} too."]


def test_texts_longer_than_a_slice(spark):
    """5 million characters: two copies, one near copy, and short texts around them."""
    r = random.Random(9)
    words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(1_000_000)]
    long = " ".join(words)
    near = " ".join([*words[:-3], "x", "y", "z"])
    docs = spark.createDataFrame([(1, long), (2, "short one"), (3, long), (4, near), (5, None), (6, "short two")], "doc_id long, text string").repartition(1)
    assert {x["doc_id"]: x["component_id"] for x in ngram_join.near_groups(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 1, 5: 5, 6: 6}
    assert {x["doc_id"]: x["keep_id"] for x in exact_dedup.exact_groups(docs).collect()} == {1: 3, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6}
    got = {x["doc_id"]: (x["n_words"], x["n_removed"]) for x in substring.remove_repeats(docs).collect()}
    assert got == {1: (1_000_000, 1_000_000), 2: (2, 0), 3: (1_000_000, 1_000_000), 4: (1_000_000, 999_997), 5: (0, 0), 6: (2, 0)}
    assert {x["doc_id"]: x["n_words"] for x in quality_rules.statistics(docs.withColumn("lang", F.lit("en"))).collect()}[4] == 1_000_000


def test_pipeline_on_empty_null_and_repeated_rows(spark, tmp_path):
    import corpus_pipeline as c

    text = " ".join(f"word{i} of a quiet text about gardens and rivers" for i in range(12))
    rows = [(1, text, "en", "a", len(text)), (1, text, "en", "a", len(text)), (2, text.upper(), "en", "b", len(text)), (None, text + " more", "en", None, 1), (3, None, None, "a", None), (4, "", "en", "a", 0), (5, "Another plain text that stands alone in this table of ours.", "de", None, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels = spark.createDataFrame([(1, 1), (4, 0), (77, 1)], "doc_id long, quality int")
    for name, some in (("rows", rows), ("empty", [])):
        sf = str(tmp_path / name)
        docs = spark.createDataFrame(some, schema).withColumn("_keep", F.lit(1)).withColumn("row", F.lit("r")).withColumn("digest", F.lit("d"))
        docs.write.parquet(f"{sf}/documents.parquet")
        labels.write.parquet(f"{sf}/labels.parquet")
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        for _, stage in c.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns
            docs = out.persist()
            docs.count()
        assert c.run(spark, sf).count() == c.STAGES[-1][1](spark, docs, sf).count()
        if not some:
            assert docs.count() == 0


def test_pipeline_stages(spark, tmp_path):
    import duckdb
    import tiktoken

    import corpus_pipeline as c
    from pitpanel.llm.queries import ORACLES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start, previous = docs, docs.count()
    assert [n for n, _ in c.STAGES][2] == "n-gram Jaccard join" and len(c.STAGES) == 5
    for i, (_, stage) in enumerate(c.STAGES):
        out = stage(spark, docs, sf).persist()
        if i < 4:
            assert out.columns == start.columns
        if i == 0:  # every tree walked node by node
            trees = quality_model.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            good = [r["doc_id"] for r in docs.collect() if walked(trees, quality_model.statistics(r["text"])) >= 0.5]
            assert sorted(good) == sorted(r["doc_id"] for r in out.collect()) and 0 < len(good) < previous
        if i == 3:  # the mix in SQL, each document as often as its words are taken
            docs.write.parquet(str(tmp_path / "kept"))
            con = duckdb.connect()
            con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/kept/*.parquet'")
            cur = con.execute(ORACLES["op6_mixing"])
            names = [d[0] for d in cur.description]
            want = Counter({r["doc_id"]: r["taken"] // r["size"] if r["size"] else 1 for r in (dict(zip(names, x, strict=True)) for x in cur.fetchall())})
            assert +want == Counter(r["doc_id"] for r in out.collect())
        if i == 4:  # the public library's ids
            ranks, pattern = tokenizer()
            enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})
            assert sorted((r["doc_id"], enc.encode_ordinary(r["text"] or "")) for r in docs.collect()) == sorted((r["doc_id"], list(r["ids"])) for r in out.collect())
        if i == 1:
            keep = {}
            for r in docs.collect():
                k = (r["text"] or "").translate(LOW)
                keep[k] = max(keep.get(k, -1), r["doc_id"])
            assert sorted(keep.values()) == sorted(r["doc_id"] for r in out.collect())
        if i == 2:
            _, label = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
            assert sorted(set(label.values())) == sorted(r["doc_id"] for r in out.collect())
        assert i == 3 or out.count() <= previous
        docs, previous = out, out.count()
    assert c.run(spark, sf).count() == previous and docs.filter("n_tokens <> size(ids)").count() == 0


def test_html_windows_find_the_text_without_marks():
    import pyarrow.parquet as pq

    for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        marked = r["html"] or ""
        stripped = re.sub(r"<(/?)article", r"<\1div", marked)
        inside = re.sub(r"(?s)^.*?<article>|</article>.*$", "", marked)
        lines = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " ")))).strip() for x in re.split(r"</?(?:p|h1)>", inside)]
        assert html_extract.main_text(marked) == html_extract.main_text(stripped) == "\n".join(x for x in lines if x)


def test_html_edges_comments_and_controls():
    prose, talk = "A longer paragraph which says several things about its matter. " * 2, "I do not agree with any of this at all. " * 12
    p, t = prose.strip(), talk.strip()
    refs = "".join(f"<p><a href='{i}'>Reference {i}</a></p>" for i in range(4))
    named = "\n".join(f"Reference {i}" for i in range(4))
    for page, text in (
        (f"<article><p>{p}</p><section id='user-comments'><p>{t}</p><p>{t}</p></section></article>", p),
        (f"<div><h1>T</h1><p>{p}</p></div><div class='comments'><p>{t}</p><article><p>{t}</p></article></div>", f"T\n{p}"),
        (f"<div class='post comments-open has-comments'><h1>T</h1><p>{p}</p></div>", f"T\n{p}"),
        (f"<main><h1>T</h1><p>{p}</p></main><section><h3>More</h3><article><h3>Other story</h3><p>Teaser.</p></article></section>", f"T\n{p}"),
        (f"<article><p>{p}</p>{refs}<p>Short end.</p></article>", f"{p}\n{named}\nShort end."),
        (f"<div><p>{p}</p>{refs}<p>Short end.</p></div>", f"{p}\n{named}\nShort end."),
        ("<article><p>We have <math><mi>x</mi> = 2</math> here, <label>noted</label> and <button>pressed</button>.</p><button>Share</button></article>", "We have x = 2 here, noted and pressed."),
        (f"<div><h3>Popular posts</h3><ul><li><a href='1'>One</a></li></ul></div><div><p>{p}</p><p>{p}</p><p>Er the.</p></div><div>Copyright 2020</div>", f"{p}\n{p}\nEr the."),
    ):
        assert html_extract.main_text(f"<body>{page}</body>") == text


def features_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def test_importance_resampling(docs, empty, spark):
    target = spark.createDataFrame([("go go Stop 5 é",), (None,), ("a b c",)], "text string")
    rows = docs.collect()
    found = [(r["doc_id"], *features_of(r["text"])) for r in rows]
    goal = Counter(b for r in target.collect() for b in features_of(r["text"])[1])
    have = Counter(b for _, _, f in found for b in f)
    s_all, t_all = sum(have.values()) + 10000, sum(goal.values()) + 10000
    gain = lambda b: math.floor(1000 * math.log((goal[b] + 1) * s_all / ((have[b] + 1) * t_all)))

    def score(doc_id, f):
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        return sum(map(gain, f)), sum(map(gain, f)) + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))

    for percent in (5, 40):
        enough = sorted((-score(i, f)[1], i) for i, n, f in found if n >= 20)
        ranks = sorted((i, k + 1) for k, (_, i) in enumerate(enough[: percent * len(enough) // 100]))
        got = importance.resample(docs, target, percent=percent).collect()
        assert sorted((r["doc_id"], r["rank"]) for r in got if r["rank"]) == ranks and (percent == 5 or ranks)
        assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == Counter((i, len(f), *score(i, f)) for i, _, f in found)
    assert importance.resample(empty, target).count() == 0 and importance.resample(docs, target.limit(0)).count() == len(rows)
    buckets = np.sort(np.array([0, 0, 300, 9999, 256]))
    assert np.array_equal(importance.unpack(importance.pack(buckets)), buckets) and len(importance.unpack(importance.pack(buckets[:0]))) == 0
    long = "w" + " w" * 250_000
    assert importance.grams(long)[1] == 250_001 and len(importance.grams(long)[0]) == 3 * 250_001 - 3


def simhash_of(text):
    words = [w.translate(LOW) for w in WORD.findall(text or "")]
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked_by_bits(prints):
    """The least id that chains of links lead to, for (id, fingerprint) rows; null ids name no component."""
    label = list(range(len(prints)))
    for i, (_, x) in enumerate(prints):
        for j, (_, y) in enumerate(prints[:i]):
            if (x ^ y).bit_count() <= 3 and label[i] != label[j]:
                label = [label[j] if a == label[i] else a for a in label]
    least = {a: min((d for (d, _), b in zip(prints, label, strict=True) if a == b and d is not None), default=None) for a in set(label)}
    return Counter((d, f"{x:016x}", least[a]) for (d, x), a in zip(prints, label, strict=True))


def test_simhash(docs, empty):
    prints = [(r["doc_id"], simhash_of(r["text"])) for r in docs.collect()]
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_fingerprints(docs).collect())
    assert got == linked_by_bits(prints) and simhash.near_fingerprints(empty).count() == 0


def test_simhash_grid_loses_no_link(spark):
    r = random.Random(3)
    prints = [0, 7, 15, (1 << 64) - 1]
    for _ in range(12):  # crowded cells: originals with copies, and copies of copies
        prints.append(r.getrandbits(64))
        for _ in range(25):
            x = r.choice(prints[-5:])
            for b in r.sample(range(64), r.choice([1, 2, 3, 3, 4, 5])):
                x ^= 1 << b
            prints.append(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    points = spark.createDataFrame([(x,) for x in set(signed)], "fp long")
    links = {(a["u"], a["v"]) for a in simhash._links(points, 3).collect()}
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3 for a, b in links)
    comp = {x["node"]: x["label"] for x in components.components(spark.createDataFrame(list(links), "u long, v long")).collect()}
    of = [comp.get(x, x) for x in signed]
    for i, x in enumerate(prints):
        for j, y in enumerate(prints[:i]):
            assert (x ^ y).bit_count() > 3 or of[i] == of[j]
    shown = points.select("fp", simhash.embedded(F.col("fp")).alias("e")).collect()
    for a in shown[:20]:
        counts = [(a["fp"] >> (2 * i) & 3).bit_count() for i in range(32)]
        assert [(a["e"] >> (2 * i) & 3) for i in range(32)] == [(0, 1, 3)[c] for c in counts]


def best_phrases_of(rows, least, best):
    found, n = {}, Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOW)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                found.setdefault(lang or "und", Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, f in found.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inner = {p[s:e] for p, a in often.items() for s in range(len(p)) for e in range(s + 2, len(p) + 1) if e - s < len(p) and a >= often[p[s:e]]}
        cuts = lambda p: min((1000 * f[p] * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))  # noqa: E731, B023
        ranked = sorted((-cuts(p)[0], -a, " ".join(p).encode(), f[p[: cuts(p)[1]]], f[p[cuts(p)[1] :]]) for p, a in often.items() if p not in inner)
        out |= {(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for i, x in enumerate(ranked[:best])}
    return out


def test_phrases(docs, empty, spark):
    columns = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    r = random.Random(8)
    words = ["the", "of", "New", "york", "a", "é"]
    pieces = [" ".join(r.choice(words) for _ in range(r.randint(1, 30))) + r.choice([". ", ", ", "\n", " \t"]) for _ in range(900)]
    made = [(i, ["en", None, "de"][i % 3], "".join(pieces[7 * i : 7 * i + 9])) for i in range(120)] + [(200, "en", None), (201, "fr", ""), (202, "en", "go go go go go go go")]
    some = spark.createDataFrame(made, "doc_id long, lang string, text string").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "37")  # ranges in which nothing is frequent
    try:
        assert {tuple(x[c] for c in columns) for x in phrases.best_phrases(some, least=40, best=7).collect()} == best_phrases_of([(x["lang"], x["text"]) for x in some.collect()], 40, 7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for df, least, best in ((docs, 4, 2000), (some, 10, 2000), (some, 40, 7)):
        got = {tuple(x[c] for c in columns) for x in phrases.best_phrases(df, least=least, best=best).collect()}
        assert got == best_phrases_of([(x["lang"], x["text"]) for x in df.collect()], least, best) and got
    assert phrases.best_phrases(empty).count() == 0 and phrases.best_phrases(docs).count() >= 0
    big = spark.createDataFrame([("en", [1], 10**14), ("en", [2], 10**14), ("en", [1, 2], 10**14)], "lang string, words array<long>, n long")
    row = phrases.scored(big, spark.createDataFrame([("en", 3 * 10**14)], "lang string, n long")).first()
    assert row["score"] == 1000 * 10**14 * 3 * 10**14 // 10**28
