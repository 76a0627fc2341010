"""The training-data operators against brute force, on small tables and on made-up hard cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textlake.llm import components, decontaminate, language_id, license_scan, line_quality, mixing, ordering, passage_dedup, queries, sharding, simhash_dedup, token_count, url_filter

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = ["_id", "_source", "_hash", "_n", "_copies", "_each", "_h", "_v", "_pos", "_gone", "row", "id", "hash", "n", "u", "size", "shard", "curve", "fp", "words", "text_hash", "item_id", "k", "copies"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHES)


def table(spark, rows):
    """documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, l, s, 0, *[7] * len(CLASHES)) for i, t, l, s in rows], SCHEMA)


def hard_rows():
    rng = random.Random(5)
    long_text = " ".join(rng.choice(["uno", "dos", "tres", "cuatro"]) + str(rng.randrange(50)) for _ in range(20000))
    return [
        (1, None, "en", "a"), (2, "", None, "a"), (3, "   \n\t ", "en", None), (4, "palabra", "es", "b"), (5, long_text, "es", "b"),
        (6, "the same text " * 30, "en", "a"), (6, "the same text " * 30, "en", "a"), (7, "the same text " * 30, "de", "c"), (None, "sin id " * 60, "es", None), (8, "\U0001f600 \x1c é\u0301 " * 20, None, "\U0001f600"),
    ]


def own_items(d):
    return d.select(F.col("doc_id").alias("item_id"), F.left("text", F.lit(900)).alias("text"), "words")


def addresses(d):
    return d.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.com/"), "text").alias("url"), "row", "n", "_h")


ALL = sorted(str(r[0]) for r in hard_rows())
#: Each operator with what it has to give on the hard rows: ids of all its rows, or None for all rows.
OPERATORS = {
    "mix": (mixing.mix, None),
    # source a is capped at two copies, as are b, c and the null source: weights leave no source short
    "mixed": (mixing.mixed, None),
    "shard": (sharding.shard, None),
    "urls": (lambda d: url_filter.judge(addresses(d), queries.URL_RULES), None),
    "tokens": (lambda d: token_count.count_tokens(d, queries.tokenizer_path()), None),
    "quality": (lambda d: line_quality.judge(d, line_quality.Crf()), None),
    "keep": (lambda d: line_quality.keep(d, line_quality.Crf()), ["5"]),
    "language": (lambda d: language_id.identify(d, language_id.learn(d)), None),
    "near": (simhash_dedup.near_duplicates, None),
    # null, empty and blank texts have fingerprint 0; the rows of "the same text" are one group
    "keep_one": (simhash_dedup.keep_one, ["1", "4", "5", "6", "8", "None"]),
    "licenses": (license_scan.scan, []),
    "find": (lambda d: decontaminate.find(d, own_items(d)), ["4", "5", "6", "6", "7", "7", "8", "None"]),
    "clean": (lambda d: decontaminate.clean(d, own_items(d)), ["1", "2", "3"]),
    "passages": (passage_dedup.repeated_passages, ["6", "6", "7"]),
    "without_repeats": (passage_dedup.without_repeats, ALL),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_hard_rows(spark, name):
    run, want = OPERATORS[name]
    rows = run(table(spark, hard_rows())).collect()
    if name == "mixed":
        return  # held against mix below
    ids = sorted(str(r["page_id" if name == "urls" else "doc_id"]) for r in rows)
    assert ids == (ALL if want is None else sorted(want))


def test_hard_rows_values(spark):
    d = table(spark, hard_rows())
    r = {x.doc_id: x for x in line_quality.judge(d, line_quality.Crf()).collect()}
    assert r[1].n_words == r[2].n_words == r[3].n_words == 0 and r[1].base_failed and r[1].content_share == 0.0 and r[5].n_words == 20000
    t = {x.doc_id: x for x in token_count.count_tokens(d, queries.tokenizer_path()).collect()}
    assert (t[1].n_bytes, t[1].n_tokens, t[2].n_tokens, t[3].n_tokens) == (0, 0, 0, 0) and t[5].over_limit
    near = {x.doc_id: x for x in simhash_dedup.near_duplicates(d).collect()}
    assert near[1].fingerprint == near[2].fingerprint == "0" * 16 and near[3].component_id == 1 and near[7].component_id == 6
    urls = {x.page_id: x for x in url_filter.judge(addresses(d), queries.URL_RULES).collect()}
    assert (urls[1].host, urls[1].path, urls[1].rule, urls[1].verdict) == ("", "", None, "allow") and urls[4].rule == "com/"
    cut = {x.doc_id: x for x in passage_dedup.without_repeats(d).collect()}
    # windows within a text of one repeated phrase are all shared; what no window covers stays
    assert cut[6].text == "the same text " * 30 and cut[7].text == "" and cut[1].text is None and cut[2].text == "" and cut[7].row == 7
    mixes = Counter((x.doc_id, x.source) for x in mixing.mix(d).collect() for _ in range(x.copies))
    assert mixes == Counter((x.doc_id, x.source) for x in mixing.mixed(d).collect()) and mixes[None, None] == 2 and not mixes[1, "a"]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name][0](table(spark, []).where("doc_id = 0")).count() == 0


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- mixing


def brute_targets(size, weights=(3, 1, 2), share=1.5, cap=2.0):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(size.values()), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > cap * size[s]]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = cap * size[s]
        left, open_ = left - sum(cap * size[s] for s in over), open_ - set(over)
    return out


def test_mix(spark):
    docs = documents(spark).select("doc_id", "text", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 4)).alias("source"))
    rows = mixing.mix(docs).collect()
    assert rows and sorted(rows) == sorted(mixing.mix(docs.repartition(7)).collect())
    size = Counter()
    for r in docs.collect():
        size[r.source] += len(WORD.findall(r.text or ""))
    want = brute_targets(dict(size))
    taken = Counter()
    for r in rows:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    largest = max(r.size for r in rows)
    assert all(abs(taken[s] - want[s]) <= largest / 2 + 1 for s in want)
    copies = Counter({r.doc_id: r.copies for r in rows})
    assert copies == Counter(r.doc_id for r in mixing.mixed(docs).collect())


def test_mixed_is_mix_row_for_row(spark):
    """Ten equal rows in each of two sources, told apart only by an extra column."""
    rows = [(1, "a b c", s, k) for s in "xy" for k in range(10)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    want = Counter(r.source for r in mixing.mix(d, share=1.2).collect() for _ in range(r.copies))
    got = Counter(r.source for r in mixing.mixed(d, share=1.2).collect())
    assert got == want == {"x": 18, "y": 6}
    each = Counter((r.source, r.extra) for r in mixing.mixed(d, share=1.2).collect())
    assert len(each) == 16 and set(each.values()) <= {1, 2}


def test_inclusion_is_unequal_and_met(spark):
    """Over seeds, documents of a source are taken as often as their expectation says: it grows with the root of
    their size, whole copies are in every sample, and the words taken are the target's."""
    sizes = [10, 20, 40, 80, 160] * 24
    d = spark.createDataFrame([(i, "w " * n, "a") for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    seeds = 24
    taken = Counter()
    for seed in range(seeds):
        rows = mixing.mix(d, share=0.9, seed=seed).collect()
        assert abs(sum(r.taken for r in rows) - 0.9 * sum(sizes)) <= 80
        taken.update({r.size: 0 for r in rows})
        for r in rows:
            taken[r.size] += r.copies
    level = 0.9 * sum(sizes) / sum(n**1.5 for n in sizes)
    for n in (10, 20, 40, 80, 160):
        want = min(2.0, level * n**0.5)
        got = taken[n] / (24 * seeds)
        assert int(want) <= got <= int(want) + 1 and abs(got - want) < 0.09
    flat = Counter()
    for seed in range(8):
        for r in mixing.mix(d, share=0.5, tilt=0.0, seed=seed).collect():
            flat[r.size] += r.copies
    assert all(abs(flat[n] / (24 * 8) - 0.5) < 0.13 for n in flat)


def test_targets_of_many_sources(spark):
    rng = random.Random(4)
    size = {f"s{i}": rng.choice([0, 1, 5, 1000, rng.randrange(10**6)]) for i in range(200)} | {None: 77}
    rows = mixing.targets(spark.createDataFrame(list(size.items()), "source string, source_size long"), (3, 1, 2), 1.5, 2.0).collect()
    want = brute_targets(size)
    assert all(r.target == pytest.approx(want[r.source]) for r in rows) and len(rows) == len(size)


def test_running_sums(spark):
    d = spark.range(1000).select((F.col("id") * 37 % 101).alias("k"), "id")
    s = ordering.with_sum_before(ordering.globally_sorted(d, [F.col("k"), F.col("id")]), "id").collect()
    p = ordering.with_position(ordering.globally_sorted(d, [F.col("k"), F.col("id")])).collect()
    total, order = 0, sorted((i * 37 % 101, i) for i in range(1000))
    before = {(r.k, r.id): r._before for r in s}
    place = {(r.k, r.id): r._pos for r in p}
    for n, x in enumerate(order):
        assert before[x] == total and place[x] == n
        total += x[1]


# ---- URL rules


def test_url_filter(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").unionByName(
        spark.createDataFrame([(-1, None), (-2, "no scheme"), (-3, "http://WWW.Example.COM/en/x"), (-4, "http://example.com"), (-5, "a://b.example.com/en?x"), (-6, "http://notexample.com/en/"), (-7, "http://com/"), (-8, "x://a.net/es/y#z")], "page_id long, url string")
    )
    got = {r.page_id: r for r in url_filter.judge(pages, queries.URL_RULES).collect()}
    for p in pages.collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", p.url or "")
        host, path = (m[1], m[2]) if m else ("", "")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [r for r in queries.URL_RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: (r[0].count("."), len(r[1])), default=None)
        r = got[p.page_id]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best[0] + best[1], best[2] if best else "allow")


def test_tries_in_blocks_agree(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    whole = sorted(url_filter.judge(pages, queries.URL_RULES).collect())
    monkeypatch.setattr(url_filter, "RULES_A_TRIE", 2)
    assert sorted(url_filter.judge(pages, queries.URL_RULES).collect()) == whole


def test_tries_in_blocks_agree_on_repeated_rules(spark, monkeypatch):
    rules = [("a.b", "/", "block"), ("c.d", "/", "block"), ("A.b", "/", "allow"), ("x.a.b", "/p", "block"), ("b", "/p/q", "allow")]
    pages = spark.createDataFrame(enumerate(["http://a.b/", "http://x.a.b/p/q", "http://c.d/", "http://b/p/q", "http://z/"]), "page_id long, url string")
    whole = sorted(url_filter.judge(pages, rules).collect())
    assert [r.verdict for r in whole] == ["allow", "block", "block", "allow", "allow"]
    for n in (1, 2, 3):
        monkeypatch.setattr(url_filter, "RULES_A_TRIE", n)
        assert sorted(url_filter.judge(pages, rules).collect()) == whole


def test_deep_paths(spark):
    deep = "/" + "s/" * 5000
    pages = spark.createDataFrame([(1, f"http://h{deep}x"), (2, "http://h/s/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.judge(pages, [("h", deep, "block")]).collect()} == {1: "block", 2: "allow"}


def test_trie_partial_segment():
    trie = url_filter.build_trie([("a.b", "/x/ab", "block"), ("a.b", "", "allow"), ("b", "/", "allow")])
    assert url_filter.longest_match(trie, "c.a.b", "/x/abc")[1] == "block"
    assert url_filter.longest_match(trie, "a.b", "/x/a")[0] == "a.b"
    assert url_filter.longest_match(trie, "b", "") is None


# ---- tokens


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library = Tokenizer.from_file(path)
    texts = [r.text for r in documents(spark).collect()] + [r[1] or "" for r in hard_rows()]
    texts += ["don't I'll 'sabc ,'s", "x<|endoftext|>y <|ENDOFTEXT|><|startoftext|>", "ΟΔΟΣ Σ İ ﬁ", "a\x1cb\x85c\u3000d", "日本語 12345 ☃️👍🏽", "th" * 400 + "!" * 99]
    rng = random.Random(1)
    texts += ["".join(rng.choice("aeinorst'hABC 12.,!\n\u00e9ß") for _ in range(300)) for _ in range(100)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    counter = token_count.Counter(path)
    assert [counter.count(t) for t in texts] == want


def test_every_character_counts_as_in_the_library():
    """Each code point alone, beside a letter and beside a number."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library, counter = Tokenizer.from_file(path), token_count.Counter(path)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (c < 0x3400 or c % 7 == 0 or 0xA000 <= c < 0x20000)]
    texts = [f"{c} x{c}y ñ{c} 1{c}2 {c.upper()}{c}\u0301" for c in chars]
    for i in range(0, len(texts), 20000):
        part = texts[i : i + 20000]
        want = [len(e.ids) for e in library.encode_batch(part, add_special_tokens=False)]
        assert [t for t, n in zip(part, want) if counter.count(t) != n] == []


def test_chunk_maps_compose(monkeypatch):
    counter = token_count.Counter(queries.tokenizer_path())
    rng = random.Random(8)
    runs = "".join(rng.choice("abcdeñst") for _ in range(700)) + "!?..'" * 90 + "12345" * 30 + "'s've" + "ü" * 200 + "日本語テキスト" * 30
    for text in ("una frase  con\npalabras, que's cortas y larguísimas " * 40, runs, f"x {runs}y {runs[300:]}", "'" * 300 + "sabc"):
        want = counter.count(text)
        for size in (1, 2, 3, 15, 16, 17, 64, 100, 301, 1000):
            monkeypatch.setattr(token_count, "CHUNK", size)
            assert counter.count(text) == want, (text[:20], size)
        monkeypatch.setattr(token_count, "CHUNK", 1 << 16)


def test_long_words_are_cut_inside(monkeypatch):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    counter = token_count.Counter(path)
    rng = random.Random(2)
    text = "".join(rng.choice("etaoins") for _ in range(30000))
    monkeypatch.setattr(token_count, "CHUNK", 1 << 10)
    assert sum(o for _, o in counter.cuts(text)) == 29
    maps = [counter.chunk_map(text[i : i + 1024], i > 0, i + 1024 < len(text)) for i in range(0, len(text), 1024)]
    left, right = maps[0], maps[-1]
    for m in maps[1:]:
        left = counter.compose(left, m)
    for m in maps[-2::-1]:
        right = counter.compose(m, right)
    assert left.count == right.count == counter.count(text) == len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)
    # an entry state meets the path from the start state soon
    state, _ = counter.machine.walk(counter.machine.start, b"etaoin")
    assert maps[3].inside[0].apply(state) == counter.machine.walk(state, text[3072:4096].encode())


# ---- quality


def test_line_quality_base(spark):
    docs = documents(spark)
    crf = line_quality.fit_on(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r for r in line_quality.judge(docs, crf).collect()}
    for d in docs.collect():
        words = WORD.findall(d.text)
        grams = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
        seen, copied = set(), 0
        for line in d.text.split("\n"):
            if WORD.search(line):
                copied += line in seen
                seen.add(line)
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), sum(d.text.count(c) for c in "#*$%&|<>"))
        assert (r.n_dup_lines, r.n_repeat_words) == (copied, len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r.base_failed and r.kept)
    assert sorted(r.doc_id for r in line_quality.keep(docs, crf).collect()) == sorted(i for i, r in got.items() if r.kept)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x = [tuple(rng.normal(size=7)) for _ in range(6)]
        crf = line_quality.Crf(tuple(rng.normal(size=7)), tuple(map(tuple, rng.normal(size=(2, 2)))), tuple(rng.normal(size=2)))

        def score(path):
            s = crf.first[path[0]] + sum(np.dot(crf.weights, f) for f, y in zip(x, path) if y)
            return s + sum(crf.pairs[a][b] for a, b in zip(path, path[1:]))

        paths = [[(k >> i) & 1 for i in range(6)] for k in range(64)]
        assert abs(score(line_quality.viterbi(crf, x)) - max(map(score, paths))) < 1e-9


def test_quality_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    crf = line_quality.fit_on(docs, labels, 200)
    rows = line_quality.judge(docs, crf).join(labels, "doc_id").where("NOT base_failed").collect()
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(r.kept for r in bad) <= 0.4 * len(bad)


def test_lines_of_one_page_differ(spark):
    """Pages of good lines with junk lines among them: the labels of their lines follow the lines, not the page."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    crf = line_quality.fit_on(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    rng = random.Random(7)
    good = [words(rng, 20) + "." for _ in range(60)]
    junk = [" | ".join(words(rng, 20).split()) for _ in range(60)]
    for n_good, n_junk in ((5, 1), (4, 2), (3, 3), (2, 4)):
        lines, kinds = [], []
        for k in range(3):  # runs of each kind, as headers, bodies and footers are
            for pool, n, kind in ((good, n_good, 0), (junk, n_junk, 1)):
                lines += pool[k * n : k * n + n]
                kinds += [kind] * n
        p = line_quality.read("\n".join(lines))
        assert line_quality.viterbi(crf, p.features) == kinds
    rows = line_quality.judge(docs, crf).collect()
    assert sum(0 < r.content_share < 1 for r in rows) >= 10  # documents labelled in part


def test_training_takes_any_ids_and_all_lines(spark):
    long_page = "\n".join(["# * $ % & | <" + str(k) for k in range(500)])
    docs = spark.createDataFrame([("x", long_page), ("y", "a plain line.\n" * 2), ("y", None), (None, "b")], "doc_id string, text string")
    labels = spark.createDataFrame([("x", 0), ("y", 1), ("z", None), (None, 0)], "doc_id string, quality int")
    crf = line_quality.fit_on(docs, labels)
    assert line_quality.viterbi(crf, line_quality.read(long_page).features) == [1] * 500
    assert sum(len(c[1]) for c in line_quality.chains_of(line_quality.read(long_page))) == 500
    assert line_quality.fit_on(docs, labels.where("quality = 5")) == line_quality.Crf()


# ---- language


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs, language_id.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_every_language_is_learnt_from_whole_texts(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, 30) + (" end" + str(i)), f"l{i % 40}") for i in range(2000)] + [(None, "copy " * 40, "l0")] * 500 + [(9999, words(rng, 3000), "lone")]
    learnt = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), texts=8)
    assert len(learnt) >= 40 and ("lone" in learnt) == (zlib.crc32(b"9999") % 4 != 2)
    texts = {t.lower() for _, t, _ in rows}
    assert all(t in texts for content in learnt.values() for t in content.decode().split("\n"))
    assert learnt["l0"].count(b"copy copy") <= 39  # copies of one text teach once


def test_language_undetermined():
    c = language_id.Classifier({"en": b"the cat and the dog " * 50, "es": "el gato y la niña ".encode() * 50})
    assert c.predict(None, 0.01)[0] == c.predict("123 --", 0.01)[0] == c.predict("\u00bd \u00b2 \u2167", 0.01)[0] == "und"
    assert c.predict("the dog and the cat and the dog", 0.01)[0] == "en" and c.predict("la niña y el gato y la niña", 0.01)[0] == "es"


# ---- near duplicates


def brute_fingerprint(text):
    words = [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    order = sorted(nodes)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_near_duplicates(spark):
    docs = documents(spark).select("doc_id", "text").collect()
    long = next(d.text for d in docs if len(d.text) > 5000).split(" ")
    extra = [(1000 + i, " ".join([*long[: 50 * i], "cambio", *long[50 * i + 1 :]])) for i in range(6)] + [(2000, None), (2001, ""), (2002, "A B"), (2003, "a b")]
    all_docs = [(d.doc_id, d.text) for d in docs] + extra
    got = {r.doc_id: r for r in simhash_dedup.near_duplicates(spark.createDataFrame(all_docs, "doc_id long, text string")).collect()}
    fp = {i: brute_fingerprint(t) for i, t in all_docs}
    want = brute_components(fp, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fp
    assert {i: r.component_id for i, r in got.items()} == want
    assert len(set(want.values())) < len({*fp.values()})  # some links are between different fingerprints


def test_every_close_pair_shares_an_anchor(spark):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(30)} | {0, (1 << 64) - 1}
    for f in list(fps)[:20]:
        for _ in range(12):
            fps.add(f ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(1, 4))}))
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    star = components.connected(simhash_dedup.links(rows)).collect()
    got = {r.fp: r.fp for r in rows.collect()} | {r.u: r.v for r in star}
    assert got == brute_components(got, lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(25)] + [(7, 7)]
    got = {r.u: r.v for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    links = {frozenset(e) for e in edges}
    nodes = {n for e in edges for n in e}
    assert {n: got.get(n, n) for n in nodes} == brute_components(nodes, lambda a, b: frozenset((a, b)) in links)


def test_keep_one_goes_by_rows(spark):
    rng = random.Random(17)
    a, b = words(rng, 60), words(rng, 60)
    rows = [(1, a, "s", "x"), (1, b, "s", "x"), (2, a, "s", "x"), (None, a, "s", "x"), (None, words(rng, 50), "s", "x"), (3, b, "s", "x"), (1, a, "s", "x")]
    got = [(r.doc_id, r.text) for r in simhash_dedup.keep_one(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (1, b), rows[4][:2]], key=str)


# ---- licenses


def test_patience():
    template = license_scan.words_of(license_scan.TEMPLATES["GPL-3.0"])
    text = license_scan.words_of("The the. This work is indeed licensed under the GNU General Public License, version 3 of the")
    pairs = license_scan.patience(text, template)
    assert [t for _, t in pairs] == list(range(len(template)))
    assert all(text[a] == template[b] for a, b in pairs) and pairs == sorted(pairs)
    assert license_scan.patience("a b c".split(), "c b a".split())


def test_licenses(spark):
    docs = table(spark, [(1, "x " * 500 + "Released under\nthe MIT License. " + "y " * 300 + "Released under the MIT license", "en", "a"), (2, "the work is a license of the public under", "en", "a"), (3, "Licensed under CC BY-NC 4.0.", "en", "a")])
    got = {(r.doc_id, r.license): r for r in license_scan.scan(docs).collect()}
    assert set(got) == {(1, "MIT"), (3, "CC-BY-NC-4.0")}
    assert got[1, "MIT"].first_word == 500 and got[1, "MIT"].places == 2 and got[3, "CC-BY-NC-4.0"].coverage == 1.0


def test_licenses_in_near_succession(spark):
    mit = "Released under the MIT License."
    texts = [f"the cat sat {mit} {mit} The end", f"{mit} under {mit} the {mit}", "Released under MIT License. Released under the MIT License", "License the MIT under released", " ".join([license_scan.TEMPLATES["MIT-permission"]] * 3)]
    got = {r.doc_id: (r.license, r.coverage, r.first_word, r.last_word, r.places) for r in license_scan.scan(table(spark, [(i, x, "en", "a") for i, x in enumerate(texts)])).collect()}
    size = len(license_scan.words_of(texts[4])) // 3
    assert got == {0: ("MIT", 1.0, 3, 7, 2), 1: ("MIT", 1.0, 0, 4, 3), 2: ("MIT", 1.0, 4, 8, 2), 4: ("MIT-permission", 1.0, 0, size - 1, 3)}


def brute_places(words, template, coverage=0.8, stretch=2):
    """Disjoint stretches of at most two template lengths, left to right, in which enough of the template aligns."""
    out, at, size = [], 0, len(template)
    while at < len(words):
        best = None
        for end in range(at + 1, len(words) + 1):
            for a in range(max(at, end - stretch * size), end):
                row = [0] * (size + 1)
                for w in words[a:end]:
                    last = 0
                    for j, t in enumerate(template, 1):
                        last, row[j] = row[j], max(row[j], row[j - 1], last + (w == t))
                if row[-1] >= coverage * size and (best is None or row[-1] > best):
                    best = row[-1]
            if best:
                break
        if best is None:
            return out
        out.append(end)
        at = end
    return out


def test_license_places_against_brute_force():
    rng = random.Random(13)
    template = license_scan.words_of(license_scan.TEMPLATES["CC-BY-NC-4.0"])
    scanner = license_scan.Scanner({"L": license_scan.TEMPLATES["CC-BY-NC-4.0"]}, 0.8)
    for _ in range(150):
        text = []
        for _ in range(rng.randrange(1, 6)):
            notice = list(template)
            if rng.random() < 0.3:
                notice[rng.randrange(len(notice))] = "odd"
            text += notice + [rng.choice(["by", "fill", "cc", "here"]) for _ in range(rng.choice([0, 0, 1, 4]))]
        places = sum(r[4] for r in scanner.scan(" ".join(text)))
        assert places == len(brute_places(text, template)), text


def test_two_licenses_in_one_text(spark):
    early, late = "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0 here."
    texts = [early + " fill" * 60 + " " + late, late + " " + early, early + " All rights reserved. " + late + " Released under the MIT License"]
    got = {}
    for r in license_scan.scan(table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect():
        got.setdefault(r.doc_id, set()).add((r.license, r.places))
    both = {("CC-BY-4.0", 1), ("CC-BY-NC-4.0", 1)}
    assert got == {0: both, 1: both, 2: both | {("proprietary", 1), ("MIT", 1)}}


def test_full_license_texts(spark):
    rng = random.Random(3)
    texts = [f"{words(rng, 40)}\n{t}\n{words(rng, 40)}" for t in license_scan.TEMPLATES.values()]
    found = {}
    for r in license_scan.scan(table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect():
        found.setdefault(r.doc_id, []).append((r.license, r.coverage))
    # the short notice inside a longer one gives way to it, each text is known by its own name
    assert found == {i: [(name, 1.0)] for i, name in enumerate(license_scan.TEMPLATES)}


def test_licenses_whole_table(spark):
    found = {(r.doc_id, r.license) for r in license_scan.scan(documents(spark)).collect()}
    for d in documents(spark).collect():
        for name, template in license_scan.TEMPLATES.items():
            if template in d.text:
                assert (d.doc_id, name) in found


# ---- sharding


def test_hilbert_is_a_walk():
    bits = 3
    axes = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    index = sharding.hilbert_index(axes, bits)
    assert sorted(index.tolist()) == list(range(512))
    path = axes[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards(spark):
    docs = documents(spark)
    rows = sharding.shard(docs).collect()
    text = {d.doc_id: d.text for d in docs.collect()}
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(24)) <= 1 and set(counts) <= set(range(24))
    for s, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert all(r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.grown_shard is None for r in rows)
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in ordered] == sorted(r.curve for r in rows)
    assert sorted(rows, key=str) == sorted(sharding.shard(docs.repartition(5)).collect(), key=str)


def test_equal_texts_are_neighbours(spark):
    rng = random.Random(5)
    texts = [words(rng, 30) for _ in range(40)] + [None, ""]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None]), f"s{rng.randrange(9)}") for i in range(600)] + [(1000 + i, "many copies", "en", f"s{i % 7}") for i in range(300)]
    placed = sorted(sharding.shard(table(spark, rows), shards=5).collect(), key=lambda r: (r.shard, r.slot))
    text = {i: t for i, t, _, _ in rows}
    runs = [t for t, before in zip([text[r.doc_id] for r in placed], ["-", *[text[r.doc_id] for r in placed]]) if t != before]
    assert len(runs) == len(set(runs)) == len(set(text.values()))


def test_ranks_join_either_way(spark, monkeypatch):
    whole = sorted(sharding.shard(documents(spark)).collect(), key=str)
    monkeypatch.setattr(sharding, "BROADCAST_VALUES", 1)
    assert sorted(sharding.shard(documents(spark)).collect(), key=str) == whole


# ---- decontamination


def brute_leaks(docs, items, least=0.8):
    out = {}
    grams = lambda ws: Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else Counter([tuple(ws)])
    for i, text in items:
        item = WORD.findall(text.lower())
        want = grams(item)
        for d, t in docs:
            ws = WORD.findall((t or "").lower())
            best = 0.0
            for s in range(max(1, len(ws) - len(item) + 1)):
                window = ws[s : s + len(item)]
                if window and len(set(window) & set(item)) * 2 >= len(set(item)):
                    have = grams(window)
                    best = max(best, sum((have & want).values()) / sum((have | want).values()))
            if best >= least:
                out[d, i] = round(best, 6)
    return out


def test_decontaminate(spark):
    rng = random.Random(4)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:12] + [(900, "dos palabras"), (901, "")]
    docs = [(d.doc_id, d.text) for d in documents(spark).select("doc_id", "text").limit(40).collect()]
    for n, (_, text) in enumerate(items[:8]):
        ws = WORD.findall(text)
        cut = [*ws[: len(ws) // 2], *(["nueva"] if n % 2 else []), *ws[len(ws) // 2 :]]
        docs.append((5000 + n, "algo " * rng.randrange(9) + "\n".join(cut) + " fin " * n))
        docs.append((6000 + n, " ".join(ws[2:]).upper() + " x y"))
    docs += [(7000, "aquí dos palabras más"), (7001, None), (7002, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == pytest.approx(brute_leaks(docs, items)) and (7000, 900) in got
    left = decontaminate.clean(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_rows_that_share_an_id_with_a_leak_stay(spark):
    rng = random.Random(14)
    item = words(rng, 30)
    rows = [(1, f"{words(rng, 9)} {item} {words(rng, 9)}", "en", "a"), (1, words(rng, 40), "en", "a"), (None, item, "en", "a"), (None, words(rng, 20), "en", "a"), (2, None, "en", "a")]
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = decontaminate.clean(table(spark, rows), items)
    assert got.columns == SCHEMA.replace("`", "").replace(",", "").split()[::2]
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted((str(rows[k][0]), str(rows[k][1])) for k in (1, 3, 4))


def test_large_benchmarks_are_shuffled(spark):
    docs, items = documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    small = sorted(decontaminate.find(docs, items).collect())
    assert small == sorted(decontaminate.find(docs, items, broadcast_shingles=0).collect()) and small


def test_similar_windows_lie_within_the_radius():
    """Distances of SimHash over pairs at 0.8 weighted Jaccard or more: the loss that the radius may cause."""
    rng = random.Random(31)
    vocabulary = [f"w{k}" for k in range(400)]
    bits = {w: xxhash.xxh64_intdigest(w, 42) for w in vocabulary}

    def simhash(ws):
        return sum(1 << b for b in range(64) if 2 * sum(bits[w] >> b & 1 for w in ws) > len(ws))

    grams = lambda ws: Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    far = []
    while len(far) < 1500:
        n = rng.randrange(14, 60)
        a = [rng.choice(vocabulary) for _ in range(n)]
        b = list(a)
        for _ in range(rng.randrange(1, 3)):
            b[rng.choice([0, 1, n - 1, n - 2, rng.randrange(n)])] = rng.choice(vocabulary)
        shift = rng.randrange(3)
        b = (b[shift:] + [rng.choice(vocabulary) for _ in range(shift)])[:n]
        x, y = grams(a), grams(b)
        if a != b and sum((x & y).values()) >= 0.8 * sum((x | y).values()):
            far.append((simhash(a) ^ simhash(b)).bit_count())
    assert max(far) <= decontaminate.RADIUS


def test_leaks_of_long_items(spark):
    """Items of which a similar window may start over ten words off the place where a shared shingle aligns."""
    rng = random.Random(11)
    items = [(i, words(rng, 120 + 30 * i)) for i in range(4)]
    docs = []
    for i, text in items:
        ws = text.split()
        for edit in (4, 8, 12, 16):
            docs.append((100 * i + edit, " ".join([*words(rng, edit).split(), *ws[:9], *words(rng, edit).split(), *ws[9:], *words(rng, 3).split()])))
            docs.append((100 * i + edit + 1, " ".join([*words(rng, edit).split(), *ws[:9], *ws[9 + edit :], *words(rng, 20).split()])))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == pytest.approx(brute_leaks(docs, items)) and len(got) > 16


def test_leaks_of_the_table(spark):
    docs, items = documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find(docs, items).collect()}
    squeeze = lambda t: " ".join(WORD.findall(t.lower()))
    texts, wanted = {d.doc_id: squeeze(d.text) for d in docs.collect()}, {i.item_id: squeeze(i.text) for i in items.collect()}
    assert {(d, i) for d, t in texts.items() for i, w in wanted.items() if f" {w} " in f" {t} "} <= found


# ---- passages


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(n))


def test_planted_passages(spark):
    rng = random.Random(8)
    passage, common = words(rng, 52), words(rng, 12)
    docs = [(i, words(rng, 80) + "\n" + common + "\n" + words(rng, 40)) for i in range(40)]
    docs += [(100 + i, words(rng, 30 + i) + " " + passage + " " + words(rng, 45)) for i in range(5)]
    line = words(rng, 60).split(" ")
    docs += [(200, words(rng, 9) + "\n" + " ".join(line)), (201, " ".join([*line[:1], "otra", *line[2:]]) + "\n" + words(rng, 30))]
    docs += [(300, words(rng, 26)), (301, None), (302, "")]
    got = {r.doc_id: r for r in passage_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(got) == {100, 101, 102, 103, 104, 200, 201}
    assert got[100].n_removed == 0 and all(got[i].n_removed > 0 for i in (101, 102, 103, 104, 201)) and got[200].n_removed == 0


def test_line_links_against_all_pairs(spark, monkeypatch):
    rng = random.Random(6)
    base = [[f"w{rng.randrange(9999)}" for _ in range(40)] for _ in range(15)]
    texts = []
    for b in base:
        for _ in range(6):
            c = list(b)
            for _ in range(rng.randrange(3)):
                c[rng.randrange(2)] = f"v{rng.randrange(9999)}"
            texts.append(" ".join(c))
    rows = []
    for t in set(texts):
        for _, _, h, grams in passage_dedup.lines_of(*passage_dedup._shingles(t)):
            keys = passage_dedup._keys(passage_dedup.minima(grams, np.array([len(grams)])), passage_dedup._BAND_ROWS).view(np.int64)
            rows.append((h, len(grams), passage_dedup.packed(grams), keys[0].tolist()))
            assert passage_dedup.unpacked(rows[-1][2]).tolist() == grams.tolist()
    table_ = spark.createDataFrame(rows, "h long, n int, s binary, k array<long>")
    sets = {h: passage_dedup.unpacked(s).tolist() for h, _, s, _ in rows}
    want = brute_components(sets, lambda a, b: len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b])))
    for together, shingles in ((256, 1 << 20), (3, 1 << 20), (256, 100), (2, 60)):  # the last ones: buckets are divided, and held against pivots
        monkeypatch.setattr(passage_dedup, "TOGETHER", together)
        monkeypatch.setattr(passage_dedup, "SHINGLES_TOGETHER", shingles)
        star = {r.u: r.v for r in passage_dedup.line_components(table_.drop("s"), table_.select("h", "s"), 0.8).collect()}
        assert {h: star.get(h, h) for h in sets} == want


@pytest.mark.parametrize("few", [0, 10**6])
def test_huge_buckets(spark, monkeypatch, few):
    """A family around a pivot and lines far from it, some of which link to each other or to the family."""
    rng = random.Random(19)
    monkeypatch.setattr(passage_dedup, "TOGETHER", 4)
    monkeypatch.setattr(passage_dedup, "FEW", few)
    base = [rng.randrange(1 << 39) for _ in range(100)]
    change = lambda s, n: sorted({*s[n:], *[rng.randrange(1 << 39) for _ in range(n)]})
    family = [change(base, rng.randrange(1, 9)) for _ in range(20)] + [change(base, 14) for _ in range(6)]
    far = [change(base, 60) for _ in range(6)]
    sets = dict(enumerate([*family, *far, *[change(f, 5) for f in far[:3]]]))
    keys = {h: passage_dedup._keys(passage_dedup.minima(np.array(x, np.uint64), np.array([len(x)])), passage_dedup._BAND_ROWS).view(np.int64)[0].tolist() for h, x in sets.items()}
    for bucket in (keys, {h: [7, *k] for h, k in keys.items()}):  # by their own bands, and all in one bucket too
        lines = spark.createDataFrame([(h, len(x), bucket[h]) for h, x in sets.items()], "h long, n int, k array<long>")
        packed = spark.createDataFrame([(h, passage_dedup.packed(np.array(x, np.uint64))) for h, x in sets.items()], "h long, s binary")
        star = {r.u: r.v for r in passage_dedup.line_components(lines, packed, 0.8).collect()}
    rows = [(1, h, passage_dedup.packed(np.array(x, np.uint64)), h < 20 and h % 2 == 0, len(sets), sum(map(len, sets.values()))) for h, x in sets.items()]
    groups = passage_dedup._blocks(spark.createDataFrame(rows, "key long, h long, s binary, near boolean, c long, t long")).collect()
    met = {frozenset((a.h, b.h)) for k in {g.key for g in groups} for a in groups if a.key == k for b in groups if b.key == k}
    assert all(frozenset((a, b)) in met for a in sets for b in sets if a != b and not (a < 20 and a % 2 == 0 and b < 20 and b % 2 == 0))
    similar = lambda a, b: len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))
    assert {h: star.get(h, h) for h in sets} == brute_components(sets, similar)


def test_text_without_repeats(spark):
    rng = random.Random(23)
    p, ends = words(rng, 60), [words(rng, 40) for _ in range(4)]
    rows = [(1, f"{ends[0]}\n{p}\n{ends[1]}", "en", "a"), (2, f"{ends[2]}\n{p.upper()}\n{ends[3]}", "en", "a"), (2, ends[3][:50], "en", "a")]
    got = sorted((r.doc_id, r.text) for r in passage_dedup.without_repeats(table(spark, rows)).collect())
    assert got == sorted([(1, rows[0][1]), (2, f"{ends[2]}\n{ends[3]}"), (2, ends[3][:50])])


def test_short_passages_inside_lines(spark):
    """Of verbatim passages of 30 words or more all are found, of shorter ones the share that README states."""
    rng = random.Random(27)
    share = {}
    for n in (20, 25, 30, 50):
        docs = []
        for i in range(100):
            p = words(rng, n)
            docs += [(2 * i + j, f"{words(rng, 30)} {p} {words(rng, 30)}") for j in range(2)]
        share[n] = passage_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).count() / 200
    assert share[30] == share[50] == 1.0 and 0.05 <= share[20] <= 0.35 and share[20] <= share[25]


def test_content_places_are_shared():
    rng = random.Random(3)
    for _ in range(50):
        p = words(rng, 51)
        a, b = (passage_dedup.windows_of(passage_dedup._shingles(words(rng, rng.randrange(60)) + " " + p + " " + words(rng, rng.randrange(60)))[2]) for _ in range(2))
        assert set(a[1].tolist()) & set(b[1].tolist())


def test_near_copies_inside_longer_lines(spark):
    """Passages at 0.8 Jaccard, 45 own words on each side: 60 words with one changed, 100 words with two."""
    rng = random.Random(12)
    docs, pairs = [], [(60, (30,)), (60, (20,)), (100, (33, 66))] * 20
    for i, (n, changed) in enumerate(pairs):
        passage = words(rng, n).split(" ")
        other = ["otra" if k in changed else w for k, w in enumerate(passage)]
        docs += [(2 * i + j, " ".join([words(rng, 45), *p, words(rng, 45)])) for j, p in enumerate((passage, other))]
    got = {r.doc_id: r.n_removed for r in passage_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(got) == set(range(2 * len(pairs))) and all((got[i] > 0) == (i % 2 == 1) for i in got)


def test_every_place_of_a_passage(spark):
    rng = random.Random(21)
    p = words(rng, 60)
    docs = [(1, " ".join([words(rng, 40), p, words(rng, 40)])), (2, " ".join([words(rng, 30), p, words(rng, 50), p, words(rng, 20), p]))]
    got = {r.doc_id: r for r in passage_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    clusters = {x.cluster for x in got[1].passages}
    for at in (30, 140, 220):  # windows inside each copy
        inside = {x.cluster for x in got[2].passages if x.removed and at <= x.start_word and x.start_word + x.n_words <= at + 60}
        assert inside & clusters and len(inside) >= len(clusters) - 2
    assert got[2].n_removed == got[2].n_shared == len(got[2].passages) and got[1].n_removed == 0
