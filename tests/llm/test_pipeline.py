"""The pipeline against the same stages done by hand."""

import random
from collections import Counter

import corpus_pipeline
from textlake.llm import line_quality, mixing

from test_training_operators import SCHEMA, SF, hard_rows, table, words, brute_components, brute_fingerprint, brute_leaks, brute_targets, WORD


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    crf = line_quality.fit_on(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {d.doc_id: d for d in docs.collect()}
    kept = {}
    for i, d in rows.items():
        p = line_quality.read(d.text)
        content = sum(n for n, y in zip(p.sizes, line_quality.viterbi(crf, p.features)) if not y)
        if p.n_words >= 50 and 2 * p.n_repeat_words <= p.n_words and content >= 0.5 * p.n_words:
            kept[i] = d
    fp = {i: brute_fingerprint(d.text) for i, d in kept.items()}
    root = brute_components(fp, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    kept = {i: d for i, d in kept.items() if root[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, _ in brute_leaks([(i, d.text) for i, d in kept.items()], items)}
    kept = {i: d for i, d in kept.items() if i not in leaks}
    size = Counter()
    for d in kept.values():
        size[d.source] += len(WORD.findall(d.text))
    want = brute_targets(dict(size))

    out = corpus_pipeline.run(spark, SF).collect()
    copies = Counter(r.doc_id for r in out)
    assert set(copies) <= set(kept) and max(copies.values()) <= 2
    taken = Counter()
    for i, n in copies.items():
        taken[kept[i].source] += n * len(WORD.findall(kept[i].text))
    largest = max(len(WORD.findall(d.text)) for d in kept.values())
    assert all(abs(taken[s] - want[s]) <= largest / 2 + 1 for s in want)
    counts = Counter(r.shard for r in out)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(24)) <= 1


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def hard_folder(spark, path, rows):
    """A folder of tables: hard documents with clashing columns, a benchmark and labels."""
    docs = table(spark, rows) if rows else table(spark, hard_rows()).where("doc_id = 0")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, None), (5, 0)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "un texto de prueba muy corto"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline_on_hard_rows(spark, tmp_path):
    rng = random.Random(41)
    clean, other = words(rng, 90), words(rng, 70)
    leak = f"{words(rng, 60)} un texto de prueba muy corto {words(rng, 20)}"
    rows = [*hard_rows(), (20, clean, "en", "a"), (20, clean, "en", "a"), (21, clean, "de", "b"), (20, other, "en", "a"), (None, words(rng, 80), None, None), (22, leak, "en", "a"), (22, words(rng, 75), "en", "c")]
    sf = hard_folder(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == SCHEMA.replace("`", "").replace(",", "").split()[::2]
    out = corpus_pipeline.run(spark, sf).collect()
    ids = Counter(r.doc_id for r in out)
    # 5: long; 20: one of the copies and the other text of that id; the row without an id; 22: only the row that doesn't leak
    assert set(ids) == {5, 20, None, 22} and all(n <= 4 for n in ids.values())
    assert {r.text_crc32 for r in out if r.doc_id == 22} == {__import__("zlib").crc32(rows[-1][1].encode())}
    assert sorted(ids.items(), key=str) == sorted(Counter(r.doc_id for r in docs.collect()).items(), key=str)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, hard_folder(spark, tmp_path, [])).count() == 0


def test_mixture_is_the_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = Counter(r.doc_id for r in mixing.mix(docs).collect() for _ in range(r.copies))
    assert want == Counter(r.doc_id for r in corpus_pipeline.mixture(spark, docs, SF).collect())
