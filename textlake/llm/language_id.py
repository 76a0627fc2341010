"""Language identification by compression with per-language raw-content dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import zstandard as zstd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.runtime import drop_extra, materialize

#: Counts of more languages than this are joined by a shuffle instead of a broadcast.
BROADCAST_LANGUAGES = 100_000


def has_letter(text: str) -> bool:
    """Whether a character is of a letter category; numbers such as fractions aren't."""
    return any(map(str.isalpha, text))


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``; a null id counts as an empty text."""
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % folds == fold


def learn(docs: DataFrame, texts: int = 96, dictionary_bytes: int = 128 << 10, all_bytes: int = 64 << 20) -> dict[str, bytes]:
    """Dictionary content of every language among the training rows.

    The bound of this fit: of each language different whole texts, those that hash lowest (the same at every run),
    ``texts`` of them at most and while they fit into ``dictionary_bytes``, or into an equal share of
    ``all_bytes`` where languages are many. Texts of more than an eighth of that room come after all others;
    one text is taken whatever its length. Null lang, null text and held-out rows teach nothing. Empty table:
    no languages.
    """
    d = drop_extra(docs, "doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = materialize(d.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("_count")).withColumnRenamed("lang", "_lang"))
    languages = counts.count()
    if not languages:
        return {}
    room = max(1, min(dictionary_bytes, all_bytes // languages))
    small = F.broadcast(counts) if languages <= BROADCAST_LANGUAGES else counts
    # a threshold on the hash gives about three times as many texts as needed, whatever the table's size
    h = F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(float(1 << 53))
    near = d.withColumn("_h", h).join(small, F.col("lang") == F.col("_lang")).where(F.col("_h") * F.col("_count") < F.lit(3.0 * texts))
    # copies of a text, however many, leave each task as one
    keyed = near.select("lang", F.xxhash64("text").alias("_key"), (F.octet_length("text") + 1).alias("_size"), "text").dropDuplicates(["lang", "_key"])
    order = Window.partitionBy("lang").orderBy(F.col("_size") > room // 8, F.shiftrightunsigned("_key", 1), "_key")
    chosen = keyed.withColumn("_n", F.row_number().over(order)).withColumn("_bytes", F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chosen = chosen.where((F.col("_n") == 1) | ((F.col("_n") <= texts) & (F.col("_bytes") <= room)))
    out: dict[str, list[tuple[int, str]]] = {}
    for r in chosen.select("lang", "_n", "text").collect():
        out.setdefault(r["lang"], []).append((r["_n"], r["text"]))
    joined = {lang: "\n".join(text for _, text in sorted(rows)).lower().encode("utf-8", "replace") for lang, rows in sorted(out.items())}
    return {lang: content for lang, content in joined.items() if len(content) >= 8}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = 6, block: int = 2048):
        self.langs = sorted(dictionaries)
        self.block = block
        self.coders = []
        for lang in self.langs:
            d = zstd.ZstdCompressionDict(dictionaries[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders.append(zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes of the whole text by language, block by block so that the dictionary, not the
        text's own past, does the predicting; case is folded."""
        data = text.lower().encode("utf-8", "replace")
        blocks = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        return [sum([len(c.compress(b)) for b in blocks]) for c in self.coders]

    def predict(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        if not text or not self.langs or not has_letter(text):
            return "und", 0.0, True
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], self.langs[i]))
        best = sizes[order[0]]
        second = sizes[order[1]] if len(order) > 1 else 2 * best
        gap = (second - best) / second
        return self.langs[order[0]], min(1.0, max(0.0, second / (best + second) * 2 - 1 + 0.5)), gap < margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = 0.01) -> DataFrame:
    """doc_id, held_out, lang_pred, score, narrow for every row of ``docs``; only the text is looked at.

    lang_pred: the language whose dictionary makes the whole text smallest; of equals, the first by name.
    score: 0.5 where the two best are equal, up to 1. narrow: the answer is to be rejected, the runner-up
    is within ``margin`` of the best. Null text or no letter, or nothing learnt: ``und``, 0, narrow. Any
    length is compressed whole, in blocks. Repeated rows: each predicted. Empty table: no rows. Extra columns of
    any name are left alone.
    """

    @F.pandas_udf("struct<lang_pred string, score double, narrow boolean>")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Classifier(dictionaries)
        for texts in parts:
            yield pd.DataFrame([own.predict(t, margin) for t in texts], columns=["lang_pred", "score", "narrow"])

    d = drop_extra(docs, "doc_id", "text").withColumn("_p", predict("text"))
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "_p.lang_pred", "_p.score", "_p.narrow")
