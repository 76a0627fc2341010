"""Splitting documents into ordered segments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import text as T

CAPITAL = "A-ZÁÉÍÓÚÜÑ"
# Openings that begin a paragraph, words by which a block goes on, words that name a title
OPENINGS = "Cuando|Después|Entonces|Así|De esta manera|Por eso|En ese momento"
CONTINUES = ("y", "o", "pero", "sin embargo", "además", "también", "que", "de", "en", "con")
TITLE_WORDS = (
    "introducción|conclusión|resumen|abstract|prefacio|prólogo|epílogo|índice|bibliografía|referencias|apéndice|anexo|glosario|"
    "capítulo|sección|parte|libro|título|subtítulo|introduction|conclusion|summary|preface|prologue|epilogue|index|bibliography|"
    "references|appendix|glossary|contents|chapter|section|part|book|title|subtitle"
)
NUMBERED = r"^(?:[IVXLCDM]+\.?\s+|\d+\.?\s+|[A-Z]\.?\s+|[a-z][.)]\s+|\d+\.\d+\.?\s+|\d+\.\d+\.\d+\.?\s+)"
SECTION_WORDS = "capítulo|parte|sección|prólogo|epílogo"
WEEKDAYS = "LUNES|MARTES|MIÉRCOLES|JUEVES|VIERNES|SÁBADO|DOMINGO"
MONTHS = "ENERO|FEBRERO|MARZO|ABRIL|MAYO|JUNIO|JULIO|AGOSTO|SEPTIEMBRE|OCTUBRE|NOVIEMBRE|DICIEMBRE"


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.posexplode_outer(F.split(text, "\n")).alias("pos", "line")).where("line IS NOT NULL")


def blocks(c: Column) -> Column:
    """Blank-line separated blocks, stripped, empty ones out."""
    return F.filter(F.transform(F.split(T.unix_lines(c), r"\n[ \t]*\n+"), T.strip), lambda b: b != "")


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Paragraph chunks of each document; a text without blank lines is one chunk."""
    return docs.select(key, F.posexplode(blocks(F.col(text))).alias("pos", "chunk"))


def sentences(c: Column) -> Column:
    return F.filter(F.split(c, rf"(?<=[.!?])[ \t\n\r\f\x0B]+(?=[{CAPITAL}])"), lambda s: s != "")


def leading_title(c: Column) -> Column:
    """A numeral or chapter mark that opens the text, or an empty string."""
    return F.regexp_extract(c, r"^((?:\*\*)?(?:[IVXLCDM]+|\d+|Capítulo\s+[IVXLCDM]+|Capítulo\s+\d+|Cap\.\s*\d+)(?:\*\*)?)\s+", 1)


def pack(parts: Column, size: int = 300, openings: str | None = OPENINGS) -> Column:
    """Joins sentences into paragraphs: a new one begins once the last is over ``size`` characters, at a
    dialogue dash, or at an opening word. One fold over the sentences."""

    def step(acc: Column, s: Column) -> Column:
        last = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))
        new = (last == "") | (F.length(last) > size) | s.startswith("—")
        if openings:
            new = new | s.rlike(f"^(?:{openings})")
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), s)))
        return F.when(new, F.concat(acc, F.array(s))).otherwise(joined)

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def prose(docs: DataFrame, key: str, text: str, size: int = 300) -> DataFrame:
    """Prose paragraphs of texts in one line: the opening title apart, then packed sentences."""
    d = docs.withColumn("_flat", T.squeeze(F.col(text))).withColumn("_title", leading_title(F.col("_flat")))
    d = d.withColumn("_rest", F.when(F.col("_title") != "", T.strip(F.expr("substring(_flat, length(_title) + 1)"))).otherwise(F.col("_flat")))
    d = d.withColumn("_sentences", sentences(F.col("_rest")))
    packed = F.concat(F.when(F.col("_title") != "", F.array("_title")).otherwise(F.array().cast("array<string>")), pack(F.col("_sentences"), size))
    return d.where("length(_flat) >= 10").select(key, F.posexplode_outer(packed).alias("pos", "segment")).where("segment IS NOT NULL")


def fused(c: Column) -> Column:
    """A text whose breaks were lost: by blank lines, else by end marks before capitals, else whole."""
    natural = blocks(c)
    glued = F.split(c, rf"(?<=[.!?»”])(?=[{CAPITAL}¿¡—])")
    return F.when(F.size(natural) > 1, natural).when(F.size(glued) > 1, glued).otherwise(F.array(T.strip(c)))


# ---- headings


def title_score(c: Column, length: Column | None = None, font: Column | None = None, bold: Column | None = None, align: Column | None = None, avg_font: Column | None = None, avg_length: Column | None = None) -> Column:
    """0 to 10. Without layout columns fonts count as equal and the length as 0, as in texts without layout."""
    length = F.lit(0) if length is None else length
    font, avg_font = (F.lit(12.0) if x is None else x for x in (font, avg_font))
    avg_length = F.lit(200.0) if avg_length is None else avg_length
    t = T.strip(c)
    add = lambda cond, w: F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
    score = F.when(font > avg_font * 1.2, 2.0).when(font > avg_font * 1.1, 1.0).otherwise(0.0)
    if bold is not None:
        score = score + add(bold, 1.5)
    if align is not None:
        score = score + F.when(align == "center", 1.0).when(align == "indented", 0.5).otherwise(0.0)
    score = score + add(t.rlike(NUMBERED), 2.0) + add(F.lower(t).rlike(TITLE_WORDS), 1.5)
    score = score + F.when(length < 100, 1.0).when(length > 300, -1.0).otherwise(0.0)
    score = score + F.when(T.is_upper(t), 1.0).when((F.initcap(F.lower(t)) == t) & (F.lower(t) != t), 0.5).otherwise(0.0)
    score = score + add(~t.rlike("[.!?]$"), 0.5) + add(t.rlike("[|–—]"), 0.5) - add(length > avg_length * 2, 1.0)
    return F.when(t == "", 0.0).otherwise(F.least(F.lit(10.0), F.greatest(F.lit(0.0), score)))


def layout_baseline(b: DataFrame, doc: str, font: str, text: str) -> DataFrame:
    """Adds a document's average, largest and deviation of font size and its average text length."""
    w = Window.partitionBy(doc)
    return (
        b.withColumn("avg_font", F.avg(font).over(w)).withColumn("max_font", F.max(font).over(w))
        .withColumn("std_font", F.stddev_pop(font).over(w)).withColumn("avg_length", F.avg(F.length(text)).over(w))
    )


def score_levels(titles: DataFrame, doc: str, score: str) -> DataFrame:
    """Adds ``level`` 1 to 6 by the rank of a title's own score in its document."""
    rank = F.dense_rank().over(Window.partitionBy(doc).orderBy(F.desc(score)))
    level = F.when(F.col(score) >= 8, rank - 1).when(F.col(score) < 5, rank + 1).otherwise(rank)
    return titles.withColumn("level", F.least(F.greatest(level, F.lit(1)), F.lit(6)))


def is_heading(c: Column, marked: Column | None = None, longest: int = 150) -> Column:
    """Marked so, or short and all capitals, or two to eight words of which all over two letters have a
    capital, or ``Topic - more``, or a short line that ends in a colon."""
    t = T.strip(c)
    parts = T.words(t)
    capital = F.size(F.filter(parts, lambda w: (F.length(w) > 2) & ~w.rlike(r"^\p{Lu}"))) == 0
    dash = F.instr(t, " - ")
    short = (F.length(t) < 80) & ~t.rlike("[.,]$") & F.size(parts).between(2, 8) & t.rlike(r"^\p{Lu}")
    shape = short & (capital | ((dash > 0) & (dash <= 40)) | (t.endswith(":") & (F.length(t) < 40)))
    by_text = (t != "") & (F.length(t) <= longest) & ((T.is_upper(t) & (F.length(t) < 100)) | shape)
    return by_text if marked is None else marked | by_text


def heading_level(c: Column) -> Column:
    t = T.strip(c)
    marks = F.length(F.regexp_extract(t, "^(#+)", 1))
    decimal = F.regexp_extract(t, r"^(\d+(?:\.\d+)*)\.?\s", 1)
    dots = F.length(decimal) - F.length(F.translate(decimal, ".", ""))
    level = F.when(marks > 0, marks).when(decimal != "", dots + 1).when(T.is_upper(t), 1).when(t.rlike(r"^(?:LA|EL|LOS|LAS)\s"), 1)
    return F.least(level.when(F.length(t) < 30, 1).when(F.length(t) < 50, 2).otherwise(3), F.lit(6)).cast("int")


def heading_title(c: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(T.strip(c), r"^#+\s*", ""), r"^\d+(?:\.\d+)*\.?\s+", "")
    return T.strip(F.regexp_replace(t, r"\.\.\.$", ""))


def too_small(c: Column, least: int = 50) -> Column:
    return F.length(T.strip(c)) < least


def heading_segments(docs: DataFrame, key: str, text: str, least_score: float = 3.0, longest: int = 500) -> DataFrame:
    """Paragraph mode: lines, those that score as titles typed ``title_level_N``, long ones packed anew."""
    b = lines(docs, key, text).withColumn("line", T.strip(F.col("line"))).where("line <> ''")
    b = b.withColumn("score", title_score(F.col("line"))).withColumn("level", heading_level(F.col("line")))
    title = (F.col("score") >= least_score) & is_heading(F.col("line"))
    b = b.withColumn("kind", F.when(title, F.concat(F.lit("title_level_"), F.col("level"))).otherwise("paragraph"))
    b = b.withColumn("_sentences", sentences(F.col("line")))
    parts = F.when(~title & (F.length("line") > longest), pack(F.col("_sentences"), 300, None)).otherwise(F.array("line"))
    # outer: an inner generator's implied filter would pack every line a second time
    b = b.select(key, "pos", "kind", F.posexplode_outer(parts).alias("part", "segment"))
    b = b.withColumn("kind", F.when((F.col("kind") == "paragraph") & (F.max("part").over(Window.partitionBy(key, "pos")) > 0), "paragraph_split").otherwise(F.col("kind")))
    order = F.row_number().over(Window.partitionBy(key).orderBy("pos", "part"))
    return b.withColumn("segment_order", order).select(key, "segment_order", "kind", "segment")


def section_tree(headings: DataFrame, doc: str, pos: str, level: str) -> DataFrame:
    """Adds ``parent``: position of the nearest earlier heading of a higher rank (lower level), null at the top.

    A stack per document, kept as an array of the last position seen at each of six levels."""
    h = headings.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(pos, level))).alias("_h"))
    p = headings.schema[pos].dataType.simpleString()

    def step(acc: Column, x: Column) -> Column:
        above = F.filter(F.slice(acc["last"], F.lit(1), x[level] - 1), lambda v: v.isNotNull())
        parent = F.array_max(above)
        last = F.transform(acc["last"], lambda v, i: F.when(i + 1 == x[level], x[pos]).when(i + 1 > x[level], F.lit(None)).otherwise(v))
        return F.struct(last.alias("last"), F.concat(acc["out"], F.array(F.struct(x[pos].alias("pos"), parent.alias("parent")))).alias("out"))

    zero = F.struct(F.array(*[F.lit(None).cast(p)] * 6).alias("last"), F.array().cast(f"array<struct<pos:{p},parent:{p}>>").alias("out"))
    flat = h.select(doc, F.explode(F.aggregate("_h", zero, step, lambda a: a["out"])).alias("_o")).select(doc, F.col("_o.pos").alias(pos), F.col("_o.parent").alias("parent"))
    return headings.join(flat, [doc, pos])


# ---- conservative merge


def is_section_title(c: Column) -> Column:
    t = T.strip(c)
    named = (F.length(t) < 100) & ~t.endswith(".") & F.lower(t).rlike(SECTION_WORDS)
    # one letter or blank before the date is all that a search needs; a run of them would be read from each of its places
    dated = t.rlike(rf"(?i)[A-Z\s]\.\s+(?:{WEEKDAYS})") | t.rlike(rf"(?i)[A-Z\s]\s\d{{1,2}}\s+(?:{MONTHS})")
    return t.rlike(r"^#{1,6}\s+") | t.rlike(r"^\*\*[^*]+\*\*$") | (T.is_upper(t) & (F.length(t) > 5)) | named | dated


def _spoken(t: Column) -> Column:
    return t.rlike(r"^[A-Z][^.]*[?!]$") | t.rlike(r"^¿.*\?$") | t.rlike(r"^¡.*!$")


def merge_traits(c: Column, least: int = 20) -> Column:
    """What the merge rules ask of a block, as a struct of flags: told once a block, not once a pair."""
    t = T.strip(c)
    first = F.lower(F.regexp_extract(t, r"^(\S+)", 1))
    flags = {
        "empty": t == "", "section": is_section_title(t), "dash": t.startswith("—"), "spoken": _spoken(t), "full_stop": t.endswith("."),
        "alone": t.rlike("[?!]$") & (F.length(t) < 50), "goes_on": (F.length(t) >= least) & ~t.rlike(r"^\p{Lu}") & first.isin(*CONTINUES),
    }
    return F.when(c.isNotNull(), F.struct(*[f.alias(name) for name, f in flags.items()]))


def merges(a: Column, b: Column, gap: Column | None = None, largest: float = 10.0) -> Column:
    """Whether the block of traits ``b`` belongs to that of ``a``: no titles, no change between narration and
    speech, close."""
    gap = F.lit(5.0) if gap is None else F.coalesce(gap, F.lit(5.0))
    barred = a["empty"] | b["empty"] | a["section"] | b["section"] | (a["dash"] != b["dash"]) | (a["spoken"] != b["spoken"]) | (gap > largest)
    plain = ~a["dash"] & ~b["dash"] & ~a["alone"] & ~b["alone"] & (gap <= 5.0)
    return ~barred & ((~a["full_stop"] & b["goes_on"]) | plain)


def valid_block(c: Column) -> Column:
    t = T.strip(c)
    return (F.length(t) >= 10) & ~T.is_digits(t) & ~t.rlike(r"^[\p{P}\p{S}\s]+$")


def merged_blocks(b: DataFrame, doc: str, pos: str, text: str) -> DataFrame:
    """Runs of neighbouring blocks that belong together, joined with blanks: lag, running sum, group."""
    w = Window.partitionBy(doc).orderBy(pos)
    b = b.where(valid_block(F.col(text))).withColumn("_traits", merge_traits(F.col(text))).withColumn("_last", F.lag("_traits").over(w))
    b = b.withColumn("_new", F.when(F.col("_last").isNull() | ~merges(F.col("_last"), F.col("_traits")), 1).otherwise(0))
    b = b.withColumn("run", F.sum("_new").over(w))
    g = b.groupBy(doc, "run").agg(F.sort_array(F.collect_list(F.struct(pos, T.strip(F.col(text)).alias("t")))).alias("_s"))
    return g.select(doc, F.col("run").alias("segment_order"), F.array_join(F.col("_s.t"), " ").alias("segment"), F.size("_s").alias("merged"))


def subdivide(c: Column, size: int = 600) -> Column:
    """A block over ``size`` characters is cut at line starts, pieces up to that size where lines allow."""

    def step(acc: Column, line: Column) -> Column:
        last = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))
        fits = (F.size(acc) > 0) & (F.length(last) + 1 + F.length(line) <= size)
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, F.lit("\n"), line)))
        return F.when(fits, joined).otherwise(F.concat(acc, F.array(line)))

    return F.when(F.length(c) < size, F.array(c)).otherwise(F.aggregate(F.split(c, "\n"), F.array().cast("array<string>"), step))


# ---- verse

ROMAN = "I|II|III|IV|V|VI|VII|VIII|IX|X|XI|XII|XIII|XIV|XV|XVI|XVII|XVIII|XIX|XX"
VERSE_MARKS = (
    r"[,;]\s+\w+", r"\.\s*$", r"!\s*$", r"\?\s*$", r";\s*$", r"^(?:La|El|Los|Las|Una|Un|Unos|Unas)\s+\w+", r"^\w+\s+(?:se\s+)?\w+",
    r"^(?:Con|Sin|Por|Para|Desde|Hasta|Sobre|Bajo)\s+", r"\b(?:se|me|te|le|nos)\s+\w+", r"\b(?:anuncia|viene|pasa|llega|corre|vuela|suena|brilla)\b",
    r"\b\w+(?:or|ar|er)\b",
)  # fixed values: what speaks against a title
FORMS = "Canción|Soneto|Elegía|Oda|Balada"


def poem_title(c: Column) -> Column:
    t = T.strip(c)
    verse = t.rlike(r"(?i)[,;]\s+\w+") | t.rlike(r"[.!?]\s*$") | t.rlike(r"(?i)^(?:He|Yo|Tú)\s+")
    shape = t.rlike(rf"(?i)^(?:{FORMS}|Poema|Verso)\s+") | t.rlike(r"(?i)^[A-Z][a-z]+\s+[A-Z][a-z]+$") | t.rlike(r"(?i)^.+\s+(?:I|II|III|IV|V|VI|VII|VIII|IX|X)$")
    shape = shape | t.rlike(r"(?i)^(?:Del|El|La|Los|Las|De la|De los|En el|En la)\s+[A-Z]")
    return (t != "") & (F.length(t) <= 80) & ~verse & shape


def title_block(c: Column, marked: Column | None = None) -> Column:
    """Whether a block is a poem's title: what accepts comes first, then what rejects, then the title shapes."""
    t = T.strip(c)
    first = T.strip(F.regexp_extract(t, r"^([^\n]*)", 1))
    capitals = T.is_upper(t) & F.length(t).between(3, 100) & ~t.rlike("[.,;!?]$") & (F.size(T.words(t)) <= 10) & ~t.rlike(r"^(?:ANTOLOGÍA|PÁGINA\s+\d+)$")
    yes = (t.rlike(r"\*\*.*\*\*") & (F.length(t) < 100)) | first.rlike(rf"^(?:{ROMAN}|\d+)\.?$") | (t.rlike(r'(?s)^".*"$') & (F.length(t) < 80))
    yes = yes | t.rlike(r"(?i)^poema\s+\d+$") | capitals | t.rlike(rf"(?i)^(?:{FORMS})\s+")
    if marked is not None:
        yes = yes | (marked & (F.length(t) < 80))
    no = F.lit(False)
    for p in VERSE_MARKS:
        no = no | t.rlike("(?iu)" + p)
    # no title shape is over 80 characters: the rejecting patterns need not read longer blocks
    return (t != "") & F.when(yes, True).when((F.length(t) > 80) | no, False).otherwise(poem_title(c))


def is_verse(c: Column, longest: int = 120) -> Column:
    t = T.strip(c)
    return (t != "") & (F.length(t) <= longest)


def presplit(docs: DataFrame, key: str, text: str, size: int = 1000) -> DataFrame:
    """Blocks over ``size`` characters are cut before each of their lines that is a title."""
    l = lines(docs.where(F.length(text) > size), key, text)
    w = Window.partitionBy(key).orderBy("pos")
    l = l.withColumn("run", F.sum(F.when((F.col("pos") > 0) & title_block(F.col("line")), 1).otherwise(0)).over(w))
    g = l.groupBy(key, "run").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("_l"))
    cut = g.select(key, F.col("run").cast("int").alias("piece"), F.array_join(F.col("_l.line"), "\n").alias("block"))
    return cut.unionByName(docs.where(F.length(text) <= size).select(key, F.lit(0).alias("piece"), F.col(text).alias("block")))


def poems(b: DataFrame, doc: str, pos: str, text: str) -> DataFrame:
    """(doc, poem, title, verses, segment): poems as runs of blocks that a title opens.

    A poem ends at the next title (a secondary one only once three blocks are held), after more than two
    empty blocks, or at a block over 300 characters and 40 words once two are held; what follows such an
    end has no title and is dropped until a title comes, as is what stands before the first. The rules look
    back at what is held, so each document is folded in order by one grouped call over its flagged blocks.
    """
    t = F.col(text)
    flags = b.select(doc, pos, T.strip(t).alias("t"), title_block(t).alias("title"), ((F.length(T.strip(t)) > 300) & (T.word_count(t) > 40)).alias("bulky"), (T.is_upper(T.strip(t)) | t.rlike(rf"^\s*(?:{ROMAN}|\d+)\.?\s*$")).alias("main"), is_verse(t).alias("verse"))

    # what stands before a document's first title leaves no trace, so neither it nor untitled documents go to Python
    flags = flags.withColumn("_titled", F.max("title").over(Window.partitionBy(doc).orderBy(pos))).where("_titled").drop("_titled")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        out, held, title, blank = [], [], None, 0

        def close() -> None:
            if title is not None and held:
                out.append((rows[doc].iloc[0], len(out) + 1, title, sum(v for _, v in held), "\n".join([title, *[x for x, _ in held]])))

        for r in rows.sort_values(pos).itertuples(index=False):
            if not r.t:
                blank += 1
                if blank > 2:
                    close()
                    held, title = [], None
                continue
            blank = 0
            if r.title and (r.main or title is None or len(held) > 3):
                close()
                held, title = [], r.t
            elif r.bulky and not r.title and len(held) > 2:
                close()
                held, title = [], None
            elif title is not None:
                held.append((r.t, bool(r.verse)))
        close()
        return pd.DataFrame(out, columns=[doc, "poem", "title", "verses", "segment"])

    return flags.groupBy(doc).applyInPandas(fold, f"{doc} {b.schema[doc].dataType.simpleString()}, poem int, title string, verses int, segment string")


def verse_or_prose(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Poems where a document has any, else its prose paragraphs."""
    found = poems(lines(docs, key, text), key, "pos", "line").select(key, F.col("poem").alias("segment_order"), F.lit("poem").alias("kind"), "segment")
    rest = docs.join(found.select(key).distinct(), key, "left_anti")
    plain = prose(rest, key, text).select(key, (F.col("pos") + 1).alias("segment_order"), F.lit("paragraph").alias("kind"), "segment")
    return found.unionByName(plain)


def typed_runs(b: DataFrame, doc: str, pos: str, kind: str, text: str) -> DataFrame:
    """Cuts at blocks typed as titles: each run is a poem of a markdown source."""
    w = Window.partitionBy(doc).orderBy(pos)
    b = b.withColumn("run", F.sum(F.col(kind).rlike("title|heading").cast("int")).over(w)).where("run > 0")
    g = b.groupBy(doc, "run").agg(F.sort_array(F.collect_list(F.struct(pos, text))).alias("_s"))
    return g.select(doc, F.col("run").cast("int").alias("poem"), F.array_join(F.col(f"_s.{text}"), "\n").alias("segment"))


# ---- chunking strategies

REFERENCE = r"\{\s*([A-Z]{2,5})\s+(\d{1,3}\.\d{1,3})\s*\}"


def by_reference(docs: DataFrame, key: str, text: str, pattern: str = REFERENCE) -> DataFrame:
    """One chunk from each reference like ``{PVGM 12.3}`` up to the next; what stands before the first goes.
    A text without a reference is one chunk."""
    cut = F.split(text, f"(?={pattern})")
    kept = F.when(F.regexp_count(text, F.lit(pattern)) == 0, F.array(text)).otherwise(F.filter(cut, lambda x: x.rlike(f"^{pattern}")))
    d = docs.select(key, F.posexplode(kept).alias("pos", "chunk"))
    return d.withColumn("reference", F.nullif(F.regexp_extract("chunk", f"^{pattern}", 0), F.lit("")))


def whole(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.lit(0).alias("pos"), T.strip(F.col(text)).alias("chunk"))


def notes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Notes of a Markdown text: one for each first-level heading."""
    parts = F.filter(F.split(text, r"(?m)^#[ \t]+"), lambda x: T.strip(x) != "")
    d = docs.select(key, F.posexplode(parts).alias("pos", "_n"))
    return d.select(key, "pos", F.regexp_extract("_n", r"^([^\n]*)", 1).alias("title"), T.strip(F.regexp_replace("_n", r"^[^\n]*\n?", "")).alias("content"))


def library_segments(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Blank-line paragraphs of a stored document, or one ``document`` segment."""
    parts = F.filter(F.split(text, "\n\n"), lambda x: T.strip(x) != "")
    d = docs.select(key, text, parts.alias("_p"))
    many = F.size("_p") > 1
    d = d.select(key, F.when(many, "paragraph").otherwise("document").alias("kind"), F.posexplode(F.when(many, F.col("_p")).otherwise(F.array(text))).alias("pos", "segment"))
    return d.select(key, (F.col("pos") + 1).alias("segment_order"), "kind", "segment")


STRATEGIES = {"paragraph": paragraphs, "whole": whole, "reference": by_reference, "notes": notes}
SEGMENTERS = {"heading": heading_segments, "verse": verse_or_prose, "prose": prose, "library": library_segments}


def register_segmenter(name: str, f) -> None:
    """A segmenter is a table function: (docs, key, text) to segments."""
    SEGMENTERS[name] = f


def enriched(segments: DataFrame, docs: DataFrame, key: str, text: str, path: str, language: str | None = None, author: str | None = None, segmenter: str = "heading", version: str = "1.0") -> DataFrame:
    """Full segment records: ids by hash, so that runs can be compared; overrides before detected values."""
    head = docs.select(key, F.sha2(text, 256).alias("document_hash"), F.col(path).alias("source_file_path"), T.language_vote(F.col(text)).alias("_lang"))
    s = segments.join(head, key)
    lang = F.coalesce(F.lit(language), F.nullif(F.col("_lang"), F.lit("und")), F.lit("unknown"))
    return s.select(
        F.sha2(F.concat_ws("-", "document_hash", "segment_order"), 256).alias("segment_id"), F.col("document_hash").alias("document_id"), lang.alias("document_language"),
        F.col("segment").alias("text"), F.coalesce("kind", F.lit("text_block")).alias("segment_type"), "segment_order", F.length("segment").alias("text_length"),
        "source_file_path", "document_hash", F.lit(author).cast("string").alias("document_author"), F.lit(version).alias("pipeline_version"), F.lit(segmenter).alias("segmenter_used"),
    )
