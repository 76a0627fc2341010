"""Block cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import text as T

# The placeholder of unreadable text, words that a block may not consist of, words that run on
CORRUPT = "texto corrupto en archivo de origen"
RUN_ON = ("de", "del", "en", "con", "por", "para", "que", "y", "o", "pero", "sin", "a", "al")
LETTER = "a-zA-ZáéíóúüñÁÉÍÓÚÜÑ"


def control_chars(c: Column, by: str = "") -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", by)


def unicode_noise(c: Column, keep_lines: bool = False) -> Column:
    """Escapes, control and invisible characters become blanks; a long text with hardly a letter becomes a
    placeholder; lone symbols, letters and small numbers go; white space collapses, line ends too unless kept."""
    t = F.regexp_replace(c, r"\\u[0-9a-fA-F]{4}", " ")
    t = control_chars(t, " ")
    t = F.regexp_replace(t, r"[\x{FEFF}\x{200B}-\x{200F}\x{2028}\x{2029}]", " ")
    t = F.regexp_replace(t, r"\\[uU][0-9a-fA-F]{0,3}(?![0-9a-fA-F])", " ")
    solid = F.length(F.regexp_replace(t, r"[ \n]", ""))
    letters = F.regexp_count(t, F.lit(f"[{LETTER}]"))
    real_words = F.regexp_count(t, F.lit(f"[{LETTER}]{{3,}}"))
    corrupt = (solid > 50) & (letters / F.nullif(solid, F.lit(0)) < 0.3) & (real_words < 2)
    u = F.regexp_replace(t, rf"{T.WS}[+\-*/&%#$@!]{{1,2}}{T.WS}", " ")
    u = F.regexp_replace(u, rf"{T.WS}[a-zA-Z]{T.WS}", " ")
    u = F.regexp_replace(u, rf"{T.WS}[0-9]{{1,2}}{T.WS}", " ")
    u = F.regexp_replace(F.regexp_replace(u, r"[ \t\r\f\x0B]+", " "), r"\n{3,}", "\n\n") if keep_lines else F.regexp_replace(u, f"{T.WS}+", " ")
    return F.when(corrupt, F.lit(CORRUPT)).otherwise(T.strip(u))


def block_text(c: Column, keep_lines: bool = False) -> Column:
    return T.strip(unicode_noise(F.regexp_replace(T.unix_lines(c), r"\x00", ""), keep_lines))


def insignificant(c: Column, min_chars: int = 15, max_word: int = 50, numbers: bool = True, artefacts: bool = True) -> Column:
    """Page numbers, stray words, roman numerals, lone letters and dates."""
    out = F.length(c) < min_chars
    if numbers:
        out = out | c.rlike(r"^[0-9]+[.\-]*[0-9]*$")
    out = out | (~c.rlike(T.WS) & (F.length(c) > max_word))
    if artefacts:
        out = out | F.lower(c).isin(*T.STOP_WORDS) | ((F.length(c) <= 3) & ~T.is_digits(c)) | c.rlike("^[IVXivx]+$") | c.rlike("^[a-zA-Z]$")
        out = out | c.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}$")
    return out


def repeat_share(c: Column) -> Column:
    """Letters that repeat the one before them, as a share of the text."""
    return (F.length(c) - F.length(F.regexp_replace(c, r"(\p{L})\1+", "$1"))) / F.nullif(F.length(c), F.lit(0))


def extremely_corrupt(c: Column) -> Column:
    t = T.strip(c)
    bad = F.regexp_count(t, F.lit("\\x{FFFD}"))
    runs = t.rlike(r"\x{FFFD}{10,}") | t.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]{5,}") | t.rlike(r"^[ \x{FFFD}\x00-\x1F\x7F-\x9F]+$")
    return (F.length(t) >= 10) & ((bad >= 50) | runs | ((bad >= 20) & (bad > F.length(t) * 0.5)))


def doubled(c: Column) -> Column:
    """Whether over 30 % of the letters stand twice, as in badly decoded PDFs."""
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return F.regexp_count(c, F.lit(r"(\p{L})\1")) * 2 > letters * 0.3


def undouble(c: Column) -> Column:
    """AABBCC lines halve; else runs of a character shrink to one."""
    return F.when(c.rlike(r"^(?:(.)\1)+$"), F.regexp_replace(c, r"(.)\1", "$1")).otherwise(F.regexp_replace(c, r"(.)\1+", "$1"))


def poem_text(c: Column, heads: tuple[str, ...] = ()) -> Column:
    """Page numbers, ``N de M``, navigation words and running ``heads`` go; lines are stripped, empty ones too."""
    t = F.regexp_replace(c, r"(?i)Página\s+\d+", "")
    t = F.regexp_replace(t, r"\b\d+\s+de\s+\d+\b", "")
    t = F.regexp_replace(t, r"(?im)^[ \t]*(Anterior|Siguiente|Índice|Contenido|\d+)[ \t]*$", "")
    for head in heads:
        t = F.regexp_replace(t, rf"(?im)^[ \t]*\Q{head}\E[ \t]*$", "")
    return F.array_join(F.filter(F.transform(F.split(t, "\n"), T.strip), lambda x: x != ""), "\n")


def structural_key(c: Column) -> Column:
    """Key by which repeated heads are found: marks off, punctuation to blanks, folded, small pieces glued."""
    bare = T.squeeze(F.regexp_replace(F.regexp_replace(T.fold_accents(c), r"[*_~\[\]{}()]", ""), r"[^a-z0-9 ]", " "))
    return F.regexp_replace(bare, r"(?<= |^)([a-z]{1,3}) (?=[a-z]{1,3}(?: |$))", "$1")


def page_share(blocks: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, norm, pages, share): on how many of a document's pages each normalised text stands."""
    b = blocks.select(doc, page, structural_key(F.col(text)).alias("norm")).where("norm <> ''").distinct()
    total = blocks.select(doc, page).distinct().groupBy(doc).agg(F.count(F.lit(1)).alias("total"))
    return b.groupBy(doc, "norm").agg(F.count(F.lit(1)).alias("pages")).join(total, doc).withColumn("share", F.col("pages") / F.col("total"))


def running_heads(blocks: DataFrame, doc: str, page: str, text: str, share: float = 0.9, pages: int = 5) -> DataFrame:
    return page_share(blocks, doc, page, text).where((F.col("total") >= pages) & (F.col("share") >= share)).select(doc, "norm")


def without_heads(blocks: DataFrame, heads: DataFrame, doc: str, text: str) -> DataFrame:
    keyed = blocks.withColumn("norm", structural_key(F.col(text)))
    return keyed.join(heads, [doc, "norm"], "left_anti").drop("norm")


def fragmented(blocks: DataFrame, doc: str, text: str) -> DataFrame:
    """Per document, whether its blocks look like OCR fragments, and the ratios that say so."""
    t = F.col(text)
    short = lambda c: F.avg(c.cast("double"))
    s = blocks.groupBy(doc).agg(
        F.count(F.lit(1)).alias("n"),
        short(F.length(t) < 100).alias("short"),
        short(~F.contains(t, F.lit("\n"))).alias("single"),
        short(~T.strip(t).rlike(r"[.!?:;]$")).alias("open_end"),
        F.avg(F.length(t)).alias("avg_len"),
    )
    many = (F.col("n") >= 50) & (F.col("short") > 0.65) & (F.col("single") > 0.75) & (F.col("open_end") > 0.7)
    return s.withColumn("fragmented", many | ((F.col("n") > 500) & (F.col("avg_len") < 120) & (F.col("short") > 0.5)))


def looks_like_title(c: Column) -> Column:
    """Short, a capital first, and of five words at most over 60 % with capitals."""
    parts = T.words(c)
    capital = F.size(F.filter(parts, lambda w: w.rlike(r"^\p{Lu}")))
    return (F.length(c) <= 100) & c.rlike(r"^\p{Lu}") & (F.size(parts) <= 5) & (capital > 0.6 * F.size(parts))


def merges_lines(left: Column, right: Column) -> Column:
    """Whether the line ``right`` goes on from the paragraph ``left``."""
    a, b = T.strip(left), T.strip(right)
    last = F.lower(F.element_at(F.split(a, f"{T.WS}+"), -1))
    goes_on = ~a.rlike(r"[.!?:;]$") & b.rlike(r"^\p{Ll}")
    return (a != "") & (b != "") & (F.length(a) <= 500) & ~looks_like_title(b) & (last.isin(*RUN_ON) | goes_on)


def merge_lines(lines: Column) -> Column:
    """Folds an array of lines into paragraphs by ``merges_lines`` against the paragraph built so far."""
    clean = F.filter(F.transform(lines, T.strip), lambda x: x != "")

    def step(acc: Column, line: Column) -> Column:
        last = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, T.merge_separator(last, line), line)))
        return F.when(merges_lines(last, line), joined).otherwise(F.concat(acc, F.array(line)))

    return F.aggregate(clean, F.array().cast("array<string>"), step)


def prepared(blocks: DataFrame, doc: str, pos: str, text: str, min_chars: int = 15) -> DataFrame:
    """The whole block pass: clean, drop what is insignificant, number what is left."""
    b = blocks.withColumn(text, block_text(F.col(text), keep_lines=True)).where(~insignificant(F.col(text), min_chars))
    return b.withColumn("order", F.row_number().over(Window.partitionBy(doc).orderBy(pos)))
