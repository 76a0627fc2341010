"""Text expressions: every function takes and returns Columns, so all of it stays in Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and what they fold to, and the letters of the corpus languages
ACCENTED = "ÁÀÂÄÃÅáàâäãåÉÈÊËéèêëÍÌÎÏíìîïÓÒÔÖÕóòôöõÚÙÛÜúùûüÑñÇçÝýÿ"
FOLDED = "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuNnCcYyy"
WS = r"[ \t\n\r\f\x0B]"
NOT_WS = r"[^ \t\n\r\f\x0B]"
PARTICLES = ("de", "del", "la", "las", "los", "y", "e")
STOP_WORDS = ("del", "de", "la", "el", "los", "las", "un", "una", "y", "o", "a", "en", "con", "por", "para", "que")


def strip(c: Column) -> Column:
    """White space off both ends (Spark's trim takes blanks only)."""
    return F.btrim(c, F.lit(" \t\n\r\f\x0B"))


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({NOT_WS}+)"), F.lit(1))


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(f"{NOT_WS}+")), F.lit(0))


def fold_accents(c: Column) -> Column:
    return F.lower(F.translate(c, ACCENTED, FOLDED))


def name_key(c: Column) -> Column:
    """Names compare by this: folded, punctuation to blanks, squeezed."""
    return squeeze(F.regexp_replace(fold_accents(c), r"[^a-z0-9 ]", " "))


def is_upper(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def is_digits(c: Column) -> Column:
    return c.rlike(r"^[0-9]+$")


def preview(c: Column, size: int = 200) -> Column:
    return F.when(F.length(c) > size, F.concat(F.left(c, F.lit(size)), F.lit("..."))).otherwise(c)


def clean_filename(c: Column) -> Column:
    """Letters, digits, dot, dash and underscore; runs of others become one underscore; never empty."""
    name = F.regexp_replace(F.regexp_replace(strip(c), r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("unnamed_file"))


def clean_name(c: Column) -> Column:
    """A person's name: squeezed, edge punctuation off, capitalised, particles in small letters."""
    bare = F.regexp_replace(squeeze(c), r"^[^\p{L}]+|[^\p{L}.]+$", "")
    parts = F.split(F.initcap(F.lower(bare)), " ")
    keep = F.transform(parts, lambda w, i: F.when((i > 0) & F.lower(w).isin(*PARTICLES), F.lower(w)).otherwise(w))
    return F.array_join(keep, " ")


def author_override(c: Column) -> Column:
    return F.nullif(F.left(squeeze(F.regexp_replace(c, r"[<>|:*?\"\\/\n\r]", "")), F.lit(200)), F.lit(""))


def valid_language(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z-]{2,5}$") & c.rlike("[A-Za-z]")


def merge_separator(left: Column, right: Column) -> Column:
    """What stands between two joined blocks: nothing after a hyphen or before punctuation, else a blank."""
    return F.when(left.endswith("-") | right.rlike(r"^[.,;:!?)\]]"), F.lit("")).otherwise(F.lit(" "))


def context(c: Column, at: Column, size: Column, around: int = 50) -> Column:
    """``around`` characters on each side of the 0-based place ``at``, with ellipses where text is cut."""
    start = F.greatest(at - around, F.lit(0))
    end = F.least(at + size + around, F.length(c))
    body = F.regexp_replace(F.substring(c, start + 1, end - start), "\n", " ")
    return F.concat(F.when(start > 0, F.lit("...")).otherwise(F.lit("")), body, F.when(end < F.length(c), F.lit("...")).otherwise(F.lit("")))


def fixed(c: Column, unit: str) -> Column:
    """One decimal, halves to the even digit, and the unit."""
    return F.concat(F.format_string("%.1f", F.bround(c.cast("decimal(38,20)"), 1).cast("double")), F.lit(unit))


def format_duration(seconds: Column) -> Column:
    return (
        F.when(seconds < 1, F.concat(F.bround((seconds * 1000).cast("decimal(38,20)"), 0).cast("long").cast("string"), F.lit("ms")))
        .when(seconds < 60, fixed(seconds, "s"))
        .when(seconds < 3600, fixed(seconds / 60, "m"))
        .otherwise(fixed(seconds / 3600, "h"))
    )


def format_size(n: Column) -> Column:
    d = n.cast("double")
    return (
        F.when(d < 1024, fixed(d, " B"))
        .when(d < 1024**2, fixed(d / 1024, " KB"))
        .when(d < 1024**3, fixed(d / 1024**2, " MB"))
        .otherwise(fixed(d / 1024**3, " GB"))
    )


def paragraphs_html(c: Column) -> Column:
    parts = F.filter(F.split(c, "\n{2,}"), lambda p: strip(p) != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<p>"), F.regexp_replace(strip(p), "\n", "<br>"), F.lit("</p>"))), "")


def highlight(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, f"(?i)({pattern})", "<mark>$1</mark>")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Similarity 0..1 of two names whatever the order of their words, by edit distance."""
    ordered = lambda c: F.array_join(F.array_sort(F.split(name_key(c), " ")), " ")
    x, y = ordered(a), ordered(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / longest)


def language_vote(c: Column) -> Column:
    """Language by the stop words in the first 1,000 characters; texts under 20 characters are ``und``."""
    # Function words that vote for a language
    votes = {
        "de": ("der", "die", "und", "das", "nicht", "ist", "ein", "sich", "mit", "den"),
        "en": ("the", "of", "and", "to", "in", "is", "that", "with", "for", "was"),
        "es": ("de", "la", "que", "el", "en", "los", "las", "por", "con", "una"),
        "fr": ("le", "la", "les", "de", "et", "un", "une", "dans", "pour", "que"),
    }
    head = F.filter(F.split(F.lower(F.left(c, F.lit(1000))), r"[^\p{L}]+"), lambda w: w != "")
    count = lambda vs: F.size(F.filter(head, lambda w: w.isin(*vs)))
    scores = [F.struct(count(vs).alias("n"), F.lit(lang).alias("lang")) for lang, vs in votes.items()]
    best = F.array_max(F.array(*scores))
    return F.when((F.length(strip(c)) < 20) | (best["n"] == 0), F.lit("und")).otherwise(best["lang"])


def publication_date(c: Column) -> Column:
    """``YYYY-MM-DD``, or a bare year as it is."""
    text = strip(c)
    formats = ("yyyy-MM-dd", "dd/MM/yyyy", "yyyy/MM/dd", "dd-MM-yyyy", "yyyyMMdd")
    shapes = (r"^\d{4}-\d{2}-\d{2}$", r"^\d{2}/\d{2}/\d{4}$", r"^\d{4}/\d{2}/\d{2}$", r"^\d{2}-\d{2}-\d{4}$", r"^\d{8}$")
    tried = [F.when(text.rlike(s), F.date_format(F.try_to_timestamp(text, F.lit(f)), "yyyy-MM-dd")) for s, f in zip(shapes, formats)]
    return F.coalesce(F.when(text.rlike(r"^\d{4}$"), text), *tried)


def filename_date(c: Column) -> Column:
    """The first valid date in a file name: year-month-day, day-month-year or eight digits, from 1900 on."""
    ymd = F.regexp_extract(c, r"((?:19|20)\d{2}[-_]\d{2}[-_]\d{2})", 1)
    dmy = F.regexp_extract(c, r"(?<!\d)(\d{2}[-_]\d{2}[-_](?:19|20)\d{2})(?!\d)", 1)
    solid = F.regexp_extract(c, r"(?<!\d)((?:19|20)\d{6})(?!\d)", 1)
    as_date = lambda s, f: F.date_format(F.try_to_timestamp(F.translate(F.nullif(s, F.lit("")), "_", "-"), F.lit(f)), "yyyy-MM-dd")
    return F.coalesce(as_date(ymd, "yyyy-MM-dd"), as_date(dmy, "dd-MM-yyyy"), as_date(solid, "yyyyMMdd"))


def partial_date(c: Column) -> Column:
    """``YYYY-MM-DD``, ``YYYY-MM`` or ``YYYY`` in a file name, as written."""
    parts = [F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in (r"(\d{4}-\d{2}-\d{2})", r"(\d{4}-\d{2})", r"(\d{4})")]
    return F.coalesce(*parts)
