"""Author attribution from texts, titles and dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.functions import text as T

NAME = r"[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(?:\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+){1,3}"
# How texts name their author
ATTRIBUTIONS = (
    rf"(?:[Aa]utor|[Aa]utora|[Ee]scrito\s+por|[Cc]ompuesto\s+por|[Cc]reado\s+por)\s*:?\s*({NAME})",
    rf"(?:[Pp]oema|[Ss]oneto|[Oo]bra|[Tt]exto|[Ll]ibro|[Cc]uento|[Nn]ovela)\s+(?:de|del)\s+({NAME})",
    rf"(?m)^({NAME})\s*[-–—]",
    rf"\n\s*({NAME})\s*$",
)
# Verbs and nouns of authorship
VERBS = ("escribir", "componer", "crear", "redactar", "firmar", "elaborar", "desarrollar", "producir", "realizar")
NOUNS = ("autor", "autora", "poeta", "poetisa", "escritor", "escritora", "novelista", "dramaturgo", "ensayista", "cronista")
# How names of persons look, and words that they don't consist of
ENDINGS = ("o", "os", "án", "ón", "és", "ez", "iz", "uz", "a", "as", "ía", "ción", "sión", "dad", "tad")
SURNAMES = ("ez", "az", "iz", "oz", "uz")
TITLES = ("don", "doña", "fray", "sor", "san", "santa", "santo", "dr", "dra", "prof", "lic", "ing", "arq")
PREFIXES = ("de", "del", "la", "las", "los", "san", "santa")
POETIC = ("zumbas", "vuela", "canta", "baila", "danza", "susurra", "murmura", "grita", "llora", "ríe", "blanca", "negra", "dorada", "plateada")
SOFTWARE = "adobe|acrobat|distiller|microsoft|word|latex|pdf|calibre|http|www|scanner"
SECTIONS = "introducción|conclusión|anexo|apéndice|bibliografía|capítulo|prólogo|epílogo|índice"
WEIGHTS = {"literary_db": 1.0, "context_override": 0.95, "markers": 0.9, "document": 0.85, "contextual": 0.8, "enhanced": 0.75, "stylistic": 0.7, "other": 0.5}


def valid_name(c: Column) -> Column:
    """Two to four words of 2 to 20 letters with capitals, no digits or brackets, no poetic word."""
    ws = F.split(c, r"\s+")
    good = F.forall(ws, lambda w: w.rlike(r"^\p{Lu}") & F.length(w).between(2, 20))
    return (F.length(c) >= 3) & F.size(ws).between(2, 4) & good & ~c.rlike(r"[0-9()\[\]{}]") & ~F.lower(c).rlike("|".join(POETIC))


def is_software(c: Column) -> Column:
    return F.lower(c).rlike(SOFTWARE)


def is_section(c: Column) -> Column:
    return F.lower(c).rlike(SECTIONS)


def _names(text: Column) -> Column:
    """Names that a text gives as its author's: valid as they stand, cleaned, as often as they are given."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in ATTRIBUTIONS]))
    return F.transform(F.filter(found, valid_name), T.clean_name)


def attributions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, n): names that the text gives as its author's, each spelling cleaned and valid."""
    names = docs.select(key, F.explode_outer(_names(F.col(text))).alias("name")).where("name IS NOT NULL")
    return names.groupBy(key, "name").agg(F.count(F.lit(1)).alias("n"))


def merge_candidates(candidates: DataFrame, key: str, name: str) -> DataFrame:
    """Spellings of one folded name become one candidate under the commonest of them."""
    c = candidates.groupBy(key, T.name_key(F.col(name)).alias("folded"), name).agg(F.count(F.lit(1)).alias("_n"))
    return c.groupBy(key, "folded").agg(F.max_by(name, F.struct("_n", name)).alias("name"), F.sum("_n").alias("n"))


def morphology(name: Column) -> Column:
    """0 to 1: how much the words look like Spanish names."""
    ws = F.split(F.lower(F.trim(name)), r"\s+")

    def score(w: Column, i: Column) -> Column:
        add = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
        s = add(w.isin(*TITLES), 0.3) + add(w.rlike(f"(?:{'|'.join(ENDINGS)})$"), 0.4)
        s = s + add((i > 0) & w.rlike(f"(?:{'|'.join(SURNAMES)})$"), 0.5) + add((i > 0) & w.rlike(f"^(?:{'|'.join(PREFIXES)})"), 0.3)
        s = s + add(w.rlike("[bcdfghjklmnpqrstvwxyz][aeiouáéíóú]|[aeiouáéíóú][bcdfghjklmnpqrstvwxyz]|rr|ll|ch|ñ"), 0.2)
        return F.least(s, F.lit(1.0))

    total = F.aggregate(F.transform(ws, score), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(ws) < 2, 0.0).otherwise(F.least(total / F.size(ws), F.lit(1.0)))


def contextual(text: Column, name: Column) -> Column:
    """0 to 1 over the sentences that hold the name: verbs and nouns of authorship, ``por NAME``."""
    low, n = F.lower(text), F.lower(name)
    mine = F.filter(F.split(low, "[.!?]"), lambda s: F.contains(s, n))

    def one(s: Column) -> Column:
        verbs = sum((F.contains(s, F.lit(v)).cast("int") for v in VERBS), F.lit(0)) * 0.4
        nouns = sum((F.contains(s, F.lit(v)).cast("int") for v in NOUNS), F.lit(0)) * 0.3
        by = F.when(F.contains(s, F.concat(F.lit("por "), n)) | F.contains(s, F.concat(F.lit("de "), n)), 0.5).otherwise(0.0)
        return F.least(verbs + nouns + by, F.lit(1.0))

    return F.least(F.coalesce(F.array_max(F.transform(mine, one)), F.lit(0.0)), F.lit(1.0))


def positional(place: Column) -> Column:
    """By where a name stands, 0 to 1 of the text."""
    return F.when(place < 0.1, 0.8).when(place < 0.2, 0.6).when(place > 0.9, 0.7).when(place > 0.8, 0.5).otherwise(0.2)


def cross_validation(text: Column, name: Column) -> Column:
    """1, less if the name is told about as a person or a character, or fills over 2 % of the words."""
    low, n = F.lower(text), F.lower(name)
    near = lambda words: F.call_function("rlike", low, F.concat(F.lit(f"(?:{words})[^.]{{0,40}}\\Q"), n, F.lit(f"\\E|\\Q"), n, F.lit(f"\\E[^.]{{0,40}}(?:{words})")))
    times = (F.length(low) - F.length(F.replace(low, n, F.lit("")))) / F.nullif(F.length(n), F.lit(0))
    s = 1.0 - F.when(near("nació|murió|biografía|vida de"), 0.4).otherwise(0.0) - F.when(near("personaje|protagonista|dijo"), 0.3).otherwise(0.0)
    return F.greatest(s - F.when(times / F.greatest(T.word_count(text), F.lit(1)) > 0.02, 0.5).otherwise(0.0), F.lit(0.0))


def confidence(morph: Column, context: Column, cross: Column, position: Column, n: Column) -> Column:
    return F.least(0.30 * morph + 0.20 * context + 0.30 * cross + 0.15 * position + 0.05 * F.least(n / 3, F.lit(1.0)), F.lit(1.0))


def attribute(docs: DataFrame, key: str, text: str, least: float = 0.0) -> DataFrame:
    """(key, author, confidence): the best contextual candidate of each document, scored where its text lies."""
    t = F.col(text)

    def scored(n: Column) -> Column:
        place = F.call_function("locate", n, t) / F.greatest(F.length(t), F.lit(1))
        times = F.size(F.filter("_names", lambda x: x == n))
        return F.struct(F.round(confidence(morphology(n), contextual(t, n), cross_validation(t, n), positional(place), times), 6).alias("confidence"), n.alias("name"))

    best = F.array_max(F.transform(F.array_distinct("_names"), scored))
    d = docs.withColumn("_names", _names(t)).where(F.size("_names") > 0).select(key, best.alias("_b"))
    return d.select(key, F.col("_b.name").alias("author"), F.col("_b.confidence").alias("confidence")).where(F.col("confidence") >= least)


def fallback_score(n: Column, first: Column, in_title: Column, known: Column) -> Column:
    """The basic detector's score: often .4, early .3, in the title .2, known .1."""
    return 0.4 * F.least(n / 3, F.lit(1.0)) + F.when(first < 0.2, 0.3).otherwise(0.0) + F.when(in_title, 0.2).otherwise(0.0) + F.when(known, 0.1).otherwise(0.0)


def from_title(title: Column) -> Column:
    """Candidate names in a title or path: its first two to four words, a name before a dash, ``Last, First``."""
    t = T.squeeze(F.regexp_replace(F.regexp_replace(F.regexp_extract(title, r"([^/]*)$", 1), r"\.[A-Za-z0-9]{1,5}$", ""), "_", " "))
    ws = F.split(t, " ")
    prefixes = F.transform(F.sequence(F.lit(2), F.lit(4)), lambda k: F.array_join(F.slice(ws, F.lit(1), k), " "))
    turned = F.regexp_replace(t, rf"^([A-ZÁÉÍÓÚÑ]\S+),\s*([A-ZÁÉÍÓÚÑ]\S+).*$", "$2 $1")
    dashed = F.regexp_extract(t, rf"^({NAME})\s+[-–—]\s+", 1)
    return F.array_distinct(F.filter(F.concat(F.array(turned, dashed), prefixes), lambda n: valid_name(n) & ~is_section(n)))


def metadata_author(*fields: Column) -> Column:
    """The first metadata field that holds a name and not a program's."""
    return F.coalesce(*[F.when(~is_software(f) & valid_name(T.clean_name(f)), T.clean_name(f)) for f in fields])


def known(candidates: DataFrame, name: str, dictionary: DataFrame, least: float = 0.85) -> DataFrame:
    """Adds ``canonical`` and ``match``: exact folded name 1.0, alias 0.95, else the best similarity from
    ``least`` on. ``dictionary``: (author, aliases). Exact matches are an equi-join; only names left over are
    compared, and only with authors that share a piece: of a name cut into one piece more than it may have edits,
    one piece stands unchanged in the other name, at most as many places off. No pair from ``least`` on is lost."""
    d = dictionary.select("author", F.explode(F.concat(F.array(F.struct(T.name_key(F.col("author")).alias("k"), F.lit(1.0).alias("m"))), F.transform("aliases", lambda a: F.struct(T.name_key(a).alias("k"), F.lit(0.95).alias("m"))))).alias("_d"))
    d = d.select("author", F.col("_d.k").alias("k"), F.col("_d.m").alias("m")).groupBy("k").agg(F.max(F.struct("m", "author")).alias("_e"))
    c = candidates.withColumn("_k", T.name_key(F.col(name)))
    exact = c.join(d, c["_k"] == d["k"], "left").drop("k")
    ordered = lambda k: F.array_join(F.array_sort(F.split(k, " ")), " ")
    edits = lambda n: F.floor((1 - least) / least * n + 1e-9).cast("int")
    at = lambda i, n: F.floor(i * n / (edits(n) + 1)).cast("int")
    numbers = lambda n: F.sequence(F.lit(0), edits(n))
    part = lambda c, n, i, start: F.struct(n.alias("n"), i.alias("i"), F.substring(c, start + 1, at(i + 1, n) - at(i, n)).alias("p"))
    x, y = F.col("_x"), F.col("_y")
    sizes = F.sequence(F.ceil(F.length(x) * least - 1e-9).cast("int"), F.floor(F.length(x) / least + 1e-9).cast("int"))
    shifts = lambda n, i: F.sequence(F.greatest(at(i, n) - edits(n), F.lit(0)), at(i, n) + edits(n))
    cuts = F.flatten(F.transform(sizes, lambda n: F.flatten(F.transform(numbers(n), lambda i: F.transform(shifts(n, i), lambda j: part(x, n, i, j))))))
    left = exact.where("_e IS NULL").select("_k").distinct().withColumn("_x", ordered(F.col("_k"))).select("_k", F.explode(F.array_distinct(cuts)).alias("_s"))
    right = d.select(F.col("k").alias("_dk"), F.col("_e.author").alias("_author"), ordered(F.col("k")).alias("_y"))
    right = right.select("_dk", "_author", F.explode(F.transform(numbers(F.length(y)), lambda i: part(y, F.length(y), i, at(i, F.length(y))))).alias("_t"))
    near = left.join(right, F.col("_s") == F.col("_t")).select("_k", "_dk", "_author").distinct().withColumn("_sim", T.token_sort_ratio(F.col("_k"), F.col("_dk")))
    near = near.where(F.col("_sim") >= least).groupBy("_k").agg(F.max(F.struct("_sim", "_author")).alias("_f"))
    out = exact.join(near, "_k", "left")
    return out.withColumn("canonical", F.coalesce("_e.author", "_f._author")).withColumn("match", F.coalesce("_e.m", F.round("_f._sim", 6), F.lit(0.0))).drop("_k", "_e", "_f")


def boosted(confidence: Column, match: Column) -> Column:
    factor = F.when(match >= 1.0, 1.3).when(match > 0, 1.2).otherwise(0.95)
    return F.least(confidence * factor, F.lit(1.0))


def person_validated(candidates: DataFrame, key: str, name: str, confidence: str, persons: DataFrame, person: str) -> DataFrame:
    """Adds ``ner_validated`` and scales ``confidence``: by 1.2 where a person found in the text has the candidate's
    name, by 1.1 where it shares at least half of a person's words with it (1 at most), by 0.95 where no one does.
    ``persons``: (key, person) from any recogniser of names over the first pages."""
    lower = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    found = persons.groupBy(F.col(key).alias("_key")).agg(F.collect_set(F.lower(F.trim(person))).alias("_persons"))
    c = candidates.join(found, F.col(key) == F.col("_key"), "left").withColumn("_words", lower(F.col(name)))
    exact = F.coalesce(F.array_contains("_persons", F.lower(F.trim(name))), F.lit(False))
    common = lambda p: F.size(F.array_intersect(F.col("_words"), lower(p)))
    partial = F.coalesce(F.exists("_persons", lambda p: (common(p) >= 1) & (common(p) >= F.size(F.array_distinct(lower(p))) * 0.5)), F.lit(False))
    scaled = F.when(exact, F.least(F.col(confidence) * 1.2, F.lit(1.0))).when(partial, F.least(F.col(confidence) * 1.1, F.lit(1.0))).otherwise(F.col(confidence) * 0.95)
    return c.withColumn("ner_validated", exact | partial).withColumn(confidence, scaled).drop("_key", "_persons", "_words")


def shares_tokens(a: Column, b: Column) -> Column:
    """Names agree: two words in common, or one name's words all in the other's."""
    x, y = F.split(T.name_key(a), " "), F.split(T.name_key(b), " ")
    return (F.size(F.array_intersect(x, y)) >= 2) | (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)


def choose(candidates: DataFrame, key: str, least: float = 0.7, title: str | None = None) -> DataFrame:
    """The best of several detectors' candidates (key, name, confidence, method): confidence times the
    method's weight, plus up to 0.2 for detectors that agree, plus 0.1 if a word stands in the title."""
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("method")), F.lit(0.5))
    c = candidates.withColumn("_k", T.name_key(F.col("name"))).withColumn("_w", F.col("confidence") * weight)
    g = c.groupBy(key, "_k").agg(F.max(F.struct("_w", "name", "method")).alias("_b"), F.countDistinct("method").alias("agree"))
    g = g.withColumn("final", F.col("_b._w") + F.least(F.lit(0.2), 0.1 * (F.col("agree") - 1)))
    best = g.groupBy(key).agg(F.max(F.struct("final", "_b.name", "_b.method", "agree")).alias("_r"))
    return best.select(key, F.col("_r.name").alias("author"), F.round("_r.final", 6).alias("confidence"), "_r.method", "_r.agree").where(F.col("confidence") >= least)


def literary(docs: DataFrame, key: str, text: str, dictionary: DataFrame, most: int = 10_000) -> DataFrame:
    """(key, author, score, markers): style markers (0.2 each) and works (0.3 each) that a text names.
    ``dictionary``: (author, markers, works), a list kept by hand of at most ``most`` entries; it goes to the texts
    as one row, and only what a text names leaves it."""
    d = dictionary.select("author", F.explode(F.concat(F.transform("markers", lambda m: F.struct(F.lower(m).alias("w"), F.lit(0.2).alias("p"))), F.transform("works", lambda m: F.struct(F.lower(m).alias("w"), F.lit(0.3).alias("p"))))).alias("_d"))
    d = d.select("author", "_d.w", "_d.p", F.regexp_extract("_d.w", r"^(\S+)", 1).alias("first"))
    if d.limit(most + 1).count() > most:
        raise ValueError(f"a dictionary of more than {most} entries is no list kept by hand")
    entries = F.broadcast(d.agg(F.collect_list(F.struct("author", "w", "p", "first")).alias("_entries")))
    low = docs.select(key, F.lower(text).alias("_low")).withColumn("_words", F.array_distinct(F.split("_low", r"[^\p{L}]+"))).join(entries)
    hit = low.select(key, F.explode(F.filter("_entries", lambda x: F.contains(F.col("_low"), x["w"]) & F.array_contains(F.col("_words"), x["first"]))).alias("_x")).select(key, "_x.*")
    return hit.groupBy(key, "author").agg(F.least(F.sum("p"), F.lit(1.0)).alias("score"), F.sort_array(F.collect_set("w")).alias("markers"))


def literary_match(scored: DataFrame, key: str, title: Column, filename: Column) -> DataFrame:
    """(key, author, confidence, source): who of ``literary``'s scores is taken: an author whom the title names from
    a score over 0.3, the file name from over 0.2, else the best score over 0.5."""
    named = lambda c: F.contains(T.name_key(c), T.name_key(F.col("author")))
    s = F.col("score")
    found = F.when(named(title) & (s > 0.3), F.struct(F.lit(3).alias("k"), F.least(F.lit(0.9), 0.7 + s).alias("c"), F.lit("document_title").alias("source")))
    found = found.when(named(filename) & (s > 0.2), F.struct(F.lit(2).alias("k"), F.least(F.lit(0.85), 0.6 + s).alias("c"), F.lit("filename").alias("source")))
    found = found.when(s > 0.5, F.struct(F.lit(1).alias("k"), F.least(F.lit(0.8), s).alias("c"), F.lit("text").alias("source")))
    best = scored.withColumn("_f", found).where("_f IS NOT NULL").groupBy(key).agg(F.max(F.struct("_f.k", "_f.c", "author", "_f.source")).alias("_b"))
    return best.select(key, F.col("_b.author").alias("author"), F.round("_b.c", 6).alias("confidence"), F.col("_b.source").alias("source"))


# Words of a title that go with the modernist style
MODERNIST = ("dario", "ruben", "antologia", "poemas")


def modernism(features: DataFrame, title: Column) -> Column:
    """0.7 for a text in modernist style (long and varied words, much punctuation) whose title fits, else null.
    ``features`` are those of ``style``."""
    f = features
    fits = (f["word_length"] > 5.5) & (f["diversity"] > 0.6) & (f["punctuation"] > 0.05)
    return F.when(fits & F.lower(title).rlike("|".join(MODERNIST)), F.lit(0.7))


def style(docs: DataFrame, key: str, text: str, function_words: tuple[str, ...] = T.STOP_WORDS) -> DataFrame:
    """Sentence and word length, lexical diversity, shares of function words and punctuation."""
    d = docs.withColumn("_w", F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    d = d.withColumn("_s", F.filter(F.split(text, "[.!?]+"), lambda s: T.strip(s) != ""))
    n = F.nullif(F.size("_w"), F.lit(0))
    return d.select(
        key,
        F.round(F.size("_w") / F.nullif(F.size("_s"), F.lit(0)), 6).alias("sentence_words"),
        F.round(F.aggregate("_w", F.lit(0), lambda a, w: a + F.length(w)) / n, 6).alias("word_length"),
        F.round(F.size(F.array_distinct("_w")) / n, 6).alias("diversity"),
        F.round(F.size(F.filter("_w", lambda w: w.isin(*function_words))) / n, 6).alias("function_words"),
        F.round(F.regexp_count(text, F.lit("[.,;:!?]")) / F.nullif(F.length(text), F.lit(0)), 6).alias("punctuation"),
    )


def mentions(docs: DataFrame, key: str, text: str, authors: list[str]) -> DataFrame:
    """(key, author, n): how often each listed author's full name stands in a text."""
    each = F.array(*[F.struct(F.lit(a).alias("author"), F.regexp_count(text, F.lit(f"(?iu)(?<!\\p{{L}})\\Q{a}\\E(?!\\p{{L}})")).alias("n")) for a in authors])
    return docs.select(key, F.explode_outer(F.filter(each, lambda x: x["n"] > 0)).alias("_m")).where("_m IS NOT NULL").select(key, "_m.author", "_m.n")


def attach(segments: DataFrame, authors: DataFrame, key: str) -> DataFrame:
    """The document's author on each of its segments."""
    return segments.join(authors, key, "left")
