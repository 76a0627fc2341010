"""SQL of the queries whose operators fold over a text: the same rules, restated for DuckDB."""

from __future__ import annotations

from textlake.functions import text as T
from textlake.operators import authors, clean, profile, segment

WS = r"[ \t\n\r\f\v]"
NOT_WS = r"[^ \t\n\r\f\v]"
CAPITAL = segment.CAPITAL
#: A word's edge where letters of any language count as its part.
EDGE, END = r"(?:^|[^\p{L}\p{Nd}_])", r"(?:$|[^\p{L}\p{Nd}_])"
LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS pos FROM documents"


def quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '{NOT_WS}+')"


def upper(x: str) -> str:
    return f"(upper({x}) = {x} AND lower({x}) <> {x})"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{quoted(pattern)}')"


def fold(x: str) -> str:
    return f"lower(translate({x}, '{T.ACCENTED}', '{T.FOLDED}'))"


def full_lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {strip('l')}), lambda l: l <> '')"


def blocks(x: str) -> str:
    cut = f"string_split(regexp_replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '\\n[ \\t]*\\n+', chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda b: {strip('b')}), lambda b: b <> '')"


def sentences(x: str) -> str:
    return rf"list_filter(string_split(regexp_replace({x}, '([.!?]){WS}+([{CAPITAL}])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: s <> '')"


def packed(parts: str, new: str) -> str:
    """A fold of strings: where ``new`` (of the list so far a, the next one b) holds a string of its own, else joined by a blank."""
    return f"list_reduce(list_transform({parts}, lambda s: [s]), lambda a, b: CASE WHEN {new} THEN a || b ELSE a[:-2] || [a[-1] || ' ' || b[1]] END)"


def title_case(x: str) -> str:
    return f"(array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: CASE WHEN w[1] = 'ß' THEN w ELSE upper(w[1]) || w[2:] END), ' ') = {x} AND lower({x}) <> {x})"


def title_score(t: str) -> str:
    """Without layout: no font, bold or alignment, length 0."""
    return (
        f"CASE WHEN {t} = '' THEN 0.0 ELSE least(10.0, CASE WHEN {has(t, segment.NUMBERED)} THEN 2.0 ELSE 0 END + CASE WHEN {has(f'lower({t})', segment.TITLE_WORDS)} THEN 1.5 ELSE 0 END + 1.0"
        f" + CASE WHEN {upper(t)} THEN 1.0 WHEN {title_case(t)} THEN 0.5 ELSE 0 END + CASE WHEN {has(t, '[.!?]$')} THEN 0 ELSE 0.5 END + CASE WHEN {has(t, '[|–—]')} THEN 0.5 ELSE 0 END) END::DOUBLE"
    )


def is_heading(t: str) -> str:
    ws = words(t)
    short = f"(length({t}) < 80 AND NOT {has(t, '[.,]$')} AND len({ws}) BETWEEN 2 AND 8 AND {has(t, '^[[:upper:]]|^' + chr(92) + 'p{Lu}')})"
    capital = f"len(list_filter({ws}, lambda w: length(w) > 2 AND NOT regexp_matches(w, '^\\p{{Lu}}'))) = 0"
    dash = f"instr({t}, ' - ') BETWEEN 1 AND 40"
    return f"({t} <> '' AND length({t}) <= 150 AND (({upper(t)} AND length({t}) < 100) OR ({short} AND ({capital} OR {dash} OR (ends_with({t}, ':') AND length({t}) < 40)))))"


def heading_level(t: str) -> str:
    decimal = rf"regexp_extract({t}, '^(\d+(?:\.\d+)*)\.?\s', 1)"
    return (
        f"CAST(least(6, CASE WHEN starts_with({t}, '#') THEN length(regexp_extract({t}, '^(#+)', 1)) WHEN {decimal} <> '' THEN len(string_split({decimal}, '.'))"
        rf" WHEN {upper(t)} THEN 1 WHEN {has(t, '^(?:LA|EL|LOS|LAS)' + chr(92) + 's')} THEN 1 WHEN length({t}) < 30 THEN 1 WHEN length({t}) < 50 THEN 2 ELSE 3 END) AS INTEGER)"
    )


def structural_key(x: str) -> str:
    bare = f"regexp_extract_all(regexp_replace(regexp_replace({fold(x)}, '[*_~\\[\\]{{}}()]', '', 'g'), '[^a-z0-9 ]', ' ', 'g'), '[a-z0-9]+')"
    small = "regexp_matches({}, '^[a-z]{{1,3}}$')"
    glue = f"CASE WHEN {small.format('v[i]')} AND {small.format('v[i + 1]')} THEN '' ELSE ' ' END"
    return f"(SELECT coalesce(rtrim(array_to_string(list_transform(range(1, len(v) + 1), lambda i: v[i] || CASE WHEN i = len(v) THEN '' ELSE {glue} END), '')), '') FROM (SELECT {bare} AS v))"


SQL: dict[str, str] = {}

SQL["format_sizes"] = (
    "SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%.1f B', n_chars::DOUBLE) WHEN n_chars < 1048576 THEN printf('%.1f KB', n_chars / 1024.0::DOUBLE)"
    " WHEN n_chars < 1073741824 THEN printf('%.1f MB', n_chars / 1048576.0::DOUBLE) ELSE printf('%.1f GB', n_chars / 1073741824.0::DOUBLE) END AS size, CASE WHEN n_chars < 100 THEN printf('%.0fms', n_chars * 10.0::DOUBLE + 1)"
    " WHEN n_chars < 6000 THEN printf('%.1fs', n_chars / 100.0::DOUBLE + 0.001) WHEN n_chars < 360000 THEN printf('%.1fm', (n_chars / 100.0::DOUBLE + 0.001) / 60) ELSE printf('%.1fh', (n_chars / 100.0::DOUBLE + 0.001) / 3600) END AS duration FROM documents"
)
SQL["structural_keys"] = f"SELECT item_id, {structural_key('text')} AS norm FROM benchmark"
SQL["first_answers"] = f"SELECT doc_id, nullif({strip('lang')}, '') AS answer FROM documents"
SQL["line_samples"] = f"SELECT doc_id, array_to_string(CASE WHEN len(l) > 10 THEN l[:5] || l[-5:] ELSE l END, chr(10)) AS sample FROM (SELECT doc_id, {full_lines('text')} AS l FROM documents)"
SQL["numbering_details"] = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS pattern, count(*) AS n, array_to_string(list(pos ORDER BY pos)[:10], ',') AS lines, array_to_string(list(line ORDER BY pos)[:5], '|') AS examples FROM ({LINES}) WHERE {has('line', p)} GROUP BY doc_id" for k, p in profile.NUMBERING.items()
)

_VOTES = {
    "de": ("der", "die", "und", "das", "nicht", "ist", "ein", "sich", "mit", "den"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "with", "for", "was"),
    "es": ("de", "la", "que", "el", "en", "los", "las", "por", "con", "una"),
    "fr": ("le", "la", "les", "de", "et", "un", "une", "dans", "pour", "que"),
}


def language_vote(text: str) -> str:
    return (
        f"WITH h AS (SELECT doc_id, {text} AS text, regexp_extract_all(lower(left({text}, 1000)), '\\p{{L}}+') AS w FROM documents), v AS ("
        + " UNION ALL ".join(f"SELECT doc_id, '{lang}' AS lang, len(list_filter(w, lambda x: x IN {ws})) AS n FROM h" for lang, ws in _VOTES.items())
        + f"), b AS (SELECT doc_id, max((n, lang)) AS best FROM v GROUP BY doc_id) SELECT h.doc_id, CASE WHEN length({strip('h.text')}) < 20 OR best[1] = 0 THEN 'und' ELSE best[2] END AS lang FROM h JOIN b USING (doc_id)"
    )


SQL["language_vote"] = language_vote("text")

_CHARS = "SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE text <> ''"
_RUNS = (
    f"WITH c AS ({_CHARS}), m AS (SELECT *, CASE WHEN ch = lag(ch) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM c),"
    " r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m), k AS (SELECT doc_id, any_value(ch) AS ch, count(*) AS n FROM r GROUP BY doc_id, run)"
)
SQL["corruption_ratio"] = (
    f"{_RUNS}, s AS (SELECT doc_id, coalesce(sum(n - 1) FILTER ({has('ch', chr(92) + 'p{L}')}), 0) AS extra, coalesce(sum(n // 2) FILTER ({has('ch', chr(92) + 'p{L}')}), 0) AS pairs,"
    f" coalesce(sum(n) FILTER ({has('ch', chr(92) + 'p{L}')}), 0) AS letters, sum(n) AS size FROM k GROUP BY doc_id)"
    " SELECT doc_id, round(extra / size, 6)::DOUBLE AS ratio, pairs * 2 > letters * 0.3 AS doubled FROM s UNION ALL SELECT doc_id, NULL, false FROM documents WHERE text = ''"
)
SQL["undoubled_lines"] = (
    f"WITH l AS (SELECT doc_id, pos, line FROM ({LINES}) WHERE line <> ''), c AS (SELECT doc_id, pos, unnest(string_split(line, '')) AS ch, generate_subscripts(string_split(line, ''), 1) AS i FROM l),"
    " m AS (SELECT *, CASE WHEN ch = lag(ch) OVER (PARTITION BY doc_id, pos ORDER BY i) THEN 0 ELSE 1 END AS new FROM c), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, pos ORDER BY i) AS run FROM m),"
    " k AS (SELECT doc_id, pos, run, any_value(ch) AS ch, count(*) AS n FROM r GROUP BY doc_id, pos, run)"
    " SELECT doc_id, pos, CASE WHEN bool_and(n % 2 = 0) THEN string_agg(repeat(ch, CAST(n // 2 AS INTEGER)), '' ORDER BY run) ELSE string_agg(ch, '' ORDER BY run) END AS line FROM k GROUP BY doc_id, pos"
)
SQL["poem_cleaning"] = (
    "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)Página\\s+\\d+', '', 'g'), '\\b\\d+\\s+de\\s+\\d+\\b', '', 'g'),"
    f" '(?im)^[ \\t]*(Anterior|Siguiente|Índice|Contenido|\\d+)[ \\t]*$', '', 'g'), '(?im)^[ \\t]*Antología[ \\t]*$', '', 'g'), chr(10)), lambda l: {strip('l')}), lambda l: l <> ''), chr(10)) AS cleaned FROM documents"
)
_KEYED = f"SELECT doc_id % 20 AS book, doc_id AS page, line, {structural_key('line')} AS norm FROM ({LINES})"
_SHARES = (
    f"WITH b AS ({_KEYED}), t AS (SELECT book, count(DISTINCT page) AS total FROM b GROUP BY book),"
    " s AS (SELECT book, norm, count(DISTINCT page) AS pages, any_value(total) AS total FROM b JOIN t USING (book) WHERE norm <> '' GROUP BY book, norm)"
)
SQL["header_footer_lines"] = f"{_SHARES} SELECT book, norm, pages, total FROM s"
SQL["without_running_heads"] = f"{_SHARES} SELECT book, page, line FROM b WHERE (book, norm) NOT IN (SELECT (book, norm) FROM s WHERE total >= 5 AND pages / total >= 0.05)"

_SEPARATOR = "CASE WHEN ends_with({a}, '-') OR regexp_matches({b}, '^[.,;:!?)\\]]') THEN '' ELSE ' ' END"
_TITLE = "(length({t}) <= 100 AND regexp_matches({t}, '^\\p{{Lu}}') AND len({w}) <= 5 AND len(list_filter({w}, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) > 0.6 * len({w}))"
_RUN_ON = ", ".join(f"'{w}'" for w in clean.RUN_ON)
_MERGES = (
    f"(a[-1] <> '' AND length(a[-1]) <= 500 AND NOT {_TITLE.format(t='b[1]', w=words('b[1]'))} AND (lower(regexp_extract(a[-1], '({NOT_WS}+)$', 1)) IN ({_RUN_ON}) OR (NOT regexp_matches(a[-1], '[.!?:;]$') AND regexp_matches(b[1], '^\\p{{Ll}}'))))"
)
SQL["merged_lines"] = (
    f"WITH o AS (SELECT doc_id, regexp_replace(text, ' (de|que|en|y|a|the|of) ', ' \\1' || chr(10), 'g') AS text FROM documents), m AS (SELECT doc_id, list_reduce(list_transform({full_lines('text')}, lambda s: [s]), lambda a, b: CASE WHEN {_MERGES} THEN a[:-2] || [a[-1] || {_SEPARATOR.format(a='a[-1]', b='b[1]')} || b[1]] ELSE a || b END) AS p"
    f" FROM o WHERE len({full_lines('text')}) > 0) SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS pos, unnest(p) AS paragraph FROM m"
)

_PACK = "a[-1] = '' OR length(a[-1]) > 300 OR starts_with(b[1], '—')"
_OPENING = f"regexp_matches(b[1], '^(?:{segment.OPENINGS})')"
_PROSE = (
    f"flat AS (SELECT doc_id, {squeeze('text')} AS flat FROM documents), g AS (SELECT doc_id, flat, regexp_extract(flat, '^((?:\\*\\*)?(?:[IVXLCDM]+|\\d+|Capítulo\\s+[IVXLCDM]+|Capítulo\\s+\\d+|Cap\\.\\s*\\d+)(?:\\*\\*)?)\\s+', 1) AS title FROM flat WHERE length(flat) >= 10),"
    f" hs AS (SELECT doc_id, title, {sentences('CASE WHEN title <> ' + chr(39) * 2 + ' THEN ' + strip('substr(flat, length(title) + 1)') + ' ELSE flat END')} AS s FROM g),"
    f" p AS (SELECT doc_id, CASE WHEN title <> '' THEN [title] ELSE [] END || {packed('s', _PACK + ' OR ' + _OPENING)} AS parts FROM hs WHERE len(s) > 0 UNION ALL SELECT doc_id, [title] FROM hs WHERE len(s) = 0 AND title <> '')"
)
SQL["sentence_pack_300"] = f"WITH {_PROSE} SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS pos, unnest(parts) AS segment FROM p"
SQL["fused_paragraphs"] = (
    f"WITH n AS (SELECT doc_id, text, {blocks('text')} AS parted, string_split(regexp_replace(text, '([.!?»”])([{CAPITAL}¿¡—])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS glued FROM documents),"
    f" p AS (SELECT doc_id, CASE WHEN len(parted) > 1 THEN parted WHEN len(glued) > 1 THEN glued ELSE [{strip('text')}] END AS parts FROM n)"
    " SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS pos, unnest(parts) AS paragraph FROM p"
)
SQL["subdivided_blocks"] = (
    "WITH p AS (SELECT doc_id, CASE WHEN length(text) < 600 THEN [text] ELSE list_reduce(list_transform(string_split(text, chr(10)), lambda s: [s]),"
    " lambda a, b: CASE WHEN length(a[-1]) + 1 + length(b[1]) <= 600 THEN a[:-2] || [a[-1] || chr(10) || b[1]] ELSE a || b END) END AS parts FROM documents),"
    " u AS (SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS pos, unnest(parts) AS piece FROM p)"
    f" SELECT doc_id, pos, piece, length({strip('piece')}) < 50 AS small FROM u"
)
_STRIPPED = f"SELECT doc_id, pos, line, {strip('line')} AS t FROM ({LINES})"
SQL["title_score"] = (
    f"WITH s AS (SELECT doc_id, pos, {title_score('t')} AS score FROM ({_STRIPPED})), r AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY score DESC) AS rank FROM s WHERE score >= 2.5)"
    " SELECT doc_id, pos, score, CAST(least(greatest(CASE WHEN score >= 8 THEN rank - 1 WHEN score < 5 THEN rank + 1 ELSE rank END, 1), 6) AS INTEGER) AS level FROM r"
)
_HEADING_TITLE = strip(r"regexp_replace(regexp_replace(regexp_replace(t, '^#+\s*', ''), '^\d+(?:\.\d+)*\.?\s+', ''), '\.\.\.$', '')")
SQL["heading_flags"] = f"SELECT doc_id, pos, {is_heading('t')} AS heading, {heading_level('t')} AS level, {_HEADING_TITLE} AS title FROM ({_STRIPPED})"


def _heading_segments(least: float) -> str:
    return (
        f"WITH b AS (SELECT doc_id, pos, t, {title_score('t')} >= {least} AND {is_heading('t')} AS title, {heading_level('t')} AS level FROM ({_STRIPPED}) WHERE t <> ''),"
        f" p AS (SELECT *, CASE WHEN NOT title AND length(t) > 500 THEN {packed(sentences('t'), _PACK)} ELSE [t] END AS parts FROM b),"
        " u AS (SELECT doc_id, pos, CASE WHEN title THEN 'title_level_' || level WHEN len(parts) > 1 THEN 'paragraph_split' ELSE 'paragraph' END AS kind, generate_subscripts(parts, 1) AS part, unnest(parts) AS segment FROM p)"
        " SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, part) AS INTEGER) AS segment_order, kind, segment FROM u"
    )


SQL["heading_segments"] = _heading_segments(3.0)
SQL["profile_segments"] = _heading_segments(2.5)
SQL["section_tree"] = (
    f"WITH h AS (SELECT doc_id, pos, {heading_level('t')} AS level FROM ({_STRIPPED}) WHERE line <> '')"
    " SELECT h.doc_id, h.pos, h.level, max(b.pos) AS parent FROM h LEFT JOIN h b ON b.doc_id = h.doc_id AND b.pos < h.pos AND b.level < h.level GROUP BY h.doc_id, h.pos, h.level"
)


# ---- blocks, titles and poems


def section_title(t: str) -> str:
    named = f"(length({t}) < 100 AND NOT ends_with({t}, '.') AND {has(f'lower({t})', segment.SECTION_WORDS)})"
    dated = f"({has(t, rf'(?i)[A-Z\s]\.\s+(?:{segment.WEEKDAYS})')} OR {has(t, rf'(?i)[A-Z\s]\s\d{{1,2}}\s+(?:{segment.MONTHS})')})"
    return f"({has(t, r'^#{1,6}\s+')} OR {has(t, r'^\*\*[^*]+\*\*$')} OR ({upper(t)} AND length({t}) > 5) OR {named} OR {dated})"


_CONTINUES = ", ".join(f"'{w}'" for w in segment.CONTINUES)
SQL["markdown_merge"] = (
    f"WITH b AS (SELECT doc_id, pos, t FROM ({_STRIPPED}) WHERE length(t) >= 10 AND NOT {has('t', '^[0-9]+$')} AND NOT {has('t', r'^[\p{P}\p{S}\s]+$')}),"
    f" f AS (SELECT *, {section_title('t')} AS section, starts_with(t, '—') AS dash, {has('t', r'^[A-Z][^.]*[?!]$')} OR {has('t', r'^¿.*\?$')} OR {has('t', '^¡.*!$')} AS spoken, ends_with(t, '.') AS stop,"
    f" {has('t', '[?!]$')} AND length(t) < 50 AS alone, length(t) >= 20 AND NOT {has('t', r'^\p{Lu}')} AND lower(regexp_extract(t, '^(\\S+)', 1)) IN ({_CONTINUES}) AS goes FROM b),"
    " l AS (SELECT *, lag({'section': section, 'dash': dash, 'spoken': spoken, 'stop': stop, 'alone': alone}) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM f),"
    " n AS (SELECT *, CASE WHEN p IS NULL OR p.section OR section OR p.dash <> dash OR p.spoken <> spoken OR NOT ((NOT p.stop AND goes) OR (NOT p.dash AND NOT dash AND NOT p.alone AND NOT alone)) THEN 1 ELSE 0 END AS new FROM l),"
    " r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS run FROM n)"
    " SELECT doc_id, run AS segment_order, string_agg(t, ' ' ORDER BY pos) AS segment, CAST(count(*) AS INTEGER) AS merged FROM r GROUP BY doc_id, run"
)


def poem_title(t: str) -> str:
    verse = f"({has(t, r'[,;]\s+\w+')} OR {has(t, r'[.!?]\s*$')} OR {has(t, r'^(?:[Hh][Ee]|[Yy][Oo]|[Tt]ú)\s+')})"
    shape = (rf"(?i)^(?:{segment.FORMS}|Poema|Verso)\s+", r"^[A-Za-z][A-Za-z]+\s+[A-Za-z][A-Za-z]+$", r"(?i)^.+\s+(?:I|II|III|IV|V|VI|VII|VIII|IX|X)$", r"(?i)^(?:Del|El|La|Los|Las|De la|De los|En el|En la)\s+[A-Z]")
    return f"({t} <> '' AND length({t}) <= 80 AND NOT {verse} AND ({' OR '.join(has(t, p) for p in shape)}))"


def title_block(t: str) -> str:
    capitals = f"({upper(t)} AND length({t}) BETWEEN 3 AND 100 AND NOT {has(t, '[.,;!?]$')} AND len({words(t)}) <= 10 AND NOT {has(t, r'^(?:ANTOLOGÍA|PÁGINA\s+\d+)$')})"
    yes = (
        f"(({has(t, r'\*\*.*\*\*')} AND length({t}) < 100) OR {has(t, rf'^(?:{segment.ROMAN}|\d+)\.?$')} OR ({has(t, '(?s)^\".*\"$')} AND length({t}) < 80)"
        f" OR {has(t, r'(?i)^poema\s+\d+$')} OR {capitals} OR {has(t, rf'(?i)^(?:{segment.FORMS})\s+')})"
    )
    marks = [p.replace(r"\b(", f"{EDGE}(", 1).replace(r"\b\w", rf"{EDGE}\w", 1) for p in segment.VERSE_MARKS]
    marks = [p[:-2] + END if p.endswith(r"\b") else p for p in marks]
    no = " OR ".join(has(t, "(?i)" + p) for p in marks)
    return f"({t} <> '' AND CASE WHEN {yes} THEN true WHEN length({t}) > 80 OR {no} THEN false ELSE {poem_title(t)} END)"


SQL["verse_titles"] = f"SELECT doc_id, pos, {title_block('t')} AS title, {poem_title('t')} AS poem_title FROM ({_STRIPPED})"
SQL["verse_presplit"] = (
    f"WITH l AS (SELECT doc_id, pos, line, CASE WHEN pos > 0 AND {title_block('t')} THEN 1 ELSE 0 END AS cut FROM ({_STRIPPED}) WHERE doc_id IN (SELECT doc_id FROM documents WHERE length(text) > 1000)),"
    " r AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS piece FROM l)"
    " SELECT doc_id, piece, string_agg(line, chr(10) ORDER BY pos) AS block FROM r GROUP BY doc_id, piece UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= 1000"
)
# one step a line: the title and blocks held, what a line ends, and the number of empty blocks
_POEMS = (
    f"f AS (SELECT doc_id, pos, t, {title_block('t')} AS title, length(t) > 300 AND len({words('t')}) > 40 AS bulky, {upper('t')} OR {has('t', rf'^(?:{segment.ROMAN}|\d+)\.?$')} AS main, t <> '' AND length(t) <= 120 AS verse FROM ({_STRIPPED})),"
    " x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM f WHERE doc_id IN (SELECT doc_id FROM f WHERE title)),"
    " s AS (SELECT doc_id, 0::BIGINT AS i, NULL::VARCHAR AS title, []::VARCHAR[] AS held, 0 AS verses, 0 AS blank, NULL::VARCHAR AS done, []::VARCHAR[] AS done_held, 0 AS done_verses FROM x WHERE i = 1"
    " UNION ALL SELECT doc_id, i, CASE WHEN opens THEN t WHEN ends THEN NULL ELSE old END, CASE WHEN opens OR ends THEN [] WHEN t = '' OR old IS NULL THEN held ELSE held || [t] END,"
    " CASE WHEN opens OR ends THEN 0 WHEN t = '' OR old IS NULL OR NOT verse THEN verses ELSE verses + 1 END, CASE WHEN t = '' THEN blank + 1 ELSE 0 END, CASE WHEN opens OR ends THEN old END, held, verses FROM ("
    " SELECT *, (t = '' AND blank + 1 > 2) OR (t <> '' AND NOT opens AND bulky AND NOT is_title AND len(held) > 2) AS ends FROM ("
    " SELECT s.doc_id, x.i, x.t, x.verse, x.bulky, x.title AS is_title, s.title AS old, s.held, s.verses, s.blank, x.t <> '' AND x.title AND (x.main OR s.title IS NULL OR len(s.held) > 3) AS opens FROM s JOIN x ON x.doc_id = s.doc_id AND x.i = s.i + 1))),"
    " o AS (SELECT doc_id, i, done AS title, done_held AS held, done_verses AS verses FROM s WHERE done IS NOT NULL UNION ALL SELECT doc_id, i + 1, title, held, verses FROM s WHERE title IS NOT NULL AND (doc_id, i) IN (SELECT (doc_id, max(i)) FROM x GROUP BY doc_id)),"
    " poems AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS poem, title, verses, array_to_string([title] || held, chr(10)) AS segment FROM o WHERE len(held) > 0)"
)
SQL["poem_segments"] = f"WITH RECURSIVE {_POEMS} SELECT doc_id, poem, title, verses, segment FROM poems"
SQL["poem_stats"] = f"WITH RECURSIVE {_POEMS} SELECT doc_id, count(*) AS poems, CAST(sum(verses) AS BIGINT) AS verses, CAST(sum(length(segment)) AS BIGINT) AS chars FROM poems GROUP BY doc_id"
SQL["verse_or_prose"] = (
    f"WITH RECURSIVE {_POEMS}, {_PROSE} SELECT doc_id, poem AS segment_order, 'poem' AS kind, segment FROM poems"
    " UNION ALL SELECT doc_id, CAST(generate_subscripts(parts, 1) AS INTEGER), 'paragraph', unnest(parts) FROM p WHERE doc_id NOT IN (SELECT doc_id FROM poems)"
)
SQL["markdown_poems"] = (
    "SELECT conv_id, CAST(run AS INTEGER) AS poem, string_agg(text, chr(10) ORDER BY turn) AS segment FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM conversations) WHERE run > 0 GROUP BY conv_id, run"
)
SQL["metadata_maps"] = "SELECT doc_id, '{\"title\":\"' || source || '\"}' AS kept, '{\"doc_pages\":\"' || n_chars || '\"}' AS extra FROM documents"

# ---- authors, search, sources

SQL["author_literary"] = (
    "WITH d(w, p) AS (VALUES ('the', 0.2), ('and of', 0.2), ('cióníez', 0.3)), h AS (SELECT doc_id, w, p FROM documents, d WHERE contains(lower(text), w) AND list_contains(string_split_regex(lower(text), '[^\\p{L}]+'), string_split(w, ' ')[1]))"
    " SELECT doc_id, 'Ana López' AS author, round(least(sum(p), 1.0), 4)::DOUBLE AS score, string_agg(w, '|' ORDER BY w) AS markers FROM h GROUP BY doc_id"
)
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def style(text: str) -> str:
    return (
        f"WITH r AS (SELECT doc_id, {text} AS t FROM documents), w AS (SELECT doc_id, t, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+') AS w, "
        f"len(list_filter(string_split_regex(t, '[.!?]+'), lambda s: {strip('s')} <> '')) AS s FROM r)"
        " SELECT doc_id, round(len(w) / nullif(s, 0), 6)::DOUBLE AS sentence_words, round(list_sum(list_transform(w, lambda x: length(x))) / nullif(len(w), 0), 6)::DOUBLE AS word_length,"
        f" round(len(list_distinct(w)) / nullif(len(w), 0), 6)::DOUBLE AS diversity, round(len(list_filter(w, lambda x: x IN ({_STOP}))) / nullif(len(w), 0), 6)::DOUBLE AS function_words,"
        " round(len(regexp_extract_all(t, '[.,;:!?]')) / nullif(length(t), 0), 6)::DOUBLE AS punctuation FROM w"
    )


SQL["style_features"] = style("text")
SQL["search_ranked"] = (
    f"WITH t AS (SELECT doc_id, list_filter(string_split_regex({fold('text')}, '[^a-z0-9ß]+'), lambda w: w <> '') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM t),"
    " h AS (SELECT doc_id, want, min(levenshtein(term, want)) AS typos, count(*) AS tf, min(pos) AS first FROM u, (VALUES ('thing'), ('heath')) v(want) WHERE levenshtein(term, want) <= 1 GROUP BY doc_id, want)"
    " SELECT doc_id, count(*) AS words, CAST(sum(typos) AS BIGINT) AS typos, CAST(sum(tf) AS BIGINT) AS tf, CAST(min(first) AS INTEGER) AS first FROM h GROUP BY doc_id ORDER BY words DESC, typos, tf DESC, first, doc_id LIMIT 20"
)
SQL["semantic_batch"] = (
    "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query, e.vec_id, list_dot_product(e.v, q.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.v, q.v))) AS similarity"
    " FROM e JOIN e q ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS rank FROM s)"
    " SELECT query, CAST(rank AS INTEGER) AS rank, vec_id, round(similarity, 4) AS similarity FROM r WHERE rank <= 5"
)
_HTML = "regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<head[^>]*>.*?</head>', ' ', 'g')"
for _n in range(1, 7):
    _HTML = f"regexp_replace({_HTML}, '(?is)<h{_n}[^>]*>', chr(10) || '{'#' * _n} ', 'g')"
_HTML = f"regexp_replace({_HTML}, '(?is)<li[^>]*>', chr(10) || '* ', 'g')"
_HTML = f"regexp_replace({_HTML}, '(?is)<br\\s*/?>|</?(p|div|h[1-6]|ul|ol|table|tr|section|article|header|footer|nav|main|body|html|blockquote)[^>]*>', chr(10), 'g')"
_HTML = f"regexp_replace({_HTML}, '(?s)<[^>]+>', '', 'g')"
for _name, _sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_name}', '{_sign}')"
SQL["html_text"] = f"SELECT page_id, array_to_string(list_filter(list_transform(string_split({_HTML}, chr(10)), lambda l: {squeeze('l')}), lambda l: l <> ''), chr(10)) AS text FROM pages"
_OCR_TITLE = f"(length(t) BETWEEN 3 AND 80 AND NOT {has('t', '[.,;]$')} AND ({upper('t')} OR {has('t', '(?i)^(capítulo|parte|poema|canto|prólogo)' + END)} OR {has('t', r'^(?:[IVXLCDM]+|\d+)\.?$')}))"
SQL["ocr_blocks"] = (
    f"WITH k AS (SELECT doc_id, pos, t, {_OCR_TITLE} AS head FROM ({_STRIPPED})), l AS (SELECT *, lag(t) OVER w AS last, lag(head) OVER w AS last_head FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),"
    f" r AS (SELECT *, CAST(sum(CASE WHEN last IS NULL OR last = '' OR head OR last_head OR ({has('last', '[.!?]$')} AND {has('t', r'^\p{Lu}')}) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS run FROM l)"
    " SELECT doc_id, run AS pos, CASE WHEN bool_or(head) THEN 'heading' ELSE 'paragraph' END AS kind, string_agg(t, ' ' ORDER BY pos) AS block FROM r WHERE t <> '' GROUP BY doc_id, run"
)
SQL["typed_markdown"] = (
    f"WITH k AS (SELECT doc_id AS path, pos, t, CASE WHEN starts_with(t, '#') THEN 'title_level_' || {heading_level('t')} WHEN {has('t', r'^\*\*[^*]+\*\*$')} THEN 'poem_title' WHEN t = '' THEN 'blank' ELSE 'paragraph' END AS kind FROM ({_STRIPPED})),"
    " n AS (SELECT *, CASE WHEN kind = 'paragraph' AND lag(kind) OVER (PARTITION BY path ORDER BY pos) = 'paragraph' THEN 0 ELSE 1 END AS new FROM k), r AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY pos) AS run FROM n)"
    " SELECT path, min(pos) AS pos, any_value(kind) AS kind, string_agg(t, ' ' ORDER BY pos) AS block FROM r WHERE kind <> 'blank' GROUP BY path, run"
)
_BROKEN = f"regexp_replace(text, '([,;:.!?])\\s+([{CAPITAL}])', '\\1' || chr(10) || '\\2', 'g')"
_BREAKS = "(length({0}) - length(replace({0}, chr(10), '')))"
SQL["poetry_shapes"] = (
    f"WITH s AS (SELECT doc_id, text, {_BROKEN} AS broken, list_filter(string_split(text, chr(10)), lambda l: {strip('l')} <> '') AS l, list_filter(list_transform(string_split_regex(text, '[.!?]'), lambda s: {strip('s')}), lambda s: s <> '') AS s FROM documents)"
    " SELECT doc_id, (coalesce(list_sum(list_transform(l, lambda x: length(x))) / nullif(len(l), 0) < 60, false))::INT"
    f" + ({has('text', '(?i)' + EDGE + '(poema|verso|estrofa|soneto|canto)' + END)})::INT + (len(list_filter(l, lambda x: NOT regexp_matches(x, '[.!?]\\s*$'))) > 0.5 * len(l))::INT + (len(list_filter(s, lambda x: length(x) < 50)) > 0.3 * len(s))::INT >= 2 AS poetry,"
    f" CAST(CASE WHEN {_BREAKS.format('broken')} - {_BREAKS.format('text')} > 3 THEN {_BREAKS.format('broken')} ELSE {_BREAKS.format('text')} END AS INTEGER) AS breaks FROM s"
)


def paged(heading: str) -> str:
    """Greedy packing into pages of at most 500 words; a heading begins a page."""
    return (
        f"b AS (SELECT doc_id, pos, line, len({words('line')}) AS w, {heading} AS h FROM ({_STRIPPED})), g AS (SELECT doc_id, list(pos ORDER BY pos) AS ps, list_reduce(list([{{'p': 1, 'w': w, 'h': h}}] ORDER BY pos), lambda a, b: a || [CASE WHEN b[1].h OR a[-1].w + b[1].w > 500"
        " THEN {'p': a[-1].p + 1, 'w': b[1].w, 'h': b[1].h} ELSE {'p': a[-1].p, 'w': a[-1].w + b[1].w, 'h': b[1].h} END]) AS l FROM b GROUP BY doc_id),"
        " paged AS (SELECT doc_id, pos, line, w, h, (l[list_position(ps, pos)]).p AS page_no FROM b JOIN g USING (doc_id))"
    )


SQL["app_pages"] = f"WITH {paged('false')} SELECT doc_id, page_no, min(pos) AS start, max(pos) AS end, CAST(sum(w) AS BIGINT) AS words FROM paged GROUP BY doc_id, page_no"
SQL["toc"] = f"WITH {paged(is_heading('t'))} SELECT doc_id, pos, line AS title, {heading_level(strip('line'))} AS level, page_no FROM paged WHERE h"
_NOISE = (
    f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '\\r\\n?', chr(10), 'g'), '\\x00', '', 'g'), '\\\\u[0-9a-fA-F]{{4}}', ' ', 'g'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}]', ' ', 'g'),"
    " '[\\x{FEFF}\\x{200B}-\\x{200F}\\x{2028}\\x{2029}]', ' ', 'g'), '\\\\[uU][0-9a-fA-F]{0,3}', ' ', 'g')"
).replace("{{", "{").replace("}}", "}")
SQL["prepared_blocks"] = (
    f"WITH n AS (SELECT doc_id, pos, {_NOISE} AS t FROM ({LINES})), c AS (SELECT doc_id, pos, CASE WHEN length(replace(replace(t, ' ', ''), chr(10), '')) > 50 AND len(regexp_extract_all(t, '[{clean.LETTER}]')) / length(replace(replace(t, ' ', ''), chr(10), '')) < 0.3"
    f" AND len(regexp_extract_all(t, '[{clean.LETTER}]{{3,}}')) < 2 THEN '{clean.CORRUPT}' ELSE "
    + strip(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '{WS}[+*/&%#$@!-]{{1,2}}{WS}', ' ', 'g'), '{WS}[a-zA-Z]{WS}', ' ', 'g'), '{WS}[0-9]{{1,2}}{WS}', ' ', 'g'), '[ \\t\\r\\f\\v]+', ' ', 'g')")
    + f" END AS line FROM n) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS order, line FROM c WHERE NOT (length(line) < 15 OR {has('line', '^[0-9]+[.-]*[0-9]*$')} OR (NOT {has('line', WS)} AND length(line) > 50) OR {has('line', '^[IVXivx]+$')})"
).replace(" AS order,", ' AS "order",')


# ---- names of persons


def capitalised(x: str) -> str:
    return f"array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


def clean_name(x: str) -> str:
    particles = ", ".join(f"'{w}'" for w in T.PARTICLES)
    bare = f"regexp_replace({squeeze(x)}, '^[^\\p{{L}}]+|[^\\p{{L}}.]+$', '', 'g')"
    return f"(SELECT array_to_string(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN i > 1 AND v[i] IN ({particles}) THEN v[i] ELSE upper(v[i][1]) || v[i][2:] END), ' ') FROM (SELECT string_split(lower({bare}), ' ') AS v))"


def valid_name(x: str) -> str:
    parts = f"string_split_regex({x}, '\\s+')"
    return (
        f"(length({x}) >= 3 AND len({parts}) BETWEEN 2 AND 4 AND len(list_filter({parts}, lambda w: NOT (regexp_matches(w, '^\\p{{Lu}}') AND length(w) BETWEEN 2 AND 20))) = 0"
        f" AND NOT regexp_matches({x}, '[0-9()\\[\\]{{}}]') AND NOT regexp_matches(lower({x}), '{'|'.join(authors.POETIC)}'))"
    )


PERSON = "'  \"' || upper(p_name) || '  DE  la ' || lower(p_type) || ' y PEÑA-8\", '"
AFTER_FIRST_LINE = "regexp_replace(n, '^[^\\n]*\\n?', '')"
_NAME = capitalised("p_name")
CANDIDATE = f"{_NAME} || CASE p_partkey % 6 WHEN 2 THEN ' 9' WHEN 3 THEN ' Canta' WHEN 4 THEN ' Word Prólogo' WHEN 5 THEN ' De La Torre' ELSE '' END"
CANDIDATE = f"CASE WHEN p_partkey % 6 = 1 THEN p_name ELSE {CANDIDATE} END"

ATTRIBUTED = (
    "d AS (SELECT doc_id, 'Escrito por ' || CASE doc_id % 3 WHEN 0 THEN 'Ana López Ruiz' WHEN 1 THEN 'Pedro Gómez' ELSE 'Marta Díaz' END || '.' || chr(10) || regexp_replace(text, '[-–—]', ' ', 'g') AS text FROM documents)"
)
_FOUND = " || ".join(f"regexp_extract_all(text, '{quoted(p)}', 1)" for p in authors.ATTRIBUTIONS)
NAMES = f"found AS (SELECT doc_id, unnest({_FOUND}) AS raw FROM d), names AS (SELECT doc_id, {clean_name('raw')} AS name FROM found WHERE {valid_name('raw')})"


def _listed(words_: tuple[str, ...]) -> str:
    return "|".join(words_)


def morphology(x: str) -> str:
    pattern = "[bcdfghjklmnpqrstvwxyz][aeiouáéíóú]|[aeiouáéíóú][bcdfghjklmnpqrstvwxyz]|rr|ll|ch|ñ"
    ws = f"string_split_regex(lower(trim({x})), '\\s+')"
    one = (
        f"least(1.0, CASE WHEN regexp_matches(v[i], '^(?:{_listed(authors.TITLES)})$') THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(v[i], '(?:{_listed(authors.ENDINGS)})$') THEN 0.4 ELSE 0 END"
        f" + CASE WHEN i > 1 AND regexp_matches(v[i], '(?:{_listed(authors.SURNAMES)})$') THEN 0.5 ELSE 0 END + CASE WHEN i > 1 AND regexp_matches(v[i], '^(?:{_listed(authors.PREFIXES)})') THEN 0.3 ELSE 0 END"
        f" + CASE WHEN regexp_matches(v[i], '{pattern}') THEN 0.2 ELSE 0 END)"
    )
    return f"(SELECT CASE WHEN len(v) < 2 THEN 0.0 ELSE least(1.0, list_sum(list_transform(range(1, len(v) + 1), lambda i: {one})) / len(v)) END FROM (SELECT {ws} AS v))::DOUBLE"


_MORPHED = "'Don ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' Martínez' ELSE ' de la Sol' END"
MORPHOLOGY = f"SELECT p_partkey, round({morphology(_MORPHED)}, 6) AS score FROM part"

_TITLE_NAME = (
    f"CASE p_partkey % 4 WHEN 0 THEN {_NAME} || ' - Poemas' WHEN 1 THEN regexp_extract({_NAME}, '(\\S+)$', 1) || ', ' || regexp_extract({_NAME}, '^(\\S+)', 1) WHEN 2 THEN {_NAME} || ' Capítulo' ELSE p_name END"
)
FROM_TITLE = (
    f"WITH t AS (SELECT p_partkey, p_name, {squeeze(_TITLE_NAME)} AS t FROM part), w AS (SELECT *, string_split(t, ' ') AS ws FROM t),"
    " c AS (SELECT *, [regexp_replace(t, '^([A-ZÁÉÍÓÚÑ]\\S+),\\s*([A-ZÁÉÍÓÚÑ]\\S+).*$', '\\2 \\1'), "
    f"regexp_extract(t, '^({authors.NAME})\\s+[-–—]\\s+', 1), array_to_string(ws[1:2], ' '), array_to_string(ws[1:3], ' '), array_to_string(ws[1:4], ' ')] AS c FROM w),"
    f" u AS (SELECT p_partkey, unnest(c) AS n, generate_subscripts(c, 1) AS i FROM c), k AS (SELECT p_partkey, n, min(i) AS i FROM u WHERE {valid_name('n')} AND NOT regexp_matches(lower(n), '{authors.SECTIONS}') GROUP BY p_partkey, n),"
    " g AS (SELECT p_partkey, string_agg(n, '|' ORDER BY i) AS names FROM k GROUP BY p_partkey)"
    f" SELECT p_partkey, coalesce(names, '') AS names, CASE WHEN {valid_name(_NAME)} AND NOT regexp_matches(lower(p_name), '{authors.SOFTWARE}') THEN {_NAME} END AS meta FROM part LEFT JOIN g USING (p_partkey)"
)

_KEY = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
_SORTED = "array_to_string(list_sort(string_split({}, ' ')), ' ')"
_FULL = "p_name || ' ' || lower(p_brand)"
KNOWN = (
    f"WITH a AS (SELECT {_FULL} AS author, min(p_name) AS p FROM part WHERE p_partkey % 5 = 0 GROUP BY 1), e AS (SELECT {_KEY.format('author')} AS k, 1.0 AS m, author FROM a UNION ALL SELECT {_KEY.format('reverse(p) || chr(32) || chr(122)')}, 0.95, author FROM a),"
    " x AS (SELECT k, max((m, author)) AS best FROM e GROUP BY k),"
    f" n AS (SELECT p_partkey, {_KEY.format(f'CASE p_partkey % 3 WHEN 0 THEN upper({_FULL}) WHEN 1 THEN left({_FULL}, 2) || substr({_FULL}, 4) ELSE reverse(p_name) || chr(32) || chr(122) END')} AS k FROM part),"
    f" left_over AS (SELECT DISTINCT k FROM n WHERE k NOT IN (SELECT k FROM x)), s AS (SELECT l.k, x.best[2] AS author, {_SORTED.format('l.k')} AS a, {_SORTED.format('x.k')} AS b FROM left_over l, x),"
    " f AS (SELECT k, max((1 - levenshtein(a, b) / greatest(length(a), length(b)), author)) AS best FROM s WHERE 1 - levenshtein(a, b) / greatest(length(a), length(b)) >= 0.85 GROUP BY k),"
    " r AS (SELECT p_partkey, coalesce(x.best[2], f.best[2]) AS canonical, coalesce(x.best[1]::DOUBLE, round(f.best[1], 6), 0.0) AS match FROM n LEFT JOIN x USING (k) LEFT JOIN f USING (k))"
    " SELECT p_partkey, canonical, round(match, 4) AS match, round(least(0.6::DOUBLE * CASE WHEN match >= 1 THEN 1.3 WHEN match > 0 THEN 1.2 ELSE 0.95 END, 1.0), 4)::DOUBLE AS confidence FROM r"
)
CHOICE = (
    "WITH c AS (SELECT doc_id, 'Ana López' AS name, doc_id % 10 / 10 AS confidence, 'literary_db' AS method, 1.0::DOUBLE AS w FROM documents"
    " UNION ALL SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'ANA LOPEZ' ELSE 'Juan Pérez' END, doc_id % 7 / 7, 'contextual', 0.8::DOUBLE FROM documents"
    " UNION ALL SELECT doc_id, 'Juan Pérez', doc_id % 4 / 4, 'stylistic', 0.7::DOUBLE FROM documents UNION ALL SELECT doc_id, 'Otro', doc_id % 3 / 2, 'unknown', 0.5::DOUBLE FROM documents),"
    f" g AS (SELECT doc_id, {fold('name')} AS k, max((confidence * w, name, method)) AS b, count(DISTINCT method) AS agree FROM c GROUP BY doc_id, k),"
    " h AS (SELECT doc_id, max((b[1] + least(0.2::DOUBLE, 0.1::DOUBLE * (agree - 1)), b[2], b[3], agree)) AS r FROM g GROUP BY doc_id)"
    " SELECT doc_id, r[2] AS author, round(r[1], 6) AS confidence, r[3] AS method, CAST(r[4] AS INTEGER) AS agree FROM h WHERE round(r[1], 6) >= 0.7"
)
_VERBS, _NOUNS = (" + ".join(f"contains(s, '{w}')::INT" for w in ws) for ws in (authors.VERBS, authors.NOUNS))
_NEAR = "regexp_matches(low, '(?:{0})[^.]{{0,40}}' || regexp_escape(n) || '|' || regexp_escape(n) || '[^.]{{0,40}}(?:{0})')"
ATTRIBUTION = (
    f"WITH {ATTRIBUTED}, {NAMES}, k AS (SELECT doc_id, name, count(*) AS times FROM names GROUP BY doc_id, name),"
    " j AS (SELECT k.*, d.text, lower(d.text) AS low, lower(name) AS n FROM k JOIN d USING (doc_id)),"
    f" x AS (SELECT *, coalesce(list_max(list_transform(list_filter(string_split_regex(low, '[.!?]'), lambda s: contains(s, n)), lambda s: least(1.0::DOUBLE, ({_VERBS}) * 0.4::DOUBLE + ({_NOUNS}) * 0.3::DOUBLE + CASE WHEN contains(s, 'por ' || n) OR contains(s, 'de ' || n) THEN 0.5 ELSE 0 END))), 0) AS context,"
    f" greatest(0, 1.0::DOUBLE - CASE WHEN {_NEAR.format('nació|murió|biografía|vida de')} THEN 0.4 ELSE 0 END - CASE WHEN {_NEAR.format('personaje|protagonista|dijo')} THEN 0.3 ELSE 0 END"
    f" - CASE WHEN (length(low) - length(replace(low, n, ''))) / length(n) / greatest(len({words('text')}), 1) > 0.02 THEN 0.5 ELSE 0 END) AS crossed, instr(text, name) / greatest(length(text), 1) AS place, {morphology('name')} AS morph FROM j),"
    " y AS (SELECT doc_id, name, round(least(1.0, 0.30::DOUBLE * morph + 0.20::DOUBLE * context + 0.30::DOUBLE * crossed + 0.15::DOUBLE * CASE WHEN place < 0.1 THEN 0.8 WHEN place < 0.2 THEN 0.6 WHEN place > 0.9 THEN 0.7 WHEN place > 0.8 THEN 0.5 ELSE 0.2 END + 0.05::DOUBLE * least(times / 3, 1.0)), 6) AS confidence FROM x)"
    " SELECT doc_id, b[2] AS author, b[1] AS confidence FROM (SELECT doc_id, max((confidence, name)) AS b FROM y GROUP BY doc_id)"
)
