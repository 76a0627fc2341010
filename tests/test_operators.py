"""Hand-made cases and Python restatements of rules that SQL can't state."""

import io
import math
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from textlake.functions import text as T
from textlake.functions import vector as V
from textlake.operators import authors, clean, jobs, reader, registry, rules, search, segment
from textlake.sources import files, sinks
from textlake.streaming import incremental


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()[0]


def test_parse():
    assert search.parse('"a b" c').phrases == ("a b",)
    assert search.parse("x and y").groups == (("and", ("x", "y")),)
    assert search.parse("NOT z").groups == (("not", ("z",)),)
    assert search.parse("uno dos").terms == ("uno", "dos")


def test_accented_initial_and_mid_word(spark):
    docs = spark.createDataFrame([(1, "la época dorada"), (2, "epopeya xépoca"), (3, "")], ["id", "text"])
    assert [r.id for r in search.literal(docs, "text", "época").collect()] == [1]
    hit = search.literal(docs, "text", "NOT época").orderBy("id").collect()
    assert [r.id for r in hit] == [2, 3] and hit[0].position is None


def test_occurrences_overlap(spark):
    docs = spark.createDataFrame([(1, "aaaa baa")], ["id", "text"])
    assert sorted(r.position for r in search.occurrences(docs, "id", "text", "aa").collect()) == [0, 1, 2, 6]


def test_prose_packing(spark):
    text = " ".join(f"Frase número {i} con algunas palabras más para llenar." for i in range(30)) + " Entonces acaba."
    got = [r.segment for r in segment.prose(spark.createDataFrame([(1, text)], ["id", "text"]), "id", "text").orderBy("pos").collect()]
    want = []
    for s in re.split(r"(?<=[.!?])\s+(?=[A-ZÁÉÍÓÚÜÑ])", text):
        if not want or len(want[-1]) > 300 or s.startswith("—") or re.match(segment.OPENINGS, s):
            want.append(s)
        else:
            want[-1] += " " + s
    assert got == want


def test_roman_title_is_case_sensitive(spark):
    assert one(spark, segment.leading_title(F.col("t")), t="Mi casa es grande") == ""
    assert one(spark, segment.leading_title(F.col("t")), t="IV Mi casa") == "IV"


def test_pages(spark):
    sizes = [200, 200, 200, 700, 10, 10]
    rows = [(1, i, "w " * n, "heading" if i == 5 else "paragraph") for i, n in enumerate(sizes)]
    paged = reader.pages(spark.createDataFrame(rows, ["d", "p", "t", "k"]), "d", "p", "t", "k")
    assert [r.page_no for r in paged.orderBy("p").collect()] == [1, 1, 2, 3, 4, 5]


def test_section_tree(spark):
    rows = [(1, i, level) for i, level in enumerate([1, 2, 3, 2, 1, 3])]
    tree = segment.section_tree(spark.createDataFrame(rows, "d long, p long, l int"), "d", "p", "l")
    assert [r.parent for r in tree.orderBy("p").collect()] == [None, 0, 1, 0, None, 4]


def test_poems(spark):
    lines = ["texto suelto", "CANTO PRIMERO", "verso uno,", "verso dos.", "OTRO CANTO", "verso tres."]
    b = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], ["d", "p", "t"])
    got = segment.poems(b, "d", "p", "t").orderBy("poem").collect()
    assert [(r.title, r.verses) for r in got] == [("CANTO PRIMERO", 2), ("OTRO CANTO", 1)]


def test_rules(spark):
    d = spark.createDataFrame([('{"a":{"b":[{"c":"x"}]},"n":5,"e":"","z":null}',)], ["raw"]).withColumn("doc", rules.parsed(F.col("raw")))
    ok = lambda **k: d.select(rules.passes(F.col("doc"), rules.Rule(**k))).first()[0]
    assert ok(path="a.b[0].c", value="x") and not ok(path="a.b[1].c", value="x")
    assert ok(path="n", op="gte", value=5) and not ok(path="m", op="gte", value=5)
    assert ok(path="m", op="neq", value="q") and ok(path="z", op="not_exists") and ok(path="e", op="exists")
    assert not ok(path="n", op="contains", value="5") and ok(path="a.b[0].c", op="regex", value="^x$")


def test_deep_strings(spark):
    d = spark.createDataFrame([('{"t":["uno",{"k":"dos"}," "]}',)], ["raw"]).withColumn("doc", rules.parsed(F.col("raw")))
    assert d.select(rules.text_at(F.col("doc"), ["missing", "t"])).first()[0] == "uno\n\ndos"


def test_cleaning(spark):
    assert one(spark, clean.block_text(F.col("t")), t="uno\r\ndos\x00 \\u00e1 tres") == "uno dos tres"
    assert one(spark, clean.block_text(F.col("t")), t="%" * 60) == clean.CORRUPT
    assert one(spark, clean.undouble(F.col("t")), t="hhoollaa") == "hola"
    assert one(spark, clean.extremely_corrupt(F.col("t")), t="�" * 60) is True


def test_registry_batch(spark):
    schema = "hash string, file_path string, title string, first_seen timestamp"
    old = spark.createDataFrame([("h1", "/a", "A", None)], schema)
    new = spark.createDataFrame([("h1", "/b", None, None), ("h2", "/x/libro.txt", None, None), ("h2", "/y", None, None)], schema)
    got = {r.hash: (r.file_path, r.title) for r in registry.register(old, new).collect()}
    assert got == {"h1": ("/a", "A"), "h2": ("/x/libro.txt", "libro")}


def test_known_authors(spark):
    names = spark.createDataFrame([("ana lopez",), ("Ana Lopes",), ("A. López",), ("Nadie Sabe",)], ["name"])
    known = spark.createDataFrame([("Ana López", ["A. López"])], ["author", "aliases"])
    got = {r.name: (r.canonical, r.match) for r in authors.known(names, "name", known).collect()}
    assert got["ana lopez"] == ("Ana López", 1.0) and got["A. López"] == ("Ana López", 0.95)
    assert got["Ana Lopes"][0] == "Ana López" and 0.85 <= got["Ana Lopes"][1] < 0.95 and got["Nadie Sabe"] == (None, 0.0)


def docx(paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def xlsx(rows):
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    cells = "".join("<row>" + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r) if v) + "</row>" for i, r in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}"><sheets><sheet name="Hoja"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def test_office_sources(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx([("Heading2", "Uno"), ("", "Texto largo, con coma.")]))
    (tmp_path / "b.xlsx").write_bytes(xlsx([["nombre", "año"], ["Ana", "1901"], ["", "1902"]]))
    files.register(spark)
    d = files.docx_headings(spark.read.format("docx").option("paths", str(tmp_path / "a.docx")).load()).orderBy("pos").collect()
    assert [(r.text, r.is_heading, r.heading_level) for r in d] == [("Uno", True, 2), ("Texto largo, con coma.", False, None)]
    x = spark.read.format("xlsx").option("paths", str(tmp_path / "b.xlsx")).load().orderBy("pos").collect()
    assert [r.block for r in x] == ["Hoja", "nombre, año", "nombre: Ana | año: 1901", "año: 1902"]


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("uno\r\ndos\n\n\ntres\n")
    (tmp_path / "b.ndjson").write_text('{"texto":"hola","autor":"Ana"}\nrota\n{"content":"adiós"}\n')
    blocks = files.reader_for("x.txt")(spark, str(tmp_path / "a.txt")).orderBy("pos").collect()
    assert [r.block for r in blocks] == ["uno\ndos", "tres"]
    assert sorted(r.text for r in files.ndjson(spark, str(tmp_path / "b.ndjson")).collect()) == ["adiós", "hola"]
    assert files.listing(spark, str(tmp_path)).count() == 2
    assert files.delimiter("a;b;c\n1,2") == ";" and files.delimiter("a,b;c") == ","


def test_html(spark):
    html = "<html><head><title> Un\n título</title></head><body><script>x</p></script><h2>Cabeza</h2><p>a&amp;b</p></body></html>"
    assert one(spark, files.html_title(F.col("h")), h=html) == "Un título"
    assert one(spark, files.html_text(F.col("h")), h=html) == "## Cabeza\na&b"


def test_stream_registers_once(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], ["path", "text"]).write.parquet(src)
    run = lambda: incremental.register_new(incoming(), "text", "path", store, str(tmp_path / "cp")).awaitTermination()
    incoming = lambda: incremental.incoming(spark, src, "path string, text string")
    run()
    spark.createDataFrame([("d", "y"), ("e", "z")], ["path", "text"]).write.mode("append").parquet(src)
    run()
    got = spark.read.parquet(store)
    assert sorted(r.file_path for r in got.collect()) == ["a", "b", "e"]
    new = str(tmp_path / "compacted")
    assert sorted(r.file_path for r in incremental.compacted(spark, store, new).collect()) == ["a", "b", "e"] and len(list((tmp_path / "compacted").glob("batch=*"))) == 1
    store = new  # the stream goes on from the compacted registry
    spark.createDataFrame([("f", "z"), ("g", "w")], ["path", "text"]).write.mode("append").parquet(src)
    run()
    assert sorted(r.file_path for r in spark.read.parquet(new).collect()) == ["a", "b", "e", "g"]


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "events")
    spark.sql("SELECT timestamp'2024-01-01' + make_dt_interval(0, 0, CAST(id AS INT)) AS ts, id % 3 AS k, id AS v FROM range(100)").write.parquet(src)
    stream = incremental.incoming(spark, src, "ts timestamp, k long, v long")
    q = incremental.tumbling(stream, "ts", "30 minutes", "k", value="v", delay="1 hour").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = incremental.tumbling(spark.read.parquet(src), "ts", "30 minutes", "k", value="v")
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, batch.collect()))


@pytest.mark.parametrize("name,want", [("mi archivo.txt", "mi_archivo.txt"), ("***", "unnamed_file")])
def test_filenames(spark, name, want):
    assert one(spark, T.clean_filename(F.col("n")), n=name) == want


def test_nearest_to_each_of_many_queries(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(1100)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = search.nearest_to_each(e, e, "vec_id", "embedding", 3)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.query, r.rank): (r.vec_id, r.similarity) for r in out.collect()}
    assert len(got) == 3300

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))

    for i, q in rows[::97]:
        want = sorted(((-cosine(v, q), j) for j, v in rows if j != i))[:3]
        for rank, (c, j) in enumerate(want, 1):
            assert got[i, rank][0] == j and abs(got[i, rank][1] + c) < 1e-9


def test_known_authors_against_all_pairs(spark):
    rng = random.Random(9)
    authors_ = ["Gabriel Marquez", "Ana Lopez Ruiz", "Li Po", "Juan Ramon Jimenez Mantecon", "Bo"]
    names = ["Gbriel Mrquez", "Xna Yopez Ruiz"]
    for a in authors_ * 30:
        w = list(a)
        for _ in range(rng.randrange(1, 6)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randrange(2)] = rng.choice(["", "a", "z"])
        names.append("".join(w))
    known = spark.createDataFrame([(a, []) for a in authors_], "author string, aliases array<string>")
    out = authors.known(spark.createDataFrame([(n,) for n in sorted(set(names))], "name string"), "name", known)
    got = {r.name: (r.canonical, r.match) for r in out.collect()}
    pairs = spark.createDataFrame([(n, a) for n in got for a in authors_], "n string, a string")
    best = {}
    for r in pairs.select("n", "a", (T.name_key(F.col("n")) == T.name_key(F.col("a"))).alias("same"), T.token_sort_ratio(F.col("n"), F.col("a")).alias("sim")).collect():
        if r.same or r.sim >= 0.85:
            best[r.n] = max(best.get(r.n, (0, "")), (2.0 if r.same else r.sim, r.a))
    assert {n: c for n, (c, _) in got.items() if c} == {n: a for n, (_, a) in best.items()}
    assert got["Gbriel Mrquez"] == ("Gabriel Marquez", 0.866667)


def test_csv_files_by_their_own_delimiter(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name;note;\nAna;"x;y, z";1\n;;\nLuis;;2\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("k\tv\n1\tuno\n", encoding="utf-8")
    (tmp_path / "empty.csv").write_text("", encoding="utf-8")
    rows = files.reader_for("x/a.CSV")(spark, str(tmp_path)).collect()
    got = sorted((r.path.rsplit("/", 1)[-1], r.pos, r.block) for r in rows)
    assert got == [("a.csv", 0, "name: Ana; note: x;y, z; Columna_3: 1"), ("a.csv", 2, "name: Luis; Columna_3: 2"), ("b.csv", 0, "k: 1; v: uno")]
    assert files.delimiter("plain") == "," and files.delimiter("a|b;c|d") == "|"


def office_file(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_docx_properties_and_bad_files(spark):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hola</w:t></w:r></w:p></w:body></w:document>'
    core = '<c:coreProperties xmlns:c="c" xmlns:d="d"><d:title>Obra</d:title><d:creator>Ana</d:creator><c:keywords/></c:coreProperties>'
    good = office_file({"word/document.xml": body, "docProps/core.xml": core})
    f = spark.createDataFrame([("a.docx", bytearray(good)), ("b.docx", bytearray(b"no zip"))], "path string, content binary")
    got = {r.path: r for r in files.docx_files(f).collect()}
    assert got["a.docx"].text == "Hola" and got["b.docx"].style == "error" and "BadZipFile" in got["b.docx"].text
    p = {r.path: r for r in files.docx_properties(f).collect()}
    assert (p["a.docx"].title, p["a.docx"].author, p["a.docx"].keywords) == ("Obra", "Ana", None) and p["b.docx"].title is None


def test_xlsx_sheets_by_relation_and_bad_sheets(spark):
    s, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    book = f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="Uno" r:id="x"/><sheet name="Mala" r:id="y"/></sheets></workbook>'
    rels = '<Relationships xmlns="p"><Relationship Id="x" Target="worksheets/other.xml"/><Relationship Id="y" Target="worksheets/bad.xml"/></Relationships>'
    sheet = f'<worksheet xmlns="{s}"><sheetData><row><c r="A1" t="inlineStr"><is><t>k</t></is></c></row><row><c r="A2"><v>7</v></c></row></sheetData></worksheet>'
    book = office_file({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/worksheets/other.xml": sheet, "xl/worksheets/bad.xml": "<broken"})
    f = spark.createDataFrame([("a.xlsx", bytearray(book)), ("b.xlsx", bytearray(b""))], "path string, content binary")
    got = [(r.path, r.sheet, r.kind, r.block) for r in files.xlsx_files(f).orderBy("path", "sheet", "pos").collect()]
    assert [g[:3] for g in got] == [("a.xlsx", "Mala", "error"), ("a.xlsx", "Uno", "title"), ("a.xlsx", "Uno", "header"), ("a.xlsx", "Uno", "row"), ("b.xlsx", "", "error")]
    assert got[3][3] == "k: 7"


def test_log_entries(spark):
    log = "before\n2024-01-02 03:04:05,678 - ERROR para archivo a/b.txt: NameError: x\n  more TypeError\n2024-01-02 03:04:06,000 done\n2024-01-02 03:04:07 no millis"
    got = [tuple(r) for r in jobs.log_entries(spark.createDataFrame([(log,)], ["t"]), "t").orderBy("ts").collect()]
    assert got == [
        ("2024-01-02 03:04:05,678", "a/b.txt", "NameError", "- ERROR para archivo a/b.txt: NameError: x\n  more TypeError"),
        ("2024-01-02 03:04:06,000", "Desconocido", "other", "done"),
    ]


def test_sizes_round_as_written(spark):
    assert one(spark, T.format_size(F.col("n")), n=1280) == "1.2 KB" and one(spark, T.format_size(F.col("n")), n=1331) == "1.3 KB"
    assert one(spark, T.format_duration(F.col("n")), n=0.0125) == "12ms" and one(spark, T.format_duration(F.col("n")), n=5400.0) == "1.5h"


def test_store_and_writers(spark, tmp_path):
    d = spark.createDataFrame([(1, "a\x00b"), (2, None)], "id int, text string")
    sinks.write_ndjson(sinks.json_lines(d), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    sinks.store(d, d, str(tmp_path / "s"))
    sinks.store(d, d, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/segments")).count() == 4


def test_own_readers_and_segmenters(spark):
    files.register_reader(".abc", "abc", lambda s, p: p)
    assert files.reader_for("z.abc")(None, "z.abc") == "z.abc" and files.reader_for("z.unknown") is None
    segment.register_segmenter("own", lambda d, k, t: d.select(k, t))
    assert segment.SEGMENTERS.pop("own") is not None


def test_shared_tokens_and_snippets(spark):
    assert one(spark, authors.shares_tokens(F.col("a"), F.col("b")), a="Ana López Ruiz", b="lopez ana") and not one(spark, authors.shares_tokens(F.col("a"), F.col("b")), a="Ana López", b="Ana Ruiz")
    hits = search.reshaped(spark.createDataFrame([("x" * 400, 0.25)], ["t", "similarity"]), "t").first()
    assert hits.snippet == "x" * 360 + "..." and hits.score == 75
    assert one(spark, V.unit(F.col("v")), v=[3.0, 4.0]) == [0.6, 0.8]


def test_top_patterns(spark):
    e = spark.createDataFrame([("a", "m")] * 3 + [("b", "n")], ["k", "m"])
    assert [tuple(r) for r in jobs.top_patterns(e, "k", "m", 1).collect()] == [("a: m", 3)]


def test_pdf_maps_streams_and_bad_files(spark):
    import zlib

    from textlake.sources import pdf

    cmap = b"1 beginbfchar <0001> <00D1> endbfchar 1 beginbfrange <0002> <0004> <0061> endbfrange"
    inner = b"5 0 "
    body = b"<< /Type /Page /Parent 2 0 R /Contents [8 0 R 9 0 R] >>"
    stream = zlib.compress(inner + body)
    show = rb"BT /F1 10 Tf (Uno \(dos\) \101\n) Tj T* [(tr) -50 (es) -300 (cuatro)] TJ 0 -12 Td /F2 10 Tf <000100020004> Tj ET"
    data = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in [
        (2, b"<< /Type /Pages /Kids [5 0 R] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>"), (3, b"<< /Type /Font >>"), (4, b"<< /Type /Font /ToUnicode 7 0 R >>"),
        (7, b"<< >>\nstream\n" + cmap + b"\nendstream"), (8, b"<< >>\nstream\n" + show + b"\nendstream"), (9, b"<< /Filter /FlateDecode >>\nstream\nbroken\nendstream"),
        (10, b"<< /Type /ObjStm /N 1 /First %d /Filter /FlateDecode >>\nstream\n" % len(inner) + stream + b"\nendstream"),
    ])
    assert [x[2] for x in pdf.lines(data)] == ["Uno (dos) A", "tres cuatro", "Ñac"]
    f = spark.createDataFrame([("a.pdf", bytearray(data)), ("b.pdf", bytearray(b"no pdf"))], "path string, content binary")
    got = [(r.path, r.page, r.text) for r in files.pdf_files(f).orderBy("path", "page", "pos").collect()]
    assert got[:3] == [("a.pdf", 1, "Uno (dos) A"), ("a.pdf", 1, "tres cuatro"), ("a.pdf", 1, "Ñac")] and got[3][:2] == ("b.pdf", 0) and "ValueError" in got[3][2]
    assert files.reader_for("x/libro.PDF") is files.READERS["pdf"]


def documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_front_matter_of_odd_documents(spark, tmp_path):
    rows = [(0, "eins\rzwei\x85drei\u2028vier\u2029\n# x", "s"), (2, "text", None), (4, None, "s"), (1, None, None), (3, "va v", "s"), (5, "\x0b a\x0b\r\nb", "s"), (6, "", "s")]
    got = driver.queries()["front_matter"](spark, documents(spark, tmp_path, rows)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {
        0: ("s", "2024-01-01", "eins\rzwei\x85drei\u2028vier\u2029", 26),
        2: (None, "2024-01-03", "text", 6),
        4: ("s", "2024-01-05", None, None),
        1: (None, None, None, None),
        3: (None, None, "va v", 6),  # only white space is stripped; the SQL's E'\v' is the letter in DuckDB
        5: (None, None, "a", 9),
        6: ("s", "2024-01-07", None, 2),
    }


def test_json_extract_of_odd_documents(spark, tmp_path):
    body = " wort" * 25
    texts = {0: "eins" + body, 1: "a\x7fb\x00c" + body, 2: "va" + body + " v", 3: "\x0bvt" + body + "\x0b", 4: "x" * 99, 5: None}
    rows = [(i, texts[i], None if i % 2 == 0 else "s") for i in texts]
    got = driver.queries()["json_extract"](spark, documents(spark, tmp_path, rows)).collect()
    # only white space is stripped; the SQL's E'\v' is the letter in DuckDB
    assert {tuple(r) for r in got} == {(0, texts[0], None), (1, texts[1], "s"), (2, texts[2], None), (3, texts[3].strip("\x0b"), "s")}


def test_stored_tables_are_those_of_the_folder(spark, tmp_path):
    d = spark.range(4).selectExpr("id", "id % 2 AS day", "id % 2 AS hour")
    d.write.parquet(str(tmp_path / "flat.parquet"))
    d.write.partitionBy("day", "hour").parquet(str(tmp_path / "days.parquet"))
    (tmp_path / "notes.txt").write_text("x")
    assert sorted(tuple(r) for r in driver.queries()["stored_tables"](spark, str(tmp_path)).collect()) == [("days", 1), ("flat", 2)]


def test_json_keeps_very_long_texts(spark, tmp_path):
    path = documents(spark, tmp_path, [(1, "wort " * 4_200_000 + "x", "s")])
    assert [tuple(r) for r in driver.queries()["json_extract"](spark, path).selectExpr("doc_id", "length(text)").collect()] == [(1, 21_000_001)]
