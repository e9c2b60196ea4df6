"""Files, objects and logs: written, read, damaged and read again."""

import hashlib
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tabulark import sinks
from tabulark.operators import counts
from tabulark.session import work_folder
from tabulark.sources import docx, objects

HEAD = f'<w:document xmlns:w="{docx.W}"><w:body>'


def made(folder, name, body, numbering=None):
    with zipfile.ZipFile(folder / f"{name}.docx", "w") as z:
        z.writestr("word/document.xml", HEAD + body + "</w:body></w:document>")
        if numbering:
            z.writestr("word/numbering.xml", f'<w:numbering xmlns:w="{docx.W}">{numbering}</w:numbering>')


def p(text, props=""):
    return f"<w:p>{props}<w:r><w:t>{text}</w:t></w:r></w:p>"


def item(num, level=None):
    return f'<w:pPr><w:numPr>{"" if level is None else f"""<w:ilvl w:val="{level}"/>"""}<w:numId w:val="{num}"/></w:numPr></w:pPr>'


def lines_of(spark, folder):
    rows = docx.document_lines(docx.read_docx(spark, str(folder))).orderBy("file", "line_no").collect()
    return [(r.file, r.line_id, r.text, r.block_type) for r in rows]


def test_numbers_come_back(spark, tmp_path):
    numbering = (
        '<w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:start w:val="9"/><w:numFmt w:val="upperRoman"/><w:lvlText w:val=" %1、 "/></w:lvl><w:lvl w:ilvl="1"/></w:abstractNum>'
        '<w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="7"/></w:num>'
    )
    body = p("a", item(1)) + p("b", item(1, 1)) + p("c", item(2, 0)) + p("d", item(1, 0)) + p("  e ", item(0)) + p("f", item(1, 5)) + p("") + p("", item(1, 1)) + p("g", item(9))
    made(tmp_path, "n", body, numbering)
    assert [t for _, _, t, _ in lines_of(spark, tmp_path)] == ["IX、a", "1.b", "IX、c", "X、d", "e", "f", "2.", "g"]


def test_runs_tables_and_merged_cells(spark, tmp_path):
    cell = lambda text, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{text}</w:tc>"
    table = (
        f'<w:tbl><w:tr>{cell(p("wide") + p("two"), """<w:gridSpan w:val="2"/>""")}{cell(p("tall"), """<w:vMerge w:val="restart"/>""")}</w:tr>'
        f'<w:tr>{cell(p(" x "))}{cell(p(""))}{cell(p(""), "<w:vMerge/>")}</w:tr><w:tr>{cell(p(""))}</w:tr></w:tbl>'
    )
    runs = '<w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t><w:br/><w:noBreakHyphen/><w:br w:type="page"/></w:r><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink><w:ins><w:r><w:t>not yet</w:t></w:r></w:ins></w:p>'
    made(tmp_path, "t", runs + table + p("end"))
    assert lines_of(spark, tmp_path) == [("t", "D1L001", "one\ttwo\n-link", "text"), ("t", "D1L002", "wide\ntwo | wide\ntwo | tall", "table"), ("t", "D1L003", "x | tall", "table"), ("t", "D1L004", "end", "text")]


def test_a_bad_file_is_a_row_of_its_own(spark, tmp_path):
    made(tmp_path, "good", p("fine"))
    (tmp_path / "cut.docx").write_bytes((tmp_path / "good.docx").read_bytes()[:90])
    (tmp_path / "empty.docx").write_bytes(b"")
    made(tmp_path, "torn", p("one") + "<w:p>")
    with zipfile.ZipFile(tmp_path / "other.docx", "w") as z:
        z.writestr("mimetype", "no document")
    (tmp_path / "_hidden.docx").write_bytes(b"")
    found = docx.read_docx(spark, str(tmp_path))
    assert {r.file for r in docx.unreadable(found).collect()} == {"cut", "empty", "torn", "other"}
    assert lines_of(spark, tmp_path) == [("good", "D1L001", "fine", "text")]


def test_files_are_packed_into_partitions(spark, tmp_path):
    for k in range(10):
        made(tmp_path, f"f{k}", p(f"text {k}"))
    assert docx.read_docx(spark, str(tmp_path)).rdd.getNumPartitions() == 1
    apart = docx.read_docx(spark, str(tmp_path), maxPartitionBytes=1)
    assert apart.rdd.getNumPartitions() == 10 and apart.count() == 10


def test_writing_again_gives_the_same_files(spark):
    folder = work_folder(spark, "docx-test")
    rows = spark.createDataFrame([("a/x", [("é\x07 & <b>\ttab\r", 1, 0, None), (None, None, None, ["c1", None]), ("", None, None, [])], [(1, 0, "lowerLetter", "%1)", 2)]), ("y", None, None)], docx.WRITE_SCHEMA).withColumn("extra", F.lit(1))
    docx.write_docx(rows, folder)
    local = folder.removeprefix("file://")
    before = {n: open(f"{local}/{n}.docx", "rb").read() for n in ("a/x", "y")}
    docx.write_docx(rows, folder)
    assert before == {n: open(f"{local}/{n}.docx", "rb").read() for n in ("a/x", "y")}
    assert [t for _, _, t, _ in lines_of(spark, folder)] == ["b)é & <b>\ttab", "c1"]
    with pytest.raises(Exception, match="WRITE_SCHEMA"):
        spark.createDataFrame([(1,)], "file int").write.format("docx").mode("append").save(folder)


def test_objects_are_put_once_and_checked(spark, tmp_path):
    folder = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, b"one"), (2, b"two"), (3, b"one"), (4, None), (5, b"")], "name int, content binary")
    first = objects.put(rows.select(F.col("name").alias("k"), "content"), "content", folder)
    assert first.columns == ["k", "name", "length", "fresh"] and {r.k: r.name for r in first.collect()} == {k: hashlib.sha256(c).hexdigest() for k, c in ((1, b"one"), (2, b"two"), (3, b"one"), (5, b""))}
    again = objects.put(rows.select(F.col("name").alias("k"), "content"), "content", folder)
    assert again.where("fresh").count() == 0 and objects.listed(spark, folder).count() == 2  # not the empty one
    empty = hashlib.sha256(b"").hexdigest()
    assert objects.fetched(spark.createDataFrame([(empty,)], "name string"), folder).first().content == b""
    assert objects.put(rows.where("false").select("content"), "content", folder).count() == 0
    names = {c: hashlib.sha256(c).hexdigest() for c in (b"one", b"two", b"gone")}
    with open(objects.place(folder, names[b"two"]), "wb") as f:
        f.write(b"rotten")
    got = {r.name: (r.content, r.error) for r in objects.fetched(spark.createDataFrame([(n,) for n in names.values()], "name string"), folder).collect()}
    assert got[names[b"one"]] == (b"one", None) and got[names[b"gone"]] == (None, "FileNotFoundError") and "match" in got[names[b"two"]][1]


def test_a_task_that_runs_again_does_no_harm(tmp_path):
    system, root = objects.located(str(tmp_path))
    name, n, fresh = objects._put(system, root, b"content")
    (tmp_path / name[:2] / "_half").write_bytes(b"con")  # what a lost task leaves
    assert fresh and objects._put(system, root, b"content") == (name, 7, False)
    with open(objects.place(root, name), "wb") as f:
        f.write(b"con")
    assert objects._put(system, root, b"content") == (name, 7, True)  # a cut object is written again
    assert sorted(os.listdir(tmp_path / name[:2])) == sorted([name, "_half"])


def test_listing_reads_no_contents(spark, tmp_path, capsys):
    objects.put(spark.createDataFrame([(b"x",)], "c binary"), "c", str(tmp_path))
    objects.listed(spark, str(tmp_path)).explain()
    assert "content" not in capsys.readouterr().out.split("ReadSchema")[1]


def test_a_rerun_touches_its_partition_alone(spark, tmp_path):
    folder = str(tmp_path / "table")
    files = lambda: {str(f.relative_to(folder)): f.stat().st_mtime_ns for f in (tmp_path / "table").rglob("*.parquet")}
    rows = spark.createDataFrame([(k, k % 3) for k in range(30)], "k int, part int")
    sinks.replace_parts(rows, folder, ["part"])
    before = files()
    sinks.replace_parts(rows.where("part = 1 AND k > 20"), folder, ["part"])
    after = files()
    kept = {f for f in before if "part=1" not in f}
    assert {f: before[f] for f in kept} == {f: t for f, t in after.items() if "part=1" not in f}
    assert sorted(r.k for r in spark.read.parquet(folder).where("part = 1").collect()) == [22, 25, 28]
    sinks.replace_parts(rows.where("false"), folder, ["part"])
    assert set(files()) == set(after)


def test_sketches_add_up(spark):
    rows = spark.range(40_000).selectExpr("id % 4 AS g", "id % 7 AS day", "IF(id % 100 = 0, NULL, id % 9000) AS v")
    fine = counts.sketched(rows, ["g", "day"], "v")
    both = counts.merged(fine, ["g"]).alias("a")
    whole = {r.g: r.estimate for r in counts.estimated(counts.sketched(rows, ["g"], "v")).collect()}
    exact = {r.g: r.n for r in rows.groupBy("g").agg(F.count_distinct("v").alias("n")).collect()}
    assert {r.g: r.estimate for r in counts.estimated(both).collect()} == whole
    assert all(abs(whole[g] - exact[g]) <= 4 * counts.RELATIVE_ERROR * exact[g] for g in exact)
