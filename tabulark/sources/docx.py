"""DOCX files as a data source: `spark.read.format("docx").load(folder)`, and a writer for the same format.

Reading lists names and sizes on the driver, packs files into partitions by size and opens them in tasks. A file that
cannot be read is one row with its error; the others are not touched. Rows are what the file holds, in the order of its body;
automatic numbers are written out by `document_lines`, which counts with windows, not in the reader.

Paths are those of pyarrow's file systems (local, s3, gs, hdfs), since tasks open the files themselves.
"""

from __future__ import annotations

import re
import uuid
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from xml.sax.saxutils import escape, quoteattr

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tabulark.functions.exam import number_label

#: A row for each paragraph of the body and each row of its tables; the numbering columns are those of the paragraph's list level.
READ_SCHEMA = "file string, pos int, block_type string, text string, num_id int, level int, format string, template string, start int, error string"
#: A row for each file. A block with cells is a row of a table; neighbouring ones are rows of one table.
WRITE_SCHEMA = "file string, blocks array<struct<text:string,num_id:int,level:int,cells:array<string>>>, numbering array<struct<num_id:int,level:int,format:string,template:string,start:int>>"

#: The format's namespaces and content types.
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
TYPES = (
    '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/>'
    '<Override PartName="/word/numbering.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.numbering+xml"/></Types>'
)
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{}" Target="{}"/></Relationships>'
ILLEGAL = re.compile(r"[^\t\n\r\x20-\uD7FF\uE000-\uFFFD\U00010000-\U0010FFFF]")
DEFAULT_LEVEL = {"format": "decimal", "template": "%1.", "start": 1}
OPEN_COST = 32 * 1024
SMALL_PART = 1 << 20  # bytes of a document part that is parsed as a whole


def w(name: str) -> str:
    return f"{{{W}}}{name}"


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# --- reading -------------------------------------------------------------------------------------------------


def _levels(archive: zipfile.ZipFile) -> dict[tuple[int, int], dict]:
    """What the numbering part says of each (list, level)."""
    return _levels_of(archive.read("word/numbering.xml")) if "word/numbering.xml" in archive.namelist() else {}


@lru_cache(maxsize=64)
def _levels_of(part: bytes) -> dict[tuple[int, int], dict]:
    """Files of one origin mostly share their numbering part, so it is kept; the result is for reading only."""
    root = ET.fromstring(part)
    value = lambda of, name: of.find(w(name)).get(w("val")) if of.find(w(name)) is not None else None
    abstract = {}
    for a in root.findall(w("abstractNum")):
        for level in a.findall(w("lvl")):
            found = {"format": value(level, "numFmt"), "template": value(level, "lvlText"), "start": value(level, "start")}
            own = {k: v if v not in (None, "") else DEFAULT_LEVEL[k] for k, v in found.items()}
            abstract[a.get(w("abstractNumId")), int(level.get(w("ilvl")) or 0)] = own | {"start": int(own["start"])}
    used = {n.get(w("numId")): value(n, "abstractNumId") for n in root.findall(w("num"))}
    return {(int(n), level): own for n, a in used.items() for (of, level), own in abstract.items() if of == a}


def _text(paragraph: ET.Element) -> str:
    """The text of a paragraph's runs, hyperlinks included."""
    out = []
    for child in paragraph:
        for run in child if child.tag == w("hyperlink") else (child,):
            for part in run if run.tag == w("r") else ():
                name = part.tag.removeprefix(f"{{{W}}}")
                if name == "t":
                    out.append(part.text or "")
                elif name in ("tab", "ptab"):
                    out.append("\t")
                elif name == "cr" or name == "br" and part.get(w("type"), "textWrapping") == "textWrapping":
                    out.append("\n")
                elif name == "noBreakHyphen":
                    out.append("-")
    return "".join(out)


def _table_rows(table: ET.Element) -> Iterator[str]:
    """The cells of each row, joined. A cell over several columns stands in each, one over several rows in each of them."""
    above: list[str] = []
    for row in table.findall(w("tr")):
        cells: list[str] = []
        for cell in row.findall(w("tc")):
            props = cell.find(w("tcPr"))
            span = props.find(w("gridSpan")) if props is not None else None
            merge = props.find(w("vMerge")) if props is not None else None
            text = "\n".join(_text(p) for p in cell.findall(w("p"))).strip()
            if merge is not None and merge.get(w("val"), "continue") == "continue" and len(cells) < len(above):
                text = above[len(cells)]
            cells += [text] * int(span.get(w("val")) if span is not None else 1)
        above = cells
        yield " | ".join(c for c in cells if c)


def _numbering(paragraph: ET.Element, levels: dict) -> tuple:
    props = paragraph.find(w("pPr"))
    number = props.find(w("numPr")) if props is not None else None
    pick = lambda name: number.find(w(name)).get(w("val")) if number is not None and number.find(w(name)) is not None else None
    num_id = int(pick("numId") or 0)  # list 0 means none
    level = int(pick("ilvl") or 0)
    own = levels.get((num_id, level)) if num_id else None
    return (num_id, level, own["format"], own["template"], own["start"]) if own else (None,) * 5


def _blocks(archive: zipfile.ZipFile) -> Iterator[ET.Element]:
    """The body's blocks. Those of a large part are dropped from the tree once read."""
    if archive.getinfo("word/document.xml").file_size <= SMALL_PART:
        for body in ET.fromstring(archive.read("word/document.xml")).findall(w("body")):
            yield from body
        return
    with archive.open("word/document.xml") as part:
        parents = []
        for event, element in ET.iterparse(part, ("start", "end")):
            if event == "start":
                parents.append(element)
                continue
            parents.pop()
            if len(parents) == 2 and parents[-1].tag == w("body"):
                yield element
                parents[-1].clear()


def parsed(stream) -> Iterator[tuple]:
    """block_type, text and numbering columns of a file's blocks."""
    with zipfile.ZipFile(stream) as archive:
        levels = _levels(archive)
        for element in _blocks(archive):
            if element.tag == w("p"):
                yield ("text", _text(element), *_numbering(element, levels))
            elif element.tag == w("tbl"):
                for row in _table_rows(element):
                    yield ("table", row, *(None,) * 5)


@dataclass
class Files(InputPartition):
    names: list[str]


class DocxReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Files]:
        system, path = located(self.path)
        found = [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.path.endswith(".docx") and not f.base_name.startswith(("_", "."))]
        out, held = [], self.size
        for f in sorted(found, key=lambda f: f.path):
            if held + f.size + OPEN_COST > self.size:
                out.append(Files([]))
                held = 0
            out[-1].names.append(f.path)
            held += f.size + OPEN_COST
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, root = located(self.path)
        for name in partition.names:
            file = name.removeprefix(root.rstrip("/") + "/").removesuffix(".docx")
            try:
                with system.open_input_file(name) as stream:
                    rows = [(file, pos, *row, None) for pos, row in enumerate(parsed(stream), 1)]
            except (OSError, ValueError, KeyError, AttributeError, zipfile.BadZipFile, ET.ParseError) as e:
                rows = [(file, *(None,) * 8, f"{type(e).__name__}: {e}")]
            yield from rows


# --- writing -------------------------------------------------------------------------------------------------


def _run(text: str | None) -> str:
    parts = re.split("([\t\n])", ILLEGAL.sub("", text or ""))
    return "<w:r>" + "".join({"\t": "<w:tab/>", "\n": "<w:br/>"}.get(p) or f'<w:t xml:space="preserve">{escape(p, {chr(13): "&#13;"})}</w:t>' for p in parts if p) + "</w:r>"


def _document(blocks) -> str:
    out, in_table = [], False
    for b in blocks or ():
        if (b.cells is not None) != in_table:
            out.append("</w:tbl>" if in_table else "<w:tbl>")
            in_table = not in_table
        if in_table:
            out.append("<w:tr>" + "".join(f"<w:tc><w:p>{_run(c)}</w:p></w:tc>" for c in b.cells) + "</w:tr>")
        else:
            number = f'<w:pPr><w:numPr><w:ilvl w:val="{b.level or 0}"/><w:numId w:val="{b.num_id}"/></w:numPr></w:pPr>' if b.num_id is not None else ""
            out.append(f"<w:p>{number}{_run(b.text)}</w:p>")
    return f'<w:document xmlns:w="{W}"><w:body>{"".join(out)}{"</w:tbl>" if in_table else ""}</w:body></w:document>'


@lru_cache(maxsize=64)
def _numbering_part(levels: tuple) -> str:
    lists: dict[int, list] = {}
    for n in levels:
        lists.setdefault(n.num_id, []).append(n)
    level = lambda n: f'<w:lvl w:ilvl="{n.level}"><w:start w:val="{n.start}"/><w:numFmt w:val={quoteattr(n.format)}/><w:lvlText w:val={quoteattr(n.template)}/></w:lvl>'
    abstract = "".join(f'<w:abstractNum w:abstractNumId="{k}">{"".join(map(level, ls))}</w:abstractNum>' for k, ls in lists.items())
    return f'<w:numbering xmlns:w="{W}">{abstract}{"".join(f'<w:num w:numId="{k}"><w:abstractNumId w:val="{k}"/></w:num>' for k in lists)}</w:numbering>'


def packed(sink, blocks, numbering) -> None:
    """Write a file. The same blocks give the same bytes, so a task that runs again replaces a file by itself."""
    parts = {
        "[Content_Types].xml": TYPES, "_rels/.rels": RELS.format("officeDocument", "word/document.xml"), "word/_rels/document.xml.rels": RELS.format("numbering", "numbering.xml"),
        "word/numbering.xml": _numbering_part(tuple(numbering or ())), "word/document.xml": _document(blocks),
    }
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in parts.items():
            archive.writestr(zipfile.ZipInfo(name), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text, zipfile.ZIP_DEFLATED)


class DocxWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows) -> WriterCommitMessage:
        system, root = located(self.path)
        made = set()
        for row in rows:
            target = f"{root}/{row.file}.docx"
            folder, _, name = target.rpartition("/")
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            half = f"{folder}/_{uuid.uuid4().hex}-{name}"  # seen by no reader; a lost task leaves at most this behind
            with system.open_output_stream(half) as sink:
                packed(sink, row.blocks, row.numbering)
            system.move(half, target)
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        system, root = located(self.path)
        system.create_dir(root, recursive=True)
        system.open_output_stream(f"{root}/_SUCCESS").close()


class DocxSource(DataSource):
    """Options: path; maxPartitionBytes (32 MB by default): how much a task reads, counting 256 KB more for each file."""

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: StructType) -> DocxReader:
        return DocxReader(self.options["path"], int(self.options.get("maxPartitionBytes", 32 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> DocxWriter:
        missing = {"file", "blocks", "numbering"} - set(schema.names)
        if missing:
            raise ValueError(f"a DOCX file needs the columns of WRITE_SCHEMA; missing: {sorted(missing)}")
        return DocxWriter(self.options["path"])


def read_docx(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(DocxSource)
    return spark.read.format("docx").options(**options).load(path)


def write_docx(rows: DataFrame, path: str) -> None:
    """`rows` by WRITE_SCHEMA, a file each; files of the same name are replaced. Files are dealt out first, as the partitions of a
    compressed table may be few and uneven for the work on their rows."""
    rows.sparkSession.dataSource.register(DocxSource)
    rows.select("file", "blocks", "numbering").repartition("file").write.format("docx").mode("append").save(path)


# --- lines ---------------------------------------------------------------------------------------------------


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def document_lines(paragraphs: DataFrame) -> DataFrame:
    """file, line_id, page_no, line_no, text, block_type: automatic numbers written out, counted per list and level from its start;
    blank lines go and the rest is numbered through. Files that could not be read have no lines."""
    good = paragraphs.where("error is null").repartition("file")  # one shuffle serves both windows
    counted = Window.partitionBy("file", "num_id", "level").orderBy("pos")
    label = number_label((F.row_number().over(counted) + F.col("start") - 1).cast("int"), F.col("format"))
    prefix = F.when(F.col("num_id").isNotNull(), F.trim(F.replace("template", F.lit("%1"), label))).otherwise("")
    lines = good.withColumn("text", stripped(F.concat(prefix, F.coalesce("text", F.lit(""))))).where("text <> ''")
    line_no = F.row_number().over(Window.partitionBy("file").orderBy("pos"))
    return lines.withColumn("line_no", line_no).select("file", F.format_string("D1L%03d", "line_no").alias("line_id"), F.lit(1).alias("page_no"), "line_no", "text", "block_type")


def unreadable(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.where("error is not null").select("file", "error")
