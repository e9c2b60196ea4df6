"""Sources with declared schemas: tables, line snapshots, OCR output, annotations, page layouts."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabulark.functions.exam import number_label

#: Characters that a JSON value may end with.
VALUE_ENDS = '}]"0123456789elE'
BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
SNAPSHOT = (
    "filename string, source string, postprocessed boolean, pages array<struct<page_no:int,width:int,height:int>>, "
    "lines array<struct<line_id:string,page_no:int,line_no_in_page:int,order:int,text:string,block_type:string,source:string,continuation:boolean>>, "
    f"images array<struct<image_id:string,page_no:int,bbox:{BOX},source:string,placement:string>>"
)
OCR = "page int, result struct<layoutParsingResults:array<struct<markdown:struct<text:string,images:map<string,string>>,outputImages:map<string,string>,prunedResult:struct<parsing_res_list:array<struct<block_label:string,block_content:string,block_bbox:string>>>>>>"
ANNOTATION = (
    "questions array<struct<question_number:string,question_type:string,section_id:string,stem_line_ids:array<string>,options_line_ids:map<string,array<string>>,answer:string,answer_line_ids:array<string>,"
    "explanation_line_ids:array<string>,difficulty:string,score:double,knowledge_points:array<string>,confidence:double,source_page:int,is_composite:boolean,shared_material_line_ids:array<string>,"
    "sub_questions:array<struct<qno:string,question_type:string,answer:string,knowledge_points:array<string>,score:double,stem_line_ids:array<string>>>>>"
)


def tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def snapshot_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of line snapshots (one JSON document per file)."""
    rows = spark.read.schema(SNAPSHOT).json(path, multiLine=True)
    return rows.select("filename", F.explode("lines").alias("l")).select("filename", "l.*")


def line_map(spark: SparkSession, path: str) -> DataFrame:
    """line_id, text of a JSON object of line ids."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.explode(F.from_json("value", "map<string,string>")).alias("line_id", "text"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """One row per annotated question."""
    return spark.read.schema(ANNOTATION).json(path, multiLine=True).select(F.explode("questions").alias("q")).select("q.*")


def box_of(text: Column) -> Column:
    """A box from an array [x1,y1,x2,y2] or an object with x1/left, y1/top, x2/right, y2/bottom."""
    array = F.from_json(text, "array<double>")
    named = F.from_json(text, "map<string,double>")
    pick = lambda *keys: F.coalesce(*[named[k] for k in keys])
    from_array = F.when(F.size(array) == 4, F.struct(array[0].alias("x1"), array[1].alias("y1"), array[2].alias("x2"), array[3].alias("y2")))
    from_names = F.when(pick("x1", "left").isNotNull(), F.struct(pick("x1", "left").alias("x1"), pick("y1", "top").alias("y1"), pick("x2", "right").alias("x2"), pick("y2", "bottom").alias("y2")))
    return F.when(F.startswith(F.trim(text), F.lit("[")), from_array).otherwise(from_names)


def ocr_blocks(spark: SparkSession, path: str) -> DataFrame:
    """page, block_no, label, content, box of OCR output in JSON lines; pages without a number are counted on."""
    rows = spark.read.schema(OCR).json(path).withColumn("_file", F.input_file_name()).withColumn("_id", F.monotonically_increasing_id())
    page = F.coalesce("page", F.row_number().over(Window.partitionBy("_file").orderBy("_id")))
    blocks = rows.select(page.alias("page"), F.explode("result.layoutParsingResults").alias("r")).select("page", F.posexplode("r.prunedResult.parsing_res_list").alias("block_no", "b"))
    return blocks.select("page", "block_no", F.col("b.block_label").alias("label"), F.col("b.block_content").alias("content"), box_of(F.col("b.block_bbox")).alias("box"))


def block_lines(blocks: DataFrame, document: list[str] = []) -> DataFrame:  # noqa: B006
    """Blocks split into lines at newlines; tables stay whole; blank lines go. See `numbered_lines` for ids."""
    parts = F.when(F.col("label") == "table", F.array("content")).otherwise(F.split("content", "\n"))
    rows = blocks.select(*document, "page", "block_no", "label", F.posexplode(parts).alias("pos", "text"))
    return rows.where(F.trim("text") != "")


def numbered_lines(blocks: DataFrame, prefix: str = "P", document: list[str] = []) -> DataFrame:  # noqa: B006
    """line_id, page, line_no_in_page, order, text, block_type behind the `document` columns, which tell documents apart (none: all blocks
    are of one): lines in the order of pages and blocks, numbered on each page and over all pages of a document."""
    rows = block_lines(blocks, document)
    lines = rows.withColumn("line_no_in_page", F.row_number().over(Window.partitionBy(*document, "page").orderBy("block_no", "pos")))
    pages = lines.groupBy(*document, "page").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*document or [F.lit(1)]).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # the pages of one document
    lines = lines.join(pages.select(*document, "page", before.alias("_before")), [*document, "page"])
    kind = F.when(F.col("label").isin("table", "formula"), F.col("label")).otherwise("text")
    return lines.select(*document, F.format_string("%s%dL%03d", F.lit(prefix), "page", "line_no_in_page").alias("line_id"), "page", "line_no_in_page", (F.col("_before") + F.col("line_no_in_page")).alias("order"), "text", kind.alias("block_type"))


def box_of_name(name: Column) -> Column:
    """A box from an image name that ends in `_x1_y1_x2_y2` before its extension; null otherwise."""
    parts = F.transform(F.split(F.regexp_extract(name, r"_(\d+_\d+_\d+_\d+)\.[A-Za-z]+$", 1), "_"), lambda x: x.try_cast("double"))
    return F.when(F.size(parts) == 4, F.struct(*[F.get(parts, F.lit(i)).alias(k) for i, k in enumerate(("x1", "y1", "x2", "y2"))]))


def text_blocks(blocks: DataFrame, top: float = 15.0, bottom: float = 800.0) -> DataFrame:
    """Layout blocks (doc_id, page, x, y, text) inside the page body, numbered from top to bottom."""
    order = Window.partitionBy("doc_id", "page").orderBy("y", "x")
    return blocks.where(F.col("y").between(top, bottom)).withColumn("line_no_in_page", F.row_number().over(order))


def numbered_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """Automatic numbers of paragraphs (doc_id, pos, num_id, level, format, text) written out again."""
    order = Window.partitionBy("doc_id", "num_id", "level").orderBy("pos")
    number = number_label(F.row_number().over(order), F.coalesce("format", F.lit("decimal")))
    prefix = F.when(F.col("num_id").isNull(), "").otherwise(F.concat(number, F.lit(". ")))
    return paragraphs.withColumn("text", F.concat(prefix, F.col("text")))


def images_for_refs(refs: DataFrame, images: DataFrame, reach: float = 5.0) -> DataFrame:
    """Image blocks matched to placed images within `reach` units of the corner, through cells of that size."""
    cell = lambda v: F.floor(v / reach)
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    build = images.withColumn("_s", around).select("doc_id", "page", F.col("x").alias("ix"), F.col("y").alias("iy"), "xref", (cell(F.col("x")) + F.col("_s.i")).alias("_x"), (cell(F.col("y")) + F.col("_s.j")).alias("_y"))
    hit = refs.withColumn("_x", cell(F.col("x"))).withColumn("_y", cell(F.col("y"))).join(build, ["doc_id", "page", "_x", "_y"])
    return hit.where((F.abs(F.col("x") - F.col("ix")) < reach) & (F.abs(F.col("y") - F.col("iy")) < reach)).groupBy("ref_id").agg(F.min("xref").alias("xref"))


# --- tolerant readers ----------------------------------------------------------------------------------------


def _object(text: str | None) -> str | None:
    """The first JSON object in a text, fences stripped; a cut-off object is closed. None if there is none."""
    if not text:
        return None
    at = text.find("{")
    if at < 0:
        return None
    body = re.sub(r"```\w*", "", text[at:])
    try:
        value, _ = json.JSONDecoder().raw_decode(body)
        return json.dumps(value, ensure_ascii=False)
    except ValueError:
        pass
    return _closed(body)


def _closed(body: str) -> str | None:
    """The longest prefix of a cut-off object that can be closed. One pass notes, for each place that may end a value,
    which brackets are open there and whether a string is; places are tried from the last one."""
    stack, quoted, skip, ends = (), False, False, []
    for i, ch in enumerate(body):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = ch == "\\", ch != '"'
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            stack = (stack, "}" if ch == "{" else "]")
        elif ch in "}]" and stack:
            stack = stack[0]
        if not skip and (ch in VALUE_ENDS or i == len(body) - 1):
            ends.append((i + 1, stack, quoted))
    for end, stack, quoted in reversed(ends):
        tail = '"' if quoted else ""
        while stack:
            stack, close = stack
            tail += close
        try:
            return json.dumps(json.loads(body[:end] + tail), ensure_ascii=False)
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def json_object(s: pd.Series) -> pd.Series:
    """The JSON object that a model's answer holds, repaired if it was cut off; null without one."""
    return s.map(_object)


def _repair(text: str | None) -> str | None:
    if not text or text.isascii() or re.search("[一-鿿]", text):
        return text
    try:
        fixed = text.encode("cp1252").decode("gbk")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return text
    return fixed if re.search("[一-鿿]", fixed) else text


@F.pandas_udf(T.BooleanType())
def is_mojibake(s: pd.Series) -> pd.Series:
    """Whether a text with characters U+0080 to U+00FF is GBK read as cp1252."""

    def one(text):
        if not text or not any("\x80" <= ch <= "\xff" for ch in text):
            return False
        try:
            return bool(re.search("[一-鿿]", text.encode("cp1252").decode("gbk")))
        except (UnicodeEncodeError, UnicodeDecodeError):
            return False

    return s.map(one)


@F.pandas_udf(T.StringType())
def repair_gbk(s: pd.Series) -> pd.Series:
    """GBK bytes that were read as cp1252 come back; anything else stays."""
    return s.map(_repair)
