"""Files as rows: text, Markdown and HTML by Spark's readers, gold sets as JSON lines, batch jobs.

DOCX is read by its XML.  PDF and OCR need libraries that are not part of this engine; a
converter for an extension can be registered, and files without one have no text.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from fnmatch import fnmatch
from io import BytesIO
from pathlib import Path
from xml.etree import ElementTree
from zipfile import BadZipFile, ZipFile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.functions.text import trimmed

EXTENSIONS = ("pdf", "docx", "html", "htm", "md", "txt")
CONVERTERS: dict[str, Callable[[bytes], str]] = {}
GOLD = "id string, corpus string, query string, expected array<string>, match string, fact_ids array<string>, answer string, passage string, dimensions struct<topic:string,question_type:string,difficulty:string>"


def plain_html(html: Column) -> Column:
    """Text of an HTML page: no scripts, styles, comments or tags; block ends as line ends; common entities undone."""
    t = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?i)<(?:br|/p|/div|/li|/tr|/h[1-6])[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return trimmed(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def fenced(text: Column) -> Column:
    """Plain text as Markdown: one fence around all of it."""
    return F.concat(F.lit("```\n"), text, F.lit("\n```"))


def register_converter(extension: str, convert: Callable[[bytes], str]) -> None:
    CONVERTERS[extension.lower().lstrip(".")] = convert


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_markdown(content: bytes) -> str | None:
    """A Word file as Markdown: headings by their style, list items, tables as rows of cells; None for what is no such file."""
    try:
        with ZipFile(BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    except (BadZipFile, KeyError, ElementTree.ParseError):
        return None
    text = lambda node: "".join("\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else x.text or "" for x in node.iter() if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
    out = []
    for block in body if body is not None else ():
        if block.tag == f"{_W}p":
            style = block.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") or "").lower() if style is not None else ""
            level = int(name[-1]) if name.startswith("heading") and name[-1:].isdigit() else 1 if name == "title" else 0
            mark = "#" * level + " " if level else "- " if block.find(f"{_W}pPr/{_W}numPr") is not None else ""
            out += [mark + text(block)] * bool(text(block).strip())
        elif block.tag == f"{_W}tbl":
            rows = [[" ".join(text(c).split()) for c in r.iter(f"{_W}tc")] for r in block.iter(f"{_W}tr")]
            lines = [f"| {' | '.join(r)} |" for r in rows]
            out += ["\n".join([*lines[:1], f"|{' --- |' * len(rows[0])}", *lines[1:]])] if rows else []
    return "\n\n".join(out)


CONVERTERS["docx"] = docx_markdown


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, document_id, extension, markdown) of the files under a folder, or of one file.

    ``document_id`` is the file's name; a second file of the same name gets ``#`` and eight digits of its path's SHA-1.
    Markdown as it is, text in a fence, HTML as plain text; other kinds by their converter, else null.
    """
    glob = "*.{" + ",".join(EXTENSIONS) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    named = files.select("path", F.substring_index("path", "/", -1).alias("name"), F.lower(F.substring_index("path", ".", -1)).alias("extension"), "content")
    text = F.decode("content", "UTF-8")
    known = F.when(F.col("extension") == "md", text).when(F.col("extension") == "txt", fenced(text)).when(F.col("extension").isin("html", "htm"), plain_html(text))
    rows = named.withColumn("markdown", known)
    if CONVERTERS:
        converters = dict(CONVERTERS)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(markdown=[m if m is not None or e not in converters else converters[e](bytes(c)) for m, e, c in zip(pdf["markdown"], pdf["extension"], pdf["content"])])

        rows = rows.mapInPandas(run, "path string, name string, extension string, content binary, markdown string")
    from pyspark.sql import Window

    paths = files.select("path", F.substring_index("path", "/", -1).alias("name"))  # no content is read or sorted for this
    first = F.row_number().over(Window.partitionBy("name").orderBy("path")) == 1
    ids = paths.select("path", F.when(first, F.col("name")).otherwise(F.concat("name", F.lit("#"), F.substring(F.sha1("path"), 1, 8))).alias("document_id"))
    return rows.drop("name").join(ids, "path").select("path", "document_id", "extension", "markdown")


def ocr_needed(pages_with_text: Column, pages: Column) -> Column:
    """Whether a PDF has to be recognised: unless more than half of its pages carry text."""
    return ~(2 * pages_with_text > pages)


def read_gold(spark: SparkSession, paths: list[str] | dict[str, str], sets: list[str] | None = None) -> DataFrame:
    """Gold rows of JSON lines files, blank lines and // comments aside, in order of id.

    ``paths`` may name sets (name -> file); ``sets`` then chooses some of them, and an unknown one is refused.
    """
    if isinstance(paths, dict):
        unknown = set(sets or ()) - set(paths)
        if unknown:
            raise ValueError(f"no gold set {', '.join(sorted(unknown))}; there are {', '.join(sorted(paths))}")
        paths = [paths[n] for n in (sets or sorted(paths))]
    lines = spark.read.text(paths).select(F.trim("value").alias("v")).where("v <> '' and not startswith(v, '//')")
    return lines.select(F.from_json("v", GOLD).alias("r")).select("r.*").orderBy("id")


def corpus_files(spark: SparkSession, root: str, files: list[str] = (), globs: list[str] = (), exclusions: list[str] = ()) -> list[str]:
    """Paths under ``root`` of the listed files and of what the globs match, without the exclusions (names or globs), sorted, each once."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: set[str] = set()
    for pattern in (*files, *globs):
        hits = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/{pattern}"))
        if pattern in files and not hits:
            raise FileNotFoundError(f"{root}/{pattern}")
        found |= {h.getPath().toUri().getPath() for h in (hits or ()) if h.isFile()}
    prefix = fs.makeQualified(base).toUri().getPath().rstrip("/") + "/"
    return sorted(p for p in found if not any(fnmatch(p.removeprefix(prefix), x) or fnmatch(p.rsplit("/", 1)[-1], x) for x in exclusions))


def source_texts(spark: SparkSession, where: dict, root: str) -> DataFrame:
    """(source, text) of what a sidecar names: one ``document``, a ``documents_dir``, or a ``source_glob``; sources are file names."""
    if where.get("document"):
        paths = corpus_files(spark, root, files=[where["document"]])
    elif where.get("documents_dir"):
        paths = corpus_files(spark, root, globs=[f"{where['documents_dir']}/*"])
    elif where.get("source_glob"):
        paths = corpus_files(spark, root, globs=[where["source_glob"]])
    else:
        raise ValueError("a sidecar names a document, a documents_dir or a source_glob")
    if not paths:
        return spark.createDataFrame([], "source string, text string")
    whole = spark.read.format("binaryFile").load(paths)
    return whole.select(F.substring_index("path", "/", -1).alias("source"), F.decode("content", "UTF-8").alias("text"))


def read_batch_job(path: str) -> tuple[dict, list[str]]:
    """(job, missing): a batch description with the documents that exist, and those that do not."""
    job = json.loads(Path(path).read_text(encoding="utf-8"))
    if not job.get("index_name"):
        raise ValueError("a batch job names its index")
    wanted = job.get("documents") or []
    there = [d for d in wanted if Path(d).exists()]
    return {**job, "documents": there}, [d for d in wanted if d not in there]
