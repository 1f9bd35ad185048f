"""Binary documents as rows: names and first bytes are checked, text is decoded or read out of DOCX members, bad files are rows with an error.

Files come from Spark's binaryFile source, so they can be in any store that Spark reads. The content of a file over
`MOST_BYTES` is not loaded. Each file is read by itself inside a task; a file that can't be read never ends the job.
Scanned images and PDF pages need text recognition or a layout reader, which stay outside: their rows say so (`needs`).
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits, kinds of files with their first bytes, and character codes in the order in which they are tried.
MOST_BYTES, MOST_CHARS, MOST_XML = 12 * 1024 * 1024, 120_000, 8 * 1024 * 1024
SIGNATURES = {"pdf": b"%PDF-", "docx": b"PK", "png": b"\x89PNG\r\n\x1a\n", "jpg": b"\xff\xd8\xff", "jpeg": b"\xff\xd8\xff", "txt": b""}
CODES = ["utf-8-sig", "utf-16", "cp1257"]
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Bytes of a text file that are looked at for zero bytes.
HEAD = 4096

DOCUMENT = "path string, file_name string, file_type string, byte_size long, sha256 string, document_id string, method string, text string, warnings array<string>, needs string, error string"


class Unreadable(ValueError):
    """Why a file gives no text."""


def decoded(content: bytes) -> str:
    """The text of a text file in the first code that fits."""
    if b"\x00" in content[:HEAD]:
        raise Unreadable("binary content in a text file")
    for code in CODES:
        try:
            return content.decode(code)
        except UnicodeDecodeError:
            continue
    raise Unreadable("unknown character code")


def _member(archive: zipfile.ZipFile, name: str, most: int) -> bytes:
    """A member's bytes; neither its stated nor its real size may pass the limit."""
    if archive.getinfo(name).file_size > most:
        raise Unreadable("text parts are too large")
    with archive.open(name) as member:
        content = member.read(most + 1)
    if len(content) > most:
        raise Unreadable("text parts are too large")
    if b"<!DOCTYPE" in content:
        raise Unreadable("a text part has a document type")
    return content


def docx_text(content: bytes) -> str:
    """Paragraphs of the body, then of headers and footers by name. No other member is opened."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            names = set(archive.namelist())
            if "word/document.xml" not in names:
                raise Unreadable("no body")
            left, out = MOST_XML, []
            for name in ["word/document.xml", *sorted(n for n in names if re.fullmatch(r"word/(header|footer)\d+\.xml", n))]:
                part = _member(archive, name, left)
                left -= len(part)
                for _, paragraph in ElementTree.iterparse(io.BytesIO(part)):
                    if paragraph.tag == f"{WORD}p":
                        line = "".join(piece.text or "" for piece in paragraph.iter(f"{WORD}t")).strip()
                        if line:
                            out.append(line)
                        paragraph.clear()
            return "\n".join(out)
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, RuntimeError, NotImplementedError, EOFError, OSError) as e:
        raise Unreadable("not a readable DOCX") from e


def cleaned(text: str) -> str:
    """NUL as space, runs of spaces and tabs as one, none behind a line end, two line ends at most in a row, trimmed."""
    text = re.sub(r"\n[ \t]+", "\n", re.sub(r"[ \t]+", " ", text.replace("\x00", " ")))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def _one(kind: str, size: int, content: bytes | None) -> tuple[str | None, str | None, list[str], str | None, str | None]:
    """method, text, warnings, needs, error of a file."""
    try:
        if kind not in SIGNATURES:
            raise Unreadable("unsupported kind of file")
        if not size:
            raise Unreadable("empty file")
        if size > MOST_BYTES or content is None:
            raise Unreadable("file is too large")
        if not content.startswith(SIGNATURES[kind]):
            raise Unreadable(f"not a valid {'jpeg' if kind == 'jpg' else kind}")
        if kind not in ("txt", "docx"):
            return None, None, [], "layout" if kind == "pdf" else "recognition", None
        method, text = ("text", decoded(content)) if kind == "txt" else ("docx", docx_text(content))
        text = cleaned(text)
        if not text:
            raise Unreadable("no readable text")
        return method, text[:MOST_CHARS], ["text was cut"] if len(text) > MOST_CHARS else [], None, None
    except Unreadable as e:
        return None, None, [], None, str(e)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]
    for whole in batches:
        for k in range(whole.num_rows):  # one file at a time: contents are large
            batch = whole.slice(k, 1)
            found = _one(batch.column("file_type")[0].as_py(), batch.column("byte_size")[0].as_py(), batch.column("content")[0].as_py())
            own = {n: batch.column(n) for n in ("path", "file_name", "file_type", "byte_size", "sha256")}
            own["document_id"] = pa.array([None if own["sha256"][0].as_py() is None else f"DOC-{own['sha256'][0].as_py()[:16].upper()}"], pa.string())
            for name, value, kind in zip(("method", "text", "warnings", "needs", "error"), found, kinds, strict=True):
                own[name] = pa.array([value], kind)
            yield pa.RecordBatch.from_arrays(list(own.values()), names=list(own))


def parse(files: DataFrame) -> DataFrame:
    """A row for each of files (path, length, content): its text, or what it needs, or why it gives none."""
    name = F.trim(F.regexp_extract("path", r"([^/\\]*)$", 1))
    kind = F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1))
    size = F.coalesce("length", F.octet_length("content"), F.lit(0)).cast("long")
    rows = files.select("path", name.alias("file_name"), kind.alias("file_type"), size.alias("byte_size"), F.sha2("content", 256).alias("sha256"), F.when(size <= MOST_BYTES, F.col("content")).alias("content"))
    return rows.mapInArrow(_read, DOCUMENT)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a folder and those below it. Of files that are too large only the name and size are read; Spark leaves out files without a byte."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")
    small, large = files.filter(F.col("length") <= MOST_BYTES), files.filter(F.col("length") > MOST_BYTES)
    return parse(small).unionByName(parse(large.select("path", "length", F.lit(None).cast("binary").alias("content"))))
