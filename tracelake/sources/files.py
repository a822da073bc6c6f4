"""Files to typed blocks of text: kind detection, text and Markdown, WebVTT, DOCX and PDF.

Input is `binaryFile` rows (path, content). Text formats stay in the JVM; DOCX and PDF bytes are read in Arrow batches.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = "struct<text:string,char_start:int,char_end:int,section_path:string,location_label:string>"
PARSED = f"path string, status string, text string, blocks array<{BLOCK}>"


def file_kind(path: Column, content: Column) -> Column:
    """By content first, then by extension; an extension that the content contradicts is unsupported."""
    head = F.hex(F.substring(content, 1, 9))
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    docx = head.startswith("504B0304") & F.contains(content, F.lit("word/document.xml").cast("binary"))
    vtt = head.rlike("^(EFBBBF)?574542565454")
    by_content = F.when(head.startswith("255044462D"), "pdf").when(docx, "docx").when(vtt, "vtt")
    return F.coalesce(
        F.when(by_content.isNotNull() & ((extension == by_content) | ~extension.isin("pdf", "docx", "vtt")), by_content),
        F.when(by_content.isNull() & extension.isin("txt", "md", "markdown"), F.when(extension == "txt", "txt").otherwise("markdown")),
        F.lit("unsupported"),
    )


#: The characters in which Windows-1252 is not Latin-1.
_C1 = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))


def decoded(content: Column) -> Column:
    """UTF-8 without its mark, or else Windows-1252, or else UTF-8 with what is wrong replaced."""
    bare = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, 4, 2**31 - 1)).otherwise(content)
    text, latin = bare.cast("string"), F.decode(bare, "iso-8859-1")
    return F.coalesce(F.try_validate_utf8(text), F.when(~latin.rlike("[\x81\x8d\x8f\x90\x9d]"), F.translate(latin, _C1, _C1.encode("latin-1").decode("cp1252"))), F.make_valid_utf8(text))


def paragraphs(text: Column, markdown: bool = False) -> Column:
    """array<BLOCK> of a text's paragraphs (blank lines part them), with line labels and, in Markdown, the headings above."""
    pieces = F.regexp_extract_all(text, F.lit(r"((?:(?!\n[ \t]*\n)[\s\S])+|\n[ \t]*\n+)"), 1)

    def step(state: Column, piece: Column) -> Column:
        gap = piece.rlike(r"\A\n[ \t]*\n+\z")
        blank = F.regexp_replace(piece, r"(?U)\s+", "") == ""
        heading = F.regexp_extract(F.trim(piece), r"^(?:#{1,6})\s+(.*)$", 1)
        is_heading = F.trim(piece).rlike(r"^#{1,6}\s+[^\n]*$") if markdown else F.lit(False)
        under = F.when(is_heading, F.trim(heading)).otherwise(state["heading"])
        section = F.when(is_heading, F.concat(F.lit("heading: "), F.trim(heading))).when(state["heading"].isNotNull(), F.concat(F.lit("under: "), state["heading"]))
        end = state["at"] + F.length(piece)
        block = F.struct(piece.alias("text"), state["at"].alias("char_start"), end.alias("char_end"), section.alias("section_path"), F.concat(F.lit("line "), state["line"].cast("string")).alias("location_label"))
        lines = state["line"] + F.length(piece) - F.length(F.replace(piece, F.lit("\n"), F.lit("")))
        return F.struct(end.alias("at"), lines.alias("line"), F.when(gap, state["heading"]).otherwise(under).alias("heading"), F.when(gap | blank, state["blocks"]).otherwise(F.concat(state["blocks"], F.array(block))).alias("blocks"))

    start = F.struct(F.lit(0).alias("at"), F.lit(1).alias("line"), F.lit(None).cast("string").alias("heading"), F.array().cast(f"array<{BLOCK}>").alias("blocks"))
    return F.aggregate(pieces, start, step, lambda s: s["blocks"])


def cues(text: Column) -> Column:
    """array<struct<start, end, speaker, text>> of a WebVTT text, empty cues left out."""
    stamp = r"((?:\d{2,}:)?\d{2}:\d{2}\.\d{3})"
    plain = F.regexp_replace(text, r"\r\n?", "\n")
    raw = F.regexp_extract_all(plain, F.lit(stamp + r"[ \t]+-->[ \t]+" + stamp + r"[^\n]*\n((?:[^\n]+(?:\n|\z))*)"), 0)

    def one(cue: Column) -> Column:
        body = F.regexp_extract(cue, r"(?s)^[^\n]*\n(.*)$", 1)
        speaker = F.nullif(F.trim(F.regexp_extract(body, r"<v(?:\.[^ >]*)?\s+([^>]+)>", 1)), F.lit(""))
        said = F.trim(F.regexp_replace(F.regexp_replace(body, "<[^>]*>", ""), r"\s+", " "))
        return F.struct(F.regexp_extract(cue, "^" + stamp, 1).alias("start"), F.regexp_extract(cue, r"-->[ \t]+" + stamp, 1).alias("end"), speaker.alias("speaker"), said.alias("text"))

    return F.filter(F.transform(raw, one), lambda c: c["text"] != "")


def merged_turns(items: Column) -> Column:
    """Neighbours of one speaker (none is a speaker too) joined: array<struct<start, end, speaker, text>>."""
    kind = "array<struct<start:string,end:string,speaker:string,text:string>>"

    def step(done: Column, c: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), c["end"].alias("end"), last["speaker"].alias("speaker"), F.concat_ws(" ", last["text"], c["text"]).alias("text"))
        same = (F.size(done) > 0) & last["speaker"].eqNullSafe(c["speaker"])
        return F.when(same, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(c)))

    return F.when(F.size(items) == 0, F.array().cast(kind)).otherwise(F.aggregate(F.slice(items, 2, F.size(items)), F.slice(items, 1, 1).cast(kind), step))


def turn_blocks(turns: Column) -> Column:
    """array<BLOCK> of turns: "Speaker: text", a blank line between them, spans in the joined text."""
    numbered = F.transform(turns, lambda t, i: F.struct(F.concat(F.coalesce(F.concat(t["speaker"], F.lit(": ")), F.lit("")), t["text"]).alias("full"), F.concat(F.lit("turn "), (i + 1).cast("string"), F.coalesce(F.concat(F.lit(" ("), t["speaker"], F.lit(")")), F.lit(""))).alias("section"), F.concat(t["start"], F.lit("-"), t["end"]).alias("label")))

    def step(state: Column, t: Column) -> Column:
        end = state["at"] + F.length(t["full"])
        block = F.struct(t["full"].alias("text"), state["at"].alias("char_start"), end.alias("char_end"), t["section"].alias("section_path"), t["label"].alias("location_label"))
        return F.struct((end + 2).alias("at"), F.concat(state["blocks"], F.array(block)).alias("blocks"))

    return F.aggregate(numbered, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{BLOCK}>").alias("blocks")), step, lambda s: s["blocks"])


def parsed_text(files: DataFrame) -> DataFrame:
    """(path, kind, status, text, blocks) of text, Markdown and WebVTT files."""
    rows = files.select("path", file_kind(F.col("path"), F.col("content")).alias("kind"), decoded(F.col("content")).alias("text"))
    found = F.when(F.col("kind") == "vtt", turn_blocks(merged_turns(cues(F.col("text"))))).when(F.col("kind") == "markdown", paragraphs(F.col("text"), True)).when(F.col("kind") == "txt", paragraphs(F.col("text")))
    rows = rows.withColumn("blocks", found)
    status = F.when(F.col("blocks").isNull(), "unsupported").when(F.size("blocks") > 0, "parsed").when((F.col("kind") == "vtt") & F.contains("text", F.lit("-->")), "failed").otherwise("empty")
    return rows.withColumn("status", status).select("path", "kind", "status", "text", "blocks")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_docx(data: bytes) -> list[dict]:
    """Blocks of a DOCX body in order: paragraphs, list items and table cells with their coordinates."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    out: list[tuple[str, str]] = []
    text_of = lambda p: "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
    paragraphs = tables = 0
    for child in body if body is not None else ():
        if child.tag == f"{_W}p":
            paragraphs += 1
            is_list = child.find(f"{_W}pPr/{_W}numPr") is not None
            out.append((text_of(child), f"{'list item' if is_list else 'paragraph'} {paragraphs}"))
        elif child.tag == f"{_W}tbl":
            tables += 1
            for r, row in enumerate(child.findall(f"{_W}tr"), 1):
                for c, cell in enumerate(row.findall(f"{_W}tc"), 1):
                    out.append(("\n".join(filter(None, map(text_of, cell.findall(f"{_W}p")))), f"table {tables} row {r} column {c}"))
    return _spaced([(t, None, label) for t, label in out if t])


_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}


def _pdf_string(token: bytes) -> str:
    """The characters of a literal (...) or hexadecimal <...> string."""
    if token[:1] == b"<":
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", token)
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], b"" if m[1].endswith(b"\n") else m[1]), token[1:-1], flags=re.S)
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    return raw.decode("cp1252", "replace")


def _pdf_strings(stream: bytes) -> str:
    """What a content stream shows, a line for each showing operator."""
    text = rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>"
    lines = []
    for shown in re.finditer(rb"(?:" + text + rb")\s*(?:Tj|'|\")|\[(?:" + text + rb"|[^\]\\(<])*\]\s*TJ", stream, re.S):
        lines.append("".join(_pdf_string(t) for t in re.findall(text, shown[0], re.S)))
    return "\n".join(lines)


def _pdf_objects(data: bytes) -> dict[int, tuple[bytes, bytes | None]]:
    """Objects by number: (dictionary, inflated stream), those inside object streams among them."""
    out: dict[int, tuple[bytes, bytes | None]] = {}
    for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)(?:\bendobj|\Z)", data, re.S):
        head, _, rest = m[2].partition(b"stream")
        body = None
        if rest:
            body = re.sub(rb"\r?\n?endstream.*\Z", b"", re.sub(rb"\A\r?\n", b"", rest), flags=re.S)
            if b"/FlateDecode" in head:
                try:
                    body = zlib.decompressobj().decompress(body)
                except zlib.error:
                    body = None
        out[int(m[1])] = (head, body)
    for head, body in list(out.values()):
        counts = [re.search(rb"/%s\s+(\d+)" % name, head) for name in (b"N", b"First")]
        if b"/ObjStm" in head and body and all(counts):
            n, first = (int(c[1]) for c in counts)
            places = list(map(int, body[:first].split()[: 2 * n]))
            ends = [*places[3::2], len(body) - first]
            for number, at, end in zip(places[::2], places[1::2], ends, strict=False):
                out[number] = (body[first + at : first + end], None)
    return out


def _pdf_pages(data: bytes) -> list[bytes]:
    """Each page's content, in the order of the page tree; without a tree each content stream is a page."""
    objects = _pdf_objects(data)
    refs = lambda name, head: [int(n) for m in re.findall(rb"/%s\s*(\[[^\]]*\]|\d+\s+\d+\s+R)" % name, head) for n in re.findall(rb"(\d+)\s+\d+\s+R", m)]
    pages, seen = [], set()
    waiting = [n for head, _ in objects.values() if re.search(rb"/Type\s*/Catalog\b", head) for n in refs(b"Pages", head)]
    while waiting:
        number = waiting.pop(0)
        head = objects.get(number, (b"", None))[0]
        if number in seen:
            continue
        seen.add(number)
        if kids := refs(b"Kids", head):
            waiting = kids + waiting
        elif re.search(rb"/Type\s*/Page\b", head):
            pages.append(b"\n".join(objects.get(n, (b"", None))[1] or b"" for n in refs(b"Contents", head)))
    return pages or [body for _, body in objects.values() if body and b"BT" in body]


def read_pdf(data: bytes, least: int = 30) -> tuple[str, list[dict]]:
    """(status, blocks): a block for each page that has text; `ocr_required` if no page has `least` characters that are not blank.
    Text is what strings say in Latin or UTF-16; fonts with codes of their own are not resolved."""
    pages = [_pdf_strings(p).strip() for p in _pdf_pages(data)]
    dense = any(len(re.sub(r"\s", "", p)) >= least for p in pages)
    return ("parsed" if dense else "ocr_required"), _spaced([(p, None, f"page {k}") for k, p in enumerate(pages, 1) if p])


def _spaced(parts: list[tuple]) -> list[dict]:
    out, at = [], 0
    for text, section, label in parts:
        out.append({"text": text, "char_start": at, "char_end": at + len(text), "section_path": section, "location_label": label})
        at += len(text) + 2
    return out


def parsed_binary(files: DataFrame) -> DataFrame:
    """(path, status, text, blocks) of DOCX and PDF files (path, kind, content); unreadable bytes have status failed."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, kind, content in zip(frame["path"], frame["kind"], frame["content"], strict=True):
                try:
                    status, blocks = ("parsed", read_docx(bytes(content))) if kind == "docx" else read_pdf(bytes(content))
                except (zipfile.BadZipFile, KeyError, ET.ParseError, TypeError):
                    status, blocks = "failed", []
                rows.append((path, status if blocks or status != "parsed" else "empty", "\n\n".join(b["text"] for b in blocks), blocks))
            yield pd.DataFrame(rows, columns=["path", "status", "text", "blocks"])

    return files.where(F.col("kind").isin("docx", "pdf")).select("path", "kind", "content").mapInPandas(work, PARSED)
