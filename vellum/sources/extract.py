"""Files to page records.  One Arrow-batched pass reads what ``binaryFile`` lists; a file that can't be read gives a row with its error."""

from __future__ import annotations

import csv
import email
import email.policy
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import visible_text

PAGES = "path string, source_filename string, page_number long, page_text string, source string, ocr_failed boolean, error string"


# fixed value: headers of a mail that are shown, in order
SHOWN_HEADERS = ("From", "To", "Cc", "Date", "Subject")


class NeedsPlugin(ValueError):
    """A type whose reader isn't installed here, such as PDF."""


def read_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)


def _plain(body: bytes, suffix: str) -> str:
    return body.decode("utf-8")


# fixed values: first words of blocks that aren't cues, and tags that cues have
NOT_CUES, CUE_TAGS = ("WEBVTT", "NOTE", "STYLE", "REGION"), {"c", "i", "b", "u", "v"}


def _said(line: str) -> str:
    """A cue's line with its speaker's name before the words, and without the other tags."""
    out = []
    for k, piece in enumerate(re.split(r"<([^>]*)>", line)):
        if k % 2 == 0:
            out.append(piece)
            continue
        kind, _, name = piece.lstrip("/").partition(" ")
        if kind.split(".")[0] not in CUE_TAGS:
            out.append(f"<{piece}>")
        elif kind.split(".")[0] == "v" and name.strip():
            out.append(f"{name.strip()}: ")
    return "".join(out)


# what a whole line that gives a cue's time looks like; an arrow in speech is speech
_TIMING = re.compile(r"(?:\d+:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?\s*-->\s*(?:\d+:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?(?:\s.*)?")


def _clock(timing: str) -> str:
    """[hours:minutes:seconds] of where a cue starts."""
    *hours, minutes, seconds = timing.split("-->")[0].strip().replace(",", ".").split(":")
    return f"[{int(hours[0]) if hours else 0:02d}:{int(minutes):02d}:{seconds.split('.')[0]}] "


def _subtitles(body: bytes, suffix: str) -> str:
    """Blocks of lines are cues: an identifier, the timing, and what is said, whose first line gets its start time."""
    out = []
    for block in re.split(r"(?:\r\n|\r|\n)[ \t]*(?:(?:\r\n|\r|\n)[ \t]*)+", body.decode("utf-8-sig", "replace")):
        lines = [x.strip() for x in block.splitlines() if x.strip()]
        timing = next((k for k, x in enumerate(lines) if _TIMING.fullmatch(x)), None)
        if not lines or timing is None and lines[0].upper().startswith(NOT_CUES):
            continue
        said = [x for x in map(_said, lines[0 if timing is None else timing + 1 :]) if not x.isdigit()]
        if said and timing is not None:
            said[0] = _clock(lines[timing]) + said[0]
        out += said
    return "\n".join(out)


def _csv(body: bytes, suffix: str) -> str:
    rows = csv.reader(io.StringIO(body.decode("utf-8", "replace"), newline=""))
    return "\n".join(" | ".join(c.strip() for c in r) for r in rows)


def _json(body: bytes, suffix: str) -> str:
    raw = body.decode("utf-8", "replace")
    try:
        return json.dumps(json.loads(raw), indent=2, ensure_ascii=False)
    except ValueError:
        return raw


def _docx(body: bytes, suffix: str) -> str:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(body)).read("word/document.xml"))
    body_node = root.find(f"{w}body")
    shown = {f"{w}t": lambda n: n.text or "", f"{w}tab": lambda n: "\t", f"{w}br": lambda n: "\n"}
    return "\n".join("".join(shown[n.tag](n) for n in p.iter() if n.tag in shown) for p in (body_node if body_node is not None else root).findall(f"{w}p"))


def message(body: bytes):
    return email.message_from_bytes(body, policy=email.policy.default)


class _Words(HTMLParser):
    """The text between a page's tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_data(self, data: str) -> None:
        self.found.append(data)


def _own_texts(part):
    """A mail's text parts in order; what is attached, other mails among it, isn't entered."""
    if part.get_content_disposition() == "attachment" or part.get_content_maintype() == "message":
        return
    if part.is_multipart():
        for inner in part.iter_parts():
            yield from _own_texts(inner)
    elif part.get_content_maintype() == "text":
        yield part


def _said_by(part) -> str:
    """A text part's text; a charset that nobody knows is read as UTF-8."""
    try:
        return part.get_content()
    except LookupError:
        return (part.get_payload(decode=True) or b"").decode("utf-8", "replace")


def _eml(body: bytes, suffix: str) -> str:
    """Headers, the plain body or else the HTML one without tags, and the names of attachments."""
    mail = message(body)
    bodies: dict[str, str] = {}
    for part in _own_texts(mail):
        bodies.setdefault(part.get_content_subtype(), _said_by(part))
    if "plain" not in bodies and "html" in bodies:
        page = _Words()
        page.feed(bodies["html"])
        page.close()
        bodies["plain"] = " ".join(" ".join(page.found).split())
    heads = [f"{name}: {mail[name]}" for name in SHOWN_HEADERS if mail[name]]
    files = ", ".join(filter(None, (a.get_filename() for a in mail.iter_attachments())))
    return "\n\n".join(["\n".join(heads), *filter(None, (bodies.get("plain"), files and f"[Attachments: {files}]"))])


def _html(body: bytes, suffix: str) -> str:
    """Left raw here; ``extract`` makes it visible text with column functions."""
    return body.decode("utf-8", "replace")


READERS: dict[str, Callable[[bytes, str], str]] = {
    **dict.fromkeys(("txt", "md"), _plain), **dict.fromkeys(("html", "htm"), _html), **dict.fromkeys(("vtt", "srt"), _subtitles),
    "csv": _csv, "json": _json, "eml": _eml, "docx": _docx,
}


def extract(files: DataFrame, plugins: dict[str, Callable[[bytes], list[tuple[str, bool]]]] | None = None) -> DataFrame:
    """Page records of files (path, content).  ``plugins`` read further types, such as pdf, into (text, ocr_failed) of each page."""
    more = plugins or {}

    def pages(path: str, body: bytes) -> list[tuple]:
        name = path.rsplit("/", 1)[-1]
        suffix = name.rsplit(".", 1)[-1].lower() if "." in name else ""
        try:
            if suffix in more:
                return [(path, name, i, text, suffix, failed, None) for i, (text, failed) in enumerate(more[suffix](body), 1)]
            if suffix not in READERS:
                raise NeedsPlugin(f"unsupported file type: .{suffix}")
            kind = "html" if suffix == "htm" else suffix
            return [(path, name, 1, READERS[suffix](body, suffix), kind, False, None)]
        except Exception as e:  # the file is set aside with its error; others go on
            return [(path, name, None, None, suffix, False, f"{type(e).__name__}: {e}")]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for path, body in zip(b["path"], b["content"], strict=True) for r in pages(path, bytes(body))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAGES.split(", ")]).astype({"page_number": "Int64"})

    got = files.select("path", "content").mapInPandas(task, PAGES)
    return got.withColumn("page_text", F.when(F.col("source") == "html", visible_text(F.col("page_text"))).otherwise(F.col("page_text")))


def attachments(mails: DataFrame) -> DataFrame:
    """Files attached to mails (path, content): named, decodable parts, as (attachment_of, filename, content, size)."""
    out = "attachment_of string, filename string, content binary, size long"

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, body in zip(b["path"], b["content"], strict=True):
                for part in message(bytes(body)).iter_attachments():
                    name, data = part.get_filename(), part.get_payload(decode=True)
                    if name and data:
                        rows.append((path, re.split(r"[\\/]", name)[-1], data, len(data)))
            yield pd.DataFrame(rows, columns=["attachment_of", "filename", "content", "size"])

    return mails.select("path", "content").mapInPandas(task, out)
