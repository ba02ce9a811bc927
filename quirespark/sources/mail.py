"""MHT and HTML files: bodies, assets and headers, and their tables, links and paragraphs as rows."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from email import policy
from email.parser import BytesParser
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import decode_charset, decode_words
from .files import frame

PARTS = "doc_id string, html string, subject string, sender string, recipient string, date string, assets array<struct<key:string,data_url:string>>, n_parts int, error string"


def read_mail(data: bytes) -> dict:
    """The first HTML part, with the images beside it as data URLs under their location, cid: and base name. Text without markup is preformatted."""
    message = BytesParser(policy=policy.compat32).parsebytes(data)
    html, assets, n = None, {}, 0
    parts = [p for p in message.walk() if not p.is_multipart()] if message.is_multipart() else []
    for part in parts:
        n += 1
        kind, body = part.get_content_type(), part.get_payload(decode=True) or b""
        if kind == "text/html" and html is None:
            html = decode_charset(body, part.get_content_charset())
        elif kind.startswith("image/") or kind == "application/octet-stream":
            url = f"data:{'image/png' if kind == 'application/octet-stream' else kind};base64,{base64.b64encode(body).decode()}"
            location, cid = part.get("Content-Location", ""), part.get("Content-ID", "").strip().strip("<>")
            if location:
                assets[location] = url
                assets.setdefault(re.split(r"[\\/]", location)[-1], url)
            if cid:
                assets[f"cid:{cid}"] = url
    if html is None:
        single = not message.is_multipart() and message.get("Content-Type")
        raw = message.get_payload(decode=True) if single else data
        named = re.search(rb"(?i)charset\s*=\s*[\"']?([\w-]+)", data[:4096])
        html = decode_charset(raw or b"", message.get_content_charset() or (named and named[1].decode()))
        if not re.search(r"<[a-z!]", html, re.I):
            html = "<pre>" + html.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") + "</pre>"
    header = lambda k: decode_words(str(message.get(k, "") or ""))
    return {"html": html, "subject": header("Subject"), "sender": header("From"), "recipient": header("To"), "date": str(message.get("Date", "") or ""), "assets": [{"key": k, "data_url": v} for k, v in assets.items() if k], "n_parts": n, "error": None}


def mails(files: DataFrame) -> DataFrame:
    """PARTS of files(doc_id, content)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    rows.append({"doc_id": doc_id} | read_mail(bytes(content or b"")))
                except (ValueError, LookupError) as e:
                    rows.append({"doc_id": doc_id, "error": str(e)})
            yield frame(rows, PARTS)

    return files.select("doc_id", "content").mapInPandas(parse, PARTS)


#: Elements that start a paragraph of their own, and those whose text is not shown.
BLOCKS = set("address article aside blockquote body dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td th thead tr ul".split())
UNSEEN = {"script", "style", "head", "title", "noscript", "template"}
VOID = set("area base br col embed hr img input link meta source track wbr".split())


class _Walk(HTMLParser):
    """Paragraphs of runs, and table cells."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.stack: list[str] = []
        self.runs: list[tuple] = []
        self.href: list[str | None] = []
        self.tables: list[dict] = []
        self.n_tables = 0

    def flush(self) -> None:
        runs: list[list] = []
        for text, *form in self.runs:
            if runs and runs[-1][1:] == form:
                runs[-1][0] += text
            else:
                runs.append([text, *form])
        for r in runs:
            r[0] = re.sub(r"\s+", " ", r[0])
        if runs:
            runs[0][0], runs[-1][0] = runs[0][0].lstrip(), runs[-1][0].rstrip()
        runs = [r for r in runs if r[0]]
        if runs and any(r[0].strip() for r in runs):
            block = next((t for t in reversed(self.stack) if t in BLOCKS), "body")
            self.rows.append({"kind": "paragraph", "tag": block, "text": "".join(r[0] for r in runs), "runs": [{"text": t, "bold": b, "italic": i, "href": h} for t, b, i, h in runs]})
        self.runs = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in BLOCKS or tag == "br":
            self.flush()
        if tag == "img":
            self.flush()
            self.rows.append({"kind": "image", "tag": "img", "text": a.get("alt") or "", "src": a.get("src") or a.get("data-blocked"), "blocked": "data-blocked" in a})
        if tag == "table":
            for t in self.tables:
                t["nested"] = True
            self.n_tables += 1
            self.tables.append({"id": self.n_tables, "row": -1, "nested": False, "cells": []})
        elif self.tables and tag == "tr":
            self.tables[-1]["row"] += 1
        elif self.tables and tag in ("td", "th"):
            style = (a.get("style") or "").lower()
            self.tables[-1]["cells"].append({"row": self.tables[-1]["row"], "text": "", "is_header": tag == "th", "bordered": bool(re.search(r"border(-top|-left)?:[^;]*[1-9]", style))})
        if tag not in VOID:
            self.stack.append(tag)
            self.href.append(a.get("href") if tag == "a" else self.href[-1] if self.href else None)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if tag == "table" and self.tables:
            t = self.tables.pop()
            self.rows += [{"kind": "cell", "tag": "td", "table_id": t["id"], "nested": t["nested"], **c, "text": re.sub(r"\s+", " ", c["text"]).strip()} for c in t["cells"]]
        if tag in self.stack:
            while self.stack.pop() != tag:
                self.href.pop()
            self.href.pop()

    def handle_data(self, data: str) -> None:
        if any(t in UNSEEN for t in self.stack):
            return
        bold, italic = any(t in ("b", "strong", "th", "h1", "h2", "h3") for t in self.stack), any(t in ("i", "em") for t in self.stack)
        self.runs.append((data, bold, italic, self.href[-1] if self.href else None))
        for t in self.tables[-1:]:
            if t["cells"]:
                t["cells"][-1]["text"] += data


ITEMS = "doc_id string, seq long, kind string, tag string, text string, runs array<struct<text:string,bold:boolean,italic:boolean,href:string>>, src string, blocked boolean, table_id int, row int, is_header boolean, bordered boolean, nested boolean"


def structure(pages: DataFrame) -> DataFrame:
    """ITEMS of pages(doc_id, html): paragraphs with runs, images and table cells, in order."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[dict] = []
            for doc_id, html in zip(batch["doc_id"], batch["html"], strict=True):
                w = _Walk()
                w.feed(html or "")
                w.close()
                w.flush()
                rows += [{"doc_id": doc_id, "seq": i} | r for i, r in enumerate(w.rows)]
            yield frame(rows, ITEMS)

    return pages.select(F.col("doc_id").cast("string").alias("doc_id"), "html").mapInPandas(walk, ITEMS)
