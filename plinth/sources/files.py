"""File sources: document scans, parser routing, structured text readers, source registry and fetching."""

from __future__ import annotations

import io
import os
import re
import time
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import Protocol
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth import schema

#: Upload bound in bytes (fixed default).
UPLOAD_BYTES = 200 * 1024 * 1024
# ---- fixed values: elements and selectors without content of a page ------------------------------
NOISE_TAGS = {"script", "style", "noscript", "nav", "header", "footer", "form", "iframe", "svg", "aside", "button"}
NOISE_NAMES = {"sidebar", "nav", "navbar", "breadcrumb", "header", "footer", "cookie", "menu", "social", "share", "advertisement"}
NOISE_IDS = {"sidebar", "cookie"}
STATUTE_KINDS = ("statute", "act", "amendment", "rule", "regulation", "notification")


def parser_for(mime: Column, name: Column) -> Column:
    """The media type decides, then the suffix; text otherwise."""
    m, n = F.lower(F.coalesce(mime, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    by_mime = F.when(m.contains("pdf"), "pdf").when(m.contains("html"), "html").when(m.contains("wordprocessingml"), "docx").when(m.startswith("text/"), "text")
    by_name = F.when(n.endswith(".pdf"), "pdf").when(n.rlike("[.]html?$"), "html").when(n.endswith(".docx"), "docx")
    return F.coalesce(by_mime, by_name, F.lit("text"))


def needs_ocr(mime: Column, text: Column, enabled: bool = True, floor: int = 80) -> Column:
    return F.lit(enabled) & mime.contains("pdf") & (F.length(F.trim(F.coalesce(text, F.lit("")))) < floor)


def kind_of_name(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.rlike("judgment|judgement|sci_|hc_|case"), "judgment").when(low.contains("fir_"), "fir").when(low.contains("chargesheet"), "chargesheet").when(low.rlike("contract|agreement"), "contract").otherwise("statute")


def upload_verdict(length: Column, size: Column, most: int = UPLOAD_BYTES) -> Column:
    return F.when(length == 0, "empty").when(size > most, "too_large").otherwise("accepted")


def pick_text(names: list[str], floor: int = 200) -> Column:
    """The first column of at least ``floor`` characters, else the longest."""
    first = [F.when(F.length(F.trim(F.col(n))) >= floor, F.col(n)) for n in names]
    longest = F.array_max(F.array(*(F.struct(F.coalesce(F.length(n), F.lit(0)).alias("k"), F.lit(-i).alias("p"), F.col(n).alias("v")) for i, n in enumerate(names))))
    return F.coalesce(*first, longest["v"])


#: Longest text that a fetched corpus row keeps, and what follows it where more was cut.
MAX_TEXT, CUT_MARK = 60_000, "\n\n[... truncated by fetch_hf_corpora ...]"


def fetched_text(names: list[str], limit: int = MAX_TEXT) -> Column:
    """The picked text without white space around it, cut at ``limit`` characters with a mark."""
    body = F.btrim(pick_text(names), F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(body) > limit, F.concat(F.substring(body, 1, limit), F.lit(CUT_MARK))).otherwise(body)


def scan(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """(path, name, stem, modified, length, content) of the files below a folder; partial downloads are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.col("modificationTime").alias("modified"), "length", "content").filter(~F.col("name").rlike(r"\.(tmp|part)$"))


def utf8(content: Column) -> Column:
    """UTF-8 text of bytes, null where they are not valid; those go through :func:`decode_text`."""
    return F.try_validate_utf8(content.cast("string"))


def decode_text(data: bytes) -> str:
    """The first of UTF-8, UTF-16 and Latin-1 that can read the bytes."""
    for encoding in ("utf-8", "utf-16"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


#: The column that keeps a JSON line which does not fit the schema.
BAD_LINE = "bad_line"


def jsonl(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped, and one that cannot be read stands in ``bad_line``."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    read = lines.select("value", F.from_json("value", f"{columns}, {BAD_LINE} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE}).alias("r"))
    return read.select("r.*")


class _Text(HTMLParser):
    """Text of a page without noise elements; the text of main or article is kept apart."""

    _VOID = {"br", "img", "meta", "link", "input", "hr", "source", "area", "base", "col", "embed", "track", "wbr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool]] = []
        self.all: list[str] = []
        self.main: list[str] = []
        self.article: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in self._VOID:
            return
        found = dict(attrs)
        names = set((found.get("class") or "").split())
        noise = tag in NOISE_TAGS or names & NOISE_NAMES or found.get("id") in NOISE_IDS or (bool(self.stack) and self.stack[-1][1])
        self.stack.append((tag, bool(noise), False))

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return

    def handle_data(self, data):
        if self.stack and self.stack[-1][1]:
            return
        tags = {t for t, _, _ in self.stack}
        if "title" in tags or "head" in tags:
            return
        self.all.append(data)
        if "main" in tags:
            self.main.append(data)
        if "article" in tags:
            self.article.append(data)

    def text(self) -> str:
        body = "\n".join(self.main or self.article or self.all)
        return re.sub(r"\n{3,}", "\n\n", re.sub("[ \t ]+", " ", body)).strip()


def html_text(html: str | None) -> str:
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return parser.text()


def docx_text(data: bytes) -> str:
    """Paragraphs, then table rows with cells joined by `` | ``."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as box:
        body = ElementTree.fromstring(box.read("word/document.xml")).find(f"{space}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{space}t"))
    lines = [words(p) for p in body.findall(f"{space}p")]
    for row in body.iter(f"{space}tr"):
        lines.append(" | ".join(words(c).strip() for c in row.findall(f"{space}tc")))
    return "\n".join(x for x in lines if x.strip())


def joined_pages(pages: list[str]) -> tuple[str, list[tuple[int, int]]]:
    """Pages joined by one character, and where each begins and ends."""
    offsets, at = [], 0
    for page in pages:
        offsets.append((at, at + len(page)))
        at += len(page) + 1
    return "\n".join(pages), offsets


def pdf_pages(data: bytes) -> tuple[list[str], bool, str | None]:
    """(text of each page, whether it stays encrypted, what went wrong); needs the optional ``pypdf``."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return [], False, "no_reader"
    try:
        reader = PdfReader(io.BytesIO(data))
        if reader.is_encrypted and not reader.decrypt(""):
            return [], True, None
    except Exception as problem:
        return [], bool(re.search("crypt", str(problem), re.I)), type(problem).__name__
    pages = []
    for page in reader.pages:
        try:
            pages.append(page.extract_text() or "")
        except Exception:
            pages.append("")
    return pages, False, None


PARSED = "path string, name string, parser string, text string, page_offsets array<struct<start:int,end:int>>, encrypted boolean, problem string"


def _parsed_row(parser: str, data: bytes) -> tuple[str, list[tuple[int, int]], bool, str | None]:
    try:
        if parser == "pdf":
            pages, encrypted, problem = pdf_pages(data)
            return (*joined_pages(pages), encrypted, problem)
        text = docx_text(data) if parser == "docx" else html_text(decode_text(data)) if parser == "html" else decode_text(data)
        return text, [(0, len(text))], False, None
    except Exception as problem:
        return "", [], False, type(problem).__name__


def parse(files: DataFrame) -> DataFrame:
    """(path, name, parser, text, page_offsets, encrypted, problem) of scanned files.

    A column ``mime`` decides before the name, if there is one. Valid UTF-8
    text is read natively, the rest in Arrow batches; what cannot be read has
    an empty text and says why.
    """
    mime = F.col("mime") if "mime" in files.columns else F.lit("")
    routed = files.withColumn("parser", parser_for(mime, F.col("name"))).withColumn("plain", F.when(F.col("parser") == "text", utf8(F.col("content"))))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("plain").alias("end")))
    plain = routed.filter("plain is not null").select("path", "name", "parser", F.col("plain").alias("text"), whole.alias("page_offsets"), F.lit(False).alias("encrypted"), F.lit(None).cast("string").alias("problem"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in PARSED.split(", ")]
        for f in frames:
            rows = [(p, n, k, *_parsed_row(k, bytes(c))) for p, n, k, c in zip(f["path"], f["name"], f["parser"], f["content"], strict=True)]
            out = pd.DataFrame(rows, columns=names)
            out["page_offsets"] = [[{"start": a, "end": b} for a, b in spans] for spans in out["page_offsets"]]
            yield out

    rest = routed.filter("plain is null").select("path", "name", "parser", "content").mapInPandas(run, PARSED)
    return plain.unionByName(rest)


def readable(parsed: DataFrame) -> DataFrame:
    """Parsed documents without those that stay encrypted."""
    return parsed.filter(~F.coalesce("encrypted", F.lit(False)))


class OcrReader(Protocol):
    """Pages of a scanned document: the text of each and the confidences of its words in percent, -1 where there is none."""

    def __call__(self, data: bytes) -> list[tuple[str, list[float]]]: ...


def mean_confidence(words: list[float]) -> float:
    """The mean of a page's word confidences as a share; words without one do not count."""
    known = [w for w in words if w != -1]
    return sum(known) / len(known) / 100 if known else 0.0


def ocr(scans: DataFrame, load: Callable[[], OcrReader], floor: int = 80) -> DataFrame:
    """(path, text, page_offsets, page_confidences, problem) of the PDFs whose text is too short to be one.

    ``scans``: path, parser, text, content. ``load`` makes the reader once in
    a task; without a working one the texts are empty and say why.
    """
    out = "path string, text string, page_offsets array<struct<start:int,end:int>>, page_confidences array<double>, problem string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            reader, missing = load(), None
        except Exception as problem:
            reader, missing = None, type(problem).__name__
        for f in frames:
            rows = []
            for path, data in zip(f["path"], f["content"], strict=True):
                try:
                    pages, problem = (reader(bytes(data)), None) if reader else ([], missing)
                except Exception as failed:
                    pages, problem = [], type(failed).__name__
                text, spans = joined_pages([t for t, _ in pages])
                rows.append((path, text, [{"start": a, "end": b} for a, b in spans], [mean_confidence(c) for _, c in pages], problem))
            yield pd.DataFrame(rows, columns=["path", "text", "page_offsets", "page_confidences", "problem"])

    return scans.filter(needs_ocr(F.col("parser"), F.col("text"), floor=floor)).select("path", "content").mapInPandas(run, out)


def fetch_route(refs: DataFrame, local: DataFrame, cached: DataFrame, remote: DataFrame) -> DataFrame:
    """(id, url, via, path) of references (id, url): a ``file://`` address, the file of that id, the cached copy, the network, or ``missing``.

    ``local``, ``cached`` and ``remote``: id, path of what is there.
    """
    side = lambda df, name: df.groupBy("id").agg(F.min("path").alias(name))
    own = F.when(F.col("url").startswith("file://"), F.regexp_replace("url", "^file://", ""))
    joined = refs.join(side(local, "local"), "id", "left").join(side(cached, "cached"), "id", "left").join(side(remote, "remote"), "id", "left").withColumn("own", own)
    via = F.when(F.col("own").isNotNull() | F.col("local").isNotNull(), "file").when(F.col("cached").isNotNull(), "cache").when(F.col("remote").isNotNull(), "http").otherwise("missing")
    return joined.select("id", "url", via.alias("via"), F.coalesce("own", "local", "cached", "remote").alias("path"))


def verified(uploads: DataFrame) -> DataFrame:
    """``uploads`` (content, claimed, ...) with ``ok``: what was read back has the digest that was claimed."""
    return uploads.withColumn("ok", F.coalesce(F.sha2(F.col("content").cast("binary"), 256) == F.lower("claimed"), F.lit(False)))


def require_verified(uploads: DataFrame, key: str) -> DataFrame:
    """``uploads`` as they are; a digest that differs raises, and names some of the rows."""
    bad = [str(r[0]) for r in verified(uploads).filter("not ok").select(key).limit(5).collect()]
    if bad:
        raise ValueError(f"digest differs: {', '.join(bad)}")
    return uploads


#: A small corpus to try things on: path below the folder, and text.
DEMO = {
    "statutes/penal_code_theft.txt": "THE INDIAN PENAL CODE, 1860\n378. Theft.\nWhoever, meaning to take movable property dishonestly, moves it without consent commits theft.\nExplanation. A thing fixed to the earth becomes movable once it is cut off.\n",
    "statutes/penal_code_murder.txt": "THE INDIAN PENAL CODE, 1860\n300. Murder.\nCulpable homicide done with the intention of causing death is murder.\nProvided that the exceptions below are kept in mind.\n",
    "judgments/2019_state_v_x.txt": "1. The appeal arises from a report under Section 378 of IPC.\n2. Dishonest intention, movable property and taking without consent must be shown. See State of Maharashtra v. Ram Lal, (2019) 8 SCC 100.\n3. The appeal is dismissed.\n",
    "private/matter_demo/statement.txt": "Statement of Ramesh Kumar\nEx. P-1\n\nI saw the accused take my bicycle on 12 March 2024 without my consent.\n",
}


def write_demo(store: LocalStore) -> list[str]:
    """The demo corpus as files of a store; returns their addresses."""
    return [store.put(key, text.encode()) for key, text in DEMO.items()]


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, kind, text) of an evaluation corpus: .txt, .md and .html only."""
    files = scan(spark, folder).filter(F.lower("name").rlike(r"\.(txt|md|html)$"))
    return parse(files).select("path", "name", kind_of_name(F.col("name")).alias("kind"), "text")


def with_seeds(seeds: DataFrame, files: DataFrame, years: list[int] | None = None, courts: list[str] | None = None) -> DataFrame:
    """References of a source: its seeds, and the bare files that no seed names; optional year and court filters.

    ``seeds``: external_id, title, url, court, year. ``files`` as from :func:`scan`.
    """
    from plinth.functions.text import year_of_name

    bare = files.join(seeds.select(F.col("external_id").alias("stem")), "stem", "left_anti")
    refs = seeds.select("external_id", "title", "url", "court", "year").unionByName(bare.select(F.col("stem").alias("external_id"), F.col("name").alias("title"), F.col("path").alias("url"), F.lit(None).cast("string").alias("court"), year_of_name(F.col("name")).alias("year")))
    if years:
        refs = refs.filter(F.col("year").isin(years))
    if courts:
        refs = refs.filter(F.lower("court").isin([c.lower() for c in courts]))
    return refs


class Registry:
    """Sources by name; a name that is switched off or unknown raises KeyError."""

    def __init__(self) -> None:
        self._made: dict[str, tuple[Callable[[SparkSession], DataFrame], bool]] = {}

    def add(self, name: str, source: Callable[[SparkSession], DataFrame], enabled: bool = True) -> None:
        self._made[name] = (source, enabled)

    def get(self, name: str) -> Callable[[SparkSession], DataFrame]:
        source, enabled = self._made[name]
        if not enabled:
            raise KeyError(name)
        return source

    def names(self) -> list[str]:
        return sorted(n for n, (_, on) in self._made.items() if on)


class TokenBucket:
    """``rate`` permits a second per host, up to ``burst`` at once; returns the seconds to wait."""

    def __init__(self, rate: float = 1.0, burst: int = 3, clock: Callable[[], float] = time.monotonic) -> None:
        self.rate, self.burst, self.clock = rate, burst, clock
        self._state: dict[str, tuple[float, float]] = {}

    def acquire(self, host: str) -> float:
        now = self.clock()
        tokens, then = self._state.get(host, (float(self.burst), now))
        tokens = min(self.burst, tokens + (now - then) * self.rate) - 1
        self._state[host] = (tokens, now)
        return max(0.0, -tokens / self.rate)


class LocalStore:
    """Object store over a folder: write to a side file, then rename."""

    def __init__(self, root: str) -> None:
        self.root = root

    def _path(self, key: str) -> str:
        path = os.path.normpath(os.path.join(self.root, key))
        if not path.startswith(os.path.normpath(self.root) + os.sep):
            raise ValueError(f"key leaves the store: {key}")
        return path

    def put(self, key: str, data: bytes) -> str:
        path = self._path(key)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path + ".part", "wb") as f:
            f.write(data)
        os.replace(path + ".part", path)
        return "file://" + path

    def get(self, key: str) -> bytes:
        with open(self._path(key), "rb") as f:
            return f.read()

    def exists(self, key: str) -> bool:
        return os.path.exists(self._path(key))

    def presign(self, key: str, expires_s: int = 3600) -> str:
        """The file's own address: a folder has no access to grant."""
        return "file://" + self._path(key)

    def ensure(self) -> None:
        os.makedirs(self.root, exist_ok=True)


class BucketClient(Protocol):
    """What an S3-compatible client must do; a missing bucket raises an error whose code or text is NoSuchBucket."""

    def make_bucket(self, bucket: str) -> None: ...
    def bucket_exists(self, bucket: str) -> bool: ...
    def put(self, bucket: str, key: str, data: bytes) -> None: ...
    def get(self, bucket: str, key: str) -> bytes: ...
    def stat(self, bucket: str, key: str) -> object: ...
    def presign(self, bucket: str, key: str, expires_s: int) -> str: ...


class BucketStore:
    """Object store over a bucket of an S3-compatible client; a bucket that is missing is made, and the call tried once more."""

    def __init__(self, client: BucketClient, bucket: str) -> None:
        self.client, self.bucket = client, bucket

    def ensure(self) -> None:
        if not self.client.bucket_exists(self.bucket):
            self.client.make_bucket(self.bucket)

    def _call(self, method, *args):
        try:
            return method(self.bucket, *args)
        except Exception as problem:
            if "NoSuchBucket" not in (getattr(problem, "code", None), *str(problem).split()):
                raise
        self.ensure()
        return method(self.bucket, *args)

    def put(self, key: str, data: bytes) -> str:
        self._call(self.client.put, key, data)
        return f"s3://{self.bucket}/{key}"

    def get(self, key: str) -> bytes:
        return self._call(self.client.get, key)

    def exists(self, key: str) -> bool:
        try:
            self.client.stat(self.bucket, key)
        except Exception:
            return False
        return True

    def presign(self, key: str, expires_s: int = 3600) -> str:
        return self.client.presign(self.bucket, key, expires_s)


def store_for(bucket: str, root: str, connect: Callable[[], BucketClient] | None = None) -> LocalStore | BucketStore:
    """A bucket where a client can be had, else a folder of that name below ``root``."""
    if connect is not None:
        try:
            return BucketStore(connect(), bucket)
        except Exception:
            pass
    return LocalStore(os.path.join(root, bucket))


def ensure_stores(stores: list[LocalStore | BucketStore], attempts: int = 5, backoff_s: float = 0.25, sleep: Callable[[float], None] = time.sleep) -> None:
    """Make what the stores need; after a failure all are tried again, each time after a longer wait, and the last failure raises."""
    for attempt in range(1, attempts + 1):
        try:
            for store in stores:
                store.ensure()
            return
        except Exception:
            if attempt == attempts:
                raise
            sleep(backoff_s * attempt)


def load_bytes(uri: str, stores: dict[str, LocalStore | BucketStore]) -> bytes:
    """Bytes of ``s3://bucket/key``, ``file://path`` or a plain path."""
    scheme, _, rest = uri.rpartition("://")
    if scheme == "s3":
        bucket, _, key = rest.partition("/")
        return stores[bucket].get(key)
    with open(rest, "rb") as f:
        return f.read()


def crosswalk(spark: SparkSession, rows: list[dict], source: str, target: str, name: str, source_act: str, target_act: str) -> DataFrame:
    """A crosswalk table from mapping records; unknown mapping types count as partial."""
    kinds = ("one_to_one", "one_to_many", "many_to_one", "partial", "none")
    flat = [(name, source_act, target_act, str(r[source]), str(r[target]), r.get("mapping_type") if r.get("mapping_type") in kinds else "partial") for r in rows]
    return schema.inline(spark, flat, "name, source_act, target_act, source_section, target_section, mapping_type")
