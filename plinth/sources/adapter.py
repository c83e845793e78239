"""Sources beyond plain files: a Python data source for adapters, configuration files, and a polite cached fetcher."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from plinth import schema
from plinth.sources.files import TokenBucket

try:
    import yaml
except ImportError:
    yaml = None


class _Ref(InputPartition):
    def __init__(self, ref: dict) -> None:
        self.ref = ref


def _read(ref: dict, root: str) -> Iterator[tuple]:
    """The row of one reference; one that cannot be read says why."""
    if not ref:
        return
    path = ref.get("url", "").removeprefix("file://") or os.path.join(root, ref["external_id"])
    known = ref["external_id"], ref.get("title"), _year(ref), _court(ref)
    try:
        with open(path, "rb") as f:
            yield *known, f.read(), None
    except OSError as problem:
        yield *known, None, type(problem).__name__


def _year(ref: dict) -> int | None:
    """The reference's year, or the first one in its name."""
    if (year := ref.get("year")) is not None:
        return int(year)
    found = re.search(r"(?<!\d)(?:1[89]|20)\d\d(?!\d)", ref["external_id"])
    return int(found.group()) if found else None


def _court(ref: dict) -> str | None:
    return ref["court"].lower() if ref.get("court") else None


def _test(f: Filter) -> Callable[[dict], bool] | None:
    """What a filter on year, court or external_id asks of a reference; None where only Spark can tell."""
    column = {("year",): _year, ("court",): _court, ("external_id",): lambda ref: ref["external_id"]}.get(getattr(f, "attribute", None))
    if column is None:
        return None
    known = lambda holds: lambda ref: (v := column(ref)) is not None and holds(v)
    match f:
        case IsNotNull():
            return lambda ref: column(ref) is not None
        case EqualTo():
            return known(lambda v: v == f.value)
        case In():
            return known(lambda v: v in f.value)
        case GreaterThanOrEqual():
            return known(lambda v: v >= f.value)
        case GreaterThan():
            return known(lambda v: v > f.value)
        case LessThanOrEqual():
            return known(lambda v: v <= f.value)
        case LessThan():
            return known(lambda v: v < f.value)
        case _:
            return None


class _Reader(DataSourceReader):
    """One partition per reference: a failing one is retried or reported alone."""

    def __init__(self, options: dict) -> None:
        self.refs = json.loads(options.get("refs", "[]"))
        self.root = options.get("root", "")
        self.tests: list[Callable[[dict], bool]] = []

    def partitions(self) -> list[InputPartition]:
        return [_Ref(r) for r in self.refs if all(test(r) for test in self.tests)] or [_Ref({})]

    def read(self, partition: _Ref) -> Iterator[tuple]:
        return _read(partition.ref, self.root)


class _Choosing(_Reader):
    """Those references that a pushed filter rules out are never opened."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if (test := _test(f)) is None:
                yield f
            else:
                self.tests.append(test)


class _Arrivals(DataSourceStreamReader):
    """References as they arrive: JSON-lines files in the folder ``arrivals``, whose names rise; the offset is the last name read."""

    def __init__(self, options: dict) -> None:
        self.folder, self.root = options["arrivals"], options.get("root", "")

    def _names(self) -> list[str]:
        return sorted(n for n in os.listdir(self.folder) if not n.startswith((".", "_"))) if os.path.isdir(self.folder) else []

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(self._names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        refs = []
        for name in self._names():
            if start["after"] < name <= end["after"]:
                with open(os.path.join(self.folder, name), encoding="utf-8") as f:
                    refs += [json.loads(line) for line in f if line.strip()]
        return [_Ref(r) for r in refs] or [_Ref({})]

    def read(self, partition: _Ref) -> Iterator[tuple]:
        return _read(partition.ref, self.root)

    def commit(self, end: dict) -> None:
        pass


class AdapterSource(DataSource):
    """``spark.read.format("plinth_adapter").option("refs", <json list>)``, or ``spark.readStream`` with ``arrivals``.

    A reference has external_id, and may have title, url, year and court (in
    the row in lower case). With the option ``pushdown`` filters on year, court
    and external_id choose the references to open; Spark refuses it unless
    ``spark.sql.python.filterPushdown.enabled`` is set, so :func:`references`
    sets the option by that.
    """

    @classmethod
    def name(cls) -> str:
        return "plinth_adapter"

    def schema(self) -> str:
        return "external_id string, title string, year int, court string, content binary, problem string"

    def reader(self, schema) -> DataSourceReader:
        return (_Choosing if self.options.get("pushdown") == "true" else _Reader)(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Arrivals(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AdapterSource)


def references(spark: SparkSession, refs: list[dict], root: str = "") -> DataFrame:
    """The documents of ``refs``, with filters pushed where the session allows it."""
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("plinth_adapter").option("refs", json.dumps(refs)).option("root", root).option("pushdown", pushed).load()


def load_yaml(path: str):
    if yaml is None:
        raise RuntimeError("reading YAML needs the optional yaml package")
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def crosswalk_file(spark: SparkSession, path: str) -> DataFrame:
    """A crosswalk file (source_act, target_act, mappings with one column per act) as a table."""
    spec = load_yaml(path)
    name = os.path.basename(path).rsplit(".", 1)[0]
    source, target = name.split("_")[:2]
    kinds = ("one_to_one", "one_to_many", "many_to_one", "partial", "none")
    rows = [(name, spec["source_act"], spec["target_act"], str(m[source]), str(m[target]), m.get("mapping_type") if m.get("mapping_type") in kinds else "partial") for m in spec.get("mappings", [])]
    return schema.inline(spark, rows, "name, source_act, target_act, source_section, target_section, mapping_type")


def threshold_file(path: str) -> dict:
    return load_yaml(path) or {}


def service_file(spark: SparkSession, path: str) -> DataFrame:
    """The service catalogue: id, title, kind, listens and publishes as lists."""
    rows = [(s["id"], s.get("title"), s.get("kind"), ",".join(s.get("listens", [])), ",".join(s.get("publishes", []))) for s in load_yaml(path).get("services", [])]
    return schema.inline(spark, rows, "id, title, kind, listens, publishes").selectExpr("id", "title", "kind", "split(listens, ',') AS listens", "split(publishes, ',') AS publishes")


class Fetcher:
    """Driver-side GET: disk cache by the URL's digest with an optional age limit, robots rules, a bucket per host.

    ``get`` is the transport, ``(url) -> (bytes, headers)``; rules that cannot be read allow.
    """

    def __init__(self, folder: str, get: Callable[[str], tuple[bytes, dict]], bucket: TokenBucket | None = None, agent: str = "plinth", sleep: Callable[[float], None] = time.sleep) -> None:
        self.folder, self.get, self.bucket, self.agent, self.sleep = folder, get, bucket or TokenBucket(), agent, sleep
        self._rules: dict[str, object] = {}

    def allowed(self, url: str) -> bool:
        from urllib.robotparser import RobotFileParser

        parts = urlsplit(url)
        if parts.netloc not in self._rules:
            rules = RobotFileParser()
            try:
                rules.parse(self.get(f"{parts.scheme}://{parts.netloc}/robots.txt")[0].decode("utf-8", "replace").splitlines())
            except Exception:
                rules.allow_all = True
            self._rules[parts.netloc] = rules
        return self._rules[parts.netloc].can_fetch(self.agent, url)

    def fetch(self, url: str, ttl_s: float | None = None) -> bytes:
        path = os.path.join(self.folder, hashlib.sha256(url.encode()).hexdigest())
        if os.path.exists(path) and (ttl_s is None or time.time() - os.path.getmtime(path) <= ttl_s):
            with open(path, "rb") as f:
                return f.read()
        if not self.allowed(url):
            raise PermissionError(url)
        self.sleep(self.bucket.acquire(urlsplit(url).netloc))
        data, _ = self.get(url)
        os.makedirs(self.folder, exist_ok=True)
        with open(path + ".part", "wb") as f:
            f.write(data)
        os.replace(path + ".part", path)
        return data
