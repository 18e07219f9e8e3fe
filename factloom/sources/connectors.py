"""Remote services as batch data sources: a search, and a fetch of documents by id.

The service is a function that the caller registers; this package opens no connection of its own. Tests register a
function over a local table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

#: name -> function(list of ids) -> list of (id, document as a dict); ids that are not found are left out.
FETCHERS: dict[str, Callable[[list[str]], list[tuple[str, dict]]]] = {}


def fetch(ids: DataFrame, key: str, service: Callable[[list[str]], list[tuple[str, dict]]], batch: int = 200, calls: int = 8) -> DataFrame:
    """(key, found, body, error): every id asked for in batches, `calls` batches at a time at most. A failed batch is reported, not raised.

    Ids that the service doesn't know come out with found = false, so that a ledger can keep them from being asked again.
    """
    kind = ids.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), batch):
                part = f[key].iloc[lo : lo + batch].tolist()
                try:
                    got, error = dict(service(part)), None
                except Exception as e:  # noqa: BLE001
                    got, error = {}, f"{type(e).__name__}: {e}"
                yield pd.DataFrame({key: part, "found": [None if error else i in got for i in part], "body": [json.dumps(got[i], ensure_ascii=False) if i in got else None for i in part], "error": error})

    return ids.select(key).distinct().repartition(calls, key).mapInPandas(run, f"`{key}` {kind}, found boolean, body string, error string")


def resolve(ids: DataFrame, key: str, value: str, service: Callable[[list], list[tuple[object, dict]]], batch: int = 200) -> DataFrame:
    """(key, value): what the service knows of each id, asked for `batch` at a time; ids that it doesn't map are left out."""
    found = fetch(ids, key, service, batch)
    return found.select(key, F.get_json_object("body", f"$.{value}").alias(value)).where(F.col(value).isNotNull())


def fetch_binary(keys: DataFrame, key: str, service: Callable[[list], list[tuple[object, bytes]]], batch: int = 20, calls: int = 8) -> DataFrame:
    """(key, found, data, error) of objects whose content is bytes, as `fetch` does for documents."""
    kind = keys.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), batch):
                part = f[key].iloc[lo : lo + batch].tolist()
                try:
                    got, error = dict(service(part)), None
                except Exception as e:  # noqa: BLE001
                    got, error = {}, f"{type(e).__name__}: {e}"
                yield pd.DataFrame({key: part, "found": [None if error else i in got for i in part], "data": [got.get(i) for i in part], "error": error})

    return keys.select(key).distinct().repartition(calls, key).mapInPandas(run, f"`{key}` {kind}, found boolean, data binary, error string")


def search_pages(asked: DataFrame, service: Callable[[str, int, int], list[dict]], page: int = 100, calls: int = 8) -> DataFrame:
    """(query, rank, pmcid, title): the first `n` hits of every query (query, n), a page at a time; a short page is the last. Queries run on several executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for query, n in zip(f["query"], f["n"], strict=True):
                start = 0
                while start < n:
                    hits = service(query, start, min(page, int(n) - start))
                    if hits:
                        yield pd.DataFrame({"query": query, "rank": range(start, start + len(hits)), "pmcid": [h.get("pmcid") for h in hits], "title": [h.get("title") for h in hits]}).astype({"rank": "int32"})
                    start += page
                    if len(hits) < page:
                        break

    return asked.select("query", "n").repartition(calls, "query").mapInPandas(run, "query string, rank int, pmcid string, title string")


class SearchSource(DataSource):
    """format("claim_search"): options `path` (a JSON-lines file of documents), `licences` (comma-separated), `phrase`, `n`.

    With `pushdown` = true, conditions on the licence are pushed into the search, so `n` counts what they leave; the session
    then needs spark.sql.python.filterPushdown.enabled.
    """

    @classmethod
    def name(cls) -> str:
        return "claim_search"

    def schema(self) -> str:
        return "rank int, pmcid string, title string, licence string"

    def reader(self, schema) -> DataSourceReader:
        pushing = self.options.get("pushdown", "false").lower() == "true"
        return (_PushingReader if pushing else _SearchReader)(self.options)


class _SearchReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.licences = {x.strip() for x in options.get("licences", "").split(",") if x.strip()}
        self.phrase = options.get("phrase", "").lower()
        self.n = int(options.get("n", "100"))
        self.nothing = False

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # a search answers with one ranked list

    def read(self, partition) -> Iterator[tuple]:
        rank = 0
        if self.nothing:
            return
        with open(self.path, encoding="utf-8") as lines:
            for line in lines:
                if rank >= self.n or not line.strip():
                    continue
                d = json.loads(line)
                texts = " ".join(str(d.get(k) or "") for k in ("title", "abstract", "full_text")).lower()
                if (not self.licences or d.get("licence") in self.licences) and self.phrase in texts:
                    yield rank, d.get("pmcid"), d.get("title"), d.get("licence")
                    rank += 1


class _PushingReader(_SearchReader):
    def pushFilters(self, filters):
        """Equality and membership on the licence are the service's work; everything else stays with the engine."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("licence",) and isinstance(f, (EqualTo, In)):
                asked = set(value) if isinstance(f, In) else {value}
                self.licences = self.licences & asked if self.licences else asked
                self.nothing = not self.licences
            else:
                yield f
