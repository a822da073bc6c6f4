"""A Python data source that replays recorded pages of a paged service (drive, mail, calendar, meetings), batch or stream.

Option `path` names a folder of JSON files, one a page: {"items": [...], "next": token or null}. The first by name comes first,
and a page's token names the next one's file; null ends a full pass, a token without a file ends the pass before its time
(`full_pass` tells which). A page is a partition and, on a stream, an offset, so a stopped stream goes on with the page
after the last one it committed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

SCHEMA = "page int, external_id string, kind string, modified_at string, trashed boolean, payload string"


def _pages(folder: str) -> list[str]:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    return sorted(i.path for i in store.get_file_info(fs.FileSelector(base)) if i.path.endswith(".json"))


def _page(path: str, folder: str) -> dict:
    from pyarrow import fs

    store, _ = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(path) as f:
        return json.loads(f.read())


def _after(folder: str, path: str | None) -> str | None:
    """The file of the page after `path`, or of the first one; None where there is none (yet)."""
    paths = _pages(folder)
    if path is None:
        return paths[0] if paths else None
    token = _page(path, folder).get("next")
    name = f"{path.rsplit('/', 1)[0]}/{token}.json"
    return name if token is not None and name in paths else None


def _chain(folder: str) -> list[str]:
    out: list[str] = []
    path = _after(folder, None)
    while path is not None and path not in out:
        out.append(path)
        path = _after(folder, path)
    return out


def full_pass(folder: str) -> bool:
    """Whether the recorded pages reach the service's last one; only then may what is missing count as gone."""
    chain = _chain(folder)
    return bool(chain) and _page(chain[-1], folder).get("next") is None


def _rows(folder: str, number: int, path: str) -> Iterator[tuple]:
    for item in _page(path, folder).get("items", []):
        yield (number, str(item.get("id")), item.get("kind"), item.get("modified_at"), bool(item.get("trashed", False)), json.dumps(item, sort_keys=True))


class _Page(InputPartition):
    def __init__(self, number: int, path: str):
        self.number, self.path = number, path


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[_Page]:
        return [_Page(k, p) for k, p in enumerate(_chain(self.folder))] or [_Page(-1, "")]

    def read(self, partition: _Page) -> Iterator[tuple]:
        if partition.number >= 0:
            yield from _rows(self.folder, partition.number, partition.path)


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"page": 0, "last": ""}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        path = _after(self.folder, start["last"] or None)
        return (iter([]), start) if path is None else (iter(list(_rows(self.folder, start["page"], path))), {"page": start["page"] + 1, "last": path})

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        last, page = start["last"] or None, start["page"]
        while page < end["page"]:
            last = _after(self.folder, last)
            yield from _rows(self.folder, page, last)
            page += 1


class RecordedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Stream(self.options["path"])
