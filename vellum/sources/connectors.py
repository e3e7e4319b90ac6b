"""The contract of external sources, as a Python data source: one partition for each page of a listing.

``spark.read.format("vellum_items").option("service", name)`` lists what a registered service has.  Services that need a
network aren't here; a folder of files is one that needs none.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ITEMS = "service string, source_id string, name string, kind string, modified timestamp, size long, content binary"


class Service(Protocol):
    category: str
    name: str

    def pages(self, options: dict) -> list:
        """Tokens of a listing's pages, windows or accounts; each is read by its own task."""

    def read(self, page, options: dict) -> Iterator[tuple]:
        """(source_id, name, kind, modified, content) of a page's items."""


class Folder:
    """Files of ``path``, by subfolder; a hidden or linked one isn't read."""

    category, name = "Files", "folder"

    def pages(self, options: dict) -> list:
        root = options["path"].removeprefix("file://")
        return [root, *sorted(e.path for e in os.scandir(root) if e.is_dir(follow_symlinks=False) and not e.name.startswith("."))]

    def read(self, page, options: dict) -> Iterator[tuple]:
        for e in sorted(os.scandir(page), key=lambda e: e.name):
            if e.is_file(follow_symlinks=False) and not e.name.startswith("."):
                with open(e.path, "rb") as f:
                    yield e.path, e.name, "file", datetime.fromtimestamp(e.stat().st_mtime, UTC), f.read()


SERVICES: dict[str, Service] = {}


def register(service: Service) -> None:
    SERVICES[service.name] = service


register(Folder())


def listed_services() -> list[tuple[str, str]]:
    return sorted((s.category, s.name) for s in SERVICES.values())


@dataclass
class _Page(InputPartition):
    token: object


class _Reader(DataSourceReader):
    def __init__(self, service: Service, options: dict):
        self.service, self.options = service, options

    def partitions(self):
        return [_Page(p) for p in self.service.pages(self.options)]

    def read(self, partition):
        for source_id, name, kind, modified, content in self.service.read(partition.token, self.options):
            yield self.service.name, source_id, name, kind, modified, len(content or b""), content


class ItemSource(DataSource):
    @classmethod
    def name(cls):
        return "vellum_items"

    def schema(self):
        return ITEMS

    def reader(self, schema):
        return _Reader(SERVICES[self.options["service"]], dict(self.options))
