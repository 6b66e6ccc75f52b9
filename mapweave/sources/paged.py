"""spark.read.format("mapping_pages"): mappings from numbered page documents, a partition for each file or page (up to 2,000).

Options: ``path``, a folder that all workers can open, whose files hold a page each, or several one after another (an
empty file holds none); or ``url``, an address with {page} in it (from 1 on) whose first page says how many there are
(pagination.total_pages); ``query`` says whether search fields may be sent along with the url. Conditions of equality on
the search fields and on the uuid are taken over from Spark: they are added to the address, and each page's rows are
held against them before they leave the reader. A page that can't be read, or that is no page document, fails the job
and says which.
"""

from __future__ import annotations

import gzip
import json
import os
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from mapweave.schema import MAPPING

#: Fields whose conditions of equality the reader takes.
PUSHED = ("uuid", "subject_id", "subject_id_curie", "predicate_id", "predicate_id_curie", "object_id", "object_id_curie", "mapping_provider")
FORMAT = "mapping_pages"
#: Files or pages beyond so many share partitions.
MOST_PARTITIONS = 2_000


@dataclass
class Page(InputPartition):
    addresses: list[str]
    fields: dict[str, list[str]]


def load(address: str) -> bytes:
    """What lies at an address or in a file."""
    try:
        if "://" in address:
            with urllib.request.urlopen(address) as answer:  # noqa: S310
                return answer.read()
        with open(address, "rb") as f:
            text = f.read()
        return gzip.decompress(text) if address.endswith(".gz") else text
    except urllib.error.HTTPError as e:
        raise OSError(f"Failure loading {address} with status {e.code}") from e
    except OSError as e:
        raise OSError(f"Failure loading {address}: {e}") from e


def fetch(address: str) -> Iterator[dict]:
    """The page documents at an address (one at least) or in a file (none in an empty one, as Spark writes for an empty partition)."""
    raw, at, read = load(address), 0, json.JSONDecoder().raw_decode
    try:
        text = raw.decode(json.detect_encoding(raw)).strip()
        while at < len(text) or not text and "://" in address:
            page, at = read(text, at)
            if not isinstance(page["data"], list):
                raise TypeError("data is no list")
            yield page
            while text[at : at + 1].isspace():
                at += 1
    except (ValueError, KeyError, TypeError) as e:
        raise OSError(f"Failure loading {address}: no page document ({e})") from e


class PageReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema, self.fields = options, schema, {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                values = [f.value] if isinstance(f, EqualTo) else list(f.value)
                known = self.fields.get(f.attribute[0])
                self.fields[f.attribute[0]] = values if known is None else [v for v in known if v in values]
            else:
                yield f

    def partitions(self) -> list[Page]:
        if path := self.options.get("path"):
            folder = urllib.parse.unquote(urllib.parse.urlsplit(path).path) if path.startswith("file:") else path
            if "://" in folder:
                raise ValueError(f"{path} is no folder that a worker can open; give an url")
            files = sorted(os.path.join(d, n) for d, _, names in os.walk(folder) for n in names if not n.startswith((".", "_")))
            return self._dealt(files)
        url = self.options["url"]
        sent = "".join(f"&{k}={urllib.parse.quote(v)}" for k, values in self.fields.items() for v in values) if self.options.get("query", "false") == "true" else ""
        at = lambda n: url.replace("{page}", str(n)) + sent
        return self._dealt([at(n) for n in range(1, int(next(fetch(at(1)))["pagination"]["total_pages"]) + 1)])

    def _dealt(self, addresses: list[str]) -> list[Page]:
        """A partition for each address, for several where there are more than MOST_PARTITIONS."""
        several = -(-len(addresses) // MOST_PARTITIONS) or 1
        return [Page(addresses[i : i + several], self.fields) for i in range(0, len(addresses), several)]

    def read(self, partition: Page | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without pages
            return
        schema = to_arrow_schema(self.schema)
        for page in (p for address in partition.addresses for p in fetch(address)):
            rows = [r for r in page["data"] if all(r.get(k) in values for k, values in partition.fields.items())]
            if rows:
                yield pa.RecordBatch.from_pylist([{f: r.get(f) for f in schema.names} for r in rows], schema)


class MappingPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return StructType([f for f in MAPPING if f.name != "mapping_set_id"] + [MAPPING["mapping_set_id"]])

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let Spark hand it conditions."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MappingPages)
