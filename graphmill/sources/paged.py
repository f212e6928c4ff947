"""Pages of JSON at a web address (or below file://) as a Spark data source, one partition for each run of pages.

    paged.register(spark)
    spark.read.format("paged_json").option("url", "https://host/nets?offset={offset}&size={size}").option("pages", 50).load()

Options: url (with {page}, {offset}, {size}), pages, size (rows a page, 100), records (the key of the list in a page;
a page that is a list itself needs none), per_task (pages a partition, 1), timeout (seconds, 60), body (a JSON text that
is posted). Rows: page, place, id (the record's id, uuid, externalId or name), json. An empty page gives no row; a page that
cannot be read fails its task, which Spark tries again.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

IDS = ("id", "uuid", "externalId", "graphId", "name")


class Pages(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[Pages]:
        pages, step = int(self.options.get("pages", 1)), max(1, int(self.options.get("per_task", 1)))
        return [Pages(i, min(pages, i + step)) for i in range(0, pages, step)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        o = self.options
        size = int(o.get("size", 100))
        for page in range(partition.first, partition.last):
            url = o["url"].replace("{page}", str(page)).replace("{offset}", str(page * size)).replace("{size}", str(size))
            data = o["body"].encode() if "body" in o else None
            request = urllib.request.Request(url, data, {"Content-Type": "application/json"} if data else {})
            with urllib.request.urlopen(request, timeout=float(o.get("timeout", 60))) as r:
                doc = json.loads(r.read())
            found = doc if isinstance(doc, list) else doc.get(o.get("records", "records"), [])
            if isinstance(found, dict):
                found = [{"name": k, **(v if isinstance(v, dict) else {"value": v})} for k, v in found.items()]
            for i, rec in enumerate(found):
                key = next((str(rec[k]) for k in IDS if isinstance(rec, dict) and rec.get(k) is not None), None)
                yield page, i, key, json.dumps(rec, sort_keys=True)


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, place int, id string, json string"

    def reader(self, schema: object) -> Reader:
        return Reader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedJson)


def first_of_each(records: DataFrame, most: int | None = 200) -> DataFrame:
    """Records with an id, each id once (its first page and place), the first so many in that order, or all."""
    once = records.filter("id IS NOT NULL").withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("page", "place"))).filter("r = 1").drop("r")
    return once if most is None else once.orderBy("page", "place").limit(most)
