"""Readers of layouts, reports and vocabularies; the index as Parquet tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYOUT = {
    "page_text": "source_file string, page int, raw_text string",
    "blocks": "source_file string, page int, block_no int, x0 double, y0 double, x1 double, y1 double, text string",
    "page_tables": "source_file string, page int, table_no int, x0 double, y0 double, x1 double, y1 double, markdown string",
    "page_images": "source_file string, page int, figure_index int, width int, height int, n_bytes long, ext string, bytes binary",
}
#: Tables of an index and the columns whose files they are ordered by.
INDEX = {"hype": {"chunks": "index", "vectors": "row_id", "postings": "token"}, "graph": {"triples": "row_id", "edges": "head", "vectors": "row_id", "postings": "token"}}


def read_layout(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four layout tables of a folder."""
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in LAYOUT.items()}


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw): one row for each text file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw) of JSON reports; a missing path is an error."""
    return read_whole(spark, path)


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """(ord, name) of an ordered JSON array."""
    return read_whole(spark, path).select(F.posexplode(F.from_json("raw", "array<string>")).alias("ord", "name"))


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """(ord, phrase, canonical) of a JSON object phrase -> canonical in the order of the document."""
    entries = F.map_entries(F.from_json("raw", "map<string,string>"))
    return read_whole(spark, path).select(F.posexplode(entries).alias("ord", "e")).select("ord", F.col("e.key").alias("phrase"), F.col("e.value").alias("canonical"))


class _Versions:
    """The versions of an index: numbered manifests, each naming the folders of every table.

    A manifest is put in place, whole, after all that it names; so a reader, during a
    write or after a broken one, sees the version before it.
    """

    def __init__(self, spark: SparkSession, folder: str, kind: str) -> None:
        self.spark, self.root = spark, f"{folder}/{kind}"
        self.store = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def last(self) -> tuple[int, dict[str, list[str]]]:
        """The number of the last version and its tables' folders; (0, {}) where there is none."""
        found = self.store.globStatus(self._path(f"{self.root}/manifest-*.json")) or []
        names = sorted(f.getPath().getName() for f in found)
        if not names:
            return 0, {}
        raw = read_whole(self.spark, f"{self.root}/{names[-1]}").first().raw
        return int(names[-1][len("manifest-") : -len(".json")]), json.loads(raw)

    def put(self, number: int, tables: dict[str, list[str]]) -> bool:
        """Puts a version in place; False where another writer took its number."""
        part = self._path(f"{self.root}/.manifest-{uuid.uuid4().hex}")
        out = self.store.create(part, False)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        name = self._path(f"{self.root}/manifest-{number:09d}.json")
        if not self.store.exists(name) and self.store.rename(part, name):
            return True
        self.store.delete(part, False)
        return False


def write_index(tables: dict[str, DataFrame], folder: str, kind: str, add: bool = False) -> None:
    """Writes an index (hype: chunks, vectors, postings; graph: triples, edges, vectors, postings) as its next version.

    The new version takes the old one's place, or with ``add`` has its tables as
    further parts. A graph without triples is not written.
    """
    if kind == "graph" and tables["triples"].isEmpty():
        return
    spark = next(iter(tables.values())).sparkSession
    versions, part = _Versions(spark, folder, kind), uuid.uuid4().hex[:12]
    made = {}
    for name, order in INDEX[kind].items():
        if name in tables:
            made[name] = f"{part}/{name}"
            tables[name].repartitionByRange(order).sortWithinPartitions(order).write.parquet(f"{versions.root}/{made[name]}")
    while True:
        number, before = versions.last()
        if versions.put(number + 1, {n: [*(before.get(n, []) if add else []), path] for n, path in made.items()} | ({n: p for n, p in before.items() if n not in made} if add else {})):
            return


def read_index(spark: SparkSession, folder: str, kind: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables of an index's last version, those of ``names`` or all that it has; no index is an error."""
    versions = _Versions(spark, folder, kind)
    number, parts = versions.last()
    if not number:
        raise FileNotFoundError(f"no {kind} index in {folder}")
    return {name: spark.read.parquet(*[f"{versions.root}/{p}" for p in parts[name]]) for name in names or parts}
