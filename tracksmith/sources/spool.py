"""A streaming source of messages that a broker's bridge spools: `spark.readStream.format("spool")`.

A broker such as MQTT's keeps no place in its stream for a reader, so a bridge writes what it gets to files of JSON
lines, {"topic", "payload", "at"}, in a folder that driver and executors share; a file is written aside and then
renamed to a name ending in .jsonl, and names grow (a time or a count with leading zeros). Offsets are file names:
a batch is the files after one name up to another, so a batch that is read again after a failure has the same files,
and files go only when Spark has committed the batch after theirs. Lines that are no JSON come with a null topic and
the line as payload, to be counted as rejects.

Options: path; topics, a comma-separated list of filters with + and #; files (of a batch, 1000); keep (true: files
that are committed stay).
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from urllib.parse import urlparse

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "topic string, payload string, at string"
#: The file that remembers the last committed one.
MARK = ".committed"


def topic_pattern(filters: str) -> re.Pattern[str]:
    """Topics that one of the filters takes: + is one level, # all that follow, with the level above."""
    one = [re.escape(f.strip()).replace(r"\+", "[^/]*").replace(r"/\#", "(/.*)?").replace(r"\#", ".*") for f in filters.split(",")]
    return re.compile("|".join(f"(?:{f})" for f in one))


class Files(InputPartition):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class SpoolReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        place = urlparse(options["path"])
        if place.scheme not in ("", "file"):
            raise ValueError(f"a spool is a folder that all machines mount, not {options['path']}")
        self.folder, self.most = place.path, int(options.get("files", "1000"))
        self.keep, self.topics = options.get("keep", "false").lower() == "true", options.get("topics", "#")
        self.told: str | None = None  # where the last batch that this reader planned ends

    def names(self) -> list[str]:
        return sorted(n for n in os.listdir(self.folder) if n.endswith(".jsonl"))

    def initialOffset(self) -> dict:  # noqa: N802
        self.told = ""
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        if self.told is None:  # a restarted query, whose place is not told here: all there is, so that it never goes back
            self.told = max([self.committed(), *self.names()])
        else:
            new = [n for n in self.names() if n > self.told][: self.most]
            self.told = new[-1] if new else self.told
        return {"after": self.told}

    def committed(self) -> str:
        """Up to where files have been committed and may be gone."""
        try:
            with open(f"{self.folder}/{MARK}", encoding="utf-8") as mark:
                return mark.read()
        except FileNotFoundError:
            return ""

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.told = max(self.told or "", end["after"])  # after a restart the first batch is one that was planned before
        names = [n for n in self.names() if start["after"] < n <= end["after"]]
        return [Files(names[i::8]) for i in range(min(8, len(names)))]

    def read(self, partition: Files) -> Iterator[tuple]:
        taken = topic_pattern(self.topics)
        for name in partition.names:
            with open(f"{self.folder}/{name}", encoding="utf-8", errors="replace") as lines:
                for line in lines:
                    try:
                        m = json.loads(line)
                        topic, payload, at = m["topic"], m["payload"], m.get("at")
                    except (ValueError, KeyError, TypeError, AttributeError):
                        yield None, line.rstrip("\n"), None
                        continue
                    if taken.fullmatch(topic):
                        yield topic, payload if isinstance(payload, str) else json.dumps(payload), at

    def commit(self, end: dict) -> None:
        with open(f"{self.folder}/{MARK}.new", "w", encoding="utf-8") as mark:
            mark.write(end["after"])
        os.replace(f"{self.folder}/{MARK}.new", f"{self.folder}/{MARK}")
        for name in [] if self.keep else [n for n in self.names() if n <= end["after"]]:
            os.remove(f"{self.folder}/{name}")


class Spool(DataSource):
    @classmethod
    def name(cls) -> str:
        return "spool"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802
        return SpoolReader({k.lower(): v for k, v in self.options.items()})


def spool_stream(spark: SparkSession, path: str, topics: str = "#", files: int = 1000, keep: bool = False):  # noqa: ANN201
    """A stream of the spool's messages."""
    spark.dataSource.register(Spool)
    return spark.readStream.format("spool").options(path=path, topics=topics, files=str(files), keep=str(keep).lower()).load()
