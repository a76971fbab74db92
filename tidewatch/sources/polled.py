"""A stream of feeds that are polled over HTTP: ``spark.readStream.format("polled_feed").option("feeds", ...).option("spool", ...)``.

A feed says only what it holds now, so it can't be read twice. Each poll is therefore spooled: what it found goes to a file of its own in a folder that driver and
executors share, put in place by a rename, before its number becomes an offset. Batches read the spool by number, so a batch that runs again
reads the same rows, and a restart goes on at the number in the checkpoint. A poll's rows are the lines that the feed's last poll didn't have.

Hosts are asked at most once in ``host_delay`` seconds and feeds once in ``every``; a failed feed is asked again after ``delay`` seconds
times the failures so far, and after ``retries`` of them a row tells its error. This state is in the spool too.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .feed import AGENT

SCHEMA = "feed string, poll bigint, line int, url string, error string, polled_at timestamp"


class Poll(InputPartition):
    def __init__(self, number: int):
        self.number = number


class Spool:
    """Numbered polls, and what is known of each feed."""

    def __init__(self, folder: str):
        from .sample_sink import opened

        self.system, self.base = opened(folder)

    def _put(self, name: str, value) -> None:
        self.system.create_dir(self.base, recursive=True)
        part = f"{self.base}/.{name}.{uuid.uuid4().hex}"
        with self.system.open_output_stream(part) as f:
            f.write(json.dumps(value).encode())
        self.system.move(part, f"{self.base}/{name}")

    def get(self, name: str):
        with self.system.open_input_stream(f"{self.base}/{name}") as f:
            return json.loads(f.read())

    def _numbers(self) -> list[int]:
        from pyarrow import fs

        found = self.system.get_file_info(fs.FileSelector(self.base, allow_not_found=True))
        return sorted(int(x.base_name.removesuffix(".json")) for x in found if x.base_name[:1].isdigit())

    def poll(self, number: int) -> dict:
        return self.get(f"{number:012d}.json")

    def state(self) -> dict:
        """{feed: {last, asked, failures}} and the next number, with what a poll said that was spooled just before a kill."""
        from pyarrow import fs

        has = self.system.get_file_info(f"{self.base}/state.json").type != fs.FileType.NotFound
        state = self.get("state.json") if has else {"next": 0, "feeds": {}}
        for n in (n for n in self._numbers() if n >= state["next"]):
            told = self.poll(n)
            state["feeds"][told["feed"]] = {"last": n, "asked": told["at"], "failures": 0}
            state["next"] = n + 1
        return state

    def add(self, state: dict, feed: str, told: dict) -> None:
        self._put(f"{state['next']:012d}.json", told | {"feed": feed})
        state["feeds"][feed] = {"last": state["next"], "asked": told["at"], "failures": 0}
        state["next"] += 1

    def keep(self, state: dict) -> None:
        self._put("state.json", state)

    def forget(self, before: int, state: dict) -> None:
        """Polls that no batch asks for any more go, but for each feed's last one."""
        needed = {f["last"] for f in state["feeds"].values()}
        for n in self._numbers():
            if n < before and n not in needed:
                self.system.delete_file(f"{self.base}/{n:012d}.json")


class FeedStream(DataSourceStreamReader):
    def __init__(self, options):
        self.feeds = [f for f in options.get("feeds", "").split() if f]
        self.folder = options["spool"]
        number = lambda k, d: float(options.get(k, d))
        self.every, self.host_delay, self.delay, self.timeout = number("every", 60), number("host_delay", 1), number("delay", 1), number("timeout", 8)
        self.retries = int(options.get("retries", 2))

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        spool = Spool(self.folder)
        state = spool.state()
        changed = False
        for feed in self.feeds:
            known = state["feeds"].get(feed, {"last": None, "asked": 0, "failures": 0})
            wait = self.delay * known["failures"] if known["failures"] else self.every
            host = urlsplit(feed).netloc
            asked = max((f["asked"] for k, f in state["feeds"].items() if urlsplit(k).netloc == host), default=0)
            now = time.time()
            if now < known["asked"] + wait or now < asked + self.host_delay:
                continue
            changed = True
            try:
                lines, error = self.ask(feed), None
            except Exception as e:  # any failure is data
                lines, error = None, str(e)
            if error and known["failures"] < self.retries:
                state["feeds"][feed] = known | {"asked": now, "failures": known["failures"] + 1}
                continue
            before = spool.poll(known["last"])["lines"] if known["last"] is not None else []
            have = set(before)
            new = [] if error else [x for x in dict.fromkeys(lines) if x not in have]
            if error or new:
                spool.add(state, feed, {"lines": before if error else lines, "new": new, "error": error, "at": now})
            else:
                state["feeds"][feed] = known | {"asked": now, "failures": 0}
        if changed:
            spool.keep(state)
        return {"next": state["next"]}

    def ask(self, feed: str) -> list[str]:
        from urllib.request import Request, urlopen

        with urlopen(Request(feed, headers={"User-Agent": AGENT, "Accept": "text/plain,text/csv,*/*"}), timeout=self.timeout) as r:
            text = r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
        lines = (x.strip() for x in text.removeprefix("﻿").splitlines())
        return [x for x in lines if x and not x.startswith("#")]

    def partitions(self, start: dict, end: dict) -> list[Poll]:
        return [Poll(n) for n in range(start["next"], end["next"])]

    def read(self, partition: Poll) -> Iterator[tuple]:
        told = Spool(self.folder).poll(partition.number)
        at = datetime.fromtimestamp(told["at"], UTC)
        if told["error"]:
            yield told["feed"], partition.number, None, None, told["error"], at
        for i, url in enumerate(told["new"]):
            yield told["feed"], partition.number, i, url, None, at

    def commit(self, end: dict) -> None:
        spool = Spool(self.folder)
        spool.forget(end["next"], spool.state())


class PolledFeeds(DataSource):
    """SRC1, SRC2 as a stream: (feed, poll, line, url, error, polled_at)."""

    @classmethod
    def name(cls) -> str:
        return "polled_feed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedStream(self.options)


def register(spark) -> None:
    spark.dataSource.register(PolledFeeds)
