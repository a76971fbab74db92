"""Streams that keep state: killed in the middle and run again they give the rows of one run."""

from __future__ import annotations

import random

import pytest
from test_operators import CANDIDATE, SHAPES, sequential

from tidewatch.streaming import admission


def feed(spark, path, rows, parts):
    """``rows`` as ``parts`` files, which the stream takes in the order of their times."""
    import os

    for k in range(parts):
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], CANDIDATE).coalesce(1).write.parquet(f"{path}/{k}")
        for f in os.listdir(f"{path}/{k}"):
            os.utime(f"{path}/{k}/{f}", (1_700_000_000 + 10 * k,) * 2)
    return spark.readStream.schema(CANDIDATE).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


@pytest.mark.parametrize("table", ["outcomes", "claims"])
def test_admission_that_is_killed_goes_on(spark, tmp_path, monkeypatch, table):
    rng = random.Random(table)
    rows = [(i, rng.randint(0, 1), *SHAPES["crowded" if i % 2 else "sparse"](rng, i), rng.choice([None] * 6 + ["http_status_404"]), None) for i in range(90)]
    quotas, to = {0: 9, 1: 60}, f"{tmp_path}/out"
    stream = feed(spark, f"{tmp_path}/in", rows, 3)
    put = admission._put

    def dies(df, to, name, batch):
        put(df, to, name, batch)
        if name == table and batch == 1:
            raise RuntimeError("killed")

    monkeypatch.setattr(admission, "_put", dies)
    with pytest.raises(Exception, match="killed"):
        admission.run(stream, to, f"{tmp_path}/check", quotas)
    monkeypatch.setattr(admission, "_put", put)
    admission.run(stream, to, f"{tmp_path}/check", quotas)
    got = sorted(tuple(r) for r in admission.outcomes(spark, to).select("ord", "label", "outcome").collect())
    assert got == sequential(rows, quotas)
    last = admission.progress(spark, to).orderBy("batch").collect()[-1]
    accepted = {y: sum(o == "accepted" and z == y for _, z, o in got) for y in quotas}
    assert last.batch == 2 and last.tried == len(got) and last.accepted == accepted and last.rejected == len(got) - sum(accepted.values())
    assert last.complete == all(accepted[y] >= n for y, n in quotas.items())


def test_polled_feeds_skip_nothing_and_repeat_nothing(spark, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from tidewatch.sources import polled
    from tidewatch.streaming import streams

    pages = {"/a": "# head\nhttps://one.test\n\nhttps://two.test\n", "/b": "https://two.test\n"}
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            body = pages.get(self.path)
            self.send_response(200 if body is not None else 503)
            self.end_headers()
            self.wfile.write((body or "").encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    polled.register(spark)
    options = {"feeds": f"{at}/a {at}/b {at}/c", "spool": f"{tmp_path}/spool", "every": "0", "host_delay": "0", "delay": "0", "retries": "1"}
    run = lambda: streams.run_once(spark.readStream.format("polled_feed").options(**options).load(), f"{tmp_path}/out", f"{tmp_path}/check")
    rows = lambda: sorted((r.feed[len(at) :], r.url, r.error is not None) for r in spark.read.schema(polled.SCHEMA).parquet(f"{tmp_path}/out").collect())
    try:
        run()
        first = [("/a", "https://one.test", False), ("/a", "https://two.test", False), ("/b", "https://two.test", False)]
        assert [x for x in rows() if not x[2]] == first
        pages["/a"] = "https://two.test\nhttps://three.test\n"
        run()
        got = [x for x in rows() if not x[2]]
        assert got == sorted([*first, ("/a", "https://three.test", False)]) and any(x[2] for x in rows())
        run()
        assert [x for x in rows() if not x[2]] == got
        # a batch that runs again reads the spool, whatever the feed says now
        spool = polled.Spool(f"{tmp_path}/spool")
        stream = polled.FeedStream(options)
        end = spool.state()["next"]
        pages["/a"] = "https://four.test"
        last = spool.state()["feeds"][f"{at}/a"]["last"]
        assert [r[3] for r in stream.read(polled.Poll(last))] == ["https://three.test"] and end > last
        # a poll that was spooled before a kill isn't polled again
        state = spool.state()
        spool.add(dict(state), f"{at}/a", {"lines": ["https://four.test"], "new": ["https://four.test"], "error": None, "at": 0})
        run()
        assert sum(x[1] == "https://four.test" for x in rows()) == 1
        # hosts and feeds aren't asked too often
        n = len(asked)
        assert polled.FeedStream(options | {"host_delay": "3600"}).latestOffset() == polled.FeedStream(options | {"every": "3600", "delay": "3600"}).latestOffset() and len(asked) == n
    finally:
        server.shutdown()


def test_retries_fall_due_and_end(spark, tmp_path):
    from datetime import datetime, timedelta

    from tidewatch.streaming import attempts, streams

    begin = datetime(2026, 1, 1)
    # (url, second, ok) of each batch: a succeeds at its second try, b is given up after two retries, c waits at the end; t lets time pass
    batches = [[("a", 0, False), ("b", 0, False)], [("t", 15, True)], [("t", 16, True)], [("a", 20, True), ("b", 21, False)], [("t", 50, True)], [("t", 51, True)], [("b", 60, False), ("c", 61, False)], [("t", 100, True)], [("t", 101, True)]]
    import os

    schema = "url string, ts timestamp, ok boolean, error string"
    for k, batch in enumerate(batches):
        spark.createDataFrame([(u, begin + timedelta(seconds=s), ok, None if ok else f"{u}{s}") for u, s, ok in batch], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        for f in os.listdir(f"{tmp_path}/in/{k}"):
            os.utime(f"{tmp_path}/in/{k}/{f}", (1_700_000_000 + 10 * k,) * 2)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, attempts.PROVIDER)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        for _ in range(2):  # the second run finds nothing new
            streams.run_once(attempts.decisions(stream, retries=2, delay=10), f"{tmp_path}/out", f"{tmp_path}/check")
    finally:
        spark.conf.set(key, before)
    got = sorted((r.url, r.attempts, r.action, int((r["at"] - begin).total_seconds()), r.error) for r in spark.read.schema(attempts.OUT).parquet(f"{tmp_path}/out").where("url <> 't'").collect())
    assert got == [("a", 1, "retry", 10, None), ("a", 2, "done", 20, None), ("b", 1, "retry", 10, None), ("b", 2, "retry", 41, None), ("b", 3, "give_up", 60, "b60"), ("c", 1, "retry", 71, None)]
