import threading

import pytest

from terraframe.operators.viewport import ByteCache, Latest, Superseded, ViewportReader


def test_least_recent_goes_first():
    c = ByteCache(8)
    c.set("a", 1, 4)
    c.set("b", 2, 4)
    assert c.get("a") == 1
    c.set("c", 3, 4)
    assert "b" not in c and c.get("a") == 1 and c.get("c") == 3


def test_oversize_is_not_stored_and_drops_the_old_value():
    c = ByteCache(8)
    c.set("a", 1, 4)
    c.set("a", 2, 9)
    assert "a" not in c and c.size == 0
    with pytest.raises(ValueError):
        ByteCache(0)


def test_a_new_request_supersedes():
    latest, started, go, out = Latest(), threading.Event(), threading.Event(), []

    def slow(current):
        started.set()
        go.wait(5)
        return 1

    def first():
        try:
            out.append(latest.run(slow))
        except Superseded:
            out.append("superseded")

    t = threading.Thread(target=first)
    t.start()
    started.wait(5)
    assert latest.run(lambda current: 2) == 2
    go.set()
    t.join()
    assert out == ["superseded"]


def test_the_cache_serves_the_second_read():
    r = ViewportReader(lambda *a: b"1234", ByteCache(100))
    assert r.read_latest("p", "raster", (0, 0, 1, 1), 1, 1) == r.read_latest("p", "raster", (0, 0, 1, 1), 1, 1)
    assert r.reads == 1


def test_a_new_request_cancels_the_jobs_of_the_old_one(spark):
    import time

    latest, out = Latest(spark), []

    def slow(current):
        return spark.range(0, 8, 1, 8).selectExpr("java_method('java.lang.Thread', 'sleep', CAST(id * 0 + 20000 AS BIGINT)) AS s").collect()

    def first():
        try:
            out.append(latest.run(slow))
        except Superseded:
            out.append("superseded")

    t = threading.Thread(target=first)
    t.start()
    time.sleep(3)
    began = time.monotonic()
    assert latest.run(lambda current: "new") == "new"
    t.join(15)
    assert out == ["superseded"] and time.monotonic() - began < 15


def test_readers_are_told_when_they_are_superseded():
    seen = []

    def read(path, layer, window, w, h, wanted):
        seen.append(wanted())
        reader.latest.cancel()
        seen.append(wanted())
        return b"x"

    reader = ViewportReader(read, ByteCache(100))
    with pytest.raises(Superseded):
        reader.read_latest("p", "raster", (0, 0, 1, 1), 1, 1)
    assert seen == [True, False] and not reader.cache.size


@pytest.mark.parametrize("spans", [1, 3, 1024])
def test_residency_in_spans_equals_a_replay(spark, monkeypatch, spans):
    import random

    from terraframe.operators import viewport

    monkeypatch.setattr(viewport, "SPANS", spans)
    rnd, sizes = random.Random(3), {}
    log = [(k, n, sizes.setdefault(k, rnd.randrange(1, 30))) for n, k in enumerate(rnd.choices(range(40), k=300))]
    cache = ByteCache(100)
    for k, _, size in log:
        if cache.get(k) is None:
            cache.set(k, k, size)
    got = {r.key for r in viewport.lru_residency(spark.createDataFrame(log, "key long, seq long, bytes long"), 100).collect()}
    used, want = 0, set()
    for k in sorted(sizes, key=lambda k: -max(n for x, n, _ in log if x == k)):
        if sizes[k] <= 100 and (used := used + sizes[k]) <= 100:
            want.add(k)
    assert got == want
    assert viewport.lru_residency(spark.createDataFrame([], "key long, seq long, bytes long"), 5).collect() == []
