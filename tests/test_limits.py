import pytest
from pyspark.sql import functions as F

from notewarp.functions import limits as L
from notewarp.operators import embed as E
from notewarp.settings import Settings


def states(spark, hits, s=Settings()):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hits)], "arrival int, hit boolean")
    return [(r["batch"], r["failures"], r["successes"]) for r in L.adapt(df, s).orderBy("arrival").collect()]


def by_limiter(hits, s=Settings()):
    lim, out = E.Limiter(s), []
    for h in hits:
        lim.limited() if h else lim.succeeded()
        out.append((lim.batch, lim.failures, lim.successes))
    return out


@pytest.mark.parametrize("hits", [[True] * 5, [True, *[False] * 5], [False] * 6, [True, False, True, *[False] * 7], []])
def test_batch_ladder(spark, hits):
    assert states(spark, hits) == by_limiter(hits)


def test_ladder_values(spark):
    assert [b for b, _, _ in by_limiter([True] * 5)] == [50, 25, 12, 10, 10]
    assert by_limiter([True, *[False] * 5])[-1] == (100, 0, 0)
    assert by_limiter([True, False])[-1] == (50, 1, 1)
    assert states(spark, [True, *[False] * 9], Settings(recovery=0))[-1][0] == 50


def test_pace(spark):
    calls = spark.createDataFrame([(0.0, 1), (0.0, 5), (10.0, 1), (10.0, 1)], "arrival double, n int")
    got = [r["emit"] for r in L.pace(calls, 600, order=("arrival", "n")).orderBy("emit").collect()]
    assert got == pytest.approx([0.1, 0.6, 10.0, 10.1])
    slept, now = [], [100.0]
    lim = E.Limiter(Settings(rpm=600), clock=lambda: now[0], sleep=lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    lim.wait(10)
    lim.wait(10)
    assert slept == pytest.approx([1.0]) and lim.last == pytest.approx(101.0)


@pytest.mark.parametrize("headers, want", [({"Retry-After": "120"}, 120.0), ({"x-RETRY-AFTER-s": "1.5"}, 1.5), ({}, None), ({"Retry-After": ""}, None), ({"Retry-After": "junk"}, None), ({"Retry-After": "0"}, 0.0), ({"Retry-After": "Wed, 21 Oct 2015 07:28:00 GMT"}, 30.0), ({"a-retry-after": "x", "b-retry-after": "7"}, 7.0)])
def test_retry_after(spark, headers, want):
    assert E.retry_after(headers, now=1445412450) == want
    pairs = [F.lit(x) for kv in headers.items() for x in kv]
    column = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    assert spark.range(1).select(L.retry_after(column, F.lit(1445412450)).alias("v")).first()["v"] == want


def test_past_date_is_zero(spark):
    assert E.retry_after({"Retry-After": "Wed, 21 Oct 2015 07:28:00 GMT"}, now=2e9) == 0.0


@pytest.mark.parametrize("message, want", [("429 too many", True), ("RESOURCE_EXHAUSTED", True), ("500", False), ("", False)])
def test_retryable(spark, message, want):
    assert E.retryable(message) == want
    assert spark.range(1).select(L.retryable(F.lit(message)).alias("v")).first()["v"] == want


@pytest.mark.parametrize("attempt, least, low, high", [(0, 30.0, 24, 36), (0, 0.0, 4, 6), (10, 0.0, 96, 144)])
def test_backoff(spark, attempt, least, low, high):
    assert all(low <= E.Limiter().delay(attempt, least) <= high for _ in range(50))
    got = spark.range(50).select(L.backoff(F.lit(attempt), F.lit(least)).alias("v")).collect()
    assert all(low <= r["v"] <= high for r in got)


def test_headers_and_errors(spark):
    headers = {"Retry-After": "1", "X-RateLimit-Limit": "2", "x-goog-quota": "3", "Content-Type": "t", "Server": "s"}
    assert len(E.limit_headers(headers)) == 3
    column = F.create_map(*[F.lit(x) for kv in headers.items() for x in kv])
    assert len(spark.range(1).select(L.limit_headers(column).alias("v")).first()["v"]) == 3
    assert spark.range(1).select(F.length(L.short_error(F.repeat(F.lit("x"), F.lit(999)))).alias("v")).first()["v"] == 300


def test_calls_are_tried_again():
    log, tries = [], []

    def fn():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("429")
        return [1]

    lim = E.Limiter(Settings(), sleep=lambda s: None)
    assert lim.call(fn, "text", 5, 7, log.append) == [1]
    assert [(x["success"], x["retry_count"], x["http_status"]) for x in log] == [(False, 1, 429), (False, 2, 429), (True, 2, 200)]
    assert lim.batch == 25

    def never():
        raise RuntimeError("429")

    with pytest.raises(RuntimeError):
        lim.call(never, "text", 1, 1)
    with pytest.raises(ValueError):
        lim.call(lambda: (_ for _ in ()).throw(ValueError("no")), "text", 1, 1)


def test_settings(tmp_path):
    file = tmp_path / ".env"
    file.write_text("# c\nNOTEWARP_BATCH='50'\nbad line\nNOTEWARP_RPS=2\nNOTEWARP_VAULT=\"/x\"\nNOTEWARP_DIM=\n")
    s = Settings.read({"NOTEWARP_BATCH": "7"}, str(file))
    assert (s.batch, s.rpm, s.vault, s.dim) == (7, 120.0, "/x", 1536)
    assert Settings.read({}).rpm == 120.0
