"""Service calls: order, bounded concurrency, request batches, retry with pauses."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from scour.operators.answer import map_model
from scour.operators.embed import udf_embedder
from scour.operators.service import ServiceCalls


def test_order_concurrency_and_wall_time():
    now, most, lock = 0, 0, threading.Lock()

    def slow(x):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
        time.sleep(0.02 if x % 3 else 0.05)               # later inputs overtake
        with lock:
            now -= 1
        return x * x

    t0 = time.perf_counter()
    out = list(ServiceCalls(workers=8).map(slow, range(64)))
    assert out == [(x * x, None) for x in range(64)] and 1 < most <= 8
    assert time.perf_counter() - t0 < 64 * 0.02


def test_long_inputs_are_not_read_ahead():
    read = 0

    def inputs():
        nonlocal read
        for read in range(1000):  # noqa: B007
            yield read

    got = ServiceCalls(workers=4, batch=2).map(lambda xs: xs, inputs())
    assert next(got) == (0, None) and read < 4 * 2 * 2 + 2
    assert [x for x, _ in got] == list(range(1, 1000))


@pytest.mark.parametrize("workers,batch", [(1, 1), (3, 1), (1, 4), (3, 4)])
def test_retry_and_refusals(workers, batch):
    tries: dict = {}
    lock = threading.Lock()

    def one(x):
        with lock:
            tries[x] = tries.get(x, 0) + 1
        if x == 5:
            raise ValueError("refused")
        if x % 4 == 2 and tries[x] < 3:
            raise TimeoutError("busy")
        return -x

    call = one if batch == 1 else lambda xs: [one(x) for x in xs]
    calls = ServiceCalls(workers, batch, attempts=4, pause=0.001)
    out = list(calls.map(call, range(11), (ValueError, TimeoutError)))
    assert [x for x, _ in out] == [None if x == 5 else -x for x in range(11)]
    assert [str(e) for _, e in out if e] == ["refused"]
    assert list(calls.map(call, [])) == []


def test_other_errors_are_raised():
    def broken(x):
        raise KeyError(x)

    for workers in (1, 3):
        with pytest.raises(KeyError):
            list(ServiceCalls(workers).map(broken, range(9), (ValueError,)))
    short = ServiceCalls(batch=3).map(lambda xs: xs[:1], range(3))
    assert list(short) == [(0, None), (1, None), (2, None)]      # one by one after a short reply
    with pytest.raises(ValueError):
        ServiceCalls(workers=0)


def client(fail):
    def factory():
        tries: dict = {}

        def call(texts):
            out = []
            for t in texts:
                tries[t] = tries.get(t, 0) + 1
                if t == "bad" or (fail and tries[t] == 1):
                    raise ConnectionError(t)
                out.append([float(len(t)), 1.0])
            return out
        return call
    return factory


def test_embedder_with_calls(spark):
    rows = [(i, "x" * i) for i in range(1, 30)] + [(0, "bad")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(2)
    calls = ServiceCalls(workers=4, batch=3, attempts=4, pause=0.001)
    out = udf_embedder(client(True), 2, (ConnectionError,), calls)(df, "text").collect()
    assert {r["id"]: r["embedding"] and list(r["embedding"]) for r in out} == {
        0: None, **{i: [float(i), 1.0] for i in range(1, 30)}}
    assert [r["error"] for r in out if r["id"] == 0] == ["ConnectionError: bad"]


def test_model_with_calls(spark):
    def factory():
        def call(prompt, system, temperature):
            if prompt == "p3":
                raise TimeoutError("slow")
            return {"answer": prompt}
        return call

    df = spark.range(6).select("id", F.concat(F.lit("p"), "id").alias("prompt"))
    out = map_model(df, factory, calls=ServiceCalls(workers=3, batch=9, attempts=2, pause=0.001)).collect()
    assert {r["id"]: r["response"] for r in out} == {
        i: None if i == 3 else f'{{"answer": "p{i}"}}' for i in range(6)}
    assert [r["model_error"] for r in out if r["id"] == 3] == ["slow"]
