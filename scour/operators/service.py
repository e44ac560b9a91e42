"""Calls of a remote service from inside an iterator UDF.

A remote embedder or model answers slowly, and mostly by waiting. ``ServiceCalls``
keeps a bounded number of requests on their way per task, sends several inputs in
one request where the service takes lists, repeats failed requests with growing
pauses, and gives the results in the order of the inputs.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice


@dataclass(frozen=True)
class ServiceCalls:
    """How a task calls its service.

    ``workers``: requests on their way at once (a client used by several threads has
    to allow it); ``batch``: inputs per request, where above 1 the client takes and
    returns lists; ``attempts``: tries of a request that fails with an error of a
    retryable class; ``pause``: seconds before the second try, doubled for each
    further one up to ``longest`` and spread by up to half, so that tasks don't
    return together."""
    workers: int = 1
    batch: int = 1
    attempts: int = 1
    pause: float = 0.2
    longest: float = 30.0

    def __post_init__(self):
        if min(self.workers, self.batch, self.attempts) < 1:
            raise ValueError("workers, batch and attempts are at least 1")

    def _tried(self, call: Callable, retryable: tuple):
        """(result, error) of one request and its repeats."""
        for attempt in range(1, self.attempts + 1):
            try:
                return call(), None
            except retryable as e:
                error = e
            if attempt < self.attempts:
                time.sleep(min(self.longest, self.pause * 2 ** (attempt - 1)) * random.uniform(0.5, 1.0))
        return None, error

    def _request(self, call: Callable, inputs: list, retryable: tuple) -> list:
        """[(result, error)] of the inputs of one request. A list that fails as a whole
        is sent one by one: an input that the service refuses fails no neighbour."""
        def listed(part: list) -> list:
            out = list(call(part))
            if len(out) != len(part):
                raise ValueError(f"{len(out)} results for {len(part)} inputs")
            return out

        if self.batch == 1:
            return [self._tried(lambda: call(inputs[0]), retryable)]
        out, error = self._tried(lambda: listed(inputs), retryable)
        if error is None:
            return [(x, None) for x in out]
        if len(inputs) == 1:
            return [(None, error)]
        return [self._tried(lambda x=x: listed([x])[0], retryable) for x in inputs]

    def map(self, call: Callable, inputs: Iterator, retryable: tuple = (Exception,)) -> Iterator[tuple]:
        """(result, error) per input, in order. At most twice ``workers`` requests are
        read ahead, so a long input is never held as a whole; an error that is not
        retryable is raised."""
        inputs = iter(inputs)
        parts = iter(lambda: list(islice(inputs, self.batch)), [])
        if self.workers == 1:
            for part in parts:
                yield from self._request(call, part, retryable)
            return
        with ThreadPoolExecutor(self.workers) as pool:
            ahead: list[Future] = []
            try:
                for part in parts:
                    ahead.append(pool.submit(self._request, call, part, retryable))
                    if len(ahead) >= 2 * self.workers:
                        yield from ahead.pop(0).result()
                while ahead:
                    yield from ahead.pop(0).result()
            finally:
                for f in ahead:
                    f.cancel()


ONE_BY_ONE = ServiceCalls()
