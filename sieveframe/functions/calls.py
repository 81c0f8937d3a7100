"""Calls of outside services from the driver: several attempts, and deadlines for jobs."""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import SparkSession


class Transient(Exception):
    """An error worth another attempt."""


def with_retry(f: Callable, attempts: int = 3, wait: float = 0.5, most: float = 8.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """UDF1: f, called again after a Transient error, with growing, jittered pauses; the last error is raised, others at once."""

    def call(*args, **options):
        for k in range(attempts):
            try:
                return f(*args, **options)
            except Transient:
                if k == attempts - 1:
                    raise
                sleep(min(most, wait * 2**k) * (0.5 + random.random() / 2))

    return call


@contextmanager
def deadline(spark: SparkSession, seconds: float):
    """ST05: Spark jobs started inside are cancelled when the time is over, and the block raises TimeoutError."""
    tag = f"deadline-{uuid4().hex}"
    over = threading.Event()

    def stop() -> None:
        over.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    spark.sparkContext.addJobTag(tag)
    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        yield
    except Exception as e:
        if over.is_set():
            raise TimeoutError(f"over {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)


class LossyEvents:
    """ST02: a bounded queue of events for onlookers; what doesn't fit, or comes after closing, is dropped."""

    def __init__(self, size: int = 256):
        self.size, self.closed, self.events = size, False, []
        self.lock = threading.Lock()

    def emit(self, event: dict) -> bool:
        with self.lock:
            if self.closed or len(self.events) >= self.size:
                return False
            self.events.append(event)
            return True

    def drain(self) -> list[dict]:
        with self.lock:
            out, self.events = self.events, []
            return out

    def close(self) -> None:
        self.closed = True
