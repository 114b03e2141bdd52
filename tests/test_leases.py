"""Exclusive creation, leases and fences."""

import threading
import time

import pytest

from tarn.sources.pointers import ConcurrentChange, Files, Generations
from tarn.sources.requests import LeaseLost, RequestRunning, Requests


def race(n, work):
    """Results of n threads that start together."""
    gate, out = threading.Barrier(n), [None] * n

    def one(i):
        gate.wait()
        out[i] = work(i)

    threads = [threading.Thread(target=one, args=(i,)) for i in range(n)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    return out


def test_one_of_four_creates_a_file(spark, tmp_path):
    files = [Files(spark) for _ in range(4)]
    for trial in range(200):
        path = f"{tmp_path}/race/{trial}"
        won = race(4, lambda i: files[i].create(path, f"text {i}" * 50))
        assert won.count(True) == 1
        assert files[0].read(path) == f"text {won.index(True)}" * 50
    assert len(files[0].names(f"{tmp_path}/race")) == 200  # nothing else is left


def test_one_of_four_writers_follows_a_generation(spark, tmp_path):
    for trial in range(20):
        store = Generations(spark, f"{tmp_path}/{trial}")
        first = store.new()[0]
        store.publish(first, {})
        names = [store.new()[0] for _ in range(4)]

        def publish(i):
            try:
                Generations(spark, f"{tmp_path}/{trial}").publish(names[i], {}, after=first)
            except ConcurrentChange:
                return False
            return True

        won = race(4, publish)
        assert won.count(True) == 1 and store.current() == names[won.index(True)]


def test_a_writer_whose_number_came_and_went_is_told(spark, tmp_path):
    store = Generations(spark, str(tmp_path))
    store.KEPT = 2
    first, late = store.new()[0], store.new()[0]
    store.publish(first, {})

    def others():
        for _ in range(4):
            Generations.publish(store, store.new()[0], {})

    with pytest.raises(ConcurrentChange):
        store.publish(late, {}, after=first, guard=others)
    assert store.current() != late


def test_a_dead_owner_is_passed_by_and_fenced(spark, tmp_path):
    requests = Requests(spark, str(tmp_path), lease_seconds=0.3)
    dead = requests.take("k", "h")
    with pytest.raises(RequestRunning):
        requests.take("k", "h")
    requests.renew(dead)
    time.sleep(0.4)
    takers = [Requests(spark, str(tmp_path), lease_seconds=30) for _ in range(4)]

    def take(i):
        try:
            return takers[i].take("k", "h")
        except RequestRunning:
            return None

    got = [lease for lease in race(4, take) if lease]
    assert len(got) == 1 and got[0].number > dead.number
    for late in (lambda: requests.renew(dead), lambda: requests.finish(dead, "completed", {"n": 1})):
        with pytest.raises(LeaseLost):
            late()
    requests.finish(got[0], "completed", {"n": 2})
    assert requests.take("k", "h") == {"n": 2}


def test_long_work_keeps_its_lease_and_late_work_publishes_nothing(spark, tmp_path):
    requests, other = (Requests(spark, str(tmp_path), lease_seconds=0.6) for _ in range(2))

    def slow():
        time.sleep(1.2)
        with pytest.raises(RequestRunning):
            other.once("k", {}, dict)
        return {"n": 1}

    assert requests.once("k", {}, slow) == {"n": 1} == other.once("k", {}, dict)
    published = []

    def overtaken(guard):
        requests._end("late", 1, "expired")  # as a caller that saw no sign of life does
        guard()
        published.append(1)

    with pytest.raises(LeaseLost):
        requests.once("late", {}, overtaken, fenced=True)
    assert not published and other.once("late", {}, lambda: {"n": 3}) == {"n": 3}
