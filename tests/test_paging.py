"""The listing as a stream: where it ends, what it retries, and what a restart fetches."""

import os

import pytest

from gradelake.sources import paging

DDL = "id bigint, name string"


def book(path):
    """A listing that notes the pages asked for in a file, since the source runs in a process of its own."""

    def fetch(total, told=None, fail=()):
        def own(page, size):
            with open(path, "a") as f:
                f.write(f"{page}\n")
            if page in fail and open(path).read().split().count(str(page)) == 1:
                raise paging.Refused(429)
            first = (page - 1) * size
            return [(i, f"card {i}") for i in range(first, min(total, first + size))], total if told is None else told

        return own

    return fetch


def asked(path):
    return [int(x) for x in open(path).read().split()] if os.path.exists(path) else []


def no_wait(seconds):
    pass


def read_all(spark, rows, tmp_path):
    query = paging.saved(rows, str(tmp_path / "out"), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    return sorted(r.id for r in spark.read.schema(DDL).json(str(tmp_path / "out")).collect())


@pytest.mark.parametrize(("options", "most", "pages", "rows"), [({"total": 23}, 99, [1, 2, 3], 23), ({"total": 20}, 99, [1, 2], 20), ({"total": 50}, 2, [1, 2], 20), ({"total": 15, "told": 10**6}, 99, [1, 2, 3], 15), ({"total": 0}, 99, [1], 0), ({"total": 12, "fail": (2,)}, 99, [1, 2, 2], 12)])
def test_ends(spark, tmp_path, options, most, pages, rows):
    """At the total, in the middle or at the end of a page; at the cap; at an empty page, whatever was told; and after a refusal."""
    calls = str(tmp_path / "calls")
    listing = paging.listing(spark, book(calls)(**options), DDL, 10, most, no_wait)
    assert read_all(spark, listing, tmp_path) == list(range(rows))
    assert asked(calls) == pages


def test_restart(spark, tmp_path):
    """What was written before a failure is not fetched again."""
    calls = str(tmp_path / "calls")
    good = book(calls)(30)

    def broken(page, size):
        rows = good(page, size)
        if page == 3:
            raise ConnectionError("gone")
        return rows

    query = paging.saved(paging.listing(spark, broken, DDL, 10, wait=no_wait), str(tmp_path / "out"), str(tmp_path / "state"))
    with pytest.raises(Exception, match="gone"):
        query.awaitTermination(120)
        query.processAllAvailable()
    assert asked(calls) == [1, 2, 3, 3, 3, 3]
    assert read_all(spark, paging.listing(spark, good, DDL, 10, wait=no_wait), tmp_path) == list(range(30))
    assert asked(calls) == [1, 2, 3, 3, 3, 3, 3]
    record = paging.described(spark, str(tmp_path / "out"), "listing", 1.5, DDL).first()
    assert (record["count"], record.source, record.fields, record.took_ms) == (30, "listing", ["id", "name"], 1500)


def test_retries():
    waits = []

    def never(page, size):
        raise paging.Refused(429 if len(waits) % 2 == 0 else 500)

    with pytest.raises(paging.Refused):
        paging.fetched(never, 1, 10, waits.append)
    assert waits == [5, 4, 15]
