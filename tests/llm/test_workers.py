"""Steps over batches give memory back when their task ends."""

from collections.abc import Iterator

import pytest

from taqlspark.llm import workers


@pytest.fixture
def released(monkeypatch):
    calls = []
    monkeypatch.setattr(workers, "release", lambda: calls.append(1))
    return calls


@workers.tidy
def halves(batches: Iterator[int]) -> Iterator[float]:
    """Halves."""
    for b in batches:
        yield 2 / b


def test_batches_pass_and_memory_goes_at_the_end(released):
    found = halves(iter([1, 2]))
    assert next(found) == 2 and not released
    assert list(found) == [1] and released == [1]
    assert list(halves(iter([]))) == [] and released == [1, 1]


def test_memory_goes_when_a_task_fails_or_stops_early(released):
    with pytest.raises(ZeroDivisionError):
        list(halves(iter([0])))
    found = halves(iter([1, 2]))
    next(found)
    found.close()
    assert released == [1, 1]


def test_name_and_hints_stay():
    assert (halves.__name__, halves.__doc__) == ("halves", "Halves.")
    assert halves.__annotations__["return"] == Iterator[float]


def test_release_runs():
    workers.release()
