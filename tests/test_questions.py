import pytest

from filigree.operators.chunking import split_recursive
from filigree.operators.evaluation import bootstrap_mt
from filigree.operators.ingest import may_follow
from filigree.operators.questions import calculate
from filigree.plans import questions as P


def test_calculator_values(spark):
    got = {r.id: r.value for r in P.safe_eval(spark, "").collect()}
    assert got == {1: pytest.approx(1030524880.775), 2: 3.14, 3: 36.0, 4: None, 5: None, 6: None, 7: 1.0, 8: -4.0}


@pytest.mark.parametrize("bad", ["a + 1", "(lambda: 1)()", "[].append(1)", "1 if 1 else 2", "'a' * 3", "1" * 401])
def test_calculator_refuses(bad):
    with pytest.raises((ValueError, SyntaxError, TypeError)):
        calculate(bad)


def test_recursive_split_keeps_separators_and_sizes():
    text = "第一句。" * 50 + "\n\n" + "word " * 200
    pieces = split_recursive(text, 100, 20)
    assert all(len(p) <= 100 for p in pieces) and pieces[0].startswith("第一句")
    assert split_recursive("short", 100, 20) == ["short"]


def test_bootstrap_replay_is_reproducible_and_holds_the_mean():
    values = [1.0, 0.0, 1.0, 1.0]
    assert bootstrap_mt(values) == bootstrap_mt(values)
    mean, lo, hi, n = bootstrap_mt(values)
    assert lo <= mean <= hi and n == 4
    assert bootstrap_mt([]) == (0.0, 0.0, 0.0, 0) and bootstrap_mt([0.5]) == (0.5, 0.5, 0.5, 1)


def test_states():
    assert may_follow("pending", "parsing") and may_follow("embedding", "ready") and may_follow("parsing", "failed")
    assert not may_follow("pending", "ready") and not may_follow("ready", "chunking")
