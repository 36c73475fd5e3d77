import random

import pytest

from stemma.operators import resolve

SCHEMA = "seq long, primary_id long, secondary_id long"


def loop(decisions, xrefs):
    """One decision after the other."""
    there, out = dict(xrefs), []
    for seq, first, second in sorted(decisions):
        if first == second:
            out.append((first, second, resolve.MERGE_SELF))
        elif first not in there or second not in there:
            out.append((first, second, resolve.MERGE_MISSING))
        elif (there[first] or "").upper() == (there[second] or "").upper():
            out.append((first, second, resolve.MERGE_SAME_XREF))
        else:
            out.append((first, second, None))
            del there[second]
    return out, there


def outcome(spark, decisions, xrefs):
    persons = spark.createDataFrame(sorted(xrefs.items()), "person_id long, xref string")
    checked = resolve.check_merges(spark.createDataFrame(decisions, SCHEMA), persons)
    left = resolve.apply_merges(persons, checked)
    return sorted((tuple(r) for r in checked.collect()), key=repr), {r.person_id: r.xref for r in left.collect()}


def same(spark, decisions, xrefs):
    want, there = loop(decisions, xrefs)
    got, left = outcome(spark, decisions, xrefs)
    assert got == sorted(want, key=repr) and left == there


def test_a_cycle_keeps_the_first_primary(spark):
    same(spark, [(1, 1, 2), (2, 2, 1)], {1: "I1", 2: "I2"})


@pytest.mark.parametrize("step", [1, -1])
def test_a_chain_of_a_thousand(spark, step):
    xrefs = {i: f"I{i}" for i in range(1002)}
    same(spark, [(step * i, i, i + 1) for i in range(1000)], xrefs)


def test_random_decisions_equal_the_loop(spark):
    r = random.Random(4)
    people = 150
    xrefs = {i: r.choice([f"I{i}", f"i{i}", "I1", None]) for i in range(people)}
    decisions = [(k, r.randrange(people + 5), r.randrange(people + 5)) for k in range(600)]
    # A person named in a third of all decisions, now as primary, now as secondary.
    decisions += [(600 + k, *((7, r.randrange(people)) if k % 9 else (r.randrange(people), 7))) for k in range(300)]
    r.shuffle(decisions)
    decisions = [(k, a, b) for k, (_, a, b) in enumerate(decisions)]
    same(spark, decisions, xrefs)


def test_no_decisions_and_repeated_ones(spark):
    same(spark, [], {1: "I1"})
    same(spark, [(1, 1, 2), (1, 1, 2), (5, 3, 3)], {1: "I1", 2: "I2", 3: "I3"})
