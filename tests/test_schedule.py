import random

import pytest

from tidevec.operators.oplog import BUILD, BUILD_ASYNC, BUILD_WAIT, INSERT, PAUSE, RESUME, SEARCH, run_lengths
from tidevec.plans import schedule
from tidevec.workload import generators
from tidevec.workload.arrivals import Arrivals, Stream

COSTS = schedule.Costs(block=2)


def log(spark, kinds, deadlines=None):
    rows = [(i + 1, t, float(i), (deadlines or {}).get(i + 1, 1.0)) for i, t in enumerate(kinds)]
    return spark.createDataFrame(rows, "seq long, op_type string, arrival_time double, deadline double")


def by_rule(kinds, policy, costs=COSTS, deadlines=None):
    """The policies one operation at a time: [(seq or None, type)]."""
    ops = [(i + 1, t) for i, t in enumerate(kinds)]
    if policy == "NP" or BUILD not in kinds and policy != "SP-NP":
        return ops
    if policy == "SP-NP":
        out, held = [], None
        for op in ops:
            if op[1] == BUILD:
                held = op
            elif op[1] == SEARCH and held:
                out.append(op)
            else:
                out += ([held] if held else []) + [op]
                held = None
        return out + ([held] if held else [])
    at = kinds.index(BUILD)
    later = [op for op in ops[at + 1 :] if op[1] in (INSERT, SEARCH)]
    if policy == "SP-P":
        inside, after = [op for op in later if op[1] == SEARCH], [op for op in later if op[1] == INSERT]
    else:
        ts = (kinds[:at].count(INSERT) // costs.block // 3) * costs.unindexed
        inside, after, n_ins, n_adm = [], [], 0, 0
        for op in later:
            if op[1] == INSERT:
                inside.append(op)
                n_ins += 1
                continue
            left = costs.build * (1 + costs.margin) - costs.build * costs.built_before - costs.checkpoint - costs.resume - n_ins * costs.insert - (costs.resume + costs.checkpoint)
            most = max(int(left / ts), 0) if ts > 0 else 0
            if costs.checkpoint + ts + costs.resume <= (deadlines or {}).get(op[0], 1.0) and n_adm < most:
                inside.append(op)
                n_adm += 1
            else:
                after.append(op)
    return ops[:at] + [(None, BUILD_ASYNC)] + ([(None, PAUSE), *inside, (None, RESUME)] if inside else []) + after + [(None, BUILD_WAIT)]


def got(df):
    return [(r.seq, r.op_type) for r in df.orderBy("position").collect()]


CASES = [
    [INSERT, SEARCH, INSERT],
    [BUILD],
    [INSERT, INSERT, BUILD],
    [SEARCH, BUILD, SEARCH],
    [INSERT, BUILD, SEARCH, SEARCH, INSERT, SEARCH],
    [INSERT, BUILD, SEARCH, BUILD, SEARCH, INSERT],
    [INSERT] * 13 + [BUILD] + [SEARCH, INSERT] * 5,
]


@pytest.mark.parametrize("policy", list(schedule.POLICIES))
def test_policies_equal_the_rules(spark, policy):
    rng = random.Random(policy)
    for kinds in [*CASES, [rng.choice([INSERT, INSERT, SEARCH]) for _ in range(30)] + [BUILD] + [rng.choice([INSERT, SEARCH]) for _ in range(30)]]:
        assert got(schedule.schedule(log(spark, kinds), policy, COSTS)) == by_rule(kinds, policy)


def test_tight_bound_and_deadlines(spark):
    kinds = [INSERT] * 12 + [BUILD] + [SEARCH, SEARCH, INSERT, SEARCH, SEARCH]
    tight = schedule.Costs(block=2, build=0.15, unindexed=0.005, insert=0.004)
    assert got(schedule.slo_p(log(spark, kinds), tight)) == by_rule(kinds, "SLO-P", tight)
    short = {15: 0.01}
    assert got(schedule.slo_p(log(spark, kinds, short), COSTS)) == by_rule(kinds, "SLO-P", COSTS, short)


def test_unknown_policy(spark):
    with pytest.raises(ValueError):
        schedule.schedule(log(spark, [INSERT]), "FIFO")


def test_run_lengths(spark):
    rows = run_lengths(log(spark, [INSERT, INSERT, SEARCH, INSERT])).collect()
    assert sorted((r.start_seq, r.op_type, r.length) for r in rows) == [(1, INSERT, 2), (3, SEARCH, 1), (4, INSERT, 1)]


def test_workload_counts_and_order():
    for name, params in generators.SCENARIOS.items():
        ops = generators.generate(name)
        kinds, times = [o[2] for o in ops], [o[1] for o in ops]
        assert times == sorted(times) and [o[0] for o in ops] == list(range(1, len(ops) + 1))
        assert len(ops) == params["req"] + (name == "c")
        assert kinds.count(BUILD) == (name in "ace")
        keys = [int(o[3]) for o in ops if o[2] == INSERT]
        assert keys == list(range(1, len(keys) + 1))
    assert [o[2] for o in generators.generate("a")][-1] == BUILD
    assert [o[2] for o in generators.generate("c")].index(BUILD) == 50


def test_workloads_are_reproducible_and_checked():
    assert generators.generate("e") == generators.generate("e") and generators.generate("d", seed=1) != generators.generate("d", seed=2)
    with pytest.raises(ValueError):
        generators.generate("a", {"req": 1, "distribution": "normal"})
    with pytest.raises(ValueError):
        generators.generate("z")
    with pytest.raises(ValueError):
        Arrivals(1).single(Stream(1, "cauchy", {}))
    cursor = generators.generate("d", query_source="corpus_cursor")
    assert all(o[5] is None and o[4] is not None for o in cursor if o[2] == SEARCH)


@pytest.mark.parametrize("distribution", ["zipf", "normal", "uniform", "lognormal", "poisson"])
def test_arrivals_rise(distribution):
    times = Arrivals(7).single(Stream(50, distribution, {}))
    assert all(b > a for a, b in zip(times, times[1:], strict=False))
