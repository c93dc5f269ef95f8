"""The mix of sources: nothing dropped by default, and order at exact weights."""

from snapcase.llm.mixing import mix_schedule, mixed


def test_hot_source_stays_whole_by_default(spark):
    sizes = {"hot": 500, None: 9} | {f"s{i}": 50 for i in range(20)}
    table = spark.createDataFrame(
        [(i, s, "x") for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))],
        "doc_id long, source string, text string")
    slots = {r.doc_id: (r.slot, r.rank) for r in mix_schedule(table).collect()}
    out = [r.doc_id for r in mixed(table).collect()]
    assert sorted(out) == list(range(sum(sizes.values())))
    assert out == sorted(out, key=slots.get)


def test_prefixes_stay_within_a_block_of_exact_weights(spark):
    # Many periods of 16 slots; the weight of "tiny" is far below one slot of a period.
    weights = {"a": 0.7, "b": 0.2991, "tiny": 0.0009}
    sizes = {"a": 4200, "b": 1800, "tiny": 7}
    table = spark.createDataFrame(
        [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))],
        "doc_id long, source string")
    target = spark.createDataFrame(list(weights.items()), "source string, weight double")
    found = mix_schedule(table, weights=target, block_docs=1, period=16).collect()
    order = {r.slot: r.source for r in found if r.in_mix}
    assert sorted(order) == list(range(len(order))) and len(order) > 5900
    assert all((r.slot is not None) == r.in_mix for r in found)
    assert all(r.release <= r.slot < r.deadline for r in found if r.in_mix)
    end = min(sizes[s] / w for s, w in weights.items())
    done = dict.fromkeys(weights, 0)
    for t in range(int(end)):
        done[order[t]] += 1
        assert all(abs(done[s] - w * (t + 1)) < 1 + 1e-6 for s, w in weights.items())
