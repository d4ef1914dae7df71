from collections import Counter

from emoloom.llm import mixing as M


def test_shares_and_repeats(spark):
    rows = [(k, "big", 100 + k % 50) for k in range(6000)] + [(10_000 + k, "small", 50 + k % 30) for k in range(300)] + [(20_000, None, 5), (20_001, "other", 5), (20_002, "big", 0)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.9, 1), ("small", 0.1, 4), ("absent", 0.3, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = [tuple(r) for r in M.mix(sized, targets).collect()]
    again = [tuple(r) for r in M.mix(sized.repartition(7), targets).collect()]
    assert sorted(mixed) == sorted(again)
    copies = Counter((d, s) for d, s, _, _ in mixed)
    assert all(n <= {"big": 1, "small": 4}[s] for (_, s), n in copies.items()) and {s for _, s in copies} == {"big", "small"}
    total = Counter()
    for _, s, n, _ in mixed:
        total[s] += n
    assert abs(total["big"] / sum(total.values()) - 0.9) < 0.005
    assert len(set(mixed)) == len(mixed)  # copies are numbered
    shown = {r.source: r for r in M.shares(M.mix(sized, targets), targets).collect()}
    assert shown["absent"].tokens is None and abs(shown["small"].actual_share - 0.1) < 0.005


def test_sizes_and_empty(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "hello there", "a")], "doc_id long, text string, source string")
    sized = M.sizes(docs)
    assert [r.tokens > 0 for r in sized.orderBy("doc_id").collect()] == [False, False, True]
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    assert [r.copy for r in M.mix(sized, targets).orderBy("copy").collect()] == [1, 2]
    assert M.mix(sized.limit(0), targets).collect() == []
