import random

import numpy as np

from emoloom.llm import overlap as O


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return row[-1]


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(0, 30))] for _ in "ab")
        assert O.longest_common(a, b) == lcs(a, b)


def test_prefixes_miss_no_near_pair():
    rng = random.Random(4)
    counts = np.zeros(1 << O.SLOTS[0], np.float32)
    for _ in range(3000):
        n = rng.randrange(10, 60)
        vocabulary = rng.choice([4, 12, 1000])
        a = [rng.randrange(vocabulary) for _ in range(n)]
        b = list(a)
        for _ in range(rng.randrange(0, n // 8 + 1)):
            k = rng.randrange(len(b))
            how = rng.randrange(3)
            if how == 0:
                b[k] = 5000 + rng.randrange(9)
            elif how == 1:
                b.insert(k, 5000 + rng.randrange(9))
            elif len(b) > 4:
                del b[k]
        longest = max(len(a), len(b))
        if O.longest_common(a, b) * 10 < 9 * longest:
            continue
        sides = []
        for s in (a, b):
            own, at = O.grams(np.array(s, np.int64), counts)
            sides.append(list(zip(own.tolist(), at.tolist())))
        assert any(g == h and abs(p - q) * 10 <= longest for g, p in sides[0] for h, q in sides[1])


def test_overlaps_against_brute_force(spark):
    from emoloom.llm.dedup import Keys
    from emoloom.llm.lookalike import is_case

    rng = random.Random(9)
    words = [f"w{k}" for k in range(40)]
    train = [(f"T{k}", " ".join(rng.choice(words) for _ in range(rng.randrange(4, 40)))) for k in range(120)]
    evals = []
    for k in range(60):
        w = rng.choice(train)[1].split()
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [rng.choice(words)] * rng.randrange(2)
        evals.append((k, " ".join(w) + rng.choice(["", "!", " ?"])))
    evals += [(900, None), (901, ""), (902, "a b c"), (903, "?? !! ,, .."), (904, train[0][1].upper())]
    train += [("N", None), ("E", "  "), ("S", "a b c"), ("P", "!! .. ?? ,,"), ("L", "long word " * 3000)]
    key = Keys()

    def seq(t):
        return [x for x in (key.strip("", w) for w in key.canonical.text(t).lower().split()) if x]

    want = set()
    for i, t in evals:
        for j, u in train:
            if is_case(t) and is_case(u):
                a, b = seq(t), seq(u)
                if key.key(t) == key.key(u) or (a and lcs(a, b) * 10 >= 9 * max(len(a), len(b))):
                    want.add((i, j))
    e = spark.createDataFrame(evals, "internal_id long, text string").selectExpr("*", "1 as id", "2 as gram")
    t = spark.createDataFrame(train, "sample_id string, text string").selectExpr("*", "'x' as words")
    got = O.overlaps(e, t).collect()
    assert {(r.internal_id, r.sample_id) for r in got} == want and len(got) == len(want)
    assert O.overlaps(e.limit(0), t).collect() == [] and O.overlaps(e, t.limit(0)).collect() == []
