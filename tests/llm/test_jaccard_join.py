import random

import pytest

from disarm.llm.components import components
from disarm.llm.jaccard_join import jaccard_components
from tests.llm.test_shingles import plain_sets


def plain(rows):
    sets = [plain_sets(t, 5) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(find(i), []).append(d)
    smallest = {k: min((d for d in v if d is not None), default=None) for k, v in low.items()}
    return sorted(((d, len(s), smallest[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def corpus(rng):
    word = lambda: "w" + str(rng.randint(0, 3000))
    common = " ".join(word() for _ in range(12))
    rows, base = [], [word() for _ in range(60)]
    for _ in range(60):  # a group of near copies that all share most shingles with the first
        text = list(base)
        if rng.random() < 0.8:
            text[rng.randint(0, 59)] = word()
        rows.append(" ".join(text))
    chain = [word() for _ in range(60)]
    for _ in range(8):  # each one links with the next, not with all
        rows.append(" ".join(chain))
        chain = chain[2:] + [word(), word()]
    rows += [f"{common} {' '.join(word() for _ in range(rng.randint(0, 6)))}" for _ in range(40)]
    rows += [" ".join(word() for _ in range(rng.randint(1, 80))) for _ in range(60)]
    rows += rows[:7] + ["", None, "a", "A", "a b c", "A  b\tC", "exact copy of five words", "exact copy of five words"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_those_of_all_pairs(spark, seed):
    rows = corpus(random.Random(seed))
    docs = spark.createDataFrame([(d, t, "x", True) for d, t in rows], "doc_id long, text string, row string, kept boolean").repartition(5)
    got = jaccard_components(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == plain(rows)
    assert sum(r.kept for r in got) == len({r.component_id for r in got})
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_missing_and_repeated_ids(spark):
    rows = [(None, "one two three four five six"), (3, "one two three four five six"), (3, "one two three four five six"), (4, None), (4, None), (None, "alone")]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(
        [(None, 2, 3), (3, 2, 3), (3, 2, 3), (4, 0, 4), (4, 0, 4), (None, 1, None)], key=repr)
    assert sorted((r.component_id is not None and r.component_id, r.kept) for r in got if r.doc_id == 3) == [(3, False), (3, True)]


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_chains_hubs_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 199), (199, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 199: 199, 200: 199}
