import numpy as np
import pytest
from driftbasket.llm import ngram_join, queries
from driftbasket.llm.common import words_of
from driftbasket.operators.components import components
from fixtures import EDGE_TEXTS, edge_docs, empty_docs


def shingles(text):
    w = words_of(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(x), find(i)) for i, x in sets}


def near_copies(seed=3):
    """Chains, groups of copies, a common passage and lone texts."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    passage, out = [word() for _ in range(40)], []
    for g in range(12):
        text = [word() for _ in range(int(rng.integers(5, 120)))] + (passage if g % 3 == 0 else [])
        for _ in range(int(rng.integers(1, 9))):
            out.append(" ".join(text))
            if rng.random() < 0.7:
                text = [*text]
                for _ in range(max(1, len(text) // 60)):
                    text[rng.integers(len(text))] = word()
    out += [" ".join(passage)] * 3 + [" ".join(passage[:38] + [word()])]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [3, 4])
def test_join_of_near_copies(spark, seed):
    docs = near_copies(seed)
    got = ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs)


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op4_ngram_jaccard(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs) and len(got) == len(docs)


def test_edges(spark):
    got = ngram_join.join(edge_docs(spark)).collect()
    want = brute(list(enumerate(EDGE_TEXTS)))
    assert len(got) == len(EDGE_TEXTS) + 3
    for r in got:
        assert (r.n_shingles, r.component_id) == ((1, None) if r.doc_id is None else want[r.doc_id])
    assert ngram_join.join(empty_docs(spark)).count() == 0


def test_ids_of_any_size_and_one_large_group(spark):
    """Near copies of one text link through many of them, not only through the least; ids take all 64 bits."""
    rng = np.random.default_rng(8)
    base = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(120)]
    docs = [(2**62, "one two three four five six"), (2**62 + 1, "one two three four five six"), (2**63 - 1, "ONE two three four five six"), (-3, "seven of them here again now"), (2**62 + 9, "seven of them here again now")]
    for k in range(700):
        text = [*base]
        for at in rng.integers(0, 120, 3):
            text[at] = rng.choice(["xx", "yy", "zz"])
        docs.append((k, " ".join(text)))
    want = brute(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want and got[2**63 - 1][1] == 2**62 and got[2**62 + 9][1] == -3


def test_trie_join_finds_what_pairs_do():
    rng = np.random.default_rng(6)
    for percent in (50, 75):
        sets = [np.unique(rng.integers(0, 60, 40)) for _ in range(80)]
        sizes, lost = np.array([len(s) for s in sets]), np.zeros(80, np.int64)
        trie = ngram_join.TrieJoin(sets, sizes, lost, percent, step=4)
        for k in sorted(range(80), key=lambda k: sets[k].tolist()):
            want = [i for i in range(80) if 100 * len(np.intersect1d(sets[i], sets[k])) >= percent * len(np.union1d(sets[i], sets[k]))]
            assert trie.partners(sets[k], int(sizes[k]), 0).tolist() == want


def test_walk_in_trie_order_counts_as_sets_do():
    rng = np.random.default_rng(5)
    for _ in range(30):
        fixed = np.unique(rng.integers(0, 300, 120)).astype(np.uint64)
        sets = sorted((np.unique(np.concatenate([rng.choice(fixed, 100), rng.integers(0, 400, int(rng.integers(1, 60)))])).astype(np.uint64) for _ in range(60)), key=lambda k: k.astype(">u8").tobytes())
        walk = ngram_join.TrieWalk(fixed, 75, step=8)
        for k in sets:
            both = len(np.intersect1d(fixed, k))
            assert walk.linked(k) == (100 * both >= 75 * (len(fixed) + len(k) - both))


def test_bounds():
    for n in range(1, 200):
        assert ngram_join.prefix_length(n, 75) == n - -(-75 * n // 100) + 1
    for a, b in ((10, 10), (7, 9), (100, 133)):
        i = ngram_join.least_overlap(a, b, 75)
        assert 100 * i >= 75 * (a + b - i) and 100 * (i - 1) < 75 * (a + b - i + 1)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (100, 102), (7, 7)] + [(200, 300 + i) for i in range(50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100 and all(got[300 + i] == 200 for i in range(50))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
