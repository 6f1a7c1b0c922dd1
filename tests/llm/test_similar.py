"""Near-duplicates by exact similarity against brute force over all pairs."""

import itertools

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import similar


def plain_set(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def first_of_groups(rows):
    """The (id, text) rows that stay, by all pairs."""
    sets, parent = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, j in itertools.combinations(range(len(rows)), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    out = {}
    for i, row in enumerate(rows):
        out[find(i)] = min(out.get(find(i), row), row)
    return set(out.values())


@pytest.fixture(scope="module")
def near():
    """Texts with copies of one to four changed words in 100: similarities from 0.6 to 0.95."""
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(5000)}"
    rows = []
    for _ in range(60):
        words = [word() for _ in range(100)]
        rows.append(" ".join(words))
        for changed in (1, 1, 2, 4):
            copy = list(words)
            for at in rng.choice(100, changed, replace=False):
                copy[at] = word()
            rows.append(" ".join(copy))
    return list(enumerate(rows))


def test_stage_links_all_near_copies(spark, near):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in near], "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "").collect()}
    assert got == first_of_groups(near)
    assert len(got) < 150


def test_keys_meet_at_the_least_similarity():
    rng = np.random.default_rng(4)
    for per_key, tables in (similar.tables_for(1000), similar.tables_for(1 << 40)):
        bits = per_key * tables * similar.WIDTH
        pairs = []
        for _ in range(1000):
            x = np.unique(rng.integers(0, 1 << 64, 99, dtype=np.uint64))
            pairs += [x, np.concatenate([x[:88], rng.integers(0, 1 << 64, 11, dtype=np.uint64)])]  # 88 of 110
        votes = np.stack([similar.weights(x, bits) for x in pairs])
        keys = similar.keys_of(votes, per_key, tables)
        assert sum(bool(set(a) & set(b)) for a, b in zip(keys[::2].tolist(), keys[1::2].tolist(), strict=True)) >= 975
        for n in (64, 64 * similar.LANES_KEPT):
            apart = (votes[::2, :n] > 0) != (votes[1::2, :n] > 0)
            assert (apart.sum(axis=1) > similar.most_bits(n)).sum() <= 3


def test_weights_count_bits():
    hashes = np.random.default_rng(8).integers(0, 1 << 64, 5000, dtype=np.uint64)
    salted = similar._mixed(hashes ^ similar._mixed(np.arange(1, 4, dtype=np.uint64))[2])
    ones = [int((salted >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)]
    assert similar.weights(hashes, 192)[128:].tolist() == [2 * x - 5000 for x in ones]


def test_codewords_are_the_nearest():
    votes = np.random.default_rng(9).standard_normal((50, 23))
    code = np.concatenate([similar._half_of_the_code().T, -similar._half_of_the_code().T])
    assert len({tuple(c) for c in code.tolist()}) == 4096
    assert min((code[1:] != code[0]).sum(axis=1)) == 7
    best = np.sort(code @ votes.T, axis=0)[-2:][::-1].T
    for row, found, want in zip(votes, similar.codewords(votes).tolist(), best.tolist(), strict=True):
        assert np.allclose([(-1) ** (i % 2) * similar._half_of_the_code()[:, i // 2] @ row for i in found], want)


def test_differing_texts_of_one_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, a + " z"), (4, c), (5, ""), (6, " ")]
    got = sorted((r.doc_id, r.text) for r in similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, a), (2, b), (4, c), (5, "")])
