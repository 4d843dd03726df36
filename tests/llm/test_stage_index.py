"""The pipeline's near-duplicates: candidates by op 3's index, the rest in blocks, against all pairs."""

import numpy as np


def near_copies(rng, groups=6, copies=25, words=120):
    texts = []
    for _ in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 10**6, words)]
        for _ in range(copies):
            own = list(base)
            for at in rng.integers(0, words, int(rng.integers(1, 7))):
                own[at] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(own))
    return texts


def grams(t):
    w = t.split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def all_pairs(texts):
    sets, lab = [grams(t) for t in texts], list(range(len(texts)))
    find = lambda x: x if lab[x] == x else find(lab[x])
    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]) - 1e-9:
                lab[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(find(i), []).append(i)
    return sorted(groups.values())


def found(spark, texts):
    from lumenframe.llm import jaccard_dedup

    groups = {}
    for r in jaccard_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect():
        groups.setdefault(r["group"], []).append(r["id"])
    return sorted(sorted(g) for g in groups.values())


def test_stage_probes_the_index_of_op3(spark, monkeypatch):
    """The stage's candidates come from op 3's index first: its edges connect what fingerprints at 4 bits or fewer connect."""
    from lumenframe.llm import jaccard_dedup, near_dedup

    seen = []

    def links(fps, distance):
        out = near_dedup.near_links(fps, distance)
        seen.extend((r["a"], r["b"]) for r in out.collect())
        return out

    monkeypatch.setattr(jaccard_dedup, "near_links", links, raising=False)
    texts = near_copies(np.random.default_rng(1))
    assert found(spark, texts) == all_pairs(texts)
    prints = {int(near_dedup._fold([jaccard_dedup.shingles(t)])[0]) for t in texts}
    lab = {x: x for x in prints}
    find = lambda x: x if lab[x] == x else find(lab[x])
    for a in prints:
        for b in prints:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                lab[max(find(a), find(b))] = min(find(a), find(b))
    assert seen and all(find(a) == find(b) for a, b in seen)


def test_blocks_of_a_popular_shingle(spark, monkeypatch):
    """A token's nodes cut into many blocks, pairs compared a few at once: the links are the same."""
    from lumenframe.llm import jaccard_dedup

    monkeypatch.setattr(jaccard_dedup, "BLOCK", 7, raising=False)
    texts = [*near_copies(np.random.default_rng(2)), "one two", "", "a b c d e f"]
    want = all_pairs(texts)
    assert found(spark, texts) == want and any(1 < len(g) < 25 for g in want)


def test_parities_lose_no_pair():
    """Parities differ in no more cells than two sets' shingles, folded or not; few pairs of a group leave their block."""
    import pandas as pd

    from lumenframe.llm import jaccard_dedup as jd

    rng = np.random.default_rng(3)
    for size in (1, 2, 9, 70, 700, 9000):
        x = rng.integers(0, 2**63, size).astype(np.uint64)
        for share in (0.5, 0.8, 0.95, 1):
            y = np.unique(np.concatenate((x[: int(size * share)], rng.integers(0, 2**63, size - int(size * share)).astype(np.uint64))))
            p, q, apart = jd.parities(np.unique(x)), jd.parities(y), len(np.setxor1d(x, y))
            words = min(len(p), len(q)) // 8
            assert np.bitwise_count(jd.folded(p, words) ^ jd.folded(q, words)).sum() <= apart
            assert np.bitwise_count(jd.folded(p) ^ jd.folded(q)).sum() <= apart
    # 400 texts that share half of their shingles: 79800 pairs of a token, none of them at 0.8
    common = rng.integers(0, 2**63, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate((common, rng.integers(0, 2**63, 100).astype(np.uint64)))) for _ in range(400)]
    rows = pd.DataFrame({"token": 1, "sub": 0, "probe": 0, "n": 200, "node": range(400), "pos": 0, "root": range(400), "odd": [jd.folded(jd.parities(s)).tobytes() for s in sets]})
    assert sum(map(len, jd._met(iter([rows[:150], rows[150:]]), 0.8, False))) < 400
