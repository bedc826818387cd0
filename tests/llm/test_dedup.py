import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from odd_rows import prose
from hypothesis import given, settings
from hypothesis import strategies as st

from georesolve.llm import exact_dedup, simhash


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("fan_in", [2, 8])
def test_groups_of_odd_rows(spark, odd, keep, fan_in):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = {}
    for i, t in rows:
        want.setdefault(lowered(t), []).append(i)
    pick = max if keep == "largest" else min
    merged = {r.sha: r for r in exact_dedup.merged_runs(exact_dedup.digests(odd), keep, fan_in, lane_entries=2).collect()}
    assert len(merged) == len(want)
    for t, ids in want.items():
        r = merged[hashlib.sha256(t.encode()).hexdigest()]
        known = [i for i in ids if i is not None]
        assert (r.group_size, r.keep_id) == (len(ids), pick(known) if known else None)
        assert r.rows_at_keep == ids.count(r.keep_id)
    got = exact_dedup.groups(odd, keep).collect()
    assert len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_one_row_of_each_text_stays(odd, empty):
    kept = exact_dedup.deduplicate(odd, "largest")
    assert kept.columns == odd.columns
    texts = [lowered(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({lowered(r.text) for r in odd.collect()})
    assert exact_dedup.deduplicate(empty).count() == exact_dedup.groups(empty).count() == 0


def plain_fingerprint(t, n, seed):
    w = re.findall("[^\x20\x09-\x0d]+", lowered(t))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64(s.encode(), seed=seed).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="aB c\t\né\x0b", max_size=60), st.integers(1, 5))
def test_fingerprint_matches_its_definition(text, n):
    assert simhash.fingerprint(text, n, 42) == plain_fingerprint(text, n, 42)


def brute_components(fps, ids, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    best = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            best[find(i)] = min(best.get(find(i), ids[i]), ids[i])
    return [best.get(find(i)) for i in range(len(fps))]


@pytest.mark.parametrize("radius,tile", [(4, 4096), (4, 7), (10, 50)])
def test_links_lose_nothing(spark, radius, tile):
    """Chains and balls of fingerprints, in one tile and cut into many."""
    rng, fps = random.Random(radius), {0, 2**64 - 1}
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(12):
            fps.add(f)
            for b in rng.sample(range(64), rng.randint(1, radius)):
                f ^= 1 << b
    fps = sorted(fps)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius, tile)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    got = [roots.get(f, f) for f in signed]
    want = brute_components(fps, list(range(len(fps))), radius)
    assert len({(g, w) for g, w in zip(got, want, strict=True)}) == len(set(got)) == len(set(want))


def test_near_duplicates_of_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    source = [(r.doc_id, r.text) for r in odd.collect()]
    want = brute_components([plain_fingerprint(t, 4, 42) for _, t in source], [i for i, _ in source], 4)
    assert sorted(((r.doc_id is None, r.doc_id or 0, str(r.component_id)) for r in rows)) == sorted((i is None, i or 0, str(c)) for (i, _), c in zip(source, want, strict=True))
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


def test_near_copies_leave_one(spark):
    base = prose(3, 400).split()
    docs = [(1, " ".join(base)), (2, " ".join([*base[:200], "changed", *base[201:]])), (3, prose(9, 400))]
    kept = simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string"), radius=10, shingle=5)
    assert {r.doc_id for r in kept.collect()} == {1, 3}


def test_every_pair_is_emitted_once(spark):
    rng, f, fps = random.Random(5), 0, set()
    for _ in range(150):
        fps.add(f)
        f ^= sum(1 << b for b in rng.sample(range(64), 3))
    fps = sorted(fps)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    for tile in (4096, 7):
        rows = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 14, tile, every=True).collect()
        got = [tuple(sorted((r.a % 2**64, r.b % 2**64))) for r in rows]
        assert len(got) == len(set(got))
        assert set(got) == {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 14}


def shingles(t):
    w = t.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_fingerprints_of_unlike_texts_stay(spark):
    """A chain of texts: neighbours' fingerprints are within 14 bits, but only some are 0.8 alike."""
    base = prose(5, 400).split()
    docs = [(1, " ".join(base))]
    for i in range(1, 9):
        base = [*base[: 40 * i], *prose(50 + i, 6 * i).split(), *base[40 * i + 6 * i :]]
        docs.append((i + 1, " ".join(base)))
    fps = [simhash.fingerprint(t, 5, 42) for _, t in docs]
    ratio = lambda a, b: len(a & b) / len(a | b)
    linked = {i for i in range(1, 9) for j in range(i) if ratio(shingles(docs[i][1]), shingles(docs[j][1])) >= 0.8}
    near = {i for i in range(1, 9) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 14}
    assert linked < near
    kept = simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string"), radius=14, shingle=5)
    assert {r.doc_id for r in kept.collect()} == {i + 1 for i in range(9)} - {i + 1 for i in linked}


def test_runs_merge_by_rank_even_if_first_words_agree():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 3, (40, 5)).astype(np.uint64)  # many digests with one first word
    pool[20:, 0] = rng.integers(0, 2**63, 20)
    for largest in (False, True):
        runs, want = [], {}
        for _ in range(5):
            d = pool[rng.integers(0, 40, 60)]
            ids = np.where(rng.random(60) < 0.2, exact_dedup.NO_ID, rng.integers(0, 9, 60))
            one = np.ones(60, dtype=np.int64)
            runs.append(exact_dedup._sorted_run(d, ids, one, one, largest))
            for x, i in zip(map(tuple, d.tolist()), ids.tolist(), strict=True):
                want.setdefault(x, []).append(i)
        d, ids, sizes, at_id = exact_dedup._merge(runs, largest)
        got = {tuple(x): (i, n, m) for x, i, n, m in zip(d.tolist(), ids.tolist(), sizes.tolist(), at_id.tolist(), strict=True)}
        assert d.tolist() == sorted(map(list, got)) and got.keys() == want.keys()
        for x, all_ids in want.items():
            known = [i for i in all_ids if i != exact_dedup.NO_ID] or [exact_dedup.NO_ID]
            best = max(known) if largest else min(known)
            assert got[x] == (best, len(all_ids), all_ids.count(best))


def test_near_copies_are_found_among_many(spark):
    """Pairs and one large group of edited copies: nearly all pairs of likeness 0.8 end in one component, no other texts."""
    rng, docs = random.Random(3), []
    for g in range(60):
        base = prose(1000 + g, 150).split()
        for k in range(60 if g == 0 else 3):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in simhash.keep_one(df, radius=14, shingle=5).collect()}
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = {i for i in range(len(docs)) if find(i) == i}
    assert want <= kept and len(kept - want) <= 0.05 * (len(docs) - len(want))


@pytest.mark.parametrize("size", [60, 400])
def test_forest_of_a_key_joins_what_brute_force_joins(size):
    """Groups of sets around a few centres: in whole sketches a forest comes out, in longer ones open pairs too."""
    rng = np.random.default_rng(size)
    sets = []
    for _ in range(4):
        centre = rng.integers(0, 1 << 63, size=size, dtype=np.uint64)
        for _ in range(12):
            own = centre.copy()
            own[rng.choice(size, int(size * rng.choice([0.02, 0.05, 0.25])), replace=False)] += np.uint64(1 << 40)
            sets.append(np.unique(own))
    like = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if like(sets[i], sets[j]) >= 0.8}
    rows = [{"key": 0, "p": 0, "q": 0, "part": 0, "band": 0, "node": i, "root": i, "fp": simhash.majority(s), "size": len(s), "mins": simhash.bands(s)[1], "low": simhash.lowest(s)} for i, s in enumerate(sets)]
    frame = pd.DataFrame(rows).astype({"fp": "uint64"})
    frame["fp"] = frame["fp"].to_numpy().view(np.int64)
    got = [(min(a, b), max(a, b)) for x, y in simhash._Key(frame, 64, 0.8).links(simhash.EVERY) for a, b in zip(x, y, strict=True)]

    def roots(pairs):
        root = list(range(len(sets)))
        for a, b in pairs:
            ra, rb = root[a], root[b]
            root = [min(ra, rb) if r in (ra, rb) else r for r in root]
        return root

    assert roots(p for p in got if p in want) == roots(want)
    if size <= simhash.LOWEST:
        assert set(got) <= want and len(got) < len(sets)
