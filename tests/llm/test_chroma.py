from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from agreemill.llm import chroma

SCHEMA = "vec_id long, embedding array<float>, fp string"


def vectors(n=60, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        v = rng.normal(0, 0.125, 64)
        out.append(v)
        for _ in range(rng.integers(0, 4)):
            out.append(v + rng.normal(0, 0.006, 64))
    return [x.astype(np.float32).tolist() for x in out[:n]]


def fp_of(v):
    return chroma.fingerprint_of(chroma.chroma(chroma.melody(v)))


def slow_linked(a, b):
    """Every offset at which any integer agrees, one by one."""
    a, b = a.view(np.uint32).tolist(), b.view(np.uint32).tolist()
    for offset in range(-len(a) + 1, len(b)):
        both = [(x, b[i + offset]) for i, x in enumerate(a) if 0 <= i + offset < len(b)]
        errors = sum((x ^ y).bit_count() for x, y in both)
        if any(x == y for x, y in both) and len(both) >= min(chroma.MIN_OVERLAP, len(a), len(b)) and errors <= chroma.MAX_ERRORS * 32 * len(both):
            return True
    return False


def slow_classes(rows):
    fps = {i: fp_of(v) for i, v in rows if v}
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if slow_linked(fps[a], fps[b]):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i, _ in rows}


def test_classes_match_brute_force(spark):
    rows = list(enumerate(vectors()))
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(3, rows[3][1], "x"), (99, None, "x"), (98, [], "x")], SCHEMA)
    got = chroma.tune_classes(df).collect()
    assert len(got) == 63
    expected = slow_classes(rows) | {99: 99, 98: 98}
    assert {r["vec_id"]: r["class_id"] for r in got} == expected
    assert len(set(expected.values())) < 50
    by = {r["vec_id"]: r for r in got}
    assert by[0]["fp_crc32"] == chroma.checksum(fp_of(rows[0][1])) and by[99]["n_ints"] <= 0
    for i, v in rows:
        r = by[i]
        if r["class_id"] == i:
            assert (r["offset"], r["bit_error_rate"]) == (0, 0.0)
        else:
            found = chroma.align(fp_of(v), fp_of(rows[r["class_id"]][1]))
            assert (r["offset"], r["bit_error_rate"]) == ((None, None) if found is None else (found[0], round(found[1] / found[2], 6)))


def test_hot_integers_are_dealt_in_parts(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(0, 0.125, 64)
    rows = [(i, fp_of((base + rng.normal(0, 0.003, 64)).tolist()).tolist()) for i in range(120)]
    prints = spark.createDataFrame(rows, "n long, fp array<int>")
    from agreemill.llm.components import components

    one = {r["node"]: r["component"] for r in components(chroma.links(prints), "a", "b").collect()}
    parts = {r["node"]: r["component"] for r in components(chroma.links(prints, part=10), "a", "b").collect()}
    assert one == parts and len(one) > 100


def prints_with_one_integer(pairs, seed=0):
    """Recordings in pairs of near copies; all share one integer, twice, at varied places."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(pairs):
        fp = rng.integers(-(2**31), 2**31, 40)
        fp[rng.integers(3, 17)] = fp[rng.integers(20, 36)] = 77
        other = fp.copy()
        other[::3] ^= 0b1011
        rows += [(2 * i, fp.astype(int).tolist()), (2 * i + 1, other.astype(int).tolist())]
    for _, fp in rows:
        fp[38] = 77
    return rows


@pytest.mark.parametrize(("few", "part"), [(1000, 10), (5, 10), (5, 1000), (5, 3)])
def test_pairs_that_share_one_hot_integer_are_all_found(spark, few, part):
    rows = prints_with_one_integer(40)
    got = {tuple(sorted(r)) for r in chroma.links(spark.createDataFrame(rows, "n long, fp array<int>"), few=few, part=part).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(40)}


def test_repeated_integers_are_tried_at_every_offset(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(-(2**31), 2**31, 40).astype(np.int32)
    a[25] = 5
    b = a ^ np.int32(0b111)
    b[25] = 5
    b[3] = 5
    assert chroma.linked(a, b) and slow_linked(a, b)
    rows = [(1, a.tolist()), (2, b.tolist()), (3, a[::-1].tolist())]
    assert [tuple(r) for r in chroma.links(spark.createDataFrame(rows, "n long, fp array<int>")).collect()] == [(1, 2)]
    for _ in range(60):
        x, y = (rng.integers(0, 4, rng.integers(1, 30)).astype(np.int32) for _ in range(2))
        offsets, counts = chroma.offset_histogram(x, y)
        slow = Counter(j - i for i, p in enumerate(x.tolist()) for j, q in enumerate(y.tolist()) if p == q)
        assert dict(zip(offsets.tolist(), counts.tolist(), strict=True)) == slow
        assert chroma.linked(x, y) == slow_linked(x, y)


def test_long_silence_is_aligned_in_bounded_memory():
    a = np.zeros(20_000, np.int32)
    assert chroma.linked(a, a[:15_000])


def test_rows_of_one_key_and_clashing_names(spark):
    rng = np.random.default_rng(3)
    v, w = ((rng.normal(0, 0.125, 64)).astype(np.float32).tolist() for _ in range(2))
    df = spark.createDataFrame([(1, v, "a", 1), (1, w, "b", 2), (2, w, "c", 3), (None, v, "d", 4)], "vec_id long, embedding array<float>, fp string, n int")
    got = sorted((r["vec_id"] or 0, r["class_id"] or 0) for r in chroma.tune_classes(df).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 1)]


def test_shifted_and_resampled_recordings_align():
    rng = np.random.default_rng(1)
    tune = chroma.melody(rng.normal(0, 0.125, 200))
    a = chroma.fingerprint_of(chroma.chroma(tune))
    b = chroma.fingerprint_of(chroma.chroma(tune[7 * chroma.HOP :]))
    offset, errors, bits = chroma.align(b, a)
    assert offset == 7 and errors <= 0.02 * bits
    quiet = chroma.decode_wav(chroma.wav_bytes(0.5 * tune))
    c = chroma.fingerprint_of(chroma.chroma(quiet))
    errors, bits = chroma.bit_errors(a, c, 0)
    assert errors <= 0.1 * bits
    up = np.interp(np.arange(0, len(tune) - 1, 0.5), np.arange(len(tune)), tune)
    d = chroma.fingerprint_of(chroma.chroma(chroma.decode_wav(chroma.wav_bytes(up, 2 * chroma.RATE))))
    errors, bits = chroma.bit_errors(a, d, 0)
    assert errors <= 0.15 * bits
    other = chroma.fingerprint_of(chroma.chroma(chroma.melody(rng.normal(0, 0.125, 200))))
    errors, bits = chroma.bit_errors(a, other, 0)
    assert errors > 0.25 * bits


def test_cells_that_are_no_recordings(spark):
    cells = [(1, None), (2, b""), (3, b"junk"), (4, chroma.wav_bytes(np.zeros(100))), (5, chroma.wav_bytes(np.zeros(60_000))), (6, chroma.wav_bytes(np.zeros(70_000)))]
    got = {r["id"]: r for r in chroma.classes(spark.createDataFrame(cells, "id long, wav binary"), "wav", "id").collect()}
    assert {i: r["class_id"] for i, r in got.items()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5}
    assert chroma.tune_classes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_filters_fit_the_frames():
    assert len(chroma.filters()) == 16
    assert all(0 <= y and y + h <= 12 and 2 <= w <= chroma.SPAN for _, y, h, w in chroma.filters())


def test_groups_laid_out_equal_pair_by_pair(monkeypatch):
    """Every offset of the shared integer, whichever way a group is compared."""
    rng = np.random.default_rng(6)
    base = rng.integers(-(2**31), 2**31, 60).astype(np.int32)
    prints = []
    for _ in range(25):
        a, b = rng.integers(0, 29), rng.integers(32, 60)
        own = base[a:b].copy()
        for i in rng.integers(0, len(own), int(rng.integers(0, 5 * len(own)))):
            own[i] ^= np.int32(1 << int(rng.integers(0, 31)))
        own[30 - a] = 7
        if rng.random() < 0.5:
            own[rng.integers(0, len(own))] = 7
        prints.append(own)
    first = rng.random(25) < 0.6
    for one, two in ((np.ones(25, bool), np.ones(25, bool)), (first, ~first)):
        want = set()
        for i in range(25):
            for j in range(i + 1, 25):
                offsets = {int(q - p) for p in np.flatnonzero(prints[i] == 7) for q in np.flatnonzero(prints[j] == 7)}
                tried = [chroma.bit_errors(prints[i], prints[j], o) for o in offsets]
                if one[i] and two[j] and any(n >= 32 * min(chroma.MIN_OVERLAP, len(prints[i]), len(prints[j])) and e <= 0.2 * n for e, n in tried):
                    want.add((i, j))
        for cells in (1, 10**9):
            monkeypatch.setattr(chroma, "CROWD_CELLS", cells)
            assert set(chroma._met(7, prints, one, two, 0.2)) == want
        assert want
