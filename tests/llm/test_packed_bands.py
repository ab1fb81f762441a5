"""Bands of similarity joins go into the shuffle packed, and hashes of runs of characters are computed in steps."""

import collections

import numpy as np
import pyarrow as pa

from helix.llm import line_dedup as L
from helix.llm import similar as S


def test_bands_are_packed(spark):
    """Far fewer rows than bands; the buckets are those of the plain bands, of members that are alike."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (400, 144), dtype=np.uint8)
    base[200:300] = base[:100]
    base[200:300, ::9] = rng.integers(0, 256, (100, 16), dtype=np.uint8)  # copies with other values here and there
    base[300:340] = 255 - base[340:380]
    base[300:340, :6] = base[340:380, :6]  # one band in common, and nothing else
    base[380:] = base[380]  # a bucket of more than MARKED
    ids = [i + (i % 3 << 33) for i in range(400)]
    members = spark.createDataFrame([(i, bytes(x.tobytes())) for i, x in zip(ids, base, strict=True)] + [(7 << 33, None)], "id long, sketch binary").repartition(3)
    packed = S.banded(members, 6, 6)
    assert packed.count() <= 3 * 3 * 64
    entries = [e for r in packed.collect() for e in np.frombuffer(r["bands"], np.uint32).reshape(-1, 4)]
    assert len(entries) == 400 * 24
    plain = collections.defaultdict(set)
    for i, x in zip(ids, base, strict=True):
        for k in range(24):
            plain[k, x[6 * k : 6 * k + 6].tobytes()].add(i)
    number = {i: n for n, i in enumerate(ids)}
    unlike = {frozenset((ids[n], ids[n + 40])) for n in range(300, 340)}
    want = {frozenset(x) for x in plain.values() if len(x) > 1} - unlike
    got = collections.defaultdict(set)
    for r in S.shared_bands(members, 6, 0.8).collect():
        got[r["h"]].add(r["id"])
        assert r["n"] >= 2
    assert {frozenset(x) for x in got.values()} == want and any(len(x) == 20 for x in want) and any(number[i] < 100 for x in want for i in x)


def test_marks_of_similar_members_differ_in_few_bits():
    assert S.most_unlike(0.8) < 20 and S.most_unlike(0.9) < S.most_unlike(0.8)
    x = pa.array([bytes(range(144)), bytes(range(144)), bytes(x ^ 1 for x in range(144))], pa.binary())
    a, b, c = S.marks(x)
    assert a == b and np.bitwise_count(a ^ c) == 64


def test_character_runs_across_steps():
    """Texts longer than a step, short ones, empty ones and characters of several bytes: equal runs have equal hashes, others have others."""
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abc é語😀"), n)) for n in (0, 1, 4, 5, 6, L._STEP + 3, 0, 3, 2 * L._STEP + 4, 70)]
    raw = [t.encode() for t in texts]
    h, after = L.char_hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]), 5)
    runs = [t[i : i + 5] for t in texts for i in range(max(len(t) - 4, len(t) > 0))]
    assert len(h) == len(runs) == after[-1] and len(set(h.tolist())) == len(set(runs)) == len(set(zip(h.tolist(), runs, strict=True)))


def test_lines_with_long_white_space():
    text = (" " * 200 + "a b" + "\t" * 100 + "\n" + " " * 300 + "\n x \r\n\ny").encode()
    starts, ends, row, number, n = L.text_lines(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert [text[a:b] for a, b in zip(starts, ends, strict=True)] == [b"a b", b"x", b"y"] and number.tolist() == [0, 2, 4] and n.tolist() == [5] and row.tolist() == [0, 0, 0]
