"""The language model against sums over all words and against loops over all tokens."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helix.llm import lm_score as M
from helix.llm import words as W

TEXTS = [" ".join(f"w{(i * i + 7 * k) % (11 + k % 5)}{'aeiou'[i % 5]}" for i in range(40 + k)) for k in range(30)] + ["", "once only here", "w1a w2e"]


@pytest.fixture(scope="module")
def model(spark):
    texts = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3)
    vocab, rare = M.vocabulary(M.counts(texts), 2.0**-19)
    return texts, vocab, rare.collect(), M.train(texts, vocab)


def tokens(texts):
    ((_, data, offsets),) = W.chunks(pa.array(texts), 1 << 20)
    return M.tokens(data, offsets)


def test_probabilities_of_all_words_sum_to_one(model):
    _, vocab, rare, m = model
    h, g, rows = tokens(["w1a w2e w0u once unseen w4i"])
    cls, _, _ = vocab.classes(h, g)
    for at in range(len(h)):
        outer, inner = M.features(h, cls, rows)
        p = np.exp(M.log_probabilities(outer, m.weights[0], m.bias[0])[at].astype(float))
        assert abs(p.sum() - 1) < 1e-4
        total = p[: M.SINGLE].sum()
        for c in range(M.SINGLE, M.CLASSES):
            if p[c] == 0:
                continue
            # the buckets of the second factor as if the token were of this class
            as_c = np.full_like(cls, c)
            _, f = M.features(h, np.where(np.arange(len(h)) == at, as_c, cls), rows)
            q = np.exp(M.log_probabilities(f[:, at : at + 1], m.weights[1], m.bias[1][[c]])[0].astype(float))
            if c < M.SINGLE + M.GROUPS:
                some = vocab.cls == c
                words = sum(q[k] * n / vocab.mass[c, k] for k, n in zip(vocab.cluster[some], vocab.n[some], strict=True))
            else:
                words = sum(q[k] * (vocab.mass[c, k] + vocab.distinct[c, k] + 1) / (vocab.mass[c, k] + vocab.distinct[c, k] + 1) for k in range(M.CLUSTERS))
            total += p[c] * words
        assert abs(total - 1) < 1e-3


def test_rare_words_and_counts_make_up_the_clusters(model):
    _, vocab, rare, _ = model
    n = sum(len(t.split()) + 1 for t in TEXTS)
    assert vocab.total == n == vocab.mass.sum() and vocab.size == len({w for t in TEXTS for w in t.split()}) + 1 == vocab.distinct.sum()
    assert vocab.n.sum() + sum(r["n"] for r in rare) == n and all(r["n"] < 4 for r in rare)
    assert (vocab.n[vocab.cls >= 1] >= 4).all()


def test_gradients_are_sums_over_all_tokens(model):
    texts, vocab, _, m = model
    h, g, rows = tokens(TEXTS)
    cls, cluster, _ = vocab.classes(h, g)
    outer, inner = M.features(h, cls, rows)
    p = np.exp(M.log_probabilities(outer, m.weights[0], m.bias[0]))
    seen, want = np.zeros((2, M.BUCKETS, M.CLASSES)), np.zeros((2, M.BUCKETS, M.CLASSES))
    for at in range(len(h)):
        for f in outer:
            seen[0, f[at], cls[at]] += 1
            want[0, f[at]] += p[at]
        if cls[at] >= M.SINGLE:
            q = np.exp(M.log_probabilities(inner[:, [at]], m.weights[1], m.bias[1][[cls[at]]])[0])
            for f in inner:
                seen[1, f[at], cluster[at]] += 1
                want[1, f[at]] += q
    assert all((a == b).all() for a, b in zip(M.gradient_part(texts, vocab, None), seen, strict=True))
    assert all(np.allclose(a, b, rtol=1e-4, atol=1e-4) for a, b in zip(M.gradient_part(texts, vocab, m), want, strict=True))


def test_context_tells_words_of_a_class_apart(spark):
    """After "new", "york" is likelier than before, and than a word of the same count and class elsewhere."""
    rng = np.random.default_rng(1)
    other = [f"x{i:02d}ork" for i in range(40)]
    texts = [" ".join(w for _ in range(30) for w in (["new", "york"] if rng.random() < 0.2 else [str(rng.choice(other))])) for _ in range(200)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1000, "new york"), (1001, "x01ork york"), (1002, "new x01ork")], "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in M.lm_score(d, F.col("doc_id") >= 1000).collect() if r["doc_id"] >= 1000}
    assert s[1000] > s[1001] and s[1000] > s[1002] + 0.5


def test_classes_do_not_depend_on_the_size_of_the_corpus(spark):
    """Ten times the corpus: the same shares, so the same words are frequent."""
    base = [("a " * 50 + "b " * 10 + "c c c d",)] * 3
    share = 2.0**-5
    small, _ = M.vocabulary(M.counts(spark.createDataFrame(base * 2, "text string")), share)
    large, _ = M.vocabulary(M.counts(spark.createDataFrame(base * 20, "text string")), share)
    assert (small.key == large.key).all() and len(small.key) <= 1 / share + 1
