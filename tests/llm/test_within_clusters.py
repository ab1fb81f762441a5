"""words of a cluster are told apart by their history, as classes and clusters are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helix.llm import lm_score as M
from tests.llm.test_model import tokens

NAMES = [f"q{i:03d}ed" for i in range(400)]


@pytest.fixture(scope="module")
def model(spark):
    """Each of 400 words of one ending comes after one of its own five times, and each of as many rare ones once or twice."""
    texts = [" ".join(f"p{i:03d} {w}" for i, w in enumerate(NAMES)) for _ in range(5)] + [" ".join(f"r{i}x {'s' * (i % 7)}{i}ed" for i in range(400))] + ["s3ed sss3ed s4ed", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    vocab, rare = M.vocabulary(M.counts(df), 2.0**-19)
    return texts, df, vocab, {r["token"]: r["n"] for r in rare.collect()}, M.train(df, vocab)


def test_context_tells_words_of_a_cluster_apart(spark, model):
    """Before, all words of a cluster gained the same from what stands before them, so both scores of a pair were equal."""
    _, _, vocab, _, _ = model
    h, g, _ = tokens([" ".join(NAMES)])
    cls, cluster, place = (x[:-1] for x in vocab.classes(h, g))
    a, b = next((i, j) for i in range(400) for j in range(i) if cls[i] == cls[j] and cluster[i] == cluster[j] >= M.OWN and (place[[i, j]] >= 0).all())
    docs = [(i, t) for i, t in enumerate(model[0])] + [(1000, f"p{a:03d} {NAMES[a]}"), (1001, f"p{a:03d} {NAMES[b]}"), (1002, f"p{b:03d} {NAMES[b]}"), (1003, f"p{b:03d} {NAMES[a]}")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in M.lm_score(d, F.col("doc_id") >= 1000).collect()}
    assert s[1000] + s[1002] > s[1001] + s[1003] + 0.05


def test_shares_within_clusters_sum_to_one(model):
    """Over all frequent words of a cluster, and over all counted rare ones of a cluster, whatever the history."""
    texts, _, vocab, rare, m = model
    every = sorted({w for t in texts for w in t.split()})
    for before in ("p007", "unseen"):
        h, g, rows = tokens([f"{before} {w}" for w in every])
        cls, cluster, place = vocab.classes(h, g)
        p = np.exp(m.within_clusters(h, cls, place, rows, vocab.paths))[rows[:-1] + 1]
        sums = {}
        for i, at in enumerate(rows[:-1] + 1):
            if cls[at] >= M.SINGLE:
                x = p[i]
                if place[at] < 0:
                    (cell,) = vocab.paths.cell(h[[at]], cls[[at]])
                    x *= (rare[int(h[at].view(np.int64))] + 1) / cell
                sums[cls[at], cluster[at]] = sums.get((cls[at], cluster[at]), 0) + x
        assert len(sums) > 40 and all(abs(x - 1) < 1e-4 for x in sums.values())


def test_gradients_of_steps_are_sums_over_all_steps(model):
    texts, df, vocab, _, m = model
    h, g, rows = tokens(texts)
    cls, _, place = vocab.classes(h, g)
    at, node, out = vocab.paths.steps(h, cls, place)
    f = M.deep_features(M.histories(h, rows), at, node)
    p = np.exp(M.log_probabilities(f, m.deep, vocab.paths.bias[node]))
    taken, shares, likely = np.zeros((3, M.DEEP, M.CLUSTERS))
    for i in range(len(at)):
        for t in f:
            taken[t[i], out[i]] += 1
            shares[t[i]] += np.exp(vocab.paths.bias[node[i]])
            likely[t[i]] += p[i]
    *_, a, b = M.gradient_parts(df, vocab, None)
    *_, _, c = M.gradient_parts(df, vocab, m)
    assert (a == taken).all() and np.allclose(b, shares, rtol=1e-4, atol=1e-4) and np.allclose(c, likely, rtol=1e-4, atol=1e-4)
