"""Language-model scoring with a hashed maximum-entropy model: word n-gram, skip and class features, and a softmax factored by classes.

P(word | history) = P(class | history) * P(cluster | class, history) * P(step | steps before, history) * ... All factors are log-linear models over
hashed features of the two words before; their weights are learned by gradient updates to which every task adds what it has observed
and expected in all its training documents. A class is the end of a text, one of the most frequent words, or a group of frequent or
of rare words by ending; a group's clusters are its most frequent words, one each, and parts of the rest by hash, so an unseen word
has a cluster too. A cluster of several frequent words is divided in the same way, step by step, until a part is one word. A cluster of rare words is divided by
three steps of 16 by hash; only rare words that fall into the same of these 4,096 cells share it by their counts. Unseen words have the share of one count of their cluster.

Counts cover all training documents. A word is frequent if it is counted four times and is a share of all tokens (2^-19) at least. So at
most 2^19 words can be, whatever the size of the corpus; they go to the tasks as arrays. The others, of which there is no bound, meet
their counts in a join. What a task sends for a gradient has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helix.llm import words as W
from helix.llm.shared import written

END, START = W.U(0x5BD1E9955BD1E995), W.U(0x27D4EB2F165667C5)
GROUPS, TOP = 4, 7
#: Classes: 0 the end, then the most frequent words, the groups of frequent words, the groups of rare words. Single ones have no clusters.
CLASSES, SINGLE = 1 + TOP + 2 * GROUPS, 1 + TOP
#: Clusters of a group, as many as classes, so that both factors have rows of one width; those of frequent words that are one word.
CLUSTERS, OWN = CLASSES, 8
BUCKETS, TEMPLATES = 1 << 15, 4
#: Buckets of the factors within clusters; steps by hash within clusters of rare words, cells that they lead to, and nodes at which they are taken.
DEEP, STEPS = 1 << 16, 3
CELLS, RARE_NODES = CLUSTERS**STEPS, GROUPS * CLUSTERS * sum(CLUSTERS**i for i in range(STEPS))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of a run of texts, each text followed by its end; the group of each by its last two bytes; the rows' offsets."""
    starts, ends, rows = W.spans(data, offsets, W.NONSPACE)
    h = W.hashes(data, starts, ends)
    last, second = W.LOWER[data[ends - 1]].astype(W.U), np.where(ends - starts > 1, W.LOWER[data[np.maximum(ends - 2, 0)]], 0).astype(W.U)
    group = (W.mixed(last << W.U(8) | second) % W.U(GROUPS)).astype(np.int64)
    return np.insert(h, rows[1:], END), np.insert(group, rows[1:], -1), rows + np.arange(len(rows))


def counts(texts: DataFrame) -> DataFrame:
    """texts (text) -> token, grp, n: how often each token stands in them. Tasks sum before the shuffle, and hand on when they hold much."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, g, n = (np.concatenate([x[i] for x in held]) for i in range(3))
            u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            return u, g[first], np.bincount(inverse, n).astype(np.int64)

        def rows() -> pa.RecordBatch:
            u, g, n = merged()
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(g), pa.array(n)], ["token", "grp", "n"])

        for b in batches:
            for _, data, offsets in W.chunks(b["text"], 4 << 20):
                h, g, _ = tokens(data, offsets)
                u, first, n = np.unique(h, return_index=True, return_counts=True)
                held.append((u, g[first], n))
                if sum(len(x[0]) for x in held) > 3_000_000:
                    held[:] = [merged()]
                    if len(held[0][0]) > 2_000_000:
                        yield rows()
                        held.clear()
        if held:
            yield rows()

    return texts.mapInArrow(W.releasing(run), "token long, grp long, n long").groupBy("token").agg(F.max("grp").alias("grp"), F.sum("n").alias("n"))


def by_hash(h: np.ndarray) -> np.ndarray:
    """A part of 16 by a token's hash; part_by_hash() is the same as a column."""
    return ((h >> W.U(20)) & W.U(15)).astype(np.int64)


def part_by_hash(token):
    return F.shiftrightunsigned(token, 20).bitwiseAND(F.lit(15)).cast("long")


def cell_by_hash(h: np.ndarray) -> np.ndarray:
    """A cell of CELLS by further bits of a token's hash; cell_of() is the same as a column."""
    return ((h >> W.U(24)) & W.U(CELLS - 1)).astype(np.int64)


def cell_of(token):
    return F.shiftrightunsigned(token, 24).bitwiseAND(F.lit(CELLS - 1)).cast("long")


@dataclass
class Paths:
    """Steps (node, outcome) within clusters: those of the frequent tokens (of one from first to the next's first), the logarithm of the outcomes' shares at each node, and
    the tokens and distinct tokens of each cell of each cluster of rare words."""

    first: np.ndarray
    node: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    cells: np.ndarray

    def steps(self, h: np.ndarray, cls: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The steps of some tokens: of which token, node, outcome. Those of a token follow each other."""
        known, rare = np.flatnonzero(place >= 0), np.flatnonzero((place < 0) & (cls >= SINGLE + GROUPS))
        n = np.diff(self.first)[place[known]] if len(known) else np.zeros(0, np.int64)
        at = np.repeat(known, n)
        step = np.repeat(self.first[:-1][place[known]] - np.cumsum(n) + n, n) + np.arange(len(at)) if len(at) else np.zeros(0, np.int64)
        q, cell = (cls[rare] - SINGLE - GROUPS) * CLUSTERS + by_hash(h[rare]), cell_by_hash(h[rare])
        nodes, outs, base = [], [], 0
        for i in range(STEPS):
            prefix = cell // CLUSTERS ** (STEPS - i)
            nodes.append(base + q * CLUSTERS**i + prefix)
            outs.append(cell // CLUSTERS ** (STEPS - 1 - i) % CLUSTERS)
            base += GROUPS * CLUSTERS ** (i + 1)
        return np.concatenate([at, np.repeat(rare, STEPS)]), np.concatenate([self.node[step], np.stack(nodes, axis=1).ravel()]), np.concatenate([self.out[step], np.stack(outs, axis=1).ravel()])

    def cell(self, h: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Tokens and distinct tokens of the cells of rare tokens."""
        return self.cells[(cls - SINGLE - GROUPS) * CLUSTERS + by_hash(h), cell_by_hash(h)]


def paths(key: np.ndarray, n: np.ndarray, cls: np.ndarray, cluster: np.ndarray, cells: np.ndarray) -> Paths:
    """Each part of several frequent words is divided into its most frequent ones, one each, and parts of the rest by hash."""
    shares, words, nodes, outs = [cells.reshape(-1, CLUSTERS**i, CLUSTERS, CELLS // CLUSTERS ** (i + 1)).sum(axis=3).reshape(-1, CLUSTERS) for i in range(STEPS)], [], [], []
    word = np.flatnonzero((cls >= SINGLE) & (cluster >= OWN))
    part, base, level = cls[word] * CLUSTERS + cluster[word], RARE_NODES, 0
    while len(word):
        _, at, size = np.unique(part, return_inverse=True, return_counts=True)
        word, part = word[size[at] > 1], part[size[at] > 1]
        u, at, size = np.unique(part, return_inverse=True, return_counts=True)
        order = np.lexsort((key[word], -n[word], at))
        word, at = word[order], at[order]
        rank = np.arange(len(word)) - (np.cumsum(size) - size)[at]
        own = (rank < OWN) | (size[at] <= CLUSTERS)
        out = np.where(own, rank, OWN + (W.mixed(key[word] ^ W.U(0x6A09E667F3BCC909 + level)) % W.U(CLUSTERS - OWN)).astype(np.int64))
        words.append(word)
        nodes.append(base + at)
        outs.append(out)
        shares.append(np.bincount(at * CLUSTERS + out, n[word], len(u) * CLUSTERS).reshape(-1, CLUSTERS))
        word, part, base, level = word[~own], (at * CLUSTERS + out)[~own], base + len(u), level + 1
    words, nodes, outs = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (words, nodes, outs))
    order = np.argsort(words, kind="stable")
    share = np.concatenate(shares).astype(float)
    total = share.sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore"):
        bias = np.where(total > 0, np.log(share / np.maximum(total, 1)), 0).astype(np.float32)
    first = np.concatenate([[0], np.cumsum(np.bincount(words, minlength=len(key)))]).astype(np.int64)
    return Paths(first, nodes[order].astype(np.int64), outs[order].astype(np.int64), bias, cells)


@dataclass
class Vocabulary:
    """The frequent tokens in order, with count, class and cluster; of each cluster (class, cluster) the tokens and distinct tokens in it; all tokens and distinct tokens; the
    steps within clusters."""

    key: np.ndarray
    n: np.ndarray
    cls: np.ndarray
    cluster: np.ndarray
    mass: np.ndarray
    distinct: np.ndarray
    total: int
    size: int
    paths: Paths

    def classes(self, h: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The class and cluster of each token, and its place among the frequent ones (-1: it is none)."""
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        g = group[first]
        cls, cluster, place = np.where(g < 0, 0, SINGLE + GROUPS + g), np.where(g < 0, 0, by_hash(u)), np.full(len(u), -1)
        if len(self.key):
            at = np.minimum(np.searchsorted(self.key, u), len(self.key) - 1)
            known = self.key[at] == u
            cls, cluster, place = np.where(known, self.cls[at], cls), np.where(known, self.cluster[at], cluster), np.where(known, at, -1)
        return cls[inverse], cluster[inverse], place[inverse]


def vocabulary(counted: DataFrame, least_share: float) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary, and the table of the counted tokens that are not among its frequent ones."""
    total, size = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    is_frequent = (F.col("n") >= max(4.0, total * least_share)) | (F.col("grp") < 0)
    table = counted.filter(is_frequent).toArrow()  # 1 / least_share rows at most, and the end
    key, n, grp = table["token"].to_numpy().view(W.U), table["n"].to_numpy(), table["grp"].to_numpy()
    order = np.argsort(key)
    key, n, grp = key[order], n[order], grp[order]
    falling = np.lexsort((key, -n))
    cls = np.where(grp < 0, 0, SINGLE + grp)
    top = falling[grp[falling] >= 0][:TOP]
    cls[top] = 1 + np.arange(len(top))
    cluster = OWN + by_hash(key) % (CLUSTERS - OWN)
    for c in range(CLASSES):
        some = falling[cls[falling] == c][:OWN]
        cluster[some] = np.arange(len(some))
    mass, distinct = (np.bincount(cls * CLUSTERS + cluster, w, CLASSES * CLUSTERS).reshape(CLASSES, CLUSTERS) for w in (n, None))
    rare = counted.filter(~is_frequent).select("token", "grp", "n")
    cells = np.zeros((GROUPS * CLUSTERS, CELLS))
    by = rare.groupBy("grp", part_by_hash(F.col("token")).alias("part"), cell_of(F.col("token")).alias("cell")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow()  # a row for each cell
    if by.num_rows:
        g, part, cell, m, v = (by[c].to_numpy() for c in ("grp", "part", "cell", "n", "v"))
        np.add.at(mass, (SINGLE + GROUPS + g, part), m)
        np.add.at(distinct, (SINGLE + GROUPS + g, part), v)
        cells[g * CLUSTERS + part, cell] = m + v
    return Vocabulary(key, n, cls, cluster, mass, distinct, int(total), int(size), paths(key, n, cls, cluster, cells)), rare.select("token", "n")


def histories(h: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """A hash of each token's word before, of the word before that, and of both."""
    one, two = np.empty_like(h), np.empty_like(h)
    one[1:], two[2:] = h[:-1], h[:-2]
    first = rows[:-1]
    one[first] = two[first] = two[first[np.diff(rows) > 1] + 1] = START
    return [W.mixed(one ^ W.U(0x1F83D9ABFB41BD6B)), W.mixed(two ^ W.U(0x5BE0CD19137E2179)), W.mixed(one * W.U(3) + two ^ W.U(0x243F6A8885A308D3))]


def features(h: np.ndarray, cls: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each token's history for the class factor, a row for each template: word before, word before that, both, both classes; and for the
    cluster factor those of the first three, in a range of buckets for each group."""
    c1, c2 = np.zeros_like(cls), np.zeros_like(cls)
    c1[1:], c2[2:] = cls[:-1], cls[:-2]
    first = rows[:-1]
    c1[first] = c2[first] = c2[first[np.diff(rows) > 1] + 1] = 0
    shift = W.U(64 - 15)
    words = histories(h, rows)
    own = (cls - SINGLE) * (BUCKETS // (2 * GROUPS))
    outer = [x >> shift for x in words] + [W.mixed((c1 * CLASSES + c2).astype(W.U) ^ W.U(0x13198A2E03707344)) >> shift]
    return np.stack(outer).astype(np.int64), np.stack([(W.mixed(x ^ W.U(0xA4093822299F31D0)) >> W.U(64 - 12)).astype(np.int64) + own for x in words])


def deep_features(words: list[np.ndarray], at: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The buckets of steps at nodes, of tokens with these histories."""
    of = W.mixed(node.astype(W.U) ^ W.U(0xBB67AE8584CAA73B))
    return np.stack([(W.mixed(x[at] ^ of) >> W.U(64 - 16)).astype(np.int64) for x in words])


def log_probabilities(f: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """A row of log probabilities of the outcomes for each token: the softmax of bias and the weights of its buckets."""
    z = weights[f[0]] + bias
    for t in f[1:]:
        z += weights[t]
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


@dataclass
class Model:
    """For classes and for clusters: weights (BUCKETS rows) and bias, the logarithm of the shares; a row of cluster bias for each class. Weights of steps within clusters."""

    weights: tuple[np.ndarray, np.ndarray]
    bias: tuple[np.ndarray, np.ndarray]
    deep: np.ndarray

    def log_probability(self, h: np.ndarray, cls: np.ndarray, cluster: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Of each token's class and cluster, given its history."""
        outer, inner = features(h, cls, rows)
        p = log_probabilities(outer, self.weights[0], self.bias[0])[np.arange(len(h)), cls].astype(np.float64)
        some = np.flatnonzero(cls >= SINGLE)
        p[some] += log_probabilities(inner[:, some], self.weights[1], self.bias[1][cls[some]])[np.arange(len(some)), cluster[some]]
        return p

    def within_clusters(self, h: np.ndarray, cls: np.ndarray, place: np.ndarray, rows: np.ndarray, paths: Paths) -> np.ndarray:
        """Of each token's steps within its cluster, given its history; 0 where there are none. A cell without any counted word has -inf."""
        at, node, out = paths.steps(h, cls, place)
        p = log_probabilities(deep_features(histories(h, rows), at, node), self.deep, paths.bias[node])[np.arange(len(at)), out]
        return np.bincount(at, p, len(h))


def gradient_part(texts: DataFrame, vocab: Vocabulary, model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket was active with each class, and with each cluster, in the texts; with a model, how often it expects that."""
    return gradient_parts(texts, vocab, model)[:2]


def add_expected(part: np.ndarray, f: np.ndarray, p: np.ndarray) -> None:
    """Add the rows of p to the buckets in f; part has a row for each outcome."""
    for row, x in zip(part, np.ascontiguousarray(p.T, float), strict=True):
        for t in f:
            row += np.bincount(t, x, len(row))


def gradient_parts(texts: DataFrame, vocab: Vocabulary, model: Model | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """gradient_part(), and the same for steps within clusters: how often they were taken (without a model), and are expected (without one, by the shares at their nodes,
    as a bucket is of many nodes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES, 2 * BUCKETS + 2 * DEEP))

        def add_observed(base: int, f: np.ndarray, out: np.ndarray) -> None:
            for t in f:
                np.add.at(total.reshape(-1), out * total.shape[1] + base + t, 1.0)

        for b in batches:
            for _, data, offsets in W.chunks(b["text"], 1 << 19):
                h, g, rows = tokens(data, offsets)
                cls, cluster, place = vocab.classes(h, g)
                at, node, step = vocab.paths.steps(h, cls, place)
                deep, shares = deep_features(histories(h, rows), at, node), vocab.paths.bias[node]
                if model is None:
                    add_observed(2 * BUCKETS, deep, step)
                add_expected(total[:, 2 * BUCKETS + DEEP :], deep, np.exp(shares if model is None else log_probabilities(deep, model.deep, shares)))
                outer, inner = features(h, cls, rows)
                some = np.flatnonzero(cls >= SINGLE)
                inner = inner[:, some]
                for level, f, out in ((0, outer, cls), (1, inner, cluster[some])):
                    if model is None:
                        add_observed(level * BUCKETS, f, out)
                        continue
                    p = np.exp(log_probabilities(f, model.weights[level], model.bias[0] if level == 0 else model.bias[1][cls[some]]))
                    add_expected(total[:, level * BUCKETS : (level + 1) * BUCKETS], f, p)
        active = np.flatnonzero(total.any(axis=0))
        values = pa.FixedSizeListArray.from_arrays(pa.array(total.T[active].ravel().astype(np.float32)), CLASSES).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([pa.array(active.astype(np.int32)), values], ["bucket", "v"])

    sums = [F.sum(F.col("v")[i].cast("double")).alias(f"v{i}") for i in range(CLASSES)]
    # each task sends sums of a fixed size, so there are as many as run at once, not as there are partitions; no row is moved for it
    few = texts.coalesce(max(8, texts.sparkSession.sparkContext.defaultParallelism))
    table = few.mapInArrow(W.releasing(run), "bucket int, v array<float>").groupBy("bucket").agg(*sums).toArrow()  # a row for each bucket
    out = np.zeros((2 * BUCKETS + 2 * DEEP, CLASSES))
    if table.num_rows:
        out[table["bucket"].to_numpy()] = np.stack([table[f"v{i}"].to_numpy() for i in range(CLASSES)], axis=1)
    return tuple(np.split(out, [BUCKETS, 2 * BUCKETS, 2 * BUCKETS + DEEP]))


def train(texts: DataFrame, vocab: Vocabulary, *, updates: int = 2, prior: float = 60.0, rate: float = 0.45) -> Model:
    """The model. Each update is a gradient step in the logarithm (iterative scaling): the log ratio of what was observed to what the model expects, both with
    a prior of so many tokens. Without weights it expects the shares in every bucket, so the first expectation needs no pass over the texts."""
    per_class, rare = vocab.mass.sum(axis=1), np.arange(CLASSES) >= SINGLE + GROUPS
    # rare and unseen words, and ends, can always come; a class or cluster of frequent words without any can't
    share = np.where((per_class > 0) | rare | (np.arange(CLASSES) == 0), per_class + 1.0, 0.0)
    within = vocab.mass + np.where(rare[:, None], vocab.distinct + 1.0, 0.0)
    share, within = share / share.sum(), within / np.maximum(within.sum(axis=1, keepdims=True), 1)
    with np.errstate(divide="ignore"):
        bias = (np.log(share).astype(np.float32), np.log(within).astype(np.float32))
    model = Model(tuple(np.zeros((BUCKETS, n), np.float32) for n in (CLASSES, CLUSTERS)), bias, np.zeros((DEEP, CLUSTERS), np.float32))
    shares = (share[None, :], np.repeat(within[SINGLE:], BUCKETS // (2 * GROUPS), axis=0))  # a bucket of the second factor is of one class
    *observed, taken, likely = gradient_parts(texts, vocab, None)
    for i in range(updates):
        if i == 0:
            expected = [o.sum(axis=1, keepdims=True) * s for o, s in zip(observed, shares, strict=True)]
        else:
            *expected, _, likely = gradient_parts(texts, vocab, model)
        model.deep += (rate * np.log((taken + prior / CLUSTERS) / (likely + prior / CLUSTERS))).astype(np.float32)
        for w, o, e, s in zip(model.weights, observed, expected, shares, strict=True):
            can = np.broadcast_to(s > 0, o.shape)
            w += np.where(can, rate * np.log(np.where(can, o + prior * s, 1) / np.where(can, e + prior * s, 1)), 0).astype(np.float32)
    return model


def lm_score(docs: DataFrame, held_out, *, doc_id: str = "doc_id", text: str = "text", least_share: float = 2.0**-19, updates: int = 2) -> DataFrame:
    """docs (doc_id, text; others are left alone) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row.

    held_out: a boolean column of docs; those rows aren't learned from (null: they are). Tokens are runs of non-space, A-Z lower-cased, and an end. The base is
    the count of a token plus one over all tokens, distinct tokens and one; the score is the model's. Both are sums of log10. Null is as empty, one token.
    Repeated rows count each time. Without training documents both are 0.
    """
    read = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    learned = read.filter("NOT held_out").select("text")
    counted = written(counts(learned), "counts")
    vocab, rare = vocabulary(counted, least_share)
    model = train(learned, vocab, updates=updates)
    log_n = np.log10(vocab.n + 1.0)
    # within its cluster: a frequent token by its steps; an unseen one has one count of tokens, distinct tokens and one; of the others a rare one by its steps to a cell, and there
    # by its count plus one, over tokens and distinct tokens
    outer = np.log10(vocab.mass + vocab.distinct + 1.0)
    kept = read.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = TaskContext.get().partitionId() << 38
        for batch in batches:
            for base, data, offsets in W.chunks(batch["text"], 1 << 19):
                n = len(offsets) - 1
                h, g, rows = tokens(data, offsets)
                cls, cluster, place = vocab.classes(h, g)
                p = model.log_probability(h, cls, cluster, rows) / np.log(10)
                known = place >= 0
                row = np.repeat(np.arange(n), np.diff(rows))
                deep = model.within_clusters(h, cls, place, rows, vocab.paths) / np.log(10)
                within = np.where(known, deep, -outer[cls, cluster])
                new = np.flatnonzero(~known)
                seen = np.zeros(len(new))  # what is added if the word has a count
                is_rare = cls[new] >= SINGLE + GROUPS
                r = new[is_rare]
                all_of, cell = (vocab.mass + vocab.distinct)[cls[r], cluster[r]], vocab.paths.cell(h[r], cls[r])
                seen[is_rare] = np.where(cell > 0, deep[r] + np.log10(np.maximum(all_of, 1) / np.maximum(cell, 1)), 0)
                first = np.bincount(row[known], log_n[place[known]], n) if len(vocab.key) else np.zeros(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[~known], minlength=n))]), pa.int32()), pa.StructArray.from_arrays([pa.array(h[new].view(np.int64)), pa.array(seen)], ["token", "seen"]))
                some = batch.slice(base, n)
                yield pa.RecordBatch.from_arrays(
                    [some["doc_id"], some["held_out"], pa.array(np.arange(next_id, next_id + n)), pa.array(np.diff(rows)), pa.array(np.bincount(row[known], minlength=n)), pa.array(first), pa.array(np.bincount(row, p + within, n)), lists],
                    ["doc_id", "held_out", "id", "n_tokens", "known", "first", "score", "rare"],
                )
                next_id += n

    scored = written(read.mapInArrow(W.releasing(score), f"doc_id {kept}, held_out boolean, id long, n_tokens long, known long, first double, score double, rare array<struct<token:long,seen:double>>"), "scored")
    more = scored.select("id", F.explode("rare").alias("r")).select("id", "r.*").join(rare, "token").groupBy("id").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("sum"), F.sum("seen").alias("seen"))
    out = scored.drop("rare").join(more, "id", "left").fillna(0, ["more", "sum", "seen"])
    all_n = float(np.log10(vocab.total + vocab.size + 1.0))
    learned_any = F.lit(vocab.total > 0)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("more")).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("first") + F.col("sum") - F.col("n_tokens") * all_n).alias("base_score"), F.when(learned_any, F.col("score") + F.col("sum") + F.col("seen")).otherwise(0.0).alias("score"),
    )
