"""Near-dedup against brute force on one large group of near copies, and on crafted words."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glimmer.llm import near_dedup, substring_dedup, textkit


def twins() -> tuple[str, str]:
    """Two different words of 4,096 letters that any polynomial modulo 2**64 takes for equal."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_take_for_equal():
    w = [x for _, x in textkit.chunks(pa.array(twins()), textkit.FOLDED, 2)][0]
    assert len(set(w.hashes[0].tolist())) == 2 and len(set(w.hashes[1].tolist())) == 2
    upper = [x for _, x in textkit.chunks(pa.array(["Z" * 100, "z" * 100]), textkit.FOLDED, 2)][0]
    assert upper.hashes[0][0] == upper.hashes[0][1]


def test_identity_is_of_bytes(spark):
    a, b = twins()
    rest = [f"w{i}" for i in range(34)]
    rows = spark.createDataFrame([(1, " ".join([a, *rest])), (2, " ".join([b, *rest])), (3, a), (4, b)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(rows).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    classes = {r.doc_id: r.class_id for r in near_dedup.near_dedup(rows).collect()}
    assert classes[3] != classes[4]


@pytest.fixture(scope="module")
def family() -> list[str]:
    """1,500 texts around one: from near copies to strangers, chains of revisions, and odd ones."""
    own = random.Random(5)
    word = lambda: f"{own.choice('abcdefgh')}{own.randrange(10**6)}"
    base = [word() for _ in range(160)]
    texts = []
    for _ in range(1100):
        w = list(base)
        for _ in range(own.choice([0, 1, 1, 2, 2, 3, 4, 6, 9, 14])):
            w[own.randrange(len(w))] = word()
        texts.append(w)
    for _ in range(25):  # each version is like the one before
        w = list(base)
        for _ in range(10):
            for _ in range(2):
                w[own.randrange(len(w))] = word()
            texts.append(list(w))
    for _ in range(30):  # the same edits in a few texts: alike, but not like the base
        w = list(base)
        for k in own.sample(range(160), 12):
            w[k] = word()
        for _ in range(5):
            v = list(w)
            v[own.randrange(160)] = word()
            texts.append(v)
    own.shuffle(texts)
    return [" ".join(w) for w in texts]


def test_a_large_group_against_brute_force(spark, family):
    rows = spark.createDataFrame(list(enumerate(family)), "doc_id long, text string").repartition(6)
    weights = near_dedup.idf(rows, "text")
    sets = [(h, n * weights(h)) for _, w in textkit.chunks(pa.array(family), textkit.FOLDED) for h, n in near_dedup.per_text(w)]
    every = np.unique(np.concatenate([h for h, _ in sets]))
    n = len(sets)
    dense = np.zeros((n, len(every)), np.float32)
    for i, (h, x) in enumerate(sets):
        dense[i, np.searchsorted(every, h)] = x
    total = dense.sum(1, dtype=np.float64)
    links = []
    for i in range(n):
        at = np.flatnonzero(dense[i])
        shared = np.minimum(dense[i, at], dense[i + 1 :, at]).sum(1, dtype=np.float64)
        alike = shared / (total[i] + total[i + 1 :] - shared)
        links += [(i, i + 1 + j) for j in np.flatnonzero(alike >= 0.8)]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(rows).collect()}
    found = sum(got[a] == got[b] for a, b in links)
    assert len(links) > 10_000
    assert found >= 0.999 * len(links)  # a link is lost only where no band is shared
    assert all(find(i) == find(c) for i, c in got.items())  # nothing else is put together
    assert sum(got[i] != find(i) for i in range(n)) <= 0.01 * n


def test_bounds_leave_no_pair_out(spark):
    """Every pair of a group: linked through the hub, among the candidates, or not alike."""
    own = random.Random(9)
    base = [f"w{own.randrange(10**6)}" for _ in range(60)]
    texts = []
    for _ in range(120):
        w = list(base)
        for k in own.sample(range(0, 60, 8), own.randrange(0, 5)):
            w[k] = f"{k}x{own.randrange(2)}"
        texts.append(" ".join(w))
    texts = sorted(set(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "u long, body string")
    weights = near_dedup.idf(docs, "body")
    held = spark.sparkContext.broadcast(weights)
    n = len(texts)
    pairs = spark.createDataFrame([(0, i, n, i % 3) for i in range(1, n)], "a long, b long, n long, share int")
    met = near_dedup._compare(pairs, docs, held).cache()
    linked = {r.b for r in met.filter("linked").collect()}
    wanted = {(r.a, r.b) for r in near_dedup._open_pairs(met).collect()}
    sets = [(h, c, weights(h)) for _, w in textkit.chunks(pa.array(texts), textkit.FOLDED) for h, c in near_dedup.per_text(w)]
    near = far = 0
    for i in range(1, n):
        for j in range(i + 1, n):
            _, apart = near_dedup._difference(sets[i], sets[j])
            both = float((sets[i][1] * sets[i][2]).sum() + (sets[j][1] * sets[j][2]).sum())
            if apart.sum() <= near_dedup._APART * both:
                near += 1
                assert (i in linked and j in linked) or (i, j) in wanted
            else:
                far += (i, j) in wanted
    assert near > 50 and met.filter("NOT linked").count() > 10
    assert far < near + n * n / 8


def test_a_passage_of_more_words_than_code_points():
    stretch = " ".join(f"w{i}" for i in range(1_200_000))
    machines = substring_dedup._Automata([stretch])
    assert len(machines.parts) > 1
    words = ["other", *stretch.split(" ")[:300_000], "more"]
    gone = machines.locate([x.encode() for x in words])
    # The first piece is found whole, the second is not: it goes on.
    assert not gone[0] and not gone[-1] and gone[1 : substring_dedup.PIECE].all()
