"""The text operators against brute force on small tables with awkward rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.llm import chat, line_dedup, near_dedup, packing, quality, secrets, substring_dedup, toxicity
from glimmer.llm import decontaminate as leaks
from glimmer.llm import exact_dedup as exact
from glimmer.llm.components import components

rng = random.Random(3)
WORDS = ["alpha", "béta", "Gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lam", "mu", "nu", "xi", "omi", "pi", "rho", "sig", "tau", "ups", "phi", "chi", "psi", "ome"]


def prose(n: int) -> list[str]:
    return [rng.choice(WORDS) + rng.choice(["", ",", "."]) + str(rng.randrange(40)) for _ in range(n)]


def make_rows() -> list[tuple]:
    base, shared = prose(300), prose(60)
    rows = [(None, "no id"), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (5, "one")]
    for i in range(10, 40):
        rows.append((i, " ".join(prose(rng.randrange(1, 200)))))
    for i in range(40, 52):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(300)] = "changed" + str(rng.randrange(9))
        rows.append((i, " ".join(w)))
    for i in range(52, 60):
        rows.append((i, " ".join(prose(30)) + "\n" + " ".join(shared) + "\n" + " ".join(prose(20))))
    rows += [(60, "x " * 5000), (61, "y" * 100_000), (62, " ".join(base) + " "), (63, " ".join(base))]
    return rows


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns with names that operators use inside.
    return spark.createDataFrame([(i, t, "n", 0, "b") for i, t in ROWS], "doc_id long, text string, id string, row int, body string").repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_exact_dedup(docs, empty):
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_dedup(docs).collect())
    groups = collections.defaultdict(list)
    for i, t in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    want = collections.Counter()
    for n, members in groups.items():
        members.sort()
        for k, (_, _, _, i) in enumerate(members):
            want[i, members[0][3], len(members), k == 0, hashlib.sha256(n.encode()).hexdigest()] += 1
    assert got == want
    assert exact.exact_dedup(empty).count() == 0


def test_substring_dedup(docs, empty):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in ROWS]
    count = collections.Counter(tuple(w[k : k + 35]) for _, w in split for k in range(len(w) - 34))
    want = collections.Counter()
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        want[i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)] += 1
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.substring_dedup(docs).collect())
    assert got == want
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_near_dedup(docs, empty):
    toks = {k: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for k, (_, t) in enumerate(ROWS)}
    sets = {k: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)]) for k, w in toks.items()}
    df = collections.Counter(x for s in sets.values() for x in s)
    n = len(ROWS)
    weight = {x: 1 + math.log((n + 1) / (d + 1)) / math.log(n + 2) for x, d in df.items()}
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            shared = sum(min(c, sets[b][x]) * weight[x] for x, c in sets[a].items() if x in sets[b])
            total = sum(c * weight[x] for s in (sets[a], sets[b]) for x, c in s.items()) - shared
            assert abs(shared / total - 0.8) > 0.002
            if shared >= 0.8 * total:
                parent[find(a)] = find(b)
    members = collections.defaultdict(list)
    for k, (i, _) in enumerate(ROWS):
        members[find(k)].append(i)
    want = collections.Counter()
    for m in members.values():
        low = min((i for i in m if i is not None), default=None)
        for i in m:
            want[i, low, len(m)] += 1
    out = near_dedup.near_dedup(docs).collect()
    assert collections.Counter((r.doc_id, r.class_id, r.class_size) for r in out) == want
    assert sum(r.kept for r in out) == len(members)
    assert near_dedup.near_dedup(empty).count() == 0


def test_near_dedup_of_a_large_group(spark):
    """One group of near copies beyond the size of pairwise buckets, and strangers that share a half."""
    base, half = prose(200), prose(60)
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(200)] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(half + prose(60))) for i in range(60)]
    out = {r.doc_id: r.class_id for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i] == 0 for i in range(60))
    assert all(out[100 + i] == 100 + i for i in range(60))


def test_near_dedup_of_bridged_groups(spark):
    """Two groups of near copies whose texts are alike only through one pair are one class."""
    own = random.Random(11)
    word = lambda: f"{own.choice(WORDS)}{own.randrange(5000)}"
    rows = []
    for family in range(12):
        old, new = [word() for _ in range(420)], [word() for _ in range(420)]
        # Words replaced from the front: 0.63 alike between the groups, 0.85 along the bridge.
        for replaced, copies in ((0, 12), (32, 1), (64, 1), (96, 12)):
            rows += [(family, " ".join([*new[:replaced], *old[replaced:], f"tail{own.randrange(10**9)}"])) for _ in range(copies)]
    rows = [(i, *row) for i, row in enumerate(rows)]
    out = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, family int, text string").select("doc_id", "text")).collect()
    first = {}
    for i, family, _ in rows:
        first.setdefault(family, i)
    assert {r.doc_id: r.class_id for r in out} == {i: first[family] for i, family, _ in rows}


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}


def plain_distance(a: str, b: str) -> int:
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_edit_distance_expression(spark):
    rows = []
    for _ in range(300):
        a = [rng.choice("abcé") for _ in range(rng.randint(0, 25))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, len(b))
            b[i : i + rng.randint(0, 1)] = [rng.choice("abcé")] * rng.randint(0, 1)
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "x string, y string")
    for r in df.withColumn("ok", line_dedup.within(F.col("x"), F.col("y"), 2)).collect():
        assert r.ok == (plain_distance(r.x, r.y) <= 2), (r.x, r.y)


def test_line_dedup(spark, empty):
    line = "the quick brown fox jumps over the lazy dog 1234"
    rows = [(None, line), (1, line + "\nshort\n\nshort"), (2, line.replace("quick", "quack") + "\nshirt"), (3, line[:-4] + "99"), (4, None), (5, ""),
            (6, "another line that is long enough to be compared\n" + line.replace("lazy", "azy")), (7, "x" * 50_000), (7, "x" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, want, earlier = set(), {}, []
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        gone = []
        for k, x in enumerate((t or "").split("\n")):
            if not x.strip(" "):
                continue
            near = any(x != y and min(len(x), len(y)) >= 24 and abs(len(x) - len(y)) <= 2 and plain_distance(x, y) <= 2 for y in earlier)
            if x in seen or near:
                gone.append(k)
            if x not in seen:
                earlier.append(x)
            seen.add(x)
        want[i] = gone
    found = line_dedup.line_dedup(docs)
    assert {r.doc_id: r.removed for r in found.collect()} == want
    cut = {r.doc_id: r.text for r in line_dedup.without_lines(docs, found).collect()}
    assert cut[1] == "short\n" and cut[4] is None and cut[6] == "another line that is long enough to be compared"
    assert line_dedup.line_dedup(empty).count() == 0


def test_decontaminate(spark, docs, empty):
    item = ROWS[20][1].split()
    items = [(1, " ".join(item[3:40])), (1, "one two"), (2, "Theta0, IOTA0"), (3, None), (4, "..."), (None, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    want = collections.Counter()
    for i, t in ROWS:
        w, hit, names = words(t), set(), set()
        for k, s in items:
            v = words(s)
            n = min(10, len(v))
            for a in range(len(v) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[a : a + n]:
                        hit.update(range(p, p + n))
                        names.add("" if k is None else str(k))
        want[i, len(w), len(hit), tuple(sorted(names))] += 1
    for block in (leaks.BLOCK_WORDS, 5):
        got = collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in leaks.decontaminate(docs, bench, block_words=block).collect())
        assert got == want
    assert leaks.decontaminate(empty, bench).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert leaks.decontaminate(docs, none).filter("contaminated").count() == 0


def test_secrets(spark, empty):
    key = hashlib.sha256(b"k").hexdigest()
    rows = [(1, f"é password = \"abcdefghijkl\" and token=short, api_key:{'Z' * 12}"), (2, None), (3, ""), (4, f"AKIA{'A1' * 8} {key[:20]} hex"),
            (5, "see wJalrXUtnFEMIK7MDENGbPxRfiCYzEXAMPLEKEY0 here"), (6, "get_user_account_list_item_by_name_and_status"), (7, "deadbeef" * 2000)]
    ratios = secrets.train(secrets.labelled_samples(spark))
    got = {r.doc_id: r.s for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string"), ratios).select("doc_id", secrets.spelled(F.col("spans")).alias("s")).collect()}
    assert got[1] == "assign:2:26,assign:45:65" and got[2] == got[3] == got[6] == ""
    assert got[4] == "access:0:20,hex:21:41" and got[5] == "markov:4:44" and got[7] == "hex:0:16000"
    assert secrets.secret_spans(empty, ratios).count() == 0
    held = spark.createDataFrame([(hashlib.sha1(str(i).encode()).hexdigest().upper()[:30] + "xQ9",) for i in range(200)], "text string")
    spans = secrets.secret_spans(held.withColumn("doc_id", F.lit(1)), ratios)
    assert spans.filter(F.size("spans") > 0).count() > 180


def test_secrets_short_or_inside_a_path(spark):
    path = "home/user/project/config/service/handler/manager/factory/builder/version/release/"
    rows = [(1, "is xK9qZ2vB7mW4tR8p so"), (2, f"see {path}q7ZkX2vB9mW4tR8pJ3xQ/{path}index/table"), (3, f"see {path}{path}index/table"), (4, "internationalization get_user_name")]
    ratios = secrets.train(secrets.labelled_samples(spark))
    got = {r.doc_id: r.s for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string"), ratios).select("doc_id", secrets.spelled(F.col("spans")).alias("s")).collect()}
    assert got == {1: "markov:3:19", 2: f"markov:4:{len(rows[1][1])}", 3: "", 4: ""}


def test_chat(spark):
    texts = ["</s>[INST] ok [/INST]", "<|turn|>a<|sep|>\\<|end|>\n", "\\\\<s>\\", "<", "", None, "é\n[INST", "<<SYS>> x <</SYS>>"]
    rows = [(c, t, "assistant" if t % 2 else "user", x) for c in (1, 2) for t, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = df.select("conv_id", "turn", F.to_variant_object(F.struct("role", "text")).alias("record"))
    out = chat.format_chat(records).select("*", chat.parsed_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("l")).collect()
    for r in out:
        assert [(x.role, x.text) for x in r.t] == [("assistant" if k % 2 else "user", x or "") for k, x in enumerate(texts)]
        assert r.l == "".join(x or "" for k, x in enumerate(texts) if k % 2)
        assert len(r.formatted.split("<|turn|>")) == len(texts) + 1
    layouts = ['{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}', '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}',
               '{"instruction":"a","output":"b"}', '{"prompt":"a","response":"b"}', '{"question":"a","answer":"b"}', '{"instruction":"a","input":"","output":"b"}', '{"odd":1}']
    df = spark.createDataFrame([(i, 0, x) for i, x in enumerate(layouts)], "conv_id long, turn long, j string").select("conv_id", "turn", F.parse_json("j").alias("record"))
    for r in chat.format_chat(df).select("*", chat.parsed_turns(F.col("formatted")).alias("t")).collect():
        assert [(x.role, x.text) for x in r.t] == ([("user", "a"), ("assistant", "b")] if r.conv_id < 6 else [])
        assert r.n_unmapped == (r.conv_id == 6)


def test_packing(docs, empty):
    out = packing.pack(docs, buckets=4, budget=500).collect()
    assert len(out) == len(ROWS)
    batches = collections.defaultdict(list)
    for r in out:
        assert r.n_tokens <= r.bucket_len and r.slot < r.batch_rows
        batches[r.batch].append(r)
    for b in batches.values():
        assert len({r.bucket_len for r in b}) == 1 and (len(b) == 1 or len(b) * b[0].bucket_len <= 500)
        assert sorted(r.slot for r in b) == list(range(len(b)))
    assert packing.pack(empty).count() == 0


def test_boundaries_are_optimal():
    from itertools import combinations

    lengths = sorted(rng.sample(range(1, 60), 9))
    counts = np.array([rng.randrange(1, 9) for _ in lengths])
    longest = np.array(lengths)

    def padding(ends):
        return sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts))

    got = padding(packing.boundaries(longest, counts, longest * counts, 3))
    assert got == min(padding((*e, lengths[-1])) for e in combinations(lengths[:-1], 2))


def test_quality(spark, empty):
    good = [" ".join(prose(120)) for _ in range(200)]
    bad = [" ".join(w + "$$$" for w in prose(100)) for _ in range(15)] + [" ".join(["Same"] * 100) for _ in range(15)] + [" ".join(prose(60)).upper() + "!!" for _ in range(15)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(900, None), (901, ""), (902, "x" * 90_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    w = quality.train(df)
    out = {r.doc_id: r.kept for r in quality.score(df, w).collect()}
    assert all(out[i] for i in range(200)) and sum(out[200 + i] for i in range(45)) <= 2 and not out[900] and not out[901]
    assert quality.keep_good(df, w).columns == ["doc_id", "text"]
    assert quality.score(empty, quality.train(empty)).count() == 0


def test_toxicity(spark, empty):
    rows, labels = [], []
    for i in range(800):
        t = prose(80)
        bad = i % 8 == 0
        if bad:
            t[rng.randrange(80)] = rng.choice(["Blargh", "snark" + rng.choice(WORDS), "FRUMP"])
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    rows += [(9000, None), (9001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, known.filter("doc_id < 600 OR doc_id IS NULL"))
    out = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    held = [(out[i], y) for i, y in labels if i >= 600]
    assert sum(p == y for p, y in held) >= 0.97 * len(held) and out[9000] == out[9001] == 0
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, nothing)).filter("predicted = 1").count() == 0


def test_toxicity_of_rare_words(spark):
    """A toxic word that few rows have counts also where over 2,000 candidates are more frequent."""
    own = random.Random(5)
    letters = lambda: "".join(own.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    usual, bad = [letters() for _ in range(300)], [letters() for _ in range(2500)]
    text = lambda *more: " ".join([*own.sample(usual, 20), *more])
    deck = [w for _ in range(10) for w in own.sample(bad, len(bad))]
    rows = [(text(*deck[50 * i : 50 * i + 50]), 1) for i in range(500)]
    rows += [(text("zqxjkvbrw"), 1) for _ in range(6)] + [(text(), 0) for _ in range(3000)]
    t = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, toxic int").cache()
    model = toxicity.train(t.select("doc_id", "text"), t.select("doc_id", "toxic"))
    out = {r.doc_id: r.predicted for r in toxicity.score(t.select("doc_id", "text"), model).collect()}
    assert [out[i] for i in range(500, 506)] == [1] * 6
    assert sum(out[i] for i in range(506, 3506)) == 0
