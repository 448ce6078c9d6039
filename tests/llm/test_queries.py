"""Registered queries and pipeline stages against brute force, and awkward rows: clashing columns,
repeated rows, ties, other partitions."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glimmer.llm import chat, exact_dedup, line_dedup, packing, quality, secrets, toxicity
from glimmer.llm import decontaminate as leaks
from glimmer.llm import queries as Q

SMALL = "/root/testdata/sf0.001"
own = random.Random(17)
VOWELS = ["ta", "re", "mi", "so", "la", "pe", "nu", "ki", "do", "va"]


def word() -> str:
    return "".join(own.choice(VOWELS) for _ in range(own.randrange(1, 5)))


def prose(n: int) -> str:
    return " ".join(word() + own.choice(["", "", "", ",", "."]) for _ in range(n))


def test_secrets_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    want = {}
    for r in docs:
        t = r.text or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 16]
        n = collections.Counter(k for _, k, _ in spans)
        spelled = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        want[r.doc_id] = (n[0], n[1], n[2], hashlib.sha256(spelled.encode()).hexdigest())
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in Q.op6_secrets(spark, SMALL).collect()}
    assert got == want


def test_toxicity_query(spark):
    found = Q.op2_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic"), "doc_id")
    held = [(r.toxic, r.predicted) for r in found.filter("held_out").collect()]
    # One label in ten has no sign in the text.
    assert sum(p for y, p in held if y) >= 0.85 * sum(y for y, _ in held) and sum(p for y, p in held if not y) <= 0.01 * len(held)


def test_quality_query(spark):
    found = Q.op7_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality"), "doc_id").collect()
    assert np.mean([r.kept for r in found if r.quality]) >= 0.99 and np.mean([r.kept for r in found if not r.quality]) <= 0.05


@pytest.mark.parametrize("parts", [1, 7])
def test_scores_depend_on_the_text_alone(spark, parts):
    texts = ["same", "same same!", "!ends", "NEXT same", "", None, "a b c", "same", "plain words here"] * 3
    rows = spark.createDataFrame([(i, t, 1.5, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, score double, key string, body string")
    h = np.unique([v for _, w in _chunks(["same plain"]) for v in w.hashes[0].tolist()]).astype(np.uint64)
    model = toxicity.Model(h, np.array([1.0, -0.5, 2.0, -1.0, 3.0, 0.1]))
    scores = collections.defaultdict(set)
    for r in toxicity.score(rows.repartition(parts), model).collect():
        scores[texts[r.doc_id] or ""].add(r.score)
    assert all(len(s) == 1 for s in scores.values()) and len({min(s) for s in scores.values()}) >= 4
    weights = np.linspace(-1, 1, quality.WIDTH + 1)
    scores.clear()
    for r in quality.score(rows.repartition(parts), weights).collect():
        scores[texts[r.doc_id] or ""].add(r.score)
    assert all(len(s) == 1 for s in scores.values())


def _chunks(texts):
    import pyarrow as pa

    from glimmer.llm import textkit

    return textkit.chunks(pa.array(texts), textkit.FOLDED)


def test_repeated_ids_do_not_enlarge_the_sample(spark):
    rows = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "vile"), (3, "vile too"), (4, "vile you"), (5, "vile it")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 0), (2, 1), (3, 1), (4, 1), (5, 1)], "doc_id long, toxic int")
    assert len(toxicity.train(rows, labels).weights) >= 1


def test_quality_of_a_loop(spark):
    """A phrase of ten ordinary words over and over is junk, at any length."""
    good = [prose(own.randrange(60, 400)) for _ in range(300)]
    loops = [" ".join([prose(10)] * own.choice([8, 30, 400])) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(good + loops)), "doc_id long, text string")
    out = {r.doc_id: r.kept for r in quality.score(rows, quality.train(rows)).collect()}
    assert sum(out[i] for i in range(300)) >= 297 and sum(out[300 + i] for i in range(40)) <= 2


def test_fingerprints_of_nested_layouts(spark):
    odd = ['{"messages":[{"content":"a"}],"role":"user"}', '{"conversations":[{"from":"human"}],"value":"x"}', '{"a":{"b":1},"c":2}', '{"a":{"b":1,"c":2}}']
    rows = spark.createDataFrame([(i, 0, x, "f") for i, x in enumerate(odd)], "conv_id long, turn long, j string, formatted string")
    rows = rows.select("conv_id", "turn", F.parse_json("j").alias("record"), "formatted", F.lit(1).alias("turns"))
    assert len({r.p for r in rows.select(chat.field_paths(F.col("record")).alias("p")).collect()}) == 4
    assert all(r.n_unmapped == 1 and r.formatted == "" for r in chat.format_chat(rows).collect())


def test_chat_keeps_roles_of_canonical_turns(spark):
    rows = spark.createDataFrame([(1, 0, "human", "x"), (1, 1, "gpt", "y"), (1, 1, "gpt", "y")], "conv_id long, turn long, role string, text string")
    out = chat.format_chat(rows.select("conv_id", "turn", F.to_variant_object(F.struct("role", "text")).alias("record")))
    (r,) = out.select(chat.parsed_turns(F.col("formatted")).alias("t"), "loss").collect()
    assert [(x.role, x.text) for x in r.t] == [("human", "x"), ("gpt", "y"), ("gpt", "y")] and r.loss == []
    assert chat.format_chat(rows.limit(0).select("conv_id", "turn", F.parse_json("text").alias("record"))).count() == 0


@pytest.mark.parametrize("block", [20, 100_000])
def test_decontamination_in_blocks(spark, block):
    items = [(k, prose(25)) for k in range(6)] + [(6, "one, two"), (7, None), (None, prose(12)), (8, ",".join(["q"] * 30))]
    docs = [(k, prose(20) + " " + (items[k % 6][1] or "") + " " + prose(5)) for k in range(12)]
    docs += [(3, docs[3][1]), (None, items[8][1]), (20, None), (21, "One two!"), (22, "q " * 12), (23, "")]
    d = spark.createDataFrame([(i, t, "k", 0, 1) for i, t in docs], "doc_id long, text string, key string, n int, sig int")
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    want = collections.Counter()
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for item, u in items:
            v = words(u)
            k = min(10, len(v))
            for a in range(len(v) - k + 1 if k else 0):
                for s in range(len(w) - k + 1):
                    if w[s : s + k] == v[a : a + k]:
                        hit.update(range(s, s + k))
                        names.add("" if item is None else str(item))
        want[i, len(w), len(hit), tuple(sorted(names))] += 1
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in leaks.decontaminate(d, b, block_words=block).collect())
    assert got == want


def test_unequal_texts_of_one_digest(spark, monkeypatch):
    """Where a group's bytes differ, it is parted."""
    rows = spark.createDataFrame([(1, "a b"), (2, "ab "), (3, "c"), (4, "c")], "doc_id long, text string")
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("00" * 16))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(rows).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 2), 4: (3, 2)}


@pytest.fixture(scope="module")
def awkward(spark):
    """Documents with the columns of the table and others that operators use inside."""
    line, passage, item = prose(12), prose(60), prose(14)
    texts = [f"{prose(40)}\n{line}\n{prose(30)}" for _ in range(20)] + [passage, passage + " more", f"{prose(20)} {item} {prose(20)}", None, "", " \n ", "x" * 30_000]
    texts += [" ".join(w + "$$$" for w in prose(60).split()) for _ in range(6)]
    rows = [(i, t, "en", "s", None if t is None else len(t), 1, "r", True) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, prose(50), None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _i int, _r string, kept boolean").cache()
    return docs, item


def test_stages(spark, awkward, tmp_path):
    docs, item = awkward
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = lambda df: collections.Counter(tuple(r) for r in df.collect())
    stage = dict(corpus_pipeline.STAGES)
    # Quality: the rows the scorer keeps, unchanged.
    good = stage["quality"](spark, docs, str(tmp_path))
    kept = {r.doc_id for r in quality.score(docs, quality.train(docs)).filter("kept").collect()}
    assert rows(good) == collections.Counter({r: n for r, n in rows(docs).items() if r[0] in kept}) and good.columns == docs.columns
    # Lines: of equal ones the first stays, by id, then text.
    cut = stage["line_dedup"](spark, docs, str(tmp_path))
    found = {(r.doc_id, r.r): r.removed for r in line_dedup.line_dedup(docs).collect()}
    hashed = docs.select("*", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("h")).collect()
    want = collections.Counter()
    for r in hashed:
        gone = set(found[r.doc_id, r.h])
        t = r.text if not gone else "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone)
        want[(r.doc_id, t, r.lang, r.source, len(t or ""), *tuple(r)[5:8])] += 1
    assert rows(cut) == want
    assert sum("\n" in (r[1] or "") for r in rows(cut).elements()) >= 20
    # Near copies: one of the two passages, one of the repeated rows, one of the empty texts.
    one = rows(stage["near_dedup"](spark, docs, str(tmp_path)))
    assert sum(n for r, n in one.items() if r[0] in (20, 21)) == 1 and sum(n for r, n in one.items() if r[0] in (23, 24, 25)) == 1
    assert set(range(20)) <= {r[0] for r in one} and None in {r[0] for r in one}
    # Leaks: the document with the item goes, nothing else.
    clean = rows(stage["decontaminate"](spark, docs, str(tmp_path)))
    assert clean == collections.Counter({r: n for r, n in rows(docs).items() if r[0] != 22})
    # Packing: every row once.
    packed = collections.Counter(r.doc_id for r in stage["packing"](spark, docs, str(tmp_path)).collect())
    assert packed == collections.Counter(r.doc_id for r in docs.collect())
    assert packing.pack(docs.limit(0)).count() == 0


def test_stages_on_an_empty_table(spark, awkward, tmp_path):
    docs, item = awkward
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_secrets_of_repeated_rows_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "token=abcdefghijklmnop", "b", 0)] * 3, "doc_id long, text string, body string, id int")
    out = secrets.secret_spans(rows, secrets.train(secrets.labelled_samples(spark, rows))).collect()
    assert len(out) == 3 and len({str(r.spans) for r in out}) == 1
