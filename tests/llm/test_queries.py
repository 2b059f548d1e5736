"""The registered queries and the pipeline on small tables with clashing columns, against plain computations."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from fieldquarry.llm import mil, mil_q, pii, pii_q
from fieldquarry.llm.registry import QUERIES

from .test_operators import brute_components, check_packed, slow_ppm, words

TEXTS = "doc_id long, text string, lang string, source string, n_chars long, score double, id string, row int, label string"


def fold(doc):
    return zlib.crc32(str(doc).encode() if doc is not None else b"") % 5


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder, rng = str(tmp_path_factory.mktemp("corpus")), random.Random(17)
    texts = [None, "", " \n ", "One two", "a b c d e"]
    for i in range(70):
        own = words(rng, rng.randrange(3, 120))
        texts.append(" ".join(own) if i % 3 else " ".join(w + "###" for w in own))
    texts += [texts[10], texts[10], texts[12] + " and more", "long words " * 9000, "x" * 20_000]
    rows = [(i, t, "en", "s", len(t or ""), 0.5, "x", 1, "y") for i, t in enumerate(texts)] + [(7, texts[7], "en", "s", 1, None, None, None, None)]
    spark.createDataFrame(rows, TEXTS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    marks = [(i, int("###" not in (t or "")), 0) for i, t in enumerate(texts) if i % 4] + [(3, 0, 1), (None, 1, 0), (9, None, 0)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, [(r[0], r[1]) for r in rows]


def test_op1(spark, corpus):
    folder, rows = corpus
    want = brute_components(rows)
    got = QUERIES["op1_minhash_near_dedup"](spark, folder).collect()
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id) for r in got)


def test_op2(spark, corpus):
    import tiktoken

    from fieldquarry.llm.bpe import load_ranks

    folder, rows = corpus
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {}
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    got = QUERIES["op2_byte_level_bpe"](spark, folder).collect()
    assert len(got) == len(rows) and all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == want[r.doc_id] for r in got)


def plain_score(model, text):
    """The classifier's forward pass for one document, passage by passage and byte by byte."""
    data = (text or "").encode()
    p, h, e = model.p, [], []
    for at in range(0, max(1, len(data)), mil.PASSAGE):
        piece = data[at : at + mil.PASSAGE]
        n = max(1, len(piece))
        kinds = collections.Counter(int(mil._CLASS[b]) for b in piece)
        pairs = collections.Counter((a * 31 + b * 17 + (a ^ b)) % mil.PAIRS for a, b in zip(piece, piece[1:]))
        own = [bytes(sorted(w)) for w in piece.replace(b"\n", b" ").split(b" ") if w]
        many = max(1, len(own))
        same = [sum(own[i] == own[i - lag] for i in range(lag, len(own))) / many for lag in (1, 2, 3)]
        x = [math.sqrt(kinds[c] / n) for c in range(mil.CLASSES)] + [math.sqrt(pairs[c] / n) for c in range(mil.PAIRS)]
        x += [*same, len(set(own)) / many, math.log1p(len(piece) / many), math.log1p(len(piece))]
        z = (np.array(x, np.float32).astype(float) - p["mean"]) / p["sd"]
        h.append(np.tanh(z @ p["W"] + p["b"]))
        e.append(float((np.tanh(h[-1] @ p["V"]) / (1 + np.exp(-(h[-1] @ p["U"])))) @ p["w"]))
    a = np.exp(np.array(e) - max(e))
    return 1 / (1 + math.exp(-((a / a.sum()) @ np.array(h) @ p["c"] + p["d"])))


def test_op5(spark, corpus, monkeypatch):
    monkeypatch.setattr(mil, "BLOCK", 7)
    folder, rows = corpus
    got = QUERIES["op5_quality_classifier"](spark, folder).collect()
    labels = {}
    for r in spark.read.parquet(f"{folder}/labels.parquet").collect():
        if r.doc_id is not None and r.quality is not None and fold(r.doc_id):
            labels[r.doc_id] = max(r.quality, labels.get(r.doc_id, 0))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = mil.learn(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), "doc_id", "text", "quality")
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (fold(r.doc_id) == 0) and r.predicted == int(r.score >= 0.3)
        assert abs(r.score - plain_score(model, texts[r.doc_id])) < 1e-5, r.doc_id
    held = [(r.score, "###" not in texts[r.doc_id]) for r in got if r.held_out and len(texts[r.doc_id] or "") > 100 and r.doc_id < 75]
    pairs = [a > b for a, x in held for b, y in held if x and not y]
    assert len(pairs) > 5 and sum(pairs) >= 0.9 * len(pairs)


def test_training_takes_whole_texts_and_no_label_of_the_held_out(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(78, 0), (6, 1), (7, 1), (8, 1)], "doc_id long, quality int")
    whole = lambda i: max(1, -(-len((dict(rows)[i] or "").encode()) // mil.PASSAGE))
    fit, seen = mil.fit, {}
    mil.fit = lambda x, many, label: seen.update(many=sorted(many.tolist())) or fit(x, many, label)
    try:
        mil.learn(docs, labels, "doc_id", "text", "quality")
        assert seen["many"] == sorted([whole(78), whole(6), whole(7), whole(7), whole(8)]) and seen["many"][-1] > 100  # two rows of document 7
        mil.learn(docs, labels, "doc_id", "text", "quality", train_passages=whole(78) - 1)
        assert seen["many"] == sorted([whole(6), whole(7), whole(7), whole(8)])  # a bag is whole or left out
    finally:
        mil.fit = fit
    marks = spark.read.parquet(f"{folder}/labels.parquet")
    flipped = marks.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in mil_q.scored(docs.select("doc_id", "text"), marks).collect()}
    b = {r.doc_id: r.score for r in mil_q.scored(docs.select("doc_id", "text"), flipped).collect()}
    assert a == b


def test_op6(spark, corpus):
    from tokenizers import Tokenizer

    folder, rows = corpus
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = [r for r in QUERIES["op6_packing"](spark, folder).collect()]
    pieces = collections.Counter((r.doc_id, r.start) for r in got)
    assert pieces[7, 0] == 2 and all(n == 1 for k, n in pieces.items() if k[0] != 7)
    again = max((r.sequence_id, r.offset) for r in got if (r.doc_id, r.start) == (7, 0))
    renamed = [r.asDict() | ({"doc_id": 1007} if r.doc_id == 7 and (r.sequence_id, r.offset) == again else {}) for r in got]
    texts = dict(rows)
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in (texts | {1007: texts[7]}).items()}
    check_packed([collections.namedtuple("R", r)(**r) for r in renamed], want)


def test_op7(spark, corpus):
    folder, rows = corpus
    own = [(i, (t or "").encode().lower().split()) for i, t in rows]
    learnt = [w for i, w in own if fold(i) != 1]
    c = collections.Counter(x for w in learnt for x in w)
    n, v, table = sum(c.values()) + len(learnt), len(c) + 1, {}
    want = {}
    for i, w in own:
        counts = [*(c[y] for y in w), len(learnt)]
        want[i] = (len(w) + 1, sum(x > 0 for x in counts), n, sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in counts), slow_ppm(learnt, w, table))
    got = QUERIES["op7_lm_scoring"](spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(r.doc_id) == 1, *w[:3])
        assert abs(r.base_score - w[3]) < 1e-6 * max(1, -w[3]) and abs(r.score - w[4]) < 1e-6 * max(1, -w[4])


def test_op10(spark, corpus):
    from tokenizers import Tokenizer

    folder, rows = corpus
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want[i] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    got = sorted(QUERIES["op10_token_id_output"](spark, folder).collect(), key=lambda r: r.start)
    assert len(got) == len(rows) and [r.doc_id for r in got] == sorted(i for i, _ in rows)
    start = 0
    for r in got:
        assert r.start == start and (r.n_tokens, r.ids_crc32) == want[r.doc_id]
        start += r.n_tokens


def test_pipeline_keeps_clashing_columns_and_rows_without_text(spark, corpus):
    import corpus_pipeline
    from tokenizers import Tokenizer

    folder, rows = corpus
    spark.conf.set(pii_q.KEY, "own")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, frames = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frames.append(stage(spark, frames[-1], folder))
        assert frames[-1].columns == names and [k for _, k in frames[-1].dtypes] == [k for _, k in docs.dtypes]
    scores = {r.doc_id: r.score for r in QUERIES["op5_quality_classifier"](spark, folder).collect()}
    good = [(i, t) for i, t in rows if scores[i] >= 0.3]
    of = brute_components(good)
    texts = {i: t for i, t in good if of[i][1] == i}
    f = pii.Feistel(b"own")
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {i: library.encode(pii.pseudonymise_text(t or "", f)[0], add_special_tokens=False).ids + [0] for i, t in texts.items()}
    got = corpus_pipeline.run(spark, folder).collect()
    spark.conf.unset(pii_q.KEY)
    assert {r.doc_id for r in got} == set(want)
    for i, ids in want.items():
        assert sum(r.length for r in got if r.doc_id == i) == len(ids) * sum(j == i for j, _ in good)


def test_columns_of_the_results_names_are_replaced(spark):
    from fieldquarry.llm import bpe

    path = P.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.createDataFrame([(1, "one two", "old")], "doc_id long, text string, decoded string")
    ids = bpe.bpe_encode(docs, path, P.PATTERN).withColumn("decoded", F.lit("old"))
    assert bytes(bpe.bpe_decode(ids, path).first().decoded) == b"one two" and bpe.bpe_decode(ids, path).columns == ["doc_id", "ids", "decoded"]
    found = pii.pseudonymise(docs.withColumn("found", F.lit(1)), "k", counts_col="found")
    assert found.columns == ["doc_id", "text", "decoded", "found"] and found.first().found == {}
