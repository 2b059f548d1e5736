"""Token counts, the conversation trie and whitening against the library and brute force, on tables with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece

from fieldquarry.llm import conversations, radix, transducer, whitening
from fieldquarry.llm.registry import QUERIES

MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts():
    rng = random.Random(3)
    letters = " ▁aeinth\n\t  é漢字ゼ😀\x00<>0x41s/Ａ.,"
    texts = [None, "", " ", "  ", "a", "▁", "a▁b", "<s>hi</s><unk>", "aaaa" * 500, " " * 3000, "=" * 2000, "漢字" * 900, "ab " * 1000, "\r\n", "word " * 30_000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    return texts + ["".join(rng.choice("ehtinaors") for _ in range(3000)) for _ in range(5)]


def test_transducer_counts_as_the_library(library):
    texts = odd_texts()
    want = [len(library.encode(t or "")) for t in texts]
    one = transducer.Transducer(transducer.read_model(MODEL), transitions=2000)  # forgets between batches
    assert one.counts(pa.array(texts)).tolist() == want
    assert one.counts(pa.array(texts[::-1])).tolist() == want[::-1]
    assert one.counts(pa.array([], pa.string())).tolist() == [] and one.counts(pa.array([None, ""], pa.string())).tolist() == [0, 0]


def test_chunks_compose_whatever_their_first_guess(library):
    one = transducer.machine(MODEL)
    rng = random.Random(5)
    for text in ("a" * 700, "=" * 999, " " * 800, "".join(rng.choice("ehtinaors") for _ in range(2000)), "ab " * 300):
        symbols = np.append([0, one.space], one.symbol[[ord(c) for c in text]]).astype(np.uint16)
        for chunk, warm in ((7, 1), (16, 3), (64, 8), (4096, 32)):
            assert one.changes(symbols, chunk, warm).sum() == len(library.encode(text)), (text[:5], chunk)


def test_other_models_are_refused(tmp_path):
    (tmp_path / "m").write_bytes(b"\x0a\x08\x0a\x01a\x15\x00\x00\x00\x00")
    with pytest.raises(ValueError):
        transducer.read_model(str(tmp_path / "m"))


def test_op11(spark, tmp_path, library):
    texts = odd_texts()
    rows = [(i, t, 1, True) for i, t in enumerate(texts)] + [(None, "no id", 1, True), (3, texts[8], 1, True), (3, texts[8], 1, True)]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, over_limit boolean").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_token_counts"](spark, str(tmp_path)).collect()
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t, *_ in rows]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key) and any(r.over_limit for r in got)
    assert transducer.token_counts(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []


def trie(rows):
    """The contract's nodes, by plain dictionaries."""
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        kids = [k for k in members if len(k) == len(node) + 1 and k[: len(node)] == node]
        n = len(members[node])
        saved = (n - 1) * len(node[-1][1].encode()) if node else 0
        ends = ",".join(map(str, sorted(c for c in members[node] if full[c] == node)))
        out[node] = (min(members[node]), len(node), min(members[node[:-1]]) if node else None, n, len(kids), sum(out[k][5] for k in kids) or 1, saved + sum(out[k][6] for k in kids), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values())


def talks():
    rng = random.Random(11)
    rows = []
    for c in range(120):
        for t in range(rng.randrange(0, 12)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hello", "é ü", "", None, "bye"]) if t < 4 else f"own {c} {t}"))
    rows += [(c, t, "user", f"same {t}") for c in range(200, 260) for t in range(5)]  # a hot conversation
    rows += [(300, None, "b", "x"), (300, None, "a", "y"), (300, 1, "a", "z"), (300, 1, "a", "z"), (None, 1, "a", "lost"), (301, 0, "user", "long " * 5000)]
    rows += [(302, t, "user", str(t)) for t in range(400)]
    return rows


def test_trie_in_one_block_and_in_many(spark):
    rows = talks()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, depth int").repartition(3)
    want = trie(rows)
    keys = conversations.rebuilt(frame, 5, 9).cache()
    for least, size in ((64, 32 << 20), (8, 1)):
        got = sorted(map(tuple, conversations.prefix_trie(keys, least, size).collect()))
        assert got == want, (least, size)
    assert conversations.prefix_trie(conversations.rebuilt(frame.limit(0), 5, 9)).collect() == []


def test_op12(spark, tmp_path):
    rows = talks()
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(map(tuple, QUERIES["op12_conversation_trie"](spark, str(tmp_path)).collect())) == trie(rows)


def test_radix_layouts_grow_and_paths_split():
    rng = random.Random(2)
    keys = [bytes(rng.randrange(b) for _ in range(rng.randrange(0, 7))) for b in (2, 5, 17, 49, 256) for _ in range(600)]
    tree = radix.Tree()
    for i, k in enumerate(keys):
        tree.insert(k, i)
    seen, kinds, stack = [], set(), [(tree.root, b"")]
    while stack:
        node, key = stack.pop()
        key += node.path
        seen += [(key, i) for i in node.ends]
        if node.children:
            kinds.add((type(node.children).__name__, getattr(node.children, "room", 0)))
            nodes = list(node.children.items())
            assert [b for b, _ in nodes] == sorted(n.path[0] for _, n in nodes) and all(node.children.get(b) is n for b, n in nodes)
            stack += [(n, key) for _, n in nodes]
    assert sorted(seen) == sorted((k, i) for i, k in enumerate(keys))
    assert kinds >= {("Few", 4), ("Few", 16), ("Indexed", 0), ("Direct", 0)}


def plain_whitening(vectors, k=32):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n = len(x)
    c = n * x - x.sum(axis=0)
    values, axes = np.linalg.eigh((c / n).T @ (c / n) / n)
    values, axes = values[::-1], axes[:, ::-1]
    kept = int((values[:k] > values[0] * 1e-11).sum())
    return (c * c).sum(axis=1), (c / n) @ (axes[:, :kept] / np.sqrt(values[:kept])), values[:kept] / values.sum()


def test_whitening(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(whitening, "HOT", 3)
    rng = np.random.default_rng(1)
    hot, odd = [0.25] * 6, [None, [], [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [1.0, 2.0]]
    good = [v.tolist() for v in rng.normal(0, 1, (60, 6)) * [5, 4, 3, 2, 1, 0.5]] + [hot] * 40
    rows = [(i % 90 if i else None, v, 1, "x") for i, v in enumerate(good)] + [(1000 + i, v, 1, "x") for i, v in enumerate(odd)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int, n string").repartition(3)
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    deviation, whitened, explained = plain_whitening(good)
    got = QUERIES["op13_embedding_whitening"](spark, str(tmp_path)).collect()
    assert len(got) == len(good) * 6 and {(r.n, r.identity_error) for r in got} == {(len(good), got[0].identity_error)} and got[0].identity_error < 1e-9
    for j in range(6):
        own = sorted((-1 if r.vec_id is None else r.vec_id, r.deviation, r.whitened) for r in got if r.component == j + 1)
        want = sorted((-1 if i is None else i, d, w) for (i, *_), d, w in zip(rows, deviation.tolist(), whitened[:, j].tolist()))
        flipped = sorted((a, b, -w) for a, b, w in want)
        assert [x[:2] for x in own] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in own], [x[2] for x in want], atol=1e-9) or np.allclose([x[2] for x in own], [x[2] for x in flipped], atol=1e-9)
    assert np.allclose(sorted({(r.component, r.explained) for r in got}), list(enumerate(explained, 1)), atol=1e-12)


def test_whitening_without_variance_and_of_few_rows(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == [] and whitening.whiten(spark.createDataFrame([(1, None)], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect() == []
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 2.0]), (3, [3.0, 2.0])], kind)).collect()
    assert len(got) == 3 and abs(got[0].explained - 1) < 1e-12
    with pytest.raises(OverflowError):
        whitening.whiten(spark.createDataFrame([(1, [1e17]), (2, [-1e17])], "vec_id long, embedding array<double>")).collect()
