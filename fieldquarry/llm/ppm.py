"""Language-model scores by prediction by partial matching over bytes.

A document is its lower-cased words joined by single spaces, then a line feed, which no word holds: the end. The trie's
deepest nodes are (context of ``ORDER`` bytes, next byte) with counts gathered from the training documents; shorter
contexts' counts follow by summing. A byte is coded in the longest context that the trie has: with n and d, the
context's total and number of different bytes, a byte seen c times there has probability c / (n + d), and the escape to
the next shorter context d / (n + d) (method C). After an escape, bytes that the longer context knew are excluded, from
n and d of the shorter one too; below the empty context the bytes left are equally likely. A document's score is the
sum of its bytes' log10 probabilities.

A model of at most ``NODES`` deepest nodes goes to all executors whole. Of a larger one all nodes stay in written tables:
the most counted ones' probabilities go to all executors, and the other byte and context pairs of the documents are joined.

Beside it stands a unigram model of words, exact over the whole corpus: frequent words, at most ``FREQUENT``, go to all
executors; all other words are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, materialise, slices

ORDER = 5
#: Deepest nodes and words that are sent to all executors at most, the most counted first; all others are joined.
NODES, FREQUENT = 1 << 20, 1 << 17

_U = np.uint64
_BITS = 8 * (ORDER + 1)


def plain_bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """(bytes of all documents, each after ``ORDER`` line feeds; where each ends; words of each)."""
    words = [(t or "").encode("utf-8").lower().split() for t in texts]
    parts = [b"\n" * ORDER + b" ".join(w) + b"\n" for w in words]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), words


def gram_keys(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context and byte as one integer for each coded byte, where each document's end)."""
    n = len(data) - ORDER
    keys = np.zeros(max(n, 0), _U)
    for k in range(ORDER + 1):
        keys = keys << _U(8) | data[k : k + n].astype(_U)
    starts = np.append(0, ends[:-1])
    keep = np.ones(n, bool)
    for k in range(ORDER):  # keys that would begin in the document before
        late = starts[1:] - ORDER + k
        keep[late[(late >= 0) & (late < n)]] = False
    return keys[keep], ends - ORDER * np.arange(1, len(ends) + 1)


def count_grams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram long, n long): how often each context and byte occur; each task sends every gram once for some MB of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, index = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(index, np.concatenate([n for _, n in held])).astype(np.int64)

        for batch in slices(batches, "text", 4 << 20):
            data, ends, _ = plain_bytes(batch.column(0).to_pylist())
            held.append(np.unique(gram_keys(data, ends)[0], return_counts=True))
            if sum(len(k) for k, _ in held) > 2_000_000:
                held = [merged()]
                if len(held[0][0]) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].astype(np.int64)), pa.array(held[0][1])], names=["gram", "n"])
                    held = []
        if held:
            keys, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], names=["gram", "n"])

    grams = in_batches(docs.select(F.col(text_col).cast("string").alias("text")), run, "gram long, n long")
    return grams.groupBy("gram").agg(F.sum("n").alias("n"))


def at_most(counts: DataFrame, n_col: str, bound: int) -> int:
    """The least count so that at most ``bound`` rows have as many, by a histogram of at most a thousand steps."""
    step = F.floor(F.log2(n_col) * 16)
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows"), F.min(n_col).alias("lo"), F.max(n_col).alias("hi")).collect()
    seen = 0
    for r in sorted(steps, key=lambda r: -r.step):
        seen += r.rows
        if seen > bound:
            return r.hi + 1
    return 1


class Values:
    """A hash table of log probabilities by key."""

    def __init__(self, keys: np.ndarray, value: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.slots = np.full(1 << self.bits, 2**64 - 1, _U)
        self.values = np.zeros(1 << self.bits)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(todo):
            free = self.slots[slot] == _U(2**64 - 1)
            self.slots[slot[free]] = keys[todo[free]]  # of several for one slot the last stays
            won = self.slots[slot] == keys[todo]
            self.values[slot[won]] = value[todo[won]]
            todo, slot = todo[~won], slot[~won] + 1 & (1 << self.bits) - 1
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _U(0x9E3779B97F4A7C15) >> _U(64 - self.bits)).astype(np.int64)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """Each key's value, nan where there is none."""
        slot = self._slot(keys)
        there = self.slots[slot]
        out = self.values[slot]
        todo = np.flatnonzero(there != keys)
        slot, there = slot[todo], there[todo]
        out[todo] = np.nan
        for _ in range(self.probes):
            on = there != _U(2**64 - 1)  # an empty slot ends a search
            todo, slot = todo[on], slot[on] + 1 & (1 << self.bits) - 1
            if not len(todo):
                break
            there = self.slots[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            todo, slot, there = todo[~hit], slot[~hit], there[~hit]
        return out


class Trie(Values):
    """Sorted arrays of nodes and contexts for each order, and a hash table of the deepest nodes' log probabilities."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        by = np.argsort(grams)
        keys, counts = grams[by].astype(_U), n[by].astype(np.float64)
        self.nodes, self.counts, self.contexts, self.n, self.d = {}, {}, {}, {}, {}
        for k in range(ORDER, -1, -1):
            if k < ORDER:
                keys, index = np.unique(keys & _U((1 << 8 * (k + 1)) - 1), return_inverse=True)
                counts = np.bincount(index, counts, minlength=len(keys))
            self.nodes[k], self.counts[k] = keys, counts
            self.contexts[k], index = np.unique(keys >> _U(8), return_inverse=True)
            self.n[k] = np.bincount(index, counts, minlength=len(self.contexts[k]))
            self.d[k] = np.bincount(index, minlength=len(self.contexts[k])).astype(np.float64)
        # of each context of order k: n and d that are left in its suffix once its own bytes are excluded there
        self.left_n, self.left_d = {}, {}
        for k in range(1, ORDER + 1):
            own = np.searchsorted(self.contexts[k], self.nodes[k] >> _U(8))
            suffix = np.searchsorted(self.nodes[k - 1], self.nodes[k] & _U((1 << 8 * k) - 1))
            known = np.bincount(own, self.counts[k - 1][suffix], minlength=len(self.contexts[k]))
            parent = np.searchsorted(self.contexts[k - 1], self.contexts[k] & _U((1 << 8 * (k - 1)) - 1))
            self.left_n[k] = self.n[k - 1][parent] - known
            self.left_d[k] = self.d[k - 1][parent] - self.d[k]
        keys = self.nodes[ORDER]
        own = np.searchsorted(self.contexts[ORDER], keys >> _U(8))
        super().__init__(keys, np.log10(self.counts[ORDER] / (self.n[ORDER] + self.d[ORDER])[own]) if len(keys) else np.empty(0))

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """The log10 probability of each key's byte in its context."""
        out = super().log10(keys)
        todo = np.flatnonzero(np.isnan(out))
        if len(todo):
            short, index = np.unique(keys[todo], return_inverse=True)
            out[todo] = self._escaped(short)[index]
        return out

    @staticmethod
    def _of(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        return values[at] if len(values) else np.zeros(len(at))

    def _escaped(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        live = np.arange(len(keys))
        longer = np.full(len(keys), -1)  # the context one byte longer that was escaped from
        for k in range(ORDER, -1, -1):
            ctx = keys[live] >> _U(8) & _U((1 << 8 * k) - 1)
            own = np.minimum(np.searchsorted(self.contexts[k], ctx), max(len(self.contexts[k]) - 1, 0))
            there = self.contexts[k][own] == ctx if len(self.contexts[k]) else np.zeros(len(live), bool)
            from_longer = longer >= 0
            n, d = self._of(self.n[k], own), self._of(self.d[k], own)
            if k < ORDER:
                n, d = np.where(from_longer, self._of(self.left_n[k + 1], longer), n), np.where(from_longer, self._of(self.left_d[k + 1], longer), d)
            node = keys[live] & _U((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(self.nodes[k], node), max(len(self.nodes[k]) - 1, 0))
            found = there & (self.nodes[k][at] == node) if len(self.nodes[k]) else np.zeros(len(live), bool)
            out[live[found]] += np.log10(self.counts[k][at[found]] / (n + d)[found])
            escaped = there & ~found & (d > 0)
            out[live[escaped]] += np.log10((d / np.maximum(n + d, 1))[escaped])
            longer = np.where(there, own, -1)[~found]
            live = live[~found]
            if not len(live):
                return out
        known = self.d[0][0] if len(self.d[0]) else 0
        out[live] -= np.log10(256 - known)
        return out


class Nodes:
    """The trie of all grams as written tables: nodes (key, c) and contexts (ctx, n, d, left_n, left_d) for each order.

    Keys are counted before they are joined, and a key has at most 256 that are longer by one byte, so no group is hot.
    """

    def __init__(self, grams: DataFrame):
        self.nodes, self.contexts = {ORDER: grams.select(F.col("gram").alias("key"), F.col("n").alias("c"))}, {}
        for k in range(ORDER - 1, -1, -1):
            self.nodes[k] = materialise(self.nodes[k + 1].groupBy(_low("key", k + 1).alias("key")).agg(F.sum("c").alias("c")), "lm-nodes")
        for k in range(ORDER + 1):
            own = self.nodes[k].groupBy(F.shiftright("key", 8).alias("ctx")).agg(F.sum("c").alias("n"), F.count("*").alias("d"))
            if k:
                suffix = self.nodes[k - 1].select(F.col("key").alias("short"), F.col("c").alias("known"))
                known = self.nodes[k].select(F.shiftright("key", 8).alias("ctx"), _low("key", k).alias("short")).join(suffix, "short").groupBy("ctx").agg(F.sum("known").alias("known"))
                parent = self.contexts[k - 1].select(F.col("ctx").alias("short"), F.col("n").alias("all_n"), F.col("d").alias("all_d"))
                own = own.join(known, "ctx").withColumn("short", _low("ctx", k - 1)).join(parent, "short")
                own = own.select("ctx", "n", "d", (F.col("all_n") - F.col("known")).alias("left_n"), (F.col("all_d") - F.col("d")).alias("left_d"))
            self.contexts[k] = materialise(own, "lm-contexts")
        first = self.contexts[0].first()
        self.bytes_known = first.d if first else 0

    def seen(self) -> DataFrame:
        """(gram, n, value) of every deepest node."""
        value = F.log10(F.col("c") / (F.col("n") + F.col("d")))
        return self.nodes[ORDER].withColumn("ctx", F.shiftright("key", 8)).join(self.contexts[ORDER], "ctx").select(F.col("key").alias("gram"), F.col("c").alias("n"), value.alias("value"))

    def unseen(self, grams: DataFrame) -> DataFrame:
        """(gram, value) of distinct grams that aren't deepest nodes."""
        keys = grams.select(F.col("gram").alias("key"), F.shiftright("gram", 8).alias("ctx"))
        top = self.contexts[ORDER].select("ctx", F.log10(F.col("d") / (F.col("n") + F.col("d"))).alias("escape"))
        out = keys.join(self._after(ORDER, keys.select("key")), "key").join(top, "ctx", "left")
        return out.select(F.col("key").alias("gram"), (F.coalesce("escape", F.lit(0.0)) + F.col("value")).alias("value"))

    def _after(self, k: int, keys: DataFrame) -> DataFrame:
        """(key, value) of distinct keys that aren't nodes of order k: what the shorter contexts give them."""
        if k == 0:
            return keys.select("key", F.lit(-float(np.log10(256 - self.bytes_known)) if self.bytes_known < 256 else 0.0).alias("value"))
        short = keys.select(_low("key", k).alias("key")).distinct().join(self.nodes[k - 1], "key", "left").withColumn("ctx", F.shiftright("key", 8))
        short = materialise(short.join(self.contexts[k - 1].select("ctx", "n", "d"), "ctx", "left").select("key", "c", "n", "d"), "lm-short")
        below = self._after(k - 1, short.filter("c is null").select("key"))
        short = short.join(below, "key", "left").select(F.col("key").alias("short"), "c", "n", "d", F.col("value").alias("below"))
        left = self.contexts[k].select("ctx", "left_n", "left_d")
        met = keys.select("key", F.shiftright("key", 8).alias("ctx"), _low("key", k).alias("short")).join(left, "ctx", "left").join(short, "short")
        n, d = F.coalesce("left_n", "n"), F.coalesce("left_d", "d")  # without the bytes of the context one byte longer, if there is one
        escape = F.when(d > 0, F.log10(d / (n + d))).otherwise(0.0)
        return materialise(met.select("key", F.when(F.col("c").isNotNull(), F.log10(F.col("c") / (n + d))).otherwise(escape + F.col("below")).alias("value")), "lm-after")


def _low(column: str, size: int) -> "F.Column":
    """The last ``size`` bytes of a key."""
    return F.col(column).bitwiseAND(F.lit((1 << 8 * size) - 1).cast("long"))


def _frequent(counts: DataFrame, bound: int) -> tuple[dict[bytes, int], int]:
    least = at_most(counts, "c", bound)
    got = counts.filter(F.col("c") >= least).toArrow()
    return dict(zip(got["word"].to_pylist(), got["c"].to_pylist())), least


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word binary, c long) of all lower-cased words; each task sends a word once for every 300,000 different ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

        for batch in slices(batches, "text", 2 << 20):
            for text in batch.column(0).to_pylist():
                counts.update((text or "").encode("utf-8").lower().split())
            if len(counts) > 300_000:
                yield sent()
                counts.clear()
        if counts:
            yield sent()

    return in_batches(docs.select(F.col(text_col).cast("string").alias("text")), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def score_documents(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", nodes: int = NODES, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` is a column expression that marks the rows to learn from. Tokens are words and one end for each document.
    base_score sums log10((c + 0.5) / (N + 0.5 (V + 1))) over tokens; score is the byte model's. Null and empty texts
    are their end alone. Without training rows N and V are 0 and the trie is empty. Null and repeated ids, and equal
    rows, are scored each; other columns are ignored. ``nodes`` and ``frequent`` bound what is broadcast, not the models.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    learnt = rows.filter("train")
    words = materialise(count_words(learnt), "lm-words")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = learnt.select("id").count()
    n_all, v_all = total.n + ends, total.v + (ends > 0)
    known, least = _frequent(words, frequent)
    part = {w: float(np.log10(c + 0.5)) for w, c in known.items()}
    grams = materialise(count_grams(learnt), "lm-grams")
    whole = grams.count() <= nodes
    if whole:
        deep = grams.select("gram", F.col("n").alias("value")).toArrow()
    else:
        trie = Nodes(grams)
        seen = materialise(trie.seen(), "lm-seen")
        often = F.col("n") >= at_most(grams, "n", nodes)
        deep = seen.filter(often).select("gram", "value").toArrow()
    shared = spark.sparkContext.broadcast((part, deep["gram"].to_numpy(), deep["value"].to_numpy()))  # bounded by ``frequent`` and ``nodes``
    below = float(np.log10(n_all + 0.5 * (v_all + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, values = shared.value
        model = Trie(keys, values) if whole else Values(keys.astype(_U), values)
        end = float(np.log10(ends + 0.5))
        names = ["row", "id", "word", "times", "tokens", "known", "base", "score", "gram"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        for batch in slices(batches, "text", 1 << 19):
            data, stops, split = plain_bytes(batch.column(2).to_pylist())
            grams, stops = gram_keys(data, stops)
            value = model.log10(grams)
            asked = np.flatnonzero(np.isnan(value))
            value[asked] = 0.0
            sums = np.append(0.0, np.cumsum(value))
            score = np.diff(sums[np.append(0, stops)])
            if len(asked):
                gram, index = np.unique(grams[asked], return_inverse=True)
                pair, times = np.unique(np.searchsorted(stops, asked, "right") * len(gram) + index, return_counts=True)
                columns = [pa.nulls(len(pair), k) for k in kinds]
                columns[0], columns[3] = batch.column(0).take(pa.array(pair // len(gram))), pa.array(times)
                columns[-1] = pa.array(gram[pair % len(gram)].astype(np.int64))
                yield pa.RecordBatch.from_arrays(columns, names=names)
            out: list[list] = [[] for _ in names]
            for row, doc, own, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), split, score.tolist()):
                base, seen = end, int(ends > 0)
                for word, times in Counter(own).items():
                    p = part.get(word)
                    if p is None:
                        for column, value in zip(out, (row, None, word, times, 0, 0, 0.0, 0.0, None)):
                            column.append(value)
                    else:
                        base += times * p
                        seen += times
                # no word holds a space: this row meets no other in the join
                for column, value in zip(out, (row, doc, b" %d" % row, 0, len(own) + 1, seen, base, s, None)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    keyed = rows.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    asked = in_batches(keyed, run, "row long, id long, word binary, times long, tokens long, known long, base double, score double, gram long")
    if not whole:
        asked = materialise(asked, "lm-asked")
    met = asked.filter("gram is null").join(words.filter(F.col("c") < least), "word", "left")
    base = F.col("base") + F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))
    known = F.col("known") + F.when(F.col("c") > 0, F.col("times")).otherwise(0)
    met = met.select("row", "id", "tokens", known.alias("known"), base.alias("base"), "score")
    if not whole:
        grams = asked.filter("gram is not null").select("row", "gram", "times")
        rare = seen.filter(~often).select("gram", "value")
        fresh = materialise(grams.select("gram").distinct().join(rare, "gram", "left_anti"), "lm-fresh")
        values = materialise(rare.unionByName(trie.unseen(fresh)), "lm-values")
        none = F.lit(0).cast("long")
        scored = grams.join(values, "gram").select("row", F.lit(None).cast("long").alias("id"), none.alias("tokens"), none.alias("known"), F.lit(0.0).alias("base"), (F.col("times") * F.col("value")).alias("score"))
        met = met.unionByName(scored)
    sums = met.groupBy("row").agg(
        F.max("id").alias(id_col),
        F.sum("tokens").alias("n_tokens"),
        F.sum("known").alias("n_known"),
        F.sum("base").alias("base"),
        F.sum("score").alias("score"),
    )
    return sums.select(id_col, "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * below).alias("base_score"), "score")
