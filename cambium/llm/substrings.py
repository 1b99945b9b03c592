"""Repeated passages removed by suffix automata of reference shards (operator 1)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cambium.llm.common import U64, batched, fresh, prefix, ranged, slices, stored, text_bytes, told_apart, word_hashes, words_of

#: Words of the anchor, the run that a window is filed under: of its runs of ANCHOR words the one with the least hash.
ANCHOR = 10
#: Contexts in one shard's automaton (about), and of one anchor from which windows are counted one by one instead.
SHARD, HOT = 1000, 2000
#: Words of an external reference in one broadcast automaton.
REFERENCE_WORDS = 200_000
_INDEX = 26


class SuffixAutomaton:
    """Generalised suffix automaton of weighted sequences: every run of symbols with the weight of its occurrences."""

    def __init__(self, sequences: Iterable[tuple[list[int], int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.weight = [-1], [0], [0]
        for sequence, weight in sequences:
            last = 0
            for symbol in sequence:
                last = self._extend(last, symbol)
                self.weight[last] += weight
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.weight[self.link[state]] += self.weight[state]

    def _state(self, edges: dict[int, int], link: int, length: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.weight.append(0)
        return len(self.length) - 1

    def _split(self, p: int, symbol: int, q: int) -> int:
        """The state of the shorter runs that reach q from p by the symbol."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.next[q].copy(), self.link[q], self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        q = self.next[last].get(symbol)
        if q is not None:
            return self._split(last, symbol, q)
        new = self._state({}, 0, self.length[last] + 1)
        p = last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, symbol, self.next[p][symbol])
        return new

    def matches(self, sequence: Iterable[int], least: int, weight: int = 1) -> Iterator[int]:
        """Matching statistics: the start of each run of `least` symbols that the automaton holds `weight` times."""
        state = size = 0
        following, link, length, weights = self.next, self.link, self.length, self.weight
        for end, symbol in enumerate(sequence, 1):
            while state and symbol not in following[state]:
                state = link[state]
                size = length[state]
            if symbol in following[state]:
                state = following[state][symbol]
                size += 1
            if size >= least:
                v = state
                while length[link[v]] >= least:
                    v = link[v]
                if weights[v] >= weight:
                    yield end - least


def _contexts(texts: pa.Array, window: int) -> tuple[np.ndarray, ...]:
    """Contexts of every text: (text, first window start, windows, anchor, hash of the words).

    Each window start of a text belongs to exactly one context, the run of neighbouring windows with the same anchor
    place; equal windows, wherever they are, have equal anchors at equal offsets.
    """
    buf, offsets = text_bytes(texts)
    starts, ends, first = words_of(buf, offsets)
    n = len(starts)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),) * 2
    if n >= 1 << _INDEX:
        raise ValueError(f"a text has {n} words: split texts of 2**{_INDEX} words or more")
    if n < window:
        return none
    sums = prefix(word_hashes(buf, starts, ends))
    spot = np.arange(n - ANCHOR + 1)
    gram = ranged(sums, spot, spot + ANCHOR)
    low = gram >> U64(_INDEX) << U64(_INDEX) | spot.astype(U64)
    width, span = window - ANCHOR + 1, 1
    while 2 * span <= width:
        low, span = np.minimum(low[: len(low) - span], low[span:]), 2 * span
    if width > span:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    place = (low & U64((1 << _INDEX) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    at = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
    if not len(at):
        return none
    place = place[at]
    turn = np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)])
    begin = np.flatnonzero(turn)
    many = np.diff(np.append(begin, len(at)))
    a = at[begin]
    return text[a], a - first[text[a]], many, gram[place[begin]], ranged(sums, a, a + many + window - 1)


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """Anchors that more than one context has; counts are summed within a batch first, so a frequent one is few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            anchor = np.sort(_contexts(b.column("text"), window)[3])
            edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(anchor[edge].view(np.int64)), pa.array(np.diff(np.append(edge, len(anchor))))], ["anchor", "m"])

    return docs.select("text").mapInArrow(run, "anchor long, m long").groupBy("anchor").agg(F.sum("m").alias("m")).where("m > 1").select("anchor")


def _occurrences(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            text, pos, n, anchor, ctx = _contexts(b.column("text"), window)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(ctx.view(np.int64)), b.column("key").take(pa.array(text)), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32))], ["anchor", "ctx", "key", "pos", "n"])

    return docs.select("key", "text").mapInArrow(run, "anchor long, ctx long, key long, pos int, n int")


def _words(wanted: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """The words of contexts, from the text of one occurrence of each; the text meets all contexts wanted of it at once."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "ctx", "pos", "n", "m", "hot")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, contexts in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist()):
                words = text.encode().split()
                rows += [(c["anchor"], c["ctx"], c["n"], c["m"], c["hot"], b" ".join(words[c["pos"] : c["pos"] + c["n"] + window - 1])) for c in contexts]
            columns = zip(*rows) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["anchor", "ctx", "n", "m", "hot", "words"])

    lists = stored(lists)
    some, _ = told_apart(docs.select("key", "text"), F.col("key"), lists.select("key"))  # other texts aren't shuffled
    return some.join(lists, "key").mapInArrow(run, "anchor long, ctx long, n int, m long, hot boolean, words binary")


def _automata(contexts: DataFrame, window: int) -> DataFrame:
    """(anchor, ctx, mask): bit i is set if the context's window i occurs twice or more among all contexts.

    A shard is the contexts of some anchors: all occurrences of a window have its anchor, so they are in one shard.
    Its automaton weighs each distinct context by its copies; then the contexts are streamed through it.
    """

    def solve(shard: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        ids: dict[bytes, int] = {}
        sequences = [[ids.setdefault(w, len(ids)) for w in words.split(b" ")] for _, _, _, words in shard]
        automaton = SuffixAutomaton(zip(sequences, (m for _, _, m, _ in shard)))
        masks = [sum(1 << i for i in automaton.matches(s, window, 2)) for s in sequences]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in shard], pa.int64()), pa.array([x[1] for x in shard], pa.int64()), pa.array(masks, pa.int64())], ["anchor", "ctx", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple[int, int, int, bytes]] = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("anchor", "ctx", "m", "words"))):
                if len(shard) >= SHARD and row[0] != shard[-1][0]:
                    yield solve(shard)
                    shard = []
                shard.append(row)
        if shard:
            yield solve(shard)

    return contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "anchor long, ctx long, mask long")


def _counted(contexts: DataFrame, window: int) -> DataFrame:
    """The masks of contexts of hot anchors, whose shard could outgrow a task: windows are counted one by one."""
    words = F.split(F.col("words").cast("string"), " ")
    each = contexts.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("anchor", "ctx", "m", "i", F.sha2(F.array_join(F.slice(words, F.col("i") + 1, window), " "), 256).alias("w"))
    twice = stored(each.groupBy("w").agg(F.sum("m").alias("total")).where("total > 1").select("w"))  # so that Spark can split a frequent w
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i"))
    return each.join(twice, "w", "left_semi").groupBy("anchor", "ctx").agg(F.bit_or(bit).alias("mask"))


def repeated(docs: DataFrame, window: int = 35) -> DataFrame:
    """(key, spans): for each text with repeated windows the places of its contexts and their masks. docs: key, doc_id, text.

    The reference of each document is all documents, too much to broadcast. So it is cut into shards by anchor, each
    with an automaton of its own, and of the documents only contexts whose anchor occurs twice go to that one shard:
    1. count anchors, 2. keep occurrences of contexts with repeated anchors, 3. reduce them to distinct contexts with
    their copies, 4. an anchor with one distinct context needs no automaton: its copies match it whole, 5. the others'
    words are fetched and go through their shard's automaton, 6. masks go back to the occurrences, by document.
    """
    often = stored(_anchors(docs, window))
    found = stored(_occurrences(docs, window).join(often, "anchor", "left_semi"))
    unlike = stored(found.groupBy("anchor", "ctx").agg(F.count("*").alias("m"), F.min(F.struct("key", "pos", "n")).alias("at")).select("anchor", "ctx", "m", "at.key", "at.pos", "at.n"))
    several = stored(unlike.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1"))
    alone = unlike.join(several, "anchor", "left_anti").select("anchor", "ctx", (F.call_function("shiftleft", F.lit(1).cast("long"), F.col("n")) - 1).alias("mask"))
    wanted = unlike.join(several, "anchor").select("anchor", "ctx", "m", "key", "pos", "n", (F.col("k") > HOT).alias("hot"))
    words = stored(_words(wanted, docs, window))
    masks = alone.unionByName(_automata(words.where("not hot"), window)).unionByName(_counted(words.where("hot"), window)).where("mask != 0")
    return found.join(masks, ["anchor", "ctx"]).groupBy("key").agg(F.collect_list(F.struct("pos", "mask")).alias("spans"))


def covered(n_words: int, starts: Iterable[int], window: int) -> np.ndarray:
    """Which of n words are in a window that begins at one of the starts."""
    edge = np.zeros(n_words + 1, np.int64)
    for s in starts:
        edge[s] += 1
        edge[s + window] -= 1
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = 35, text_out: str = "kept_text") -> DataFrame:
    """docs with n_words, n_removed and the kept words, joined by one space, as `text_out`.

    A word goes if it is in a window of `window` consecutive words of its document whose words also start anywhere
    else, in another document or in the same one; windows are judged on the input. Null and empty texts have no words
    and an empty result, as do texts of which nothing is left; texts shorter than the window stay. Rows repeated with
    the same id and text are documents of their own, and so repeat each other. Texts of 2**26 words or more raise an
    error, as does a window of other than 10 to 72 words (an anchor is 10 words, a context's windows are bits of a
    long). Columns of docs named like the new ones are replaced. Only texts with repeated windows are shuffled.
    """
    if not ANCHOR <= window < ANCHOR + 63:
        raise ValueError(f"window: {ANCHOR} to {ANCHOR + 62} words")
    batched(docs.sparkSession)
    added = ("n_words", "n_removed", text_out)
    kept = docs.select([c for c in docs.columns if c not in added])
    key = F.xxhash64("doc_id", "text")
    names, k, found = kept.columns, fresh("key"), fresh("spans")
    spans = stored(repeated(docs.select(key.alias("key"), "doc_id", "text"), window).select(F.col("key").alias(k), F.col("spans").alias(found)))
    some, rest = told_apart(kept, key, spans.select(k))
    met = some.withColumn(k, key).join(spans, k, "left")
    alone = rest.withColumn(k, F.lit(0).cast("long")).withColumn(found, F.lit(None).cast(spans.schema[found].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, gone, texts = [], [], []
            for text, spans in zip(b.column("text").to_pylist(), b.column(found).to_pylist()):
                words = (text or "").encode().split()
                out = 0
                if spans:
                    bad = covered(len(words), {s["pos"] + i for s in spans for i in range(s["mask"].bit_length()) if s["mask"] >> i & 1}, window)
                    out = int(bad.sum())
                    words = [w for w, x in zip(words, bad.tolist()) if not x]
                total.append(len(words) + out)
                gone.append(out)
                texts.append(b" ".join(words).decode())
            new = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *new], [*names, *added])

    schema = T.StructType([*kept.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(text_out, T.StringType())])
    return met.mapInArrow(run, schema).unionByName(alone.select(met.columns).mapInArrow(run, schema))


def remove_reference(docs: DataFrame, reference: DataFrame, window: int = 35) -> DataFrame:
    """docs with every word removed from text that is in a run of `window` words or more that the reference holds too.

    reference (text) is read one bounded shard at a time; each shard's automaton is broadcast, and the documents are
    streamed through it for matching statistics against the original words. A shard is REFERENCE_WORDS words and one text
    at most; null texts of the reference hold nothing, null texts of docs stay null.
    """
    batched(docs.sparkSession)

    def shards() -> Iterator[list[list[bytes]]]:
        texts, size = [], 0
        for row in reference.select("text").where("text is not null").toLocalIterator():
            texts.append(row["text"].encode().split())
            size += len(texts[-1])
            if size >= REFERENCE_WORDS:
                yield texts
                texts, size = [], 0
        if texts:
            yield texts

    ids: list[dict[bytes, int]] = []
    automata = []
    for texts in shards():
        known: dict[bytes, int] = {}
        automata.append(SuffixAutomaton(([known.setdefault(w, len(known)) for w in t], 1) for t in texts))
        ids.append(known)
    shared = [docs.sparkSession.sparkContext.broadcast(x) for x in zip(ids, automata)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                words = (text or "").encode().split()
                hit = [s for x in shared for s in x.value[1].matches([x.value[0].get(w, -1) for w in words], window)]
                bad = covered(len(words), hit, window) if hit else None
                out.append(text if bad is None else b" ".join(w for w, x in zip(words, bad.tolist()) if not x).decode())
            i = b.schema.get_field_index("text")
            yield b.set_column(i, "text", pa.array(out, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def op1_substrings(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
