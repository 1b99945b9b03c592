"""Benchmark decontamination by q-gram lemma filtering and banded alignment (operator 2)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cambium.llm.common import U64, batched, slices, stored, text_bytes

Q = 8
#: Characters of benchmark text in one broadcast shard (a longer item stands alone); a larger benchmark takes several, each with a scan of its own.
SHARD_CHARS = 1 << 20
#: Shards whose scans are in one plan; then what is left is stored.
SHARDS_A_PLAN = 4
#: Items of fewer characters only match between blanks, as a few letters may stand inside other words.
SHORT = 32

_LOWER = np.arange(1 << 16, dtype=np.uint32)
for _c in range(1 << 16):
    if not (chr(_c).isalnum() or unicodedata.category(chr(_c))[0] == "M"):
        _LOWER[_c] = 32
    elif (_l := chr(_c).lower()) != chr(_c):
        _LOWER[_c] = ord(_l[0])


def characters(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts given as UTF-8, and their offsets in code points; bytes that aren't UTF-8 count as one unknown character each run."""
    try:
        codes = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), "<u4")
        count = np.zeros(len(buf) + 1, np.int64)
        np.cumsum((buf & 0xC0) != 0x80, out=count[1:])
        return codes, count[offsets]
    except UnicodeDecodeError:
        each = [np.frombuffer(buf[a:b].tobytes().decode(errors="replace").encode("utf-32-le"), "<u4") for a, b in zip(offsets, offsets[1:])]
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])


def normalised(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased letters and digits of any script, each run of other characters one blank; their places in code points, and offsets of texts."""
    codes, offsets = characters(buf, offsets)
    low = np.where(codes < 1 << 16, _LOWER[np.minimum(codes, (1 << 16) - 1)], codes).astype(np.uint32)
    blank = low == 32
    again = np.zeros(len(low), bool)
    again[1:] = blank[1:] & blank[:-1]
    firsts = offsets[:-1]
    again[firsts[firsts < len(low)]] = False
    kept = np.flatnonzero(~again)
    return low[kept], kept, np.searchsorted(kept, offsets)


def grams(text: np.ndarray) -> np.ndarray:
    """A hash of every run of eight characters; what shares one by chance is sorted out by the alignment."""
    out = np.zeros(max(0, len(text) - Q + 1), U64)
    for j in range(Q if len(out) else 0):
        out = out * U64(0x9E3779B97F4A7C15) + text[j : j + len(out)]
    return out


def occurrences(pattern: np.ndarray, region: np.ndarray) -> list[int]:
    """All starts of the pattern in the region."""
    needle, hay, out, at = pattern.tobytes(), region.tobytes(), [], 0
    while (at := hay.find(needle, at)) >= 0:
        if at % 4 == 0:
            out.append(at // 4)
        at += 1
    return out


@dataclass
class Shard:
    """Benchmark items with the index of their q-grams."""

    ids: list
    texts: list[np.ndarray]
    #: Added to diagonals, so that none is negative.
    lead: int
    budget: np.ndarray
    need: np.ndarray
    stride: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    seen: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: list[np.ndarray], rate: float) -> Shard:
        sizes = np.array([len(t) for t in texts], np.int64)
        budget = np.minimum((sizes * rate).astype(np.int64), (sizes - Q) // Q)  # so that at least one q-gram must stay
        each = [grams(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(g) for g in each])
        place = np.concatenate([np.arange(len(g)) for g in each]) if each else np.zeros(0, np.int64)
        every = np.concatenate(each) if each else np.zeros(0, U64)
        order = np.argsort(every, kind="stable")
        keys, first = np.unique(every[order], return_index=True)
        seen = np.zeros(1 << max(16, int(16 * len(keys) + 1).bit_length()), bool)
        seen[slot(keys, len(seen))] = True
        return cls(ids, texts, int(sizes.max()) + 1, budget, sizes - Q + 1 - budget * Q, np.maximum(budget + 1, 16), keys, np.append(first, len(every)), owner[order], place[order], seen)

    def bands(self, text: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text index, item, band, hits) of the diagonal bands with as many shared q-grams as the lemma asks for.

        An alignment of at most k edits keeps at least m - q + 1 - kq q-grams, on diagonals within k of each other; so
        they all lie in one of the bands of width 2s, s > k, that begin at multiples of s.
        """
        got = grams(text)
        at = np.flatnonzero(self.seen[slot(got, len(self.seen))])
        doc = np.searchsorted(offsets, at, side="right") - 1
        whole = at + Q <= offsets[doc + 1]
        at, doc = at[whole], doc[whole]
        key = np.minimum(np.searchsorted(self.keys, got[at]), len(self.keys) - 1)
        real = self.keys[key] == got[at]
        at, doc, key = at[real], doc[real], key[real]
        if not len(at):
            return
        many = self.first[key + 1] - self.first[key]
        pick = np.repeat(self.first[key] - np.cumsum(many) + many, many) + np.arange(many.sum())
        item = self.owner[pick]
        diagonal = np.repeat(at, many) - self.place[pick] + self.lead
        band = diagonal // self.stride[item]
        wide = (len(text) + 2 * self.lead) // 16 + 2
        code = (np.repeat(doc, many) * len(self.texts) + item) * wide + band
        codes, counts = np.unique(np.concatenate([code, code - 1]), return_counts=True)
        owner = codes // wide % len(self.texts)
        enough = counts >= self.need[owner]
        for c, n in zip(codes[enough].tolist(), counts[enough].tolist()):
            yield c // wide // len(self.texts), c // wide % len(self.texts), c % wide, n

    def matches(self, text: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text index, item, start, end, edits): of each text and item all matches that don't overlap, those with the fewest edits (then the first) chosen first."""
        found: dict[tuple[int, int], set[tuple[int, int, int]]] = {}
        inexact = []
        for doc, item, band, _ in self.bands(text, offsets):
            low, size = band * int(self.stride[item]) - self.lead, len(self.texts[item])
            a, b = max(low, int(offsets[doc])), min(low + 2 * int(self.stride[item]) + size, int(offsets[doc + 1]))
            if exact := occurrences(self.texts[item], text[a:b]):
                found.setdefault((doc, item), set()).update((0, a + x, a + x + size) for x in exact)
            else:
                inexact.append((doc, item, low, a, b))
        near = lambda c: any(abs(x - c[2]) <= 3 * int(self.stride[c[1]]) for e, x, _ in found.get(c[:2], ()) if not e)
        inexact = [c for c in inexact if not near(c)]  # the alignment of a band beside an exact match is that match
        for at in range(0, len(inexact), 256):
            part = inexact[at : at + 256]
            for (doc, item, _, a, b), edits in zip(part, self.banded(text, part).tolist()):
                if edits <= self.budget[item]:
                    start, end, edits = placed(self.texts[item], text[a:b])
                    found.setdefault((doc, item), set()).add((edits, a + start, a + end))
        for (doc, item), all_ in found.items():
            taken: list[tuple[int, int]] = []
            for edits, a, b in sorted(all_):
                whole = len(self.texts[item]) >= SHORT or (a == offsets[doc] or text[a - 1] == 32) and (b == offsets[doc + 1] or text[b] == 32)
                if whole and all(b <= x or a >= y for x, y in taken):
                    taken.append((a, b))
                    yield doc, item, a, b, edits

    def banded(self, text: np.ndarray, candidates: list[tuple[int, int, int, int, int]]) -> np.ndarray:
        """Fewest edits of each candidate (text, item, lowest diagonal, from, to) on the diagonals of its band.

        All candidates advance together, a row of the pattern at a time; a cell (row, diagonal) follows from the same
        diagonal, the next one in the row before, and the one before in the same row.
        """
        items = [c[1] for c in candidates]
        sizes = np.array([len(self.texts[i]) for i in items])
        most, width = int(sizes.max()), 2 * int(self.stride[items].max()) + 1
        pattern = np.zeros((len(items), most), np.uint32)
        for row, i in enumerate(items):
            pattern[row, : len(self.texts[i])] = self.texts[i]
        low, start, end = (np.array([c[x] for c in candidates])[:, None] for x in (2, 3, 4))
        at = low + np.arange(most + width)
        region = np.where((at >= start) & (at < end), text[np.clip(at, 0, len(text) - 1)], np.uint32(0xFFFFFFFF))  # no character
        step = np.arange(width, dtype=np.int32)
        row, out = np.zeros((len(items), width), np.int32), np.zeros(len(items), np.int32)
        for i in range(most):
            new = row + (region[:, i : i + width] != pattern[:, i, None])
            np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
            row = np.minimum.accumulate(new - step, axis=1) + step
            ended = sizes == i + 1
            if ended.any():
                out[ended] = row[ended].min(1)
        return out


def slot(keys: np.ndarray, size: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def _ends(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Fewest edits between the whole pattern and some run of text that ends at each position (semi-global alignment)."""
    step = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, c in enumerate(pattern, 1):
        new = np.empty_like(row)
        new[0] = i
        np.minimum(row[1:] + 1, row[:-1] + (text != c), out=new[1:])
        row = np.minimum.accumulate(new - step) + step
    return row


def placed(pattern: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(start, end, edits) of the best alignment of the pattern within a region."""
    ends = _ends(pattern, region)
    end = int(ends.argmin())
    edits = int(ends[end])
    back = _ends(pattern[::-1], region[:end][::-1])
    return end - int(np.flatnonzero(back == edits)[0]), end, edits


def shards(benchmark: DataFrame, rate: float, min_chars: int) -> Iterator[Shard]:
    """Items of at least `min_chars` normalised characters, in shards of bounded size, read one shard at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        raw = np.frombuffer(row["text"].encode(), np.uint8)
        clean = normalised(raw, np.array([0, len(raw)]))[0]
        ink = np.flatnonzero(clean != 32)
        clean = clean[ink[0] : ink[-1] + 1] if len(ink) else clean[:0]
        if len(clean) < max(min_chars, Q):
            continue
        if texts and size + len(clean) > SHARD_CHARS:
            yield Shard.of(ids, texts, rate)
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(clean)
        size += len(clean)
    if ids:
        yield Shard.of(ids, texts, rate)


def _scan(docs: DataFrame, shard: Shard, item: T.DataType | None) -> DataFrame:
    """The matches of a shard's items, or, without a type of item ids, the rows that have none."""
    batched(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(shard)
    kind = item and to_arrow_type(item)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = shared.value
        for batch in slices(batches):
            text, places, at = normalised(*text_bytes(batch.column("text")))
            found = sorted(shard.matches(text, at))
            if kind is None:
                bad = {doc for doc, *_ in found}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))
                continue
            base = [int(places[at[doc]]) for doc, *_ in found]  # a text that matches has a first character
            columns = [[shard.ids[i] for _, i, *_ in found], [int(places[a]) - x for (_, _, a, _, _), x in zip(found, base)], [int(places[b - 1]) + 1 - x for (_, _, _, b, _), x in zip(found, base)], [e for *_, e in found]]
            values = [pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([doc for doc, *_ in found], pa.int64())), *values], ["doc_id", "item_id", "start", "end", "edits"])

    if kind is None:
        return docs.mapInArrow(run, docs.schema)
    return docs.select("doc_id", "text").mapInArrow(run, _matches(docs, item))


def _matches(docs: DataFrame, item: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", item), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType())])


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, min_chars: int = Q) -> DataFrame:
    """(doc_id, item_id, start, end, edits): of each document and benchmark item all passages that match and don't overlap.

    Texts are compared as lower-case letters and digits of any script, other characters as blanks; an item matches a
    passage within rate x its length edits (fewer for items under 40 characters, so that the lemma holds; items under
    SHORT characters between blanks only). An item matches as a whole. start and end are code points of the document.
    Null and empty texts and items match nothing, nor do items of under `min_chars` characters, of which there is no
    q-gram (8 at least). Of overlapping passages the one with the fewest edits counts, then the first. Repeated rows
    give repeated matches; equal items with other ids match each. Very long texts are scanned whole. The benchmark is
    broadcast in shards of bounded size, a few at a time; documents aren't shuffled.
    """
    item = benchmark.schema["item_id"].dataType
    done, open_ = [], []
    for shard in shards(benchmark, rate, min_chars):
        open_.append(_scan(docs, shard, item))
        if len(open_) == SHARDS_A_PLAN:
            done.append(stored(reduce(DataFrame.unionByName, open_)))
            open_ = []
    found = done + open_
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], _matches(docs, item))


def keep_clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, min_chars: int = Q) -> DataFrame:
    """The rows of docs, columns unchanged, in which `leaks` finds no item. One narrow pass for each benchmark shard."""
    for n, shard in enumerate(shards(benchmark, rate, min_chars), 1):
        docs = _scan(docs, shard, None)
        if n % SHARDS_A_PLAN == 0:
            docs = stored(docs)
    return docs


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
