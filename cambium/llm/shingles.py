"""Components of texts whose sets of word shingles have a Jaccard similarity of 0.8 or more, by salted ball hashing of SimHashes.

At that similarity about 15 % of the bits of a SimHash differ, too many for one ball around the whole. So fingerprints
have 256 bits, in 16 blocks, and each block is compared under a salt that similar sets share: the least hash of the set
in one of 16 orders. Sets of a salt are linked in a star first, which settles most groups of near copies; those that are
left in different components send the variants of their blocks within half the radius of two bits, and colliding pairs
are verified, by the whole fingerprint and then set against set. Of a large group of edited copies nearly all pairs would
collide, though few have the similarity; so members close to the centre of their star meet by the edits that they share.
Of the many texts with a common passage a fixed share of all pairs would collide; so those of a frequent salt meet by an
exact prefix filter on their sets, passages last. A pair of similarity 0.8 has no block that collides
with a probability of 1e-4, and is too far apart by its fingerprint with one of 1e-3; of greater similarity, less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cambium.llm.common import U64, batched, bit_sums, mixed, prefix, ranged, slices, stored, text_bytes, told_apart, word_hashes, words_of
from cambium.llm.components import connected_components

#: Similarity asked for, as a fraction of integers, so that no rounding decides.
OVER, OF = 4, 5
#: Salts, each with a block of so many bits of the fingerprint, which has LONGS words of 64 bits.
SALTS, WIDTH, LONGS = 16, 16, 4
#: Differing bits beyond which pairs aren't verified set against set. At similarity 0.8 they are 38.8 on average, with a deviation of 5.7.
FAR = 58
#: Similarity, as a fraction, from which a member of a star is close to its centre, and differing bits beyond which that isn't tried.
CLOSE, CLOSE_OF, CLOSE_FAR = 2, 5, 90
#: Sets under a salt beyond which they don't meet by its balls, but by a prefix filter; the most frequent shingles that the filter is told of, which come last in its order; and in how many shingles at once they are counted.
MANY, FREQUENT, RUN = 64, 1 << 18, 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEEDS = mixed(np.arange(1, SALTS + LONGS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def shingle_hashes(text: bytes, shingle: int) -> list[int]:
    """XXH64 with seed 42 of each shingle: A-Z lower-cased, words between ASCII white space; none of a text without words."""
    words = text.lower().split()
    if not words:
        return []
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    return [xxhash.xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())]


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, in one array, and offsets (n + 1). A text of fewer words is one shingle, none of no words."""
    buf, offsets = text_bytes(texts)
    low = _LOWER[buf]
    starts, ends, first = words_of(low, offsets)
    n_words = np.diff(first)
    sums = prefix(word_hashes(low, starts, ends))
    many = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    owner = np.repeat(np.arange(len(many)), many)
    a = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    hashes = ranged(sums, a, np.minimum(a + shingle, first[owner + 1]))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(many) + 1))


def prints(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text's set: digest, size, salts (n, SALTS) and fingerprint (n, LONGS); zeros of an empty set."""
    hashes, offsets = shingle_sets(texts, shingle)
    n = np.diff(offsets)
    digest = np.array([xxhash.xxh64_intdigest(hashes[a:b].tobytes(), 42) for a, b in zip(offsets, offsets[1:])], U64)
    salts, marks = np.zeros((len(n), SALTS), U64), np.zeros((len(n), LONGS), U64)
    some = n > 0
    at = offsets[:-1][some]
    if len(at):
        for i in range(SALTS):
            salts[some, i] = mixed(np.minimum.reduceat(mixed(hashes ^ _SEEDS[i]), at) + _SEEDS[i])
        for i in range(LONGS):
            bits = 2 * bit_sums(mixed(hashes ^ _SEEDS[SALTS + i]), at) > n[some][:, None]
            marks[some, i] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return digest, n, salts, marks


def _table(texts: DataFrame, shingle: int) -> DataFrame:
    """(h, digest, n, salts, mark) of each row of texts (h, text)."""

    def lists(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.view(np.int64).ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            digest, n, salts, marks = prints(b.column("text"), shingle)
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(digest.view(np.int64)), pa.array(n.astype(np.int32)), lists(salts), lists(marks)], ["h", "digest", "n", "salts", "mark"])

    return texts.select("h", "text").mapInArrow(run, "h long, digest long, n int, salts array<long>, mark array<long>")


def _both(pairs: DataFrame, table: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(table.select(F.col("digest").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs


def _apart(one: str, other: str, longs: int) -> Column:
    """Differing bits of two fingerprints."""
    return sum((F.bit_count(F.col(one)[i].bitwiseXOR(F.col(other)[i])) for i in range(longs)), F.lit(0))


def _near_in_size(n: str, m: str) -> Column:
    return OF * F.least(n, m) >= OVER * F.greatest(n, m)


def _with_text(members: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """members (digest, ...), each digest once, with text."""
    wanted = stored(classes.select("digest", "h").join(members, "digest"))
    some, _ = told_apart(texts, F.col("h"), wanted.select("h"))
    return stored(some.groupBy("h").agg(F.first("text").alias("text")).join(wanted, "h").select(*members.columns, "text"))


def _beside(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b, ...) of digests, with text_a and text_b."""
    either = pairs.select(F.col("a").alias("digest")).unionByName(pairs.select(F.col("b").alias("digest"))).distinct()
    return _both(pairs, _with_text(either, classes, texts), ("text",))


def _compared(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Of each slice of pairs of texts: the pairs, what their sets differ by, how many shingles they share, and have in all."""
    for b in (x for part in slices(batches, "text_a") for x in slices(iter([part]), "text_b")):
        (one, at), (two, to) = (shingle_sets(b.column(f"text_{s}"), shingle) for s in "ab")
        differ = [np.setxor1d(one[at[i] : at[i + 1]], two[to[i] : to[i + 1]], assume_unique=True) for i in range(b.num_rows)]
        both, many = np.diff(at) + np.diff(to), np.array([len(x) for x in differ], np.int64)
        yield b, differ, (both - many) // 2, (both + many) // 2


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) of digests that have the similarity: near in size and fingerprint, then set against set."""
    near = stored(_both(pairs, classes, ("n", "mark")).where(_near_in_size("n_a", "n_b") & (_apart("mark_a", "mark_b", LONGS) <= FAR)).select("a", "b"))
    if near.isEmpty():
        return near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, common, total in _compared(batches, shingle):
            yield b.filter(pa.array(OF * common >= OVER * total)).select(["a", "b"])

    return stored(_beside(near, classes, texts).select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"))


def _around(stars: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(a, b, linked, delta) of the members a of a star that are close to its centre b: whether they have the similarity, and what their sets differ by."""
    close = (CLOSE_OF * F.least("n_a", "n_b") >= CLOSE * F.greatest("n_a", "n_b")) & (_apart("mark_a", "mark_b", LONGS) <= CLOSE_FAR)
    near = stored(_both(stars, classes, ("n", "mark")).where(close).select("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, differ, common, total in _compared(batches, shingle):
            kept = np.flatnonzero(CLOSE_OF * common >= CLOSE * total)
            ends = np.cumsum([0, *(len(differ[i]) for i in kept)], dtype=np.int32)
            delta = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, U64), *(differ[i] for i in kept)]).view(np.int64)))
            pairs = b.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([pairs.column("a"), pairs.column("b"), pa.array((OF * common >= OVER * total)[kept]), delta], ["a", "b", "linked", "delta"])

    return stored(_beside(near, classes, texts).select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, linked boolean, delta array<long>"))


def _edits_shared(around: DataFrame, part: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of a star, in different components, that may have the similarity: an exact prefix filter on what they differ by from the centre.

    Two sets differ by what their deltas differ by, so those of the similarity have deltas that differ by at most a ninth
    of both sizes. Unless both are linked with the centre, their deltas share an element. Rarest first, the first shared
    one comes after at most a quarter of a set's size of others, in the smaller delta an eighth, and in that of a linked
    member 5/9 of the delta. Edited copies whose edits are their own share only frequent elements, so most don't meet.
    """
    rows = around.withColumnRenamed("a", "digest").join(part, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    several = stored(rows.groupBy("b").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("b"))
    rows = rows.join(several, "b", "left_semi").join(classes.select("digest", "n"), "digest").withColumn("size", F.size("delta"))
    member = ["b", "digest", "component", "linked", "n", "size"]
    each = rows.select("b", "digest", F.explode("delta").alias("x"))
    shared = each.groupBy("b", "x").agg(F.count("*").alias("c")).where("c > 1")
    ranked = each.join(shared, ["b", "x"]).groupBy("b", "digest").agg(F.sort_array(F.collect_list(F.struct("c", "x"))).alias("s")).join(rows.select(member), ["b", "digest"])
    placed = stored(ranked.select(*member, (F.col("size") - F.size("s")).alias("own"), F.posexplode("s").alias("p", "s")).select(*member, F.col("s.x").alias("x"), (F.col("own") + F.col("p")).alias("p")).where(F.col("p") <= F.floor(F.col("n") / 4)))
    sides = []
    for side, first in (("a", F.lit(True)), ("b", (F.col("p") <= F.floor(F.col("n") / 8)) & (~F.col("linked") | (9 * F.col("p") < 5 * F.col("size") + 9)))):
        sides.append(placed.where(first).select("b", "x", *[F.col(c).alias(f"{c}_{side}") for c in ("digest", "component", "n", "size", "p")]))
    smaller = F.expr("size_b < size_a or size_b = size_a and digest_b < digest_a") & F.expr("component_a != component_b")
    able = F.expr("18 * (least(size_a - p_a, size_b - p_b)) >= 9 * (size_a + size_b) - n_a - n_b and 9 * (p_a + p_b) <= n_a + n_b")
    pairs = sides[0].join(sides[1], ["b", "x"]).where(smaller & _near_in_size("n_a", "n_b") & able)
    return pairs.select(F.least("digest_a", "digest_b").alias("a"), F.greatest("digest_a", "digest_b").alias("b")).distinct()


def _prefixes(sets: np.ndarray, offsets: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in `sets` the first fifth of each set and one more are, and the place of each in its set: by hash, those of `frequent` (sorted) after all others, by rank."""
    n = np.diff(offsets)
    owner, late = np.repeat(np.arange(len(n)), n), np.zeros(len(sets), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, sets), len(frequent) - 1)
        late = np.where(frequent[at] == sets, rank[at] + 1, 0)
    order = np.lexsort((sets, late, owner))
    place = np.arange(len(sets)) - offsets[:-1][owner]
    kept = place <= n[owner] // 5
    return order[kept], place[kept]


def _repeated(held: list[np.ndarray]) -> pa.RecordBatch:
    """(x, c) of the values that are there more than once."""
    values = np.sort(np.concatenate(held))
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    many = np.diff(np.append(at, len(values)))
    return pa.RecordBatch.from_arrays([pa.array(values[at[many > 1]].view(np.int64)), pa.array(many[many > 1])], ["x", "c"])


def _passages_last(members: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Pairs (a, b) of members (digest, component, loose), in different components and not both close to a centre, that may have the similarity: an exact prefix filter on the sets.

    Of sets of the similarity, the first shared shingle in any order for all comes after at most a fifth of a set's size
    of others, in the smaller set a ninth. What many members have, such as a common passage, is last in the order, so
    texts that share little else don't meet. The counts only make the order; a shingle left out of them, as one that
    doesn't repeat within a run of RUN, costs time, no pair.
    """
    whole = _with_text(members, classes, texts)

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in slices(batches):
            held.append(shingle_sets(b.column("text"), shingle)[0])
            if sum(map(len, held)) >= RUN:
                yield _repeated(held)
                held = []
        if held:
            yield _repeated(held)

    counts = whole.select("text").mapInArrow(repeated, "x long, c long").groupBy("x").agg(F.sum("c").alias("c"))
    most = counts.orderBy(F.desc("c"), "x").limit(FREQUENT).select("x").toArrow().column("x").to_numpy().view(U64)
    by = np.argsort(most)
    late = texts.sparkSession.sparkContext.broadcast((most[by], len(by) - by))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets, offsets = shingle_sets(b.column("text"), shingle)
            at, place = _prefixes(sets, offsets, *late.value)
            owner = np.searchsorted(offsets, at, side="right") - 1
            place = (np.diff(offsets)[owner] << 32) + place
            rows = b.select(["digest", "component", "loose"]).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(sets[at].view(np.int64)), pa.array(place)], ["digest", "component", "loose", "x", "at"])

    placed = stored(whole.select("digest", "component", "loose", "text").mapInArrow(run, "digest long, component long, loose boolean, x long, at long"))
    n, p = ({s: f"{f}(at_{s}, {k})" for s in "ab"} for f, k in (("shiftright", 32), ("mod", 1 << 32)))  # one long is half of two in a shuffle
    able = F.expr(
        f"9 * least({n['a']} - {p['a']}, {n['b']} - {p['b']}) >= 4 * ({n['a']} + {n['b']})"
        f" and ({n['b']} < {n['a']} or {n['b']} = {n['a']} and digest_b < digest_a) and component_a != component_b"
    )

    def side(s: str, which: str) -> DataFrame:
        return placed.where(which).select("x", *[F.col(c).alias(f"{c}_{s}") for c in ("digest", "component", "at")])

    ninth = "mod(at, 4294967296) <= floor(shiftright(at, 32) / 9)"
    pairs = side("a", "true").join(side("b", f"loose and {ninth}"), "x").where(able)
    pairs = pairs.unionByName(side("a", "loose").join(side("b", f"not loose and {ninth}"), "x").where(able))
    return pairs.select(F.least("digest_a", "digest_b").alias("a"), F.greatest("digest_a", "digest_b").alias("b")).distinct()


def _balls(members: DataFrame) -> DataFrame:
    """members (salt, i, digest, n, component, close, mark), each once for every variant within one bit of block i: with `key`, and without the fingerprint, as 17 copies of it are most of a row."""
    at = F.col("i") * WIDTH
    block = F.call_function("shiftrightunsigned", F.get("mark", F.floor(at / 64).cast("int")), at % 64).bitwiseAND(F.lit((1 << WIDTH) - 1))
    flips = F.array(F.lit(0), *[F.lit(1 << i) for i in range(WIDTH)])
    each = members.select("salt", "digest", "n", "component", "close", block.cast("int").alias("block"), F.explode(flips).alias("flip")).withColumn("variant", F.col("block").bitwiseXOR(F.col("flip")))
    return each.select(F.xxhash64("salt", "variant").alias("key"), "variant", "block", "digest", "n", "component", "close")


def _first_variant(one: str, other: str) -> Column:
    """Of the variants that two blocks within two bits share, one."""
    differ = F.col(one).bitwiseXOR(F.col(other))
    return F.when(F.bit_count(differ) == 2, F.col(one).bitwiseXOR(differ.bitwiseAND(-differ))).otherwise(F.least(one, other))


def _unlike(members: DataFrame, value: str, *more: Column) -> DataFrame:
    """(salt, low, high) of the salts under which there is more than one value. Counted in parts first, so a frequent salt is few rows."""
    return members.groupBy("salt").agg(F.min(value).alias("low"), F.max(value).alias("high"), *more).where("low < high")


def components(texts: DataFrame, shingle: int) -> DataFrame:
    """(h, component) of each distinct h of texts (h, text), h being a hash of the text: the groups that links connect.

    Texts with equal sets are one class from the start. A null or empty text has an empty set, so all of them are one
    class. The centre of a star is the member that shares the most salts, such as the original of edited copies; the
    members of a frequent salt are joined with it, never gathered. Balls are for salts of at most MANY sets, so a set
    meets fewer than that under each.
    """
    batched(texts.sparkSession)
    table = stored(_table(texts, shingle))
    classes = stored(table.groupBy("digest").agg(F.min("h").alias("h"), F.first("n").alias("n"), F.first("salts").alias("salts"), F.first("mark").alias("mark")))
    each = classes.where("n > 0").select("digest", F.posexplode("salts").alias("i", "salt"))
    shared = _unlike(each, "digest", F.count("*").alias("c"))
    met = stored(each.join(shared, "salt").select("salt", "i", "digest", "c"))
    weight = met.groupBy("digest").agg(F.sum("c").alias("w"))
    centre = stored(met.join(weight, "digest").groupBy("salt").agg(F.max(F.struct("w", "digest")).alias("m")).select("salt", F.col("m.digest").alias("b")))
    stars = met.select("salt", F.col("digest").alias("a")).join(centre, "salt").where("a != b").select("a", "b").distinct()
    around = _around(stars, classes, texts, shingle)
    links = around.where("linked").select("a", "b")

    part = stored(connected_components(links).withColumnRenamed("id", "digest"))
    beside = around.select(F.col("a").alias("digest"), "b", F.lit(True).alias("close"))
    placed = met.join(centre, "salt").join(beside, ["digest", "b"], "left").join(part, "digest", "left")
    placed = stored(placed.select("salt", "i", "digest", "c", F.coalesce("component", "digest").alias("component"), F.coalesce("close", F.col("digest") == F.col("b")).alias("close")))
    unsettled = stored(_unlike(placed, "component", F.min("close").alias("all")).where("not all").select("salt"))
    open_ = placed.join(unsettled, "salt", "left_semi")
    sent = _balls(open_.where(F.col("c") <= MANY).join(classes.select("digest", "n", "mark"), "digest"))
    one, two = (sent.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("variant", "block", "digest", "n", "component", "close")]) for s in "ab")
    pairs = one.join(two, "key").where(
        F.expr("digest_a < digest_b and component_a != component_b and not (close_a and close_b)")
        & _near_in_size("n_a", "n_b")
        & (F.col("variant_a") == _first_variant("block_a", "block_b"))
    )
    pairs = pairs.select(F.col("digest_a").alias("a"), F.col("digest_b").alias("b")).distinct()
    pairs = pairs.unionByName(_edits_shared(around, part, classes))
    crowd = stored(open_.where(F.col("c") > MANY).groupBy("digest").agg(F.first("component").alias("component"), F.max(~F.col("close")).alias("loose")))
    if not crowd.isEmpty():
        pairs = pairs.unionByName(_passages_last(crowd, classes, texts, shingle))
    pairs = stored(pairs.distinct())
    found = _verified(pairs, classes, texts, shingle)
    for side in ("a", "b"):
        found = found.withColumnRenamed(side, "digest").join(part, "digest", "left").select(F.coalesce("component", "digest").alias(side), *[c for c in ("a", "b") if c != side])
    merged = connected_components(found).select(F.col("id").alias("component"), F.col("component").alias("whole"))
    placed = table.select("h", "digest").distinct().join(part, "digest", "left").select("h", F.coalesce("component", "digest").alias("component"))
    return placed.join(merged, "component", "left").select("h", F.coalesce("whole", "component").alias("component"))
