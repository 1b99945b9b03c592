"""Exact top-k by inner product with a pivot-distance index (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cambium.llm.common import batched, stored

#: Pivots, and the vectors that they are chosen from: fixed numbers whatever the input.
PIVOTS, SEEDS = 32, 256
#: Vectors of one annulus at most, annuli of one partition (about), and of one broadcast table of bounds at most.
BLOCK, GROUP, CHUNK = 8192, 4, 1 << 16
#: Queries of one annulus that one task takes (about); an annulus that more ask for is copied, and they are dealt.
QUERIES = 1 << 18
#: Products below this are exact in float64; larger ones are computed again in integers.
EXACT = 2.0**53
#: Components that may take part, and the range of a score.
LARGEST, LIMIT = 1e150, (1 << 63) - 1

_PACKED = "ids binary, copies binary, vectors binary"


def integers(embedding: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component x, as double; null if the vector or a component is null, not finite or of LARGEST size."""
    scaled = lambda x: F.lit(scale) * x.cast("double")
    fits = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(scaled(x)) < LARGEST))
    whole = lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)
    return F.when(embedding.isNotNull() & F.coalesce(fits, F.lit(False)), F.transform(embedding, lambda x: whole(scaled(x))))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def _lifted(x: np.ndarray, peak: float) -> np.ndarray:
    """Vectors of one length: nearest by distance is then largest by inner product."""
    return np.hstack([x, np.sqrt(np.maximum(peak - (x * x).sum(1), 0))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def _spread(sample: np.ndarray, n: int) -> np.ndarray:
    """n of the sample, each the farthest from those chosen before."""
    chosen = [0]
    far = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _products(q: np.ndarray, x: np.ndarray, k: int, known: np.ndarray, ids: np.ndarray, peak: float, own: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query row (row, places of its k best in order, their scores), of scores from `known` on.

    own: the place of the query itself for each row, which is left out.
    """
    for at in range(0, len(q), 512):
        s = np.clip(q[at : at + 512] @ x.T, -float(LIMIT), float(LIMIT))
        if own is not None:
            s[np.arange(len(s)), own[at : at + 512]] = -np.inf
        room = 0.0 if peak < EXACT else 4 * x.shape[1] * 2.0**-52 * peak
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), -np.inf)
        for r in range(len(s)):
            some = np.flatnonzero((s[r] >= max(kth[r], known[at + r]) - room) & (s[r] > -np.inf))
            if peak < EXACT:
                score = s[r, some].astype(np.int64)
            else:
                whole = list(map(int, q[at + r]))
                score = np.array([max(-LIMIT, min(LIMIT, sum(a * int(b) for a, b in zip(whole, x[j])))) for j in some], np.int64)
            order = np.lexsort((ids[some], -score))[:k]
            yield at + r, some[order], score[order]


def _floor(kth: int) -> float:
    """A bound for pruning from a k-th best score; a score at the end of the range may stand for smaller ones."""
    return -np.inf if kth <= -LIMIT else float(np.nextafter(float(kth), -np.inf)) if abs(kth) >= EXACT else float(kth)


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k largest integer inner products with the other rows.

    Ties go to the smaller id; fewer than k candidates give all of them. Rows with a null id or vector, or a null or
    non-finite component (or one of 1e150 / 64 or more), take no part. Every other row is a candidate, also one that repeats an id
    or a whole row, and every query row has an answer of its own. Vectors meet vectors of their own length only. Scores
    are exact at any size; those beyond the range of a long count as its end. An empty table gives an empty one.

    With M the largest squared length, x -> (x, sqrt(M - |x|^2)) and q -> (q, 0) make |q - x|^2 = |q|^2 + M - 2 qx, so
    the distance to a pivot bounds the score: |d(q, p) - d(x, p)| <= d(q, x). Vectors are range-partitioned by (nearest
    pivot, distance, id), which cuts them into annuli of equal size even if many vectors are equal, and stored. Each
    query is first answered within its own annulus, where it lies anyway, without a shuffle: that gives its k-th best
    score so far. Then the annuli whose bound can beat it are found from a table of (pivot, low, high), CHUNK annuli at
    a time; only those annuli move, once, and a query only to those. An annulus that many queries ask for is copied.
    """
    valid = vectors.select(F.col(id_col).cast("bigint").alias("id"), integers(F.col(vector_col)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("id is not null and v is not null and size(v) > 0")
    batched(vectors.sparkSession)
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    widths = valid.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.max(squares).alias("peak")).collect()
    found = [_of_width(valid.where(F.size("v") == w["width"]), w["width"], w["n"], w["peak"], k) for w in sorted(widths)]
    return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")


def _of_width(valid: DataFrame, width: int, total: int, peak: float, k: int) -> DataFrame:
    spark = valid.sparkSession
    draw = F.xxhash64("id", "v")
    sample = valid.where(F.pmod(draw, F.lit(1 << 30)) <= int((1 << 30) * min(1.0, 4 * SEEDS / total))).orderBy(draw, "id").limit(SEEDS).select("v").toArrow()
    if not sample.num_rows:  # all rows repeat few that the draw passed over
        sample = valid.limit(SEEDS).select("v").toArrow()
    pivots = spark.sparkContext.broadcast(_spread(_lifted(_matrix(sample.column("v").combine_chunks(), width), peak), PIVOTS))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each distinct row of a batch with its copies, nearest pivot and distance."""
        for b in batches:
            if not b.num_rows:
                continue
            ids, x, asks = np.asarray(b.column("id"), np.int64), _matrix(b.column("v"), width) + 0.0, np.asarray(b.column("asks").cast(pa.int8()))
            whole = np.hstack([ids[:, None].view(np.uint8).reshape(len(ids), 8), asks[:, None].view(np.uint8), np.ascontiguousarray(x).view(np.uint8).reshape(len(ids), -1)])
            _, at, copies = np.unique(np.ascontiguousarray(whole).view(f"V{whole.shape[1]}").ravel(), return_index=True, return_counts=True)
            d = _distances(_lifted(x[at], peak), pivots.value)
            near = d.argmin(1)
            values = [pa.array(ids[at]), pa.array([r.tobytes() for r in x[at]], pa.binary()), pa.array(asks[at].astype(bool)), pa.array(copies), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])]
            yield pa.RecordBatch.from_arrays(values, ["id", "v", "asks", "copies", "pivot", "distance"])

    def annuli(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbouring rows of one pivot, BLOCK at most, as one row; equal rows are one with all their copies."""
        held: list[list] = []

        def packed() -> pa.RecordBatch:
            row = [held[0][0], held[0][1], held[-1][1], np.array([h[2] for h in held], np.int64).tobytes(), np.array([h[5] for h in held], np.int64).tobytes(), b"".join(h[3] for h in held), np.array([h[4] for h in held], bool).tobytes()]
            kinds = (pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], ["pivot", "low", "high", "ids", "copies", "vectors", "asking"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("pivot", "distance", "id", "v", "asks", "copies"))):
                if held and held[-1][:5] == list(row[:5]):
                    held[-1][5] += row[5]
                    continue
                if held and (held[0][0] != row[0] or len(held) >= BLOCK):
                    yield packed()
                    held.clear()
                held.append(list(row))
        if held:
            yield packed()

    order = ["pivot", "distance", "id"]
    ranged = valid.mapInArrow(keyed, "id bigint, v binary, asks boolean, copies bigint, pivot int, distance double").repartitionByRange(max(8, -(-total // (BLOCK * GROUP))), *order).sortWithinPartitions(*order, "v", "asks")
    table = stored(ranged.mapInArrow(annuli, f"pivot int, low double, high double, {_PACKED}, asking binary").withColumn("annulus", F.monotonically_increasing_id()))

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's best within its own annulus."""
        for b in batches:
            for home, ids, copies, vectors, asking in zip(*(b.column(c).to_pylist() for c in ("annulus", "ids", "copies", "vectors", "asking"))):
                own = np.flatnonzero(np.frombuffer(asking, bool))
                if not len(own):
                    continue
                ids, copies, x = np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, width)
                rows = []
                for r, some, score in _products(x[own], x, k, np.full(len(own), -np.inf), ids, peak, own):
                    i, best = own[r], [(int(ids[j]), int(s), int(copies[j])) for j, s in zip(some, score)]
                    if copies[i] > 1:  # the query's own row isn't a candidate, its copies are
                        best.append((int(ids[i]), max(-LIMIT, min(LIMIT, sum(int(a) ** 2 for a in x[i]))), int(copies[i]) - 1))
                    ranked = sorted(best, key=lambda t: (-t[1], t[0]))
                    scores = [s for _, s, n in ranked for _ in range(min(n, k))]
                    rows.append((home, int(i), int(ids[i]), int(copies[i]), x[i].tobytes(), _floor(scores[k - 1]) if len(scores) >= k else -np.inf, [{"vec_id": a, "score": s, "n": n} for a, s, n in ranked]))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.int64()), ("n", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["home", "i", "query_id", "queries", "v", "known", "best"])

    asked = stored(table.mapInArrow(at_home, "home bigint, i int, query_id bigint, queries bigint, v binary, known double, best array<struct<vec_id:bigint,score:bigint,n:bigint>>"))
    found = [asked.select("home", "i", F.explode("best").alias("x")).select("home", "i", "x.*")]
    bounds = table.select("annulus", "pivot", "low", "high")
    chunks = max(1, -(-bounds.count() // CHUNK))
    for c in range(chunks):
        found.append(_abroad(table, asked, bounds.where(F.pmod(F.xxhash64("annulus"), F.lit(chunks)) == c).toArrow(), pivots, width, peak, k))
    by_query = Window.partitionBy("home", "i").orderBy(F.desc("score"), "vec_id")
    best = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    lists = best.groupBy("home", "i").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score", "n"))).alias("best"))
    copied = F.slice(F.flatten(F.transform("best", lambda x: F.array_repeat(F.struct(x["vec_id"].alias("vec_id"), x["score"].alias("score")), F.least(x["n"], F.lit(k)).cast("int")))), 1, k)
    each = asked.select("home", "i", "query_id", "queries").join(lists.select("home", "i", copied.alias("best")), ["home", "i"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("queries"))))
    return each.select("query_id", F.posexplode("best").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")


def _abroad(table: DataFrame, asked: DataFrame, bounds: pa.Table, pivots, width: int, peak: float, k: int) -> DataFrame:
    """(home, i, vec_id, score, n): what queries find in annuli other than their own whose bound can beat their k-th best."""
    spark = table.sparkSession
    shared = spark.sparkContext.broadcast([np.asarray(bounds.column(c)) for c in ("annulus", "pivot", "low", "high")])

    def open_(x: np.ndarray, known: np.ndarray, home: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(annulus, rows that may find something in it)."""
        annulus, pivot, low, high = shared.value
        d = _distances(np.hstack([x, np.zeros((len(x), 1))]), pivots.value)
        square = (x * x).sum(1) + peak
        for at in range(0, len(annulus), 512):
            near = d[:, pivot[at : at + 512]]
            bound = np.maximum(0, np.maximum(low[at : at + 512] - near, near - high[at : at + 512]) - 1e-7 * np.sqrt(square)[:, None])  # room for rounding
            may = (square[:, None] * (1 + 1e-9) - bound**2) / 2 + 1e-3 >= known[:, None]
            may &= home[:, None] != annulus[at : at + 512]
            for j in np.flatnonzero(may.any(0)):
                yield int(annulus[at + j]), np.flatnonzero(may[:, j])

    def columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(b.column("v").to_pylist()), np.float64).reshape(-1, width), np.asarray(b.column("known")), np.asarray(b.column("home"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = [(a, len(rows)) for a, rows in open_(*columns(b))]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())], ["annulus", "n"])

    slim = asked.select("home", "i", "v", "known")
    wanted = slim.mapInArrow(counted, "annulus bigint, n bigint").groupBy("annulus").agg(F.sum("n").alias("n")).toArrow()  # CHUNK rows at most
    parts = {a: -(-n // QUERIES) for a, n in zip(wanted.column("annulus").to_pylist(), wanted.column("n").to_pylist())}
    dealt = spark.sparkContext.broadcast(parts)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each annulus the queries of a batch that it may answer, as one row."""
        for n, b in enumerate(batches):
            if not b.num_rows:
                continue
            x, known, home = columns(b)
            i, rows, size = np.asarray(b.column("i"), np.int64), [], 0
            for a, some in open_(x, known, home):
                rows.append((a, (n + int(home[0])) % dealt.value[a], 1, np.stack([home[some], i[some]]).tobytes(), known[some].tobytes(), x[some].tobytes()))
                size += len(rows[-1][-1])
                if size > 1 << 22:
                    yield _tagged(rows)
                    rows, size = [], 0
            if rows:
                yield _tagged(rows)

    schema = f"annulus bigint, part int, kind int, {_PACKED}"
    copies = spark.createDataFrame(pa.table({"annulus": pa.array(list(parts), pa.int64()), "parts": pa.array(list(parts.values()), pa.int32())}))
    moved = table.join(F.broadcast(copies), "annulus").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("annulus", "part", F.lit(0).alias("kind"), "ids", "copies", "vectors")

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An annulus comes before its queries."""
        ids = copies = x = None
        for b in batches:
            for _, _, kind, one, two, three in zip(*(c.to_pylist() for c in b.columns)):
                if kind == 0:
                    ids, copies, x = np.frombuffer(one, np.int64), np.frombuffer(two, np.int64), np.frombuffer(three, np.float64).reshape(-1, width)
                    continue
                home, i = np.frombuffer(one, np.int64).reshape(2, -1)
                known, rows = np.frombuffer(two, np.float64), []
                for r, some, score in _products(np.frombuffer(three, np.float64).reshape(-1, width), x, k, known, ids, peak):
                    rows += [(home[r], i[r], ids[j], s, copies[j]) for j, s in zip(some, score)]
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(c), t) for c, t in zip(zip(*rows), kinds)], ["home", "i", "vec_id", "score", "n"])

    tasks = max(8, sum(parts.values()) // GROUP)
    met = moved.unionByName(slim.mapInArrow(sent, schema)).repartition(tasks, "annulus", "part").sortWithinPartitions("annulus", "part", "kind")
    return met.mapInArrow(answered, "home bigint, i int, vec_id bigint, score bigint, n bigint")


def _tagged(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["annulus", "part", "kind", "ids", "copies", "vectors"])


def op9_topk(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_dot_product(q.e, x.e) AS BIGINT) AS score
      FROM v q JOIN v x ON q.vec_id != x.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
