"""Approximate nearest neighbours by learned partitions.

A bounded, hash-chosen sample of distinct vectors (`sample` rows, one an id) is linked to its near neighbours; that
graph is cut into balanced parts by recursive bisection (spectral start, then swaps that lower the cut). A
small softmax classifier, started at the parts' mean directions, learns from the sample to name the parts of a
vector's neighbours. It then routes every vector to its most probable part, which makes the index, and every
query to its most probable parts until their probabilities add up to `reach`, the sum that held-out sample
queries need for the aimed recall. Candidates are reranked by exact Euclidean distance in double precision.

The number of parts grows with the sample up to `parts`. Neighbouring parts share a shelf, whose rows and
queries meet in blocks of `block_bytes`, so none is gathered in one task; in a block a query is compared with
the rows of its own parts only. A query goes on to further parts until they hold k candidates with ids of their
own at least, or no part is left.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor
do rows without an id or with another length than most vectors have. Equal distances rank by smaller id.
Rows of one id count once, by their nearest vector. A distance too large for a double is infinite. An empty
table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexweave.session import ship
from lexweave.staging import stage


def near_rows(queries: np.ndarray, x: np.ndarray, k: int, itself: bool = False, block: int = 128) -> np.ndarray:
    """Places of the k nearest rows of a bounded matrix for each query, in blocks; `itself`: the queries are the rows."""
    norms, out = (x * x).sum(axis=1), []
    for at in range(0, len(queries), block):
        d = norms[None] - 2 * queries[at : at + block] @ x.T
        if itself:
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k].copy())  # a slice would keep all of it
    return np.concatenate(out)


def balanced_parts(graph: np.ndarray, parts: int, sweeps: int = 12, seed: int = 1) -> np.ndarray:
    """A part for each node: equal sizes, few cut edges; `parts` is a power of two."""
    n, k = graph.shape
    src = np.concatenate([np.repeat(np.arange(n), k), graph.ravel()])
    dst = np.concatenate([graph.ravel(), np.repeat(np.arange(n), k)])
    part, rng = np.zeros(n, np.int64), np.random.default_rng(seed)
    for _ in range(parts.bit_length() - 1):
        inner = part[src] == part[dst]
        s, d = src[inner], dst[inner]
        degree = np.maximum(np.bincount(s, minlength=n), 1)
        value = rng.standard_normal(n)
        members = [np.nonzero(part == p)[0] for p in range(part.max() + 1)]
        for _ in range(60):  # smoothing over edges, the mean of each part taken out
            value = 0.5 * value + 0.5 * np.bincount(s, value[d], n) / degree
            for m in members:
                value[m] -= value[m].mean()
                value[m] /= np.sqrt((value[m] ** 2).mean()) + 1e-12
        half = np.zeros(n, np.int64)
        for m in members:
            half[m[np.argsort(value[m], kind="stable")[len(m) // 2 :]]] = 1
        for _ in range(sweeps):
            gain = np.bincount(s, np.where(half[s] == half[d], -1, 1), n)
            for m in members:
                zero, one = m[half[m] == 0], m[half[m] == 1]
                zero, one = zero[np.argsort(-gain[zero], kind="stable")], one[np.argsort(-gain[one], kind="stable")]
                pairs = min(len(zero), len(one), max(1, len(m) // 20))
                swap = gain[zero[:pairs]] + gain[one[:pairs]] > 0
                half[zero[:pairs][swap]], half[one[:pairs][swap]] = 1, 0
        part = 2 * part + half
    return part


@dataclass
class Router:
    """Softmax classifier from a vector to part probabilities, and the probability that a query's parts add up to."""

    w: np.ndarray
    b: np.ndarray
    reach: float = 1.0

    @property
    def parts(self) -> int:
        return len(self.b)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            scores = x @ self.w + self.b
        scores = np.nan_to_num(scores, posinf=1e300, neginf=-1e300)
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)

    def ranked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts by falling probability, and the probability of those before each."""
        p = self(x)
        order = np.argsort(-p, axis=1, kind="stable")
        p = np.take_along_axis(p, order, 1)
        return order, np.cumsum(p, axis=1) - p


def _whole() -> Router:
    return Router(np.zeros((1, 1)), np.zeros(1))


def train_router(x: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int, heat: float = 10.0, epochs: int = 10, batch: int = 256, rate: float = 0.002, seed: int = 2) -> Router:
    """Adam on cross-entropy against each vector's distribution of neighbours over parts."""
    rng = np.random.default_rng(seed)
    means = np.zeros((parts, x.shape[1]))
    np.add.at(means, part, x)
    r = Router(heat * (means / (np.linalg.norm(means, axis=1, keepdims=True) + 1e-12)).T, np.zeros(parts))
    params = [r.w, r.b]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    wanted = np.concatenate([part[graph], part[:, None]], axis=1)  # a vector's own part counts like a neighbour's
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
            p = r(x[at])
            np.add.at(p, (np.arange(len(at))[:, None], wanted[at]), -1 / wanted.shape[1])
            p /= len(at)
            step += 1
            for param, grad, m, v in zip(params, (x[at].T @ p, p.sum(0)), first, second, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return r


def fit(x: np.ndarray, parts: int, k: int = 10, recall: float = 0.93) -> Router:
    """A router from a bounded sample of vectors; a tenth of it is held out to set `reach`."""
    tests, rest = x[::10], x[np.arange(len(x)) % 10 != 0]
    parts = 1 << max(0, min(parts, len(rest) // 16).bit_length() - 1)
    if parts == 1 or not len(tests):
        return _whole()
    middle = rest.mean(axis=0)
    scale = 1 / (np.sqrt(((rest - middle) ** 2).sum(axis=1).mean()) + 1e-12)
    graph = near_rows(rest, rest, min(k, len(rest) - 1), itself=True)
    part = balanced_parts(graph, parts)
    router = train_router((rest - middle) * scale, graph, part, parts)
    router.w = router.w * scale  # from here on it takes vectors as they are
    router.b = router.b - middle @ router.w
    home = np.concatenate([router(rest[at : at + 512]).argmax(axis=1) for at in range(0, len(rest), 512)])
    near = near_rows(tests, rest, min(k, len(rest)))
    needed = []
    for at in range(0, len(tests), 512):
        order, before = router.ranked(tests[at : at + 512])
        place = np.argsort(order, axis=1)  # rank of each part for each test
        needed.append(np.take_along_axis(before, np.take_along_axis(place, home[near[at : at + 512]], 1), 1).ravel())
    # aim higher by one and a half standard errors of the tests; where they are too few to vouch for that, read all parts
    aim = recall + 1.5 * np.sqrt(recall * (1 - recall) / len(tests))
    router.reach = float(np.quantile(np.concatenate(needed), aim)) + 1e-9 if aim < 1 else 2.0
    return router


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    sound: Column = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & sound)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.filter(F.size("v") == sizes[0]["d"]) if sizes else rows


def sample_vectors(rows: DataFrame, sample: int, seed: int = 4) -> np.ndarray:
    """At most `sample` distinct vectors, one an id, both chosen by hash.

    Ids with many near copies weigh as much as others, so that neighbours in the sample are other ids, as in results.
    """
    ids = rows.agg(F.approx_count_distinct("vec_id", 0.02)).first()[0]
    h, share = F.xxhash64("vec_id", F.lit(seed)), min(1.0, 1.1 * sample / max(ids, 1))  # the estimate may be a few hundredths off
    drawn = rows.withColumn("h", h).filter(F.pmod("h", F.lit(1 << 40)) / float(1 << 40) < share)
    found = drawn.groupBy("h").agg(F.min_by("v", F.xxhash64("v")).alias("v")).groupBy(F.xxhash64("v", F.lit(seed)).alias("at")).agg(F.first("v").alias("v")).orderBy("at").limit(sample)
    out: list[np.ndarray] = []
    for row in found.select("v").toLocalIterator():  # sorted, then one partition; rows become arrays at once
        out.append(np.array(row["v"], float))
    return np.array(out)


def recall(vectors: DataFrame, found: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 10, queries: int = 200) -> float:
    """The share of true k nearest ids that `found` (the result of nearest()) has, over at most `queries` of its queries.

    Distances as large as the true k-th count as found. The queries are chosen by hash and meet all rows in blocks.
    """
    rows = usable(vectors, id_col, vector)
    chosen = found.select("query_id").distinct().orderBy(F.xxhash64("query_id")).limit(queries)
    asks = rows.join(F.broadcast(chosen), rows["vec_id"] == chosen["query_id"]).groupBy("query_id").agg(F.min_by("v", F.xxhash64("v")).alias("v")).orderBy("query_id").collect()
    if not asks:
        return 1.0
    shared = vectors.sparkSession.sparkContext.broadcast((np.array([r["query_id"] for r in asks]), np.array([r["v"] for r in asks])))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, q = shared.value
        for batch in batches:
            for some in _near_rows(q, own, np.stack(batch["v"].to_numpy()), batch["vec_id"].to_numpy(), k):
                best = _best(some, k)
                yield pd.DataFrame({"query_id": own[best["query"].to_numpy()], "vec_id": best["vec_id"], "score": best["score"]})

    near = rows.mapInPandas(measure, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)
    truth = ranked.groupBy("query_id").agg(F.max("score").alias("edge"), F.count(F.lit(1)).alias("true"))
    hits = found.join(truth, "query_id").filter(F.col("score") <= F.col("edge") * (1 + 1e-9)).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    sums = truth.join(hits, "query_id", "left").agg(F.sum("true"), F.sum(F.least(F.coalesce("hits", F.lit(0)), "true"))).first()
    return (sums[1] or 0) / sums[0]


def _few_copies(rows: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` smallest ids of each distinct vector: no query needs more of them."""
    order = np.argsort(ids, kind="stable")
    key = pd.Series([r.tobytes() for r in rows[order]])
    return np.sort(order[(key.groupby(key).cumcount() < most).to_numpy()])


def _near_rows(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """(query, vec_id, score): for each query, by its place, what can be among its k nearest of `rows`."""
    if not len(rows):
        return
    norms = (rows * rows).sum(axis=1)
    take = min(len(rows), k * int(np.unique(ids, return_counts=True)[1].max()))  # k ids, however often one repeats
    for at in range(0, len(queries), max(1, (1 << 21) // len(rows))):
        q = queries[at : at + max(1, (1 << 21) // len(rows))]
        screen = norms[None] - 2 * q @ rows.T
        screen[ids[None] == own[at : at + len(q), None]] = np.inf
        edge = np.partition(screen, take - 1, axis=1)[:, take - 1]
        # everything that rounding could bring among the nearest is measured exactly
        slack = 1e-9 * (np.where(np.isfinite(edge), np.abs(edge), 0) + norms.max() + (q * q).sum(axis=1))
        i, j = np.nonzero((screen <= (edge + slack)[:, None]) & np.isfinite(screen))
        yield pd.DataFrame({"query": i + at, "vec_id": ids[j], "score": np.sqrt(((rows[j] - q[i]) ** 2).sum(axis=1))})


def _best(found: pd.DataFrame, k: int) -> pd.DataFrame:
    found = found.sort_values(["query", "score", "vec_id"]).drop_duplicates(["query", "vec_id"])
    return found[found.groupby("query").cumcount() < k]


def search_block(asks: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query_id, vec_id, score): of a block's rows the k nearest to each of its queries, from the query's parts."""
    q, v, ids, part = np.stack(asks["q"].to_numpy()), np.stack(rows["v"].to_numpy()), rows["vec_id"].to_numpy(), rows["part"].to_numpy()
    scale = max(np.abs(q).max(), np.abs(v).max())
    scale = np.exp2(np.floor(np.log2(scale))) if scale > 1e100 else 1.0  # squares must not overflow; a power of two rounds nothing
    q, v, own = q / scale, v / scale, asks["query_id"].to_numpy()
    kept = _few_copies(v, ids, k + 1)
    v, ids, part = v[kept], ids[kept], part[kept]
    wants = pd.Series(np.repeat(np.arange(len(asks)), asks["parts"].str.len())).groupby(np.concatenate(asks["parts"].to_numpy())).indices
    who = np.repeat(np.arange(len(asks)), asks["parts"].str.len())
    best, pending, size = [], [], 0
    for p, places in wants.items():
        mine, here = who[places], part == p
        for found in _near_rows(q[mine], own[mine], v[here], ids[here], k):
            pending.append(found.assign(query=mine[found["query"].to_numpy()]))
            size += len(found)
            if size > 1 << 20:  # what is held stays bounded
                pending, size = [_best(pd.concat(pending), k)], 0
    best = _best(pd.concat(pending), k) if pending else pd.DataFrame({"query": np.zeros(0, int), "vec_id": np.zeros(0, int), "score": np.zeros(0)})
    return pd.DataFrame({"query_id": own[best["query"].to_numpy()], "vec_id": best["vec_id"].to_numpy(), "score": best["score"].to_numpy() * scale})


@dataclass
class Index:
    """Every usable vector with its part and shelf, as a staged table (vec_id, v, part, shelf)."""

    router: Router
    rows: DataFrame
    sizes: dict[int, int]  # rows by part
    sole: dict[int, int]  # by part, ids that no other part has
    per_shelf: int  # parts

    def asks(self, is_query: Column, k: int) -> DataFrame:
        """(query_id, q, shelf, parts): the parts that each query reads, by shelf."""
        shared = self.rows.sparkSession.sparkContext.broadcast(self.router)
        held, per_shelf = np.array([self.sole.get(p, 0) for p in range(self.router.parts)]), self.per_shelf

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            router = shared.value
            for batch in batches:
                for at in range(0, len(batch), 512):
                    some = batch.iloc[at : at + 512]
                    order, before = router.ranked(np.stack(some["v"].to_numpy())) if router.parts > 1 else (np.zeros((len(some), 1), int), np.zeros((len(some), 1)))
                    read = (before < router.reach) | (np.cumsum(held[order], axis=1) - held[order] < k + 1)
                    i, j = np.nonzero(read)
                    parts = pd.DataFrame({"i": i, "part": order[i, j].astype("int32"), "shelf": order[i, j] // per_shelf})
                    lists = parts.groupby(["i", "shelf"])["part"].agg(list).reset_index()
                    chosen = some.iloc[lists["i"].to_numpy()]
                    yield pd.DataFrame({"query_id": chosen["vec_id"].to_numpy(), "q": chosen["v"].to_numpy(), "shelf": lists["shelf"].astype("int32"), "parts": lists["part"]})

        return self.rows.filter(is_query).select("vec_id", "v").mapInPandas(route, "query_id long, q array<double>, shelf int, parts array<int>")


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 10, sample: int = 18_432, parts: int = 1_024, rows_per_shelf: int = 4_096, recall: float = 0.93) -> Index:
    """Fit the router on a sample and give every vector its part."""
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, id_col, vector)
    count = rows.count()
    x = sample_vectors(rows, sample)
    router = fit(x, parts, k, recall) if len(x) else _whole()
    shared = spark.sparkContext.broadcast(router)
    shelves = min(router.parts, 1 << max(3, (count // rows_per_shelf).bit_length()))
    per_shelf = router.parts // shelves

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            part = np.zeros(len(batch), "int32")
            if shared.value.parts > 1:
                for at in range(0, len(batch), 512):
                    part[at : at + 512] = shared.value(np.stack(batch["v"].iloc[at : at + 512].to_numpy())).argmax(axis=1)
            yield batch.assign(part=part, shelf=part // per_shelf)

    index = stage(rows.dropDuplicates(["vec_id", "v"]).mapInPandas(home, "vec_id long, v array<double>, part int, shelf int"), "ann-index")
    sizes = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}  # one row a part
    # ids that only one part has: as many as these, a query is sure to find
    sole = index.groupBy("vec_id").agg(F.min("part").alias("part"), F.max("part").alias("last")).filter("part = last")
    return Index(router, index, sizes, {r["part"]: r["count"] for r in sole.groupBy("part").count().collect()}, per_shelf)


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = 10, block_bytes: int = 32 << 20, **options) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows found for each row where `is_query` holds (on vec_id).

    `options` are those of build_index().
    """
    spark, index = vectors.sparkSession, build_index(vectors, id_col, vector, k, **options)
    first = index.rows.select(F.size("v").alias("d")).first()
    block = max(256, block_bytes // (8 * (first["d"] if first else 1)))
    queries = stage(index.asks(is_query, k), "ann-queries")
    asked = {r["shelf"]: r["count"] for r in queries.groupBy("shelf").count().collect()}
    held: dict[int, int] = {}
    for part, n in index.sizes.items():
        held[part // index.per_shelf] = held.get(part // index.per_shelf, 0) + n
    # a row a shelf, and so no more of them than parts: how many blocks of rows and of queries it has
    blocks = spark.createDataFrame([(s, -(-n // block), -(-asked.get(s, 0) // block)) for s, n in held.items() if asked.get(s)], "shelf int, rbs int, qbs int")
    # each block of a shelf's rows meets each block of its queries in a task of its own
    rows_in = index.rows.join(F.broadcast(blocks), "shelf").withColumn("rb", F.pmod(F.xxhash64("vec_id"), "rbs").cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qbs") - 1)))
    asks = queries.join(F.broadcast(blocks), "shelf").withColumn("qb", F.pmod(F.xxhash64("query_id"), "qbs").cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("rbs") - 1)))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, int), "vec_id": np.zeros(0, int), "score": np.zeros(0)})
        return search_block(left, right, k)

    keys = ["shelf", "rb", "qb"]
    near = asks.select("query_id", "q", "parts", *keys).groupBy(*keys).cogroup(rows_in.select("vec_id", "v", "part", *keys).groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
