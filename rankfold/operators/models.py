"""Model-based recommenders: content-based (genre profiles) and implicit ALS.

Both score users against the catalogue with the block index (``rankfold.operators.vectors``), which
masks each user's seen items and keeps its best ``n``: exact, with no user × catalogue table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfold.operators.vectors import RANK_DIGITS, Block, Chunk, build_index, narrowed, pack_chunks, pair_scores, rows_of, tiled, top_scores, vectors_of
from rankfold.session import materialize, release

# interactions of an ALS block: at most on average, and fewest where more blocks only serve more cores
ROWS_PER_BLOCK = 1 << 18
LEAST_BLOCK_ROWS = 1 << 14
# numbers held per step of the least squares (they stay in a core's cache), interactions of a long row taken at a time
SOLVE_ELEMENTS = 1 << 17
ROW_STEP = 1 << 14
# Gram matrices of blocks that are summed by one task
GRAMS = 32
# a fit takes one task up to so many interactions, one of several fits up to so many, and so many numbers of its factors
WHOLE_ROWS = 1 << 18
MANY_ROWS = 1 << 22
WHOLE_NUMBERS = 1 << 26
# rows solved, and written, at a time in such a task
WHOLE_STEP = 1 << 14
# users and vectors whose scores are ranked at a time (a byte counts the vectors), and the distance to a score that rounding can bridge
RANKED_USERS = 1024
COUNTED = 255
HALF_DIGIT = 10.0**-RANK_DIGITS


def dense_from_long(long_df: DataFrame, key: str, idx: str, val: str, dim: int, out: str = "vec") -> DataFrame:
    """(key, idx, val) rows → (key, ARRAY<DOUBLE> of length dim); at most ``dim`` entries per key."""
    grouped = long_df.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col(idx).cast("int"), F.col(val)))).alias("_m"))
    return grouped.select(
        key,
        F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0.0)).cast("double")).alias(out),
    )


def genre_item_vectors(item_genres: DataFrame, vocab: DataFrame, items: DataFrame) -> DataFrame:
    """Unit multi-hot genre vector per item (zero vector for items without genres)."""
    dim = vocab.count()
    g = item_genres.join(vocab, "genre").groupBy("movie_idx", "genre_id").agg(F.lit(1.0).alias("one"))
    n = g.groupBy("movie_idx").agg(F.count(F.lit(1)).alias("_g"))
    unit = g.join(n, "movie_idx").select("movie_idx", "genre_id", (1.0 / F.sqrt(F.col("_g"))).alias("w"))
    vecs = dense_from_long(unit, "movie_idx", "genre_id", "w", max(dim, 1))
    zero = F.array_repeat(F.lit(0.0), max(dim, 1))
    return items.join(vecs, "movie_idx", "left").select("movie_idx", F.coalesce("vec", zero).alias("vec"))


def user_profiles(train: DataFrame, item_vecs_long: DataFrame, dim: int) -> DataFrame:
    """Rating-weighted sum of the unit genre vectors of each user's rated items."""
    contrib = train.select("user_idx", "movie_idx", "rating").join(item_vecs_long, "movie_idx")
    sums = contrib.groupBy("user_idx", "genre_id").agg(F.sum(F.col("rating") * F.col("w")).alias("v"))
    return dense_from_long(sums, "user_idx", "genre_id", "v", max(dim, 1))


def recommend_scored(
    user_vecs: DataFrame,
    item_vecs: DataFrame,
    seen: DataFrame,
    n: int,
    cosine: bool,
    user_col: str = "user_idx",
    item_col: str = "movie_idx",
) -> DataFrame:
    """Top-n unseen items per user by vector score (exact; see module doc)."""
    top = top_scores(user_vecs, item_vecs, n, user_col, item_col, cosine=cosine, seen=seen, out_key=item_col, out_score="score")
    return top.select(F.col(user_col).cast("int").alias(user_col), F.col(item_col).cast("int").alias(item_col), "score", "rank")


def _pack_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, key, other, weight) by block, key and other to one row for each block."""
    held: list[pa.RecordBatch] = []

    def packed() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        key, other, weight = (table.column(c).to_numpy() for c in ("key", "other", "weight"))
        parts = [np.ascontiguousarray(x).tobytes() for x in (key, other, weight)]
        return pa.RecordBatch.from_arrays([held[0].column("block")[:1], *[pa.array([x], pa.binary()) for x in parts]], names=["block", "keys", "others", "weights"])

    for batch in batches:
        blocks = batch.column("block").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]])
        for first, last in zip(edges[:-1], edges[1:], strict=True):
            if first == last:
                continue
            if held and held[0].column("block")[0].as_py() != blocks[first]:
                yield packed()
                held = []
            held.append(batch.slice(first, last - first))
    if held:
        yield packed()


def _gram(vectors: np.ndarray) -> bytes:
    wide = vectors.astype(float)
    return (wide.T @ wide).tobytes()


_FACTORS = "block int, keys binary, vec binary, gram binary"


def _pack_factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, key, vec) by block and key to one row for each block."""
    held: list[pa.RecordBatch] = []

    def packed() -> pa.RecordBatch:
        vec = np.concatenate([vectors_of(x.column("vec")) for x in held]).astype(np.float32)
        keys = np.concatenate([x.column("key").to_numpy() for x in held])
        return pa.RecordBatch.from_arrays(
            [held[0].column("block")[:1], *[pa.array([x], pa.binary()) for x in (keys.tobytes(), vec.tobytes(), _gram(vec))]], names=["block", "keys", "vec", "gram"]
        )

    for batch in batches:
        blocks = batch.column("block").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]])
        for first, last in zip(edges[:-1], edges[1:], strict=True):
            if first == last:
                continue
            if held and held[0].column("block")[0].as_py() != blocks[first]:
                yield packed()
                held = []
            held.append(batch.slice(first, last - first))
    if held:
        yield packed()


def _send_factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block of factors to the vectors that each block of the other side reads."""
    for batch in batches:
        for i in range(batch.num_rows):
            keys = np.frombuffer(batch.column("keys")[i].as_buffer(), dtype=np.int64)
            vec = np.frombuffer(batch.column("vec")[i].as_buffer(), dtype=np.float32).reshape(len(keys), -1)
            if not batch.column("routes")[i].is_valid:
                continue
            to, lists = batch.column("routes")[i].values.flatten()
            ends = np.cumsum([0, *lists.value_lengths().to_pylist()])
            all_keys = lists.flatten().to_numpy()
            for place, first, last in zip(to.to_pylist(), ends[:-1], ends[1:], strict=True):
                wanted = np.sort(all_keys[first:last])
                sent = vec[np.searchsorted(keys, wanted)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place], pa.int32()), pa.array([wanted.tobytes()], pa.binary()), pa.array([sent.tobytes()], pa.binary())], names=["to", "keys", "vec"]
                )


def solve_rows(vectors: np.ndarray, starts: np.ndarray, at: np.ndarray, weight: np.ndarray, values: np.ndarray, basis: np.ndarray, reg: float, alpha: float) -> np.ndarray:
    """Least squares of implicit ALS for each row of interactions (``at``, ``weight`` from ``starts`` on):
    (YtY + sum c y yt + reg n I) x = sum (1 + c) y, c = alpha |weight|, with n positive weights, whose
    preference alone is 1.  ``values`` and ``basis`` are YtY's eigenvalues and eigenvectors: in that basis the
    constant part is diagonal, so a row with fewer interactions than the rank is solved by a system of
    as many unknowns (Woodbury), the others by one of the rank."""
    return _solve_turned(vectors.astype(float) @ basis, starts, at, weight, values, basis, reg, alpha)


def _solve_turned(turned: np.ndarray, starts: np.ndarray, at: np.ndarray, weight: np.ndarray, values: np.ndarray, basis: np.ndarray, reg: float, alpha: float) -> np.ndarray:
    """:func:`solve_rows` with the vectors in the eigenvectors' basis."""
    rank = len(values)
    ends = np.append(starts[1:], len(at))
    size = ends - starts
    c = alpha * np.abs(weight)
    liked = weight > 0
    positive = np.add.reduceat(liked.astype(float), starts) if len(starts) else np.zeros(0)
    out = np.zeros((len(starts), rank))
    for m in np.unique(size):
        of_size = np.flatnonzero(size == m)
        step = max(1, SOLVE_ELEMENTS // int(rank * max(m, rank if m >= rank else 1)))
        for i in range(0, len(of_size), step):
            rows = of_size[i : i + step]
            diagonal = np.maximum(values, 0.0) + reg * positive[rows][:, None]
            if m < rank and (diagonal > 0).all():
                inside = starts[rows][:, None] + np.arange(m)
                z, cz = turned[at[inside]], c[inside]
                right = np.einsum("nm,nmr->nr", np.where(liked[inside], 1.0 + cz, 0.0), z) / diagonal
                root = np.sqrt(cz)[:, :, None] * z
                small = (root / diagonal[:, None, :]) @ root.transpose(0, 2, 1) + np.eye(m)
                inner = np.linalg.solve(small, (root @ right[:, :, None]))
                out[rows] = right - (root.transpose(0, 2, 1) @ inner)[:, :, 0] / diagonal
                continue
            for k, row in enumerate(rows):
                left, right = np.diag(diagonal[k]), np.zeros(rank)
                for first in range(starts[row], ends[row], ROW_STEP):  # a row can have very many
                    part = slice(first, min(first + ROW_STEP, ends[row]))
                    z = turned[at[part]]
                    left += (c[part, None] * z).T @ z
                    right += np.where(liked[part], 1.0 + c[part], 0.0) @ z
                out[row] = np.linalg.solve(left, right)
    return (out @ basis.T).astype(np.float32)


def _solve_block(values: np.ndarray, basis: np.ndarray, reg: float, alpha: float):
    """A block of interactions and the vectors sent to it to the block's factors."""

    def run(sent: pa.Table, side: pa.Table) -> pa.Table:
        rank = len(values)
        known = [(np.frombuffer(r["keys"], dtype=np.int64), np.frombuffer(r["vec"], dtype=np.float32).reshape(-1, rank)) for r in rows_of(sent.to_batches())]
        known_keys = np.concatenate([k for k, _ in known])
        order = np.argsort(known_keys)
        known_keys, vectors = known_keys[order], np.concatenate([v for _, v in known])[order]
        out = []
        for row in rows_of(side.to_batches()):
            key, other = np.frombuffer(row["keys"], dtype=np.int64), np.frombuffer(row["others"], dtype=np.int64)
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            solved = solve_rows(vectors, starts, np.searchsorted(known_keys, other), np.frombuffer(row["weights"], dtype=np.float32).astype(float), values, basis, reg, alpha)
            out.append((row["block"], key[starts].tobytes(), solved.tobytes(), _gram(solved)))
        kinds = [pa.int32(), *[pa.binary()] * 3]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["block", "keys", "vec", "gram"])

    return run


def _unpack_factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in rows_of(batches):
        keys, vec = np.frombuffer(row["keys"], dtype=np.int64), np.frombuffer(row["vec"], dtype=np.float32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * (len(vec) // max(len(keys), 1)), pa.int32()), pa.array(vec))
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), lists], names=["key", "vec"])


def _sum_grams(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(r["gram"]) for r in sorted(rows_of(table.to_batches()), key=lambda r: r["block"]))
    return pa.table({"gram": pa.array([total.tobytes()], pa.binary())})


@dataclass(frozen=True)
class AlsFit:
    """Parameters of one fit."""

    rank: int = 64
    reg: float = 0.05
    iterations: int = 15
    alpha: float = 1.0
    seed: int = 42


class _Interactions:
    """Weights of pairs, packed by blocks of users and of items; the fits of one table share them."""

    def __init__(self, confidence: DataFrame, user_col: str, item_col: str, value_col: str):
        self.columns = user_col, item_col, value_col
        self.confidence = confidence
        self.rows, *keys = confidence.agg(F.count(F.lit(1)), F.count_distinct(user_col), F.count_distinct(item_col)).first()
        self.keys = sum(keys)
        self.spark_blocks = max(2, -(-self.rows // ROWS_PER_BLOCK))
        self.n = max(self.spark_blocks, min(4 * confidence.sparkSession.sparkContext.defaultParallelism, -(-self.rows // LEAST_BLOCK_ROWS)))
        self.pairs = confidence.select(
            F.col(user_col).cast("long").alias("u"), F.col(item_col).cast("long").alias("i"), F.col(value_col).cast("float").alias("weight"),
            self.block(user_col).alias("bu"), self.block(item_col).alias("bi"),
        )
        self.sides = {}
        for mine, other in (("u", "i"), ("i", "u")):
            own = self.pairs.select(F.col("b" + mine).alias("block"), F.col(mine).alias("key"), F.col(other).alias("other"), "weight")
            ordered = own.repartitionById(self.n, F.col("block")).sortWithinPartitions("block", "key", "other", "weight")
            self.sides[mine] = materialize(ordered.mapInArrow(_pack_side, "block int, keys binary, others binary, weights binary"), "als-side", compression="uncompressed")

    def block(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(self.n)).cast("int")

    def first_factors(self, fit: AlsFit) -> dict[str, DataFrame]:
        """The factors of Spark's ALS before its first iteration, packed by blocks; the items' only where no
        iteration replaces them."""
        from pyspark.ml.recommendation import ALS  # noqa: PLC0415

        user_col, item_col, value_col = self.columns
        first = ALS(
            rank=fit.rank, maxIter=0, regParam=fit.reg, implicitPrefs=True, alpha=fit.alpha, userCol=user_col, itemCol=item_col, ratingCol=value_col, seed=fit.seed,
            numUserBlocks=self.spark_blocks, numItemBlocks=self.spark_blocks,
        ).fit(self.confidence)
        start = {"u": first.userFactors, "i": first.itemFactors}
        factors = {}
        for side in ("u", "i") if fit.iterations == 0 else ("u",):
            placed = start[side].select(self.block("id").alias("block"), F.col("id").cast("long").alias("key"), F.col("features").alias("vec"))
            packed = placed.repartitionById(self.n, F.col("block")).sortWithinPartitions("block", "key").mapInArrow(_pack_factors, _FACTORS)
            factors[side] = materialize(packed, "als-factors", compression="uncompressed")
        return factors

    def release(self) -> None:
        release(*self.sides.values())


_WHOLE_IN = "fit int, kind string, block int, keys binary, others binary, weights binary, vec binary"
_WHOLE_OUT = "fit int, kind string, keys binary, vec binary"


class _WholeSide:
    """The rows of all blocks of one side, by block and key."""

    def __init__(self, rows: list[dict]):
        parts = [(np.frombuffer(r["keys"], np.int64), np.frombuffer(r["others"], np.int64), np.frombuffer(r["weights"], np.float32)) for r in rows]
        key, self.others, self.weight = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        self.keys = key[self.starts]
        sizes = [len(np.unique(k)) for k, _, _ in parts]
        self.edges = np.concatenate([[0], np.cumsum(sizes)])

    def find(self, other: _WholeSide) -> None:
        """The places of this side's partners among the other side's keys."""
        order = np.argsort(other.keys)
        self.at = order[np.searchsorted(other.keys, self.others, sorter=order)].astype(np.int32)
        del self.others

    def gram(self, vectors: np.ndarray) -> np.ndarray:
        return sum(np.frombuffer(_gram(vectors[first:last])) for first, last in zip(self.edges[:-1], self.edges[1:], strict=True))

    def solve(self, vectors: np.ndarray, total: np.ndarray, fit: AlsFit) -> np.ndarray:
        values, basis = np.linalg.eigh(np.reshape(total, (fit.rank, fit.rank)))
        turned = vectors.astype(float) @ basis
        out = np.empty((len(self.keys), fit.rank), np.float32)
        ends = np.append(self.starts, len(self.at))
        for first in range(0, len(self.keys), WHOLE_STEP):
            last = min(first + WHOLE_STEP, len(self.keys))
            inside = slice(ends[first], ends[last])
            out[first:last] = _solve_turned(turned, self.starts[first:last] - ends[first], self.at[inside], self.weight[inside].astype(float), values, basis, fit.reg, fit.alpha)
        return out


def _fit_whole(fits: list[AlsFit]):
    """All blocks and the first user factors of a fit (each fit's rows are in one partition) to its factors:
    the half steps of the blocks, one after the other in one task."""

    def trained(number: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        fit = fits[number]
        of = lambda kind: sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["block"])
        sides = {kind: _WholeSide(of(kind)) for kind in ("u", "i")}
        first = of("f")
        keys = np.concatenate([np.frombuffer(r["keys"], np.int64) for r in first])
        vectors = {"u": np.concatenate([np.frombuffer(r["vec"], np.float32) for r in first]).reshape(len(keys), fit.rank)}
        rows.clear()
        sides["u"].find(sides["i"])
        sides["i"].find(sides["u"])
        for _ in range(fit.iterations):
            for source, target in (("u", "i"), ("i", "u")):
                vectors[target] = sides[target].solve(vectors[source], sides[source].gram(vectors[source]), fit)
        for kind, side in sides.items():
            for i in range(0, len(side.keys), WHOLE_STEP):
                row = number, kind, side.keys[i : i + WHOLE_STEP].tobytes(), vectors[kind][i : i + WHOLE_STEP].tobytes()
                kinds = [pa.int32(), pa.string(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["fit", "kind", "keys", "vec"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}
        for row in rows_of(batches):
            held.setdefault(row["fit"], []).append(row)
        for number in sorted(held):
            yield from trained(number, held.pop(number))

    return run


def als_fits(
    confidence: DataFrame, fits: list[AlsFit], user_col: str = "user_idx", item_col: str = "movie_idx", value_col: str = "confidence"
) -> list[tuple[DataFrame, DataFrame]]:
    """:func:`als_factors` for each of ``fits`` on one table.  Fits that a task can hold take one task each and
    run side by side, without a Spark job for each half step; the others are made one after the other."""
    data = _Interactions(confidence, user_col, item_col, value_col)
    most = MANY_ROWS if len(fits) > 1 else WHOLE_ROWS
    whole = 0 < data.rows <= most and all(f.iterations > 0 and data.keys * f.rank <= WHOLE_NUMBERS for f in fits)
    out = _fits_in_tasks(data, fits) if whole else [_fit_in_blocks(data, fit) for fit in fits]
    data.release()
    return out


def _fits_in_tasks(data: _Interactions, fits: list[AlsFit]) -> list[tuple[DataFrame, DataFrame]]:
    numbers = F.explode(F.sequence(F.lit(0), F.lit(len(fits) - 1))).alias("fit")
    rows = data.sides["u"].select(numbers, F.lit("u").alias("kind"), "block", "keys", "others", "weights").unionByName(
        data.sides["i"].select(numbers, F.lit("i").alias("kind"), "block", "keys", "others", "weights")
    )
    first: dict[tuple, DataFrame] = {}
    for number, fit in enumerate(fits):
        if (fit.rank, fit.seed) not in first:
            first[fit.rank, fit.seed] = data.first_factors(fit)["u"]
        rows = rows.unionByName(first[fit.rank, fit.seed].select(F.lit(number).alias("fit"), F.lit("f").alias("kind"), "block", "keys", "vec"), allowMissingColumns=True)
    ready = rows.select(*[c.split()[0] for c in _WHOLE_IN.split(", ")]).repartitionById(len(fits), F.col("fit"))
    fitted = materialize(ready.mapInArrow(_fit_whole(fits), _WHOLE_OUT), "als-whole", compression="uncompressed", partition_by="fit")
    release(*first.values())

    def vectors(number: int, kind: str, name: str) -> DataFrame:
        mine = fitted.where((F.col("fit") == number) & (F.col("kind") == kind)).select("keys", "vec")
        return mine.mapInArrow(_unpack_factors, "key int, vec array<float>").select(F.col("key").alias(name), "vec")

    return [(vectors(i, "u", data.columns[0]), vectors(i, "i", data.columns[1])) for i in range(len(fits))]


def _fit_in_blocks(data: _Interactions, fit: AlsFit) -> tuple[DataFrame, DataFrame]:
    """A half step sends each block the vectors that it reads, writes its factors and deletes those of the
    step before."""
    pairs, sides, n = data.pairs, data.sides, data.n
    routes = {}
    for mine, other in (("u", "i"), ("i", "u")):
        # the keys of a block that each block of the other side reads
        read = pairs.select(F.col("b" + mine).alias("block"), F.col("b" + other).alias("to"), F.col(mine).alias("key")).distinct()
        lists = read.groupBy("block", "to").agg(F.collect_list("key").alias("keys")).groupBy("block").agg(F.collect_list(F.struct("to", "keys")).alias("routes"))
        routes[mine] = materialize(lists, "als-routes")
    factors = data.first_factors(fit)
    for _ in range(fit.iterations):
        for source, target in (("u", "i"), ("i", "u")):
            known = factors[source]
            grams = known.select("block", "gram", F.floor(F.col("block") / GRAMS).alias("part")).groupBy("part").applyInArrow(_sum_grams, "gram binary") if n > GRAMS else known.select("block", "gram")
            total = sum(np.frombuffer(r["gram"]) for r in sorted(grams.collect(), key=lambda r: r[0]))
            values, basis = np.linalg.eigh(np.reshape(total, (fit.rank, fit.rank)))
            sent = known.join(routes[source], "block").select("keys", "vec", "routes").mapInArrow(_send_factors, "to int, keys binary, vec binary")
            solved = sent.groupBy("to").cogroup(sides[target].groupBy("block")).applyInArrow(_solve_block(values, basis, fit.reg, fit.alpha), _FACTORS)
            before = factors.get(target)
            factors[target] = materialize(solved, "als-factors", compression="uncompressed")
            if before is not None:
                release(before)
    out = []
    for side, name in (("u", data.columns[0]), ("i", data.columns[1])):
        vectors = factors[side].mapInArrow(_unpack_factors, "key int, vec array<float>")
        out.append(materialize(vectors.select(F.col("key").alias(name), "vec"), "als-vectors"))
    release(*routes.values(), *factors.values())
    return out[0], out[1]


def als_factors(
    confidence: DataFrame,
    rank: int = 64,
    reg: float = 0.05,
    iterations: int = 15,
    alpha: float = 1.0,
    seed: int = 42,
    user_col: str = "user_idx",
    item_col: str = "movie_idx",
    value_col: str = "confidence",
) -> tuple[DataFrame, DataFrame]:
    """Implicit-feedback ALS on a confidence table → (user, vec), (item, vec).

    The first user factors are those of Spark's ALS (its blocks by ``ROWS_PER_BLOCK``), the alternating
    least squares are its own, solved in batches (:func:`solve_rows`).  Users and items are hashed into
    blocks, which one task trains where it can hold them (:func:`als_fits`).
    """
    return als_fits(confidence, [AlsFit(rank, reg, iterations, alpha, seed)], user_col, item_col, value_col)[0]


def auc_global_scores(
    scores: DataFrame,
    train_pairs: DataFrame,
    test_pairs: DataFrame,
    n_items: int,
    user_col: str = "user_idx",
    item_col: str = "movie_idx",
) -> DataFrame:
    """Per-user AUC when every user shares one item score (e.g. popularity).

    Candidates of a user = all items minus its train items; positives = its test items
    that are not train items; ties count one half.  For a positive with score s:
    negatives below s = items below s globally − the user's train and positive items
    below s (running counts inside the user, on (user, score) groups).  No pair of
    items is ever formed.
    """
    sc = scores.select(item_col, F.col("score").cast("double").alias("score"))
    hist = sc.groupBy("score").agg(F.count(F.lit(1)).alias("_eq"))
    from rankfold.operators.ordering import running_totals  # noqa: PLC0415

    glob = running_totals(hist, ["score"], ["_eq"]).select(
        "score", "_eq", (F.col("_eq_cum") - F.col("_eq")).alias("_below")
    )
    pos = test_pairs.select(user_col, item_col).distinct().join(
        train_pairs.select(user_col, item_col), [user_col, item_col], "left_anti"
    )
    tr = train_pairs.select(user_col, item_col).distinct()
    marked = tr.withColumn("_t", F.lit(1)).withColumn("_p", F.lit(0)).unionByName(
        pos.withColumn("_t", F.lit(0)).withColumn("_p", F.lit(1))
    ).join(sc, item_col)
    # written once for its two consumers: the running sums and the totals per user
    per_score = materialize(marked.groupBy(user_col, "score").agg(F.sum("_t").alias("_te"), F.sum("_p").alias("_pe")), "marked")
    cum = running_totals(per_score, ["score"], ["_te", "_pe"], group_cols=[user_col]).select(
        user_col, "score", "_te", "_pe",
        (F.col("_te_cum") - F.col("_te")).alias("_tb"), (F.col("_pe_cum") - F.col("_pe")).alias("_pb"),
    )
    counts = per_score.groupBy(user_col).agg(F.sum("_te").alias("_nt"), F.sum("_pe").alias("_np"))
    per_pos = cum.where(F.col("_pe") > 0).join(glob, "score").select(
        user_col,
        (F.col("_pe") * ((F.col("_below") - F.col("_tb") - F.col("_pb"))
                         + 0.5 * (F.col("_eq") - F.col("_te") - F.col("_pe")))).alias("_num"),
    )
    agg = per_pos.groupBy(user_col).agg(F.sum("_num").alias("_num")).join(counts, user_col)
    neg = F.lit(n_items) - F.col("_nt") - F.col("_np")
    return agg.where((F.col("_np") > 0) & (neg > 0)).select(
        user_col, (F.col("_num") / (F.col("_np") * neg)).alias("auc")
    )


def lightfm_style_precision_recall(
    recs: DataFrame,
    test_pairs: DataFrame,
    train_pairs: DataFrame,
    k: int,
    user_col: str = "user_idx",
    item_col: str = "movie_idx",
) -> DataFrame:
    """Per user with test positives (minus train pairs): precision@k = hits/k,
    recall@k = hits/#positives; ``recs`` must already exclude train pairs."""
    pos = test_pairs.select(user_col, item_col).distinct().join(
        train_pairs.select(user_col, item_col), [user_col, item_col], "left_anti"
    )
    n_pos = pos.groupBy(user_col).agg(F.count(F.lit(1)).alias("_np"))
    hits = recs.where(F.col("rank") <= k).join(pos, [user_col, item_col]).groupBy(user_col).agg(
        F.count(F.lit(1)).alias("_h")
    )
    return n_pos.join(hits, user_col, "left").select(
        user_col,
        (F.coalesce(F.col("_h"), F.lit(0)) / F.lit(float(k))).alias("precision"),
        (F.coalesce(F.col("_h"), F.lit(0)) / F.col("_np")).alias("recall"),
    )


def _own_scores(chunks: pa.Table, blocks: pa.Table) -> pa.Table:
    """A tile of chunks of users and blocks of items to (chunk, user, score, t, p) for the users' own
    items of these blocks; the lowest bit of a chunk's seen ids is the flag t."""
    names = ["chunk", "u", "score", "t", "p"]
    out = [pa.table([[]] * 5, schema=pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()], strict=True))))]
    parsed = [Block.of(row) for row in rows_of(blocks.to_batches())]
    matrix, ids = np.concatenate([b.matrix for b in parsed]), np.concatenate([b.ids for b in parsed])
    vector = np.repeat(np.arange(len(matrix)), np.concatenate([b.counts for b in parsed]))
    order = np.argsort(ids, kind="stable")
    ids, vector = ids[order], vector[order]
    for row in rows_of(chunks.to_batches()):
        chunk = Chunk.of(row)
        seen, flags = chunk.seen >> 1, chunk.seen & 1
        owner = np.repeat(np.arange(len(chunk.keys)), np.diff(chunk.seen_at))
        at = np.minimum(np.searchsorted(ids, seen), len(ids) - 1)
        known = np.flatnonzero(ids[at] == seen)
        user, t = owner[known], flags[known]
        scores = np.round(pair_scores(chunk.queries, user, matrix, vector[at[known]]), RANK_DIGITS)
        out.append(pa.table([np.full(len(known), row["chunk"]), chunk.keys[user], scores, t, 1 - t], names=names))
    return pa.concat_tables(out)


def _rank_in_block(queries: np.ndarray, own: np.ndarray, n_own: np.ndarray, block: Block, below: np.ndarray, equal: np.ndarray) -> None:
    """Adds the numbers of a block's items whose rounded scores lie below and at each user's own scores:
    column u of ``own`` has n_own[u] of them, users with more first.  An item counts by its score of single
    precision where that is further from an own score than it can err; the others are scored as pairs."""
    narrow, matrix, error = narrowed(queries, block)
    width = HALF_DIGIT + error + 4e-16 * np.abs(own)
    kind = narrow.dtype.type
    least, most = np.nextafter((own - width).astype(kind), kind(-np.inf)), np.nextafter((own + width).astype(kind), kind(np.inf))
    users = [int((n_own > j).sum()) for j in range(len(own))]
    turned, counts = np.ascontiguousarray(narrow.T), block.counts
    near: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = np.empty((2, COUNTED * len(queries)), bool)

    def total(mask: np.ndarray, n: np.ndarray | None) -> np.ndarray:
        if n is None:  # as bytes, which hold COUNTED ones
            return np.add.reduce(mask.view(np.uint8), axis=0, dtype=np.uint8)
        return (n @ mask).astype(np.int64)

    for first in range(0, len(matrix), COUNTED):
        scores = matrix[first : first + COUNTED] @ turned
        n = counts[first : first + COUNTED].astype(float)
        n = None if (n == 1).all() else n
        for j, some in enumerate(users):
            under, upto = held[:, : len(scores) * some].reshape(2, len(scores), some)
            np.less(scores[:, :some], least[j, :some], out=under)
            np.less_equal(scores[:, :some], most[j, :some], out=upto)
            n_under = total(under, n)
            below[j, :some] += n_under
            unsure = np.flatnonzero(total(upto, n) != n_under)
            if len(unsure):
                vector, u = np.nonzero(upto[:, unsure] & ~under[:, unsure])
                near.append((np.full(len(u), j), unsure[u], first + vector))
    if near:
        j, u, vector = (np.concatenate(x) for x in zip(*near, strict=True))
        scores = np.round(pair_scores(queries, u, block.matrix, vector), RANK_DIGITS)
        np.add.at(below, (j, u), np.where(scores < own[j, u], counts[vector], 0))
        np.add.at(equal, (j, u), np.where(scores == own[j, u], counts[vector], 0))


def _counts_below(chunks: pa.Table, blocks: pa.Table) -> pa.Table:
    """The number of a tile's items below and at each of the scores ``own`` of its users."""
    names = ["u", "score", "below", "equal"]
    out = [pa.table([[]] * 4, schema=pa.schema(list(zip(names, [pa.int64(), pa.float64(), pa.int64(), pa.int64()], strict=True))))]
    parsed = [Block.of(row) for row in rows_of(blocks.to_batches())]
    for row in rows_of(chunks.to_batches()):
        chunk = Chunk.of(row)
        own = {r["u"]: np.sort(r["scores"]) for r in row["own"] or []}
        sizes = np.array([len(own.get(key, ())) for key in chunk.keys.tolist()])
        order = np.argsort(-sizes, kind="stable")[: int((sizes > 0).sum())]
        for first in range(0, len(order), RANKED_USERS):
            users = order[first : first + RANKED_USERS]
            n_own, queries, keys = sizes[users], chunk.queries[users], chunk.keys[users]
            held = np.arange(n_own[0])[:, None] < n_own
            scores = np.zeros(held.shape)
            scores.T[held.T] = np.concatenate([own[key] for key in keys.tolist()])
            below, equal = np.zeros(held.shape, np.int64), np.zeros(held.shape, np.int64)
            still = ~queries.any(axis=1)  # every item scores zero
            moving = np.flatnonzero(~still)
            some = (scores[:, moving], n_own[moving], below[:, moving], equal[:, moving])
            for block in parsed:
                if still.any():
                    below[:, still] += len(block.ids) * (scores[:, still] > 0)
                    equal[:, still] += len(block.ids) * (scores[:, still] == 0)
                if len(moving):
                    _rank_in_block(queries[moving], some[0], some[1], block, *some[2:])
            below[:, moving], equal[:, moving] = some[2:]
            out.append(pa.table([np.repeat(keys, n_own), *[x.T[held.T] for x in (scores, below, equal)]], names=names))
    return pa.concat_tables(out)


def auc_user_scores(
    user_vecs: DataFrame,
    item_vecs: DataFrame,
    train_pairs: DataFrame,
    test_pairs: DataFrame,
    user_col: str = "user_idx",
    item_col: str = "item_idx",
    block_vectors: int | None = None,
    tile_bytes: int | None = None,
) -> DataFrame:
    """Per-user AUC for user-specific dot-product scores (hybrid / ALS models).

    Candidates of a user = all items minus its train items; positives = its test items
    not in train; scores are compared after rounding to 9 places and ties count one half.
    Chunks of users meet blocks of items in tiles (see ``vectors``); the first pass scores each user's
    train and positive items, those pairs alone, the second counts how many items of a tile lie below and at
    the scores of the positives.  The user's own items below each score come from distributed running sums.
    No (user, item) pair outside train and positives is ever formed.
    """
    from rankfold.operators.ordering import running_totals  # noqa: PLC0415

    pos = test_pairs.select(user_col, item_col).distinct().join(
        train_pairs.select(user_col, item_col), [user_col, item_col], "left_anti"
    )
    marked = train_pairs.select(user_col, item_col).distinct().withColumn("_t", F.lit(1)).unionByName(pos.withColumn("_t", F.lit(0)))
    # one row per user; its lists are no longer than the catalogue; the flag is the lowest bit
    both = (F.col(item_col).cast("long") * 2 + F.col("_t")).alias("_b")
    lists = marked.select(F.col(user_col).cast("long").alias("_l"), both).groupBy("_l").agg(F.collect_list("_b").alias("_seen"))
    vecs = user_vecs.select(F.col(user_col).cast("long").alias("_l"), F.lit(0).alias("_k"), F.col("vec").cast("array<double>").alias("_rv"))
    packed = pack_chunks(vecs.join(lists, "_l").select("_l", "_k", "_seen", "_rv"), cosine=False)
    index = build_index(item_vecs, item_col, "vec", False, block_vectors)
    scored = tiled(packed, None, index, _own_scores, "chunk long, u long, score double, t long, p long", tile_bytes=tile_bytes)
    per_score = materialize(scored.groupBy("chunk", "u", "score").agg(F.sum("t").alias("_te"), F.sum("p").alias("_pe")), "user-scores")
    own = per_score.where(F.col("_pe") > 0).groupBy("chunk", "u").agg(F.collect_list("score").alias("scores")).groupBy("chunk").agg(F.collect_list(F.struct("u", "scores")).alias("own"))
    counted = tiled(packed, own, index, _counts_below, "u long, score double, below long, equal long", tile_bytes=tile_bytes)
    counts = materialize(counted.groupBy("u", "score").agg(F.sum("below").alias("_below"), F.sum("equal").alias("_eq")), "user-counts")
    release(packed, index)
    n_items = item_vecs.count()
    cum = running_totals(per_score.drop("chunk"), ["score"], ["_te", "_pe"], group_cols=["u"]).where(F.col("_pe") > 0).select(
        "u", "score", "_te", "_pe", (F.col("_te_cum") - F.col("_te")).alias("_tb"), (F.col("_pe_cum") - F.col("_pe")).alias("_pb")
    )
    totals = per_score.groupBy("u").agg(F.sum("_te").alias("_nt"), F.sum("_pe").alias("_np"))
    per_pos = cum.join(counts, ["u", "score"]).select(
        "u",
        (F.col("_pe") * ((F.col("_below") - F.col("_tb") - F.col("_pb"))
                         + 0.5 * (F.col("_eq") - F.col("_te") - F.col("_pe")))).alias("_num"),
    )
    agg = per_pos.groupBy("u").agg(F.sum("_num").alias("_num")).join(totals, "u")
    neg = F.lit(n_items) - F.col("_nt") - F.col("_np")
    return agg.where((F.col("_np") > 0) & (neg > 0)).select(
        F.col("u").cast("int").alias(user_col), (F.col("_num") / (F.col("_np") * neg)).alias("auc")
    )
