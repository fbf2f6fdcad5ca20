"""Codes for items: from a user's batch function, or by residual nearest centroids.

A codebook is a table ``level INT, code INT, centroid ARRAY<DOUBLE>``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions import text as tx
from tesserae.functions.prompts import without_answer
from tesserae.workspace import store

SLICE_BYTES = 64 * 1024 * 1024
POINT_BLOCK, CODE_BLOCK = 1024, 4096
PIVOTS, POINT_ROWS = 1024, 50_000
BOOK = {"level": pa.int32(), "code": pa.int32(), "centroid": pa.list_(pa.float64())}
_NEAR = 1e-9


def generate(
    prompts: DataFrame,
    make_predict,
    codebook_tokens: list[int],
    size: int,
    prompt: str = "guessing_prompt",
    batch_size: int = 64,
) -> DataFrame:
    """Adds ``semantic_ids, semantic_id_tokens, semantic_id_text`` from a user's batch function.

    ``make_predict()`` runs once per Python worker (load the model there) and returns a function
    from an array of prompts in JSON form to an array of rows of token ids. Rows keep their own
    key columns, so no order is needed to match outputs to inputs.
    """
    predict = predict_batch_udf(
        make_predict, return_type=T.ArrayType(T.LongType()), batch_size=batch_size
    )
    text = F.to_json(F.col(prompt))
    return with_code_text(
        prompts.withColumn("_tokens", predict(text))
        .withColumn("semantic_ids", tx.lookup_codes("_tokens", codebook_tokens, size))
        .drop("_tokens")
    )


def rebuild(
    coded: DataFrame, make_predict, prompt: str = "reconstruction_prompt", ids: str = "semantic_ids",
    name: str = "prediction", batch_size: int = 64,
) -> DataFrame:
    """Adds ``prediction``, the text that a user's batch function gives for a prompt and codes.

    ``make_predict()`` runs once per Python worker and returns a function from an array of JSON
    objects (``prompt``: the turns without the answer, ``ids``: the codes) to an array of texts.
    """
    predict = predict_batch_udf(make_predict, return_type=T.StringType(), batch_size=batch_size)
    asked = F.to_json(F.struct(without_answer(prompt).alias("prompt"), F.col(ids).alias("ids")))
    return coded.withColumn(name, predict(asked))


def with_code_text(rows: DataFrame, ids: str = "semantic_ids") -> DataFrame:
    """Adds the token and text renderings of the codes."""
    return rows.withColumn("semantic_id_tokens", tx.code_tokens(ids)).withColumn(
        "semantic_id_text", tx.format_ids(ids)
    )


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the closest centroid; the lowest index on exact ties.

    Points and centroids meet in blocks, so the scores held at a time are bounded.
    """
    best, least = np.zeros(len(points), np.int64), np.full(len(points), np.inf)
    for row in range(0, len(points), POINT_BLOCK):
        own = points[row : row + POINT_BLOCK]
        for at in range(0, len(centroids), CODE_BLOCK):
            index, distance = _nearest_of_block(own, centroids[at : at + CODE_BLOCK])
            nearer = distance < least[row : row + POINT_BLOCK]
            best[row : row + POINT_BLOCK][nearer] = index[nearer] + at
            least[row : row + POINT_BLOCK][nearer] = distance[nearer]
    return best, least


def _nearest_of_block(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A matrix product finds the candidates; where a second one is within rounding distance the
    candidates are compared again by summing squared differences.
    """
    scores = (centroids**2).sum(axis=1)[None, :] - 2.0 * points @ centroids.T
    best = scores.argmin(axis=1)
    low = scores[np.arange(len(points)), best][:, None]
    scale = (points**2).sum(axis=1)[:, None] + np.abs(low) + 1.0
    close = scores <= low + _NEAR * scale
    for row in np.flatnonzero(close.sum(axis=1) > 1):
        codes = np.flatnonzero(close[row])
        best[row] = codes[((centroids[codes] - points[row]) ** 2).sum(axis=1).argmin()]
    return best, ((points - centroids[best]) ** 2).sum(axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(column), -1)


def _lists(matrix: np.ndarray, kind: pa.DataType, missing: np.ndarray | None = None) -> pa.Array:
    offsets = np.arange(len(matrix) + 1, dtype="int32") * (matrix.shape[1] if len(matrix) else 0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel(), kind, mask=missing))


def _known(rest: pa.Array, width: int) -> np.ndarray:
    """The places of the vectors that are not null; all of these must be ``width`` long."""
    sizes = np.nan_to_num(pc.list_value_length(rest).to_numpy(zero_copy_only=False).astype(float), nan=-1)
    if np.any((sizes >= 0) & (sizes != width)):
        raise ValueError(f"a vector has another length than the centroids, {width}")
    return np.flatnonzero(sizes >= 0)


def _placed(found: pa.StructArray, known: np.ndarray, rows: int) -> pa.Array:
    """``found`` at the places ``known``, null elsewhere."""
    if len(known) == rows:
        return found
    place = np.full(rows, -1)
    place[known] = np.arange(len(known))
    return found.take(pa.array(place, mask=place < 0))


_CHOICE = "code int, distance double"


def _choose(spark, codes: list[int], centroids: np.ndarray):
    shared = spark.sparkContext.broadcast((np.array(codes, dtype="int32"), centroids))

    @F.arrow_udf(_CHOICE)
    def choose(rest: pa.Array) -> pa.Array:
        ids, matrix = shared.value
        known = _known(rest, matrix.shape[1])
        index, distance = nearest(_matrix(rest.take(pa.array(known))), matrix) if len(known) else (known, np.zeros(0))
        found = pa.StructArray.from_arrays(
            [pa.array(ids[index], pa.int32()), pa.array(distance, pa.float64())], names=["code", "distance"]
        )
        return _placed(found, known, len(rest))

    return choose


_CHOICES = "codes array<int>, rest array<double>"


def _choose_levels(spark, books: list[tuple[list[int], np.ndarray]]):
    """The nearest centroids of consecutive levels and what is left after them.

    All levels are chosen in one Python worker. The function counts as non-deterministic, since Spark
    copies others into filters that it infers, and each copy would be one more worker for each task.
    """
    shared = spark.sparkContext.broadcast([(np.array(codes, dtype="int32"), matrix) for codes, matrix in books])

    @F.arrow_udf(_CHOICES)
    def choose(rest: pa.Array) -> pa.Array:
        for _, matrix in shared.value:
            known = _known(rest, matrix.shape[1])
        own = rest if len(known) == len(rest) else rest.take(pa.array(known))
        missing = own.flatten().is_null().to_numpy(zero_copy_only=False)
        left = _matrix(own) if len(known) else np.zeros((0, 0))
        chosen = np.zeros((len(known), len(shared.value)), "int32")
        for level, (ids, matrix) in enumerate(shared.value if len(known) else []):
            index, _ = nearest(left, matrix)
            chosen[:, level] = ids[index]
            for row in range(0, len(left), POINT_BLOCK):
                left[row : row + POINT_BLOCK] -= matrix[index[row : row + POINT_BLOCK]]
        found = pa.StructArray.from_arrays(
            [_lists(chosen, pa.int32()), _lists(left, pa.float64(), missing)], names=["codes", "rest"]
        )
        del own, left
        return _placed(found, known, len(rest))

    return choose.asNondeterministic()


def residual_codes(
    vectors: DataFrame, codebook: DataFrame, levels: int, vector: str = "embedding",
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Adds ``ids`` and ``residual``: at each level the nearest centroid of what is left.

    A null vector has null codes; one of another length than the centroids is an error. Of equally
    near centroids the one with the lowest code is taken.

    A level of at most ``slice_bytes`` is sent to the executors, and the choice is a map over the
    rows, one for as many consecutive levels as have that size together. A larger one stays a
    table: see ``far_choice``. Filter rows before: Spark moves no later filter below the map.
    """
    spark = vectors.sparkSession
    state = vectors.withColumn(
        "residual", F.transform(F.col(vector), lambda x: x.cast("double"))
    ).withColumn("ids", F.array().cast("array<int>"))
    sent = []  # levels that are still to be added to the state

    def chosen(state: DataFrame, codes, rest) -> DataFrame:
        ids = F.when(F.col("_best").isNotNull(), F.concat("ids", codes))
        return state.select(*vectors.columns, rest.alias("residual"), ids.alias("ids"))

    def with_sent(state: DataFrame) -> DataFrame:
        state = state.withColumn("_best", _choose_levels(spark, sent)(F.col("residual")))
        return chosen(state, F.col("_best.codes"), F.col("_best.rest"))

    for level in range(levels):
        book = codebook.filter(F.col("level") == level).select("code", "centroid")
        codes, width = book.agg(F.count(F.lit(1)), F.max(F.size("centroid"))).first()
        if not codes:
            raise ValueError(f"the codebook has no level {level}")
        size = 8 * width * codes
        if sent and sum(matrix.nbytes for _, matrix in sent) + size > slice_bytes:
            state, sent = with_sent(state), []
        if size <= slice_bytes:
            found = book.orderBy("code").collect()
            sent.append(([r["code"] for r in found], np.array([r["centroid"] for r in found], dtype="float64")))
        else:
            block = min(CODE_BLOCK, max(1, slice_bytes // (8 * width)))
            state = far_choice(state, store(book, "level"), codes, block)
            state = chosen(state, F.array("_best.code"), F.zip_with("residual", "_best.chosen", lambda r, c: r - c))
    return with_sent(state) if sent else state


def far_choice(state: DataFrame, book: DataFrame, codes: int, block: int, point_rows: int = POINT_ROWS) -> DataFrame:
    """``state`` with ``_best``, the nearest of more centroids than a task should hold.

    Centroids are grouped around pivots, a bounded sample of them. By the triangle inequality a
    group whose pivot is further away than its radius and a sure bound on the nearest distance
    cannot hold the nearest centroid, so a point meets the other groups only. They meet in tasks of
    about ``block`` centroids and ``point_rows`` points; the least of the partial results is the
    choice. The driver reads the pivots and three numbers per group.
    """
    spark = state.sparkSession
    rows = store(state.withColumn("_row", F.monotonically_increasing_id()), "points")
    picked = book.orderBy(F.xxhash64("code"), "code").limit(min(PIVOTS, -(-codes // block)))
    pivots = np.array([r["centroid"] for r in picked.collect()], dtype="float64")
    near = _choose(spark, list(range(len(pivots))), pivots)(F.col("centroid"))
    members = store(
        book.withColumn("_near", near).select(
            F.col("_near.code").alias("group"), F.sqrt("_near.distance").alias("gap"), "code", "centroid"
        ),
        "centroid-groups",
    )
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("least"), F.max("gap").alias("radius"))
    groups = {r["group"]: (-(-r["n"] // block), r["least"], r["radius"]) for r in sizes.collect()}
    reached = rows.filter(F.col("residual").isNotNull()).select(
        "_row", "residual", F.explode(_reachable(spark, pivots, groups)(F.col("residual"))).alias("group")
    )
    reached = store(reached, "reachable-groups")
    counts = {r["group"]: r["count"] for r in reached.groupBy("group").count().collect()}
    plan = _local(
        spark, [(g, blocks, -(-counts.get(g, 0) // point_rows)) for g, (blocks, *_) in groups.items()],
        group=pa.int32(), blocks=pa.int64(), salts=pa.int64(),
    )
    # A row per group, so the plan is as small as the pivots.
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    points = reached.join(F.broadcast(plan), "group").withColumn("salt", F.pmod(F.xxhash64("_row"), F.col("salts")))
    points = points.withColumn("block", spread("blocks")).select("group", "block", "salt", "_row", "residual")
    centers = members.join(F.broadcast(plan.filter("salts > 0")), "group")
    centers = centers.withColumn("block", F.pmod(F.xxhash64("code"), F.col("blocks"))).withColumn("salt", spread("salts"))
    centers = centers.select("group", "block", "salt", "code", "centroid")
    key = ["group", "block", "salt"]
    partial = points.groupBy(*key).cogroup(centers.groupBy(*key)).applyInArrow(
        _nearest_in_block, "_row long, distance double, code int"
    )
    best = partial.groupBy("_row").agg(F.min(F.struct("distance", "code")).alias("_b"))
    best = best.select("_row", F.col("_b.distance").alias("distance"), F.col("_b.code").alias("code"))
    chosen = best.join(book, "code").select("_row", F.struct("code", "distance", F.col("centroid").alias("chosen")).alias("_best"))
    return rows.join(chosen, "_row", "left").drop("_row")


def _reachable(spark, pivots: np.ndarray, groups: dict):
    """The groups that may hold the nearest centroid of a point."""
    numbers = sorted(groups)
    least = np.array([groups[g][1] for g in numbers])
    radius = np.array([groups[g][2] for g in numbers])
    shared = spark.sparkContext.broadcast((np.array(numbers, np.int32), pivots[numbers], least, radius))

    @F.arrow_udf("array<int>")
    def reachable(rest: pa.Array) -> pa.Array:
        numbers, pivots, least, radius = shared.value
        if np.any(pc.list_value_length(rest).to_numpy(zero_copy_only=False) != pivots.shape[1]):
            raise ValueError(f"a vector has another length than the centroids, {pivots.shape[1]}")
        points, found = _matrix(rest), []
        for at in range(0, len(points), POINT_BLOCK):
            own = points[at : at + POINT_BLOCK]
            squares = (own**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :]
            away = np.sqrt(np.maximum(squares - 2.0 * own @ pivots.T, 0.0))
            # Rounding of the squares moves a distance by at most the root of its share of them.
            slack = np.sqrt(_NEAR * (squares.max(axis=1, keepdims=True) + 1.0))
            bound = (away + least).min(axis=1, keepdims=True) + 2 * slack
            found.extend(numbers[row] for row in away - radius <= bound)
        return pa.array(found, pa.list_(pa.int32()))

    return reachable


def _nearest_in_block(points: pa.Table, centers: pa.Table) -> pa.Table:
    schema = pa.schema([("_row", pa.int64()), ("distance", pa.float64()), ("code", pa.int32())])
    if not points.num_rows or not centers.num_rows:
        return schema.empty_table()
    centers = centers.sort_by("code")
    index, distance = nearest(
        _matrix(points.column("residual").combine_chunks()), _matrix(centers.column("centroid").combine_chunks())
    )
    code = centers.column("code").to_numpy()[index]
    return pa.Table.from_arrays([points.column("_row"), pa.array(distance), pa.array(code, pa.int32())], schema=schema)


def fit_codebook(
    vectors: DataFrame, levels: int, codes: int, seed: int = 42, vector: str = "embedding",
    max_iter: int = 20, revivals: int = 20,
) -> DataFrame:
    """One seeded k-means per level, each on the residuals of the levels before it.

    Codes that no vector takes are revived, see ``revived``; with fewer distinct residuals than
    ``codes`` a level has fewer codes. Null vectors take no part.
    """
    spark = vectors.sparkSession
    rest = vectors.select(F.transform(vector, lambda x: x.cast("double")).alias("v"))
    rest = store(rest.filter(F.col("v").isNotNull()), "rest")
    centers = []
    for level in range(levels):
        model = KMeans(k=codes, seed=seed + level, maxIter=max_iter, featuresCol="f").fit(
            rest.select(array_to_vector("v").alias("f"))
        )
        found = {i: [float(x) for x in c] for i, c in enumerate(model.clusterCenters())}
        found = revived(rest, found, codes, revivals)
        centers += [(level, i, c) for i, c in sorted(found.items())]
        if level + 1 < levels:
            coded = residual_codes(rest, _one_level(spark, found), 1, "v")
            rest = store(coded.select(F.col("residual").alias("v")), "rest")
    return _local(spark, centers, **BOOK)


def _one_level(spark, centers: dict[int, list[float]]) -> DataFrame:
    return _local(spark, [(0, i, c) for i, c in sorted(centers.items())], **BOOK)


def _local(spark, rows: list[tuple], **kinds: pa.DataType) -> DataFrame:
    """A small table of the driver's; as an Arrow table, since lists pass through Python workers on the executors."""
    columns = zip(*rows) if rows else [()] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds)))


def cell_loads(points: DataFrame, centers: dict[int, list[float]], vector: str = "v") -> DataFrame:
    """``code, n, error, far``: vectors and squared error per used code, and its farthest vector with that error."""
    coded = residual_codes(points, _one_level(points.sparkSession, centers), 1, vector)
    error = F.aggregate("residual", F.lit(0.0), lambda s, x: s + x * x)
    rows = coded.select(F.get("ids", F.lit(0)).alias("code"), F.struct(error.alias("d"), F.col(vector).alias("v")).alias("far"))
    return rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum("far.d").alias("error"), F.max("far").alias("far"))


def revived(points: DataFrame, centers: dict[int, list[float]], codes: int, rounds: int, vector: str = "v") -> dict:
    """The centers, those that no vector takes moved to where they are needed.

    In each round the loads are counted, and the cells with the largest error are split: an unused
    center moves to the farthest vector of such a cell, which it then takes, so the error never
    grows. Rounds end when every code is used, or every vector lies on a center. The driver reads
    one row per code, as many as it holds centers.
    """
    centers = dict(centers)
    for _ in range(rounds):
        cells = cell_loads(points, centers, vector).collect()
        used = {r["code"] for r in cells}
        unused = [i for i in range(codes) if i not in used]
        # A cell with one vector would only hand its place on.
        split = sorted((r for r in cells if r["far"]["d"] > 0 and r["n"] > 1), key=lambda r: (-r["error"], r["code"]))
        if not unused or not split:
            break
        for code, cell in zip(unused, split):
            centers[code] = list(cell["far"]["v"])
    else:
        used = {r["code"] for r in cell_loads(points, centers, vector).select("code").collect()}
    return {i: c for i, c in centers.items() if i in used}


def reconstruction_error(coded: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds ``squared_error`` and ``cosine`` of the sum of chosen centroids against the source.

    The sum of the chosen centroids is the source minus its residual.
    """
    def dot(a, b):
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)

    source, rest = F.col(vector), F.col("residual")
    rebuilt = F.zip_with(source, rest, lambda x, r: x.cast("double") - r)
    coded = coded.withColumn("rebuilt", rebuilt)
    norm = F.sqrt(dot(source, source)) * F.sqrt(dot(F.col("rebuilt"), F.col("rebuilt")))
    return coded.withColumn("squared_error", dot(rest, rest)).withColumn(
        "cosine", F.when(norm > 0, dot(source, F.col("rebuilt")) / norm).otherwise(F.lit(0.0))
    )


def decode(codes: DataFrame, codebook: DataFrame, levels: int, ids: str = "ids") -> DataFrame:
    """Adds ``rebuilt``: the sum of the centroids named by stored codes, level by level.

    Each level is an equi-join with that level's centroids. Unknown codes contribute nothing.
    """
    out = codes.withColumn("rebuilt", F.lit(None).cast("array<double>"))
    for level in range(levels):
        book = codebook.filter(F.col("level") == level)
        book = book.select(F.col("code").alias("_code"), F.col("centroid").alias("_c"))
        summed = (
            F.when(F.col("_c").isNull(), F.col("rebuilt"))
            .when(F.col("rebuilt").isNull(), F.col("_c"))
            .otherwise(F.zip_with("rebuilt", "_c", lambda x, y: x + y))
        )
        out = out.withColumn("_code", F.get(ids, F.lit(level))).join(book, "_code", "left")
        out = out.withColumn("rebuilt", summed).drop("_code", "_c")
    return out
