"""A registry in key buckets, of which a change rewrites only those it touches.

A key has two hashes, of its project and of its item. A bucket holds the keys whose hashes begin with certain bits,
some of each. One that grows is cut by further bits of the project hash, so that a project lies together; but if
a single project is too large for a bucket, by bits of the item hash. The manifest of a version names each bucket
and the version that wrote it; the directory of a manifest is written last, and until then nothing of the new
version is seen.

Scores change with every document of a project. They are therefore not stored but derived on reading, from
the clock of the project: the time of its last document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from taskfold.functions.recency import recency_score
from taskfold.schema import FEATURE, KEY
from taskfold.session import stored
from taskfold.sources.snapshots import committed

#: Bits of the project hash and of the item hash, the version that wrote the bucket, its rows, those of its largest project.
MANIFEST = "p_depth int, p_prefix long, i_depth int, i_prefix long, version long, n_rows long, top_rows long"
BUCKET = ("p_depth", "p_prefix", "i_depth", "i_prefix")
CLOCK = "project_id string, as_of long"
BUCKET_ROWS = 1_000_000
_BITS = 32
_HASHES = {n: f"shiftrightunsigned(xxhash64({c}), {_BITS})" for n, c in (("_p", "project_id"), ("_i", "id"))}


def create(spark: SparkSession, root: str) -> bool:
    """Start with one empty bucket as version 0, unless there is a registry. Tells whether it did."""
    if committed(spark, f"{root}/manifest"):
        return False
    first = spark.createDataFrame([(0, 0, 0, 0, 0, 0, 0)], MANIFEST)
    first.write.mode("overwrite").parquet(f"{root}/manifest/v=0")
    return True


def versions(spark: SparkSession, root: str) -> list[int]:
    return committed(spark, f"{root}/manifest")


def manifest(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest/v={version}")


def _in_buckets(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """``rows`` with the columns of their bucket: an equi-join on the first bits, for all numbers of bits that occur."""
    depths = buckets.select("p_depth", "i_depth").distinct().collect()  # 33 * 33 at most
    at = [
        F.struct(
            F.lit(p).alias("p_depth"), F.expr(f"shiftright(_p, {_BITS - p})").alias("p_prefix"),
            F.lit(i).alias("i_depth"), F.expr(f"shiftright(_i, {_BITS - i})").alias("i_prefix"),
        )
        for p, i in sorted(tuple(d) for d in depths) or [(0, 0)]
    ]
    placed = rows.withColumns({n: F.expr(e) for n, e in _HASHES.items()}).withColumn("_at", F.explode(F.array(*at)))
    return placed.select(*rows.columns, "_p", "_i", "_at.*").join(buckets, list(BUCKET))


def _read(spark: SparkSession, root: str, buckets: DataFrame) -> DataFrame:
    rows = buckets.filter("n_rows > 0").select("version", *BUCKET).collect()
    paths = [f"{root}/data/v={version}/bucket={'-'.join(map(str, bucket))}" for version, *bucket in rows]
    return spark.read.schema(FEATURE).parquet(*paths) if paths else spark.createDataFrame([], FEATURE)


def touched(spark: SparkSession, root: str, version: int, keys: DataFrame) -> DataFrame:
    """The buckets of ``version`` that hold or would hold ``keys`` (project_id, id), with the number of the keys, in all
    and of the project that has most."""
    found = _in_buckets(keys.select(*KEY).distinct(), manifest(spark, root, version))
    columns = manifest(spark, root, version).columns
    by_project = found.groupBy(*columns, "project_id").agg(F.count("*").alias("n"))
    return stored(by_project.groupBy(*columns).agg(F.sum("n").alias("n_keys"), F.max("n").alias("top_keys")), "touched")


def contents(spark: SparkSession, root: str, buckets: DataFrame) -> DataFrame:
    """The items of some buckets, with the scores they were written with."""
    return _read(spark, root, buckets)


def rewrite(
    spark: SparkSession,
    root: str,
    version: int,
    buckets: DataFrame,
    change: Callable[[DataFrame], DataFrame],
    clock: DataFrame,
    bucket_rows: int = BUCKET_ROWS,
    fold_clocks_every: int = 16,
) -> int:
    """Write version ``version`` + 1: the items of ``buckets`` (see :func:`touched`) go through ``change``, all others stay
    in the files they are in. Writing it again replaces it. Returns the number of rows written.

    A bucket that could grow beyond twice ``bucket_rows`` is cut first. ``clock`` (project_id, as_of) holds the
    projects of the change; their clocks are kept apart and folded from time to time.
    """
    new = version + 1
    # the keys may be there already, so a bucket is left whole up to twice the size
    halvings = "cast(CASE WHEN {1} <= 2 * {2} THEN 0 ELSE least({0}, ceil(log2(({1}) / {2}))) END AS int)"
    i_more = halvings.format(f"{_BITS} - i_depth", "top_rows + top_keys", bucket_rows)
    all_more = halvings.format(2 * _BITS, "n_rows + n_keys", bucket_rows)
    cut = buckets.select(*BUCKET, F.expr(i_more).alias("i_more"), F.expr(all_more).alias("all_more")).selectExpr(
        *BUCKET, "i_more", f"greatest(0, least({_BITS} - p_depth, all_more - i_more)) AS p_more"
    )
    after = _in_buckets(change(_read(spark, root, buckets)), cut)
    name = F.expr(
        f"concat_ws('-', p_depth + p_more, shiftright(_p, {_BITS} - p_depth - p_more), "
        f"i_depth + i_more, shiftright(_i, {_BITS} - i_depth - i_more))"
    )
    data = f"{root}/data/v={new}"
    (
        after.select(*FEATURE.fieldNames(), name.alias("bucket"))
        .repartition("bucket")
        .sortWithinPartitions("bucket", *KEY)
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(data)
    )
    by_project = spark.read.schema("project_id string, bucket string").parquet(data).groupBy("bucket", "project_id").count()
    counts = by_project.groupBy("bucket").agg(F.sum("count").alias("n"), F.max("count").alias("top"))
    numbers = F.split("bucket", "-").cast("array<long>")
    counts = counts.select(*[numbers[k].alias(c) for k, c in enumerate(BUCKET)], "n", "top")
    parts = "explode(sequence(shiftleft({0}_prefix, {0}_more), shiftleft({0}_prefix + 1, {0}_more) - 1)) AS {0}_new"
    children = cut.select("*", F.expr(parts.format("p"))).select("*", F.expr(parts.format("i"))).selectExpr(
        "p_depth + p_more AS p_depth", "p_new AS p_prefix", "i_depth + i_more AS i_depth", "i_new AS i_prefix"
    )
    written = children.join(counts, list(BUCKET), "left").select(
        *BUCKET, F.lit(new).cast("long").alias("version"), F.coalesce("n", F.lit(0)).alias("n_rows"), F.coalesce("top", F.lit(0)).alias("top_rows")
    )
    kept = manifest(spark, root, version).join(buckets.select(*BUCKET), list(BUCKET), "left_anti")
    _keep_clocks(spark, root, new, clock, fold_clocks_every)
    kept.unionByName(written).write.mode("overwrite").parquet(f"{root}/manifest/v={new}")
    return manifest(spark, root, new).filter(F.col("version") == new).agg(F.sum("n_rows")).first()[0] or 0


def _keep_clocks(spark: SparkSession, root: str, version: int, clock: DataFrame, every: int) -> None:
    clock.select("project_id", "as_of").write.mode("overwrite").parquet(f"{root}/clocks/v={version}")
    if version % every == 0:
        clocks(spark, root, version, folded_before=version).write.mode("overwrite").parquet(f"{root}/folded_clocks/v={version}")


def clocks(spark: SparkSession, root: str, version: int, folded_before: int | None = None) -> DataFrame:
    """(project_id, as_of) of all projects that had a document up to ``version``."""
    limit = version + 1 if folded_before is None else folded_before
    folded = max((v for v in committed(spark, f"{root}/folded_clocks") if v < limit), default=0)
    parts = [(f"{root}/folded_clocks/v={folded}", folded)] if folded else []
    parts += [(f"{root}/clocks/v={v}", v) for v in range(folded + 1, version + 1)]
    out = None
    for path, v in parts:
        own = spark.read.schema(CLOCK).parquet(path).withColumn("v", F.lit(v))
        out = own if out is None else out.unionByName(own)
    if out is None:
        return spark.createDataFrame([], CLOCK)
    return out.groupBy("project_id").agg(F.max_by("as_of", "v").alias("as_of"))


def registry(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """All items of a version (default: the newest), scored by the clocks of their projects."""
    if version is None:
        version = max(versions(spark, root), default=None)
    if version is None:
        raise FileNotFoundError(f"registry not initialized: {root}")
    items = _read(spark, root, manifest(spark, root, version))
    timed = items.join(clocks(spark, root, version).withColumnRenamed("as_of", "_as_of"), "project_id", "left")
    fresh = recency_score(F.col("last_updated"), F.col("_as_of"))
    score = F.when(F.col("_as_of").isNull(), F.col("recency_score")).otherwise(fresh)
    return timed.withColumn("recency_score", score).select(*FEATURE.fieldNames())


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Remove bucket files that none of the ``keep`` newest versions refers to, and older manifests. Returns how many
    buckets went. Run it while no version is being written."""
    known = versions(spark, root)
    living = known[-keep:]
    used = {
        tuple(r) for v in living for r in manifest(spark, root, v).filter("n_rows > 0").select("version", *BUCKET).collect()
    }
    hadoop = spark._jvm.org.apache.hadoop.fs
    data = hadoop.Path(f"{root}/data")
    fs = data.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = 0
    for status in fs.listStatus(data) if fs.exists(data) else []:
        version = int(status.getPath().getName().removeprefix("v="))
        if version > living[-1]:
            continue  # being written
        for bucket in fs.listStatus(status.getPath()):
            name = bucket.getPath().getName()
            if name.startswith("bucket=") and (version, *map(int, name.removeprefix("bucket=").split("-"))) not in used:
                fs.delete(bucket.getPath(), True)
                gone += 1
    for v in known[:-keep]:
        fs.delete(hadoop.Path(f"{root}/manifest/v={v}"), True)
    return gone
