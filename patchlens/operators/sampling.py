"""Windows, sampling, splits and top-k.

Seeded randomness is replaced by a hash order: ``md5(value ':' seed)``.  It
is stable across partitionings and re-executions (so a lost executor
recomputes the same rows) and gives the same order in any SQL engine.

Scale notes
-----------
* Per-class quotas (W1, W5) use ``row_number() <= k`` with a constant upper
  bound, which Spark plans as a ``WindowGroupLimit`` *before* the exchange:
  every task keeps at most k rows per class, so a class holding most of the
  data never reaches one task whole.
* Exact per-class ranks over the whole table (W3, W6, W8, W4) are computed by
  ``hash_rank``: a histogram of key prefixes, as fine as keeps each within a bound of rows, is
  turned into offsets, and rows are ranked inside (class, prefix) partitions.
* Keep-first deduplication (W2) groups digests and order keys, three numbers a
  row; texts are neither sorted nor grouped, and a group of copies
  holding a third of the rows collapses to one row per task before the
  shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampType

from patchlens.session import materialize

DEFAULT_SEED = 42
NULL_TOKEN = "\u0000null"


def hash_key(col, seed: int = DEFAULT_SEED) -> Column:
    """md5 of ``value:seed`` (nulls hash as one token)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.md5(F.concat(F.coalesce(c.cast("string"), F.lit(NULL_TOKEN)), F.lit(f":{seed}")))


def _null_safe_on(left: DataFrame, right: DataFrame, cols: list[str]):
    if not cols:
        return F.lit(True)
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in cols])


#: Rows of one hash range that a task ranks, and the same of rows that carry texts, lists or vectors along.
RANK_ROWS = 1 << 20
WIDE_ROWS = 1 << 12


def _rank_rows(df: DataFrame, named: list[str]) -> int:
    """How many rows of ``df`` a task should rank at once: fewer if columns besides ``named`` can be of any length."""
    fixed = (NumericType, BooleanType, DateType, TimestampType)
    wide = any(f.name not in named and not isinstance(f.dataType, fixed) for f in df.schema.fields)
    return min(WIDE_ROWS, RANK_ROWS) if wide else RANK_ROWS


def _prefix_sizes(keys: DataFrame, key: str, by: list[str], rank_rows: int) -> tuple[DataFrame, int]:
    """(*by, _bucket, _n): rows per key prefix, stored, and the prefixes' length.

    No prefix at all if every class is within ``rank_rows``; otherwise the histogram gets finer as long as a prefix
    has more rows than that and two more digits part them (equal keys are never parted).
    """
    digits, most = 3, None
    while True:
        sizes = materialize(keys.groupBy(*by, F.substring(key, 1, digits).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")))
        largest = sizes.agg(F.max("_n")).first()[0] or 0
        if largest <= rank_rows or largest == most or digits > 30:
            break
        digits, most = digits + 2, largest
    whole = sizes.groupBy(*by).agg(F.sum("_n").alias("_n")).withColumn("_bucket", F.lit(""))
    if (whole.agg(F.max("_n")).first()[0] or 0) <= rank_rows:
        return whole, 0
    return sizes, digits


def _ranked(df: DataFrame, key: str, by: list[str], tie: str | None, sizes: DataFrame, digits: int, out: str) -> DataFrame:
    order = [F.col(key)] + ([F.col(tie)] if tie else [])
    with_b = df.withColumn("_bucket", F.substring(F.col(key), 1, digits))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    offsets = offsets.select(*[F.col(c).alias("_o_" + c) for c in by], F.col("_bucket").alias("_o_bucket"),
                             "_offset")
    cond = F.col("_bucket") == F.col("_o_bucket")
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col("_o_" + c))
    joined = with_b.join(offsets, cond, "inner")
    w = Window.partitionBy(*by, "_bucket").orderBy(*order)
    return (joined.withColumn(out, (F.row_number().over(w) + F.col("_offset")).cast("long"))
            .drop("_bucket", "_o_bucket", "_offset", *["_o_" + c for c in by]))


def hash_rank(df: DataFrame, key: str, by: list[str] = (), tie: str | None = None,
              rank_rows: int | None = None, out: str = "rank") -> DataFrame:
    """Exact ``row_number() over (partition by <by> order by <key>, <tie>)``.

    ``key`` must be a hex hash column: a task ranks the rows of one prefix, at most ``rank_rows`` unless more share a key
    (by default as many as suits what the rows carry: they are sorted whole).
    """
    by = list(by)
    rank_rows = rank_rows or _rank_rows(df, [key, *by, tie])
    sizes, digits = _prefix_sizes(df, key, by, rank_rows)
    return _ranked(df, key, by, tie, sizes, digits, out)


def first_keys(df: DataFrame, limits: dict, label: str, order: str, spread: int = 256) -> DataFrame:
    """(label, order) of the first ``limits[c]`` rows of each class ``c``; ``order`` must be unique.

    Two narrow steps: the first rows of each of ``spread`` parts of a class, then the
    first of those. The last step gets at most spread * limit keys of a class.
    """
    most = max(limits.values())
    keys = df.where(F.col(label).isin(list(limits))).select(label, order)
    part = F.pmod(F.xxhash64(order), F.lit(spread))
    some = keys.withColumn("_part", part).withColumn("_rn", F.row_number().over(
        Window.partitionBy(label, "_part").orderBy(order))).where(F.col("_rn") <= most).drop("_part", "_rn")
    ranked = some.withColumn("_rn", F.row_number().over(Window.partitionBy(label).orderBy(order)))
    within = reduce(lambda a, b: a | b, [(F.col(label) == c) & (F.col("_rn") <= q) for c, q in limits.items()])
    return ranked.where((F.col("_rn") <= most) & within).drop("_rn")


# W1
def quota_per_class(df: DataFrame, quotas: dict, label: str = "label", order: str = "row_id") -> DataFrame:
    """First ``quotas[c]`` rows of each class ``c`` in ``order`` (unique).

    The class's last order value is a scalar; the rows themselves are filtered in place, never shuffled.
    """
    cut = quota_cutoffs(df, quotas, label, order)
    last = {c: cut.where(F.col(label) == c).select("last_" + order).scalar() for c in quotas}
    return df.where(reduce(lambda a, b: a | b, [(F.col(label) == c) & (F.col(order) <= last[c]) for c in quotas]))


def quota_cutoffs(df: DataFrame, quotas: dict, label: str = "label", order: str = "row_id") -> DataFrame:
    """Per class: rows collected and the ``order`` value of the last one."""
    return (first_keys(df, quotas, label, order)
            .groupBy(label).agg(F.count(F.lit(1)).alias("collected"), F.max(order).alias("last_" + order)))


def _salted(keys: list[str], salt: int) -> Column:
    """xxhash64 of the columns and of which of them are null."""
    return F.xxhash64(F.lit(salt), *[x for k in keys for x in (F.col(f"`{k}`").isNull(), F.col(f"`{k}`"))])


def digest128(keys: list[str]) -> list[Column]:
    return [_salted(keys, 1), _salted(keys, 2)]


# W2
def dedup_keep_first(df: DataFrame, keys: list[str], order: str = "row_id", digest=digest128) -> DataFrame:
    """Drop rows whose ``keys`` repeat an earlier row (by ``order``, unique); null keys are equal.

    Rows are told apart by a 128-bit digest of their keys and a further 64-bit one as a check: only ``order`` and these
    numbers are stored and grouped. In a group whose check differs the digests have collided; its rows, and no others, are grouped by
    the keys themselves (``digest`` gives columns without nulls). The rows to drop are a stored table, so the last step knows its size: it is broadcast if small, and ``df``
    itself is filtered in place; beyond that one join on ``order`` deals ``df`` out evenly, however large a group of copies is.
    """
    marks = materialize(df.select(F.col(f"`{order}`").alias("_o"), *[c.alias(f"_d{i}") for i, c in enumerate(digest(keys))],
                                  _salted(keys, 3).alias("_check")))
    parts = [c for c in marks.columns if c.startswith("_d")]
    groups = materialize(marks.groupBy(*parts).agg(
        F.count("*").alias("_n"), F.min("_o").alias("_first"), (F.min("_check") != F.max("_check")).alias("_clash")).where("_n > 1"))
    dropped = marks.join(groups.where("not _clash"), parts).where(F.col("_o") > F.col("_first")).select("_o")
    clashes = groups.where("_clash").select(*parts)
    if not clashes.isEmpty():
        named = df.select(F.col(f"`{order}`").alias("_o"), *[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)])
        ids = marks.join(clashes, parts).select("_o")
        rows = materialize(named.join(ids, "_o"))
        cols = [c for c in rows.columns if c.startswith("_k")]
        exact = rows.groupBy(*cols).agg(F.min("_o").alias("_first"))
        first = exact.select(F.col("_first").alias("_o"))
        dropped = dropped.unionByName(rows.select("_o").join(first, "_o", "left_anti"))
    gone = materialize(dropped)
    return df.join(gone, F.col(f"`{order}`") == F.col("_o"), "left_anti")


# W3
def shuffle_rows(df: DataFrame, seed: int = DEFAULT_SEED, id_col: str = "row_id",
                 out: str = "shuffle_key", rank: str = "shuffle_rank") -> DataFrame:
    """Whole-table permutation: rows with a seeded hash of the id and their place in its order (from 1)."""
    return hash_rank(df.withColumn(out, hash_key(id_col, seed)), out, tie=id_col, out=rank)


# W4
def last_test_key(df: DataFrame, test_frac: float = 0.25, seed: int = DEFAULT_SEED, col: str = "project") -> Column:
    """The hash of the last of the ``max(1, int(n * test_frac))`` test projects, as a scalar.

    Projects are ordered by a seeded hash; a null project is one group.
    """
    projects = df.select(hash_key(col, seed).alias("_pkey")).distinct()
    n = projects.agg(F.count(F.lit(1))).scalar()
    n_test = F.greatest(F.lit(1), F.floor(n * F.lit(test_frac))).cast("long")
    sizes = projects.groupBy(F.substring("_pkey", 1, 2).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = _ranked(projects, "_pkey", [], None, sizes, 2, "_prank")
    return ranked.agg(F.max(F.when(F.col("_prank") <= n_test, F.col("_pkey")))).scalar()


def _part(df: DataFrame, test_frac: float, seed: int, col: str) -> Column:
    return F.when(hash_key(col, seed) <= last_test_key(df, test_frac, seed, col), "test").otherwise("train")


def split_projects(df: DataFrame, test_frac: float = 0.25, seed: int = DEFAULT_SEED,
                   col: str = "project") -> DataFrame:
    """(project, split), one row per distinct project."""
    return df.select(col).distinct().withColumn("split", _part(df, test_frac, seed, col))


def project_wise_split(df: DataFrame, test_frac: float = 0.25, seed: int = DEFAULT_SEED,
                       col: str = "project") -> DataFrame:
    """Rows with a ``split`` column ('train' / 'test'); projects never straddle.

    A row compares its project's hash with the cut: neither joined nor shuffled.
    """
    return df.withColumn("split", _part(df, test_frac, seed, col))


#: Distinct keys that a join may broadcast (a few MB of strings).
BROADCAST_KEYS = 50_000


def _distinct_keys(projects: DataFrame, col: str) -> DataFrame:
    """The distinct keys, broadcast if their number was counted to be small."""
    keys = projects.select(F.col(col).alias("_p")).distinct()
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


# J1 / J2
def semi_join_projects(df: DataFrame, projects: DataFrame, col: str = "project") -> DataFrame:
    return df.join(_distinct_keys(projects, col), F.col(col).eqNullSafe(F.col("_p")), "left_semi")


def anti_join_projects(df: DataFrame, projects: DataFrame, col: str = "project") -> DataFrame:
    return df.join(_distinct_keys(projects, col), F.col(col).eqNullSafe(F.col("_p")), "left_anti")


# W5
def balanced_sample(df: DataFrame, per_class: int = 2500, seed: int = DEFAULT_SEED,
                    label: str = "label", id_col: str = "row_id", classes: tuple = (0, 1)) -> DataFrame:
    """``min(n_c, per_class)`` hash-chosen rows per class, then shuffled."""
    keyed = df.withColumn("_k", hash_key(id_col, seed))
    return (quota_per_class(keyed, {c: per_class for c in classes}, label, "_k")
            .drop("_k").withColumn("shuffle_key", hash_key(id_col, seed + 1)))


# W6
def stratified_split(df: DataFrame, frac: float = 0.15, seed: int = DEFAULT_SEED,
                     label: str = "label", id_col: str = "row_id", rank_rows: int = RANK_ROWS) -> DataFrame:
    """Adds ``part`` = 'val' for ``round(frac * n_c)`` hash-chosen rows per class.

    Counts by key prefix tell in which prefix a class's last 'val' key lies; only that prefix's keys are
    ranked. Rows compare their key with the class's cut (one row per class).
    """
    keys = df.select(F.col(label).alias("_l"), hash_key(id_col, seed).alias("_k"))
    sizes, digits = _prefix_sizes(keys, "_k", ["_l"], rank_rows)
    group = Window.partitionBy("_l")
    upto = F.sum("_n").over(group.orderBy("_bucket"))
    want = F.round(F.sum("_n").over(group) * F.lit(frac))
    hit = sizes.select("_l", "_bucket", (upto - F.col("_n")).alias("_before"), upto.alias("_upto"), want.alias("_want")) \
        .where((F.col("_before") < F.col("_want")) & (F.col("_want") <= F.col("_upto"))) \
        .withColumnsRenamed({"_l": "_hl", "_bucket": "_hb"})
    near = keys.join(hit, F.col("_l").eqNullSafe(F.col("_hl")) & (F.substring("_k", 1, digits) == F.col("_hb")))
    rank = F.row_number().over(Window.partitionBy("_l").orderBy("_k")) + F.col("_before")
    cut = near.withColumn("_r", rank).where(F.col("_r") == F.col("_want")).select(F.col("_l").alias("_cl"), F.col("_k").alias("_cut"))
    marked = df.join(cut, F.col(label).eqNullSafe(F.col("_cl")), "left")
    return marked.withColumn("part", F.when(hash_key(id_col, seed) <= F.col("_cut"), "val").otherwise("train")).drop("_cl", "_cut")


# W7
def capped_sample(df: DataFrame, n: int, seed: int = DEFAULT_SEED, id_col: str = "row_id") -> DataFrame:
    """At most ``n`` hash-chosen rows (top-k by hash: TakeOrdered, exact n)."""
    return (df.withColumn("_k", hash_key(id_col, seed)).orderBy("_k", id_col).limit(n).drop("_k"))


# W8
def stratified_kfold(df: DataFrame, k: int = 5, seed: int = DEFAULT_SEED, label: str = "label",
                     id_col: str = "row_id", out: str = "fold") -> DataFrame:
    """fold = (per-class hash rank - 1) mod k: class shares kept in every fold."""
    keyed = df.withColumn("_k", hash_key(id_col, seed))
    ranked = hash_rank(keyed, "_k", by=[label], tie=id_col, out="_r")
    return ranked.withColumn(out, ((F.col("_r") - 1) % k).cast("int")).drop("_k", "_r")
