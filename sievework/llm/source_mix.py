"""Mixing sources to target weights by Pareto order sampling.

Sources take weights 1, 2, 3, 1, 2, 3, ... in code point order, null last, and share all words by them; a target stops at
CAP times its source's words and the excess is shared again by weight (water-filling, in closed form over the sources
sorted by capacity per weight). A source's documents are each due r = target / words copies: floor(r) whole copies for
certain, and one more with inclusion probability f = r - floor(r). Which ones is drawn by Pareto order sampling:
documents are ranked by their random odds U / (1 - U), U from a hash of id and text, over their inclusion odds f / (1 - f),
and taken from the lowest rank on while the words last: the sample's size is fixed, in words. A document that doesn't fit
what is still open is passed over, and the order followed on to its end with those that do.

Nothing sorts a source: words are summed by BINS intervals of rank, again by BINS intervals of the one interval in which
they run out, and only that last sliver (one document in 2 ** 28 or so) is put in order. Past the cut, documents that
fit are put in order as far as they hold AHEAD times the words open (and to the end of an interval), which is repeated
while any is left. The result is a few cuts per source, each with the size up to which it holds, so a document's copies
follow from its own row and its source's.

Ties: rows of one source, rank and size (repeated rows, that is) are a group with a count all along, of which as many
are taken as fit. Where that is a part, the group's rows are numbered by a hash of their content, dealt out by that hash
so that a group of any size is spread over tasks. Rows of one id, or of null id, with different texts have ranks of
their own. Null and empty texts have size 0: they get their source's whole copies (one, in a source without words) and no
extra one, and take no words. An empty table gives an empty one. Clashing names of extra columns do no harm: only the id,
text and source are read by mix(), and copies_of() keeps all columns as they are. Texts of any length are one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, map_arrow, materialise

CAP, BINS, SEED = 3, 1 << 14, "pareto-2"
#: Words looked at in one go for each word that is open past the cut; repeated rows numbered by one task, about.
AHEAD, AT_ONCE = 32, 1_000_000
#: Sources up to which their table (some 100 bytes a row) is broadcast. Beyond, only those are that hold more than one
#: HOT-th of all rows (fewer than HOT, then), and the others meet their rows in a shuffle.
FEW_SOURCES, HOT = 10_000, 1_000
_RUNS, _PARTS = "array<struct<limit:bigint,q:double,size:bigint>>", "array<struct<q:double,size:bigint,k:bigint,n:bigint>>"


def word_count(text: Column) -> Column:
    """Runs of other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(doc_id: Column, text: Column) -> Column:
    """A document's random number between 0 and 1: 52 bits of a hash of its id and text."""
    key = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.md5(text.cast("binary")), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def _before(t: DataFrame, order: list[Column], sums: dict[str, Column], few: bool) -> DataFrame:
    """t with the sum of each column over all rows before in the order; many rows are summed by ranges first."""
    none = F.lit(0).cast("bigint")
    if few:
        w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return t.withColumns({k: F.coalesce(F.sum(c).over(w), none) for k, c in sums.items()})
    parts = materialise(t.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "mix-ranges")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as shuffle partitions
    whole = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    whole = whole.select("_part", *[F.coalesce(F.sum(f"_{k}").over(earlier), none).alias(f"_{k}") for k in sums])
    inner = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumns({k: F.coalesce(F.sum(c).over(inner), none) for k, c in sums.items()}).join(F.broadcast(whole), "_part")
    return out.withColumns({k: F.col(k) + F.col(f"_{k}") for k in sums}).drop("_part", *[f"_{k}" for k in sums])


def targets(sizes: DataFrame, few: bool = True) -> DataFrame:
    """(source, source_size, ..., target) from (source, source_size, ...): a row a source, in closed form."""
    w = _before(sizes, [F.col("source").asc_nulls_last()], {"nth": F.lit(1)}, few)
    w = w.withColumn("weight", (F.col("nth") % 3 + 1).cast("bigint"))
    # Capped sources come first when sorted by capacity per weight; the rest share what those leave.
    every = w.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    w = _before(w, [(F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()], {"size_before": F.col("source_size"), "weight_before": F.col("weight")}, few)
    w = w.withColumn("rest", F.lit(every["size"]) - CAP * F.col("size_before")).withColumn("rest_weight", F.lit(every["weight"]) - F.col("weight_before"))
    big = "decimal(38,0)"
    w = w.withColumn("free", ~(CAP * F.col("source_size").cast(big) * F.col("rest_weight") <= F.col("rest").cast(big) * F.col("weight")))
    level = w.filter("free").agg(F.max(F.struct("rest_weight", "rest")).alias("x")).first()["x"]
    share = F.lit(level["rest"]).cast("double") * F.col("weight") / F.lit(level["rest_weight"]) if level else F.lit(None).cast("double")
    return w.withColumn("target", F.when(F.col("free"), share).otherwise((CAP * F.col("source_size")).cast("double"))).select(*sizes.columns, "target")


def _attach(df: DataFrame, table: DataFrame, few: bool) -> DataFrame:
    """df with its source's row of a table that has one row for each source of df."""
    right = table.withColumnRenamed("source", "_source")
    same = df["source"].eqNullSafe(F.col("_source"))
    if few:
        return df.join(F.broadcast(right), same).drop("_source")
    hot = F.broadcast(right.filter("hot"))  # fewer than HOT rows, as each has more than one HOT-th of all
    return df.join(hot, same).unionByName(df.join(hot.select("_source"), same, "left_anti").join(right.filter("not hot"), same)).drop("_source")


def _beside(table: DataFrame, some: DataFrame, few: bool) -> DataFrame:
    """A table of sources with the columns of some, null where that lacks the source."""
    right = some.withColumnRenamed("source", "_source")
    return table.join(F.broadcast(right) if few else right, table["source"].eqNullSafe(right["_source"]), "left").drop("_source")


def _rank(u: Column, f: Column) -> Column:
    """Pareto rank q, mapped to (0, 1) by q / (1 + q): odds of one fall in the middle."""
    q = (u / (1 - u)) / (f / (1 - f))
    return F.when(f > 0, q / (1 + q)).otherwise(1.0)


def _go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, q, size, n, open), a source's groups together by rank, of which it takes all that fit.

    Gives (source, left, limit, q, size, k, n): a run of groups taken whole, which are all of size up to limit as far as
    (q, size), or k rows of the n of a group; and in each row what is left at the end.
    """
    names = ["source", "left", "limit", "q", "size", "k", "n"]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
    here, some, left, limit, cut = None, False, 0, 0, None
    found: list[tuple] = []
    out: list[tuple] = []

    def close() -> None:
        if cut:
            found.append((limit, *cut, None, None))
        out.extend((here, left, *x) for x in found or [(None,) * 5])
        found.clear()

    for batch in batches:
        for source, q, size, n, open_ in zip(*(batch.column(c).to_pylist() for c in ("source", "q", "size", "n", "open"))):
            if not some or source != here:
                if some:
                    close()
                here, some, left, limit, cut = source, True, open_, open_, None
            if size > limit:
                continue
            if n * size <= left:
                left, cut = left - n * size, (q, size)
                continue
            if cut:  # the run ends: what follows has to fit what is left now
                found.append((limit, *cut, None, None))
            if k := left // size:
                found.append((None, q, size, k, n))
            left -= k * size
            limit, cut = left, None
    if some:
        close()
    cols = list(zip(*out)) if out else [[]] * len(names)
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)


def _upto(q: Column, size: Column) -> Column:
    """Whether the row's place in the order is at (q, size) or before."""
    return (F.col("q") < q) | (F.col("q") == q) & (F.col("size") <= size)


def _extra() -> Column:
    return F.coalesce(_upto(F.col("cut_q"), F.col("cut_size")), F.lit(False)) | (F.col("q") < F.col("under"))


def plan(sized: DataFrame) -> tuple[DataFrame, bool]:
    """From (id, source, size, u): a row of cuts for each source, and whether their table is short.

    Rows of size above 0 up to the cut get one copy more than whole; so do those up to the end of one of the runs
    that are no larger than its limit; and k of the n rows that are at one of the parts.
    """
    goal = materialise(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "mix-sources")
    total = goal.agg(F.count("*").alias("sources"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    few = total["sources"] <= FEW_SOURCES
    goal = targets(goal.withColumn("hot", F.col("rows") * HOT > F.lit(total["rows"])).drop("rows"), few)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0)
    goal = goal.withColumn("whole", F.floor(ratio).cast("bigint")).withColumn("f", ratio - F.floor(ratio))
    goal = goal.withColumn("want", F.greatest(F.floor(F.col("target") + 0.5).cast("bigint") - F.col("whole") * F.col("source_size"), F.lit(0)))
    goal = materialise(goal, "mix-goal")
    ranked = lambda t: _attach(sized.filter("size > 0").select("source", "size", "u"), t, few).filter("want > 0").withColumn("q", _rank(F.col("u"), F.col("f")))

    def cut_bin(groups: DataFrame, bin_: Column, left: str) -> DataFrame:
        """(source, bin, left): of each source the first bin that the words left don't cover, and what is left for it."""
        sums = groups.groupBy("source", bin_.alias("bin")).agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.max(left).alias("left"))
        done = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))  # at most BINS rows a source
        over = sums.withColumn("before", done - F.col("words")).filter(F.col("before") + F.col("words") > F.col("left"))
        first = over.groupBy("source").agg(F.min(F.struct("bin", (F.col("left") - F.col("before")).alias("left"))).alias("at"))
        return first.select("source", F.col("at.bin").alias("bin"), F.col("at.left").alias("left"))

    coarse = F.least(F.floor(F.col("q") * BINS), F.lit(BINS - 1))
    fine = F.least(F.floor((F.col("q") * BINS - coarse) * BINS), F.lit(BINS - 1))
    one = cut_bin(ranked(goal).withColumn("n", F.lit(1)), coarse, "want").withColumnsRenamed({"bin": "bin1", "left": "left1"})
    table = _beside(goal, one, few)
    inside = ranked(table).filter(coarse == F.col("bin1")).groupBy("source", "q", "size", "left1").agg(F.count("*").alias("n"))
    inside = materialise(inside, "mix-boundary")
    two = cut_bin(inside, fine, "left1").withColumnsRenamed({"bin": "bin2", "left": "left2"})
    last = inside.join(two, inside["source"].eqNullSafe(two["source"])).drop(two["source"]).filter(fine == F.col("bin2"))
    run = F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("source").orderBy("q", "size"))
    kept = last.withColumn("run", run).filter("run <= left2").groupBy("source").agg(F.max(F.struct("q", "size")).alias("cut3"), F.max("run").alias("run3"))
    table = _beside(_beside(table, two, few), kept, few)
    # No group of the sliver fits whole: the cut is just below it. Words never run out: all are taken (under 2).
    some = F.col("bin1").isNotNull()
    under = F.when(~some, 2.0).when(F.col("cut3").isNull(), (F.col("bin1") + F.col("bin2") / BINS) / BINS).otherwise(-1.0)
    opened = F.when(some, F.col("left2") - F.coalesce("run3", F.lit(0))).otherwise(0)
    table = table.select("source", "hot", "source_size", "target", "whole", "f", "want", F.col("cut3.q").alias("cut_q"), F.col("cut3.size").alias("cut_size"), under.alias("under"), opened.alias("open"), F.array().cast(_RUNS).alias("runs"), F.array().cast(_PARTS).alias("parts"))
    table = materialise(table, "mix-cuts")
    rest = ranked(table).filter("open > 0").filter(~_extra() & (F.col("size") <= F.col("open")))
    rest = materialise(rest.groupBy("source", "q", "size", "open").agg(F.count("*").alias("n")), "mix-rest")
    while not rest.isEmpty():
        stop = cut_bin(rest.withColumn("reach", F.col("open") * AHEAD), coarse, "reach").select(F.col("source").alias("_s"), F.col("bin").alias("stop"))
        rest = materialise(rest.join(stop, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "mix-ahead")
        near = rest.filter(F.col("stop").isNull() | (coarse <= F.col("stop")))
        near = near.select("source", "q", "size", "n", "open").repartition("source").sortWithinPartitions("source", "q", "size")
        runs = materialise(map_arrow(near, _go_on, "source string, left bigint, limit bigint, q double, size bigint, k bigint, n bigint"), "mix-runs")
        runs = runs.groupBy("source").agg(F.min("left").alias("left"), F.collect_list(F.when(F.col("limit").isNotNull(), F.struct("limit", "q", "size"))).alias("new"), F.collect_list(F.when(F.col("k").isNotNull(), F.struct("q", "size", "k", "n"))).alias("more"))
        table = _beside(table, runs, few)
        table = table.withColumn("runs", F.concat("runs", F.coalesce("new", F.array().cast(_RUNS)))).withColumn("parts", F.concat("parts", F.coalesce("more", F.array().cast(_PARTS)))).withColumn("open", F.coalesce("left", "open")).drop("left", "new", "more")
        table = materialise(table, "mix-follow")
        later = rest.filter(F.col("stop").isNotNull() & (coarse > F.col("stop"))).drop("stop", "open").join(table.select(F.col("source").alias("_s"), "open"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        rest = materialise(later.filter(F.col("size") <= F.col("open")).select("source", "q", "size", "n", "open"), "mix-rest")
    return table, few


def _some_of(rows: DataFrame) -> DataFrame:
    """(row, source_size, target, whole, many, extra): rows of partly taken groups, equal ones as one with their number, and how many of those get a copy more."""
    key = ["source", "q", "size"]
    # Positions for names: what rows hold is compared, whatever their columns are called.
    fields = rows.schema["row"].dataType.fields
    content = F.md5(F.to_json(F.col("row").cast("struct<" + ",".join(f"_{i}:{f.dataType.simpleString()}" for i, f in enumerate(fields)) + ">")).cast("binary"))
    d = rows.withColumn("content", content).groupBy(*key, "content").agg(F.count("*").alias("many"), *[F.first(c).alias(c) for c in ("row", "source_size", "target", "whole", "part")])
    salts = 1 + F.floor(F.col("part.n") / AT_ONCE)
    d = materialise(d.withColumn("salt", F.pmod(F.xxhash64("content"), salts)), "mix-parts")
    here = Window.partitionBy(*key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = d.groupBy(*key, "salt").agg(F.sum("many").alias("m")).select(*[F.col(c).alias(f"_{c}") for c in [*key, "salt"]], F.coalesce(F.sum("m").over(Window.partitionBy(*key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    on = d["source"].eqNullSafe(offset["_source"]) & (d["q"] == offset["_q"]) & (d["size"] == offset["_size"]) & (d["salt"] == offset["_salt"])
    inner = Window.partitionBy(*key, "salt").orderBy("content").rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(offset, on).withColumn("before", F.col("offset") + F.coalesce(F.sum("many").over(inner), F.lit(0)))
    return d.select("row", "source_size", "target", "whole", "size", "many", F.greatest(F.lit(0), F.least("many", F.col("part.k") - F.col("before"))).alias("extra"))


def _repeat(df: DataFrame, times: Column) -> DataFrame:
    """Each row of df as often as times says; great numbers are spread over tasks."""
    step = 100_000
    some = df.withColumn("_times", times.cast("bigint")).filter("_times > 0").withColumn("_lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("_times") - 1) / step))))
    left = F.least(F.lit(step), F.col("_times") - F.col("_lot") * step).cast("int")
    return some.withColumn("_times", left).repartition("_lot", "_times").withColumn("_lot", F.explode(F.array_repeat(F.lit(1), F.col("_times")))).drop("_lot", "_times")


def _copies(rows: DataFrame, table: DataFrame, few: bool) -> tuple[DataFrame, DataFrame | None]:
    """(row, source, size, u): with source_size, target and copies; and the rows of partly taken groups apart, as of _some_of()."""
    out = _attach(rows, table, few).withColumn("q", _rank(F.col("u"), F.col("f")))
    late = F.exists("runs", lambda r: (F.col("size") <= r["limit"]) & _upto(r["q"], r["size"]))
    able = (F.col("size") > 0) & (F.col("want") > 0)
    copies = F.col("whole") + F.when(able & (_extra() | late), 1).otherwise(0)
    # A group of which a part is taken is not in any run: its size is above the limits that follow.
    part = F.filter("parts", lambda p: (p["q"] == F.col("q")) & (p["size"] == F.col("size")))
    some = None
    if not table.filter(F.size("parts") > 0).isEmpty():
        out = out.withColumn("part", F.when(able, F.get(part, F.lit(0))))
        some = _some_of(out.filter("part is not null"))
        out = out.filter("part is null")
    return out.select("row", "size", "source_size", "target", copies.alias("copies")), some


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"), uniform(docs[id_col], docs[text_col]).alias("u")]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, copies, taken): one row per input row."""
    sized = materialise(docs.select(docs[id_col].alias("id"), *_sized(docs, id_col, text_col, source_col)), "mix-sizes")
    out, some = _copies(sized.select(F.struct("id", "source").alias("row"), "source", "size", "u"), *plan(sized))
    if some is not None:
        both = some.withColumn("kind", F.explode(F.array(F.struct(F.col("extra").alias("times"), (F.col("whole") + 1).alias("copies")), F.struct((F.col("many") - F.col("extra")).alias("times"), F.col("whole").alias("copies")))))
        out = out.unionByName(_repeat(both.withColumn("copies", F.col("kind.copies")), F.col("kind.times")).select(*out.columns))
    return out.select(F.col("row.id").alias(id_col), F.col("row.source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def copies_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns."""
    sized = materialise(docs.select(docs[id_col].alias("id"), *_sized(docs, id_col, text_col, source_col)), "mix-sizes")
    row = F.struct(*[docs[c].alias(f"_{i}") for i, c in enumerate(docs.columns)])
    out, some = _copies(docs.select(row.alias("row"), *_sized(docs, id_col, text_col, source_col)), *plan(sized))
    out = out.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
    if some is not None:
        out = out.unionAll(_repeat(some, F.col("many") * F.col("whole") + F.col("extra")).select("row.*"))
    return out.toDF(*docs.columns)


#: DuckDB SQL of mix(), with the columns of its query: the order is walked group by group, in all sources at once.
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
  (CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / {float(1 << 52)}::DOUBLE AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM s),
b AS (SELECT *, sum(source_size) OVER () - {CAP} * coalesce(sum(source_size) OVER p, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS rest_weight
  FROM w WINDOW p AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, NOT ({CAP} * source_size * rest_weight <= rest * weight) AS free FROM b),
k AS (SELECT *, (SELECT max(rest_weight) FROM c WHERE free) AS lw, (SELECT arg_max(rest, rest_weight) FROM c WHERE free) AS lr FROM c),
g AS (SELECT source, source_size, CASE WHEN free THEN CAST(lr AS DOUBLE) * weight / lw ELSE CAST({CAP} * source_size AS DOUBLE) END AS target FROM k),
h AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0 END AS r FROM g),
i AS (SELECT *, CAST(floor(r) AS BIGINT) AS whole, r - floor(r) AS f, greatest(CAST(floor(target + 0.5) AS BIGINT) - CAST(floor(r) AS BIGINT) * source_size, 0) AS want FROM h),
v AS (SELECT d.doc_id, d.size, i.*, CASE WHEN f > 0 THEN (u / (1 - u)) / (f / (1 - f)) ELSE NULL END AS q FROM d JOIN i ON d.source IS NOT DISTINCT FROM i.source),
x AS (SELECT * EXCLUDE (q), coalesce(q / (1 + q), 1.0) AS q, row_number() OVER (PARTITION BY source, coalesce(q / (1 + q), 1.0), size) AS nth FROM v),
y AS (SELECT source, q, size, count(*) AS n, any_value(want) AS want, row_number() OVER (PARTITION BY source ORDER BY q, size) AS place FROM x WHERE size > 0 AND want > 0 GROUP BY source, q, size),
walk AS (SELECT source, place, q, size, least(n, want // size) AS k, want - least(n, want // size) * size AS left_ FROM y WHERE place = 1
  UNION ALL SELECT y.source, y.place, y.q, y.size, least(y.n, walk.left_ // y.size), walk.left_ - least(y.n, walk.left_ // y.size) * y.size
  FROM walk JOIN y ON y.source IS NOT DISTINCT FROM walk.source AND y.place = walk.place + 1)
SELECT x.doc_id, x.size, x.source_size, x.target, CAST((x.whole + CASE WHEN x.nth <= walk.k THEN 1 ELSE 0 END) * x.size AS BIGINT) AS taken
FROM x LEFT JOIN walk ON x.source IS NOT DISTINCT FROM walk.source AND x.q = walk.q AND x.size = walk.size
"""
