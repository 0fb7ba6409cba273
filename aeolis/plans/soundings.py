"""Queries of soundings put together, checked and compared, and of inventories from bitmaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bitmaps, soundings
from ..operators import inventories, tables
from .queries import query, read

KINDS = 7
_LINES = "(SELECT l_orderkey AS k, l_linenumber AS n, min(l_quantity) AS q FROM lineitem GROUP BY ALL)"


def _lines(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
    return rows.agg(F.min("l_quantity").alias("q"))


@query(
    f"WITH l AS (SELECT *, n % 2 = 1 AS own, count(*) FILTER (n % 2 = 1) OVER (PARTITION BY k) > 0 AND count(*) FILTER (n % 2 = 0) OVER (PARTITION BY k) > 0 AS two FROM {_LINES}), "
    f"i AS (SELECT *, list_transform(range({KINDS}), lambda i: (k + i) % 2) AS a, list_transform(range({KINDS}), lambda i: CASE WHEN (k + i) % 3 = 0 THEN 1 ELSE 0 END) AS b FROM l) "
    "SELECT k, (row_number() OVER (PARTITION BY k ORDER BY own DESC, n) - 1)::INT AS place, n, "
    f"array_to_string(list_transform(range({KINDS}), lambda i: CASE WHEN two AND (CASE WHEN own THEN a[i + 1] = 0 AND b[i + 1] = 1 ELSE b[i + 1] = 0 AND a[i + 1] = 1 END) THEN '0' ELSE ((n + i) % 5 + 1)::VARCHAR END), '') AS quality, "
    f"array_to_string(list_transform(range({KINDS}), lambda i: CASE WHEN two THEN greatest(a[i + 1], b[i + 1]) WHEN own THEN a[i + 1] ELSE b[i + 1] END), '') AS indicators, "
    "CASE WHEN two OR own THEN 1 ELSE 3 END AS released, CASE WHEN two OR NOT own THEN 4 ELSE 2 END AS ended FROM i"
)
def appended_soundings(spark, sf_dir):
    """Soundings of the odd and of the even lines of orders, one behind the other, with kinds of quality that one alone reports."""
    k = F.col("k")
    numbers = F.sequence(F.lit(0), F.lit(KINDS - 1))
    quality = F.transform(numbers, lambda i: ((F.col("n") + i) % 5 + 1).cast("string"))
    level = F.struct("n", quality.alias("quality"))
    odd = F.col("n") % 2 == 1
    arrays = _lines(spark, sf_dir).groupBy("k").agg(*(F.array_sort(F.collect_list(F.when(side, level))).alias(name) for name, side in (("odd", odd), ("even", ~odd))))
    made = lambda levels, released, ended, reports: F.when(F.size(levels) > 0, F.struct(F.lit(released).alias("released"), F.lit(ended).alias("ended"), F.transform(numbers, reports).alias("indicators"), F.col(levels).alias("levels")))
    first = made("odd", 1, 2, lambda i: ((k + i) % 2).cast("int"))
    second = made("even", 3, 4, lambda i: ((k + i) % 3 == 0).cast("int"))
    one = arrays.select("k", first.alias("first"), second.alias("second")).select("k", soundings.appended(F.col("first"), F.col("second")).alias("s"))
    rows = tables.elements(one, "s.levels", "k", F.array_join("s.indicators", "").alias("indicators"), "s.released", "s.ended", element="x", place="place")
    return rows.select("k", "place", "x.n", F.array_join("x.quality", "").alias("quality"), "indicators", "released", "ended")


_SIDES = (
    "(SELECT l_orderkey AS k, l_suppkey % 2 AS side, 1000 - l_partkey % 7 * 100 AS p, CASE WHEN min(l_quantity) % 3 <> 0 THEN min(l_quantity) END AS t, "
    "CASE WHEN max(l_quantity) % 4 <> 0 THEN max(l_quantity) END AS z FROM lineitem GROUP BY ALL)"
)


@query(
    f"SELECT coalesce(a.k, b.k) AS k, coalesce(a.p, b.p) AS p, coalesce(a.t, b.t) AS t, CASE WHEN a.t IS NOT NULL THEN 1 WHEN b.t IS NOT NULL THEN 2 END AS t_from, coalesce(a.z, b.z) AS z, "
    f"CASE WHEN a.z IS NOT NULL THEN 1 WHEN b.z IS NOT NULL THEN 2 END AS z_from FROM (SELECT * FROM {_SIDES} WHERE side = 1) AS a FULL JOIN (SELECT * FROM {_SIDES} WHERE side = 0) AS b ON a.k = b.k AND a.p = b.p"
)
def combined_soundings(spark, sf_dir):
    """Levels of two soundings of an order by pressure: a field is the first's where it has one, and says whose it is."""
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 2).alias("side"), (1000 - F.col("l_partkey") % 7 * 100).alias("p"))
    rows = rows.agg(F.min("l_quantity").alias("t"), F.max("l_quantity").alias("z"))
    level = F.struct("p", F.when(F.col("t") % 3 != 0, F.col("t")).alias("t"), F.when(F.col("z") % 4 != 0, F.col("z")).alias("z"))
    arrays = rows.groupBy("k").agg(*(F.collect_list(F.when(F.col("side") == s, level)).alias(f"s{s}") for s in (0, 1)))
    return arrays.select("k", F.inline(soundings.combined(F.col("s1"), F.col("s0"), "p", "t", "z")))


@query(
    f"WITH v AS (SELECT k, n, 1000.0::DOUBLE - n * 90 AS p, CASE WHEN q % 7 <> 0 THEN 15 - 6.0::DOUBLE * n + q / 10 END AS t, CASE WHEN n % 4 <> 3 THEN (n * 850 + q * 3)::BIGINT END AS z, CASE WHEN n % 2 = 0 THEN q END AS h, q % 5 = 0 AS ground FROM {_LINES}), "
    "s AS (SELECT *, (t + 273.15) / CASE WHEN h IS NOT NULL AND 1 - 0.379 * (h / 100 * 6.1078 * pow(10.0, 7.5 * t / (237.3 + t))) / p >= 0.1 THEN 1 - 0.379 * (h / 100 * 6.1078 * pow(10.0, 7.5 * t / (237.3 + t))) / p ELSE 1 END AS tv, "
    "min(CASE WHEN z IS NOT NULL THEN n END) OVER (PARTITION BY k) AS n0 FROM v WHERE t IS NOT NULL), "
    "d AS (SELECT *, coalesce(round((tv + lag(tv) OVER x) * ln(lag(p) OVER x / p) * 14.63563358), 0) AS layer FROM s WHERE n >= n0 WINDOW x AS (PARTITION BY k ORDER BY n)), "
    "c AS (SELECT k, n, (first(z) OVER x + sum(layer) OVER x)::BIGINT AS computed FROM d WINDOW x AS (PARTITION BY k ORDER BY n)), "
    "r AS (SELECT v.*, computed FROM v LEFT JOIN c USING (k, n)), "
    "f AS (SELECT k, n, coalesce(z - lag(z) OVER x - (computed - lag(computed) OVER x), 0) AS difference FROM r WHERE z IS NOT NULL AND computed IS NOT NULL WINDOW x AS (PARTITION BY k ORDER BY n)) "
    "SELECT k, n, computed, difference, CASE WHEN max(abs(difference)) OVER (PARTITION BY k) > 120 THEN 1 ELSE 3 END AS status, "
    "coalesce(min(CASE WHEN ground THEN place END) OVER (PARTITION BY k), 0)::INT AS surface, (count(*) FILTER (ground) OVER (PARTITION BY k))::INT AS surfaces "
    "FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) AS place FROM r) LEFT JOIN f USING (k, n)"
)
def checked_soundings(spark, sf_dir):
    """Heights computed through the layers of a sounding against those reported, with the verdict on the sounding."""
    n, q = F.col("n"), F.col("q")
    level = F.struct(
        n.alias("n"), F.when(q % 5 == 0, 0).otherwise(2).alias("type"), (1000.0 - n * 90).alias("pressure"), F.when(n % 4 != 3, (n * 850 + q * 3).cast("long")).alias("height"),
        F.when(q % 7 != 0, 15 - 6.0 * n + q / 10).alias("temperature"), F.when(n % 2 == 0, q).alias("moisture"),
    )
    arrays = _lines(spark, sf_dir).groupBy("k").agg(F.array_sort(F.collect_list(level)).alias("levels"))
    checked = arrays.withColumn("c", soundings.hydrostatic_check(F.col("levels"), "humidity", 120))
    rows = tables.elements(checked, F.arrays_zip(F.col("levels.n").alias("n"), F.col("c.checks").alias("check")), "k", "c.status", "c.surface", "c.surfaces", element="x")
    return rows.select("k", "x.n", "x.check.computed", "x.check.difference", "status", "surface", "surfaces")


@query(
    "SELECT k, count(*) FILTER (n > 3) = 0 AND coalesce(bool_and(b IS NOT DISTINCT FROM c), true) AS equal FROM (SELECT l_orderkey AS k, l_linenumber AS n, "
    "CASE WHEN min(l_quantity) % 9 <> 0 THEN min(l_quantity) END AS b, CASE WHEN max(l_quantity) % 9 <> 0 THEN max(l_quantity) END AS c FROM lineitem GROUP BY ALL) GROUP BY k"
)
def equal_soundings(spark, sf_dir):
    """Whether the soundings of least and of largest quantities of the first three lines and of all lines are equal."""
    b = lambda column: F.when(F.col(column) % 9 != 0, F.col(column)).alias("v")
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.min("l_quantity").alias("b"), F.max("l_quantity").alias("c"))
    some = lambda column: F.array_sort(F.collect_list(F.when(F.col("n") <= 3, F.struct("n", b(column)))))
    arrays = rows.groupBy("k").agg(some("b").alias("few"), F.array_sort(F.collect_list(F.struct("n", b("c")))).alias("all"))
    return arrays.select("k", soundings.same(F.col("few"), F.col("all"), "n", "v").alias("equal"))


def _inventory(spark, sf_dir):
    """A grid for each line of an order: in the file of its supplier, with codes of a time range, a grid, a level, a parameter and a process."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("offset"), F.col("l_quantity").cast("int").alias("length"), F.date_format("l_shipdate", "yyyyMMddHHmm").alias("date"),
        F.col("l_linenumber").alias("range"), (F.col("l_partkey") % 200 + 1).alias("grid"), (F.col("l_orderkey") % 30).alias("level"), F.col("l_returnflag").alias("parameter"), F.col("l_linestatus").alias("process"),
    )


def _numbered(spark, sf_dir):
    rows = _inventory(spark, sf_dir)
    packed = {"U": "range", "G": "grid", "L": "level"}
    fields = rows.groupBy("file", "parameter").agg(*(bitmaps.encode(F.collect_set(F.col(c).cast("long"))).alias(c) for c in packed.values()))
    found = inventories.codes(fields, "file", packed, {"P": "parameter"}).unionByName(inventories.codes(rows, "file", {}, {"R": "process"}))
    nations = read(spark, sf_dir, "nation")
    name = lambda kind, df, code, text: df.select(F.lit(kind).alias("kind"), F.col(code).cast("string").alias("code"), text.alias("name"))
    parameters = rows.select("parameter").distinct()
    names = name("U", nations, "n_nationkey", F.col("n_name")).union(name("L", nations, "n_nationkey", F.concat(F.lit("level "), F.col("n_name")))).union(name("G", read(spark, sf_dir, "part"), "p_partkey", F.col("p_type")))
    return rows, inventories.numbered_codes(found, names.union(name("P", parameters, "parameter", F.when(F.col("parameter") == "R", "wind").when(F.col("parameter") == "A", "Wind").otherwise("temperature"))))


_NAMED = (
    "(SELECT l_suppkey AS file, l_orderkey * 10 + l_linenumber AS off, l_quantity::INT AS len, strftime(l_shipdate, '%Y%m%d%H%M') AS date, l_linenumber AS u, u.n_name AS un, l_partkey % 200 + 1 AS g, coalesce(p_type, '') AS gn, "
    "l_orderkey % 30 AS l, coalesce('level ' || w.n_name, '') AS ln, l_returnflag AS p, CASE l_returnflag WHEN 'R' THEN 'wind' WHEN 'A' THEN 'Wind' ELSE 'temperature' END AS pn, l_linestatus AS r "
    "FROM lineitem LEFT JOIN nation AS u ON u.n_nationkey = l_linenumber LEFT JOIN nation AS w ON w.n_nationkey = l_orderkey % 30 LEFT JOIN part ON p_partkey = l_partkey % 200 + 1)"
)
_PLACES = {"u": "un", "g": "g", "l": "ln", "p": "lower(pn)", "r": "r"}
_DENSE = ", ".join(f"(dense_rank() OVER (PARTITION BY file ORDER BY {key}) - 1)::INT AS n{c}" for c, key in _PLACES.items())


@query(f"SELECT file, off AS byte_offset, concat_ws('|', off, len, date, nu, ng, nl, np, nr) AS line FROM (SELECT *, {_DENSE} FROM {_NAMED})")
def inventory_lines(spark, sf_dir):
    """A line for each grid of a file, its codes as their places in the file's own lists."""
    rows, numbered = _numbered(spark, sf_dir)
    found = inventories.renumbered(rows, numbered, "file", {"U": "range", "G": "grid", "L": "level", "P": "parameter", "R": "process"})
    return found.select("file", F.col("offset").alias("byte_offset"), inventories.lines(found, "offset", "length", "date", "n_U", "n_G", "n_L", "n_P", "n_R").alias("line"))


@query(
    f"WITH d AS (SELECT *, {_DENSE} FROM {_NAMED}) "
    "SELECT file, 'U' AS kind, nu AS number, concat('U<!>', nu, '<!>', min(u), '<!>', arg_min(un, u)) AS text FROM d GROUP BY file, nu UNION ALL SELECT file, 'G', ng, concat('G<!>', ng, '<!>', min(g), '<!>', arg_min(gn, g)) FROM d GROUP BY file, ng "
    "UNION ALL SELECT file, 'L', nl, concat('L<!>', nl, '<!>', min(l), '<!>', arg_min(ln, l)) FROM d GROUP BY file, nl UNION ALL SELECT file, 'P', np, concat('P<!>', np, '<!>7!', min(p), '<!>', arg_min(pn, p)) FROM d GROUP BY file, np "
    "UNION ALL SELECT file, 'R', nr, concat('R<!>', nr, '<!>', r) FROM d GROUP BY file, nr, r"
)
def inventory_legends(spark, sf_dir):
    """The lists of a file: time ranges, grids, levels, parameters and processes, decoded from bitmaps and in the order of their names."""
    return inventories.legend(_numbered(spark, sf_dir)[1], "7!")
