"""Queries of templates and of rules with fallback."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import templates
from ..operators import rules
from .queries import query, read

_ORDER = """\
@ an order and its lines
<order id="ORDER">\\
 <status>STATUS</status>
#IF LARGE
  <large/>
#ENDIF LARGE
#ELSE LARGE
  <usual/>
#ENDELSE LARGE
#REPEAT LINE
  <line n="$LOOP_COUNT" number="$($LOOP_COUNT+1)" half="$($LOOP_COUNT / 2)" share="$(LINE.quantity/8.0)" part="LINE.part">
#IF flag\\[!\\]R
    <returned/>
#ENDIF flag\\[!\\]R
!REPIF LINE.late
    <late>LINE.late</late>
!ENDREPIF LINE.late
#REPEAT LINE.mark
    <mark>LINE.mark</mark>
#ENDREPEAT LINE.mark
  </line>
#ENDREPEAT LINE
</order>
"""

_LINE_SQL = (
    "concat('  <line n=\"', i, '\" number=\"', i + 1, '\" half=\"', i // 2, '\" share=\"', CASE WHEN q % 8 = 0 THEN (q // 8)::VARCHAR ELSE printf('%.6f', q / 8.0::DOUBLE) END, '\" part=\"', l_partkey, '\">', chr(10), "
    "CASE WHEN l_returnflag = 'R' THEN concat('    <returned/>', chr(10)) ELSE '' END, CASE WHEN l_linenumber > 4 THEN concat('    <late>', l_linenumber, '</late>', chr(10)) ELSE '' END, "
    "'    <mark>', l_linestatus, '</mark>', chr(10), '    <mark>', l_returnflag, '</mark>', chr(10), '  </line>', chr(10))"
)


@query(
    f"SELECT o_orderkey, concat('<order id=\"', o_orderkey, '\"> <status>', o_orderstatus, '</status>', chr(10), CASE WHEN o_totalprice > 200000 THEN '  <large/>' ELSE '  <usual/>' END, chr(10), coalesce(t, ''), '</order>') AS document FROM orders LEFT JOIN "
    f"(SELECT l_orderkey, string_agg({_LINE_SQL}, '' ORDER BY i) AS t FROM (SELECT *, l_quantity::BIGINT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity::BIGINT, l_returnflag, l_linestatus) - 1 AS i FROM lineitem) GROUP BY l_orderkey) ON l_orderkey = o_orderkey"
)
def order_documents(spark, sf_dir):
    """A document for each order with its few lines, from a template."""
    line = F.struct(
        F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("bigint").alias("quantity"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("state"),
        F.when(F.col("l_linenumber") > 4, F.col("l_linenumber")).alias("late"), F.array("l_linestatus", "l_returnflag").alias("mark"),
    )
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    orders = read(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    made = templates.rendered(orders, _ORDER, "document", {"LARGE": F.col("o_totalprice") > 200000}, {"LINE": F.col("lines")}, {"ORDER": F.col("o_orderkey"), "STATUS": F.col("o_orderstatus")})
    return made.select("o_orderkey", "document")


_PART_SQL = "(SELECT p_partkey AS k, p_partkey // 50 AS m, p_partkey // 50 % 3 = 0 AND p_partkey % 2 = 1 AS s, p_size AS z, p_type, p_brand FROM part)"


def _keyword_maps(spark, sf_dir):
    """Parameter maps of fifty parts: a third of the formats keep the odd parts in a specialised map."""
    k, z = F.col("p_partkey"), F.col("p_size")
    m = F.floor(k / 50)
    name = F.concat(F.lit("m"), m, F.when((m % 3 == 0) & (k % 2 == 1), ".s1").otherwise(""))
    gcmd = lambda when, condition, value: F.when(condition, F.concat(F.lit("<GCMD"), when, F.lit(">"), value, F.lit("</GCMD>"))).otherwise(F.lit(""))
    kind = F.concat(F.lit(' ifLevelType="L'), z % 4, F.lit('"'))
    parameter = F.concat(
        F.lit('<parameter code="'), k, F.lit('"><units>K</units>'),
        gcmd(F.concat(kind, F.lit(' ifLevelValue="V'), z % 5, F.lit('"')), z % 6 == 0, F.concat(F.lit("n"), k)), gcmd(kind, z % 3 == 0, F.col("p_type")), gcmd(F.lit(""), F.lit(True), F.col("p_brand")),
        F.when(z % 2 == 0, F.concat(F.lit("<CF>cf"), z, F.lit("</CF>"))).otherwise(F.lit("")), F.lit("</parameter>"),
    )
    made = read(spark, sf_dir, "part").groupBy(name.alias("map")).agg(F.collect_list(parameter).alias("p"))
    return made.select("map", F.concat(F.lit("<parameterMap><title>t</title>"), F.array_join("p", ""), F.lit("</parameterMap>")).alias("xml"))


def _asked_for(spark, sf_dir):
    line = F.col("l_linenumber")
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("m"), F.floor(F.col("l_partkey") / 50)).alias("format"), F.concat(F.when(line % 2 == 1, "s1:").otherwise(""), F.col("l_partkey"), F.lit("@0")).alias("parameter"),
        F.concat(F.lit("L"), line % 4).alias("level_type"), F.concat(F.lit("V"), F.col("l_quantity").cast("bigint") % 5).alias("level_value"),
    )


def _keyword_sql(value: str) -> str:
    special = f"(l_linenumber % 2 = 1 AND l_partkey // 50 IN (SELECT m FROM {_PART_SQL} WHERE s))"
    return f"SELECT l_orderkey, l_linenumber, CASE WHEN s = {special} THEN {value} END AS keyword FROM lineitem LEFT JOIN {_PART_SQL} ON k = l_partkey"


@query(_keyword_sql("CASE WHEN z % 6 = 0 AND l_linenumber % 4 = z % 4 AND l_quantity::BIGINT % 5 = z % 5 THEN concat('n', k) WHEN z % 3 = 0 AND l_linenumber % 4 = z % 4 THEN p_type ELSE p_brand END"))
def parameter_keywords(spark, sf_dir):
    """Keywords by level type and value, type or any, from the map of format and specialisation or of the format."""
    found = rules.keywords(_asked_for(spark, sf_dir), rules.keyword_rules(_keyword_maps(spark, sf_dir), "map", "xml"), "GCMD")
    return found.select("l_orderkey", "l_linenumber", "keyword")


@query(_keyword_sql("CASE WHEN z % 2 = 0 THEN concat('cf', z) END"))
def parameter_names(spark, sf_dir):
    """As parameter_keywords, of a kind with no rules by level, by the plan for rules beyond a broadcast."""
    found = rules.keywords(_asked_for(spark, sf_dir), rules.keyword_rules(_keyword_maps(spark, sf_dir), "map", "xml"), "CF", most=0)
    return found.select("l_orderkey", "l_linenumber", "keyword")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Aircraft' WHEN 1 THEN 'Moored Buoy' WHEN 2 THEN 'Coastal Marine Automated Network (CMAN) Station' ELSE '' END AS platform FROM events")
def platform_names(spark, sf_dir):
    """Names of kinds of platforms, empty for others and null."""
    kind = F.get(F.array(*map(F.lit, ("aircraft", "mooredBuoy", "CMAN", "raft", None))), (F.col("event_id") % 5).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", rules.platform(kind).alias("platform"))
