"""Interval joins and groups that hold up on long, hot and malformed intervals.

Spans are pairs of epoch micros ``(start, end)``; ``end`` may lie before
``start``. Two spans can only meet in the sense used here when their closed hulls
``[least, greatest]`` share an instant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskmill.functions.times import DAY_US
from deskmill.operators.ids import in_ranges

# Spans up to 32 days meet in day cells; longer ones, and whatever meets them, in
# cells of 1,024 days. A coarse cell carries its channel as last micro: 1 for a long
# span on the left, 2 for a long one on the right that meets a short one. So two short
# spans never meet in a coarse cell.
LONG_US = 32 * DAY_US
COARSE_US = 1024 * DAY_US


def _floor(micros: str, width: int) -> str:
    return f"({micros} - pmod({micros}, {width}L))"


def _cells(df: DataFrame, side: str, span: tuple[str, str], other_has_long: Column) -> DataFrame:
    """Rows once per cell they reach, in every channel they take part in."""
    low, high = f"least({span[0]}, {span[1]})", f"greatest({span[0]}, {span[1]})"
    l, h, long_ = f"_{side}_low", f"_{side}_high", f"_{side}_long"
    fine = f"sequence({_floor(l, DAY_US)}, {_floor(h, DAY_US)}, {DAY_US}L)"

    def coarse(channel: int) -> str:
        return f"sequence({_floor(l, COARSE_US)} + {channel}, {_floor(h, COARSE_US)} + {channel}, {COARSE_US}L)"

    # Left: long in 1, short in 2. Right: long in 1 and 2, short in 1.
    wide, narrow = (coarse(1), coarse(2)) if side == "l" else (f"concat({coarse(1)}, {coarse(2)})", coarse(1))
    return (
        df.selectExpr("*", f"{low} AS {l}", f"{high} AS {h}", f"{high} - {low} > {LONG_US}L AS {long_}")
        .withColumn(f"_{side}_wide", other_has_long)
        .selectExpr(
            "*",
            f"explode(CASE WHEN {long_} THEN {wide} WHEN _{side}_wide THEN concat({fine}, {narrow})"
            f" ELSE {fine} END) AS _{side}_cell",
        )
        .drop(h, long_, f"_{side}_wide")
    )


def stored_cells(right: DataFrame, span: tuple[str, str]) -> DataFrame:
    """``right`` once per cell, for a table that serves as ``overlap_join(..., stored=True)``.

    Cells for long spans on the left are written too, since a later left side may have some.
    """
    return _cells(right, "r", span, F.lit(True))


def longest(df: DataFrame, span: tuple[str, str]) -> Column:
    """Length of the longest span of ``df``: one number, found inside the same query."""
    return df.selectExpr(f"coalesce(max(abs({span[1]} - {span[0]})), 0L)").scalar()


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: tuple[str, str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    condition: str,
    how: str = "inner",
    left_longest: Column | None = None,
    right_longest: Column | None = None,
    stored: bool = False,
) -> DataFrame:
    """Equi join on a key and a time cell, then the exact ``condition``.

    ``condition`` is a SQL expression over both sides and must imply that the closed hulls meet. Column names of the two
    sides must differ. An inner join yields each pair once: in the first cell that
    both spans reach. ``left`` and ``left_semi`` keep one row per cell of the left
    span, so group by the left row's id afterwards. Work per cell follows the rows
    of that cell, and AQE splits a cell that is still too heavy.

    Coarse cells are only written where the other side has long spans at all.
    ``left_longest`` and ``right_longest`` are upper bounds of the span lengths;
    give them where a cheaper table than the side itself knows the bound. With ``stored`` the
    right side is a table of :func:`stored_cells`; bucketed by key and ``_r_cell``, it is
    joined where it lies.
    """
    if left_longest is None and not stored:
        left_longest = longest(left, left_span)
    if right_longest is None:
        right_longest = longest(right, right_span)
    a = _cells(left, "l", left_span, right_longest > LONG_US)
    b = right if stored else _cells(right, "r", right_span, left_longest > LONG_US)
    latest = "greatest(_l_low, _r_low)"
    is_fine = f"pmod(_l_cell, {DAY_US}L) = 0"
    on = F.expr(
        f"""{keys[0]} = {keys[1]} AND _l_cell = _r_cell
        AND _l_cell = CASE WHEN {is_fine} THEN {_floor(latest, DAY_US)}
                           ELSE {_floor(latest, COARSE_US)} + pmod(_l_cell, {DAY_US}L) END
        AND ({condition})"""
    )
    helper = [f"_{side}_{part}" for side in "lr" for part in ("low", "cell")]
    return a.join(b, on, how).drop(*helper)


def label_islands(df: DataFrame, key: str, low: str, high: str, out: str = "island") -> DataFrame:
    """Label the groups of spans that hang together by overlap, per key.

    ``low < high`` is required; touching spans stay apart. The label is the first
    ``low`` of the group. A prefix maximum, segmented by key: the spans are cut into
    written ranges of key, start and end, each range finds its running maximum of ends,
    and one row per key and range carries the maximum of all ranges before. The same goes
    for the starts that open a group. So a task's share is a range, however many spans one
    key has on one day; only equal spans cannot part, and need not be here more than once.
    """
    ranged = in_ranges(df, [key, low, high])
    # one task per range: by hash, some tasks would get several
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ranged.repartitionById(tasks, "_range")
    within = Window.partitionBy(key, "_range").orderBy(low, high)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    carried = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)

    def brought_in(rows: DataFrame, column: str, into: str) -> DataFrame:
        """The greatest ``column`` of the key in all earlier ranges: one row per key and range."""
        each = rows.groupBy(key, "_range").agg(F.max(column).alias(into))
        return each.select(key, "_range", F.max(into).over(carried).alias(into))

    opened = (
        ranged.withColumn("_before", F.max(high).over(before))
        .join(brought_in(ranged, high, "_reach_in"), [key, "_range"])
        .withColumn("_opens", F.expr(f"CASE WHEN coalesce({low} >= greatest(_before, _reach_in), true) THEN {low} END"))
    )
    return (
        opened.withColumn("_own", F.max("_opens").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .join(brought_in(opened, "_opens", "_open_in"), [key, "_range"])
        .withColumn(out, F.coalesce("_own", "_open_in"))
        .drop("_range", "_before", "_reach_in", "_opens", "_own", "_open_in")
    )
