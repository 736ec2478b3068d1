"""Progress lines of child processes: classification, and state of each operation as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package

#: What each kind of line looks like, its capture being the first group.
PATTERNS = {
    "registered": r"^Submodule '[^']+' .* registered for path '([^']+)'",
    "cloning": r"^Cloning into '([^']+)'\.\.\.",
    "checkout": r"^Submodule path '([^']+)': checked out '",
    "receiving": r"^Receiving objects:\s+(\d+)%",
    "resolving": r"^Resolving deltas:\s+(\d+)%",
    "files": r"^Checking out files:\s+(\d+)%",
    "error": r"^((?:fatal:|error:|remote: aborting).*)",
}


def lines_of(chunks: DataFrame, column: str = "value") -> DataFrame:
    """Complete lines of recorded output: split at CR or LF; what follows the last one is not a line yet."""
    parts = F.split(column, "[\r\n]")
    rest = [c for c in chunks.columns if c != column]
    return chunks.select(*rest, F.posexplode(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("seq", "line"))


def classified(df: DataFrame, column: str = "line") -> DataFrame:
    """``df`` with class, percent, name (last component of a captured path) and error."""
    line = F.trim(F.col(column))
    kind, percent, name = F.lit("other"), F.lit(None).cast("int"), F.lit(None).cast("string")
    for k, p in reversed(PATTERNS.items()):
        hit = line.rlike(p)
        kind = F.when(hit, k).otherwise(kind)
        if k in ("receiving", "resolving", "files"):
            percent = F.when(hit, F.regexp_extract(line, p, 1).cast("int")).otherwise(percent)
        elif k != "error":
            name = F.when(hit, F.element_at(F.split(F.regexp_replace(F.regexp_extract(line, p, 1), "/+$", ""), "/"), -1)).otherwise(name)
    return df.withColumns({"class": kind, "percent": percent, "name": name, "error": F.when(line.rlike(PATTERNS["error"]), line)})


STATE = "operation long, active string, percent int, finished int, errors int, last_seq long"


def advance(state: tuple, row) -> tuple:
    """State after one classified line: the active submodule, its percent, how many have ended, errors so far. A new
    submodule ends the one before."""
    active, percent, finished, errors, last = state
    kind = row["class"]
    if kind in ("cloning", "registered"):
        finished += active is not None and active != row["name"]
        active, percent = row["name"], 0
    elif kind == "checkout":
        finished, active, percent = finished + 1, None, 100
    elif kind in ("receiving", "resolving", "files") and not pd.isna(row["percent"]):
        percent = int(row["percent"])
    elif kind == "error":
        errors += 1
    return active, percent, finished, errors, max(last, int(row["seq"]))


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    now = state.get if state.exists else (None, 0, 0, 0, -1)
    for pdf in frames:
        for row in pdf.sort_values("seq").to_dict("records"):
            now = advance(now, row)
    state.update(now)
    yield pd.DataFrame([(int(key[0]), *now)], columns=[c.split(" ")[0] for c in STATE.split(", ")])


def track(lines: DataFrame) -> DataFrame:
    """A stream of states of a stream of lines (operation, seq, line), keyed by operation."""
    ship_package(lines.sparkSession)
    return classified(lines).groupBy("operation").applyInPandasWithState(_fold, STATE, "active string, percent int, finished int, errors int, last_seq long", "update", "NoTimeout")


def finished(states: DataFrame, ends: DataFrame) -> DataFrame:
    """The terminal event of each operation: its last state, with the time from ``ends`` (operation, name, started, ended)
    as it is shown. What was active has ended with it."""
    from ..functions.paths import duration

    seconds = F.col("ended").cast("double") - F.col("started").cast("double")
    closed = (F.coalesce("finished", F.lit(0)) + F.col("active").isNotNull().cast("int")).alias("finished")
    return ends.join(states, "operation", "left").select("operation", "name", closed, F.coalesce("errors", F.lit(0)).alias("errors"), duration(seconds).alias("elapsed"))


def raw_log(lines: DataFrame) -> DataFrame:
    """(operation, log): everything an operation printed (operation, seq, line), whatever its class."""
    from ..frames import in_order

    return lines.groupBy("operation").agg(F.array_join(in_order("line", "seq"), "\n").alias("log"))


#: Lines of one operation that are folded in one stretch.
STRETCH = 4096


def latest(lines: DataFrame) -> DataFrame:
    """The same states from recorded lines (operation, seq, line), in one batch. An operation's lines are cut into
    stretches of numbers, each of which is read in order; what stretches say is then put together, so no task holds an
    operation, and only one row a stretch is ordered by operation. ``finished`` and ``errors`` are counts, ``percent`` and
    ``active`` what the last line said."""
    from pyspark.sql import Window

    kind = F.col("class")
    opens = kind.isin("cloning", "registered")
    rows = classified(lines).withColumn("stretch", F.floor(F.col("seq") / STRETCH))
    said = F.when(opens, F.struct(F.col("name").alias("n"))).when(kind == "checkout", F.struct(F.lit(None).cast("string").alias("n")))
    marked = rows.select("operation", "stretch", "seq", "name", opens.alias("opens"), (kind == "checkout").alias("ends"), (kind == "error").cast("int").alias("err"), said.alias("said"), F.when(opens, 0).when(kind == "checkout", 100).otherwise(F.col("percent")).alias("pc"))
    at, pc_at = F.when(F.col("said").isNotNull(), F.col("seq")), F.when(F.col("pc").isNotNull(), F.col("seq"))
    inside = Window.partitionBy("operation", "stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = marked.withColumn("before", F.last("said", ignorenulls=True).over(inside))
    ended = F.when(F.col("ends"), 1).when(F.col("opens") & (F.col("before.n") != F.col("name")), 1).otherwise(0)
    # the first to speak in a stretch does not see what was active before it
    first = F.min_by(F.struct("opens", "name"), at)
    parts = before.groupBy("operation", "stretch").agg(
        F.sum(ended).alias("ended"), F.sum("err").alias("errors"), F.max_by("said", at).alias("said"), first.alias("first"), F.max_by("pc", pc_at).alias("pc"), F.max(pc_at).alias("pc_at"), F.max("seq").alias("last_seq")
    )
    over = Window.partitionBy("operation").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    joined = parts.withColumn("carried", F.last("said", ignorenulls=True).over(over))
    more = F.when(F.col("first.opens") & (F.col("carried.n") != F.col("first.name")), 1).otherwise(0)
    spoke = F.when(F.col("said").isNotNull(), F.col("stretch"))
    return joined.groupBy("operation").agg(F.max_by("said", spoke)["n"].alias("active"), F.coalesce(F.max_by("pc", "pc_at"), F.lit(0)).alias("percent"), F.sum(F.col("ended") + more).cast("int").alias("finished"), F.sum("errors").cast("int").alias("errors"), F.max("last_seq").alias("last_seq"))
