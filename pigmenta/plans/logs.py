"""Lines of a run's log: one table of them, by which logs are written and read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Line:
    """``title: number``. ``alone`` says that a line begins with the title, and ``bare`` that it ends with the number."""

    title: str
    kind: str = "double"
    alone: bool = False
    bare: bool = False


#: The titles that other programs' logs have, by column.
LINES = {
    "nodes": Line("Nodes", "long", True, True),
    "edges": Line("Edges", "long", True, True),
    "theta": Line("EGC θ", "int", True),
    "runtime_ms": Line("runtime"),
    "color": Line("colors used", "int"),
    "iter_count": Line("Iter count", "int"),
    "phase_1_ms": Line("Phase 1 (Boundary+Preload)"),
    "phase_2_ms": Line("Phase 2 (Parallel Exec)"),
    "phase_3_ms": Line("Phase 3 (Result Merge)"),
}
#: What follows a margin that a model gave.
PREDICTED = "(Predicted)"
#: Cells of a row of the table of devices.
DEVICE_CELLS = (("device", "int"), ("parts", "int"), ("exec_ms", "double"), ("max_mem_mb", "double"), ("total_mem_mb", "double"))

#: Any title, colon and number in a line; the rest of the line is looked at, not taken, as another pair may follow.
_PAIR = r"([^\n:|]+):[ \t]*(\d+(?:\.\d+)?)(?=([^\n]*))"


def written(name: str, value: object, unit: str = "", note: str = "") -> str:
    """A line of the table with its value."""
    return f"{LINES[name].title}: {value}{' ' if unit else ''}{unit}{' ' if note else ''}{note}"


def _same(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), r"\s+", "")


def _of(line: Line) -> Column:
    """The first pair under the line's title."""
    wanted = "".join(line.title.lower().split())

    def fits(pair: Column) -> Column:
        title = _same(pair["title"])
        out = (title == wanted) & ~pair["title"].rlike(r"^\s") if line.alone else title.endswith(wanted)
        return out & (F.trim(pair["rest"]) == "") if line.bare else out

    return F.get(F.filter("pairs", fits), F.lit(0))


def parse_logs(logs: DataFrame) -> DataFrame:
    """``logs`` (run, text) with the figures of each text; null where a line is missing."""
    group = lambda i: F.regexp_extract_all("text", F.lit(_PAIR), F.lit(i))
    pairs = F.arrays_zip(group(1).alias("title"), group(2).alias("number"), group(3).alias("rest"))
    found = logs.select("run", pairs.alias("pairs"))
    predicted = F.coalesce(F.contains(F.lower(_of(LINES["theta"])["rest"]), F.lit(PREDICTED.lower())), F.lit(False))
    return found.select("run", *(_of(line)["number"].try_cast(line.kind).alias(name) for name, line in LINES.items()), predicted.alias("theta_predicted"))


def parse_devices(logs: DataFrame) -> DataFrame:
    """(run, device, parts, exec_ms, max_mem_mb, total_mem_mb): the rows of each text's table whose cells are all numbers."""
    lines = logs.select("run", F.explode(F.split("text", "\n")).alias("line"))
    cells = F.transform(F.split("line", r"\|"), F.trim)
    rows = lines.where(F.col("line").contains("|")).select("run", F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 2, F.lit(0))).alias("cells"))
    numbers = [F.get("cells", F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(DEVICE_CELLS)]
    return rows.where(F.size("cells") == len(DEVICE_CELLS)).select("run", *numbers).dropna()
