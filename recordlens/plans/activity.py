"""Session activity in batch form: live files, badges, tree, health, suggestions, snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recordlens.functions import fixed, text
from recordlens.operators import aggregates
from recordlens.operators.ordered import pick_row


def latest_state(events: DataFrame, order: list[str], session: str = "sessionId") -> DataFrame:
    """Last event per path of a session; a removal drops that path only."""
    last = pick_row(events, [session, "filePath"], order, last=True)
    return last.filter(~F.col("eventType").isin("unlink", "unlinkDir"))


def _badge(when: Column, name: str, severity: str, value: Column) -> Column:
    return F.when(when, F.struct(F.lit(name).alias("id"), F.lit(severity).alias("severity"),
                                 value.cast("int").alias("value")))


def _sized(c: Column, name: str, yellow: int, red: int) -> Column:
    return F.coalesce(_badge(c > red, name, "red", c), _badge(c > yellow, name, "yellow", c))


def badges_of(lines: Column, imports: Column, exports: Column) -> Column:
    """Badges of a file: size and imports in two steps, exports in one."""
    return F.array_compact(F.array(
        _sized(lines, "oversized", fixed.LINES_YELLOW, fixed.LINES_RED),
        _sized(imports, "importHeavy", fixed.IMPORTS_YELLOW, fixed.IMPORTS_RED),
        _badge(exports > fixed.EXPORTS_YELLOW, "highSurfaceArea", "yellow", exports),
    ))


def file_badges(live: DataFrame) -> DataFrame:
    return live.withColumn("badges", badges_of(F.col("lines"), F.col("imports"), F.col("exports")))


def worst(badges: Column) -> Column:
    """0 without badges, 1 for yellow, 2 for red."""
    has = lambda s: F.exists(badges, lambda b: b["severity"] == s)
    return F.when(has("red"), 2).when(has("yellow"), 1).otherwise(0)


def _folders(live: DataFrame, session: str) -> DataFrame:
    """Every folder of the live paths, the root included, with its number of direct files."""
    per = live.groupBy(session, text.dirname(F.col("filePath")).alias("path")).agg(
        F.count("*").alias("files"))
    up = F.concat(F.array(F.lit(".")), text.ancestors(F.col("path")))
    above = per.select(session, F.explode(up).alias("path")).select(
        session, "path", F.lit(0).cast("bigint").alias("files"))
    return per.unionByName(above).groupBy(session, "path").agg(F.sum("files").alias("files"))


def branch_badges(live: DataFrame, session: str = "sessionId") -> DataFrame:
    """Badges of folders: many direct files, deep nesting."""
    depth = text.segment_count(F.col("path"))
    return _folders(live, session).withColumn("badges", F.array_compact(F.array(
        _badge(F.col("files") > fixed.FLAT_FILES, "flatDump", "yellow", F.col("files")),
        _badge(depth > fixed.DEEP_SEGMENTS, "deepNesting", "yellow", depth))))


def build_tree(live: DataFrame, session: str = "sessionId") -> DataFrame:
    """Nodes of the path tree: path, parent, name, kind, badges."""
    c = F.col
    files = file_badges(live).select(session, c("filePath").alias("path"), F.lit("file").alias("kind"),
                                     "badges")
    dirs = branch_badges(live, session).select(session, "path", F.lit("dir").alias("kind"), "badges")
    parent = F.when(c("path") != ".", text.dirname(c("path")))
    return files.unionByName(dirs).withColumns({
        "parent": parent,
        "name": F.when(c("path") == ".", "root").otherwise(F.substring_index("path", "/", -1)),
    })


def tree_health(live: DataFrame, session: str = "sessionId") -> DataFrame:
    tree = build_tree(live, session)
    nodes = tree.select(F.col(session).alias("session"), "path", worst(F.col("badges")).alias("own"),
                        (F.size("badges") > 0).alias("has_badges"))
    return aggregates.severity_rollup(nodes)


def node_health(live: DataFrame, paths: DataFrame | None = None,
                session: str = "sessionId") -> DataFrame:
    """Badges and number of children of each node, or of the requested paths."""
    tree = build_tree(live, session)
    if paths is not None:
        tree = tree.join(paths, "path", "left_semi")
    children = build_tree(live, session).filter(F.col("parent").isNotNull()).groupBy(
        session, F.col("parent").alias("path")).agg(F.count("*").alias("children"))
    return tree.join(children, [session, "path"], "left").fillna({"children": 0})


def suggested_action(badges: Column) -> Column:
    has = lambda n: F.exists(badges, lambda b: b["id"] == n)
    red = F.exists(badges, lambda b: b["severity"] == "red")
    return (
        F.when(F.size(badges) == 0, "continue")
        .when(red & (F.size(badges) >= 2), "secondOpinion")
        .when(has("oversized") | has("highSurfaceArea"), "splitFile")
        .when(has("importHeavy"), "refactor").otherwise("inspect"))


def session_snapshot(events: DataFrame, order: list[str], session: str = "sessionId") -> DataFrame:
    """Per session: event statistics and the size of its live tree."""
    live = latest_state(events, order, session)
    nodes = build_tree(live, session).groupBy(session).agg(
        F.count_if(F.col("kind") == "file").alias("files"),
        F.count_if(F.col("kind") == "dir").alias("folders"),
        F.count_if(F.size("badges") > 0).alias("badged"))
    stats = aggregates.session_stats(events, order=order, session=session)
    return stats.join(nodes, session, "left").fillna(0, ["files", "folders", "badged"])


def headline(stats: DataFrame) -> DataFrame:
    """Session headline: counts that are not zero, and the most active area."""
    c = F.col
    part = lambda n, w: F.when(c(n) > 0, F.concat(c(n).cast("string"), F.lit(w)))
    body = F.concat_ws(", ", part("created", " files created"), part("modified", " modified"),
                       part("deleted", " removed"))
    area = F.when(c("hottest_branch").isNotNull() & (c("hottest_branch") != "."),
                  F.concat(F.lit("Most active area: "), c("hottest_branch")))
    return stats.withColumns({
        "headline": F.when(body == "", "No changes yet").otherwise(body),
        "area": text.blank(area)})


FILTERS = ("last15", "last30", "last60", "unhealthy", "newOnly")


def recency_filter(events: DataFrame, name: str | None, *, as_of: str) -> DataFrame:
    """Events of a named view; None keeps all."""
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(
        F.col("timestamp").cast("timestamp"))
    if name in ("last15", "last30", "last60"):
        return events.filter(age < int(name[4:]) * 60_000_000)
    if name == "unhealthy":
        return events.filter(F.size("badges") > 0)
    if name == "newOnly":
        return events.filter(F.col("eventType") == "add")
    return events


def file_metrics(rows: DataFrame, content: str) -> DataFrame:
    """Lines, characters, imports and exports of source text."""
    c = F.col(content)
    return rows.withColumns({
        "lines": F.size(F.split(c, "\n")), "chars": F.length(c),
        "imports": F.regexp_count(c, F.lit(r"(?m)^import\s")) + F.regexp_count(c, F.lit(r"require\(")),
        "exports": F.regexp_count(c, F.lit(r"(?m)^export\s"))
        + F.regexp_count(c, F.lit(r"module\.exports")),
    })
