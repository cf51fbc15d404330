"""Sinks."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.sources.parts import delete_rows, key_of, read_parts, replace_parts

# S5 ----------------------------------------------------------------------------


def visit_rows(visits: DataFrame) -> DataFrame:
    """Stored form of visits: texts cut to 500 characters, the address as a hash."""

    def cut(name: str) -> Column:
        return F.substring(name, 1, 500)

    return visits.select(
        "session_id",
        F.sha2(F.col("ip").cast("string"), 256).alias("ip_hash"),
        cut("user_agent").alias("user_agent"),
        F.nullif(cut("landing_page"), F.lit("")).alias("landing_page"),
        F.nullif(cut("referrer"), F.lit("")).alias("referrer"),
        "created_at",
    )


def only_new(incoming: DataFrame, stored: DataFrame | None, key: str, order: Sequence[str]) -> DataFrame:
    """First row per key among ``incoming``, without keys already stored. The earliest row wins;
    the choice is a partial aggregation, so many repeats of one key stay small."""
    whole = F.struct(*[F.col(c) for c in incoming.columns])
    first = incoming.groupBy(F.col(key).alias("_key")).agg(F.min_by(whole, F.struct(*order)).alias("r")).select("r.*")
    return first if stored is None else first.join(stored.select(key), key, "left_anti")


def append_once(incoming: DataFrame, path: str, key: str, order: Sequence[str]) -> None:
    """Append rows whose key the table at ``path`` does not hold yet. One writer at a time."""
    spark = incoming.sparkSession
    try:
        stored = spark.read.schema(incoming.schema).parquet(path)
        stored.limit(1).count()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = None
    only_new(incoming, stored, key, order).write.mode("append").parquet(path)


# S6 ----------------------------------------------------------------------------------


def _linked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends exist."""
    src = nodes.select(F.col("label").alias("src_label"), F.col("id").alias("src"))
    dst = nodes.select(F.col("label").alias("dst_label"), F.col("id").alias("dst"))
    return edges.join(src, ["src_label", "src"], "left_semi").join(dst, ["dst_label", "dst"], "left_semi")


def _name(limit: int) -> Column:
    p = F.col("props")
    shown = F.coalesce(*[F.nullif(p[k], F.lit("")) for k in ("title", "topic", "description")], F.col("id"))
    return F.left(shown, F.lit(limit))


def _xml(text: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def _quoted(text: Column) -> Column:
    """A JSON string literal."""
    return F.substring(F.to_json(F.struct(text.alias("v"))), F.lit(6), F.length(F.to_json(F.struct(text.alias("v")))) - 6)


def graph_lines(nodes: DataFrame, edges: DataFrame, fmt: str, corpus: str = "curriculum") -> DataFrame:
    """``(place, line)`` of an export as ``json`` (one object per line), ``graphml`` or
    ``cypher``. Edges with a missing end are dropped."""
    spark = nodes.sparkSession
    linked = _linked(nodes, edges)
    key = F.concat_ws(":", "label", "id")
    src, dst = F.concat_ws(":", "src_label", "src"), F.concat_ws(":", "dst_label", "dst")

    def fixed(place: int, lines: Sequence[str]) -> DataFrame:
        return spark.range(1).select(F.lit(place).alias("place"), F.explode(F.array(*[F.lit(x) for x in lines])).alias("line"))

    if fmt == "json":
        node = F.to_json(F.struct(key.alias("id"), "label", _name(70).alias("name"), "props"))
        edge = F.to_json(F.struct(src.alias("s"), dst.alias("t"), "rel", F.when(F.size("props") > 0, F.col("props")).alias("props")))
        parts = [nodes.select(F.lit(1).alias("place"), node.alias("line")), linked.select(F.lit(2), edge)]
    elif fmt == "graphml":
        node = F.concat(
            F.lit('<node id="'), _xml(key), F.lit('"><data key="label">'), _xml(F.col("label")),
            F.lit('</data><data key="name">'), _xml(_name(80)), F.lit("</data></node>"),
        )
        edge = F.concat(
            F.lit('<edge source="'), _xml(src), F.lit('" target="'), _xml(dst), F.lit('"><data key="rel">'),
            _xml(F.col("rel")), F.lit("</data></edge>"),
        )
        head = (
            '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">'
            '<key id="label" for="node" attr.name="label" attr.type="string"/>'
            '<key id="name" for="node" attr.name="name" attr.type="string"/>'
            '<key id="rel" for="edge" attr.name="rel" attr.type="string"/><graph edgedefault="directed">'
        )
        parts = [
            fixed(0, [head]),
            nodes.select(F.lit(1), node),
            linked.select(F.lit(2), edge),
            fixed(3, ["</graph></graphml>"]),
        ]
    elif fmt == "cypher":

        def settings(props: Column) -> Column:
            cells = F.transform(F.map_entries(props), lambda e: F.concat(e["key"], F.lit(":"), _quoted(e["value"])))
            return F.array_join(cells, ", ")

        with_corpus = F.map_concat("props", F.create_map(F.lit("id"), F.col("id"), F.lit("corpus"), F.lit(corpus)))
        limits = nodes.select("label").distinct().select(
            F.lit(0).alias("place"),
            F.format_string(
                "CREATE CONSTRAINT %s_id IF NOT EXISTS FOR (n:%s) REQUIRE n.id IS UNIQUE;", F.lower("label"), F.col("label")
            ).alias("line"),
        )
        node = F.concat(
            F.lit("MERGE (n:"), "label", F.lit(" {id:"), _quoted(F.col("id")), F.lit("}) SET n += {"), settings(with_corpus), F.lit("};")
        )
        ends = F.concat(
            F.lit("MATCH (a:"), "src_label", F.lit(" {id:"), _quoted(F.col("src")), F.lit("}),(b:"), "dst_label",
            F.lit(" {id:"), _quoted(F.col("dst")), F.lit("}) "),
        )
        by_book = F.concat(
            ends, F.lit("MERGE (a)-[e:"), "rel", F.lit(" {book:"), _quoted(F.col("props")["book"]),
            F.lit("}]->(b) SET e += {"), settings(F.col("props")), F.lit("};"),
        )
        plain = F.concat(ends, F.lit("MERGE (a)-[:"), "rel", F.lit("]->(b);"))
        derived = F.col("rel").isin("PRECEDES_SLO", "CO_TAUGHT_WITH")
        parts = [limits, nodes.select(F.lit(1), node), linked.select(F.lit(2), F.when(derived, by_book).otherwise(plain))]
    else:
        raise ValueError(f"unknown format {fmt!r}")
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.union(part)
    return lines


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, fmt: str = "json", corpus: str = "curriculum") -> None:
    """Write the lines as text files whose order by name is the order of the document."""
    graph_lines(nodes, edges, fmt, corpus).orderBy("place", "line").select("line").write.mode("overwrite").text(path)


# S7 ------------------------------------------------------------------------------------

STALE_MINUTES = 5


def snapshot(df: DataFrame, folder: str, name: str, as_of: str) -> None:
    """Store a result table as of its refresh time. A reader sees a refresh only when it is committed;
    the one before stays for readers that have begun, older ones are deleted."""
    stamped = df.withColumn("last_refreshed", F.lit(as_of).cast("timestamp"))
    replace_parts(stamped, f"{folder}/{name}", F.lit("all"), gone=None, tag=as_of)


def read_snapshot(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The newest refresh, found through the pointer of the table."""
    return read_parts(spark, f"{folder}/{name}")


def refresh_days(
    folder: str, name: str, daily: Callable[[Sequence[str]], DataFrame], day: str, days: Sequence[str], as_of: str
) -> None:
    """Replace the rows of ``days`` (ISO dates) in a table of one part a day by what ``daily(days)`` computes.

    ``daily`` gets the days so that it reads no other; ``day`` names its date column. Days for which it gives
    no row go from the table, days not listed stay. Mergeable daily sums make a view that is added up when read.
    """
    fresh = daily(days).filter(F.col(day).cast("string").isin(*days))
    replace_parts(fresh, f"{folder}/{name}", F.col(day), gone=[key_of(d) for d in days], tag=as_of)


def snapshot_status(snapshots: Mapping[str, DataFrame], as_of: str) -> DataFrame:
    """Rows, last refresh, age in minutes and stale flag per snapshot."""
    now = F.lit(as_of).cast("timestamp")
    out = None
    for name, df in snapshots.items():
        part = df.agg(F.count("*").alias("row_count"), F.max(F.col("last_refreshed").cast("timestamp")).alias("last_refresh")).select(
            F.lit(name).alias("view_name"), "last_refresh", "row_count"
        )
        out = part if out is None else out.unionByName(part)
    minutes = (F.unix_micros(now) - F.unix_micros("last_refresh")) / 60_000_000
    return out.withColumns(
        {"minutes_since_refresh": F.floor(minutes).cast("bigint"), "needs_refresh": minutes >= STALE_MINUTES}
    )


def refresh_all(views: Mapping[str, Callable[[], DataFrame]], folder: str, as_of: str) -> list[dict]:
    """Refresh each view; a failing one is reported and does not stop the others."""
    report = []
    for name, build in views.items():
        start = time.monotonic()
        try:
            snapshot(build(), folder, name, as_of)
            error = None
        except Exception as problem:  # noqa: BLE001
            error = str(problem)
        report.append({"view": name, "seconds": time.monotonic() - start, "error": error})
    return report


# S8, S9 ----------------------------------------------------------------------------------


def metric_rows(df: DataFrame, panel: str, keys: Sequence[str], kind: str, day: str) -> DataFrame:
    """A panel as long rows (kind, day, panel, key, metric, value); keys become one JSON text."""
    values = [c for c in df.columns if c not in keys]
    cells = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in values]
    key = F.to_json(F.struct(*keys)) if keys else F.lit("{}")
    return df.select(
        F.lit(kind).alias("kind"), F.lit(day).alias("day"), F.lit(panel).alias("panel"), key.alias("key"), F.inline(F.array(*cells))
    )


def publish_metrics(metrics: DataFrame, path: str) -> None:
    """Write panels under ``kind=/day=`` folders as JSON; publishing a day again replaces it."""
    (
        metrics.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("kind", "day")
        .json(f"{path}/metrics")
    )
    manifest(metrics).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "day").json(
        f"{path}/manifest"
    )


def manifest(metrics: DataFrame) -> DataFrame:
    """Panels of a run with their number of values."""
    return metrics.groupBy("kind", "day", "panel").agg(F.count("*").alias("values"))


def _expired(as_of: str, days_old: int) -> Column:
    old = F.col("completed_at") < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days_old} DAY")
    return F.coalesce(F.col("status").isin("completed", "failed") & old, F.lit(False))


def purge(jobs: DataFrame, as_of: str, days_old: int = 30) -> DataFrame:
    """Jobs that stay."""
    return jobs.filter(~_expired(as_of, days_old))


def purged_count(jobs: DataFrame, as_of: str, days_old: int = 30) -> DataFrame:
    """Number of jobs a purge removes."""
    return jobs.agg(F.count_if(_expired(as_of, days_old)).alias("deleted"))


def store_jobs(jobs: DataFrame, folder: str) -> None:
    """A job table with one part a month of completion, in place of what ``folder`` held."""
    replace_parts(jobs, folder, _month(), gone=None)


def purge_table(spark: SparkSession, folder: str, as_of: str, days_old: int = 30) -> int:
    """Delete completed and failed jobs of more than ``days_old`` days from a stored table and return how
    many. Months without such jobs are not written; a purge that dies leaves the table as it was; a second
    one finds nothing."""
    return delete_rows(spark, folder, _expired(as_of, days_old), tag=as_of)


def _month() -> Column:
    return F.date_format("completed_at", "yyyy-MM")
