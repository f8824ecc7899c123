"""CSV tables of the feeds: reading, header reconciliation, writing."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from recordlens.functions import text
from recordlens.sources import feeds

SOURCE_PATH = "_source_path"  # where a row was read; no normalised header looks like it
HEADER_READERS = 16
BYTE_ORDER_MARKS = ("﻿", "ï»¿")  # as UTF-8 and as read in latin1


def header_form(name: str) -> str:
    """Normalised header: upper case, other characters to single underscores."""
    return re.sub(r"[^A-Z0-9]+", "_", name.upper()).strip("_")


def _clean_header(name: str) -> str:
    for mark in BYTE_ORDER_MARKS:
        name = name.removeprefix(mark)
    return name.strip()


def drop_blank_rows(df: DataFrame) -> DataFrame:
    filled = F.concat_ws("", *[F.col(f"`{c}`") for c in df.columns])
    return df.filter(filled != "")


def csv_scan(spark: SparkSession, path: str | list[str], *, encoding: str = "UTF-8",
             multi_line: bool = True, with_path: bool = False) -> DataFrame:
    """Headered CSV as trimmed text columns; absent cells are blank, blank rows are dropped.

    ``multi_line`` allows line breaks inside quotes and reads one file per task. Feeds without such
    breaks should pass False, which lets Spark split large files. ``with_path`` adds each row's file
    as SOURCE_PATH. Several paths must have one header (``csv_layouts``).
    """
    raw = (
        spark.read.option("header", True).option("multiLine", multi_line)
        .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
        .option("encoding", encoding).option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True).option("enforceSchema", True).csv(path)
    )
    cells = [text.strip(F.col(f"`{c}`")).alias(_clean_header(c)) for c in raw.columns]
    if not with_path:
        return drop_blank_rows(raw.select(*cells))
    filled = F.concat_ws("", *[text.strip(F.col(f"`{c}`")) for c in raw.columns]) != ""
    # Spark gives the path as in a URL, but for its plus signs.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return raw.filter(filled).select(*cells, path.alias(SOURCE_PATH))


def _header_line(spark: SparkSession, path: str, encoding: str) -> str:
    """The first line with content, and those that its open quotes continue into."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, encoding))
        line = reader.readLine()
        while line is not None and not line.strip():
            line = reader.readLine()
        while line is not None and line.count('"') % 2:
            more = reader.readLine()
            if more is None:
                break
            line += "\n" + more
        return line or ""
    finally:
        stream.close()


def csv_layouts(spark: SparkSession, paths: Sequence[str], *, encoding: str = "UTF-8") -> dict[tuple[str, ...], list[str]]:
    """Files by header, so that those of one header are read in one scan.

    Only the header lines reach the driver, a few of them at a time; an empty file has the empty header.
    """
    with ThreadPoolExecutor(HEADER_READERS) as readers:
        lines = list(readers.map(lambda path: _header_line(spark, path, encoding), paths))
    out: dict[tuple[str, ...], list[str]] = {}
    for path, line in zip(paths, lines):
        names = next(csv.reader([line]), [])
        out.setdefault(tuple(_clean_header(n) for n in names), []).append(path)
    return out


def with_normal_headers(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Columns under their normalised header; unnamed columns go, of equal names the last stays.

    Columns in ``keep`` stay as they are.
    """
    by_name: dict[str, str] = {}
    for c in df.columns:
        if c not in keep and not re.fullmatch(r"_c\d+", c) and header_form(c):
            by_name[header_form(c)] = c
    return df.select(*[text.strip(F.col(f"`{c}`")).alias(n) for n, c in by_name.items()], *keep)


def build_mapping(headers: Sequence[str], candidates: dict[str, list[str]]) -> tuple[dict, list]:
    """Field -> first candidate header that is present, and the fields without any."""
    mapping = {f: next((h for h in hs if h in headers), None) for f, hs in candidates.items()}
    return {f: h for f, h in mapping.items() if h}, [f for f, h in mapping.items() if not h]


def reconcile_columns(df: DataFrame, candidates: dict[str, list[str]],
                      essential: Sequence[str] = (), keep: Sequence[str] = ()) -> tuple[DataFrame | None, list[str]]:
    """Table under the field names, and the missing fields; None when an essential one is missing.

    The decision is made once from the header, so it is a plain projection of the scan. Columns in
    ``keep`` follow the fields.
    """
    df = with_normal_headers(df, keep)
    mapping, missing = build_mapping([c for c in df.columns if c not in keep], candidates)
    if any(f in missing for f in essential):
        return None, missing
    out = df.select(*[F.col(h).alias(f) for f, h in mapping.items()], *keep)
    return out.withColumns({f: F.lit("") for f in missing}).select(*candidates, *keep), missing


def empty_table(spark: SparkSession, columns: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))


def columns_as_text(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    return [(text.blank(F.col(f"`{c}`").cast("string")) if c in df.columns else F.lit("")).alias(c)
            for c in columns]


def with_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly these columns as text, blank where the table lacks one."""
    return df.select(*columns_as_text(df, columns))


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there; a path that cannot be read is an error, not an absent one."""
    try:
        spark.read.format("binaryFile").load(path)
        return True
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def load_tables(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The nine logical tables; an absent file is an empty table."""
    out = {}
    for name, (file, columns) in feeds.TABLES.items():
        path = f"{directory.rstrip('/')}/{file}.csv"
        if _exists(spark, path):
            df = csv_scan(spark, path)
            known = [c for c in columns if c in df.columns]
            extra = [c for c in df.columns if c not in columns]
            out[name] = with_columns(df, [*known, *[c for c in columns if c not in known], *extra])
        else:
            out[name] = empty_table(spark, columns)
    return out


def list_entities(registry: DataFrame) -> DataFrame:
    return registry.select("N_NUMBER", "YEAR_MFR", "MFR", "MODEL", "SERIAL_NUMBER", "REGISTRANT_NAME")


def csv_sink(df: DataFrame, columns: Sequence[str], path: str) -> None:
    """CSV with a fixed column order; quotes only where the value needs them."""
    with_columns(df, columns).write.mode("overwrite").option("header", True) \
        .option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def batch_sink(records: DataFrame, directory: str) -> None:
    csv_sink(records, records.columns, f"{directory}/records_csv")
    records.write.mode("overwrite").json(f"{directory}/records_json")


# ------------------------------------------------------------------ landed files
def one_source(path: str) -> str:
    """The folder of a part file that Spark wrote into a folder named as a CSV file, else the path."""
    folder, _, name = path.rpartition("/")
    return folder if name.startswith("part-") and folder.lower().endswith(".csv") else path


def source_of(path: Column) -> Column:
    """``one_source`` of a column."""
    return F.regexp_replace(path, r"(?i)(\.csv)/(?-i:part-)[^/]*$", "$1")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def landed_tables(spark: SparkSession, files: Sequence[str], candidates: dict[str, list[str]], essential: Sequence[str]
                  ) -> tuple[list[DataFrame], list[tuple[str, list[str]]], list[DataFrame]]:
    """Files of whatever layouts as tables of the fields and SOURCE_PATH, and (source, missing fields) of those left out.

    There is one table, and one scan, for every layout, however many files have it. An empty part file
    says nothing about a source whose other parts have a header. Last come the paths of all rows, also of
    layouts that are left out.
    """
    out, paths, refused, empty, readable = [], [], [], set(), set()
    for header, members in csv_layouts(spark, files).items():
        sources = {one_source(p) for p in members}
        if not header:
            empty |= sources
            continue
        readable |= sources
        rows = csv_scan(spark, members, with_path=True)
        rows = rows.withColumn(SOURCE_PATH, source_of(F.col(SOURCE_PATH)))
        paths.append(rows.select(SOURCE_PATH))
        mapped, missing = reconcile_columns(rows, candidates, essential, [SOURCE_PATH])
        if mapped is None:
            refused += [(s, missing) for s in sources]
        else:
            out.append(mapped)
    refused += [(s, list(candidates)) for s in empty - readable]
    return out, sorted(refused), paths


def union_all(parts: Sequence[DataFrame]) -> DataFrame | None:
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


# ------------------------------------------------------------------ yearly files
YEAR_IN_NAME = r"(?:19|20)\d{2}"


def yearly_rows(rows: DataFrame, fields: Sequence[str], year: Column, path: Column) -> DataFrame:
    """Rows under report ids with their year.

    Missing report ids are made from the year, a hash of the row and, for equal rows of a file, their
    number; they stay the same on a re-run.
    """
    rows = rows.withColumns({"SOURCE_YEAR": year, "_path": path})
    digest = F.sha2(F.concat_ws("|", *fields), 256)
    blank = text.is_blank(F.col("REPORT_ID"))
    turn = F.row_number().over(Window.partitionBy("_path", "_digest").orderBy("_digest"))
    made = F.concat("SOURCE_YEAR", F.lit("-"), "_digest", F.when(turn > 1, F.concat(F.lit("-"), turn)).otherwise(""))
    # Only rows without an id are numbered, so the others are not shuffled.
    without = rows.filter(blank).withColumn("_digest", digest).withColumn("REPORT_ID", made).drop("_digest")
    return rows.filter(~blank).unionByName(without).withColumn("N_NUMBER", text.normalize_mark(F.col("N_NUMBER"))).drop("_path")


def yearly_files(spark: SparkSession, files: Sequence[str], candidates: dict[str, list[str]], essential: Sequence[str]
                 ) -> tuple[DataFrame | None, DataFrame, list[tuple[str, str]]]:
    """Yearly files, the year in their name, as one table, the rows of each file, and the files left out.

    One scan per layout.
    """
    layouts, refused, read = landed_tables(spark, files, candidates, essential)
    path = F.col(SOURCE_PATH)
    year = F.coalesce(F.nullif(F.regexp_extract(file_name(path), YEAR_IN_NAME, 0), F.lit("")), F.lit("unknown"))
    rows = union_all(layouts)
    sources = sorted({one_source(f) for f in files})
    listed = spark.createDataFrame([(s,) for s in sources], f"{SOURCE_PATH} string")
    counts = union_all([listed.limit(0), *read]).groupBy(SOURCE_PATH).agg(F.count("*").alias("ROWS"))
    counted = listed.join(counts, SOURCE_PATH, "left")
    lineage = counted.select(year.alias("YEAR"), file_name(path).alias("FILE"),
                             F.coalesce("ROWS", F.lit(0)).alias("ROWS"), path.alias("PATH"))
    skipped = [(s.rsplit("/", 1)[-1], f"no column for {', '.join(f for f in lost if f in essential)}; the file is left out")
               for s, lost in refused]
    if rows is not None:
        rows = yearly_rows(rows, list(candidates), year, path).drop(SOURCE_PATH)
    return rows, lineage, skipped


def year_range(spec: str | None, current_year: int) -> tuple[int, int]:
    """``from:to`` (``current`` allowed) as years; all years from the first one by default."""
    if not spec:
        return feeds.FIRST_YEAR, current_year
    start, _, end = spec.partition(":")
    number = lambda s, default: int(s) if s.strip().isdigit() and int(s) else default
    return number(start, feeds.FIRST_YEAR), number(end, current_year)


def incremental_years(discovered: DataFrame, stored: DataFrame, spec: str | None,
                      current_year: int) -> DataFrame:
    """Discovered years with the action: fetch, keep (closed and stored) or outside the window."""
    low, high = year_range(spec, current_year)
    have = stored.select("year").distinct().withColumn("_have", F.lit(True))
    closed = F.col("year") < current_year - 1
    return discovered.select("year").distinct().join(have, "year", "left").select(
        "year", F.when(~F.col("year").between(low, high), "outside")
        .when(F.col("_have").isNotNull() & closed, "keep").otherwise("fetch").alias("action"))


def write_years(df: DataFrame, path: str) -> None:
    """Replaces only the years present in the frame."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("SOURCE_YEAR").parquet(path)
