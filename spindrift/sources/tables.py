"""Reading and writing tables: CSV, workbooks, caches with an age limit, and sinks."""

from __future__ import annotations

import datetime as dt
import os
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A CSV with a header, quoted fields over several lines allowed; all strings unless a schema is given."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (r.schema(schema) if schema is not None else r).csv(path)


def _cells(path: str, want: str | None, fallback: bool) -> list[list[str | None]] | None:
    with zipfile.ZipFile(path) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{MAIN}si")]
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), rels[s.get(f"{REL}id")]) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet")]
        target = next((t for n, t in sheets if n == want), sheets[0][1] if sheets and (fallback or want is None) else None)
        if target is None:
            return None
        out = []
        for row in ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{MAIN}row"):
            cells: list[str | None] = []
            for c in row.findall(f"{MAIN}c"):
                letters = re.match("[A-Z]+", c.get("r", "") or "A" * 0)
                at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                cells += [None] * (at - len(cells))
                v = c.find(f"{MAIN}v")
                if c.get("t") == "inlineStr":
                    cells.append("".join(t.text or "" for t in c.iter(f"{MAIN}t")))
                elif v is None:
                    cells.append(None)
                else:
                    cells.append(shared[int(v.text)] if c.get("t") == "s" else v.text)
            out.append(cells)
        return out


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None, fallback: bool = True) -> DataFrame | None:
    """A sheet of a workbook as strings; the first sheet, where ``sheet`` is missing and ``fallback`` says so."""
    rows = _cells(path, sheet, fallback)
    if not rows:
        return None
    head = [h or f"_c{i}" for i, h in enumerate(rows[0])]
    data = [tuple((r + [None] * len(head))[: len(head)]) for r in rows[1:]]
    return spark.createDataFrame(data, ", ".join(f"`{h}` string" for h in head))


def read_all_sheets(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    with zipfile.ZipFile(path) as z:
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet")]
    return {n: df for n in names if (df := read_sheet(spark, path, n, False)) is not None}


def load_existing(spark: SparkSession, path: str) -> DataFrame | None:
    """A table by its file's ending: CSV, Parquet, or a workbook's sheet 'All Contacts' (else its first). Otherwise null."""
    if not os.path.exists(path):
        return None
    if path.endswith(".csv"):
        return read_csv(spark, path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return read_sheet(spark, path, "All Contacts") if path.endswith((".xlsx", ".xls")) else None


def _column(i: int) -> str:
    s = ""
    while i >= 0:
        s, i = chr(65 + i % 26) + s, i // 26 - 1
    return s


# fixed values: the colours of a report
HEADER_FILL, GOOD_FILL, FAIR_FILL, POOR_FILL = "FF4472C4", "FFC6EFCE", "FFFFEB9C", "FFFFC7CE"


def write_workbook(sheets: dict[str, DataFrame], path: str, score_col: str = "confidence_score", most_rows: int = 1_000_000) -> None:
    """A report: one sheet a relation, bold headers on blue, frozen and filtered, rows coloured by confidence.

    A workbook is one file on the driver, and a sheet cannot hold more than about a million rows; more is an error.
    """
    styles = [HEADER_FILL, GOOD_FILL, FAIR_FILL, POOR_FILL]
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="{c}"/></patternFill></fill>' for c in styles)
    style = (
        '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="2"><font/><font><b/><color rgb="FFFFFFFF"/></font></fonts>'
        f'<fills count="6"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills><borders count="1"><border/></borders>'
        '<cellXfs count="5"><xf/><xf fontId="1" fillId="2" applyFill="1" applyFont="1"/><xf fillId="3" applyFill="1"/><xf fillId="4" applyFill="1"/><xf fillId="5" applyFill="1"/></cellXfs></styleSheet>'
    )
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for i, (name, df) in enumerate(sheets.items(), 1):
            head = [c for c in df.columns if not c.startswith("_")]
            lines = []
            for n, r in enumerate(df.select(*[F.col(f"`{c}`").cast("string") for c in head]).toLocalIterator(), 2):
                if n > most_rows:
                    raise ValueError(f"sheet {name} has more than {most_rows} rows")
                score = r[head.index(score_col)] if score_col in head else None
                s = 0 if score is None else 2 if float(score) >= 75 else 3 if float(score) >= 50 else 4
                cells = "".join(f'<c r="{_column(j)}{n}" s="{s}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for j, v in enumerate(r) if v is not None)
                lines.append(f'<row r="{n}">{cells}</row>')
            top = "".join(f'<c r="{_column(j)}1" s="1" t="inlineStr"><is><t>{escape(c)}</t></is></c>' for j, c in enumerate(head))
            last = f"{_column(max(0, len(head) - 1))}{len(lines) + 1}"
            z.writestr(
                f"xl/worksheets/sheet{i}.xml",
                f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>'
                f'<sheetData><row r="1">{top}</row>{"".join(lines)}</sheetData><autoFilter ref="A1:{last}"/></worksheet>',
            )
        book = "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{book}</sheets></workbook>')
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        links = "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}<Relationship Id="rIdS" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", style)
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr(
            "[Content_Types].xml",
            f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{parts}</Types>',
        )


def timestamp(now: dt.datetime) -> str:
    return now.strftime("%Y%m%d_%H%M%S")


def save_csv(df: DataFrame, folder: str, name: str, now: dt.datetime | None = None, single: bool = False) -> str:
    """Writes ``df`` as CSV with a header under a name that may carry the time; returns the path."""
    path = f"{folder}/{name}_{timestamp(now)}" if now else f"{folder}/{name}"
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)
    return path


def cache_table(df: DataFrame, folder: str, name: str, now: dt.datetime) -> None:
    """Keeps a table with the time it was made."""
    df.withColumn("__cached_at", F.lit(now)).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def cached_table(spark: SparkSession, folder: str, name: str, now: dt.datetime, hours: float = 24, enabled: bool = True) -> DataFrame | None:
    """A kept table that is not older than ``hours``; null if there is none, it is too old, or caching is off."""
    from pyspark.errors import AnalysisException

    if not enabled:
        return None
    try:
        df = spark.read.parquet(f"{folder}/{name}.parquet")
    except AnalysisException:
        return None
    made = df.agg(F.max("__cached_at")).first()[0]
    return df.drop("__cached_at") if made is not None and now - made <= dt.timedelta(hours=hours) else None


def clear_cache(spark: SparkSession, folder: str, now: dt.datetime, hours: float = 0) -> list[str]:
    """Deletes kept tables older than ``hours``; returns their names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for f in fs.listStatus(path) if fs.exists(path) else []:
        age = now.timestamp() - f.getModificationTime() / 1000
        if f.getPath().getName().endswith(".parquet") and age > hours * 3600:
            fs.delete(f.getPath(), True)
            gone.append(f.getPath().getName())
    return gone


def read_json_cache(spark: SparkSession, path: str, now: dt.datetime, hours: float = 24) -> DataFrame | None:
    """The programs of a JSON document {timestamp, programs, count}, unless it is older than ``hours`` or missing."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.option("multiLine", True).schema("timestamp timestamp, programs array<struct<name:string,url:string,state:string,program_type:string>>, count int").json(path)
    except AnalysisException:
        return None
    made = df.agg(F.max("timestamp")).first()[0]
    if made is None or now - made > dt.timedelta(hours=hours):
        return None
    return df.select(F.explode("programs").alias("p")).select("p.*")


def write_json_cache(programs: DataFrame, path: str, now: dt.datetime) -> None:
    """One document with the time, the programs and their number; for lists of a few thousand, as a directory gives."""
    row = programs.agg(F.collect_list(F.struct(*programs.columns)).alias("programs"), F.count("*").alias("count"))
    row.select(F.lit(now).alias("timestamp"), "programs", "count").coalesce(1).write.mode("overwrite").json(path)


def append_contacts(df: DataFrame, path: str) -> None:
    """Appends rows to a table; no rows, no files."""
    if not df.isEmpty():
        df.write.mode("append").parquet(path)


def write_by_source(df: DataFrame, path: str, col: str = "source") -> None:
    df.write.mode("overwrite").partitionBy(col).parquet(path)


def replace_with_backup(df: DataFrame, path: str, now: dt.datetime) -> str | None:
    """Writes a new version beside a table, then moves the old one to a backup and the new one in its place."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(conf)
    df.write.mode("overwrite").parquet(f"{path}.new")
    backup = None
    if fs.exists(p(path)):
        backup = f"{path}.backup_{timestamp(now)}"
        fs.rename(p(path), p(backup))
    fs.rename(p(f"{path}.new"), p(path))
    return backup


def replace_table(df: DataFrame, path: str) -> None:
    """Writes a new version beside a table, then puts it in its place; ``df`` may read the old one."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(conf)
    df.write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(p(path), True)
    fs.rename(p(f"{path}.new"), p(path))
