"""Readers and sinks: tables by name, files by suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def by_suffix(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder by its suffix: parquet, orc, json(l), csv, xml, else text with a row for each file."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind in ("parquet", "orc"):
        return spark.read.format(kind).load(path)
    if kind in ("json", "jsonl"):
        return spark.read.json(path)
    if kind == "csv":
        return spark.read.csv(path, header=True)
    if kind in ("xlsx", "xls", "docx", "pdf"):
        return binary(spark, path)
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _local(node) -> str:
    return node.tag.rpartition("}")[2]


def _text(node) -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x) == "t")


def docx_text(z) -> str:
    """Paragraphs of a document, one a line; entities are resolved by the XML parser."""
    from xml.etree import ElementTree

    return "\n".join(_text(p) for p in ElementTree.fromstring(z.read("word/document.xml")).iter() if _local(p) == "p").strip()


def xlsx_text(z) -> str:
    """Rows of all sheets in the workbook's order, cells parted by tabs: shared and inline strings, numbers, formula results."""
    from xml.etree import ElementTree

    read = lambda name: ElementTree.fromstring(z.read(name))
    names = set(z.namelist())
    shared = [_text(x) for x in read("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
    targets = {x.get("Id"): x.get("Target") for x in read("xl/_rels/workbook.xml.rels")}
    lines = []
    for sheet in (x for x in read("xl/workbook.xml").iter() if _local(x) == "sheet"):
        target = targets[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))].lstrip("/")
        lines.append(sheet.get("name", ""))
        for row in (x for x in read(target if target.startswith("xl/") else f"xl/{target}").iter() if _local(x) == "row"):
            cells = []
            for cell in row:
                value = next((x.text or "" for x in cell if _local(x) == "v"), "")
                cells.append(shared[int(value)] if cell.get("t") == "s" and value else _text(cell) if cell.get("t") == "inlineStr" else value)
            lines.append("\t".join(cells))
    return "\n".join(lines).strip()


def binary(spark: SparkSession, path: str) -> DataFrame:
    """path, text of office files. Legacy formats, and files that aren't what they claim to be, give an empty text."""
    from ..session import ship

    ship(spark)

    def read(batches):
        import io
        import zipfile
        from xml.etree.ElementTree import ParseError

        for pdf in batches:
            out = []
            for raw in pdf["content"]:
                try:
                    z = zipfile.ZipFile(io.BytesIO(raw))
                    names = set(z.namelist())
                    out.append(docx_text(z) if "word/document.xml" in names else xlsx_text(z) if "xl/workbook.xml" in names else "")
                except (zipfile.BadZipFile, ParseError, KeyError, ValueError, IndexError, StopIteration):
                    out.append("")
            yield pdf[["path"]].assign(text=out)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, text string")


def append(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    df.write.mode("append").partitionBy(*(partitions or [])).parquet(path)
