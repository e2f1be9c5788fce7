"""Readers of sheets and dumps: rows as lines, parts of tables, schemas, archives, pages of a table. Quoted dumps are read in `splits`."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders whose files are results, not sources.
OWN_FOLDERS = ("Published",)


def files(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """(path, name, extension, length, modified) of files below a folder by extension, those of OWN_FOLDERS left out; their content is not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    own = F.lit(False)
    for name in OWN_FOLDERS:
        own |= F.contains("path", F.lit(f"/{name}/"))
    return found.where(ext.isin(extensions) & ~own).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), ext.alias("extension"), "length", "modified")


def folders(paths: DataFrame, first: list[str] = ()) -> DataFrame:
    """(path) to the folders that hold them, those listed first, then in natural order of their numbers."""
    from docatlas.functions import text as T

    name = F.element_at(F.split("path", "/"), -2)
    place = F.coalesce(*(F.when(F.lower("folder") == n.lower(), i) for i, n in enumerate(first)), F.lit(len(first)))
    return paths.select(name.alias("folder")).distinct().orderBy(place, T.natural_key(F.lower("folder")), "folder")


def sheet_lines(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(path, row, line): the rows of CSV sheets that hold anything, with their numbers; cells are trimmed, blank ones skipped, the rest joined by " | "."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    rows = raw.select("path", F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("i", "line"))
    return rows.where("trim(line) <> ''").select("path", (F.col("i") + 1).alias("row"), cells_joined(F.split("line", re.escape(separator))).alias("line"))


def cells_joined(cells: Column) -> Column:
    return F.array_join(F.filter(F.transform(cells, lambda c: F.trim(c)), lambda c: c != ""), " | ")


def row_lines(rows: DataFrame) -> DataFrame:
    """Rows (path, sheet, row, line) with a mark before each line: [R1], or [sheet:R1] where a file has several sheets."""
    sheets = rows.groupBy("path").agg(F.countDistinct("sheet").alias("sheets"))
    at = F.when(F.col("sheets") > 1, F.concat("sheet", F.lit(":R"), F.col("row").cast("string"))).otherwise(F.concat(F.lit("R"), F.col("row").cast("string")))
    return rows.join(sheets, "path").select(*rows.columns[:-1], F.concat(F.lit("["), at, F.lit("] "), "line").alias("line"))


def separators(line: Column) -> Column:
    """Fields by their separators, a quote or digit before a comma; -1 where a letter follows a quoted one, as then the row is broken."""
    return F.when(line.rlike('",[A-Za-z]'), -1).otherwise(1 + F.regexp_count(line, F.lit('(?:"|[0-9]),')))


def parts(paths: DataFrame) -> DataFrame:
    """(path) of files db.table[.NNNNN].dat.gz to (db, table, part, path), part 0 where there is one only."""
    name = F.element_at(F.split("path", "/"), -1)
    pattern = r"^([A-Za-z0-9_]+)\.([A-Za-z0-9_]+?)(?:\.([0-9]+))?\.dat(?:\.gz)?$"
    get = lambda i: F.regexp_extract(name, pattern, i)
    return paths.where(name.rlike(pattern)).select(get(1).alias("db"), get(2).alias("table"), F.coalesce(get(3).try_cast("int"), F.lit(0)).alias("part"), "path")


def columns_of(ddl: str) -> list[str]:
    """Column names of a CREATE TABLE; brackets and quotes may be nested, keys and constraints are no columns."""
    if "(" not in ddl:
        return [c.strip().strip('`"') for c in ddl.split(",") if c.strip()]
    depth, quote, item, items = 0, "", "", []
    for c in ddl[ddl.index("(") + 1 :]:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            if depth == 0:
                break
            depth -= 1
        if c == "," and not depth and not quote:
            items.append(item)
            item = ""
        else:
            item += c
    names = [re.match(r"\s*[`\"]?([^\s`\"]+)", x) for x in [*items, item]]
    return [m[1] for m in names if m and m[1].upper() not in ("PRIMARY", "UNIQUE", "KEY", "INDEX", "CONSTRAINT", "FOREIGN", "FULLTEXT", "CHECK")]


def tsv_with_json(spark: SparkSession, path: str, columns: list[str], json_schema: str) -> tuple[DataFrame, DataFrame]:
    """Lines of tab-separated fields of which the last is JSON, read into `data`, broken JSON being null; and the lines of fewer fields."""
    f = F.split("value", "\t", len(columns) + 1)
    lines = spark.read.text(path)
    rows = lines.where(F.size(f) == len(columns) + 1)
    return rows.select(*(F.nullif(F.trim(f[i]), F.lit("")).alias(c) for i, c in enumerate(columns)), F.from_json(f[len(columns)], json_schema).alias("data")), lines.where(F.size(f) <= len(columns))


def offset_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(aacid, primary_id, md5, offset, length) of an index, a digest that is none being null; and the rows without a place, as they are."""
    raw = spark.read.csv(path, schema="aacid string, primary_id string, md5 string, offset string, length string")
    md5 = F.when(F.col("md5").rlike("^[0-9a-fA-F]{32}$"), F.lower("md5"))
    placed = F.col("offset").try_cast("long").isNotNull() & F.col("length").try_cast("long").isNotNull()
    rows = raw.where(placed).select("aacid", "primary_id", md5.alias("md5"), F.col("offset").try_cast("long").alias("offset"), F.col("length").try_cast("long").alias("length"))
    return rows, raw.where(~placed)


def after_key(df: DataFrame, key: str, last: int | None, n: int) -> DataFrame:
    """The n rows after a key, in order: one page of a copy that goes on where it stopped."""
    return (df if last is None else df.where(F.col(key) > last)).orderBy(key).limit(n)


def zip_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, name, text) of the text files in archives, by name; page is the number of a name like 00000012.txt, else its place."""
    import io
    import zipfile
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = sorted(n for n in z.namelist() if n.lower().endswith(".txt"))
                    for i, name in enumerate(names, 1):
                        m = re.fullmatch(r"(?:.*/)?([0-9]{8})\.txt", name)
                        text = z.read(name).decode("utf-8", "replace")
                        yield pa.RecordBatch.from_pydict({"path": [p], "page": [int(m[1]) if m else i], "name": [name], "text": [text]}, pa.schema([("path", pa.string()), ("page", pa.int32()), ("name", pa.string()), ("text", pa.string())]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, page int, name string, text string")


def dictionary_words(entries: DataFrame) -> DataFrame:
    """Headwords of (headword, raw), and words of three letters or more that definitions hold, unless all in capitals."""
    words = entries.select(F.explode(F.regexp_extract_all("raw", F.lit(r"(\p{L}{3,})"), F.lit(1))).alias("word")).where("word <> upper(word)")
    return entries.select(F.lower("headword").alias("word")).union(words.select(F.lower("word"))).distinct()


def file_list(names: DataFrame) -> DataFrame:
    """(name) of published lists to (name, kind, day): full, update or header, and the day in the name."""
    kind = F.when(F.col("name").rlike("(?i)full"), "full").when(F.col("name").rlike("(?i)header"), "header").when(F.col("name").rlike("(?i)upd"), "update")
    day = F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract("name", "((?:19|20)[0-9]{6})", 1), F.lit("")), F.lit("yyyyMMdd")))
    return names.select("name", kind.alias("kind"), day.alias("day")).where("kind is not null")


def inventory(listing: DataFrame, exact: int = 1000, first: int = 100, most: int = 50_000) -> DataFrame:
    """(folder, path, length) to (folder, files, bytes, estimated): counts up to `most`; sizes are exact for folders of at most `exact` files, else the mean of the first `first` by name times the count."""
    ranked = listing.withColumn("r", F.row_number().over(Window.partitionBy("folder").orderBy("path")))
    sums = ranked.groupBy("folder").agg(F.count("*").alias("n"), F.sum("length").alias("all"), F.avg(F.when(F.col("r") <= first, F.col("length"))).alias("mean"))
    files = F.least(F.lit(most), F.col("n"))
    return sums.select("folder", files.alias("files"), F.when(F.col("n") <= exact, F.col("all")).otherwise(F.round(F.col("mean") * files)).cast("long").alias("bytes"), (F.col("n") > exact).alias("estimated"))


def workbook_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, line): the rows of XLSX workbooks that hold anything, cells joined as in sheet_lines; rows count from the first one used.

    Values are those stored: a date is the number that the workbook keeps. A workbook is read whole by one task, its sheets row by row.
    """
    import io
    import zipfile
    from collections.abc import Iterator
    from xml.etree import ElementTree

    import pyarrow as pa

    def local(tag: str) -> str:
        return tag.rsplit("}", 1)[-1]

    def said(item: ElementTree.Element) -> str:
        """Text of a string item; what tells its pronunciation is left out."""
        return "".join((e.text or "") if local(e.tag) == "t" else said(e) for e in item if local(e.tag) in ("t", "r"))

    def strings(z: zipfile.ZipFile) -> list[str]:
        if "xl/sharedStrings.xml" not in z.namelist():
            return []
        return [said(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if local(e.tag) == "si"]

    def sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
        """Sheets in order as (name, member)."""
        targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter():
            if local(e.tag) == "sheet":
                target = targets[next(v for k, v in e.attrib.items() if local(k) == "id")]
                out.append((e.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
        return out

    def value(cell: ElementTree.Element, shared: list[str]) -> str:
        parts = {local(e.tag): e for e in cell}
        if "is" in parts:
            return said(parts["is"])
        raw = (parts["v"].text or "") if "v" in parts else ""
        if cell.get("t") == "s":
            return shared[int(raw)] if raw else ""
        return {"1": "TRUE", "0": "FALSE"}.get(raw, raw) if cell.get("t") == "b" else raw

    def rows_of(member, shared: list[str]) -> Iterator[tuple[int, str]]:
        first, no = None, 0
        for _, e in ElementTree.iterparse(member):
            if local(e.tag) == "row":
                no = int(e.get("r") or no + 1)
                cells = [value(c, shared).strip() for c in e if local(c.tag) == "c"]
                if any(cells):
                    first = no if first is None else first
                    yield no - first + 1, " | ".join(c for c in cells if c)
                e.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    shared = strings(z)
                    for name, member in sheets(z):
                        if member in z.namelist():
                            with z.open(member) as f:
                                found = list(rows_of(f, shared))
                            yield pa.RecordBatch.from_pydict({"path": [p] * len(found), "sheet": [name] * len(found), "row": [r for r, _ in found], "line": [x for _, x in found]}, pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("line", pa.string())]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, sheet string, row int, line string")
