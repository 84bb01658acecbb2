"""Scans of lists, registries, sitemaps, link files and robots rules, as DataFrames of rows with their place."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import entities

SOURCE = "source_id string, schema_version int, generated_at string, count int, items array<struct<url:string,name:string,desc:string,title:string,categories:array<string>,labels:array<string>,mentions:int>>"
#: The sources that come before all others.
FIRST = ["curated", "awesome-lists", "x-community"]


def spread(df: DataFrame) -> DataFrame:
    """A scanned table of fewer splits than there are cores, dealt out to all of them; one with more stays where it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def landed(spark: SparkSession, name: str) -> str:
    """A fresh folder for landed files, in the folder that ``spark.checkpoint.dir`` names and all executors share."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def write_files(rows: DataFrame, at: str) -> None:
    """Each row (name, content) as a file of its own in the folder ``at``; read back by name, equal names in no set order.

    Tasks write their files themselves, under a name that readers skip, and move them into place. A partitioned write takes a
    folder, a commit and two moves by the driver for each of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        # Hadoop writes local folders as file:/x; Arrow wants file:///x.
        uri = f"file://{at[5:]}" if at.startswith("file:/") and not at.startswith("file://") else at
        store, folder = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
        store.create_dir(folder, recursive=True)
        context, n = TaskContext.get(), 0
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = f"{folder}/.{context.partitionId()}-{n}-{context.taskAttemptId()}"
                with store.open_output_stream(part) as out:
                    out.write((content or "").encode())
                store.move(part, f"{folder}/{name}-{context.partitionId():05d}-{n:09d}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    spread(rows.select("name", "content")).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def json_file(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """A JSON document a file or, with lines, one a line, which can be split between tasks."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def gunzipped(files: DataFrame, most: int = 64 << 20) -> DataFrame:
    """(path, text, problem) of binary files (path, content): gzip by its first bytes. A body that is corrupt, or larger than ``most`` bytes
    when it is unpacked, stays as it is, and problem says so; nothing is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for b in batches:
            out, problems = [], []
            for raw in b.column("content").to_pylist():
                problem = None
                if raw is not None and raw[:2] == b"\x1f\x8b":
                    try:
                        reader = zlib.decompressobj(31)
                        plain = reader.decompress(raw, most + 1)
                        if len(plain) > most:
                            problem = "too large"
                        elif not reader.eof:
                            problem = "corrupt"
                        else:
                            raw = plain
                    except zlib.error:
                        problem = "corrupt"
                out.append(None if raw is None else raw.decode("utf-8", "replace"))
                problems.append(problem)
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.string()), pa.array(problems, pa.string())], ["path", "text", "problem"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, problem string")


def sources(files: DataFrame, version: int = 1) -> DataFrame:
    """Items of source files (schema SOURCE) with source_rank and pos. A wrong version is an error."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in FIRST]), F.col("source_id")), F.lit(0))
    checked = files.withColumn("_ok", F.when(F.coalesce(F.col("schema_version"), F.lit(-1)) == version, True).otherwise(F.raise_error(F.concat(F.lit("unknown version of source "), F.coalesce("source_id", F.lit("?")))).cast("boolean"))).where("_ok")
    return checked.select("source_id", F.when(rank == 0, len(FIRST) + 1).otherwise(rank).cast("int").alias("source_rank"), F.posexplode("items").alias("pos", "item")).select("source_id", "source_rank", "pos", "item.*")


def write_source(rows: DataFrame, path: str, source_id: str, version: int = 1) -> None:
    """A source as a folder: its rows (url, name, ...) as JSON lines under items/, and one line about them in head/. No task gathers the rows."""
    rows.write.mode("overwrite").json(f"{path}/items")
    written = rows.sparkSession.read.schema(rows.schema).json(f"{path}/items")
    head = written.agg(F.count("*").alias("count")).select(F.lit(source_id).alias("source_id"), F.lit(version).alias("schema_version"), F.current_timestamp().cast("string").alias("generated_at"), "count")
    head.write.mode("overwrite").json(f"{path}/head")


def read_source(spark: SparkSession, path: str, schema: str, version: int = 1) -> DataFrame:
    """The rows of a source that write_source() wrote, with its source_id. A wrong version or a missing row is an error."""
    head = spark.read.schema("source_id string, schema_version int, count long").json(f"{path}/head").first()
    items = spark.read.schema(schema).json(f"{path}/items")
    if head.schema_version != version or head["count"] != items.count():
        raise ValueError(f"{path}: not a whole source of version {version}")
    return items.withColumn("source_id", F.lit(head.source_id))


def markdown_rows(lines: DataFrame) -> DataFrame:
    """(doc, pos, category, name, url, desc) from lines (doc, pos, line): rows of tables under "## category" headings."""
    head = F.when(F.col("line").rlike("^## "), F.trim(F.regexp_replace(F.regexp_replace("line", "^## +", ""), "·.*$", "")))
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("category", F.last(head, True).over(w)).where(F.col("line").rlike(r"^\|.*\]\("))
    cells = F.transform(F.split("line", r"(?<!\\)\|"), lambda x: F.trim(x))
    named = F.filter(cells, lambda x: x.rlike(r"^\[[^\]]*\]\([^)]+\)"))
    r = rows.select("doc", "pos", "category", cells.alias("cells"), F.get(named, F.lit(0)).alias("link")).where(F.col("link").isNotNull())
    desc = F.get(F.filter(F.slice("cells", F.array_position("cells", F.col("link")).cast("int") + 1, 9), lambda x: x != ""), F.lit(0))
    return r.select("doc", "pos", "category", F.regexp_extract("link", r"^\[([^\]]*)\]", 1).alias("name"), F.regexp_extract("link", r"\]\(([^)\s]+)", 1).alias("url"), F.substring(desc, 1, 300).alias("desc"))


def lines_of(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(F.col(text), "\r?\n")).alias("pos", "line"))


def link_lines(c: Column) -> Column:
    """[title](url): description lines of a link file, as structs."""
    found = F.filter(F.split(c, "\n"), lambda x: x.rlike(r"^\s*[-*] +\[[^\]]+\]\([^)\s]+\)"))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"\[([^\]]+)\]", 1).alias("title"), F.regexp_extract(x, r"\]\(([^)\s]+)\)", 1).alias("url"), F.trim(F.regexp_extract(x, r"\)\s*:?\s*(.*)$", 1)).alias("desc")))


def sitemap(c: Column) -> Column:
    """struct(kind, locs): urlset, index or invalid; CDATA and entities decoded, locations of images left out."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?is)<image:image\b.*?</image:image>", ""), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    kind = F.when(bare.rlike(r"(?i)<urlset\b"), "urlset").when(bare.rlike(r"(?i)<sitemapindex\b"), "index").otherwise("invalid")
    locs = F.transform(F.regexp_extract_all(bare, F.lit(r"(?is)<loc\b[^>]*>(.*?)</loc>"), F.lit(1)), lambda x: entities(F.trim(x)))
    return F.struct(kind.alias("kind"), F.when(kind == "invalid", F.array().cast("array<string>")).otherwise(locs).alias("locs"))


def expand(start: DataFrame, landed: DataFrame, depth: int = 3) -> DataFrame:
    """All page locations reached from start (domain, url) through index files, at most depth levels. landed: (url, text).

    A URL is expanded once: each level anti-joins what was seen.
    """
    parsed = landed.select("url", sitemap(F.col("text")).alias("s")).select("url", "s.kind", F.explode_outer("s.locs").alias("loc"))
    todo, seen, out = start.select("domain", "url").distinct(), start.select("domain", "url").distinct(), None
    for _ in range(depth):
        got = todo.join(parsed, "url")
        pages = got.where("kind = 'urlset' and loc is not null").select("domain", "loc")
        out = pages if out is None else out.union(pages)
        todo = got.where("kind = 'index' and loc is not null").select("domain", F.col("loc").alias("url")).distinct().join(seen, ["domain", "url"], "left_anti")
        seen = seen.union(todo)
    return out.distinct()


def robots_rules(lines: DataFrame) -> DataFrame:
    """(host, agent, allow, rule) from robots files' lines (host, pos, line); agents named in a row share the rules after them."""
    k = F.lower(F.trim(F.regexp_extract("line", r"^\s*([A-Za-z-]+)\s*:", 1)))
    v = F.trim(F.regexp_replace(F.regexp_extract("line", r"^[^:]*:(.*)$", 1), r"\s*#.*$", ""))
    w = Window.partitionBy("host").orderBy("pos")
    r = lines.withColumn("k", k).withColumn("v", v).where(F.col("k").isin("user-agent", "allow", "disallow"))
    begins = (F.col("k") == "user-agent") & F.coalesce(F.lag("k").over(w) != "user-agent", F.lit(True))
    r = r.withColumn("grp", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    agents = r.where("k = 'user-agent'").select("host", "grp", F.lower("v").alias("agent"))
    rules = r.where("k <> 'user-agent'").select("host", "grp", (F.col("k") == "allow").alias("allow"), F.col("v").alias("rule"))
    return agents.join(rules, ["host", "grp"]).select("host", "agent", "allow", "rule")


def registry_items(c: Column) -> Column:
    """Named items of a registry index: an array, or an object with items."""
    kind = "array<struct<name:string,type:string,title:string,description:string>>"
    arr = F.when(F.trim(c).startswith("["), F.from_json(c, kind)).otherwise(F.from_json(c, f"struct<items:{kind}>")["items"])
    return F.filter(arr, lambda x: x["name"].isNotNull())


def manifest(files: DataFrame) -> DataFrame:
    """(kind, n, bytes) of a corpus walk (path, length), the kind from the path."""
    p = F.lower("path")
    kind = F.when(p.endswith("llms.txt") | p.endswith("llms-full.txt"), "llms").when(p.endswith("registry.json"), "registry").when(p.contains("sitemap"), "sitemap").when(p.endswith(".md"), "markdown").otherwise("other")
    return files.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


def item_files(c: Column) -> Column:
    """Files (path, content) of a registry item's JSON: those with content; else its css and variables as one file; a path that leaves its folder is left out."""
    kind = "struct<files:array<struct<path:string,target:string,content:string>>,css:map<string,string>,cssVars:string>"
    item = F.from_json(c, kind)
    files = F.transform(F.filter(item["files"], lambda f: f["content"].isNotNull()), lambda f: F.struct(F.coalesce(f["path"], f["target"], F.lit("file")).alias("path"), f["content"].alias("content")))
    files = F.filter(F.coalesce(files, F.array().cast("array<struct<path:string,content:string>>")), lambda f: ~f["path"].rlike(r"(^|[\\/])\.\.([\\/]|$)|^[\\/]"))
    rules = F.array_join(F.transform(F.map_entries(item["css"]), lambda e: F.concat(e["key"], F.lit(" {\n"), e["value"], F.lit("\n}"))), "\n\n")
    root = F.when(item["cssVars"].isNotNull() & (item["cssVars"] != "{}"), F.concat(F.lit(":root {\n"), item["cssVars"], F.lit("\n}")))
    style = F.concat_ws("\n\n", F.nullif(rules, F.lit("")), root)
    return F.when((F.size(files) == 0) & (style != ""), F.array(F.struct(F.lit("css").alias("path"), style.alias("content")))).otherwise(files)


def domain_list(lines: DataFrame, column: int | None = None) -> DataFrame:
    """Distinct domains of lines (value): text before # in lower case, or a tab-separated column of it (from 0)."""
    v = F.split_part("value", F.lit("#"), F.lit(1))
    v = F.get(F.split(v, "\t"), F.lit(column)) if column is not None else v
    return lines.select(F.lower(F.trim(v)).alias("domain")).where("domain <> ''").distinct()


def rendered(spark: SparkSession, path: str) -> DataFrame:
    """(url, links, anchors) of landed renders, one JSON file a page; several of one URL: the last file by name."""
    df = spark.read.schema("url string, links array<string>, anchors array<struct<id:string,text:string>>").json(path, multiLine=True).withColumn("_f", F.input_file_name())
    return df.where("url is not null").groupBy("url").agg(F.max_by(F.struct("links", "anchors"), "_f").alias("r")).select("url", "r.*")


def probe_summary(pages: DataFrame, k: int = 8) -> DataFrame:
    """(site, links, prefixes, ids): what pages (site, url, html) link to on their own site by first path segment, and their ids."""
    own = F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["'](/[^"'/#?]*)"""), F.lit(1))
    each = pages.select("site", F.explode(own).alias("prefix")).groupBy("site", "prefix").agg(F.count("*").alias("n"))
    r = each.withColumn("r", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("n"), "prefix")))
    top = r.groupBy("site").agg(F.sum("n").alias("links"), F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= k, F.struct("r", F.concat_ws(" ", "prefix", F.col("n").cast("string")).alias("t"))))), lambda x: x["t"]).alias("prefixes"))
    ids = pages.groupBy("site").agg(F.sum(F.regexp_count("html", F.lit(r"""(?i)<(?:section|article|h[1-4])\b[^>]*\bid\s*="""))).alias("ids"))
    return ids.join(top, "site", "left")
