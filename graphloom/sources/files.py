"""Files, sessions and logs as DataFrames, and what can be said of their names."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTRIBUTE = "struct<value:string,confidence:double>"
NODE = f"id string, type string, confidence double, attributes map<string,{ATTRIBUTE}>, aliases array<string>, source_files array<string>"
EDGE = f"id string, type string, `from` string, `to` string, confidence double, method string, attributes map<string,{ATTRIBUTE}>, source_files array<string>"


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """source_file, content, sha256, token_count of all *.md below a folder. Empty files have no row: Spark's reader leaves them out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    return manifest(raw.select(F.regexp_replace(F.col("path"), "^.*?" + "\\Q" + folder.rstrip("/").split(":")[-1] + "\\E/?", "").alias("source_file"), F.decode("content", "UTF-8").alias("content")))


def manifest(files: DataFrame) -> DataFrame:
    """Adds sha256 and token_count to source_file and content."""
    from graphloom.operators.chunks import tokens

    return files.select("source_file", "content", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), F.size(tokens(F.coalesce("content", F.lit("")))).alias("token_count"))


def changes(current: DataFrame, before: DataFrame, extracted: DataFrame) -> DataFrame:
    """source_file, change: new, modified, unextracted, same or deleted, of two manifests (source_file, sha256) and the files extracted."""
    j = current.select("source_file", F.col("sha256").alias("now")).join(before.select("source_file", F.col("sha256").alias("then")), "source_file", "full").join(extracted.select("source_file", F.lit(True).alias("done")).distinct(), "source_file", "left")
    change = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("then"), "modified").when(F.col("done").isNull(), "unextracted").otherwise("same")
    return j.select("source_file", change.alias("change"))


def read_session(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """nodes, edges, concepts and properties of a finished session; broken lines are left out."""
    read = lambda schema, path: spark.read.schema(schema + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path).where("_corrupt_record is null").drop("_corrupt_record")
    schema = spark.read.schema("concepts array<struct<type:string,parent:string,attributes:array<string>>>, properties array<struct<name:string,domain:string,range:string,attributes:array<string>>>").option("multiLine", True).json(f"{root}/intermediate/schema.json")
    return {
        "nodes": read(NODE, f"{root}/output/nodes.jsonl").where("id is not null"),
        "edges": read(EDGE, f"{root}/output/edges.jsonl").where("id is not null"),
        "concepts": schema.select(F.posexplode("concepts").alias("pos", "c")).select("pos", "c.*"),
        "properties": schema.select(F.posexplode("properties").alias("pos", "p")).select("pos", "p.*"),
    }


def read_merge_session(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """What a merge needs of a session: its tables, raw extractions by file (required), and the manifest and shards where they exist.

    extractions: source_file, nodes, edges of intermediate/raw_extractions.json; shards the same of intermediate/raw/*.json, broken ones left out;
    manifest: source_file, entry (JSON, see migrated()).
    """
    fields = "struct<nodes:array<struct<id:string,type:string,confidence:double>>,edges:array<struct<type:string,`from`:string,`to`:string,confidence:double>>>"
    whole = lambda path: spark.read.option("wholetext", True).text(path)
    out = read_session(spark, root)
    raw = whole(f"{root}/intermediate/raw_extractions.json").select(F.explode(F.from_json("value", f"map<string,{fields}>")).alias("source_file", "e"))
    out["extractions"] = raw.select("source_file", "e.nodes", "e.edges")
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda path: bool(fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path)))
    if there(f"{root}/intermediate/raw/*.json"):
        s = whole(f"{root}/intermediate/raw/*.json").select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1).alias("shard"), F.from_json("value", fields).alias("e"), F.try_parse_json("value").isNotNull().alias("ok"))
        out["shards"] = s.where("ok").select("shard", "e.nodes", "e.edges")
    if there(f"{root}/intermediate/file_manifest.json"):
        m = whole(f"{root}/intermediate/file_manifest.json").select(F.try_parse_json("value").alias("_json"))
        out["manifest"] = m.lateralJoin(spark.tvf.variant_explode(F.col("_json").outer())).select(F.col("key").alias("source_file"), F.to_json("value").alias("entry"))
    return out


def route(path: Column) -> Column:
    """What becomes of a file by its extension: markdown, html, text, other; hidden ones are skipped."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(path.rlike(r"(^|/)\."), "skipped").when(ext.isin("md", "markdown"), "markdown").when(ext.isin("html", "htm", "xhtml"), "html").when(ext.isin("txt", "text"), "text").otherwise("other")


class _Markdown(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.lists = [], 0, []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.skip += 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "tr", "table", "blockquote"):
            self.out.append("\n\n" if tag != "tr" else "\n")
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li":
            self.lists and self.lists[-1].__setitem__(1, self.lists[-1][1] + 1)
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + (f"{self.lists[-1][1]}. " if self.lists and self.lists[-1][0] == "ol" else "- "))
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code":
            self.out.append("`")
        elif tag in ("td", "th"):
            self.out.append(" | ")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code":
            self.out.append("`")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag in ("p", "div") or tag[:1] == "h" and tag[1:].isdigit():
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(" ".join(data.split()) if data.strip() else " ")
            if data[-1:].isspace() and data.strip():
                self.out.append(" ")


def markdown_of(html: str | None) -> str | None:
    """Markdown of an HTML page: headings, lists, emphasis, code, cells; links keep their text, pictures, scripts and styles go."""
    if html is None:
        return None
    import re

    p = _Markdown()
    p.feed(html)
    p.close()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(p.out))).strip()


def html_to_markdown(html: Column) -> Column:
    @F.pandas_udf("string")
    def convert(pages):
        return pages.map(markdown_of)

    return convert(html)


def markdown_to_html(text: Column) -> Column:
    """Paragraphs and headings of a Markdown text as HTML, for round trips in tests and queries."""
    from graphloom.functions.text import html_text

    lines = F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike("^# "), F.concat(F.lit("<h1>"), html_text(F.substr(x, F.lit(3))), F.lit("</h1>"))).when(F.trim(x) == "", F.lit("")).otherwise(F.concat(F.lit("<p>"), html_text(x), F.lit("</p>"))))
    return F.array_join(lines, "\n")


#: Endings by content type, for addresses without one.
ENDINGS = {"application/pdf": ".pdf", "application/json": ".json", "application/xml": ".xml", "application/zip": ".zip", "image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/svg+xml": ".svg", "text/plain": ".txt", "text/css": ".css", "text/csv": ".csv", "text/markdown": ".md"}
#: Endings that are taken for one; what else follows a dot, such as a number, belongs to the name.
KNOWN_ENDINGS = ("css", "csv", "doc", "docx", "gif", "gz", "htm", "html", "jpeg", "jpg", "js", "json", "md", "mp3", "mp4", "odt", "pdf", "png", "ppt", "pptx", "svg", "tar", "txt", "webp", "xls", "xlsx", "xml", "zip")


def local_path(url: Column, content_type: Column | None = None) -> Column:
    """Where a page or file is kept below the output's folder: its path, without parts that could lead out of it.

    Pages end in .html; a path that ends in a slash is an index. Where an ending had to go, a hyphen and eight digits of the
    path's hash tell such pages apart; a query adds those of its own hash. Other files keep their ending if it is a known
    one, else that of their content type is added.
    """
    path = F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    query = F.nullif(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    whole = F.when(path.endswith("/"), F.concat(F.regexp_replace(path, "/+$", ""), F.lit("/index"))).otherwise(path)
    safe = F.array_join(F.filter(F.split(whole, "/"), lambda p: ~p.isin("", ".", "..")), "/")
    base = F.when(safe == "", "index").otherwise(safe)
    mark = lambda x: F.concat(F.lit("-"), F.substring(F.sha1(x), 1, 8))
    ended = base.rlike(r"\.[^/]*$")
    stem = F.regexp_replace(base, r"\.[^./]*$", "")
    page = F.concat(stem, F.when(query.isNotNull(), mark(query)).when(ended, mark(path)).otherwise(""), F.lit(".html"))
    if content_type is None:
        return page
    kind = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    known = F.lower(F.regexp_extract(base, r"[^/]\.([^./]+)$", 1)).isin(*KNOWN_ENDINGS)
    name = F.when(known, base).otherwise(F.concat(base, ending_of(content_type)))
    marked = F.when(name.rlike(r"\.[^/]*$"), F.concat(F.regexp_replace(name, r"\.[^./]*$", ""), mark(query), F.lit("."), F.regexp_extract(name, r"\.([^./]*)$", 1))).otherwise(F.concat(name, mark(query)))
    return F.when(kind == "text/html", page).when(query.isNotNull(), marked).otherwise(name)


def ending_of(content_type: Column) -> Column:
    """The ending of a file by its content type, empty if that is not among ENDINGS."""
    kind = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv]), kind), F.lit(""))


def asset_wanted(content_type: Column, url: Column) -> Column:
    return content_type.startswith("text/") | content_type.isin("application/pdf", "application/xhtml+xml") | F.lower(url).rlike(r"\.(html?|md|txt|pdf)$")


def already_fetched(now: DataFrame, before: DataFrame) -> DataFrame:
    """The rows of now whose address was fetched before with the same hash (url, sha256): their text need not be read again, their links are followed all the same."""
    return now.join(before.select("url", "sha256").distinct(), ["url", "sha256"], "left_semi")


def code_host(url: Column) -> Column:
    """owner/repository of an address of a code host's repository, else null."""
    return F.nullif(F.regexp_extract(url, r"^https?://(?:www\.)?github\.com/([^/?#]+/[^/?#]+?)(?:\.git)?(?:[/?#]|$)", 1), F.lit(""))


def crawl_depth(url: Column) -> Column:
    """How deep a crawl goes from an address where nothing is said: 2 for a repository, 1 for a site or folder, 0 for a single page."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.when(code_host(url).isNotNull(), 2).when((path == "") | path.endswith("/"), 1).otherwise(0)


def repository_file(path: Column) -> Column:
    """Whether a file of a repository is worth reading: documents outside hidden and vendored folders."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return ~path.rlike(r"(^|/)\.") & ~path.rlike(r"(^|/)(node_modules|vendor|dist|build)/") & ext.isin("md", "markdown", "txt", "rst", "html", "pdf")


def migrated(entries: DataFrame) -> DataFrame:
    """source_file, content, sha256, token_count of a manifest's entries (JSON): an object with these, or the text alone, of which they are computed."""
    text, whole = F.from_json(F.concat(F.lit("["), "entry", F.lit("]")), "array<string>")[0], F.from_json("entry", "struct<content:string,sha256:string,token_count:int>")
    old = manifest(entries.where("entry like '\"%'").select("source_file", text.alias("content")))
    return entries.where("entry like '{%'").select("source_file", whole.alias("e")).select("source_file", "e.*").unionByName(old)


def conversion_state(current: DataFrame, before: DataFrame, outputs: DataFrame) -> DataFrame:
    """source_file, what of two runs' hashes (source_file, sha256) and the outputs that exist: keep where the hash is the same and the output there, else convert; remove where the source is gone."""
    j = current.select("source_file", F.col("sha256").alias("now")).join(before.select("source_file", F.col("sha256").alias("then")), "source_file", "full").join(outputs.select("source_file", F.lit(True).alias("there")).distinct(), "source_file", "left")
    return j.select("source_file", F.when(F.col("now").isNull(), "remove").when((F.col("now") == F.col("then")) & F.col("there"), "keep").otherwise("convert").alias("what"))


def converted(rows: DataFrame, converters: dict[str, Callable[[str], str]]) -> DataFrame:
    """rows (route, content and more) with their content as text, and failure: texts and Markdown pass, HTML is read, other kinds go through the converters given. A file that fails has no content and says why; the others go on."""
    schema = T.StructType([*[f for f in rows.schema if f.name not in ("route", "content")], T.StructField("content", T.StringType()), T.StructField("failure", T.StringType())])
    kept = [f.name for f in schema if f.name not in ("content", "failure")]
    known = {"html": markdown_of, **converters}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, failures = [], []
            for kind, content in zip(b.column("route").to_pylist(), b.column("content").to_pylist()):
                text, failure = content, None
                if kind not in ("text", "markdown"):
                    try:
                        text = known[kind](content)
                    except KeyError:
                        text, failure = None, f"no converter for {kind}"
                    except Exception as e:  # one file's failure is a row
                        text, failure = None, f"{type(e).__name__}: {e}"
                texts.append(text)
                failures.append(failure)
            yield pa.RecordBatch.from_arrays([*b.select(kept).columns, pa.array(texts, pa.string()), pa.array(failures, pa.string())], schema.names)

    return rows.mapInArrow(run, schema)


def url_list(lines: DataFrame) -> DataFrame:
    """url: the lines (value) that are neither blank nor comments, once each."""
    return lines.select(F.trim("value").alias("url")).where("url <> '' and url not like '#%'").distinct()


def crawl_order(links: DataFrame, seeds: DataFrame, depth: int, same_host: bool = True, most: int | None = None) -> DataFrame:
    """url, hop: pages a crawl reaches over links (src, dst), nearest first. The frontier logic without the network."""
    from graphloom.operators.graph import within

    host = lambda c: F.lower(F.try_parse_url(c, F.lit("HOST")))
    e = links.where(host("src").eqNullSafe(host("dst"))) if same_host else links
    seen = within(e, seeds.select(F.col("url").alias("id")), depth, directed=True).groupBy(F.col("id").alias("url")).agg(F.min("hop").alias("hop"))
    return seen.orderBy("hop", "url").limit(most) if most else seen


def read_run_log(lines: DataFrame) -> DataFrame:
    """clock, level, logger, message, and all other columns, of lines (value) like 'HH:MM:SS [LEVEL] logger — message'; other lines are left out."""
    p = r"^(\d{2}:\d{2}:\d{2}) \[(\w+)\] (\S+) — (.*)$"
    cols = [F.regexp_extract("value", p, i).alias(c) for i, c in enumerate(("clock", "level", "logger", "message"), 1)]
    return lines.select(*[c for c in lines.columns if c != "value"], *cols).where("clock <> ''")


def read_call_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ts string, provider string, model string, context string, input_tokens long, output_tokens long, total_tokens long, duration_s double, raw_response string, status_code int, error string").json(path)
