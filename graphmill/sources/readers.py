"""Sources and sinks: tables by project, graph databases over JDBC, POM and mapper XML, source files, commit logs; upserts and exports."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental


def label_scan(spark: SparkSession, path: str, projects: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """A node or edge table partitioned by project; the filter prunes partitions, the columns prune the scan."""
    df = spark.read.parquet(path)
    df = df.where(F.col("project").isin(projects)) if projects else df
    return df.select(*columns) if columns else df


def write_nodes(nodes: DataFrame, path: str, key: str = "id") -> None:
    """Upserts by key: partitions (projects) that occur in nodes are rewritten, others stay. Of rows of nodes that share a key the greatest counts."""
    spark = nodes.sparkSession
    nodes = nodes.groupBy(key).agg(F.max(F.struct(*[c for c in nodes.columns if c != key])).alias("_x")).select(key, "_x.*").select(*nodes.columns)
    try:
        old = spark.read.parquet(path).join(nodes.select("project").distinct(), "project", "left_semi")
    except Exception as e:  # noqa: BLE001  no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        nodes.write.partitionBy("project").parquet(path)
        return
    from ..operators.lineage import saved

    merged = saved(incremental.upserted(old.select(*nodes.columns), nodes, key))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(path)


def write_edges(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    """Adds edges (src, dst, ...) whose two ends exist and that the table at path lacks, once."""
    fresh = incremental.connected_edges(edges, nodes)
    try:
        fresh = fresh.join(edges.sparkSession.read.parquet(path).select("src", "dst"), ["src", "dst"], "left_anti")
    except Exception as e:  # noqa: BLE001  no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh.select(*edges.columns).write.mode("append").parquet(path)


def jdbc_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a graph database (nodes, edges, files) through JDBC; the driver's jar must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def graph_rows(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a parser's database to methods (node, class_name, file_path, ...) and edges (src, dst, call_type) between methods."""
    methods = nodes.where("kind in ('method', 'function')").join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id", "left")
    methods = methods.select(F.col("id").alias("node"), F.regexp_replace("qualified_name", r"[.#][^.#]*$", "").alias("class_name"), F.col("name").alias("method_name"), "file_path", "start_line", "end_line")
    calls = edges.where("kind = 'calls'").select(F.col("source").alias("src"), F.col("target").alias("dst"), F.lit("CALL").alias("call_type"))
    return methods, incremental.connected_edges(calls, methods.select("node"))


def read_poms(spark: SparkSession, folder: str) -> DataFrame:
    """(path, group_id, artifact_id, version, dependencies): pom.xml files with ${properties} filled in."""
    schema = "groupId string, artifactId string, version string, parent struct<groupId:string,version:string>, properties map<string,string>, dependencies struct<dependency:array<struct<groupId:string,artifactId:string,version:string>>>"
    x = spark.read.format("binaryFile").option("pathGlobFilter", "pom.xml").option("recursiveFileLookup", True).load(folder).select("path", F.decode("content", "UTF-8").alias("xml"))
    body = F.regexp_replace(F.regexp_replace("xml", r"(?s)<properties>.*?</properties>|<!--.*?-->", ""), r"xmlns(:\w+)?=\"[^\"]*\"", "")
    props = F.regexp_extract("xml", r"(?s)<properties>(.*?)</properties>", 1)
    p = F.map_from_entries(F.zip_with(F.regexp_extract_all(props, F.lit(r"<([\w.\-]+)>([^<]*)</"), F.lit(1)), F.regexp_extract_all(props, F.lit(r"<([\w.\-]+)>([^<]*)</"), F.lit(2)), lambda k, v: F.struct(k, v)))
    out = x.select("path", p.alias("p"), F.from_xml(body, schema.replace("properties map<string,string>, ", "")).alias("m"))
    fill = lambda c: F.when(c.rlike(r"^\$\{.*\}$"), F.coalesce(F.try_element_at("p", F.regexp_extract(c, r"^\$\{(.*)\}$", 1)), c)).otherwise(c)
    deps = F.transform(F.coalesce("m.dependencies.dependency", F.array()), lambda d: F.concat_ws(":", fill(d["groupId"]), d["artifactId"], fill(d["version"])))
    return out.select("path", F.coalesce("m.groupId", "m.parent.groupId").alias("group_id"), F.col("m.artifactId").alias("artifact_id"), F.coalesce("m.version", "m.parent.version").alias("version"), deps.alias("dependencies"))


def read_mappers(spark: SparkSession, folder: str) -> DataFrame:
    """(namespace, sql_id, statement_type, sql): statements of mapper XML files."""
    x = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", True).load(folder).select(F.decode("content", "UTF-8").alias("xml"))
    namespace = F.regexp_extract("xml", r"<mapper\s+namespace=\"([^\"]+)\"", 1)
    pattern = F.lit(r"(?s)<(select|insert|update|delete)\s[^>]*?id=\"([^\"]+)\"[^>]*>(.*?)</\1>")
    parts = [F.regexp_extract_all("xml", pattern, F.lit(k)) for k in (1, 2, 3)]
    rows = x.where(namespace != "").select(namespace.alias("namespace"), F.explode(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("kind", "id", "sql"), strict=True)])).alias("s"))
    clean = F.trim(F.regexp_replace(F.regexp_replace("s.sql", "<[^>]+>", " "), r"\s+", " "))
    return rows.select("namespace", F.col("s.id").alias("sql_id"), F.upper("s.kind").alias("statement_type"), clean.alias("sql"))


# Annotations and decorators that declare entry points.
JAVA_ROUTES = re.compile(r'@(Get|Post|Put|Delete|Patch|Request)Mapping\(\s*(?:value\s*=\s*|path\s*=\s*)?"([^"]*)"')
JAVA_LISTENERS = re.compile(r'@(?:KafkaListener|RabbitListener|RocketMQMessageListener)\([^)]*?(?:topics?|queues?)\s*=\s*\{?"([^"]+)"')
JAVA_FEIGN = re.compile(r'@FeignClient\([^)]*?(?:name|value)\s*=\s*"([^"]+)"')
PYTHON_ROUTES = re.compile(r'@\w+\.(get|post|put|delete|patch|route)\(\s*["\']([^"\']*)["\']')
PYTHON_TASKS = re.compile(r"@(?:\w+\.)?(?:shared_task|task)\b[^\n]*\n(?:@[^\n]*\n)*(?:async\s+)?def\s+(\w+)")
DJANGO_PATHS = re.compile(r'\b(?:re_)?path\(\s*r?["\']([^"\']*)["\']')
CALLS = re.compile(r'\b(?:requests|httpx|restTemplate|axios|http)\.(get|post|put|delete|patch|getForObject|postForObject)\(\s*[`"\']([^`"\']+)')


def scan_text(path: str, text: str) -> list[tuple[str, str, str, int]]:
    """(kind, method, key, line) of the entry points and outgoing calls that a source file declares."""
    found, line = [], lambda m: text.count("\n", 0, m.start()) + 1
    for m in JAVA_ROUTES.finditer(text):
        found.append(("HTTP", "GET" if m[1] == "Request" else m[1].upper(), m[2], line(m)))
    found += [("MQ_CONSUMER", "", m[1], line(m)) for m in JAVA_LISTENERS.finditer(text)]
    found += [("FEIGN", "", m[1], line(m)) for m in JAVA_FEIGN.finditer(text)]
    if path.endswith(".py"):
        for m in PYTHON_ROUTES.finditer(text):
            found.append(("HTTP", "GET" if m[1] == "route" else m[1].upper(), m[2], line(m)))
        found += [("TASK", "", m[1], line(m)) for m in PYTHON_TASKS.finditer(text)]
        found += [("HTTP", "", m[1], line(m)) for m in DJANGO_PATHS.finditer(text)]
    for m in CALLS.finditer(text):
        method = re.match("get|post|put|delete|patch", m[1], re.I)[0]
        found.append(("HTTP_CALL", method.upper(), m[2], line(m)))
    return found


def scan_sources(spark: SparkSession, folder: str, endings: str = "*.{java,py,js,ts,vue}") -> DataFrame:
    """(path, kind, method, key, line) over all source files; a file is a row, so memory is bounded by the largest file of a batch."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", endings).option("recursiveFileLookup", True).load(folder).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *r) for p, c in zip(b["path"], b["content"], strict=True) for r in scan_text(p, bytes(c).decode("utf-8", "replace"))]
            yield pd.DataFrame(rows, columns=["path", "kind", "method", "key", "line"])

    return files.mapInPandas(run, "path string, kind string, method string, key string, line int")


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """Lines of `git log --numstat --format=@%H|%ae|%cI` (one file a repository) to (repo, commit, author, at, file, lines).

    A commit is one record (the separator is a line's end and @), so a log is read by many tasks. A binary file counts 0 lines.
    """
    text = spark.read.text(path, lineSep="\n@").select(F.input_file_name().alias("repo"), F.split("value", "\n").alias("x"))
    head = F.split(F.regexp_replace(F.col("x")[0], "^@", ""), r"\|")
    rows = text.select("repo", head[0].alias("commit"), head[1].alias("author"), F.to_timestamp(head[2]).alias("at"), F.explode("x").alias("f"))
    cells = F.split("f", "\t")
    return rows.where(F.col("f").rlike(r"^(\d+|-)\t(\d+|-)\t")).select("repo", "commit", "author", "at", cells[2].alias("file"), (F.coalesce(cells[0].try_cast("long"), F.lit(0)) + F.coalesce(cells[1].try_cast("long"), F.lit(0))).alias("lines"))


def read_diff(spark: SparkSession, path: str) -> DataFrame:
    """Unified diffs (`git diff`, one file a comparison) to (diff, file, status, additions, deletions), a row a changed file.

    A file's part is one record (the separator is the line that begins with `diff --git`).
    """
    text = spark.read.text(path, lineSep="\ndiff --git ").select(F.input_file_name().alias("diff"), F.split("value", "\n").alias("x"))
    name = F.regexp_extract(F.col("x")[0], r" b/(.*)$", 1)
    begins = lambda p: F.exists("x", lambda l: F.startswith(l, F.lit(p)))
    status = F.when(begins("new file mode"), "ADDED").when(begins("deleted file mode"), "DELETED").when(begins("rename to"), "RENAMED").otherwise("MODIFIED")
    body = F.slice("x", F.greatest(F.lit(1), F.array_position(F.transform("x", lambda l: F.startswith(l, F.lit("@@"))), True).cast("int")), F.size("x"))
    has = F.exists("x", lambda l: F.startswith(l, F.lit("@@")))
    lines = lambda p: F.when(has, F.size(F.filter(body, lambda l: F.startswith(l, F.lit(p))))).otherwise(0)
    return text.where(name != "").select("diff", name.alias("file"), status.alias("status"), lines("+").alias("additions"), lines("-").alias("deletions"))


def export_reports(reports: DataFrame, folder: str) -> None:
    """A markdown text a report (report_id, title, body), a file a partition."""
    reports.select(F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("body"), F.lit("\n")).alias("value")).write.mode("overwrite").text(folder)
