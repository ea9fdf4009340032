"""The run catalog: scans, flattening, browsing, read-only SQL and publication."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from py4j.java_gateway import is_instance_of
from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.functions.exprs import SAFE_ID, is_safe_id
from tidemark.functions.skew import by_size
from tidemark.session import settle, widen
from tidemark.sources import files

# Page limits and SQL nodes that a read-only query may contain.
MAX_LISTED_RUNS = 200
READ_ONLY_NODES = (
    "Aggregate",
    "CTERelationDef",
    "Distinct",
    "Except",
    "Filter",
    "Generate",
    "GlobalLimit",
    "Intersect",
    "Join",
    "LateralJoin",
    "LocalLimit",
    "LocalRelation",
    "Offset",
    "OneRowRelation",
    "Pivot",
    "Project",
    "Sample",
    "Sort",
    "SubqueryAlias",
    "Union",
    "Unpivot",
    "UnresolvedHaving",
    "UnresolvedHint",
    "UnresolvedInlineTable",
    "UnresolvedRelation",
    "UnresolvedSubqueryColumnAliases",
    "UnresolvedTableValuedFunction",
    "UnresolvedWith",
    "View",
    "Window",
    "WithCTE",
    "WithWindowDefinition",
)
TABLE_FUNCTIONS = (
    "explode",
    "inline",
    "posexplode",
    "range",
    "stack",
)
REFUSED_FUNCTIONS = (
    "java_method",
    "reflect",
    "try_reflect",
    "read_files",
)
REFUSED_EXPRESSIONS = (
    "ExpressionWithUnresolvedIdentifier",
    "FunctionTableSubqueryArgumentExpression",
)


class RefusedQuery(ValueError):
    """The statement is not one read-only SELECT over the catalog."""


# -- scans ------------------------------------------------------------------------


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything, on any Hadoop file system."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def empty_catalog(spark: SparkSession) -> DataFrame:
    """The catalog before the first run: every base column, no rows."""
    return spark.createDataFrame([], schemas.CATALOG)


def union_catalogs(base: DataFrame, *others: DataFrame) -> DataFrame:
    """Union by column name; a column only some sides have is NULL on the others.

    Columns of the base schema are cast to its types, so an integer written by one run and a
    double by another do not clash.
    """
    known = {f.name: f.dataType for f in base.schema.fields}
    out = base
    for other in others:
        cast = [F.col(f"`{c}`").cast(known[c]).alias(c) if c in known else F.col(f"`{c}`") for c in other.columns]
        out = out.unionByName(other.select(*cast), allowMissingColumns=True)
    return out


INTEGERS = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8}
NUMBERS = {*INTEGERS, "float", "double"}


def _common_type(kinds: set[str]) -> str:
    """The narrowest type that holds all of ``kinds``: integer, double or text."""
    if kinds <= set(INTEGERS):
        return max(kinds, key=INTEGERS.__getitem__)
    return "double" if kinds <= NUMBERS else "string"


def catalog_file_schemas(spark: SparkSession, path: str) -> DataFrame:
    """``(path, schema, error)`` of every Parquet file below ``path``, footers read in tasks."""
    names = F.col("path").endswith(".parquet")  # hidden files are not listed
    return files.footer_schemas(widen(files.list_files(spark, path).filter(names)))


def _read_widened(spark: SparkSession, path: str) -> DataFrame:
    """All files below ``path``, columns united by name and widened where files differ.

    Files that only add columns are one scan. Where a column has other types in other files, the
    footer of every file is read in tasks and reduced to the distinct schemas. The files of each
    schema, in whatever folders, are one scan, and the column is cast to a type that holds all: an
    integer to the widest integer, any numbers to double, anything else to text (values that are
    not scalars as JSON). A file whose footer cannot be read is an error.
    """
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except Exception as error:
        if "CANNOT_MERGE" not in str(error):
            raise
    found = settle(catalog_file_schemas(spark, path))
    bad = found.filter(F.col("schema").isNull()).select("path", "error").first()
    if bad is not None:
        raise ValueError(f"No Parquet footer in {bad['path']}: {bad['error']}")
    texts = [r[0] for r in found.select("schema").distinct().orderBy("schema").collect()]
    scans = {text: T.StructType.fromJson(json.loads(text)) for text in texts}
    kinds: dict[str, set[str]] = {}
    for schema in scans.values():
        for field in schema.fields:
            kinds.setdefault(field.name, set()).add(field.dataType.simpleString())
    wide = {c: _common_type(k) for c, k in kinds.items() if len(k) > 1}

    def widened(field: T.StructField) -> Column:
        value = F.col(f"`{field.name}`")
        if field.name not in wide:
            return value
        if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(value).alias(field.name)
        return value.cast(wide[field.name]).alias(field.name)

    parts = []
    for text, schema in scans.items():
        # Spark's own file index of a scan is a list of names, too
        names = [r[0] for r in found.filter(F.col("schema") == text).select("path").collect()]
        part = spark.read.option("basePath", path).schema(schema).parquet(*names)
        folders = [F.col(f"`{c}`") for c in part.columns if c not in schema.names]
        parts.append(part.select(*map(widened, schema.fields), *folders))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def scan_catalog(spark: SparkSession, path: str) -> DataFrame:
    """All catalog rows below ``path``; one empty table when nothing was published yet."""
    base = empty_catalog(spark)
    if not path_exists(spark, path):
        return base
    rows = _read_widened(spark, path)
    # The base columns the files lack are added; a scan keeps its pushed filters because
    # nothing but a projection is put above it.
    present = {c: f.dataType for c, f in zip(rows.columns, rows.schema.fields)}
    return rows.select(
        *[
            (F.col(f.name) if present[f.name] == f.dataType else F.col(f.name).cast(f.dataType))
            if f.name in present
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schemas.CATALOG.fields
        ],
        *[F.col(f"`{c}`") for c in rows.columns if c not in schemas.CATALOG.names],
    )


def _folder_documents(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``(_run, content)`` of the file ``name`` of every run folder that has one.

    Folders are named on the driver and the files read in tasks; staging folders fail the id pattern.
    """
    tops = files.list_names(spark, f"{root}/experiments").filter(F.col("length").isNull())
    named = tops.select(F.element_at(F.split("path", "/"), -1).alias("_run"), F.concat("path", F.lit(f"/{name}")).alias("path"))
    found = files.read_files(named.where(F.col("_run").rlike(SAFE_ID)))
    return found.where(~F.col("error").eqNullSafe(files.ABSENT)).select("_run", "content")


def parse_documents(rows: DataFrame, schema: T.StructType | str) -> DataFrame:
    """``rows`` with the fields of the JSON text in ``content`` instead of it, as Spark's reader has them.

    A list has a row for each of its documents, one that is no JSON object has nulls, blank
    content has no row.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    text = F.col("content").cast("string")
    found = F.coalesce(F.from_json(text, T.ArrayType(kind)), F.array(F.lit(None).cast(kind)))
    rest = [c for c in rows.columns if c != "content"]
    full = rows.where(text.isNull() | (F.length(F.trim(text, F.lit(" \t\r\n"))) > 0))
    return full.select(*rest, F.explode(found).alias("_document")).select("_document.*", *rest)


def _record_files(spark: SparkSession, root: str) -> DataFrame | None:
    """Every run document with the name of its folder; one that is no JSON object has nulls."""
    if not path_exists(spark, f"{root}/experiments"):
        return None
    return parse_documents(_folder_documents(spark, root, "record.json"), schemas.RECORD)


def scan_records(spark: SparkSession, root: str) -> DataFrame:
    """Run documents of all committed runs; staging directories fail the id pattern.

    Documents that :func:`record_problems` reports are left out.
    """
    rows = _record_files(spark, root)
    if rows is None:
        return spark.createDataFrame([], schemas.RECORD)
    return rows.where(F.col("id") == F.col("_run")).drop("_run")


def record_problems(spark: SparkSession, root: str) -> DataFrame:
    """``(run_id, problem)`` of run documents without an id or with that of another run."""
    rows = _record_files(spark, root)
    if rows is None:
        return spark.createDataFrame([], "run_id string, problem string")
    problem = F.when(F.col("id").isNull(), "malformed record").when(F.col("id") != F.col("_run"), "id of another run")
    return rows.select(F.col("_run").alias("run_id"), problem.alias("problem")).filter(F.col("problem").isNotNull())


def scan_manifests(spark: SparkSession, root: str) -> DataFrame:
    """``(run_id, valid, artifacts, manifest_sha256)`` per run directory with a manifest."""
    rows = _folder_documents(spark, root, "manifest.json")
    out = rows.select(
        F.col("_run").alias("run_id"),
        F.from_json(F.col("content").cast("string"), schemas.MANIFEST).alias("m"),
        F.sha2("content", 256).alias("manifest_sha256"),
    )
    return out.select(
        "run_id",
        F.coalesce(
            (F.col("m.version") == 1)
            & (F.col("m.algorithm") == "sha256")
            & F.col("m.artifacts").isNotNull(),
            F.lit(False),
        ).alias("valid"),
        F.col("m.artifacts").alias("artifacts"),
        "manifest_sha256",
    )


def manifest_rows(manifests: DataFrame) -> DataFrame:
    """One row per listed artifact of valid manifests."""
    return manifests.filter("valid").select(
        "run_id", F.explode("artifacts").alias("path", "sha256")
    )


def list_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """``(run_id, path, length, file)`` of the files of committed runs; only metadata is read."""
    inside = r"/experiments/([^/]+)/(.+)$"
    listed = files.list_files(spark, f"{root}/experiments")
    out = listed.select(
        F.regexp_extract("path", inside, 1).alias("run_id"),
        F.regexp_extract("path", inside, 2).alias("path"),
        "length",
        F.col("path").alias("file"),
    )
    return out.where(is_safe_id("run_id") & (F.col("path") != "manifest.json"))


def artifact_digests(listed: DataFrame) -> DataFrame:
    """``(run_id, path, length, sha256, error)`` of listed artifacts.

    Bytes are hashed in chunks where a task reads them, whatever a file's size. An artifact that
    cannot be read has a null digest, which artifact checks report as ``unreadable``.
    """
    named = listed.select("run_id", F.col("path").alias("inner"), "length", F.col("file").alias("path"))
    return files.file_digests(named).select("run_id", F.col("inner").alias("path"), "length", "sha256", "error")


def scan_artifacts(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """Files of committed runs with size and, if asked, the digest of their bytes.

    Without ``content`` only file metadata is read.
    """
    listed = list_artifacts(spark, root)
    return artifact_digests(listed).drop("error") if content else listed.drop("file")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Sweep specs and configuration documents, one JSON document per file."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_documents(listed: DataFrame, schema: T.StructType | str) -> DataFrame:
    """As :func:`read_json`, of the files at ``path``: any number of small ones, read in tasks."""
    return parse_documents(files.read_files(listed.select("path")).select("content"), schema)


# -- flattening -------------------------------------------------------------------


def metric_types(records: DataFrame) -> dict[str, str]:
    """Every metric name in any run with the narrowest type that holds all its values.

    Values are JSON scalars as text: boolean if all are true or false, double if all are
    numbers, else string. The names become columns, so the plan needs them on the driver.
    """
    value = F.col("value")
    rows = (
        records.select(F.explode("metrics").alias("name", "value"))
        .filter(value.isNotNull())
        .groupBy("name")
        .agg(
            F.bool_and(value.isin("true", "false")).alias("flag"),
            F.bool_and(value.try_cast("double").isNotNull()).alias("number"),
        )
        .orderBy("name")
        .collect()
    )
    return {r["name"]: "boolean" if r["flag"] else "double" if r["number"] else "string" for r in rows}


def _column_names(metrics: Sequence[str]) -> dict[str, str]:
    """A column for every metric that is none yet, told apart as Spark does, without case."""
    taken = {
        c.lower()
        for c in (
            *schemas.IDENTITY_COLUMNS,
            *schemas.CONFIG_COLUMNS,
            *schemas.METRIC_COLUMNS,
            *schemas.DOCUMENT_COLUMNS,
        )
    }
    out = {}
    for name in metrics:
        column = name
        while column.lower() in taken:
            column = f"metric_{column}"
        taken.add(column.lower())
        out[name] = column
    return out


def flatten_records(records: DataFrame, types: Mapping[str, str] | None = None) -> DataFrame:
    """One catalog row per run document.

    Fixed metric columns keep their types; every other metric becomes a column of its own type
    (``types``, or as :func:`metric_types` finds) under its own name, or ``metric_<name>`` when
    that name is taken.
    """
    found = metric_types(records) if types is None else types
    extra = {n: kind for n, kind in found.items() if n not in schemas.METRIC_COLUMNS}
    columns = _column_names(list(extra))
    fixed = {f.name: f.dataType for f in schemas.CATALOG.fields}
    metric = F.col("metrics")
    return records.select(
        "id",
        "status",
        "equation",
        "solver",
        "created_at",
        "parent_id",
        F.when(F.col("error").isNotNull(), F.to_json("error")).alias("error"),
        *[F.col(f"config.{c}").cast(fixed[c]).alias(c) for c in schemas.CONFIG_COLUMNS],
        *[metric[c].try_cast(fixed[c]).alias(c) for c in schemas.METRIC_COLUMNS],
        *[metric[n].try_cast(kind).alias(columns[n]) for n, kind in extra.items()],
        F.to_json("config").alias("config_json"),
        F.coalesce(F.to_json("provenance"), F.lit("{}")).alias("provenance_json"),
        F.coalesce(F.to_json("metrics"), F.lit("{}")).alias("metrics_json"),
    )


# -- browsing ---------------------------------------------------------------------


def browse(
    catalog: DataFrame,
    *,
    equation: str | None = None,
    status: str | None = None,
    flagged: bool | None = None,
    text: str | None = None,
) -> DataFrame:
    """Conjunction of the given filters; the text filter looks at the whole row."""
    out = catalog
    if equation:
        out = out.filter(F.col("equation") == equation)
    if status:
        out = out.filter(F.col("status") == status)
    if flagged is not None:
        flag = F.coalesce(F.col("needs_review"), F.lit(False))
        out = out.filter(flag if flagged else ~flag)
    if text:
        row = F.lower(F.to_json(F.struct(*[F.col(f"`{c}`") for c in catalog.columns])))
        out = out.filter(row.contains(text.lower()))
    return out


def list_runs(catalog: DataFrame) -> DataFrame:
    return catalog.select("id", "equation", "status", "parent_id")


def show_run(catalog: DataFrame, run_id: str) -> DataFrame:
    return catalog.filter(F.col("id") == run_id)


def first_runs(catalog: DataFrame, count: int = 50, most: int = MAX_LISTED_RUNS) -> DataFrame:
    """The first ``count`` runs by id, from 1 to ``most``."""
    if isinstance(count, bool) or not 1 <= count <= most:
        raise ValueError(f"count must be an integer in [1, {most}]")
    return catalog.orderBy("id").limit(count)


def listing_summary(catalog: DataFrame, count: int = 50) -> DataFrame:
    """How many runs a listing shows, how many there are and whether it is truncated."""
    n = F.count("*")
    return catalog.agg(
        F.least(n, F.lit(count)).alias("displayed"),
        n.alias("total"),
        (n > count).alias("truncated"),
        F.lit(count).cast("long").alias("max_experiments"),
    )


# -- reuse ------------------------------------------------------------------------


def parents_ready(requests: DataFrame, catalog: DataFrame, problems: DataFrame) -> DataFrame:
    """Requests whose parent, if they name one, exists and has no artifact problem."""
    ids = catalog.select(F.col("id").alias("parent_id"), F.lit(True).alias("_exists"))
    bad = problems.select(F.col("id").alias("parent_id")).distinct().withColumn("_bad", F.lit(True))
    return (
        requests.join(ids, "parent_id", "left")
        .join(bad, "parent_id", "left")
        .filter(F.col("parent_id").isNull() | (F.col("_exists") & F.col("_bad").isNull()))
        .select(*requests.columns)
    )


def reuse_plan(expected: DataFrame, catalog: DataFrame, problems: DataFrame) -> DataFrame:
    """``run``, ``reuse`` or ``corrupt`` per expected id; recorded failures are reused too."""
    have = catalog.select("id", F.col("status").alias("found_status"))
    bad = problems.groupBy("id").agg(F.count("*").alias("problem_count"))
    return (
        expected.join(have, "id", "left")
        .join(bad, "id", "left")
        .withColumn("problem_count", F.coalesce("problem_count", F.lit(0)).cast("long"))
        .withColumn(
            "action",
            F.when(F.col("found_status").isNull(), "run")
            .when(F.col("problem_count") > 0, "corrupt")
            .otherwise("reuse"),
        )
    )


# -- read-only SQL ----------------------------------------------------------------


PLAN_EXPRESSION = "org.apache.spark.sql.catalyst.expressions.PlanExpression"


def _seq(items) -> list:
    return [items.apply(i) for i in range(items.size())]


def _walk_plan(node, nodes: list, names: set[str]) -> None:
    """Collect all plan nodes of a parsed statement, those of subqueries included."""
    nodes.append(node)
    if node.getClass().getSimpleName() == "UnresolvedWith":
        for pair in _seq(node.cteRelations()):
            names.add(pair._1())
            _walk_plan(pair._2(), nodes, names)
    for child in _seq(node.children()):
        _walk_plan(child, nodes, names)
    for expression in _seq(node.expressions()):
        _walk_expression(expression, nodes, names)


def _walk_expression(expression, nodes: list, names: set[str]) -> None:
    if is_instance_of(SparkContext._gateway, expression, PLAN_EXPRESSION):
        _walk_plan(expression.plan(), nodes, names)
    kind = expression.getClass().getSimpleName()
    if kind in REFUSED_EXPRESSIONS:
        raise RefusedQuery(f"Expression is not allowed: {kind}")
    if kind == "UnresolvedFunction":
        name = _seq(expression.nameParts())[-1].lower()
        if name in REFUSED_FUNCTIONS:
            raise RefusedQuery(f"Function is not allowed: {name}")
    for child in _seq(expression.children()):
        _walk_expression(child, nodes, names)


def check_select(spark: SparkSession, sql: str, table: str = "experiments") -> None:
    """Raise unless ``sql`` parses to one SELECT that reads nothing but ``table``."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as error:
        raise RefusedQuery("Expected one SELECT over the catalog and nothing else") from error
    nodes: list = []
    names = {table}
    _walk_plan(plan, nodes, names)
    for node in nodes:
        kind = node.getClass().getSimpleName()
        if kind not in READ_ONLY_NODES:
            raise RefusedQuery(f"Expected one SELECT over the catalog and nothing else, got {kind}")
        if kind == "UnresolvedRelation":
            parts = _seq(node.multipartIdentifier())
            if len(parts) != 1 or parts[0].lower() not in {n.lower() for n in names}:
                raise RefusedQuery(f"Only {table} can be read: {'.'.join(parts)}")
        if kind == "UnresolvedTableValuedFunction":
            name = _seq(node.name())[-1].lower()
            if name not in TABLE_FUNCTIONS:
                raise RefusedQuery(f"Table function is not allowed: {name}")


def select_runs(catalog: DataFrame, sql: str) -> DataFrame:
    """Evaluate one read-only SELECT over the view ``experiments``.

    The result stays distributed and the view is lazy, so the query's filters and columns
    reach the catalog files.
    """
    spark = catalog.sparkSession
    check_select(spark, sql)
    catalog.createOrReplaceTempView("experiments")
    return spark.sql(sql)


# -- publication ------------------------------------------------------------------


def array_problems(frames: DataFrame) -> DataFrame:
    """Fields that cannot be published: unsafe name, empty, ragged, or missing frames.

    A field needs one row per saved time of its run and the same number of cells in each.
    """
    per_field = frames.groupBy("run_id", "field").agg(
        F.count("*").alias("rows"),
        F.count_distinct("frame").alias("saved"),
        F.max("frame").alias("last"),
        F.min("frame").alias("first"),
        F.min(F.coalesce(F.size("values"), F.lit(0))).alias("least"),
        F.max(F.coalesce(F.size("values"), F.lit(0))).alias("most"),
    )
    per_run = frames.groupBy("run_id").agg(F.count_distinct("frame").alias("run_frames"))
    checked = per_field.join(per_run, "run_id").withColumn(
        "problem",
        F.when(~F.col("field").rlike(r"^[A-Za-z][A-Za-z0-9_]*$"), "unsafe array name")
        .when(F.col("least") == 0, "empty array")
        .when(F.col("least") != F.col("most"), "ragged frames")
        .when(F.col("rows") != F.col("saved"), "repeated frame")
        .when(
            (F.col("first") != 0)
            | (F.col("last") + 1 != F.col("saved"))
            | (F.col("saved") != F.col("run_frames")),
            "does not match the saved time dimension",
        ),
    )
    return checked.filter(F.col("problem").isNotNull()).select("run_id", "field", "problem")


COMMITTED = "id string, batch string"


def publish_runs(catalog_rows: DataFrame, frames: DataFrame | None, root: str) -> DataFrame:
    """Append new runs: field arrays first, catalog rows next, the commit last.

    Every attempt writes its own batch, and only the last step names that batch in the next free
    version, so an interrupted attempt stays invisible and can simply run again. Ids that are
    already committed are left out; nothing is overwritten. Equal rows of an id count once, different
    ones are refused. Returns the committed ids.
    """
    spark = catalog_rows.sparkSession
    batch = uuid.uuid4().hex
    new = (
        catalog_rows.filter(is_safe_id("id"))
        .join(committed_runs(spark, root), "id", "left_anti")
        .distinct()
    )
    if frames is not None:
        bad = array_problems(frames).select(F.col("run_id").alias("id")).distinct()
        new = new.join(bad, "id", "left_anti")
    new = settle(new)  # frames and catalog rows must see the same runs
    clash = new.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") > 1).first()
    if clash is not None:
        raise ValueError(f"Different rows of one run: {clash['id']}")
    if frames is not None:
        owners = by_size(new.select(F.col("id").alias("run_id"), "equation"))
        (
            frames.join(owners, "run_id")
            .withColumn("batch", F.lit(batch))
            .repartitionByRange("equation", "run_id", "frame")
            .sortWithinPartitions("equation", "run_id", "field", "frame")
            .write.mode("append")
            .partitionBy("batch", "equation")
            .parquet(f"{root}/frames")
        )
    (
        new.withColumn("batch", F.lit(batch))
        .write.mode("append")
        .partitionBy("batch", "status")
        .parquet(f"{root}/catalog")
    )
    if not new.isEmpty():
        listed = new.select("id", F.lit(batch).alias("batch"))
        listed.write.mode("append").partitionBy("batch").parquet(f"{root}/committed")
        _take_version(spark, root, batch)
    return committed_runs(spark, root)


def _take_version(spark: SparkSession, root: str, batch: str) -> int:
    """Name ``batch`` in the next free version file, which is what commits it.

    A version is taken by creating its file, which fails if it exists. Versions are taken one after
    the other, so a later commit never gets a smaller one.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/versions")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(folder)
    version = len(store.listStatus(folder))
    while True:
        target = spark._jvm.org.apache.hadoop.fs.Path(folder, f"{version:012d}")
        try:
            out = store.create(target, False)
        except Py4JJavaError:
            if not store.exists(target):
                raise
            version += 1
            continue
        out.write(bytearray(batch.encode()))
        out.close()
        return version


def committed_runs(spark: SparkSession, root: str) -> DataFrame:
    """Committed ids and the batch that holds them.

    Of racing batches with one id the one committed first keeps it, for good.
    """
    if not path_exists(spark, f"{root}/versions/*"):
        return spark.createDataFrame([], COMMITTED)
    versions = spark.read.text(f"{root}/versions", wholetext=True).select(
        F.col("value").alias("batch"), F.col("_metadata.file_name").alias("version")
    )
    rows = spark.read.schema(COMMITTED).parquet(f"{root}/committed").join(versions, "batch")
    return rows.groupBy("id").agg(F.min_by("batch", "version").alias("batch"))


def published_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Catalog rows of committed runs."""
    rows = scan_catalog(spark, f"{root}/catalog")
    if "batch" not in rows.columns:
        return rows
    return rows.join(committed_runs(spark, root), ["id", "batch"], "left_semi").drop("batch")


def published_frames(spark: SparkSession, root: str) -> DataFrame:
    """Field rows of committed runs."""
    commits = committed_runs(spark, root).withColumnRenamed("id", "run_id")
    return (
        spark.read.parquet(f"{root}/frames")
        .join(commits, ["run_id", "batch"], "left_semi")
        .drop("batch")
    )


def write_report(report: DataFrame, path: str) -> None:
    """Write a report as JSON, refusing to replace one."""
    report.write.mode("errorifexists").json(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of a report, one JSON document a line; a damaged line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
