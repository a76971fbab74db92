"""Readers of feeds, candidates, indexes, predictions and sample directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import label_of, without_bom
from ..functions.url import domain_to_url, normalise, normalise_feed, strip

#: The dialect of all files: quotes are doubled, newlines may stand in quotes; a byte order mark is skipped.
CSV = {"multiLine": True, "escape": '"', "quote": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def ordinal(df: DataFrame, name: str = "ord") -> DataFrame:
    """The rows' order in the file: of partitions as read, and within them."""
    return df.withColumn(name, F.monotonically_increasing_id())


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """SO3: missing columns are named."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def or_raise(c: Column) -> Column:
    """The URL of a normalised struct; an error raises."""
    return F.when(c["error"].isNull(), c["url"]).otherwise(F.raise_error(c["error"]))


def feed(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: (url, ord): lines without blanks and comments."""
    lines = ordinal(spark.read.text(path)).select(strip(without_bom(F.col("value"))).alias("url"), "ord")
    return lines.where((F.col("url") != "") & ~F.col("url").startswith("#"))


def ranked(spark: SparkSession, path: str, limit: int = 50_000) -> DataFrame:
    """SRC3: (url, ord) of a rank list without header; invalid rows are skipped; the first ``limit`` valid ones."""
    rows = ordinal(spark.read.options(**CSV).schema("a string, b string").csv(path))
    value = F.when(strip(F.col("a")).rlike("^[0-9]+$") & F.col("b").isNotNull(), F.col("b")).otherwise(F.col("a"))
    made = rows.select(domain_to_url(value).alias("u"), "ord").where("u.error is null")
    return made.select("u.url", "ord").orderBy("ord").limit(limit)


def labelled(spark: SparkSession, path: str, url_column: str = "url", label_column: str = "label") -> DataFrame:
    """SRC4: (url, label, source, ord); labels other than 0 and 1 are skipped; what isn't a number or a URL raises."""
    rows = ordinal(require(spark.read.options(header=True, **CSV).csv(path), [url_column, label_column]))
    label = F.trim(F.col(label_column)).cast("int")
    source = F.regexp_extract(F.input_file_name(), r"([^/]*?)(\.[^./]*)?$", 1)
    return rows.where(label.isin(0, 1)).select(or_raise(normalise_feed(F.col(url_column))).alias("url"), label.alias("label"), source.alias("source"), "ord")


def seen(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: (url), as written: a CSV with a ``url`` header or plain lines; a missing file is empty."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "url string")
    first = spark.read.text(path).limit(1).first()
    if first and "url" in [x.strip().strip('"') for x in (first[0] or "").lstrip("﻿").split(",")]:
        return spark.read.options(header=True, **CSV).csv(path).select("url").where("url is not null and trim(url) <> ''")
    return feed(spark, path).select("url")


def candidates(spark: SparkSession, path: str, layout: str = "header", url_column: str = "url", label_column: str = "label", url_index: int = 0, label_index: int = 1, fixed_label: int | None = None, max_rows: int = 0) -> DataFrame:
    """SRC6: (input_row, original_url, normalized_url, raw_label, label, reason); reason is null for a candidate.

    Layouts: ``header``, ``no_header`` (columns by index), ``tranco`` (rank, domain; label 0). Row numbers are those of
    the file, from 2 under a header.
    """
    from pyspark.sql import Window

    from ..operators.prefix import ranked

    reader = spark.read.options(header=layout == "header", **CSV)
    if layout == "header":
        rows = require(reader.csv(path), [url_column] + ([label_column] if fixed_label is None else []))
        url, label = F.col(url_column), F.col(label_column) if fixed_label is None else F.lit(str(fixed_label))
    else:
        width = 1 + (1 if layout == "tranco" else max(url_index, label_index))
        rows = reader.schema(", ".join(f"c{i} string" for i in range(width))).csv(path)
        url = F.col("c1") if layout == "tranco" else F.col(f"c{url_index}")
        label = F.lit("0") if layout == "tranco" else F.col(f"c{label_index}") if fixed_label is None else F.lit(str(fixed_label))
    rows = ordinal(rows).select("ord", F.coalesce(url, F.lit("")).alias("original_url"), F.coalesce(label, F.lit("")).alias("raw_label"))
    rows = ranked(rows, [], [F.col("ord")], "input_row").withColumn("input_row", F.col("input_row") + (1 if layout == "header" else 0))
    if max_rows:
        rows = rows.where(F.col("input_row") <= max_rows + (1 if layout == "header" else 0))
    n, y = normalise(F.col("original_url")), label_of(F.col("raw_label"))
    rows = rows.withColumn("_n", n).withColumn("label", y).withColumn("_e", F.coalesce(F.when(y.isNull(), F.lit("unmapped_label")), F.col("_n.error")))
    # invalid rows are each their own group, as there may be very many
    valid = Window.partitionBy(F.when(F.col("_e").isNull(), F.col("_n.url")).otherwise(F.concat(F.lit("#"), F.col("input_row")))).orderBy("input_row")
    first = F.first("label").over(valid.rowsBetween(Window.unboundedPreceding, 0))
    again = F.when(F.row_number().over(valid) > 1, F.when(F.col("label") == first, "duplicate_input_url").otherwise("conflicting_input_label"))
    reason = F.when(F.col("_e").isNotNull(), F.col("_e")).otherwise(again)
    return rows.select("input_row", "original_url", F.when(reason.isNull(), F.col("_n.url")).otherwise(F.lit("")).alias("normalized_url"), "raw_label", "label", reason.alias("reason"))


PREDICTION = "sample_id string, model string, true_label int, p double, threshold double, source string, domain string, url string, ord bigint"


def there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def predictions(spark: SparkSession, path: str, model: str | None = None, optional: bool = False) -> DataFrame:
    """SRC10: typed predictions, of one model if it's named; a missing file or one without rows raises.

    SRC11: with ``optional`` either is a table without rows.
    """
    if optional and not there(spark, path):
        return spark.createDataFrame([], PREDICTION)
    rows = ordinal(require(spark.read.options(header=True, **CSV).csv(path), ["sample_id", "model", "true_label", "phishing_probability", "threshold"]))
    if not optional and not rows.take(1):
        raise ValueError(f"no predictions in {path}")
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")
    out = rows.select("sample_id", "model", F.col("true_label").cast("int"), F.col("phishing_probability").cast("double").alias("p"), F.col("threshold").cast("double"), text("source").alias("source"), text("domain").alias("domain"), text("url").alias("url"), "ord")
    return out.where(F.col("model") == model) if model else out


def internal_metrics(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SRC12: (model, internal_f1, ...) of comparison tables; paths that aren't there are left out, and of a model in several the last counts."""
    found = [(k, p) for k, p in enumerate(paths) if there(spark, p)]
    numbers = ("accuracy", "precision", "recall", "f1", "roc_auc")
    schema = "model string, " + ", ".join(f"internal_{c} double" for c in numbers)
    if not found:
        return spark.createDataFrame([], schema)
    rows = None
    for k, p in found:
        t = require(spark.read.options(header=True, **CSV).csv(p), ["model"])
        one = ordinal(t).select("model", *((F.expr(f"try_cast({c} as double)") if c in t.columns else F.lit(None).cast("double")).alias(f"internal_{c}") for c in numbers), F.struct(F.lit(k), "ord").alias("_at"))
        rows = one if rows is None else rows.unionByName(one)
    last = rows.groupBy("model").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "_at")), "_at").alias("r"))
    return last.select("r.*")


def thresholds(spark: SparkSession, path: str) -> DataFrame:
    """SRC13: (model, threshold) of JSON ({models: {m: {threshold}}}, {models: {m: x}} or {m: x}) or of a CSV."""
    if path.endswith(".csv"):
        return require(spark.read.options(header=True, **CSV).csv(path), ["model", "threshold"]).select("model", F.col("threshold").cast("double"))
    text = spark.read.text(path, wholetext=True).select(without_bom(F.col("value")).alias("value"))
    models = F.coalesce(F.get_json_object("value", "$.models"), F.col("value"))
    one = F.explode(F.from_json(models, "map<string,string>")).alias("model", "x")
    return text.select(one).select("model", F.coalesce(F.try_variant_get(F.try_parse_json("x"), "$.threshold", "double"), F.expr("try_cast(x as double)")).alias("threshold"))


def audit(spark: SparkSession, path: str) -> DataFrame:
    """SRC14: all rows of an audit, in order; see operators.audit.approved."""
    return ordinal(require(spark.read.options(header=True, **CSV).csv(path), ["sample_id", "audit_status", "audited_label"]))


def base_index(spark: SparkSession, path: str) -> DataFrame:
    """SRC15: an index in the order of its header."""
    return spark.read.options(header=True, **CSV).csv(path)


def sample_directory(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """SRC7: (index rows, counters) of root/{trainval,test}/SAMPLE/...: the checks in order, the first failure counts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    at = F.regexp_extract_all(F.col("path"), F.lit(r"/(trainval|test)/([^/]+)/(.+)$"), F.lit(0))
    get = lambda k: F.regexp_extract("path", r"/(trainval|test)/([^/]+)/(.+)$", k)
    kinds = {"url": "URL/url.txt", "label": "Label/label.txt", "screenshot": "SCREEN-SHOT/screen_shoot.png", "html": "RAW-HTML/index.html"}
    texts = F.when(get(3).isin(kinds["url"], kinds["label"]), F.decode("content", "UTF-8"))
    listed = files.where(F.size(at) > 0).select(get(1).alias("split"), get(2).alias("rec_id"), get(3).alias("file"), "path", texts.alias("text"))
    pick = lambda kind, what: F.max(F.when(F.col("file") == kinds[kind], F.col(what)))
    s = listed.groupBy("split", "rec_id").agg(*(pick(k, "path").alias(k) for k in kinds), pick("url", "text").alias("url_text"), pick("label", "text").alias("label_text"))
    label = F.when(F.upper(F.substring("rec_id", 1, 1)) == "L", 0).when(F.upper(F.substring("rec_id", 1, 1)) == "P", 1)
    reason = F.coalesce(*(F.when(F.col(k).isNull(), F.lit(f"missing_{k}")) for k in kinds), F.when(label.isNull(), F.lit("invalid_sample_name")), F.lit("written"))
    s = s.withColumn("reason", reason)
    clean = lambda c: strip(F.replace(F.replace(F.col(c), F.lit("﻿"), F.lit("")), F.lit("ï»¿"), F.lit("")))
    rows = s.where("reason = 'written'").select("rec_id", "split", clean("url_text").alias("url"), F.col("html").alias("html_file"), F.col("screenshot").alias("screenshot_file"), label.alias("label"), clean("label_text").alias("target_brand"), F.lit("directory").alias("source"))
    return rows, s.groupBy("reason").agg(F.count("*").alias("n"))


def with_payloads(index: DataFrame, files: DataFrame, split: str | None = None, html_chars: int = 2000) -> DataFrame:
    """SRC8, J12: index rows whose pages and screenshots are there, with the page's start; a label other than 0 or 1 raises."""
    rows = index.where(F.col("split") == split) if split else index
    rows = rows.where("coalesce(url, '') <> '' and coalesce(cast(label as string), '') <> ''")
    y = F.trim(F.col("label").cast("string"))
    rows = rows.withColumn("label", F.when(y.isin("0", "1"), y.cast("int")).otherwise(F.raise_error(F.concat(F.lit("label isn't 0 or 1: "), y)).cast("int")))
    pages = files.select(F.col("path").alias("html_file"), F.decode("content", "UTF-8").alias("html"))
    if "screenshot_file" in rows.columns:
        rows = rows.join(files.select(F.col("path").alias("screenshot_file")).distinct(), "screenshot_file", "left_semi")
    return rows.join(pages, "html_file").withColumn("html", F.substring("html", 1, html_chars))


def external_batch(spark: SparkSession, root: str, balanced: bool = True, html_chars: int = 2000) -> DataFrame:
    """SRC9: the samples of a collected batch: (sample_id, url, html, screenshot_file, label, source, domain), in order of sample_id.

    The gates, each of which raises: ``dataset_summary.json`` says role external_test_only and complete; every row of ``collection_results.csv``
    has its five files and the label of its file; labels are balanced. Screenshots are only listed, not read.
    """
    summary = spark.read.text(f"{root}/dataset_summary.json", wholetext=True).select(F.get_json_object("value", "$.dataset_role").alias("role"), F.get_json_object("value", "$.complete").alias("complete")).first()
    if summary is None or summary.role != "external_test_only":
        raise ValueError("the batch isn't marked external_test_only")
    if summary.complete != "true":
        raise ValueError("the batch isn't marked complete")
    index = require(spark.read.options(header=True, **CSV).csv(f"{root}/collection_results.csv"), ["sample_id", "label"])
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in index.columns else F.lit("")
    index = index.select("sample_id", F.col("label").alias("told"), text("source").alias("source"), text("domain").alias("domain"))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    get = lambda k: F.regexp_extract("path", r"/([^/]+)/(URL|RAW-HTML|SCREEN-SHOT|Label)/([^/]+)$", k)
    base = F.substring_index(get(1), "_", 1)
    named = get(3) == F.concat(base, F.when(get(2) == "RAW-HTML", ".html").when(get(2) == "SCREEN-SHOT", ".png").otherwise(".txt"))
    texts = files.option("pathGlobFilter", "*.{txt,html}").load(root).where(named).select(get(1).alias("id"), get(2).alias("kind"), "path", F.decode("content", "UTF-8").alias("text"))
    shots = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(root).where(named).select(get(1).alias("id"), get(2).alias("kind"), "path", F.lit(None).cast("string").alias("text"))
    meta = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json").load(root).select(F.regexp_extract("path", "/([^/]+)/metadata[.]json$", 1).alias("id"), F.lit("metadata").alias("kind"), "path", F.lit(None).cast("string").alias("text"))
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    s = texts.unionByName(shots).unionByName(meta).groupBy("id").agg(F.count_distinct("kind").alias("kinds"), of("URL", "text").alias("url"), of("RAW-HTML", "text").alias("html"), of("SCREEN-SHOT", "path").alias("screenshot_file"), of("Label", "text").alias("label_text"))
    out = index.join(s, F.col("sample_id") == F.col("id"), "left")
    whole = F.when(F.col("kinds") == 5, F.col("sample_id")).otherwise(F.raise_error(F.concat(F.lit("files are missing of "), F.col("sample_id"))))
    label = F.trim(without_bom(F.regexp_replace("label_text", r"\s+$", "")))
    same = F.when(label.isin("0", "1") & (label == F.trim("told")), label.cast("int")).otherwise(F.raise_error(F.concat(F.lit("labels disagree of "), F.col("sample_id"))).cast("int"))
    page = F.substring("html", 1, html_chars) if html_chars > 0 else F.col("html")
    out = out.select(whole.alias("sample_id"), strip(without_bom(F.col("url"))).alias("url"), page.alias("html"), "screenshot_file", same.alias("label"), "source", "domain")
    if balanced:
        counts = out.groupBy("label").count().agg(F.min("count").alias("a"), F.max("count").alias("b"), F.count("*").alias("k"))
        ok = F.assert_true((F.col("k") == 2) & (F.col("a") == F.col("b")), F.lit("labels aren't balanced"))
        out = out.crossJoin(F.broadcast(counts.select(ok.alias("_ok")))).where("_ok is null").drop("_ok")
    return out.orderBy("sample_id")


def resume(spark: SparkSession, accepted: DataFrame, rejected: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """SRC17, ST2: what a stopped collection left: accepted samples with all 5 files, used numbers, attempted keys."""
    whole = files.groupBy("sample_id").agg(F.count_distinct("kind").alias("n")).where("n >= 5").select("sample_id")
    ok = accepted.join(whole, "sample_id", "left_semi")
    number = F.regexp_extract("sample_id", "^[LP]([0-9]+)_", 1)
    used = ok.where(number != "").select("label", number.cast("bigint").alias("number"))
    keys = ok.select(F.col("normalized_original_url").alias("url"), "label").unionByName(rejected.where("coalesce(normalized_url, '') <> '' and mapped_label is not null").select(F.col("normalized_url").alias("url"), F.col("mapped_label").alias("label"))).distinct()
    return {"accepted": ok, "used": used, "attempted": keys, "counts": ok.groupBy("label").agg(F.count("*").alias("n"))}

