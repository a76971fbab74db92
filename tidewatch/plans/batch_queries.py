"""Queries of the collection side: candidates, rejections, leakage, near duplicates, ids, samples, admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, image, lists, text, url
from ..operators import admission, artefacts, dedup, hamming, leakage, metrics, scoring
from ..operators import leakage_store as leakage_tables
from ..sources import shared
from ..streaming import admission as stream_admission
from . import url_queries
from .views import WITH_PAGES, pages_x, shaped, table


def rows(s: SparkSession, d: str) -> DataFrame:
    """Pages with a valid normalised URL, in order."""
    return pages_x(s, d).withColumn("n", url.normalise(F.col("url"))).where("n.error is null").select("page_id", F.col("n.url").alias("url"), "label", F.col("page_id").alias("ord"))


def seen(s, d):
    return rows(s, d).where("page_id % 7 = 0").select("url")


def seen_anti_join(s, d):
    return rows(s, d).join(seen(s, d).distinct(), "url", "left_anti").select("page_id", "url")


def batch_dedup(s, d):
    return dedup.against_seen(rows(s, d), seen(s, d)).select("page_id", "outcome")


def candidate_stats(s, d):
    return dedup.against_seen(rows(s, d), seen(s, d)).groupBy("outcome").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("phishing"), F.count_if(F.col("label") == 0).alias("legitimate"))


def conflicting_label(s, d):
    return dedup.conflicting_labels(rows(s, d)).select("page_id", "outcome")


def label_map(s, d):
    raw = F.element_at(F.array(*(F.lit(x) for x in (" Legit", "PHISH", "1", "0", "unknown", "", "Benign ", "malicious"))), (F.col("doc_id") % 8 + 1).cast("int"))
    y = text.label_of(raw)
    return table(s, d, "documents").select("doc_id", y.alias("label"), F.when(y.isNull(), F.concat(F.lit("unmapped_label:"), raw)).alias("reason"))


def label_counts(s, d):
    return table(s, d, "documents").join(table(s, d, "labels"), "doc_id").groupBy("source", "quality").agg(F.count("*").alias("n"))


def reject_reason(s, d):
    p = pages_x(s, d).withColumn("_f", url.normalise(F.col("url")))
    reason = F.coalesce(admission.stateless_reason(F.col("_f.error")), admission.stateless_reason(F.col("_f.error"), before=False))
    return p.select("page_id", reason.alias("reason")).where("reason is not null")


def merge_rejections(s, d):
    r = reject_reason(s, d)
    old = r.where("page_id % 2 = 0")
    new = r.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") - F.col("page_id") % 2)
    return dedup.merge_new(old, new.withColumn("reason", F.upper("reason")).unionByName(old), ["page_id", "reason"], "page_id").select("page_id", "reason")


def build_candidates(s, d):
    r = rows(s, d).select("url", "label", F.col("page_id").alias("n"))
    return dedup.build_candidates(r.where("label = 1").withColumn("source", F.lit("feed")), r.where("label = 0").withColumn("source", F.lit("tranco")), seen(s, d), 40, 60)


def corpus(s, d):
    """All pages as a training corpus."""
    return _corpus(pages_x(s, d))


def _corpus(pages):
    return pages.select("url", "html", "label", F.when(F.col("page_id") % 2 == 0, "trainval").otherwise("test").alias("split"))


def leakage_index(s, d):
    return leakage.index(corpus(s, d))


def leakage_stats(s, d):
    return leakage.stats(corpus(s, d))


def leakage_cache(s, d):
    """The index through its JSON form and back."""
    c = corpus(s, d)
    return leakage.from_json(leakage.as_json(leakage.index(c), leakage.stats(c)))


def _probed(s, d):
    p = pages_x(s, d).where("page_id % 3 <> 0").withColumn("n", url.normalise(F.col("url")))
    return p.select("page_id", F.col("n.url").alias("url"), html.fingerprint(F.col("html")).alias("html_hash"), url.hostname(F.col("n.url")).alias("domain"), "label")


def leakage_probe(s, d):
    return leakage.probe(_probed(s, d), leakage.index(_corpus(pages_x(s, d).where("page_id % 3 = 0")))).select("page_id", "in_url", "in_html_hash", "in_phishing_domain")


def leakage_store(s, d):
    """The same probe against a store that the corpus was added to in two batches, the second of which repeats keys of the first."""
    root = shared.new_path(s, "leakage-store")
    third = leakage.index(_corpus(pages_x(s, d).where("page_id % 3 = 0")))
    first = leakage.index(_corpus(pages_x(s, d).where("page_id % 6 = 0")))
    leakage_tables.add(first, root, 0)
    leakage_tables.add(third, root, 1)
    return leakage_tables.probe(_probed(s, d), root).select("page_id", "in_url", "in_html_hash", "in_phishing_domain")


def duplicate_texts(s, d):
    """Documents whose text an earlier one has, with that one."""
    t = table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = t.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return t.join(first, "h").where("doc_id > first").select("doc_id", "first")


def hashes(s, d):
    """Sign hashes of the embeddings, and copies with their first 0 to 8 bits flipped."""
    h = table(s, d, "embeddings").select("vec_id", hamming.sign_hash(F.col("embedding")).alias("h"))
    k = (F.col("vec_id") % 9).cast("int")
    mask = F.when(k == 0, F.lit(0).cast("bigint")).otherwise(F.lit(-1).cast("bigint"))
    flips = sum((F.when(k > i, F.shiftleft(F.lit(1).cast("bigint"), 63 - i)).otherwise(F.lit(0).cast("bigint")) for i in range(8)), F.lit(0).cast("bigint"))
    return h, h.select((F.col("vec_id") + 1_000_000).alias("vec_id"), F.col("h").bitwiseXOR(F.when(mask == 0, F.lit(0).cast("bigint")).otherwise(flips)).alias("h"))


def hamming_pairs(s, d):
    h, c = hashes(s, d)
    return hamming.near_pairs(h.select(F.col("vec_id").alias("a"), F.col("h").alias("ha")), c.select(F.col("vec_id").alias("b"), F.col("h").alias("hb")))


def hash_hex(s, d):
    h, _ = hashes(s, d)
    x = hamming.to_hex(F.col("h"))
    return h.select("vec_id", x.alias("hex"), F.bit_count("h").cast("bigint").alias("ones"), (hamming.from_hex(x) == F.col("h")).cast("int").alias("same"))


def sample_ids(s, d):
    o = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select("doc_id", (1 - F.col("quality")).alias("label"))
    used = o.where("doc_id % 5 = 0 and doc_id > 0").select("label", F.col("doc_id").alias("number"))
    return dedup.sample_ids(o.where("doc_id % 5 <> 0").withColumn("ord", F.col("doc_id")), used).select("doc_id", "label", "number", "sample_id")


def stratified_split(s, d):
    return dedup.stratified(table(s, d, "labels"), "quality", "doc_id", 0.15).select("doc_id", "quality", "split")


def stratified_counts(s, d):
    return dedup.stratified(table(s, d, "labels"), "quality", "doc_id", 0.15).groupBy("quality", "split").agg(F.count("*").alias("n"))


def scan_reasons(s, d):
    p = pages_x(s, d)
    reason = F.when(F.coalesce("url", F.lit("")) == "", "missing_url").when(F.col("html") == "", "missing_html").when(F.col("status") == 404, "missing_screenshot").otherwise("written")
    return p.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


QUOTAS = {0: 60, 1: 30}


def captures(s, d):
    """All pages as captures in order; screenshots are hashes of 97 vectors, of which later pages have copies with 0 to 8 bits flipped."""
    return captured(pages_x(s, d), table(s, d, "embeddings"))


def captured(pages, embeddings):
    p = pages.withColumn("vec_id", F.col("page_id") % 97)
    h = embeddings.select("vec_id", hamming.sign_hash(F.col("embedding")).alias("h"))
    bit = lambda i: F.when((F.col("page_id") / 97).cast("bigint") % 9 > i, F.shiftleft(F.lit(1).cast("bigint"), 63 - i)).otherwise(F.lit(0).cast("bigint"))
    flips = sum((bit(i) for i in range(8)), F.lit(0).cast("bigint"))
    return p.join(h, "vec_id", "left").select(F.col("page_id").alias("ord"), "label", "url", F.col("url").alias("final_url"), "html", "status", "content_type", F.col("h").bitwiseXOR(flips).alias("dhash"))


def admitted(s, d):
    return admission.admit(admission.prepared(captures(s, d)), QUOTAS)


def stream_admitted(s, d):
    """The same from a stream of the pages' file, with its state in tables."""
    to = shared.new_path(s, "admission")
    pages = s.readStream.schema(table(s, d, "pages").schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/[p]ages.parquet")
    stream_admission.run(admission.prepared(captured(shaped(pages), table(s, d, "embeddings"))), f"{to}/state", f"{to}/checkpoint", QUOTAS)
    return stream_admission.outcomes(s, f"{to}/state").select("ord", "label", "outcome")


def admission_outcomes(s, d):
    return admitted(s, d).groupBy("label", "outcome").agg(F.count("*").alias("n"))


def model_texts(pages):
    """ML7, ML9: what text models read of a page: the normalised text of its URL, and the tokens of its start."""
    start = text.trimmed(F.col("html"), scoring.HTML_CHARS)
    return pages.withColumns({"url_text": text.normalise(F.col("url")), "page_text": html.html_text()(start)})


def model_encodings(s, d):
    """The encoded inputs of URL models: how many characters they take and their sum."""
    ids = text.char_encode(text.normalise(F.col("url")), scoring.URL_CHARS, scoring.URL_VOCABULARY)
    p = pages_x(s, d).select("page_id", ids.alias("ids"))
    return p.select("page_id", F.size(F.filter("ids", lambda x: x > 0)).cast("bigint").alias("n"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


def screenshots(s, d):
    """I3, AG16: the checks of gray images made of the vectors, some of them missing, small or of one colour."""
    k, rows, columns = F.col("vec_id") % 5, F.when(F.col("vec_id") % 5 == 0, 40).otherwise(64), 72
    value = lambda i: F.pmod(F.floor(F.abs(F.get("embedding", (((i / columns).cast("int") * 7 + i % columns) % 64).cast("int")).cast("double")) * 1000) + i, F.lit(256))
    pixel = lambda i: F.lpad(F.hex(F.when(k == 1, F.lit(120).cast("bigint")).otherwise(value(i)).cast("bigint")), 2, "0")
    data = F.when(k != 2, F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), rows * columns - 1), pixel), "")))
    shot = F.struct(rows.alias("height"), F.lit(columns).alias("width"), F.lit(1).alias("nChannels"), data.alias("data"))
    found = table(s, d, "embeddings").select("vec_id", shot.alias("image")).select("vec_id", image.inspected()(F.col("image")).alias("r"))
    return found.select("vec_id", "r.error", "r.width", "r.height", F.round("r.deviation", 6).alias("deviation"), F.col("r.dhash").isNotNull().cast("int").alias("hashed"))


def neural_scores(s, d):
    """All six networks with seeded weights over the pages' URLs, markup and images made of their embeddings; blank images without one.

    What is dealt and joined are the starts of pages and the vectors; images exist only in the short batches that go to the networks.
    """
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("page_id"), "embedding")
    p = pages_x(s, d).select("page_id", "url", text.trimmed(F.col("html"), scoring.HTML_CHARS).alias("html")).repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "page_id").join(e, "page_id", "left")
    p = model_texts(p).select("page_id", "embedding", text.char_encode(F.col("url_text"), scoring.URL_CHARS, scoring.URL_VOCABULARY).alias("u"), text.char_encode(F.col("page_text"), scoring.HTML_CHARS, scoring.HTML_VOCABULARY).alias("h"))
    image = F.flatten(F.array_repeat(F.col("embedding").cast("array<float>"), 3 * scoring.IMAGE))
    blank = F.array_repeat(F.lit(0.0).cast("float"), 3 * scoring.IMAGE * scoring.IMAGE)
    scores = scoring.scorers(scoring.selected(), s)(url=F.col("u"), html=F.col("h"), screenshot=F.coalesce(image, blank))
    return p.select("page_id", scores.alias("s")).select("page_id", "s.*")


def logistic_scores(s, d):
    """A logistic regression on the 35 features."""
    f = url_queries.featured(s, d)
    model = scoring.train_logistic(f, [*url.URL_FEATURES, *html.HTML_FEATURES])
    return model.transform(f).select("page_id", "label", F.col("predicted").cast("int").alias("predicted"))


def artefact_scores(s, d):
    """Two kinds of models, each with a threshold of its validation rows, saved, loaded again and compared by what they say of every page."""
    f = url_queries.featured(s, d)
    names = [*url.URL_FEATURES, *html.HTML_FEATURES]
    f = shared.written(f.select("page_id", "label", *names), "features")
    loaded = {}
    for kind, grid in (("logistic", {"regParam": [1e-3, 1e-1]}), ("forest", {"maxDepth": [5]})):
        to = shared.new_path(s, f"artefact-{kind}")
        artefacts.save(artefacts.trained(f, names, kind, grid=grid), to)
        loaded[kind] = artefacts.load(s, to)
    return artefacts.score_all(loaded, f, "page_id", "label").withColumn("p", F.round("p", 9))


# ---- SQL
_N = url_queries.normalise_sql(True)
NORMAL = f"normal AS ({_N})"
ROWS = f"WITH {NORMAL}, rows_ AS (SELECT n.page_id, n.url, CASE WHEN n.page_id % 3 = 0 THEN 1 ELSE 0 END AS label FROM normal n WHERE error IS NULL), seen AS (SELECT DISTINCT url FROM rows_ WHERE page_id % 7 = 0)"
OUTCOMES = f"{ROWS}, outcomes AS (SELECT page_id, label, CASE WHEN url IN (SELECT url FROM seen) THEN 'duplicate_seen' WHEN row_number() OVER (PARTITION BY url ORDER BY page_id) > 1 THEN 'duplicate_batch' ELSE 'accepted' END AS outcome FROM rows_)"
RAW = "[' Legit', 'PHISH', '1', '0', 'unknown', '', 'Benign ', 'malicious'][CAST(doc_id % 8 + 1 AS INT)]"
quoted = url_queries.quoted
inlist = lambda xs: ", ".join(quoted(x) for x in xs)
SIGNATURE = "coalesce(" + ", ".join(f"CASE WHEN contains({url_queries.COLLAPSED}, {quoted(x)}) THEN {quoted(x)} END" for x in lists.ERROR_SIGNATURES) + ")"
REASON = f"""WITH {NORMAL}, {WITH_PAGES}, reasons AS (SELECT p.page_id, coalesce(n.error, CASE WHEN status >= 400 THEN concat('http_status_', CAST(status AS STRING)) END, CASE WHEN NOT contains(lower(content_type), 'html') THEN 'non_html_content_type' END,
  CASE WHEN length(html) < 100 THEN 'html_too_short' END, CASE WHEN {SIGNATURE} IS NOT NULL THEN concat('error_page:', {SIGNATURE}) END) AS reason FROM pages_x p JOIN normal n USING (page_id))"""
CORPUS = f"WITH {NORMAL}, {WITH_PAGES}, corpus AS (SELECT p.page_id, n.url, html, label, CASE WHEN p.page_id % 2 = 0 THEN 'trainval' ELSE 'test' END AS split FROM pages_x p JOIN normal n USING (page_id))"
THIRD = lambda sql: sql.replace("JOIN normal n USING (page_id))", "JOIN normal n USING (page_id) WHERE p.page_id % 3 = 0)")
DOMAIN = "regexp_extract(url, '^https?://([^/:?]*)', 1)"
INDEX = f"{CORPUS}, idx AS (SELECT 'url' AS kind, url AS key FROM corpus WHERE url IS NOT NULL UNION SELECT 'html_hash', sha256({url_queries.CANONICAL}) FROM corpus UNION SELECT 'phishing_domain', {DOMAIN} FROM corpus WHERE url IS NOT NULL AND label = 1 AND split = 'trainval')"
BITS = "bits AS (SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS b FROM embeddings)"
#: The fold, row by row: what accepted rows hold, what is left of the quotas, the outcome of the row.
ADMITTED = f"""{REASON.replace("WITH ", "WITH RECURSIVE ", 1)}, {BITS},
shots AS (SELECT p.page_id, concat(translate(substring(b, 1, k), '01', '10'), substring(b, k + 1)) AS shot FROM (SELECT page_id, CAST(page_id // 97 % 9 AS INT) AS k FROM pages_x) p JOIN bits ON vec_id = p.page_id % 97),
c AS (SELECT p.page_id AS ord, label, n.url, sha256({url_queries.CANONICAL}) AS page, shot, reason FROM pages_x p JOIN normal n USING (page_id) JOIN reasons USING (page_id) LEFT JOIN shots USING (page_id) WHERE n.url IS NOT NULL),
r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ord) AS i FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY url, label ORDER BY ord) = 1)),
f AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS INTEGER) AS label, '' AS outcome, CAST([] AS STRING[]) AS urls, CAST([] AS STRING[]) AS pages, CAST([] AS STRING[]) AS shots, {QUOTAS[0]} AS left0, {QUOTAS[1]} AS left1
  UNION ALL SELECT i, ord, label, outcome, CASE WHEN ok THEN list_append(urls, url) ELSE urls END, CASE WHEN ok THEN list_append(pages, page) ELSE pages END, CASE WHEN ok AND shot IS NOT NULL THEN list_append(shots, shot) ELSE shots END, left0 - CASE WHEN ok AND label = 0 THEN 1 ELSE 0 END, left1 - CASE WHEN ok AND label = 1 THEN 1 ELSE 0 END
  FROM (SELECT *, outcome = 'accepted' AS ok FROM (SELECT r.i, r.ord, r.label, r.url, r.page, r.shot, f.urls, f.pages, f.shots, f.left0, f.left1,
    CASE WHEN CASE r.label WHEN 0 THEN f.left0 ELSE f.left1 END <= 0 THEN 'skipped' WHEN list_contains(f.urls, r.url) THEN 'duplicate_original_url' WHEN r.reason IS NOT NULL THEN r.reason WHEN list_contains(f.pages, r.page) THEN 'duplicate_html'
      WHEN len(list_filter(f.shots, lambda x: hamming(x, r.shot) <= 5)) > 0 THEN 'duplicate_screenshot' ELSE 'accepted' END AS outcome FROM f JOIN r ON r.i = f.i + 1 WHERE f.left0 > 0 OR f.left1 > 0)))"""
LABELLED = "o AS (SELECT doc_id, 1 - quality AS label FROM documents JOIN labels USING (doc_id))"
LEAKAGE_PROBE = f"""{THIRD(INDEX)}, batch AS (SELECT p.page_id, n.url, sha256({url_queries.CANONICAL}) AS h FROM pages_x p JOIN normal n USING (page_id) WHERE p.page_id % 3 <> 0)
SELECT page_id, CAST(EXISTS (SELECT 1 FROM idx WHERE kind = 'url' AND key = url) AS INT) AS in_url, CAST(EXISTS (SELECT 1 FROM idx WHERE kind = 'html_hash' AND key = h) AS INT) AS in_html_hash, CAST(EXISTS (SELECT 1 FROM idx WHERE kind = 'phishing_domain' AND key = {DOMAIN}) AS INT) AS in_phishing_domain FROM batch"""
SQL = {
    "seen_anti_join": f"{ROWS} SELECT page_id, url FROM rows_ WHERE url NOT IN (SELECT url FROM seen)",
    "batch_dedup": f"{OUTCOMES} SELECT page_id, outcome FROM outcomes",
    "candidate_stats": f"{OUTCOMES} SELECT outcome, count(*) AS n, count_if(label = 1) AS phishing, count_if(label = 0) AS legitimate FROM outcomes GROUP BY outcome",
    "conflicting_label": f"{ROWS} SELECT page_id, CASE WHEN row_number() OVER w = 1 THEN 'accepted' WHEN label = first_value(label) OVER w THEN 'duplicate_input_url' ELSE 'conflicting_input_label' END AS outcome FROM rows_ WINDOW w AS (PARTITION BY url ORDER BY page_id)",
    "label_map": f"WITH r AS (SELECT doc_id, {RAW} AS raw FROM documents), y AS (SELECT *, CASE WHEN lower(trim(raw)) IN ({inlist(lists.LEGITIMATE)}) THEN 0 WHEN lower(trim(raw)) IN ({inlist(lists.PHISHING)}) THEN 1 END AS label FROM r) SELECT doc_id, label, CASE WHEN label IS NULL THEN concat('unmapped_label:', raw) END AS reason FROM y",
    "label_counts": "SELECT source, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL",
    "reject_reason": f"{REASON} SELECT * FROM reasons WHERE reason IS NOT NULL",
    "merge_rejections": f"{REASON}, r AS (SELECT * FROM reasons WHERE reason IS NOT NULL), old AS (SELECT * FROM r WHERE page_id % 2 = 0), new AS (SELECT DISTINCT page_id - page_id % 2 AS page_id, upper(reason) AS reason FROM r WHERE page_id % 3 = 0) SELECT * FROM old UNION ALL SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.page_id = n.page_id AND o.reason = n.reason)",
    "build_candidates": f"""{ROWS}, pool AS (SELECT url, label, page_id AS n, md5(concat('42:', url, '|', CAST(page_id AS STRING))) AS o FROM rows_),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY o, n) AS k FROM pool) WHERE k <= CASE WHEN label = 1 THEN 40 ELSE 60 END)
SELECT url, label, CASE WHEN label = 1 THEN 'feed' ELSE 'tranco' END AS source, CASE WHEN url IN (SELECT url FROM seen) THEN 'duplicate_seen' WHEN row_number() OVER (PARTITION BY url ORDER BY label DESC, o, n) > 1 THEN 'duplicate_batch' ELSE 'accepted' END AS outcome FROM capped""",
    "leakage_index": f"{INDEX} SELECT * FROM idx",
    "leakage_cache": f"{INDEX} SELECT * FROM idx",
    "leakage_stats": f"{CORPUS} SELECT CASE WHEN url IS NULL THEN 'url_errors' ELSE 'urls' END AS stat, count(*) AS n FROM corpus GROUP BY 1 UNION ALL SELECT 'html', count(*) FROM corpus",
    "leakage_probe": LEAKAGE_PROBE,
    "leakage_store": LEAKAGE_PROBE,
    "duplicate_texts": "SELECT * FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) WHERE doc_id > first",
    "hamming_pairs": f"WITH {BITS}, copies AS (SELECT vec_id + 1000000 AS vec_id, concat(translate(substring(b, 1, CAST(vec_id % 9 AS INT)), '01', '10'), substring(b, CAST(vec_id % 9 AS INT) + 1)) AS b FROM bits) SELECT x.vec_id AS a, y.vec_id AS b, hamming(x.b, y.b) AS distance FROM bits x, copies y WHERE hamming(x.b, y.b) <= 5",
    "hash_hex": f"WITH {BITS} SELECT vec_id, array_to_string(list_transform(range(0, 16), lambda i: substring('0123456789abcdef', CAST(8 * CAST(b[4 * i + 1] AS INT) + 4 * CAST(b[4 * i + 2] AS INT) + 2 * CAST(b[4 * i + 3] AS INT) + CAST(b[4 * i + 4] AS INT) + 1 AS BIGINT), 1)), '') AS hex, CAST(length(replace(b, '0', '')) AS BIGINT) AS ones, 1 AS same FROM bits",
    "sample_ids": f"""WITH {LABELLED}, used AS (SELECT label, doc_id AS number FROM o WHERE doc_id % 5 = 0 AND doc_id > 0), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS k FROM o WHERE doc_id % 5 <> 0),
free AS (SELECT label, i AS number, row_number() OVER (PARTITION BY label ORDER BY i) AS k FROM (SELECT DISTINCT label FROM o), range(1, 2 * (SELECT max(doc_id) + 2 FROM o)) t(i) WHERE (label, i) NOT IN (SELECT (label, number) FROM used))
SELECT doc_id, r.label, number, concat(CASE WHEN r.label = 0 THEN 'L' ELSE 'P' END, printf('%05d', number), CASE WHEN r.label = 0 THEN '_legitimate' ELSE '_phishing' END) AS sample_id FROM r JOIN free USING (label, k)""",
    "stratified_split": "SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY md5(concat('42:', CAST(doc_id AS STRING))), doc_id) <= floor(count(*) OVER (PARTITION BY quality) * 15e-2 + 5e-1) THEN 'val' ELSE 'train' END AS split FROM labels",
    "stratified_counts": "WITH n AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1) SELECT quality, 'val' AS split, CAST(floor(n * 15e-2 + 5e-1) AS BIGINT) AS n FROM n UNION ALL SELECT quality, 'train', n - CAST(floor(n * 15e-2 + 5e-1) AS BIGINT) FROM n",
    "admitted": f"{ADMITTED} SELECT ord, label, outcome FROM f WHERE ord IS NOT NULL AND outcome <> 'skipped'",
    "stream_admitted": f"{ADMITTED} SELECT ord, label, outcome FROM f WHERE ord IS NOT NULL AND outcome <> 'skipped'",
    "admission_outcomes": f"{ADMITTED} SELECT label, outcome, count(*) AS n FROM f WHERE ord IS NOT NULL AND outcome <> 'skipped' GROUP BY label, outcome",
    "model_encodings": f"WITH {WITH_PAGES}, t AS (SELECT page_id, substring({url_queries.NORMAL('url')}, 1, {scoring.URL_CHARS}) AS u FROM pages_x) SELECT page_id, length(u) AS n, CAST(coalesce(list_sum(list_transform(list_filter(string_split(u, ''), lambda c: c <> ''), lambda c: least(ord(c), {scoring.URL_VOCABULARY - 1}))), 0) AS BIGINT) AS total FROM t",
    "screenshots": """WITH v AS (SELECT vec_id, vec_id % 5 AS k, CASE WHEN vec_id % 5 = 0 THEN 40 ELSE 64 END AS height, embedding FROM embeddings),
p AS (SELECT vec_id, stddev_pop(CASE WHEN k = 1 THEN 120 ELSE (CAST(floor(abs(CAST(embedding[((i // 72) * 7 + i % 72) % 64 + 1] AS DOUBLE)) * 1000) AS BIGINT) + i) % 256 END) AS deviation FROM v, range(0, 4608) t(i) WHERE k NOT IN (0, 2) GROUP BY vec_id)
SELECT vec_id, CASE k WHEN 2 THEN 'invalid_screenshot' WHEN 0 THEN 'screenshot_too_small' WHEN 1 THEN 'blank_or_monochrome_screenshot' END AS error, CASE WHEN k <> 2 THEN 72 END AS width, CASE WHEN k <> 2 THEN height END AS height, round(deviation, 6) AS deviation, CAST(k > 2 AS INT) AS hashed FROM v LEFT JOIN p USING (vec_id)""",
    "scan_reasons": f"WITH {WITH_PAGES} SELECT CASE WHEN url = '' THEN 'missing_url' WHEN html = '' THEN 'missing_html' WHEN status = 404 THEN 'missing_screenshot' ELSE 'written' END AS reason, count(*) AS n FROM pages_x GROUP BY 1",
}

_FUNCTIONS = (seen_anti_join, batch_dedup, candidate_stats, conflicting_label, label_map, label_counts, reject_reason, merge_rejections, build_candidates, leakage_index, leakage_stats, leakage_cache, leakage_probe, leakage_store, duplicate_texts, hamming_pairs, hash_hex, sample_ids, stratified_split, stratified_counts, scan_reasons, model_encodings, screenshots, admitted, stream_admitted, admission_outcomes, neural_scores, logistic_scores, artefact_scores)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
