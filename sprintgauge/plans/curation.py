"""Registered queries: scans, filters, text functions and statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.html import html_to_text
from ..functions.language import detect_language
from ..operators import curate as ops, stats
from ..session import staging_root
from ..sources import projects
from ..sources.tables import requirements, table
from . import base, oracles as o

RAW = ["dataset_name", "row_ord", "issuekey", "title", "description", "storypoint"]


def _raw(spark, sf_dir):
    return requirements(spark, sf_dir).select(*RAW)


def _documents(spark, sf_dir, **columns):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", *[c.alias(n) for n, c in columns.items()])


def _pages(spark, sf_dir, column):
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return pages.select("page_id", column.alias("plain"))


def _export(rows, root):
    """Each project of ``rows`` as a folder of CSV part files under ``root``."""
    (rows.write.mode("append").partitionBy("dataset_name")
     .option("header", True).option("quote", '"').option("escape", '"')
     .option("emptyValue", "").option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(root))


def _exported(spark, *tables):
    root = f"{staging_root(spark)}/exports-{uuid.uuid4().hex}"
    for rows in tables:
        _export(rows, root)
    return root


def _scan(spark, sf_dir):
    """Export every project as CSV, then scan the exports by header."""
    root = _exported(spark, _raw(spark, sf_dir).drop("row_ord"))
    return projects.scan_requirements(spark, root, excluded=()).drop("row_ord")


def _retrieval_corpus(spark, sf_dir):
    root = _exported(spark, _raw(spark, sf_dir).drop("row_ord"))
    return projects.retrieval_corpus(spark, root).withColumn("storypoint", F.col("storypoint").cast("double"))


def _treated_exports(spark, sf_dir):
    """Treated exports in two layouts: every other project lacks the key column."""
    rows = base.curated(spark, sf_dir).select(
        "dataset_name", "issuekey", "treated_description_bert", "storypoint")
    keyless = F.crc32(F.col("dataset_name")) % 2 == 0
    return _exported(spark, rows.filter(~keyless), rows.filter(keyless).drop("issuekey"))


def _mlm_corpus(spark, sf_dir):
    return projects.language_corpus(spark, _treated_exports(spark, sf_dir))


def _union(spark, sf_dir):
    """The layouts are united by column name; what one lacks is NULL."""
    rows = projects.scan_columns(
        spark, _treated_exports(spark, sf_dir), ["treated_description_bert", "storypoint"], ["issuekey"])
    return rows.select(F.col("treated_description_bert").alias("text"), F.col("storypoint").cast("double"))


QUERIES = {
    "dataset_stats": lambda s, d: stats.dataset_stats(base.curated(s, d)),
    "point_distribution": lambda s, d: stats.point_distribution(base.curated(s, d)),
    "fibonacci_distribution": lambda s, d: stats.fibonacci_distribution(requirements(s, d)),
    "scan_requirements": _scan,
    "exclude_dataset": lambda s, d: ops.exclude_datasets(_raw(s, d)),
    "filter_valid_points": lambda s, d: ops.filter_valid_points(_raw(s, d)),
    "filter_cap": lambda s, d: ops.filter_cap(_raw(s, d)),
    "filter_nonblank": lambda s, d: ops.filter_nonblank(_raw(s, d)),
    "filter_language": lambda s, d: ops.filter_language(
        _raw(s, d)).select("dataset_name", "row_ord", "issuekey"),
    "filter_iqr": lambda s, d: ops.filter_iqr(
        ops.filter_valid_points(requirements(s, d).select(
            "dataset_name", "row_ord", "issuekey", "storypoint"))),
    "concat_title": lambda s, d: ops.concat_title(_raw(s, d).filter("description IS NOT NULL"))
    .select("dataset_name", "row_ord", "description"),
    "dedup_first": base.first_copies,
    "uniform_cap": lambda s, d: ops.uniform_cap(
        base.staged_once(s, d, "first_copies", lambda: base.first_copies(s, d))),
    "limit_per_dataset": lambda s, d: ops.limit_per_dataset(
        base.staged_once(s, d, "first_copies", lambda: base.first_copies(s, d)), 50),
    "union_datasets": _union,
    "mlm_corpus": _mlm_corpus,
    "retrieval_corpus": _retrieval_corpus,
    "with_defaults": lambda s, d: projects.with_defaults(
        _raw(s, d).select("dataset_name", "row_ord", "storypoint")),
    "curate_view": lambda s, d: ops.treat(
        base.curated(s, d).select(*ops.CURATED_COLUMNS), view="ml"),
    "treat_ml": lambda s, d: base.curated(s, d).select(
        "dataset_name", "issuekey", "treated_description_ml"),
    "treat_bert": lambda s, d: base.curated(s, d).select(
        "dataset_name", "issuekey", "treated_description_bert"),
    "clean_ascii": lambda s, d: _documents(s, d, cleaned=tx.clean_ascii(F.col("text"))),
    "strip_tags": lambda s, d: _pages(s, d, tx.strip_tags(F.col("html"))),
    "html_to_text": lambda s, d: _pages(s, d, html_to_text(F.col("html"))),
    "detect_language": lambda s, d: _documents(s, d, language=detect_language(F.col("text"))),
    "sentence_count": lambda s, d: _documents(s, d, sentences=tx.sentence_count(F.col("text"))),
    "word_count": lambda s, d: _documents(s, d, words=tx.word_count(F.col("text"))),
    "tokenize": lambda s, d: _documents(s, d, tokens=F.array_join(tx.tokenize(F.col("text")), " ")),
}

_RAW = ", ".join(RAW)
_PAGE_TEXT = o.no_tags("html")
for _entity, _char in [("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;?", "&")]:
    _PAGE_TEXT = f"regexp_replace({_PAGE_TEXT}, '{_entity}', '{_char}', 'g')"

ORACLES = {
    "dataset_stats": o.with_blocks(["capped"], f"""
SELECT dataset_name, count(*) AS n_rows, round(avg(words), 6) AS words_mean,
  round(stddev_pop(words), 6) AS words_std, min(storypoint) AS point_min,
  max(storypoint) AS point_max, round(avg(storypoint), 6) AS point_mean,
  median(storypoint) AS point_median
FROM (SELECT *, len({o.words('description')}) AS words FROM capped) GROUP BY dataset_name"""),
    "point_distribution": o.with_blocks(["capped"], """
SELECT dataset_name, storypoint, count(*) AS n_rows FROM capped GROUP BY ALL"""),
    "fibonacci_distribution": o.with_blocks(["requirements"], """
SELECT dataset_name, storypoint, count(*) AS n_rows FROM requirements
WHERE storypoint IN (1, 2, 3, 5, 8, 13, 21) GROUP BY ALL"""),
    "scan_requirements": o.with_blocks(["requirements"], f"""
SELECT dataset_name, issuekey, title, description, storypoint FROM requirements"""),
    "exclude_dataset": o.with_blocks(["requirements"], f"""
SELECT {_RAW} FROM requirements WHERE NOT contains(dataset_name, 'titanium')"""),
    "filter_valid_points": o.with_blocks(["requirements"], f"""
SELECT {_RAW} FROM requirements WHERE storypoint IS NOT NULL AND storypoint > 0"""),
    "filter_cap": o.with_blocks(["requirements"], f"""
SELECT {_RAW} FROM requirements WHERE storypoint <= 8"""),
    "filter_nonblank": o.with_blocks(["requirements"], f"""
SELECT {_RAW} FROM requirements WHERE {o.nonblank('description')}"""),
    "filter_language": o.with_blocks(["detected"], """
SELECT dataset_name, row_ord, issuekey FROM detected WHERE detected = 'en'"""),
    "filter_iqr": o.with_blocks(["requirements"], """
SELECT r.dataset_name, row_ord, issuekey, storypoint FROM requirements r JOIN (
  SELECT dataset_name, quantile_cont(storypoint, 0.25) AS q1, quantile_cont(storypoint, 0.75) AS q3
  FROM requirements WHERE storypoint > 0 GROUP BY 1) q USING (dataset_name)
WHERE storypoint > 0 AND storypoint BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"""),
    "concat_title": o.with_blocks(["requirements"], """
SELECT dataset_name, row_ord, coalesce(title, 'nan') || ' ' || description AS description
FROM requirements WHERE description IS NOT NULL"""),
    "dedup_first": o.with_blocks(["first_copies"], "SELECT * FROM first_copies"),
    "uniform_cap": o.with_blocks(["capped"], "SELECT * FROM capped"),
    "limit_per_dataset": o.with_blocks(["first_copies"], """
SELECT * FROM first_copies
QUALIFY row_number() OVER (PARTITION BY dataset_name ORDER BY row_ord) <= 50"""),
    "union_datasets": o.with_blocks(["curated"], """
SELECT treated_description_bert AS text, storypoint FROM curated"""),
    "mlm_corpus": o.with_blocks(["curated"], "SELECT treated_description_bert AS text FROM curated"),
    "retrieval_corpus": o.with_blocks(["requirements"], """
SELECT description, storypoint FROM requirements
WHERE description IS NOT NULL AND storypoint IS NOT NULL"""),
    "with_defaults": o.with_blocks(["requirements"], """
SELECT dataset_name, row_ord, storypoint, 'SEM_ID' AS issuekey FROM requirements"""),
    "curate_view": o.with_blocks(["curated"], """
SELECT dataset_name, row_ord, issuekey, description, storypoint,
  treated_description_ml AS treated_description FROM curated"""),
    "treat_ml": o.with_blocks(["curated"], """
SELECT dataset_name, issuekey, treated_description_ml FROM curated"""),
    "treat_bert": o.with_blocks(["curated"], """
SELECT dataset_name, issuekey, treated_description_bert FROM curated"""),
    "clean_ascii": f"SELECT doc_id, {o.clean('text')} AS cleaned FROM documents",
    "strip_tags": f"SELECT page_id, {o.no_tags('html')} AS plain FROM pages",
    "html_to_text": f"SELECT page_id, {_PAGE_TEXT} AS plain FROM pages",
    "detect_language": f"SELECT doc_id, {o.language('text')} AS language FROM documents",
    "sentence_count": f"""
SELECT doc_id, CASE WHEN {o.nonblank('text')} THEN len(list_filter(
  regexp_split_to_array(text, '[.!?]+(?:[\\t-\\r\\x1c-\\x20]|\\z)'),
  lambda p: {o.nonblank('p')})) ELSE 0 END AS sentences FROM documents""",
    "word_count": f"SELECT doc_id, len({o.words('text')}) AS words FROM documents",
    "tokenize": f"SELECT doc_id, array_to_string({o.tokens('text')}, ' ') AS tokens FROM documents",
}
