"""Registered queries: retrieval, prompts, answers and language-model data."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions import answers, lexicon, metrics
from ..operators import features, language_model as lm, neighbours, prompting, scoring, splits
from ..session import staging_root
from ..sources import sinks
from ..sources.tables import requirements, table
from . import base, oracles as o

ROW = ["dataset_name", "row_ord"]


def _vectors(s, d):
    return table(s, d, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"))


def _knn_join(s, d):
    found = neighbours.knn_vectors(_vectors(s, d), _vectors(s, d), exclude_self=True)
    return found.select("query_id", "neighbour_id", "rank", F.round("distance", 5).alias("distance"))


def _knn_lsh(s, d):
    """Neighbours of every vector whose id 50 divides, among all vectors."""
    asked = _vectors(s, d).filter("row_id % 50 = 0")
    found = neighbours.knn_lsh(asked, _vectors(s, d), exclude_self=True)
    return found.select("query_id", "neighbour_id", "rank", F.round("distance", 5).alias("distance"))


def retrievable(s, d):
    """Every curated row: each is a query and a candidate."""
    return base.curated(s, d).select(
        F.col("row_ord").alias("row_id"), "issuekey", "description", "storypoint")


def description_vectors(rows):
    """TF-IDF of each row's own description; one group, as a column for the joins."""
    bags = features.term_bags(rows, ["row_id"], "description")
    return features.corpus_tfidf(bags, ["row_id"]).withColumn(
        "cell", F.pmod(F.col("row_id"), F.lit(1)).cast("int"))


def retrieved(s, d):
    def build():
        rows = base.staged_once(
            s, d, "description_vectors", lambda: description_vectors(retrievable(s, d)))
        return neighbours.knn_sparse(
            rows, rows, ["cell"], lexicon.RETRIEVED, exclude_self=True).drop("cell")
    return base.staged_once(s, d, "retrieved", build)


def _few_shot(s, d):
    return prompting.few_shot_prompts(retrievable(s, d), retrieved(s, d))


def _neighbour_answers(s, d):
    return prompting.parse_answers(
        prompting.neighbour_answers(retrievable(s, d), retrieved(s, d)))


def retrieval_run(rows, store, model, make_model, neighbours_of, **options):
    """Corpus, vectors, neighbours, prompts, answers, points: each row with its answer by ``model``."""
    prompts = prompting.few_shot_prompts(rows, neighbours_of(rows)).join(
        rows.select("row_id", F.col("storypoint").alias("actual")), "row_id")
    answered = prompting.answer_missing(prompts, store, model, make_model, **options)
    return prompting.parse_answers(answered).withColumn("model", F.lit(model))


def _retrieval_run(s, d):
    """Mean absolute error per model over all curated rows, answered through the store."""
    store = sinks.store_path(staging_root(s), f"answers-{uuid.uuid4().hex}")
    made = retrieval_run(retrievable(s, d), store, "median_of_examples", prompting.median_of_examples,
                         lambda rows: retrieved(s, d))
    valid = scoring.valid_predictions(made).withColumnsRenamed({"actual": "y", "predicted": "prediction"})
    return valid.groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"), F.round(metrics.mae(F.col("y"), F.col("prediction")), 6).alias("mae"))


def generated_answers(s, d):
    """Answers in the shapes models give, one per requirement."""
    shapes = ["5", " 5 ", "five", "", "5d", "1_000", "a###b### 5", "8.0", "4", "-3"]
    shape = F.element_at(F.array(*[F.lit(x) for x in shapes]), (F.col("row_ord") % 10 + 1).cast("int"))
    return requirements(s, d).select(
        "dataset_name", "row_ord",
        F.concat(F.lit("task "), F.col("issuekey"), F.lit("\n###\n"), shape).alias("generated"),
        F.col("storypoint").alias("actual"))


def _prompts(s, d, make):
    rows = requirements(s, d).filter("description IS NOT NULL")
    return rows.select("issuekey", make(F.col("description")).alias("prompt"))


def _bert_text(s, d):
    return base.curated(s, d).select(
        "dataset_name", "issuekey", "row_ord", F.col("treated_description_bert").alias("text"))


def words(s, d):
    return base.staged_once(s, d, "words", lambda: lm.vocabulary(_bert_text(s, d)))


def encoded(s, d):
    return base.staged_once(
        s, d, "encoded", lambda: lm.encode(_bert_text(s, d), words(s, d), ROW))


def _joined(column):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), " ").alias(column)


def _masked(s, d):
    masked = lm.mask_tokens(encoded(s, d), ROW, words(s, d).count())
    return masked.select(*ROW, _joined("input_ids"), _joined("labels"))


def _perplexity(s, d):
    parts = splits.holdout_split(_bert_text(s, d), lexicon.LM_HOLDOUT)
    return lm.perplexity(lm.word_losses(parts))


def _mean_of_vector():
    def predict(vectors: np.ndarray) -> np.ndarray:
        return vectors.astype(np.float64).mean(axis=1)
    return predict


QUERIES = {
    "knn_join": _knn_join,
    "knn_lsh": _knn_lsh,
    "prompt_zero_shot": lambda s, d: _prompts(s, d, answers.zero_shot_prompt),
    "prompt_with_role": lambda s, d: _prompts(s, d, answers.role_prompt),
    "truncate_prompt": lambda s, d: _prompts(s, d, lambda x: answers.truncate_prompt(
        answers.role_prompt(x), lexicon.FEW_SHOT_BUDGET)),
    "prompt_few_shot": _few_shot,
    "answer_by_neighbours": _neighbour_answers,
    "retrieval_run": _retrieval_run,
    "parse_answer": lambda s, d: prompting.parse_answers(generated_answers(s, d)),
    "valid_predictions": lambda s, d: scoring.valid_predictions(prompting.parse_answers(generated_answers(s, d))),
    "answer_in_scale": lambda s, d: prompting.parse_answers(generated_answers(s, d)).select(
        "dataset_name", "row_ord", answers.in_scale(F.col("predicted")).alias("in_scale")),
    "encode_tokens": lambda s, d: encoded(s, d).select(
        *ROW, _joined("input_ids"), _joined("attention_mask")),
    "mlm_mask": _masked,
    "perplexity": _perplexity,
    "predict_batch": lambda s, d: table(s, d, "embeddings").select(
        "vec_id", F.round(prompting.predict_rows(
            _mean_of_vector, F.col("embedding"), [64]), 5).alias("prediction")),
}

_DESCRIBED = "FROM requirements WHERE description IS NOT NULL"
_ROLE = (
    f"{o.quoted(lexicon.INSTRUCTIONS + lexicon.WORKED_EXAMPLES + chr(10) + lexicon.TASK_HEADER)}"
    f" || description || chr(10) || chr(10) || '###'")
_BEFORE, _AFTER = lexicon.ZERO_SHOT_TEMPLATE.split(lexicon.TEMPLATE_SLOT)
_WORDS = "regexp_extract_all(prompt, '[^\\t-\\r\\x1c-\\x20]+')"
_ANSWERS = """SELECT dataset_name, row_ord, 'task ' || issuekey || chr(10) || '###' || chr(10) ||
  (['5', ' 5 ', 'five', '', '5d', '1_000', 'a###b### 5', '8.0', '4', '-3'])[row_ord % 10 + 1]
  AS generated, storypoint AS actual FROM requirements"""
_LAST = ("regexp_replace(list_extract(string_split(generated, '###'), -1),"
         " '^[\\t-\\r\\x1c-\\x20]+|[\\t-\\r\\x1c-\\x20]+$', '', 'g')")
_PARSED = (f"SELECT *, CASE WHEN regexp_matches({_LAST}, '^[+-]?[0-9]+(\\.[0-9]*)?$')"
           f" THEN CAST({_LAST} AS DOUBLE) END AS predicted FROM ({_ANSWERS})")
_RETRIEVED = f"""retrievable AS MATERIALIZED (SELECT row_ord AS row_id, description, storypoint FROM capped),
used AS MATERIALIZED (SELECT row_id, term, count(*) AS tf FROM (
    SELECT row_id, unnest({o.tokens('description')}) AS term FROM retrievable) GROUP BY ALL),
rarity AS (SELECT term, ln((1 + (SELECT count(*) FROM retrievable)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf
  FROM used GROUP BY term),
weighed AS MATERIALIZED (SELECT row_id, term,
    tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY row_id)) AS w FROM used JOIN rarity USING (term)),
common AS MATERIALIZED (SELECT a.row_id AS query_id, b.row_id AS neighbour_id, sum(a.w * b.w) AS dot
  FROM weighed a JOIN weighed b ON a.term = b.term AND a.row_id <> b.row_id GROUP BY ALL),
lengths AS (SELECT row_id, CASE WHEN row_id IN (SELECT row_id FROM used) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS length
  FROM retrievable),
retrieved AS MATERIALIZED (SELECT q.row_id AS query_id, c.row_id AS neighbour_id, row_number() OVER
    (PARTITION BY q.row_id ORDER BY round(q.length + c.length - 2 * coalesce(dot, 0), 9), c.row_id) AS rank
  FROM lengths q JOIN lengths c ON q.row_id <> c.row_id
    LEFT JOIN common ON query_id = q.row_id AND neighbour_id = c.row_id QUALIFY rank <= 3)"""
_LM_TOKENS = "regexp_extract_all(lower(treated_description_bert), '[a-z0-9_]+')"

o.BLOCKS.update({
    "words": (["curated"], f"""SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) + 4 AS id
FROM (SELECT unnest({_LM_TOKENS}) AS term FROM curated) GROUP BY term"""),
    "encoded": (["words"], f"""SELECT dataset_name, row_ord,
  list_concat(list_concat([2], coalesce(ids, [])), [3]) AS ids FROM curated LEFT JOIN (
  SELECT dataset_name, row_ord, list(coalesce(id, 1) ORDER BY pos) AS ids FROM (
    SELECT dataset_name, row_ord, generate_subscripts(tokens, 1) AS pos, unnest(tokens) AS term
    FROM (SELECT dataset_name, row_ord, {_LM_TOKENS}[1:510] AS tokens FROM curated))
  LEFT JOIN words USING (term) GROUP BY dataset_name, row_ord) USING (dataset_name, row_ord)"""),
})
_PADDED = "list_concat(ids, list_transform(range(512 - len(ids)), lambda x: 0))"


def _hex(start):
    return f"(CAST(('0x' || substr(digest, {start}, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


ORACLES = {
    "knn_join": """
SELECT query_id, neighbour_id, rank, round(distance, 5) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), neighbour_id)
    AS rank
  FROM (SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id,
      list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) ** 2 AS distance
    FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id)) WHERE rank <= 3""",
    "prompt_zero_shot": o.with_blocks(["requirements"], f"""
SELECT issuekey, {o.quoted(_BEFORE)} || description || {o.quoted(_AFTER)} AS prompt {_DESCRIBED}"""),
    "prompt_with_role": o.with_blocks(["requirements"], f"""
SELECT issuekey, {_ROLE} AS prompt {_DESCRIBED}"""),
    "truncate_prompt": o.with_blocks(["requirements"], f"""
SELECT issuekey, CASE WHEN len({_WORDS}) > 1024
  THEN array_to_string({_WORDS}[1:1023], ' ') || chr(10) || '###' ELSE prompt END AS prompt
FROM (SELECT issuekey, {_ROLE} AS prompt {_DESCRIBED})"""),
    "prompt_few_shot": o.with_blocks(["capped"], "") .rstrip() + f""",
{_RETRIEVED}
SELECT q.row_id, {o.quoted(lexicon.INSTRUCTIONS)} || string_agg('Descrição da tarefa:' || chr(10)
  || c.description || chr(10) || '###' || chr(10) || CAST(c.storypoint AS VARCHAR) || chr(10)
  || chr(10), '' ORDER BY rank) || 'Descrição da tarefa:' || chr(10) || any_value(q.description)
  || chr(10) || '###' AS prompt
FROM retrieved JOIN retrievable q ON q.row_id = query_id
  JOIN retrievable c ON c.row_id = neighbour_id GROUP BY q.row_id""",
    "answer_by_neighbours": o.with_blocks(["capped"], "").rstrip() + f""",
{_RETRIEVED}
SELECT q.row_id, '###' || chr(10) || CAST(median(c.storypoint) AS VARCHAR) AS generated,
  any_value(q.storypoint) AS actual, median(c.storypoint) AS predicted
FROM retrieved JOIN retrievable q ON q.row_id = query_id
  JOIN retrievable c ON c.row_id = neighbour_id GROUP BY q.row_id""",
    "retrieval_run": o.with_blocks(["capped"], "").rstrip() + f""",
{_RETRIEVED}
SELECT 'median_of_examples' AS model, count(*) AS n_rows, round(avg(abs(actual - predicted)), 6) AS mae FROM (
  SELECT any_value(q.storypoint) AS actual, median(c.storypoint) AS predicted
  FROM retrieved JOIN retrievable q ON q.row_id = query_id
    JOIN retrievable c ON c.row_id = neighbour_id GROUP BY q.row_id)""",
    "parse_answer": o.with_blocks(["requirements"], _PARSED),
    "valid_predictions": o.with_blocks(
        ["requirements"],
        f"SELECT * FROM ({_PARSED}) WHERE predicted IS NOT NULL AND actual IS NOT NULL"),
    "answer_in_scale": o.with_blocks(["requirements"], f"""
SELECT dataset_name, row_ord, coalesce(predicted IN (1, 2, 3, 5, 8), false) AS in_scale
FROM ({_PARSED})"""),
    "encode_tokens": o.with_blocks(["encoded"], f"""
SELECT dataset_name, row_ord, array_to_string({_PADDED}, ' ') AS input_ids,
  array_to_string(list_transform(range(512), lambda x: CASE WHEN x < len(ids) THEN 1 ELSE 0 END),
    ' ') AS attention_mask FROM encoded"""),
    "mlm_mask": o.with_blocks(["encoded"], f"""
SELECT dataset_name, row_ord,
  string_agg(CASE WHEN NOT chosen THEN token WHEN {_hex(9)} < 0.8::DOUBLE THEN 4
    WHEN {_hex(9)} < 0.9::DOUBLE
      THEN CAST(floor({_hex(17)} * (SELECT count(*) FROM words)) AS BIGINT) + 5
    ELSE token END, ' ' ORDER BY pos) AS input_ids,
  string_agg(CASE WHEN chosen THEN token ELSE -100 END, ' ' ORDER BY pos) AS labels
FROM (SELECT *, (token >= 5 OR token = 1) AND {_hex(1)} < 0.15::DOUBLE AS chosen
  FROM (SELECT *, md5('42:' || dataset_name || ':' || row_ord || ':' || pos) AS digest
    FROM (SELECT dataset_name, row_ord, generate_subscripts(padded, 1) - 1 AS pos,
        unnest(padded) AS token
      FROM (SELECT dataset_name, row_ord, {_PADDED} AS padded FROM encoded))))
GROUP BY dataset_name, row_ord"""),
    "perplexity": o.with_blocks(["curated"], f"""
SELECT round(exp(sum(n * -ln((seen + 1) / CAST(total AS DOUBLE))) / sum(n)), 6) AS perplexity
FROM (SELECT *, sum(seen) OVER () + count(*) OVER () AS total FROM (
  SELECT term, count(*) FILTER (WHERE part = 'train') AS seen,
    count(*) FILTER (WHERE part = 'holdout') AS n
  FROM (SELECT unnest({_LM_TOKENS}) AS term, CASE WHEN row_number() OVER (
        PARTITION BY dataset_name ORDER BY md5('holdout42:' || issuekey || ':' || row_ord))
      <= ceil(count(*) OVER (PARTITION BY dataset_name) * CAST(0.1 AS DOUBLE))
      THEN 'holdout' ELSE 'train' END AS part FROM curated) GROUP BY term))"""),
    "predict_batch": "SELECT vec_id, round(list_avg(embedding::DOUBLE[]), 5) AS prediction FROM embeddings",
}
