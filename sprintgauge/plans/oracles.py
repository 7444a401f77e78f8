"""SQL building blocks for the side-by-side check.

Each block is one common table expression; ``with_blocks`` strings together
those a query needs, in dependency order.
"""

from __future__ import annotations

from ..functions import lexicon


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


def clean(column: str) -> str:
    return f"trim(regexp_replace({column}, '[^\\x00-\\x08\\x0e-\\x1b\\x21-\\x7f]+', ' ', 'g'))"


def no_tags(column: str) -> str:
    script = (
        "(?is)<script[^>]*>.*?</script[^>]*>|<style[^>]*>.*?</style[^>]*>"
        "|<template[^>]*>.*?</template[^>]*>"
    )
    return (
        f"regexp_replace(regexp_replace(regexp_replace({column}, '(?s)<!--.*?-->', '', 'g'),"
        f" '{script}', '', 'g'), '<[!?/a-zA-Z][^>]*>', '', 'g')"
    )


def nonblank(column: str) -> str:
    return f"coalesce(regexp_matches({column}, '[^\\t-\\r\\x1c-\\x20]'), false)"


def words(column: str) -> str:
    return f"regexp_extract_all({column}, '[\\p{{L}}\\p{{N}}_]+')"


def tokens(column: str) -> str:
    return f"regexp_extract_all(lower({clean(column)}), '[a-z0-9_]{{2,}}')"


def language(column: str) -> str:
    hits = {
        code: f"len(list_filter(found, lambda w: list_contains({sql_list(ws)}, w)))"
        for code, ws in lexicon.LANGUAGE_WORDS.items()
    }
    best = "greatest(" + ", ".join(hits.values()) + ")"
    cases = " ".join(f"WHEN {n} = {best} THEN '{code}'" for code, n in hits.items())
    return (
        f"(SELECT CASE WHEN {best} = 0 THEN 'unknown' {cases} END FROM "
        f"(SELECT coalesce(regexp_extract_all(lower({column}), '\\p{{L}}+'), []) AS found))"
    )


def lemmas(column: str) -> str:
    kept = (
        f"list_filter(regexp_extract_all(lower({column}), '[a-z0-9_]+'), "
        f"lambda t: NOT list_contains({sql_list(lexicon.STOP_WORDS)}, t))"
    )
    keys, values = zip(*lexicon.IRREGULAR_LEMMAS.items())
    irregular = (
        f"coalesce({sql_list(list(values))}[list_position({sql_list(list(keys))}, t)], t)"
    )
    reduced = irregular
    for _, pattern, tail in lexicon.SUFFIX_RULES:
        reduced = f"regexp_replace({reduced}, {quoted(pattern)}, '\\1{tail}')"
    mapped = f"list_transform({kept}, lambda t: {reduced})"
    return f"array_to_string(list_filter({mapped}, lambda t: length(t) > 1), ' ')"


def _requirements() -> str:
    return """SELECT
  CASE WHEN source = 'src19' THEN 'titanium' ELSE 'ds' || (doc_id % 5) END AS dataset_name,
  doc_id AS row_ord,
  'REQ-' || doc_id AS issuekey,
  CASE WHEN n_chars % 29 <> 0 THEN 'Item ' || (n_chars % 97) END AS title,
  CASE WHEN doc_id % 31 = 0 THEN NULL WHEN doc_id % 37 = 0 THEN '   ' ELSE text END AS description,
  CAST(CASE WHEN doc_id % 41 = 0 THEN NULL WHEN doc_id % 43 = 0 THEN 0
    WHEN doc_id % 5 = 3 THEN CASE WHEN n_chars < 1000 THEN 1 WHEN n_chars < 2000 THEN 3 ELSE 5 END
    WHEN n_chars < 400 THEN 1 WHEN n_chars < 900 THEN 2 WHEN n_chars < 1500 THEN 3
    WHEN n_chars < 3000 THEN 5 WHEN n_chars < 6000 THEN 8 ELSE 13 END AS DOUBLE) AS storypoint,
  lang FROM documents"""


BLOCKS: dict[str, tuple[list[str], str]] = {
    "requirements": ([], _requirements()),
    "detected": (
        ["requirements"],
        f"SELECT *, {language('description')} AS detected FROM requirements",
    ),
    "kept": (
        ["detected"],
        "SELECT dataset_name, row_ord, issuekey, coalesce(title, 'nan') || ' ' || description"
        " AS description, storypoint FROM detected WHERE detected = 'en' AND storypoint > 0"
        f" AND storypoint <= 8 AND {nonblank('description')}"
        " AND NOT contains(dataset_name, 'titanium')",
    ),
    "first_copies": (
        ["kept"],
        "SELECT * FROM kept QUALIFY row_number() OVER"
        " (PARTITION BY dataset_name, description ORDER BY row_ord) = 1",
    ),
    "capped": (
        ["first_copies"],
        "SELECT * FROM first_copies WHERE storypoint <= (SELECT min(top) FROM"
        " (SELECT max(storypoint) AS top FROM first_copies GROUP BY dataset_name))",
    ),
    "curated": (
        ["capped"],
        f"SELECT *, {lemmas('treated_description_bert')} AS treated_description_ml FROM"
        f" (SELECT *, {no_tags(clean('description'))} AS treated_description_bert FROM capped)",
    ),
}

BLOCKS |= {
    "folds": (
        ["capped"],
        "SELECT dataset_name, issuekey, row_ord, CAST(ntile(5) OVER (PARTITION BY dataset_name"
        " ORDER BY md5('42:' || issuekey || ':' || row_ord)) AS INTEGER) AS fold FROM capped",
    ),
    "intra_roles": (
        ["folds"],
        """SELECT dataset_name, split, issuekey, row_ord, CASE WHEN tested THEN 'test'
  WHEN row_number() OVER (PARTITION BY dataset_name, split, tested
    ORDER BY md5('holdout42:' || issuekey || ':' || row_ord))
    <= ceil(count(*) OVER (PARTITION BY dataset_name, split, tested) * CAST(0.2 AS DOUBLE))
  THEN 'validation' ELSE 'train' END AS role
FROM (SELECT *, fold = split AS tested FROM folds,
  (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS split))""",
    ),
    "names": (
        ["capped"],
        "SELECT dataset_name, row_number() OVER (ORDER BY dataset_name) - 1 AS position,"
        " count(*) OVER () AS n FROM (SELECT DISTINCT dataset_name FROM capped)",
    ),
    "offsets": (
        ["names"],
        "SELECT CAST(c.position AS INTEGER) AS cycle, p.dataset_name,"
        " (p.position - c.position + p.n) % p.n AS gap FROM names c, names p",
    ),
    "loo": (
        ["offsets"],
        "SELECT cycle, dataset_name, CASE gap WHEN 0 THEN 'test' WHEN 1 THEN 'validation'"
        " ELSE 'train' END AS role FROM offsets",
    ),
    "four_way": (
        ["offsets"],
        "SELECT cycle, dataset_name, CASE WHEN gap <= 1 THEN 'train' WHEN gap = 2 THEN"
        " 'validation' ELSE 'test' END AS role FROM offsets WHERE gap <= 3",
    ),
    "labels_loo": (
        ["loo"],
        "SELECT cycle, string_agg(dataset_name, '_' ORDER BY dataset_name) FILTER"
        " (WHERE role = 'train') AS train_set, max(dataset_name) FILTER (WHERE role ="
        " 'validation') AS validation, max(dataset_name) FILTER (WHERE role = 'test')"
        " AS test FROM loo GROUP BY cycle",
    ),
    "terms": (
        ["curated"],
        f"SELECT dataset_name, issuekey, row_ord, term, count(*) AS tf FROM (SELECT dataset_name,"
        f" issuekey, row_ord, unnest({tokens('treated_description_ml')}) AS term FROM curated)"
        " GROUP BY ALL",
    ),
    "vocabulary": (
        ["terms", "intra_roles"],
        """SELECT dataset_name, split, term, sum(tf) AS frequency, count(*) AS df
FROM terms JOIN intra_roles USING (dataset_name, issuekey, row_ord) WHERE role = 'train'
GROUP BY dataset_name, split, term QUALIFY row_number() OVER (PARTITION BY dataset_name, split
  ORDER BY sum(tf) DESC, term) <= 5000""",
    ),
    "weights": (
        ["vocabulary"],
        """SELECT dataset_name, split, issuekey, row_ord, role, term,
  w / sqrt(sum(w * w) OVER (PARTITION BY dataset_name, split, row_ord)) AS w
FROM (SELECT *, tf * (ln((1 + n_train) / CAST(1 + df AS DOUBLE)) + 1) AS w
  FROM terms JOIN intra_roles USING (dataset_name, issuekey, row_ord)
  JOIN vocabulary USING (dataset_name, split, term)
  JOIN (SELECT dataset_name, split, count(*) AS n_train FROM intra_roles
    WHERE role = 'train' GROUP BY ALL) USING (dataset_name, split))""",
    ),
    "neighbours": (
        ["weights"],
        """SELECT *, row_number() OVER (PARTITION BY dataset_name, split, query_id
    ORDER BY distance, neighbour_id) AS rank
FROM (SELECT q.dataset_name, q.split, q.row_ord AS query_id, c.row_ord AS neighbour_id,
    round(greatest(q.filled + c.filled - 2 * coalesce(sim, 0), 0), 9) AS distance
  FROM (SELECT r.*, CASE WHEN EXISTS (FROM weights w WHERE w.dataset_name = r.dataset_name
      AND w.split = r.split AND w.row_ord = r.row_ord) THEN 1.0::DOUBLE ELSE 0 END AS filled
    FROM intra_roles r) q
  JOIN (SELECT r.*, CASE WHEN EXISTS (FROM weights w WHERE w.dataset_name = r.dataset_name
      AND w.split = r.split AND w.row_ord = r.row_ord) THEN 1.0::DOUBLE ELSE 0 END AS filled
    FROM intra_roles r) c
    ON q.dataset_name = c.dataset_name AND q.split = c.split AND q.role = 'test'
    AND c.role = 'train'
  LEFT JOIN (SELECT a.dataset_name, a.split, a.row_ord AS qr, b.row_ord AS cr, sum(a.w * b.w) AS sim
    FROM weights a JOIN weights b USING (dataset_name, split, term)
    WHERE a.role = 'test' AND b.role = 'train' GROUP BY ALL) s
    ON s.dataset_name = q.dataset_name AND s.split = q.split AND s.qr = q.row_ord
    AND s.cr = c.row_ord)
QUALIFY rank <= 5""",
    ),
    "predictions": (
        ["neighbours"],
        """SELECT r.dataset_name, r.split, r.issuekey, r.row_ord, storypoint AS y, model, prediction
FROM intra_roles r JOIN capped USING (dataset_name, issuekey, row_ord) JOIN (
  SELECT dataset_name, split, NULL AS query_id, 'train_mean' AS model, avg(storypoint) AS prediction
  FROM intra_roles JOIN capped USING (dataset_name, issuekey, row_ord) WHERE role = 'train' GROUP BY ALL
  UNION ALL
  SELECT dataset_name, split, NULL, 'train_median', median(storypoint)
  FROM intra_roles JOIN capped USING (dataset_name, issuekey, row_ord) WHERE role = 'train' GROUP BY ALL
  UNION ALL
  SELECT n.dataset_name, split, query_id, 'knn' || k, avg(storypoint)
  FROM neighbours n JOIN capped c ON c.row_ord = n.neighbour_id
    JOIN (SELECT unnest([3, 5]) AS k) ON rank <= k GROUP BY ALL) p
  ON p.dataset_name = r.dataset_name AND p.split = r.split
  AND coalesce(p.query_id, r.row_ord) = r.row_ord
WHERE r.role = 'test'""",
    ),
    "trained": (
        ["weights", "folds"],
        """SELECT r.dataset_name, r.split, r.row_ord, fold, storypoint,
  CASE WHEN EXISTS (FROM weights w WHERE w.dataset_name = r.dataset_name
    AND w.split = r.split AND w.row_ord = r.row_ord) THEN 1.0::DOUBLE ELSE 0 END AS filled
FROM intra_roles r JOIN folds USING (dataset_name, issuekey, row_ord)
  JOIN capped USING (dataset_name, issuekey, row_ord) WHERE role = 'train'""",
    ),
    "held": (
        ["trained"],
        """SELECT q.dataset_name, q.split, q.row_ord, q.storypoint AS y, model, prediction
FROM trained q JOIN (
  SELECT dataset_name, split, fold, unnest(['train_mean', 'train_median']) AS model,
    unnest([mean, middle]) AS prediction
  FROM (SELECT h.dataset_name, h.split, h.fold, avg(storypoint) AS mean, median(storypoint) AS middle
    FROM (SELECT DISTINCT dataset_name, split, fold FROM trained) h JOIN trained c
    ON c.dataset_name = h.dataset_name AND c.split = h.split AND c.fold <> h.fold GROUP BY ALL)) p
  ON p.dataset_name = q.dataset_name AND p.split = q.split AND p.fold = q.fold
UNION ALL
SELECT dataset_name, split, query_id, y, 'knn' || k, avg(storypoint) FROM (
  SELECT q.dataset_name, q.split, q.row_ord AS query_id, q.storypoint AS y, c.storypoint,
    row_number() OVER (PARTITION BY q.dataset_name, q.split, q.row_ord ORDER BY
      round(greatest(q.filled + c.filled - 2 * coalesce(sim, 0), 0), 9), c.row_ord) AS rank
  FROM trained q JOIN trained c
    ON q.dataset_name = c.dataset_name AND q.split = c.split AND q.fold <> c.fold
  LEFT JOIN (SELECT a.dataset_name, a.split, a.row_ord AS qr, b.row_ord AS cr, sum(a.w * b.w) AS sim
    FROM weights a JOIN weights b USING (dataset_name, split, term)
    WHERE a.role = 'train' AND b.role = 'train' GROUP BY ALL) s
    ON s.dataset_name = q.dataset_name AND s.split = q.split AND s.qr = q.row_ord
    AND s.cr = c.row_ord)
JOIN (SELECT unnest([3, 5]) AS k) ON rank <= k GROUP BY ALL""",
    ),
    "inter_predictions": (
        ["loo"],
        """SELECT cycle, c.dataset_name, row_ord, storypoint AS y, model, prediction
FROM capped c JOIN loo USING (dataset_name) JOIN (
  SELECT cycle, 'train_mean' AS model, avg(storypoint) AS prediction
  FROM capped JOIN loo USING (dataset_name) WHERE role = 'train' GROUP BY ALL
  UNION ALL
  SELECT cycle, 'train_median', median(storypoint)
  FROM capped JOIN loo USING (dataset_name) WHERE role = 'train' GROUP BY ALL) p USING (cycle)
WHERE role = 'test'""",
    ),
}

# Metrics as SQL over columns y and prediction.
SQL_METRICS = {
    "mae": "avg(abs(y - prediction))",
    "mse": "avg((y - prediction) ** 2)",
    "rmse": "sqrt(avg((y - prediction) ** 2))",
    "r2": "CASE WHEN min(y) < max(y) THEN 1 - sum((y - prediction) ** 2) / (var_pop(y) * count(*))"
          " WHEN sum((y - prediction) ** 2) = 0 THEN 1.0 ELSE 0.0 END",
    "pearson": "CASE WHEN min(y) < max(y) AND min(prediction) < max(prediction)"
               " THEN covar_pop(y, prediction) / (stddev_pop(y) * stddev_pop(prediction)) END",
}


def with_blocks(names: list[str], body: str) -> str:
    """``body`` preceded by the blocks it names and all they depend on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for needed in BLOCKS[name][0]:
            add(needed)
        ordered.append(name)

    for name in names:
        add(name)
    defined = ",\n".join(f"{n} AS MATERIALIZED ({BLOCKS[n][1]})" for n in ordered)
    return f"WITH {defined}\n{body}" if ordered else body
