"""The queries in plain SQL, for an independent engine.

These are written from the definitions, with global windows and joins where the
Spark operators avoid them.
"""

from revmill.functions.text import TOKEN_RUN
from revmill.schema import (
    CUTOFF_MS,
    DEFAULT_TITLE,
    GENERATORS,
    LENGTH_MU,
    LENGTH_SIGMA,
    MAX_FEATURES,
    MAX_LEN,
    MODELS,
    VARIANTS,
)

ORACLES: dict[str, str] = {}

# The characters that split words, spelled out.
SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WORD_RUN = f"[^{SPACE}]+"


def _list(values) -> str:
    return ", ".join(values)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(text: str) -> str:
    return f"cast(len(regexp_extract_all(coalesce({text}, ''), '{WORD_RUN}')) AS int)"


def shuffle_order(seed: str, key: str) -> str:
    return f"md5(concat(cast({seed} AS varchar), '|', {key})), {key}"


def u32(text: str) -> str:
    return f"cast(concat('0x', substr(md5({text}), 1, 8)) AS bigint)"


def folded(n: int) -> str:
    """n sums over a vector's components, one for each remainder of the place."""
    sums = (
        f"list_sum([embedding[i]::double FOR i IN range({k + 1}, len(embedding) + 1, {n})])" for k in range(n)
    )
    return f"[{', '.join(sums)}]"


# Named tables; each may use the ones before it.
TABLES = {
    "raw": """
        SELECT doc_id, lang AS category,
               CASE WHEN doc_id % 29 = 0 THEN NULL
                    WHEN doc_id % 31 = 0 THEN 0
                    ELSE 1669766400000 + (((doc_id // 3) * 7919) % 1000 - 850) * 86400000
               END AS timestamp,
               text,
               CASE WHEN doc_id % 37 <> 0
                    THEN concat('u', cast((doc_id // 3) % 7 AS varchar)) END AS user_id,
               concat('P', cast(doc_id % 500 AS varchar)) AS parent_asin,
               cast(1 + doc_id % 5 AS double) AS rating,
               concat(source, ' ', cast(doc_id AS varchar)) AS title
        FROM documents""",
    "raw_pool": f"""
        SELECT concat_ws('_', category, coalesce(user_id, ''), cast(timestamp AS varchar)) AS review_id,
               category, parent_asin, rating, title, text, timestamp,
               0 AS label, 'human' AS generator, doc_id
        FROM raw
        WHERE timestamp <> 0 AND timestamp < {CUTOFF_MS} AND {words('text')} BETWEEN 20 AND 400""",
    "reviews": """
        SELECT concat('r', cast(doc_id AS varchar)) AS review_id,
               lang AS category,
               concat('P', cast(doc_id % 500 AS varchar)) AS parent_asin,
               cast(1 + doc_id % 5 AS double) AS rating,
               concat(source, ' ', cast(doc_id AS varchar)) AS title,
               text,
               CASE WHEN k >= 16 OR doc_id % 29 = 0 THEN NULL
                    ELSE 1669766400000 + ((doc_id * 7919) % 1000 - 850) * 86400000
               END AS timestamp,
               CASE WHEN k < 16 THEN 0 ELSE 1 END AS label,
               CASE WHEN k < 16 THEN 'human' WHEN k = 16 THEN 'gpt5mini'
                    WHEN k = 17 THEN 'granite' WHEN k = 18 THEN 'gemma'
                    ELSE 'qwen' END AS generator
        FROM (SELECT *, cast(substr(source, 4) AS int) AS k FROM documents) s""",
    "human": f"""
        SELECT * FROM reviews
        WHERE generator = 'human' AND timestamp <> 0 AND timestamp < {CUTOFF_MS}
          AND {words('text')} BETWEEN 20 AND 400""",
    "ai": "SELECT * FROM reviews WHERE generator <> 'human'",
    "quota": """
        SELECT pos, category,
               n // k + CASE WHEN pos < n % k THEN 1 ELSE 0 END AS quota
        FROM (SELECT category, row_number() OVER (ORDER BY category) - 1 AS pos,
                     count(*) OVER () AS k, (SELECT count(*) // 4 + 3 FROM documents) AS n
              FROM (SELECT DISTINCT category FROM reviews) d) c""",
    "gens": "SELECT * FROM (VALUES {}) v(rotation, held_out, train_gens)".format(
        _list(
            f"({r}, '{g}', '{','.join(o for o in GENERATORS if o != g)}')"
            for r, g in enumerate(GENERATORS)
        )
    ),
    "ai_split": f"""
        SELECT *, CASE WHEN generator = held_out THEN 'test_crossgen'
                       WHEN rn <= n * 8 // 10 THEN 'train'
                       WHEN rn <= n * 8 // 10 + n // 10 THEN 'val_indist'
                       ELSE 'test_indist' END AS split
        FROM (SELECT rotation, held_out, a.*,
                     row_number() OVER (PARTITION BY rotation, generator
                                        ORDER BY {shuffle_order('42 + rotation', 'review_id')}) AS rn,
                     count(*) OVER (PARTITION BY rotation, generator) AS n
              FROM ai a, gens) r""",
    "need": """
        SELECT rotation,
               count(*) FILTER (split = 'train') AS n_train,
               count(*) FILTER (split = 'val_indist') AS n_val,
               count(*) FILTER (split = 'test_indist') AS n_test
        FROM ai_split GROUP BY rotation""",
    "human_split": f"""
        SELECT *, CASE WHEN rn <= n // 4 THEN 'test_crossgen'
                       WHEN rn <= n // 4 + n_train THEN 'train'
                       WHEN rn <= n // 4 + n_train + n_val THEN 'val_indist'
                       WHEN rn <= n // 4 + n_train + n_val + n_test THEN 'test_indist'
                  END AS split
        FROM (SELECT need.*, h.*,
                     row_number() OVER (PARTITION BY rotation
                                        ORDER BY {shuffle_order('42 + rotation', 'review_id')}) AS rn,
                     count(*) OVER (PARTITION BY rotation) AS n
              FROM human h, need) r""",
    "splits": """
        SELECT rotation, split, review_id, category, parent_asin, generator, label, text
        FROM human_split WHERE split IS NOT NULL
        UNION ALL
        SELECT rotation, split, review_id, category, parent_asin, generator, label, text
        FROM ai_split""",
    "train": "SELECT * FROM splits WHERE rotation = 0 AND split = 'train'",
    "meta": """
        SELECT rotation, held_out, train_gens,
               count(*) FILTER (split = 'train') AS n_train,
               count(*) FILTER (split = 'val_indist') AS n_val,
               count(*) FILTER (split = 'test_indist') AS n_test_indist,
               count(*) FILTER (split = 'test_crossgen') AS n_test_crossgen
        FROM splits JOIN gens USING (rotation) GROUP BY ALL""",
    "models": "SELECT * FROM (VALUES {}) v(position, model, name)".format(
        _list(f"({i}, '{run}', '{name}')" for i, (run, name) in enumerate(MODELS))
    ),
    "variants": "SELECT * FROM (VALUES {}) v(variant, w_ce, w_contrastive, w_adversarial)".format(
        _list(f"('{v}', {a}::double, {b}::double, {c}::double)" for v, a, b, c in VARIANTS)
    ),
    "scored": f"""
        SELECT model, rotation, split, review_id, generator, label,
               (floor({u32("concat_ws('|', model, cast(rotation AS varchar), review_id)")}
                      * 700 / 4294967296.0) + 300 * label) / 1000.0 AS p
        FROM splits, models
        WHERE split IN ('test_indist', 'test_crossgen') AND NOT (model = 'both' AND rotation = 3)""",
    "metrics": """
        SELECT model, rotation, split,
               coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
               (ranks - pos * (pos + 1) / 2.0) / nullif(pos * neg, 0) AS auc,
               pos + neg AS n
        FROM (SELECT model, rotation, split,
                     count(*) FILTER (label = 1 AND p >= 0.5) AS tp,
                     count(*) FILTER (label = 0 AND p >= 0.5) AS fp,
                     count(*) FILTER (label = 1 AND p < 0.5) AS fn,
                     cast(count(*) FILTER (label = 1) AS double) AS pos,
                     cast(count(*) FILTER (label = 0) AS double) AS neg,
                     sum(mid_rank) FILTER (label = 1) AS ranks
              FROM (SELECT *, rank() OVER (PARTITION BY model, rotation, split ORDER BY p)
                              + (count(*) OVER (PARTITION BY model, rotation, split, p) - 1) / 2.0
                              AS mid_rank
                    FROM scored) r
              GROUP BY ALL) s""",
    "fanned": """
        SELECT s.* EXCLUDE (generator), g.generator
        FROM scored s
        JOIN (SELECT DISTINCT model, rotation, split, generator FROM scored) g
          ON s.model = g.model AND s.rotation = g.rotation AND s.split = g.split
         AND (s.generator = g.generator OR s.generator = 'human')""",
    "per_generator": """
        SELECT model, rotation, split, generator,
               coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
               (ranks - pos * (pos + 1) / 2.0) / nullif(pos * neg, 0) AS auc,
               pos + neg AS n
        FROM (SELECT model, rotation, split, generator,
                     count(*) FILTER (label = 1 AND p >= 0.5) AS tp,
                     count(*) FILTER (label = 0 AND p >= 0.5) AS fp,
                     count(*) FILTER (label = 1 AND p < 0.5) AS fn,
                     cast(count(*) FILTER (label = 1) AS double) AS pos,
                     cast(count(*) FILTER (label = 0) AS double) AS neg,
                     sum(mid_rank) FILTER (label = 1) AS ranks
              FROM (SELECT *, rank() OVER (PARTITION BY model, rotation, split, generator ORDER BY p)
                              + (count(*) OVER (PARTITION BY model, rotation, split, generator, p) - 1) / 2.0
                              AS mid_rank
                    FROM fanned) r
              GROUP BY ALL) s""",
    "averages": """
        SELECT model, split,
               CASE WHEN count(f1) = count(*) THEN avg(f1) END AS f1,
               CASE WHEN count(auc) = count(*) THEN avg(auc) END AS auc,
               count(*) AS rotations
        FROM metrics GROUP BY model, split""",
    "comparison": """
        SELECT position, name AS model,
               max(f1) FILTER (split = 'test_indist') AS f1_indist,
               max(f1) FILTER (split = 'test_crossgen') AS f1_crossgen,
               max(auc) FILTER (split = 'test_indist') AS auc_indist,
               max(auc) FILTER (split = 'test_crossgen') AS auc_crossgen
        FROM averages JOIN models USING (model) GROUP BY position, name""",
    # Generation
    "products": """
        SELECT parent_asin, category, rating, title, review_id
        FROM (SELECT *, row_number() OVER (PARTITION BY parent_asin ORDER BY {order}) AS rn
              FROM human) r WHERE rn = 1""".format(order=shuffle_order("42", "review_id")),
    "seeds": """
        SELECT parent_asin, category, rating, title, review_id
        FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS rn, count(*) OVER () AS n
              FROM products) r WHERE rn <= n // 2""".format(
        order=shuffle_order("42", "parent_asin")
    ),
    "bins": f"""
        SELECT wc, stop - n AS start, stop
        FROM (SELECT wc, n, cast(sum(n) OVER (ORDER BY wc) AS bigint) AS stop
              FROM (SELECT {words('text')} AS wc, count(*) AS n FROM human GROUP BY 1) c) s""",
    "requests": """
        SELECT concat_ws('_', generator, parent_asin, '42') AS request_id, generator, parent_asin,
               category, rating, title, wc AS target_wc,
               {prompt} AS prompt, cast(floor(wc * 2.5) AS int) AS max_tokens
        FROM (SELECT *, cast(floor({u} / 4294967296.0 * (SELECT max(stop) FROM bins)) AS bigint) AS place
              FROM seeds) s
        JOIN bins ON start <= place AND place < stop,
             (SELECT unnest([{gens}]) AS generator) g""",
    "responses": """
        SELECT request_id, CASE WHEN {u} % 13 <> 0 THEN prompt END AS text,
               CASE WHEN {u} % 13 = 0 THEN 'timeout' END AS error
        FROM requests""".format(u=u32("request_id")),
    # Vectors
    "vectors": """
        SELECT vec_id, embedding, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS label,
               label % 4 AS gen_label, vec_id // 8 AS doc,
               CASE WHEN label <> 0 THEN 1 ELSE 0 END AS mask
        FROM embeddings""",
    "dims": """
        SELECT vec_id, label, doc, mask, cast(generate_subscripts(embedding, 1) - 1 AS int) AS dim,
               cast(unnest(embedding) AS double) AS x
        FROM vectors""",
    "unit": """
        SELECT vec_id, dim, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-12) AS x
        FROM dims""",
    "batches": """
        SELECT *, (row_number() OVER (ORDER BY {order}) - 1) // 16 AS batch_id
        FROM vectors""".format(
        order="md5(concat('42|', cast(vec_id AS varchar))), cast(vec_id AS varchar)"
    ),
    "similarities": """
        SELECT a.batch_id, a.vec_id AS i, b.vec_id AS j, a.label = b.label AS same,
               sum(u.x * v.x) / 0.07 AS s
        FROM batches a JOIN batches b ON a.batch_id = b.batch_id
        JOIN unit u ON u.vec_id = a.vec_id JOIN unit v ON v.vec_id = b.vec_id AND v.dim = u.dim
        GROUP BY ALL""",
    "anchors": """
        SELECT batch_id, i,
               avg(s - top) FILTER (same AND i <> j)
                 - ln(sum(exp(s - top)) FILTER (i <> j) + 1e-12) AS value
        FROM (SELECT *, max(s) OVER (PARTITION BY batch_id, i) AS top FROM similarities) m
        GROUP BY batch_id, i""",
    "supcon": """
        SELECT batch_id, coalesce(-avg(value), 0) AS loss FROM anchors GROUP BY batch_id""",
    "ce": """
        SELECT batch_id, avg(ln(list_sum([exp(x - list_max(l)) FOR x IN l])) + list_max(l)
                             - l[label + 1]) AS loss
        FROM (SELECT *, FOLDED2 AS l FROM batches) b GROUP BY batch_id""",
    "generator_ce": """
        SELECT batch_id, avg(ln(list_sum([exp(x - list_max(l)) FOR x IN l])) + list_max(l)
                             - l[gen_label + 1]) AS loss
        FROM (SELECT *, FOLDED4 AS l FROM batches) b GROUP BY batch_id""",
    # Text features
    "words": f"""
        SELECT review_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos
        FROM (SELECT review_id, regexp_extract_all(lower(text), '{WORD_RUN}') AS w FROM reviews) r""",
    "vocabulary": """
        SELECT word, row_number() OVER (ORDER BY n DESC, word) + 1 AS id
        FROM (SELECT word, count(*) AS n FROM words GROUP BY word
             ) t""",
    "terms": f"""
        SELECT review_id,
               list_concat(w, [concat(w[i], ' ', w[i + 1]) FOR i IN range(1, len(w))]) AS t
        FROM (SELECT review_id, regexp_extract_all(lower(text), '{TOKEN_RUN}') AS w FROM reviews) r""",
    "tf": """
        SELECT review_id, term, count(*) AS tf
        FROM (SELECT review_id, unnest(t) AS term FROM terms) e GROUP BY ALL""",
    "tfidf": f"""
        SELECT term, count(*) AS df, cast(sum(tf) AS bigint) AS total,
               ln((1.0 + (SELECT count(*) FROM reviews)) / (1.0 + count(*))) + 1 AS idf
        FROM tf GROUP BY term HAVING count(*) >= 2
        ORDER BY total DESC, term LIMIT {MAX_FEATURES}""",
    "weights": """
        SELECT review_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY review_id)) AS weight
        FROM (SELECT review_id, term, (1 + ln(tf)) * idf AS raw FROM tf JOIN tfidf USING (term)) r""",
}


def _prompt() -> str:
    stars = (
        "CASE WHEN rating IS NULL OR isnan(rating) OR rating = 0 THEN 5 "
        "ELSE cast(round_even(rating, 0) AS int) END"
    )
    return (
        f"concat('Write a ', {stars}, '-star Amazon product review for: ', "
        f"coalesce(nullif(title, ''), {_q(DEFAULT_TITLE)}), chr(10), "
        "'Category: ', replace(category, '_', ' '), chr(10), "
        "'Length: about ', wc, ' words.', chr(10), "
        "'Voice: a real customer who bought this product. No emojis, no hashtags.', chr(10), "
        "'Output only the review body — no title, no preamble.')"
    )


for _name, _n in (("ce", 2), ("generator_ce", 4)):
    TABLES[_name] = TABLES[_name].replace(f"FOLDED{_n}", folded(_n))
TABLES["requests"] = TABLES["requests"].format(
    prompt=_prompt(),
    u=u32("concat('42|length|', parent_asin)"),
    gens=_list(_q(g) for g in GENERATORS),
)


def add(name: str, select: str) -> None:
    """Register a query with the named tables it needs, directly or through others."""
    import re

    needed: set[str] = set()
    open_ = [select]
    while open_:
        text = open_.pop()
        for t in TABLES:
            if t not in needed and re.search(rf"\b(FROM|JOIN)\s+{t}\b|,\s+{t}\b", text):
                needed.add(t)
                open_.append(TABLES[t])
    ctes = ",\n".join(f"{t} AS ({TABLES[t]})" for t in TABLES if t in needed)
    ORACLES[name] = (f"WITH {ctes}\n" if ctes else "") + select


def r6(*names: str) -> str:
    return _list(f"round({n}, 6) AS {n}" for n in names)


KEY = "model, rotation, split"

# Every 53rd line has text after its object; of 43 and 47 those that no earlier rule changed.
REJECTED = "(doc_id % 53 = 0 AND doc_id % 41 <> 0 AND doc_id % 19 <> 0 AND doc_id % 23 <> 0 AND doc_id % 43 <> 0 AND doc_id % 47 <> 0)"
add("scan_reviews_json", f"""
    SELECT category,
           CASE WHEN doc_id % 41 <> 0 THEN timestamp END AS timestamp,
           CASE WHEN doc_id % 41 <> 0 THEN md5(text) END AS text_md5,
           CASE WHEN doc_id % 41 <> 0 THEN user_id END AS user_id,
           CASE WHEN doc_id % 41 <> 0 THEN parent_asin END AS parent_asin,
           CASE WHEN doc_id % 41 <> 0 AND (doc_id % 19 = 0 OR (doc_id % 23 <> 0 AND doc_id % 43 <> 0)) THEN rating END AS rating,
           CASE WHEN doc_id % 41 <> 0 THEN title END AS title
    FROM raw WHERE doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND NOT {REJECTED}""")
add("rejected_reviews_json", f"""
    SELECT category, CASE WHEN doc_id % 13 = 0 THEN 'cut off' ELSE 'text after the value' END AS reason, count(*) AS n
    FROM raw WHERE doc_id % 13 = 0 OR (doc_id % 17 <> 0 AND {REJECTED}) GROUP BY ALL""")
add("scan_reviews_parquet", """
    SELECT review_id, category, rating, timestamp, label, generator, md5(text) AS text_md5
    FROM (SELECT * FROM human UNION ALL SELECT * FROM ai) r""")
add("scan_split", """
    SELECT rotation, split, review_id, category, generator, label FROM splits
    WHERE rotation = 1 AND split = 'test_crossgen'""")
add("write_reviews", """
    SELECT category, count(*) AS n, cast(sum(length(text)) AS bigint) AS n_chars
    FROM human GROUP BY category""")
add("write_splits", """
    SELECT rotation, split, generator, count(*) AS n FROM splits GROUP BY ALL""")
add("metrics_json", f"""
    SELECT {KEY}, NULL AS generator, {r6('f1', 'auc')}, cast(n AS bigint) AS n FROM metrics
    UNION ALL
    SELECT {KEY}, generator, {r6('f1', 'auc')}, cast(n AS bigint) AS n FROM per_generator""")
add("write_summary_csv", f"""
    SELECT model, {r6('f1_indist', 'f1_crossgen', 'auc_indist', 'auc_crossgen')} FROM comparison""")
add("variant_table", """
    SELECT variant, rotation, held_out, w_ce AS ce, w_contrastive AS contrastive,
           w_adversarial AS adversarial, n_train
    FROM meta, variants""")

add("cutoff_filter", f"""
    SELECT doc_id, timestamp FROM raw WHERE timestamp <> 0 AND timestamp < {CUTOFF_MS}""")
add("word_count", f"SELECT review_id, {words('text')} AS words FROM reviews")
add("word_band_filter", f"""
    SELECT review_id, generator FROM reviews WHERE {words('text')} BETWEEN 20 AND 400""")
add("text_default", """
    SELECT doc_id, cast(length(t) AS int) AS n_chars, md5(t) AS text_md5
    FROM (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN coalesce(text, '') ELSE '' END AS t
          FROM raw) r""")
add("review_key", f"""
    SELECT doc_id, concat_ws('_', category, coalesce(user_id, ''), cast(timestamp AS varchar)) AS review_id
    FROM raw WHERE timestamp <> 0 AND timestamp < {CUTOFF_MS}""")
add("human_rows", """
    SELECT * EXCLUDE (text), md5(text) AS text_md5 FROM raw_pool""")
add("ai_rows", f"""
    SELECT concat_ws('_', generator, review_id, '42') AS review_id, category,
           review_id AS parent_asin, rating, title, cast(NULL AS bigint) AS timestamp, 1 AS label,
           generator, md5(regexp_replace(text, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')) AS text_md5
    FROM ai""")
add("feature_columns", """
    SELECT review_id, md5(coalesce(text, '')) AS text_md5, label FROM reviews""")

add("category_quota", """
    SELECT cast(pos AS int) AS pos, category, quota, available
    FROM quota JOIN (SELECT category, count(*) AS available FROM human GROUP BY 1) a USING (category)""")
add("quota_take", f"""
    SELECT category, review_id
    FROM (SELECT category, review_id,
                 row_number() OVER (PARTITION BY category ORDER BY {shuffle_order('42', 'review_id')}) AS rn
          FROM human) r JOIN quota USING (category) WHERE rn <= quota""")
add("dedup_reviews", """
    SELECT review_id, doc_id, md5(text) AS text_md5
    FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY doc_id) AS rn
          FROM raw_pool) r WHERE rn = 1""")
add("seeded_shuffle", f"""
    SELECT review_id, row_number() OVER (ORDER BY {shuffle_order('42', 'review_id')}) AS position
    FROM human""")
add("human_pool", """
    SELECT review_id, category, parent_asin, rating, title, timestamp, label, generator,
           md5(text) AS text_md5
    FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY doc_id) AS copy
          FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS rn
                FROM raw_pool) r JOIN quota USING (category)
          WHERE rn <= quota) q
    WHERE copy = 1""")
add("pool_in_file_order", f"""
    SELECT review_id, category, parent_asin, rating, title, timestamp, label, generator,
           md5(text) AS text_md5
    FROM (SELECT *, row_number() OVER (PARTITION BY review_id
                        ORDER BY file, parent_asin NULLS FIRST, rating NULLS FIRST, title NULLS FIRST, text) AS copy
          FROM (SELECT r.*, quota,
                       rank() OVER (PARTITION BY r.category, file ORDER BY {shuffle_order('42', 'review_id')}) AS place,
                       n, before
                FROM (SELECT *, doc_id * 8 // ((SELECT max(doc_id) FROM documents) + 1) AS file FROM raw_pool) r
                JOIN quota USING (category)
                JOIN (SELECT category, file, n, sum(n) OVER (PARTITION BY category ORDER BY file) - n AS before
                      FROM (SELECT category, doc_id * 8 // ((SELECT max(doc_id) FROM documents) + 1) AS file, count(*) AS n
                            FROM raw_pool GROUP BY ALL) c) f USING (category, file)) p
          WHERE before + n <= quota OR (before < quota AND place <= quota - before)) q
    WHERE copy = 1""")
add("category_counts", "SELECT category, count(*) AS n FROM human GROUP BY category")
add("word_count_stats", f"""
    SELECT min(w) AS min, max(w) AS max, round(avg(w), 6) AS mean
    FROM (SELECT {words('text')} AS w FROM human) c""")
add("head_rows", """
    SELECT review_id, category, rating, title FROM human ORDER BY review_id LIMIT 5""")

add("seed_products", "SELECT parent_asin, category, rating, title, review_id FROM seeds")
add("length_draw", f"""
    SELECT review_id, wc AS target_wc
    FROM (SELECT review_id,
                 cast(floor({u32("concat('42|length|', review_id)")} / 4294967296.0
                            * (SELECT max(stop) FROM bins)) AS bigint) AS place
          FROM reviews) r JOIN bins ON start <= place AND place < stop""")
add("length_lognormal", f"""
    SELECT review_id,
           cast(floor(exp({LENGTH_MU} + {LENGTH_SIGMA} * sqrt(-2.0 * ln(u)) * cos(2.0 * pi() * v))) AS int)
             AS target_wc
    FROM (SELECT review_id,
                 1.0::double - {u32("concat('42|radius|', review_id)")} / 4294967296.0::double AS u,
                 {u32("concat('42|angle|', review_id)")} / 4294967296.0::double AS v
          FROM reviews) r""")
add("prompt_render", f"""
    SELECT review_id, {_prompt()} AS prompt
    FROM (SELECT *, {words('text')} AS wc FROM reviews) r""")
add("token_budget", f"""
    SELECT review_id, cast(floor({words('text')} * 2.5) AS int) AS max_tokens FROM reviews""")
add("chat_messages", f"""
    SELECT review_id, 1 AS n_messages, 'user' AS role, {_prompt()} AS content
    FROM (SELECT *, {words('text')} AS wc FROM reviews) r""")
add("generation_requests", """
    SELECT request_id, generator, parent_asin, category, rating, title, target_wc, prompt, max_tokens
    FROM requests""")
add("ingest_responses", """
    SELECT request_id AS review_id, category, parent_asin, rating, title, s.text,
           cast(NULL AS bigint) AS timestamp, 1 AS label, generator
    FROM requests JOIN responses s USING (request_id) WHERE error IS NULL""")
add("pending_requests", """
    SELECT request_id, generator, parent_asin FROM requests
    WHERE request_id IN (SELECT request_id FROM responses WHERE error IS NOT NULL)""")

add("rotations", """
    SELECT rotation, held_out, train_gens,
           count(*) FILTER (generator = held_out) AS n_held_out,
           count(*) FILTER (generator <> held_out) AS n_trained
    FROM gens, ai GROUP BY ALL""")
add("reserve_human", """
    SELECT rotation, CASE WHEN rn <= n // 4 THEN 'reserve' ELSE 'pool' END AS part, review_id
    FROM human_split""")
add("split_80_10_10", """
    SELECT rotation, generator,
           CASE WHEN rn <= n * 8 // 10 THEN 'train'
                WHEN rn <= n * 8 // 10 + n // 10 THEN 'val_indist' ELSE 'test_indist' END AS split,
           review_id
    FROM ai_split""")
add("balance_human", """
    SELECT rotation, split, review_id FROM human_split
    WHERE split IN ('train', 'val_indist', 'test_indist')""")
add("balance_check", """
    SELECT rotation, n_train + n_val + n_test AS need, h - h // 4 AS pool,
           greatest(n_train + n_val + n_test - (h - h // 4), 0) AS shortfall
    FROM need, (SELECT count(*) AS h FROM human) c""")
add("logo_splits", """
    SELECT rotation, split, review_id, category, generator, label FROM splits""")
add("combine_shuffle", f"""
    SELECT review_id, generator,
           row_number() OVER (ORDER BY {shuffle_order('42', 'review_id')}) AS position
    FROM (SELECT review_id, generator FROM human UNION ALL SELECT review_id, generator FROM ai) r""")
add("rotation_meta", "SELECT * FROM meta")
add("leakage_check", """
    SELECT 'review_id' AS key, g.rotation, count(DISTINCT a.review_id) AS shared
    FROM gens g LEFT JOIN (SELECT s.rotation, s.review_id FROM splits s
         WHERE split = 'train' AND EXISTS (SELECT 1 FROM splits t
           WHERE t.rotation = s.rotation AND t.split = 'test_crossgen' AND t.review_id = s.review_id)) a
      ON a.rotation = g.rotation GROUP BY g.rotation
    UNION ALL
    SELECT 'parent_asin' AS key, g.rotation, count(DISTINCT a.parent_asin) AS shared
    FROM gens g LEFT JOIN (SELECT s.rotation, s.parent_asin FROM splits s
         WHERE split = 'train' AND EXISTS (SELECT 1 FROM splits t
           WHERE t.rotation = s.rotation AND t.split = 'test_crossgen' AND t.parent_asin = s.parent_asin)) a
      ON a.rotation = g.rotation GROUP BY g.rotation""")

LABELS = """(SELECT rotation, generator, CASE WHEN generator = 'human' THEN 0 ELSE
                 row_number() OVER (PARTITION BY rotation, generator = 'human' ORDER BY generator) END AS gen_label
             FROM (SELECT DISTINCT rotation, generator FROM splits WHERE split = 'train') d)"""
add("generator_label_map", f"SELECT rotation, generator, cast(gen_label AS int) AS gen_label FROM {LABELS} m")
add("generator_label_encode", f"""
    SELECT rotation, split, generator, review_id, cast(coalesce(gen_label, 0) AS int) AS gen_label,
           gen_label IS NOT NULL AS gen_known
    FROM splits LEFT JOIN {LABELS} m USING (rotation, generator)""")
add("token_ids", f"""
    SELECT review_id,
           array_to_string(list_concat(coalesce(ids, []),
                           list_resize([]::bigint[], {MAX_LEN} - coalesce(len(ids), 0), 0)), ' ') AS ids,
           cast(coalesce(len(ids), 0) AS int) AS n_tokens, label,
           cast(CASE WHEN generator = 'human' THEN 0 ELSE gen_label END AS int) AS gen_label
    FROM reviews JOIN (
        SELECT generator, row_number() OVER (PARTITION BY generator = 'human' ORDER BY generator) AS gen_label
        FROM (SELECT DISTINCT generator FROM reviews) d) m USING (generator)
    LEFT JOIN (
        SELECT review_id, list(coalesce(id, 1) ORDER BY pos) AS ids
        FROM words LEFT JOIN vocabulary USING (word) WHERE pos < {MAX_LEN} GROUP BY review_id) e
    USING (review_id)""")
add("masked_mean_pool", """
    SELECT doc, dim, round(sum(x * mask) / greatest(sum(mask), 1e-6), 6) AS x
    FROM dims GROUP BY doc, dim""")
add("embed_table", """
    SELECT review_id, r.label, embedding IS NOT NULL AS has_vector, cast(len(embedding) AS int) AS dims,
           round(list_sum(embedding::double[]), 6) AS total
    FROM reviews r LEFT JOIN embeddings e ON review_id = concat('r', cast(vec_id AS varchar))""")
add("l2_normalize", "SELECT vec_id, dim, round(x, 6) AS x FROM unit")
add("standard_scale", """
    SELECT vec_id, d.dim, round((x - mean) / std, 6) AS x
    FROM dims d JOIN (SELECT dim, avg(x) AS mean, coalesce(nullif(stddev_pop(x), 0), 1) AS std
                      FROM dims WHERE label = 0 GROUP BY dim) s ON s.dim = d.dim""")
add("tokens_ngrams", """
    SELECT review_id, cast(len(t) AS int) AS n_terms, md5(coalesce(array_to_string(t, '|'), '')) AS terms_md5
    FROM terms""")
add("tfidf_vocab", "SELECT term, df, total, round(idf, 6) AS idf FROM tfidf")
add("tfidf_weights", """
    SELECT review_id, count(term) AS n_terms, round(coalesce(sum(weight), 0), 6) AS total,
           round(coalesce(sum(weight * length(term)), 0), 6) AS by_length,
           round(coalesce(sqrt(sum(weight * weight)), 0), 6) AS norm
    FROM (SELECT review_id FROM reviews) r LEFT JOIN weights USING (review_id) GROUP BY review_id""")

# The penalised loss has one optimum; the query measures how far a fit is from it.
add("tfidf_lr_optimum", """
    SELECT rotation, n_train, cast(least(50000, count(*)) AS int) AS n_features, TRUE AS at_optimum
    FROM (SELECT rotation, term
          FROM (SELECT DISTINCT rotation, review_id, unnest(t) AS term
                FROM splits JOIN terms USING (review_id) WHERE split = 'train') d
          GROUP BY rotation, term HAVING count(*) >= 2) f
    JOIN (SELECT rotation, count(*) AS n_train FROM splits WHERE split = 'train' GROUP BY rotation) n USING (rotation)
    GROUP BY rotation, n_train""")
add("embedding_lr_optimum", """
    SELECT rotation, count(*) AS n_train, cast(max(len(embedding)) AS int) AS n_features, TRUE AS at_optimum
    FROM splits JOIN embeddings ON review_id = concat('r', cast(vec_id AS varchar))
    WHERE split = 'train' GROUP BY rotation""")
add("softmax_prob", f"""
    SELECT vec_id, round(exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) AS p
    FROM (SELECT vec_id, l[1] AS a, l[2] AS b
          FROM (SELECT vec_id, {folded(2)} AS l FROM vectors) f) g""")
add("cross_entropy", "SELECT batch_id, round(loss, 6) AS loss FROM ce")
add("generator_cross_entropy", "SELECT batch_id, round(loss, 6) AS loss FROM generator_ce")
add("supcon_loss", "SELECT batch_id, round(loss, 6) AS loss FROM supcon")
add("weighted_loss", f"""
    SELECT batch_id, variant, {r6('ce', 'contrastive', 'adversarial')},
           round(coalesce(w_ce * ce, 0) + coalesce(w_contrastive * contrastive, 0)
                 + coalesce(w_adversarial * adversarial, 0), 6) AS total
    FROM (SELECT batch_id, variant, w_ce, w_contrastive, w_adversarial,
                 CASE WHEN w_ce > 0 THEN c.loss END AS ce,
                 CASE WHEN w_contrastive > 0 THEN s.loss END AS contrastive,
                 CASE WHEN w_adversarial > 0 THEN g.loss END AS adversarial
          FROM ce c JOIN supcon s USING (batch_id) JOIN generator_ce g USING (batch_id), variants) p""")

add("threshold_predict", f"""
    SELECT {KEY}, review_id, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pred FROM scored""")
add("confusion_counts", f"""
    SELECT {KEY}, count(*) FILTER (p >= 0.5 AND label = 1) AS tp,
           count(*) FILTER (p >= 0.5 AND label = 0) AS fp,
           count(*) FILTER (p < 0.5 AND label = 1) AS fn,
           count(*) FILTER (p < 0.5 AND label = 0) AS tn
    FROM scored GROUP BY {KEY}""")
add("f1", f"SELECT {KEY}, {r6('f1')} FROM metrics")
add("auc", f"SELECT {KEY}, {r6('auc')} FROM metrics")
add("split_metrics", f"SELECT {KEY}, {r6('f1', 'auc')}, cast(n AS bigint) AS n FROM metrics")
add("per_generator_metrics", f"""
    SELECT {KEY}, generator, {r6('f1', 'auc')}, cast(n AS bigint) AS n FROM per_generator""")
add("best_step", f"""
    SELECT run, step, f1
    FROM (SELECT run, step, f1, row_number() OVER (PARTITION BY run ORDER BY f1 DESC, step) AS rn
          FROM (SELECT run, step,
                       round(coalesce(2.0 * count(*) FILTER (label = 1 AND p >= 0.5)
                         / nullif(count(*) FILTER (label = 1) + count(*) FILTER (p >= 0.5), 0), 0), 2) AS f1
                FROM (SELECT *, (floor({u32("concat_ws('|', run, cast(step AS varchar), review_id)")}
                                       * 700 / 4294967296.0) + 300 * label) / 1000.0 AS p
                      FROM (SELECT concat_ws('_', variant, cast(rotation AS varchar)) AS run,
                                   unnest([200, 400, 600, 800, 1000]) AS step, review_id, label
                            FROM splits, variants WHERE split = 'val_indist') v) s
                GROUP BY run, step) h) r
    WHERE rn = 1""")
add("rotation_average", f"SELECT model, split, {r6('f1', 'auc')}, rotations FROM averages")
add("comparison_table", f"""
    SELECT position, model, {r6('f1_indist', 'f1_crossgen', 'auc_indist', 'auc_crossgen')}
    FROM comparison""")
add("heldout_pivot", "SELECT variant, {} FROM variants LEFT JOIN metrics m ON model = variant AND split = 'test_crossgen' GROUP BY variant".format(
    _list(f"round(max(f1) FILTER (rotation = {r}), 6) AS {g}" for r, g in enumerate(GENERATORS))
))
add("gap_table", """
    SELECT position, model, round(f1_indist, 6) AS f1_indist, round(f1_crossgen, 6) AS f1_crossgen,
           round(f1_indist - f1_crossgen, 6) AS gap
    FROM comparison""")
add("pending_runs", """
    SELECT v.variant AS model, g.rotation FROM variants v, gens g
    WHERE NOT EXISTS (SELECT 1 FROM metrics m WHERE m.model = v.variant AND m.rotation = g.rotation)""")

add("stream_review_ingest", f"""
    SELECT review_id, category, parent_asin, rating, timestamp, label, text_md5
    FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY wave, parent_asin NULLS FIRST,
                                       rating NULLS FIRST, title NULLS FIRST, text) AS copy
          FROM (SELECT review_id, category, parent_asin, title, text, timestamp, label, 2 - doc_id % 3 AS wave,
                       md5(text) AS text_md5,
                       CASE WHEN doc_id % 19 = 0 OR (doc_id % 23 <> 0 AND doc_id % 43 <> 0) THEN rating END AS rating
                FROM raw_pool
                WHERE doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND doc_id % 41 <> 0 AND NOT {REJECTED}) r) s
    WHERE copy = 1""")
