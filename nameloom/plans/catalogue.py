"""Registered queries of the retrieval engine and their SQL, over the harness tables.

``part`` plays the catalogue: each part is an entity whose scientific name is its two-word
name (shared by many parts, so lookups are ambiguous), with a unique standard name,
and an alias and, for some, a former name.  Every query asks for and searches all parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nameloom.functions import features, html
from nameloom.functions.text import abbreviation_parts, is_ascii, normalize_ascii, with_normalized
from nameloom.operators import cascade, catalogue, evaluation, names, training, vector
from nameloom.sources.shared import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """Entities from ``part``."""
    key = F.col("p_partkey")
    return _table(spark, d, "part").select(
        F.format_string("TAXON:%04d", key + 1).alias("entity_id"), F.concat_ws(" ", "p_brand", key.cast("string")).alias("standard_name_cn"), F.col("p_name").alias("scientific_name"), F.col("p_type").alias("taxon_rank"),
        F.array(F.concat_ws(" ", F.upper("p_name"), "p_brand")).alias("aliases"), F.when(key % 3 == 0, F.array(F.concat_ws(" ", F.lit("former"), key.cast("string")))).alias("former_names"),
        F.lit(None).cast("string").alias("metadata"), key.cast("long").alias("ent_ord"),
    )


ENT = """ent AS (SELECT p_partkey::BIGINT AS ent_ord, 'TAXON:' || printf('%04d', p_partkey + 1) AS entity_id, p_brand || ' ' || p_partkey AS standard_name_cn,
  p_name AS scientific_name, p_type AS taxon_rank, [upper(p_name) || ' ' || p_brand] AS aliases, CASE WHEN p_partkey % 3 = 0 THEN ['former ' || p_partkey] ELSE [] END AS former_names FROM part)"""
#: ``one``: the catalogue that is asked, here all of it.
ONE = ENT + ", one AS (SELECT * FROM ent)"


def names_sql(source: str) -> str:
    """CTEs ``nm`` of the names of a catalogue; names of these catalogues are distinct within an entity."""
    return f"""nm AS (SELECT ent_ord, entity_id, i - 1 AS name_ord, l[i] AS name, lower(l[i]) AS norm FROM
  (SELECT ent_ord, entity_id, [standard_name_cn, scientific_name] || aliases || former_names AS l FROM {source}), UNNEST(generate_series(1, len(l))) AS u(i))"""


ALL_NAMES = f"WITH {ENT}, {names_sql('ent')}"


@query(r"""SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\b([A-Za-z])[\s\x0b\x1c-\x1f]*\.[\s\x0b\x1c-\x1f]*([A-Za-z][A-Za-z-]*)\b', '\1. \2', 'g'),
  '[\s\x0b\x1c-\x1f]+', ' ', 'g'), '^[\s\x0b\x1c-\x1f,;:]+', ''), '[\s\x0b\x1c-\x1f,;:]+$', '')) AS norm FROM documents WHERE octet_length(encode(text)) = length(text)""")
def normalize_ascii_documents(spark, d):
    return _table(spark, d, "documents").where(is_ascii(F.col("text"))).select("doc_id", normalize_ascii(F.col("text")).alias("norm"))


@query()
def normalize_unicode_documents(spark, d):
    return with_normalized(_table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "norm")


def _abbreviated(spark, d):
    rows = catalog(spark, d).select("entity_id", F.concat(F.upper(F.substring("scientific_name", 1, 1)), F.lit(" . "), F.substring_index("scientific_name", " ", -1)).alias("query"))
    return with_normalized(rows, "query")


@query(f"WITH {ENT} SELECT entity_id, lower(scientific_name[1]) AS initial, split_part(scientific_name, ' ', 2) AS epithet FROM ent")
def latin_abbrev_parse(spark, d):
    initial, epithet = abbreviation_parts(F.col("norm"))
    return _abbreviated(spark, d).select("entity_id", initial.alias("initial"), epithet.alias("epithet"))


@query(f"{ALL_NAMES} SELECT ent_ord, entity_id, name_ord, name FROM nm")
def entity_names_explode(spark, d):
    return names.explode_names(catalog(spark, d)).withColumn("name_ord", F.col("name_ord").cast("long"))


DICTIONARY = """dict AS (SELECT norm, string_agg(entity_id, ',' ORDER BY ent_ord) AS ids, count(*) AS n FROM (SELECT norm, entity_id, min(ent_ord) AS ent_ord FROM nm GROUP BY 1, 2) GROUP BY norm),
  dn AS (SELECT norm, string_agg(name, '|' ORDER BY o) AS matched FROM (SELECT norm, name, min(ent_ord * 1000 + name_ord) AS o FROM nm GROUP BY 1, 2) GROUP BY norm)"""


@query(f"{ALL_NAMES}, {DICTIONARY} SELECT norm, ids AS entity_ids, matched AS matched_names FROM dict JOIN dn USING (norm)")
def alias_dict_build(spark, d):
    return names.alias_dictionary(catalog(spark, d)).select("norm", F.array_join("entity_ids", ",").alias("entity_ids"), F.array_join("matched_names", "|").alias("matched_names"))


def _asked(rows: DataFrame, text) -> DataFrame:
    return with_normalized(rows.select(F.col("entity_id").alias("qid"), text.alias("query")), "query")


@query(f"WITH {ENT} SELECT entity_id AS qid, entity_id, standard_name_cn AS matched_name, 'exact' AS source FROM ent")
def alias_exact_single(spark, d):
    entities = catalog(spark, d)
    asked = _asked(entities, F.concat(F.lit("  "), F.upper(F.replace("standard_name_cn", F.lit(" "), F.lit("   "))), F.lit(" ;")))
    return cascade.alias_hits(asked, written(names.alias_dictionary(entities), "aliases")).select("qid", "entity_id", "matched_name", "source")


AMBIGUOUS = f"WITH {ONE} SELECT one.entity_id AS qid, (row_number() OVER (PARTITION BY one.entity_id ORDER BY ent.ent_ord) - 1)::BIGINT AS pos, ent.entity_id, one.scientific_name AS matched_name, CASE WHEN count(*) OVER (PARTITION BY one.entity_id) = 1 THEN 'exact' ELSE 'ambiguous_alias' END AS source FROM one JOIN ent USING (scientific_name)"


def _ambiguous(spark, d, entities: DataFrame) -> DataFrame:
    asked = _asked(entities, F.initcap("scientific_name"))
    return cascade.alias_hits(asked, written(names.alias_dictionary(catalog(spark, d)), "aliases")).select("qid", F.col("pos").cast("long").alias("pos"), "entity_id", "matched_name", "source")


@query(AMBIGUOUS)
def alias_ambiguous(spark, d):
    return _ambiguous(spark, d, catalog(spark, d))


LOOKUP = "lk AS (SELECT lower(scientific_name[1]) AS initial, split_part(lower(scientific_name), ' ', 2) AS epithet, entity_id, ent_ord FROM {0})"


@query(f"WITH {ENT}, {LOOKUP.format('ent')} SELECT initial, epithet, string_agg(entity_id, ',' ORDER BY ent_ord) AS entity_ids FROM lk GROUP BY 1, 2")
def latin_lookup_build(spark, d):
    return names.abbreviation_lookup(catalog(spark, d)).select("initial", "epithet", F.array_join("entity_ids", ",").alias("entity_ids"))


EXPANDED = f"WITH {ONE}, {LOOKUP.format('one')}, hits AS (SELECT q.entity_id AS qid, lk.entity_id, count(*) OVER (PARTITION BY q.entity_id) AS n FROM one q JOIN lk ON lower(q.scientific_name[1]) = initial AND split_part(q.scientific_name, ' ', 2) = epithet)"


def _expanded(queried: DataFrame, entities: DataFrame) -> DataFrame:
    asked = _asked(queried, F.concat(F.upper(F.substring("scientific_name", 1, 1)), F.lit("."), F.substring_index("scientific_name", " ", -1)))
    return cascade.abbreviation_hits(asked, written(names.abbreviation_lookup(entities), "abbreviations"))


def _some_unique(entities: DataFrame) -> DataFrame:
    """The catalogue with an epithet of its own, spelled from its number, for every third part."""
    own = F.concat(F.substring_index("scientific_name", " ", 1), F.lit(" "), F.translate(F.col("ent_ord").cast("string"), "0123456789", "abcdefghij"))
    return entities.withColumn("scientific_name", F.when(F.col("ent_ord") % 3 == 0, own).otherwise(F.col("scientific_name")))


UNIQUE = "SELECT * REPLACE (CASE WHEN ent_ord % 3 = 0 THEN split_part(scientific_name, ' ', 1) || ' ' || translate(ent_ord::VARCHAR, '0123456789', 'abcdefghij') ELSE scientific_name END AS scientific_name) FROM ent"


@query(f"{EXPANDED.replace('one AS (SELECT * FROM ent)', f'one AS ({UNIQUE})')} SELECT qid, entity_id, 'expanded_exact' AS source FROM hits WHERE n = 1")
def latin_expand_single(spark, d):
    entities = _some_unique(catalog(spark, d))
    return _expanded(entities, entities).where("source = 'expanded_exact'").select("qid", "entity_id", "source")


@query(f"{EXPANDED} SELECT qid, entity_id, 'ambiguous_abbreviation' AS source FROM hits WHERE n > 1")
def latin_expand_ambiguous(spark, d):
    return _expanded(catalog(spark, d), catalog(spark, d)).where("source = 'ambiguous_abbreviation'").select("qid", "entity_id", "source")


FEATURES = """base AS (SELECT entity_id AS id, lower({1}) AS norm FROM {0}), ft AS (
  SELECT id, 'tok:' || t AS feature, 2 AS w FROM base, UNNEST(string_split(norm, ' ')) AS u(t) WHERE t <> ''
  UNION ALL SELECT id, 'ng' || n || ':' || substr(c, i, n), 1 FROM (SELECT id, replace(norm, ' ', '') AS c FROM base), UNNEST([1, 2, 3, 4]) AS v(n), UNNEST(generate_series(1, length(c) - n + 1)) AS u(i)),
  tf AS (SELECT id, feature, sum(w)::BIGINT AS tf FROM ft GROUP BY 1, 2)"""


def _frequencies(entities: DataFrame, column: str) -> DataFrame:
    return features.term_frequencies(with_normalized(entities.select(F.col("entity_id").alias("id"), F.col(column).alias("name")), "name"), "id", "norm")


@query(f"WITH {ENT}, {FEATURES.format('ent', 'standard_name_cn')} SELECT id, feature, tf FROM tf")
def ngram_term_frequency(spark, d):
    return _frequencies(catalog(spark, d), "standard_name_cn")


@query(f"WITH {ENT}, {FEATURES.format('ent', 'standard_name_cn')} SELECT id, feature, round(tf / sqrt(sum((tf * tf)::DOUBLE) OVER (PARTITION BY id)), 6) AS weight FROM tf")
def ngram_l2_weights(spark, d):
    return features.unit_weights(_frequencies(catalog(spark, d), "standard_name_cn"), "id").select("id", "feature", F.round("weight", 6).alias("weight"))


COSINE = f"""WITH {ONE}, {FEATURES.format('one', 'scientific_name')}, w AS (SELECT id, feature, tf / sqrt(sum((tf * tf)::DOUBLE) OVER (PARTITION BY id)) AS weight FROM tf),
  s AS (SELECT a.id AS qid, b.id AS cid, round(sum(a.weight * b.weight), 6) AS score FROM w a JOIN w b USING (feature) WHERE a.id <> b.id GROUP BY 1, 2)
  SELECT qid, cid, score FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) <= 5"""


@query(COSINE)
def ngram_sparse_cosine_topk(spark, d):
    """Equal names have equal scores, so names are compared once; of each, its six smallest ids can be among five others."""
    named = with_normalized(catalog(spark, d).select("entity_id", "scientific_name"), "scientific_name").select("entity_id", "norm")
    w = features.unit_weights(features.term_frequencies(named.select(F.col("norm").alias("id"), "norm").distinct(), "id", "norm"), "id")
    pairs = features.sparse_cosine(w.withColumnRenamed("id", "qid"), w.withColumnRenamed("id", "cid")).withColumn("score", F.round("score", 6))
    first = named.withColumn("_n", F.row_number().over(Window.partitionBy("norm").orderBy("entity_id"))).where("_n <= 6").select(F.col("norm").alias("cid"), "entity_id")
    six = vector.top_k(pairs.join(first, "cid").withColumn("first_ord", F.col("entity_id")), 6, 0.82).select("qid", "entity_id", "score")
    found = named.select(F.col("entity_id").alias("id"), F.col("norm").alias("qid")).join(six, "qid").where("id <> entity_id").drop("qid")
    return vector.top_k(found.select(F.col("id").alias("qid"), "entity_id", F.col("entity_id").alias("first_ord"), "score"), 5, 0.82).select("qid", F.col("entity_id").alias("cid"), "score")


@query(f"""WITH {ENT}, {FEATURES.format('ent', 'standard_name_cn')}, h AS (SELECT id, ('0x' || substr(md5(feature), 1, 8))::BIGINT % 512 AS bucket, sum(tf)::BIGINT AS tf FROM tf GROUP BY 1, 2)
  SELECT id, bucket, round(tf / sqrt(sum((tf * tf)::DOUBLE) OVER (PARTITION BY id)), 6) AS weight FROM h""")
def ngram_md5_hashed_vector(spark, d):
    return features.hashed_weights(_frequencies(catalog(spark, d), "standard_name_cn"), "id").select("id", "bucket", F.round("weight", 6).alias("weight"))


@query()
def ngram_blake2b_vector(spark, d):
    rows = with_normalized(names.explode_names(catalog(spark, d)), "name")
    return rows.select("entity_id", "name_ord", features.ngram_vector("norm").alias("vector"))


SCORES = """sc AS (SELECT q.vec_id AS qid, r.vec_id, r.label, list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS score
  FROM embeddings q JOIN embeddings r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id)"""
BEST = SCORES + ", best AS (SELECT qid, label, max(round(score, 6)) AS score, min(vec_id) AS first_ord FROM sc GROUP BY 1, 2)"


def _vector_scores(spark, d) -> DataFrame:
    rows = _table(spark, d, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query_vector"))
    records = rows.select(F.col("label").cast("string").alias("entity_id"), F.col("vec_id").alias("ent_ord"), F.lit(0).alias("name_ord"), F.col("vec_id").cast("string").alias("name"), F.col("embedding").alias("vector"))
    return vector.scores(asked, records, F.col("qid") != F.col("ent_ord"))


def _vector_top(spark, d, k: int) -> DataFrame:
    best = vector.best_per_entity(_vector_scores(spark, d)).withColumn("score", F.round("score", 6))
    return vector.top_k(best, k, 0.3)


@query(f"WITH {SCORES} SELECT qid, vec_id, round(score, 6) AS score FROM sc")
def vector_cosine_scores(spark, d):
    return _vector_scores(spark, d).select("qid", F.col("ent_ord").alias("vec_id"), F.round("score", 6).alias("score"))


@query(f"WITH {BEST} SELECT qid, label::VARCHAR AS entity_id, score FROM best")
def vector_max_per_entity(spark, d):
    return vector.best_per_entity(_vector_scores(spark, d)).select("qid", "entity_id", F.round("score", 6).alias("score"))


@query(f"WITH {BEST} SELECT qid, label::VARCHAR AS entity_id, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, first_ord))::BIGINT AS rank, score < 0.3 AS low_confidence FROM best QUALIFY rank <= 5")
def vector_topk_threshold(spark, d):
    return _vector_top(spark, d, 5).select("qid", "entity_id", "score", F.col("rank").cast("long").alias("rank"), "low_confidence")


RANKS = f"WITH {BEST}, rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first_ord) AS rank FROM best), ranks AS (SELECT e.vec_id AS qid, e.label::VARCHAR AS target_entity_id, CASE WHEN e.vec_id % 100 = 0 THEN 'alias' ELSE 'entity' END AS split, rk.rank::BIGINT AS rank FROM embeddings e LEFT JOIN rk ON rk.qid = e.vec_id AND rk.label = e.label AND rk.rank <= 3 WHERE e.vec_id % 50 = 0)"


def _ranks(spark, d) -> DataFrame:
    asked = _table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("label").cast("string").alias("target_entity_id"), F.when(F.col("vec_id") % 100 == 0, "alias").otherwise("entity").alias("split"))
    return evaluation.target_ranks(asked, _vector_top(spark, d, 3)).withColumn("rank", F.col("rank").cast("long"))


@query(f"{RANKS} SELECT qid, target_entity_id, split, coalesce(rank, 0) AS rank FROM ranks")
def eval_rank(spark, d):
    return _ranks(spark, d).withColumn("rank", F.coalesce("rank", F.lit(0)).cast("long"))


@query(f"""{RANKS}, b AS (SELECT 'all' AS bucket, rank FROM ranks UNION ALL SELECT split, rank FROM ranks)
  SELECT bucket, count(*) AS count, round(count(*) FILTER (rank = 1) / count(*), 4) AS top1_accuracy, round(count(*) FILTER (rank <= 3) / count(*), 4) AS top3_recall, round(sum(coalesce(1.0::DOUBLE / rank, 0)) / count(*), 4) AS mrr FROM b GROUP BY bucket""")
def eval_metrics_by_bucket(spark, d):
    return evaluation.metrics(_ranks(spark, d))


def _cascade(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries (qid, _text) and the results of each distinct text; a query has those of its text."""
    sci = F.col("scientific_name")
    texts = F.array(F.upper(sci), F.concat(F.upper(F.substring(sci, 1, 1)), F.lit("."), F.substring_index(sci, " ", -1)), F.concat(sci, F.lit("x")))
    asked = entities.select(F.posexplode(texts).alias("k", "query"), "entity_id").select(F.concat_ws(":", "entity_id", "k").alias("qid"), "query")
    # equal texts have equal results, so each is resolved once
    found = cascade.retrieve(asked.select(F.col("query").alias("qid"), "query").distinct(), cascade.build_index(entities, "char-ngram-sparse"))
    return asked.withColumnRenamed("query", "_text"), written(found.withColumnRenamed("qid", "_text"), "found")


@query()
def cascade_results(spark, d):
    return cascade.spread(*_cascade(catalog(spark, d)), ["_text"]).drop("_text")


EXACT = "SELECT CASE WHEN n = 1 THEN 'exact' ELSE 'ambiguous_alias' END AS source, sum(n * n)::BIGINT AS n_rows FROM (SELECT count(*) AS n FROM one GROUP BY scientific_name) GROUP BY 1"
STAGES = f"""{EXPANDED}, n AS (SELECT count(*) AS n FROM one) {EXACT} UNION ALL SELECT 'embedding', least(5, n) * n FROM n
  UNION ALL SELECT CASE WHEN n = 1 THEN 'expanded_exact' ELSE 'ambiguous_abbreviation' END, count(*) FROM hits GROUP BY 1"""


@query(STAGES)
def cascade_stage_counts(spark, d):
    """A text's results count once for each query with it, so texts are counted before they meet."""
    asked, found = _cascade(catalog(spark, d))
    pairs = asked.groupBy("_text").agg(F.count(F.lit(1)).alias("_asked")).join(found.groupBy("_text", "source").agg(F.count(F.lit(1)).alias("_found")), "_text")
    return pairs.groupBy("source").agg(F.sum(F.col("_asked") * F.col("_found")).alias("n_rows"))


@query(r"""SELECT page_id, i - 1 AS pos, l[i] AS item FROM (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<li\b[^>]*>(.*?)</li>', 1), lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(x, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM pages), UNNEST(generate_series(1, len(l))) AS u(i)""")
def html_list_items(spark, d):
    return _table(spark, d, "pages").select("page_id", F.posexplode(html.list_items(F.col("html"))).alias("pos", "item")).withColumn("pos", F.col("pos").cast("long"))


_HOST = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"


@query(f"""SELECT page_id, i - 1 AS link_ord, host || h[i] AS href, trim(regexp_replace(replace(replace(t[i], '&amp;', '&'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text
  FROM (SELECT page_id, {_HOST} AS host, regexp_extract_all(html, '<a href="(/[^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="(/[^"]*)">([^<]*)</a>', 2) AS t FROM pages), UNNEST(generate_series(1, len(h))) AS u(i)""")
def html_links(spark, d):
    return html.links(_table(spark, d, "pages"))


@query(f"""SELECT DISTINCT {_HOST} || href AS url FROM (SELECT url, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS href FROM pages) WHERE regexp_matches(href, '^[^?#%]*e$') UNION SELECT 'http://start.example/'""")
def html_link_discovery_distinct(spark, d):
    return html.category_urls(html.links(_table(spark, d, "pages")), "http://start.example/", path_end="e", query_part="")


@query(r"""SELECT doc_id, regexp_extract(text, '\b([A-Z][a-z]+(?:\s+[a-z][a-z.-]+)+(?:\s+subsp\.\s+[a-z-]+)?)\b', 1) AS latin FROM documents WHERE octet_length(encode(text)) = length(text)""")
def latin_name_extract(spark, d):
    return _table(spark, d, "documents").where(is_ascii(F.col("text"))).select("doc_id", html.first_latin("text").alias("latin"))


@query()
def latin_name_extract_unicode(spark, d):
    return _table(spark, d, "documents").select("doc_id", html.first_latin("text").alias("latin"))


@query("""WITH c AS (SELECT page_id % 7 AS category, page_id // 7 AS page_no, length(html) % 3 AS n FROM pages), s AS (SELECT *, n = 0 AND lag(n) OVER (PARTITION BY category ORDER BY page_no) = 0 AS stop FROM c),
  e AS (SELECT *, coalesce(max(stop::INT) OVER (PARTITION BY category ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM s) SELECT category, page_no, n FROM e WHERE earlier = 0""")
def page_stop_rule(spark, d):
    counts = _table(spark, d, "pages").select((F.col("page_id") % 7).alias("category"), F.expr("page_id div 7").alias("page_no"), (F.length("html") % 3).cast("long").alias("n"))
    return catalogue.pages_before_stop(counts)


def _seen(spark, d) -> DataFrame:
    return _table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.initcap("p_name").alias("scientific_name"), F.col("p_type").alias("category"), F.concat(F.lit("/page/"), "p_brand").alias("url"))


@query("SELECT p_partkey AS ord, p_name AS k, p_type AS category FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) = 1")
def candidate_first_wins(spark, d):
    return catalogue.first_wins(_seen(spark, d)).select("ord", F.lower("scientific_name").alias("k"), "category")


@query("""WITH s AS (SELECT p_name AS k, p_partkey AS ord, p_type AS category, '/page/' || p_brand AS url, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part),
  o AS (SELECT * FROM s WHERE rn > 1 QUALIFY row_number() OVER (PARTITION BY k, url ORDER BY ord) = 1) SELECT k, string_agg(category || '@' || url, ',' ORDER BY ord) AS examples FROM o GROUP BY k""")
def candidate_source_examples(spark, d):
    found = catalogue.source_examples(_seen(spark, d))
    return found.select("k", F.array_join(F.transform("examples", lambda e: F.concat(e["category"], F.lit("@"), e["url"])), ",").alias("examples"))


@query(f"""WITH {ENT}, sized AS (SELECT ent.*, p_size FROM ent JOIN part ON p_partkey = ent_ord), base AS (SELECT * FROM sized WHERE p_size <= 5),
  fresh AS (SELECT * FROM sized WHERE p_size > 5 AND lower(scientific_name) NOT IN (SELECT lower(scientific_name) FROM base) QUALIFY row_number() OVER (PARTITION BY lower(scientific_name) ORDER BY ent_ord) = 1),
  m AS (SELECT coalesce(max(substr(entity_id, 7)::BIGINT), 0) AS m FROM base)
  SELECT ent_ord AS ord, false AS is_new, entity_id, scientific_name FROM base UNION ALL SELECT ent_ord, true, 'TAXON:' || printf('%04d', m + row_number() OVER (ORDER BY ent_ord)), scientific_name FROM fresh, m""")
def catalog_merge_ids(spark, d):
    rows = catalog(spark, d).join(_table(spark, d, "part").select(F.col("p_partkey").alias("ent_ord"), "p_size"), "ent_ord").withColumnRenamed("ent_ord", "ord")
    return catalogue.merge(rows.where("p_size <= 5"), rows.where("p_size > 5"))


SPLIT = ONE + """, sp AS (SELECT *, row_number() OVER (ORDER BY md5('13:' || entity_id), ent_ord) - 1 AS split_ord, greatest(1, round_even(count(*) OVER () * 0.2, 0)) AS size FROM one),
  tr AS (SELECT * FROM sp WHERE split_ord >= size), ev AS (SELECT * FROM sp WHERE split_ord < size)"""


def _split(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = training.split_entities(entities)
    return rows.where("not is_eval"), rows.where("is_eval")


SPLITS = f"WITH {SPLIT} SELECT entity_id, split_ord, split_ord < size AS is_eval FROM sp"


def _entity_split(entities: DataFrame) -> DataFrame:
    return training.split_entities(entities).select("entity_id", F.col("split_ord").cast("long").alias("split_ord"), "is_eval")


@query(SPLITS)
def entity_split(spark, d):
    return _entity_split(catalog(spark, d))


def _named_sql(source: str, out: str) -> str:
    """Names of a catalogue; the canonical one is the standard name, so all others count as other names."""
    return f"{out} AS (SELECT ent_ord, entity_id, standard_name_cn AS canonical, i - 1 AS name_ord, l[i] AS name, lower(l[i]) AS norm, len(l) AS n FROM (SELECT *, [standard_name_cn, scientific_name] || aliases || former_names AS l FROM {source}), UNNEST(generate_series(1, len(l))) AS u(i))"


HOLDOUTS = f"""{SPLIT}, {_named_sql('tr', 'trn')}, ho AS (SELECT entity_id, ent_ord, name AS heldout, norm AS heldout_norm, canonical FROM trn WHERE name_ord = n - 1 AND n >= 3 AND ('0x' || substr(md5('30:' || entity_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.4)"""


HELD = f"WITH {HOLDOUTS} SELECT entity_id, heldout FROM ho"


def _alias_holdouts(entities: DataFrame) -> DataFrame:
    return training.alias_holdouts(_split(entities)[0]).select("entity_id", "heldout")


@query(HELD)
def alias_holdouts(spark, d):
    return _alias_holdouts(catalog(spark, d))


NEGATIVES = """hn AS (SELECT ent_ord, entity_id, standard_name_cn AS canonical, coalesce(
  (SELECT min_by(b.standard_name_cn, b.ent_ord) FROM tr b WHERE split_part(b.scientific_name, ' ', 1) = split_part(a.scientific_name, ' ', 1) AND b.entity_id <> a.entity_id),
  (SELECT min_by(b.standard_name_cn, b.ent_ord) FROM tr b WHERE b.taxon_rank = a.taxon_rank AND b.entity_id <> a.entity_id),
  (SELECT min_by(b.standard_name_cn, b.ent_ord) FROM tr b WHERE b.entity_id <> a.entity_id), standard_name_cn) AS hard_negative FROM tr a)"""


HARD = f"WITH {SPLIT}, {NEGATIVES} SELECT entity_id, canonical, hard_negative FROM hn"


def _hard_negatives(entities: DataFrame) -> DataFrame:
    return training.hard_negatives(_split(entities)[0]).select("entity_id", "canonical", "hard_negative")


@query(HARD)
def hard_negatives(spark, d):
    return _hard_negatives(catalog(spark, d))


TRIPLETS = f"""WITH {HOLDOUTS}, {NEGATIVES}, an AS (SELECT trn.* FROM trn LEFT JOIN ho USING (entity_id) WHERE name_ord > 0 AND (heldout_norm IS NULL OR norm <> heldout_norm) QUALIFY row_number() OVER (PARTITION BY trn.entity_id ORDER BY name_ord) <= 2)
  SELECT name AS anchor, an.canonical AS positive, hard_negative, an.entity_id FROM an JOIN hn USING (entity_id) QUALIFY row_number() OVER (PARTITION BY norm, lower(an.canonical), lower(hard_negative) ORDER BY an.ent_ord, name_ord) = 1"""


def _training_triplets(entities: DataFrame) -> DataFrame:
    train, _ = _split(entities)
    return training.training_triplets(train, training.alias_holdouts(train), max_pairs=2).select("anchor", "positive", "hard_negative", "entity_id")


@query(TRIPLETS)
def training_triplets(spark, d):
    return _training_triplets(catalog(spark, d))


EVALUATED = f"""WITH {HOLDOUTS}, {_named_sql('ev', 'evn')} SELECT heldout AS query, entity_id AS target_entity_id, canonical AS target_name, 'alias' AS split FROM ho
  UNION ALL SELECT name, entity_id, canonical, 'entity' FROM evn WHERE name_ord BETWEEN 1 AND 2"""


def _eval_rows(entities: DataFrame) -> DataFrame:
    train, held = _split(entities)
    return training.evaluation_queries(train, held, training.alias_holdouts(train), max_queries=2)


@query(EVALUATED)
def eval_rows(spark, d):
    return _eval_rows(catalog(spark, d))


def _recall(entities: DataFrame) -> DataFrame:
    return cascade.recall_summary(cascade.recall_report(entities, cascade.build_index(entities, "char-ngram-sparse")))


@query(f"""{ALL_NAMES}, f AS (SELECT norm, min(ent_ord) AS top FROM nm GROUP BY norm), x AS (SELECT ent_ord, unnest(aliases) AS x, 'alias' AS k FROM ent UNION ALL SELECT ent_ord, unnest(former_names), 'former_name' FROM ent)
  SELECT count(*) AS total_cases, count(*) FILTER (top = ent_ord) AS top1_hits, round(count(*) FILTER (top = ent_ord) / count(*), 4) AS top1_accuracy, count(*) FILTER (k = 'alias') AS alias_cases, count(*) FILTER (k = 'former_name') AS former_name_cases FROM x JOIN f ON lower(x) = norm""")
def recall_report_summary(spark, d):
    return _recall(catalog(spark, d))


@query(f"{ALL_NAMES} SELECT (SELECT count(DISTINCT entity_id) FROM ent) AS entities, (SELECT count(*) FROM nm) AS name_vectors, (SELECT count(DISTINCT norm) FROM nm) AS alias_keys, 'char-ngram-sparse' AS backend")
def index_status(spark, d):
    return cascade.index_status(cascade.build_index(catalog(spark, d), "char-ngram-sparse"))


def _listing(spark: SparkSession, d: str) -> DataFrame:
    """Pages of four parts each: table rows on even pages, whole columns one after another on odd ones."""
    key, items = F.col("p_partkey").cast("long"), F.col("items")
    latin = F.concat(F.upper(F.substring("p_name", 1, 1)), F.substr("p_name", F.lit(2)))
    rows = _table(spark, d, "part").select(key.alias("key"), F.expr("p_partkey div 4").cast("long").alias("page_id"), F.concat(F.lit("酵母"), key.cast("string")).alias("cn"), latin.alias("latin"))
    pages = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("key", "cn", "latin"))).alias("items"))
    cells = F.transform(items, lambda x: F.concat(F.lit("<tr><td>"), x["cn"], F.lit("</td><td>"), x["latin"], F.lit('</td><td><a href="/cicc/detail/?cid='), x["key"].cast("string"), F.lit('">查看详情</a></td></tr>')))
    columns = F.concat(F.array(*map(F.lit, html.HEADERS)), F.transform(items, lambda x, i: (i + 1).cast("string")), F.transform(items, lambda x: F.concat(F.lit("CICC "), x["key"].cast("string"))), F.transform(items, lambda x: x["cn"]), F.transform(items, lambda x: x["latin"]))
    listed = F.transform(columns, lambda x: F.concat(F.lit("<li>"), x, F.lit("</li>")))
    return pages.select("page_id", F.concat(F.lit("http://list.example/"), F.col("page_id").cast("string")).alias("url"), F.array_join(F.when(F.col("page_id") % 2 == 0, cells).otherwise(listed), "").alias("html"))


@query("""SELECT p_partkey // 4 AS page_id, 'http://list.example/' || p_partkey // 4 AS url, (row_number() OVER (PARTITION BY p_partkey // 4 ORDER BY p_partkey) - 1)::BIGINT AS row_ord, '酵母' || p_partkey AS cn, upper(p_name[1]) || substr(p_name, 2) AS latin,
  CASE WHEN p_partkey // 4 % 2 = 0 THEN p_partkey::VARCHAR END AS cid, CASE WHEN p_partkey // 4 % 2 = 1 THEN 'CICC ' || p_partkey END AS strain FROM part""")
def html_page_candidates(spark, d):
    return html.page_candidates(_listing(spark, d)).withColumn("row_ord", F.col("row_ord").cast("long"))
