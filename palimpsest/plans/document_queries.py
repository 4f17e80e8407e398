"""Queries over texts: documents, pages, conversations, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import changes, glossary, quality, resolve, rules, scopes, writes
from .base import query, table

_KEYWORDS = ["idiot", "scum", "und", "la"]


_KEYWORD_SQL = " UNION ALL ".join(f"SELECT '{k}' AS keyword, count(*) AS n_docs FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}]){k}([^\\p{{L}}\\p{{N}}]|$)')" for k in _KEYWORDS)


@query(_KEYWORD_SQL)
def keyword_word_boundary(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(tx.keywords_found(F.col("text"), _KEYWORDS)).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n_docs"))


@query("""SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])scum([^\\p{L}\\p{N}]|$)')
OR (regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])la([^\\p{L}\\p{N}]|$)') AND (contains(lower(text), 'license') OR contains(lower(text), '@mail')))""")
def ambiguous_keyword_context(spark, sf_dir):
    hit = tx.keyword_profile([F.col("text")], ["scum", "la"], ambiguous=["la"], context=["license", "@mail"])
    return table(spark, sf_dir, "documents").filter(hit).select("doc_id")


@query("""SELECT doc_id, regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])idiot([^\\p{L}\\p{N}]|$)') AS hit FROM documents ORDER BY hit DESC, doc_id LIMIT 40""")
def keyword_priority_selection(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.keyword_matches(F.col("text"), "idiot").alias("hit")).orderBy(F.desc("hit"), "doc_id").limit(40)


@query("""SELECT d.lang, d.source, count(*) AS total, count(*) FILTER (l.quality IS NOT NULL) AS quality, count(*) FILTER (l.toxic IS NOT NULL) AS toxic, count(*) FILTER (trim(d.text) NOT IN ('', '-', '[]')) AS text
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL""")
def coverage_matrix(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return quality.coverage_matrix(joined, [F.col("lang"), F.col("source")], {"quality": F.col("quality"), "toxic": F.col("toxic"), "text": F.col("text")})


@query("""WITH j AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)) SELECT 'quality' AS field_name, count(*) FILTER (quality IS NULL) AS missing, count(*) AS total FROM j
UNION ALL SELECT 'toxic', count(*) FILTER (toxic IS NULL), count(*) FROM j UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL), count(*) FROM j""")
def missing_field_counts(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return quality.missing_counts(joined, ["quality", "toxic", "lang"]).select("field_name", "missing", "total")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlinked_records(spark, sf_dir):
    return scopes.outside(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang")


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]*>', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS text FROM pages")
def html_clean_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.clean_markup(F.col("html")).alias("text"))


@query("""SELECT doc_id, n_items, first_item FROM (
SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS n_items,
list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS first_item FROM documents)""")
def list_normalise(spark, sf_dir):
    items = F.from_json(tx.to_json_array(F.col("text")), "array<string>")
    return table(spark, sf_dir, "documents").select("doc_id", items.alias("x")).select("doc_id", F.coalesce(F.size("x"), F.lit(0)).cast("long").alias("n_items"), F.try_element_at("x", F.lit(1)).alias("first_item"))


@query("""SELECT conv_id, turn, old_role, role AS new_role FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS old_role FROM conversations) WHERE old_role IS NOT NULL AND old_role <> role""")
def adjacent_turn_changes(spark, sf_dir):
    found = changes.detect_changes(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], ["role"], carry=["turn"])
    return found.select("conv_id", "turn", F.col("old_value").alias("old_role"), F.col("new_value").alias("new_role"))


@query("""SELECT facet, value, count(*) AS n FROM (SELECT 'lang' AS facet, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents) WHERE trim(value) <> '' GROUP BY ALL""")
def document_facets(spark, sf_dir):
    return rules.facets(table(spark, sf_dir, "documents"), {"lang": F.col("lang"), "source": F.col("source")}, {})


_GRAMS = """WITH t AS (SELECT min(p_partkey) AS k, lower(p_name) AS s FROM part GROUP BY p_name),
g AS (SELECT DISTINCT k, substr(s, i, 3) AS gram FROM t, LATERAL (SELECT unnest(generate_series(1, length(s) - 2)) AS i)),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.k > b.k GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT a, b, shared FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) <= 200"""


@query(_GRAMS)
def trigram_candidates(spark, sf_dir):
    """A top-k report over distinct part names, each by its smallest key: the best 200 partners of a name."""
    names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))
    return resolve.trigram_candidates(names, "p_partkey", "p_name", 5).select("a", "b", F.col("shared").cast("long").alias("shared"))


@query()
def title_similarity(spark, sf_dir):
    """Similar part names: whole values of a short column, every pair of distinct names."""
    return resolve.similar_titles(table(spark, sf_dir, "part"), "p_partkey", "p_name", ratio=0.85)


@query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, w[i] || ' ' || w[i + 1] AS phrase FROM w, LATERAL (SELECT unnest(generate_series(1, len(w) - 1)) AS i) WHERE w[i] NOT IN ('the', 'of', 'and') AND w[i + 1] NOT IN ('the', 'of', 'and'))
SELECT phrase, count(DISTINCT doc_id) AS n_texts FROM g WHERE length(phrase) BETWEEN 3 AND 60 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2""")
def ngram_mining(spark, sf_dir):
    """Word pairs (runs of letters of any script) of two texts or more."""
    docs = table(spark, sf_dir, "documents").withColumn("t", F.array_join(F.array_remove(F.split(F.lower("text"), r"[^\p{L}]+"), ""), " "))
    return glossary.mine_phrases(docs, "doc_id", F.col("t"), 2, 2, ("the", "of", "and"), 2)


@query("""SELECT page_id, i AS n, id FROM (SELECT page_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM (SELECT page_id, regexp_extract_all(url, '([0-9]+)', 1) AS ids FROM pages))""")
def identifier_extract(spark, sf_dir):
    ids = F.regexp_extract_all("url", F.lit("([0-9]+)"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(ids).alias("n", "id")).select("page_id", (F.col("n") + 1).cast("long").alias("n"), "id")


@query("""WITH e AS (SELECT doc_id, text, count(*) OVER (PARTITION BY text) AS n, min(doc_id) OVER (PARTITION BY text) AS master FROM documents) SELECT doc_id, master FROM e""")
def entity_components(spark, sf_dir):
    """Masters of records that share a strong identifier (here: the hash of the text)."""
    docs = table(spark, sf_dir, "documents")
    ids = docs.select("doc_id", F.lit("text").alias("type"), F.sha2("text", 256).alias("value"), F.lit(1.0).alias("confidence"))
    return resolve.resolve_entities(ids, "doc_id")


@query("""SELECT doc_id, CASE WHEN contains(lower(lang || ' ' || source), 'de') THEN 'base' ELSE 'translated' END AS branch FROM documents WHERE contains(lower(lang || ' ' || source), 'de') OR contains(lower(lang || ' ' || source), 'src1')""")
def expanded_search(spark, sf_dir):
    columns = {"query": ["lang", "source"]}
    return glossary.expanded_search(table(spark, sf_dir, "documents"), {"query": "de"}, columns, {"de": "src1"}).select("doc_id", "branch")


@query("SELECT doc_id, d.lang AS lang_a, CASE WHEN doc_id % 3 = 0 THEN 'xx' ELSE d.lang END AS lang_b FROM documents d WHERE doc_id % 3 = 0")
def local_live_diff(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("lang_a"))
    b = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "xx").otherwise(F.col("lang")).alias("lang_b"))
    return a.join(b, "doc_id").filter(changes.values_differ(F.col("lang_a"), F.col("lang_b")))


@query("SELECT doc_id, quality AS value FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'en')")
def merge_fresh_rows(spark, sf_dir):
    session = table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id", F.lit(0).alias("value"))
    batch = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("value"))
    merged, _ = writes.merge_fresh(session, batch, "doc_id")
    return merged.join(session.select("doc_id"), "doc_id", "left_anti")


@query("SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, string_agg(DISTINCT source, '; ' ORDER BY source) AS source_list FROM documents GROUP BY 1")
def csv_export_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.array_join(F.array_sort(F.collect_set("source")), "; ").alias("source_list"))


@query("SELECT doc_id, (CASE WHEN contains(text, 'License') THEN 1 ELSE 0 END + CASE WHEN contains(text, '@mail') THEN 1 ELSE 0 END + CASE WHEN contains(text, 'token') THEN 1 ELSE 0 END) >= 1 AS page_ok FROM documents")
def content_canary(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", quality.canary(F.col("text"), ["License", "@mail", "token"], 1).alias("page_ok"))


@query("SELECT doc_id, regexp_replace(text, '(?i)((?:token|secret|password|api[_-]?key)\\s*[=:]\\s*)\\S+', '\\1***', 'g') AS text FROM documents")
def redacted_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.redact(F.col("text")).alias("text"))


@query("SELECT doc_id, regexp_replace(text, '(?i)((?:token|secret|password|api[_-]?key)\\s*[=:]\\s*)\\S+', '\\1***', 'g') AS text FROM documents")
def redacted_documents(spark, sf_dir):
    """Every text, whatever secret it names."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.redact(F.col("text")).alias("text"))


@query()
def phrase_mining(spark, sf_dir):
    """Phrases of 1 to 4 words of all texts, with the operator's own stop words and evidence bound."""
    return glossary.mine_phrases(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
