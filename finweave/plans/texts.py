"""Queries on documents, pages and vectors."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import functions as F

from finweave.functions import constants as K
from finweave.functions import text as X
from finweave.functions.num import rounded
from finweave.operators import mentions, retrieval, text, token_windows
from finweave.plans.registry import query
from finweave.sources import domain as D
from finweave.sources.index import Index

Q = "the tion of der"


def documents(spark, sf_dir):
    return D.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text", "lang", "source")


@query("SELECT doc_id AS document_id, CAST(unnest(range(len(list_range))) AS INTEGER) AS chunk_index, unnest(list_transform(list_range, lambda i: substr(text, i + 1, 1200))) AS text FROM (SELECT doc_id, text, range(0, length(text), 1000) AS list_range FROM documents)")
def chunk_windows(spark, sf_dir):
    return documents(spark, sf_dir).select("document_id", F.posexplode(X.windows(F.col("text"))).alias("chunk_index", "text"))


_CHUNKS = "WITH c AS (SELECT doc_id AS document_id, CAST(unnest(range(len(r))) AS INTEGER) AS chunk_index, unnest(list_transform(r, lambda i: substr(text, i + 1, 1200))) AS text FROM (SELECT doc_id, text, range(0, length(text), 1000) AS r FROM documents))"


def _any(words) -> str:
    return "regexp_matches(lower(text), '" + "|".join(words) + "')"


@query(
    _CHUNKS
    + f""", d AS (SELECT *, 'chunk_' || substr(md5(document_id || '_' || chunk_index || '_' || substr(text, 1, 100)), 1, 12) AS chunk_id FROM c)
    SELECT document_id, chunk_index, chunk_id, lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id, CAST(length(text) AS INTEGER) AS char_count, {_any(K.FINANCIAL_WORDS)} AS has_financial_data, {_any(K.RISK_WORDS)} AS has_risk_mention, {_any(K.FORWARD_WORDS)} AS has_forward_looking
    FROM d WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index)"""
)
def described_chunks(spark, sf_dir):
    c = text.chunks(documents(spark, sf_dir), X.windows(F.col("text")))
    return c.select("document_id", "chunk_index", "chunk_id", "prev_chunk_id", "next_chunk_id", "char_count", "has_financial_data", "has_risk_mention", "has_forward_looking")


_SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) > 0)"""


@query(f"SELECT doc_id AS document_id, CAST(unnest(range(len(s))) AS INTEGER) AS position, unnest(s) AS sentence FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)")
def sentences(spark, sf_dir):
    return documents(spark, sf_dir).select("document_id", F.posexplode(X.sentences(F.col("text"))).alias("position", "sentence"))


@query(
    f"""WITH s AS (SELECT doc_id AS document_id, {_SENTENCES} AS s FROM documents)
    SELECT document_id, CAST(i AS INTEGER) AS window_index, array_to_string(s[i + 1 : i + 3], ' ') AS text FROM (SELECT *, unnest(range(0, greatest(len(s) - 2, 1))) AS i FROM s WHERE len(s) > 0)"""
)
def sliding_windows(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("document_id", X.sentences(F.col("text")).alias("s")).select("document_id", F.posexplode(X.sliding(F.col("s"))).alias("window_index", "text"))


@query(
    r"""WITH w AS (SELECT doc_id AS document_id, list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '') AS w FROM documents)
    SELECT document_id, CAST(i // 512 AS INTEGER) AS chunk_index, array_to_string(w[i + 1 : i + 512], ' ') AS text FROM (SELECT *, unnest(range(0, len(w), 512)) AS i FROM w)"""
)
def word_chunks(spark, sf_dir):
    return documents(spark, sf_dir).select("document_id", F.posexplode(X.word_windows(F.col("text"))).alias("chunk_index", "text"))


@query()
def paragraph_chunks(spark, sf_dir):
    return text.paragraph_chunks(documents(spark, sf_dir)).select("document_id", "chunk_index", "chunk_id", "char_count")


@query()
def sentence_chunks(spark, sf_dir):
    return text.sentence_chunks(documents(spark, sf_dir)).select("document_id", "chunk_index", "chunk_id", "char_count")


def _present(words) -> str:
    return "(" + " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in words) + ")"


_N = r"nullif(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')), 0)"


@query(
    f"""WITH p AS (SELECT doc_id AS document_id, {_present(K.POSITIVE)} AS p, {_present(K.NEGATIVE)} AS n, {_present(K.UNCERTAIN)} AS u, {_N} AS words, {_present(K.RISK_INDICATORS)} AS risk_mentions, {_present(K.OPPORTUNITIES)} AS opportunities FROM documents),
    s AS (SELECT *, coalesce((p - n) / nullif(CAST(p + n AS DOUBLE), 0), 0) AS overall FROM p)
    SELECT document_id, round(coalesce(p * 100 / words::DOUBLE, 0), 6) AS positive, round(coalesce(n * 100 / words::DOUBLE, 0), 6) AS negative, round(coalesce(u * 100 / words::DOUBLE, 0), 6) AS uncertainty, round(overall, 6) AS overall,
    CASE WHEN overall > 0.1 THEN 'positive' WHEN overall < -0.1 THEN 'negative' ELSE 'neutral' END AS label, risk_mentions, opportunities FROM s"""
)
def lexicon_sentiment(spark, sf_dir):
    return rounded(text.sentiment(documents(spark, sf_dir)))


_HTML = r"""trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', chr(10), 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s*\n\s*', chr(10), 'g'))"""


@query(f"SELECT page_id, url, length(t) AS chars, md5(t) AS text_md5 FROM (SELECT page_id, url, {_HTML} AS t FROM pages)")
def html_text(spark, sf_dir):
    p = D.read(spark, sf_dir, "pages").withColumn("t", X.strip_html(F.col("html")))
    return p.select("page_id", "url", F.length("t").cast("long").alias("chars"), F.md5("t").alias("text_md5"))


@query(
    D.sql("stmt")
    + r""" SELECT ticker, fiscal_year, CAST(printf('%.1f', Revenue / 1e6) AS DOUBLE) * 1e6 AS revenue, CAST(printf('%.2f', abs(NetIncome) / 1e9) AS DOUBLE) * 1e9 AS net_income, 12.5::DOUBLE AS gross_margin FROM stmt"""
)
def told_figures(spark, sf_dir):
    s = D.statements(spark, sf_dir)
    t = F.format_string("Total revenue of $%.1f million, net income was $%.2f billion and gross margin of 12.5%% this year.", F.col("Revenue") / 1e6, F.abs("NetIncome") / 1e9)
    f = text.figures(s.select(F.struct("ticker", "fiscal_year").alias("document_id"), t.alias("text")))
    return f.select("document_id.ticker", "document_id.fiscal_year", "revenue", "net_income", "gross_margin")


@query("SELECT doc_id AS document_id, item, CAST(length(head || trim(text)) AS BIGINT) AS chars FROM documents, (VALUES ('item_1a', 'Item 1A. Risk Factors. '), ('item_2', 'Item 2. Properties. '), ('item_3', 'Item 3. Legal Proceedings. ')) h(item, head) WHERE length(trim(head || trim(text))) >= 100")
def filing_sections(spark, sf_dir):
    t = F.concat_ws("\n", *[F.concat(F.lit(h), F.trim("text")) for h in ("Item 1A. Risk Factors. ", "Item 2. Properties. ", "Item 3. Legal Proceedings. ")])
    return text.sections(documents(spark, sf_dir).withColumn("text", t)).select("document_id", "item", F.length("text").cast("long").alias("chars"))


@query()
def key_entities(spark, sf_dir):
    return text.key_entities(documents(spark, sf_dir))


@query()
def token_chunks(spark, sf_dir):
    """Windows of 512 tokens, 64 of them shared with the next."""
    import public_tokenizers

    return token_windows.windows(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")).drop("text")


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


@query(
    rf"""WITH w AS (SELECT document_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM (SELECT doc_id AS document_id, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents)),
    t AS (SELECT document_id, pos, regexp_replace(word, '^[^\pL]+|[^\pL]+$', '', 'g') AS core, regexp_matches(word, '[^\pL]$') AS closed FROM w),
    c AS (SELECT *, CASE WHEN lag(pos) OVER d = pos - 1 AND NOT lag(closed) OVER d THEN 0 ELSE 1 END AS opens FROM t WHERE regexp_matches(core, '^\p{{Lu}}\p{{Ll}}+$') WINDOW d AS (PARTITION BY document_id ORDER BY pos)),
    r AS (SELECT *, sum(opens) OVER (PARTITION BY document_id ORDER BY pos) AS run FROM c),
    s AS (SELECT document_id, min(pos) AS start, max(pos) AS last, string_agg(core, ' ' ORDER BY pos) AS entity FROM r GROUP BY document_id, run HAVING count(*) > 1),
    m AS (SELECT s.document_id, start, entity, count(*) FILTER (lower(core) IN ({_listed(K.POSITIVE)})) AS p, count(*) FILTER (lower(core) IN ({_listed(K.NEGATIVE)})) AS n FROM s JOIN t ON t.document_id = s.document_id AND t.pos BETWEEN start - 10 AND last + 10 GROUP BY 1, 2, 3)
    SELECT document_id, entity, count(*) AS mentions, CAST(sum(p) AS BIGINT) AS positive, CAST(sum(n) AS BIGINT) AS negative, round(avg(coalesce((p - n) / nullif(p + n, 0)::DOUBLE, 0)), 6) AS sentiment FROM m GROUP BY 1, 2"""
)
def entity_sentiment(spark, sf_dir):
    return rounded(mentions.entity_sentiment(documents(spark, sf_dir)))


def filings(spark, sf_dir):
    """Documents as filings: source as ticker, a year from the id."""
    return documents(spark, sf_dir).select(F.col("source").alias("ticker"), (F.pmod("document_id", F.lit(5)) + 2020).cast("int").alias("fiscal_year"), F.col("document_id").cast("string").alias("document_id"), "text")


@query(
    """WITH f AS (SELECT source AS ticker, CAST(2020 + doc_id % 5 AS INTEGER) AS fiscal_year, CAST(doc_id AS VARCHAR) AS document_id, coalesce(text, '') AS text FROM documents WHERE source IS NOT NULL),
    c AS (SELECT ticker, fiscal_year, document_id, sha256(text) AS content, unnest(range(0, length(text), 1000)) AS pos, text FROM f)
    SELECT ticker, fiscal_year, document_id, content, CAST(pos // 1000 AS INTEGER) AS chunk_index, md5(substr(text, pos + 1, 1200)) AS text_md5 FROM c"""
)
def index_passages(spark, sf_dir):
    """Passages of an index that was built from all documents; building again writes nothing."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    index = Index(f"{folder}/passages/{spark.sparkContext.applicationId}/{md5(sf_dir.encode()).hexdigest()}")
    index.build(filings(spark, sf_dir))
    return index.chunks(spark).select("ticker", "fiscal_year", "document_id", "content", "chunk_index", F.md5("text").alias("text_md5"))


@query()
def corpus_topics(spark, sf_dir):
    return text.topics(documents(spark, sf_dir))


_BM25 = f"""WITH d AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
    t AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM d), v AS (SELECT term, count(DISTINCT id) AS df FROM t GROUP BY 1), i AS (SELECT term, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM v, s),
    m AS (SELECT avg(idf) AS mean FROM i), q AS (SELECT term, avgdl, CASE WHEN idf < 0 THEN mean * 0.25 ELSE idf END AS idf FROM i, m WHERE term IN ({", ".join(repr(x) for x in Q.split())})),
    h AS (SELECT id, dl, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    bm AS (SELECT id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM h JOIN q USING (term) GROUP BY 1)"""


def _text_rows(spark, sf_dir):
    return D.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


@query(_BM25 + " SELECT id, round(score, 6) AS score FROM bm")
def bm25_scores(spark, sf_dir):
    return rounded(retrieval.bm25(_text_rows(spark, sf_dir), Q))


_COS = """qv AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 7), cs AS (SELECT vec_id AS id, label, list_dot_product(CAST(embedding AS DOUBLE[]), q) / nullif(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(q, q)), 0) AS similarity FROM embeddings, qv)"""


def _vectors(spark, sf_dir):
    return D.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


@query("WITH " + _COS + " SELECT id, label, round(similarity, 6) AS similarity FROM cs WHERE id <> 7 ORDER BY cs.similarity DESC, id LIMIT 10")
def similar_vectors(spark, sf_dir):
    return rounded(retrieval.similar_to(_vectors(spark, sf_dir), 7, 10).select("id", "label", "similarity"))


@query("WITH " + _COS + " SELECT id, label, round(similarity, 6) AS similarity FROM cs WHERE label = 3 ORDER BY cs.similarity DESC, id LIMIT 10")
def filtered_similarity(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return rounded(retrieval.similar(v, v.filter("id = 7"), 10, {"label": 3, "missing": None}).select("id", "label", "similarity"))


@query(
    _BM25
    + ", "
    + _COS
    + """, dn AS (SELECT id, similarity FROM cs WHERE id <> 7 ORDER BY similarity DESC, id LIMIT 50), top AS (SELECT max(score) AS top FROM bm),
    f AS (SELECT dn.id, 0.5 * coalesce(similarity, 0) + 0.5 * coalesce(score / nullif(top, 0), 0) AS s FROM dn LEFT JOIN bm USING (id), top) SELECT id, round(s, 6) AS hybrid_score FROM f ORDER BY s DESC, id LIMIT 10"""
)
def hybrid_search(spark, sf_dir):
    dense = retrieval.similar_to(_vectors(spark, sf_dir), 7, 50)
    return rounded(retrieval.blended(dense, retrieval.bm25(_text_rows(spark, sf_dir), Q)))


@query(
    _BM25
    + ", "
    + _COS
    + """, a AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) AS r FROM cs WHERE id <> 7 QUALIFY r <= 50), b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM bm QUALIFY r <= 50),
    f AS (SELECT id, sum(p) AS s FROM (SELECT id, 0.6 / (60 + r) AS p FROM a UNION ALL SELECT id, 0.4 / (60 + r) FROM b) GROUP BY 1) SELECT id, round(s, 9) AS rrf_score FROM f ORDER BY s DESC, id LIMIT 6"""
)
def rank_fusion(spark, sf_dir):
    dense = retrieval.similar_to(_vectors(spark, sf_dir), 7, 50)
    return rounded(retrieval.fused([(dense, "similarity", 0.6), (retrieval.bm25(_text_rows(spark, sf_dir), Q), "score", 0.4)]), 9)


@query()
def hashed_embeddings(spark, sf_dir):
    return retrieval.embed(_text_rows(spark, sf_dir))


@query(
    D.sql("stmt")
    + r""", r AS (SELECT ticker, fiscal_year AS fy, unnest(['gross_margin', 'roa']) AS metric, unnest([GrossProfit / Revenue, NetIncome / Assets]) AS value FROM stmt)
    SELECT ticker, fy, 'Ratios of ' || ticker || ' in ' || fy || chr(10) || string_agg(metric || ': ' || printf('%.4f', value), chr(10) ORDER BY metric) AS text FROM r GROUP BY 1, 2"""
)
def ratio_documents(spark, sf_dir):
    s = D.statements(spark, sf_dir).select("ticker", F.col("fiscal_year").alias("fy"), (F.col("GrossProfit") / F.col("Revenue")).alias("gross_margin"), (F.col("NetIncome") / F.col("Assets")).alias("roa"))
    return retrieval.ratio_documents(s.unpivot(["ticker", "fy"], ["gross_margin", "roa"], "metric", "value"))


@query("SELECT conv_id, coalesce(string_agg('[fy=' || turn || ' section=' || role || ' source=' || conv_id || '] ' || CASE WHEN length(t) > 1200 THEN substr(t, 1, 1200) || ' ...' ELSE t END, chr(10) || chr(10) ORDER BY turn), '') AS context FROM (SELECT *, replace(text, chr(10), ' ') AS t FROM conversations) GROUP BY conv_id")
def answer_contexts(spark, sf_dir):
    c = D.read(spark, sf_dir, "conversations")
    return retrieval.context(c.select("conv_id", F.col("turn").alias("rank"), F.col("turn").alias("fy"), F.col("role").alias("section"), F.col("conv_id").cast("string").alias("source"), "text"), by=["conv_id"])


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'item ' || event_id AS answer FROM events""")
def json_answers(spark, sf_dir):
    e = D.read(spark, sf_dir, "events")
    raw = F.concat(F.lit('Sure: {"answer": "item '), F.col("event_id").cast("string"), F.lit('", "citations": []} done'))
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"), retrieval.parsed_answer(raw)["answer"].alias("answer"))
