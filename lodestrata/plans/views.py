"""The engine's shapes over the driver's tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RAW_PAGE
from ..sources.files import html_blocks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: language as version, the shape of the text as type, short texts as front matter, the first words as section."""
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("text").contains(" | "), "table").when(F.length("text") < 200, "definition").when(F.col("text").rlike("[0-9]{4}"), "register").otherwise("text")
    return d.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), F.col("lang").alias("version"), "source", F.substring_index("text", " ", 1).alias("section_path"),
        F.substring_index("text", " ", 2).alias("section_title"), F.col("text").alias("raw_text"), "text", kind.alias("content_type"),
        (F.length("text") < 60).alias("is_front_matter"), F.col("text").contains("\n").alias("is_row_chunk"), F.lit(1).alias("page_start"),
    )


CHUNKS = r"""chunks AS (SELECT doc_id AS id, doc_id AS pos, lang AS version, source, split_part(text, ' ', 1) AS section_path,
  CASE WHEN length(text) - length(replace(text, ' ', '')) < 1 THEN text ELSE split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) END AS section_title,
  text AS raw_text, text,
  CASE WHEN contains(text, ' | ') THEN 'table' WHEN length(text) < 200 THEN 'definition' WHEN regexp_matches(text, '[0-9]{4}') THEN 'register' ELSE 'text' END AS content_type,
  length(text) < 60 AS is_front_matter, contains(text, chr(10)) AS is_row_chunk FROM documents)"""


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each order as a table: a key that the row above has too is blank, as in merged cells."""
    li = table(spark, sf_dir, "lineitem")
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").alias("q"))))
    t = li.groupBy("l_orderkey").agg(rows.alias("r"))
    row = lambda x, i: F.array(F.when((i > 0) & (F.get(F.col("r"), i - 1)["l_returnflag"] == x["l_returnflag"]), F.lit(None).cast("string")).otherwise(x["l_returnflag"]), x["l_linestatus"], x["q"].cast("string"), F.lit(None).cast("string"))
    return t.select(F.col("l_orderkey").alias("table_id"), F.transform("r", row).alias("rows"))


GRID = """cells AS (SELECT l_orderkey AS table_id, row_number() OVER o - 1 AS ord,
  CASE WHEN lag(l_returnflag) OVER o = l_returnflag THEN NULL ELSE l_returnflag END AS c0, l_linestatus AS c1, l_quantity::INT::VARCHAR AS c2
  FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus, l_quantity::INT))"""


def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as chapters and their nations as sections, on computed pages."""
    r = table(spark, sf_dir, "region").select(F.lit("spec-B51.pdf").alias("source"), (F.col("r_regionkey") * 100).alias("toc_ord"), F.lit(1).alias("level"), F.concat((F.col("r_regionkey") + 1).cast("string"), F.lit(" "), F.col("r_name")).alias("title"), (F.col("r_regionkey") * 20 + 3).alias("page_start"))
    n = table(spark, sf_dir, "nation").select(F.lit("spec-B51.pdf").alias("source"), (F.col("n_regionkey") * 100 + 1 + F.col("n_nationkey")).alias("toc_ord"), F.lit(2).alias("level"), F.concat((F.col("n_regionkey") + 1).cast("string"), F.lit("."), (F.col("n_nationkey") + 1).cast("string"), F.lit(" "), F.col("n_name")).alias("title"), (F.col("n_regionkey") * 20 + 3 + F.floor(F.col("n_nationkey") * 2 / 3).cast("int")).alias("page_start"))
    return r.unionByName(n).withColumn("total_pages", F.lit(120))


TOC = """toc AS (SELECT 'spec-B51.pdf' AS source, r_regionkey * 100 AS toc_ord, 1 AS level, (r_regionkey + 1) || ' ' || r_name AS title, r_regionkey * 20 + 3 AS page_start FROM region
  UNION ALL SELECT 'spec-B51.pdf', n_regionkey * 100 + 1 + n_nationkey, 2, (n_regionkey + 1) || '.' || (n_nationkey + 1) || ' ' || n_name, n_regionkey * 20 + 3 + floor(n_nationkey * 2 / 3)::INT FROM nation),
sections AS (SELECT a.*, CASE WHEN nxt IS NULL THEN 120 ELSE greatest(page_start, nxt - 1) END AS page_end FROM (SELECT a.*, (SELECT min_by(b.page_start, b.toc_ord) FROM toc b WHERE b.toc_ord > a.toc_ord AND b.level <= a.level) AS nxt FROM toc a) a),
page_map AS (SELECT p AS page, arg_max(toc_ord, level * 1000000000 + page_start * 100000 + toc_ord) AS toc_ord FROM sections, range(1, 121) AS t(p) WHERE p BETWEEN page_start AND page_end GROUP BY p)"""


def text_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as text blocks on pages of 200."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.floor(k / 200).cast("int").alias("page"), k.alias("block_ord"), F.col("p_name").alias("text"),
        ((k * 37) % 500).cast("double").alias("x0"), ((k * 53) % 700).cast("double").alias("y0"), ((k * 37) % 500 + 20 + F.col("p_size")).cast("double").alias("x1"), ((k * 53) % 700 + 12).cast("double").alias("y1"),
    )


TEXT_BOXES = """texts AS (SELECT (p_partkey // 200)::INT AS page, p_partkey AS block_ord, p_name AS text, (p_partkey * 37) % 500 AS x0, (p_partkey * 53) % 700 AS y0,
  (p_partkey * 37) % 500 + 20 + p_size AS x1, (p_partkey * 53) % 700 + 12 AS y1 FROM part)"""


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw pages: lines as spans of up to three blocks, one of them in the margin on some; the same lines as a table's rows."""
    flag, k = F.col("l_returnflag"), F.col("l_orderkey")
    text = F.when(flag == "R", "Page 7 ").otherwise(F.concat(F.lit(" "), flag, F.lit("–"), "l_linestatus", F.col("l_suppkey").cast("string")))
    q = F.col("l_quantity").cast("int")
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", q.alias("q"), text.alias("t"))))
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lines.alias("lines"))
    box = lambda x, y: [F.lit(x).alias("x0"), y.alias("y0"), F.lit(x + 9.0).alias("x1"), (y + 9).alias("y1")]
    span = lambda x: F.struct(x["t"].alias("text"), x["q"].cast("double").alias("size"), x["l_linenumber"].alias("flags"))
    block = lambda n: F.struct(
        F.lit(0).alias("type"), *box(5.0, F.when(F.lit(n) == k % 7, 700.0).otherwise(100.0 + n)), F.lit(n).alias("block_no"),
        F.transform(F.filter("lines", lambda x: x["l_linenumber"] % 3 == n), span).alias("spans"),
    )
    rows = F.transform("lines", lambda x: F.array(F.lit("i"), F.when(x["t"] != "Page 7 ", x["t"]), F.lit(None).cast("string")))
    grid = lambda x: F.array(F.struct(*box(x, F.lit(300.0)), rows.alias("rows")))
    edge = lambda top: F.struct(F.lit("h").alias("orientation"), F.lit(0.0).alias("x0"), F.lit(500.0).alias("x1"), F.lit(top).alias("top"), F.lit(top).alias("bottom"))
    return o.select(
        F.lit("orders.pdf").alias("source"), F.lit("5.1").alias("version"), k.cast("int").alias("page_num"), F.lit(600.0).alias("width"), F.lit(700.0).alias("height"),
        F.array(block(0), block(1), block(2)).alias("blocks"), F.lit(None).cast(RAW_PAGE["drawings"].dataType).alias("drawings"), F.lit(None).cast(RAW_PAGE["images"].dataType).alias("images"),
        F.when(k % 5 == 0, F.array(edge(80.0), edge(102.0))).alias("edges"), F.when(k % 3 == 0, grid(1.0)).alias("ruled_tables"), grid(2.0).alias("aligned_tables"),
    )


def web_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(raw pages, outline) of web pages, a hundred to a document: blocks of markup from top to bottom, headings as the outline."""
    k = F.col("page")
    b = html_blocks(table(spark, sf_dir, "pages")).filter("text <> ''")
    b = b.withColumns({"source": F.concat(F.lit("web-"), F.expr("page div 100").cast("string"), F.lit("-B51")), "page_num": (k % 100 + 1).cast("int")})
    y = (F.col("block_ord") * 20 + 100).cast("double")
    spans = F.array(F.struct("text", F.lit(9.0).alias("size"), F.lit(0).alias("flags")))
    block = F.struct(F.lit(0).alias("type"), F.lit(50.0).alias("x0"), y.alias("y0"), F.lit(500.0).alias("x1"), (y + 12).alias("y1"), F.col("block_ord").alias("block_no"), spans.alias("spans"))
    pages = b.groupBy("source", "page_num").agg(F.sort_array(F.collect_list(F.struct("block_ord", block.alias("b")))).alias("bs"))
    made = {"version": F.lit("5.1"), "width": F.lit(600.0), "height": F.lit(1e9), "blocks": F.transform("bs", lambda x: x["b"])}
    raw = pages.select(*[made.get(f.name, F.col(f.name) if f.name in pages.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW_PAGE.fields])
    head = b.filter("tag IN ('h1', 'h2')")
    toc = head.select("source", (F.col("page_num") * 10000 + F.col("block_ord")).alias("toc_ord"), F.substring("tag", 2, 1).cast("int").alias("level"), F.col("text").alias("title"), F.col("page_num").alias("page_start"))
    return raw, toc


def big_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as tables and figures on pages of 10."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.floor(k / 10).cast("int").alias("page"), k.alias("box"), ((k * 71) % 400).cast("double").alias("x0"), ((k * 97) % 600).cast("double").alias("y0"), ((k * 71) % 400 + 150).cast("double").alias("x1"), ((k * 97) % 600 + 100).cast("double").alias("y1"))


BIG_BOXES = """boxes AS (SELECT (s_suppkey // 10)::INT AS page, s_suppkey AS box, (s_suppkey * 71) % 400 AS x0, (s_suppkey * 97) % 600 AS y0,
  (s_suppkey * 71) % 400 + 150 AS x1, (s_suppkey * 97) % 600 + 100 AS y1 FROM supplier)"""


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a flow of blocks: pages of 12, a heading now and then, kinds by market segment."""
    k = F.col("c_custkey")
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "table").when(F.col("c_mktsegment") == "MACHINERY", "definition").when(F.col("c_nationkey") > 18, "register").otherwise("text")
    heading = F.when((k % 7 == 0) & (kind == "text"), F.col("c_nationkey").cast("int"))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"), F.floor(k / 36).cast("int").alias("page"), k.alias("block_ord"), kind.alias("kind"), heading.alias("heading_ord"), F.col("c_name").alias("text"))


BLOCKS = """blocks AS (SELECT 's' || (c_custkey % 3) AS source, (c_custkey // 36)::INT AS page, c_custkey AS block_ord, c_name AS text,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'table' WHEN c_mktsegment = 'MACHINERY' THEN 'definition' WHEN c_nationkey > 18 THEN 'register' ELSE 'text' END AS kind,
  CASE WHEN c_custkey % 7 = 0 AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND c_nationkey <= 18 THEN c_nationkey END AS heading_ord FROM customer),
pages_of AS (SELECT source, page, CASE WHEN page % 4 <> 0 THEN page // 2 END AS page_ord FROM (SELECT DISTINCT source, page FROM blocks)),
placed AS (SELECT b.*, p.page_ord, coalesce(last_value(heading_ord IGNORE NULLS) OVER (PARTITION BY b.source, b.page ORDER BY block_ord ROWS UNBOUNDED PRECEDING), p.page_ord) AS section_ord
  FROM blocks b LEFT JOIN pages_of p USING (source, page))"""


def block_pages(blocks: DataFrame) -> DataFrame:
    return blocks.select("source", "page").distinct().withColumn("toc_ord", F.when(F.col("page") % 4 != 0, F.floor(F.col("page") / 2).cast("int")))


def keyword_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def dense_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100, numbered as the keyword queries are."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.expr("vec_id div 100").alias("query_id"), F.col("embedding").alias("vector"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("version"))


#: BM25 of all benchmark texts over documents: scores(query_id, pos, score)
BM25 = """words AS (SELECT doc_id AS pos, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents),
sizes AS (SELECT doc_id AS pos, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS dl FROM documents),
tfs AS (SELECT term, pos, count(*) AS tf FROM words GROUP BY ALL),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sizes),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw_idf FROM tfs, corpus GROUP BY term),
terms AS (SELECT term, df, CASE WHEN raw_idf < 0 THEN 0.25::DOUBLE * (SELECT avg(raw_idf) FROM raw) ELSE raw_idf END AS idf FROM raw),
asked AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark) GROUP BY ALL),
scores AS (SELECT query_id, t.pos, sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM asked JOIN terms USING (term) JOIN tfs t USING (term) JOIN sizes s ON s.pos = t.pos, corpus GROUP BY ALL)"""

DENSE = """qv AS (SELECT vec_id // 100 AS query_id, embedding::DOUBLE[] AS q, label AS version FROM embeddings WHERE vec_id % 100 = 0),
dists AS (SELECT query_id, vec_id AS id, label AS version, qv.version AS q_version, 1 - list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))) AS distance FROM embeddings, qv)"""
