"""The registered queries of the engine's own operators, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formulas, ids
from ..functions import text as X
from ..operators import answers, assistant, chunks, evaluate, events, filters, flow, layout, retrieval, splitter, structure, tables, threads
from ..plugins import HashingEmbedder
from ..profile import CHUNK_CHARS, CHUNK_OVERLAP
from ..session import stored, working_folder
from ..sources import files, store
from ..sources import page_source as page_source_format
from ..sources.keywords import KeywordIndex
from ..sources.pages import page_models
from . import ingest as plan
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return add


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
VALID = r"""(length(regexp_replace(raw_text, '^\s+|\s+$', '', 'g')) >= CASE WHEN is_row_chunk THEN 25 ELSE CASE content_type WHEN 'text' THEN 20 WHEN 'table' THEN 80 WHEN 'definition' THEN 8 WHEN 'register' THEN 40 ELSE 30 END END
  AND NOT regexp_matches(raw_text, '^\s*(cont''d|continued|continued\s+on\s+next\s+page|to\s+be\s+continued)\.?\s*$', 'i') AND NOT regexp_matches(raw_text, '^\s*(downloaded\s+by|JEDEC\s+Standard)', 'i'))"""
BODY = "(NOT is_front_matter AND (content_type <> 'table' OR is_row_chunk OR regexp_matches(upper(section_title), 'CSD|CID|DSR|OCR')))"


# -- scalar functions -----------------------------------------------------------------------------------------------


@query(with_(V.CHUNKS) + "SELECT id, section_title || ' ' || raw_text AS index_text FROM chunks WHERE NOT is_front_matter")
def scan_filter_project(spark, sf):
    c = filters.keyword_indexable(V.chunks(spark, sf))
    return c.select("id", F.concat("section_title", F.lit(" "), "raw_text").alias("index_text"))


@query(r"""WITH n AS (SELECT doc_id, 'Page 12 Downloaded by x on y' || chr(10) || text || chr(160) || '( ) e-MMC ' || chr(8805) || '5 [ ]' AS t FROM documents),
a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, 'Downloaded\s+by\s+[^\n]*', '', 'gi'), 'JEDEC\s+Standard\s+No\.\s+84-B51', '', 'gi'), 'Page\s+\d+', '', 'gi') AS t FROM n),
b AS (SELECT doc_id, replace(replace(translate(t, chr(160) || chr(8211) || chr(8212) || chr(8722) || chr(8216) || chr(8217) || chr(8220) || chr(8221) || chr(181) || chr(215) || chr(8226), ' ---''''""ux*'), chr(8805), '>='), chr(8804), '<=') AS t FROM a),
c AS (SELECT doc_id, replace(replace(replace(t, chr(177), '+/-'), chr(176), 'deg'), chr(8230), '...') AS t FROM b),
d AS (SELECT doc_id, regexp_replace(regexp_replace(t, 'e\s*[•∙\-.]\s*MMC', 'eMMC', 'gi'), 'e\s*2\s*[•∙\-.]\s*MMC', 'e.MMC', 'gi') AS t FROM c),
e AS (SELECT doc_id, regexp_replace(regexp_replace(replace(t, '∆', 'Delta'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM d)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\(\s*\)', '', 'g'), '\[\s*\]', '', 'g'), '\(\s*\.\s*\)', '', 'g'), '^\s+|\s+$', '', 'g') AS clean FROM e""")
def clean_text(spark, sf):
    noisy = F.concat(F.lit("Page 12 Downloaded by x on y\n"), "text", F.lit(" ( ) e-MMC ≥5 [ ]"))
    return V.table(spark, sf, "documents").select("doc_id", X.clean_text(noisy).alias("clean"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS n_terms FROM documents")
def tokenize_counts(spark, sf):
    t = X.tokens(F.col("text"))
    return V.table(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_terms"))


@query(r"""SELECT s_suppkey, CASE WHEN regexp_matches(f, 'B(\d)(\d+)', 'i') THEN regexp_extract(f, 'B(\d)(\d+)', 1, 'i') || '.' || regexp_extract(f, 'B(\d)(\d+)', 2, 'i') ELSE 'unknown' END AS version,
  CASE WHEN regexp_matches(f, 'B\d+', 'i') THEN upper(regexp_extract(f, 'B\d+', 0, 'i')) ELSE regexp_replace(f, '\.[^.]*$', '') END AS short
FROM (SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN 'spec-b' ELSE 'JESD84-B' END || CASE WHEN s_nationkey % 5 = 0 THEN '' ELSE s_nationkey::VARCHAR END || '.pdf' AS f FROM supplier)""")
def extract_version(spark, sf):
    n = F.col("s_nationkey")
    f = F.concat(F.when(n % 3 == 0, "spec-b").otherwise("JESD84-B"), F.when(n % 5 == 0, "").otherwise(n.cast("string")), F.lit(".pdf"))
    return V.table(spark, sf, "supplier").select("s_suppkey", X.file_version(f).alias("version"), X.short_source(f).alias("short"))


VERSION_TEXT = "CASE o_orderkey % 6 WHEN 0 THEN 'compare 5.0 and 5.1' WHEN 1 THEN 'in b451 only' WHEN 2 THEN 'section 7.5.1' WHEN 3 THEN 'JESD84-B50, 4.5' WHEN 4 THEN 'release 15.1' ELSE 'none ' || o_orderstatus END"


@query(rf"""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN regexp_matches(q, '\b5\.1\b|[Bb]51\b|JESD84-B51\b', 'i') THEN '5.1' END, CASE WHEN regexp_matches(q, '\b5\.0\b|[Bb]50\b|JESD84-B50\b', 'i') THEN '5.0' END,
  CASE WHEN regexp_matches(q, '\b4\.51\b|\b4\.5\b|[Bb]451\b|JESD84-B451\b', 'i') THEN '4.51' END], lambda x: x IS NOT NULL), ',') AS versions FROM (SELECT o_orderkey, {VERSION_TEXT} AS q FROM orders)""")
def detect_versions(spark, sf):
    return V.table(spark, sf, "orders").select("o_orderkey", F.array_join(X.versions_named(F.expr(VERSION_TEXT)), ",").alias("versions"))


@query(with_(V.TOC) + r"""SELECT toc_ord, regexp_extract(title, '^(\d+(?:\.\d+)*)\s*(.*)', 1) AS number, regexp_extract(title, '^(\d+(?:\.\d+)*)\s*(.*)', 2) AS bare,
  CASE WHEN level = 1 THEN split_part(title, ' ', 1) ELSE split_part(split_part(title, ' ', 1), '.', 1) || '/' || split_part(title, ' ', 1) END AS path, title AS label FROM toc""")
def section_path(spark, sf):
    number = X.section_number(F.col("title"))
    path = X.section_path(number)
    return V.toc(spark, sf).select("toc_ord", number.alias("number"), X.bare_title(F.col("title")).alias("bare"), F.array_join(path, "/").alias("path"), X.section_label(path, X.bare_title(F.col("title"))).alias("label"))


@query("""WITH h AS (SELECT doc_id, sha1(unhex('c7a3f2e184b05d9ea0123456789abcde') || encode(source || '|' || lang || '|text|1||' || doc_id || '|' || substr(sha256(text), 1, 16))) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS chunk_id FROM h""")
def chunk_id_uuid5(spark, sf):
    d = V.table(spark, sf, "documents")
    none = F.array().cast("array<string>")
    return d.select("doc_id", ids.chunk_id(F.col("source"), F.col("lang"), F.lit("text"), F.lit(1), none, F.col("doc_id"), F.col("text")).alias("chunk_id"))


def _formula(key: str, *columns: str):
    def run(spark, sf):
        return V.table(spark, sf, "part").select("p_partkey", formulas.sentence(key, *[F.expr(c) for c in columns]).alias("answer"))

    return run


MEGA = "CASE WHEN {kb} >= 1024 THEN ' = ' || round_even({kb} / 1024.0::DOUBLE, 0)::BIGINT || ' {unit}' ELSE '' END"
for _key, _columns, _sql in [
    ("boot_size", ["p_size"], "'Boot partition size = 128 KB × ' || p_size || ' = ' || (p_size * 128) || ' KB' || " + MEGA.format(kb="(p_size * 128)", unit="MB") + " || '  [EXT_CSD[226] BOOT_SIZE_MULT]'"),
    ("rpmb_size", ["p_size"], "'RPMB partition size (per partition) = 128 KB × ' || p_size || ' = ' || (p_size * 128) || ' KB' || " + MEGA.format(kb="(p_size * 128)", unit="MB") + " || '  [EXT_CSD[168] RPMB_SIZE_MULT]'"),
    ("capacity", ["p_partkey * 1000"], "'Device capacity = SEC_COUNT × 512 bytes = ' || (p_partkey * 1000) || ' × 512 = ' || format('{:,}', p_partkey * 512000) || ' bytes ≈ ' || printf('%.2f', p_partkey * 512000 / 1073741824.0::DOUBLE) || ' GiB (' || printf('%.2f', p_partkey * 512000 / 1e9) || ' GB)  [EXT_CSD[215:212] SEC_COUNT]'"),
    ("erase_group", ["p_size"], "'Erase group size = (HC_ERASE_GRP_SIZE + 1) × 512 KB = (' || p_size || ' + 1) × 512 = ' || ((p_size + 1) * 512) || ' KB' || " + MEGA.format(kb="((p_size + 1) * 512)", unit="MiB") + " || '  [EXT_CSD[224] HC_ERASE_GRP_SIZE]'"),
    ("wp_group", ["p_size", "p_partkey % 7"], "'Write protect group size = (HC_WP_GRP_SIZE + 1) × erase_group_size = (' || p_size || ' + 1) × ' || ((p_partkey % 7 + 1) * 512) || ' KB = ' || ((p_size + 1) * (p_partkey % 7 + 1) * 512) || ' KB' || " + MEGA.format(kb="((p_size + 1) * (p_partkey % 7 + 1) * 512)", unit="MiB") + " || '  [EXT_CSD[221] HC_WP_GRP_SIZE]'"),
    ("sleep_current", ["p_size % 20"], "'Sleep mode max current = 1 µA × 2^(S_C_VCC) = 1 × 2^' || (p_size % 20) || ' = ' || (2 ** (p_size % 20))::BIGINT || ' µA  [EXT_CSD[143] S_C_VCC]'"),
    ("gp_size", ["p_size", "p_partkey % 7", "p_partkey % 5"], "'GP partition size = GP_SIZE_MULT × wp_group_size = ' || p_size || ' × ' || ((p_partkey % 5 + 1) * (p_partkey % 7 + 1) * 512) || ' KB = ' || (p_size * (p_partkey % 5 + 1) * (p_partkey % 7 + 1) * 512) || ' KB' || " + MEGA.format(kb="(p_size * (p_partkey % 5 + 1) * (p_partkey % 7 + 1) * 512)", unit="MiB") + " || '  [EXT_CSD[154:143] GP_SIZE_MULT]'"),
    ("tran_speed", ["p_partkey % 6", "p_size % 18"], """CASE WHEN p_partkey % 6 > 3 THEN 'Invalid freq_unit=' || (p_partkey % 6) || '. Valid values: [0, 1, 2, 3].' WHEN p_size % 18 NOT BETWEEN 1 AND 15 THEN 'Invalid mult=' || (p_size % 18) || '. Valid values: [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15].'
  ELSE 'TRAN_SPEED decode: freq_unit=' || (p_partkey % 6) || ' → ' || printf('%.1f', [0.1, 1, 10, 100][p_partkey % 6 + 1]::DOUBLE) || ' MHz base, mult=' || (p_size % 18) || ' → ×' || printf('%.1f', [1.0,1.2,1.3,1.5,2.0,2.5,3.0,3.5,4.0,4.5,5.0,5.5,6.0,7.0,8.0][p_size % 18]::DOUBLE) || chr(10) || 'Result = ' || printf('%.1f', [0.1, 1, 10, 100][p_partkey % 6 + 1]::DOUBLE) || ' × ' || printf('%.1f', [1.0,1.2,1.3,1.5,2.0,2.5,3.0,3.5,4.0,4.5,5.0,5.5,6.0,7.0,8.0][p_size % 18]::DOUBLE)
  || ' = ' || printf('%.1f', [100e3, 1e6, 10e6, 100e6][p_partkey % 6 + 1]::DOUBLE * [1.0,1.2,1.3,1.5,2.0,2.5,3.0,3.5,4.0,4.5,5.0,5.5,6.0,7.0,8.0][p_size % 18]::DOUBLE / 1e6::DOUBLE) || ' MHz  [CSD[103:96] TRAN_SPEED]' END"""),
]:
    query(f"SELECT p_partkey, {_sql} AS answer FROM part", f"formula_{_key}")(_formula(_key, *_columns))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Calculation error for formula ''boot_size'': ''boot_size_mult''. Check parameter names and types.'
  WHEN 1 THEN 'Calculation error for formula ''boot_size'': invalid literal for int() with base 10: ''0x10''. Check parameter names and types.'
  WHEN 2 THEN 'Boot partition size = 128 KB × 20 = 2560 KB = 2 MB  [EXT_CSD[226] BOOT_SIZE_MULT]' WHEN 3 THEN 'Boot partition size = 128 KB × 7 = 896 KB  [EXT_CSD[226] BOOT_SIZE_MULT]'
  ELSE 'Unknown formula ''size''. Supported: [''boot_size'', ''rpmb_size'', ''capacity'', ''tran_speed'', ''erase_group'', ''wp_group'', ''sleep_current'', ''gp_size''].' END AS answer FROM orders""")
def formula_errors(spark, sf):
    k = F.col("o_orderkey") % 5
    value = F.when(k == 1, "0x10").when(k == 2, "20").otherwise("7")
    given = F.when(k == 0, F.create_map(F.lit("other"), F.lit("1"))).otherwise(F.create_map(F.lit("boot_size_mult"), value))
    return V.table(spark, sf, "orders").select("o_orderkey", formulas.calculate(F.when(k == 4, "size").otherwise(" Boot_Size "), given).alias("answer"))


# -- filters and statistics -----------------------------------------------------------------------------------------


@query(with_(V.CHUNKS) + f"SELECT id, {VALID} AS valid FROM chunks")
def chunk_validity(spark, sf):
    return V.chunks(spark, sf).select("id", filters.is_valid(F.col("content_type"), F.col("raw_text"), F.col("is_row_chunk")).alias("valid"))


@query(with_(V.CHUNKS) + f"SELECT id, content_type FROM chunks WHERE {BODY} AND {VALID}")
def searchable_chunks(spark, sf):
    return filters.searchable(V.chunks(spark, sf)).select("id", "content_type")


@query(with_(V.CHUNKS) + rf"SELECT id FROM chunks WHERE {BODY} AND length({TRIM.format('raw_text')}) >= CASE content_type WHEN 'text' THEN 20 WHEN 'table' THEN 25 WHEN 'definition' THEN 8 WHEN 'register' THEN 40 ELSE 30 END")
def indexable_chunks(spark, sf):
    return filters.indexable(V.chunks(spark, sf)).select("id")


@query(with_(V.CHUNKS) + f"""SELECT source, count(*) AS total, count(*) FILTER (is_front_matter) AS front_matter, count(*) FILTER ({BODY} AND {VALID}) AS searchable, count(*) FILTER (NOT is_front_matter AND NOT ({BODY} AND {VALID})) AS short_filtered,
{', '.join(f"count(*) FILTER ({BODY} AND {VALID} AND content_type = '{t}') AS n_{t}" for t in ('text', 'table', 'figure', 'bitmap', 'definition', 'register'))} FROM chunks GROUP BY source""")
def chunk_stats(spark, sf):
    return filters.stats(V.chunks(spark, sf), ["source"])


@query(with_(V.CHUNKS) + f"""SELECT source, count(*) AS total, count(*) FILTER (NOT is_front_matter) AS body, count(*) FILTER (is_front_matter) AS front_matter,
{', '.join(f"count(*) FILTER (NOT is_front_matter AND content_type = '{t}') AS n_{t}" for t in ('text', 'table', 'figure', 'bitmap', 'definition', 'register'))} FROM chunks GROUP BY source""")
def inspector_stats(spark, sf):
    return filters.body_stats(V.chunks(spark, sf), ["source"])


@query(with_(V.CHUNKS) + "SELECT source, content_type, count(*) AS n, count(*) FILTER (is_front_matter) AS front FROM chunks GROUP BY ROLLUP (source, content_type)")
def type_counts_rollup(spark, sf):
    return V.chunks(spark, sf).rollup("source", "content_type").agg(F.count("*").alias("n"), F.count_if("is_front_matter").alias("front"))


@query("SELECT doc_id, lang, text FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedupe_first_seen(spark, sf):
    return filters.first_seen(V.table(spark, sf, "documents").select("doc_id", "lang", "text"), ["text"], ["doc_id"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def new_ids_anti(spark, sf):
    return filters.new_rows(V.table(spark, sf, "documents").select("doc_id"), V.table(spark, sf, "labels"), "doc_id")


@query("SELECT label::VARCHAR AS label, count(*) AS docs, count(*) FILTER (label = 0) AS glossary FROM embeddings GROUP BY ROLLUP (label)")
def collection_counts(spark, sf):
    v = V.table(spark, sf, "embeddings").withColumn("label", F.col("label").cast("string"))
    return v.rollup("label").agg(F.count("*").alias("docs"), F.count_if(F.col("label") == "0").alias("glossary"))


# -- structure and flow ---------------------------------------------------------------------------------------------


@query(with_(V.TOC) + "SELECT page::INT AS page, toc_ord FROM page_map")
def page_section_map(spark, sf):
    return structure.page_sections(structure.section_ends(V.toc(spark, sf))).select("page", "toc_ord")


@query(with_(V.TOC) + r"""SELECT toc_ord, level, page_start, page_end, lower(title) AS label_key, page_start < (SELECT min(page_start) FROM toc WHERE level = 1) AS is_front_matter FROM sections""")
def section_table(spark, sf):
    return structure.sections(V.toc(spark, sf)).select("toc_ord", "level", "page_start", "page_end", "label_key", "is_front_matter")


HEAD_TEXT = "CASE c_custkey % 4 WHEN 0 THEN '  ' || upper(t.title) || '. ' WHEN 1 THEN t.title || ' of ' || c_name WHEN 2 THEN t.title || c_name ELSE c_name END"
HEADS = "heads AS (SELECT c_custkey AS block_id, " + HEAD_TEXT + " AS text FROM customer JOIN toc t ON t.level = 2 AND t.toc_ord % 100 - 1 = c_nationkey)"


def _heads(spark, sf):
    t = V.toc(spark, sf).filter("level = 2").select("title", (F.col("toc_ord") % 100 - 1).alias("c_nationkey"))
    c = V.table(spark, sf, "customer").join(F.broadcast(t).alias("t"), "c_nationkey")
    return c.select(F.lit("spec-B51.pdf").alias("source"), F.col("c_custkey").alias("block_id"), F.expr(HEAD_TEXT).alias("text"))


@query(with_(V.TOC, HEADS) + r"SELECT block_id, t.toc_ord AS exact_ord FROM heads LEFT JOIN toc t ON lower(t.title) = regexp_replace(lower(trim(heads.text)), '^[. ]+|[. ]+$', '', 'g')")
def heading_exact(spark, sf):
    return structure.exact_headings(_heads(spark, sf), structure.sections(V.toc(spark, sf))).select("block_id", "exact_ord")


@query(with_(V.TOC, HEADS) + r"""SELECT block_id, (SELECT min_by(t.toc_ord, t.toc_ord) FROM toc t WHERE starts_with(k, lower(t.title) || ' ')) AS prefix_ord
FROM (SELECT block_id, regexp_replace(lower(trim(text)), '^[. ]+|[. ]+$', '', 'g') AS k FROM heads)""")
def heading_prefix(spark, sf):
    secs = structure.sections(V.toc(spark, sf))
    return structure.prefix_headings(structure.exact_headings(_heads(spark, sf), secs), secs).select("block_id", "prefix_ord")


@query(with_(V.BLOCKS) + "SELECT block_ord, section_ord FROM placed")
def section_fill(spark, sf):
    b = V.page_blocks(spark, sf)
    return flow.section_at_block(b, V.block_pages(b)).select("block_ord", "section_ord")


@query(with_(V.BLOCKS) + """, seen AS (SELECT *, coalesce(section_ord, -1) AS s, coalesce(page_ord, -1) AS ps FROM placed WHERE kind <> 'definition'),
marked AS (SELECT *, CASE WHEN lag(kind) OVER o IS NULL OR s <> lag(s) OVER o OR (lag(page) OVER o <> page AND ps <> lag(s) OVER o) OR kind <> lag(kind) OVER o OR kind IN ('table', 'figure', 'bitmap') THEN 1 ELSE 0 END AS stop
  FROM seen WINDOW o AS (PARTITION BY source ORDER BY page, block_ord)),
numbered AS (SELECT *, sum(stop) OVER (PARTITION BY source ORDER BY page, block_ord) AS island FROM marked)
SELECT source, island::BIGINT AS island, min(page) AS page_start, max(page) AS page_end, count(*) AS n_blocks, string_agg(text, chr(10) ORDER BY page, block_ord) AS raw_text FROM numbered WHERE kind IN ('text', 'register') GROUP BY source, island""")
def flow_islands(spark, sf):
    b = V.page_blocks(spark, sf)
    runs = flow.flow_text(flow.islands(flow.section_at_block(b, V.block_pages(b))))
    return runs.select("source", "island", "page_start", "page_end", "n_blocks", "raw_text")


# -- layout ---------------------------------------------------------------------------------------------------------


@query(with_(V.TEXT_BOXES, V.BIG_BOXES) + "SELECT block_ord FROM texts t WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.page = t.page AND (t.x0 + t.x1) / 2.0 BETWEEN b.x0 - 2 AND b.x1 + 2 AND (t.y0 + t.y1) / 2.0 BETWEEN b.y0 - 2 AND b.y1 + 2)")
def text_in_table_anti(spark, sf):
    return layout.outside_tables(V.text_boxes(spark, sf), V.big_boxes(spark, sf), ["page"]).select("block_ord")


@query(with_(V.TEXT_BOXES, V.BIG_BOXES) + "SELECT b.page, box, string_agg(trim(text), chr(10) ORDER BY block_ord) AS labels, count(*) AS n_labels FROM boxes b JOIN texts t ON b.page = t.page AND (t.x0 + t.x1) / 2.0 BETWEEN b.x0 AND b.x1 AND (t.y0 + t.y1) / 2.0 BETWEEN b.y0 AND b.y1 GROUP BY b.page, box")
def labels_in_figure(spark, sf):
    return layout.labels_in_boxes(V.text_boxes(spark, sf), V.big_boxes(spark, sf), ["page"], "box")


@query(with_(V.TEXT_BOXES, V.BIG_BOXES) + """SELECT page, box, arg_min(cap, dist * 100000 + block_ord) AS caption, min(dist) AS dist FROM (SELECT b.page, box, 'Figure 3 - ' || text AS cap, block_ord,
  CASE WHEN b.y1 <= t.y0 THEN t.y0 - b.y1 WHEN t.y1 <= b.y0 THEN b.y0 - t.y1 ELSE -1 END::DOUBLE AS dist FROM boxes b JOIN texts t ON b.page = t.page) WHERE dist BETWEEN 0 AND 40 GROUP BY page, box""")
def nearest_caption(spark, sf):
    t = V.text_boxes(spark, sf).withColumn("text", F.concat(F.lit("Figure 3 - "), "text"))
    return layout.nearest_caption(V.big_boxes(spark, sf), t, ["page"], "box")


@query(with_("RECURSIVE " + V.TEXT_BOXES).rstrip() + """, grown AS (SELECT 0 AS k, page, block_ord AS i, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM texts
  UNION ALL SELECT any_value(a.k) + 1, a.page, a.i, min(b.x0), min(b.y0), max(b.x1), max(b.y1) FROM grown a JOIN grown b ON a.page = b.page AND a.x0 - 4 < b.x1 AND a.x1 + 4 > b.x0 AND a.y0 - 4 < b.y1 AND a.y1 + 4 > b.y0 WHERE a.k < 20 GROUP BY a.page, a.i)
SELECT page, x0, y0, x1, y1, (x1 - x0) * (y1 - y0) AS area, count(*)::INT AS element_count FROM grown WHERE k = 20 GROUP BY ALL HAVING area >= 500""")
def bbox_cluster(spark, sf):
    """Drawings of each page by place, made of the parts' boxes."""
    boxes = V.text_boxes(spark, sf).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("x0", "y0", "x1", "y1"))).alias("boxes"))
    return boxes.select("page", F.inline(layout.cluster_boxes(F.col("boxes"), least_area=500.0)))


@query(with_(V.TEXT_BOXES) + """, wide AS (SELECT page, y0, y1 FROM texts WHERE x1 - x0 > 50 * 0.6)
SELECT page, coalesce(bool_or(gap BETWEEN 10 AND 30), false) AS decorated FROM (SELECT page, lead(y0) OVER (PARTITION BY page ORDER BY y0, y1) - y1 AS gap FROM wide) GROUP BY page""")
def heading_decoration(spark, sf):
    edge = F.struct(F.col("y0").alias("top"), F.col("y1").alias("bottom"), "x0", "x1")
    pages = V.text_boxes(spark, sf).groupBy("page").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    return pages.select("page", layout.heading_rules(F.col("edges"), F.lit(50.0)).alias("decorated"))


SPANS = """spans AS (SELECT l_orderkey AS page, l_linenumber % 3 AS block_no, l_linenumber AS ord, l_partkey AS ord2, l_quantity::INT AS size,
  CASE WHEN l_returnflag = 'R' THEN '' ELSE l_returnflag || '-' || l_linestatus || l_suppkey END AS text FROM lineitem)"""


@query(with_(SPANS) + """SELECT page, block_no, string_agg(text, ' ' ORDER BY ord, ord2, size, text) AS text, round_even(sum(size)::DOUBLE / count(*), 1) AS font_size, max(ord)::INT AS font_flags
FROM spans WHERE text <> '' AND block_no <> page % 7 GROUP BY page, block_no""")
def page_texts(spark, sf):
    """Text blocks of raw pages: each line of an order is a span, watermarks and blanks of which go; some blocks lie in a margin."""
    return files.blocks(page_models(V.raw_pages(spark, sf)), "text_blocks").select("page", "block_no", "text", "font_size", "font_flags")


@query("""WITH o AS (SELECT l_orderkey AS page, count(*) AS n, count(*) FILTER (l_returnflag <> 'R') AS n_rows FROM lineitem GROUP BY ALL)
SELECT page, CASE WHEN page % 3 = 0 THEN 'ruled' ELSE 'aligned' END AS kind, n_rows FROM o WHERE n_rows > 0 AND (page % 3 = 0 OR page % 5 <> 0)""")
def page_tables(spark, sf):
    """Tables of raw pages: by lines where there are any, else by aligned text unless the page has a heading's rules."""
    return files.blocks(page_models(V.raw_pages(spark, sf)), "table_blocks").select("page", F.when(F.col("x0") == 1, "ruled").otherwise("aligned").alias("kind"), F.size("rows").cast("long").alias("n_rows"))


@query("""SELECT 'orders-' || (o_orderkey % 3) || '-B5' || (o_orderkey % 2) || '.jsonl' AS source, '5.' || (o_orderkey % 2) AS version, o_orderkey::INT AS page_num, o_totalprice AS width FROM orders WHERE o_orderkey > 40 AND o_orderkey % 2 = 1""")
def page_source(spark, sf):
    """Orders as pages, written by the sink as one JSON lines file for each group of them, and read by the source: by byte ranges, with pages and versions chosen there."""
    o = V.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    name = F.concat(F.lit("orders-"), (k % 3).cast("string"), F.lit("-B5"), (k % 2).cast("string"), F.lit(".jsonl"))
    folder = working_folder(spark, "page-source")
    page_source_format.write_named(o.select(name.alias("name"), k.cast("int").alias("page_num"), F.col("o_totalprice").alias("width")), folder, "name", ["page_num"])
    pages = spark.read.format("page_models").option("path", folder).option("split", 1 << 20).load()
    return pages.filter("page_num > 40 AND version = '5.1'").select("source", "version", "page_num", "width")


@query()
def ingest(spark, sf):
    """Chunks of web pages, a hundred to a document, from raw pages and an outline of their headings."""
    raw, toc = V.web_pages(spark, sf)
    keep = stored(spark, "ingest")
    return plan.ingest(keep(page_models(raw)), toc, keep=keep, cleaned=True)



@query(with_(V.TEXT_BOXES, V.BIG_BOXES) + """, plain AS (SELECT page, y0, 3 AS build, block_ord AS own, CASE WHEN page % 2 = 0 THEN 'definition' ELSE 'text' END AS kind FROM texts t WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.page = t.page AND (t.x0 + t.x1) / 2.0 BETWEEN b.x0 - 2 AND b.x1 + 2 AND (t.y0 + t.y1) / 2.0 BETWEEN b.y0 - 2 AND b.y1 + 2)),
every AS (SELECT page, y0, 0 AS build, box AS own, 'table' AS kind FROM boxes UNION ALL SELECT page, y0, 1, box, 'figure' FROM boxes WHERE box % 3 = 0 UNION ALL SELECT page, y0, 2, box, 'bitmap' FROM boxes WHERE box % 3 = 1 UNION ALL SELECT * FROM plain)
SELECT page, own AS own_ord, kind, row_number() OVER (PARTITION BY page ORDER BY y0, build, own)::INT AS block_ord FROM every""")
def classify_page(spark, sf):
    boxes = V.big_boxes(spark, sf).withColumnRenamed("box", "block_ord")
    k = F.col("block_ord") % 3
    return layout.classify(V.text_boxes(spark, sf), boxes, boxes.filter(k == 0), boxes.filter(k == 1), ["page"], F.when(F.col("page") % 2 == 0, "Terms and definitions").otherwise("Bus")).select("page", "own_ord", "kind", "block_ord")


@query(r"""WITH b AS (SELECT page_id AS page, unnest(list_transform(regexp_extract_all(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')))) AS text FROM pages) SELECT page, text FROM b""")
def html_headings(spark, sf):
    return files.html_blocks(V.table(spark, sf, "pages")).filter("tag = 'h1'").select("page", "text")


@query(r"""WITH cut AS (SELECT page_id, string_split(regexp_replace(html, '(?i)<(h1|h2|p|li|/article|/ul|/body)\b', chr(1) || '<\1', 'g'), chr(1)) AS parts FROM pages),
part AS (SELECT page_id, unnest(parts) AS x, unnest(range(1, len(parts) + 1)) AS i, len(parts) AS n FROM cut),
opened AS (SELECT page_id, i, n, lower(regexp_extract(x, '(?is)^<(h1|h2|p|li)\b[^>]*>', 1)) AS tag, regexp_replace(x, '(?is)^<(h1|h2|p|li)\b[^>]*>', '') AS x FROM part),
ended AS (SELECT page_id, i, n, tag, x, strpos(lower(x), '</' || tag || '>') AS e FROM opened WHERE tag <> '')
SELECT page_id AS page, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS block_ord, tag,
  trim(regexp_replace(regexp_replace(CASE WHEN e > 0 THEN x[1:e - 1] ELSE x END, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS text FROM ended WHERE e > 0 OR i < n""")
def html_blocks(spark, sf):
    return files.html_blocks(V.table(spark, sf, "pages"))


# -- tables ---------------------------------------------------------------------------------------------------------

GRID_FILL = V.GRID + """, filled AS (SELECT *, coalesce(last_value(c0 IGNORE NULLS) OVER (PARTITION BY table_id ORDER BY ord ROWS UNBOUNDED PRECEDING), '') AS k FROM cells),
starts AS (SELECT table_id, coalesce(min(ord) FILTER (c0 IS NOT NULL), 1) AS start FROM cells GROUP BY table_id)"""


@query(with_(GRID_FILL) + "SELECT table_id, string_agg(k, ',' ORDER BY ord) AS keys FROM filled GROUP BY table_id")
def forward_fill(spark, sf):
    g = V.grids(spark, sf)
    body = F.transform("rows", lambda r: F.transform(r, tables.cell))
    return g.select("table_id", F.array_join(F.transform(tables.forward_fill(body), lambda r: F.get(r, F.lit(0))), ",").alias("keys"))


@query(with_(GRID_FILL) + "SELECT table_id, start::INT AS data_start FROM starts")
def first_data_row(spark, sf):
    return tables.preprocess(V.grids(spark, sf)).select("table_id", "data_start")


NOTED = """noted AS (SELECT l_orderkey AS table_id, row_number() OVER o - 1 AS ord, CASE WHEN l_quantity > 25 THEN 'NOTE ' || l_linenumber || ' see NOTE 9' ELSE l_linestatus END AS c0, l_quantity <= 25 AS plain
  FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity)), tail AS (SELECT *, bool_and(NOT plain) OVER (PARTITION BY table_id ORDER BY ord DESC) AS note FROM noted)"""


@query(with_(NOTED) + "SELECT table_id, count(*) FILTER (note)::INT AS n_notes, coalesce(string_agg(replace(c0, ' NOTE 9', chr(10) || 'NOTE 9'), chr(10) ORDER BY ord) FILTER (note), '') AS notes FROM tail GROUP BY table_id")
def trailing_notes(spark, sf):
    li = V.table(spark, sf, "lineitem")
    note = F.concat(F.lit("NOTE "), F.col("l_linenumber").cast("string"), F.lit(" see NOTE 9"))
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", F.array(F.when(F.col("l_quantity") > 25, note).otherwise(F.col("l_linestatus")), F.when(F.col("l_quantity") > 25, "").otherwise("x")).alias("r"))))
    t = li.groupBy(F.col("l_orderkey").alias("table_id")).agg(F.transform(rows, lambda x: x["r"]).alias("body"))
    n = tables.note_count(F.col("body"))
    t = t.withColumn("n_notes", n)
    return t.select("table_id", "n_notes", tables.notes_text(F.slice("body", F.size("body") - F.col("n_notes") + 1, F.col("n_notes"))).alias("notes"))


@query("""SELECT l_orderkey AS table_id, string_agg(l_returnflag, ' ' ORDER BY l_linenumber, l_partkey, l_returnflag) || '/' || coalesce(string_agg(l_linestatus, ' ' ORDER BY l_linenumber, l_partkey, l_returnflag) FILTER (l_quantity > 25), '') AS header FROM lineitem GROUP BY l_orderkey""")
def header_merge(spark, sf):
    li = V.table(spark, sf, "lineitem")
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", F.array(F.concat(F.lit(" "), "l_returnflag"), F.when(F.col("l_quantity") > 25, F.col("l_linestatus"))).alias("r"))))
    t = li.groupBy(F.col("l_orderkey").alias("table_id")).agg(F.transform(rows, lambda x: x["r"]).alias("rows"))
    return t.select("table_id", F.array_join(tables.merge_header(F.col("rows"), F.lit(2)), "/").alias("header"))


#: with the fixed header mode, rows before the first data row (one at least) are the header
MD = GRID_FILL + """, fixed AS (SELECT table_id, greatest(start, 1) AS start FROM starts),
heads AS (SELECT table_id, [coalesce(string_agg(c0, ' ' ORDER BY ord), ''), coalesce(string_agg(c1, ' ' ORDER BY ord), ''), coalesce(string_agg(c2, ' ' ORDER BY ord), ''), ''] AS h FROM cells JOIN fixed USING (table_id) WHERE ord < start GROUP BY table_id),
body AS (SELECT c.table_id, ord, coalesce(last_value(c0 IGNORE NULLS) OVER (PARTITION BY c.table_id ORDER BY ord ROWS UNBOUNDED PRECEDING), '') AS k, c1, c2 FROM cells c JOIN fixed USING (table_id) WHERE ord >= start),
tops AS (SELECT table_id, '| ' || array_to_string(h, ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(h, lambda x: repeat('-', greatest(length(x), 3))), ' | ') || ' |' AS top FROM heads)"""


@query(with_(MD) + "SELECT table_id, any_value(top) || coalesce(chr(10) || string_agg('| ' || k || ' | ' || c1 || ' | ' || c2 || ' |  |', chr(10) ORDER BY ord), '') AS markdown FROM tops LEFT JOIN body USING (table_id) GROUP BY table_id")
def table_markdown(spark, sf):
    t = tables.preprocess(V.grids(spark, sf), header_mode="fixed")
    return t.select("table_id", tables.markdown(F.col("header"), F.col("body"), F.col("notes")).alias("markdown"))


@query(with_(MD) + """SELECT table_id, (row_number() OVER (PARTITION BY table_id ORDER BY first) - 1)::INT AS index, k AS key, top || chr(10) || lines AS markdown
FROM (SELECT table_id, k, min(ord) AS first, string_agg('| ' || k || ' | ' || c1 || ' | ' || c2 || ' |  |', chr(10) ORDER BY ord) AS lines FROM body GROUP BY table_id, k) JOIN tops USING (table_id)""")
def row_groups(spark, sf):
    t = tables.preprocess(V.grids(spark, sf), header_mode="fixed")
    return t.select("table_id", F.inline(tables.row_groups(F.col("header"), F.col("body"), F.col("notes"), F.lit("R"))))


@query(with_("RECURSIVE " + V.GRID).rstrip() + """, lens AS (SELECT table_id, ord, 14 + length(coalesce(last_value(c0 IGNORE NULLS) OVER (PARTITION BY table_id ORDER BY ord ROWS UNBOUNDED PRECEDING), '')) + length(c1) + length(c2) AS n FROM cells),
steps AS (SELECT table_id, ord, n AS size, 0 AS part FROM lens WHERE ord = 0
  UNION ALL SELECT l.table_id, l.ord, CASE WHEN 49 + s.size + l.n > 100 THEN l.n ELSE s.size + l.n END, CASE WHEN 49 + s.size + l.n > 100 THEN s.part + 1 ELSE s.part END FROM steps s JOIN lens l ON l.table_id = s.table_id AND l.ord = s.ord + 1)
SELECT table_id, part, count(*) AS n_rows FROM steps GROUP BY table_id, part""")
def pack_rows(spark, sf):
    t = V.grids(spark, sf)
    body = tables.forward_fill(F.transform("rows", lambda r: F.transform(r, tables.cell)))
    parts = tables.pack_rows(F.array(*[F.lit("")] * 4), body, F.lit(""), F.lit(9), 100)
    return t.select("table_id", F.posexplode(parts).alias("part", "md")).select("table_id", "part", (F.size(F.split("md", "\n")) - 2).cast("long").alias("n_rows"))


WIDE = """wide AS (SELECT l_orderkey AS table_id, l_linenumber % 5 = 0 AS noise, l_quantity > 10 AS rich, CASE WHEN l_quantity > 10 THEN 5 ELSE 1 END AS filled, row_number() OVER o AS ord, count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity))"""


@query(with_(WIDE) + """SELECT table_id, count(*) FILTER (rich OR NOT noise) AS n_rows FROM wide GROUP BY table_id
HAVING table_id % 3 = 0 OR (bool_and(filled > 1 OR ord NOT IN (1, n)) AND sum(filled) / (10.0 * count(*)) >= 0.4)""")
def plausible_tables(spark, sf):
    """Tables of 8 columns always stay; of 10 columns those without a lone cell at an end and with enough cells. Watermark letters go, and rows that hold nothing else."""
    li, full = V.table(spark, sf, "lineitem"), F.col("l_quantity") > 10
    cell, none = F.when(full, F.col("l_linestatus")), F.lit(None).cast("string")
    first = F.when(F.col("l_linenumber") % 5 == 0, "i").otherwise(F.col("l_returnflag"))
    row = F.slice(F.array(first, *[cell] * 4, *[none] * 5), F.lit(1), F.when(F.col("l_orderkey") % 3 == 0, 8).otherwise(10))
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", row.alias("r"))))
    t = li.groupBy(F.col("l_orderkey").alias("table_id")).agg(F.transform(rows, lambda x: x["r"]).alias("rows"))
    return t.filter(tables.is_plausible(F.col("rows"))).select("table_id", F.size(tables.drop_noise(F.col("rows"))).cast("long").alias("n_rows"))


# -- chunks ---------------------------------------------------------------------------------------------------------


def _runs(spark, sf):
    d = V.table(spark, sf, "documents")
    return d.select(
        "doc_id", "source", F.col("lang").alias("version"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.array(F.lit("6"), F.lit("6.1")).alias("section_path"), F.lit("Bus").alias("section_title"),
        F.lit(2).alias("heading_level"), F.lit("6.1 Bus").alias("section_label"), F.lit(False).alias("section_front"), F.lit("text").alias("kind"), F.col("text").alias("raw_text"),
    )


def split_sql(texts: str, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> str:
    """The recursive CTEs that cut texts (doc_id, text) into `split` (doc_id, chunk_index, chunk).

    One recursion goes down the separators and leaves small parts, the other walks from run to run of a part's neighbours by their
    lengths' prefix sums. Not the splitter's code in SQL: that goes part by part and keeps a run.
    """
    strip = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')".format
    return f"""given AS (SELECT doc_id, text FROM {texts} WHERE {strip('text')} <> ''),
seps AS (SELECT k, sep FROM (VALUES (1, chr(10) || chr(10)), (2, chr(10)), (3, '. '), (4, ' '), (5, '')) s(k, sep)),
cut AS (SELECT doc_id, []::INT[] AS path, text AS body, 0 AS k, false AS small FROM given WHERE length(text) >= {size}
  UNION ALL
  SELECT doc_id, list_append(path, i), part, k, length(part) < {size} FROM (
    SELECT doc_id, path, k, unnest(parts) AS part, unnest(range(1, len(parts) + 1))::INT AS i FROM (
      SELECT doc_id, path, k, list_filter(list_transform(string_split(body, sep), lambda x, i: CASE WHEN i = 1 THEN x ELSE sep || x END), lambda x: x <> '') AS parts FROM (
        SELECT c.doc_id, c.path, c.body, s.k, s.sep FROM cut c JOIN seps s ON s.k = CASE WHEN c.k < 1 AND contains(body, chr(10) || chr(10)) THEN 1
          WHEN c.k < 2 AND contains(body, chr(10)) THEN 2 WHEN c.k < 3 AND contains(body, '. ') THEN 3 WHEN c.k < 4 AND contains(body, ' ') THEN 4 ELSE 5 END WHERE NOT c.small)))),
leaves AS (SELECT doc_id, path[1:len(path) - 1] AS parent, path[len(path)] AS i, body, small, count(*) FILTER (NOT small) OVER (PARTITION BY doc_id, path[1:len(path) - 1] ORDER BY path[len(path)]) AS g FROM cut WHERE len(path) > 0),
sums AS (SELECT doc_id, parent, g, i, body, sum(length(body)) OVER (PARTITION BY doc_id, parent, g ORDER BY i) AS upto FROM leaves WHERE small),
groups AS (SELECT doc_id, parent, g, list(i ORDER BY i) AS places, list(body ORDER BY i) AS bodies, list(upto ORDER BY i) AS ends, list(upto - length(body) ORDER BY i) AS begins FROM sums GROUP BY ALL),
runs AS (SELECT doc_id, parent, g, 1 AS a, len(list_filter(ends, lambda x: x <= {size})) AS b FROM groups
  UNION ALL
  SELECT doc_id, parent, g, next, len(list_filter(ends, lambda x: x - begins[next] <= {size})) FROM (
    SELECT g.*, 1 + len(list_filter(begins, lambda x: ends[b] - x > {overlap} OR ends[b + 1] - x > {size})) AS next FROM runs r JOIN groups g USING (doc_id, parent, g) WHERE b < len(ends))),
found AS (SELECT doc_id, list_append(parent, places[a]) AS place, {strip("array_to_string(bodies[a:b], '')")} AS chunk FROM runs JOIN groups USING (doc_id, parent, g)),
split AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1)::INT AS chunk_index, chunk FROM found WHERE chunk <> ''
  UNION ALL SELECT doc_id, 0, {strip('text')} FROM given WHERE length(text) < {size})"""


@query("WITH RECURSIVE " + split_sql("documents") + "\nSELECT doc_id, chunk_index, chunk FROM split")
def text_split(spark, sf):
    return splitter.split_frame(V.table(spark, sf, "documents").select("doc_id", "text"), "text", F.lit("text")).select("doc_id", "chunk_index", "chunk")


def _table_chunks(spark, sf):
    t = tables.preprocess(V.grids(spark, sf), header_mode="fixed")
    t = t.withColumns({"source": F.lit("spec-B51.pdf"), "version": F.lit("5.1"), "page_start": F.col("table_id").cast("int"), "page_end": F.col("table_id").cast("int"), "section_path": F.array(F.lit("7")), "section_title": F.lit("Registers"), "heading_level": F.lit(1), "section_label": F.lit("7 Registers"), "section_front": F.lit(False), "caption": F.lit("Table 3 - Lines")})
    return chunks.table_chunks(t)


def uuid5_sql(key: str) -> str:
    """The version-5 UUID of a key in the engine's namespace."""
    h = f"sha1(unhex('c7a3f2e184b05d9ea0123456789abcde') || encode({key}))"
    return f"(SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ('89ab')[1 + ('0x' || h[17])::INT % 4] || h[18:20] || '-' || h[21:32] FROM (SELECT {h} AS h))"


def _text_chunks_sql() -> str:
    key = uuid5_sql("source || '|' || lang || '|text|1|6/6.1|' || chunk_index || '|' || sha256(chunk)[1:16]")
    prefix = "'[eMMC ' || lang || ' | 6.1 Bus | Page 1]' || chr(10)"
    return f"""
SELECT {key} AS chunk_id, source, lang AS version, 1 AS page_start, 1 AS page_end, '6/6.1' AS section_path, 'Bus' AS section_title, 2 AS heading_level, 'text' AS content_type, false AS is_front_matter, chunk_index, {prefix} || chunk AS text, chunk AS raw_text, false AS is_row_chunk
FROM split JOIN documents USING (doc_id)"""


@query("WITH RECURSIVE " + split_sql("documents") + _text_chunks_sql())
def text_chunks(spark, sf):
    c = chunks.text_chunks(_runs(spark, sf)).withColumn("section_path", F.array_join("section_path", "/"))
    return c.drop("table_markdown", "figure_caption", "term", "parent_chunk_id")  # text chunks have none


@query(with_(MD) + f""", grouped AS (SELECT table_id, k, min(ord) AS first, string_agg('| ' || k || ' | ' || c1 || ' | ' || c2 || ' |  |', chr(10) ORDER BY ord) AS lines FROM body GROUP BY table_id, k),
whole AS (SELECT table_id, any_value(top) || coalesce(chr(10) || string_agg('| ' || k || ' | ' || c1 || ' | ' || c2 || ' |  |', chr(10) ORDER BY ord), '') AS md FROM tops LEFT JOIN body USING (table_id) GROUP BY table_id),
parents AS (SELECT table_id, md, {uuid5_sql("'spec-B51.pdf|5.1|table|' || table_id || '|7|0|' || sha256(md)[1:16]")} AS id FROM whole),
pieces AS (SELECT table_id, md, 0 AS i, false AS is_row, NULL AS parent FROM parents
  UNION ALL SELECT table_id, top || chr(10) || lines, (row_number() OVER (PARTITION BY table_id ORDER BY first) - 1)::INT, true, id FROM grouped JOIN tops USING (table_id) JOIN parents USING (table_id))
SELECT {uuid5_sql("'spec-B51.pdf|5.1|table|' || table_id || '|7|' || i || '|' || sha256(md)[1:16]")} AS chunk_id, table_id::INT AS page_start, i AS chunk_index, is_row AS is_row_chunk, parent AS parent_chunk_id, md AS raw_text, md AS table_markdown,
  '[eMMC 5.1 | 7 Registers | Page ' || table_id || ']' || chr(10) || 'Table 3 - Lines' || chr(10) || chr(10) || md AS text, 'Table 3 - Lines' AS figure_caption FROM pieces""")
def table_chunks(spark, sf):
    return _table_chunks(spark, sf).select("chunk_id", "page_start", "chunk_index", "is_row_chunk", "parent_chunk_id", "raw_text", "table_markdown", "text", "figure_caption")


@query(with_(MD) + "SELECT table_id, count(DISTINCT k) AS n_groups, count(DISTINCT k) AS n_linked FROM body GROUP BY table_id")
def parent_fk(spark, sf):
    """Row groups of each table, and those of them that name the table's first full chunk as parent."""
    c = _table_chunks(spark, sf)
    first = c.filter("NOT is_row_chunk AND chunk_index = 0").select("page_start", F.col("chunk_id").alias("first_id"))
    groups = c.filter("is_row_chunk").join(first, "page_start", "left").groupBy(F.col("page_start").cast("long").alias("table_id"))
    return groups.agg(F.count("*").alias("n_groups"), F.count_if(F.col("parent_chunk_id") == F.col("first_id")).alias("n_linked"))


@query(with_(V.TEXT_BOXES, V.BIG_BOXES, f"""near AS ({SQL['nearest_caption'][SQL['nearest_caption'].index("SELECT page, box, arg_min"):]})""", f"""inside AS ({SQL['labels_in_figure'][SQL['labels_in_figure'].index("SELECT b.page, box, string_agg"):]})""",
f"""told AS (SELECT page, CASE WHEN box % 2 = 0 THEN 'figure' ELSE 'bitmap' END AS kind, caption, coalesce('[Figure: ' || nullif(trim(caption), '') || ']', CASE WHEN box % 2 = 1 THEN '[Figure: bitmap image]' ELSE '[Figure: (no caption)]' END) || coalesce(chr(10) || nullif(labels, ''), '') AS raw
  FROM boxes LEFT JOIN near USING (page, box) LEFT JOIN inside USING (page, box) WHERE coalesce(caption, '') <> '' OR coalesce(labels, '') <> '')""").rstrip() + f"""
SELECT {uuid5_sql("'spec-B51.pdf|5.1|' || kind || '|' || page || '|7|0|' || sha256(raw)[1:16]")} AS chunk_id, kind AS content_type, page AS page_start, raw AS raw_text, '[eMMC 5.1 | 7 Bus | Page ' || page || ']' || chr(10) || raw AS text, nullif(caption, '') AS figure_caption FROM told""")
def figure_chunks(spark, sf):
    return _figure_chunks(spark, sf).select("chunk_id", "content_type", "page_start", "raw_text", "text", "figure_caption")


def _figure_chunks(spark, sf):
    boxes, texts = V.big_boxes(spark, sf), V.text_boxes(spark, sf)
    captions = layout.nearest_caption(boxes, texts.withColumn("text", F.concat(F.lit("Figure 3 - "), "text")), ["page"], "box").drop("dist")
    f = boxes.join(captions, ["page", "box"], "left").join(layout.labels_in_boxes(texts, boxes, ["page"], "box"), ["page", "box"], "left")
    f = f.withColumns({"source": F.lit("spec-B51.pdf"), "version": F.lit("5.1"), "page_start": F.col("page"), "page_end": F.col("page"), "section_path": F.array(F.lit("7")), "section_title": F.lit("Bus"), "heading_level": F.lit(1), "section_label": F.lit("7 Bus"), "section_front": F.lit(False), "kind": F.when(F.col("box") % 2 == 0, "figure").otherwise("bitmap")})
    return chunks.figure_chunks(f)




@query("""WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 2 = 0 THEN 'CMD' || l_linenumber ELSE 'Line ' || l_returnflag || ' of an order' END AS term, 'the line with flag ' || l_returnflag || ' of part ' || l_partkey AS definition FROM lineitem)
SELECT l_orderkey AS block, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, definition) - 1)::INT AS index, term, definition FROM d""")
def abbrev_defs(spark, sf):
    """Abbreviations in texts of one half of the orders, numbered terms with their definitions below them in the other."""
    li = V.table(spark, sf, "lineitem")
    text = F.concat(F.lit("the line with flag "), "l_returnflag", F.lit(" of part "), F.col("l_partkey").cast("string"))
    line = F.struct("l_linenumber", "l_partkey", text.alias("t"), F.col("l_returnflag").alias("f"))
    number = lambda x: x["l_linenumber"].cast("string")
    shown = lambda x: F.when(F.col("block") % 2 == 0, F.concat(F.lit("CMD"), number(x), F.lit(" : "), x["t"])).otherwise(F.concat(F.lit("3."), number(x), F.lit(" Line "), x["f"], F.lit(" of an order\n"), x["t"]))
    t = li.groupBy(F.col("l_orderkey").alias("block")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    t = t.select("block", F.array_join(F.transform("lines", shown), "\n").alias("text"))
    return t.select("block", F.posexplode(X.definitions(F.col("text"))).alias("index", "d")).select("block", "index", "d.term", "d.definition")


INLINE = r"'([A-Z][A-Za-z0-9_\-\s]{2,40}?)\s+(?:means|is defined as|refers to)\s+(.{10,200})'"


@query(f"""SELECT p_partkey, trim(regexp_extract(t, {INLINE}, 1, 'i')) AS term, trim(regexp_extract(t, {INLINE}, 2, 'i')) AS definition
FROM (SELECT p_partkey, 'The ' || p_name || ' means a part of brand ' || p_brand || ' and size' AS t FROM part) WHERE regexp_matches(t, {INLINE}, 'i')""")
def inline_defs(spark, sf):
    p = V.table(spark, sf, "part")
    text = F.concat(F.lit("The "), "p_name", F.lit(" means a part of brand "), "p_brand", F.lit(" and size"))
    return p.select("p_partkey", F.explode(X.inline_definitions(text)).alias("d")).select("p_partkey", "d.term", "d.definition")


@query(r"""SELECT p_partkey, trim(regexp_extract(t, 'Table\s+\d+[\s—\-]+[^\n]{5,80}', 0, 'i')) AS table_caption, trim(regexp_extract(t, 'Figure\s+\d+[\s—\-]+[^\n]{3,120}', 0, 'i')) AS figure_caption
FROM (SELECT p_partkey, 'see' || chr(10) || CASE WHEN p_size % 2 = 0 THEN 'TABLE ' ELSE 'Figure ' END || p_size || ' - ' || p_name || chr(10) || 'end' AS t FROM part)""")
def captions(spark, sf):
    text = F.concat(F.lit("see\n"), F.when(F.col("p_size") % 2 == 0, "TABLE ").otherwise("Figure "), F.col("p_size").cast("string"), F.lit(" - "), "p_name", F.lit("\nend"))
    return V.table(spark, sf, "part").select("p_partkey", X.table_caption(text).alias("table_caption"), X.figure_caption(text).alias("figure_caption"))


# -- retrieval ------------------------------------------------------------------------------------------------------


@query(with_(V.BM25) + "SELECT term, df, round(idf, 6) AS idf FROM terms")
def bm25_stats(spark, sf):
    return retrieval.bm25_terms(V.chunks(spark, sf), F.col("raw_text")).select("term", "df", F.round("idf", 6).alias("idf"))


def _bm25(spark, sf, n, pad):
    hits = retrieval.bm25_search(V.keyword_queries(spark, sf), V.chunks(spark, sf), F.col("raw_text"), n, pad)
    return hits.select("query_id", "pos", F.round("score", 4).alias("score"), "rank")


@query(with_(V.BM25) + "SELECT query_id, pos, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos)::INT AS rank FROM scores QUALIFY rank <= 10")
def bm25_search(spark, sf):
    return _bm25(spark, sf, 10, False)


@query(with_(V.BM25) + """, head AS (SELECT doc_id AS pos FROM documents ORDER BY doc_id LIMIT 400), padded AS (SELECT query_id, pos, score FROM scores UNION ALL SELECT b.item_id, pos, 0.0 FROM benchmark b, head WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.query_id = b.item_id AND s.pos = head.pos))
SELECT query_id, pos, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos)::INT AS rank FROM padded QUALIFY rank <= 400""")
def bm25_search_padded(spark, sf):
    """400 hits a query: where fewer documents hold a token of it, others fill up with no score."""
    return _bm25(spark, sf, 400, True)


@query(SQL["bm25_search"])
def bm25_stored(spark, sf):
    """The same search over a stored index, built from one half of the documents and then from all of them."""
    c = V.chunks(spark, sf)
    index = KeywordIndex(spark, working_folder(spark, "keywords"))
    half = c.agg(F.max("pos")).first()[0] // 2
    for part in (c.filter(F.col("pos") <= half), c):
        index.append(part, F.col("raw_text"))
    hits = index.search(V.keyword_queries(spark, sf), 10)
    return hits.select("query_id", "pos", F.round("score", 4).alias("score"), "rank")


@query(with_(V.BM25) + """, kinds AS (SELECT item_id AS query_id, min(t) AS lo, max(t) AS hi FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM benchmark) GROUP BY ALL),
short AS (SELECT query_id, unnest(list_distinct([lo, hi])) AS term FROM kinds),
few AS (SELECT query_id, t.pos, sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM short JOIN terms USING (term) JOIN tfs t USING (term) JOIN sizes s ON s.pos = t.pos, corpus GROUP BY ALL)
SELECT query_id, pos, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos)::INT AS rank FROM few QUALIFY rank <= 5""")
def bm25_stored_short(spark, sf):
    """Questions of two words, the first and last of each text by the alphabet, in one commit's index: most blocks of common words are left out."""
    index = KeywordIndex(spark, working_folder(spark, "keywords"))
    index.append(V.chunks(spark, sf), F.col("raw_text"))
    words = F.array_distinct(X.tokens(F.col("query")))
    q = V.keyword_queries(spark, sf).select("query_id", F.concat_ws(" ", F.array_distinct(F.array(F.array_min(words), F.array_max(words)))).alias("query"))
    return index.search(q, 5).select("query_id", "pos", F.round("score", 4).alias("score"), "rank")


@query(with_(V.BM25) + "SELECT count(DISTINCT pos) AS n_docs, count(DISTINCT query_id) AS n_queries FROM (SELECT query_id, pos FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) <= 10)")
def retrieval_counts(spark, sf):
    return answers.retrieval_counts(_bm25(spark, sf, 10, False), "pos")


@query(with_(V.CHUNKS) + f"SELECT source, count(*) AS total, count(*) FILTER ({BODY} AND {VALID}) AS searchable, count(*) FILTER (NOT ({BODY} AND {VALID})) AS skipped FROM chunks GROUP BY ROLLUP (source)")
def index_totals(spark, sf):
    c = V.chunks(spark, sf)
    keep = filters.searchable(c).select("id", F.lit(True).alias("keep"))
    return answers.index_totals(c.join(keep, "id", "left"), F.coalesce("keep", F.lit(False)), "source")


@query(with_(V.DENSE) + """, h AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM dists QUALIFY rank <= 2),
x AS (SELECT query_id, rank, '### Hit ' || rank || ' (Score: ' || printf('%.4f', 1 - distance) || ')' || chr(10) || '- **Source**: v' || id || ' (Page 7)' || chr(10) || '- **Path**: 6 > 6.1 > Bus' || chr(10) || chr(10) || '```text' || chr(10) || 'entry ' || id || chr(10) || '```' || chr(10) AS t FROM h)
SELECT query_id, '## query ' || query_id || chr(10) || chr(10) || string_agg(t, chr(10) ORDER BY rank) AS report FROM x GROUP BY query_id""")
def verification_report(spark, sf):
    q = V.dense_queries(spark, sf)
    hits = retrieval.dense_search(q, V.vectors(spark, sf), 2)
    name = F.col("id").cast("string")
    hits = hits.withColumns({"source": F.concat(F.lit("v"), name), "page_start": F.lit(7), "section_path": F.lit("6/6.1"), "section_title": F.lit("Bus"), "document": F.concat(F.lit("entry "), name)})
    return answers.verification(q.select("query_id", F.concat(F.lit("query "), F.col("query_id").cast("string")).alias("query")), hits)


def _dense(hits):
    return hits.select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@query(with_(V.DENSE) + "SELECT query_id, id, CASE WHEN abs(distance) < 5e-7 THEN 0.0::DOUBLE ELSE round(distance, 6) END AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM dists QUALIFY rank <= 15")
def dense_search(spark, sf):
    return _dense(retrieval.dense_search(V.dense_queries(spark, sf), V.vectors(spark, sf)))


@query(with_(V.DENSE) + "SELECT * FROM (SELECT query_id, id, CASE WHEN abs(distance) < 5e-7 THEN 0.0::DOUBLE ELSE round(distance, 6) END AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM dists WHERE version = q_version QUALIFY rank <= 15) WHERE distance < 0.7")
def dense_filtered(spark, sf):
    q = V.table(spark, sf, "embeddings").filter("vec_id % 100 = 0").select(F.expr("vec_id div 100").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("wanted"))
    return _dense(retrieval.dense_search(q, V.vectors(spark, sf), where=F.col("version") == F.col("wanted"), most=0.7))


@query(with_(V.DENSE) + "SELECT query_id, id, CASE WHEN abs(distance) < 5e-7 THEN 0.0::DOUBLE ELSE round(distance, 6) END AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM dists WHERE version = 0 QUALIFY rank <= 5")
def glossary_search(spark, sf):
    return _dense(retrieval.dense_search(V.dense_queries(spark, sf), V.vectors(spark, sf).filter("version = 0"), 5))


RRF = """dr AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM dists QUALIFY rank <= 15),
sr AS (SELECT query_id, pos AS id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) AS rank FROM scores QUALIFY rank <= 40),
lists AS (SELECT query_id, id, rank, distance, NULL::DOUBLE AS score, 0 AS list FROM dr UNION ALL SELECT query_id, id, rank, NULL, score, 1 FROM sr),
merged AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(list * 1000 + rank) AS first, min(distance) AS distance, max(score) AS score FROM lists GROUP BY ALL),
fused AS (SELECT query_id, id, rrf, distance, CASE WHEN first >= 1000 THEN score END AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, first) AS rank FROM merged QUALIFY rank <= 15)"""


@query(with_(V.BM25, V.DENSE, RRF) + "SELECT query_id, id, rank::INT AS rank, round(rrf, 8) AS rrf_score, CASE WHEN abs(distance) < 5e-7 THEN 0.0::DOUBLE ELSE round(distance, 6) END AS distance, round(score, 4) AS bm25_score FROM fused")
def rrf_fuse(spark, sf):
    """All benchmark texts as keyword queries, every hundredth vector as a vector query; those with the same number are fused."""
    q = V.keyword_queries(spark, sf)
    sparse = retrieval.bm25_search(q, V.chunks(spark, sf), F.col("raw_text"), 40).select("query_id", F.col("pos").alias("id"), "rank", "score")
    hits = retrieval.fuse(retrieval.dense_search(V.dense_queries(spark, sf), V.vectors(spark, sf)), sparse)
    return hits.select("query_id", "id", "rank", F.round("rrf_score", 8).alias("rrf_score"), F.round("distance", 6).alias("distance"), F.round("bm25_score", 4).alias("bm25_score"))


HYBRID = r"""lang_of AS (SELECT doc_id AS id, lang AS version FROM documents),
indexed AS (SELECT e.vec_id AS id, embedding::DOUBLE[] AS v, version FROM embeddings e JOIN lang_of l ON l.id = e.vec_id),
dd AS (SELECT query_id, id, 1 - list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) AS distance FROM (SELECT vec_id // 100 AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0) x, indexed WHERE version = 'en'),
dr AS (SELECT query_id, id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM dd) WHERE rank <= 15 AND distance < 0.85),
s1 AS (SELECT query_id, pos, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) AS rank FROM scores QUALIFY rank <= 40),
sr AS (SELECT query_id, pos AS id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM s1 JOIN lang_of l ON l.id = pos WHERE version = 'en'),
""" + RRF[RRF.index("lists AS"):]  # fmt: skip
TITLED = r"""docs AS (SELECT doc_id, CASE WHEN length(text) - length(replace(text, ' ', '')) < 1 THEN text ELSE split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) END || ' ' || text AS text FROM documents)"""


def _hybrid(spark, sf, **options):
    q = V.keyword_queries(spark, sf).join(V.dense_queries(spark, sf), "query_id", "full")  # a query may lack its text or its vector
    c = V.chunks(spark, sf)
    v = V.vectors(spark, sf).drop("version").join(c.select("id", "version"), "id")
    return retrieval.hybrid(q, c, v, default_version="en", **options)


@query(with_(TITLED, V.BM25.replace("FROM documents", "FROM docs"), HYBRID) + "SELECT query_id, id, rank::INT AS rank, round(rrf, 8) AS rrf_score FROM fused")
def hybrid_search(spark, sf):
    return _hybrid(spark, sf).select("query_id", "id", "rank", F.round("rrf_score", 8).alias("rrf_score"))


@query(SQL["hybrid_search"])
def hybrid_stored(spark, sf):
    """The same over a stored keyword index."""
    c = V.chunks(spark, sf)
    index = KeywordIndex(spark, working_folder(spark, "keywords"))
    index.append(c, F.concat("section_title", F.lit(" "), "raw_text"))
    return _hybrid(spark, sf, index=index).select("query_id", "id", "rank", F.round("rrf_score", 8).alias("rrf_score"))


EXPANDED = """centre AS (SELECT query_id, rank AS hr, c.pos AS at, c.source, c.section_path FROM fused JOIN chunks c USING (id) WHERE content_type IN ('table', 'register')),
near AS (SELECT query_id, hr, s AS step, c.id FROM centre, (VALUES (-1), (1)) AS x(s) JOIN chunks c ON c.pos = centre.at + s AND c.source = centre.source AND c.section_path = centre.section_path JOIN indexed i ON i.id = c.id),
fresh AS (SELECT query_id, id, min(hr * 10 + step) AS o FROM near n WHERE NOT EXISTS (SELECT 1 FROM fused h WHERE h.query_id = n.query_id AND h.id = n.id) GROUP BY ALL),
counts AS (SELECT query_id, max(rank) AS last FROM fused GROUP BY query_id)"""


@query(with_(V.CHUNKS, TITLED, V.BM25.replace("FROM documents", "FROM docs"), HYBRID, EXPANDED) + "SELECT query_id, id, rank::INT AS rank FROM fused UNION ALL SELECT query_id, id, (last + row_number() OVER (PARTITION BY query_id ORDER BY o, id))::INT FROM fresh JOIN counts USING (query_id)")
def hybrid_expanded(spark, sf):
    return _hybrid(spark, sf, expand=True).select("query_id", "id", "rank")


@query(with_(HYBRID[: HYBRID.index("s1 AS")].rstrip().rstrip(",")) + "SELECT query_id, id, rank::INT AS rank FROM dr")
def dense_only(spark, sf):
    return _hybrid(spark, sf, use_bm25=False).select("query_id", "id", "rank")


PLACED = """placed AS (SELECT id, content_type, source, version AS path, row_number() OVER (PARTITION BY source ORDER BY id) + 1000000 * substr(source, 4)::BIGINT AS spot FROM chunks)"""


@query(with_(V.CHUNKS, PLACED) + """, hits AS (SELECT item_id AS query_id, item_id * 20 + k AS id, k + 1 AS rank FROM benchmark, range(0, 5) AS t(k)),
centre AS (SELECT query_id, rank AS hr, spot, source, path FROM hits JOIN placed USING (id) WHERE content_type IN ('table', 'register')),
near AS (SELECT query_id, hr, s AS step, c.id FROM centre, (VALUES (-1), (1)) AS x(s) JOIN placed c ON c.spot = centre.spot + s AND c.source = centre.source AND c.path = centre.path),
fresh AS (SELECT query_id, id, min(hr * 10 + step) AS o FROM near n WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = n.query_id AND h.id = n.id) GROUP BY ALL)
SELECT query_id, id, (5 + row_number() OVER (PARTITION BY query_id ORDER BY o, id))::INT AS rank FROM fresh""")
def neighbor_expand(spark, sf):
    hits = V.keyword_queries(spark, sf).select("query_id", F.posexplode(F.sequence(F.lit(0), F.lit(4))).alias("i", "k"))
    hits = hits.select("query_id", (F.col("query_id") * 20 + F.col("k")).alias("id"), (F.col("i") + 1).alias("rank"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("id")) + 1000000 * F.substring("source", 4, 9).cast("long")
    c = V.chunks(spark, sf).withColumn("pos", place).withColumn("section_path", F.col("version"))
    return retrieval.neighbours(hits, c)


VARIANTS = "variants AS (SELECT l_orderkey AS query_id, l_linenumber % 3 AS variant_ord, l_suppkey AS id, l_linenumber AS rank, l_partkey FROM lineitem)"


def _variants(spark, sf):
    return V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_linenumber") % 3).alias("variant_ord"), F.col("l_suppkey").alias("id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("rank"))


@query(with_(VARIANTS) + "SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY o, id)::INT AS rank FROM (SELECT query_id, id, min(variant_ord * 100000000000 + rank * 1000000 + l_partkey) AS o FROM variants GROUP BY ALL) QUALIFY rank <= 3")
def multi_query_dedupe(spark, sf):
    return retrieval.merge_variants(_variants(spark, sf), 3).select("query_id", "id", "rank")


@query(with_(V.CHUNKS) + """, h AS (SELECT label AS query_id, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings QUALIFY rank <= 3),
x AS (SELECT query_id, rank, '[' || rank || '] Source: ' || source || ' | Pages: ' || CASE WHEN id % 2 = 0 THEN '7' ELSE '7–9' END || ' | Section: 6.1 ' || section_title || chr(10) || 'Cite-as: [' || source || ' §6.1 p.7]' || chr(10) || raw_text AS e FROM h JOIN chunks USING (id))
SELECT query_id, string_agg(e, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n_excerpts FROM x GROUP BY query_id""")
def citations(spark, sf):
    hits = retrieval.top(V.table(spark, sf, "embeddings").select(F.col("label").alias("query_id"), F.col("vec_id").alias("id")), ["query_id"], ["id"], 3)
    rows = hits.join(V.chunks(spark, sf), "id")
    text = retrieval.excerpt(F.col("rank"), F.col("source"), F.lit(7), F.when(F.col("id") % 2 == 0, 7).otherwise(9), F.array(F.lit("6"), F.lit("6.1")), F.col("section_title"), F.col("raw_text"))
    return retrieval.context(rows.withColumn("excerpt", text), ["query_id"])


@query(with_(V.CHUNKS, """dq AS (SELECT vec_id // 100 AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
indexed AS (SELECT e.vec_id AS id, embedding::DOUBLE[] AS v, lang AS version FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id)""") + """SELECT query_id AS feature_id, version, id, row_number() OVER (PARTITION BY query_id, version ORDER BY d, id)::INT AS rank
FROM (SELECT query_id, version, id, 1 - list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) AS d FROM dq, indexed WHERE version IN ('en', 'fr', 'de')) QUALIFY row_number() OVER (PARTITION BY query_id, version ORDER BY d, id) <= 5""")
def compare_versions(spark, sf):
    c = V.chunks(spark, sf)
    v = V.vectors(spark, sf).drop("version").join(c.select("id", "version"), "id")
    q = V.dense_queries(spark, sf).withColumn("query", F.lit("bus width"))
    return retrieval.compare_versions(q, ["en", "fr", "de"], lambda f: retrieval.hybrid(f, c, v, use_bm25=False, n=5, most=9.0), c)


# -- reports, conversations, inspection -----------------------------------------------------------------------------


def _results(spark, sf):
    d = V.table(spark, sf, "documents").join(V.table(spark, sf, "labels"), "doc_id")
    nan = F.when(F.col("n_chars") < 500, F.lit(float("nan"))).otherwise(F.col("quality").cast("double"))
    return d.select("doc_id", F.col("lang").alias("type"), F.when(F.col("doc_id") % 2 == 0, "dense_rag").otherwise("hybrid_rag").alias("pipeline"), nan.alias("faithfulness"), F.col("toxic").cast("double").alias("answer_relevancy"), (F.col("n_chars") / 1000).alias("context_precision"), F.lit(None).cast("double").alias("context_recall"))


RESULTS = """results AS (SELECT doc_id, lang AS type, CASE WHEN doc_id % 2 = 0 THEN 'dense_rag' ELSE 'hybrid_rag' END AS pipeline, CASE WHEN n_chars >= 500 THEN quality::DOUBLE END AS faithfulness, toxic::DOUBLE AS answer_relevancy, n_chars / 1000.0::DOUBLE AS context_precision, NULL::DOUBLE AS context_recall FROM documents JOIN labels USING (doc_id))"""
MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in evaluate.METRICS)


def _rounded(df, names=None):
    return df.withColumns({m: F.round(m, 6) for m in names or evaluate.METRICS})


@query(with_(RESULTS) + f"SELECT pipeline, count(*) AS n, {MEANS} FROM results GROUP BY pipeline")
def eval_summary(spark, sf):
    return _rounded(evaluate.summary(_results(spark, sf), ["pipeline"]))


@query(with_(RESULTS) + f"SELECT type, count(*) AS n, {MEANS}, list_position(['en', 'fr', 'de'], type)::BIGINT AS place FROM results WHERE type IN ('en', 'fr', 'de') GROUP BY type")
def eval_by_type(spark, sf):
    return _rounded(evaluate.by_type(_results(spark, sf), ["en", "fr", "de"]))


@query(with_(RESULTS) + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}) FILTER (pipeline = 'dense_rag'), 6) AS base, round(avg({m}) FILTER (pipeline = 'hybrid_rag'), 6) AS other, round(avg({m}) FILTER (pipeline = 'hybrid_rag') - avg({m}) FILTER (pipeline = 'dense_rag'), 6) AS delta FROM results" for m in evaluate.METRICS))
def eval_delta(spark, sf):
    return _rounded(evaluate.delta(_results(spark, sf), "dense_rag", "hybrid_rag"), ["base", "other", "delta"])


@query(with_(RESULTS) + "SELECT doc_id, type, coalesce(printf('%.4f', faithfulness), '—') AS faithfulness, coalesce(printf('%.4f', answer_relevancy), '—') AS answer_relevancy, '—' AS context_recall FROM results")
def eval_detail(spark, sf):
    return _results(spark, sf).select("doc_id", "type", *[X.metric_cell(F.col(m)).alias(m) for m in ("faithfulness", "answer_relevancy", "context_recall")])


@query("""WITH w AS (SELECT conv_id, turn, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS turn_no, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations)
SELECT conv_id, turn, role, turn_no, (min(place) OVER (PARTITION BY conv_id, turn_no) - 1)::INT AS n_before FROM w""")
def conversation_turns(spark, sf):
    return assistant.turns(V.table(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", "turn_no", "n_before")


def _sentences_sql(text: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(coalesce({text}, ''), '[.!?\\n]+'), lambda x: list_distinct(regexp_extract_all(lower(x), '[a-z0-9_]+'))), lambda t: len(t) > 0)"


#: each answer of a conversation: the question before it, the two turns before that as contexts, the next turn as the reference
ANSWERED = f"""asked AS (SELECT a.conv_id, a.turn, q.text AS question, a.text AS response, r.text AS reference, p.text AS c1, o.text AS c2 FROM conversations a
  JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1 LEFT JOIN conversations r ON r.conv_id = a.conv_id AND r.turn = a.turn + 1
  LEFT JOIN conversations p ON p.conv_id = a.conv_id AND p.turn = a.turn - 2 LEFT JOIN conversations o ON o.conv_id = a.conv_id AND o.turn = a.turn - 3),
cut AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(question), '[a-z0-9_]+')) AS q, {_sentences_sql("response")} AS r, {_sentences_sql("reference")} AS ref, [{_sentences_sql("c1")}, {_sentences_sql("c2")}] AS c FROM asked),
flat AS (SELECT *, flatten(c) AS every FROM cut),
best AS (SELECT conv_id, turn, q, r, ref, list_sum(list_transform(r, lambda s: len(s))) AS n_r, list_sum(list_transform(ref, lambda s: len(s))) AS n_ref,
  list_sum(list_transform(r, lambda s: coalesce(list_max(list_transform(every, lambda x: len(list_intersect(s, x)))), 0))) AS h_r, list_sum(list_transform(ref, lambda s: coalesce(list_max(list_transform(every, lambda x: len(list_intersect(s, x)))), 0))) AS h_ref,
  list_transform(c, lambda x: len(list_filter(ref, lambda s: len(list_filter(x, lambda y: len(list_intersect(s, y)) >= 0.5 * len(s))) > 0)) > 0) AS good FROM flat)"""


@query(with_(ANSWERED) + """SELECT conv_id, turn, round(CASE WHEN n_r > 0 THEN h_r::DOUBLE / n_r END, 6) AS faithfulness_standin, round(CASE WHEN len(r) > 0 AND len(q) > 0 THEN len(list_intersect(q, flatten(r)))::DOUBLE / len(q) END, 6) AS answer_relevancy_standin,
CASE WHEN len(r) > 0 AND len(ref) > 0 THEN CASE WHEN good[1] THEN 1.0::DOUBLE WHEN good[2] THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END END AS context_precision_standin, round(CASE WHEN len(r) > 0 AND n_ref > 0 THEN h_ref::DOUBLE / n_ref END, 6) AS context_recall_standin FROM best""")
def metric_standins(spark, sf):
    """Every turn of a conversation as an answer to the one before it."""
    c = V.table(spark, sf, "conversations")
    turn = lambda name, step: c.select("conv_id", (F.col("turn") - step).alias("turn"), F.col("text").alias(name))
    rows = c.select("conv_id", "turn", F.col("text").alias("response")).join(turn("question", -1), ["conv_id", "turn"])
    for name, step in (("reference", 1), ("c1", -2), ("c2", -3)):
        rows = rows.join(turn(name, step), ["conv_id", "turn"], "left")
    scores = evaluate.standins(rows.withColumn("contexts", F.array("c1", "c2")))
    return scores.select("conv_id", "turn", *[F.round(f"{m}_standin", 6).alias(f"{m}_standin") for m in evaluate.METRICS])


@query("""WITH RECURSIVE ends AS (SELECT conv_id, max(turn) AS turn, count(*) AS n FROM conversations GROUP BY conv_id),
asked AS (SELECT c.conv_id, CASE WHEN c.conv_id % 3 = 0 THEN e.turn ELSE 1 END AS seq, CASE WHEN c.conv_id % 3 = 0 THEN e.n ELSE 2 END AS n, coalesce(c.text, '') AS text FROM conversations c JOIN ends e USING (conv_id, turn)),
steps AS (SELECT * FROM asked UNION ALL SELECT conv_id, seq + 2, n + 2, array_to_string(list_filter(string_split(text, ' '), lambda x, i: i % 2 = 1), ' ') FROM steps WHERE len(string_split(text, ' ')) > 20)
SELECT conv_id::VARCHAR AS thread_id, CASE WHEN conv_id % 3 = 0 THEN 0 ELSE 1 END AS epoch, seq + 1 AS seq, 'assistant' AS role, CASE WHEN len(string_split(text, ' ')) > 20 THEN '' ELSE n || ' messages: ' || text END AS content, NULL AS tool FROM steps
UNION ALL SELECT conv_id::VARCHAR, CASE WHEN conv_id % 3 = 0 THEN 0 ELSE 1 END, s.seq, 'tool', s.text, 'condense' FROM steps s JOIN asked a USING (conv_id) WHERE s.seq > a.seq""")
def agent_loop(spark, sf):
    """Every conversation's last message, asked of an agent that condenses it by a tool until it is short; a third of the threads was reset
    before, a third switched to another version. The loop runs twice: the second run has nothing to do."""
    c = V.table(spark, sf, "conversations").select("conv_id", F.col("conv_id").cast("string").alias("thread_id"), F.col("turn").alias("ord"), "role", F.coalesce("text", F.lit("")).alias("content"))
    last = c.groupBy("thread_id").agg(F.max("ord").alias("ord"))
    memory = threads.Threads(spark, working_folder(spark, "threads"))
    memory.post(c.join(last, ["thread_id", "ord"], "left_anti"))
    memory.reset(c.filter("conv_id % 3 = 1"))
    memory.reset(c.filter("conv_id % 3 = 2"), "5.0")
    memory.reset(c.filter("conv_id % 3 = 2"), "5.0")  # it is the version of their memory
    memory.post(c.join(last, ["thread_id", "ord"]).select("thread_id", "content"))

    def decide(rows):
        text = F.col("content")
        long = F.size(F.split(text, " ")) > 20
        call = F.array(F.struct(F.lit("condense").alias("tool"), text.alias("input")))
        return rows.select("thread_id", "epoch", F.when(long, "").otherwise(F.concat(F.col("n_messages").cast("string"), F.lit(" messages: "), text)).alias("content"), F.when(long, call).alias("calls"))

    for _ in range(2):
        memory.run(decide, {"condense": lambda text: F.array_join(F.filter(F.split(text, " "), lambda _, i: i % 2 == 0), " ")})
    now = memory.memory()
    asked = now.filter("role = 'user'").groupBy("thread_id").agg(F.max("seq").alias("asked"))
    return now.join(asked, "thread_id").filter("seq > asked").select("thread_id", "epoch", "seq", "role", "content", "tool")


def _run_events(spark, sf):
    e = V.table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "view", events.START).when(F.col("event_type").isin("purchase", "error"), events.END).otherwise(events.TOKEN)
    return e.select(F.col("user_id").alias("session_id"), F.expr("event_id div 3 % 5").alias("run_id"), "ts", F.col("event_id").alias("ord"), kind.alias("kind"), F.when(F.col("event_id") % 11 > 0, F.concat(F.lit(" "), F.col("event_id").cast("string"))).alias("content"))


GATED = """e AS (SELECT user_id AS session_id, event_id // 3 % 5 AS run_id, ts, event_id AS ord, CASE WHEN event_type = 'view' THEN 'tool_start' WHEN event_type IN ('purchase', 'error') THEN 'tool_end' ELSE 'token' END AS kind, CASE WHEN event_id % 11 > 0 THEN ' ' || event_id END AS content FROM events),
marks AS (SELECT *, lag(kind) OVER (PARTITION BY session_id, run_id ORDER BY ts, ord) AS was FROM e WHERE kind <> 'token'),
changes AS (SELECT session_id, ts, ord, CASE WHEN kind = 'tool_start' AND was IS DISTINCT FROM 'tool_start' THEN 1 WHEN kind = 'tool_end' AND was = 'tool_start' THEN -1 ELSE 0 END AS c FROM marks),
opened AS (SELECT e.*, sum(coalesce(c, 0)) OVER (PARTITION BY session_id ORDER BY ts, ord)::INT AS open FROM e LEFT JOIN changes USING (session_id, ts, ord))"""


@query(with_(GATED) + "SELECT session_id, ord, open, kind = 'token' AND content IS NOT NULL AND open = 0 AS shown FROM opened")
def gated_tokens(spark, sf):
    """A model's tokens among tool runs that overlap, begin twice and end unbegun; sessions are counted by the day."""
    rows = events.gated(_run_events(spark, sf), order=["ts", "ord"], slice_by=F.unix_date(F.to_date("ts")))
    return rows.select("session_id", "ord", "open", "shown")


@query(with_(GATED) + """SELECT session_id, CASE WHEN count(*) FILTER (s) = 0 THEN 'No answer was made; please try again.' ELSE string_agg(content, '' ORDER BY ts, ord) FILTER (s) END AS answer, count(*) FILTER (s) AS n_shown, count(*) FILTER (kind = 'tool_start') AS n_tools
FROM (SELECT *, kind = 'token' AND content IS NOT NULL AND open = 0 AS s FROM opened) GROUP BY session_id""")
def gated_answers(spark, sf):
    order = ["ts", "ord"]
    return events.answers(events.gated(_run_events(spark, sf), order=order), order=order)


@query(with_(GATED) + """, w AS (SELECT *, lead(kind) OVER o AS next_kind, lead(content) OVER o AS next_content FROM e WHERE kind <> 'token' WINDOW o AS (PARTITION BY session_id, run_id ORDER BY ts, ord))
SELECT session_id, run_id, content AS input, CASE WHEN next_kind = 'tool_end' THEN next_content END AS output FROM w WHERE kind = 'tool_start' QUALIFY row_number() OVER (PARTITION BY session_id, run_id ORDER BY ts, ord) = 1""")
def tool_steps(spark, sf):
    return events.tool_steps(_run_events(spark, sf), order=["ts", "ord"])


@query(with_(V.CHUNKS) + "SELECT id, CASE WHEN length(text) > 30 THEN left(text, 30) || '…' ELSE text END AS preview FROM chunks WHERE content_type = 'text' AND NOT is_front_matter AND contains(lower(text), 'the') ORDER BY id LIMIT 50 OFFSET 50")
def inspector_search(spark, sf):
    return assistant.inspect(V.chunks(spark, sf), "text", "The", page=1).select("id", X.preview(F.col("text"), 30).alias("preview"))


@query("""SELECT item_id AS query_id, round(len(list_intersect(a, r)) / len(r)::DOUBLE, 6) AS recall FROM (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS a, list_distinct(regexp_extract_all(lower(text || ' ' || item_id || ' reference'), '[a-z0-9_]+')) AS r FROM benchmark)""")
def overlap_metrics(spark, sf):
    q = V.keyword_queries(spark, sf)
    _, recall = evaluate.token_overlap(F.col("query"), F.concat_ws(" ", "query", "query_id", F.lit("reference")))
    return q.select("query_id", F.round(recall, 6).alias("recall"))


@query(with_(V.BM25) + """, hits AS (SELECT query_id, pos AS id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) AS rank FROM scores QUALIFY rank <= 10),
relevant AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
n AS (SELECT query_id, count(*) AS n FROM relevant GROUP BY query_id),
found AS (SELECT query_id, min(rank) AS first, count(*) AS k, sum(1 / log2(rank + 1.0)) AS dcg FROM hits JOIN relevant USING (query_id, id) GROUP BY query_id)
SELECT query_id, round(coalesce(1.0 / first, 0), 6) AS mrr, round(coalesce(k / n::DOUBLE, 0), 6) AS recall, round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1.0))), 0), 6) AS ndcg FROM n LEFT JOIN found USING (query_id)""")
def ranking_quality(spark, sf):
    """BM25 against the documents that hold a benchmark text verbatim."""
    q, c = V.keyword_queries(spark, sf), V.chunks(spark, sf)
    hits = retrieval.bm25_search(q, c, F.col("raw_text"), 10).select("query_id", F.col("pos").alias("id"), "rank")
    scores = evaluate.ranking_metrics(hits, evaluate.verbatim(q, c.select("id", F.col("raw_text").alias("text"))))
    return scores.select("query_id", *[F.round(m, 6).alias(m) for m in ("mrr", "recall", "ndcg")])


@query("SELECT doc_id AS ord, text AS user_input, lang AS response, source AS reference FROM documents")
def eval_samples(spark, sf):
    d = V.table(spark, sf, "documents")
    records = d.select(F.col("doc_id").alias("ord"), F.col("text").alias("question"), F.col("source").alias("reference"))
    responses = d.select(F.col("doc_id").alias("ord"), F.col("lang").alias("response"), F.array("source").alias("contexts"))
    return evaluate.zip_records(records, responses).select("ord", "user_input", "response", "reference")


@query(with_(V.CHUNKS) + """SELECT id, CASE WHEN section_path <> '' THEN 'dist=' || printf('%.3f', id / 1000.0::DOUBLE) WHEN is_row_chunk THEN 'rrf=' || printf('%.4f', id / 1000.0::DOUBLE) ELSE 'bm25-only' END AS shown FROM chunks""")
def score_texts(spark, sf):
    c, v = V.chunks(spark, sf), F.col("id") / 1000
    return c.select("id", retrieval.score_text(F.when(F.col("section_path") != "", v), F.when(F.col("is_row_chunk"), v)).alias("shown"))


@query("SELECT doc_id::VARCHAR AS id, 8 + (lang = 'en')::INT AS n_keys, lang || '/' || source AS path FROM documents")
def vector_records(spark, sf):
    """The metadata hold what has a value: here eight keys, and a term for one language."""
    none = F.lit(None).cast("string")
    d = V.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("chunk_id"), "source", F.col("lang").alias("version"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.array("lang", "source").alias("section_path"), none.alias("section_title"),
        none.alias("heading_level"), F.lit("text").alias("content_type"), F.lit(False).alias("is_front_matter"), none.alias("chunk_index"), none.alias("is_row_chunk"), none.alias("figure_caption"), F.when(F.col("lang") == "en", "t").alias("term"),
        none.alias("parent_chunk_id"), F.col("text").alias("raw_text"), "text",
    )
    r = store.vector_record(d)
    return r.select("id", F.size("metadata").alias("n_keys"), F.element_at("metadata", F.lit("section_path")).alias("path"))


@query(with_(V.DENSE) + """, g AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM dists WHERE version = 0 QUALIFY rank <= 5)
SELECT query_id, string_agg('[' || rank || '] glossary p.' || id || chr(10) || 'entry ' || id, chr(10) || chr(10) ORDER BY rank) AS answer, count(*) AS n_excerpts FROM g GROUP BY query_id""")
def explain_terms(spark, sf):
    g = V.vectors(spark, sf).filter("version = 0").withColumns({"source": F.lit("glossary"), "page_start": F.col("id").cast("int"), "document": F.concat(F.lit("entry "), F.col("id").cast("string"))})
    return assistant.explain_terms(V.dense_queries(spark, sf).withColumn("query", F.lit("t")), g)


@query(with_(V.CHUNKS) + rf"SELECT version, count(DISTINCT id) AS docs, count(DISTINCT id) FILTER (content_type = 'definition') AS glossary FROM chunks WHERE {BODY} AND length({TRIM.format('raw_text')}) >= CASE content_type WHEN 'text' THEN 20 WHEN 'table' THEN 25 WHEN 'definition' THEN 8 WHEN 'register' THEN 40 ELSE 30 END GROUP BY version")
def incremental_index(spark, sf):
    """What the store holds after the first half has been indexed, then everything, then everything again."""
    none = F.lit(None).cast("string")
    c = V.chunks(spark, sf).withColumns({"chunk_id": F.col("id").cast("string"), "page_end": F.lit(1), "section_path": F.array("section_path"), "heading_level": F.lit(1), "chunk_index": F.col("id"), "figure_caption": none, "term": none, "parent_chunk_id": none, "line": F.col("id")})
    half = c.agg(F.max("id")).first()[0] // 2
    s = store.VectorStore(spark, working_folder(spark, "store"))
    for part in (c.filter(F.col("id") <= half), c, c):
        store.index_chunks(s, part, HashingEmbedder)
    docs = s.collection().groupBy("version").agg(F.count("*").alias("docs"))
    return docs.join(s.collection("glossary").groupBy("version").agg(F.count("*").alias("glossary")), "version", "left").withColumn("glossary", F.coalesce("glossary", F.lit(0)))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword and vector search, fused: the engine end to end."""
    return rrf_fuse(spark, sf)
