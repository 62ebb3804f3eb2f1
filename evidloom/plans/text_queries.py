"""Text, chunk, evidence and readiness queries bound to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.functions import text as T
from evidloom.operators import chunks as C
from evidloom.operators import evidence as E

HEADING = r"[A-Z]\S* \S+\.$"
MAX_CHARS, OVERLAP = 2000, 120


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunks(sources(spark, sf_dir), patterns=(HEADING,), max_chars=MAX_CHARS, overlap_chars=OVERLAP)


def prj_01_chunks(spark, sf_dir):
    """The chunk ledger of all documents (PRJ-01, FN-01, FN-02, WIN-02..04)."""
    return ledger(spark, sf_dir).drop("text")


def fn_01_sections(spark, sf_dir):
    own = sources(spark, sf_dir).select("source_id", F.inline(T.sections(F.col("text"), (HEADING,))))
    return own.select("source_id", "start", "end", F.col("hint"))


def fn_02_bounded_ranges(spark, sf_dir):
    n = F.char_length("text").cast("long")
    return sources(spark, sf_dir).select("source_id", F.inline(T.bounded(F.lit(0).cast("long"), n, 700, 50)))


def src_03_digests(spark, sf_dir):
    """Digest, size in bytes and length in characters of each source (SRC-02, SRC-03, FN-16)."""
    x = sources(spark, sf_dir)
    return x.select("source_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"), F.octet_length("text").cast("long").alias("bytes"), F.char_length("text").cast("long").alias("chars"))


def fn_04_stable_ids(spark, sf_dir):
    n = table(spark, sf_dir, "customer")
    node = T.node_id(F.lit("world"), F.col("c_name"), F.lit("customer"))
    target = T.node_id(F.lit("world"), F.col("c_nationkey").cast("string"), F.lit("nation"))
    return n.select(
        "c_custkey", node.alias("node_id"), T.edge_id(F.lit("world"), node, target, F.lit("lives_in")).alias("edge_id"),
        T.event_id(F.lit("world"), F.lit("order"), F.col("c_name"), F.col("c_custkey"), F.col("c_custkey") + 7).alias("event_id"),
        T.evidence_id(F.lit("world"), F.lit("chunk-0001"), F.col("c_custkey"), F.col("c_custkey") + 7).alias("evidence_id"),
    )


def fn_10_query_terms(spark, sf_dir):
    own = table(spark, sf_dir, "benchmark").select("item_id", T.query_terms(F.col("text")).alias("terms"))
    return own.select("item_id", F.posexplode("terms").alias("ord", "term")).select("item_id", F.col("ord").cast("long").alias("ord"), "term")


def fn_14_headings(spark, sf_dir):
    marked = F.regexp_replace(F.regexp_replace("html", "<h1[^>]*>", "\n# "), "</h1>", "\n")
    own = table(spark, sf_dir, "pages").select("page_id", T.headings(marked).alias("h"))
    return own.select("page_id", F.posexplode("h").alias("ord", "heading")).select("page_id", F.col("ord").cast("long").alias("ord"), "heading")


def val_11_chunk_coverage(spark, sf_dir):
    """Coverage errors of a ledger damaged by rule: every 13th source loses its second chunk, every 17th its last is pending, every 19th has none (VAL-11, WIN-01)."""
    x = ledger(spark, sf_dir).select("source_id", "chunk_no", "chunk_id", "start", "end")
    x = x.where(~((F.col("source_id") % 13 == 0) & (F.col("chunk_no") == 2)) & (F.col("source_id") % 19 != 0))
    x = x.select("source_id", "chunk_id", "start", "end", F.when((F.col("source_id") % 17 == 0) & (F.col("chunk_no") == 1), "pending").otherwise("completed").alias("status"))
    return C.coverage_errors(x, sources(spark, sf_dir).select("source_id", F.char_length("text").cast("long").alias("n")))


KINDS = {"required_fields": "field", "required_tables": "table", "required_cards": "card", "required_case_patterns": "case_pattern"}


def templates(spark, sf_dir):
    """Benchmark items as requirements: template item_id // 8, key item_id % 4."""
    b = table(spark, sf_dir, "benchmark")
    name = F.format_string("template-%03d", F.floor(F.col("item_id") / 8).cast("int"))
    of = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("item_id") % 4 == k, F.struct("item_id", "text")))), lambda x: x["text"])
    return b.groupBy(name.alias("template_name")).agg(*[of(k).alias(c) for k, c in enumerate(KINDS)])


def evd_02_requirement_items(spark, sf_dir):
    return E.requirement_items(templates(spark, sf_dir), KINDS)


def _hits(spark, sf_dir):
    return E.first_hits(E.requirement_items(templates(spark, sf_dir), KINDS), ledger(spark, sf_dir))


def jn_14_first_hits(spark, sf_dir):
    """The first place of each requirement in each document's chunks (JN-14, WIN-05, FN-12)."""
    return _hits(spark, sf_dir)


def evd_01_evidence(spark, sf_dir):
    return E.evidence(_hits(spark, sf_dir))


def evd_01_supplements(spark, sf_dir):
    """Nodes, events and edges that evidence gives, as one list of ids (EVD-01)."""
    parts = E.supplements(E.requirement_items(templates(spark, sf_dir), KINDS), E.evidence(_hits(spark, sf_dir)))
    rows = [parts[k].select(F.lit(k).alias("collection"), F.col(c).alias("id"), "evidence_id") for k, c in (("nodes", "node_id"), ("events", "event_id"), ("edges", "edge_id"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def agg_04_readiness(spark, sf_dir):
    """Coverage of each template's requirements over the corpus, with what supports it (AGG-04, EVD-03)."""
    items = E.requirement_items(templates(spark, sf_dir), KINDS)
    parts = E.supplements(items, E.evidence(_hits(spark, sf_dir)))
    return E.readiness(parts["status"], parts["links"])


def agg_07_ordered_distinct(spark, sf_dir):
    """Each user's event types in the order of their first event (AGG-07, AGG-08)."""
    out = E.ordered_distinct(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id", "types")
    return out.select("user_id", F.array_join("types", ",").alias("types"))


QUERIES = {f.__name__: f for f in (prj_01_chunks, fn_01_sections, fn_02_bounded_ranges, src_03_digests, fn_04_stable_ids, fn_10_query_terms, fn_14_headings, val_11_chunk_coverage, evd_02_requirement_items, jn_14_first_hits, evd_01_evidence, evd_01_supplements, agg_04_readiness, agg_07_ordered_distinct)}

_SECTIONS = rf"""
line AS (SELECT doc_id, no, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents)),
head AS (SELECT doc_id, pos, trim(line) AS hint FROM line WHERE regexp_matches(trim(line), '^{HEADING}')
  UNION ALL SELECT doc_id, -1, NULL FROM documents),
section AS (SELECT doc_id, greatest(pos, 0) AS s, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), length(text))::BIGINT AS e, hint FROM head JOIN documents USING (doc_id)),
sections AS (SELECT * FROM section WHERE e > s)"""


def _ranges(s: str, e: str, most: int, overlap: int) -> str:
    step = most - overlap
    return f"[{{'s': ({s} + i * {step})::BIGINT, 'e': least({s} + i * {step} + {most}, {e})::BIGINT}} for i in range(0, greatest(1, CASE WHEN {e} - {s} <= {most} THEN 1 ELSE ceil(({e} - {s} - {overlap}) / {step}) END)::BIGINT)]"


_CHUNKS = f"""{_SECTIONS},
chunk AS (SELECT doc_id, hint, r.s AS s, r.e AS e, row_number() OVER (PARTITION BY doc_id ORDER BY r.s, r.e)::BIGINT AS no FROM (SELECT doc_id, hint, s AS s0, unnest({_ranges("s", "e", MAX_CHARS, OVERLAP)}) AS r FROM sections)),
chunks AS (SELECT chunk.*, printf('chunk-%04d', no) AS chunk_id, text[s+1:e] AS t FROM chunk JOIN documents USING (doc_id))"""
_SLUG = lambda *p: f"substr(sha256(concat_ws('|', {', '.join(p)})), 1, 16)"
_ITEMS = """
req AS (SELECT printf('template-%03d', item_id // 8) AS template_name, ['field', 'table', 'card', 'case_pattern'][item_id % 4 + 1] AS kind,
  ['required_fields', 'required_tables', 'required_cards', 'required_case_patterns'][item_id % 4 + 1] AS key, text AS value,
  (item_id % 4) * 1000000 + row_number() OVER (PARTITION BY item_id // 8, item_id % 4 ORDER BY item_id) - 1 AS ord FROM benchmark WHERE text <> ''),
items AS (SELECT template_name, kind, arg_min(key, ord) AS key, value, min(ord)::BIGINT AS ord, concat_ws('.', template_name, arg_min(key, ord), value) AS requirement_id FROM req GROUP BY template_name, kind, value)"""
_HITS = f"""{_CHUNKS}, {_ITEMS},
hit AS (SELECT requirement_id, doc_id, no, chunk_id, s + instr(lower(t), lower(value)) - 1 AS b, length(value) AS n FROM items JOIN chunks ON contains(lower(t), lower(value))),
hits AS (SELECT requirement_id, doc_id, no, chunk_id, b, b + n AS f FROM hit QUALIFY row_number() OVER (PARTITION BY requirement_id, doc_id ORDER BY no) = 1),
ev AS (SELECT 'evidence:' || {_SLUG("doc_id", "chunk_id || ':' || requirement_id", "'[' || b || ',' || f || ']'")} AS evidence_id, * FROM hits)"""
_SUPPLEMENT = f"""{_HITS}, rows AS (SELECT ev.*, 'node:requirement:' || {_SLUG("doc_id", "requirement_id", "'requirement'")} AS node_id,
  'event:evidence:' || {_SLUG("doc_id", "'evidence'", "requirement_id", "'[' || b || ',' || f || ']'")} AS event_id FROM ev)"""

ORACLES = {
    "prj_01_chunks": f"WITH {_CHUNKS} SELECT doc_id AS source_id, no AS chunk_no, chunk_id, s AS start, e AS \"end\", hint, sha256(t) AS sha256 FROM chunks",
    "fn_01_sections": f"WITH {_SECTIONS} SELECT doc_id AS source_id, s::BIGINT AS start, e AS \"end\", hint FROM sections",
    "fn_02_bounded_ranges": f"SELECT doc_id AS source_id, r.s AS start, r.e AS \"end\" FROM (SELECT doc_id, unnest({_ranges('0', 'length(text)', 700, 50)}) AS r FROM documents)",
    "src_03_digests": "SELECT doc_id AS source_id, sha256(text) AS sha256, md5(text) AS md5, octet_length(encode(text))::BIGINT AS bytes, length(text)::BIGINT AS chars FROM documents",
    "fn_04_stable_ids": f"""WITH n AS (SELECT c_custkey, c_name, 'node:customer:' || {_SLUG("'world'", "c_name", "'customer'")} AS node_id, 'node:nation:' || {_SLUG("'world'", "c_nationkey", "'nation'")} AS target, '[' || c_custkey || ',' || (c_custkey + 7) || ']' AS span FROM customer)
SELECT c_custkey, node_id, 'edge:lives_in:' || {_SLUG("'world'", "node_id", "target", "'lives_in'")} AS edge_id, 'event:order:' || {_SLUG("'world'", "'order'", "c_name", "span")} AS event_id, 'evidence:' || {_SLUG("'world'", "'chunk-0001'", "span")} AS evidence_id FROM n""",
    "fn_10_query_terms": r"""WITH t AS (SELECT item_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_\p{M}]+') AS w FROM benchmark))
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY min(i)) - 1)::BIGINT AS ord, term FROM t WHERE NOT (regexp_matches(term, '^[A-Za-z]*$') AND length(term) <= 2) GROUP BY item_id, term""",
    "fn_14_headings": r"""SELECT page_id, (no - 1)::BIGINT AS ord, trim(h[no]) AS heading FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS no FROM (SELECT page_id, regexp_extract_all(html, '<h1[^>]*>([^<]*\S[^<]*)</h1>', 1) AS h FROM pages))""",
    "val_11_chunk_coverage": f"""WITH {_CHUNKS}, kept AS (SELECT doc_id, chunk_id, s, e, CASE WHEN doc_id % 17 = 0 AND no = 1 THEN 'pending' ELSE 'completed' END AS status FROM chunks WHERE NOT (doc_id % 13 = 0 AND no = 2) AND doc_id % 19 <> 0),
w AS (SELECT *, lag(e) OVER o AS before, lead(s) OVER o AS after FROM kept WINDOW o AS (PARTITION BY doc_id ORDER BY s, e, chunk_id)), x AS (SELECT w.*, length(text) AS n FROM w JOIN documents USING (doc_id))
SELECT doc_id AS source_id, chunk_id, 'chunk_coverage_start' AS code FROM x WHERE before IS NULL AND s <> 0
UNION ALL SELECT doc_id, chunk_id, 'chunk_coverage_gap' FROM x WHERE s > before
UNION ALL SELECT doc_id, chunk_id, 'chunk_coverage_end' FROM x WHERE after IS NULL AND e <> n
UNION ALL SELECT doc_id, chunk_id, 'chunk_not_completed' FROM x WHERE status <> 'completed'
UNION ALL SELECT doc_id, '', 'chunk_ledger_empty' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM kept)""",
    "evd_02_requirement_items": f"WITH {_ITEMS} SELECT * FROM items",
    "jn_14_first_hits": f"WITH {_HITS} SELECT requirement_id, doc_id AS source_id, no AS chunk_no, chunk_id, b::BIGINT AS start, f::BIGINT AS \"end\" FROM hits",
    "evd_01_evidence": f"WITH {_HITS} SELECT evidence_id, doc_id AS source_id, requirement_id, chunk_id, b::BIGINT AS start, f::BIGINT AS \"end\" FROM ev",
    "evd_01_supplements": f"""WITH {_SUPPLEMENT} SELECT DISTINCT 'nodes' AS collection, node_id AS id, evidence_id FROM rows UNION ALL SELECT DISTINCT 'events', event_id, evidence_id FROM rows
UNION ALL SELECT DISTINCT 'edges', 'edge:supports:' || {_SLUG("doc_id", "node_id", "event_id", "'supports'")}, evidence_id FROM rows""",
    "agg_04_readiness": f"""WITH {_SUPPLEMENT}, st AS (SELECT items.*, requirement_id IN (SELECT requirement_id FROM hits) AS ok FROM items),
miss AS (SELECT template_name, kind, min(ord) AS o FROM st WHERE NOT ok GROUP BY ALL), kinds AS (SELECT template_name, string_agg(kind, ',' ORDER BY o) AS k FROM miss GROUP BY 1),
held AS (SELECT template_name, count(DISTINCT node_id) AS n, count(DISTINCT (r.doc_id, node_id, event_id)) AS d, count(DISTINCT event_id) AS e, count(DISTINCT evidence_id) AS v FROM rows r JOIN items USING (requirement_id) GROUP BY 1),
t AS (SELECT template_name, count(*)::BIGINT AS total, (count(*) FILTER (WHERE ok))::BIGINT AS covered FROM st GROUP BY template_name)
SELECT template_name, total, covered, round(covered / total, 4) AS readiness_score, coalesce(k, '') AS missing_kinds, coalesce(n, 0) AS supporting_node_count, coalesce(d, 0) AS supporting_edge_count, coalesce(e, 0) AS supporting_event_count, coalesce(v, 0) AS evidence_count,
  CASE WHEN total > covered THEN (total - covered) || ' of its requirements stand in no chunk' ELSE '' END AS note
FROM t LEFT JOIN kinds USING (template_name) LEFT JOIN held USING (template_name)""",
    "agg_07_ordered_distinct": "SELECT user_id, string_agg(event_type, ',' ORDER BY o) AS types FROM (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY ALL) GROUP BY user_id",
}
