"""The query registry, and the engine's input tables as DuckDB common table expressions."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where given, the SQL that must return the same rows."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# Parameters of the linked test candidates: a day's silence, 400 px.
GAP_MS = 86_400_000
TOLERANCE_PX = 400

_LINES = r"""
SELECT *, unnest(string_split(text, chr(10))) line,
       generate_subscripts(string_split(text, chr(10)), 1) - 1 pos FROM documents"""

TABLES = {
    "boxes": rf"""
SELECT source video_id, doc_id::INT frame_idx, (doc_id * 500)::INT time_ms, pos::INT box_ord,
       regexp_replace(line, '^\s+|\s+$', '', 'g') text,
       ((doc_id * 31 + pos * 17) % 100)::DOUBLE / 100 confidence,
       10 x, (20 * pos)::INT y, greatest(1, 8 * length(line))::INT w, 16 h FROM ({_LINES})""",
    "page_boxes": r"""
SELECT 'pages' video_id, page_id::INT frame_idx, (page_id * 500)::INT time_ms, (pos - 1)::INT box_ord,
       line text, 10 x, (20 * (pos - 1))::INT y, greatest(1, 8 * length(line))::INT w, 16 h
FROM (SELECT page_id, unnest(string_split(html, chr(10))) line,
             generate_subscripts(string_split(html, chr(10)), 1) pos FROM pages)""",
    "words": r"""
SELECT conv_id::VARCHAR video_id, turn::INT frame_idx, pos::INT box_ord, word text,
       coalesce(sum(8 * (length(word) + 1)) OVER (PARTITION BY conv_id, turn ORDER BY pos
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT x,
       0 y, greatest(1, 8 * length(word))::INT w, 16 h
FROM (SELECT *, unnest(string_split(text, ' ')) word,
             generate_subscripts(string_split(text, ' '), 1) - 1 pos FROM conversations)""",
    "spans": r"""
SELECT source video_id, doc_id::INT frame_idx,
       (['PHONE_NUMBER','EMAIL_ADDRESS','PERSON','US_SSN','CREDIT_CARD','US_BANK_NUMBER','IP_ADDRESS',
         'DATE_TIME','LOCATION'])[((doc_id * 7 + k) % 9)::INT + 1] entity_type,
       ((doc_id * 37 + k * 101) % n_chars)::INT s,
       ((doc_id * 37 + k * 101) % n_chars + 2 + (doc_id + k) % 20)::INT e,
       ((doc_id * 13 + k * 29) % 100)::DOUBLE / 100 score, k::INT span_ord
FROM documents, range(0, 5) r(k)""",
    "offsets": r"""
SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY video_id, frame_idx ORDER BY box_ord
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT s FROM boxes""",
    "composites": r"""
SELECT video_id, frame_idx, string_agg(text, chr(10) ORDER BY box_ord) composite
FROM boxes GROUP BY ALL""",
    "entity_map": r"""
SELECT * FROM (VALUES ('PHONE_NUMBER','phone'), ('EMAIL_ADDRESS','email'), ('PERSON','person'),
  ('US_SSN','ssn'), ('CREDIT_CARD','credit_card'), ('US_BANK_NUMBER','account_id'),
  ('IP_ADDRESS','account_id')) t(entity_type, pii_type)""",
    "limits": r"""
SELECT * FROM (VALUES ('phone', 0.35::DOUBLE), ('email', 0.35::DOUBLE), ('person', 0.5::DOUBLE), ('ssn', 0.35::DOUBLE),
  ('credit_card', 0.35::DOUBLE), ('account_id', 0.35::DOUBLE), ('face', 0.4::DOUBLE)) t(pii_type, limit_value)""",
    "span_texts": r"""
SELECT p.*, regexp_replace(substring(c.composite, p.s + 1, p.e - p.s), '^\s+|\s+$', '', 'g') text
FROM spans p JOIN composites c USING (video_id, frame_idx)""",
    "kept": r"""
SELECT t.*, m.pii_type FROM span_texts t JOIN entity_map m USING (entity_type) LEFT JOIN limits l USING (pii_type)
WHERE t.score >= coalesce(l.limit_value, 0.35::DOUBLE)
  AND (t.entity_type <> 'PERSON' OR length(t.text) >= 4)""",
    "attributed": r"""
SELECT k.video_id, k.frame_idx, k.span_ord, min(o.box_ord) box_ord FROM kept k JOIN offsets o
  ON k.video_id = o.video_id AND k.frame_idx = o.frame_idx AND k.s < o.s + length(o.text) AND k.e > o.s
GROUP BY ALL""",
    "analyzer": r"""
SELECT k.video_id, k.frame_idx, b.time_ms, k.pii_type, k.score confidence, k.text, b.x, b.y, b.w, b.h,
       k.span_ord, k.entity_type
FROM kept k JOIN attributed a USING (video_id, frame_idx, span_ord)
JOIN boxes b ON b.video_id = k.video_id AND b.frame_idx = k.frame_idx AND b.box_ord = a.box_ord""",
    "cands": r"""
SELECT user_id::VARCHAR video_id, event_type pii_type, epoch_us(ts) // 1000 time_ms, event_id cand_ord,
       least(1::DOUBLE, value / 500::DOUBLE) confidence,
       json_extract_string(props, '$.k')::INT * 10 x, trunc(value)::INT y, 80 w, 20 h, event_type text
FROM events""",
    "cands_big": r"""
SELECT l_suppkey::VARCHAR video_id, l_returnflag pii_type, epoch_us(l_shipdate) // 1000 time_ms,
       l_orderkey * 10 + l_linenumber cand_ord, l_discount confidence,
       trunc(l_quantity * 20)::INT x, (l_partkey % 500)::INT y, 80 w, 20 h FROM lineitem""",
    "cuts": r"""
SELECT user_id::VARCHAR video_id, epoch_us(ts) // 1000 cut_ms FROM events WHERE event_type = 'error'""",
    "hists": r"""
SELECT label::VARCHAR video_id, vec_id::INT frame_idx,
       list_transform(embedding, lambda v: abs(v::DOUBLE)) hist FROM embeddings""",
    "review": r"""
SELECT o_custkey::VARCHAR project_id, o_orderkey event_id,
       CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'pending' ELSE 'rejected' END status,
       (['phone','email','person','ssn','credit_card'])[substring(o_orderpriority, 1, 1)::INT] pii_type,
       (o_orderkey % 97)::DOUBLE / 97 confidence,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('T', o_orderkey % 50) END extracted_text,
       ((o_orderkey % 600) * 1000)::INT start_ms,
       ((o_orderkey % 600) * 1000 + (o_orderkey % 7) * 500)::INT end_ms,
       (['blur','pixelate','solid_box'])[(o_orderkey % 3)::INT + 1] style_type, 15 strength, '#000000' color
FROM orders""",
    "batch": r"""
SELECT o_custkey::VARCHAR batch_id, o_orderkey item_id,
       (['done','error','scanning','exporting','queued'])[substring(o_orderpriority, 1, 1)::INT] status,
       (o_orderkey % 101)::INT scan_pct, (o_orderkey * 7 % 101)::INT export_pct,
       (o_orderkey % 13)::INT events_found FROM orders""",
    "metas": r"""
SELECT doc_id, concat('{"streams":[{"codec_type":"audio"},{"codec_type":"video","r_frame_rate":"',
  24000 + 1000 * (doc_id % 7), '/1001","width":', 640 + doc_id * 13 % 1281, ',"height":',
  360 + doc_id * 7 % 721, ',"codec_name":"h264"}],"format":{"duration":"', n_chars,
  '.5","format_name":"mp4"}}') probe FROM documents""",
}


def link_tables(
    source: str, with_cuts: bool = False, gap: int = GAP_MS, reach: int = TOLERANCE_PX
) -> dict[str, str]:
    """The greedy linking rule as recursive SQL; yields `linked` (one row per candidate)."""
    last_cut = (
        "LEFT JOIN LATERAL (SELECT max(cut_ms) last_cut FROM cuts u "
        "WHERE u.video_id = c.video_id AND u.cut_ms < c.time_ms) q ON true"
        if with_cuts else "CROSS JOIN (SELECT NULL::BIGINT last_cut) q"
    )
    return {
        "lk": f"""
SELECT c.*, x + w / 2.0::DOUBLE cx, y + h / 2.0::DOUBLE cy, q.last_cut, lag(time_ms) OVER k p
FROM {source} c {last_cut} WINDOW k AS (PARTITION BY c.video_id, pii_type ORDER BY time_ms, cand_ord)""",
        "li": f"""
SELECT *, sum(CASE WHEN p IS NULL OR time_ms - p > {gap} THEN 1 ELSE 0 END)
  OVER (PARTITION BY video_id, pii_type ORDER BY time_ms, cand_ord) isl FROM lk""",
        "ln": """
SELECT *, row_number() OVER (PARTITION BY video_id, pii_type, isl ORDER BY time_ms, cand_ord) rn FROM li""",
        "lr": f"""
SELECT video_id, pii_type, isl, rn, cand_ord, time_ms seed_ms, cand_ord seed_ord,
       [{{'t0': time_ms, 'o0': cand_ord, 't1': time_ms, 'cx': cx, 'cy': cy}}] st FROM ln WHERE rn = 1
UNION ALL
SELECT video_id, pii_type, isl, rn, cand_ord,
       CASE WHEN m IS NULL OR m = 0 THEN time_ms ELSE st[m].t0 END,
       CASE WHEN m IS NULL OR m = 0 THEN cand_ord ELSE st[m].o0 END,
       CASE WHEN m IS NULL OR m = 0
            THEN list_append(st, {{'t0': time_ms, 'o0': cand_ord, 't1': time_ms, 'cx': cx, 'cy': cy}})
            ELSE list_concat(list_concat(st[1:m-1],
                 [{{'t0': st[m].t0, 'o0': st[m].o0, 't1': time_ms, 'cx': cx, 'cy': cy}}]), st[m+1:]) END
FROM (SELECT n.video_id, n.pii_type, n.isl, n.rn, n.cand_ord, n.time_ms, n.cx, n.cy, r.st,
        list_position(list_transform(r.st, lambda e: n.time_ms - e.t1 <= {gap}
          AND NOT coalesce(n.last_cut > e.t1, false)
          AND sqrt((n.cx - e.cx) * (n.cx - e.cx) + (n.cy - e.cy) * (n.cy - e.cy)) <= {reach}), true) m
      FROM lr r JOIN ln n ON n.video_id = r.video_id AND n.pii_type = r.pii_type AND n.isl = r.isl
                         AND n.rn = r.rn + 1)""",
        "linked": """
SELECT n.video_id, n.pii_type, n.time_ms, n.cand_ord, n.confidence, n.x, n.y, n.w, n.h, n.text,
       r.seed_ms, r.seed_ord,
       sha256(concat_ws(':', n.video_id, n.pii_type, r.seed_ms::VARCHAR, r.seed_ord::VARCHAR)) event_id
FROM ln n JOIN lr r USING (video_id, pii_type, isl, rn)""",
    }


LINKED = link_tables("cands")
SUMMARY = """
SELECT video_id, pii_type, event_id, seed_ms, seed_ord, min(time_ms) start_ms, max(time_ms) end_ms,
       max(confidence) confidence, count(*) n_keyframes, arg_min(text, cand_ord) extracted_text,
       max(w) env_w, max(h) env_h FROM linked GROUP BY ALL"""

_NEEDS = {
    "offsets": ["boxes"], "composites": ["boxes"], "span_texts": ["spans", "composites"],
    "kept": ["span_texts", "entity_map", "limits"], "attributed": ["kept", "offsets"],
    "analyzer": ["kept", "attributed", "boxes"], "linked": ["cands"],
}


def sql(tables: str, body: str, extra: dict[str, str] | None = None) -> str:
    """A statement with the named tables, and what they need, as common table expressions."""
    ctes: dict[str, str] = {}

    def need(name: str) -> None:
        if name in ctes:
            return
        for other in _NEEDS.get(name, []):
            need(other)
        if name == "linked":
            ctes.update(LINKED)
        elif name == "summary":
            need("linked")
            ctes["summary"] = SUMMARY
        else:
            ctes[name] = TABLES[name]

    for name in tables.split():
        need(name)
    ctes.update(extra or {})
    if not ctes:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({q})" for n, q in ctes.items()) + "\n" + body
