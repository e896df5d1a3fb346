"""Independent SQL for the catalogue, in DuckDB's dialect: joins, windows and recursion where the engine folds arrays."""

from __future__ import annotations

from segloom import adapters as A

ORACLES: dict[str, str] = {}
_WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _norm(x: str) -> str:
    return f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def _lines(source: str, key: str) -> str:
    """CTEs src, l: lines with their places from 0 and whether they are blank."""
    return f"""{source}, ll AS (SELECT {key}, string_split({_norm('source')}, chr(10)) AS a FROM src),
    l AS (SELECT {key}, unnest(a) AS line, generate_subscripts(a, 1)::BIGINT - 1 AS i FROM ll), lb AS (SELECT *, {_trim('line')} AS bare, {_trim('line')} = '' AS blank FROM l)"""


_TXT = f"src AS (SELECT doc_id, {A.TXT} AS source FROM documents)"
_BLOCKS = f"{_lines(_TXT, 'doc_id')}, blk AS (SELECT doc_id, i AS block_idx, CASE WHEN blank OR bare[1] = '[' THEN 'pass' ELSE 'text' END AS kind, line AS text FROM lb)"
_SEGS = f"{_BLOCKS}, seg AS (SELECT doc_id, block_idx AS seg_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) - 1 AS ord, text, strlen(text) AS b FROM blk WHERE kind = 'text')"
_UNIT = f"{_SEGS}, unit AS (SELECT doc_id, (ord // 25)::BIGINT AS unit_idx, count(*) AS n, min(seg_id) AS first_id, min(ord) AS o, sum(b) AS bytes, list(text ORDER BY ord) AS cues FROM seg GROUP BY 1, 2), ctx AS (SELECT u.doc_id, u.unit_idx, count(s.ord) AS n_context, coalesce(sum(s.b), 0) AS bytes, coalesce(string_agg(s.text, chr(10) ORDER BY s.ord), '') AS nl, coalesce(string_agg(s.text, '|' ORDER BY s.ord), '') AS bar FROM unit u LEFT JOIN seg s ON s.doc_id = u.doc_id AND s.ord < u.o AND s.ord >= u.o - 5 GROUP BY 1, 2)"


def _subtitle(format_: str) -> str:
    piece = A.PIECES["srt" if format_ == "vtt" else format_].replace("\\\\", "\\")
    sep = " || ".join("chr(10)" for _ in A.SEPARATORS[format_])
    return f"raw AS (SELECT conv_id, {A.HEADS[format_]} || string_agg({piece}, {sep} ORDER BY turn) AS t FROM conversations GROUP BY conv_id), src AS (SELECT conv_id, CASE WHEN conv_id % 3 = 1 THEN replace(t, chr(10), chr(13) || chr(10)) ELSE t END AS source FROM raw)"


def _timed(format_: str) -> str:
    return f"""{_lines(_subtitle(format_), 'conv_id')}, g AS (SELECT *, sum(blank::INT) OVER (PARTITION BY conv_id ORDER BY i) AS g FROM lb), c AS (SELECT conv_id, g, list(line ORDER BY i) AS ls FROM g WHERE NOT blank GROUP BY 1, 2),
    p AS (SELECT *, list_position([contains(x, '-->') for x in ls], true) AS p FROM c),
    blk AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY g) - 1 AS block_idx, CASE WHEN p > 0 THEN 'text' ELSE 'pass' END AS kind, CASE WHEN p > 0 THEN array_to_string(ls[1:p], chr(10)) ELSE array_to_string(ls, chr(10)) END AS framing, CASE WHEN p > 0 THEN array_to_string(ls[p + 1:], chr(10)) ELSE '' END AS text FROM p)"""


_LRC = rf"""{_lines(_subtitle('lrc'), 'conv_id')}, m AS (SELECT conv_id, i, line, regexp_extract(line, '^(\[[0-9]+:[^\]]*\])+') AS tags FROM lb),
    blk AS (SELECT conv_id, i AS block_idx, CASE WHEN tags <> '' THEN 'text' ELSE 'pass' END AS kind, CASE WHEN tags <> '' THEN tags ELSE line END AS framing, CASE WHEN tags <> '' THEN substr(line, length(tags) + 1) ELSE '' END AS text FROM m)"""
_ASS = rf"""{_lines(_subtitle('ass'), 'conv_id')}, s AS (SELECT *, last_value(CASE WHEN bare[1] = '[' AND bare[-1] = ']' THEN lower(bare) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY i) AS sec FROM lb),
    f AS (SELECT *, CASE WHEN sec = '[events]' AND starts_with(bare, 'Format:') THEN [lower({_trim('x')}) for x in string_split(substr(bare, 8), ',')] END AS names FROM s),
    n AS (SELECT *, last_value(CASE WHEN names IS NOT NULL THEN CASE WHEN list_contains(names, 'text') THEN len(names) - list_position(list_reverse(names), 'text') ELSE len(names) - 1 END END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY i) AS k FROM f),
    d AS (SELECT *, sec = '[events]' AND starts_with(line, 'Dialogue:') AS cue, string_split(substr(line, 10), ',') AS parts, coalesce(k, 9) AS kk FROM n),
    h AS (SELECT *, CASE WHEN len(parts) > kk THEN array_to_string(parts[1:kk], ',') || CASE WHEN kk > 0 THEN ',' ELSE '' END ELSE substr(line, 10) END AS head, CASE WHEN len(parts) > kk THEN array_to_string(parts[kk + 1:], ',') ELSE '' END AS rest FROM d),
    t AS (SELECT *, regexp_extract(rest, '^(\{{[^}}]*\}})+') AS lead FROM h),
    blk AS (SELECT conv_id, i AS block_idx, CASE WHEN cue THEN 'text' ELSE 'pass' END AS kind, CASE WHEN cue THEN 'Dialogue:' || head || lead ELSE line END AS framing, CASE WHEN cue THEN substr(rest, length(lead) + 1) ELSE '' END AS text FROM t)"""
#: States: n normal, f front matter, ` and ~ fences. A block's number grows where one begins.
_MD = rf"""{_lines(_subtitle('md'), 'conv_id')}, w AS (SELECT conv_id, i, line, bare, blank,
      CASE WHEN starts_with(bare, '```') THEN '`' WHEN starts_with(bare, '~~~') THEN '~' ELSE '' END AS fence FROM lb),
    m AS (SELECT conv_id, i, line, bare, CASE WHEN i = 0 AND bare IN ('---', '+++') THEN 'f' WHEN fence <> '' THEN fence WHEN blank THEN 'b' ELSE 't' END AS part, CASE WHEN i = 0 AND bare IN ('---', '+++') THEN bare WHEN fence <> '' THEN fence ELSE '' END AS open, 1::BIGINT AS g FROM w WHERE i = 0
      UNION ALL SELECT w.conv_id, w.i, w.line, w.bare,
        CASE WHEN m.open <> '' THEN 'h' WHEN w.fence <> '' THEN w.fence WHEN w.blank THEN 'b' ELSE 't' END,
        CASE WHEN m.open IN ('---', '+++') THEN CASE WHEN w.bare = m.open THEN '' ELSE m.open END WHEN m.open <> '' THEN CASE WHEN w.fence = m.open THEN '' ELSE m.open END ELSE w.fence END,
        m.g + CASE WHEN m.open <> '' THEN 0 WHEN w.fence = '' AND NOT w.blank AND m.part = 't' THEN 0 ELSE 1 END
      FROM m JOIN w ON w.conv_id = m.conv_id AND w.i = m.i + 1),
    q AS (SELECT conv_id, g, min(part) FILTER (WHERE part <> 'h') AS part, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS text, max(bare) AS bare FROM m GROUP BY 1, 2),
    blk AS (SELECT conv_id, g - 1 AS block_idx, CASE WHEN part = 't' AND NOT (n = 1 AND (regexp_matches(bare, '^ *(- *){{3,}}$|^ *(\* *){{3,}}$|^ *(_ *){{3,}}$') OR (bare[1] = '[' AND contains(bare, ']:')))) THEN 'text' ELSE 'pass' END AS kind, CASE WHEN part = 'b' THEN '' ELSE text END AS text FROM q)"""

P = f"p AS (SELECT p_partkey, p_size, {A.PATH} AS path FROM part), q AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM p), e AS (SELECT *, CASE WHEN strpos(substr(name, 2), '.') > 0 THEN regexp_extract(name, '[^.]*$') END AS ext, CASE WHEN strpos(substr(name, 2), '.') > 0 THEN regexp_replace(name, '\\.[^.]*$', '') ELSE name END AS stem FROM q), fm AS (SELECT *, CASE WHEN lower(ext) IN ('epub', 'srt', 'vtt', 'ass', 'lrc', 'txt', 'md', 'docx') THEN lower(ext) WHEN lower(ext) = 'ssa' THEN 'ass' WHEN lower(ext) = 'markdown' THEN 'md' END AS format, ends_with(stem, '.bilingual') OR ends_with(stem, '.translated') AS generated FROM e)"


def _out(mode: str) -> str:
    return f"regexp_replace(path, '[^/]*$', '') || stem || CASE WHEN {mode} THEN '.translated' ELSE '.bilingual' END || coalesce('.' || ext, '')"


ORACLES["format_detect"] = f"WITH {P} SELECT path, format FROM fm"
ORACLES["generated_outputs"] = f"WITH {P} SELECT path, generated FROM fm"
ORACLES["output_paths"] = f"WITH {P} SELECT path, {_out('p_partkey % 2 = 0')} AS suffixed, CASE WHEN p_partkey % 5 = 0 THEN path WHEN p_partkey % 3 = 0 THEN 'given.txt' ELSE {_out('p_partkey % 2 = 0')} END AS resolved FROM fm"
ORACLES["path_order"] = f"WITH {P} SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS place FROM fm"
ORACLES["archive_paths"] = r"""WITH RECURSIVE h AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '../img/' WHEN 1 THEN './a//' WHEN 2 THEN 'x\\y/' WHEN 3 THEN '../../../' ELSE '' END || p_partkey::VARCHAR AS href FROM part),
  s AS (SELECT *, string_split(replace(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'OEBPS/text/' END || href, '\', '/'), '/') AS parts FROM h),
  w AS (SELECT p_partkey, parts, 0 AS k, []::VARCHAR[] AS acc FROM s UNION ALL SELECT p_partkey, parts, k + 1, CASE WHEN parts[k + 1] IN ('', '.') THEN acc WHEN parts[k + 1] = '..' THEN acc[1:len(acc) - 1] ELSE list_append(acc, parts[k + 1]) END FROM w WHERE k < len(parts))
  SELECT p_partkey, array_to_string(acc, '/') AS joined, NOT (href LIKE '/%' OR '/' || href || '/' LIKE '%/../%') AS safe, array_to_string([x for x in string_split(replace(href, '\', '/'), '/') if x NOT IN ('', '.', '..')], '/') AS api FROM w JOIN h USING (p_partkey) WHERE k = len(parts)"""
_LIST = f"WITH {P} SELECT name, path, 'file' AS kind, format IS NOT NULL AS supported, p_size::BIGINT AS size FROM fm"
ORACLES["listing"] = f"{_LIST} WHERE path LIKE 'd1/%'"
ORACLES["folder_filter"] = f"WITH {P} SELECT name, 'file' AS kind, format IS NOT NULL AS supported FROM fm WHERE path LIKE 'd2/%' AND contains(lower(name || ' ' || path), '1')"

ORACLES["txt_blocks"] = f"WITH {_BLOCKS} SELECT * FROM blk"
ORACLES["txt_segments"] = f"WITH {_SEGS} SELECT doc_id, seg_id, ord, text FROM seg"
ORACLES["txt_stats"] = f"WITH {_BLOCKS} SELECT doc_id, count(*) AS n_blocks, count(*) FILTER (WHERE kind = 'text') AS n_segments FROM blk GROUP BY 1"
ORACLES["srt_cues"] = f"WITH {_timed('srt')} SELECT * FROM blk"
ORACLES["vtt_cues"] = f"WITH {_timed('vtt')} SELECT * FROM blk"
ORACLES["lrc_cues"] = f"WITH {_LRC} SELECT * FROM blk"
ORACLES["ass_cues"] = f"WITH {_ASS} SELECT * FROM blk"
ORACLES["md_blocks"] = f"WITH RECURSIVE {_MD} SELECT * FROM blk"
_strip = "html"
_strip = f"regexp_replace({_strip}, '(?s)<!--.*?-->', '', 'g')"
for _t in ("head", "title", "script", "style", "pre", "code", "nav", "textarea", "svg"):
    _strip = rf"regexp_replace({_strip}, '(?is)<{_t}\b[^>]*>.*?</{_t}\s*>', '', 'g')"
_HTML = rf"""t AS (SELECT page_id, regexp_extract_all({_strip}, '<[^>]*>|[^<]+') AS a FROM pages), k AS (SELECT page_id, unnest(a) AS tok, generate_subscripts(a, 1) AS i FROM t),
  g AS (SELECT *, lower(regexp_extract(tok, '(?i)^<(/?(?:p|h1|h2|h3|h4|h5|h6|li|blockquote|figcaption|dt|dd))(?:[\s>/]|$)', 1)) AS tag FROM k), s AS (SELECT *, sum((tag <> '')::INT) OVER (PARTITION BY page_id ORDER BY i) AS seg FROM g),
  x AS (SELECT page_id, seg, max(tag) AS tag, coalesce(string_agg(tok, '' ORDER BY i) FILTER (WHERE tok[1] <> '<'), '') AS text FROM s GROUP BY 1, 2), y AS (SELECT *, lead(tag) OVER (PARTITION BY page_id ORDER BY seg) AS nxt FROM x),
  leaf AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY seg) - 1 AS leaf_idx, tag, text FROM y WHERE tag <> '' AND nxt = '/' || tag AND {_trim('text')} <> '')"""
ORACLES["html_leaf_blocks"] = f"WITH {_HTML} SELECT * FROM leaf"
ORACLES["html_apply"] = f"""WITH {_HTML}, w AS (SELECT page_id, leaf_idx, CASE WHEN tag IN ('li', 'dt', 'dd') THEN tag ELSE 'p' END AS t, replace(replace(replace('<t> & ' || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS x FROM leaf)
  SELECT pages.page_id, coalesce(string_agg('<' || t || ' class="hy-zh">' || x || '</' || t || '>', chr(10) ORDER BY leaf_idx), '') AS inserted FROM pages LEFT JOIN w USING (page_id) GROUP BY 1"""

ORACLES["units_independent"] = f"WITH {_SEGS} SELECT doc_id, ord AS unit_idx, seg_id FROM seg"
ORACLES["units_batched"] = f"WITH {_UNIT} SELECT doc_id, unit_idx, first_id, n, (512 + c.bytes + u.bytes + 16 * n)::BIGINT AS prompt_size FROM unit u JOIN ctx c USING (doc_id, unit_idx)"
ORACLES["units_greedy"] = f"""WITH RECURSIVE {_SEGS}, s AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS cb FROM seg),
  r AS (SELECT doc_id, ord, seg_id, (512 + cb + b + 16)::BIGINT AS c, 1::BIGINT AS n, 0::BIGINT AS u FROM s WHERE ord = 0 UNION ALL
    SELECT s.doc_id, s.ord, s.seg_id, CASE WHEN r.n >= 25 OR r.c + s.b + 16 > 1500 THEN 512 + s.cb + s.b + 16 ELSE r.c + s.b + 16 END, CASE WHEN r.n >= 25 OR r.c + s.b + 16 > 1500 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n >= 25 OR r.c + s.b + 16 > 1500 THEN r.u + 1 ELSE r.u END FROM r JOIN s ON s.doc_id = r.doc_id AND s.ord = r.ord + 1)
  SELECT doc_id, u AS unit_idx, min(seg_id) AS first_id, count(*) AS n FROM r GROUP BY 1, 2"""
_greedy = ORACLES["units_greedy"]
ORACLES["units_limited_greedy"] = _greedy[: _greedy.rindex("SELECT doc_id, u AS")].rstrip() + """, g AS (SELECT doc_id, u, min(ord) AS o, min(seg_id) AS first_id, count(*) AS n FROM r GROUP BY 1, 2), z AS (SELECT doc_id, count(*) AS len FROM seg GROUP BY 1),
  h AS (SELECT g.*, coalesce(sum(least(25, len - o)) OVER (ORDER BY g.doc_id, u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS charged FROM g JOIN z USING (doc_id))
  SELECT doc_id, u AS unit_idx, first_id, least(n, 1000 - charged)::BIGINT AS n FROM h WHERE charged < 1000"""
ORACLES["units_limited"] = f"WITH {_SEGS}, k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS o FROM (SELECT *, row_number() OVER (ORDER BY doc_id, ord) AS r FROM seg) WHERE r <= 1000) SELECT doc_id, (o // 25)::BIGINT AS unit_idx, count(*) AS n FROM k GROUP BY 1, 2"
ORACLES["context_windows"] = f"WITH {_UNIT} SELECT doc_id, unit_idx, n_context, bar AS context FROM ctx"


def _runs(x: str, key: str, source: str) -> str:
    """CTE clean: characters beyond the eighth of a run dropped."""
    return f"""chars AS (SELECT {key}, unnest(string_split({x}, '')) AS ch, generate_subscripts(string_split({x}, ''), 1) AS p FROM {source}), isl AS (SELECT *, p - row_number() OVER (PARTITION BY {key}, ch ORDER BY p) AS g FROM chars),
    runs AS (SELECT *, row_number() OVER (PARTITION BY {key}, ch, g ORDER BY p) AS k FROM isl), clean AS (SELECT {key}, string_agg(ch, '' ORDER BY p) AS clean FROM runs WHERE k <= 8 GROUP BY ALL)"""


ORACLES["batch_prompts"] = f"""WITH {_UNIT}, {_runs('text', 'doc_id, ord', 'seg')}, tag AS (SELECT doc_id, (ord // 25)::BIGINT AS unit_idx, string_agg('<c' || (ord % 25 + 1) || '>' || clean || '</c' || (ord % 25 + 1) || '>', chr(10) ORDER BY ord) AS body FROM clean GROUP BY 1, 2)
  SELECT doc_id, unit_idx, sha256('Please accurately translate the following text into French. You must retain the exact same number of <cN></cN> delimiters in the translation, in the same order. Strictly do not omit, escape, or translate these delimiters. Translate only the text between them; do not merge, split, add, or skip any.' || chr(10) || chr(10) ||
    CASE WHEN n_context > 0 THEN 'The lines below under ''Context'' are for context only — do NOT translate or wrap them in tags:' || chr(10) || chr(10) || 'Context:' || chr(10) || nl || chr(10) || chr(10) ELSE '' END || body) AS prompt_sha FROM tag JOIN ctx USING (doc_id, unit_idx)"""
ORACLES["single_prompts"] = f"WITH {_SEGS} SELECT doc_id, seg_id, sha256('Translate the following text into French. Note that you should only output the translated result without any additional explanation:' || chr(10) || chr(10) || {_trim('text')}) AS prompt_sha FROM seg"
ORACLES["chat_requests"] = f"SELECT item_id, '7b-fp8' AS model, 'Translate the following text into French. Note that you should only output the translated result without any additional explanation:' || chr(10) || chr(10) || {_trim('text')} AS content, 0.7::DOUBLE AS temperature, 20::BIGINT AS top_k, true AS unbounded, CASE WHEN item_id % 5 > 1 THEN text END AS answer FROM benchmark"
ORACLES["sanitize_text"] = f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN repeat('é', doc_id % 40) || text || '!!!!!!!!!!!!' ELSE text || repeat(chr(10), doc_id % 12) END AS x FROM documents), {_runs('x', 'doc_id', 't')} SELECT doc_id, clean FROM clean"""
_cut = lambda n: f"CASE WHEN strlen(t) <= {n} THEN t ELSE (SELECT coalesce(string_agg(ch, '' ORDER BY p), '') FROM c WHERE c.doc_id = d.doc_id AND c.e <= {n}) || '…' END AS at_{n}"
ORACLES["truncate_bytes"] = f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN repeat('日a🙂', 30) || text ELSE text END AS t FROM documents), x AS (SELECT doc_id, unnest(string_split(left(t, 130), '')) AS ch, generate_subscripts(string_split(left(t, 130), ''), 1) AS p FROM d),
  c AS (SELECT *, sum(strlen(ch)) OVER (PARTITION BY doc_id ORDER BY p) AS e FROM x) SELECT doc_id, {', '.join(_cut(n) for n in (20, 21, 22, 23, 120))} FROM d"""
_B = "[ \\t\\n\\r.!?;:,，。！？；：、]"
ORACLES["boundary_split"] = rf"""WITH d AS (SELECT doc_id, text AS t FROM documents), x AS (SELECT doc_id, t, unnest(string_split(t, '')) AS ch, generate_subscripts(string_split(t, ''), 1) - 1 AS i FROM d),
  m AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY abs(i - length(t) // 2), i) AS k FROM x WHERE regexp_matches(ch, '{_B}')), n AS (SELECT doc_id, i FROM m WHERE k = 1),
  c AS (SELECT d.doc_id, t, i + length(regexp_extract(substr(t, (i + 1)::INT), '^{_B}+')) AS cut FROM d LEFT JOIN n USING (doc_id))
  SELECT doc_id, CASE WHEN {_trim('left(t, cut)')} <> '' AND {_trim('substr(t, cut + 1)')} <> '' THEN left(t, cut) END AS "left", CASE WHEN {_trim('left(t, cut)')} <> '' AND {_trim('substr(t, cut + 1)')} <> '' THEN substr(t, cut + 1) END AS "right" FROM c"""

_KEY = "sha256('7b-fp8' || chr(31) || 'French' || chr(31) || text)"
_CACHE = f"{_SEGS}, kd AS (SELECT doc_id, seg_id, text, {_KEY} AS key FROM seg), tab AS (SELECT {_KEY} AS key, 'T:' || text AS value FROM (SELECT text FROM seg WHERE doc_id % 3 = 0 UNION SELECT text FROM benchmark))"
ORACLES["cache_keys"] = f"WITH {_CACHE} SELECT doc_id, seg_id, key, left(key, 2) || '/' || substr(key, 3) AS path FROM kd"
ORACLES["cache_hits"] = f"WITH {_CACHE} SELECT doc_id, seg_id, value FROM kd JOIN tab USING (key)"
ORACLES["cache_misses"] = f"WITH {_CACHE} SELECT doc_id, seg_id FROM kd WHERE key NOT IN (SELECT key FROM tab)"
ORACLES["cache_put"] = f"WITH {_CACHE}, u AS (SELECT key, max('N:' || text) AS v FROM kd WHERE doc_id % 3 = 1 GROUP BY 1), a AS (SELECT coalesce(u.key, tab.key) AS key, coalesce(v, value) AS value FROM tab FULL JOIN u ON u.key = tab.key) SELECT left(key, 2) AS shard, count(*) AS n, count(*) FILTER (WHERE value LIKE 'N:%') AS new FROM a GROUP BY 1"
ORACLES["segment_dedup"] = f"WITH {_CACHE} SELECT key, count(*) AS n, min(doc_id) AS first_doc FROM kd GROUP BY 1"

ORACLES["parse_tagged"] = rf"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS x, (turn + 1)::VARCHAR AS k FROM conversations), n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1),
  g AS (SELECT t.*, n, CASE WHEN turn % 4 = 1 OR turn % 7 = 6 AND NOT turn % 6 = 3 AND NOT turn % 5 = 2 THEN NULL WHEN turn % 6 = 3 THEN {_trim("x")} WHEN turn % 5 = 2 THEN 'a' ELSE {_trim('x')} END AS text FROM t JOIN n USING (conv_id) WHERE turn < n)
  SELECT conv_id, sum((text IS NULL)::INT) OVER (PARTITION BY conv_id)::BIGINT AS missing, turn::BIGINT AS pos, text FROM g"""
ORACLES["best_attempt"] = "WITH a AS (SELECT DISTINCT conv_id, attempt, (conv_id * 7 + attempt * 3) % 5 AS n FROM conversations, range(4) r(attempt)), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, attempt) AS k FROM a) SELECT conv_id, attempt::BIGINT AS attempt, n::BIGINT AS n FROM k WHERE k = 1"
ORACLES["split_plan"] = "WITH RECURSIVE s AS (SELECT conv_id, (1 + (count(*) * 7 + conv_id) % 60)::BIGINT AS n FROM conversations GROUP BY 1), r AS (SELECT conv_id, '' AS path, 0::BIGINT AS first, n AS size FROM s UNION ALL SELECT conv_id, path || h, CASE WHEN h = 'L' THEN first ELSE first + size // 2 END, CASE WHEN h = 'L' THEN size // 2 ELSE size - size // 2 END FROM r, (VALUES ('L'), ('R')) v(h) WHERE size > 1) SELECT * FROM r"
ORACLES["error_classes"] = """WITH e AS (SELECT event_id, 200 + event_id % 400 AS s, CASE event_type WHEN 'view' THEN 'This Model''s Maximum Context length is 8' WHEN 'click' THEN 'reduce the INPUT prompt' WHEN 'error' THEN 'Token limit' ELSE props END AS x, event_id % 6 AS a FROM events)
  SELECT event_id, CASE WHEN s < 300 THEN 'success' WHEN s >= 400 AND s < 500 AND s <> 429 THEN 'fatal' ELSE 'transient' END AS request, CASE WHEN s < 300 THEN 'ok' WHEN s >= 500 OR s IN (408, 429) THEN 'retry' ELSE 'fatal' END AS acquire,
    lower(x) LIKE '%context length%' OR lower(x) LIKE '%input prompt%' OR lower(x) LIKE '%context window%' OR lower(x) LIKE '%token limit%' OR lower(x) LIKE '%maximum context%' AS overflow, least(30000, greatest(500 * (1 << a::INT), CASE WHEN event_id % 3 = 0 THEN event_id % 50000 ELSE 0 END))::BIGINT AS backoff_ms FROM e"""

_E2E = f"{_SEGS}, tr AS (SELECT doc_id, seg_id, 'translated ' || (ord % 25 + 1) AS tr FROM seg)"
_BI = "string_agg(text || CASE WHEN tr IS NULL THEN '' ELSE chr(10) || tr END, chr(10) ORDER BY block_idx)"
ORACLES["translate_fake_e2e"] = f"WITH {_E2E} SELECT doc_id, count(tr) AS n_segments, ((count(tr) + 24) // 25)::BIGINT AS n_units, count(tr) AS n_translated, sha256({_BI}) AS rendered_sha FROM blk LEFT JOIN tr ON tr.doc_id = blk.doc_id AND seg_id = block_idx GROUP BY blk.doc_id".replace("SELECT doc_id, count", "SELECT blk.doc_id, count")
ORACLES["translate_cached_e2e"] = f"""WITH {_SEGS}, tab AS (SELECT text FROM seg WHERE doc_id % 3 = 0 UNION SELECT text FROM benchmark), both_ AS (SELECT seg.*, tab.text IS NOT NULL AS hit FROM seg LEFT JOIN tab ON tab.text = seg.text),
  tr AS (SELECT doc_id, seg_id, hit, CASE WHEN hit THEN 'T:' || text ELSE 'translated ' || ((row_number() OVER (PARTITION BY doc_id, hit ORDER BY seg_id) - 1) % 25 + 1) END AS tr FROM both_)
  SELECT blk.doc_id, sha256({_BI}) AS rendered_sha, count(tr) AS n_segments, count(*) FILTER (WHERE hit) AS n_hits, count(*) FILTER (WHERE NOT hit) AS n_translated FROM blk LEFT JOIN tr ON tr.doc_id = blk.doc_id AND seg_id = block_idx GROUP BY 1"""
ORACLES["render_txt_bilingual"] = f"WITH {_E2E} SELECT blk.doc_id, {_BI} AS output FROM blk LEFT JOIN tr ON tr.doc_id = blk.doc_id AND seg_id = block_idx GROUP BY 1"
ORACLES["render_txt_replace"] = f"WITH {_E2E} SELECT blk.doc_id, string_agg(coalesce(tr, text), chr(10) ORDER BY block_idx) AS output FROM blk LEFT JOIN tr ON tr.doc_id = blk.doc_id AND seg_id = block_idx GROUP BY 1"


def _render(blocks: str, part: str, sep: str, tail: str, rec: str = "") -> str:
    return f"""WITH {rec}{blocks}, sg AS (SELECT conv_id, block_idx, text, row_number() OVER (PARTITION BY conv_id ORDER BY block_idx) - 1 AS ord FROM blk WHERE kind = 'text' AND {_trim('text')} <> ''),
    tr AS (SELECT conv_id, block_idx, 'T' || chr(10) || left(text, 20) AS tr FROM sg WHERE ord % 3 <> 2) SELECT blk.conv_id, string_agg({part}, {sep} ORDER BY blk.block_idx){tail} AS output FROM blk LEFT JOIN tr USING (conv_id, block_idx) GROUP BY 1"""


_own = "CASE WHEN text = '' THEN framing ELSE framing || chr(10) || text END"
ORACLES["render_srt"] = _render(_timed("srt"), f"CASE WHEN kind = 'pass' THEN framing WHEN tr IS NULL THEN {_own} ELSE framing || chr(10) || text || chr(10) || tr END", "chr(10) || chr(10)", " || chr(10)")
ORACLES["render_vtt"] = _render(_timed("vtt"), f"CASE WHEN kind = 'pass' THEN framing WHEN tr IS NULL THEN {_own} ELSE framing || chr(10) || tr END", "chr(10) || chr(10)", " || chr(10)")
ORACLES["render_lrc"] = _render(_LRC, "CASE WHEN kind = 'pass' THEN framing WHEN tr IS NULL THEN framing || text ELSE framing || text || chr(10) || framing || replace(tr, chr(10), ' ') END", "chr(10)", "")
ORACLES["render_ass"] = _render(_ASS, r"CASE WHEN kind = 'pass' THEN framing WHEN tr IS NULL THEN framing || text ELSE framing || text || '\N' || replace(tr, chr(10), '\N') END", "chr(10)", " || chr(10)")
ORACLES["render_md"] = _render(_MD, "CASE WHEN kind = 'pass' OR tr IS NULL THEN text ELSE text || chr(10) || chr(10) || tr END", "chr(10)", "", "RECURSIVE ")
_DONE = f"{_UNIT}, dn AS (SELECT doc_id, n AS attempted, CASE WHEN doc_id % 13 = 0 AND unit_idx % 2 = 1 THEN 0 ELSE n END AS done FROM unit)"
ORACLES["run_summary"] = f"WITH {_DONE} SELECT sum(attempted)::BIGINT AS total, sum(attempted)::BIGINT AS completed, sum(done)::BIGINT AS translated, (sum(attempted) - sum(done))::BIGINT AS failed FROM dn"
ORACLES["file_outcomes"] = f"WITH {_DONE} SELECT doc_id, sum(attempted)::BIGINT AS attempted, sum(done)::BIGINT AS translated, CASE WHEN doc_id % 11 = 0 THEN 'write failed' END AS error, doc_id % 11 <> 0 AS ok FROM dn GROUP BY 1"

_J, _RUN, _ACT, _END = f"WITH {A.JOBS_SQL}", "('starting_model', 'translating', 'writing')", "('queued', 'starting_model', 'translating', 'writing')", "('completed', 'failed', 'cancelled')"
_own = lambda k: f"owner = substr(sha256('{k}'), 1, 32)"
_cols = "id, owner, status, created_at, updated_at"
ORACLES["jobs_page"] = f"{_J}, a AS (SELECT *, 1 AS page FROM jobs WHERE {_own(605)} ORDER BY created_at DESC, id DESC LIMIT 4), b AS (SELECT *, 2 AS page FROM jobs WHERE {_own(605)} AND (created_at, id) < (870000000, '000000007000') ORDER BY created_at DESC, id DESC LIMIT 6) SELECT id, created_at, page, created_at || ':' || id AS cursor FROM (FROM a UNION ALL FROM b)"
ORACLES["jobs_page_phase"] = f"{_J} SELECT {_cols} FROM jobs WHERE {_own(1242)} AND status IN {_RUN} ORDER BY created_at DESC, id DESC LIMIT 101"
ORACLES["jobs_active"] = f"{_J} SELECT {_cols} FROM jobs WHERE {_own(1378)} AND status IN {_ACT}"
ORACLES["jobs_active_counts"] = f"{_J} SELECT owner, count(*) FILTER (WHERE status IN {_ACT}) AS active, count(*) AS total, count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status IN {_RUN}) AS in_progress, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed FROM jobs GROUP BY 1"
ORACLES["jobs_recover"] = f"{_J} SELECT id, owner, 'queued' AS status, created_at, CASE WHEN status = 'queued' THEN updated_at ELSE {A.NOW} END::BIGINT AS updated_at FROM jobs WHERE status IN {_ACT}"
_hit = "status = 'queued' AND id::BIGINT % 3 = 0"
ORACLES["jobs_claim"] = f"{_J} SELECT id, owner, CASE WHEN {_hit} THEN 'starting_model' ELSE status END AS status, created_at, CASE WHEN {_hit} THEN {A.NOW} ELSE updated_at END::BIGINT AS updated_at, CASE WHEN {_hit} THEN NULL ELSE error END AS error FROM jobs"
_busy = f"busy AS (SELECT owner, count(*) AS busy FROM jobs WHERE status IN {_ACT} GROUP BY 1)"
#: Requests and new jobs one after the other: a recursion whose step is a turn of every owner, with the active jobs counted so far.
_turns = lambda asked, limit: f"""a AS ({asked}), t AS (SELECT a.*, row_number() OVER (PARTITION BY a.owner ORDER BY since, id) AS turn FROM a),
  walk(owner, id, turn, n, ok) AS (SELECT t.owner, id, turn, coalesce(busy, 0) + CASE WHEN coalesce(busy, 0) < {limit} THEN 1 ELSE 0 END, coalesce(busy, 0) < {limit} FROM t LEFT JOIN busy USING (owner) WHERE turn = 1
    UNION ALL SELECT t.owner, t.id, t.turn, n + CASE WHEN n < {limit} THEN 1 ELSE 0 END, n < {limit} FROM walk JOIN t ON t.owner = walk.owner AND t.turn = walk.turn + 1)"""  # noqa: E731
_JR = _J.replace("WITH ", "WITH RECURSIVE ", 1)
ORACLES["jobs_retry"] = f"""{_JR}, {_busy}, r AS (SELECT owner, CASE WHEN id::BIGINT % 10 = 3 THEN id || 'x' ELSE id END AS id FROM jobs WHERE id::BIGINT % 10 < 6), {_turns("SELECT r.owner, r.id, 0 AS since FROM r JOIN jobs USING (id) WHERE status = 'failed'", 7)}
  SELECT r.owner, r.id, CASE WHEN j.id IS NULL THEN 'not_found' WHEN j.status <> 'failed' THEN 'not_failed' WHEN ok THEN 'retried' ELSE 'at_limit' END AS outcome FROM r LEFT JOIN jobs j ON j.owner = r.owner AND j.id = r.id LEFT JOIN walk w ON w.id = r.id"""
_again = "coalesce(ok, false)"
ORACLES["jobs_retried"] = f"""{_JR}, {_busy}, {_turns("SELECT owner, id, 0 AS since FROM jobs WHERE status = 'failed' AND id::BIGINT % 2 = 1", 9)}, x AS (SELECT jobs.*, {_again} AS g FROM jobs LEFT JOIN (SELECT id, ok FROM walk) USING (id)) SELECT id, owner, CASE WHEN g THEN 'queued' ELSE status END AS status, CASE WHEN g THEN {A.NOW} ELSE created_at END::BIGINT AS created_at, CASE WHEN g THEN {A.NOW} ELSE updated_at END::BIGINT AS updated_at,
  {', '.join(f'CASE WHEN g THEN 0 ELSE {c} END::BIGINT AS {c}' for c in ('total', 'completed', 'translated', 'failed_segments'))}, CASE WHEN g THEN NULL ELSE error END AS error, result_available AND NOT g AS result_available FROM x"""
ORACLES["jobs_expired"] = f"{_J} SELECT {_cols} FROM jobs WHERE status IN {_END} AND updated_at < 900000000 ORDER BY updated_at, id LIMIT 500"
ORACLES["jobs_delete"] = f"{_J} SELECT {_cols} FROM jobs WHERE NOT (id::BIGINT % 4 = 1 AND status IN {_END})"
ORACLES["jobs_insert"] = f"""{_JR}, {_busy}, {_turns("SELECT owner, 'n' || id AS id, created_at AS since FROM jobs WHERE id::BIGINT % 5 = 0", 9)}, w AS (SELECT owner, count(*) FILTER (WHERE ok) AS more FROM walk GROUP BY 1)
  SELECT owner, count(*) + coalesce(any_value(more), 0) AS n, coalesce(any_value(more), 0) AS new FROM jobs LEFT JOIN w USING (owner) GROUP BY owner"""
ORACLES["jobs_cancel"] = f"{_J}, r AS (SELECT owner, CASE WHEN id::BIGINT % 10 = 3 THEN id || 'x' ELSE id END AS id FROM jobs WHERE id::BIGINT % 10 < 6) SELECT r.owner, r.id, CASE WHEN j.id IS NULL THEN 'not_found' WHEN j.status IN {_END} THEN 'already_terminal' ELSE 'cancelled' END AS outcome FROM r LEFT JOIN jobs j ON j.id = r.id"
ORACLES["jobs_cancelled"] = f"{_J} SELECT id, owner, CASE WHEN status IN {_ACT} AND id::BIGINT % 2 = 1 THEN 'cancelled' ELSE status END AS status, created_at, CASE WHEN status IN {_ACT} AND id::BIGINT % 2 = 1 THEN {A.NOW} ELSE updated_at END::BIGINT AS updated_at, CASE WHEN status IN {_ACT} AND id::BIGINT % 2 = 1 THEN NULL ELSE error END AS error FROM jobs"
ORACLES["jobs_upsert"] = f"{_J} SELECT id, owner, CASE WHEN id::BIGINT % 3 = 0 THEN 'writing' ELSE status END AS status, created_at, updated_at FROM jobs UNION ALL SELECT 'new', 'me', 'queued', 1, 1"
ORACLES["jobs_page_info"] = f"""{_J}, o AS (SELECT owner AS first FROM jobs ORDER BY owner LIMIT 1), p AS (SELECT id, created_at, row_number() OVER (ORDER BY created_at DESC, id DESC) AS k, count(*) OVER () AS total FROM jobs, o WHERE owner = first)
  SELECT string_agg(id, ',' ORDER BY k) FILTER (WHERE k <= 3) AS ids, count(*) > 3 AS has_more, max(CASE WHEN k = 3 AND total > 3 THEN created_at || ':' || id END) AS next_cursor, count(*) AS total FROM p"""
ORACLES["jobs_cursor"] = f"{_J} SELECT id, CASE WHEN id::BIGINT % 3 > 0 THEN created_at END AS cursor_at, CASE WHEN id::BIGINT % 3 > 0 THEN id END AS cursor_id FROM jobs"
ORACLES["jobs_progress"] = f"{_J} SELECT id, CASE WHEN status = 'queued' THEN 'queued' WHEN status IN {_RUN} THEN 'in_progress' WHEN status IN ('completed', 'failed') THEN status END AS phase, CASE WHEN total > 0 THEN least(100, floor(completed::DOUBLE / total * 100 + 0.5)) ELSE 0 END::BIGINT AS percent, status = 'completed' OR result_available AS downloadable FROM jobs"
ORACLES["owner_hash"] = "SELECT c_custkey, substr(sha256(c_custkey::VARCHAR), 1, 32) AS owner FROM customer"

_STORE = "CASE WHEN p_partkey % 2 = 0 THEN 'documents' ELSE 'remote_fs' END AS storage"
ORACLES["selection_plan"] = f"WITH {P}, f AS (SELECT *, {_STORE} FROM fm) SELECT DISTINCT storage, path FROM f WHERE format IS NOT NULL AND (path LIKE '%7%' OR (storage = 'documents' AND path LIKE 'd1/%') OR (storage = 'remote_fs' AND path LIKE 'd3/%'))"
ORACLES["save_plan"] = f"""WITH {P}, f AS (SELECT *, {_STORE}, p_partkey % 4 < 2 AS rep FROM fm WHERE format IS NOT NULL), o AS (SELECT *, CASE WHEN generated THEN 'generated' WHEN rep AND format = 'docx' THEN 'incompatible' ELSE 'planned' END AS outcome FROM f),
  t AS (SELECT *, CASE WHEN outcome = 'planned' THEN CASE p_partkey % 3 WHEN 0 THEN {_out('rep')} WHEN 1 THEN path ELSE 'out/' || CASE WHEN p_partkey % 2 = 0 THEN storage || '/' ELSE '' END || {_out('rep')} END END AS save_path FROM o)
  SELECT p_partkey, path, CASE WHEN outcome = 'planned' AND p_partkey % 3 <> 1 AND save_path IN (SELECT save_path FROM t WHERE p_partkey % 5 = 0 AND save_path IS NOT NULL) THEN 'existing' ELSE outcome END AS outcome, save_path FROM t"""
ORACLES["schedule_dispatch"] = f"""{_J}, q AS (SELECT id, preset, CASE WHEN id::BIGINT % 3 <> 0 THEN save_to END AS output, row_number() OVER (ORDER BY created_at, id) AS pos FROM jobs WHERE status = 'queued'), s AS (SELECT * FROM q WHERE preset = (SELECT preset FROM q WHERE pos = 1)),
  d AS (SELECT *, row_number() OVER (PARTITION BY output ORDER BY pos) AS k FROM s), c AS (SELECT id, pos FROM d WHERE k = 1 OR output IS NULL ORDER BY pos LIMIT 8) SELECT id, row_number() OVER (ORDER BY pos) AS place FROM c"""
ORACLES["schedule_dispatch_busy"] = f"""{_J}, q AS (SELECT id, status, preset, CASE WHEN id::BIGINT % 3 <> 0 THEN save_to END AS output, row_number() OVER (ORDER BY created_at, id) AS pos FROM jobs), a AS (SELECT * FROM q WHERE status = 'translating' AND preset = '30b-fp8' ORDER BY pos LIMIT 5),
  s AS (SELECT * FROM q WHERE status = 'queued' AND preset = coalesce((SELECT max(preset) FROM a), (SELECT preset FROM q WHERE status = 'queued' ORDER BY pos LIMIT 1)) AND (output IS NULL OR output NOT IN (SELECT output FROM a WHERE output IS NOT NULL))),
  d AS (SELECT *, row_number() OVER (PARTITION BY output ORDER BY pos) AS k FROM s), c AS (SELECT id, row_number() OVER (ORDER BY pos) AS place FROM d WHERE k = 1 OR output IS NULL) SELECT id, place FROM c WHERE place <= 8 - (SELECT count(*) FROM a)"""
_MIR = "m AS (SELECT s_nationkey::BIGINT AS grp, ['modelscope', 'hf_mirror', 'huggingface'][(s_suppkey % 3 + 1)::INT] AS source, (s_suppkey % 3)::INT AS rank, max(s_suppkey % 5 <> 0) AS available, max(s_suppkey * 37 % 101)::BIGINT AS speed FROM supplier GROUP BY ALL), up AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY speed DESC, rank DESC) AS k, max(speed) OVER (PARTITION BY grp) AS best FROM m WHERE available), rec AS (SELECT grp, coalesce(max(CASE WHEN rank = 0 AND speed >= best * 85 // 100 THEN source END), max(CASE WHEN k = 1 THEN source END)) AS recommended FROM up GROUP BY 1)"
ORACLES["source_ranking"] = f"WITH {_MIR} SELECT grp, recommended FROM rec"
ORACLES["source_preference"] = f"""WITH {_MIR}, a AS (SELECT grp, 0 AS o, 0 AS p, recommended AS s FROM rec UNION ALL SELECT grp, 1, row_number() OVER (PARTITION BY grp ORDER BY speed DESC, rank), source FROM up UNION ALL SELECT grp, 2, i, s FROM (SELECT DISTINCT grp FROM m), (VALUES (0, 'modelscope'), (1, 'hf_mirror'), (2, 'huggingface')) v(i, s)),
  n AS (SELECT *, lag(s) OVER (PARTITION BY grp ORDER BY o, p) AS b FROM a) SELECT grp, string_agg(s, ',' ORDER BY o, p) AS sources FROM n WHERE b IS NULL OR b <> s GROUP BY 1"""
ORACLES["download_plan"] = """WITH f AS (SELECT l_orderkey AS model, trunc(l_extendedprice)::BIGINT AS size, CASE l_linenumber % 3 WHEN 0 THEN 0 WHEN 1 THEN trunc(l_extendedprice)::BIGINT ELSE 100 END AS fin, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey * 10 ELSE 0 END AS par FROM lineitem),
  s AS (SELECT model, sum(size)::BIGINT AS total, sum(CASE WHEN fin >= size THEN size ELSE least(par, size) END)::BIGINT AS present FROM f GROUP BY 1), r AS (SELECT *, total - present AS remaining, trunc(model % 7 * 1000 / greatest(model % 5 / 8.0::DOUBLE, 0.25))::BIGINT AS speed FROM s)
  SELECT model, total, present, remaining, CASE WHEN (model % 3) * 1048576 > 1048576 THEN 'unexpected_size' WHEN model % 1000 * 100 < remaining THEN 'no_space' ELSE 'ok' END AS verdict, speed, CASE WHEN speed > 0 THEN remaining // speed ELSE -1 END AS eta FROM r"""
ORACLES["launch_profile"] = """WITH g AS (SELECT p_partkey, (8046402613 + (p_partkey % 4) * 7515735243)::BIGINT AS w, CASE WHEN p_partkey % 2 = 0 THEN 8589934592 ELSE 3221225472 END AS kv, CASE WHEN p_partkey % 2 = 0 THEN 0.35 ELSE 0.55 END::DOUBLE AS tuned, ((16 + p_partkey % 60) * 1073741824)::BIGINT AS total, p_partkey % 3 <> 0 AS flag FROM part),
  h AS (SELECT *, least(0.9::DOUBLE, (total - (p_partkey % 7) * 536870912)::DOUBLE / total) AS ceil_, w + kv + 2147483648 AS need FROM g), k AS (SELECT *, greatest(0, floor(total * ceil_)::BIGINT - w - 2147483648) // 268435456 * 268435456 AS less FROM h),
  v AS (SELECT *, CASE WHEN need <= tuned * total THEN 1 WHEN need <= ceil_ * total THEN 2 WHEN less >= 1073741824 THEN 3 ELSE 4 END AS c FROM k)
  SELECT p_partkey, round(CASE c WHEN 1 THEN tuned WHEN 2 THEN least(ceil(need::DOUBLE / total / 0.05::DOUBLE) * 0.05::DOUBLE, ceil_) WHEN 3 THEN ceil_ ELSE -1 END, 6) AS utilization, CASE WHEN flag AND c < 3 THEN kv WHEN flag AND c = 3 THEN less ELSE -1 END::BIGINT AS kv_bytes, c < 4 AS ok FROM v"""

_EV = f"ev AS (SELECT event_id, user_id AS run, floor(epoch(ts))::BIGINT AS sec, ts, {A.LOG} AS raw, event_type <> 'error' AS ok FROM events)"
_SIG = rf"""{_EV}, cl AS (SELECT *, regexp_replace(regexp_replace(raw, '\x1b\[[^@-~]*[@-~]', '', 'g'), '[\x00-\x08\x0a-\x1f\x7f]', '', 'g') AS x FROM ev), ct AS (SELECT *, {_trim("CASE WHEN length(x) >= 600 THEN left(x, 600) || '...' ELSE x END")} AS line FROM cl),
  pc AS (SELECT *, lower(line) AS low, try_cast(nullif(regexp_extract(line, '^[^%]*?([0-9]+)[ \t]*%', 1), '') AS INT) AS pct0 FROM ct WHERE line <> ''), pd AS (SELECT *, CASE WHEN pct0 <= 255 THEN least(pct0, 100) END AS pct FROM pc),
  sg AS (SELECT *, CASE WHEN contains(low, 'loading safetensors checkpoint shards') THEN 'loading_weights' WHEN regexp_matches(low, 'loading model weights took|model loading took|weights loaded') THEN 'loading_weights' WHEN regexp_matches(low, 'cuda graph|cudagraph') THEN 'capturing_graphs' WHEN regexp_matches(low, 'compil|triton|flashinfer|marlin|torchinductor|ninja|nvcc') THEN 'compiling_kernels' WHEN regexp_matches(low, 'application startup complete|uvicorn running|starting vllm api server|available routes') THEN 'starting_server' END AS stage,
    CASE WHEN contains(low, 'loading safetensors checkpoint shards') THEN 10 + coalesce(pct, 0) * 35 // 100 WHEN regexp_matches(low, 'loading model weights took|model loading took|weights loaded') THEN 48 WHEN regexp_matches(low, 'cuda graph|cudagraph') THEN 65 + coalesce(pct, 5) * 30 // 100 WHEN regexp_matches(low, 'compil|triton|flashinfer|marlin|torchinductor|ninja|nvcc') THEN 52 WHEN regexp_matches(low, 'application startup complete|uvicorn running|starting vllm api server|available routes') THEN 98 END::INT AS progress FROM pd)"""
ORACLES["log_signals"] = f"WITH {_SIG} SELECT event_id, line, stage, coalesce(progress, -1)::BIGINT AS progress FROM sg"
ORACLES["startup_progress"] = f"WITH {_SIG}, m AS (SELECT *, coalesce(max(progress) OVER (PARTITION BY run ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING), 0) AS now_progress FROM sg) SELECT event_id, now_progress::BIGINT AS now_progress, last_value(CASE WHEN progress >= now_progress THEN stage END IGNORE NULLS) OVER (PARTITION BY run ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS now_stage FROM m"
ORACLES["probe_failures"] = f"WITH RECURSIVE {_EV}, o AS (SELECT event_id, run, ok, row_number() OVER (PARTITION BY run ORDER BY sec, event_id) AS k FROM ev), r AS (SELECT event_id, run, k, CASE WHEN ok THEN 0 ELSE 1 END::BIGINT AS failures FROM o WHERE k = 1 UNION ALL SELECT o.event_id, o.run, o.k, CASE WHEN o.ok THEN 0 WHEN r.failures = 3 THEN 1 ELSE r.failures + 1 END FROM r JOIN o ON o.run = r.run AND o.k = r.k + 1) SELECT event_id, failures, failures = 3 AS failed FROM r"
ORACLES["eta"] = "WITH e AS (SELECT event_id, event_id % 101 AS p, event_id % 900 AS t FROM events) SELECT event_id, CASE WHEN p <= 5 THEN greatest(0, 360 - t) ELSE least((greatest(0, 360 - t) + t * (100 - p) // p) // 2, greatest(0, 600 - t)) END::BIGINT AS remaining FROM e"
ORACLES["recent_logs"] = f"WITH {_EV}, k AS (SELECT run, event_id, row_number() OVER (PARTITION BY run ORDER BY sec DESC, event_id DESC) AS back FROM ev) SELECT * FROM k WHERE back <= 40"
ORACLES["lease_sessions"] = f"WITH {_EV}, g AS (SELECT *, (ts - lag(ts) OVER (PARTITION BY run ORDER BY ts)) >= INTERVAL 6 HOUR AS gap FROM ev), s AS (SELECT *, sum(coalesce(gap, false)::INT) OVER (PARTITION BY run ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT run, epoch_us(min(ts)) AS session_start, epoch_us(max(ts) + INTERVAL 6 HOUR) AS session_end, count(*) AS uses FROM s GROUP BY run, s".replace("GROUP BY run, s", "GROUP BY run, s.s")
ORACLES["progress_throttle"] = f"WITH RECURSIVE {_EV}, o AS (SELECT run, sec, row_number() OVER (PARTITION BY run ORDER BY sec, event_id) AS k FROM ev), r AS (SELECT run, sec, k, true AS due, sec AS last FROM o WHERE k = 1 UNION ALL SELECT o.run, o.sec, o.k, o.sec - r.last >= 7200, CASE WHEN o.sec - r.last >= 7200 THEN o.sec ELSE r.last END FROM r JOIN o ON o.run = r.run AND o.k = r.k + 1) SELECT run, sec AS written_at FROM r WHERE due"

ORACLES["settings_bounds"] = f"""WITH t AS (SELECT o_orderkey AS o, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN chr(9) || 'French ' WHEN 2 THEN repeat('é', 33) WHEN 3 THEN repeat('x', 64) ELSE 'de' END AS x FROM orders)
  SELECT o AS o_orderkey, o % 120 >= 1 AND o % 120 <= 100 AND o % 60 <= 50 AS valid, strlen({_trim('x')}) BETWEEN 1 AND 64 AS target_ok, CASE WHEN o % 7 = 0 THEN 120 ELSE least(3600, greatest(30, o % 5000)) END::BIGINT AS ttl, greatest(0, o - 604800)::BIGINT AS cutoff, CASE WHEN o % 3 = 0 THEN 50 ELSE least(100, greatest(1, o % 200)) END::BIGINT AS page FROM t"""
ORACLES["format_strategies"] = "SELECT f AS format, CASE WHEN f IN ('epub', 'docx') THEN 'independent' ELSE 'batched' END AS kind, CASE WHEN f IN ('epub', 'docx') THEN 1 ELSE 25 END::BIGINT AS batch_size, CASE WHEN f IN ('epub', 'docx') THEN 0 ELSE 5 END::BIGINT AS context FROM (SELECT unnest(['epub', 'srt', 'vtt', 'ass', 'lrc', 'txt', 'md', 'docx']) AS f)"
ORACLES["preset_budgets"] = "SELECT * FROM (VALUES ('7b-fp8', 3840::BIGINT, 8046402613::BIGINT), ('30b-fp8', 1792, 30593608342)) v(preset, budget, download_bytes)"
ORACLES["job_checks"] = f"{_J} SELECT id, 'preset' AS rule FROM jobs WHERE id::BIGINT % 50 = 0 UNION ALL SELECT id, 'translated' FROM jobs WHERE id::BIGINT % 70 = 0 UNION ALL SELECT id, 'status' FROM jobs WHERE id::BIGINT % 90 = 0"
_ph = lambda s: f"CASE WHEN {s} IN {_RUN} THEN 'in_progress' WHEN {s} <> 'cancelled' THEN {s} END"
ORACLES["snapshot_changes"] = f"""{_J}, b AS (SELECT id, {_ph('status')} AS p FROM jobs WHERE id::BIGINT % 13 <> 0), a AS (SELECT id, {_ph("CASE WHEN id::BIGINT % 3 = 0 THEN 'writing' ELSE status END")} AS p FROM jobs WHERE id::BIGINT % 11 <> 0)
  SELECT coalesce(b.id, a.id) AS id, CASE WHEN a.id IS NULL THEN 'disappeared' WHEN b.id IS NULL THEN 'appeared' WHEN a.p IS NOT DISTINCT FROM b.p THEN 'same' ELSE 'phase' END AS change FROM b FULL JOIN a ON a.id = b.id"""
ORACLES["active_overlay"] = f"{_J} SELECT id, CASE WHEN status = 'translating' THEN 'writing' ELSE status END AS status, CASE WHEN status = 'translating' THEN total ELSE completed END AS completed FROM jobs"
ORACLES["live_leases"] = f"WITH {_EV} SELECT event_id, sec + event_id % 3600 AS expires_at FROM ev WHERE sec + event_id % 3600 > 1705000000"
ORACLES["display_values"] = """WITH n AS (SELECT p_partkey, p_name, (1::BIGINT << (p_partkey % 40)::INT) + p_partkey AS n, greatest(0, p_partkey - 5) AS s FROM part)
  SELECT p_partkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', floor(n / 1024 * 10 + 0.5) / 10) || ' KB' WHEN n < 1073741824 THEN printf('%.1f', floor(n / 1048576 * 10 + 0.5) / 10) || ' MiB' ELSE printf('%.2f', floor(n / 1073741824 * 100 + 0.5) / 100) || ' GiB' END AS bytes,
  CASE WHEN s < 60 THEN s || ' 秒' WHEN s % 60 > 0 THEN (s // 60) || ' 分 ' || (s % 60) || ' 秒' ELSE (s // 60) || ' 分钟' END AS duration, '&lt;&quot;&amp;&#39;&gt;' || p_name AS attribute FROM n"""
ORACLES["file_urls"] = """WITH f AS (SELECT p_partkey, replace(p_name, ' ', '_') AS p FROM part) SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'https://modelscope.cn/api/v1/models/o/r/repo?Revision=master&FilePath=' || replace(p, '#', '%23') || '%2B%C3%A9.json' WHEN 1 THEN 'https://hf-mirror.com/o/r/resolve/abc/' || p || '+é.json' WHEN 2 THEN 'https://huggingface.co/o/r/resolve/abc/' || p || '+é.json' END AS url,
  p_partkey % 3 > 0 AND p_partkey % 5 = p_partkey % 2 AS resumes FROM f"""
ORACLES["log_lines"] = """WITH c AS (SELECT event_id, event_type, (event_id % 7 * 3000)::BIGINT AS n FROM events) SELECT event_id, 0::BIGINT AS pos, 1::BIGINT AS n, 'a' AS head FROM c UNION ALL SELECT event_id, 1, length(event_type), left(event_type, 5) FROM c UNION ALL SELECT event_id, 2 + k, least(8192, n - k * 8192), repeat('y', least(5, n - k * 8192)) FROM c, range(3) r(k) WHERE n > k * 8192"""
ORACLES["manifest_files"] = """WITH f AS (SELECT l_orderkey, CASE WHEN l_linenumber % 4 = 0 THEN 'sub/' ELSE '' END || 'm' || l_linenumber || CASE l_partkey % 3 WHEN 0 THEN '.safetensors' WHEN 1 THEN '.json' ELSE '.bin' END AS path, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE l_suppkey END AS size, CASE WHEN l_orderkey % 8 = 0 THEN 'h' ELSE 's' END AS sha256 FROM lineitem)
  SELECT * FROM f WHERE path NOT LIKE '%/%' AND path NOT LIKE '%.bin'"""
ORACLES["missing_shards"] = """WITH l AS (SELECT l_orderkey AS model, 'm' || (l_partkey % 6) || '.safetensors' AS shard, l_linenumber, l_suppkey FROM lineitem) SELECT DISTINCT model, shard FROM l WHERE (model, shard) NOT IN (SELECT (model, shard) FROM l WHERE l_linenumber % 2 = 1 AND l_suppkey % 3 > 0)"""
ORACLES["weights_bytes"] = "SELECT l_orderkey AS model, coalesce(sum(l_suppkey) FILTER (WHERE l_partkey % 3 <> 0), -1)::BIGINT AS bytes FROM lineitem GROUP BY 1"
ORACLES["spine_paths"] = """WITH i AS (SELECT l_orderkey AS book, l_linenumber AS k, CASE WHEN l_partkey % 4 = 0 THEN 'x.xhtml' ELSE 'OEBPS/t' || (l_suppkey % 3) || '.xhtml' END AS path FROM lineitem WHERE l_partkey % 5 <> 0 AND l_partkey % 7 <> 0)
  SELECT i.book, i.path, min(r.l_linenumber)::BIGINT AS pos FROM lineitem r JOIN i ON i.book = r.l_orderkey AND i.k = r.l_linenumber * 3 % 8 GROUP BY 1, 2"""
_MF = "f AS (SELECT l_orderkey AS model, CASE l_linenumber WHEN 1 THEN 'config.json' WHEN 2 THEN 'tokenizer.json' WHEN 3 THEN 'model.safetensors.index.json' ELSE 'm' || l_linenumber || '.safetensors' END AS path, CASE WHEN l_partkey % 13 = 0 THEN 0 ELSE l_suppkey END::BIGINT AS size FROM lineitem WHERE l_partkey % 11 <> 0)"
_MC = f"""{_MF}, k AS (SELECT DISTINCT model FROM f UNION SELECT l_orderkey FROM lineitem WHERE l_linenumber > 3), s AS (SELECT l_orderkey AS model, 'm' || l_linenumber || '.safetensors' AS path FROM lineitem WHERE l_linenumber > 3),
  w AS (SELECT model, 4 AS rank, path FROM s UNION ALL SELECT model, rank, path FROM k, (VALUES (0, 'config.json'), (1, 'tokenizer.json'), (2, 'model.safetensors.index.json')) v(rank, path)),
  b AS (SELECT w.model, rank, w.path, CASE WHEN size IS NULL THEN 'missing ' ELSE 'invalid ' END || w.path AS problem FROM w LEFT JOIN f ON f.model = w.model AND f.path = w.path WHERE size IS NULL OR size <= 0 UNION ALL SELECT model, 3, '', 'no shards' FROM k WHERE model NOT IN (SELECT model FROM s)),
  p AS (SELECT model, problem FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY rank, path) AS n FROM b) WHERE n = 1), checked AS (SELECT k.model, problem, (SELECT coalesce(sum(size), 0) FROM f WHERE f.model = k.model)::BIGINT AS bytes FROM k LEFT JOIN p ON p.model = k.model)"""
ORACLES["model_directories"] = f"WITH {_MC} SELECT * FROM checked"
ORACLES["model_status"] = f"WITH {_MC} SELECT model, CASE WHEN problem IS NULL THEN 'ready' WHEN o_custkey % 5 > 0 THEN 'paused' ELSE 'absent' END AS state, CASE WHEN problem IS NULL THEN bytes ELSE coalesce(o_custkey % 5, 0) END::BIGINT AS bytes FROM checked LEFT JOIN orders ON o_orderkey = model"
ORACLES["storage_sizes"] = "SELECT p_partkey % 3 AS store, sum(p_size)::BIGINT AS bytes FROM part WHERE p_partkey % 5 <> 2 GROUP BY 1"
ORACLES["model_order"] = """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 99 END::BIGINT AS rank, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', floor(n / 1024 * 10 + 0.5) / 10) || ' KB' WHEN n < 1073741824 THEN printf('%.1f', floor(n / 1048576 * 10 + 0.5) / 10) || ' MiB' ELSE printf('%.2f', floor(n / 1073741824 * 100 + 0.5) / 100) || ' GiB' END || '/s' AS speed FROM (SELECT *, p_partkey * 1000 AS n FROM part)"""
ORACLES["usable_benchmarks"] = "SELECT grp, tested_at, state, state = 'complete' AND 150000 - tested_at < 86400 AS usable FROM (SELECT o_custkey AS grp, o_orderkey * 10 AS tested_at, CASE WHEN o_orderkey % 4 > 0 THEN 'complete' ELSE 'testing' END AS state, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1"
ORACLES["start_attempts"] = "WITH e AS (SELECT event_id, user_id, event_type = 'error' AS failed, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY epoch(ts::TIMESTAMP)::BIGINT, event_id) AS n FROM events) SELECT event_id, n::BIGINT AS failures, CASE WHEN NOT failed THEN 'wait' WHEN n < 3 THEN 'retry' ELSE 'give_up' END AS \"then\" FROM e WHERE n < 3 OR n = 3 AND failed"
ORACLES["upload_limits"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 50000 <= 536870912 ELSE o_orderkey % 16384 <= 8192 END AS accepted FROM orders"
ORACLES["ascending_ranges"] = "SELECT l_orderkey, bool_and(ok) AS ok FROM (SELECT l_orderkey, coalesce(lag(l_linenumber * 100 + 98 + l_suppkey % 4) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) <= l_linenumber * 100, true) AS ok FROM lineitem) GROUP BY 1"
# archives: what is read from the books and documents that the tables' pages and turns make, and from those with a translation after every other segment
_EPUB = f"WITH {_HTML}, b AS (SELECT page_id % 50 AS doc_id, row_number() OVER (PARTITION BY page_id % 50 ORDER BY page_id, leaf_idx) - 1 AS seg_id, text FROM leaf)"
_DOCX = r"WITH b AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seg_id, text FROM conversations WHERE regexp_matches(coalesce(text, ''), '\S'))"
_read = "SELECT doc_id, seg_id, text, NULL::VARCHAR AS error FROM b"
_added = "'T & ' || upper(replace(text, 'ß', 'ss'))"
_with_added = lambda added: f", n AS (SELECT doc_id, seg_id * 2 AS o, text FROM b UNION ALL SELECT doc_id, seg_id * 2 + 1, {added} FROM b WHERE seg_id % 2 = 0) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS seg_id, text, NULL::VARCHAR AS error FROM n"
ORACLES["epub_segments"], ORACLES["docx_segments"] = f"{_EPUB} {_read}", f"{_DOCX} {_read}"
ORACLES["epub_render"] = _EPUB + _with_added(f"replace(replace(replace({_added}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')")
ORACLES["docx_render"] = _DOCX + _with_added(_added)
