"""DuckDB SQL that each SQL-expressible query is checked against."""

from __future__ import annotations

import re

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_TOKENS = r"len(regexp_extract_all({}, '\w+|[^\w\s]'))"
_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda s: " + _STRIP.format("s") + r"), lambda s: s <> '')"
_TERMS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_INGESTED = "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, text FROM conversations"
_SCORED = """SELECT conv_id, turn, user_text, reply FROM (SELECT conv_id, turn, role, text AS user_text, lead(role) OVER w AS next_role, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) t
  WHERE role = 'user' AND next_role = 'assistant' AND reply <> ''"""


def _english(text: str) -> str:
    """The English sentences of a text by the same stages, as nested replacements."""
    from turnlake.functions import sentences as rules

    def replaced(value: str, stages) -> str:
        for pattern, by in stages:
            value = "regexp_replace({}, '{}', '{}', 'g')".format(value, pattern.replace("'", "''"), re.sub(r"\$(\d)", r"\\\1", by).replace("'", "''"))
        return value

    marked = replaced(replaced(text, rules.HIDE), [(f"({rules.SPANS})", f"{rules.SPAN}$1{rules.SPAN}")])
    inside = f"array_to_string(list_transform(string_split({marked}, '{rules.SPAN}'), lambda x, i: CASE WHEN i % 2 = 0 THEN translate(x, '.?!', '{rules.STOP}{rules.ASKS}{rules.CRIES}') ELSE x END), '')"
    cut = f"string_split({replaced(inside, [*rules.SHOW, rules.ENDS])}, chr(10))"
    shown = _STRIP.format(f"translate(s, '{rules.STOP}{rules.ASKS}{rules.CRIES}{rules.WEAK}{rules.DOTS}{rules.ITEM}', '.?!.….')")
    return f"list_filter(list_transform({cut}, lambda s: {shown}), lambda s: s <> '')"


def _packed(source: str, words: str, limit: int, out: str) -> str:
    """CTEs: words(k, i, w, n) packed greedily into numbered groups."""
    return f"""{words} AS MATERIALIZED ({source}),
{out} AS (SELECT k, i, 1 AS g, n AS run FROM {words} WHERE i = 1 UNION ALL
  SELECT x.k, x.i, CASE WHEN run + x.n > {limit} THEN g + 1 ELSE g END, CASE WHEN run + x.n > {limit} THEN x.n ELSE run + x.n END FROM {out} JOIN {words} x ON x.k = {out}.k AND x.i = {out}.i + 1)"""


def _clauses(delimiter: str) -> str:
    cut = f"string_split(s, '{delimiter}')"
    part = _STRIP.format("x")
    return f"list_filter(list_transform({cut}, lambda x, i: CASE WHEN {part} = '' THEN '' WHEN i < len({cut}) THEN {part} || '{delimiter.rstrip()}' ELSE {part} END), lambda x: x <> '')"


def _parts(limit: int, rows: str, sentences: str | None = None) -> str:
    """CTEs up to part(conv_id, turn, p, s, n): sentences, long ones in parts. rows: SELECT conv_id, turn, text; sentences: of text, another rule than the plain one."""
    fits = lambda list_: f"len(list_filter({list_}, lambda x: {_TOKENS.format('x')} > {limit})) = 0"
    words = f"SELECT k, i, w[i] AS w, {_TOKENS.format('w[i]')} AS n FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT k, list_filter(string_split_regex(s, '\\s+'), lambda x: x <> '') AS w FROM cut WHERE pieces IS NULL))"
    return f"""base AS MATERIALIZED ({rows}),
sent AS (SELECT conv_id, turn, q, l[q] AS s FROM (SELECT conv_id, turn, l, unnest(range(1, len(l) + 1)) AS q FROM (SELECT conv_id, turn, {sentences or _SENTENCES.format("text")} AS l FROM base))),
cut AS MATERIALIZED (SELECT *, conv_id || '/' || turn || '/' || q AS k, CASE WHEN {_TOKENS.format("s")} <= {limit} THEN [s] WHEN contains(s, '; ') AND {fits(_clauses("; "))} THEN {_clauses("; ")} WHEN contains(s, ', ') AND {fits(_clauses(", "))} THEN {_clauses(", ")} END AS pieces FROM sent),
{_packed(words, "hard_words", limit, "hard")},
hard_parts AS (SELECT k, list(w ORDER BY g) AS pieces FROM (SELECT hard.k, g, string_agg(w, ' ' ORDER BY hard.i) AS w FROM hard JOIN hard_words USING (k, i) GROUP BY hard.k, g) GROUP BY k),
whole AS (SELECT conv_id, turn, q, coalesce(cut.pieces, hard_parts.pieces) AS l FROM cut LEFT JOIN hard_parts USING (k)),
part AS MATERIALIZED (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY q, j) AS p, l[j] AS s, {_TOKENS.format("l[j]")} AS n FROM (SELECT conv_id, turn, q, l, unnest(range(1, len(l) + 1)) AS j FROM whole))"""


def _chunks(limit: int, rows: str, sentences: str | None = None) -> str:
    """CTEs up to chunks(conv_id, turn, pos, text, start_char, end_char, token_count)."""
    at = lambda what: f"instr(substr(b.text, o.stop + 1), {what})"
    return f"""{_parts(limit, rows, sentences)},
o AS (SELECT conv_id, turn, p, s, instr(b.text, s) - 1 AS start, instr(b.text, s) - 1 + length(s) AS stop FROM part JOIN base b USING (conv_id, turn) WHERE p = 1 UNION ALL
  SELECT conv_id, turn, p, s, start, start + length(s) FROM (SELECT x.conv_id, x.turn, x.p, x.s, CASE WHEN {at("x.s")} > 0 THEN o.stop + {at("x.s")} - 1 WHEN {at("regexp_extract(x.s, '^[^ ]+')")} > 0 THEN o.stop + {at("regexp_extract(x.s, '^[^ ]+')")} - 1 ELSE o.stop END AS start
    FROM o JOIN part x ON x.conv_id = o.conv_id AND x.turn = o.turn AND x.p = o.p + 1 JOIN base b ON b.conv_id = x.conv_id AND b.turn = x.turn)),
{_packed("SELECT conv_id || '/' || turn AS k, p AS i, s AS w, n FROM part", "packed_words", limit, "packed")},
chunks AS (SELECT o.conv_id, o.turn, (g - 1)::INTEGER AS pos, string_agg(o.s, ' ' ORDER BY o.p) AS text, arg_min(o.start, o.p)::INTEGER AS start_char, arg_max(o.stop, o.p)::INTEGER AS end_char, sum(part.n)::INTEGER AS token_count
  FROM o JOIN part USING (conv_id, turn, p) JOIN packed ON packed.k = o.conv_id || '/' || o.turn AND packed.i = o.p GROUP BY o.conv_id, o.turn, g)"""


_TALK = "SELECT conv_id, turn, text FROM conversations"
_TALK_CHUNKS = "WITH RECURSIVE " + _chunks(40, _TALK)

#: CTEs up to bm25(query_id, doc_id, score): all turns against the user's turns of every hundredth conversation.
_BM25 = f"""d AS MATERIALIZED (SELECT conv_id * 100000 + turn AS doc_id, conv_id, role, {_TERMS.format("text")} AS l FROM conversations),
facts AS (SELECT count(*) AS n, avg(len(l)) AS mean FROM d),
tf AS MATERIALIZED (SELECT doc_id, len(l) AS length, term, count(*) AS tf FROM (SELECT doc_id, l, unnest(l) AS term FROM d) GROUP BY ALL),
idf AS (SELECT term, ln(1 + ((SELECT n FROM facts) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY term),
asks AS (SELECT DISTINCT doc_id AS query_id, term FROM tf JOIN d USING (doc_id) WHERE conv_id % 100 = 0 AND role = 'user'),
bm25 AS (SELECT query_id, doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (SELECT mean FROM facts)))) AS score FROM asks JOIN tf USING (term) JOIN idf USING (term) GROUP BY ALL)"""


def _best(scores: str, n: int, key: str = "doc_id") -> str:
    """The n best rows of each query by score, ties to the smaller key, with rk."""
    return f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, {key}) AS rk, {key}, score FROM {scores} QUALIFY rk <= {n}"

#: CTEs up to v: every operation with ord, item and verdict, by running windows; ok: the accepted ones.
_OPS = """p AS (SELECT conv_id, turn, text, length(coalesce(text, '')) AS z FROM conversations),
q AS (SELECT conv_id, turn, text, 0 AS seq, (z + turn) % 10 AS pick, (z + turn * 5) % 6 AS m FROM p UNION ALL SELECT conv_id, turn, text, 1, (z * 7 + turn * 3) % 10, (z * 3 + turn) % 6 FROM p),
r AS (SELECT *, CASE WHEN pick < 4 THEN 'create' WHEN pick < 6 THEN 'update' WHEN pick < 8 THEN 'supersede' WHEN pick < 9 THEN 'pin' ELSE 'delete' END AS op FROM q),
o AS (SELECT conv_id, turn, seq::BIGINT AS seq, turn * 2 + seq AS ord, op, m::BIGINT AS item, CASE WHEN op <> 'supersede' THEN m WHEN turn % 6 = 5 THEN 6 ELSE (m + 1 + turn % 3) % 6 END::BIGINT AS mem_id, concat_ws(':', turn, seq, left(text, 20)) AS content,
  CASE WHEN op = 'pin' THEN CASE WHEN turn % 2 = 0 THEN 'user_pinned' ELSE 'none' END END AS pin, turn % 10 <> 9 AND coalesce(left(text, 20), '') <> '' AS sourced FROM r),
c AS (SELECT conv_id, item, min(ord) AS created FROM o WHERE op = 'create' AND sourced GROUP BY ALL),
g AS (SELECT o.*, c.created, sourced AND NOT (op = 'supersede' AND mem_id = o.item) AS fair, op <> 'supersede' OR coalesce(s.created < ord, false) AS sound, coalesce(c.created < ord, false) AS there
  FROM o LEFT JOIN c ON c.conv_id = o.conv_id AND c.item = o.item LEFT JOIN c AS s ON s.conv_id = o.conv_id AND s.item = o.mem_id),
w AS (SELECT *, coalesce(max(CASE WHEN fair AND there AND sound AND op IN ('supersede', 'delete') THEN 1 END) OVER b, 0) AS over_, coalesce(max(CASE WHEN fair AND there AND op = 'delete' THEN 1 END) OVER b, 0) AS gone
  FROM g WINDOW b AS (PARTITION BY conv_id, item ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS MATERIALIZED (SELECT *, CASE WHEN NOT sourced THEN 'no provenance' WHEN NOT fair THEN 'supersedes itself' WHEN op = 'create' THEN CASE WHEN ord = created THEN 'ok' ELSE 'exists' END WHEN NOT there THEN 'no such item' WHEN NOT sound THEN 'no such successor'
  WHEN op = 'delete' AND gone = 1 OR op <> 'delete' AND over_ = 1 THEN 'has ended' ELSE 'ok' END AS verdict FROM w),
ok AS (SELECT * FROM v WHERE verdict = 'ok')"""


def _greedy(source: str, budget: int, out: str) -> str:
    """CTEs up to out(conv_id, turn, used, kept): items(conv_id, turn, i, n) of source tried one by one; kept: the places taken."""
    return f"""{out}_items AS MATERIALIZED ({source}),
{out}_fold AS (SELECT conv_id, turn, 0::BIGINT AS i, 0::BIGINT AS used, []::BIGINT[] AS kept FROM {out}_items GROUP BY ALL UNION ALL
  SELECT f.conv_id, f.turn, x.i, CASE WHEN used + n <= {budget} THEN used + n ELSE used END, CASE WHEN used + n <= {budget} THEN list_append(kept, x.i) ELSE kept END FROM {out}_fold AS f JOIN {out}_items AS x ON x.conv_id = f.conv_id AND x.turn = f.turn AND x.i = f.i + 1),
{out} AS (SELECT conv_id, turn, max(used) AS used, arg_max(kept, i) AS kept FROM {out}_fold GROUP BY ALL)"""


def _context() -> str:
    tokens = _TOKENS.format("text")
    header = f"SELECT h.conv_id, h.turn, h.rk AS i, {tokens} AS n, text FROM found AS h JOIN conversations AS t ON t.conv_id = h.conv_id AND t.turn = h.m_turn"
    recent = f"SELECT s.conv_id, s.turn, row_number() OVER (PARTITION BY s.conv_id, s.turn ORDER BY t.turn DESC) AS i, {tokens} AS n, text FROM asked AS s JOIN conversations AS t ON t.conv_id = s.conv_id AND t.turn < s.turn QUALIFY i <= 8"
    cut = _SENTENCES.format("t.text")
    snippets = f"SELECT conv_id, turn, i, {_TOKENS.format('l[i]')} AS n, l[i] AS text FROM (SELECT conv_id, turn, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT h.conv_id, h.turn, {cut} AS l FROM found AS h JOIN conversations AS t ON t.conv_id = h.conv_id AND t.turn = h.m_turn WHERE h.rk = 1))"
    text = lambda name, order: f"md5(coalesce((SELECT string_agg(x.text, '|' ORDER BY x.i {order}) FROM {name}_items AS x WHERE x.conv_id = s.conv_id AND x.turn = s.turn AND list_contains({name}.kept, x.i)), ''))"
    return f"""WITH RECURSIVE {_HITS}, found AS (SELECT * FROM ranked WHERE rk <= 5),
{_greedy(header, 60, "header")}, {_greedy(recent, 90, "recent")}, {_greedy(snippets, 15, "snippets")}
SELECT s.conv_id, s.turn, coalesce(header.used, 0) AS header_tokens, coalesce(recent.used, 0) AS recent_tokens, coalesce(snippets.used, 0) AS snippets_tokens, {text("header", "")} AS header_md5, {text("recent", "DESC")} AS recent_md5, {text("snippets", "")} AS snippets_md5
FROM asked AS s LEFT JOIN header USING (conv_id, turn) LEFT JOIN recent USING (conv_id, turn) LEFT JOIN snippets USING (conv_id, turn)"""


def _roundtrip() -> str:
    text = _STRIP.format("text")
    return f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, {text} AS text FROM conversations WHERE role IN ('user', 'assistant') AND {text} <> ''"


def _window(frame: str) -> str:
    return f"""SELECT conv_id, turn, len(coalesce(r, []))::BIGINT AS n_recent, md5(array_to_string(coalesce(r, []), chr(10))) AS recent_md5
FROM (SELECT conv_id, turn, list(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {frame} PRECEDING AND 1 PRECEDING) AS r FROM ({_INGESTED}))"""


_HITS = f"""asked AS ({_SCORED}),
q AS (SELECT conv_id, turn, term, count(*) AS tf FROM (SELECT conv_id, turn, unnest({_TERMS.format("user_text")}) AS term FROM asked) GROUP BY ALL),
m AS (SELECT conv_id, turn, term, count(*) AS tf FROM (SELECT conv_id, turn, unnest({_TERMS.format("text")}) AS term FROM conversations) GROUP BY ALL),
qs AS (SELECT conv_id, turn, sqrt(sum(tf * tf)) AS size FROM q GROUP BY ALL), ms AS (SELECT conv_id, turn, sqrt(sum(tf * tf)) AS size FROM m GROUP BY ALL),
dots AS (SELECT q.conv_id, q.turn, m.turn AS m_turn, sum(q.tf * m.tf) AS dot FROM q JOIN m ON q.conv_id = m.conv_id AND q.term = m.term AND m.turn < q.turn GROUP BY ALL),
ranked AS (SELECT d.conv_id, d.turn, d.m_turn, dot / (qs.size * ms.size) AS score, row_number() OVER (PARTITION BY d.conv_id, d.turn ORDER BY round(dot / (qs.size * ms.size), 9) DESC, m_turn) AS rk
  FROM dots d JOIN qs ON qs.conv_id = d.conv_id AND qs.turn = d.turn JOIN ms ON ms.conv_id = d.conv_id AND ms.turn = d.m_turn),
hits AS (SELECT * FROM ranked WHERE rk <= 3)"""


def _cosine(k: int) -> str:
    return f"""scored AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM scored QUALIFY rk <= {k})"""


_PROXY = f"SELECT conv_id, turn, length(user_text) % 5 + 1 AS score FROM ({_SCORED})"
_BOARD = f"""WITH asked AS ({_SCORED}),
grid AS (SELECT row_number() OVER (ORDER BY min_tokens, max_tokens, k, ef_search) - 1 AS config_idx, * FROM (SELECT unnest([80, 120, 180]) AS min_tokens), (SELECT unnest([200, 300, 400]) AS max_tokens), (SELECT unnest([5, 10, 15]) AS k), (SELECT unnest([50, 100]) AS ef_search) WHERE min_tokens < max_tokens),
runs AS (SELECT config_idx, min_tokens, max_tokens, k, ef_search, count(*) AS n_scored, avg(score) AS mean_score, avg((score >= 4)::INT) AS recall_at_4
  FROM (SELECT grid.*, least(5, trunc(length(user_text) + k * max_tokens / 100)::INT % 5 + 1) AS score FROM grid, asked) GROUP BY ALL),
board AS (SELECT *, row_number() OVER (ORDER BY mean_score DESC, config_idx) AS place FROM runs)"""



def _replayed(limit: int, ks: list[int]) -> str:
    """A query of k, conv_id, turn, reply, n_retrieved and score: the default evaluation."""
    distinct = lambda x: f"list_distinct({_TERMS.format(x)})"
    return f"""WITH RECURSIVE {_chunks(limit, _TALK)},
asked AS ({_SCORED}),
qt AS (SELECT conv_id, turn, term, count(*) AS tf FROM (SELECT conv_id, turn, unnest({_TERMS.format("user_text")}) AS term FROM asked) GROUP BY ALL),
mt AS (SELECT conv_id, turn, pos, term, count(*) AS tf FROM (SELECT conv_id, turn, pos, unnest({_TERMS.format("text")}) AS term FROM chunks) GROUP BY ALL),
qz AS (SELECT conv_id, turn, sqrt(sum(tf * tf)) AS size FROM qt GROUP BY ALL), mz AS (SELECT conv_id, turn, pos, sqrt(sum(tf * tf)) AS size FROM mt GROUP BY ALL),
dot AS (SELECT qt.conv_id, qt.turn, mt.turn AS m_turn, mt.pos, sum(qt.tf * mt.tf) AS dot FROM qt JOIN mt ON qt.conv_id = mt.conv_id AND qt.term = mt.term AND mt.turn < qt.turn GROUP BY ALL),
placed AS (SELECT d.conv_id, d.turn, d.m_turn, d.pos, row_number() OVER (PARTITION BY d.conv_id, d.turn ORDER BY round(dot / (qz.size * mz.size), 9) DESC, m_turn, d.pos) AS rk
  FROM dot d JOIN qz ON qz.conv_id = d.conv_id AND qz.turn = d.turn JOIN mz ON mz.conv_id = d.conv_id AND mz.turn = d.m_turn AND mz.pos = d.pos),
hit AS (SELECT p.conv_id, p.turn, list(c.text ORDER BY rk) AS hits FROM placed p JOIN chunks c ON c.conv_id = p.conv_id AND c.turn = p.m_turn AND c.pos = p.pos WHERE rk <= {max(ks)} GROUP BY ALL),
past AS (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
told AS (SELECT a.conv_id, a.turn, a.reply AS expected, coalesce(hits[1], before, '') AS reply, coalesce(hits, []) AS hits FROM asked a LEFT JOIN hit h ON h.conv_id = a.conv_id AND h.turn = a.turn JOIN past p ON p.conv_id = a.conv_id AND p.turn = a.turn),
share AS (SELECT *, CASE WHEN len({distinct("expected")}) > 0 THEN len(list_intersect({distinct("expected")}, {distinct("reply")})) / len({distinct("expected")}) ELSE 0 END AS part FROM told)
SELECT k, conv_id, turn, substr(reply, 1, 500) AS reply, least(5, k, len(hits))::BIGINT AS n_retrieved, CASE WHEN part >= 0.8 THEN 5 WHEN part >= 0.6 THEN 4 WHEN part >= 0.4 THEN 3 WHEN part >= 0.2 THEN 2 ELSE 1 END::INTEGER AS score
FROM share, (SELECT unnest({ks}) AS k)"""


def _swept(min_tokens: list[int], max_tokens: list[int], ks: list[int], efs: list[int]) -> str:
    """The leaderboard of a grid of default evaluations."""
    runs = " UNION ALL ".join(f"SELECT {m} AS max_tokens, k, count(*) AS n_scored, avg(score) AS mean_score, avg((score >= 4)::INT) AS recall_at_4 FROM ({_replayed(m, ks)}) GROUP BY ALL" for m in max_tokens)
    return f"""WITH grid AS (SELECT row_number() OVER (ORDER BY min_tokens, max_tokens, k, ef_search) - 1 AS config_idx, * FROM (SELECT unnest({min_tokens}) AS min_tokens), (SELECT unnest({max_tokens}) AS max_tokens), (SELECT unnest({ks}) AS k), (SELECT unnest({efs}) AS ef_search) WHERE min_tokens < max_tokens),
runs AS ({runs}),
board AS (SELECT *, row_number() OVER (ORDER BY mean_score DESC, config_idx) AS place FROM grid JOIN runs USING (max_tokens, k))
SELECT place::INTEGER AS place, config_idx::INTEGER AS config_idx, min_tokens, max_tokens, k, ef_search, n_scored, round(mean_score, 6) AS mean_score, round(recall_at_4, 6) AS recall_at_4, place = 1 AS is_best FROM board"""


SQL = {
    "replay_eval": f"SELECT conv_id, turn, score, n_retrieved, md5(reply) AS reply_md5 FROM ({_replayed(250, [10])})",
    "replay_sweep": f"SELECT place, config_idx, max_tokens, k, ef_search, n_scored, mean_score, recall_at_4, is_best FROM ({_swept([10], [20, 40], [1, 5], [50, 100])})",
    "default_sweep": _swept([80, 120, 180], [200, 300, 400], [5, 10, 15], [50, 100]),
    "first_conversations": "SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT DISTINCT conv_id FROM conversations ORDER BY conv_id LIMIT 10)",
    "term_weights": f"SELECT conv_id, turn, term, round(count(*) / any_value(n), 6) AS weight FROM (SELECT conv_id, turn, len(l) AS n, unnest(l) AS term FROM (SELECT conv_id, turn, {_TERMS.format('text')} AS l FROM conversations)) GROUP BY conv_id, turn, term",
    "transcript_all": "SELECT * FROM conversations",
    "transcript_recent": "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20",
    "transcript_count": "SELECT count(*) AS n_turns FROM conversations",
    "turn_lookup": "SELECT sha256(conv_id || '|' || turn) AS turn_id, conv_id, role, text FROM conversations WHERE turn = 0",
    "role_validation": "SELECT role, count(*) AS n_turns, role IN ('user', 'assistant', 'system') AS valid FROM conversations GROUP BY role",
    "fk_check": "SELECT doc_id, doc_id IN (SELECT doc_id FROM documents) AS accepted FROM labels",
    "parse_txt_roundtrip": _roundtrip(),
    "parse_md_roundtrip": _roundtrip(),
    "token_counts": f"SELECT doc_id, {_TOKENS.format('text')}::BIGINT AS n_tokens FROM documents",
    "sentence_split": f"SELECT conv_id, turn, (i - 1)::INTEGER AS pos, l[i] AS sentence FROM (SELECT conv_id, turn, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT conv_id, turn, {_SENTENCES.format('text')} AS l FROM conversations))",
    "chunk_hardsplit": "WITH RECURSIVE "
    + _packed(
        f"SELECT k, i, w[i] AS w, {_TOKENS.format('w[i]')} AS n FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT conv_id || '/' || turn AS k, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM conversations))",
        "words", 12, "packed",
    )
    + " SELECT c.conv_id, c.turn, (g - 1)::INTEGER AS pos, piece FROM (SELECT packed.k, g, string_agg(w, ' ' ORDER BY packed.i) AS piece FROM packed JOIN words USING (k, i) GROUP BY packed.k, g) p JOIN conversations c ON p.k = c.conv_id || '/' || c.turn",
    "chunk_subsplit": "WITH RECURSIVE " + _parts(12, _TALK) + " SELECT conv_id, turn, (p - 1)::INTEGER AS pos, s AS piece, n::BIGINT AS n_tokens FROM part",
    "chunk_merge": _TALK_CHUNKS + " SELECT * FROM chunks",
    "chunk_stats": _TALK_CHUNKS + " SELECT conv_id, count(*) AS n_chunks, sum(token_count)::BIGINT AS n_tokens FROM chunks GROUP BY ROLLUP (conv_id)",
    "document_chunks": "WITH RECURSIVE " + _chunks(250, "SELECT doc_id AS conv_id, 0 AS turn, text FROM documents") + " SELECT conv_id AS doc_id, pos, start_char, end_char, token_count, md5(text) AS text_md5 FROM chunks",
    "stream_chunks": _TALK_CHUNKS + " SELECT conv_id, turn, pos, token_count FROM chunks",
    "ingest_counters": _TALK_CHUNKS + ", t AS (SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY 1), c AS (SELECT conv_id, count(*) AS n_chunks FROM chunks GROUP BY 1) SELECT conv_id, sum(n_turns)::BIGINT AS n_turns, sum(coalesce(n_chunks, 0))::BIGINT AS n_chunks FROM t LEFT JOIN c USING (conv_id) GROUP BY ROLLUP (conv_id)",
    "vector_norms": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings",
    "cosine_topk": f"WITH {_cosine(10)} SELECT query_id, rk::INTEGER AS rk, vec_id, round(score, 6) AS score FROM top",
    "hydrate_hits": f"WITH {_cosine(5)} SELECT query_id, rk::INTEGER AS rk, top.vec_id, label, source FROM top JOIN embeddings USING (vec_id) LEFT JOIN documents ON doc_id = top.vec_id",
    "ann_upkeep": f"WITH {_cosine(1)} SELECT stage, query_id, vec_id, round(score, 6) AS score FROM top CROSS JOIN (SELECT unnest(['before', 'after']) AS stage) s",
    "add_idempotent": "SELECT vec_id AS chunk_id, label FROM embeddings WHERE label % 2 = 1",
    "label_assignment": "SELECT vec_id, (SELECT max(vec_id) FROM embeddings WHERE label % 2 = 0) + row_number() OVER (ORDER BY vec_id) AS label FROM embeddings WHERE label % 2 = 1",
    "scored_turns": _SCORED,
    "replay_roles": f"SELECT conv_id, role, count(*) AS n_turns FROM ({_INGESTED}) GROUP BY ALL",
    "recent_window_4": _window("4"),
    "recent_window_all": _window("UNBOUNDED"),
    "english_segments": f"SELECT conv_id, turn, (i - 1)::INTEGER AS pos, l[i] AS sentence FROM (SELECT conv_id, turn, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT conv_id, turn, {_english('text')} AS l FROM conversations))",
    "english_chunks": f"WITH RECURSIVE {_chunks(40, _TALK, _english('text'))} SELECT conv_id, turn, pos, text, start_char, end_char, token_count FROM chunks",
    "hybrid_candidates": f"""WITH {_BM25},
v AS MATERIALIZED (SELECT doc_id, conv_id, role, [len(list_filter(p, lambda x: x = i))::DOUBLE FOR i IN range(64)] AS e FROM (SELECT doc_id, conv_id, role, list_transform(l, lambda t: ('0x' || substr(md5(t), 1, 6))::BIGINT % 64) AS p FROM d)),
near AS (SELECT q.doc_id AS query_id, v.doc_id, CASE WHEN list_sum(q.e) = 0 OR list_sum(v.e) = 0 THEN 0 ELSE list_cosine_similarity(q.e, v.e) END AS score FROM v AS q CROSS JOIN v WHERE q.conv_id % 100 = 0 AND q.role = 'user'),
one AS ({_best('near', 50)}), two AS ({_best('bm25', 50)})
SELECT query_id, doc_id, one.rk::INTEGER AS dense_rk, round(one.score, 6) AS dense_score, two.rk::INTEGER AS term_rk, round(two.score, 6) AS term_score FROM one FULL JOIN two USING (query_id, doc_id)""",
    "memory_verdicts": f"WITH {_OPS} SELECT conv_id, turn, seq, op, item, verdict FROM v",
    "memory_state": f"""WITH RECURSIVE {_OPS},
items AS MATERIALIZED (SELECT conv_id, item AS mem_id, 'Decision' AS kind, arg_max(content, ord) FILTER (op IN ('create', 'update')) AS content, arg_max(pin, ord) FILTER (op = 'pin') AS pin,
  CASE WHEN bool_or(op = 'delete') THEN 'deleted' WHEN bool_or(op = 'supersede') THEN 'superseded' ELSE 'active' END AS status, min(turn) AS created_at, max(turn) AS changed_at, arg_max(mem_id, ord) FILTER (op = 'supersede') AS successor, count(*) AS version FROM ok GROUP BY ALL),
walk AS (SELECT conv_id, mem_id, mem_id AS here, successor AS next, 0 AS step FROM items UNION ALL SELECT walk.conv_id, walk.mem_id, items.mem_id, items.successor, step + 1 FROM walk JOIN items ON items.conv_id = walk.conv_id AND items.mem_id = walk.next WHERE step < 20),
ends AS (SELECT conv_id, mem_id, coalesce(min(here) FILTER (next IS NULL), min(here) FILTER (step > 10)) AS head FROM walk GROUP BY ALL)
SELECT items.*, head FROM items JOIN ends USING (conv_id, mem_id)""",
    "memory_as_of": f"""WITH {_OPS},
s AS (SELECT t.conv_id, t.turn, ok.item, CASE WHEN bool_or(op = 'delete') THEN 'deleted' WHEN bool_or(op = 'supersede') THEN 'superseded' ELSE 'active' END AS status, arg_max(pin, ord) FILTER (op = 'pin') AS pin FROM conversations AS t JOIN ok ON ok.conv_id = t.conv_id AND ok.turn <= t.turn GROUP BY ALL)
SELECT conv_id, turn, count(*) FILTER (status = 'active') AS n_active, count(*) FILTER (status = 'superseded') AS n_superseded, count(*) FILTER (status = 'deleted') AS n_deleted, count(*) FILTER (status = 'active' AND pin = 'user_pinned') AS n_pinned FROM s GROUP BY ALL""",
    "memory_heat": f"""WITH {_OPS},
h AS (SELECT conv_id % 97 AS user_id, conv_id * 8 + item AS item, (conv_id // 97) * 3 + turn AS hour, sum(CASE op WHEN 'pin' THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END) AS w FROM o WHERE op <> 'delete' GROUP BY ALL),
clock AS (SELECT max((conv_id // 97) * 3 + turn) AS now FROM conversations),
e AS (SELECT a.user_id, a.item, a.hour, a.w, sum(b.w * pow(0.5, (a.hour - b.hour) / 6.0)) AS after FROM h AS a JOIN h AS b ON b.user_id = a.user_id AND b.item = a.item AND b.hour <= a.hour GROUP BY ALL),
points AS (SELECT user_id, item, hour * 2 AS at_, round(after - w, 9) AS e FROM e UNION ALL SELECT user_id, item, hour * 2 + 1, round(after, 9) FROM e),
last_ AS (SELECT user_id, item, arg_max(after, hour) * pow(0.5, ((SELECT now FROM clock) - max(hour)) / 6.0) AS raw, count(*) AS n_accesses FROM e GROUP BY ALL),
marks AS (SELECT user_id, item, round(raw, 9) AS energy, n_accesses, coalesce(max(at_) FILTER (e >= 0.75), -9) AS hot, coalesce(max(at_) FILTER (e < 0.65), -9) AS not_hot, coalesce(max(at_) FILTER (e < 0.25), -9) AS cold, coalesce(max(at_) FILTER (e >= 0.35), -9) AS not_cold FROM points JOIN last_ USING (user_id, item) GROUP BY ALL),
states AS (SELECT *, energy >= 0.75 OR energy >= 0.65 AND hot > not_hot AS is_hot, energy < 0.25 OR energy < 0.35 AND not_cold <= cold AS is_cold FROM marks)
SELECT user_id, item, round(energy, 6) AS energy, n_accesses, CASE WHEN is_hot AND count_if(is_hot) OVER (PARTITION BY user_id ORDER BY energy DESC, item ROWS UNBOUNDED PRECEDING) <= 5 THEN 'HOT' WHEN is_hot THEN 'WARM' WHEN is_cold THEN 'COLD' ELSE 'WARM' END AS tier FROM states""",
    "memory_quotes": """WITH x AS (SELECT conv_id, turn, text, trim(substr(text, 11, 30), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM conversations),
y AS (SELECT *, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS flat, regexp_extract(text, '(?i)' || regexp_replace(regexp_replace(said, '([^\\p{L}\\p{N}\\s])', '\\\\\\1', 'g'), '\\s+', '\\\\s+', 'g')) AS hit FROM x)
SELECT conv_id, turn, altered, CASE WHEN NOT altered AND said <> '' THEN (instr(text, hit) - 1)::INTEGER END AS first, CASE WHEN NOT altered AND said <> '' THEN (instr(text, hit) - 1 + length(hit))::INTEGER END AS last FROM y CROSS JOIN (SELECT unnest([false, true]) AS altered) a""",
    "context_packing": _context(),
    "bm25_topk": f"WITH {_BM25} SELECT query_id, rk::INTEGER AS rk, doc_id, round(score, 6) AS score FROM ({_best('bm25', 10)})",
    "online_replay": """WITH t AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, '') AS said FROM conversations),
        w AS (SELECT *, list(said) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS recent, lag(role) OVER o AS before, lag(text) OVER o AS question FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
        SELECT conv_id, turn::BIGINT AS turn, role, coalesce(len(recent), 0)::BIGINT AS n_recent, md5(coalesce(array_to_string(recent, '|'), '')) AS recent_md5, CASE WHEN role = 'assistant' AND text <> '' AND before = 'user' THEN md5(question) END AS asked_md5 FROM w""",
    "prior_retrieval": f"WITH {_HITS} SELECT conv_id, turn, rk::INTEGER AS rk, m_turn, round(score, 6) AS score FROM hits",
    "build_prompt": f"""WITH {_HITS},
found AS (SELECT h.conv_id, h.turn, string_agg('[Memory ' || rk || ']: ' || c.text, chr(10) ORDER BY rk) AS memory FROM hits h JOIN conversations c ON c.conv_id = h.conv_id AND c.turn = h.m_turn GROUP BY ALL),
past AS (SELECT conv_id, turn, list(role || '> ' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS r FROM ({_INGESTED})),
msg AS (SELECT a.conv_id, a.turn, list_concat(list_concat(list_concat(['system> SYSTEM'], CASE WHEN memory IS NULL THEN [] ELSE ['system> Relevant memory context:' || chr(10) || memory] END), coalesce(r, [])), ['user> ' || user_text]) AS l
  FROM asked a LEFT JOIN found f ON f.conv_id = a.conv_id AND f.turn = a.turn JOIN past p ON p.conv_id = a.conv_id AND p.turn = a.turn)
SELECT conv_id, turn, len(l)::BIGINT AS n_messages, array_to_string(l, chr(10)) AS prompt FROM msg""",
    "judge_parse": """WITH a AS (SELECT conv_id, turn, turn % 6 AS kind, CASE turn % 6 WHEN 2 THEN '{"score": 4, "reasoning": "fine"} and more' WHEN 3 THEN '{''score'': 4}' WHEN 4 THEN '{"score": null}' WHEN 5 THEN substr(regexp_replace(text, '[^A-Za-z .]', '', 'g'), 1, 300) END AS answer FROM conversations)
SELECT conv_id, turn, CASE WHEN kind = 0 THEN greatest(1, least(5, conv_id % 9)) ELSE 1 END::INTEGER AS score, CASE WHEN kind < 2 THEN 'fine' ELSE 'Failed to parse judge response: ' || substr(answer, 1, 200) END AS reasoning FROM a""",
    "conversation_scores": f"""WITH s AS ({_PROXY}) SELECT t.conv_id, num_turns, coalesce(n_scored, 0) AS n_scored, coalesce(mean_score, 0) AS mean_score, coalesce(scores_by_position, '') AS scores_by_position
FROM (SELECT conv_id, count(*) AS num_turns FROM conversations GROUP BY 1) t LEFT JOIN (SELECT conv_id, count(*) AS n_scored, round(avg(score), 6) AS mean_score, string_agg(score::VARCHAR, ',' ORDER BY turn) AS scores_by_position FROM s GROUP BY 1) USING (conv_id)""",
    "run_metrics": f"SELECT count(*) AS n_scored, round(avg(score), 6) AS mean_score, round(avg((score >= 4)::INT), 6) AS recall_at_4 FROM ({_PROXY})",
    "sweep_leaderboard": _BOARD + " SELECT place::INTEGER AS place, config_idx::INTEGER AS config_idx, min_tokens, max_tokens, k, ef_search, n_scored, round(mean_score, 6) AS mean_score, round(recall_at_4, 6) AS recall_at_4 FROM board",
    "best_config": _BOARD + " SELECT config_idx::INTEGER AS config_idx, min_tokens, max_tokens, k, ef_search FROM board WHERE place = 1",
    "truncate_results": f"SELECT doc_id, substr(text, 1, 500) AS head, array_to_string(list_transform({_SENTENCES.format('text')}[1:5], lambda x: substr(x, 1, 200)), chr(10)) AS first_five FROM documents",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n_events, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "role_adjacency": "SELECT role, next_role, count(*) AS n FROM (SELECT role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations) GROUP BY ALL",
}
