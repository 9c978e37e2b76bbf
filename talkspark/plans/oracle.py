"""Plain SQL statements of the same results, for comparison on the shared tables.

Each query is a short final SELECT over named common table expressions; ``build`` collects the
ones it needs.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def build(final: str) -> str:
    order: list[str] = []

    def visit(sql: str, seen: tuple[str, ...]) -> None:
        for word in dict.fromkeys(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", sql)):
            if word in CTES and word not in seen and word not in order:
                visit(CTES[word], (*seen, word))
                order.append(word)

    visit(final, ())
    if not order:
        return final.strip()

    def head(name: str) -> str:
        # a recursive expression names its columns in its first line: "-- (a, b)"
        first = CTES[name].split("\n", 1)[0]
        return name + first[3:] if first.startswith("-- (") else name

    def body(name: str) -> str:
        kind = "" if CTES[name].startswith("-- (") else " MATERIALIZED"
        return f"{head(name)} AS{kind} ({CTES[name]})"

    return "WITH RECURSIVE " + ",\n".join(map(body, order)) + "\n" + final.strip()


# --- base views -----------------------------------------------------------------------------

cte("v_tok", r"""
SELECT conv_id, turn, role, unnest(l) AS orig, unnest(range(len(l))) AS p
FROM (SELECT conv_id, turn, role, regexp_extract_all(text, '\S+') AS l FROM conversations)
""")
cte("v_words", r"""
SELECT video_id, idx, text, start_ms, start_ms + 150 + (length(orig) * 37) % 230 AS end_ms,
  start_ms / 1e3 AS start_s, (start_ms + 150 + (length(orig) * 37) % 230) / 1e3 AS end_s,
  role AS speaker, role AS speaker_global,
  CASE WHEN idx % 101 = 50 THEN 'unresolved' WHEN turn % 3 = 1 THEN 'inferred'
    ELSE 'confirmed' END AS speaker_status, 'gemini' AS origin
FROM (SELECT conv_id AS video_id, idx, turn, role, orig,
    CASE WHEN p = 0 AND turn % 4 IN (2, 3) THEN '라는'
      WHEN idx % 41 = 7 THEN ['torch','GPT-4.1','ConvNetJS','ResNet50'][(idx // 41) % 4 + 1]
      WHEN idx % 53 = 11 THEN '1,200' WHEN idx % 89 = 20 THEN '보시면' ELSE orig END AS text,
    idx * 400 + (turn // 4) * 6200 + [500,1400,3200,6200][turn % 4 + 1] AS start_ms
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, p) - 1 AS idx FROM v_tok))
""")
cte("v_cues", r"""
SELECT video_id, idx // 6 AS cue_idx, min(start_ms) AS cue_start_ms, max(end_ms) + 400 AS cue_end_ms,
  min(start_ms) / 1e3 AS cue_start, (max(end_ms) + 400) / 1e3 AS cue_end,
  string_agg(CASE text WHEN 'torch' THEN 'PyTorch' WHEN '라는' THEN 'self supervised 라는' ELSE text END,
    ' ' ORDER BY idx) AS cue_text
FROM v_words GROUP BY 1, 2
""")
cte("v_total", "SELECT video_id, max(end_s) AS total_s FROM v_words GROUP BY 1")
cte("v_chunks", r"""
SELECT video_id, chunk_index, n AS n_chunks,
  round(CASE WHEN chunk_index = 0 THEN 0 ELSE greatest(0, chunk_index * core - 10e0) END, 6) AS chunk_start,
  round(CASE WHEN chunk_index = n - 1 THEN total_s ELSE (chunk_index + 1) * core END, 6) AS chunk_end
FROM (SELECT *, total_s / n AS core, unnest(range(n)) AS chunk_index FROM (
  SELECT video_id, total_s, (SELECT min(k) FROM range(1, 2000) t(k)
    WHERE k >= greatest(1, ceil(total_s / 90e0)) AND (k = 1 OR total_s / k + 10e0 <= 90e0)) AS n FROM v_total))
""")
cte("v_cw", r"""
SELECT w.video_id, c.chunk_index, c.chunk_start, c.chunk_end, w.idx AS pos, w.text, w.start_ms, w.end_ms,
  w.start_s, w.end_s, 'spk:' || ((CASE speaker WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END
    + c.chunk_index) % 3) AS speaker_raw
FROM v_words w JOIN v_chunks c ON w.video_id = c.video_id AND w.start_s >= c.chunk_start
  AND w.start_s < c.chunk_end
""")
cte("v_rw", r"""
SELECT video_id, chunk_index, chunk_start, chunk_end, pos, text,
  CASE WHEN pos % 307 = 5 THEN '22979s' ELSE (rs // 1000) || '.' || lpad((rs % 1000)::VARCHAR, 3, '0') || 's' END
    AS start_offset,
  CASE WHEN pos % 211 <> 3 THEN (re // 1000) || '.' || lpad((re % 1000)::VARCHAR, 3, '0') || 's' END AS end_offset,
  speaker_raw AS speaker
FROM (SELECT *, greatest(0, start_ms - round(chunk_start * 1000)::BIGINT) AS rs,
  greatest(0, end_ms - round(chunk_start * 1000)::BIGINT) AS re FROM v_cw)
""")
cte("v_videos", r"""
SELECT DISTINCT conv_id AS video_id,
  CASE conv_id % 4 WHEN 1 THEN 'en' WHEN 2 THEN 'ko' WHEN 3 THEN 'fr' END AS language,
  CASE WHEN conv_id % 3 = 0 THEN ['en-orig'] ELSE []::VARCHAR[] END AS auto_caption_langs,
  CASE conv_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS playable_in_embed
FROM conversations
""")
cte("v_tracks", r"""
SELECT video_id, video_id % 10 <> 9 AS original,
  CASE WHEN video_id % 10 <> 9 THEN 'en-orig' ELSE 'ko' END AS language,
  CASE WHEN video_id % 13 = 0 THEN 'fetch failed' END AS error FROM v_videos
""")
cte("v_frames", r"""
SELECT a.video_id, a.idx // 120 AS frame_no, a.start_s AS frame_at,
  a.text || coalesce(' ' || b.text, '') AS ocr_text, (a.idx // 120) % 3 AS conf_kind
FROM v_words a LEFT JOIN v_words b ON a.video_id = b.video_id AND b.idx = a.idx + 1
WHERE a.idx % 120 = 60
""")
cte("v_questions", r"""
SELECT 'b' || item_id AS question_id, text AS query FROM benchmark
UNION ALL SELECT * FROM (VALUES ('f0','PyTorch'), ('f1','1,200'), ('f2','라는'), ('f3','zzzunseen')) t(question_id, query)
""")
cte("v_attempts", r"""
SELECT 'k' || (user_id % 5) AS key_hash, event_id, ts,
  (ts::TIMESTAMP AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles')::DATE::VARCHAR AS pday
FROM events
""")
cte("v_guard", r"""
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN repeat('안녕하세요 여러분 ', 10) ELSE text END AS text,
  CASE WHEN doc_id % 7 = 0 THEN 'ko' ELSE lang END AS langs FROM documents
""")

# --- segmentation ---------------------------------------------------------------------------

END = "[.!?。！？요다][\"''’”)]*$"  # quotes doubled for SQL

cte("v_lag", r"""
SELECT *, lag(end_s) OVER p AS pe, lag(text) OVER p AS pt, lag(speaker) OVER p AS psp,
  lead(start_s) OVER p AS ns, lead(text) OVER p AS nt, lead(speaker) OVER p AS nsp
FROM v_words WINDOW p AS (PARTITION BY video_id ORDER BY idx)
""")
cte("v_brk", f"""
SELECT video_id, idx, text, start_s, end_s, regexp_matches(text, '{END}') AS is_end, start_s - pe AS gap,
  pe IS NULL OR start_s - pe > 1.2e0 OR regexp_matches(pt, '{END}') AS brk FROM v_lag
""")
cte("v_chsent", r"""
SELECT video_id, grp, min_by(start_s, idx) AS s_start, max_by(end_s, idx) AS s_end,
  string_agg(text, ' ' ORDER BY idx) AS s_text, count(*) AS n_words
FROM (SELECT *, island + ((idx - island) // 35) * 35 AS grp FROM (
  SELECT *, max(CASE WHEN brk THEN idx END) OVER (PARTITION BY video_id ORDER BY idx) AS island FROM v_brk))
GROUP BY 1, 2
""")
cte("v_next5", r"""
SELECT b.video_id, b.idx, CASE WHEN stop_at - b.idx < 34 OR (stop_at - b.idx = 34 AND stop_is_end)
    OR n_left < 35 THEN stop_at + 1
  ELSE (SELECT g.idx FROM v_brk g WHERE g.video_id = b.video_id AND g.idx BETWEEN b.idx + 25 AND b.idx + 34
    ORDER BY g.gap DESC, g.idx LIMIT 1) END AS nxt
FROM (SELECT *, min(CASE WHEN stop THEN idx END) OVER f AS stop_at, arg_min(is_end, CASE WHEN stop THEN idx END) OVER f
    AS stop_is_end, count(*) OVER f AS n_left
  FROM (SELECT *, is_end OR coalesce(lead(gap) OVER (PARTITION BY video_id ORDER BY idx) > 1.2e0, true) AS stop
    FROM v_brk)
  WINDOW f AS (PARTITION BY video_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) b
""")
cte("v_walk5", """-- (video_id, grp)
SELECT video_id, idx FROM v_brk WHERE idx = 0
UNION ALL
SELECT n.video_id, n.nxt FROM v_walk5 w JOIN v_next5 n ON n.video_id = w.video_id AND n.idx = w.grp
  JOIN v_brk b ON b.video_id = n.video_id AND b.idx = n.nxt
""")
cte("v_grp5", r"""
SELECT w.*, max(s.grp) OVER (PARTITION BY w.video_id ORDER BY w.idx) AS grp
FROM v_words w LEFT JOIN v_walk5 s ON s.video_id = w.video_id AND s.grp = w.idx
""")
cte("v_sent", r"""
SELECT *, 's-' || left(sha1(round(s_start * 1000)::BIGINT || '|' || round(s_end * 1000)::BIGINT || '|' || s_text), 12)
  AS sentence_key, row_number() OVER (PARTITION BY video_id ORDER BY grp) AS no
FROM (SELECT video_id, grp, min_by(start_s, idx) AS s_start, max_by(end_s, idx) AS s_end,
  string_agg(text, ' ' ORDER BY idx) AS s_text, count(*) AS n_words FROM v_grp5 GROUP BY 1, 2)
""")
cte("v_walk6", """-- (video_id, idx, grp, g_start)
SELECT video_id, idx, idx, start_s FROM v_lag WHERE idx = 0
UNION ALL
SELECT n.video_id, n.idx,
  CASE WHEN n.start_s - n.pe > 2.5e0 OR n.end_s - w.g_start > 30e0 OR n.speaker <> n.psp THEN n.idx ELSE w.grp END,
  CASE WHEN n.start_s - n.pe > 2.5e0 OR n.end_s - w.g_start > 30e0 OR n.speaker <> n.psp THEN n.start_s
    ELSE w.g_start END
FROM v_walk6 w JOIN v_lag n ON n.video_id = w.video_id AND n.idx = w.idx + 1
""")
cte("v_spans", r"""
SELECT video_id, grp AS span_idx, start_s, end_s, text,
  CASE WHEN speaker_status <> 'unresolved' THEN cand END AS speaker, cand AS speaker_candidate, speaker_status,
  CASE speaker_status WHEN 'confirmed' THEN 1e0 WHEN 'inferred' THEN 0.75e0 ELSE 0e0 END AS speaker_confidence,
  1e0 AS confidence
FROM (SELECT w.video_id, s.grp, min_by(w.start_s, w.idx) AS start_s, max_by(w.end_s, w.idx) AS end_s,
    string_agg(w.text, ' ' ORDER BY w.idx) AS text, min_by(w.speaker_global, w.idx) AS cand,
    CASE WHEN bool_or(speaker_status = 'unresolved') THEN 'unresolved'
      WHEN bool_or(speaker_status = 'inferred') THEN 'inferred' ELSE 'confirmed' END AS speaker_status
  FROM v_words w JOIN v_walk6 s USING (video_id, idx) GROUP BY 1, 2)
""")
cte("v_walk7", """-- (video_id, idx, grp, g_start, n_lines, room)
SELECT video_id, idx, idx, start_s, 1, length(text) FROM v_lag WHERE idx = 0
UNION ALL
SELECT video_id, idx, CASE WHEN fresh THEN idx ELSE grp END, CASE WHEN fresh THEN start_s ELSE g_start END,
  CASE WHEN fresh THEN 1 ELSE n2 END, CASE WHEN fresh THEN size ELSE r2 END
FROM (SELECT n.video_id, n.idx, n.start_s, w.grp, w.g_start, length(n.text) AS size,
    w.n_lines + CASE WHEN w.room + 1 + length(n.text) > 20 THEN 1 ELSE 0 END AS n2,
    CASE WHEN w.room + 1 + length(n.text) > 20 THEN length(n.text) ELSE w.room + 1 + length(n.text) END AS r2,
    n.speaker <> n.psp OR n.start_s - n.pe > 0.65e0 OR n.end_s - w.g_start > 7e0
      OR w.n_lines + CASE WHEN w.room + 1 + length(n.text) > 20 THEN 1 ELSE 0 END > 2 AS fresh
  FROM v_walk7 w JOIN v_lag n ON n.video_id = w.video_id AND n.idx = w.idx + 1)
""")
cte("v_rcues", r"""
SELECT video_id, grp, row_number() OVER (PARTITION BY video_id ORDER BY grp) AS cue_no, c_start, c_end, lines, plain,
  n_words FROM (
SELECT video_id, grp, min(c_start) AS c_start, max(c_end) AS c_end, string_agg(line, chr(10) ORDER BY n_lines) AS lines,
  string_agg(line, ' ' ORDER BY n_lines) AS plain, sum(n) AS n_words
FROM (SELECT w.video_id, s.grp, s.n_lines, min(w.start_s) AS c_start, max_by(w.end_s, w.idx) AS c_end,
    string_agg(w.text, ' ' ORDER BY w.idx) AS line, count(*) AS n
  FROM v_words w JOIN v_walk7 s USING (video_id, idx) GROUP BY 1, 2, 3) GROUP BY 1, 2)
""")
cte("v_gaps", r"""
SELECT video_id, idx AS gap_idx, end_s AS gap_start, ns AS gap_end,
  CASE WHEN speaker = nsp THEN speaker END AS gap_speaker
FROM v_lag WHERE ns - end_s > 1.5e0
  AND regexp_matches(regexp_replace(trim(nt), '^[.,!?;:()\[\]{}"'']+', ''), '^(이라는|라는|이라고|라고|의|와|과|을|를)')
""")
cte("v_breath", r"""
SELECT video_id, grp, idx AS breath_idx, start_s AS breath_at, row_number() OVER (PARTITION BY video_id, grp ORDER BY idx) AS k
FROM (SELECT *, max(CASE WHEN b THEN start_s END) OVER (PARTITION BY video_id, grp ORDER BY idx
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM (SELECT *, coalesce(start_s - lag(end_s) OVER q >= 0.3e0 OR regexp_matches(lag(text) OVER q, '[,;:]\s*$'), false) AS b
    FROM v_grp5 WINDOW q AS (PARTITION BY video_id, grp ORDER BY idx)))
WHERE b AND (seen IS NULL OR start_s > seen)
""")
