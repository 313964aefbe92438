"""DuckDB twins of the engine's queries, put together from shared common table expressions."""

from __future__ import annotations

from attestor.functions import facts as K
from attestor.operators.models import PROMPT, REPLY
from attestor.plans.fixtures import DECISIONS_SQL, RENDERED_SQL, REPLIES_SQL

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def sentence_list(text: str) -> str:
    """Kept sentences of a text as a list."""
    norm = f"trim(regexp_replace({text}, '{SPACE}+', ' ', 'g'))"
    cut = rf"string_split(regexp_replace({norm}, '([.!?]) ([A-Z])', '\1' || chr(30) || '\2', 'g'), chr(30))"
    return f"list_filter({cut}, lambda s: length(s) >= 16)"


def token_list(text: str) -> str:
    return f"list_filter(string_split(lower(trim(regexp_replace({text}, '{SPACE}+', ' ', 'g'))), ' '), lambda t: t <> '')"


SENT = f"sent AS (SELECT doc_id, i - 1 AS pos, s[i] AS sentence FROM (SELECT doc_id, {sentence_list('text')} AS s FROM documents) x, unnest(range(1, len(s) + 1)) AS r(i))"
LISTS = f"lists AS (SELECT doc_id, lang, {sentence_list('text')} AS s FROM documents)"
CHUNK = (
    "chunk AS (SELECT s.doc_id, s.pos AS idx, s.sentence || coalesce(' ' || n.sentence, '') AS text, p.parent FROM sent s "
    "LEFT JOIN sent n ON n.doc_id = s.doc_id AND n.pos = s.pos + 1 AND n.pos // 5 = s.pos // 5 "
    "JOIN (SELECT doc_id, pos // 5 AS para, string_agg(sentence, ' ' ORDER BY pos) AS parent FROM sent GROUP BY ALL) p ON p.doc_id = s.doc_id AND p.para = s.pos // 5)"
)
RESP = "resp AS (SELECT conv_id || '-' || turn AS response_id, conv_id AS doc_id, text FROM conversations WHERE role = 'assistant')"


def claim_cte(source: str, limit: int = 20) -> str:
    return (
        f"claim0 AS (SELECT response_id, doc_id, i AS pos, s[i] AS claim FROM (SELECT response_id, doc_id, {sentence_list('text')} AS s FROM {source}) x, unnest(range(1, len(s) + 1)) AS r(i)), "
        "claim1 AS (SELECT response_id, doc_id, claim, min(pos) AS pos FROM claim0 WHERE len(string_split(claim, ' ')) BETWEEN 9 AND 59 GROUP BY ALL), "
        f"claims AS (SELECT * FROM (SELECT response_id, doc_id, row_number() OVER (PARTITION BY response_id ORDER BY pos) - 1 AS claim_no, claim FROM claim1) WHERE claim_no < {limit})"
    )


CLAIMS = f"{RESP}, {claim_cte('resp')}"
def bm25_cte(documents: str) -> str:
    """Statistics by document of the chunks for which the condition on doc_id holds."""
    return (
        f"tok AS (SELECT doc_id, idx, unnest({token_list('text')}) AS token FROM chunk WHERE {documents}), "
        "tf AS (SELECT doc_id, idx, token, count(*) AS f FROM tok GROUP BY ALL), "
        "dl AS (SELECT doc_id, idx, sum(f) AS len FROM tf GROUP BY ALL), "
        "stats AS (SELECT doc_id, count(*) AS n_chunks, avg(len) AS avgdl FROM dl GROUP BY ALL), "
        "idf0 AS (SELECT doc_id, token, ln(n_chunks - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf JOIN stats USING (doc_id) GROUP BY doc_id, token, n_chunks), "
        "idf AS (SELECT doc_id, token, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY doc_id) ELSE raw END AS idf FROM idf0)"
    )


BM25 = (
    f"{bm25_cte('doc_id IN (SELECT doc_id FROM claims)')}, "
    f"q AS (SELECT response_id, claim_no, doc_id, token, count(*) AS n FROM (SELECT response_id, claim_no, doc_id, unnest({token_list('claim')}) AS token FROM claims) GROUP BY ALL), "
    "bm AS (SELECT response_id, claim_no, doc_id, idx, sum(n * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len / avgdl))) AS bm25 "
    "FROM q JOIN tf USING (doc_id, token) JOIN idf USING (doc_id, token) JOIN stats USING (doc_id) JOIN dl USING (doc_id, idx) GROUP BY ALL)"
)
SEMANTIC = (
    "qn AS (SELECT response_id, claim_no, sqrt(sum(n * n)) AS q_norm FROM q GROUP BY ALL), "
    "tn AS (SELECT doc_id, idx, sqrt(sum(f * f)) AS norm FROM tf GROUP BY ALL), "
    "sem AS (SELECT response_id, claim_no, doc_id, idx, sum(n * f) / (any_value(norm) * any_value(q_norm)) AS semantic "
    "FROM q JOIN tf USING (doc_id, token) JOIN tn USING (doc_id, idx) JOIN qn USING (response_id, claim_no) GROUP BY ALL)"
)


def hits_cte(k: int = 3) -> str:
    return (
        "pairs AS (SELECT c.response_id, c.claim_no, c.doc_id, c.claim, h.idx, h.text, h.parent, round(coalesce(semantic, 0), 9) AS semantic, round(coalesce(bm25, 0), 9) AS bm25 "
        "FROM claims c JOIN chunk h USING (doc_id) LEFT JOIN bm USING (response_id, claim_no, doc_id, idx) LEFT JOIN sem USING (response_id, claim_no, doc_id, idx)), "
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY response_id, claim_no ORDER BY semantic DESC, idx) AS near, max(bm25) OVER (PARTITION BY response_id, claim_no) AS top FROM pairs), "
        "texts AS (SELECT response_id, claim_no, doc_id, claim, text, min(idx) AS idx, "
        f"round(0.6 * coalesce(max(semantic) FILTER (near <= {2 * k}), 0) + 0.4 * max(bm25) / CASE WHEN any_value(top) > 0 THEN any_value(top) ELSE 1 END, 4) AS score, "
        f"coalesce(arg_max(parent, near) FILTER (near <= {2 * k}), text) AS parent FROM ranked GROUP BY response_id, claim_no, doc_id, claim, text), "
        f"hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY response_id, claim_no ORDER BY score DESC, idx) AS rank FROM texts) WHERE rank <= {k}), "
        "contexts AS (SELECT response_id, doc_id, claim_no, claim, string_agg(parent, ' ' ORDER BY rank) AS context FROM hits GROUP BY ALL)"
    )


ALL_HITS = f"{SENT}, {CHUNK}, {CLAIMS}, {BM25}, {SEMANTIC}, {hits_cte()}"
OVERLAP = f"len(list_intersect(list_distinct({token_list('claim')}), {token_list('parent')})) / greatest(len(list_distinct({token_list('claim')})), 1)"
NLI = (
    f"share AS (SELECT *, {OVERLAP} AS share FROM (SELECT *, row_number() OVER (PARTITION BY response_id, claim_no, parent ORDER BY rank) AS nth FROM hits) WHERE nth = 1), "
    "scored AS (SELECT *, CASE WHEN share >= 0.8 THEN 'ENTAILMENT' WHEN share <= 0.2 THEN 'CONTRADICTION' ELSE 'NEUTRAL' END AS label, "
    "round(CASE WHEN share >= 0.8 THEN share WHEN share <= 0.2 THEN 1 - share ELSE 1 - abs(2 * share - 1) END, 9) AS nli_score FROM share), "
    "best AS (SELECT response_id, doc_id, claim_no, claim, label AS nli_label, round_even(nli_score, 3) AS nli_score, parent AS evidence, label = 'CONTRADICTION' AS is_hallucinated FROM ("
    "SELECT *, row_number() OVER (PARTITION BY response_id, claim_no ORDER BY nli_score DESC, rank) AS b FROM scored WHERE rank = 1 OR label = 'CONTRADICTION') WHERE b = 1)"
)


def _distinct(text: str, pattern: str, group: int = 0) -> str:
    return f"list_sort(list_distinct(regexp_extract_all({text}, '{pattern}', {group})))"


_ABS = rf"\b({'|'.join(K.ABSOLUTES)})\b"
_SCALE = rf"\b(\d+)\s+({'|'.join(K.ENTITIES)})\b"


def bordered(text: str) -> str:
    """text with letters and numbers outside ASCII as `_`, since DuckDB's word borders know ASCII only; facts hold none of them."""
    return rf"regexp_replace(regexp_replace({text}, '[^\P{{L}}\x00-\x7F]', '_', 'g'), '[^\P{{N}}\x00-\x7F]', '_', 'g')"


def facts_sql(text: str) -> dict[str, str]:
    return {
        "percentages": _distinct(text, K.PERCENTAGE),
        "numbers": _distinct(text, K.NUMBER),
        "years": _distinct(text, K.YEAR, 1),
        "absolutes": _distinct(f"lower({text})", _ABS, 1),
        "stat_claims": f"list_transform(list_zip(regexp_extract_all({text}, '{K.STATISTIC}', 1), regexp_extract_all({text}, '{K.STATISTIC}', 2)), lambda z: z[1] || '|' || z[2])",
        "scale_claims": f"list_transform(list_zip(regexp_extract_all(lower({text}), '{_SCALE}', 1), regexp_extract_all(lower({text}), '{_SCALE}', 2)), lambda z: z[1] || '|' || z[2])",
        "organizations": f"regexp_extract_all({text}, '{K.ORGANIZATION}', 1)[1:20]",
    }


def compare_cte(rows: str) -> str:
    """Fact points and messages of rows(id, source, claim)."""
    c, s = facts_sql("claim"), facts_sql("source")
    scale = f"list_zip(regexp_extract_all(lower({{}}), '{_SCALE}', 1), regexp_extract_all(lower({{}}), '{_SCALE}', 2))"
    number = "regexp_replace({}, '^0+(.)', '\\1')"
    return (
        f"f AS (SELECT id, source, claim, {c['percentages']} AS cp, {s['percentages']} AS sp, {c['years']} AS cy, {s['years']} AS sy, {c['absolutes']} AS ca, "
        f"{scale.format('claim', 'claim')} AS cs, {scale.format('source', 'source')} AS ss, {c['organizations']} AS co FROM {rows}), "
        "g AS (SELECT id, sp, ca, list_filter(cp, lambda p: NOT list_contains(sp, p)) AS p, list_filter(cy, lambda y: NOT list_contains(sy, y)) AS y, "
        f"list_filter(cs, lambda x: len(list_filter(ss, lambda z: z[2] = x[2])) > 0 AND len(list_filter(ss, lambda z: z[2] = x[2] AND {number.format('z[1]')} = {number.format('x[1]')})) = 0) AS sc, ss, "
        r"list_filter(co, lambda o: len(string_split_regex(o, '\s+')) >= 3 AND NOT contains(lower(source), lower(o))) AS o FROM f), "
        "compared AS (SELECT id, CAST(least(100, len(p) * CASE WHEN len(sp) > 0 THEN 40 ELSE 30 END + len(y) * 20 + len(sc) * 35 + len(o) * 25 + len(ca) * 10) AS BIGINT) AS points, "
        "list_transform(p, lambda x: CASE WHEN len(sp) > 0 THEN 'Stat not in source: ''' || x || ''' (source has: ' || array_to_string(sp[1:3], ', ') || ')' ELSE 'Fabricated stat: ''' || x || '''' END) "
        "|| list_transform(y, lambda x: 'Year not in source: ''' || x || '''') "
        f"|| list_transform(sc, lambda x: 'Scale mismatch for ''' || x[2] || ''': claim=' || x[1] || ', source=[' || array_to_string(list_transform(list_filter(ss, lambda z: z[2] = x[2]), lambda z: {number.format('z[1]')}), ', ') || ']') "
        "|| list_transform(o, lambda x: 'Unknown organization: ''' || x || '''') "
        "|| CASE WHEN len(ca) > 0 THEN ['Absolute language detected: [' || array_to_string(list_transform(ca, lambda x: '''' || x || ''''), ', ') || ']'] ELSE [] END AS signals, p, y, sc, o, ca, sp FROM g)"
    )


CONTEXT_FACTS = "fact_rows AS (SELECT response_id || '#' || claim_no AS id, context AS source, claim FROM contexts), " + compare_cte("fact_rows")


def lit(text: str) -> str:
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in text.split("\n"))


def stripped(value: str) -> str:
    return f"regexp_replace({value}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def reply_field(raw: str, prefix: str, default: str) -> str:
    last = f"list_filter(string_split({stripped(raw)}, chr(10)), lambda x: starts_with(x, '{prefix}'))[-1]"
    return "coalesce(" + stripped(f"replace({last}, '{prefix}', '')") + f", '{default}')"


REPLY_SQL = {name: reply_field("raw", prefix, default) for name, (prefix, default) in REPLY.items()}
REPLY_ROWS = f"{RENDERED_SQL}, {REPLIES_SQL}"

#: Needs nli_label, nli_score, points, signals, judged (0 or 1), llm_verdict, reasoning, confidence, correction, evidence.
NEEDS = "points >= 40 OR NOT ((nli_label = 'ENTAILMENT' AND nli_score >= 0.85 AND points < 20) OR (nli_label = 'CONTRADICTION' AND nli_score >= 0.92))"
FUSE = """fused0 AS (
  SELECT *, CASE WHEN nli_label = 'CONTRADICTION' THEN 1 ELSE 0 END AS c, CASE WHEN judged = 1 AND llm_verdict = 'HALLUCINATED' THEN 1 ELSE 0 END AS h, points / 100.0 AS f,
    CASE WHEN judged = 1 THEN coalesce(reasoning, '') ELSE '' END AS why, CASE WHEN judged = 1 THEN coalesce(correction, 'N/A') ELSE 'N/A' END AS fix, array_to_string(signals[1:2], '; ') AS two
  FROM to_fuse),
fused1 AS (SELECT *, CASE
    WHEN points >= 80 OR (points >= 50 AND c + h > 0) THEN 1
    WHEN nli_label = 'ENTAILMENT' AND nli_score >= 0.85 AND points < 20 THEN 2
    WHEN c = 1 AND nli_score >= 0.85 THEN 3 WHEN judged = 1 THEN 4 ELSE 5 END AS kase FROM fused0),
fused AS (SELECT *, kase AS "case",
    CASE kase WHEN 1 THEN 'Hallucinated' WHEN 2 THEN 'Supported' WHEN 3 THEN 'Hallucinated' WHEN 4 THEN CASE c + h WHEN 2 THEN 'Hallucinated' WHEN 1 THEN 'Uncertain' ELSE 'Supported' END ELSE 'Uncertain' END AS verdict,
    CAST(printf('%.2f', CASE kase WHEN 1 THEN least(CAST(0.5 AS DOUBLE) * f + CAST(0.3 AS DOUBLE) * c + CAST(0.2 AS DOUBLE) * h, 1.0) WHEN 2 THEN 0.0
      WHEN 3 THEN least(CAST(0.6 AS DOUBLE) + CAST(0.2 AS DOUBLE) * f + CAST(0.2 AS DOUBLE) * h, 1.0) WHEN 4 THEN CAST(0.4 AS DOUBLE) * c + CAST(0.35 AS DOUBLE) * h + CAST(0.25 AS DOUBLE) * f
      ELSE CAST(0.3 AS DOUBLE) + CAST(0.2 AS DOUBLE) * f END) AS DOUBLE) AS hallucination_score,
    CASE kase WHEN 1 THEN CASE WHEN points * 50 + c * 3000 + h * 2000 >= 6000 THEN 'HIGH' ELSE 'MEDIUM' END WHEN 4 THEN coalesce(confidence, 'MEDIUM') WHEN 5 THEN 'LOW' ELSE 'HIGH' END AS sure,
    CASE kase WHEN 1 THEN 'Fact check failed: ' || two || CASE WHEN why <> '' THEN ' | ' || why ELSE '' END
      WHEN 2 THEN 'Source directly supports this claim.'
      WHEN 3 THEN 'Source contradicts this claim.' || CASE WHEN len(signals) > 0 THEN ' | ' || two ELSE '' END || CASE WHEN why <> '' THEN ' | ' || why ELSE '' END
      WHEN 4 THEN CASE WHEN c <> h THEN '[Models disagree] ' ELSE '' END || why || CASE WHEN len(signals) > 0 THEN ' | Fact issues: ' || two ELSE '' END
      ELSE 'Insufficient evidence. ' || CASE WHEN len(signals) > 0 THEN two ELSE '' END END AS explanation,
    CASE WHEN kase IN (1, 3, 4) THEN fix ELSE 'N/A' END AS given_correction, CASE WHEN kase IN (1, 3, 4) THEN why ELSE '' END AS given_reasoning,
    CASE WHEN kase = 2 THEN '' ELSE array_to_string(signals, '; ') END AS fact_signals,
    CASE kase WHEN 1 THEN judged = 1 WHEN 3 THEN judged = 1 WHEN 4 THEN true ELSE false END AS llm_used FROM fused1)"""

VERIFY = (
    f"{ALL_HITS}, {NLI}, {CONTEXT_FACTS}, "
    f"gated AS (SELECT b.*, points, signals, {NEEDS} AS needs FROM best b JOIN compared ON id = response_id || '#' || claim_no), "
    "ruled AS (SELECT *, nli_label = 'CONTRADICTION' OR points >= 50 AS wrong FROM gated), "
    "to_fuse AS (SELECT c.response_id, c.doc_id, c.claim_no, c.claim, coalesce(nli_label, 'NEUTRAL') AS nli_label, coalesce(nli_score, 0) AS nli_score, coalesce(points, 0) AS points, coalesce(signals, []) AS signals, "
    "coalesce(evidence, '') AS evidence, coalesce(needs, false) AS needs_judge, CASE WHEN needs THEN 1 ELSE 0 END AS judged, CASE WHEN wrong THEN 'HALLUCINATED' ELSE 'SUPPORTED' END AS llm_verdict, 'The evidence was compared with the claim.' AS reasoning, "
    "CASE WHEN nli_score >= 0.9 THEN 'HIGH' WHEN nli_score >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, "
    f"CASE WHEN wrong THEN regexp_replace(left(evidence, 80), '^{SPACE}+|{SPACE}+$', '', 'g') ELSE 'N/A' END AS correction FROM claims c LEFT JOIN ruled r USING (response_id, doc_id, claim_no)), {FUSE}"
)
SUMMARY = (
    f"{VERIFY}, per AS (SELECT response_id, count(*) AS total_claims, count(*) FILTER (verdict = 'Hallucinated') AS hallucinated, count(*) FILTER (verdict = 'Uncertain') AS uncertain, "
    "count(*) FILTER (verdict = 'Supported') AS supported, count(*) FILTER (needs_judge) AS llm_calls_made FROM fused GROUP BY ALL), "
    "summary AS (SELECT r.response_id, r.doc_id, coalesce(total_claims, 0) AS total_claims, coalesce(hallucinated, 0) AS hallucinated, coalesce(uncertain, 0) AS uncertain, coalesce(supported, 0) AS supported, "
    "coalesce(llm_calls_made, 0) AS llm_calls_made, coalesce(total_claims - llm_calls_made, 0) AS llm_calls_saved, coalesce(round_even(hallucinated / total_claims * 100, 1), 0.0) AS hallucination_rate FROM resp r LEFT JOIN per p USING (response_id))"
)
DENSITY = (
    "placed AS (SELECT response_id, verdict, row_number() OVER (PARTITION BY response_id ORDER BY claim_no) - 1 AS pos, count(*) OVER (PARTITION BY response_id) AS n FROM fused), "
    "density AS (SELECT response_id, 'S' || (pos // greatest(1, n // 5) + 1) AS section, round_even(count(*) FILTER (verdict = 'Hallucinated') / count(*) * 100, 1) AS density, count(*) AS claims FROM placed GROUP BY ALL)"
)


def prompt_sql(source: str, claim: str) -> str:
    head, rest = PROMPT.split("{source}")
    middle, tail = rest.split("{claim}")
    return f"{lit(head)} || {source} || {lit(middle)} || {claim} || {lit(tail)}"


GRID = DECISIONS_SQL
