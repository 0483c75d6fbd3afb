"""Redaction and audit on ``documents`` and ``conversations``.

A source is a session and a document one of its turns, so sessions are large.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ragspark import fixed
from ragspark.functions.numbers import keyed_hash
from ragspark.functions.pii import only
from ragspark.operators import audit, pii_eval, redaction, reports
from ragspark.plans import conversation
from ragspark.queries.registry import query
from ragspark.session import materialise, shared_folder
from ragspark.streaming import sessions

KEY = b"ragspark-demo-key"

# E-mail and card detectors with their word boundaries spelled out, because the
# oracle's regular expressions have only ASCII boundaries.
W = r"\p{L}\p{N}_"
EMAIL = rf"[{W}][{W}.+-]*@[{W}-]+\.[{W}.-]*[{W}]"
CARD = rf"(?:^|[^{W}])(\d(?:[ -]?\d){{12,18}})\b"
FOUND_SQL = rf"""
emails AS (
  SELECT source, doc_id, 0 AS det, generate_subscripts(m, 1) AS pos, 'EMAIL' AS entity_type, unnest(m) AS value
  FROM (SELECT *, regexp_extract_all(text, '{EMAIL}') AS m FROM documents)),
numbers AS (
  SELECT source, doc_id, 1 AS det, generate_subscripts(m, 1) AS pos, 'CARD' AS entity_type, unnest(m) AS value
  FROM (SELECT *, regexp_extract_all(regexp_replace(text, '{EMAIL}', '[E]', 'g'), '{CARD}', 1) AS m FROM documents)),
cards AS (
  SELECT * FROM numbers WHERE list_sum(list_transform(
    list_reverse(string_split(regexp_replace(value, '[^0-9]', '', 'g'), '')),
    lambda d, i: CASE WHEN i % 2 = 1 THEN d::INT WHEN d::INT > 4 THEN d::INT * 2 - 9 ELSE d::INT * 2 END)) % 10 = 0),
found AS (SELECT * FROM emails UNION ALL SELECT * FROM cards)
"""


def _texts(t):
    return _as_texts(t.documents)


def _as_texts(documents):
    return documents.select(
        F.col("source").alias("session_id"), F.col("doc_id").alias("turn"), F.lit(0).alias("pass_no"), "text"
    )


@query("redact_counts", f"""
WITH {FOUND_SQL}
SELECT source AS session_id, entity_type, count(*) AS count FROM found GROUP BY ALL""")
def redact_counts(t):
    texts = redaction.redact(_texts(t), only("EMAIL", "CARD")).texts
    return redaction.detection_totals(texts, ["session_id"])


# All ten detectors in SQL. Every non-word character is doubled first, so that two
# matches never compete for the boundary between them. Each step sees the text
# with earlier matches replaced by tokens; vetoed matches are replaced as well,
# which on these texts hides nothing from later steps.
NON_WORD = rf"[^{W}]"
B, E = rf"(?:^|{NON_WORD})", rf"(?:$|{NON_WORD})"
STOP = "[" + ", ".join(f"'{w}'" for w in fixed.NAME_STOPWORDS) + "]"
GAP = rf"(?:{NON_WORD}{{2}})"


def _doubled(pattern: str) -> str:
    return rf"{B}({pattern}){E}"


STREETS = fixed.DETECTOR_PATTERNS[7][1].rsplit("(?:", 1)[1].split(")")[0]
STEPS = [  # entity type, pattern over the doubled text, veto in SQL
    ("EMAIL", rf"[{W}](?:[{W}]|\.\.|\+\+|--)*@@(?:[{W}]|--)+\.\.(?:[{W}]|\.\.|--)*[{W}]", "true"),
    ("NINO", r"[A-Za-z]{2}(?:\s\s)?\d{2}(?:\s\s)?\d{2}(?:\s\s)?\d{2}(?:\s\s)?[A-Da-d]",
     "regexp_full_match(upper(replace(v, ' ', '')), '[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\\d{6}[A-D]') AND upper(replace(v, ' ', ''))[1:2] NOT IN "
     "('BG', 'GB', 'NK', 'KN', 'TN', 'NT', 'ZZ')"),
    ("CARD", r"\d(?:(?:  |--)?\d){12,18}",
     "list_sum(list_transform(list_reverse(string_split(regexp_replace(v, '[^0-9]', '', 'g'), '')), "
     "lambda d, i: CASE WHEN i % 2 = 1 THEN d::INT WHEN d::INT > 4 THEN d::INT * 2 - 9 ELSE d::INT * 2 END)) % 10 = 0"),
    ("SORT_CODE", r"\d{2}(?:--|  )\d{2}(?:--|  )\d{2}", "true"),
    ("ACCOUNT", r"(?i:account)(?:\s+(?:(?i:number)|(?i:no)(?:\.\.)?|##))?\s*(?:::|--)?\s*\d{8}", "true"),
    ("PHONE", r"(?:\(\()?0\d{2,4}(?:\)\))?(?:\s\s|--)?\d{3,4}(?:\s\s|--)?\d{3,4}", "true"),
    ("POSTCODE", r"[A-Za-z][A-Ha-hJ-Yj-y]?[0-9][A-Za-z0-9]?(?:\s\s)?[0-9][A-Za-z]{2}|[Gg][Ii][Rr](?:\s\s)?0[Aa]{2}", "true"),
    ("ADDRESS", rf"\d{{1,4}}[A-Za-z]?\s+(?:[A-Z][a-z]+\s+){{0,3}}(?:{STREETS})", "true"),
    ("NAME", r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof)(?:\.\.)?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}", "true"),
    ("NAME", r"[A-Z][a-z]+\s+[A-Z][a-z]+",
     f"len(list_intersect(list_transform(string_split_regex(v, '\\s+'), lambda w: lower(w)), {STOP})) = 0"),
]


def _all_detectors_sql() -> str:
    """Counts per detector. A match is marked in place, so later steps cannot see it."""
    steps = []
    for i, (kind, pattern, veto) in enumerate(STEPS):
        found = f"regexp_extract_all(t{i}, '{_doubled(pattern)}', 1)"
        steps.append(
            f"s{i} AS (SELECT *, list_filter(list_transform({found}, lambda x: regexp_replace(x, '({NON_WORD})({NON_WORD})', '\\1', 'g')), "
            f"lambda v: {veto}) AS m{i}, regexp_replace(t{i}, '{B}(?:{pattern}){E}', ' [[{kind}_0]] ', 'g') AS t{i + 1} FROM "
            + (f"s{i - 1})" if i else f"(SELECT session_id, regexp_replace(text, '({NON_WORD})', '\\1\\1', 'g') AS t0 FROM texts))")
        )
    counts = " UNION ALL ".join(f"SELECT session_id, '{k}' AS entity_type, len(m{i}) AS n FROM s{len(STEPS) - 1}" for i, (k, _, _) in enumerate(STEPS))
    return (
        "WITH texts AS (SELECT source AS session_id, text FROM documents UNION ALL SELECT 'conv-' || conv_id, text FROM conversations), "
        + ", ".join(steps) + f" SELECT session_id, entity_type, sum(n)::BIGINT AS count FROM ({counts}) WHERE n > 0 GROUP BY ALL"
    )


def _talks(t):
    """Documents and conversations: a source and a conversation are sessions."""
    talks = t.conversations.select(
        F.concat(F.lit("conv-"), "conv_id").alias("session_id"), F.col("turn").cast("long").alias("turn"),
        F.lit(0).alias("pass_no"), "text",
    )
    return _texts(t).unionByName(talks)


@query("redact_counts_all", _all_detectors_sql())
def redact_counts_all(t):
    """All ten detectors over documents and conversations."""
    return redaction.detection_totals(redaction.redact(_talks(t)).texts, ["session_id"])


def _masking_sql() -> str:
    """CTEs from the texts to ``issued`` (the vault) and ``filled`` (every match with what stands in its place).

    As above, but a match leaves a mark that names its detector and keeps the characters around it, so
    that the marks of a detector, read from left to right, are its matches. Vetoed matches get their text back.
    """
    steps = []
    for i, (kind, pattern, veto) in enumerate(STEPS):
        # An account's number is masked, the words before it stay.
        before, value = (pattern[:-len(r"\d{8}")], r"\d{8}") if kind == "ACCOUNT" else ("", pattern)
        cut = f"({B}{before})({value})({E})"
        steps.append(
            f"s{i} AS (SELECT *, list_transform(list_transform(regexp_extract_all(t{i}, '{cut}', 2), lambda x: regexp_replace(x, '({NON_WORD})({NON_WORD})', '\\1', 'g')), "
            f"lambda v: {{'v': v, 'ok': {veto}}}) AS m{i}, regexp_replace(t{i}, '{cut}', '\\1[[{kind}_{chr(97 + i)}]]\\3', 'g') AS t{i + 1} FROM "
            + (f"s{i - 1})" if i else f"(SELECT session_id, turn, regexp_replace(text, '({NON_WORD})', '\\1\\1', 'g') AS t0 FROM texts))")
        )
    last = len(STEPS) - 1
    mark = rf"\[[A-Z_]+_([a-{chr(97 + last)}])\]"
    kinds = "[" + ", ".join(f"'{k}'" for k, _, _ in STEPS) + "]"
    return (
        "WITH texts AS (SELECT source AS session_id, doc_id AS turn, coalesce(text, '') AS text FROM documents "
        "UNION ALL SELECT 'conv-' || conv_id, turn, coalesce(text, '') FROM conversations), " + ", ".join(steps)
        + f""",
marked AS (SELECT session_id, turn, [{', '.join(f'm{i}' for i in range(last + 1))}] AS found, regexp_replace(t{last + 1}, '({NON_WORD})({NON_WORD})', '\\1', 'g') AS text FROM s{last}),
places AS (SELECT session_id, turn, found, generate_subscripts(marks, 1) AS pos, ascii(unnest(marks)) - 96 AS det
           FROM (SELECT *, regexp_extract_all(text, '{mark}', 1) AS marks FROM marked)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn, det ORDER BY pos) AS k FROM places),
seen AS (SELECT session_id, turn, pos, det, k, found[det][k].v AS value, found[det][k].ok AS ok, {kinds}[det] AS kind FROM numbered),
firsts AS (SELECT session_id, lower(trim(value)) AS key, arg_min(trim(value), (turn, det, k)) AS value, arg_min(kind, (turn, det, k)) AS entity_type,
                  min((turn, det, k)) AS sight FROM seen WHERE ok GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id, entity_type ORDER BY sight) AS n FROM firsts),
issued AS (SELECT *, '[' || entity_type || '_' || n || ']' AS token FROM ranked),
filled AS (SELECT s.session_id, s.turn, s.pos, CASE WHEN ok THEN token ELSE s.value END AS fill
           FROM seen s LEFT JOIN issued i ON i.session_id = s.session_id AND i.key = lower(trim(s.value))),
parts AS (SELECT session_id, turn, string_split_regex(text, '{mark.replace("(", "(?:")}') AS parts FROM marked)
""")


@query("redact_text", _masking_sql() + """
SELECT p.session_id, p.turn, md5(any_value(parts[1]) || coalesce(string_agg(fill || parts[pos + 1], '' ORDER BY pos), '')) AS clean_md5
FROM parts p LEFT JOIN filled f ON f.session_id = p.session_id AND f.turn = p.turn GROUP BY ALL""")
def redact_text(t):
    """Every masked text of all ten detectors, tokens numbered over the whole session."""
    return redaction.redact(_talks(t)).texts.select("session_id", "turn", F.md5("clean_text").alias("clean_md5"))


@query("redact_vault_all", _masking_sql() + "SELECT session_id, key, entity_type, n, token, value FROM issued")
def redact_vault_all(t):
    """The whole vault of all ten detectors."""
    return redaction.redact(_talks(t)).vault


VAULT_SQL = f"""
WITH {FOUND_SQL},
f AS (SELECT source, lower(value) AS key, arg_min(value, (doc_id, det, pos)) AS value, arg_min(entity_type, (doc_id, det, pos)) AS entity_type,
             min((doc_id, det, pos)) AS first_seen FROM found GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY source, entity_type ORDER BY first_seen) AS n FROM f)
SELECT source AS session_id, entity_type, n, '[' || entity_type || '_' || n || ']' AS token, value FROM n"""


@query("redact_vault", VAULT_SQL)
def redact_vault(t):
    """Token per distinct value and session, numbered by first sight."""
    vault = redaction.redact(_texts(t), only("EMAIL", "CARD")).vault
    return vault.select("session_id", "entity_type", "n", "token", "value")


@query("vault_stream", VAULT_SQL)
def vault_stream(t):
    """The same vault by the stream: documents as turns, tokens as they were issued."""
    folder = f"{shared_folder(t.spark).rstrip('/')}/ragspark/{uuid.uuid4().hex}"
    turns = _as_texts(t.stream("documents"))
    issued = sessions.redact_stream(turns, only("EMAIL", "CARD")).select("session_id", F.explode("issued").alias("i")).select(
        "session_id", "i.entity_type", "i.n", "i.token", "i.value"
    )
    issued.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(
        f"{folder}/vault").awaitTermination()
    return t.spark.read.schema(issued.schema).parquet(f"{folder}/vault")


@query("redact_roundtrip", "SELECT doc_id AS turn, md5(text) AS text_md5 FROM documents")
def redact_roundtrip(t):
    """All detectors, then re-identification: every text comes back."""
    done = redaction.redact(_texts(t))
    back = redaction.rehydrate(materialise(done.texts), done.vault, ["session_id", "turn", "pass_no"])
    return back.select("turn", F.md5("rehydrated").alias("text_md5"))


PII_SQL = rf"""
WITH {FOUND_SQL},
gold AS (SELECT doc_id, value, 'EMAIL' AS type, true AS is_pii FROM emails
         UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '\d{{16}}')), 'REFERENCE', false FROM documents),
masks AS (SELECT DISTINCT doc_id, entity_type, value FROM found),
r AS (SELECT count(*) AS n FROM gold WHERE is_pii),
m AS (SELECT count(*) AS n, count_if(entity_type = 'EMAIL')::BIGINT AS tp FROM masks)
SELECT 'recall' AS section, 'EMAIL' AS label, n AS hits, n AS total, 1.0::DOUBLE AS value FROM r
UNION ALL SELECT 'recall', 'overall', n, n, 1.0 FROM r
UNION ALL SELECT 'masks', 'precision', tp, n, round(tp / n, 6) FROM m
UNION ALL SELECT 'masks', 'over_mask_rate', n - tp, n, round((n - tp) / n, 6) FROM m
UNION ALL SELECT 'false_positives', 'REFERENCE', n - tp, n - tp, 1.0 FROM m"""


def _cases(t):
    """Documents as labelled cases: e-mail addresses are personal, long numbers are references."""
    pattern = r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
    def entities(found, kind, personal):
        found = F.coalesce(found, F.array().cast("array<string>"))
        return F.transform(found, lambda v: F.struct(v.alias("text"), F.lit(kind).alias("type"), F.lit(personal).alias("is_pii")))
    gold = F.concat(
        entities(F.when(F.col("text").contains("@"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))), "EMAIL", True),
        entities(F.regexp_extract_all("text", F.lit(r"\d{16}"), F.lit(0)), "REFERENCE", False),
    )
    return t.spread("documents").select(F.col("doc_id").cast("string").alias("case_id"), "text", gold.alias("entities"))


@query("pii_eval", PII_SQL)
def pii_quality(t):
    return pii_eval.report(_cases(t), only("EMAIL", "CARD")).withColumn("value", F.round("value", 6))


@query("redaction_report", f"""
WITH r AS ({PII_SQL}),
lines AS (
  SELECT 0 AS part, 0 AS place, '' AS label, '# Redaction quality' AS line UNION ALL SELECT 2, 0, '', '| Type | Recall | Found/All |'
  UNION ALL SELECT 3, 0, '', '|---|---:|---:|' UNION ALL SELECT 9, 0, '', 'Wrong masks by cause:'
  UNION ALL SELECT 1, 0, '', 'Cases: ' || count(*) FROM documents
  UNION ALL SELECT CASE WHEN label = 'overall' THEN 5 ELSE 4 END, 0, label, '| ' || label || ' | ' || printf('%.0f%%', value * 100) || ' | ' || hits || '/' || total || ' |'
            FROM r WHERE section = 'recall'
  UNION ALL SELECT 6, 0, '', '- Masks: ' || total || ' (right ' || hits || ', wrong ' || (total - hits) || ')' FROM r WHERE label = 'precision'
  UNION ALL SELECT 7, 0, '', '- Precision: ' || printf('%.0f%%', value * 100) FROM r WHERE label = 'precision'
  UNION ALL SELECT 8, 0, '', '- Over-mask rate: ' || printf('%.0f%%', value * 100) FROM r WHERE label = 'over_mask_rate'
  UNION ALL SELECT 10, -hits, label, '- ' || label || ': ' || hits FROM r WHERE section = 'false_positives')
SELECT row_number() OVER (ORDER BY part, place, label) AS line_no, line FROM lines""")
def redaction_report(t):
    """The redaction evaluation as text."""
    cases = _cases(t)
    return reports.redaction_report(pii_eval.report(cases, only("EMAIL", "CARD")), t.documents)


def _hex(pad: int) -> str:
    return bytes(b ^ pad for b in KEY.ljust(64, b"\0")).hex()


HMAC_SQL = f"sha256(unhex('{_hex(0x5C)}') || unhex(sha256(unhex('{_hex(0x36)}') || encode({{text}}))))"


@query("audit_hash", f"SELECT doc_id, {HMAC_SQL.format(text='text')} AS input_hash FROM documents")
def audit_hash(t):
    return t.documents.select("doc_id", keyed_hash(F.col("text"), KEY).alias("input_hash"))


@query("audit_query", f"""
WITH r AS (
  SELECT '2026-06-' || lpad((conv_id % 28 + 1)::VARCHAR, 2, '0') || 'T10:00:0' || turn || '+00:00' AS ts, 'conv-' || conv_id AS session_id,
         {HMAC_SQL.format(text='text')} AS input_hash, len(text) AS toks, conv_id, turn FROM conversations
  WHERE turn % 3 = 0)
SELECT session_id, input_hash, 'NAME:' || (turn + 1) AS output_pii, ts || '  ' || substr(session_id, 1, 8) || '  REVIEW  tokens=' || rpad((toks + turn)::VARCHAR, greatest(5, len((toks + turn)::VARCHAR))::INT, ' ')
  || ' ' || (turn * 10) || 'ms  input_pii=[' || CASE WHEN turn = 0 THEN 'none' ELSE 'EMAIL:' || turn || ', NAME:1' END || ']  hash=' || substr(input_hash, 1, 12) || '...' AS line
FROM r WHERE ts >= '2026-06-03' AND ts <= '2026-06-20'""")
def audit_query(t):
    """Audit trail built from conversation turns, filtered and summarised."""
    none = F.array().cast("array<struct<entity_type:string,count:bigint>>")
    turn = F.col("turn").cast("long")
    one = F.lit(1).cast("long")
    def found(*pairs):
        return F.array(*[F.struct(F.lit(k).alias("entity_type"), n.alias("count")) for k, n in pairs])
    length = F.length("text").cast("long")
    turns = t.conversations.select(
        F.concat(F.lit("2026-06-"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00:0"), "turn", F.lit("+00:00")).alias("timestamp"),
        F.concat(F.lit("conv-"), "conv_id").alias("session_id"), F.col("text").alias("raw_question"),
        F.when(turn > 0, found(("EMAIL", turn), ("NAME", one))).otherwise(none).alias("input_detections"),
        none.alias("answer_detections"), found(("NAME", one)).alias("draft_detections"), found(("NAME", turn)).alias("reason_detections"),
        F.lit("answer").alias("masked_handler_answer"), F.lit("draft").alias("masked_customer_draft"), F.lit("").alias("masked_review_reason"),
        F.lit("model").alias("model_id"), F.array().cast("array<string>").alias("cited_provisions"),
        F.array().cast("array<string>").alias("retrieved_chunk_ids"), (turn % 3 == 0).alias("human_review_required"),
        F.lit(False).alias("insufficient_context"), (turn * 10).cast("double").alias("latency_ms"), F.lit(0.0).alias("retrieval_latency_ms"),
        F.lit(0.0).alias("generation_latency_ms"),
        F.struct(length.alias("input_tokens"), turn.alias("output_tokens"), (length + turn).alias("total_tokens")).alias("usage"),
    )
    trail = audit.audit_records(turns, KEY)
    kept = audit.filter_audit(trail, since="2026-06-03", until="2026-06-20", review_only=True)
    masked = F.transform("output_detections", lambda d: F.concat(d["entity_type"], F.lit(":"), d["count"].cast("string")))
    return kept.select(
        "session_id", "input_hash", F.array_join(masked, ", ").alias("output_pii"), audit.summary_line().alias("line")
    )


@query("audit_recent", f"""
SELECT conv_id * 8 + turn AS ord, {HMAC_SQL.format(text='text')} AS input_hash FROM conversations
WHERE role = 'user' ORDER BY ord DESC LIMIT 20""")
def audit_recent(t):
    """The last twenty matches in trail order."""
    trail = t.conversations.where("role = 'user'").select(
        (F.col("conv_id") * 8 + F.col("turn")).alias("ord"), keyed_hash(F.col("text"), KEY).alias("input_hash")
    )
    return audit.most_recent(trail, "ord", 20)


@query("conversation_history", """
WITH last AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id),
m AS (SELECT conv_id, turn AS past_turn, 'user' AS role, text FROM conversations
      UNION ALL SELECT conv_id, turn, 'assistant', CASE WHEN turn % 2 = 0 THEN role ELSE role || chr(10) || chr(10) || '[Customer draft]' || chr(10) || 'draft' END
      FROM conversations)
SELECT m.conv_id AS session_id, last.turn, past_turn, role, md5(text) AS text_md5 FROM m JOIN last USING (conv_id) WHERE past_turn < last.turn""")
def conversation_history(t):
    """Earlier messages of the last turn of each conversation."""
    masked = t.conversations.select(
        F.col("conv_id").alias("session_id"), "turn", F.col("text").alias("masked_question"), F.col("role").alias("masked_handler_answer"),
        F.when(F.col("turn") % 2 == 1, "draft").alias("masked_customer_draft"),
    )
    asking = masked.groupBy("session_id").agg(F.max("turn").alias("turn"))
    past = conversation.history(masked, asking)
    return past.select("session_id", "turn", "past_turn", "role", F.md5("text").alias("text_md5"))
