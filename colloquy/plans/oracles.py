"""SQL oracles (DuckDB dialect) for the registered checks.

They restate each operator the plain way on the raw test tables: the period
bounds are computed in SQL with time-zone functions, conversations' texts are
really joined with ``' | '`` in time order and matched as a whole, and periods
are a range join. RE2 has no lookbehind, so a word start is written
``(^|[^\\p{L}\\p{N}_])`` and a negation guard by marking: every guard phrase
gets a ``_`` appended (a word character), after which a keyword right behind it
can no longer start a word.
"""

from __future__ import annotations

from ..params import Params
from ..plans.rules import REFERENCE_PACK, RulePack
from ..sources.testdata import CHAT_CUSTOM_PARAMS, CHAT_PARAMS, EVENT_PARAMS, N_TENANTS, PHRASES, TEST_PACK, TEST_PACK_GUARDED, call_params

FMT = "%Y-%m-%d %H:%M:%S.%f"


def _q(s: str) -> str:
    return s.replace("'", "''")


def loc(x: str, tz: str) -> str:
    return f"timezone('{tz}', timezone('UTC', {x}))"


def cfg(p: Params) -> str:
    tz = p.tz
    as_of = p.as_of_utc().strftime("%Y-%m-%d %H:%M:%S.%f")
    if p.custom_start is not None and p.custom_end is not None:
        cs = f"timezone('UTC', timezone('{tz}', TIMESTAMP '{p.custom_start} 00:00:00'))"
        ce = f"timezone('UTC', timezone('{tz}', TIMESTAMP '{p.custom_end} 00:00:00' + INTERVAL 1 DAY))"
    else:
        cs = ce = "CAST(NULL AS TIMESTAMP)"
    return f"""
cfg1 AS (SELECT TIMESTAMP '{as_of}' AS t_now, {loc("TIMESTAMP '" + as_of + "'", tz)} AS l_now),
cfg AS (
  SELECT t_now, l_now,
    t_now - INTERVAL 7 DAY AS d7_start,
    t_now - INTERVAL 14 DAY AS d8_start,
    t_now - INTERVAL 7 DAY AS d8_end,
    timezone('UTC', timezone('{tz}', CAST(date_trunc('month', l_now) AS TIMESTAMP) - INTERVAL 1 MONTH)) AS mf_start,
    timezone('UTC', timezone('{tz}', CAST(date_trunc('month', l_now) AS TIMESTAMP))) AS mf_end,
    {cs} AS cust_start, {ce} AS cust_end,
    GREATEST(1, date_diff('day', DATE '{p.project_start}', CAST(l_now AS DATE))) AS dias,
    date_diff('day', CAST(date_trunc('month', l_now) AS DATE), CAST(l_now AS DATE)) + 1 AS dias_mes,
    {int(p.monthly_goal)} AS goal
  FROM cfg1),
periods AS (
  SELECT 'd7' AS bucket, d7_start AS p_start, CAST(NULL AS TIMESTAMP) AS p_end, 1 AS ord FROM cfg
  UNION ALL SELECT 'd8_14', d8_start, d8_end, 2 FROM cfg
  UNION ALL SELECT 'mes_fechado', mf_start, mf_end, 3 FROM cfg
  UNION ALL SELECT 'custom', cust_start, cust_end, 4 FROM cfg WHERE cust_start IS NOT NULL AND cust_end IS NOT NULL)"""


IN_PERIOD = "m.{ts} >= p.p_start AND (p.p_end IS NULL OR m.{ts} < p.p_end)"


def in_period(ts: str = "ts") -> str:
    return IN_PERIOD.format(ts=ts)


CHAT_BASE = """
msgs_a AS (
  SELECT CAST(conv_id % 3 AS VARCHAR) AS tenant_id, conv_id AS conversation_id, conv_id * 1000 + turn AS message_id,
         CASE WHEN role = 'user' THEN 0 ELSE 1 END AS kind, role = 'system' AS is_private,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST((conv_id * 331) % 1080 AS INTEGER))
           + to_minutes(CAST(turn * 7 AS INTEGER)) AS ts,
         text AS content
  FROM conversations),
convs_a AS (
  SELECT CAST(c.conv_id % 3 AS VARCHAR) AS tenant_id, c.conv_id AS conversation_id, c.conv_id % 40 AS contact_id,
         cu.c_name AS contact_name
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN customer cu ON cu.c_custkey = c.conv_id),
excl AS (SELECT conversation_id FROM convs_a WHERE COALESCE(contact_name, '') ILIKE '%7%'),
base AS (
  SELECT m.tenant_id, m.conversation_id, m.message_id, c.contact_id, m.kind, m.is_private, m.ts, m.content
  FROM msgs_a m JOIN convs_a c ON c.conversation_id = m.conversation_id AND c.tenant_id = m.tenant_id
  WHERE m.conversation_id NOT IN (SELECT conversation_id FROM excl)),
tenants AS (SELECT DISTINCT CAST(conv_id % 3 AS VARCHAR) AS tenant_id FROM conversations)"""

EVENT_BASE = """
base AS (
  SELECT CAST(user_id % 3 AS VARCHAR) AS tenant_id, user_id AS conversation_id, event_id AS message_id,
         user_id % 40 AS contact_id, CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END AS kind,
         event_type = 'signup' AS is_private, ts, props AS content
  FROM events),
tenants AS (SELECT DISTINCT CAST(user_id % 3 AS VARCHAR) AS tenant_id FROM events)"""


def chat_with(*ctes: str, params: Params = CHAT_PARAMS) -> str:
    return "WITH " + ",".join([cfg(params), CHAT_BASE, *ctes]) + "\n"


def events_with(*ctes: str) -> str:
    return "WITH " + ",".join([cfg(EVENT_PARAMS), EVENT_BASE, *ctes]) + "\n"


# --- rule regexes in RE2 ------------------------------------------------------
def re2(keywords: str, word_start: bool = True) -> str:
    pre = r"(?:^|[^\p{L}\p{N}_])" if word_start else ""
    return _q(f"(?is){pre}(?:{keywords})")


NEGATOR_INITIAL = "n[ãa]o"


def rule_match(text: str, rule) -> str:
    """RE2 form of one rule. Guarded rules are matched on the marked text,
    except alternatives that themselves begin with the negator "não" (marking
    would split them): those are matched on the raw text without the guard,
    which differs only for a negator-initial keyword right after a second
    negator ("nunca não entendi")."""
    if not rule.guard:
        return f"regexp_matches({text}, '{re2(rule.keywords, rule.word_start)}')"
    from ..functions.regex import _top_level_alternatives
    alts = _top_level_alternatives(rule.keywords) or [rule.keywords]
    raw = [a for a in alts if a.startswith(NEGATOR_INITIAL)]
    marked_alts = [a for a in alts if not a.startswith(NEGATOR_INITIAL)]
    marked = f"regexp_replace({text}, '{_q('(?i)(' + rule.guard + ')')}', '\\1_', 'g')"
    parts = []
    if marked_alts:
        parts.append(f"regexp_matches({marked}, '{re2('|'.join(marked_alts), rule.word_start)}')")
    if raw:
        parts.append(f"regexp_matches({text}, '{re2('|'.join(raw), rule.word_start)}')")
    return "(" + " OR ".join(parts) + ")"


def case_topic(text: str, pack: RulePack, message_level: bool = False) -> str:
    rules = pack.message_rules if message_level else pack.rules
    whens = " ".join(f"WHEN {rule_match(text, r)} THEN '{_q(r.topic)}'" for r in rules)
    return f"CASE {whens} ELSE '{_q(pack.default_topic)}' END"


def text_cte(pack: RulePack = TEST_PACK) -> str:
    t = "texto"
    return f"""
ta AS (
  SELECT tenant_id, conversation_id, string_agg(content, ' | ' ORDER BY ts, message_id) AS texto,
         MAX(ts) AS ult_msg, COUNT(*) AS n_msgs
  FROM base WHERE kind = 0 AND is_private = false AND content IS NOT NULL AND length(content) >= {pack.min_text_len}
  GROUP BY tenant_id, conversation_id),
cl AS (
  SELECT tenant_id, conversation_id, texto, ult_msg, n_msgs, {case_topic(t, pack)} AS categoria,
         regexp_matches({t}, '{re2(pack.mention)}') AS menciona_desafio,
         regexp_matches({t}, '{re2(pack.mention)}') AND regexp_matches({t}, '{re2(pack.engage)}') AS engajou
  FROM ta),
cb AS (SELECT m.*, p.bucket FROM cl m JOIN periods p ON {in_period('ult_msg')})"""


def pct(n: str, total: str) -> str:
    return f"CASE WHEN {total} > 0 THEN CAST((2000 * {n} + {total}) // (2 * {total}) AS DOUBLE) / 10 ELSE 0 END"


def stop_list(pack: RulePack) -> str:
    return ", ".join(f"'{_q(w)}'" for w in sorted(pack.stop_words))


TOTALS = """
tot AS (
  SELECT tenant_id,
    COUNT(*) FILTER (WHERE kind = 1 AND is_private) AS disparos,
    COUNT(DISTINCT contact_id) FILTER (WHERE kind = 1 AND is_private) AS alunos,
    COUNT(DISTINCT conversation_id) FILTER (WHERE is_private = false AND kind = 0) AS respostas,
    COUNT(DISTINCT conversation_id) FILTER (WHERE is_private = false AND kind IN (0, 1)) AS conversas_unicas,
    COUNT(*) FILTER (WHERE kind = 1 AND is_private AND ts >= (SELECT mf_end FROM cfg)) AS mes_disparos,
    COUNT(DISTINCT contact_id) FILTER (WHERE kind = 1 AND is_private AND ts >= (SELECT mf_end FROM cfg)) AS mes_alunos,
    COUNT(DISTINCT conversation_id) FILTER (WHERE is_private = false AND kind = 0
                                             AND ts >= (SELECT mf_end FROM cfg)) AS mes_respostas
  FROM base GROUP BY tenant_id)"""


def _period_labels(p: Params) -> str:
    tz = p.tz
    months = ", ".join(f"'{m}'" for m in ("Jan", "Fev", "Mar", "Abr", "Mai", "Jun", "Jul", "Ago", "Set", "Out", "Nov", "Dez"))
    d = lambda x: f"CAST({loc(x, tz)} AS DATE)"
    custom = ""
    if p.custom_start is not None and p.custom_end is not None:
        cs, ce = f"DATE '{p.custom_start}'", f"DATE '{p.custom_end}'"
        custom = (f"\n  UNION ALL SELECT 'custom', strftime({cs}, '%d/%m') || ' a ' || strftime({ce}, '%d/%m'), "
                  f"strftime({cs}, '%d/%m/%Y') || ' a ' || strftime({ce}, '%d/%m/%Y') FROM cfg")
    return f"""
labels AS (
  SELECT 'd7' AS bucket, 'Últimos 7 dias' AS label,
         strftime({d('d7_start')}, '%d/%m') || ' a ' || strftime(CAST(l_now AS DATE), '%d/%m') AS sublabel FROM cfg
  UNION ALL SELECT 'd8_14', 'Semana retrasada',
         strftime({d('d8_start')}, '%d/%m') || ' a ' || strftime({d("d8_end - INTERVAL 1 DAY")}, '%d/%m') FROM cfg
  UNION ALL SELECT 'mes_fechado',
         'Mês de ' || ([{months}])[month({loc('mf_start', tz)})] || '/' || strftime({loc('mf_start', tz)}, '%y'),
         strftime({d('mf_start')}, '%d/%m/%Y') || ' a ' || strftime({d("mf_end - INTERVAL 1 DAY")}, '%d/%m/%Y')
  FROM cfg{custom})"""


def oracles() -> dict[str, str]:
    tp = TEST_PACK
    tz_c, tz_e = CHAT_PARAMS.tz, EVENT_PARAMS.tz
    o: dict[str, str] = {}

    o["period_calendar"] = events_with(_period_labels(EVENT_PARAMS)) + f"""
SELECT t.tenant_id, p.bucket, l.label, l.sublabel, p.ord,
       strftime(p.p_start, '{FMT}') AS start_utc, strftime(p.p_end, '{FMT}') AS end_utc
FROM tenants t JOIN periods p ON TRUE JOIN labels l ON l.bucket = p.bucket"""

    o["base_messages_excluded"] = chat_with() + f"""
SELECT tenant_id, conversation_id, message_id, contact_id, kind, is_private, strftime(ts, '{FMT}') AS ts, content
FROM base"""

    o["assign_periods_events"] = events_with() + f"""
SELECT m.tenant_id, m.message_id, p.bucket FROM base m JOIN periods p ON {in_period()}"""

    dispatch = f"""
SELECT m.tenant_id, p.bucket, COUNT(*) AS disparos, COUNT(DISTINCT m.contact_id) AS alunos_atendidos
FROM base m JOIN periods p ON {in_period()}
WHERE m.kind = 1 AND m.is_private = true GROUP BY m.tenant_id, p.bucket"""
    o["dispatch_kpis"] = chat_with() + dispatch
    o["dispatch_kpis_events"] = events_with() + dispatch

    o["message_kpis"] = chat_with() + f"""
SELECT m.tenant_id, p.bucket, COUNT(*) FILTER (WHERE m.kind = 0) AS msgs_aluno,
       COUNT(*) FILTER (WHERE m.kind = 1) AS msgs_tcs
FROM base m JOIN periods p ON {in_period()}
WHERE m.is_private = false AND m.kind IN (0, 1) GROUP BY m.tenant_id, p.bucket"""

    o["message_kpis_events"] = events_with() + f"""
SELECT m.tenant_id, p.bucket, COUNT(*) FILTER (WHERE m.kind = 0) AS msgs_aluno,
       COUNT(*) FILTER (WHERE m.kind = 1) AS msgs_tcs,
       COUNT(DISTINCT m.conversation_id) FILTER (WHERE m.kind = 0) AS respostas
FROM base m JOIN periods p ON {in_period()}
WHERE m.is_private = false AND m.kind IN (0, 1) GROUP BY m.tenant_id, p.bucket"""

    o["responses"] = chat_with() + f"""
SELECT m.tenant_id, p.bucket, COUNT(DISTINCT m.conversation_id) AS respostas
FROM base m JOIN periods p ON {in_period()}
WHERE m.is_private = false AND m.kind = 0 GROUP BY m.tenant_id, p.bucket"""

    o["totals_alltime"] = chat_with(TOTALS) + """
SELECT tenant_id, disparos, alunos, respostas, conversas_unicas FROM tot"""
    o["totals_month"] = chat_with(TOTALS) + """
SELECT tenant_id, mes_disparos, mes_alunos, mes_respostas FROM tot"""
    o["totals_events"] = events_with(TOTALS) + """
SELECT tenant_id, disparos, alunos, respostas, conversas_unicas, mes_disparos, mes_alunos, mes_respostas FROM tot"""

    o["goal_metrics"] = chat_with(TOTALS) + f"""
SELECT tenant_id,
  {pct('respostas', 'disparos')} AS taxa_resp,
  CASE WHEN alunos > 0 THEN CAST((200 * disparos + alunos) // (2 * alunos) AS DOUBLE) / 100 ELSE 0 END
    AS disparos_por_aluno,
  CAST((2 * dias * goal + 30) // 60 AS BIGINT) AS meta_proporcional,
  CASE WHEN dias > 0 AND goal > 0
       THEN CAST((60000 * disparos + dias * goal) // (2 * dias * goal) AS DOUBLE) / 10 ELSE 0 END AS pct_meta,
  CASE WHEN dias > 0 THEN CAST((20 * disparos + dias) // (2 * dias) AS DOUBLE) / 10 ELSE 0 END AS pace_diario,
  {pct('mes_respostas', 'mes_disparos')} AS mes_taxa_resp,
  CAST((2 * dias_mes * goal + 30) // 60 AS BIGINT) AS mes_meta_proporcional,
  CASE WHEN dias_mes > 0 AND goal > 0
       THEN CAST((60000 * mes_disparos + dias_mes * goal) // (2 * dias_mes * goal) AS DOUBLE) / 10 ELSE 0 END
    AS mes_pct_meta,
  CASE WHEN dias_mes > 0 THEN CAST((60 * mes_disparos + dias_mes) // (2 * dias_mes) AS BIGINT) ELSE 0 END
    AS projecao_fim_mes
FROM tot JOIN cfg ON TRUE"""

    o["conversation_topics"] = chat_with(text_cte(tp)) + f"""
SELECT tenant_id, conversation_id, categoria, strftime(ult_msg, '{FMT}') AS ult_msg, n_msgs, menciona_desafio, engajou
FROM cl"""

    o["conversation_text"] = chat_with(text_cte(tp)) + f"""
SELECT tenant_id, conversation_id, strftime(ult_msg, '{FMT}') AS ult_msg, n_msgs, CAST(length(texto) AS BIGINT) AS texto_chars
FROM ta"""

    o["conversation_segments"] = chat_with(text_cte(tp)) + """
SELECT tenant_id, conversation_id, CAST(k AS BIGINT) AS segment, substring(texto, CAST(k * 500 + 1 AS BIGINT), 500) AS text
FROM (SELECT *, unnest(range(0, (length(texto) + 499) // 500)) AS k FROM ta) x"""

    o["topic_rules"] = f"SELECT doc_id, {case_topic('text', tp)} AS topic FROM documents"
    o["topic_rules_guarded"] = f"SELECT doc_id, {case_topic('text', TEST_PACK_GUARDED)} AS topic FROM documents"
    o["reference_rules_documents"] = (f"SELECT doc_id, {case_topic('text', REFERENCE_PACK)} AS topic, "
                                      f"regexp_matches(text, '{re2(REFERENCE_PACK.mention)}') AS menciona_desafio "
                                      "FROM documents")

    o["topic_distribution"] = topic_distribution_sql(CHAT_PARAMS, tp)
    o["word_counts"] = chat_with(text_cte(tp), words_cte(tp)) + "SELECT tenant_id, bucket, word, n FROM wc"
    o["word_cloud"] = word_cloud_sql(CHAT_PARAMS, tp)

    o["mention_funnel"] = chat_with(text_cte(tp)) + f"""
SELECT tenant_id, bucket, n_conversas, n_mencionou, {pct('n_mencionou', 'n_conversas')} AS pct_mencionou,
       n_engajou, {pct('n_engajou', 'n_mencionou')} AS pct_engajou
FROM (SELECT tenant_id, bucket, COUNT(*) AS n_conversas, COUNT(*) FILTER (WHERE menciona_desafio) AS n_mencionou,
             COUNT(*) FILTER (WHERE engajou) AS n_engajou
      FROM cb GROUP BY tenant_id, bucket) x"""

    def rhythm(tz: str) -> str:
        return f"""
SELECT m.tenant_id, p.bucket, strftime(CAST({loc('m.ts', tz)} AS DATE), '%Y-%m-%d') AS dia,
       COUNT(*) FILTER (WHERE m.kind = 0) AS rec, COUNT(*) FILTER (WHERE m.kind = 1) AS env
FROM base m JOIN periods p ON {in_period()}
WHERE p.bucket IN ('d7', 'd8_14', 'custom') AND m.is_private = false AND m.kind IN (0, 1)
GROUP BY m.tenant_id, p.bucket, dia"""
    o["daily_rhythm"] = events_with() + rhythm(tz_e)
    o["daily_rhythm_chat"] = chat_with() + rhythm(tz_c)

    o["hourly_heatmap"] = events_with(f"""
hb AS (
  SELECT m.tenant_id, p.bucket, CAST(hour({loc('m.ts', tz_e)}) AS INTEGER) AS h, COUNT(*) AS n
  FROM base m JOIN periods p ON {in_period()}
  WHERE p.bucket IN ('d7', 'custom') AND m.is_private = false AND m.kind = 0
  GROUP BY m.tenant_id, p.bucket, h),
ob AS (SELECT DISTINCT tenant_id, bucket FROM hb)""") + """
SELECT ob.tenant_id, ob.bucket, CAST(g.h AS INTEGER) AS h, COALESCE(hb.n, 0) AS n
FROM ob JOIN range(24) g(h) ON TRUE
LEFT JOIN hb ON hb.tenant_id = ob.tenant_id AND hb.bucket = ob.bucket AND hb.h = g.h"""

    o["quote_candidates"] = chat_with(mc_cte(tp)) + "SELECT tenant_id, conversation_id, message_id, mcat FROM mc"
    o["sample_quotes"] = sample_quotes_sql(CHAT_PARAMS, tp)
    o["period_report"] = period_report_sql(CHAT_PARAMS, tp)

    # the same operators with a custom period, and with the report's own rule pack
    o["topic_distribution_custom"] = topic_distribution_sql(CHAT_CUSTOM_PARAMS, tp)
    o["word_cloud_custom"] = word_cloud_sql(CHAT_CUSTOM_PARAMS, tp)
    o["sample_quotes_custom"] = sample_quotes_sql(CHAT_CUSTOM_PARAMS, tp)
    o["period_report_custom"] = period_report_sql(CHAT_CUSTOM_PARAMS, tp)
    o["word_cloud_reference"] = word_cloud_sql(CHAT_PARAMS, REFERENCE_PACK)
    o["period_report_reference"] = period_report_sql(CHAT_PARAMS, REFERENCE_PACK)
    o["summary_leaves"] = summary_leaves_sql(CHAT_PARAMS, REFERENCE_PACK)

    # every tenant with its own call: the plain SQL of each call, and of it the tenant's rows
    o["period_calendar_calls"] = per_tenant(lambda p: chat_with(_period_labels(p), params=p) + f"""
SELECT t.tenant_id, p.bucket, l.label, l.sublabel, p.ord, strftime(p.p_start, '{FMT}') AS start_utc, strftime(p.p_end, '{FMT}') AS end_utc
FROM tenants t JOIN periods p ON TRUE JOIN labels l ON l.bucket = p.bucket""")
    o["dispatch_kpis_calls"] = per_tenant(lambda p: chat_with(params=p) + dispatch)
    o["summary_leaves_calls"] = per_tenant(lambda p: summary_leaves_sql(p, tp))
    o["summary_leaves_one_tenant"] = f"SELECT * FROM ({summary_leaves_sql(CHAT_PARAMS, tp)}) x WHERE tenant_id = '1'"
    # the report's rules on texts that begin with a phrase
    o["message_rules_phrases"] = with_phrases(chat_with() + f"""
SELECT message_id, {case_topic('content', REFERENCE_PACK)} AS topic, {case_topic('content', REFERENCE_PACK, message_level=True)} AS mcat,
       regexp_matches(content, '{re2(REFERENCE_PACK.mention)}') AS menciona, regexp_matches(content, '{re2(REFERENCE_PACK.engage)}') AS engaja,
       regexp_matches(content, '{re2(REFERENCE_PACK.quote_exclude, word_start=False)}') AS automatica
FROM msgs_a""")
    o["conversation_topics_phrases"] = with_phrases(chat_with(text_cte(REFERENCE_PACK)) + f"""
SELECT tenant_id, conversation_id, categoria, strftime(ult_msg, '{FMT}') AS ult_msg, n_msgs, menciona_desafio, engajou FROM cl""")
    o["sample_quotes_phrases"] = with_phrases(sample_quotes_sql(CHAT_PARAMS, REFERENCE_PACK))
    o["summary_leaves_phrases"] = with_phrases(summary_leaves_sql(CHAT_CUSTOM_PARAMS, REFERENCE_PACK))
    o["summary_json"] = o["summary_leaves_phrases"]
    own = f"""
own AS (SELECT DISTINCT tenant_id, unnest(regexp_split_to_array(lower(content), '{_q(tp.word_split)}')) AS word FROM msgs_a),
tok AS (
  SELECT * FROM (SELECT tenant_id, bucket, unnest(regexp_split_to_array(lower(texto), '{_q(tp.word_split)}')) AS word FROM cb) x
  ANTI JOIN (SELECT * FROM own WHERE length(word) % 4 = CAST(tenant_id AS INTEGER)) y ON y.tenant_id = x.tenant_id AND y.word = x.word)"""
    o["word_cloud_own_stop_words"] = word_cloud_sql(CHAT_PARAMS, tp, own)

    o["period_facts"] = chat_with(params=CHAT_CUSTOM_PARAMS) + PERIOD_FACTS
    o["period_facts_events"] = events_with() + PERIOD_FACTS
    o["period_facts_calls"] = per_tenant(lambda p: chat_with(params=p) + PERIOD_FACTS)
    o["daily_rhythm_rollup"] = o["daily_rhythm"]
    o["hourly_heatmap_rollup"] = o["hourly_heatmap"]
    o["activity_events"] = events_with() + f"""
SELECT tenant_id, conversation_id, contact_id, periods, strftime(dia, '%Y-%m-%d') AS dia, h,
       COUNT(*) FILTER (WHERE kind = 1 AND is_private) AS n_disp, COUNT(*) FILTER (WHERE kind = 0 AND is_private = false) AS n_in,
       COUNT(*) FILTER (WHERE kind = 1 AND is_private = false) AS n_out
FROM (SELECT *, CASE WHEN timed THEN CAST(l_ts AS DATE) END AS dia, CASE WHEN timed THEN hour(l_ts) END AS h
      FROM (SELECT *, is_private = false AND kind IN (0, 1) AND periods % 16 > 0 AS timed
            FROM (SELECT m.*, {loc('m.ts', tz_e)} AS l_ts,
                         CAST(32 + CASE WHEN ts >= mf_end THEN 16 ELSE 0 END + CASE WHEN ts >= cust_start AND ts < cust_end THEN 8 ELSE 0 END
                              + CASE WHEN ts >= mf_start AND ts < mf_end THEN 4 ELSE 0 END + CASE WHEN ts >= d8_start AND ts < d8_end THEN 2 ELSE 0 END
                              + CASE WHEN ts >= d7_start THEN 1 ELSE 0 END AS BIGINT) AS periods
                  FROM base m JOIN cfg ON TRUE) a) b) c
GROUP BY tenant_id, conversation_id, contact_id, periods, dia, h"""
    return o


PERIOD_FACTS = f"""
SELECT t.tenant_id, n.bucket, COUNT(*) FILTER (WHERE m.kind = 1 AND m.is_private) AS disparos,
       COUNT(*) FILTER (WHERE m.kind = 0 AND m.is_private = false) AS msgs_aluno, COUNT(*) FILTER (WHERE m.kind = 1 AND m.is_private = false) AS msgs_tcs,
       COUNT(DISTINCT m.conversation_id) FILTER (WHERE m.kind = 0 AND m.is_private = false) AS respostas,
       COUNT(DISTINCT m.conversation_id) FILTER (WHERE m.kind IN (0, 1) AND m.is_private = false) AS conversas_unicas,
       COUNT(DISTINCT m.contact_id) FILTER (WHERE m.kind = 1 AND m.is_private) AS alunos_atendidos
FROM (SELECT DISTINCT tenant_id FROM base) t
JOIN (SELECT unnest(['d7', 'd8_14', 'mes_fechado', 'custom', 'mes_atual', 'total']) AS bucket) n ON TRUE
LEFT JOIN (SELECT bucket, p_start, p_end FROM periods UNION ALL SELECT 'mes_atual', mf_end, NULL FROM cfg
           UNION ALL SELECT 'total', TIMESTAMP '0001-01-01 00:00:00', NULL) p ON p.bucket = n.bucket
LEFT JOIN base m ON m.tenant_id = t.tenant_id AND {in_period()}
GROUP BY t.tenant_id, n.bucket"""


def with_phrases(sql: str) -> str:
    """The query on messages whose texts begin with a phrase."""
    phrases = ", ".join(f"'{_q(p)}'" for p in PHRASES)
    text = f"([{phrases}])[(conv_id * 7 + turn * 5) % {len(PHRASES)} + 1] || '. ' || substring(text, 1, CAST((conv_id % 5) * 30 AS BIGINT))"
    assert "         text AS content" in sql
    return sql.replace("         text AS content", f"         {text} AS content")


def per_tenant(sql) -> str:
    parts = [f"SELECT * FROM ({sql(call_params(t))}) x WHERE tenant_id = '{t}'" for t in range(N_TENANTS)]
    return "\nUNION ALL\n".join(parts)


def topic_distribution_sql(params: Params, pack: RulePack) -> str:
    return chat_with(text_cte(pack), params=params) + f"""
SELECT tenant_id, bucket, categoria, n, {pct('n', 'total')} AS pct
FROM (SELECT tenant_id, bucket, categoria, COUNT(*) AS n,
             SUM(COUNT(*)) OVER (PARTITION BY tenant_id, bucket) AS total
      FROM cb GROUP BY tenant_id, bucket, categoria) x"""


def words_cte(pack: RulePack, tok: str | None = None) -> str:
    tok = tok or f"""
tok AS (
  SELECT tenant_id, bucket, unnest(regexp_split_to_array(lower(texto), '{_q(pack.word_split)}')) AS word FROM cb)"""
    return f"""{tok},
wc AS (
  SELECT tenant_id, bucket, word, COUNT(*) AS n FROM tok
  WHERE length(word) >= 4 AND word NOT IN ({stop_list(pack)})
  GROUP BY tenant_id, bucket, word HAVING COUNT(*) >= 2)"""


def word_cloud_sql(params: Params, pack: RulePack, tok: str | None = None) -> str:
    return chat_with(text_cte(pack), words_cte(pack, tok), params=params) + """
SELECT tenant_id, bucket, word, n, rn FROM (
  SELECT tenant_id, bucket, word, n, ROW_NUMBER() OVER (PARTITION BY tenant_id, bucket ORDER BY n DESC, word) AS rn
  FROM wc) x WHERE rn <= 40"""


def mc_cte(pack: RulePack) -> str:
    return f"""
mc AS (
  SELECT tenant_id, conversation_id, message_id, content, {case_topic('content', pack, message_level=True)} AS mcat
  FROM base
  WHERE kind = 0 AND is_private = false AND content IS NOT NULL
    AND length(content) BETWEEN {pack.quote_min_len} AND {pack.quote_max_len}
    AND NOT regexp_matches(content, '{re2(pack.quote_exclude, word_start=False)}'))"""


def _no_quote(pack: RulePack) -> str:
    return ", ".join(f"'{_q(t)}'" for t in pack.no_quote_topics)


def sample_quotes_sql(params: Params, pack: RulePack) -> str:
    return chat_with(text_cte(pack), mc_cte(pack), f"""
fr AS (
  SELECT mc.tenant_id, mc.conversation_id, mc.content, cb.categoria, cb.bucket,
         ROW_NUMBER() OVER (PARTITION BY mc.tenant_id, mc.conversation_id, cb.categoria, cb.bucket
                            ORDER BY md5(mc.content), mc.message_id) AS k
  FROM mc JOIN cb ON cb.tenant_id = mc.tenant_id AND cb.conversation_id = mc.conversation_id AND cb.categoria = mc.mcat
  WHERE cb.categoria NOT IN ({_no_quote(pack)})),
ranked AS (
  SELECT tenant_id, bucket, categoria, content,
         ROW_NUMBER() OVER (PARTITION BY tenant_id, bucket, categoria ORDER BY md5(content), conversation_id) AS rn
  FROM fr WHERE k = 1)""", params=params) + "SELECT tenant_id, bucket, categoria, rn, content FROM ranked WHERE rn <= 3"


def period_report_sql(params: Params, pack: RulePack) -> str:
    tz = params.tz
    return chat_with(_period_labels(params), text_cte(pack), words_cte(pack), mc_cte(pack), f"""
k AS (SELECT m.tenant_id, p.bucket, COUNT(*) AS disparos, COUNT(DISTINCT m.contact_id) AS alunos
      FROM base m JOIN periods p ON {in_period()} WHERE m.kind = 1 AND m.is_private = true GROUP BY 1, 2),
mm AS (SELECT m.tenant_id, p.bucket, COUNT(*) FILTER (WHERE m.kind = 0) AS msgs_aluno,
              COUNT(*) FILTER (WHERE m.kind = 1) AS msgs_tcs,
              COUNT(DISTINCT m.conversation_id) FILTER (WHERE m.kind = 0) AS respostas
       FROM base m JOIN periods p ON {in_period()} WHERE m.is_private = false AND m.kind IN (0, 1) GROUP BY 1, 2),
a AS (SELECT tenant_id, bucket, COUNT(DISTINCT categoria) AS n_assuntos, COUNT(*) FILTER (WHERE menciona_desafio)
             AS n_mencionou FROM cb GROUP BY 1, 2),
nv AS (SELECT tenant_id, bucket, LEAST(COUNT(*), 40) AS n_nuvem FROM wc GROUP BY 1, 2),
fq AS (SELECT DISTINCT cb.tenant_id, cb.bucket, cb.categoria FROM mc
       JOIN cb ON cb.tenant_id = mc.tenant_id AND cb.conversation_id = mc.conversation_id AND cb.categoria = mc.mcat
       WHERE cb.categoria NOT IN ({_no_quote(pack)})),
f AS (SELECT tenant_id, bucket, COUNT(*) AS n_frases FROM fq GROUP BY 1, 2),
rt AS (SELECT m.tenant_id, p.bucket, COUNT(DISTINCT CAST({loc('m.ts', tz)} AS DATE)) AS n_ritmo
       FROM base m JOIN periods p ON {in_period()}
       WHERE p.bucket IN ('d7', 'd8_14', 'custom') AND m.is_private = false AND m.kind IN (0, 1) GROUP BY 1, 2),
hm AS (SELECT DISTINCT m.tenant_id, p.bucket, CAST(24 AS BIGINT) AS n_heatmap FROM base m JOIN periods p ON {in_period()}
       WHERE p.bucket IN ('d7', 'custom') AND m.is_private = false AND m.kind = 0)""", params=params) + f"""
SELECT t.tenant_id, p.bucket, l.label, l.sublabel,
  COALESCE(k.disparos, 0) AS disparos, COALESCE(mm.respostas, 0) AS respostas,
  {pct('COALESCE(mm.respostas, 0)', 'COALESCE(k.disparos, 0)')} AS taxa_resp,
  COALESCE(k.alunos, 0) AS alunos_atendidos,
  CASE WHEN COALESCE(k.alunos, 0) > 0 THEN CAST((200 * k.disparos + k.alunos) // (2 * k.alunos) AS DOUBLE) / 100
       ELSE 0 END AS disparos_por_aluno,
  COALESCE(mm.msgs_aluno, 0) AS msgs_aluno, COALESCE(mm.msgs_tcs, 0) AS msgs_tcs,
  COALESCE(a.n_assuntos, 0) AS n_assuntos, COALESCE(nv.n_nuvem, 0) AS n_nuvem, a.n_mencionou,
  COALESCE(f.n_frases, 0) AS n_frases, COALESCE(rt.n_ritmo, 0) AS n_ritmo, COALESCE(hm.n_heatmap, 0) AS n_heatmap
FROM tenants t JOIN periods p ON TRUE JOIN labels l ON l.bucket = p.bucket
LEFT JOIN k ON k.tenant_id = t.tenant_id AND k.bucket = p.bucket
LEFT JOIN mm ON mm.tenant_id = t.tenant_id AND mm.bucket = p.bucket
LEFT JOIN a ON a.tenant_id = t.tenant_id AND a.bucket = p.bucket
LEFT JOIN nv ON nv.tenant_id = t.tenant_id AND nv.bucket = p.bucket
LEFT JOIN f ON f.tenant_id = t.tenant_id AND f.bucket = p.bucket
LEFT JOIN rt ON rt.tenant_id = t.tenant_id AND rt.bucket = p.bucket
LEFT JOIN hm ON hm.tenant_id = t.tenant_id AND hm.bucket = p.bucket"""


def summary_leaves_sql(params: Params, pack: RulePack) -> str:
    """The whole document as (tenant_id, path, num, txt) leaf rows, built in SQL."""
    tz = params.tz
    months = ", ".join(f"'{m}'" for m in ("Jan", "Fev", "Mar", "Abr", "Mai", "Jun", "Jul", "Ago", "Set", "Out", "Nov", "Dez"))
    no_q = _no_quote(pack)
    ctes = chat_with(_period_labels(params), text_cte(pack), words_cte(pack), mc_cte(pack), TOTALS, f"""
sp AS (SELECT t.tenant_id, p.bucket, l.label, l.sublabel FROM tenants t JOIN periods p ON TRUE
       JOIN labels l ON l.bucket = p.bucket),
k AS (SELECT m.tenant_id, p.bucket, COUNT(*) AS disparos, COUNT(DISTINCT m.contact_id) AS alunos
      FROM base m JOIN periods p ON {in_period()} WHERE m.kind = 1 AND m.is_private = true GROUP BY 1, 2),
mm AS (SELECT m.tenant_id, p.bucket, COUNT(*) FILTER (WHERE m.kind = 0) AS msgs_aluno,
              COUNT(*) FILTER (WHERE m.kind = 1) AS msgs_tcs,
              COUNT(DISTINCT m.conversation_id) FILTER (WHERE m.kind = 0) AS respostas
       FROM base m JOIN periods p ON {in_period()} WHERE m.is_private = false AND m.kind IN (0, 1) GROUP BY 1, 2),
per_v AS (SELECT sp.tenant_id, sp.bucket,
          CAST(COALESCE(k.disparos, 0) AS DOUBLE) AS disparos, CAST(COALESCE(mm.respostas, 0) AS DOUBLE) AS respostas,
          {pct('COALESCE(mm.respostas, 0)', 'COALESCE(k.disparos, 0)')} AS taxa_resp,
          CAST(COALESCE(k.alunos, 0) AS DOUBLE) AS alunos_atendidos,
          CASE WHEN COALESCE(k.alunos, 0) > 0 THEN CAST((200 * k.disparos + k.alunos) // (2 * k.alunos) AS DOUBLE) / 100
               ELSE 0 END AS disparos_por_aluno,
          CAST(COALESCE(mm.msgs_aluno, 0) AS DOUBLE) AS msgs_aluno, CAST(COALESCE(mm.msgs_tcs, 0) AS DOUBLE) AS msgs_tcs
        FROM sp LEFT JOIN k ON k.tenant_id = sp.tenant_id AND k.bucket = sp.bucket
        LEFT JOIN mm ON mm.tenant_id = sp.tenant_id AND mm.bucket = sp.bucket),
tc AS (SELECT tenant_id, bucket, categoria, n, total,
              ROW_NUMBER() OVER (PARTITION BY tenant_id, bucket ORDER BY n DESC, categoria) - 1 AS i
       FROM (SELECT tenant_id, bucket, categoria, COUNT(*) AS n,
                    SUM(COUNT(*)) OVER (PARTITION BY tenant_id, bucket) AS total
             FROM cb GROUP BY tenant_id, bucket, categoria) x),
wr AS (SELECT * FROM (SELECT tenant_id, bucket, word, n,
                             ROW_NUMBER() OVER (PARTITION BY tenant_id, bucket ORDER BY n DESC, word) - 1 AS i
                      FROM wc) x WHERE i < 40),
fun AS (SELECT tenant_id, bucket, COUNT(*) AS n_conversas, COUNT(*) FILTER (WHERE menciona_desafio) AS n_m,
               COUNT(*) FILTER (WHERE engajou) AS n_e FROM cb GROUP BY 1, 2),
des_v AS (SELECT sp.tenant_id, sp.bucket, CAST(fun.n_m AS DOUBLE) AS n_mencionou,
               CASE WHEN fun.n_m IS NULL THEN NULL ELSE {pct('fun.n_m', 'fun.n_conversas')} END AS pct_mencionou,
               CAST(fun.n_e AS DOUBLE) AS n_engajou,
               CASE WHEN fun.n_m IS NULL THEN NULL ELSE {pct('fun.n_e', 'fun.n_m')} END AS pct_engajou
        FROM sp LEFT JOIN fun ON fun.tenant_id = sp.tenant_id AND fun.bucket = sp.bucket),
fr AS (SELECT mc.tenant_id, mc.conversation_id, mc.content, cb.categoria, cb.bucket,
              ROW_NUMBER() OVER (PARTITION BY mc.tenant_id, mc.conversation_id, cb.categoria, cb.bucket
                                 ORDER BY md5(mc.content), mc.message_id) AS k
       FROM mc JOIN cb ON cb.tenant_id = mc.tenant_id AND cb.conversation_id = mc.conversation_id AND cb.categoria = mc.mcat
       WHERE cb.categoria NOT IN ({no_q})),
qr AS (SELECT * FROM (SELECT tenant_id, bucket, categoria, content,
                             ROW_NUMBER() OVER (PARTITION BY tenant_id, bucket, categoria
                                                ORDER BY md5(content), conversation_id) - 1 AS i
                      FROM fr WHERE k = 1) x WHERE i < 3),
rd AS (SELECT m.tenant_id, p.bucket, CAST({loc('m.ts', tz)} AS DATE) AS dia,
              COUNT(*) FILTER (WHERE m.kind = 0) AS rec, COUNT(*) FILTER (WHERE m.kind = 1) AS env
       FROM base m JOIN periods p ON {in_period()}
       WHERE p.bucket IN ('d7', 'd8_14', 'custom') AND m.is_private = false AND m.kind IN (0, 1) GROUP BY 1, 2, 3),
rr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY tenant_id, bucket ORDER BY dia) - 1 AS i FROM rd),
hb AS (SELECT m.tenant_id, p.bucket, CAST(hour({loc('m.ts', tz)}) AS INTEGER) AS h, COUNT(*) AS n
       FROM base m JOIN periods p ON {in_period()}
       WHERE p.bucket IN ('d7', 'custom') AND m.is_private = false AND m.kind = 0 GROUP BY 1, 2, 3),
ob AS (SELECT DISTINCT tenant_id, bucket FROM hb),
hm AS (SELECT ob.tenant_id, ob.bucket, CAST(g.h AS INTEGER) AS h, COALESCE(hb.n, 0) AS n
       FROM ob JOIN range(24) g(h) ON TRUE
       LEFT JOIN hb ON hb.tenant_id = ob.tenant_id AND hb.bucket = ob.bucket AND hb.h = g.h),
all_v AS (SELECT t.tenant_id,
         CAST(COALESCE(disparos, 0) AS DOUBLE) AS disparos, CAST(COALESCE(respostas, 0) AS DOUBLE) AS respostas,
         {pct('COALESCE(respostas, 0)', 'COALESCE(disparos, 0)')} AS taxa_resp,
         CAST(COALESCE(alunos, 0) AS DOUBLE) AS alunos_atendidos,
         CASE WHEN COALESCE(alunos, 0) > 0 THEN CAST((200 * disparos + alunos) // (2 * alunos) AS DOUBLE) / 100
              ELSE 0 END AS disparos_por_aluno,
         CAST(COALESCE(conversas_unicas, 0) AS DOUBLE) AS conversas_unicas,
         CAST((2 * dias * goal + 30) // 60 AS DOUBLE) AS meta_proporcional,
         CASE WHEN dias > 0 AND goal > 0
              THEN CAST((60000 * COALESCE(disparos, 0) + dias * goal) // (2 * dias * goal) AS DOUBLE) / 10 ELSE 0 END
           AS pct_meta,
         CASE WHEN dias > 0 THEN CAST((20 * COALESCE(disparos, 0) + dias) // (2 * dias) AS DOUBLE) / 10 ELSE 0 END
           AS pace_diario
       FROM tenants t LEFT JOIN tot ON tot.tenant_id = t.tenant_id JOIN cfg ON TRUE),
mon_v AS (SELECT t.tenant_id,
         CAST(COALESCE(mes_disparos, 0) AS DOUBLE) AS disparos, CAST(COALESCE(mes_respostas, 0) AS DOUBLE) AS respostas,
         {pct('COALESCE(mes_respostas, 0)', 'COALESCE(mes_disparos, 0)')} AS taxa_resp,
         CAST(COALESCE(mes_alunos, 0) AS DOUBLE) AS alunos_atendidos,
         CAST(dias_mes AS DOUBLE) AS dias_decorridos, CAST(goal AS DOUBLE) AS meta,
         CAST((2 * dias_mes * goal + 30) // 60 AS DOUBLE) AS meta_proporcional,
         CASE WHEN dias_mes > 0 AND goal > 0
              THEN CAST((60000 * COALESCE(mes_disparos, 0) + dias_mes * goal) // (2 * dias_mes * goal) AS DOUBLE) / 10
              ELSE 0 END AS pct_meta,
         CASE WHEN dias_mes > 0 THEN CAST((60 * COALESCE(mes_disparos, 0) + dias_mes) // (2 * dias_mes) AS DOUBLE)
              ELSE 0 END AS projecao_fim_mes
       FROM tenants t LEFT JOIN tot ON tot.tenant_id = t.tenant_id JOIN cfg ON TRUE)""", params=params)
    pre = "'periodos.' || bucket || '."
    return ctes + f"""
SELECT t.tenant_id, 'atualizado_em' AS path, CAST(NULL AS DOUBLE) AS num, strftime(l_now, '%Y-%m-%d %H:%M') AS txt
  FROM tenants t JOIN cfg ON TRUE
UNION ALL SELECT t.tenant_id, 'inicio_projeto', NULL, strftime(DATE '{params.project_start}', '%Y-%m-%d') FROM tenants t
UNION ALL SELECT t.tenant_id, 'meta_mensal', CAST(goal AS DOUBLE), NULL FROM tenants t JOIN cfg ON TRUE
UNION ALL SELECT t.tenant_id, 'dias_corridos', CAST(dias AS DOUBLE), NULL FROM tenants t JOIN cfg ON TRUE
UNION ALL SELECT tenant_id, 'alltime.' || name, value, NULL FROM (UNPIVOT all_v ON COLUMNS(* EXCLUDE (tenant_id))
                                                                   INTO NAME name VALUE value)
UNION ALL SELECT tenant_id, 'mes_atual.' || name, value, NULL FROM (UNPIVOT mon_v ON COLUMNS(* EXCLUDE (tenant_id))
                                                                     INTO NAME name VALUE value)
UNION ALL SELECT t.tenant_id, 'mes_atual.label', NULL,
                 ([{months}])[month(l_now)] || '/' || strftime(l_now, '%y') FROM tenants t JOIN cfg ON TRUE
UNION ALL SELECT tenant_id, {pre}label', NULL, label FROM sp
UNION ALL SELECT tenant_id, {pre}sublabel', NULL, sublabel FROM sp
UNION ALL SELECT tenant_id, {pre}' || name, value, NULL FROM (UNPIVOT per_v ON COLUMNS(* EXCLUDE (tenant_id, bucket))
                                                              INTO NAME name VALUE value)
UNION ALL SELECT tenant_id, {pre}assuntos[' || i || '].cat', NULL, categoria FROM tc
UNION ALL SELECT tenant_id, {pre}assuntos[' || i || '].n', CAST(n AS DOUBLE), NULL FROM tc
UNION ALL SELECT tenant_id, {pre}assuntos[' || i || '].pct', {pct('n', 'total')}, NULL FROM tc
UNION ALL SELECT tenant_id, {pre}nuvem[' || i || '].w', NULL, word FROM wr
UNION ALL SELECT tenant_id, {pre}nuvem[' || i || '].n', CAST(n AS DOUBLE), NULL FROM wr
UNION ALL SELECT tenant_id, {pre}desafio.' || name, value, NULL
  FROM des_v UNPIVOT INCLUDE NULLS (value FOR name IN (n_mencionou, pct_mencionou, n_engajou, pct_engajou))
UNION ALL SELECT tenant_id, {pre}frases.' || categoria || '[' || i || ']', NULL, content FROM qr
UNION ALL SELECT tenant_id, {pre}ritmo[' || i || '].dia', NULL, strftime(dia, '%d/%m') FROM rr
UNION ALL SELECT tenant_id, {pre}ritmo[' || i || '].rec', CAST(rec AS DOUBLE), NULL FROM rr
UNION ALL SELECT tenant_id, {pre}ritmo[' || i || '].env', CAST(env AS DOUBLE), NULL FROM rr
UNION ALL SELECT tenant_id, {pre}heatmap[' || h || ']', CAST(n AS DOUBLE), NULL FROM hm"""
