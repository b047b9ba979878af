"""Whole document for a hand-made tenant, compared by value; and the
per-message topic decomposition against joined texts (brute force)."""

import datetime as dt
import json
import random

import regex
from conftest import make_conversations, make_messages, utc

from colloquy import Dashboard, Params, REFERENCE_PACK

PARAMS = Params(as_of=utc(2024, 2, 14, 12, 0), project_start=dt.date(2024, 1, 1), monthly_goal=30,
                tenants=("t1", "t2"))

MSGS = [
    ("t1", 1, 1, 1, True, utc(2024, 2, 10, 12), None),
    ("t1", 1, 2, 0, False, utc(2024, 2, 10, 13), "quero cancelar minha inscrição"),
    ("t1", 1, 3, 1, False, utc(2024, 2, 10, 14), "ok, vou verificar"),
    ("t1", 2, 4, 1, True, utc(2024, 1, 20, 12), None),
    ("t1", 2, 5, 0, False, utc(2024, 1, 20, 15), "adorei o curso, muito bom mesmo"),
    ("t1", 3, 6, 1, True, utc(2024, 2, 10, 12), None),
]
CONVS = [("t1", 1, 100, "Ana"), ("t1", 2, 200, "Bruno"), ("t1", 3, 300, "Tiago Teste")]

EMPTY_PERIOD = {"disparos": 0, "respostas": 0, "taxa_resp": 0.0, "alunos_atendidos": 0, "disparos_por_aluno": 0.0,
                "msgs_aluno": 0, "msgs_tcs": 0, "assuntos": [], "nuvem": [], "desafio": {}, "frases": {},
                "ritmo": [], "heatmap": []}
ZERO_FUNNEL = {"n_mencionou": 0, "pct_mencionou": 0.0, "n_engajou": 0, "pct_engajou": 0.0}


def labels(bucket):
    return {"d7": {"label": "Últimos 7 dias", "sublabel": "07/02 a 14/02"},
            "d8_14": {"label": "Semana retrasada", "sublabel": "31/01 a 06/02"},
            "mes_fechado": {"label": "Mês de Jan/24", "sublabel": "01/01/2024 a 31/01/2024"}}[bucket]


def expected_t1():
    hm = [0] * 24
    hm[10] = 1
    return {
        "atualizado_em": "2024-02-14 09:00", "inicio_projeto": "2024-01-01", "meta_mensal": 30, "dias_corridos": 44,
        "alltime": {"disparos": 2, "respostas": 2, "taxa_resp": 100.0, "alunos_atendidos": 2,
                    "disparos_por_aluno": 1.0, "conversas_unicas": 2, "meta_proporcional": 44, "pct_meta": 4.5,
                    "pace_diario": 0.0},
        "mes_atual": {"label": "Fev/24", "disparos": 1, "respostas": 1, "taxa_resp": 100.0, "alunos_atendidos": 1,
                      "dias_decorridos": 14, "meta": 30, "meta_proporcional": 14, "pct_meta": 7.1,
                      "projecao_fim_mes": 2},
        "periodos": {
            "d7": {**labels("d7"), "disparos": 1, "respostas": 1, "taxa_resp": 100.0, "alunos_atendidos": 1,
                   "disparos_por_aluno": 1.0, "msgs_aluno": 1, "msgs_tcs": 1,
                   "assuntos": [{"cat": "risco", "n": 1, "pct": 100.0}], "nuvem": [], "desafio": ZERO_FUNNEL,
                   "frases": {"risco": ["quero cancelar minha inscrição"]},
                   "ritmo": [{"dia": "10/02", "rec": 1, "env": 1}], "heatmap": hm},
            "d8_14": {**labels("d8_14"), **EMPTY_PERIOD},
            "mes_fechado": {**labels("mes_fechado"), "disparos": 1, "respostas": 1, "taxa_resp": 100.0,
                            "alunos_atendidos": 1, "disparos_por_aluno": 1.0, "msgs_aluno": 1, "msgs_tcs": 0,
                            "assuntos": [{"cat": "elogios", "n": 1, "pct": 100.0}], "nuvem": [],
                            "desafio": ZERO_FUNNEL, "frases": {"elogios": ["adorei o curso, muito bom mesmo"]},
                            "ritmo": [], "heatmap": []},
        },
    }


def test_golden_document(spark):
    for how in ("cache", "table"):
        d = Dashboard.from_tables(make_messages(spark, MSGS), make_conversations(spark, CONVS), PARAMS,
                                  REFERENCE_PACK, how=how)
        docs = {r["tenant_id"]: json.loads(r["doc"]) for r in d.summary_json().collect()}
        d.close()
        assert docs["t1"] == expected_t1(), how
        t2 = docs["t2"]
        assert t2["alltime"] == {"disparos": 0, "respostas": 0, "taxa_resp": 0.0, "alunos_atendidos": 0,
                                 "disparos_por_aluno": 0.0, "conversas_unicas": 0, "meta_proporcional": 44,
                                 "pct_meta": 0.0, "pace_diario": 0.0}
        assert t2["periodos"] == {b: {**labels(b), **EMPTY_PERIOD} for b in ("d7", "d8_14", "mes_fechado")}


# --- decomposition: topic of the joined text == min over messages -------------
def plain(rule):
    ws = r"(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_])" if rule.word_start else ""
    guard = f"(?<!{rule.guard})" if rule.guard else ""
    return regex.compile(f"(?is){ws}{guard}(?:{rule.keywords})")


def test_topics_equal_joined_text_classification(spark):
    rules = [(r.topic, plain(r)) for r in REFERENCE_PACK.rules]
    mention, engage = plain_kw(REFERENCE_PACK.mention), plain_kw(REFERENCE_PACK.engage)
    frags = ["não", "quero", "cancelar", "mais", "agradecemos", "seu", "contato", "mensagem", "sou", "a", "corretora",
             "desafio", "bora", "vou", "fazer", "curso", "é", "ótimo", "|", "assim que possível", "retorno", "em breve",
             "envio", "👉", "escolha a", "escolha", "obrigada", "nunca", "arrematei", "tô", "dentro", "xx"]
    rnd = random.Random(11)
    msgs, texts = [], {}
    mid = 0
    for conv in range(400):
        parts = []
        for k in range(rnd.randint(1, 5)):
            mid += 1
            t = " ".join(rnd.choice(frags) for _ in range(rnd.randint(1, 6)))
            msgs.append(("t", conv, mid, 0, False, utc(2024, 2, 10, 0, 0, k), t))
            if len(t) >= 6:
                parts.append(t)
        if parts:
            texts[conv] = " | ".join(parts)
    # a rule that ends in a space takes the joint's space, but not after the last message
    for conv, parts in ((400, ["Por favor escolha a", "segunda mensagem aqui"]), (401, ["segunda mensagem aqui", "Por favor escolha a"])):
        texts[conv] = " | ".join(parts)
        for k, t in enumerate(parts):
            mid += 1
            msgs.append(("t", conv, mid, 0, False, utc(2024, 2, 10, 0, 0, k), t))
    convs = [("t", c, c, "x") for c in range(402)]
    params = Params(as_of=utc(2024, 2, 14, 12, 0), project_start=dt.date(2024, 1, 1))
    d = Dashboard.from_tables(make_messages(spark, msgs), make_conversations(spark, convs), params, how="none")
    got = {r["conversation_id"]: (r["categoria"], r["menciona_desafio"], r["engajou"])
           for r in d.conversation_topics().collect()}
    want = {}
    for c, text in texts.items():
        topic = next((name for name, rx in rules if rx.search(text)), REFERENCE_PACK.default_topic)
        m = bool(mention.search(text))
        want[c] = (topic, m, m and bool(engage.search(text)))
    assert got == want
    assert got[400][0] == "automatico" and got[401][0] == REFERENCE_PACK.default_topic


def plain_kw(keywords):
    return regex.compile(r"(?is)(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_])(?:" + keywords + ")")
