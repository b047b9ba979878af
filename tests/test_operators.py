"""Hand-made cases for the operators (one small tenant world per test)."""

import datetime as dt
import json

from conftest import make_conversations, make_messages, utc

from colloquy import Dashboard, Params, REFERENCE_PACK
from colloquy.operators.periods import assign_periods
from colloquy.plans.calendar import build_calendar
from colloquy.plans.rules import Rule, RulePack

AS_OF = utc(2024, 2, 14, 12, 0)
PARAMS = Params(as_of=AS_OF, project_start=dt.date(2024, 1, 1), monthly_goal=30)


def dash(spark, msgs, convs=None, params=PARAMS, pack=REFERENCE_PACK):
    if convs is None:
        ids = sorted({(m[0], m[1]) for m in msgs})
        convs = [(t, c, c * 10, f"Pessoa {c}") for t, c in ids]
    return Dashboard.from_tables(make_messages(spark, msgs), make_conversations(spark, convs), params, pack, how="none")


def test_overlap_gives_one_row_per_period(spark):
    p = Params(as_of=utc(2024, 2, 5, 12), custom_start=dt.date(2024, 1, 20), custom_end=dt.date(2024, 1, 31))
    df = make_messages(spark, [("t", 1, 1, 0, False, utc(2024, 1, 30, 12), "x")])
    got = sorted(r["bucket"] for r in assign_periods(df, "ts", build_calendar(p)).collect())
    assert got == ["custom", "d7", "mes_fechado"]


def test_null_private_counts_nowhere(spark):
    d = dash(spark, [("t", 1, 1, 1, None, utc(2024, 2, 10), "nota"), ("t", 1, 2, 0, None, utc(2024, 2, 10), "oi oi oi")])
    assert d.dispatch_kpis().count() == 0
    assert d.message_kpis().count() == 0
    t = d.totals().first()
    assert (t["disparos"], t["respostas"], t["conversas_unicas"]) == (0, 0, 0)


def test_contact_name_exclusion(spark):
    msgs = [("t", c, c, 1, True, utc(2024, 2, 10), None) for c in (1, 2, 3, 4)]
    convs = [("t", 1, 10, "Tiago Silva"), ("t", 2, 20, "joão TESTE"), ("t", 3, 30, None), ("t", 4, 40, "Ana")]
    d = dash(spark, msgs, convs)
    assert sorted(r["conversation_id"] for r in d.base.collect()) == [3, 4]


def test_conversation_text_keeps_six_plus_characters(spark):
    msgs = [("t", 1, 1, 0, False, utc(2024, 2, 10, 1), "12345"),
            ("t", 1, 2, 0, False, utc(2024, 2, 10, 2), "123456"),
            ("t", 1, 3, 0, False, utc(2024, 2, 10, 3), None),
            ("t", 1, 4, 0, False, utc(2024, 2, 10, 4), "abcd")]
    r = dash(spark, msgs).conversation_topics().first()
    assert r["n_msgs"] == 1 and r["ult_msg"] == dt.datetime(2024, 2, 10, 2)


def test_topic_share_one_of_eight(spark):
    msgs = [("t", c, c, 0, False, utc(2024, 2, 10), "quero cancelar tudo" if c == 1 else "bom dia pessoal")
            for c in range(1, 9)]
    rows = {r["categoria"]: r for r in dash(spark, msgs).topic_distribution().where("bucket = 'd7'").collect()}
    assert rows["risco"]["n"] == 1 and rows["risco"]["pct_tenths"] == 125
    assert rows["outros"]["n"] == 7 and rows["outros"]["pct_tenths"] == 875


def test_word_cloud_rules(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(41)]  # 41 distinct 4-letter words
    texts = [" ".join(words), " ".join(words), "solitario", "abc abc", "para para", "palavra palavra palavra"]
    msgs = [("t", 1, i, 0, False, utc(2024, 2, 10, i), t) for i, t in enumerate(texts)]
    cloud = dash(spark, msgs).word_cloud().where("bucket = 'd7'").orderBy("rn").collect()
    assert len(cloud) == 40
    assert (cloud[0]["word"], cloud[0]["n"]) == ("palavra", 3)
    assert [r["word"] for r in cloud[1:]] == sorted(words)[:39]
    got = {r["word"] for r in cloud}
    assert not got & {"solitario", "abc", "para"}


def test_funnel_without_mentions_is_zero_not_null(spark):
    msgs = [("t", 1, 1, 0, False, utc(2024, 2, 10), "bom dia pessoal")]
    r = dash(spark, msgs).mention_funnel().where("bucket = 'd7'").first()
    assert (r["n_mencionou"], r["pct_mencionou_tenths"], r["n_engajou"], r["pct_engajou_tenths"]) == (0, 0, 0, 0)


def test_funnel_mention_and_engagement(spark):
    msgs = [("t", 1, 1, 0, False, utc(2024, 2, 10), "sobre o desafio"),
            ("t", 1, 2, 0, False, utc(2024, 2, 11), "bora lá"),
            ("t", 2, 3, 0, False, utc(2024, 2, 10), "desafios são bons"),
            ("t", 3, 4, 0, False, utc(2024, 2, 10), "nada a ver")]
    r = dash(spark, msgs).mention_funnel().where("bucket = 'd7'").first()
    assert (r["n_conversas"], r["n_mencionou"], r["n_engajou"]) == (3, 2, 1)
    assert (r["pct_mencionou_tenths"], r["pct_engajou_tenths"]) == (667, 500)


def test_heatmap_local_hour_and_dense(spark):
    from colloquy.operators.rhythm import heatmap_folded
    msgs = [("t", 1, 1, 0, False, utc(2024, 2, 10, 5, 0), "oi")]
    rows = heatmap_folded(dash(spark, msgs).hourly_heatmap()).collect()
    assert len(rows) == 1 and rows[0]["bucket"] == "d7"
    hm = rows[0]["heatmap"]
    assert len(hm) == 24 and hm[2] == 1 and sum(hm) == 1


def test_rhythm_days_without_traffic_are_absent(spark):
    msgs = [("t", 1, 1, 0, False, utc(2024, 2, 8, 12), "oi"), ("t", 1, 2, 1, False, utc(2024, 2, 11, 12), "olá")]
    rows = sorted((r["bucket"], str(r["dia"]), r["rec"], r["env"]) for r in dash(spark, msgs).daily_rhythm().collect())
    assert rows == [("d7", "2024-02-08", 1, 0), ("d7", "2024-02-11", 0, 1)]


def test_quote_filters(spark):
    base = "quero cancelar "
    msgs = [("t", 1, 1, 0, False, utc(2024, 2, 10, 1), (base + "x" * 24)[:24]),
            ("t", 2, 2, 0, False, utc(2024, 2, 10, 1), (base + "x" * 25)[:25]),
            ("t", 3, 3, 0, False, utc(2024, 2, 10, 1), (base + "x" * 250)[:250]),
            ("t", 4, 4, 0, False, utc(2024, 2, 10, 1), (base + "x" * 251)[:251]),
            ("t", 5, 5, 0, False, utc(2024, 2, 10, 1), "quero cancelar, retorno em breve ok"),
            # conversation is risco (first message), this message is elogios: not a quote
            ("t", 6, 6, 0, False, utc(2024, 2, 10, 1), "quero cancelar"),
            ("t", 6, 7, 0, False, utc(2024, 2, 10, 2), "adorei o curso, de verdade mesmo")]
    q = dash(spark, msgs).sample_quotes().collect()
    assert sorted(len(r["content"]) for r in q) == [25, 250]
    assert {r["categoria"] for r in q} == {"risco"}


def test_quotes_top3_stable_by_md5(spark):
    import hashlib
    texts = [f"quero cancelar a inscrição número {i}" for i in range(6)]
    msgs = [("t", i, i, 0, False, utc(2024, 2, 10), t) for i, t in enumerate(texts)]
    q = dash(spark, msgs).sample_quotes().where("bucket = 'd7'").orderBy("rn").collect()
    want = sorted(texts, key=lambda t: hashlib.md5(t.encode()).hexdigest())[:3]
    assert [r["content"] for r in q] == want


def test_custom_pack_guard_marks(spark):
    pack = RulePack(rules=(Rule("a", "thing", guard="that "),), default_topic="z", mention="x", engage="y",
                    quote_exclude="qqq")
    msgs = [("t", 1, 1, 0, False, utc(2024, 2, 10), "that thing here"),
            ("t", 2, 2, 0, False, utc(2024, 2, 10), "that thing, then thing"),
            ("t", 3, 3, 0, False, utc(2024, 2, 10), "that, thing")]
    got = {r["conversation_id"]: r["categoria"] for r in dash(spark, msgs, pack=pack).conversation_topics().collect()}
    assert got == {1: "z", 2: "a", 3: "a"}


def test_empty_tenant_gets_a_full_document(spark):
    p = Params(as_of=AS_OF, project_start=dt.date(2024, 1, 1), monthly_goal=30, tenants=("t", "empty"))
    msgs = [("t", 1, 1, 1, True, utc(2024, 2, 10), None)]
    d = dash(spark, msgs, params=p)
    docs = {r["tenant_id"]: json.loads(r["doc"]) for r in d.summary_json().collect()}
    e = docs["empty"]
    assert e["alltime"]["disparos"] == 0 and e["mes_atual"]["projecao_fim_mes"] == 0
    assert set(e["periodos"]) == {"d7", "d8_14", "mes_fechado"}
    for per in e["periodos"].values():
        assert per["disparos"] == 0 and per["assuntos"] == [] and per["nuvem"] == [] and per["desafio"] == {}
        assert per["frases"] == {} and per["ritmo"] == [] and per["heatmap"] == []
    assert docs["t"]["periodos"]["d7"]["disparos"] == 1


def test_quotes_are_not_time_filtered(spark):
    # the candidate is from January; the conversation's latest text message puts it in d7
    msgs = [("t", 1, 1, 0, False, utc(2024, 1, 5, 12), "quero cancelar minha assinatura hoje"),
            ("t", 1, 2, 0, False, utc(2024, 2, 10, 12), "ok ok ok")]
    q = dash(spark, msgs).sample_quotes().collect()
    assert [(r["bucket"], r["content"]) for r in q] == [("d7", "quero cancelar minha assinatura hoje")]


def test_null_contact_dispatch_counts_without_a_student(spark):
    msgs = [("t", 1, 1, 1, True, utc(2024, 2, 10), None), ("t", 2, 2, 1, True, utc(2024, 2, 10), None)]
    convs = [("t", 1, None, "Ana"), ("t", 2, 20, "Bia")]
    d = dash(spark, msgs, convs)
    k = d.dispatch_kpis().where("bucket = 'd7'").first()
    assert (k["disparos"], k["alunos_atendidos"]) == (2, 1)
    t = d.totals().first()
    assert (t["disparos"], t["alunos"]) == (2, 1)
