"""The report's rule pack on hand-made texts (the change notes of the rules),
and the rewritten Java regexes against a plain reading with Python's ``regex``."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from colloquy.functions.regex import first_char_class, matches
from colloquy.operators.topics import classify
from colloquy.plans.rules import REFERENCE_PACK as P

CASES = [
    # (text, conversation topic)
    ("não tenho dúvida nenhuma", "outros"),
    ("tenho dúvida sobre a aula", "dificuldade"),
    ("nunca arrematei nada", "outros"),
    ("arrematei meu primeiro imóvel!", "prova"),
    ("não gostei muito", "outros"),
    ("gostei muito do conteúdo", "elogios"),
    ("o curso é excelente", "elogios"),
    ("não fui avisado do horário", "dificuldade"),
    ("como funciona o desafio?", "dificuldade"),
    ("estou grávida", "afetivo"),
    ("fiz uma cirurgia", "afetivo"),
    ("meu pai está internado", "afetivo"),
    ("vou maratonar amanhã", "compromisso"),
    ("fiz uma venda", "outros"),
    ("tive um resultado", "outros"),
    ("Agradecemos o seu contato, responderemos em breve", "automatico"),
    ("Sou corretora de imóveis, CRECI 123", "automatico"),
    ("acesso liberado, obrigado", "acesso"),
    ("NÃO QUERO MAIS o curso", "risco"),
    ("não cancelar", "outros"),
    ("não cancelar. quero cancelar", "risco"),
    ("não, cancelar", "risco"),
    ("não  cancelar", "risco"),
    ("descancelar", "outros"),
    ("écancelar", "outros"),
    ("_cancelar", "outros"),
    ("quero cancelar a plataforma", "risco"),
    ("a plataforma me ajuda", "tecnico"),
    ("Não é difícil", "outros"),
    ("ainda não arrematei", "outros"),
    ("agradeco pelo contato", "automatico"),
    ("agradeco | pelo contato", "outros"),
    ("👉 clique aqui", "automatico"),
    ("CANCELAR", "risco"),
    ("Cancelar", "risco"),
]


@pytest.fixture(scope="module")
def classified(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    rows = df.select("i", classify(F.col("t"), P).alias("c"), classify(F.col("t"), P, message_level=True).alias("m"),
                     matches(F.col("t"), P.mention).alias("men")).collect()
    return {r["i"]: r for r in rows}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_change_notes(classified, i):
    text, want = CASES[i]
    assert classified[i]["c"] == want, text


def test_message_chain_has_no_auto_reply_topic(classified):
    for i, (text, want) in enumerate(CASES):
        expect = "outros" if want == "automatico" else want
        assert classified[i]["m"] == expect, text


def test_mention(classified):
    assert classified[8]["men"]  # "como funciona o desafio?"
    assert not classified[0]["men"]


def test_first_char_class_is_exact_superset():
    assert first_char_class("abc|[xy]z|(?:q|r)s") == "[[a][xy][q][r]]"
    assert first_char_class("a?b|c") is None
    assert first_char_class(".x") is None


# --- brute force: Java rewrite vs. a plain reading of the rules --------------
def plain(rule):
    ws = r"(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_])" if rule.word_start else ""
    guard = f"(?<!{rule.guard})" if rule.guard else ""
    return regex.compile(f"(?is){ws}{guard}(?:{rule.keywords})")


PLAIN = [plain(r) for r in P.rules]
WORDS = ["não", "nao", "nunca", "jamais", "ainda", "é", "tá", "vou", "quero", "cancelar", "plataforma", "login",
         "dúvida", "tenho", "me", "ajuda", "difícil", "arrematei", "primeiro", "resultado", "amei", "curso", "é",
         "excelente", "acesso", "liberado", "assistindo", "módulo", "bora", "grupo", "obrigada", "filho", "sou",
         "corretora", "de", "imóveis", "creci", "👉", "desafio", "topo", "Não", "CANCELAR", "x", "_", ",", "|", "ok",
         "agradecemos", "agradeço", "contato", "mensagem", "como", "posso", "podemos", "te", "lhe", "ajudar", "escolha",
         "uma", "opção", "seja", "muito", "bem-vindo", "bemvinda", "à", "disposição", "a", "plantão", "setor", "vendas",
         "central", "assim", "que", "possível", "retorno", "em", "breve", "envio", "realizando", "o", "sonho", "🏡",
         "🔑", "imobiliária", "despachante", "especialista", "financiamento", "imobiliário", "locação", "im", "Maria",
         "consultora", "estou", "atendimento", "informe", "seu", "nome", "SOU", "Agradeco", "ESCOLHA"]


def plain_topic(text):
    for r, rx in zip(P.rules, PLAIN):
        if rx.search(text):
            return r.topic
    return P.default_topic


def test_random_texts_agree_with_plain_regex(spark):
    rnd = random.Random(7)
    texts = []
    for _ in range(6000):
        n = rnd.randint(1, 12)
        texts.append(" ".join(rnd.choice(WORDS) for _ in range(n)).replace(" ,", ",") + rnd.choice(["", ".", "!"]))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", classify(F.col("t"), P).alias("c")).collect()}
    bad = [(t, got[i], plain_topic(t)) for i, t in enumerate(texts) if got[i] != plain_topic(t)]
    assert not bad, bad[:5]


def test_random_texts_agree_with_sql_oracle_form(spark):
    """The DuckDB form of the rules (marked negators, RE2) against Spark on the
    same random texts; texts with a negator-initial keyword right after a second
    negator are the documented blind spot of the SQL form and are skipped."""
    import duckdb

    from colloquy.plans.oracles import case_topic

    rnd = random.Random(13)
    texts = []
    for _ in range(4000):
        n = rnd.randint(1, 12)
        texts.append(" ".join(rnd.choice(WORDS) for _ in range(n)).replace(" ,", ",") + rnd.choice(["", ".", "!"]))
    blind = regex.compile(r"(?i)(nunca|jamais|n[ãa]o|ainda n[ãa]o) (\w+ )?n[ãa]o ")
    texts = [t for t in texts if not blind.search(t)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    want = dict(con.execute(f"SELECT i, {case_topic('text', P)} FROM t").fetchall())
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r["c"] for r in df.select("i", classify(F.col("text"), P).alias("c")).collect()}
    bad = [(texts[i], got[i], want[i]) for i in got if got[i] != want[i]]
    assert not bad, bad[:5]
