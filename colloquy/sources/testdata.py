"""Adapters from the generated test tables to the canonical schema.

A. ``conversations`` (conv_id, turn, role, text) + ``customer`` -> chat messages
   and conversations; used by the text operators.
B. ``events`` (event_id, ts, user_id, event_type, value, props) -> a message
   base at volume; used by the counting and calendar operators.

Both only project and compute columns, so filters and column pruning still
reach the Parquet scans.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import Params
from ..plans.rules import Rule, RulePack

# Fixed test parameters (see FIXTURES.md).
CHAT_PARAMS = Params(
    as_of=dt.datetime(2024, 2, 14, 12, 0, tzinfo=dt.timezone.utc),
    tz="America/Sao_Paulo",
    project_start=dt.date(2024, 1, 1),
    monthly_goal=30,
    exclude_patterns=("%7%",),
)
# The chat parameters with a custom range (2024-01-20 .. 2024-02-10, inclusive).
CHAT_CUSTOM_PARAMS = Params(
    as_of=dt.datetime(2024, 2, 14, 12, 0, tzinfo=dt.timezone.utc),
    tz="America/Sao_Paulo",
    project_start=dt.date(2024, 1, 1),
    monthly_goal=30,
    custom_start=dt.date(2024, 1, 20),
    custom_end=dt.date(2024, 2, 10),
    exclude_patterns=("%7%",),
)
EVENT_PARAMS = Params(
    as_of=dt.datetime(2024, 2, 5, 12, 0, tzinfo=dt.timezone.utc),
    tz="America/Sao_Paulo",
    project_start=dt.date(2024, 1, 1),
    monthly_goal=30,
    custom_start=dt.date(2024, 1, 10),
    custom_end=dt.date(2024, 1, 20),
    exclude_patterns=(),
)
# Each tenant's own call in the queries that test them (tenant "t" of N_TENANTS).
def call_params(t: int) -> Params:
    """The chat parameters with tenant t's own project start, goal and custom range."""
    start = dt.date(2024, 1, 5) + dt.timedelta(days=8 * t)
    return Params(as_of=CHAT_PARAMS.as_of, tz=CHAT_PARAMS.tz, project_start=dt.date(2024, 1, 1) + dt.timedelta(days=9 * t),
                  monthly_goal=30 + 17 * t, custom_start=start, custom_end=start + dt.timedelta(days=6 + 5 * t), exclude_patterns=("%7%",))


N_TENANTS = 3
N_CONTACTS = 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    hours = ((conv * 331) % 1080).cast("int")
    minutes = (turn * 7).cast("int")
    return c.select(
        (conv % N_TENANTS).cast("string").alias("tenant_id"),
        conv.alias("conversation_id"),
        (conv * 1000 + turn).alias("message_id"),
        F.when(F.col("role") == "user", F.lit(0)).otherwise(F.lit(1)).alias("kind"),
        (F.col("role") == "system").alias("is_private"),
        (F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), hours, minutes, F.lit(0))).alias("ts"),
        F.col("text").alias("content"),
    )


# Fixed test phrases, one put before each text of ``phrase_messages``: something for every rule of the report, negated
# forms that its guards leave out, mentions with and without engagement, automatic replies and plain talk.
PHRASES = (
    "quero cancelar a minha inscrição hoje", "não quero cancelar nada, fique tranquila", "a plataforma caiu de novo agora há pouco", "não entendi a segunda parte da explicação",
    "ele nunca me ajuda quando eu pergunto", "arrematei um apartamento pequeno no centro", "ainda não arrematei nenhum por aqui", "amei cada minuto da transmissão de ontem",
    "não amei tanto quanto esperava", "consegui acessar tudo pelo celular novo", "estou assistindo pela segunda vez", "vou estudar amanhã bem cedo", "o telegram da turma está animado",
    "minha esposa pediu para avisar", "agradecemos o contato e a paciência", "sou corretor de imóveis aqui perto", "sobre o desafio: aceito com certeza", "o desafio vai até que dia mesmo",
    "nada de novo por enquanto por aqui", "bom dia a todos do time", "em breve envio os documentos que faltam", "jamais vou pedir reembolso disso", "recomendo para quem está começando agora", "peço desculpas pela demora",
)


def phrase_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chat messages with a phrase of ``PHRASES`` before the beginning of their text, so that every rule has something to find."""
    m = chat_messages(spark, sf_dir)
    conv = F.col("conversation_id")
    turn = F.col("message_id") - conv * 1000
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), ((conv * 7 + turn * 5) % len(PHRASES) + 1).cast("int"))
    start = F.substr(F.col("content"), F.lit(1), ((conv % 5) * 30).cast("int"))
    return m.withColumn("content", F.concat(phrase, F.lit(". "), start))


def chat_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _table(spark, sf_dir, "conversations").select("conv_id").distinct()
    names = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("conv_id"), "c_name")
    return ids.join(names, "conv_id", "left").select(
        (F.col("conv_id") % N_TENANTS).cast("string").alias("tenant_id"),
        F.col("conv_id").alias("conversation_id"),
        (F.col("conv_id") % N_CONTACTS).alias("contact_id"),
        F.col("c_name").alias("contact_name"),
    )


def chat_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenant's call arguments (``plans.calls.CALLS_SCHEMA``), by its number."""
    t = F.col("tenant_id").cast("int")
    own = chat_messages(spark, sf_dir).select("tenant_id").distinct()
    start = F.date_add(F.lit(dt.date(2024, 1, 5)), 8 * t)
    return own.select("tenant_id", F.date_add(F.lit(dt.date(2024, 1, 1)), 9 * t).alias("project_start"), (30 + 17 * t).alias("monthly_goal"),
                      start.alias("custom_start"), F.date_add(start, 6 + 5 * t).alias("custom_end"))


def chat_stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stop list of each tenant's own: its words, by length, where the length leaves the tenant's number modulo 4."""
    words = chat_messages(spark, sf_dir).select("tenant_id", F.explode(F.split(F.lower("content"), TEST_PACK.word_split)).alias("word"))
    return words.where(F.length("word") % 4 == F.col("tenant_id").cast("int")).distinct()


def event_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an already-joined message base (contact derived from the user)."""
    e = _table(spark, sf_dir, "events")
    user = F.col("user_id")
    return e.select(
        (user % N_TENANTS).cast("string").alias("tenant_id"),
        user.alias("conversation_id"),
        F.col("event_id").alias("message_id"),
        (user % N_CONTACTS).alias("contact_id"),
        F.when(F.col("event_type").isin("view", "click"), F.lit(0)).otherwise(F.lit(1)).alias("kind"),
        (F.col("event_type") == "signup").alias("is_private"),
        F.col("ts"),
        F.col("props").alias("content"),
    )


# Fixed test rule pack (the test texts are invented prose, so the report's own
# keywords would never hit): word-prefix, case-insensitive, first match wins.
TEST_PACK = RulePack(
    rules=(
        Rule("sich", "sich|und"),
        Rule("thing", "thing|then"),
        Rule("from", "from|this"),
        Rule("que", "que|par|el"),
        Rule("that", "that|with", message_level=False),
    ),
    default_topic="other",
    mention="and",
    engage="from|with",
    quote_exclude="(from the)|(with the)",
    stop_words=frozenset(("that", "with", "this", "from", "have")),
    no_quote_topics=("other", "that"),
)
# The same pack with a negation guard on the second rule.
TEST_PACK_GUARDED = RulePack(
    rules=(
        Rule("sich", "sich|und"),
        Rule("thing", "thing|then", guard="that |with "),
        Rule("from", "from|this"),
        Rule("que", "que|par|el"),
        Rule("that", "that|with", message_level=False),
    ),
    default_topic="other",
    mention="and",
    engage="from|with",
    quote_exclude="(from the)|(with the)",
    stop_words=TEST_PACK.stop_words,
    no_quote_topics=("other", "that"),
)
