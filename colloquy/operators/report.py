"""The dashboard document: one nested row per tenant.

Per-period pieces (KPIs, topics, cloud, funnel, quotes, rhythm, heatmap) are
each at most four rows per tenant. They are stacked with ``unionByName`` onto
the tenant x period spine and folded by one ``groupBy(tenant, bucket)``
(instead of nine joins), then by one ``groupBy(tenant)`` into the ``periodos``
map; the per-tenant totals join that once. Missing pieces become 0, ``[]`` or
``{}``, so every tenant of the spine gets a full document even without rows.

Three inputs feed several pieces and are materialised once (cached, or written under ``spark.checkpoint.dir``): the
traffic rollup (all counts, one pass over the messages without text; ``activity.py``), the text messages of the conversations that some
period can hold, with their rule features, and the topics of those conversations. So the messages are read
twice. Left lazy (``how="none"``) nothing is shared, and every counting operator reads the base itself, with its
own filters pushed into the scan.
"""

from __future__ import annotations

import logging
import uuid
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ratio import pct_tenths, quot_hundredths, to_decimal
from ..params import Params
from ..plans.calendar import Calendar, build_calendar
from ..plans.rules import REFERENCE_PACK, RulePack
from . import activity as rollup
from .base import base_messages, kept_conversations, restrict_tenants
from .kpis import dispatch_kpis, goal_metrics, message_kpis, totals, with_call_facts
from .periods import period_spine
from .quotes import quotes_folded, sample_quotes
from .segments import SEGMENT, conversation_segments
from .rhythm import daily_rhythm, heatmap_folded, hourly_heatmap, rhythm_folded
from .topics import (active_conversations, classified_buckets, conversation_text, conversation_topics, funnel_folded, is_text,
                     mention_funnel, topic_counts, topic_distribution, topics_folded, with_buckets,
                     with_text_features)
from .words import cloud_folded, word_cloud, word_counts

PIECE_COLUMNS = ("disparos", "alunos_atendidos", "msgs_aluno", "msgs_tcs", "respostas",
                 "assuntos", "nuvem", "desafio", "frases", "ritmo", "heatmap")


def _configured_checkpoint_dir(spark: SparkSession) -> str | None:
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        try:
            d = spark.sparkContext.getCheckpointDir()
        except Exception:  # no SparkContext on this session (e.g. Spark Connect)
            d = None
    return d or None


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``."""
    d = _configured_checkpoint_dir(spark)
    if not d:
        raise RuntimeError("spark.checkpoint.dir is not set; set it to a shared folder (or use how='cache')")
    return d


def _delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a working table this run wrote (a leftover folder only costs space, so an error is logged, not raised)."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception as e:
        logging.getLogger(__name__).warning("working folder %s was not deleted: %s", path, e)


def materialize(df: DataFrame, how: str) -> tuple[DataFrame, str | None]:
    """Materialise a frame that several operators read; returns the frame to
    use and, for ``table``, the folder written.

    ``table``: write Parquet under ``spark.checkpoint.dir`` and read it back
    (columnar, pruned reads, balanced input splits, survives executor loss);
    ``cache``: persist MEMORY_AND_DISK (lost blocks are recomputed from
    lineage); ``none``: leave lazy. The caller chooses; nothing switches by itself."""
    if how == "cache":
        return df.persist(StorageLevel.MEMORY_AND_DISK), None
    if how == "table":
        spark = df.sparkSession
        path = f"{checkpoint_dir(spark).rstrip('/')}/colloquy-{uuid.uuid4().hex}"
        df.write.mode("error").parquet(path)
        return spark.read.parquet(path), path
    if how != "none":
        raise ValueError(f"unknown materialisation {how!r}")
    return df, None


@dataclass
class Dashboard:
    """All operators of one run over a message base, sharing materialised inputs."""

    base: DataFrame
    cal: Calendar
    tenants: DataFrame
    pack: RulePack = REFERENCE_PACK
    words_k: int = 40
    quotes_k: int = 3
    stop_words: DataFrame | None = None
    how: str = "table"
    #: the base without text
    work: DataFrame | None = None
    #: what the counting operators read unless everything is lazy: a row per tenant, and one per tenant, set of periods and hour
    facts: DataFrame | None = None
    hours: DataFrame | None = None
    #: text messages of the active conversations, with their features: what the text operators read
    texts: DataFrame | None = None
    _topics: DataFrame | None = None
    _quoted: DataFrame | None = None
    _held: list = field(default_factory=list)
    _written: list = field(default_factory=list)

    @classmethod
    def from_tables(cls, messages: DataFrame, conversations: DataFrame, params: Params,
                    pack: RulePack = REFERENCE_PACK, how: str = "table", calls: DataFrame | None = None,
                    stop_words: DataFrame | None = None) -> "Dashboard":
        """``calls``: each tenant's own arguments (``plans.calls.CALLS_SCHEMA``); its tenants are then those of the run, as
        with ``params.tenants``. ``stop_words`` (tenant_id, word): left out of a tenant's word cloud beside the pack's."""
        msgs = restrict_tenants(messages, params.tenants)
        spark = messages.sparkSession
        if calls is not None:
            calls = restrict_tenants(calls, params.tenants)
            tenants = calls.select("tenant_id")
            conversations = conversations.join(tenants, "tenant_id", "left_semi")
        elif params.tenants is not None:
            tenants = spark.createDataFrame([(t,) for t in dict.fromkeys(params.tenants)], "tenant_id string")
        else:
            # every tenant with a counted row has conversations (the base is an inner join
            # on them), so the conversation table alone names the tenants: no message scan
            tenants = conversations.select("tenant_id").distinct()
        join = lambda m: base_messages(m, conversations, params.exclude_patterns, params.tenants)
        kept = kept_conversations(conversations, params.exclude_patterns, params.tenants)
        return cls._open(join(msgs), join(msgs.drop("content")), msgs, kept, params, tenants, pack, how, calls, stop_words)

    @classmethod
    def from_base(cls, base: DataFrame, params: Params, tenants: DataFrame | None = None,
                  pack: RulePack = REFERENCE_PACK, how: str = "table", calls: DataFrame | None = None,
                  stop_words: DataFrame | None = None) -> "Dashboard":
        if tenants is None:
            tenants = base.select("tenant_id").distinct()
        return cls._open(base, base.drop("content"), base, None, params, tenants, pack, how, calls, stop_words)

    @classmethod
    def _open(cls, base: DataFrame, counts: DataFrame, messages: DataFrame, kept: DataFrame | None, params: Params, tenants: DataFrame, pack: RulePack,
              how: str, calls: DataFrame | None, stop_words: DataFrame | None) -> "Dashboard":
        """``counts``: the base without text; ``messages``: rows that hold the base's text messages, contact or not;
        ``kept``: the conversations that make them the base (None: they are)."""
        cal = build_calendar(params)
        if calls is not None:
            cal = cal.with_calls(calls)
        d = cls(base=base, cal=cal, tenants=tenants, pack=pack, stop_words=stop_words, how=how, work=counts)
        try:
            if how == "none":
                active = active_conversations(d.work, cal)
            else:
                traffic = d._materialize(rollup.activity(messages, cal, kept), how)
                # small whatever the traffic; a lost block is made again from the rollup
                d.facts = d._materialize(rollup.period_facts(traffic), "cache")
                d.hours = d._materialize(rollup.traffic_hours(traffic), "cache")
                active = rollup.active_conversations(traffic)
            # the conversations that any period can hold, found without text; the semi-join (which also leaves out excluded
            # contacts) comes before the rules, the words and the quotes
            text = messages.where(is_text(pack))
            texts = with_text_features(text.join(active, ["tenant_id", "conversation_id"], "left_semi"), pack)
            d.texts = d._materialize(texts, how)
            d._quoted = d.texts if how != "none" else text  # without the rules, where those are not written down
            d._topics = d._materialize(with_buckets(conversation_topics(d.texts, pack), cal).where(F.size("buckets") > 0), how)
        except Exception:
            d.close()
            raise
        return d

    def __enter__(self) -> "Dashboard":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _materialize(self, df: DataFrame, how: str) -> DataFrame:
        out, path = materialize(df, how)
        self._held.append(out)
        if path is not None:
            self._written.append(path)
        return out

    def close(self) -> None:
        """Release the materialised inputs (unpersist, or delete the working tables this run wrote)."""
        for df in self._held:
            if df.is_cached:
                df.unpersist()
        for path in self._written:
            _delete_folder(self.base.sparkSession, path)
        self._held.clear()
        self._written.clear()

    # -- flat operator outputs ------------------------------------------------
    def conversation_topics(self) -> DataFrame:
        """Of every conversation with text, whenever it was active."""
        return conversation_topics(self.base, self.pack)

    def active_topics(self) -> DataFrame:
        """Of the conversations that some period holds, with those periods in ``buckets``."""
        return self._topics

    def conversation_text(self) -> DataFrame:
        return conversation_text(self.base, self.pack)

    def conversation_segments(self, size: int = SEGMENT) -> DataFrame:
        """The conversations' texts, in order, in rows of ``size`` characters."""
        return conversation_segments(self.base, self.pack, size)

    def classified_buckets(self) -> DataFrame:
        return classified_buckets(self._topics)

    def dispatch_kpis(self) -> DataFrame:
        return dispatch_kpis(self.work, self.cal) if self.facts is None else rollup.dispatch_kpis(self.facts)

    def message_kpis(self) -> DataFrame:
        return message_kpis(self.work, self.cal) if self.facts is None else rollup.message_kpis(self.facts)

    def totals(self) -> DataFrame:
        return goal_metrics(totals(self.work, self.cal) if self.facts is None else rollup.totals(self.facts), self.cal)

    def topic_distribution(self) -> DataFrame:
        return topic_distribution(self.classified_buckets())

    def word_cloud(self) -> DataFrame:
        return word_cloud(word_counts(self.texts, self._topics, self.pack, stop_words=self.stop_words), self.words_k)

    def mention_funnel(self) -> DataFrame:
        return mention_funnel(self.classified_buckets())

    def sample_quotes(self) -> DataFrame:
        return sample_quotes(self.texts, self._topics, self.pack, self.quotes_k, self._quoted)

    def daily_rhythm(self) -> DataFrame:
        return daily_rhythm(self.work, self.cal) if self.hours is None else rollup.daily_rhythm(self.hours)

    def hourly_heatmap(self) -> DataFrame:
        return hourly_heatmap(self.work, self.cal) if self.hours is None else rollup.hourly_heatmap(self.hours)

    def period_spine(self) -> DataFrame:
        return period_spine(self.tenants, self.cal)

    # -- the document ---------------------------------------------------------
    def period_rows(self) -> DataFrame:
        """(tenant_id, bucket, ord, period struct) for every spine row."""
        spine = self.period_spine().select("tenant_id", "bucket", "ord", "label", "sublabel")
        pieces = [
            self.dispatch_kpis(),
            self.message_kpis(),
            topics_folded(topic_counts(self.classified_buckets())),
            cloud_folded(self.word_cloud()),
            funnel_folded(self.mention_funnel()),
            quotes_folded(self.sample_quotes()),
            rhythm_folded(self.daily_rhythm()),
            heatmap_folded(self.hourly_heatmap()),
        ]
        stacked = spine
        for p in pieces:
            stacked = stacked.unionByName(p, allowMissingColumns=True)
        keep = ("ord", "label", "sublabel") + PIECE_COLUMNS
        folded = (stacked.groupBy("tenant_id", "bucket")
                  .agg(*[F.first(c, ignorenulls=True).alias(c) for c in keep])
                  .where(F.col("label").isNotNull()))
        types = {f.name: f.dataType for f in folded.schema.fields}

        def n(c: str) -> Column:
            return F.coalesce(F.col(c), F.lit(0).cast("long"))

        def empty(c: str) -> Column:
            dtype = types[c]
            if isinstance(dtype, T.ArrayType):
                blank = F.array().cast(dtype)
            elif isinstance(dtype, T.MapType):
                blank = F.create_map().cast(dtype)
            else:  # struct: all fields NULL, printed as {}
                blank = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in dtype.fields])
            return F.coalesce(F.col(c), blank)

        period = F.struct(
            F.col("label"), F.col("sublabel"),
            n("disparos").alias("disparos"),
            n("respostas").alias("respostas"),
            to_decimal(pct_tenths(n("respostas"), n("disparos")), 1).alias("taxa_resp"),
            n("alunos_atendidos").alias("alunos_atendidos"),
            to_decimal(quot_hundredths(n("disparos"), n("alunos_atendidos")), 2).alias("disparos_por_aluno"),
            n("msgs_aluno").alias("msgs_aluno"),
            n("msgs_tcs").alias("msgs_tcs"),
            empty("assuntos").alias("assuntos"),
            empty("nuvem").alias("nuvem"),
            empty("desafio").alias("desafio"),
            empty("frases").alias("frases"),
            empty("ritmo").alias("ritmo"),
            empty("heatmap").alias("heatmap"),
        )
        return folded.select("tenant_id", "bucket", "ord", period.alias("period"))

    def summary(self) -> DataFrame:
        """One row per tenant: the dashboard document as nested columns."""
        cal = self.cal
        rows = self.period_rows()
        by_ord = F.array_sort(F.collect_list(F.struct("ord", "bucket", "period")),
                              lambda a, b: a["ord"] - b["ord"])
        periodos = rows.groupBy("tenant_id").agg(F.map_from_entries(F.transform(
            by_ord, lambda e: F.struct(e["bucket"], e["period"]))).alias("periodos"))
        tot = self.totals().drop("meta_proporcional", "mes_meta_proporcional")
        doc = with_call_facts(self.tenants, cal).join(periodos, "tenant_id", "left").join(tot, "tenant_id", "left")

        def n(c: str) -> Column:
            return F.coalesce(F.col(c), F.lit(0).cast("long"))

        zero = F.lit(0).cast("long")
        alltime = F.struct(
            n("disparos").alias("disparos"),
            n("respostas").alias("respostas"),
            to_decimal(F.coalesce(F.col("taxa_resp_tenths"), zero), 1).alias("taxa_resp"),
            n("alunos").alias("alunos_atendidos"),
            to_decimal(F.coalesce(F.col("disparos_por_aluno_hundredths"), zero), 2).alias("disparos_por_aluno"),
            n("conversas_unicas").alias("conversas_unicas"),
            F.col("meta_proporcional"),
            to_decimal(F.coalesce(F.col("pct_meta_tenths"), zero), 1).alias("pct_meta"),
            to_decimal(F.coalesce(F.col("pace_diario_tenths"), zero), 1).alias("pace_diario"),
        )
        mes_atual = F.struct(
            F.lit(cal.current_month_label).alias("label"),
            n("mes_disparos").alias("disparos"),
            n("mes_respostas").alias("respostas"),
            to_decimal(F.coalesce(F.col("mes_taxa_resp_tenths"), zero), 1).alias("taxa_resp"),
            n("mes_alunos").alias("alunos_atendidos"),
            F.lit(cal.month_days).alias("dias_decorridos"),
            F.col("meta_mensal").alias("meta"),
            F.col("mes_meta_proporcional").alias("meta_proporcional"),
            to_decimal(F.coalesce(F.col("mes_pct_meta_tenths"), zero), 1).alias("pct_meta"),
            n("projecao_fim_mes").alias("projecao_fim_mes"),
        )
        empty_periods = F.create_map().cast(periodos.schema["periodos"].dataType)
        return doc.select(
            "tenant_id",
            F.lit(cal.updated_at).alias("atualizado_em"),
            "inicio_projeto",
            "meta_mensal",
            "dias_corridos",
            alltime.alias("alltime"),
            mes_atual.alias("mes_atual"),
            F.coalesce(F.col("periodos"), empty_periods).alias("periodos"),
        )

    def summary_json(self) -> DataFrame:
        """(tenant_id, doc): the document as JSON text (the sink form)."""
        s = self.summary()
        return s.select("tenant_id", F.to_json(F.struct(*[c for c in s.columns if c != "tenant_id"])).alias("doc"))


def summary(messages: DataFrame, conversations: DataFrame, params: Params, pack: RulePack = REFERENCE_PACK,
            how: str = "table") -> DataFrame:
    """Convenience: the per-tenant document for ``params``."""
    return Dashboard.from_tables(messages, conversations, params, pack, how).summary()
