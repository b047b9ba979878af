"""The report's own rules really find something in the phrase texts (whose values are checked against SQL)."""

import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from colloquy.operators.topics import classify
from colloquy.plans import checks
from colloquy.plans.rules import REFERENCE_PACK
from colloquy.sources.testdata import PHRASES

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_every_rule_and_guard_has_something_to_do(spark):
    rows = checks.message_rules_phrases(spark, SF).collect()
    assert {r.topic for r in rows} == set(REFERENCE_PACK.topics)
    assert {r.mcat for r in rows} == set(REFERENCE_PACK.topics) - {"automatico"}
    assert all(0 < sum(r[c] for r in rows) < len(rows) for c in ("menciona", "engaja", "automatica"))
    texts = spark.createDataFrame([(p,) for p in PHRASES], "content string")
    plain = replace(REFERENCE_PACK, rules=tuple(replace(r, guard=None) for r in REFERENCE_PACK.rules))
    both = texts.select(classify(F.col("content"), REFERENCE_PACK).alias("a"), classify(F.col("content"), plain).alias("b")).collect()
    assert {r.b for r in both if r.a != r.b} >= {"risco", "dificuldade", "prova", "elogios"}


def test_no_list_of_the_document_is_empty(spark):
    doc = checks.phrases(spark, SF, checks.CHAT_CUSTOM_PARAMS).summary().collect()
    full = [p for r in doc for p in r.periodos.values() if p.msgs_aluno]
    assert all(p.assuntos and p.frases and p.heatmap is not None for p in full)
    assert any(p.desafio.n_mencionou and p.desafio.n_engajou for p in full) and any(p.nuvem for p in full)
    assert len({t for p in full for t in p.frases}) >= 8
