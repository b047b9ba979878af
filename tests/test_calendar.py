import datetime as dt

from conftest import utc

from colloquy import Params, build_calendar


def cal(as_of, **kw):
    return build_calendar(Params(as_of=as_of, tz="America/Sao_Paulo", project_start=dt.date(2024, 1, 1), **kw))


def test_rolling_windows_and_closed_month():
    c = cal(utc(2024, 2, 14, 12, 0))
    p = {x.bucket: x for x in c.periods}
    assert [x.bucket for x in c.periods] == ["d7", "d8_14", "mes_fechado"]
    assert p["d7"].start == dt.datetime(2024, 2, 7, 12, 0) and p["d7"].end is None
    assert (p["d8_14"].start, p["d8_14"].end) == (dt.datetime(2024, 1, 31, 12), dt.datetime(2024, 2, 7, 12))
    # local month starts at 03:00 UTC in Sao Paulo (UTC-3)
    assert (p["mes_fechado"].start, p["mes_fechado"].end) == (dt.datetime(2024, 1, 1, 3), dt.datetime(2024, 2, 1, 3))
    assert c.month_start == dt.datetime(2024, 2, 1, 3)
    assert p["d7"].sublabel == "07/02 a 14/02"
    assert p["d8_14"].sublabel == "31/01 a 06/02"
    assert p["mes_fechado"].label == "Mês de Jan/24"
    assert p["mes_fechado"].sublabel == "01/01/2024 a 31/01/2024"
    assert c.elapsed_days == 44 and c.month_days == 14
    assert c.updated_at == "2024-02-14 09:00" and c.current_month_label == "Fev/24"


def test_period_edges_start_in_end_out():
    c = cal(utc(2024, 2, 14, 12, 0))
    p = {x.bucket: x for x in c.periods}
    one = dt.timedelta(microseconds=1)
    assert p["d8_14"].contains(p["d8_14"].start) and not p["d8_14"].contains(p["d8_14"].start - one)
    assert not p["d8_14"].contains(p["d8_14"].end) and p["d8_14"].contains(p["d8_14"].end - one)
    assert p["d7"].contains(dt.datetime(2030, 1, 1))  # future instants count


def test_month_turn_uses_local_month():
    # 01:00 UTC on March 1st is still February 29th in Sao Paulo
    c = cal(utc(2024, 3, 1, 1, 0))
    p = {x.bucket: x for x in c.periods}
    assert p["mes_fechado"].label == "Mês de Jan/24"
    assert c.current_month_label == "Fev/24" and c.month_days == 29


def test_year_turn():
    c = cal(utc(2024, 1, 10, 15, 0))
    p = {x.bucket: x for x in c.periods}
    assert p["mes_fechado"].label == "Mês de Dez/23"
    assert p["mes_fechado"].sublabel == "01/12/2023 a 31/12/2023"


def test_custom_needs_both_ends_and_end_is_inclusive():
    assert "custom" not in [p.bucket for p in cal(utc(2024, 2, 14, 12), custom_start=dt.date(2024, 1, 5)).periods]
    assert "custom" not in [p.bucket for p in cal(utc(2024, 2, 14, 12), custom_end=dt.date(2024, 1, 5)).periods]
    c = cal(utc(2024, 2, 14, 12), custom_start=dt.date(2024, 1, 5), custom_end=dt.date(2024, 1, 9))
    cu = c.period("custom")
    assert (cu.start, cu.end) == (dt.datetime(2024, 1, 5, 3), dt.datetime(2024, 1, 10, 3))
    assert cu.contains(dt.datetime(2024, 1, 10, 2, 59))  # 23:59 local on the end date
    assert (cu.label, cu.sublabel) == ("05/01 a 09/01", "05/01/2024 a 09/01/2024")


def test_elapsed_days_at_least_one():
    c = build_calendar(Params(as_of=utc(2024, 1, 1, 12), project_start=dt.date(2024, 1, 1)))
    assert c.elapsed_days == 1
