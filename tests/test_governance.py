"""Governance replay (G4, G5, G7, G11): properties on random event logs, and the boundaries by hand."""

import datetime as dt
import random

from spendlens.operators import governance as G

T0 = dt.datetime(2024, 1, 1)


LATEST = "tenant_id string, workspace string, fingerprint string, check_id string, category string, group_key string, detected_at timestamp"
EVENTS = "tenant_id string, workspace_id string, subject_type string, subject_id string, state string, snooze_until timestamp, event_ts timestamp"
EXTENSIONS = "tenant_id string, workspace string, fingerprint string, days int, event_ts timestamp"
SLA_DAYS = {"security": 7, "waste": 21, "governance": 30}


def at(days, hours=0):
    return T0 + dt.timedelta(days=days, hours=hours)


def random_log(seed, n=40):
    """(latest rows, state events, extensions) of findings with random histories."""
    rnd = random.Random(seed)
    latest, events, extensions = [], [], []
    for i in range(n):
        latest.append(("t", "w", f"fp{i}", "chk", ["security", "waste", "governance", "rightsizing"][i % 4], f"g{i % 5}", T0))
        ts = T0
        for _ in range(rnd.randint(1, 8)):
            ts += dt.timedelta(hours=rnd.randint(1, 24 * 20))
            state = rnd.choice(["open", "open", "snoozed", "snoozed", "resolved", "ignored", "acknowledged"])
            events.append(("t", "w", "finding", f"fp{i}", state, ts + dt.timedelta(days=rnd.randint(-2, 15)) if state == "snoozed" else None, ts))
            if rnd.random() < 0.4:
                extensions.append(("t", "w", f"fp{i}", rnd.randint(1, 40), ts + dt.timedelta(hours=rnd.randint(1, 200))))
    return latest, events, extensions


def replayed(spark, latest, events, extensions=(), assignments=None):
    ext = spark.createDataFrame(list(extensions), EXTENSIONS)
    asg = None if assignments is None else spark.createDataFrame(assignments, "tenant_id string, workspace string, fingerprint string, owner_id string, team_id string, event_ts timestamp")
    out = G.sla_replay(spark.createDataFrame(events, EVENTS), spark.createDataFrame(latest, LATEST), G.default_policies(spark), extensions=ext, assignments=asg)
    return {r.fingerprint: r for r in out.collect()}


def test_properties_of_the_replay(spark):
    latest, events, extensions = random_log(7)
    got = replayed(spark, latest, events, extensions)
    without = replayed(spark, latest, events)
    mine = lambda fp, rows, at_: [r for r in rows if r[at_] == fp]
    for _, _, fp, _, category, _, _ in latest:
        g, ext, own = got[fp], mine(fp, extensions, 2), mine(fp, events, 3)
        days = SLA_DAYS.get(category)
        # the deadline is what it is made of
        if g.first_opened_at is None or days is None:
            assert g.sla_deadline is None and g.sla_breached_at is None
        else:
            assert g.sla_deadline == g.first_opened_at + dt.timedelta(days=days, seconds=g.sla_total_paused_seconds + g.sla_extension_seconds)
        assert g.sla_extension_seconds == 86400 * sum(e[3] for e in ext) and g.sla_extended_count == len(ext) and g.events == len(own)
        # extensions neither open nor pause nor resume
        for c in ("first_opened_at", "sla_paused_at", "sla_total_paused_seconds", "events"):
            assert g[c] == without[fp][c]
        times = [e[6] for e in own]
        span = (max(times) - min(times)).total_seconds()
        assert 0 <= g.sla_total_paused_seconds <= span
        assert g.first_opened_at is None or g.first_opened_at in times
        assert (g.sla_paused_at is None) or own[-1][4] in ("snoozed", "open", "acknowledged", "resolved", "ignored")
        # a stamp lies on an event of its own, never before the finding opened
        if g.sla_breached_at is not None:
            assert g.sla_breached_at in times + [e[4] for e in ext] and g.sla_breached_at > g.first_opened_at
        if not ext and without[fp].sla_breached_at is not None and max(times) > without[fp].sla_deadline:
            assert g.sla_breached_at <= max(times)


def test_replay_does_not_hang_on_the_order_of_rows(spark):
    latest, events, extensions = random_log(11, 15)
    first = replayed(spark, latest, events, extensions)
    assert replayed(spark, latest[::-1], events[::-1], extensions[::-1]) == first
    # one extension of a days and one of b at the same time are one of a + b, but for their number
    whole = [("t", "w", "fp1", 12, at(400))]
    split = [("t", "w", "fp1", 5, at(400)), ("t", "w", "fp1", 7, at(400))]
    a, b = (replayed(spark, latest, events, x)["fp1"] for x in (whole, split))
    assert (a.sla_deadline, a.sla_extension_seconds) == (b.sla_deadline, b.sla_extension_seconds)


def test_group_events_are_events_of_every_member(spark):
    latest = [("t", "w", f"f{i}", "chk", "security", "g", T0) for i in range(3)] + [("t", "w", "other", "chk", "security", "h", T0)]
    log = [("open", None, at(0)), ("snoozed", at(6), at(2)), ("open", None, at(5)), ("resolved", None, at(30))]
    by_group = replayed(spark, latest, [("t", "w", "group", "g", *e) for e in log])
    by_finding = replayed(spark, latest, [("t", "w", "finding", f"f{i}", *e) for i in range(3) for e in log])
    assert set(by_group) == {"f0", "f1", "f2"} and by_group == by_finding
    one = by_group["f0"]
    assert (one.sla_total_paused_seconds, one.sla_deadline, one.sla_breached_at) == (3 * 86400, at(10), at(30))


def test_an_extension_meets_the_clock_at_its_time(spark):
    latest = [("t", "w", "f", "chk", "security", None, T0)]  # seven days
    opened = ("t", "w", "finding", "f", "open", None, at(0))
    late = ("t", "w", "finding", "f", "open", None, at(9))  # stamps the breach
    ext = lambda days, when: ("t", "w", "f", days, when)
    run = lambda events, extensions: replayed(spark, latest, events, extensions)["f"]
    assert run([opened, late], []).sla_breached_at == at(9)
    assert run([opened, late], [ext(1, at(10))]).sla_breached_at == at(9)  # still behind: the stamp stays
    assert run([opened, late], [ext(30, at(10))]).sla_breached_at is None  # moved ahead: lifted
    assert run([opened, late], [ext(3, at(10))]).sla_breached_at is None  # to its very time
    assert run([opened, late], [ext(1, at(8))]).sla_breached_at == at(9) and run([opened, late], [ext(5, at(8))]).sla_breached_at is None
    assert run([opened], [ext(1, at(20))]).sla_breached_at == at(20)  # late when extended: stamped then
    again = run([opened, late, ("t", "w", "finding", "f", "open", None, at(40))], [ext(10, at(10))])
    assert again.sla_breached_at == at(40)
    # a pause before it moves the deadline it meets: open 0, snoozed 2 to 6, deadline 11
    paused = [opened, ("t", "w", "finding", "f", "snoozed", at(20), at(2)), ("t", "w", "finding", "f", "open", None, at(6))]
    assert run(paused, [ext(1, at(10.5))]).sla_breached_at is None and run(paused, [ext(1, at(13))]).sla_breached_at == at(13)
    # an extension while paused ends no pause
    assert run(paused[:2], [ext(1, at(30))]).sla_paused_at == at(2)


def test_the_last_assignment_wins(spark):
    latest = [("t", "w", f, "chk", "security", None, T0) for f in ("a", "b", "c")]
    asg = [("t", "w", "a", "u1", "t1", at(1)), ("t", "w", "a", "u2", None, at(3)), ("t", "w", "a", "u3", "t3", at(2)), ("t", "w", "b", "u9", "t9", at(1)), ("t", "w", "gone", "u", "t", at(1))]
    got = replayed(spark, latest, [("t", "w", "finding", "a", "open", None, at(0)), ("t", "w", "finding", "c", "open", None, at(0))], (), asg)
    assert {f: (r.owner_id, r.team_id, r.assigned_at, r.events) for f, r in got.items()} == {"a": ("u2", None, at(3), 1), "b": ("u9", "t9", at(1), 0), "c": (None, None, None, 1)}


def test_effective_state_group_overrides(spark):
    latest = spark.createDataFrame(
        [("t", "w", "a", "chk", "security", "g1", T0), ("t", "w", "b", "chk", "security", None, T0)],
        "tenant_id string, workspace string, fingerprint string, check_id string, category string, group_key string, detected_at timestamp",
    )
    ev = spark.createDataFrame(
        [
            ("t", "w", "finding", "a", "open", None, T0),
            ("t", "w", "group", "g1", "resolved", None, T0 + dt.timedelta(days=1)),
            ("t", "w", "finding", "b", "snoozed", T0 + dt.timedelta(days=2), T0),
        ],
        "tenant_id string, workspace_id string, subject_type string, subject_id string, state string, snooze_until timestamp, event_ts timestamp",
    )
    gov = G.sla_replay(ev, latest, G.default_policies(spark))
    cur = {r.fingerprint: r for r in G.finding_current(latest, ev, gov, "2024-01-10").collect()}
    assert cur["a"].effective_state == "resolved"  # group state wins
    assert cur["a"].sla_status == "closed"  # resolved before the deadline, never breached
    assert cur["b"].effective_state == "open"  # snooze expired as of the reference time


def _extended(spark, deadline, breached, events):
    gov = spark.createDataFrame(
        [("t", "w", "f", 0, 0, deadline, breached)],
        "tenant_id string, workspace string, fingerprint string, sla_extension_seconds long, sla_extended_count int, sla_deadline timestamp, sla_breached_at timestamp",
    )
    ext = spark.createDataFrame([("t", "w", "f", d, ts) for d, ts in events], "tenant_id string, workspace string, fingerprint string, days int, event_ts timestamp")
    return G.apply_extensions(gov, ext).first()


def test_extension_keeps_or_clears_the_breach(spark):
    d = lambda n: T0 + dt.timedelta(days=n)
    late = _extended(spark, d(10), d(11), [(3, d(20))])  # the new deadline is still behind the event
    assert late.sla_breached_at == d(11) and late.sla_deadline == d(13) and late.sla_extended_count == 1
    ahead = _extended(spark, d(10), d(11), [(3, d(20)), (30, d(21))])
    assert ahead.sla_breached_at is None and ahead.sla_extension_seconds == 33 * 86400
    again = _extended(spark, d(10), d(11), [(15, d(20)), (1, d(40))])  # cleared, then late again
    assert again.sla_breached_at == d(40)
    assert _extended(spark, d(10), d(11), []).sla_breached_at == d(11)
    assert _extended(spark, None, None, [(5, d(1))]).sla_breached_at is None


def test_backfill_skips_findings_with_events(spark):
    latest = spark.createDataFrame(
        [("t", "w", "a", "chk", "security", None, T0), ("t", "w", "b", "chk", "security", None, T0)],
        "tenant_id string, workspace string, fingerprint string, check_id string, category string, group_key string, detected_at timestamp",
    )
    ev = spark.createDataFrame([("t", "w", "finding", "a"), ("t", "w", "group", "b")], "tenant_id string, workspace_id string, subject_type string, subject_id string")
    rows = G.sla_backfill(latest, G.default_policies(spark), "2024-01-10", state_events=ev).collect()
    assert [r.fingerprint for r in rows] == ["b"]
