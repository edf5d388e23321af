"""Pairing: O8 pending TTL, O16 decisions, O17 approved users."""

import datetime as dt

from gatewarden.operators import pairing as P

NOW = dt.datetime(2024, 1, 31, 0, 0, 0)


def ago(s):
    return NOW - dt.timedelta(seconds=s) if s is not None else None


def pending_df(spark, rows):
    return spark.createDataFrame(
        rows, "deployment_id string, platform string, code string, user_id string, user_name string, created_at timestamp"
    )


def test_pending_ttl_boundaries(spark):
    rows = [
        ("d", "tg", "a", "1", "u", ago(3599.9)),
        ("d", "tg", "b", "1", "u", ago(3600)),
        ("d", "tg", "c", "1", "u", ago(3600.1)),
        ("d", "tg", "n", "1", "u", None),
        ("d", "tg", "f", "1", "u", ago(-90)),
    ]
    got = {r.code: r.age_minutes for r in P.pending_requests(pending_df(spark, rows), NOW).collect()}
    assert got == {"a": 59, "b": 60, "n": 0, "f": -1}


def decisions_df(spark, rows):
    return spark.createDataFrame(
        [(i, "d", NOW + dt.timedelta(seconds=t), i, op, pl, code) for i, (t, op, pl, code) in enumerate(rows)],
        "decision_id long, deployment_id string, ts timestamp, seq long, op string, platform string, code string",
    )


def test_resolve_decisions_cases(spark):
    pending = pending_df(
        spark,
        [
            ("d", "tg", "abc", "7", "seven", ago(10)),
            ("d", "tg", "blank", "  ", "nobody", ago(10)),
            ("d", "tg", "twice", "8", "eight", ago(10)),
            ("d", "tg", "dena", "9", "nine", ago(10)),
            ("d", "tg", "old", "10", "ten", ago(10**6)),
        ],
    )
    dec = decisions_df(
        spark,
        [
            (1, "approve", "tg", "nope"),      # 0 unknown code -> 404
            (2, "approve", "tg", "blank"),     # 1 blank user -> 422, stays
            (3, "approve", "tg", " abc "),     # 2 padded code -> 200
            (4, "approve", "tg", "ABC"),       # 3 upper-cased -> 404
            (5, "approve", "tg", "twice"),     # 4 -> 200
            (6, "approve", "tg", "twice"),     # 5 -> 404 (already moved)
            (7, "deny", "tg", "dena"),         # 6 -> 200
            (8, "approve", "tg", "dena"),      # 7 -> 404
            (9, "approve", "tg", "old"),       # 8 approve after TTL -> 200
            (10, "approve", "", "abc"),        # 9 missing platform -> 400
            (11, "deny", "tg", "missing"),     # 10 deny of unknown -> 200
            (12, None, "tg", "blank"),         # 11 unreadable body -> 400
        ],
    )
    outcomes, remaining, approvals = P.resolve_decisions(pending, dec)
    got = [r.status for r in outcomes.orderBy("decision_id").collect()]
    assert got == [404, 422, 200, 404, 200, 404, 200, 404, 200, 400, 200, 400]
    assert sorted(r.code for r in remaining.collect()) == ["blank"]
    assert sorted((r.user_id, r.user_name) for r in approvals.collect()) == [("10", "ten"), ("7", "seven"), ("8", "eight")]


def test_approved_users_fold(spark):
    def ops(rows):
        return spark.createDataFrame(
            [("d", "tg", u, n, NOW + dt.timedelta(seconds=t), t) for u, n, t in rows],
            "deployment_id string, platform string, user_id string, user_name string, ts timestamp, seq long",
        )

    approvals = ops([("1", "a", 1), ("1", "a2", 5), ("2", "b", 1), ("3", "c", 1), ("3", "c2", 9)])
    revocations = ops([("2", None, 2), ("3", None, 3), ("4", None, 4)])
    got = sorted((r.user_id, r.user_name) for r in P.approved_users(approvals, revocations).collect())
    assert got == [("1", "a2"), ("3", "c2")]
    # independent of input order
    got2 = sorted((r.user_id, r.user_name) for r in P.approved_users(approvals.orderBy("seq", ascending=False), revocations).collect())
    assert got2 == got
