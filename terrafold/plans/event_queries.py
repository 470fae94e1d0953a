"""Time-series queries over the event view."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..operators import imu, aggs, joins, windows
from .registry import Registry, rounded

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_KEYED = "(PARTITION BY ring ORDER BY us, event_id"
_NEAREST = """SELECT event_id, r_time, r_event_id FROM (SELECT l.event_id, r.us AS r_time, r.event_id AS r_event_id,
row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.us - r.us), r.us DESC, r.event_id DESC) AS k FROM ev l, ev r WHERE l.event_type = 'click' AND r.event_type = 'purchase') WHERE k = 1"""


def _kind(ev, kind):
    return ev.where(F.col("event_type") == kind)


@query("ev", _NEAREST)
def asof_nearest(spark, sf_dir):
    ev = V.events(spark, sf_dir)
    return joins.asof_nearest(_kind(ev, "click"), _kind(ev, "purchase"), "us", ["event_id"]).select("event_id", "r_time", "r_event_id")


@query("ev", f"SELECT event_id, r_time, r_event_id FROM ({_NEAREST}) JOIN (SELECT event_id, us FROM ev) USING (event_id) WHERE abs(us - r_time) < 300000000")
def asof_tolerance(spark, sf_dir):
    ev = V.events(spark, sf_dir)
    out = joins.asof_nearest(_kind(ev, "click"), _kind(ev, "purchase"), "us", ["event_id"], tolerance=300_000_000)
    return out.where("r_time is not null").select("event_id", "r_time", "r_event_id")


@query("ev", """WITH b AS (SELECT l.event_id, l.us, (SELECT max(r.us) FROM ev r WHERE r.ring = l.ring AND r.event_type = 'view' AND r.us <= l.us) AS p, (SELECT min(r.us) FROM ev r WHERE r.ring = l.ring AND r.event_type = 'view' AND r.us >= l.us) AS n, l.ring FROM ev l WHERE l.event_type = 'click')
SELECT b.event_id, round(CASE WHEN p IS NULL THEN rn.value WHEN n IS NULL OR n = p THEN rp.value ELSE rp.value + (us - p) / CAST(n - p AS DOUBLE) * (rn.value - rp.value) END, 6) AS value_at FROM b LEFT JOIN (SELECT ring, us AS p, value FROM ev WHERE event_type = 'view') rp USING (ring, p) LEFT JOIN (SELECT ring, us AS n, value FROM ev WHERE event_type = 'view') rn USING (ring, n)""")
def imu_interpolate(spark, sf_dir):
    ev = V.events(spark, sf_dir)
    out = joins.bracket_interpolate(_kind(ev, "click").drop("value"), _kind(ev, "view"), "us", "value", ["ring"])
    return out.select("event_id", F.round("value_at", 6).alias("value_at"))


@query("", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def pose_join(spark, sf_dir):
    """Frames with both of their poses: two equi-joins."""
    o, c, n = (V.table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("ev", "SELECT event_id, us FROM ev WHERE us > 1704499200000000 AND us < 1705276800000000 AND event_type = 'error'")
def time_range(spark, sf_dir):
    """Open interval, evaluated on the scan."""
    t = V.table(spark, sf_dir, "events").where("ts > timestamp_ntz'2024-01-06 00:00:00' and ts < timestamp_ntz'2024-01-15 00:00:00' and event_type = 'error'")
    return t.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


_FRAMES = "WITH f AS (SELECT DISTINCT ring, us // 86400000000 AS day FROM ev), a AS (SELECT ring, day, lag(day) OVER (PARTITION BY ring ORDER BY day) AS adjacent FROM f), v AS (SELECT DISTINCT ring, event_type, us // 86400000000 AS day FROM ev WHERE value > 50), c AS (SELECT DISTINCT ring, event_type, us // 86400000000 AS day FROM ev)"
_FIRST = """, p AS (SELECT c.ring, c.event_type, c.day, v.day AS seen, row_number() OVER (PARTITION BY c.ring, c.event_type, c.day ORDER BY CASE WHEN v.day < c.day THEN {} ELSE {} END, abs(v.day - c.day)) AS k FROM c JOIN a USING (ring, day) JOIN v ON v.ring = c.ring AND v.event_type = c.event_type AND v.day != c.day AND (a.adjacent IS NULL OR v.day != a.adjacent))
SELECT c.ring, c.event_type, c.day, coalesce(p.seen, c.day) AS source, CAST((coalesce(p.seen, c.day) - c.day) % 255 AS BIGINT) AS label FROM c LEFT JOIN p ON p.ring = c.ring AND p.event_type = c.event_type AND p.day = c.day AND p.k = 1"""


def _first_match(spark, sf_dir, backward_first):
    ev = V.events(spark, sf_dir).withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    cells = ev.select("ring", "event_type", "day").distinct()
    visible = ev.where("value > 50").select("ring", "event_type", "day").distinct()
    out = joins.first_match(cells, ev.select("ring", "day"), visible, ["event_type"], "day", ["ring"], backward_first=backward_first)
    return out.select("ring", "event_type", "day", "source", ((F.col("source") - F.col("day")) % 255).alias("label"))


@query("ev", _FRAMES + _FIRST.format(1, 0))
def first_match_time(spark, sf_dir):
    return _first_match(spark, sf_dir, False)


@query("ev", _FRAMES + _FIRST.format(0, 1))
def first_match_backward(spark, sf_dir):
    return _first_match(spark, sf_dir, True)


@query("ev", "SELECT l.event_id, r.event_id AS r_event_id FROM ev l JOIN ev r ON l.ring = r.ring AND l.event_type = 'click' AND r.event_type = 'view' AND abs(l.us - r.us) < 7200000000")
def align_streams(spark, sf_dir):
    ev = V.events(spark, sf_dir)
    return joins.align(_kind(ev, "click"), _kind(ev, "view"), "us", 7_200_000_000, ["event_id"], ["ring"]).select("event_id", "r_event_id")


@query("ev", """WITH n AS (SELECT l.event_id AS e, r.event_type AS t, r.event_id AS r, row_number() OVER (PARTITION BY l.event_id, r.event_type ORDER BY r.us DESC, r.event_id DESC) AS k FROM ev l JOIN ev r ON l.ring = r.ring AND abs(l.us - r.us) < 172800000000 WHERE l.event_type = 'click')
SELECT v.e AS event_id, v.r AS view_event_id, p.r AS purchase_event_id, s.r AS signup_event_id FROM n v JOIN n p USING (e) JOIN n s USING (e) WHERE v.k = 1 AND p.k = 1 AND s.k = 1 AND v.t = 'view' AND p.t = 'purchase' AND s.t = 'signup'""")
def align_all_streams(spark, sf_dir):
    """Clicks with the newest view, purchase and sign-up of their user within two days."""
    ev = V.events(spark, sf_dir)
    others = {k: _kind(ev, k) for k in ("view", "purchase", "signup")}
    return joins.align_all(_kind(ev, "click"), others, "us", 172_800_000_000, ["event_id"], ["ring"]).select("event_id", *(f"{k}_event_id" for k in others))


@query("ev", "SELECT l.event_id, (SELECT arg_max(r.event_id, r.us) FROM ev r WHERE r.ring = l.ring AND r.event_type = 'view' AND r.us <= l.us) AS r_event_id FROM ev l WHERE l.event_type = 'click'")
def last_value_join(spark, sf_dir):
    ev = V.events(spark, sf_dir)
    return joins.last_value(_kind(ev, "click"), _kind(ev, "view"), "us", ["event_id"], ["ring"]).select("event_id", "r_event_id")


_CURVE = f"SELECT event_id, ring, us, CASE WHEN count(*) OVER w = 11 THEN pow(sum(value) OVER w - 11*value, 2) + pow(sum(value/2) OVER w - 11*(value/2), 2) END AS curvature FROM ev WINDOW w AS {_KEYED} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"


def _curved(spark, sf_dir):
    ev = V.events(spark, sf_dir).withColumn("half", F.col("value") / 2)
    return windows.curvature(ev, ["value", "half"], ["ring"], ["us", "event_id"])


@query("ev", f"SELECT event_id, round(curvature,4) AS curvature FROM ({_CURVE})")
def curvature(spark, sf_dir):
    return _curved(spark, sf_dir).select("event_id", F.round("curvature", 4).alias("curvature"))


@query("ev", f"SELECT event_id, ring, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ring ORDER BY round(curvature,6) DESC, event_id) AS rank FROM ({_CURVE}) WHERE curvature IS NOT NULL) WHERE rank <= 2")
def curvature_topk(spark, sf_dir):
    c = _curved(spark, sf_dir).where("curvature is not null")
    return windows.top_k(c, ["ring"], [F.round("curvature", 6).desc(), F.col("event_id")], 2).select("event_id", "ring", "rank")


@query("ev", f"""SELECT event_id, CASE WHEN n > 11 AND i >= 5 AND i < 5 + floor((n-11)*6/6) THEN CAST(length(list_filter([0,1,2,3,4,5], lambda j: i >= 5 + floor((n-11)*j/6))) - 1 AS INT) END AS region
FROM (SELECT event_id, row_number() OVER {_KEYED}) - 1 AS i, count(*) OVER (PARTITION BY ring) AS n FROM ev)""")
def region_split(spark, sf_dir):
    out = windows.region_split(V.events(spark, sf_dir), ["ring"], ["us", "event_id"])
    return out.select("event_id", F.col("region").cast("int").alias("region"))


@query("ev", f"SELECT event_id, round(pow(value - lead(value) OVER {_KEYED}),2),6) AS gap_next, round(pow(value - lag(value) OVER {_KEYED}),2),6) AS gap_previous FROM ev")
def neighbor_gap(spark, sf_dir):
    return rounded(windows.neighbour_gap(V.events(spark, sf_dir), ["value"], ["ring"], ["us", "event_id"]).select("event_id", "gap_next", "gap_previous"), "gap_next gap_previous")


@query("ev", f"SELECT event_id, (coalesce(max(CASE WHEN value > 250 THEN 1 ELSE 0 END) OVER {_KEYED} ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING),0) + coalesce(max(CASE WHEN value < 1 THEN 1 ELSE 0 END) OVER {_KEYED} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING),0)) > 0 AS picked FROM ev")
def suppress(spark, sf_dir):
    return windows.suppress(V.events(spark, sf_dir), F.col("value") > 250, F.col("value") < 1, ["ring"], ["us", "event_id"]).select("event_id", "picked")


_HOLES = "SELECT event_id, ring, us, CASE WHEN event_type IN ('click','view') THEN value END AS value FROM ev"


@query("ev", f"""WITH h AS ({_HOLES}), b AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN us END) OVER (PARTITION BY ring ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p, min(CASE WHEN value IS NOT NULL THEN us END) OVER (PARTITION BY ring ORDER BY us ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM h)
SELECT b.event_id, round(coalesce(b.value, l.value + (b.us - p) / CAST(n - p AS DOUBLE) * (r.value - l.value)), 6) AS filled FROM b LEFT JOIN h l ON l.ring = b.ring AND l.us = p LEFT JOIN h r ON r.ring = b.ring AND r.us = n""")
def gap_fill(spark, sf_dir):
    ev = V.events(spark, sf_dir).withColumn("value", F.when(F.col("event_type").isin("click", "view"), F.col("value")))
    return windows.gap_fill(ev, "value", "us", ["ring"]).select("event_id", F.round("filled", 6).alias("filled"))


@query("ev", f"SELECT event_id, coalesce(max(CASE WHEN value > 200 THEN 1 ELSE 0 END) OVER {_KEYED} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS passed FROM ev")
def sticky_unwrap(spark, sf_dir):
    return windows.sticky(V.events(spark, sf_dir), F.col("value") > 200, ["ring"], ["us", "event_id"]).select("event_id", "passed")


@query("ev", f"""WITH d AS (SELECT *, coalesce((us - lag(us) OVER {_KEYED})) / 1e6, 0) AS dt FROM ev), v AS (SELECT *, sum((value/1000)*dt) OVER {_KEYED} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS velocity FROM d),
s AS (SELECT *, coalesce(lag(velocity) OVER {_KEYED}), 0) AS v0 FROM v) SELECT event_id, round(velocity,3) AS velocity, round((sum(v0*dt + 5e-1*(value/1000)*dt*dt) OVER {_KEYED} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 1e6, 3) AS shift FROM s""")
def imu_integrate(spark, sf_dir):
    ev = V.events(spark, sf_dir).withColumn("a", F.col("value") / 1000)
    out = windows.integrate(ev, "a", "us", ["ring"])
    return out.select("event_id", F.round("velocity", 3).alias("velocity"), F.round(F.col("shift") / 1e6, 3).alias("shift"))


@query("ev", "SELECT ring, min(hour) AS first, max(hour) AS last, count(*) AS length FROM (SELECT ring, hour, hour - row_number() OVER (PARTITION BY ring ORDER BY hour) AS g FROM (SELECT DISTINCT ring, us // 3600000000 AS hour FROM ev)) GROUP BY ring, g")
def mask_islands(spark, sf_dir):
    ev = V.events(spark, sf_dir).withColumn("hour", F.floor(F.col("us") / 3_600_000_000))
    return windows.islands(ev, "hour", ["ring"])


@query("ev", "SELECT ring, event_type, max(us) AS us, arg_max(event_id, us) AS event_id FROM ev GROUP BY 1, 2")
def last_wins(spark, sf_dir):
    return aggs.last_wins(V.events(spark, sf_dir), ["ring", "event_type"], "us", ["event_id"])


@query("ev", f"SELECT event_id, list(event_id) OVER {_KEYED} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)[1] AS oldest, CAST(len(list(event_id) OVER {_KEYED} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) AS INT) AS n FROM ev")
def bounded_history(spark, sf_dir):
    h = windows.bounded_history(V.events(spark, sf_dir), "event_id", ["ring"], ["us", "event_id"], 4)
    return h.select("event_id", F.get("history", F.lit(0)).alias("oldest"), F.size("history").alias("n"))


@query("ev", f"SELECT event_id, k FROM (SELECT event_id, row_number() OVER {_KEYED}) AS k FROM ev) WHERE k > 20 AND k % 2 = 1")
def startup_and_decimation(spark, sf_dir):
    """The first 20 messages of a stream go, then every second one stays."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("ring").orderBy("us", "event_id")).cast("long").alias("k")
    return V.events(spark, sf_dir).select("event_id", k).where("k > 20 and k % 2 = 1")


@query("ev", """WITH n AS (SELECT event_id, ring, us, value, lead(event_id) OVER (PARTITION BY ring ORDER BY us, event_id) AS nxt FROM ev), chain AS (SELECT event_id AS origin, event_id AS cur, value, 0 AS hop FROM n UNION ALL SELECT c.origin, n2.event_id, c.value + n2.value, c.hop + 1 FROM chain c JOIN n n1 ON n1.event_id = c.cur JOIN n n2 ON n2.event_id = n1.nxt WHERE c.hop < 3)
SELECT origin, max(hop) AS hops, arg_max(cur, hop) AS last, round(arg_max(value, hop), 4) AS total FROM chain GROUP BY 1""")
def flow_chain(spark, sf_dir):
    """Follows each row's link to the next one, three hops: one join a hop on the link table."""
    from pyspark.sql import Window

    w = Window.partitionBy("ring").orderBy("us", "event_id")
    links = V.events(spark, sf_dir).select("event_id", "value", F.lead("event_id").over(w).alias("nxt"))
    at = links.select(F.col("event_id").alias("origin"), F.col("event_id").alias("last"), "value", "nxt", F.lit(0).alias("hops"))
    step = links.select(F.col("event_id").alias("to"), F.col("value").alias("v"), F.col("nxt").alias("then"))
    for _ in range(3):
        j = at.join(step, at["nxt"] == step["to"], "left")
        at = j.select("origin", F.coalesce("to", "last").alias("last"), (F.col("value") + F.coalesce("v", F.lit(0.0))).alias("value"), F.col("then").alias("nxt"), (F.col("hops") + F.col("to").isNotNull().cast("int")).alias("hops"))
    return at.select("origin", "hops", "last", F.round("value", 4).alias("total"))


@query("ev", "SELECT event_id, CAST(trunc((us - 1704067200000000) / 1e6 * 10 + 5e-1) % 255 AS INT) AS label FROM ev")
def time_label(spark, sf_dir):
    from ..functions.scalars import time_label as label

    return V.events(spark, sf_dir).select("event_id", label((F.col("us") - 1_704_067_200_000_000) / 1e6, F.lit(0.0)).alias("label"))


@query("ev", f"SELECT event_id, round(998e-3*value + 2e-3*coalesce(lag(value) OVER {_KEYED}), value), 6) AS blended FROM ev")
def pose_blend(spark, sf_dir):
    """A pose angle, mixed with 0.2 per cent of the sensor's last one."""
    from pyspark.sql import Window

    w = Window.partitionBy("ring").orderBy("us", "event_id")
    return V.events(spark, sf_dir).select("event_id", F.round(0.998 * F.col("value") + 0.002 * F.coalesce(F.lag("value").over(w), F.col("value")), 6).alias("blended"))


@query("", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%d') AS day, string_split(event_type, 'i')[1] AS head FROM events")
def text_and_time_functions(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.get(F.split("event_type", "i"), F.lit(0)).alias("head"))


#: Inertial states made of the events of one kind: angles, velocity, position.
_STATES = {"roll": "value/1e3", "pitch": "value/2e3", "yaw": "(event_id % 63)/1e1 - 314e-2", "vx": "value/1e2", "vy": "(event_id % 7)/1e1", "vz": "1e-1", "px": "value/1e1", "py": "(event_id % 11)*1e0", "pz": "value/5e1"}
_SHORT = "(n.yaw - p.yaw - CASE WHEN n.yaw - p.yaw > pi() THEN 2*pi() WHEN n.yaw - p.yaw < -pi() THEN -2*pi() ELSE 0e0 END)"


def _at_sql(name: str, source: str, keep: str, prefix: str) -> str:
    """States at the times ``us`` of ``source``."""
    value = lambda c: f"CASE WHEN p.us IS NULL THEN n.{c} WHEN n.us IS NULL OR n.us = p.us THEN p.{c} ELSE p.{c} + (q.us - p.us)/CAST(n.us - p.us AS DOUBLE)*{_SHORT if c == 'yaw' else f'(n.{c} - p.{c})'} END AS {prefix}{c}"
    return f"{name} AS (SELECT {keep}, {', '.join(value(c) for c in _STATES)} FROM {source} q ASOF LEFT JOIN st p ON q.ring = p.ring AND q.us >= p.us ASOF LEFT JOIN st n ON q.ring = n.ring AND q.us <= n.us)"


def _back_sql(x: str, y: str, z: str, p: str) -> list[str]:
    """The vector turned by -yaw about y, -pitch about x, -roll about z."""
    a = (f"(cos({p}yaw)*({x}) - sin({p}yaw)*({z}))", f"({y})", f"(cos({p}yaw)*({z}) + sin({p}yaw)*({x}))")
    b = (a[0], f"(cos({p}pitch)*{a[1]} + sin({p}pitch)*{a[2]})", f"(cos({p}pitch)*{a[2]} - sin({p}pitch)*{a[1]})")
    return [f"(cos({p}roll)*{b[0]} + sin({p}roll)*{b[1]})", f"(cos({p}roll)*{b[1]} - sin({p}roll)*{b[0]})", b[2]]


_SWEEPS = f"""st AS (SELECT ring, us, {", ".join(f"{e} AS {c}" for c, e in _STATES.items())} FROM ev WHERE event_type = 'view'), sw AS (SELECT ring, us // 86400000000 AS day, min(us) AS first, max(us) AS final FROM ev GROUP BY 1, 2),
{_at_sql("b", "(SELECT *, first AS us FROM sw)", "q.ring, q.day, q.first, q.final", "s_")}, {_at_sql("e", "(SELECT *, final AS us FROM sw)", "q.ring, q.day", "e_")}, sweep AS (SELECT *, (final - first)/1e6 AS took FROM b JOIN e USING (ring, day))"""


def _imu_sql() -> str:
    shift = _back_sql(*(f"e_p{c} - s_p{c} - s_v{c}*took" for c in "xyz"), "s_")
    velo = _back_sql(*(f"e_v{c} - s_v{c}" for c in "xyz"), "s_")
    told = ["s_pitch", "s_yaw", "s_roll", "e_pitch", "e_yaw", "e_roll", *(f"{e} AS {n}_{c}" for n, v in (("shift", shift), ("velo", velo)) for c, e in zip("xyz", v, strict=True))]
    names = [x.split(" AS ")[-1] for x in told]
    return f"WITH {_SWEEPS}, o AS (SELECT ring, day, {', '.join(told)} FROM sweep) SELECT ring, day, {', '.join(f'round({n}, 6) + 0e0 AS {n}' for n in names)} FROM o"


def _start_sql() -> str:
    turn = ("cos(c_roll)*x - sin(c_roll)*y", "sin(c_roll)*x + cos(c_roll)*y", "z")
    pitch = ("kx", "cos(c_pitch)*ky - sin(c_pitch)*kz", "sin(c_pitch)*ky + cos(c_pitch)*kz")
    yaw = ("cos(c_yaw)*lx + sin(c_yaw)*lz", "ly", "cos(c_yaw)*lz - sin(c_yaw)*lx")
    step = lambda name, source, v, n: f"{name} AS (SELECT *, {', '.join(f'{e} AS {n}{c}' for c, e in zip('xyz', v, strict=True))} FROM {source})"
    moved = tuple(f"y{c} + c_p{c} - s_p{c} - s_v{c}*gone" for c in "xyz")
    out = _back_sql("mx", "my", "mz", "s_")
    return f"""WITH {_SWEEPS}, pts AS (SELECT event_id, ring, us, us // 86400000000 AS day, value/1e1 AS x, value/2e1 AS y, 1e0 AS z FROM ev WHERE event_type = 'click'), {_at_sql("c", "pts", "q.event_id, q.ring, q.us, q.day, q.x, q.y, q.z", "c_")},
j AS (SELECT c.*, {", ".join(f"s_{n}" for n in _STATES)}, (us - first)/1e6 AS gone FROM c JOIN b USING (ring, day)), {step("k1", "j", turn, "k")}, {step("k2", "k1", pitch, "l")}, {step("k3", "k2", yaw, "y")}, {step("k4", "k3", moved, "m")}
SELECT event_id, {", ".join(f"round(coalesce({e}, {c}), 4) + 0e0 AS {c}" for c, e in zip("xyz", out, strict=True))} FROM k4"""


def _imu(spark, sf_dir):
    ev = V.events(spark, sf_dir)
    states = ev.where("event_type = 'view'").select("ring", "us", *(F.expr(e).cast("double").alias(c) for c, e in _STATES.items()))
    ev = ev.withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    sweeps = ev.groupBy("ring", "day").agg(F.min("us").alias("begin"), F.max("us").alias("end"))
    return ev, states, imu.sweep_states(sweeps, states, "us", ["ring"])


@query("ev", _imu_sql())
def sweep_imu_states(spark, sf_dir):
    """The inertial state of each sweep (a user's day): angles at both ends, shift and change of velocity in the axes of its begin."""
    names = [f"{p}_{a}" for p in "se" for a in ("pitch", "yaw", "roll")] + [f"{n}_{c}" for n in ("shift", "velo") for c in "xyz"]
    return rounded(_imu(spark, sf_dir)[2].select("ring", "day", *names), " ".join(names))


@query("ev", _start_sql())
def imu_to_sweep_start(spark, sf_dir):
    """Points moved to their sweep's start by the inertial states at their own times."""
    ev, states, sweeps = _imu(spark, sf_dir)
    points = ev.where("event_type = 'click'").select("event_id", "ring", "day", "us", (F.col("value") / 10).alias("x"), (F.col("value") / 20).alias("y"), F.lit(1.0).alias("z"))
    return rounded(imu.to_sweep_start(points, sweeps, states, "us", ["ring"], ["day"]).select("event_id", "x", "y", "z"), "x y z", 4)
