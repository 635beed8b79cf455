"""The choice of a track's chain as rounds over tables.

A round builds the chains of the tracks that are still open, judges them by
window rules and by the road, and writes what it learned: penalties by point,
bans by directed pair of cells, questions asked, answers by coordinate key.
Tracks without new faults are done and leave every table; what was asked is
skipped by anti joins, and an answer is got once for all tracks. Only the
heaviest chain itself, a fold over a track's points, is a Python function.

State of a round: ``live`` (a row for each point of an open track), ``bans``,
``asked``; ``answers`` only grows by what is new.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymill import model as m
from waymill.functions import geo
from waymill.functions import kernels as k
from waymill.operators import sequence as s
from waymill.plans.shared import shared_path

US = s.US
Keep = Callable[[DataFrame], DataFrame]
LIVE = "track_id string, seq int, t_us long, lon double, lat double, w double, trusted boolean, hot boolean, penalty double"
BAN = "track_id string, ya long, xa long, yb long, xb long, need_s double"
ASKED = "track_id string, kind string, t_a long, t_b long"
ANSWER = "key string, dist_m double, fault string"
_CELLS = ["ya", "xa", "yb", "xb"]


def keeper(spark: SparkSession) -> Keep:
    """Writes a DataFrame to the shared folder and reads it back: cuts the lineage."""

    def keep(df: DataFrame) -> DataFrame:
        path = shared_path(spark, "rounds")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep


@dataclass
class Picked:
    """``chain`` (track_id, seq), ``report`` (track_id, road_passes, loops,
    road_banned, road_asked, cut_short, faults) and, for each round, how many
    tracks, points and questions it handled."""

    chain: DataFrame
    report: DataFrame
    rounds: list[dict] = field(default_factory=list)


def dealt(df: DataFrame) -> DataFrame:
    """For Python functions over tracks, whose cost the rows' bytes don't tell; window
    rules are dealt out by Spark itself."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "track_id")


def chains(live: DataFrame, bans: DataFrame) -> DataFrame:
    """The rows of ``live`` that are on their track's heaviest drivable chain."""

    def run(key: tuple, points: pa.Table, known: pa.Table) -> pa.Table:
        if not points.num_rows:
            return points
        points = points.sort_by("seq")
        column = lambda c: points.column(c).to_numpy()
        banned = {tuple(r[:4]): r[4] for r in zip(*(known.column(c).to_pylist() for c in [*_CELLS, "need_s"]))}
        builder = k.ChainBuilder(k.Track(column("t_us"), column("lon"), column("lat")))
        return points.take(pa.array(builder.build(column("w") - column("penalty"), banned)))

    return dealt(live).groupBy("track_id").cogroup(dealt(bans).groupBy("track_id")).applyInArrow(run, LIVE)


# ---------------------------------------------------------------- questions


def _worth_asking(metres: Column, seconds: Column) -> Column:
    slow = (seconds > 0) & (metres / seconds * 3.6 <= m.ROAD_SHORT_KMH)
    return (metres >= m.ROAD_LEAST_M) & ~((metres < m.ROAD_SHORT_M) & slow)


def road_questions(chain: DataFrame) -> DataFrame:
    """Pairs of a chain's points whose road distance is worth asking for: its steps,
    and wider ones around points that are penalised or near a long sudden jump.
    (track_id, i, j, t_a, t_b, a_lon, ..., ya, ..., key), one for each pair of times."""
    w = s.order()
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = F.struct("seq", "t_us", "lon", "lat")
    c = chain.withColumns({"at": F.row_number().over(w), "here": here, "is_hot": (F.col("penalty") > 0) | F.col("hot")})
    c = c.withColumns({"first": F.first("here").over(whole), "last": F.last("here").over(whole), "b0": F.lead("here").over(w)})
    for n, step in enumerate(m.HOT_STEPS):
        c = c.withColumns({f"a{n + 1}": F.coalesce(F.lag("here", step).over(w), F.col("first")), f"b{n + 1}": F.coalesce(F.lead("here", step).over(w), F.col("last"))})

    def end(kind: int) -> Column:
        a, b = F.col(f"a{kind}" if kind else "here"), F.col(f"b{kind}")
        # degrees along both axes are no less than the way: most pairs are left here, before rows and angles are made of them
        far = (F.abs(a["lon"] - b["lon"]) + F.abs(a["lat"] - b["lat"])) * m.CELL_DEGREE_M >= m.ROAD_LEAST_M
        return F.when(far & (F.col("is_hot") if kind else F.lit(True)), F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b")))

    q = c.select("track_id", "at", F.explode(F.array(*(end(kind) for kind in range(len(m.HOT_STEPS) + 1)))).alias("q"))
    q = q.where("q is not null").where("q.a.seq < q.b.seq")
    q = q.select("track_id", "at", F.col("q.kind").alias("kind"), *[F.col(f"q.{e}.{x}").alias(n) for e, names in (("a", ("i", "t_a", "a_lon", "a_lat")), ("b", ("j", "t_b", "b_lon", "b_lat"))) for x, n in zip(("seq", "t_us", "lon", "lat"), names)])
    metres = geo.haversine(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"))
    q = q.where(_worth_asking(metres, (F.col("t_b") - F.col("t_a")) / US))
    a, b = geo.ban_cell(F.col("a_lon"), F.col("a_lat")), geo.ban_cell(F.col("b_lon"), F.col("b_lat"))
    return q.withColumns({"ya": a["y"], "xa": a["x"], "yb": b["y"], "xb": b["x"]})


def half_hours(chain: DataFrame) -> DataFrame:
    """Adds half: the number of a point's half hour, each of which begins with the
    first point behind the one before."""
    # a fold over the times of a track alone; an entry is added for each half hour, not for each point
    start = F.struct(F.lit(None).cast("long").alias("a"), F.array().cast("array<long>").alias("all"))
    onward = lambda acc, t: F.when(acc["a"].isNull() | (t > acc["a"] + m.LOOP_S * US), F.struct(t.alias("a"), F.concat(acc["all"], F.array(t)).alias("all"))).otherwise(acc)
    begins = chain.groupBy("track_id").agg(F.sort_array(F.collect_list("t_us")).alias("t")).select("track_id", F.explode(F.aggregate("t", start, onward, lambda acc: acc["all"])).alias("t_us"))
    first = chain.join(begins.withColumn("begins", F.lit(1)), ["track_id", "t_us"], "left")
    mark = F.when((F.col("begins") == 1) & (F.lag("t_us").over(s.order()).isNull() | (F.lag("t_us").over(s.order()) < F.col("t_us"))), 1).otherwise(0)
    return first.withColumn("mark", mark).withColumn("half", F.sum("mark").over(s.order())).drop("begins", "mark")


def loop_questions(halves: DataFrame) -> DataFrame:
    """Half hours of four points and more that wind long enough to ask for the road between their ends."""
    same = F.col("half") == F.lag("half").over(s.order())
    p = s.steps(halves).withColumn("inner_m", F.when(same, F.col("step_m")).otherwise(0.0)).withColumn("_all", F.count("*").over(Window.partitionBy("track_id")))
    end = lambda f, c: f(c, "seq")
    g = p.groupBy("track_id", "half").agg(
        F.count("*").alias("n"), F.max("_all").alias("all"), F.sum("inner_m").alias("path_m"), F.min("seq").alias("i"), F.max("seq").alias("j"), F.min("t_us").alias("t_a"), F.max("t_us").alias("t_b"),
        *[end(f, c).alias(f"{e}_{c}") for e, f in (("a", F.min_by), ("b", F.max_by)) for c in ("lon", "lat")],
    )
    return g.where((F.col("all") >= m.LOOP_POINTS) & (F.col("n") >= m.LOOP_POINTS) & (F.col("path_m") >= m.LOOP_PATH_M)).drop("n", "all")


# ---------------------------------------------------------------- verdicts


def _faults(df: DataFrame, rule: str, add: Column | float, hit: Column) -> DataFrame:
    """(track_id, seq, add, rule, fault): what a rule adds to a point's penalty;
    ``fault`` is 1 on one row of each hit."""
    return df.select("track_id", "seq", (add if isinstance(add, Column) else F.lit(float(add))).alias("add"), F.lit(rule).alias("rule"), hit.cast("int").alias("fault"))


def road_faults(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions whose road is too long for their time, with what a vehicle needs."""
    dt = (F.col("t_b") - F.col("t_a")) / US
    found = questions.join(answers.select("key", "dist_m"), "key")
    return found.where(F.col("dist_m").isNotNull() & ~((dt > 0) & (F.col("dist_m") / dt * 3.6 <= m.ROAD_KMH))).withColumn("need_s", F.col("dist_m") / (m.ROAD_KMH / 3.6))


def loop_faults(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Half hours that wind too much; after one, less is enough for the next."""
    ratio = F.col("path_m") / F.greatest("dist_m", F.lit(m.LOOP_FLOOR_M))
    judged = questions.join(answers.select("key", "dist_m"), "key").where("dist_m is not null")
    # between the two bounds the verdict is that of the half hour before
    sure = F.when(ratio > m.LOOP_ENTER, True).when(ratio <= m.LOOP_STAY, False)
    before = Window.partitionBy("track_id").orderBy("half").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return judged.withColumn("winds", F.coalesce(F.last(sure, ignorenulls=True).over(before), F.lit(False))).where("winds")


def chain_faults(chain: DataFrame) -> DataFrame:
    """What the rules that need no road find in a chain: stubs, sideways
    acceleration, rushed minutes, lonely points."""
    w, whole = s.order(), Window.partitionBy("track_id")
    c = chain.withColumn("_all", F.count("*").over(whole))
    # stubs: a stretch with a trusted stop is safe
    p = s.parts(c, F.col("step_m") >= m.STUB_GAP_M).withColumn("safe", F.max(F.col("trusted").cast("int")).over(Window.partitionBy("track_id", "part")))
    found = p.where("safe = 0").join(s.stubs(c).select("track_id", "part", "first"), ["track_id", "part"])
    out = _faults(found, "stub", m.STUB_W, F.col("seq") == F.col("first"))
    bent = s.lateral(c).where(F.col("g") >= m.LATERAL_G)
    out = out.unionAll(_faults(bent, "lateral", m.LATERAL_W, F.lit(1)))
    # a point pays once for each rushed minute that it lies in: those begun so far less those ended before
    minutes = s.rush(c).where("_all >= 3").select("track_id", "seq", "end_seq")
    marks = minutes.select("track_id", "seq", F.lit(1).alias("begun"), F.lit(0).alias("ended")).unionAll(minutes.select("track_id", F.col("end_seq").alias("seq"), F.lit(0), F.lit(1)))
    marks = marks.groupBy("track_id", "seq").agg(F.sum("begun").alias("begun"), F.sum("ended").alias("ended"))
    r = c.select("track_id", "seq", "t_us").join(marks, ["track_id", "seq"], "left").na.fill(0, ["begun", "ended"])
    times = F.sum("begun").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.coalesce(F.sum("ended").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = r.withColumn("times", times).where("times > 0")
    out = out.unionAll(_faults(r, "rush", F.col("times") * m.RUSH_W, F.col("begun") > 0))
    alone = s.parts(c.where("_all >= 4"), F.col("dt_s") >= m.LONELY_S).join(s.lonely(c.where("_all >= 4")).select("track_id", "part", "first"), ["track_id", "part"])
    return out.unionAll(_faults(alone, "lonely", m.LONELY_W, F.col("seq") == F.col("first")))


# ---------------------------------------------------------------- rounds


def _new_answers(questions: DataFrame, answers: DataFrame, distances, keep: Keep) -> tuple[DataFrame, int]:
    """Asks for the pairs that no track has asked for yet."""
    wanted = questions.select("key", "a_lon", "a_lat", "b_lon", "b_lat").groupBy("key").agg(*(F.min(c).alias(c) for c in ("a_lon", "a_lat", "b_lon", "b_lat")))
    new = keep(distances(wanted.join(answers.select("key"), "key", "left_anti")).select("key", "dist_m", "fault"))
    return answers.unionAll(new), new.count()


def pick(points: DataFrame, distances: Callable[[DataFrame], DataFrame] | None, keep: Keep, passes: int = m.PASSES) -> Picked:
    """The chain of every track of ``points`` (track_id, seq, t_us, lon, lat, w,
    trusted). ``distances`` answers (key, a_lon, a_lat, b_lon, b_lat) with (key,
    dist_m, fault); without it the road isn't asked. Rows: a track of one point is
    its own chain; points of equal time keep the order of seq."""
    from waymill.plans.providers import pair_key

    spark = points.sparkSession
    live = keep(s.hot(points.select("track_id", "seq", "t_us", "lon", "lat", "w", "trusted")).withColumn("penalty", F.lit(0.0)).select("track_id", "seq", "t_us", "lon", "lat", "w", "trusted", F.coalesce("hot", F.lit(False)).alias("hot"), "penalty"))
    bans, asked, answers = (spark.createDataFrame([], x) for x in (BAN, ASKED, ANSWER))
    done: list[DataFrame] = []
    ended: list[DataFrame] = []
    tallies: list[DataFrame] = []
    told: list[dict] = []
    for number in range(passes):
        # dealt out once for all window rules: by its bytes a chain would be one task
        chain = dealt(keep(chains(live, bans)))
        faults = chain_faults(chain)
        new_bans, open_asked = bans.limit(0), asked
        if distances is not None:
            short = chain.withColumn("_all", F.count("*").over(Window.partitionBy("track_id")))
            road = road_questions(short.where("_all >= 2")).join(bans.select("track_id", *_CELLS), ["track_id", *_CELLS], "left_anti")
            first = Window.partitionBy("track_id", "t_a", "t_b").orderBy(F.col("kind") > 0, "at", "kind")
            road = road.join(asked.where("kind = 'road'").select("track_id", "t_a", "t_b"), ["track_id", "t_a", "t_b"], "left_anti").withColumn("_k", F.row_number().over(first)).where("_k = 1")
            halves = half_hours(chain)
            loops = loop_questions(halves).join(asked.where("kind = 'loop'").select("track_id", "t_a", "t_b"), ["track_id", "t_a", "t_b"], "left_anti")
            same = ["track_id", "i", "j", "t_a", "t_b", "a_lon", "a_lat", "b_lon", "b_lat"]
            none = lambda c, t: F.lit(None).cast(t).alias(c)
            questions = road.select(F.lit("road").alias("kind"), *same, *_CELLS, none("half", "long"), none("path_m", "double"))
            questions = questions.unionAll(loops.select(F.lit("loop").alias("kind"), *same, *(none(c, "long") for c in _CELLS), "half", "path_m"))
            questions = keep(questions.withColumn("key", pair_key()))
            answers, n_asked = _new_answers(questions, answers, distances, keep)
            hits = road_faults(questions.where("kind = 'road'"), answers)
            new_bans = hits.select("track_id", *_CELLS, "need_s")
            faults = faults.unionAll(_faults(hits.withColumn("seq", F.explode(F.array("i", "j"))), "road", m.ROAD_W, F.col("seq") == F.col("i")))
            winding = loop_faults(questions.where("kind = 'loop'"), answers).select("track_id", "half", "i")
            faults = faults.unionAll(_faults(halves.join(winding, ["track_id", "half"]), "loop", m.LOOP_W, F.col("seq") == F.col("i")))
            open_asked = asked.unionAll(questions.select("track_id", "kind", "t_a", "t_b"))
            complaint = questions.join(answers.where("fault is not null"), "key").groupBy("track_id").agg(F.count("*").alias("failed"))
        faults = keep(faults)
        found = faults.groupBy("track_id").agg(F.sum("fault").alias("n"), F.sum(F.when(F.col("rule") == "loop", F.col("fault")).otherwise(0)).alias("loops"))
        found = found.where("n > 0")
        tally = chain.select("track_id").distinct().join(found, "track_id", "left").na.fill(0, ["n", "loops"])
        if distances is not None:
            tally = tally.join(questions.groupBy("track_id").agg(F.count("*").alias("asked")), "track_id", "left").join(complaint, "track_id", "left").na.fill(0, ["asked", "failed"])
        else:
            tally = tally.withColumns({"asked": F.lit(0).cast("long"), "failed": F.lit(0).cast("long")})
        tally = keep(tally.withColumn("pass", F.lit(number + 1)))
        tallies.append(tally)
        going = tally.where("n > 0").select("track_id")
        done.append(chain.join(going, "track_id", "left_anti").select("track_id", "seq"))
        sizes = tally.agg(F.count("*"), F.count(F.when(F.col("n") > 0, 1)), F.sum("asked")).first()
        told.append({"tracks": sizes[0], "open": sizes[1], "points": live.count(), "questions": sizes[2] or 0, "asked": n_asked if distances is not None else 0})
        ended.append(bans.join(going, "track_id", "left_anti"))
        if not sizes[1]:
            break
        add = faults.groupBy("track_id", "seq").agg(F.sum("add").alias("add"))
        live = keep(live.join(going, "track_id", "left_semi").join(add, ["track_id", "seq"], "left").withColumn("penalty", F.col("penalty") + F.coalesce("add", F.lit(0.0))).select(live.columns))
        bans = keep(bans.unionAll(new_bans).join(going, "track_id", "left_semi").groupBy("track_id", *_CELLS).agg(F.max("need_s").alias("need_s")))
        asked = keep(open_asked.join(going, "track_id", "left_semi"))
    else:  # out of passes: what the last one learned still counts
        done.append(chains(live, bans).select("track_id", "seq"))
        ended.append(bans)
    all_of = lambda parts: reduce(DataFrame.unionAll, parts)
    last = F.max_by("n", "pass").alias("faults")
    report = all_of(tallies).groupBy("track_id").agg(F.max("pass").alias("road_passes"), F.sum("loops").alias("loops"), F.sum("asked").alias("road_asked"), F.sum("failed").alias("failed"), last)
    report = report.join(all_of(ended).groupBy("track_id").agg(F.count("*").alias("road_banned")), "track_id", "left").na.fill(0, ["road_banned"])
    whole = [F.col(c).cast("int").alias(c) for c in ("road_passes", "loops", "road_asked", "road_banned", "failed", "faults")]
    report = report.select("track_id", *whole, ((F.col("faults") > 0) & (F.lit(passes) < m.PASSES)).alias("cut_short"))
    return Picked(keep(all_of(done)), keep(report), told)
