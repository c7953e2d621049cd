"""Filtered discovery: eligibility, paging, radius search, facets, counts, role-scoped reads."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import canonical, canonical_set, haversine_km, length_prefixed
from ..specs import STATUSES

MAX_SKILLS, MAX_TERM, MAX_RADIUS_KM, FACET_ROWS = 20, 100, 500.0, 20
APPLICATION_STATUSES = ("Created", *STATUSES)


# Criteria trees -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Equal:
    column: str
    value: object


@dataclass(frozen=True)
class Holds:
    """An array column holds the value."""

    column: str
    value: object


@dataclass(frozen=True)
class AtLeast:
    column: str
    value: object


@dataclass(frozen=True)
class Missing:
    column: str


@dataclass(frozen=True)
class AllOf:
    parts: tuple


@dataclass(frozen=True)
class AnyOf:
    parts: tuple


def criteria_to_column(c) -> Column:
    """A criteria tree as one predicate; an unknown counts as false."""
    if isinstance(c, Equal):
        out = F.col(c.column) == F.lit(c.value)
    elif isinstance(c, Holds):
        out = F.array_contains(c.column, F.lit(c.value))
    elif isinstance(c, AtLeast):
        out = F.col(c.column) >= F.lit(c.value)
    elif isinstance(c, Missing):
        out = F.col(c.column).isNull()
    else:
        every = isinstance(c, AllOf)
        out = F.lit(every)
        for part in c.parts:
            out = (out & criteria_to_column(part)) if every else (out | criteria_to_column(part))
    return F.coalesce(out, F.lit(False))


@dataclass(frozen=True)
class JobFilter:
    city: str | None = None
    skills: tuple[str, ...] = ()
    match_all: bool = True
    created_after: object = None


@dataclass(frozen=True)
class CandidateFilter:
    skills: tuple[str, ...] = ()
    country: str | None = None
    city: str | None = None
    availability: str | None = None
    extra: tuple = field(default=())


def _terms(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in sorted({v.strip().lower() for v in values})])


def open_jobs(jobs: DataFrame, f: JobFilter) -> DataFrame:
    """Open jobs by canonical city, all or any of the skills, and age."""
    out = jobs.where(F.col("status") == "Open")
    if f.city is not None:
        out = out.where(canonical("city") == f.city.strip().lower())
    if f.skills:
        own = canonical_set("skills")
        out = out.where(F.size(F.array_except(_terms(f.skills), own)) == 0 if f.match_all else F.arrays_overlap(own, _terms(f.skills)))
    return out if f.created_after is None else out.where(F.col("createdAt") > F.lit(f.created_after))


def open_jobs_with_recovery(jobs: DataFrame, f: JobFilter) -> DataFrame:
    """If nothing is found, without the age, then with any instead of all skills; ``relaxed`` says what was dropped."""
    tries = [(f, [])]
    if f.created_after is not None:
        tries.append((JobFilter(f.city, f.skills, f.match_all, None), ["createdAfter"]))
    if f.skills and f.match_all:
        last = tries[-1]
        tries.append((JobFilter(f.city, f.skills, False, last[0].created_after), [*last[1], "matchAll"]))
    out = None
    for n, (g, relaxed) in enumerate(tries[:3]):
        one = open_jobs(jobs, g).withColumn("attempt", F.lit(n)).withColumn("relaxed", F.array(*map(F.lit, relaxed)).cast("array<string>"))
        out = one if out is None else out.unionByName(one)
    first = out.agg(F.min("attempt").alias("first"))
    return out.join(F.broadcast(first), F.col("attempt") == F.col("first")).drop("first")


def eligible_candidates(users: DataFrame, f: CandidateFilter) -> DataFrame:
    """Active candidates with the skills; private attributes are tested for those who opted in, others never match on them."""
    out = users.where((F.col("role") == "Candidate") & (F.col("accountStatus") == "Active"))
    if f.skills:
        out = out.where(F.size(F.array_except(_terms(f.skills), canonical_set("skills"))) == 0)
    private = [(c, v) for c, v in (("country", f.country), ("city", f.city), ("availabilityStatus", f.availability)) if v is not None]
    if private:
        ok = F.coalesce(F.col("recruiterSearchOptIn"), F.lit(False))
        for c, v in private:
            ok = ok & (canonical(c) == v.strip().lower())
        out = out.where(F.coalesce(ok, F.lit(False)))
    for c in f.extra:
        out = out.where(criteria_to_column(c))
    return out


def invalid_requests(requests: DataFrame) -> DataFrame:
    """Requests ``(requestId, skills, city, radiusKm)`` with the reasons why they are refused."""
    radius = F.col("radiusKm")
    reasons = F.array_compact(F.array(
        F.when(F.size("skills") > MAX_SKILLS, "TOO_MANY_SKILLS"),
        F.when(F.exists("skills", lambda s: (F.length(F.trim(s)) == 0) | (F.length(s) > MAX_TERM)), "INVALID_SKILL"),
        F.when(F.length(F.trim("city")) == 0, "BLANK_CITY"),
        F.when(radius.isNotNull() & (F.isnan(radius) | (radius <= 0) | (radius > MAX_RADIUS_KM)), "INVALID_RADIUS"),
    ))
    return requests.withColumn("reasons", reasons).where(F.size("reasons") > 0)


def backfill_canonical(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs with canonical city and skills, and those whose values can't be derived."""
    done = jobs.withColumn("canonicalCity", canonical("city")).withColumn("canonicalSkills", canonical_set("skills"))
    bad = F.col("canonicalCity").isNull() | (F.length("canonicalCity") == 0) | F.col("canonicalSkills").isNull()
    return done.where(~F.coalesce(bad, F.lit(True))), done.where(F.coalesce(bad, F.lit(True)))


# Paging ---------------------------------------------------------------------------------------


def keyset_page(df: DataFrame, ts: str, id_: str, cursor: tuple | None, n: int) -> DataFrame:
    """Newest first after a cursor ``(ts, id)``."""
    if cursor is not None:
        t, i = F.lit(cursor[0]).cast(df.schema[ts].dataType), F.lit(cursor[1])
        df = df.where((F.col(ts) < t) | ((F.col(ts) == t) & (F.col(id_) < i)))
    return df.orderBy(F.desc(ts), F.desc(id_)).limit(n)


def query_fingerprint(*parts: Column) -> Column:
    """Binds a cursor to its query."""
    return F.sha2(length_prefixed(list(parts)), 256)


def nearby_page(df: DataFrame, cursor: tuple[float, object] | None, n: int) -> DataFrame:
    """Nearest first after a cursor ``(distance, id)``."""
    if cursor is not None:
        d, i = F.lit(cursor[0]), F.lit(cursor[1])
        df = df.where((F.col("distanceKm") > d) | ((F.col("distanceKm") == d) & (F.col("id") > i)))
    return df.orderBy("distanceKm", "id").limit(n)


#: Cells of centres that are broadcast at most, and the parts that a cell's jobs are dealt to beyond that.
MOST_CELLS, CELL_PARTS = 200_000, 8


def grid(radius_km: float) -> float:
    """Degrees of latitude of a cell for circles of a radius: a circle spans few cells, whatever its size."""
    return min(30.0, max(0.02, radius_km / 111.0))


def _around(cy: Column, degrees: float) -> Column:
    """Cells around the parallels of row ``cy``: fewer towards the poles, so that cells are about as wide as high."""
    low = cy * degrees - 90
    widest = F.greatest(F.lit(0.0), low, -low - degrees)
    return F.greatest(F.lit(1), F.floor(F.cos(F.radians(widest)) * 360 / degrees))


def nearby_jobs(jobs: DataFrame, centres: DataFrame, radius_km: float) -> DataFrame:
    """Open, not remote jobs within a radius of each centre ``(centreId, cLat, cLon)``.

    Both sides fall into the cells of a grid whose size follows the radius; a centre is listed in
    every cell that its circle can touch, so an equi-join replaces the comparison of all pairs.
    Rows of cells have fewer of them towards the poles, so that a circle there touches few, too.
    The centres' cells are counted and broadcast up to ``MOST_CELLS``, so jobs are compared where
    they are read, however many a city's cell holds; beyond that a cell's jobs are dealt to
    ``CELL_PARTS`` parts, its centres are listed in each, and both are shuffled: a planner can't
    see how many rows cells make of a small table, and would broadcast them.  Places without
    coordinates are near nothing.
    """
    rows = jobs.where((F.col("status") == "Open") & ~F.coalesce("remote", F.lit(False)) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    degrees = grid(radius_km)
    cell_lat = lambda c: F.floor((c + 90) / degrees)
    turn = lambda c: F.floor((c + 180) * F.col("around") / 360)
    rows = rows.withColumn("cy", cell_lat(F.col("lat"))).withColumn("around", _around(F.col("cy"), degrees))
    rows = rows.withColumn("cx", F.pmod(turn(F.col("lon")), F.col("around"))).drop("around")
    d_lat = F.lit(radius_km / 111.0)
    # a circle over a pole holds places of every longitude
    edge = F.abs("cLat") + d_lat
    d_lon = F.when(edge >= 90, 180.0).otherwise(F.least(F.lit(180.0), d_lat / F.cos(F.radians(edge))))
    low, high = turn(F.col("cLon") - d_lon), turn(F.col("cLon") + d_lon)
    steps = F.sequence(low, F.least(high, low + F.col("around") - 1))
    near = centres.where("cLat is not null and cLon is not null").withColumn("cy", F.explode(F.sequence(cell_lat(F.col("cLat") - d_lat), cell_lat(F.col("cLat") + d_lat))))
    near = near.withColumn("around", _around(F.col("cy"), degrees))
    near = near.withColumn("cx", F.explode(F.array_distinct(F.transform(steps, lambda x: F.pmod(x, F.col("around")))))).drop("around")
    if near.limit(MOST_CELLS + 1).count() <= MOST_CELLS:
        out = rows.join(F.broadcast(near), ["cy", "cx"])
    else:
        dealt = near.withColumn("cellPart", F.explode(F.sequence(F.lit(0), F.lit(CELL_PARTS - 1))))
        out = rows.withColumn("cellPart", F.pmod(F.xxhash64("id"), F.lit(CELL_PARTS)).cast("int")).join(dealt.hint("merge"), ["cy", "cx", "cellPart"]).drop("cellPart")
    out = out.withColumn("distanceKm", haversine_km(F.col("lat"), F.col("lon"), F.col("cLat"), F.col("cLon")))
    return out.where(F.col("distanceKm") <= radius_km).drop("cy", "cx")


# Facets and counts ----------------------------------------------------------------------------


def facets(jobs: DataFrame, f: JobFilter | None = None, matched_ids: DataFrame | None = None, top: int = FACET_ROWS, within: tuple[float, float, float] | None = None) -> DataFrame:
    """Top values by dimension over open jobs: rows are unpivoted once and counted once.

    ``within`` is a latitude, a longitude and kilometres: only jobs at a place in that circle count.
    """
    rows = open_jobs(jobs, f or JobFilter())
    if within is not None:
        lat, lon, km = within
        centre = jobs.sparkSession.range(1).select(F.col("id").alias("centreId"), F.lit(float(lat)).alias("cLat"), F.lit(float(lon)).alias("cLon"))
        rows = nearby_jobs(rows, centre, km).select(*rows.columns)
    if matched_ids is not None:
        rows = rows.join(matched_ids.select("id"), "id", "left_semi")
    cell = lambda dim, value, shown: F.struct(F.lit(dim).alias("dimension"), value.alias("value"), shown.alias("display"))
    text = lambda dim, c: cell(dim, canonical(c), F.trim(c))
    remote = F.coalesce("remote", F.lit(False)).cast("string")
    cells = F.concat(F.transform(canonical_set("skills"), lambda s: F.struct(F.lit("skill").alias("dimension"), s.alias("value"), s.alias("display"))), F.array(text("country", "country"), text("city", "city"), cell("remote", remote, remote)))
    long = rows.select(F.explode(cells).alias("c")).select("c.*").where("value is not null and value <> ''")
    counts = long.groupBy("dimension", "value").agg(F.count("*").alias("n"), F.min("display").alias("display"))
    ranked = counts.withColumn("position", F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "value")))
    whole = Window.partitionBy("dimension")
    return ranked.where(F.col("position") <= top + 1).withColumn("truncated", F.max("position").over(whole) > top).where(F.col("position") <= top)


def application_counts(jobs: DataFrame, applications: DataFrame, actor: tuple[str, object]) -> DataFrame:
    """Applications of each managed job by status, with zeros, and their total."""
    role, who = actor
    mine = jobs if role == "Admin" else jobs.where(F.col("recruiterId") == F.lit(who))
    if role == "Candidate":
        mine = jobs.limit(0)
    counts = applications.groupBy(F.col("jobId").alias("id")).agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s.lower()) for s in APPLICATION_STATUSES], F.count("*").alias("total"))
    return mine.select("id").join(counts, "id", "left").na.fill(0)


def visible_applications(applications: DataFrame, jobs: DataFrame, actor: tuple[str, object]) -> DataFrame:
    """A candidate's own applications, those of a recruiter's jobs, or all of them."""
    role, who = actor
    if role == "Candidate":
        return applications.where(F.col("candidateId") == F.lit(who))
    if role == "Recruiter":
        return applications.join(jobs.where(F.col("recruiterId") == F.lit(who)).select(F.col("id").alias("jobId")), "jobId", "left_semi")
    return applications


def visible_jobs(jobs: DataFrame, applications: DataFrame, actor: tuple[str, object]) -> DataFrame:
    """Jobs that are open, managed by the actor, or applied to by them."""
    role, who = actor
    if role == "Admin":
        return jobs
    if role == "Recruiter":
        return jobs.where((F.col("status") == "Open") | (F.col("recruiterId") == F.lit(who)))
    own = applications.where(F.col("candidateId") == F.lit(who)).select(F.col("jobId").alias("id")).distinct().withColumn("applied", F.lit(True))
    return jobs.join(own, "id", "left").where((F.col("status") == "Open") | F.coalesce("applied", F.lit(False))).drop("applied")


def related_jobs(keys: DataFrame, applications: DataFrame, jobs: DataFrame, actor: tuple[str, object]) -> DataFrame:
    """Jobs of requested ``(applicationId, jobId)`` keys, where the actor may read the application."""
    allowed = visible_applications(applications, jobs, actor).select(F.col("id").alias("applicationId"), "jobId")
    return keys.join(allowed, ["applicationId", "jobId"], "left_semi").join(jobs.withColumnRenamed("id", "jobId"), "jobId")


def jobs_to_close(jobs: DataFrame, users: DataFrame) -> DataFrame:
    """Open jobs of deleted recruiters, oldest deletion request first."""
    gone = users.where(F.col("accountStatus") == "Deleted").select(F.col("id").alias("recruiterId"), "deletionRequestedAt")
    return jobs.where(F.col("status") == "Open").join(gone, "recruiterId").orderBy("deletionRequestedAt", "id")


#: Status steps that an application may take (fixed values).
PERMITTED = (("Created", "Accepted"), ("Created", "Declined"), ("Created", "Rejected"), ("Accepted", "Interview"), ("Interview", "Hired"), ("Interview", "Rejected"))
#: The text that a step into a status needs (fixed values).
NEEDED_TEXT = {"Rejected": "feedback", "Declined": "reason"}


def invalid_transitions(history: DataFrame, permitted: tuple = PERMITTED) -> DataFrame:
    """History rows whose step is not permitted, doesn't follow the stored one, or lacks its text.

    A rejection needs feedback, a declined application a reason; neither text stands in for the other.
    """
    w = Window.partitionBy("applicationId").orderBy("occurredAt", "id")
    before = F.lag("newStatus").over(w)
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, b in permitted])
    step = F.concat_ws(">", "previousStatus", "newStatus")
    missing = F.lit(False)
    for status, text in NEEDED_TEXT.items():
        missing = missing | ((F.col("newStatus") == status) & (F.length(F.trim(F.coalesce(text, F.lit("")))) == 0))
    reason = (
        F.when(F.col("previousStatus").isNull() & (F.col("newStatus") == "Created"), None)
        .when(before.isNotNull() & ~before.eqNullSafe(F.col("previousStatus")), "BROKEN_CHAIN")
        .when(~F.array_contains(pairs, step), "NOT_PERMITTED")
        .when(missing, "TEXT_MISSING")
    )
    return history.withColumn("violation", reason).where("violation is not null")
