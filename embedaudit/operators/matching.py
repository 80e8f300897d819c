"""Cohort matching: tiered candidates, scores, and assignment of each candidate to one case at most.

Cases that agree in sites, sex, age and diagnosis have the same wishes and form a class. Candidates are looked up and
scored once for a class; ``members`` (case_id, class) and ``lists`` (class, candidate_id, ...) are never multiplied
out on the way to an assignment.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embedaudit.functions.text import series_age
from embedaudit.sources.scratch import released, written

YEARS, MISSING_AGE = 20, 25.0
#: Candidates that are fetched for a case at most, and wanted for it first.
FETCH, WANTED = 200, 50
#: Classes that one task settles, about.
CLASSES = 2000
#: Candidates that one task ranks, about.
DEALT = 20_000
# What is excluded after the fetch; missing values stay.
EXCLUDED = ("black or african american", "african american")
#: Days are looked up by nodes of 8 ** level days.
_STEP, _LEVELS = 8, 6
_ANY = "*"
_NODES = "array<struct<level:int,node:bigint>>"


def fetch_cap(size: int) -> int:
    """Candidates that are fetched first for a wanted number: twice as many, 200 at most."""
    return min(2 * size, FETCH)


def day_interval(age: Column, window: int) -> tuple[Column, Column]:
    """First and last day of an age in years, give or take ``window`` years of 365 days, not below 0."""
    return F.greatest((age - window) * 365, F.lit(0)).cast("long"), ((age + window) * 365).cast("long")


def _node(level: int, node: Column) -> Column:
    return F.named_struct(F.lit("level"), F.lit(level), F.lit("node"), node)


def _nodes(level: int):
    return lambda node: _node(level, node)


def nodes_of_day(day: Column) -> Column:
    """The node of each level that a day falls into."""
    return F.array(*[_node(k, F.floor(day / _STEP**k).cast("long")) for k in range(_LEVELS)])


def nodes_of_interval(low: Column, high: Column) -> Column:
    """The fewest nodes that make up the days from low to high: on each level those within it whose parent is not, a
    few at either end."""
    run = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<long>"))
    out = []
    for k in range(_LEVELS):
        first, last = F.ceil(low / _STEP**k).cast("long"), (F.floor((high + 1) / _STEP**k) - 1).cast("long")
        whole = run(first, last)
        if k + 1 < _LEVELS:
            up_first, up_last = F.ceil(low / _STEP ** (k + 1)).cast("long"), (F.floor((high + 1) / _STEP ** (k + 1)) - 1).cast("long")
            ends = F.concat(run(first, up_first * _STEP - 1), run((up_last + 1) * _STEP, last))
            whole = F.when(up_first <= up_last, ends).otherwise(whole)
        out.append(F.transform(whole, _nodes(k)))
    return F.concat(*out)


def wish_lists(cases: DataFrame, candidates: DataFrame, window: int = YEARS, size: int = WANTED, excluded: tuple[str, ...] = EXCLUDED) -> tuple[DataFrame, DataFrame]:
    """``members`` (case_id, class) and ``lists`` (class, candidate_id, tier, retry, age_delta, score).

    Tiers: 1 a site of the case's list, its sex, and an age in days within the window; 2 site and sex; 3 site. A
    missing sex or age of a case drops that clause; a candidate with a missing value does not meet it; a case without
    sites has no tier. Of a tier the first :func:`fetch_cap` candidates in id order are fetched, then those of an
    ``excluded`` race are left out, and the first tier that has any left is the case's list. ``retry`` marks those
    that come with FETCH candidates in place of that, looked at only when all before them are used; their tier is
    the first that has any left of FETCH, which may be an earlier one.

    Candidates are ranked once under each of their keys (site, sex or any, a node of days or any age) and FETCH of a
    key stay; a class looks up the few nodes that make up its interval of days. No case meets all of a site.
    """
    named = cases.select(
        "case_id", F.array_distinct("sites").alias("sites"), F.col("sex").alias("case_sex"), F.col("age").cast("double").alias("case_age"), F.col("diagnosis").alias("case_diagnosis")
    )
    shown = [F.array_join("sites", ";"), *(F.coalesce(F.col(c).cast("string"), F.lit(_ANY)) for c in ("case_sex", "case_age", "case_diagnosis"))]
    named = named.filter("size(sites) > 0").withColumn("class", F.concat_ws("|", *shown))
    low, high = day_interval(F.col("case_age"), window)
    classes = written(named.drop("case_id").distinct().withColumn("low", low).withColumn("high", high), "case-classes")
    any_age = F.array(_node(-1, F.lit(0).cast("long"))).cast(_NODES)
    days = F.when(F.col("age_days").isNotNull(), nodes_of_day(F.col("age_days")).cast(_NODES)).otherwise(F.array().cast(_NODES))
    # a file of candidates is one task's, and each becomes some 14 keyed rows that are put in order: dealt by number first
    dealt = candidates.repartition(max(1, -(-candidates.count() // DEALT)), "candidate_id")
    keyed = dealt.select("candidate_id", "site", "sex", "age_days", "race", F.col("diagnosis"), F.explode(F.array(F.col("sex"), F.lit(_ANY))).alias("k_sex"), F.concat(days, any_age).alias("n"))
    keyed = keyed.filter("k_sex IS NOT NULL").select("*", F.inline("n")).drop("n")
    ranked = keyed.withColumn("__n", F.row_number().over(Window.partitionBy("site", "k_sex", "level", "node").orderBy("candidate_id"))).filter(F.col("__n") <= FETCH).drop("__n")
    sex = F.coalesce("case_sex", F.lit(_ANY))
    ages = F.when(F.col("case_age").isNull(), any_age).otherwise(nodes_of_interval(F.col("low"), F.col("high")).cast(_NODES))
    tiers = F.array(*[F.named_struct(F.lit("tier"), F.lit(t), F.lit("k_sex"), s, F.lit("n"), a).cast(f"struct<tier:int,k_sex:string,n:{_NODES}>") for t, s, a in ((1, sex, ages), (2, sex, any_age), (3, F.lit(_ANY), any_age))])
    looked = classes.select("class", "case_age", "case_diagnosis", F.explode("sites").alias("site"), tiers.alias("t")).select("class", "case_age", "case_diagnosis", "site", F.inline("t")).select("*", F.inline("n")).drop("n")
    met = looked.join(ranked, ["site", "k_sex", "level", "node"])
    fetched = met.withColumn("place", F.row_number().over(Window.partitionBy("class", "tier").orderBy("candidate_id"))).filter(F.col("place") <= FETCH)
    left = fetched.filter(~F.coalesce(F.lower(F.trim("race")), F.lit("")).isin(*excluded))
    of = Window.partitionBy("class")
    early = F.col("place") <= fetch_cap(size)
    left = left.withColumn("first_tier", F.min(F.when(early, F.col("tier"))).over(of)).withColumn("late_tier", F.min("tier").over(of))
    first = (F.col("tier") == F.col("first_tier")) & early
    listed = left.filter("first_tier IS NOT NULL").filter(first | (F.col("tier") == F.col("late_tier")))
    # in both lists: the first one counts
    best = listed.groupBy("class", "candidate_id").agg(F.min(F.struct((~first).alias("retry"), "tier", "case_age", "case_diagnosis", (F.col("age_days") / 365.0).alias("age"), "diagnosis")).alias("x"))
    return named.select("case_id", "class"), scored(best.select("class", "candidate_id", "x.*")).select("class", "candidate_id", "tier", "retry", "age_delta", "score")


def case_pairs(members: DataFrame, lists: DataFrame) -> DataFrame:
    """Each case with each candidate of its list."""
    return members.join(lists, "class").drop("class")


def scored(pairs: DataFrame) -> DataFrame:
    """``age_delta`` (25 where an age is missing or 0) and ``score``: 10 for another diagnosis, plus the age delta."""
    gap = F.coalesce(F.abs(F.nullif("case_age", F.lit(0)) - F.nullif("age", F.lit(0))).cast("double"), F.lit(MISSING_AGE))
    other = F.when(F.col("case_diagnosis").eqNullSafe(F.col("diagnosis")), 0.0).otherwise(10.0)
    return pairs.withColumn("age_delta", gap).withColumn("score", other + gap)


def best_listed(members: DataFrame, lists: DataFrame) -> DataFrame:
    """:func:`best_per_case` of all pairs, found once for each class: cases never meet their whole lists."""
    best = lists.groupBy("class").agg(F.min(F.struct("score", "candidate_id")).alias("b"))
    return members.join(best, "class").select("case_id", "b.candidate_id", "b.score")


def best_per_case(pairs: DataFrame) -> DataFrame:
    """The least score of each case; ties go to the first candidate."""
    by = Window.partitionBy("case_id").orderBy("score", "candidate_id")
    return pairs.withColumn("rank", F.row_number().over(by)).filter("rank = 1").drop("rank")


def settled(wishes: dict, members: dict, holder: dict) -> dict:
    """The candidates that change hands when a group's free cases choose in order: candidate to case.

    ``wishes`` and ``members`` are the classes' candidates and cases in order; ``holder`` says who holds a candidate, a
    case of the group or of another. A case takes its first candidate that no earlier case holds; a case of the group
    that loses it that way chooses again. Cases are met in ascending order, so what a case has passed by, later cases
    of its class pass by too.
    """
    of = {case: name for name, cases in members.items() for case in cases}
    holding = {case for case in holder.values() if case in of}
    queue = [case for case in of if case not in holding]
    heapq.heapify(queue)
    at, taken = dict.fromkeys(members, 0), {}
    while queue:
        case = heapq.heappop(queue)
        name = of[case]
        wanted, i = wishes.get(name, []), at[name]
        while i < len(wanted) and wanted[i] in holder and holder[wanted[i]] < case:
            i += 1
        at[name] = i + 1
        if i < len(wanted):
            loser = holder.get(wanted[i])
            holder[wanted[i]] = taken[wanted[i]] = case
            if loser in of:
                heapq.heappush(queue, loser)
    return taken


def assigned_in_rounds(members: DataFrame, lists: DataFrame, classes: int = CLASSES) -> tuple[DataFrame, int]:
    """``case_id, candidate_id`` and the number of rounds: each candidate to at most one case, cases in order choosing
    their best that is left (by ``retry``, where lists have it, score and candidate).

    Deferred acceptance in blocks: classes lie in groups of some ``classes`` neighbours by name, and a task settles all
    that its group's cases want among themselves before anything is exchanged. A candidate then stays with the
    least case that holds it, and only groups that lost one go on, so rounds follow the chains that lead from group
    to group, not those from case to case. Of a class only as many cases as its list is long can get a candidate.
    With one common order of cases the outcome is that of cases choosing one after the other.
    """
    order = [*(["retry"] if "retry" in lists.columns else []), "score", "candidate_id"]
    kinds = {c: lists.schema[c].dataType.simpleString() for c in ("class", "candidate_id")} | {"case_id": members.schema["case_id"].dataType.simpleString()}
    wishes = lists.groupBy("class").agg(F.sort_array(F.collect_list(F.struct(*order))).alias("w")).select("class", F.col("w.candidate_id").alias("w"))
    wishes = written(wishes, "wishes")
    groups = max(1, -(-wishes.count() // classes))
    dealt = wishes.select("class", F.size("w").alias("long")).repartitionByRange(groups, "class").withColumn("group", F.spark_partition_id())
    dealt = written(dealt, "groups")
    lists_of = written(wishes.join(dealt, "class").select("group", "class", F.posexplode("w").alias("wish", "candidate_id")), "lists")
    place = F.row_number().over(Window.partitionBy("class").orderBy("case_id"))
    cases = written(members.select("class", "case_id").join(dealt, "class").withColumn("k", place).filter("k <= long").select("group", "class", "case_id"), "cases")
    released(wishes)
    schema = f"candidate_id {kinds['candidate_id']}, case_id {kinds['case_id']}, group int"
    held, active, rounds = lists.sparkSession.createDataFrame([], schema), dealt.select("group").distinct(), 0

    def settle(lists: pd.DataFrame, cases: pd.DataFrame) -> pd.DataFrame:
        wanted = {name: x.tolist() for name, x in lists.sort_values("wish").groupby("class")["candidate_id"]}
        mine = {name: x.tolist() for name, x in cases.groupby("class")["case_id"]}
        known = lists.dropna(subset=["holder"]).drop_duplicates("candidate_id")
        kind = cases["case_id"].dtype if len(cases) else object
        taken = settled(wanted, mine, dict(zip(known["candidate_id"].tolist(), known["holder"].astype(kind).tolist(), strict=True)))
        group = int(cases["group"].iloc[0]) if len(cases) else -1
        return pd.DataFrame([(k, v, group) for k, v in taken.items()], columns=["candidate_id", "case_id", "group"])

    while True:
        rounds += 1
        mine = lists_of.join(active, "group", "left_semi").join(held.select("candidate_id", F.col("case_id").alias("holder")), "candidate_id", "left")
        met = mine.groupBy("group").cogroup(cases.join(active, "group", "left_semi").groupBy("group"))
        both = written(held.unionByName(met.applyInPandas(settle, schema)), "claims")
        least = F.min(F.struct("case_id", "group")).alias("x")
        after = written(both.groupBy("candidate_id").agg(least).select("candidate_id", "x.*"), "held")
        again = None
        if groups > 1:
            lost = both.select("case_id", "group").join(after.select("case_id"), "case_id", "left_anti")
            again = written(lost.select("group").distinct(), "active")
        released(*(x for x in (held, active) if hasattr(x, "_written")), both)
        held, active = after, again
        if active is None or active.isEmpty():
            released(lists_of, cases, dealt, *([active] if active else []))
            return held.select("case_id", "candidate_id"), rounds


def assign(members: DataFrame, lists: DataFrame) -> DataFrame:
    return assigned_in_rounds(members, lists)[0]


def classes_of(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``members`` and ``lists`` of pairs of cases and candidates: cases with equal lists of wishes are a class, named so
    that classes which want the same candidates are neighbours."""
    order = [*(["retry"] if "retry" in pairs.columns else []), "score", "candidate_id"]
    wishes = pairs.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct(*order))).alias("w"))
    text = F.md5(F.array_join(F.transform("w", lambda x: F.concat_ws(":", *(x[c].cast("string") for c in order))), ",").cast("binary"))
    least = F.lpad(F.array_min(F.col("w.candidate_id")).cast("string"), 20, "0")
    wishes = written(wishes.withColumn("class", F.concat_ws("|", least, text)), "classes")
    return wishes.select("case_id", "class"), wishes.groupBy("class").agg(F.any_value("w").alias("w")).select("class", F.inline("w"))


def assign_unique(pairs: DataFrame) -> DataFrame:
    """:func:`assign` of pairs of cases and candidates with their ``score`` (and ``retry``)."""
    return assign(*classes_of(pairs))


def match_manifest(cases: DataFrame, members: DataFrame, lists: DataFrame, assigned: DataFrame) -> DataFrame:
    """A row for every case: its candidate with tier and age delta, or NO_MATCH, tier NONE and nulls."""
    chosen = assigned.join(members, "case_id").join(lists, ["class", "candidate_id"])
    chosen = chosen.select("case_id", "candidate_id", F.concat(F.lit("T"), F.col("tier").cast("string")).alias("t"), "age_delta", "score")
    joined = cases.join(chosen, "case_id", "left").withColumn("tier", F.coalesce("t", F.lit("NONE"))).drop("t")
    return joined.withColumn("status", F.when(F.col("candidate_id").isNotNull(), "MATCHED").otherwise("NO_MATCH"))


def match_series(cases: DataFrame, series: DataFrame) -> DataFrame:
    """The best series of each case: sexes must agree where the series has one; the score is that of candidates.

    Only the first series of each sex, age and diagnosis can be a best one, and cases that agree in these have one best
    series, so distinct values meet, not rows.
    """
    code = F.when(F.upper(F.col("sex")).startswith("M"), "male").when(F.upper(F.col("sex")).startswith("F"), "female")
    s = series.select("series_id", F.coalesce(code, F.lit("any")).alias("meets"), series_age(F.col("age")).alias("age"), "diagnosis").groupBy("meets", "age", "diagnosis").agg(F.min("series_id").alias("series_id"))
    c = cases.select("case_id", "sex", F.col("age").cast("double").alias("case_age"), F.col("diagnosis").alias("case_diagnosis"))
    classes = c.select("sex", "case_age", "case_diagnosis").distinct().withColumn("meets", F.explode(F.array(F.lit("any"), F.coalesce("sex", F.lit("unknown")))))
    best = scored(classes.join(s, "meets")).groupBy("sex", "case_age", "case_diagnosis").agg(F.min(F.struct("score", "series_id")).alias("b"))
    best = best.select(F.col("sex").alias("b_sex"), F.col("case_age").alias("b_age"), F.col("case_diagnosis").alias("b_diagnosis"), "b")
    same = F.col("sex").eqNullSafe(F.col("b_sex")) & F.col("case_age").eqNullSafe(F.col("b_age")) & F.col("case_diagnosis").eqNullSafe(F.col("b_diagnosis"))
    return c.join(best, same).select("case_id", "b.series_id", "b.score")
