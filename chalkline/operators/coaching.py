"""C: coaching scores. An analysis is one JSON document per session, so C1 to C3 are row-local."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.maths import half_up
from chalkline.functions.rows import explode_into, inline_into, once, posexplode_into
from chalkline.operators.ordered import running_total

# Rubric areas as (key, display name, number of indicators) per framework.
AREAS = {
    "hots": [
        ("classroom_environment", "Classroom Environment", 3),
        ("lesson_planning", "Lesson Planning", 3),
        ("instructional_strategies", "Instructional Strategies", 4),
        ("student_engagement", "Student Engagement", 3),
        ("assessment_feedback", "Assessment & Feedback", 3),
    ],
    "fico": [
        ("lesson_structure", "Lesson Structure", 4),
        ("instructional_quality", "Instructional Quality", 5),
        ("classroom_climate", "Classroom Climate", 4),
        ("student_engagement", "Student Engagement", 4),
        ("assessment_feedback", "Assessment & Feedback", 4),
    ],
    "teach": [
        ("classroom_culture", "Classroom Culture", 2),
        ("instruction", "Instruction", 4),
        ("socioemotional", "Socioemotional Skills", 3),
    ],
    "mewaka": [
        ("introduction", "Introduction", 2),
        ("content_delivery", "Content Delivery", 8),
        ("teaching_methods", "Teaching Methods / Techniques", 7),
        ("learner_involvement", "Learner's involvement & communication", 3),
        ("classroom_management", "Classroom Management", 3),
        ("conclusion", "Conclusion", 2),
    ],
}
# Highest score of one indicator and of a whole session.
SCALE = {"hots": 3, "fico": 4, "teach": 5, "mewaka": 3}
TOTAL = {"hots": 48, "fico": 84, "teach": 50, "mewaka": 75}

# Goals of the competency rubric as (criterion, marks, levels).
GOALS = {
    "goal1_formative_assessment": [
        ("incorporation_of_feedback", 5, 3),
        ("smart_objectives", 4, 3),
        ("teachers_role", 4, 3),
        ("assessment", 9, 3),
    ],
    "goal2_student_engagement": [
        ("cognitive_rigor", 9, 3),
        ("real_world_connections", 4, 2),
        ("multimodality", 5, 2),
        ("misconceptions", 4, 3),
    ],
    "goal3_quality_content": [
        ("prior_knowledge", 4, 2),
        ("prior_knowledge_activation", 4, 3),
        ("content_coverage_accuracy", 11, 3),
        ("content_organization", 7, 3),
        ("verbal_questioning", 4, 3),
        ("coherence_transitions", 4, 3),
    ],
    "goal4_classroom_interaction": [("peer_group_interactions", 5, 3)],
    "goal5_classroom_management": [
        ("classroom_management", 9, 3),
        ("visibility_materials", 3, 2),
        ("classroom_culture", 9, 3),
        ("teaching_learning_materials", 3, 2),
    ],
}
GOAL_NAMES = {
    "goal1_formative_assessment": ("G1", "Formative Assessment & Feedback"),
    "goal2_student_engagement": ("G2", "Student Engagement"),
    "goal3_quality_content": ("G3", "Quality Subject Content"),
    "goal4_classroom_interaction": ("G4", "Classroom Interaction"),
    "goal5_classroom_management": ("G5", "Classroom Management"),
}
MARKS_BASE = 103
MARKS_WITH_PLAN = 117

_ITEM = "struct<id:string,name:string,score:double,holistic_score:double>"
_AREA = (
    f"struct<indicators:array<{_ITEM}>,elements:array<{_ITEM}>,area_score:double,area_max:double,"
    "domain_score:double,domain_max:double>"
)
_GOAL = "map<string,struct<competency_score:double,computed_marks:double,max_marks:double>>"


def _areas(json: Column, path: str) -> Column:
    return F.from_json(F.get_json_object(json, path), f"map<string,{_AREA}>")


def _sum(items: Column, value: Callable[[Column], Column]) -> Column:
    zero = F.lit(0.0)
    return F.coalesce(F.aggregate(items, zero, lambda acc, i: acc + F.coalesce(value(i), zero)), zero)


def _rubric(codes: bool) -> Column:
    """Literal map from framework to its areas as ``array<struct<area, key, name, max>>``."""
    pairs = []
    for name, areas in AREAS.items():
        rows = []
        for i, (area, label, n) in enumerate(areas):
            code = {"hots": f"A{i + 1}", "fico": f"D{i + 1}", "teach": f"T{i + 2}", "mewaka": "ABCDEF"[i]}[name]
            rows.append(
                F.struct(
                    F.lit(area).alias("area"),
                    F.lit(code if codes else area).alias("key"),
                    F.lit(label).alias("name"),
                    F.lit(float(n * SCALE[name])).alias("max"),
                )
            )
        pairs += [F.lit(name), F.array(*rows)]
    return F.create_map(*pairs)


_DOCUMENT = (
    f"struct<areas:map<string,{_AREA}>,domains:map<string,{_AREA}>,time_on_task:struct<score:double>,"
    + ",".join(f"{goal}:{_GOAL}" for goal in GOALS)
    + ",scores:map<string,double>>"
)


def _prepared(sessions: DataFrame) -> DataFrame:
    """Lower-cased framework and the document, parsed once per row."""
    name = F.lower(F.coalesce("framework", F.lit("")))
    parsed = sessions.withColumns({"_f": name, "_d": F.from_json("analysis_data", _DOCUMENT)})
    return parsed.withColumns(
        {
            "_areas": F.col("_d.areas"),
            "_domains": F.col("_d.domains"),
            "_task": F.coalesce(F.col("_d.time_on_task.score"), F.lit(0.0)),
        }
    )


def _goal_max(goal: str) -> float:
    return float(sum(marks for _, marks, _ in GOALS[goal]))


def framework_scores(sessions: DataFrame) -> DataFrame:
    """``sessions(session_id, framework, analysis_data, has_lesson_plan)`` to one row per area
    with its score and maximum and the session's overall marks, maximum and percentage. An unknown
    framework gives no rows; an area absent from the analysis gives none either."""
    f = F.col("_f")
    box = (
        F.when(f == "fico", F.col("_domains"))
        .when(f == "mewaka", F.coalesce("_domains", "_areas"))
        .otherwise(F.col("_areas"))
    )
    prepared = _prepared(sessions).withColumn("_box", box)

    def value(item: Column) -> Column:
        score = item["score"]
        clamped = F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(3.0), score)))
        return F.when(f == "teach", item["holistic_score"]).when(f == "mewaka", clamped).otherwise(score)

    def area_row(r: Column) -> Column:
        area = F.col("_box")[r["area"]]
        items = F.when(f == "teach", area["elements"]).otherwise(area["indicators"])
        return F.struct(
            r["key"].alias("key"), r["name"].alias("name"), _sum(items, value).alias("score"), r["max"].alias("max")
        )

    listed = F.transform(F.filter(_rubric(False)[f], lambda r: F.map_contains_key("_box", r["area"])), area_row)
    goals = []
    for goal, criteria in GOALS.items():
        cells = F.col(f"_d.{goal}")
        table = F.array(
            *[F.struct(F.lit(c).alias("c"), F.lit(float(most)).alias("most"), F.lit(levels).alias("levels")) for c, most, levels in criteria]
        )
        marks = F.when(
            cells.isNotNull(), _sum(table, lambda r, cells=cells: cells[r["c"]]["competency_score"] / r["levels"] * r["most"])
        ).otherwise(0.0)
        goals.append(
            F.struct(
                F.lit(goal).alias("key"),
                F.lit(GOAL_NAMES[goal][1]).alias("name"),
                F.round(marks, 2).alias("score"),
                F.lit(_goal_max(goal)).alias("max"),
            )
        )
    with_plan = F.coalesce("has_lesson_plan", F.lit(False))
    limit = F.when(with_plan, float(MARKS_WITH_PLAN)).otherwise(float(MARKS_BASE))
    for name, total in TOTAL.items():
        limit = F.when(f == name, F.lit(float(total))).otherwise(limit)
    scored = prepared.filter(f.isin(*AREAS, "oecd")).withColumns(
        {"_rows": F.when(f == "oecd", F.array(*goals)).otherwise(listed), "overall_max": limit}
    )
    extra = F.when(f == "teach", F.col("_task")).otherwise(0.0)
    return (
        scored.withColumn("overall_marks", F.round(_sum(F.col("_rows"), lambda r: r["score"]) + extra, 2))
        .withColumn("overall_percentage", F.round(F.col("overall_marks") / F.col("overall_max") * 100, 1))
        .transform(
            inline_into,
            ["session_id", f.alias("framework"), "overall_marks", "overall_max", "overall_percentage"],
            F.col("_rows"),
            "key",
        )
    )


def score_groups(sessions: DataFrame) -> DataFrame:
    """Uniform (key, name, score, max, pct) rows from the stored scores of each framework."""
    f = F.col("_f")
    by_domain = f.isin("fico", "mewaka")
    box = F.when(by_domain, F.coalesce("_domains", "_areas")).otherwise(F.col("_areas"))
    empty = F.create_map().cast(f"map<string,{_AREA}>")
    prepared = _prepared(sessions).withColumn("_box", F.coalesce(box, empty))

    def area_row(r: Column) -> Column:
        area = F.col("_box")[r["area"]]
        score = F.coalesce(F.when(by_domain, area["domain_score"]), area["area_score"], F.lit(0.0))
        most = F.coalesce(F.when(by_domain, area["domain_max"]), area["area_max"], r["max"])
        return F.struct(r["key"].alias("key"), r["name"].alias("name"), score.alias("score"), most.alias("max"))

    def row(key: str, name: str, score: Column, most: float) -> Column:
        return F.struct(F.lit(key).alias("key"), F.lit(name).alias("name"), score.alias("score"), F.lit(most).alias("max"))

    listed = F.transform(_rubric(True)[f], area_row)
    task = F.array(row("T1", "Time on Task", F.col("_task"), 5.0))
    goals = F.array(
        *[
            row(
                code,
                label,
                F.coalesce(F.col("_d.scores")[f"{goal.split('_')[0]}_total"], F.lit(0.0)),
                _goal_max(goal),
            )
            for goal, (code, label) in GOAL_NAMES.items()
        ]
    )
    rows = F.when(f == "oecd", goals).when(f == "teach", F.concat(task, listed)).otherwise(listed)
    known = prepared.filter(f.isin(*AREAS, "oecd"))
    long = inline_into(known, ["session_id", f.alias("framework")], rows, "key")
    return long.withColumn(
        "pct", F.when(F.col("max") > 0, half_up(F.col("score") / F.col("max") * 100)).otherwise(0).cast("int")
    )


# C3 -----------------------------------------------------------------------------------


def indicators(json: Column) -> Column:
    """Indicators of the four stored layouts in order, as an array of
    ``struct<name, score, max_score, area, id>``."""
    shape = "array<struct<name:string,score:double,max_score:double,area:string,id:string>>"

    def of(box: Column, field: str, score: str, most: float, prefix: str = "") -> Column:
        listed = F.transform(
            F.map_entries(box),
            lambda e: F.transform(
                F.coalesce(e["value"][field], F.array().cast(f"array<{_ITEM}>")),
                lambda i: F.struct(
                    i["name"].alias("name"),
                    i[score].alias("score"),
                    F.lit(most).alias("max_score"),
                    e["key"].alias("area"),
                    F.concat(F.lit(prefix), i["id"]).alias("id"),
                ),
            ),
        )
        return F.coalesce(F.flatten(listed), F.array().cast(shape))

    def listed(j: Column) -> Column:
        return F.concat(
            once(
                _areas(j, "$.areas"),
                lambda areas: F.concat(of(areas, "indicators", "score", 3.0), of(areas, "elements", "holistic_score", 5.0, "E")),
            ),
            of(_areas(j, "$.domains"), "indicators", "score", 4.0),
            F.coalesce(F.flatten(goals(F.map_entries(F.from_json(j, "map<string,string>")))), F.array().cast(shape)),
        )

    goals = lambda tops: F.transform(
        F.filter(tops, lambda e: e["key"].startswith("goal") & e["value"].startswith("{")),
        lambda e: F.transform(
            F.filter(F.map_entries(F.from_json(e["value"], _GOAL)), lambda c: c["value"]["computed_marks"].isNotNull()),
            lambda c: F.struct(
                F.replace(c["key"], F.lit("_"), F.lit(" ")).alias("name"),
                c["value"]["computed_marks"].alias("score"),
                c["value"]["max_marks"].alias("max_score"),
                e["key"].alias("area"),
                c["key"].alias("id"),
            ),
        ),
    )
    return once(json, listed)


def weakest(items: Column) -> Column:
    """Lowest score by maximum; the first one wins a tie, and keeps the lead when it has no score."""
    ranked = F.transform(
        items, lambda x, i: F.struct((x["score"] / x["max_score"]).alias("ratio"), i.alias("at"), x.alias("item"))
    )

    def lowest(ranked: Column) -> Column:
        scored = F.filter(ranked, lambda r: r["ratio"].isNotNull())
        return once(F.get(ranked, F.lit(0)), lambda first: F.when(first["ratio"].isNull(), first["item"]).otherwise(F.array_min(scored)["item"]))

    return once(ranked, lowest)


# Selection policies by name; an unknown name falls back to the default.
POLICIES: dict[str, Callable[[Column], Column]] = {"weakest": weakest}
DEFAULT_POLICY = "weakest"


def focus_indicator(sessions: DataFrame, policy: str | Callable[[Column], Column] = DEFAULT_POLICY) -> DataFrame:
    """The indicator a coaching card targets. ``policy`` is a name or a column builder over the
    indicator array."""
    focus = _pick(policy)
    return _of_listed(sessions, lambda items: F.struct(focus(items).alias("focus"))).select(
        "session_id", *[F.col("_of.focus")[c].alias(c) for c in ("name", "score", "max_score", "area", "id")]
    )


def _of_listed(sessions: DataFrame, use: Callable[[Column], Column]) -> DataFrame:
    """(session_id, _of): ``use`` of the indicators of each session that has some. The document is built and parsed once:
    it is an array of one that is exploded, so neither the filter nor the fields taken from it repeat it."""
    some = once(indicators(F.col("analysis_data")), lambda items: F.when(F.size(items) > 0, F.array(use(items))))
    return explode_into(sessions, ["session_id"], some, "_of")


def _pick(policy: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    return policy if callable(policy) else POLICIES.get(policy, POLICIES[DEFAULT_POLICY])


def focus_names(sessions: DataFrame, policies: dict[str, str | Callable[[Column], Column]]) -> DataFrame:
    """The name of the indicator each policy picks, a column per policy, in one pass over ``sessions``."""
    listed = _of_listed(sessions, lambda items: F.struct(*[_pick(p)(items)["name"].alias(c) for c, p in policies.items()]))
    return listed.select("session_id", *[F.col("_of")[c].alias(c) for c in policies])


# C4 -------------------------------------------------------------------------------------

# Counters of a transcript chunk.
COUNTERS = [
    "praise_count", "named_praise_count", "encouragement_count", "negative_language_count",
    "student_perspective_questions", "press_for_reasoning", "higher_order_questions", "connection_statements",
    "specific_feedback_count", "scaffolding_instances", "transition_cues", "redirection_count",
    "teacher_revoicing", "teacher_press_for_reasoning", "uptake_instances",
]


def merge_chunk_metrics(chunks: DataFrame, counters: Sequence[str] = tuple(COUNTERS)) -> DataFrame:
    """C4: ``chunks(session_id, chunk_no, summary, counters...)`` to one row per session: counts
    added up, summary from the first chunk."""
    return chunks.groupBy("session_id").agg(
        F.count("*").alias("chunks"),
        F.coalesce(F.min_by("summary", "chunk_no"), F.lit("Lesson summary unavailable")).alias("summary"),
        *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in counters],
    )


def merge_chunk_lists(chunks: DataFrame, column: str, size: int = 10_000) -> DataFrame:
    """C4: sections or objectives of all chunks of a session as numbered rows in chunk order. The
    place is the number of items in earlier chunks plus the place in the chunk, so a session's
    items are never gathered in one list."""
    sized = chunks.select("session_id", "chunk_no", column).withColumn(
        "_n", F.coalesce(F.size(column), F.lit(0))
    )
    placed = running_total(
        sized, ["session_id"], ["chunk_no"], F.greatest(F.col("_n"), F.lit(0)), "_end", F.floor(F.col("chunk_no") / size)
    )
    before = (F.col("_end") - F.col("_n")).alias("_before")
    return posexplode_into(placed, ["session_id", "chunk_no", before], F.col(column), "_i", "item").select("session_id", "chunk_no", (F.col("_before") + F.col("_i") + 1).alias("place"), "item")
