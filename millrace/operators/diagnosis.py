"""Symptom-to-code diagnosis: intent, evidence tiers, ordered steps, coverage against a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import code_form


def intents(questions: DataFrame, codes: DataFrame, text: str) -> DataFrame:
    """Route of each question: a known code anywhere, else an unknown code, else repair or symptom by its words.

    codes has `code`; questions keep their columns, with `intent` and `code`.
    """
    found = F.regexp_extract_all(code_form(F.col(text)), F.lit("\\b([A-Z][0-9][0-9A-F]{3}(?:-[0-9A-F]{2})?)\\b"), 1)
    asked = questions.withColumn("_codes", found)
    known = asked.select("question_id", F.explode("_codes").alias("code")).join(codes.select("code").distinct(), "code").groupBy("question_id").agg(F.min("code").alias("code"))
    repair = F.lower(text).rlike("\\b(replace|remove|install|torque)\\b") & ~F.lower(text).rlike("\\b(noise|leak|fails?|warning)\\b")
    route = F.when(F.col("code").isNotNull(), "code").when(F.size("_codes") > 0, "unknown_code").when(repair, "repair").otherwise("symptom")
    return asked.join(known, "question_id", "left").withColumn("intent", route).drop("_codes")


def code_candidates(evidence: DataFrame, k: int) -> DataFrame:
    """Best codes of each question from table, direct and inherited evidence: score 100 table + 30 direct + inherited.

    evidence has question_id, code, source (table, direct, inherited), strength; the tier is that of the best source.
    """
    part = lambda s: F.coalesce(F.max(F.when(F.col("source") == s, F.col("strength"))), F.lit(0.0))
    g = evidence.groupBy("question_id", "code").agg(part("table").alias("t"), part("direct").alias("d"), part("inherited").alias("i"))
    scored = g.withColumn("tier", F.when(F.col("t") > 0, 0).when(F.col("d") > 0, 1).otherwise(2)).withColumn("score", F.round(100 * F.col("t") + 30 * F.col("d") + F.col("i"), 6))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy("tier", F.desc("score"), "code"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("question_id", "code", "tier", "score", "rank")


def tier_confidence(tier: Column, sim: Column) -> Column:
    return F.when(tier == 0, 0.9).when(tier == 1, sim).otherwise(0.35)


def ordered_steps(steps: DataFrame, aspect_rank: dict[str, int]) -> DataFrame:
    """Steps of a code in the maker's order of aspects, then document order, numbered from 0."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for p in aspect_rank.items() for x in p])[F.col("aspect")], F.lit(99))
    return steps.withColumn("step_order", F.row_number().over(Window.partitionBy("code").orderBy(rank, "position")) - 1)


def coverage_changes(before: DataFrame, now: DataFrame, key: str, metrics: list[str], drop: float = 0.10) -> DataFrame:
    """Keys that are missing, emptied or have fallen by more than the share in some metric."""
    b, a = before.select(key, *[F.col(m).alias(f"b_{m}") for m in metrics]), now.select(key, *[F.col(m).alias(f"a_{m}") for m in metrics])
    missing = F.col(f"a_{metrics[0]}").isNull()
    emptied = F.lit(False)
    fell = F.lit(False)
    for m in metrics:
        emptied = emptied | ((F.col(f"b_{m}") > 0) & (F.col(f"a_{m}") == 0))
        fell = fell | (F.col(f"a_{m}") < F.col(f"b_{m}") * (1 - drop))
    return b.join(a, key, "left").withColumn("state", F.when(missing, "missing").when(emptied, "emptied").when(fell, "fell")).filter("state is not null").select(key, "state")


def code_titles(pages: DataFrame) -> DataFrame:
    """Pages whose title begins with trouble codes (`P0012/P1003: name`), one row per code: code, name and its place nth."""
    head, name = F.substring_index("title", ": ", 1), F.get(F.split("title", ": "), F.lit(1))
    coded = pages.filter(F.col("title").rlike("^P[0-9]{4}"))
    return coded.select("*", name.alias("name"), F.posexplode(F.split(head, "/")).alias("nth", "code"))


def extracted_codes(pages: DataFrame) -> DataFrame:
    """Codes of pages (id, parent_id, title, ord) whose parent's title has none; of a code's pages the one of most children.

    Returns code, node, name, children. Equal numbers of children: document order, then id.
    """
    children = pages.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children"))
    parents = pages.select(F.col("id").alias("parent_id"), F.col("title").rlike("^P[0-9]{4}").alias("_coded"))
    tops = code_titles(pages).join(parents, "parent_id", "left").filter("not coalesce(_coded, false)").join(children, "id", "left").withColumn("children", F.coalesce("children", F.lit(0).cast("long")))
    best = tops.groupBy("code").agg(F.min_by(F.struct("id", "name", "children"), F.struct(-F.col("children"), "ord", "id")).alias("b"))
    return best.select("code", F.col("b.id").alias("node"), F.col("b.name").alias("name"), F.col("b.children").alias("children"))


def distinct_symptoms(rows: DataFrame) -> DataFrame:
    """Symptoms (symptom, subsystem, suspected) once each in trimmed lower case, with their number of pages; blank ones go."""
    plain = rows.select(F.lower(F.trim("symptom")).alias("symptom"), "subsystem", F.lower(F.trim("suspected")).alias("suspected"))
    return plain.filter("symptom <> ''").groupBy("symptom", "subsystem", "suspected").agg(F.count("*").alias("pages"))


#: Weights of a link from a symptom table and of an inherited one; inherited links per symptom.
TABLE_WEIGHT, INHERITED_WEIGHT, INHERITED_MOST = 1.0, 0.45, 20


def symptom_links(table: DataFrame, symptoms: DataFrame, codes: DataFrame) -> DataFrame:
    """Links (symptom, code, weight): those of symptom tables, and of each symptom the first codes of its subsystem.

    Only the first codes of a subsystem are joined, so a subsystem of very many codes makes no more pairs than one of few.
    """
    first = codes.withColumn("_n", F.row_number().over(Window.partitionBy("subsystem").orderBy("code"))).filter(F.col("_n") <= INHERITED_MOST)
    inherited = symptoms.join(first, "subsystem").select("symptom", "code", F.lit(INHERITED_WEIGHT).alias("weight"))
    both = table.select("symptom", "code", F.lit(TABLE_WEIGHT).alias("weight")).unionByName(inherited)
    return both.groupBy("symptom", "code").agg(F.max("weight").alias("weight"))


def codes_of(asked: DataFrame, asked_code: str, codes: DataFrame) -> DataFrame:
    """Codes equal to an asked one, or that continue it after a hyphen: an equality join on what stands before the first hyphen."""
    heads = codes.select("code", F.explode(F.array_distinct(F.array("code", F.substring_index("code", "-", 1)))).alias(asked_code))
    return asked.join(heads, asked_code)


def symptom_strengths(met: DataFrame, vector_weight: float, keyword_weight: float, floor: float, k: int) -> DataFrame:
    """Symptoms of each question by 50 x fused reciprocal ranks + similarity, those of at least floor, k at most.

    met has question_id, symptom, vector_rank, keyword_rank, sim.
    """
    rrf = vector_weight / (60 + F.col("vector_rank")) + keyword_weight / (60 + F.col("keyword_rank"))
    g = met.groupBy("question_id", "symptom").agg(F.max("sim").alias("sim"), F.sum(rrf).alias("rrf")).filter(F.col("sim") >= floor)
    scored = g.select("question_id", "symptom", F.round(50 * F.col("rrf") + F.col("sim"), 6).alias("strength"))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("strength"), "symptom"))
    return scored.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def payloads(codes: DataFrame, parts: dict[str, tuple[DataFrame, list[Column], str, int]]) -> DataFrame:
    """Codes with lists of bounded length, each the first k values of a relation in an order; a code without any has empty lists."""
    out = codes
    for name, (rows, order, value, k) in parts.items():
        few = rows.withColumn("_n", F.row_number().over(Window.partitionBy("code").orderBy(*order))).filter(F.col("_n") <= k)
        lists = few.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", value))), lambda x: x[value]).alias(name))
        out = out.join(lists, "code", "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    return out


def grounded_questions(evidence: DataFrame, floor: float) -> DataFrame:
    """Whether a question's evidence (from_table, sim) holds: a link from a table, or a similarity of at least floor."""
    return evidence.groupBy("question_id").agg((F.bool_or("from_table") | (F.max("sim") >= floor)).alias("grounded"))
