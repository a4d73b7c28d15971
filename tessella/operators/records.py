"""Records for training: chats, tool trajectories, environments; and what is retrieved for an agent's questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.texts import search_terms


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def reasoning_messages(question: Column, evidence: Column, schema: Column, plan: Column, sql: Column) -> Column:
    """system, user and assistant message: the answer has numbered plan steps and the SQL in tags."""
    numbered = F.array_join(F.transform(plan, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")
    answer = F.concat(F.lit("<plan>\n"), numbered, F.lit("\n</plan>\n<sql>\n"), F.regexp_replace(sql, r"^\s+|\s+$", ""), F.lit("\n</sql>"))
    asked = F.concat(F.lit("Schema:\n"), schema, F.lit("\nEvidence: "), F.coalesce(F.nullif(F.trim(evidence), F.lit("")), F.lit("(none)")), F.lit("\nQuestion: "), F.trim(question))
    return F.array(message("system", F.lit("Plan the query first, then write it.")), message("user", asked), message("assistant", answer))


def tool_steps(steps: DataFrame, key: str) -> DataFrame:
    """key, messages: an assistant message with its call for each step (place, action, arguments, observation), each but a submission and the last followed
    by what the tool said. A trajectory is one array, so it has to fit in a row."""
    last = F.col("place") == F.max("place").over(Window.partitionBy(key))
    call = F.struct(F.col("place").alias("p"), F.lit(0).alias("q"), F.lit("assistant").alias("role"), F.to_json(F.struct(F.col("action").alias("name"), "arguments")).alias("content"))
    said = F.when((F.col("action") != "submit_solution") & ~F.col("__last"), F.struct(F.col("place").alias("p"), F.lit(1).alias("q"), F.lit("tool").alias("role"), F.col("observation").alias("content")))
    rows = steps.withColumn("__last", last).select(key, F.explode(F.array_compact(F.array(call, said))).alias("m"))
    listed = F.array_sort(F.collect_list("m"))
    return rows.groupBy(key).agg(F.transform(listed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def environment_record(task_id: Column, db_id: Column, drift: Column, question: Column, stale: Column, repaired: Column, rows: Column, digest: Column, tools: list[str]) -> Column:
    """One task as an environment: what it draws on, its prompt, the truth, and for each tool what it is made with."""
    made = F.struct(db_id.alias("db_id"), F.lit("v2").alias("db_version"), stale.alias("stale_sql"), repaired.alias("ground_truth"), F.struct(rows.alias("row_count"), digest.alias("value_hash")).alias("result_fingerprint"))
    return F.struct(
        F.concat(F.lit("tasks/"), F.array_join(F.array_sort(F.array_distinct(drift)), "+")).alias("data_source"),
        F.array(message("user", question)).alias("prompt"),
        repaired.alias("ground_truth"),
        F.struct(task_id.alias("instance_id"), *(made.alias(t) for t in tools)).alias("extra_info"),
    )


def balanced_copies(action: Column, drift: Column) -> Column:
    """How often a next-action example stands in the balanced mixture: once more for a submission, once more for the hard kinds of drift."""
    return F.lit(1) + (action == "submit_solution").cast("int") + drift.isin("add_column", "compound").cast("int")


def clarified(questions: DataFrame, key: str, order: str, ambiguities: DataFrame, budget: int = 3) -> DataFrame:
    """term and outcome for each question (key, order, task, question): matched, repeated, unanswerable, empty or over_budget.

    Candidates are the ambiguities of its task (term, priority 0 or 1) that it names or shares a term with: a whole phrase first, then
    the larger overlap, the lower priority, the first term by name. Non-empty questions beyond the budget aren't answered.
    """
    said = F.trim("question") != ""
    so_far = Window.partitionBy("task").orderBy(order)
    rows = questions.withColumn("__n", F.sum(said.cast("int")).over(so_far))
    words = F.array_size(F.array_intersect(search_terms(F.col("question")), search_terms(F.col("term"))))
    phrase = F.contains(F.lower("question"), F.lower("term")) & (F.col("term") != "")
    met = rows.where(said & (F.col("__n") <= budget)).join(ambiguities, "task").withColumns({"__words": words, "__phrase": phrase}).where("__words > 0 OR __phrase")
    ranked = met.groupBy(key).agg(F.min(F.struct((~F.col("__phrase")).alias("a"), (-F.col("__words")).alias("b"), F.col("priority").alias("c"), F.col("term").alias("term"))).alias("x"))
    out = rows.join(ranked.select(key, "x.term"), key, "left")
    first = F.row_number().over(Window.partitionBy("task", "term").orderBy(order)) == 1
    outcome = F.when(~said, "empty").when(F.col("__n") > budget, "over_budget").when(F.col("term").isNull(), "unanswerable").when(first, "matched").otherwise("repeated")
    return out.withColumn("outcome", outcome).select(key, "term", "outcome")


def ranked_blocks(questions: DataFrame, key: str, query: str, blocks: DataFrame, most_chars: int) -> DataFrame:
    """key, blocks (all names, in order, as text), truncated: the schema blocks (place, name, block; a small dimension) that share terms with each question, most first.

    A question that shares none, or is null, gets all, in their order. ``truncated``: joined by blank lines they are longer than ``most_chars``. For a base of any size,
    with the names up to the cut, there is ``retrieval.ranked_blocks``.
    """
    held = F.array_sort(F.collect_list(F.struct("place", "name", F.length("block").alias("size"), search_terms(F.col("block")).alias("terms"))))
    rows = questions.select(key, search_terms(F.coalesce(F.col(query), F.lit(""))).alias("asked")).crossJoin(F.broadcast(blocks.agg(held.alias("held"))))
    scored = F.transform("held", lambda b: F.struct((-F.array_size(F.array_intersect("asked", b["terms"]))).alias("s"), b["place"].alias("place"), b["name"].alias("name"), b["size"].alias("size")))
    rows = rows.withColumn("scored", F.array_sort(scored))
    some = F.filter("scored", lambda b: b["s"] < 0)
    rows = rows.withColumn("chosen", F.when(F.size(some) > 0, some).otherwise(F.col("scored")))
    total = F.aggregate("chosen", F.lit(0), lambda a, b: a + b["size"]) + 2 * (F.size("chosen") - 1)
    return rows.select(key, F.array_join(F.transform("chosen", lambda b: b["name"]), ",").alias("blocks"), (total > most_chars).alias("truncated"))


def packed_context(questions: DataFrame, key: str, text: str, needed: str, objects: DataFrame, budget: int) -> DataFrame:
    """key, chosen: names of the objects (name, ddl; a small dimension) that go into a prompt, sorted: the needed ones, then others by shared terms (the
    shorter, then the later name first among equals) as far as each fits the budget; one that doesn't fit is passed over."""
    held = F.array_sort(F.collect_list(F.struct("name", (F.length("ddl") + 2).alias("size"), search_terms(F.concat_ws(" ", "name", "ddl")).alias("terms"))))
    rows = questions.select(key, F.col(needed).alias("needed"), search_terms(F.col(text)).alias("asked")).crossJoin(F.broadcast(objects.agg(held.alias("held"))))
    is_needed = lambda o: F.array_contains("needed", o["name"])
    rows = rows.withColumn("start", F.filter("held", is_needed))
    others = F.transform(F.filter("held", lambda o: ~is_needed(o)), lambda o: F.struct(F.array_size(F.array_intersect("asked", o["terms"])).alias("s"), (-o["size"]).alias("z"), o["name"].alias("name")))
    rows = rows.withColumn("others", F.reverse(F.array_sort(others)))
    begin = F.struct(F.aggregate("start", F.lit(0), lambda a, o: a + o["size"]).alias("used"), F.transform("start", lambda o: o["name"]).alias("names"))
    add = lambda a, o: F.when(a["used"] - o["z"] <= budget, F.struct((a["used"] - o["z"]).alias("used"), F.array_append(a["names"], o["name"]).alias("names"))).otherwise(a)
    return rows.select(key, F.array_sort(F.aggregate("others", begin, add)["names"]).alias("chosen"))
